"""Panels and series as views over the given tables, each with its DuckDB twin.

PANEL_SQL holds, by name, the DuckDB subquery of every view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, *keys: str, by: str = "ts") -> DataFrame:
    """t = 0, 1, ... within each key, in time order: gaps in dates are not gaps in t."""
    return df.withColumn("t", (F.row_number().over(Window.partitionBy(*keys).orderBy(by)) - 1).cast("long"))


def _day(c: str):
    return F.to_date(c)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prices_weekly: series_id (region), ts, t, close: orders' total price a week. Sums are exact decimals."""
    orders, customer, nation, region = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region"))
    # region and nation hold a fixed handful of rows; the customer join is left to the planner
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    owners = customer.join(F.broadcast(places), customer.c_nationkey == places.n_nationkey).select("c_custkey", "r_name")
    rows = orders.select("o_custkey", "o_totalprice", F.date_trunc("week", "o_orderdate").cast("date").alias("ts")).join(owners, orders.o_custkey == owners.c_custkey)
    sums = rows.groupBy(F.col("r_name").alias("series_id"), "ts").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("close"))
    return numbered(sums, "series_id")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prices_daily: series_id (return flag), ts, t, close: mean extended price a ship day."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series_id"), _day("l_shipdate").alias("ts"), F.col("l_extendedprice").cast("decimal(18,2)").alias("p"))
    sums = rows.groupBy("series_id", "ts").agg((F.sum("p").cast("double") / F.count("p")).alias("close"))
    return numbered(sums, "series_id")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders per region and day, days without orders missing: series_id, ts, t, close."""
    orders, customer, nation, region = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region"))
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    owners = customer.join(F.broadcast(places), customer.c_nationkey == places.n_nationkey).select("c_custkey", "r_name")
    rows = orders.select("o_custkey", "o_totalprice", _day("o_orderdate").alias("ts")).join(owners, orders.o_custkey == owners.c_custkey)
    sums = rows.groupBy(F.col("r_name").alias("series_id"), "ts").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("close"))
    return numbered(sums, "series_id")


def exogenous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, value: the mean discount a ship day, in percent."""
    rows = table(spark, sf_dir, "lineitem").select(_day("l_shipdate").alias("ts"), F.col("l_discount").cast("decimal(18,2)").alias("d"))
    return rows.groupBy("ts").agg((F.sum("d").cast("double") * 100 / F.count("d")).alias("value"))


#: Event windows for studies on the panels: (event_id, start, stop, label, category).
EVENTS = [
    ("e96", "1996-02-05", "1996-04-28", "spring 1996", "conventional"),
    ("e97", "1997-06-30", "1997-10-26", "summer 1997", "novel"),
    ("e98", "1998-08-03", "1998-11-29", "autumn 1998", "conventional"),
    ("e99", "1999-01-04", "1999-03-28", "winter 1999", "novel"),
    ("e00a", "2000-03-06", "2000-06-25", "spring 2000", "conventional"),
    ("e00b", "2000-10-02", "2000-12-24", "autumn 2000", "novel"),
    ("e01", "2001-02-05", "2001-05-27", "spring 2001", "novel"),
]


def events_dim(spark: SparkSession) -> DataFrame:
    """event_id, start, stop, label, category: a fixed dimension."""
    df = spark.createDataFrame(EVENTS, "event_id string, start string, stop string, label string, category string")
    return df.withColumn("start", F.to_date("start")).withColumn("stop", F.to_date("stop"))


EVENTS_SQL = "(SELECT event_id, start::DATE AS start, stop::DATE AS stop, label, category FROM (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in e) + ")" for e in EVENTS) + ") AS v(event_id, start, stop, label, category))"

_OWNERS = "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_T = "(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1)::BIGINT AS t"
PANEL_SQL = {
    "weekly": f"(SELECT *, {_T} FROM (SELECT r_name AS series_id, date_trunc('week', o_orderdate)::DATE AS ts, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS close FROM orders {_OWNERS} GROUP BY ALL))",
    "daily": f"(SELECT *, {_T} FROM (SELECT l_returnflag AS series_id, l_shipdate::DATE AS ts, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*) AS close FROM lineitem GROUP BY ALL))",
    "sparse": f"(SELECT *, {_T} FROM (SELECT r_name AS series_id, o_orderdate::DATE AS ts, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS close FROM orders {_OWNERS} GROUP BY ALL))",
    "exogenous": "(SELECT l_shipdate::DATE AS ts, sum(l_discount::DECIMAL(18,2))::DOUBLE * 100 / count(*) AS value FROM lineitem GROUP BY ALL)",
}
