"""Queries of sources and result tables, and of geometry with operators and segments taken from data."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions.stats import t_density
from tidewatch.operators import evaluate as e
from tidewatch.operators import geometry as g
from tidewatch.sources import panels as p
from tidewatch.sources import results as r
from tidewatch.sources import tables as t

from .evaluation import D_SQL, SCORES, effects, panel_scores
from .features import RET, SP, returns
from .geometry import projected
from .registry import query, rounded, rounded_sql

BARS = "(SELECT event_type AS series_id, date_trunc('day', ts)::DATE AS ts, arg_max(value, (ts, event_id)) AS close, sum(value) AS volume FROM events GROUP BY ALL)"


def stored_bars(spark, sf):
    """The folder of daily bars, written by series."""
    path = f"{r.shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    t.bars(p.table(spark, sf, "events"), "event_type", "value", "event_id").select("series_id", "ts", "close", "volume").write.partitionBy("series_id").parquet(path)
    return path


@query("s1_stored_bars", f"SELECT series_id, ts, round(close, 6) + 0.0 AS close, round(volume, 4) + 0.0 AS volume FROM {BARS} WHERE series_id IN ('view', 'click') AND ts BETWEEN '2024-01-05' AND '2024-01-20'")
def _(spark, sf):
    """Bars of two series and a span of dates from a stored table: both filters reach the scan."""
    b = t.ohlcv(spark, stored_bars(spark, sf), ["view", "click"], "2024-01-05", "2024-01-20")
    return b.select("series_id", "ts", (F.round("close", 6) + 0.0).alias("close"), (F.round("volume", 4) + 0.0).alias("volume"))


@query("s1_fallback", f"SELECT series_id, ts, round(CASE WHEN day(ts) % 4 = 0 THEN volume ELSE close END, 4) + 0.0 AS close FROM {BARS}")
def _(spark, sf):
    """Closes, and where the first source has no row (every fourth day) what the second has instead."""
    b = spark.read.parquet(stored_bars(spark, sf))
    out = t.with_fallback(b.where(F.dayofmonth("ts") % 4 != 0).select("series_id", "ts", "close"), b.select("series_id", "ts", F.col("volume").alias("close")))
    return out.select("series_id", "ts", (F.round("close", 4) + 0.0).alias("close"))


@query("s9_mean_by_date", f"SELECT ts, round(avg(close), 4) + 0.0 AS value FROM {SP} GROUP BY 1")
def _(spark, sf):
    return rounded(t.mean_by_date(p.sparse(spark, sf), "close"), 4)


@query("s11_run_pool", "SELECT vec_id::VARCHAR AS run_id, label::VARCHAR AS group_label, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda v: v::FLOAT::DOUBLE)), 5) + 0.0 AS total, round(embedding[1]::FLOAT::DOUBLE, 6) + 0.0 AS head FROM embeddings WHERE embedding IS NOT NULL")
def _(spark, sf):
    """Every vector as a base64 run of float32 values, decoded again by native functions."""
    v = p.table(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").cast("string").alias("run_id"), F.col("label").cast("string").alias("group_label"), "embedding")
    d = t.runs_from_base64(t.runs_to_base64(v, "embedding"))
    total = F.aggregate("returns", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return d.select("run_id", "group_label", F.size("returns").cast("long").alias("n"), (F.round(total, 5) + 0.0).alias("total"), (F.round(F.col("returns")[0].cast("double"), 6) + 0.0).alias("head"))


LATE = D_SQL.replace(SCORES, f"(SELECT * FROM {SCORES} WHERE t >= 100)")


def two_runs(spark, sf):
    """Two runs of the effect study in one stored table: over all rows, and over those from row 100 on; and the register of runs."""
    root = f"{r.shared_folder(spark)}/study-{uuid.uuid4().hex}"
    cell = [F.concat_ws("/", "method", "series_id").alias("method"), F.col("event_id").alias("event"), "d"]
    late = e.cohens_d(e.group_moments(panel_scores(spark, sf).where("t >= 100"), p.events_dim(spark)))
    for at, (run, note, cells) in enumerate((("all", "canonical", effects(spark, sf)), ("late", "", late))):
        r.write_run(cells.where("d is not null").select(*cell), f"{root}/cells", run)
        r.register_run(spark, f"{root}/runs", run, at, note)
    return spark.read.parquet(f"{root}/cells"), spark.read.parquet(f"{root}/runs")


def cells_sql(src):
    return f"(SELECT method || '/' || series_id AS method, event_id AS event, d FROM {src} WHERE d IS NOT NULL)"


@query("s12_run_tables", f"SELECT 'all' AS run_id, true AS canonical, count(*) AS cells, round(avg(d), 6) AS mean_d FROM {cells_sql(D_SQL)} UNION ALL SELECT 'late', false, count(*), round(avg(d), 6) FROM {cells_sql(LATE)}")
def _(spark, sf):
    cells, runs = two_runs(spark, sf)
    g_ = cells.join(runs, "run_id").join(r.canonical_run(runs).withColumnRenamed("run_id", "_c"))
    return rounded(g_.groupBy("run_id", (F.col("run_id") == F.col("_c")).alias("canonical")).agg(F.count(F.lit(1)).alias("cells"), F.avg("d").alias("mean_d")))


@query("s13_stored_run_diff", f"SELECT coalesce(a.method, b.method) AS method, coalesce(a.event, b.event) AS event, round(b.d - a.d, 6) + 0.0 AS delta, CASE WHEN b.method IS NULL THEN 'removed' WHEN a.method IS NULL THEN 'added' ELSE 'both' END AS state FROM {cells_sql(D_SQL)} a FULL JOIN {cells_sql(LATE)} b ON a.method = b.method AND a.event = b.event")
def _(spark, sf):
    """What changed from the canonical run to the latest one of each method, by the register."""
    cells, runs = two_runs(spark, sf)
    canonical = cells.join(r.canonical_run(runs), "run_id")
    newest = r.latest_run(cells.select("method", "run_id").distinct().join(runs, "run_id"))
    return rounded(r.run_diff(canonical, cells.join(newest, ["method", "run_id"])))


@query("p12_student_density", rounded_sql("series_id, t", "density=exp(lgamma(3.0) - lgamma(2.5)) / (sqrt(5 * 3.141592653589793::DOUBLE) * 0.05) * (1 + (ret / 0.05) ** 2 / 5) ** (-3.0)", f"(SELECT * FROM {RET} WHERE ret IS NOT NULL)"))
def _(spark, sf):
    x = returns(spark, sf).where("ret is not null")
    return rounded(x.select("series_id", "t", t_density(F.col("ret"), F.lit(5.0), F.lit(0.05)).alias("density")))


@query("m4_operator_table")
def _(spark, sf):
    """The embedding with operators from a table: covariances of a row's features at three lags, as symmetric matrices."""
    x = projected(spark, sf)
    w = Window.partitionBy("series_id").orderBy("t")
    table = None
    for k in range(3):
        rows = x.withColumn("_y", F.lag("x", k).over(w)).where("_y is not null").select(F.posexplode("x").alias("i", "u"), "_y").select("i", "u", F.posexplode("_y").alias("j", "v"))
        one = rows.groupBy("i", "j").agg(F.avg(F.col("u") * F.col("v")).alias("re"))
        sym = one.join(one.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("re").alias("_t")), ["i", "j"]).select(F.lit(k).alias("k"), "i", "j", ((F.col("re") + F.col("_t")) / 2).alias("re"), F.lit(0.0).alias("im"))
        table = sym if table is None else table.unionByName(sym)
    out = g.spectral_embed(x, g.operators_from(table))
    return rounded(out.select("series_id", "t", F.element_at("spectrum", 1).alias("energy"), g.gap().alias("gap")))


@query("g6_segment_lengths")
def _(spark, sf):
    """The geodesic length between a series' mean points of one year and the next."""
    x = projected(spark, sf).select("series_id", F.year("ts").alias("year"), F.posexplode("x").alias("i", "v")).groupBy("series_id", "year", "i").agg(F.avg("v").alias("v"))
    c = x.groupBy("series_id", "year").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("b"))
    c = c.withColumn("a", F.lag("b").over(Window.partitionBy("series_id").orderBy("year"))).where("a is not null").withColumn("id", F.concat_ws("/", "series_id", "year"))
    return rounded(g.segment_lengths(c.select("id", "a", "b"), g.basis("random", 4, 3)))


@query("g28_grid_chern")
def _(spark, sf):
    """Plaquette phases over a grid around the panel's points in their first two directions."""
    at = projected(spark, sf).select(F.col("x")[0].alias("a"), F.col("x")[1].alias("b")).agg(F.avg("a"), F.avg("b"), F.greatest(F.stddev_pop("a"), F.stddev_pop("b"))).first()
    return rounded(g.grid_chern(spark, g.basis("random", 4, 2), 24, 2 * at[2], (at[0], at[1])))
