"""Sources: raw tables into panels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidewatch.functions.windows import forward_fill, ordered, so_far


def ohlcv(spark: SparkSession, path: str, symbols: list[str], start: str, stop: str, format: str = "parquet", schema: str | None = None) -> DataFrame:
    """Price rows of some symbols and dates; both filters reach the scan."""
    reader = spark.read.format(format)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df.where(F.col("series_id").isin(symbols) & F.col("ts").between(start, stop))


def bars(ticks: DataFrame, series: str, price: str, tie: str, unit: str = "day") -> DataFrame:
    """Open, high, low, close and volume (sum) of ticks by series and time unit; equal times are ordered by `tie`."""
    at = F.struct("ts", tie)
    b = ticks.groupBy(F.col(series).alias("series_id"), F.date_trunc(unit, "ts").alias("_u")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(price).alias("volume")
    )
    ts = F.to_date("_u") if unit in ("day", "week", "month") else F.col("_u").cast("timestamp")
    return b.select("series_id", ts.alias("ts"), "open", "high", "low", "close", "volume")


def from_epoch_millis(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis(column)).drop(column)


def level_from_returns(df: DataFrame, ret: str = "ret", base: float = 100.0) -> DataFrame:
    """Level rebuilt from returns, a null return counting as 0."""
    return df.withColumn("level", base * F.exp(F.sum(F.log1p(F.coalesce(ret, F.lit(0.0)))).over(so_far(ordered()))))


def daily_trades(trades: DataFrame, coverage: float = 0.5) -> DataFrame:
    """id, ts, price (a day's earliest trade), vol, vwap; ids with fewer than `coverage` of all dates are left out."""
    v, pr = (F.col(c).cast("decimal(18,2)") for c in "vp")
    d = trades.groupBy("id", "ts").agg(F.min_by("p", "at").alias("price"), F.sum(v).cast("double").alias("vol"), (F.sum(pr * v).cast("double") / F.sum(v).cast("double")).alias("vwap"))
    dates = d.agg(F.countDistinct("ts").alias("_dates"))  # one row
    enough = d.groupBy("id").agg(F.count(F.lit(1)).alias("_have")).join(F.broadcast(dates), F.col("_have") >= coverage * F.col("_dates"))
    return d.join(enough.select("id"), "id", "left_semi")


def carried(df: DataFrame, column: str) -> DataFrame:
    return forward_fill(df, column)


def tenor_pivot(surface: DataFrame, tenors: tuple[int, int] = (30, 91)) -> DataFrame:
    """ts, iv<tenor> columns (mean a date) and slope = first - second."""
    a, b = tenors
    w = surface.where(F.col("days").isin(list(tenors))).groupBy("ts").pivot("days", list(tenors)).agg(F.avg("iv"))
    return w.select("ts", F.col(str(a)).alias(f"iv{a}"), F.col(str(b)).alias(f"iv{b}"), (F.col(str(a)) - F.col(str(b))).alias("slope"))


def mean_by_date(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("ts").agg(F.avg(value).alias("value"))


def runs_from_base64(df: DataFrame) -> DataFrame:
    """run_id, group_label, payload (base64 of little-endian float32) -> returns array<float>, by native byte functions."""
    hexed = F.hex(F.unbase64("payload"))
    n = (F.length(hexed) / 8).cast("int")
    word = lambda i: F.concat(*[F.substr(hexed, i * 8 + 7 - 2 * k, F.lit(2)) for k in range(4)])

    def value(i):
        bits = F.conv(word(i), 16, 10).cast("long")
        sign = F.when(F.shiftright(bits, 31).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
        exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255)).cast("double")
        fraction = bits.bitwiseAND(F.lit(0x7FFFFF)).cast("double") / float(1 << 23)
        return (sign * F.when(exponent == 0, fraction * 2.0**-126).otherwise((1.0 + fraction) * F.pow(F.lit(2.0), exponent - 127))).cast("float")

    seq = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return df.select("run_id", "group_label", F.transform(seq, value).alias("returns"))


def with_fallback(*sources: DataFrame) -> DataFrame:
    """Rows of the first source, and of each next one those (series_id, ts) that no source before it has; columns by name."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df.join(out.select("series_id", "ts"), ["series_id", "ts"], "left_anti"))
    return out


@F.arrow_udf(BinaryType())
def _float_bytes(column: pa.Array) -> pa.Array:
    return pa.array([None if v is None else np.asarray(v, "<f4").tobytes() for v in column.to_pylist()], pa.binary())


def runs_to_base64(df: DataFrame, values: str) -> DataFrame:
    """run_id, group_label, payload: an array as base64 of little-endian float32, what runs_from_base64 reads; a null array has none."""
    return df.select("run_id", "group_label", F.base64(_float_bytes(F.col(values).cast("array<float>"))).alias("payload"))
