"""Window helpers on panels keyed by series and ordered by t."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing
#: Below this a standard deviation counts as zero and a z-score is 0, not null.
FLAT = 1e-12


def ordered(*keys: str, by: str = "t") -> WindowSpec:
    """Rows of one key in time order; the default key is series_id."""
    return Window.partitionBy(*(keys or ("series_id",))).orderBy(by)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def past(w: WindowSpec) -> WindowSpec:
    """All rows strictly before the current one."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def so_far(w: WindowSpec) -> WindowSpec:
    """All rows up to the current one."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite (missing values are nulls, never NaN)."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def full(agg: Column, counted: Column, n: int) -> Column:
    """agg where the frame holds n valid values, else null: a rolling statistic without early rows."""
    return F.when(counted >= n, agg)


def z_of(x: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd, 0 where sd is flat."""
    return F.when(sd.isNull(), None).when(sd <= FLAT, 0.0).otherwise((x - mean) / sd)


def expanding_z(df: DataFrame, raw: str, out: str = "score", roll: int = 10, min_expanding: int = 60, skip: int = 0, form: str = "signed", keys: tuple[str, ...] = ("series_id",), least: int = 10) -> DataFrame:
    """The regime score: rolling mean of raw, as a z-score against all smoothed rows before it.

    The past is rows [skip, t) and needs `least` valid values; rows before max(min_expanding, skip)
    are null; a flat past gives 0. form: signed, abs, positive (max with 0) or negated. roll=1
    leaves raw as it is.
    """
    w = ordered(*keys)
    smooth = F.avg(raw).over(last_n(w, roll)) if roll > 1 else F.col(raw)
    df = df.withColumn("_s", smooth).withColumn("_p", F.when(F.col("t") >= skip, F.col("_s")))
    p = past(w)
    df = df.withColumn("_m", F.avg("_p").over(p)).withColumn("_d", F.stddev_samp("_p").over(p)).withColumn("_n", F.count("_p").over(p))
    z = z_of(F.col("_s"), F.col("_m"), F.col("_d"))
    z = {"signed": z, "abs": F.abs(z), "positive": F.greatest(z, F.lit(0.0)), "negated": -z}[form]
    z = F.when((F.col("t") >= max(min_expanding, skip)) & (F.col("_n") >= least) & F.col("_s").isNotNull(), z)
    return df.withColumn(out, z).drop("_s", "_p", "_m", "_d", "_n")


def expanding_z_sql(src: str, raw: str, roll: int = 10, min_expanding: int = 60, skip: int = 0, form: str = "signed", keys: str = "series_id", least: int = 10) -> str:
    """The same as a DuckDB subquery: every column of src, and score."""
    smooth = f"avg({raw}) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN {roll - 1} PRECEDING AND CURRENT ROW)" if roll > 1 else raw
    z = "CASE WHEN zd IS NULL THEN NULL WHEN zd <= 1e-12 THEN 0.0 ELSE (zs - zm) / zd END"
    z = {"signed": z, "abs": f"abs({z})", "positive": f"(CASE WHEN ({z}) IS NULL THEN NULL ELSE greatest({z}, 0.0) END)", "negated": f"-({z})"}[form]
    return f"""(SELECT * EXCLUDE (zs, zp, zm, zd, zn), CASE WHEN t >= {max(min_expanding, skip)} AND zn >= {least} AND zs IS NOT NULL THEN {z} END AS score FROM (
  SELECT *, avg(zp) OVER p AS zm, stddev_samp(zp) OVER p AS zd, count(zp) OVER p AS zn
  FROM (SELECT *, CASE WHEN t >= {skip} THEN zs END AS zp FROM (SELECT *, {smooth} AS zs FROM {src}))
  WINDOW p AS (PARTITION BY {keys} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


def forward_fill(df: DataFrame, column: str, out: str | None = None, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """The last valid value up to each row."""
    return df.withColumn(out or column, F.last(column, ignorenulls=True).over(so_far(ordered(*keys))))


def percent_rank_past(df: DataFrame, column: str, out: str, keys: tuple[str, ...] = ("series_id",), include_current: bool = True, least: int = 1) -> DataFrame:
    """Share of the valid values so far that are <= the current one; null with fewer than `least` of them.

    Spark has no running frame function for it. The past of row t is the union of the left halves
    of those blocks of 2, 4, 8, ... rows in whose right half t lies, so one window over (block,
    value) counts them all: n log n rows, dealt by block, none held in memory. t numbers a key's
    rows from 0.
    """
    w = Window.partitionBy(*keys)
    valid = df.where(F.col(column).isNotNull()).select(*keys, "t", F.col(column).alias("_v")).withColumn("_top", F.max("t").over(w))
    levels = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("shiftright", F.col("_top"), k) > 0)
    halves = valid.select(*keys, "t", "_v", F.explode(levels).alias("_k"))
    right = F.call_function("shiftright", F.col("t"), F.col("_k")).bitwiseAND(F.lit(1)) == 1
    halves = halves.withColumn("_b", F.call_function("shiftright", F.col("t"), F.col("_k") + 1)).withColumn("_right", right)
    upto = Window.partitionBy(*keys, "_k", "_b").orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)
    counted = halves.withColumn("_c", F.sum(F.when(F.col("_right"), 0).otherwise(1)).over(upto))
    ranks = counted.where("_right").groupBy(*keys, "t").agg(F.sum("_c").alias("_le"))
    now = F.when(F.col(column).isNotNull(), 1).otherwise(0) if include_current else F.lit(0)
    seen = F.count(column).over(so_far(ordered(*keys))) if include_current else F.count(column).over(past(ordered(*keys)))
    j = df.withColumn("_n", seen).join(ranks, [*keys, "t"], "left")
    share = (F.coalesce("_le", F.lit(0)) + now) / F.col("_n")
    return j.withColumn(out, F.when(F.col(column).isNotNull() & (F.col("_n") >= max(least, 1)), share)).select(*df.columns, out)


def fixed_z_sql(src: str, x: str, n: int, least: int = 5) -> str:
    """series_id, t, z of x against the n rows before, as a DuckDB subquery."""
    return f"(SELECT series_id, t, CASE WHEN count({x}) OVER w >= {least} AND stddev_samp({x}) OVER w > 1e-12 THEN ({x} - avg({x}) OVER w) / stddev_samp({x}) OVER w END AS z FROM {src} WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))"
