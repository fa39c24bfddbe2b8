"""Indicators, curvature integrals and transitions on emitted observable columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.windows import last_n, ordered

from .features import onsets


def level_indicator(df: DataFrame, x: str, window: int, k: float, below: bool = True, out: str = "transition") -> DataFrame:
    """TRUE where x leaves its rolling mean (half a window of values at least, the row included) by k deviations; and its onsets."""
    w = last_n(ordered(), window)
    enough = F.count(x).over(w) >= window // 2
    limit = F.round(F.avg(x).over(w) + (-k if below else k) * F.stddev_samp(x).over(w), 9)
    hit = (F.col(x) < limit) if below else (F.col(x) > limit)
    df = df.withColumn(out, F.coalesce(enough & hit, F.lit(False)))
    return df.withColumn("onset", onsets(out))


def curvature_integral(df: DataFrame, f: str, a: str, b: str) -> DataFrame:
    """piece: trapezoid of f over |dx_a dx_b| / 2 pi between a row and the next (null on the last)."""
    w = ordered()
    step = F.abs(F.lead(a).over(w) - F.col(a)) * F.abs(F.lead(b).over(w) - F.col(b))
    return df.withColumn("piece", (F.col(f) + F.lead(f).over(w)) / 2 * step / (2 * 3.141592653589793))


def rolling_integral(df: DataFrame, window: int, stride: int = 1) -> DataFrame:
    """chern: sum of the pieces inside the last `window` rows, every stride-th row."""
    w = ordered().rowsBetween(-(window - 1), -1)
    return df.withColumn("chern", F.when(F.col("t") >= window - 1, F.sum("piece").over(w))).where(F.col("t") % stride == 0)


def transitions(df: DataFrame, x: str, threshold: float, smooth: int = 5, apart: int = 10) -> DataFrame:
    """Rows where the smoothed x changes by more than threshold, `apart` rows at least after the last one taken.

    Each taken row skips what follows: a fold over a series' candidates, which are few.
    """
    df = df.withColumn("_s", F.avg(x).over(last_n(ordered(), smooth)))
    df = df.withColumn("change", F.abs(F.col("_s") - F.lag("_s").over(ordered()))).where(F.col("change") > threshold)
    c = df.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "change"))).alias("c"))
    taken = F.aggregate("c", F.slice("c", 1, 0), lambda acc, s: F.when((F.size(acc) == 0) | (s["t"] >= F.try_element_at(acc, F.lit(-1))["t"] + apart), F.concat(acc, F.array(s))).otherwise(acc))
    return c.select("series_id", F.explode(taken).alias("s")).select("series_id", "s.t", "s.change")


def scale_transitions(by_scale: dict[int, DataFrame], x: str, threshold: float = 0.5, smooth: int = 5, apart: int = 10) -> DataFrame:
    """series_id, scale, t, change, a, b, confirmations, confirmed: transitions of x at several scales, and how many others confirm each.

    by_scale holds the series of x over windows of each length. Within a scale transitions are `apart` rows at
    least from the one taken before; each spans its window's rows [a, b]. One is confirmed if at least
    half as many others of its series as there are scales overlap it, whatever their scale.
    """
    from .joins import interval_overlaps

    found = None
    for k, df in by_scale.items():
        one = transitions(df, x, threshold, smooth, apart).select("series_id", F.lit(k).alias("scale"), "t", "change", F.greatest(F.col("t") - k + 1, F.lit(0)).alias("a"), F.col("t").alias("b"))
        found = one if found is None else found.unionByName(one)
    found = found.withColumn("id", F.concat_ws("/", "series_id", "scale", "t"))
    over = interval_overlaps(found.select("series_id", "id", "a", "b"), cell=max(by_scale), same_series=True)
    out = found.join(over.select("id", F.col("n").alias("confirmations")), "id")
    return out.select("series_id", "scale", "t", "change", "a", "b", "confirmations", (F.col("confirmations") >= len(by_scale) // 2).alias("confirmed"))


def classify_events(df: DataFrame, events: DataFrame, x: str, pad: int = 100) -> DataFrame:
    """series_id, event_id, means before, during and after, and a class.

    REGIME_CHANGE: after differs from before by more than a deviation of before; EXTREME_EVENT:
    during does but after doesn't; NORMAL_FLUCTUATION otherwise.
    """
    from .joins import lower_bound

    a = lower_bound(df, events, "start").withColumnRenamed("t0", "t1")
    b = lower_bound(df, events, "stop").withColumnRenamed("t0", "t2")
    spans = a.join(b, ["series_id", "event_id"])
    rows = spans.withColumn("t", F.explode(F.sequence(F.col("t1") - pad, F.col("t2") + pad))).join(df.select("series_id", "t", x), ["series_id", "t"])
    part = F.when(F.col("t") < F.col("t1"), "before").when(F.col("t") <= F.col("t2"), "during").otherwise("after")
    m = rows.withColumn("part", part).groupBy("series_id", "event_id").agg(
        *[F.avg(F.when(F.col("part") == k, F.col(x))).alias(k) for k in ("before", "during", "after")], F.stddev_samp(F.when(F.col("part") == "before", F.col(x))).alias("sd")
    )
    kind = F.when(F.abs(F.col("after") - F.col("before")) > F.col("sd"), "REGIME_CHANGE").when(F.abs(F.col("during") - F.col("before")) > F.col("sd"), "EXTREME_EVENT").otherwise("NORMAL_FLUCTUATION")
    return m.select("series_id", "event_id", "before", "during", "after", kind.alias("kind"))


def composite_index(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """index: weighted sum of full-series z-scores of indicator columns (uses the whole series); negative weights flip signs."""
    from pyspark.sql import Window

    w = Window.partitionBy("series_id")
    total = sum(abs(v) for v in weights.values())
    out = F.lit(0.0)
    for c, v in weights.items():
        sd = F.stddev_samp(c).over(w)
        out = out + F.when(sd > 1e-12, v * (F.col(c) - F.avg(c).over(w)) / sd).otherwise(0.0)
    return df.withColumn("index", out / total)
