"""Parameter sweeps, variant panels and per-event ratios: tables of parameters joined to the same pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.windows import FLAT, expanding_z, last_n, ordered

from .evaluate import cohens_d, group_moments
from .joins import event_members


def volatility_variants(returns: DataFrame, params: list[tuple[str, int, int]]) -> DataFrame:
    """Scores of the rolling-volatility detector for every (method, window, roll): series_id, method, ts, t, score.

    All variants' deviations and means are window columns of one pass over a series' rows, then
    stacked into rows; a variant costs a column, not another read.
    """
    by = ordered()
    wide = returns.withColumns({f"_x{i}": F.when(F.count("ret").over(last_n(by, n)) >= n, F.stddev_samp("ret").over(last_n(by, n))) for i, (_, n, _) in enumerate(params)})
    wide = wide.withColumns({f"_x{i}": F.avg(f"_x{i}").over(last_n(by, r)) for i, (_, _, r) in enumerate(params) if r > 1})
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"_x{i}").alias("x")) for i, (m, _, _) in enumerate(params)]))
    x = wide.select("series_id", "ts", "t", stacked.alias("_s")).select("series_id", "ts", "t", "_s.*")
    return expanding_z(x, "x", roll=1, form="abs", keys=("series_id", "method")).select("series_id", "method", "ts", "t", "score")


def sweep(scores: DataFrame, events: DataFrame) -> DataFrame:
    """series_id, best (method of the largest median effect), median_d: the objective of a parameter sweep over events."""
    d = cohens_d(group_moments(scores, events)).where("d is not null")
    g = d.groupBy("series_id", "method").agg(F.round(F.percentile("d", F.lit(0.5)), 6).alias("median_d"))
    return g.groupBy("series_id").agg(F.max_by("method", F.struct("median_d", "method")).alias("best"), F.max("median_d").alias("median_d"))


def collapse_ratios(df: DataFrame, x: str, events: DataFrame, trailing: int = 252) -> DataFrame:
    """series_id, event_id, collapse (least x in the event over the mean of the rows before it) and intensity (largest over their median)."""
    inside = event_members(df, events).groupBy("series_id", "event_id").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.min("t").alias("t0"))
    before = inside.select("series_id", "event_id", F.explode(F.sequence(F.greatest(F.col("t0") - trailing, F.lit(0)), F.col("t0") - 1)).alias("t"))
    past = before.join(df.select("series_id", "t", F.col(x).alias("_x")), ["series_id", "t"]).groupBy("series_id", "event_id").agg(F.avg("_x").alias("mean"), F.percentile("_x", F.lit(0.5)).alias("median"))
    j = inside.where("t0 > 0").join(past, ["series_id", "event_id"])
    return j.select("series_id", "event_id", F.when(F.abs("mean") > FLAT, F.col("lo") / F.col("mean")).alias("collapse"), F.when(F.abs("median") > FLAT, F.col("hi") / F.col("median")).alias("intensity"))


def attribute_split(ratios: DataFrame, attributes: DataFrame, x: str) -> DataFrame:
    """series_id, Welch's t of per-event ratios between events of category 'novel' and the others, and both means (null with fewer than two events on a side)."""
    j = ratios.join(F.broadcast(attributes.select("event_id", "category")), "event_id").where(F.col(x).isNotNull())
    side = lambda f, yes: f(F.when((F.col("category") == "novel") == F.lit(yes), F.col(x)))
    g = j.groupBy("series_id").agg(side(F.count, True).alias("n1"), side(F.avg, True).alias("m1"), side(F.var_samp, True).alias("v1"), side(F.count, False).alias("n2"), side(F.avg, False).alias("m2"), side(F.var_samp, False).alias("v2"))
    return g.select("series_id", F.col("m1").alias("novel"), F.col("m2").alias("other"), ((F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))).alias("t"))


def regime_signature(df: DataFrame, curvature: str, gap: str, segment: str, every: int = 10) -> DataFrame:
    """Moments of a segment's curvature (population, deviations + 1e-8) and of every `every`-th row's gap."""
    keys = ["series_id", segment]
    rows = df.where(F.col(curvature).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1)
    m = rows.groupBy(*keys).agg(F.avg(curvature).alias("m"), F.stddev_pop(curvature).alias("s"))
    u = (F.col(curvature) - F.col("m")) / (F.col("s") + 1e-8)
    sampled = F.when(F.col("_i") % every == 0, F.col(gap))
    return rows.join(m, keys).groupBy(*keys).agg(
        F.max("m").alias("curvature_mean"), F.max("s").alias("curvature_std"), F.avg(F.pow(u, 3)).alias("curvature_skewness"), (F.avg(F.pow(u, 4)) - 3).alias("curvature_kurtosis"), F.avg(sampled).alias("gap_mean"), F.stddev_pop(sampled).alias("gap_std")
    )


def scale_signals(df: DataFrame, x: str, scales: dict[int, float]) -> DataFrame:
    """series_id, t, scale, weight, signal: the size of changes of x's rolling means, over their rolling deviation.

    The deviation spans max(60, 3 * scale) rows, needs 20, and is filled backwards, then forwards (backwards looks ahead).
    """
    out = None
    for scale, weight in scales.items():
        w = ordered()
        s = df.withColumn("_c", F.avg(x).over(last_n(w, scale))).where("_c is not null")
        s = s.withColumn("_d", F.abs(F.col("_c") - F.coalesce(F.lag("_c").over(w), F.col("_c"))))
        n = last_n(w, max(60, 3 * scale))
        s = s.withColumn("_n", F.when(F.count("_d").over(n) >= 20, F.stddev_samp("_d").over(n)))
        ahead, behind = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
        s = s.withColumn("_n", F.coalesce(F.first("_n", ignorenulls=True).over(ahead), F.last("_n", ignorenulls=True).over(behind)))
        s = s.select("series_id", "t", F.lit(scale).alias("scale"), F.lit(float(weight)).alias("weight"), (F.col("_d") / (F.col("_n") + 1e-8)).alias("signal"))
        out = s if out is None else out.unionByName(s)
    return out


def scale_consensus(signals: DataFrame, threshold: float = 0.6) -> DataFrame:
    """series_id, t, consensus (weighted mean of signals over scales that all have one) and its onsets beyond the threshold."""
    total = F.sum("weight").over(Window.partitionBy("series_id", "t"))
    g = signals.withColumn("_w", total).groupBy("series_id", "t").agg((F.sum(F.col("weight") * F.col("signal")) / F.max("_w")).alias("consensus"))
    above = F.round("consensus", 9) >= threshold
    return g.withColumn("onset", above & ~F.coalesce(F.lag(above).over(ordered()), F.lit(False)))


def scale_correlations(signals: DataFrame) -> DataFrame:
    """series_id, scale_a, scale_b, rho of every two scales' signals."""
    a = signals.select("series_id", "t", F.col("scale").alias("scale_a"), F.col("signal").alias("_x"))
    b = signals.select("series_id", "t", F.col("scale").alias("scale_b"), F.col("signal").alias("_y"))
    return a.join(b, ["series_id", "t"]).where("scale_a < scale_b").groupBy("series_id", "scale_a", "scale_b").agg(F.corr("_x", "_y").alias("rho"))


def turbulence_pair(df: DataFrame, x: str, y: str, min_expanding: int = 60, ridge: float = 1e-6) -> DataFrame:
    """Turbulence of two features: the Mahalanobis distance of a row from all rows up to it, by running moments in closed form; absolute z."""
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    n, mx, my = F.count(a).over(w), F.avg(a).over(w), F.avg(b).over(w)
    r = df.withColumns({"_n": n, "_mx": mx, "_my": my, "_sxx": F.var_pop(a).over(w) + ridge, "_syy": F.var_pop(b).over(w) + ridge, "_sxy": F.covar_pop(a, b).over(w)})
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    q = (dx * dx * F.col("_syy") - 2 * dx * dy * F.col("_sxy") + dy * dy * F.col("_sxx")) / (F.col("_sxx") * F.col("_syy") - F.col("_sxy") * F.col("_sxy"))
    r = r.withColumn("turbulence", F.when(ok & (F.col("t") >= min_expanding) & (F.col("_n") >= 4), F.sqrt(F.greatest(q, F.lit(0.0)))))
    return expanding_z(r.drop("_n", "_mx", "_my", "_sxx", "_syy", "_sxy"), "turbulence", roll=1, form="abs", min_expanding=min_expanding)


def bound_checks(df: DataFrame, curvature: str, gap: str) -> DataFrame:
    """series_id, constant (largest |curvature| * gap^2), share of rows within half of it, and the mean distance of the curvature to whole numbers."""
    ok = df.where(F.col(curvature).isNotNull() & F.col(gap).isNotNull())
    r = ok.withColumn("_r", F.abs(curvature) * F.pow(gap, 2))
    g = r.groupBy("series_id").agg(F.max("_r").alias("constant"))
    return r.join(g, "series_id").groupBy("series_id").agg(F.max("constant").alias("constant"), F.avg((F.col("_r") <= F.col("constant") / 2).cast("double")).alias("share"), F.avg(F.abs(F.col(curvature) - F.rint(curvature))).alias("to_integer"), F.count(F.lit(1)).alias("n"))

