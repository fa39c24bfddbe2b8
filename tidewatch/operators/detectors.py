"""Classical and distribution-distance detectors: panel -> series_id, ts, t, method, score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.windows import expanding_z, FIRST, FLAT, LAST, last_n, ordered, so_far

from .features import discretised, linear_recursion

Detector = Callable[[DataFrame], DataFrame]
REGISTRY: dict[str, tuple[Detector, dict]] = {}


def detector(name: str, **defaults):
    """Registers a detector and its parameters by name."""

    def keep(f):
        REGISTRY[name] = (f, defaults)
        return f

    return keep


def score_with(df: DataFrame, name: str, **params) -> DataFrame:
    """Scores of a registered detector on a returns panel (series_id, ts, t, ret)."""
    f, defaults = REGISTRY[name]
    out = f(df, **(defaults | params))
    return out.select("series_id", "ts", "t", F.lit(name).alias("method"), "score")


def all_scores(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One table of the scores of many detectors."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [score_with(df, n) for n in names or list(REGISTRY)])


@detector("rolling_vol")
def rolling_vol(df: DataFrame, window: int = 20, min_expanding: int = 60) -> DataFrame:
    """Rolling deviation (any number of rows from two), as an absolute expanding z."""
    return expanding_z(df.withColumn("_x", F.stddev_samp("ret").over(last_n(ordered(), window))), "_x", roll=1, min_expanding=min_expanding, form="abs")


@detector("cusum")
def cusum(df: DataFrame, k: float = 0.5, warm: int = 60) -> DataFrame:
    """Two-sided CUSUM of returns standardised by the first `warm` rows; the recursion max(0, S + z - k) in closed form.

    S+ = P - min(0, least P so far) with P the cumulated z - k, and likewise below.
    """
    base = df.where(F.col("t") < warm).groupBy("series_id").agg(F.avg("ret").alias("_mu"), F.stddev_samp("ret").alias("_sd"))
    z = F.when(F.col("_sd") > FLAT, (F.coalesce("ret", "_mu") - F.col("_mu")) / F.col("_sd")).otherwise(0.0)
    w = so_far(ordered())
    x = df.join(base, "series_id").withColumn("_z", z)
    x = x.withColumn("_p", F.sum(F.col("_z") - k).over(w)).withColumn("_q", F.sum(-F.col("_z") - k).over(w))
    up = F.col("_p") - F.least(F.lit(0.0), F.min("_p").over(w))
    down = F.col("_q") - F.least(F.lit(0.0), F.min("_q").over(w))
    return x.withColumn("score", F.when(F.col("t") >= warm, F.greatest(up, down)))


@detector("ewma_vol")
def ewma_vol(df: DataFrame, decay: float = 0.94, warm: int = 60, min_expanding: int = 60) -> DataFrame:
    """sqrt of s = decay s + (1 - decay) r^2, begun with the variance of the first rows; positive expanding z."""
    base = df.where(F.col("t") < warm).groupBy("series_id").agg(F.var_samp("ret").alias("_v0"))
    x = df.join(base, "series_id")
    r2 = F.coalesce(F.col("ret") * F.col("ret"), F.lit(0.0))
    x = linear_recursion(x, (1 - decay) * r2 + F.when(F.col("t") == 0, decay * F.col("_v0")).otherwise(0.0), decay, "_s")
    return expanding_z(x.withColumn("_x", F.sqrt("_s")), "_x", roll=1, min_expanding=min_expanding, form="positive")


def dispersion(df: DataFrame, roll: int = 10, min_expanding: int = 60) -> DataFrame:
    """Population deviation over the components of x, rolling mean, absolute z."""
    n = F.size("x")
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / n
    sd = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n)
    return expanding_z(df.withColumn("_x", sd), "_x", roll=roll, min_expanding=min_expanding, form="abs")


def risk_premium(df: DataFrame, implied: DataFrame, window: int = 20, min_expanding: int = 60) -> DataFrame:
    """implied - realised deviation * sqrt(252) * 100 (implied: ts, value), absolute z."""
    realised = F.stddev_samp("ret").over(last_n(ordered(), window)) * (252**0.5 * 100)
    x = df.withColumn("_r", realised).join(implied, "ts", "left").withColumn("_x", F.col("value") - F.col("_r"))
    return expanding_z(x, "_x", roll=1, min_expanding=min_expanding, form="abs")


def exogenous_level(df: DataFrame, exogenous: DataFrame, roll: int = 5, min_expanding: int = 60) -> DataFrame:
    """Level of an outside series, positive z."""
    return expanding_z(df.join(exogenous, "ts", "left"), "value", roll=roll, min_expanding=min_expanding, form="positive")


@detector("transfer_entropy")
def transfer_entropy(df: DataFrame, source: str = "ret", target: str = "absret", bins: int = 5, window: int = 60, roll: int = 5, min_expanding: int = 60) -> DataFrame:
    """Transfer entropy source -> target at lag 1 over the last rows, in equal-width bins of the window; absolute z.

    Every row goes to the windows that hold it and cells are counted there; bins are those of each
    window, so a row's bin may differ between windows.
    """
    if target == "absret" and target not in df.columns:
        df = df.withColumn("absret", F.abs("ret"))
    w = ordered()
    x = df.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    x = x.withColumn("t", (F.row_number().over(w) - 1).cast("long"))
    f = last_n(w, window)
    x = x.withColumns({"_slo": F.min(source).over(f), "_shi": F.max(source).over(f), "_tlo": F.min(target).over(f), "_thi": F.max(target).over(f), "_n": F.count(F.lit(1)).over(f)})
    frames = x.where(F.col("_n") == window).select("series_id", F.col("t").alias("at"), "_slo", "_shi", "_tlo", "_thi")
    rows = x.select("series_id", "t", F.col(source).alias("_s"), F.col(target).alias("_t"), F.lead(target).over(w).alias("_next"))
    rows = rows.select("series_id", "t", "_s", "_t", "_next", F.explode(F.sequence(F.col("t") + 1, F.col("t") + window - 1)).alias("at")).where("_next is not null")
    bin_of = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    cells = rows.join(frames, ["series_id", "at"]).select("series_id", "at", bin_of("_next", "_tlo", "_thi").alias("n"), bin_of("_t", "_tlo", "_thi").alias("a"), bin_of("_s", "_slo", "_shi").alias("b"))
    key = ["series_id", "at"]
    abc = cells.groupBy(*key, "n", "a", "b").agg(F.count(F.lit(1)).alias("k"))
    over = lambda *c: F.sum("k").over(ordered(*key, *c, by=key[0]).rowsBetween(FIRST, LAST))
    abc = abc.withColumns({"kab": over("a", "b"), "kna": over("n", "a"), "ka": over("a"), "all": over()})
    te = abc.groupBy(*key).agg(F.sum(F.col("k") / F.col("all") * F.log(F.col("k") * F.col("ka") / (F.col("kab") * F.col("kna")))).alias("te"))
    out = x.join(te.withColumnRenamed("at", "t"), ["series_id", "t"], "left")
    return expanding_z(out, "te", roll=roll, min_expanding=min_expanding, form="abs")


def _two_windows(df: DataFrame, x: str, window: int, shift: int):
    """Frames [t - window, t) and [t - window - shift, t - shift)."""
    return ordered().rowsBetween(-window, -1), ordered().rowsBetween(-(window + shift), -(shift + 1))


@detector("fisher_rao")
def fisher_rao(df: DataFrame, window: int = 30, shift: int = 10, roll: int = 5, min_expanding: int = 60) -> DataFrame:
    """Fisher-Rao distance of two normal laws fitted to two shifted past windows, absolute z."""
    a, b = _two_windows(df, "ret", window, shift)
    df = df.withColumns({"_m1": F.avg("ret").over(a), "_s1": F.stddev_pop("ret").over(a), "_m2": F.avg("ret").over(b), "_s2": F.stddev_pop("ret").over(b), "_n1": F.count("ret").over(a), "_n2": F.count("ret").over(b)})
    arg = 1 + (F.pow(F.col("_m1") - F.col("_m2"), 2) + 2 * F.pow(F.col("_s1") - F.col("_s2"), 2)) / (2 * F.col("_s1") * F.col("_s2"))
    ok = (F.col("_n1") == window) & (F.col("_n2") == window) & (F.col("_s1") > FLAT) & (F.col("_s2") > FLAT)
    return expanding_z(df.withColumn("_x", F.when(ok, 2**0.5 * F.acosh(arg))), "_x", roll=roll, min_expanding=min_expanding, form="abs")


@detector("wasserstein")
def wasserstein(df: DataFrame, window: int = 30, shift: int = 10, roll: int = 5, min_expanding: int = 60) -> DataFrame:
    """Wasserstein-1 distance of two equal past windows: mean absolute difference of their order statistics; absolute z."""
    a, b = _two_windows(df, "ret", window, shift)
    df = df.withColumns({"_a": F.sort_array(F.collect_list("ret").over(a)), "_b": F.sort_array(F.collect_list("ret").over(b))})
    w1 = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / window
    ok = (F.size("_a") == window) & (F.size("_b") == window)
    return expanding_z(df.withColumn("_x", F.when(ok, w1)).drop("_a", "_b"), "_x", roll=roll, min_expanding=min_expanding, form="abs")


def directions(n: int, d: int, seed: int = 42) -> list[list[float]]:
    """n unit vectors of d components, by a seed."""
    import numpy as np

    v = np.random.default_rng(seed).standard_normal((n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


def sliced_wasserstein(df: DataFrame, x: str = "x", window: int = 30, shift: int = 10, lines: list[list[float]] | None = None, roll: int = 15, min_expanding: int = 60, d: int = 2) -> DataFrame:
    """Wasserstein-1 distance of two shifted past windows of vectors, averaged over random directions; absolute z.

    Each direction's projections are windows of numbers, sorted and differenced as columns. A row
    with a null component has no projection; a window with such a row gives null.
    """
    lines = lines or directions(20, d)
    whole = F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull())
    rays = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(v) for v in line]).alias("u")) for k, line in enumerate(lines)])
    e = df.select("series_id", "ts", "t", x, F.explode(rays).alias("_r"))
    shadow = F.when(whole, F.aggregate(F.zip_with(x, "_r.u", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    e = e.select("series_id", "ts", "t", F.col("_r.k").alias("_k"), shadow.alias("_v"))
    w = ordered("series_id", "_k")
    a, b = w.rowsBetween(-window, -1), w.rowsBetween(-window - shift, -shift - 1)
    e = e.withColumns({"_a": F.sort_array(F.collect_list("_v").over(a)), "_b": F.sort_array(F.collect_list("_v").over(b))})
    w1 = F.aggregate(F.zip_with("_a", "_b", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, v: s + v) / window
    e = e.select("series_id", "ts", "t", F.when((F.size("_a") == window) & (F.size("_b") == window), w1).alias("_w"))
    mean = e.groupBy("series_id", "ts", "t").agg(F.avg("_w").alias("distance"))
    return expanding_z(mean, "distance", roll=roll, min_expanding=min_expanding, form="abs")


@detector("jensen_shannon")
def jensen_shannon(df: DataFrame, window: int = 30, shift: int = 10, bins: int = 30, roll: int = 5, min_expanding: int = 60) -> DataFrame:
    """Jensen-Shannon divergence of histograms of two past windows over their common range, 1e-10 added a bin; absolute z."""
    a, b = _two_windows(df, "ret", window, shift)
    df = df.withColumns({"_a": F.collect_list("ret").over(a), "_b": F.collect_list("ret").over(b)})
    lo, hi = F.least(F.array_min("_a"), F.array_min("_b")), F.greatest(F.array_max("_a"), F.array_max("_b"))
    df = df.withColumn("_lo", lo).withColumn("_hi", hi)
    bin_of = lambda v: F.least(F.floor(F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    hist = lambda c: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(F.transform(c, bin_of), lambda k: k == i)) + 1e-10)
    total = window + bins * 1e-10
    df = df.withColumn("_p", F.transform(hist("_a"), lambda v: v / total)).withColumn("_q", F.transform(hist("_b"), lambda v: v / total))
    kl = lambda x: F.aggregate(F.zip_with("_p", "_q", lambda p, q: (p if x else q) * F.log((p if x else q) / ((p + q) / 2))), F.lit(0.0), lambda s, v: s + v)
    ok = (F.size("_a") == window) & (F.size("_b") == window) & (F.col("_hi") > F.col("_lo"))
    df = df.withColumn("_x", F.when(ok, (kl(True) + kl(False)) / 2)).drop("_a", "_b", "_p", "_q")
    return expanding_z(df, "_x", roll=roll, min_expanding=min_expanding, form="abs")


def joint_counts(df: DataFrame, x: str, y: str, bins: int, window: int) -> DataFrame:
    """series_id, bx, by, n: two-dimensional histogram of rolling-window bins."""
    b = discretised(discretised(df, x, bins, window, "bx"), y, bins, window, "by")
    return b.where("bx is not null and by is not null").groupBy("series_id", "bx", "by").agg(F.count(F.lit(1)).alias("n"))
