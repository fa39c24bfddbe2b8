"""Scalar projections and window features of price panels (series_id, ts, t, close)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.windows import finite, FIRST, full, LAST, last_n, ordered, so_far


def log_returns(df: DataFrame, price: str = "close", out: str = "ret") -> DataFrame:
    """ln(p_t / p_{t-1}); null in the first row and where it is not finite."""
    return df.withColumn(out, finite(F.log(F.col(price) / F.lag(price).over(ordered()))))


def momentum(price: str, k: int) -> Column:
    """p_t / p_{t-k} - 1."""
    return finite(F.col(price) / F.lag(price, k).over(ordered()) - 1)


def rolling_std(x: str, n: int) -> Column:
    """Sample standard deviation of the last n rows, null before n valid ones."""
    w = last_n(ordered(), n)
    return full(F.stddev_samp(x).over(w), F.count(x).over(w), n)


def rolling_skew(x: str, n: int) -> Column:
    """Bias-corrected skewness of the last n rows."""
    w = last_n(ordered(), n)
    return full(F.skewness(x).over(w) * ((n * (n - 1)) ** 0.5 / (n - 2)), F.count(x).over(w), n)


def rolling_kurtosis(x: str, n: int) -> Column:
    """Bias-corrected excess kurtosis of the last n rows."""
    w = last_n(ordered(), n)
    g2 = F.kurtosis(x).over(w)
    return full((g2 * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3))), F.count(x).over(w), n)


def price_range(price: str, n: int) -> Column:
    """max / min - 1 of the last n rows."""
    w = last_n(ordered(), n)
    return full(F.max(price).over(w) / F.min(price).over(w) - 1, F.count(price).over(w), n)


def single_series_features(df: DataFrame) -> DataFrame:
    """The fifteen features of one series; rows with any null are left out."""
    r = log_returns(df)
    cols = {f"vol{n}": rolling_std("ret", n) for n in (5, 20, 10, 40, 60)} | {f"mom{k}": momentum("close", k) for k in (5, 20, 10, 40, 60)}
    cols |= {"ret_sq": F.col("ret") * F.col("ret"), "range_20": price_range("close", 20), "skew_20": rolling_skew("ret", 20), "kurt_20": rolling_kurtosis("ret", 20)}
    return r.withColumns(cols).drop("close").dropna()


def multi_series_features(df: DataFrame) -> DataFrame:
    """Per series ret, vol5, vol20, mom5, mom20, and across series cross_corr5, cross_vol_disp, avg_ret.

    Only dates that every series has take part; cross terms are one value a date.
    """
    common = common_dates(df)
    r = log_returns(renumbered(common))
    r = r.withColumns({"vol5": rolling_std("ret", 5), "vol20": rolling_std("ret", 20), "mom5": momentum("close", 5), "mom20": momentum("close", 20)})
    cross = r.groupBy("ts").agg(F.stddev_samp("vol20").alias("cross_vol_disp"), F.avg("ret").alias("avg_ret"))
    return r.drop("close").join(cross, "ts").join(mean_correlation(r, "ret", 5).withColumnRenamed("mean_corr", "cross_corr5"), "ts").dropna()


def mean_correlation(df: DataFrame, x: str, n: int) -> DataFrame:
    """ts, mean_corr: mean of the rolling correlation matrix of all series, its diagonal of ones included.

    Pairs of series are joined on the date, so the work is series squared a date, not rows squared.
    """
    a = df.select("ts", F.col("series_id").alias("s1"), F.col(x).alias("x1"), "t")
    b = df.select("ts", F.col("series_id").alias("s2"), F.col(x).alias("x2"))
    w = last_n(ordered("s1", "s2"), n)
    pairs = a.join(b, "ts")
    c = F.when(F.col("s1") == F.col("s2"), F.lit(1.0)).otherwise(F.corr("x1", "x2").over(w))
    valid = F.count(F.when(F.col("x1").isNotNull() & F.col("x2").isNotNull(), 1)).over(w)
    return pairs.withColumn("c", full(c, valid, n)).groupBy("ts").agg(F.avg("c").alias("mean_corr")).where("mean_corr is not null")


def common_dates(df: DataFrame) -> DataFrame:
    """Rows of the dates that every series has."""
    n = df.agg(F.countDistinct("series_id").alias("_all"))  # one row
    have = df.groupBy("ts").agg(F.countDistinct("series_id").alias("_have")).join(F.broadcast(n), F.col("_have") == F.col("_all"))
    return df.join(have.select("ts"), "ts", "left_semi")


def renumbered(df: DataFrame) -> DataFrame:
    return df.withColumn("t", (F.row_number().over(ordered(by="ts")) - 1).cast("long"))


def enriched(df: DataFrame, lookback: int = 20) -> DataFrame:
    """series_id, ts, t, x array -> x of means, population deviations, minima and maxima of each component over the last rows.

    The first lookback - 1 rows have no full window and are left out.
    """
    e = df.select("series_id", "ts", "t", F.posexplode("x").alias("pos", "v"))
    w = last_n(ordered("series_id", "pos"), lookback)
    e = e.select("series_id", "ts", "t", "pos", F.avg("v").over(w).alias("a"), F.stddev_pop("v").over(w).alias("b"), F.min("v").over(w).alias("c"), F.max("v").over(w).alias("d"), F.count("v").over(w).alias("n"))
    packs = F.array_sort(F.collect_list(F.struct("pos", "a", "b", "c", "d")))  # one entry a component
    g = e.where(F.col("n") == lookback).groupBy("series_id", "ts", "t").agg(packs.alias("p"))
    part = lambda k: F.transform("p", lambda s: s[k])
    return g.select("series_id", "ts", "t", F.concat(*[part(k) for k in "abcd"]).alias("x"))


def breadth(df: DataFrame, x: str = "ret") -> DataFrame:
    """Cross-section features a date: std, mean abs, share positive, population skew, MA5/MA20 of the mean, and its 20-row z."""
    g = df.where(F.col(x).isNotNull()).groupBy("ts").agg(
        F.stddev_samp(x).alias("xs_std"), F.avg(F.abs(x)).alias("mean_abs"), F.avg((F.col(x) > 0).cast("double")).alias("share_up"), F.skewness(x).alias("xs_skew"), F.avg(x).alias("mean_x")
    )
    g = g.withColumn("series_id", F.lit("all"))
    g = g.withColumn("t", F.row_number().over(ordered(by="ts")) - 1)
    w5, w20 = last_n(ordered(), 5), last_n(ordered(), 20)
    sd = F.stddev_samp("mean_x").over(w20)
    return g.withColumns({"ma5": F.avg("mean_x").over(w5), "ma20": F.avg("mean_x").over(w20), "z20": F.when(sd > 1e-12, (F.col("mean_x") - F.avg("mean_x").over(w20)) / sd)}).drop("series_id", "t")


def delay_embedding(df: DataFrame, x: str, d: int = 3, tau: int = 2) -> DataFrame:
    """x array [x_t, x_{t-tau}, ...] of d entries; rows without all of them are left out."""
    lags = [F.lag(x, k * tau).over(ordered()) for k in range(d)]
    cols = df.withColumns({f"_l{k}": lag for k, lag in enumerate(lags)}).dropna(subset=[f"_l{k}" for k in range(d)])
    return cols.withColumn("x", F.array(*[f"_l{k}" for k in range(d)])).drop(*[f"_l{k}" for k in range(d)])


def fixed_window_z(x: str, n: int, least: int = 5) -> Column:
    """z-score against the n rows before, of which `least` must be valid."""
    w = ordered().rowsBetween(-n, -1)
    sd = F.stddev_samp(x).over(w)
    return F.when((F.count(x).over(w) >= least) & (sd > 1e-12), (F.col(x) - F.avg(x).over(w)) / sd)


def robust_z(df: DataFrame, x: str, n: int, out: str = "robust_z") -> DataFrame:
    """(x - median) / (1.4826 MAD) over the last n rows; 0 where the MAD is flat."""
    w = last_n(ordered(), n)
    df = df.withColumn("_f", F.collect_list(x).over(w)).withColumn("_med", F.percentile(x, F.lit(0.5)).over(w))
    dev = F.sort_array(F.transform("_f", lambda v: F.abs(v - F.col("_med"))))
    k = F.size("_f")
    at = lambda i: F.element_at("_d", i.cast("int"))
    df = df.withColumn("_d", dev).withColumn("_mad", F.when(k > 0, (at(F.floor((k + 1) / 2)) + at(F.floor((k + 2) / 2))) / 2))
    z = F.when(F.col("_mad") <= 1e-12, 0.0).otherwise((F.col(x) - F.col("_med")) / (1.4826 * F.col("_mad")))
    return df.withColumn(out, F.when((k == n) & F.col(x).isNotNull(), z)).drop("_f", "_med", "_d", "_mad")


def ema(df: DataFrame, x: str, span: int, out: str = "ema", velocity: int = 5) -> DataFrame:
    """Exponential mean with alpha = 2 / (span + 1) from the first value on, and its change over `velocity` rows.

    The recursion is a sum of decayed values: chunks of rows are scaled to their own start, so
    that weights stay finite, and the chunks' states follow in a second, short fold.
    """
    a = 2.0 / (span + 1)
    df = linear_recursion(df, F.when(F.col("t") == 0, F.col(x)).otherwise(a * F.col(x)), 1 - a, out)
    return df.withColumn(f"{out}_velocity", F.col(out) - F.lag(out, velocity).over(ordered()))


def linear_recursion(df: DataFrame, term: Column, decay: float, out: str, chunk: int = 64) -> DataFrame:
    """s_t = decay * s_{t-1} + term_t (s before the first row 0), by window sums.

    Inside a chunk, s is decay^i times the running sum of term / decay^i; the state entering each
    chunk is folded over the chunks of a series, one value each.
    """
    i = F.col("t") % chunk
    c = F.floor(F.col("t") / chunk)
    df = df.withColumn("_c", c).withColumn("_i", i).withColumn("_u", term * F.pow(F.lit(1.0 / decay), i.cast("double")))
    df = df.withColumn("_r", F.sum("_u").over(so_far(ordered("series_id", "_c"))) * F.pow(F.lit(decay), F.col("_i").cast("double")))
    ends = df.groupBy("series_id", "_c").agg(F.max_by("_r", "_i").alias("_e"), (F.max("_i") + 1).alias("_k"))
    seq = ends.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("_c", "_e", "_k"))).alias("_q"))
    # the state after each chunk, from the ordered list of chunk ends
    start = F.array(F.lit(0.0))
    states = F.aggregate("_q", start, lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) * F.pow(F.lit(decay), s["_k"].cast("double")) + s["_e"])))
    heads = seq.select("series_id", F.explode(F.arrays_zip(F.transform("_q", lambda s: s["_c"]).alias("c"), F.slice(states, 1, F.size("_q")).alias("s"))).alias("z")).select("series_id", F.col("z.c").alias("_c"), F.col("z.s").alias("_in"))
    return df.join(heads, ["series_id", "_c"]).withColumn(out, F.col("_r") + F.col("_in") * F.pow(F.lit(decay), F.col("_i") + 1.0)).drop("_c", "_i", "_u", "_r", "_in")


def drawdown(df: DataFrame, r: str = "ret") -> DataFrame:
    """wealth, peak and drawdown of simple returns; a null return counts as 0."""
    w = so_far(ordered())
    df = df.withColumn("wealth", F.exp(F.sum(F.log1p(F.coalesce(r, F.lit(0.0)))).over(w)))
    return df.withColumn("peak", F.max("wealth").over(w)).withColumn("drawdown", (F.col("peak") - F.col("wealth")) / F.col("peak"))


def persistent(df: DataFrame, flag: str, n: int, out: str = "alarm") -> DataFrame:
    """TRUE runs of at least n rows; shorter ones become FALSE."""
    on = F.coalesce(F.col(flag), F.lit(False))
    df = df.withColumn("_on", on).withColumn("_isle", F.col("t") - F.sum(F.col("_on").cast("int")).over(so_far(ordered())))
    run = F.count(F.lit(1)).over(ordered("series_id", "_on", "_isle").rowsBetween(FIRST, LAST))
    return df.withColumn(out, F.col("_on") & (run >= n)).drop("_on", "_isle")


def onsets(flag: str) -> Column:
    """FALSE to TRUE edges."""
    return F.coalesce(F.col(flag), F.lit(False)) & ~F.coalesce(F.lag(flag).over(ordered()), F.lit(False))


def lag_correlations(df: DataFrame, x: str, y: str, lags: range, least: int = 100) -> DataFrame:
    """series_id, lag, corr of x_{t-lag} with y_t where at least `least` pairs exist."""
    k = F.explode(F.array(*[F.lit(i) for i in lags])).alias("lag")
    a = df.select("series_id", "t", F.col(x).alias("_x"), k).select("series_id", "lag", (F.col("t") + F.col("lag")).alias("t"), "_x")
    b = df.select("series_id", "t", F.col(y).alias("_y"))
    j = a.join(b, ["series_id", "t"]).where("_x is not null and _y is not null")
    return j.groupBy("series_id", "lag").agg(F.corr("_x", "_y").alias("corr"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def hurst_stress(df: DataFrame, x: str, n: int = 120, out: str = "hurst_stress") -> DataFrame:
    """|log(R/S)/log(n) - 1/2| over the last n rows, R the range of cumulated deviations."""
    w = last_n(ordered(), n)
    df = df.withColumn("_f", F.collect_list(x).over(w)).withColumn("_m", F.avg(x).over(w)).withColumn("_s", F.stddev_pop(x).over(w))
    fold = F.aggregate(
        "_f",
        F.struct(F.lit(0.0).alias("c"), F.lit(float("inf")).alias("lo"), F.lit(float("-inf")).alias("hi")),
        lambda a, v: F.struct((a["c"] + v - F.col("_m")).alias("c"), F.least(a["lo"], a["c"] + v - F.col("_m")).alias("lo"), F.greatest(a["hi"], a["c"] + v - F.col("_m")).alias("hi")),
    )
    df = df.withColumn("_r", F.when((F.size("_f") == n) & (F.col("_s") > 1e-12), fold)).withColumn("_rs", (F.col("_r.hi") - F.col("_r.lo")) / F.col("_s"))
    return df.withColumn(out, F.abs(F.log("_rs") / F.log(F.lit(float(n))) - 0.5)).drop("_f", "_m", "_s", "_r", "_rs")


def sign_changes(df: DataFrame, x: str, n: int, out: str = "sign_changes") -> DataFrame:
    """Number of sign flips among the last n rows."""
    flip = (F.signum(x) != F.signum(F.lag(x).over(ordered()))).cast("int")
    df = df.withColumn("_flip", flip)
    return df.withColumn(out, F.sum("_flip").over(last_n(ordered(), n))).drop("_flip")


def prefix_moments(df: DataFrame, block: int = 512) -> DataFrame:
    """series_id, t, i, j, n, sx, sy, sxy: running sums of components and their products, per series.

    Blocked: sums of `block` rows, prefixes over blocks, and windows inside blocks only, so one long
    series is spread over many tasks.
    """
    e = df.select("series_id", "t", F.posexplode("x").alias("i", "xi"))
    pairs = e.join(e.select("series_id", "t", F.col("i").alias("j"), F.col("xi").alias("xj")), ["series_id", "t"]).where("i <= j")
    pairs = pairs.withColumn("blk", F.floor(F.col("t") / block))
    keys = ["series_id", "i", "j"]
    sums = pairs.groupBy(*keys, "blk").agg(F.count(F.lit(1)).alias("bn"), F.sum("xi").alias("bx"), F.sum("xj").alias("by"), F.sum(F.col("xi") * F.col("xj")).alias("bxy"))
    before = ordered(*keys, by="blk").rowsBetween(FIRST, -1)
    sums = sums.select(*keys, "blk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("bn", "bx", "by", "bxy")])
    inside = so_far(ordered(*keys, "blk"))
    run = pairs.select(*keys, "blk", "t", F.count(F.lit(1)).over(inside).alias("n0"), F.sum("xi").over(inside).alias("x0"), F.sum("xj").over(inside).alias("y0"), F.sum(F.col("xi") * F.col("xj")).over(inside).alias("xy0"))
    j = run.join(sums, [*keys, "blk"])
    return j.select("series_id", "t", "i", "j", (F.col("n0") + F.col("bn")).alias("n"), (F.col("x0") + F.col("bx")).alias("sx"), (F.col("y0") + F.col("by")).alias("sy"), (F.col("xy0") + F.col("bxy")).alias("sxy"))


def interpolated(df: DataFrame, x: str, out: str) -> DataFrame:
    """Linear interpolation in t between known values; after the last known one it stays, before the first it is null. Uses later rows."""
    both = F.struct("t", F.col(x).alias("v"))
    known = F.when(F.col(x).isNotNull(), both)
    w = ordered()
    df = df.withColumn("_a", F.last(known, ignorenulls=True).over(so_far(w))).withColumn("_b", F.first(known, ignorenulls=True).over(w.rowsBetween(0, LAST)))
    step = F.col("_b.t") - F.col("_a.t")
    v = F.when(F.col("_b").isNull() | (step == 0), F.col("_a.v")).otherwise(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("t") - F.col("_a.t")) / step)
    return df.withColumn(out, v).drop("_a", "_b")


def sphere(x: str = "x") -> Column:
    """x / (|x| + 1e-8)."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: v / (norm + 1e-8))


def normalised(mode: str, x: str = "x", median_norm: str = "median_norm", train_std: str = "train_std") -> Column:
    """Row normalisation after projection: sphere, none, soft (by |x| + the training median norm) or clip (5 training deviations)."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    if mode == "sphere":
        return sphere(x)
    if mode == "soft":
        return F.transform(x, lambda v: v / (norm + F.col(median_norm)))
    if mode == "clip":
        return F.zip_with(x, train_std, lambda v, s: F.greatest(F.least(v, 5.0 * s), -5.0 * s))
    if mode == "none":
        return F.col(x)
    raise ValueError(f"unknown mode {mode}")


def standardised(x: str = "x", mean: str = "mean", scale: str = "scale") -> Column:
    """(x - mean) / scale by component; a zero scale counts as 1."""
    centred = F.zip_with(x, mean, lambda v, m: v - m)
    return F.zip_with(centred, scale, lambda v, s: v / F.when(s == 0, 1.0).otherwise(s))


def projected(z: str = "z", components: str = "components") -> Column:
    """Components times z."""
    return F.transform(components, lambda c: F.aggregate(F.zip_with(c, z, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def discretised(df: DataFrame, x: str, bins: int, n: int, out: str = "bin") -> DataFrame:
    """Equal-width bin 0 .. bins-1 of x between the minimum and maximum of the last n rows; 0 where these agree."""
    w = last_n(ordered(), n)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    b = F.least(F.floor((F.col(x) - lo) / (hi - lo) * bins), F.lit(bins - 1))
    return df.withColumn(out, F.when(hi > lo, b).when(F.col(x).isNotNull(), 0).cast("int"))
