"""Backtests of return overlays: weights, costs, strategies, performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.folds import ordered_fold
from tidewatch.functions.stats import normal_sf
from tidewatch.functions.windows import last_n, ordered, so_far

from .joins import event_members


def vol_target_weight(r: str, target: float = 0.10, lookback: int = 20, floor: float = 0.0, cap: float = 2.0) -> Column:
    """target / realised annual deviation (five values at least, 1% at least), clipped; `floor` before that."""
    w = last_n(ordered(), lookback)
    vol = F.greatest(F.stddev_samp(r).over(w) * 252**0.5, F.lit(0.01))
    return F.when(F.count(r).over(w) >= 5, F.least(F.greatest(target / vol, F.lit(floor)), F.lit(cap))).otherwise(floor)


def regime_weight(base: Column, p: Column, threshold: float = 0.5, crisis: float = 0.0, width: float = 0.3, ramp: str = "sigmoid") -> Column:
    """base * (1 - alpha (1 - crisis)), alpha a sigmoid or linear ramp of p; a null p counts as 0."""
    p = F.coalesce(p, F.lit(0.0))
    if ramp == "sigmoid":
        alpha = 1.0 / (1.0 + F.exp(-6.0 / max(width, 1e-6) * (p - threshold)))
    else:
        alpha = F.least(F.greatest((p - threshold) / max(width, 1e-6), F.lit(0.0)), F.lit(1.0))
    return base * (1 - alpha * (1 - crisis))


def clipped(w: Column, most: float = 1.5, least: float = -0.5) -> Column:
    return F.greatest(F.least(w, F.lit(most)), F.lit(least))


def dynamic_vol_target(p: Column, calm: float = 0.12, crisis: float = 0.05) -> Column:
    p = F.coalesce(p, F.lit(0.0))
    return calm * (1 - p) + crisis * p


def tiered_position(score: Column) -> Column:
    """0 from score 2 on, a half from 1.5 on, else 1."""
    return F.when(score >= 2, 0.0).when(score >= 1.5, 0.5).otherwise(1.0)


def inverse_vol_weights(df: DataFrame, n: int, r: str = "ret") -> DataFrame:
    """Weights proportional to 1 / deviation over the past n rows, summing to one a date."""
    w = ordered().rowsBetween(-n, -1)
    x = df.withColumn("_iv", F.when(F.count(r).over(w) == n, 1 / F.stddev_samp(r).over(w))).where("_iv is not null")
    return x.withColumn("weight", F.col("_iv") / F.sum("_iv").over(Window.partitionBy("ts"))).drop("_iv")


def turnover(w: str) -> Column:
    """|change of the weight|, 0 in the first row."""
    return F.coalesce(F.abs(F.col(w) - F.lag(w).over(ordered())), F.lit(0.0))


def net_returns(df: DataFrame, r: str, w: str, cost_bps: float = 1.0, commission_bps: float = 0.5) -> DataFrame:
    """gross, cost and net of a weighted return series."""
    return df.withColumn("gross", F.col(r) * F.col(w)).withColumn("cost", turnover(w) * ((cost_bps + commission_bps) / 10_000)).withColumn("net", F.col("gross") - F.col("cost"))


def portfolio_returns(df: DataFrame, costs: DataFrame, r: str = "ret", w: str = "weight", commission_bps: float = 0.5) -> DataFrame:
    """ts, gross, cost, net of many assets with costs by asset (series_id, bps; 1 where missing)."""
    x = df.withColumn("_to", turnover(w)).join(costs, "series_id", "left")
    cost = F.sum(F.col("_to") * (F.coalesce("bps", F.lit(1.0)) + commission_bps) / 10_000)
    return x.groupBy("ts").agg(F.sum(F.col(r) * F.col(w)).alias("gross"), cost.alias("cost")).withColumn("net", F.col("gross") - F.col("cost"))


def min_holding(df: DataFrame, w: str, days: int = 5, out: str = "held") -> DataFrame:
    """Weight changes above 0.01 are undone when the last change is less than `days` rows back."""

    def step(state, row):
        held, at = state
        t, now = row
        moved = held is not None and now is not None and abs(now - held) > 0.01
        back = moved and t - at < days
        v = held if back else now
        return (v, t if moved and not back else at), (v,)

    return ordered_fold(df, ["t", w], lambda: (None, 0), step, f"{out} double")


def circuit_breaker(df: DataFrame, w: str, drawdown: str, limit: float = 0.15, cool: int = 20, out: str = "braked") -> DataFrame:
    """Weight 0 for `cool` rows from a drawdown beyond the limit; a breach within the pause doesn't extend it."""

    def step(state, row):
        (until,) = state
        t, now, down = row
        paused = t < until
        hit = not paused and down is not None and down > limit
        return (t + cool if hit else until,), (0.0 if paused or hit else now,)

    return ordered_fold(df, ["t", w, drawdown], lambda: (-1,), step, f"{out} double")


def equity(df: DataFrame, r: str) -> DataFrame:
    """equity, peak and drawdown of simple returns, begun at the first row."""
    w = so_far(ordered())
    df = df.withColumn("equity", F.exp(F.sum(F.log1p(F.coalesce(r, F.lit(0.0)))).over(w)))
    return df.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))


def long_flat(df: DataFrame, r: str = "ret", p: str = "p_crisis", target: float = 0.10, holding: int = 3, max_drawdown: float = 0.20, out: str = "weight") -> DataFrame:
    """Vol-targeted long position, flattened as p rises: holding period, limits, one row's lag, circuit breaker."""
    x = df.withColumn("_w", regime_weight(vol_target_weight(r, target), F.col(p)))
    x = min_holding(x, "_w", holding, "_h").withColumn("_c", clipped(F.col("_h"), 1.5, 0.0))
    x = x.withColumn("_l", F.coalesce(F.lag("_c").over(ordered()), F.lit(0.0))).withColumn("_r", F.col(r) * F.col("_l"))
    x = circuit_breaker(equity(x, "_r"), "_l", "drawdown", max_drawdown, out=out)
    return x.drop("_w", "_h", "_c", "_l", "_r", "equity", "peak", "drawdown")


def long_short(df: DataFrame, r: str = "ret", p: str = "p_crisis", target: float = 0.10, out: str = "weight") -> DataFrame:
    """Vol-targeted position that turns modestly short as p rises."""
    x = df.withColumn("_w", clipped(regime_weight(vol_target_weight(r, target), F.col(p), crisis=-0.5)))
    return x.withColumn(out, F.coalesce(F.lag("_w").over(ordered()), F.lit(0.0))).drop("_w")


def continuous(df: DataFrame, r: str = "ret", p: str = "p_crisis", out: str = "weight") -> DataFrame:
    """Position of a volatility target that itself falls with p."""
    w20 = last_n(ordered(), 20)
    vol = F.greatest(F.stddev_samp(r).over(w20) * 252**0.5, F.lit(0.01))
    x = df.withColumn("_w", F.when(F.count(r).over(w20) >= 5, clipped(dynamic_vol_target(F.col(p)) / vol, 1.5, 0.0)).otherwise(0.0))
    return x.withColumn(out, F.coalesce(F.lag("_w").over(ordered()), F.lit(0.0))).drop("_w")


def multi_signal(df: DataFrame, signals: list[str], r: str = "ret", out: str = "weight") -> DataFrame:
    """long_flat on the mean of several crisis probabilities."""
    from functools import reduce

    n = reduce(lambda a, b: a + b, [F.col(s).isNotNull().cast("int") for s in signals])
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in signals])
    return long_flat(df.withColumn("_p", F.when(n > 0, total / n)), r, "_p", out=out).drop("_p")


def benchmarks(df: DataFrame, r: str = "ret") -> DataFrame:
    """Hold and constant-volatility weights of each series."""
    x = df.withColumn("hold", F.lit(1.0)).withColumn("_v", vol_target_weight(r))
    return x.withColumn("constant_vol", F.coalesce(F.lag("_v").over(ordered()), F.lit(0.0))).drop("_v")


def equal_weight(df: DataFrame, r: str = "ret") -> DataFrame:
    """ts, ret of the equal-weight mix of the series present."""
    return df.groupBy("ts").agg(F.avg(r).alias("ret"))


def performance(df: DataFrame, r: str, keys: tuple[str, ...] = ("series_id",), rf: float = 0.0) -> DataFrame:
    """Total and annual return, volatility, Sharpe, Sortino, largest drawdown, Calmar, longest drawdown (rows), moments, share of positive rows."""
    x = df.where(F.col(r).isNotNull()).withColumn("t", F.row_number().over(ordered(*keys)) - 1)
    w = so_far(ordered(*keys))
    x = x.withColumn("_e", F.exp(F.sum(F.log1p(r)).over(w))).withColumn("_d", 1 - F.col("_e") / F.max("_e").over(w))
    x = x.withColumn("_on", F.col("_d") > 0.001).withColumn("_isle", F.col("t") - F.sum(F.col("_on").cast("int")).over(w))
    runs = x.where("_on").groupBy(*keys, "_isle").agg(F.count(F.lit(1)).alias("k")).groupBy(*keys).agg(F.max("k").alias("max_dd_duration"))
    ex = F.col(r) - rf / 252
    g = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.exp(F.sum(F.log1p(r))) - 1).alias("total_return"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), F.max("_d").alias("max_drawdown"), F.skewness(r).alias("skewness"), F.kurtosis(r).alias("kurtosis"),
        F.avg((F.col(r) > 0).cast("double")).alias("positive"), F.stddev_samp(F.when(ex < 0, ex)).alias("dsd"), F.avg(ex).alias("mx"),
    ).where("n >= 2")
    annual = F.pow(1 + F.col("total_return"), 252.0 / F.col("n")) - 1
    down = F.when(F.col("dsd").isNull(), 1e-6).otherwise(F.col("dsd") * 252**0.5)
    g = g.withColumns({
        "annual_return": annual, "annual_vol": F.col("sd") * 252**0.5, "sharpe": F.when(F.col("sd") > 1e-12, F.col("mx") / F.col("sd") * 252**0.5).otherwise(0.0),
        "sortino": F.when(down > 1e-12, F.col("mx") * 252 / down).otherwise(0.0),
    }).withColumn("calmar", F.when(F.col("max_drawdown") > 0.01, F.col("annual_return") / F.col("max_drawdown")).otherwise(0.0))
    return g.join(runs, list(keys), "left").withColumn("max_dd_duration", F.coalesce("max_dd_duration", F.lit(0))).drop("m", "sd", "dsd", "mx")


def sharpe_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """series_id, difference of annual Sharpe ratios and its HAC z and p (Bartlett kernel, lag floor(4 (T/100)^(2/9)))."""
    x = df.where(f"{a} is not null and {b} is not null").withColumn("t", F.row_number().over(ordered()) - 1).withColumn("_d", F.col(a) - F.col(b))
    g = x.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("md"), *[(F.avg(c) / F.stddev_samp(c) * 252**0.5).alias(f"s{k}") for k, c in (("a", a), ("b", b))])
    g = g.where("n >= 30").withColumn("most", F.floor(4 * F.pow(F.col("n") / 100, 2 / 9)))
    y = x.select("series_id", "t", "_d").join(g, "series_id").withColumn("_c", F.col("_d") - F.col("md"))
    lag = y.select("series_id", "t", "_c", "n", "most", F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("j"))
    other = y.select("series_id", F.col("t").alias("t2"), F.col("_c").alias("_c2"))
    prod = lag.withColumn("t2", F.col("t") - F.col("j")).join(other, ["series_id", "t2"]).groupBy("series_id", "j", "most").agg(F.avg(F.col("_c") * F.col("_c2")).alias("gamma"))
    var = prod.groupBy("series_id").agg(F.sum(F.when(F.col("j") == 0, F.col("gamma")).otherwise(2 * (1 - F.col("j") / (F.col("most") + 1)) * F.col("gamma"))).alias("v"))
    z = (F.col("sa") - F.col("sb")) / (F.sqrt(F.col("v") / F.col("n")) * 252**0.5)
    return g.join(var, "series_id").select("series_id", (F.col("sa") - F.col("sb")).alias("difference"), z.alias("z"), F.least(2 * normal_sf(F.abs(z)), F.lit(1.0)).alias("p"))


def sharpe_ci(df: DataFrame, r: str, replicates: int = 200, seed: int = 5) -> DataFrame:
    """Percentile interval of the annual Sharpe ratio under independent resampling of rows by hash."""
    x = df.where(F.col(r).isNotNull()).withColumn("i", F.row_number().over(ordered()) - 1).select("series_id", "i", F.col(r).alias("_r"))
    n = x.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    draw = n.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    draw = draw.select("series_id", "rep", F.pmod(F.xxhash64(F.lit(seed), "series_id", "rep", "k"), F.col("n")).cast("int").alias("i"))
    s = draw.join(x, ["series_id", "i"]).groupBy("series_id", "rep").agg((F.avg("_r") / F.stddev_samp("_r") * 252**0.5).alias("s"))
    return s.groupBy("series_id").agg(F.percentile("s", F.lit(0.025)).alias("lo"), F.percentile("s", F.lit(0.975)).alias("hi"))


def window_returns(df: DataFrame, events: DataFrame, r: str = "r") -> DataFrame:
    """Compounded return of each series inside each event window."""
    return event_members(df, events).groupBy("series_id", "event_id").agg((F.exp(F.sum(F.log1p(r))) - 1).alias("total"))


def break_even_cost(df: DataFrame, gross: str, to: str) -> DataFrame:
    """Cost in basis points at which the mean net return is 0."""
    return df.groupBy("series_id").agg((F.sum(gross) / F.sum(to) * 10_000).alias("bps"))


def sensitivity(df: DataFrame, targets: list[float], thresholds: list[float], r: str = "ret", p: str = "p_crisis") -> DataFrame:
    """Performance of the lagged regime weight over a grid of volatility targets and thresholds."""
    w20 = last_n(ordered("series_id", "target", "threshold"), 20)
    x = df.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    vol = F.greatest(F.stddev_samp(r).over(w20) * 252**0.5, F.lit(0.01))
    base = F.when(F.count(r).over(w20) >= 5, F.least(F.col("target") / vol, F.lit(2.0))).otherwise(0.0)
    alpha = 1 / (1 + F.exp(-20 * (F.coalesce(p, F.lit(0.0)) - F.col("threshold"))))
    x = x.withColumn("_w", base * (1 - alpha))
    x = x.withColumn("_n", F.col(r) * F.coalesce(F.lag("_w").over(ordered("series_id", "target", "threshold")), F.lit(0.0)))
    return performance(x, "_n", ("series_id", "target", "threshold"))


def lead_by_correlation(df: DataFrame, z: str, vol: str, most: int = 130) -> DataFrame:
    """series_id, the lag with the largest |corr(z_t, vol_{t+lag})|, and that correlation."""
    from .features import lag_correlations

    c = lag_correlations(df, z, vol, range(0, most, 5), least=30)
    return c.groupBy("series_id").agg(F.max_by(F.struct("lag", "corr"), F.struct(F.round(F.abs("corr"), 9), -F.col("lag"))).alias("b")).select("series_id", "b.lag", "b.corr")


def log_performance(df: DataFrame, r: str, keys: tuple[str, ...], least: int = 30, per_year: int = 252) -> DataFrame:
    """keys, n, sharpe, max_drawdown, calmar of log returns; null returns are left out.

    Equity begins with the first return. Ratios are null with fewer than `least` returns, or where
    they would divide by nothing; the drawdown with fewer than two.
    """
    w = ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)
    x = df.where(F.col(r).isNotNull()).withColumn("_c", F.exp(F.sum(r).over(w)))
    x = x.withColumn("_dd", 1 - F.col("_c") / F.max("_c").over(w))
    g = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"), F.max("_dd").alias("_dd"))
    enough = F.col("n") >= least
    return g.select(
        *keys, "n", F.when(enough & (F.col("_s") > 1e-12), F.col("_m") / F.col("_s") * per_year**0.5).alias("sharpe"),
        F.when(F.col("n") >= 2, F.col("_dd")).alias("max_drawdown"), F.when(enough & (F.col("_dd") > 1e-12), F.col("_m") * per_year / F.col("_dd")).alias("calmar"),
    )


def hedge_timing(df: DataFrame, z: str, r: str = "ret", threshold: float = 1.5, share: float = 0.10, cost: float = 0.0005) -> DataFrame:
    """series_id, strategy, hedged (share of rows) and log_performance: no hedge, always, while z is above the threshold, and while it is not.

    A hedged row sells `share` of the position and pays `cost`. A null return counts as 0 but for `none`; a null z is never hedged on signal.
    """
    c, flat = F.col, F.coalesce(F.col(r), F.lit(0.0))
    covered = flat * (1 - share) - cost
    on = F.coalesce(c(z) > threshold, F.lit(False))
    off = F.coalesce(c(z) <= threshold, F.lit(False))
    one = lambda name, hedged, value: F.struct(F.lit(name).alias("strategy"), hedged.alias("_on"), value.alias("_r"))
    ways = [one("none", F.lit(False), c(r)), one("always", F.lit(True), covered), one("timed", on, F.when(on, covered).otherwise(flat)), one("mistimed", off, F.when(off, covered).otherwise(flat))]
    x = df.select("series_id", "t", F.explode(F.array(*ways)).alias("_k")).select("series_id", "t", "_k.*")
    hedged = x.groupBy("series_id", "strategy").agg(F.avg(c("_on").cast("double")).alias("hedged"))
    return hedged.join(log_performance(x, "_r", ("series_id", "strategy")), ["series_id", "strategy"], "left")


def overlay_utility(scores: DataFrame, returns: DataFrame, quantile: float = 0.9, low: float = 0.2, least: int = 30, per_year: int = 252) -> DataFrame:
    """series_id, method, utility, gain: the Sharpe ratio of holding `low` of a position while a method's score is above its own quantile, and what it adds to holding all.

    The quantile is that of all scores of the series (it looks ahead); rows without a score or a return take no part, and
    both ratios use the same rows. Null with fewer than `least` rows or a flat return.
    """
    keys = ["series_id", "method"]
    cut = scores.groupBy(*keys).agg(F.percentile("score", F.lit(quantile)).alias("_cut"))
    x = scores.where("score is not null").join(cut, keys).join(returns.select("series_id", "t", F.col("ret").alias("_r")).where("_r is not null"), ["series_id", "t"])
    x = x.withColumn("_p", F.when(F.col("score") > F.col("_cut"), low).otherwise(1.0) * F.col("_r"))
    sharpe = lambda c: F.when((F.count(c) >= least) & (F.stddev_samp(c) > 1e-12), F.avg(c) / F.stddev_samp(c) * per_year**0.5)
    return x.groupBy(*keys).agg(sharpe("_p").alias("utility"), (sharpe("_p") - sharpe("_r")).alias("gain"))
