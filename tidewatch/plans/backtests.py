"""Queries of return overlays on the weekly panel (returns a tenth of the panel's, to stay within daily size)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.windows import ordered
from tidewatch.operators import backtest as b
from tidewatch.operators import features as f
from tidewatch.sources import panels as p

from .features import S, W, roll
from .registry import query, rounded, rounded_sql

R = f"(SELECT series_id, ts, t, coalesce(close / lag(close) {S}) - 1, 0) / 10 AS ret, round(1 / (1 + exp(-(close / avg(close) {roll(52)} - 1) * 8)), 6) AS p_crisis FROM {W})"
VOLW = f"CASE WHEN count(ret) {roll(20)} >= 5 THEN least(greatest(0.1::DOUBLE / greatest(stddev_samp(ret) {roll(20)} * sqrt(252), 0.01::DOUBLE), 0), 2) ELSE 0 END"
SIG = "(1 - 1.0::DOUBLE / (1.0::DOUBLE + exp(-20.0::DOUBLE * (p_crisis - 0.5::DOUBLE))))"


def base(spark, sf):
    w = p.weekly(spark, sf)
    mean = F.avg("close").over(ordered().rowsBetween(-51, 0))
    w = w.withColumn("p_crisis", F.round(1 / (1 + F.exp(-(F.col("close") / mean - 1) * 8)), 6))
    return w.withColumn("ret", F.coalesce(f.momentum("close", 1), F.lit(0.0)) / 10).drop("close")


@query("w23_vol_target", rounded_sql("series_id, t", f"weight={VOLW}", R))
def _(spark, sf):
    return rounded(base(spark, sf).select("series_id", "t", b.vol_target_weight("ret").alias("weight")))


@query("p8_regime_weight", rounded_sql("series_id, t", f"sigmoid={SIG}, linear=1 - least(greatest((p_crisis - 0.5::DOUBLE) / 0.3::DOUBLE, 0), 1) * 1.5::DOUBLE", R))
def _(spark, sf):
    one, pc = F.lit(1.0), F.col("p_crisis")
    return rounded(base(spark, sf).select("series_id", "t", b.regime_weight(one, pc).alias("sigmoid"), b.regime_weight(one, pc, crisis=-0.5, ramp="linear").alias("linear")))


@query("p9_limits", rounded_sql("series_id, t", "w=greatest(least(p_crisis * 4 - 1, 1.5::DOUBLE), -0.5::DOUBLE), vt=0.12::DOUBLE * (1 - p_crisis) + 0.05::DOUBLE * p_crisis", R))
def _(spark, sf):
    return rounded(base(spark, sf).select("series_id", "t", b.clipped(F.col("p_crisis") * 4 - 1).alias("w"), b.dynamic_vol_target(F.col("p_crisis")).alias("vt")))


@query("p13_tiered_position", rounded_sql("series_id, t", "position=CASE WHEN p_crisis * 3 >= 2 THEN 0.0 WHEN p_crisis * 3 >= 1.5 THEN 0.5 ELSE 1 END", R))
def _(spark, sf):
    return rounded(base(spark, sf).select("series_id", "t", b.tiered_position(F.col("p_crisis") * 3).alias("position")))


NET = f"(SELECT *, ret * w AS gross, coalesce(abs(w - lag(w) {S})), 0) * 1.5::DOUBLE / 10000 AS cost FROM (SELECT *, {VOLW} AS w FROM {R}))"


@query("b1_net_returns", rounded_sql("series_id, t", "gross, cost, net=gross - cost", NET))
def _(spark, sf):
    x = base(spark, sf).withColumn("w", b.vol_target_weight("ret"))
    return rounded(b.net_returns(x, "ret", "w").select("series_id", "t", "gross", "cost", "net"))


@query("b1_portfolio_returns", f"""SELECT ts, round(sum(ret * w), 6) + 0.0 AS gross, round(sum(c), 6) + 0.0 AS cost, round(sum(ret * w) - sum(c), 6) + 0.0 AS net FROM (SELECT *, coalesce(abs(w - lag(w) {S})), 0) * (CASE WHEN series_id = 'ASIA' THEN 3 ELSE 1 END + 0.5::DOUBLE) / 10000 AS c FROM (SELECT *, {VOLW} AS w FROM {R})) GROUP BY ts""")
def _(spark, sf):
    x = base(spark, sf).withColumn("weight", b.vol_target_weight("ret"))
    return rounded(b.portfolio_returns(x, spark.createDataFrame([("ASIA", 3.0)], "series_id string, bps double")))


@query("b5_benchmarks", rounded_sql("series_id, t", f"constant_vol=coalesce(lag(w) {S}), 0)", f"(SELECT *, {VOLW} AS w FROM {R})"))
def _(spark, sf):
    return rounded(b.benchmarks(base(spark, sf)).select("series_id", "t", "constant_vol"))


@query("b5_equal_weight", f"SELECT ts, round(avg(ret), 6) + 0.0 AS ret FROM {R} GROUP BY ts")
def _(spark, sf):
    return rounded(b.equal_weight(base(spark, sf)))


PERF = f"""WITH e AS (SELECT *, exp(sum(ln(1 + ret)) {S})) AS eq FROM {R}), d AS MATERIALIZED (SELECT *, 1 - eq / max(eq) {S}) AS dd FROM e),
i AS (SELECT series_id, max(k) AS max_dd_duration FROM (SELECT series_id, count(*) AS k FROM (SELECT *, t - sum((dd > 0.001)::INTEGER) {S}) AS isle FROM d) WHERE dd > 0.001 GROUP BY series_id, isle) GROUP BY 1),
g AS (SELECT series_id, count(*) AS n, exp(sum(ln(1 + ret))) - 1 AS tr, avg(ret) AS m, stddev_samp(ret) AS sd, max(dd) AS mdd, avg((ret > 0)::DOUBLE) AS positive, stddev_samp(ret) FILTER (ret < 0) AS dsd FROM d GROUP BY 1)
SELECT series_id, n, round(tr, 6) + 0.0 AS total_return, round(mdd, 6) + 0.0 AS max_drawdown, round(positive, 6) AS positive, round(pow(1 + tr, 252.0::DOUBLE / n) - 1, 6) + 0.0 AS annual_return, round(sd * sqrt(252), 6) AS annual_vol, round(m / sd * sqrt(252), 6) + 0.0 AS sharpe,
  round(m * 252 / (dsd * sqrt(252)), 6) + 0.0 AS sortino, round(CASE WHEN mdd > 0.01 THEN (pow(1 + tr, 252.0::DOUBLE / n) - 1) / mdd ELSE 0 END, 6) + 0.0 AS calmar, coalesce(max_dd_duration, 0) AS max_dd_duration FROM g LEFT JOIN i USING (series_id)"""


@query("b6_performance", PERF)
def _(spark, sf):
    return rounded(b.performance(base(spark, sf), "ret").drop("skewness", "kurtosis"))


HAC = f"""WITH x AS (SELECT series_id, t, ret AS a, ret * {VOLW} AS b, ret - ret * {VOLW} AS d FROM {R}), g AS (SELECT series_id, count(*) AS n, avg(d) AS md, avg(a) / stddev_samp(a) * sqrt(252) - avg(b) / stddev_samp(b) * sqrt(252) AS diff, floor(4 * pow(count(*) / 100.0::DOUBLE, 2 / 9.0::DOUBLE)) AS most FROM x GROUP BY 1 HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT x.series_id, x.t, d - md AS c, most FROM x JOIN g USING (series_id)), p AS (SELECT a.series_id, j, a.most, avg(a.c * b.c) AS gamma FROM c a, (SELECT unnest(range(0, 12)) AS j) js JOIN c b ON a.series_id = b.series_id AND b.t = a.t - j WHERE j <= a.most GROUP BY ALL),
v AS (SELECT series_id, sum(CASE WHEN j = 0 THEN gamma ELSE 2 * (1 - j / (most + 1)) * gamma END) AS v FROM p GROUP BY 1)
SELECT series_id, round(diff, 5) + 0.0 AS difference, round(diff / (sqrt(v / n) * sqrt(252)), 5) + 0.0 AS z FROM g JOIN v USING (series_id)"""


@query("b7_sharpe_difference", HAC)
def _(spark, sf):
    x = base(spark, sf).withColumn("managed", F.col("ret") * b.vol_target_weight("ret"))
    return rounded(b.sharpe_difference(x, "ret", "managed").drop("p"), 5)


@query("b8_break_even", f"SELECT series_id, round(sum(gross) / sum(tv) * 10000, 4) + 0.0 AS bps FROM (SELECT series_id, ret * w AS gross, coalesce(abs(w - lag(w) {S})), 0) AS tv FROM (SELECT *, {VOLW} AS w FROM {R})) GROUP BY 1")
def _(spark, sf):
    x = base(spark, sf).withColumn("w", b.vol_target_weight("ret")).withColumn("gross", F.col("ret") * F.col("w")).withColumn("tv", b.turnover("w"))
    return rounded(b.break_even_cost(x, "gross", "tv"), 4)


@query("b9_win_rate", f"SELECT series_id, round(avg((ret * w > 0)::DOUBLE), 6) AS win_rate FROM (SELECT *, coalesce(lag(v) {S}), 0) AS w FROM (SELECT *, {VOLW} AS v FROM {R})) WHERE w <> 0 GROUP BY 1")
def _(spark, sf):
    x = b.benchmarks(base(spark, sf)).where("constant_vol <> 0")
    return rounded(x.groupBy("series_id").agg(F.avg((F.col("ret") * F.col("constant_vol") > 0).cast("double")).alias("win_rate")))


@query("b10_lead_by_correlation", f"""WITH v AS MATERIALIZED (SELECT series_id, t, p_crisis AS x, stddev_samp(ret) {roll(20)} AS y FROM {R}), c AS (SELECT a.series_id, k::INTEGER AS lag, corr(a.x, b.y) AS corr FROM v a, (SELECT unnest(range(0, 130, 5)) AS k) ks JOIN v b ON a.series_id = b.series_id AND b.t = a.t + k WHERE a.x IS NOT NULL AND b.y IS NOT NULL GROUP BY ALL HAVING count(*) >= 30)
SELECT series_id, lag, round(corr, 6) + 0.0 AS corr FROM c QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(abs(corr), 9) DESC, lag) = 1""")
def _(spark, sf):
    x = base(spark, sf).withColumn("vol", F.stddev_samp("ret").over(ordered().rowsBetween(-19, 0)))
    return rounded(b.lead_by_correlation(x, "p_crisis", "vol"))


def rows_only(name, f):
    query(name)(lambda spark, sf: rounded(f(base(spark, sf))))


def held_sql(src, days):
    """series_id, t, v: weights w of src under a minimum holding period, row by row."""
    moved = "abs(x.w - e.v) > 0.01"
    return f"""(WITH RECURSIVE x AS MATERIALIZED (SELECT series_id, t, w FROM {src}), e(series_id, t, v, since) AS (SELECT series_id, t, w, 0::BIGINT FROM x WHERE t = 0
  UNION ALL SELECT x.series_id, x.t, CASE WHEN {moved} AND x.t - e.since < {days} THEN e.v ELSE x.w END, CASE WHEN {moved} AND x.t - e.since >= {days} THEN x.t ELSE e.since END FROM e JOIN x ON x.series_id = e.series_id AND x.t = e.t + 1) SELECT series_id, t, v FROM e)"""


def braked_sql(src, limit, cool=20):
    """series_id, t, v: weights w of src (with r, the return) under a drawdown circuit breaker."""
    return f"""(WITH RECURSIVE q AS (SELECT series_id, t, w, exp(sum(ln(1 + coalesce(r, 0))) {S})) AS eq FROM {src}), x AS MATERIALIZED (SELECT series_id, t, w, (max(eq) {S}) - eq) / max(eq) {S}) AS dd FROM q),
 e(series_id, t, v, until) AS (SELECT series_id, t, CASE WHEN dd > {limit} THEN 0.0::DOUBLE ELSE w END, CASE WHEN dd > {limit} THEN t + {cool} ELSE -1 END FROM x WHERE t = 0
  UNION ALL SELECT x.series_id, x.t, CASE WHEN x.t < e.until OR x.dd > {limit} THEN 0.0::DOUBLE ELSE x.w END, CASE WHEN x.t >= e.until AND x.dd > {limit} THEN x.t + {cool} ELSE e.until END FROM e JOIN x ON x.series_id = e.series_id AND x.t = e.t + 1) SELECT series_id, t, v FROM e)"""


def long_flat_sql(p):
    """long_flat of R with the probability p."""
    sig = f"(1 - 1.0::DOUBLE / (1.0::DOUBLE + exp(-20.0::DOUBLE * (coalesce({p}, 0) - 0.5::DOUBLE))))"
    held = held_sql(f"(SELECT series_id, t, {VOLW} * {sig} AS w FROM {R})", 3)
    lagged = f"(SELECT r.series_id, r.t, r.ret, coalesce(lag(greatest(least(h.v, 1.5::DOUBLE), 0)) OVER (PARTITION BY r.series_id ORDER BY r.t), 0) AS w FROM {R} r JOIN {held} h ON h.series_id = r.series_id AND h.t = r.t)"
    return braked_sql(f"(SELECT series_id, t, w, ret * w AS r FROM {lagged})", 0.20)


def strategy(name, sql, f, out):
    query(name, rounded_sql("series_id, t", f"{out}=v", sql))(lambda spark, sf: rounded(f(base(spark, sf)).select("series_id", "t", out)))


strategy("b2_min_holding", held_sql(f"(SELECT series_id, t, CASE WHEN p_crisis * 3 >= 2 THEN 0.0::DOUBLE WHEN p_crisis * 3 >= 1.5 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM {R})", 5), lambda x: b.min_holding(x.withColumn("w", b.tiered_position(F.col("p_crisis") * 3)), "w", 5), "held")
strategy("b3_circuit_breaker", braked_sql(f"(SELECT series_id, t, 1.0::DOUBLE AS w, ret AS r FROM {R})", 0.05), lambda x: b.circuit_breaker(b.equity(x.withColumn("w", F.lit(1.0)), "ret"), "w", "drawdown", 0.05), "braked")
strategy("b4_long_flat", long_flat_sql("p_crisis"), b.long_flat, "weight")
SHORT = f"(SELECT series_id, t, coalesce(lag(greatest(least(vw * (1 - 1.5::DOUBLE / (1.0::DOUBLE + exp(-20.0::DOUBLE * (p_crisis - 0.5::DOUBLE)))), 1.5::DOUBLE), -0.5::DOUBLE)) {S}), 0) AS v FROM (SELECT *, {VOLW} AS vw FROM {R}))"
strategy("b4_long_short", SHORT, b.long_short, "weight")
CONT = f"(SELECT series_id, t, coalesce(lag(CASE WHEN k >= 5 THEN greatest(least((0.12::DOUBLE * (1 - p_crisis) + 0.05::DOUBLE * p_crisis) / greatest(sd * sqrt(252), 0.01::DOUBLE), 1.5::DOUBLE), 0) ELSE 0 END) {S}), 0) AS v FROM (SELECT *, count(ret) {roll(20)} AS k, stddev_samp(ret) {roll(20)} AS sd FROM {R}))"
strategy("b4_continuous", CONT, b.continuous, "weight")
strategy("b4_multi_signal", long_flat_sql("((p_crisis + (1 - p_crisis * p_crisis)) / 2)"), lambda x: b.multi_signal(x.withColumn("p2", 1 - F.col("p_crisis") * F.col("p_crisis")), ["p_crisis", "p2"]), "weight")
rows_only("b7_sharpe_ci", lambda x: b.sharpe_ci(x, "ret"))
rows_only("b8_sensitivity", lambda x: b.sensitivity(x, [0.05, 0.1, 0.15], [0.4, 0.5, 0.6]))


ZED = f"(SELECT *, (p_crisis - avg(p_crisis) {roll(52)}) / nullif(stddev_samp(p_crisis) {roll(52)}, 0) AS z FROM {R})"
WAYS = "('none', false, ret), ('always', true, ret * 0.9::DOUBLE - 0.0005::DOUBLE), ('timed', coalesce(z > 1.5, false), CASE WHEN z > 1.5 THEN ret * 0.9::DOUBLE - 0.0005::DOUBLE ELSE ret END), ('mistimed', coalesce(z <= 1.5, false), CASE WHEN z <= 1.5 THEN ret * 0.9::DOUBLE - 0.0005::DOUBLE ELSE ret END)"


@query("b9_hedge_timing", f"""WITH x AS MATERIALIZED (SELECT series_id, t, k.strategy, k.hedge, k.r FROM (SELECT * EXCLUDE (z), round(z, 9) AS z FROM {ZED}) s, LATERAL (VALUES {WAYS}) k(strategy, hedge, r)),
c AS (SELECT *, exp(sum(r) OVER (PARTITION BY series_id, strategy ORDER BY t)) AS c FROM x), d AS (SELECT *, 1 - c / max(c) OVER (PARTITION BY series_id, strategy ORDER BY t) AS dd FROM c)
SELECT series_id, strategy, round(avg(hedge::INTEGER), 6) AS hedged, count(*) AS n, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe, round(max(dd), 6) AS max_drawdown, round(avg(r) * 252 / max(dd), 6) AS calmar FROM d GROUP BY ALL""")
def _(spark, sf):
    w = ordered().rowsBetween(-51, 0)
    z = (F.col("p_crisis") - F.avg("p_crisis").over(w)) / F.nullif(F.stddev_samp("p_crisis").over(w), F.lit(0.0))
    return rounded(b.hedge_timing(base(spark, sf).withColumn("z", F.round(z, 9)), "z"))
