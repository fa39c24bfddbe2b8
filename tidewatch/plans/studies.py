"""Queries of sweeps, variant panels, signatures, consensus, matching balance and framing tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.windows import expanding_z_sql
from tidewatch.operators import evaluate as e
from tidewatch.operators import features as f
from tidewatch.operators import topology as top
from tidewatch.operators import variants as v
from tidewatch.operators.joins import union_label
from tidewatch.sources import panels as p
from tidewatch.sources.panels import EVENTS_SQL

from .evaluation import POOLED, SCORES, panel_scores
from .features import DRET, RET, S, W, returns, roll, std
from .registry import query, rounded, rounded_sql

VARIANTS = [("vol10", 10, 1), ("vol20", 20, 1), ("vol40", 40, 5), ("vol60", 60, 10)]


def variant_sql(ret):
    one = lambda m, w, r: f"SELECT series_id, ts, t, '{m}' AS method, round(score, 6) AS score FROM {expanding_z_sql(f'(SELECT series_id, ts, t, {std("ret", w)} AS x FROM {ret})', 'x', r, 60, 0, 'abs')}"
    return "(" + " UNION ALL ".join(one(*x) for x in VARIANTS) + ")"


def effect_sql(scores):
    """d of every cell of a score table."""
    cells = f"(SELECT s.*, event_id, ts BETWEEN x.start AND x.stop AS inside FROM {scores} s, {EVENTS_SQL} x)"
    mom = f"(SELECT series_id, method, event_id, count(score) FILTER (inside) AS n1, avg(score) FILTER (inside) AS m1, var_samp(score) FILTER (inside) AS v1, count(score) FILTER (NOT inside) AS n2, avg(score) FILTER (NOT inside) AS m2, var_samp(score) FILTER (NOT inside) AS v2 FROM {cells} GROUP BY ALL HAVING count(score) FILTER (inside) > 0)"
    return f"(SELECT *, CASE WHEN n1 >= 2 AND n2 >= 2 THEN CASE WHEN {POOLED} < 1e-12 THEN 0.0 ELSE abs(m1 - m2) / {POOLED} END END AS d FROM {mom})"


@query("m16_parameter_sweep", f"SELECT series_id, arg_max(method, (median_d, method)) AS best, max(median_d) AS median_d FROM (SELECT series_id, method, round(quantile_cont(d, 0.5), 6) AS median_d FROM {effect_sql(variant_sql(RET))} WHERE d IS NOT NULL GROUP BY ALL) GROUP BY 1")
def _(spark, sf):
    s = v.volatility_variants(returns(spark, sf), VARIANTS).withColumn("score", F.round("score", 6))
    return rounded(v.sweep(s, p.events_dim(spark)))


@query("e32_variant_panel", f"SELECT method, count(d) AS n, round(avg(d), 6) AS mean_d, round(quantile_cont(d, 0.5), 6) AS median_d FROM {effect_sql(variant_sql(DRET))} GROUP BY 1")
def _(spark, sf):
    """The same variants on another class of series, the daily panel."""
    from tidewatch.operators.evaluate import cohens_d, group_moments

    s = v.volatility_variants(returns(spark, sf, p.daily), VARIANTS).withColumn("score", F.round("score", 6))
    d = cohens_d(group_moments(s, p.events_dim(spark)))
    return rounded(d.groupBy("method").agg(F.count("d").alias("n"), F.avg("d").alias("mean_d"), F.percentile("d", F.lit(0.5)).alias("median_d")))


RATIOS = f"""(WITH i AS (SELECT series_id, event_id, min(close) AS lo, max(close) AS hi, min(t) AS t0 FROM {W} w JOIN {EVENTS_SQL} x ON w.ts BETWEEN x.start AND x.stop GROUP BY ALL),
b AS (SELECT i.series_id, i.event_id, avg(w.close) AS m, quantile_cont(w.close, 0.5) AS md FROM i JOIN {W} w ON w.series_id = i.series_id AND w.t >= i.t0 - 252 AND w.t < i.t0 GROUP BY ALL)
SELECT i.series_id, i.event_id, lo / m AS collapse, hi / md AS intensity FROM i JOIN b USING (series_id, event_id))"""


def ratios(spark, sf):
    return v.collapse_ratios(p.weekly(spark, sf), "close", p.events_dim(spark))


@query("g31_event_ratios", rounded_sql("series_id, event_id", "collapse, intensity", RATIOS))
def _(spark, sf):
    return rounded(ratios(spark, sf))


@query("e31_attribute_split", f"""SELECT series_id, round(m1, 6) AS novel, round(m2, 6) AS other, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) + 0.0 AS t FROM (SELECT series_id, count(intensity) FILTER (category = 'novel') AS n1, avg(intensity) FILTER (category = 'novel') AS m1, var_samp(intensity) FILTER (category = 'novel') AS v1,
  count(intensity) FILTER (category <> 'novel') AS n2, avg(intensity) FILTER (category <> 'novel') AS m2, var_samp(intensity) FILTER (category <> 'novel') AS v2 FROM {RATIOS} JOIN {EVENTS_SQL} USING (event_id) GROUP BY 1)""")
def _(spark, sf):
    return rounded(v.attribute_split(ratios(spark, sf), p.events_dim(spark), "intensity"))


@query("t6_regime_signature", f"""WITH r AS (SELECT series_id, year(ts)::INTEGER AS segment, t, ret AS c, close / 1e6 AS g, row_number() OVER (PARTITION BY series_id, year(ts) ORDER BY t) - 1 AS i FROM {RET} WHERE ret IS NOT NULL), m AS (SELECT series_id, segment, avg(c) AS m, stddev_pop(c) AS s FROM r GROUP BY ALL)
SELECT series_id, segment, round(max(m), 6) + 0.0 AS curvature_mean, round(max(s), 6) AS curvature_std, round(avg(((c - m) / (s + 1e-8)) ** 3), 6) + 0.0 AS curvature_skewness, round(avg(((c - m) / (s + 1e-8)) ** 4) - 3, 6) + 0.0 AS curvature_kurtosis,
  round(avg(g) FILTER (i % 10 = 0), 6) + 0.0 AS gap_mean, round(stddev_pop(g) FILTER (i % 10 = 0), 6) + 0.0 AS gap_std FROM r JOIN m USING (series_id, segment) GROUP BY ALL""")
def _(spark, sf):
    x = returns(spark, sf).withColumn("segment", F.year("ts")).withColumn("gap", F.col("close") / 1e6)
    return rounded(v.regime_signature(x, "ret", "gap", "segment"))


SCALES = {10: 0.2, 20: 0.2, 30: 0.2, 50: 0.2, 100: 0.2}


def signal_sql(k, w):
    n = f"OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {max(60, 3 * k) - 1} PRECEDING AND CURRENT ROW)"
    return f"""SELECT series_id, t, {k} AS scale, {w}::DOUBLE AS weight, d / (coalesce(first_value(n IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(n IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) + 1e-8) AS signal
  FROM (SELECT *, CASE WHEN count(d) {n} >= 20 THEN stddev_samp(d) {n} END AS n FROM (SELECT series_id, t, abs(c - coalesce(lag(c) {S}), c)) AS d FROM (SELECT series_id, t, avg(ret) {roll(k)} AS c FROM {RET}) WHERE c IS NOT NULL))"""


SIGNALS = "(" + " UNION ALL ".join(signal_sql(k, w) for k, w in SCALES.items()) + ")"


@query("t8_scale_consensus", f"""SELECT series_id, t, round(consensus, 6) + 0.0 AS consensus, up AND NOT coalesce(lag(up) {S}), false) AS onset FROM (SELECT series_id, t, consensus, round(consensus, 9) >= 0.6 AS up FROM (SELECT series_id, t, sum(weight * signal) / sum(weight) AS consensus FROM {SIGNALS} GROUP BY ALL))""")
def _(spark, sf):
    return rounded(v.scale_consensus(v.scale_signals(returns(spark, sf), "ret", SCALES)))


@query("t8_scale_correlations", rounded_sql("series_id, scale_a, scale_b", "rho", f"(SELECT a.series_id, a.scale AS scale_a, b.scale AS scale_b, corr(a.signal, b.signal) AS rho FROM {SIGNALS} a JOIN {SIGNALS} b ON a.series_id = b.series_id AND a.t = b.t AND a.scale < b.scale GROUP BY ALL)"))
def _(spark, sf):
    return rounded(v.scale_correlations(v.scale_signals(returns(spark, sf), "ret", SCALES)))


TW = {"vol20": 1.0, "mom20": -0.5, "close": 0.5}
zs = lambda c: f"CASE WHEN stddev_samp({c}) OVER g > 1e-12 THEN ({c} - avg({c}) OVER g) / stddev_samp({c}) OVER g ELSE 0 END"
PANEL3 = f"(SELECT series_id, t, {std('ret', 20)} AS vol20, close / lag(close, 20) {S}) - 1 AS mom20, close FROM {RET})"


@query("t9_composite_index", f'SELECT series_id, t, round((1.0::DOUBLE * {zs("vol20")} - 0.5::DOUBLE * {zs("mom20")} + 0.5::DOUBLE * {zs("close")}) / 2, 6) + 0.0 AS "index" FROM {PANEL3} WINDOW g AS (PARTITION BY series_id)')
def _(spark, sf):
    x = returns(spark, sf).select("series_id", "t", f.rolling_std("ret", 20).alias("vol20"), f.momentum("close", 20).alias("mom20"), "close")
    return rounded(top.composite_index(x, TW).select("series_id", "t", "index"))


M0, SX, SY, SXY = (f"{g} OVER u" for g in ("count(a)", "var_pop(a)", "var_pop(b)", "covar_pop(a, b)"))
TURB = f"""(SELECT series_id, t, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND t >= 60 AND k >= 4 THEN sqrt(greatest(((a - ma) ** 2 * syy - 2 * (a - ma) * (b - mb) * sxy + (b - mb) ** 2 * sxx) / (sxx * syy - sxy * sxy), 0)) END AS turbulence FROM (
  SELECT *, {M0} AS k, avg(a) OVER u AS ma, avg(b) OVER u AS mb, {SX} + 1e-6 AS sxx, {SY} + 1e-6 AS syy, {SXY} AS sxy FROM (SELECT series_id, t, CASE WHEN close IS NOT NULL THEN ret END AS a, CASE WHEN ret IS NOT NULL THEN close / 1e6 END AS b FROM {RET}) WINDOW u AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


@query("d5_turbulence", rounded_sql("series_id, t", "turbulence, score", expanding_z_sql(TURB, "turbulence", 1, 60, 0, "abs"), 5))
def _(spark, sf):
    x = returns(spark, sf).withColumn("level", F.col("close") / 1e6)
    return rounded(v.turbulence_pair(x, "ret", "level").select("series_id", "t", "turbulence", "score"), 5)


@query("e23_granger", f"""SELECT series_id, n, round(r2_own, 6) AS r2_own, round(r2, 6) AS r2, round((r2 - r2_own) / ((1 - r2) / (n - 3)), 4) + 0.0 AS f_stat FROM (SELECT series_id, n, a * a AS r2_own, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS r2 FROM (
  SELECT series_id, count(*) AS n, corr(y, y1) AS a, corr(y, x1) AS b, corr(y1, x1) AS c FROM (SELECT series_id, y, lag(y) {S}) AS y1, lag(x) {S}) AS x1 FROM (SELECT series_id, t, abs(ret) AS y, {std('ret', 20)} AS x FROM {RET})) WHERE y IS NOT NULL AND y1 IS NOT NULL AND x1 IS NOT NULL GROUP BY 1))""")
def _(spark, sf):
    x = returns(spark, sf).select("series_id", "t", F.abs("ret").alias("y"), f.rolling_std("ret", 20).alias("x"))
    g = e.granger(x, "x", "y", ["series_id"])
    return g.select("series_id", "n", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("r2_own", 6), ("r2", 6), ("f_stat", 4))])


@query("e23_conformal", f"""WITH r AS (SELECT series_id, ret, t < 150 AS fit FROM {RET} WHERE ret IS NOT NULL), c AS (SELECT series_id, avg(ret) AS m FROM r WHERE fit GROUP BY 1), w AS (SELECT series_id, quantile_cont(abs(ret - m), 0.9) AS width FROM r JOIN c USING (series_id) WHERE fit GROUP BY 1)
SELECT series_id, round(max(width), 6) AS width, round(avg((abs(ret - m) <= width)::INTEGER), 6) AS coverage, count(*) AS n FROM r JOIN c USING (series_id) JOIN w USING (series_id) WHERE NOT fit GROUP BY 1""")
def _(spark, sf):
    return rounded(e.conformal_coverage(returns(spark, sf), "ret", ["series_id"], F.col("t") < 150))


@query("e25_near_misses", f"SELECT series_id, method, event_id, round(avg(score), 6) + 0.0 AS mean_score, max(score) AS max_score, round(avg((score > 2)::INTEGER), 6) AS share FROM {SCORES} s JOIN {EVENTS_SQL} x ON s.ts BETWEEN x.start AND x.stop WHERE score IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return rounded(e.near_misses(panel_scores(spark, sf), p.events_dim(spark)))


@query("e25_proximity_effect", f"""SELECT series_id, round(a, 6) + 0.0 AS near, round(b, 6) + 0.0 AS far, n AS n_near, round(a - b, 6) + 0.0 AS effect FROM (SELECT series_id, avg(abs(ret)) FILTER (near) AS a, avg(abs(ret)) FILTER (NOT near) AS b, count(*) FILTER (near) AS n
  FROM (SELECT r.*, EXISTS (SELECT 1 FROM {EVENTS_SQL} x WHERE r.ts BETWEEN x.start - INTERVAL 5 DAY AND x.start + INTERVAL 5 DAY) AS near FROM {RET} r WHERE ret IS NOT NULL) GROUP BY 1)""")
def _(spark, sf):
    x = returns(spark, sf).withColumn("x", F.abs("ret"))
    return rounded(e.proximity_effect(x, p.events_dim(spark).select(F.col("start").alias("ts")), "x"))


@query("e25_tail_exponent", f"SELECT series_id, round(regr_slope(ln(r), ln(a)), 5) + 0.0 AS slope, count(*) AS n FROM (SELECT series_id, a, rank() OVER (PARTITION BY series_id ORDER BY a DESC) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM (SELECT series_id, abs(ret) AS a FROM {RET}) WHERE a > 0) WHERE r <= n * 0.1 GROUP BY 1")
def _(spark, sf):
    return rounded(e.tail_exponent(returns(spark, sf), "ret", ["series_id"]), 5)


@query("e25_dominant_period", f"""WITH x AS (SELECT series_id, t, ret - avg(ret) OVER (PARTITION BY series_id) AS x FROM {RET} WHERE ret IS NOT NULL), g AS (SELECT series_id, period, sum(x * cos(2 * pi() * t / period)) ** 2 + sum(x * sin(2 * pi() * t / period)) ** 2 AS p, count(*) AS n FROM x, (SELECT unnest(range(2, 65)) AS period) GROUP BY ALL)
SELECT series_id, period::INTEGER AS period, round(p / n, 6) AS power FROM g QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(p / n, 9) DESC, period) = 1""")
def _(spark, sf):
    return rounded(e.dominant_period(returns(spark, sf), "ret", ["series_id"]))


COV = ("vol20", "mom20")


@query("e26_balance", f"""WITH x AS (SELECT w.series_id, w.t, vol20, mom20, EXISTS (SELECT 1 FROM {EVENTS_SQL} e WHERE q.ts BETWEEN e.start AND e.stop) AS inside FROM {PANEL3} w JOIN {W} q USING (series_id, t))
""" + " UNION ALL ".join(f"SELECT series_id, '{c}' AS covariate, round(CASE WHEN sqrt((va + vb) / 2) > 1e-12 THEN (a - b) / sqrt((va + vb) / 2) END, 6) + 0.0 AS smd FROM (SELECT series_id, avg({c}) FILTER (inside) AS a, avg({c}) FILTER (NOT inside) AS b, var_samp({c}) FILTER (inside) AS va, var_samp({c}) FILTER (NOT inside) AS vb FROM x GROUP BY 1)" for c in COV))
def _(spark, sf):
    x = returns(spark, sf).select("series_id", "ts", "t", f.rolling_std("ret", 20).alias("vol20"), f.momentum("close", 20).alias("mom20"))
    return rounded(e.mean_difference(union_label(x, p.events_dim(spark)), "inside", list(COV), ["series_id"]))


@query("e30_bound_checks", f"""WITH r AS (SELECT series_id, ret * 100 AS c, abs(ret * 100) * (close / 1e6) ** 2 AS r FROM {RET} WHERE ret IS NOT NULL), g AS (SELECT series_id, max(r) AS k FROM r GROUP BY 1)
SELECT series_id, round(max(k), 6) AS constant, round(avg((r <= k / 2)::INTEGER), 6) AS share, round(avg(abs(c - round_even(c, 0))), 6) AS to_integer, count(*) AS n FROM r JOIN g USING (series_id) GROUP BY 1""")
def _(spark, sf):
    x = returns(spark, sf).select("series_id", (F.col("ret") * 100).alias("c"), (F.col("close") / 1e6).alias("g"))
    return rounded(v.bound_checks(x, "c", "g"))


@query("x12_network_persistence")
def _(spark, sf):
    """Regions' daily orders: the weight of the correlation network's minimum spanning tree, by quarter."""
    from tidewatch.operators.networks import h0_persistence

    return rounded(h0_persistence(p.sparse(spark, sf).withColumn("window", F.trunc("ts", "quarter")), "window", "close"))


@query("j10_caliper_match")
def _(spark, sf):
    """Suppliers matched with customers of near account balances."""
    from tidewatch.operators.joins import caliper_match
    from tidewatch.sources.results import kept_table

    a = p.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("double").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    b = p.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return rounded(caliper_match(a, b, ["balance", "nation"], {"balance": 50.0, "nation": 0.0}, {"balance": 1000.0, "nation": 1.0}, kept_table(spark)))

