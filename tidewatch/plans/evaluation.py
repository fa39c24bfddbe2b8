"""Queries of event studies: effect sizes, ranks, tests, alarm metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions.windows import expanding_z_sql
from tidewatch.operators import alarms, detectors
from tidewatch.operators import evaluate as e
from tidewatch.operators import features as f
from tidewatch.sources import panels as p
from tidewatch.sources.panels import EVENTS_SQL
from tidewatch.sources.results import kept_table

from .detectors import ALARM, SC, quantile_alarms
from .features import RET, S, W, returns, roll, std
from .registry import query, rounded, rounded_sql

METHODS = ("rolling_vol", "momentum", "level")


def panel_scores(spark, sf):
    """Three methods' scores on the weekly panel, rounded so that ranks agree between engines."""
    r = returns(spark, sf)
    vol = detectors.score_with(r, "rolling_vol")
    from tidewatch.functions.windows import expanding_z

    mom = expanding_z(r.withColumn("x", f.momentum("close", 20)), "x", roll=5, form="abs").select("series_id", "ts", "t", F.lit("momentum").alias("method"), "score")
    lev = expanding_z(r, "close", roll=5).select("series_id", "ts", "t", F.lit("level").alias("method"), "score")
    return vol.unionByName(mom).unionByName(lev).withColumn("score", F.round("score", 6))


def _z(method, src, raw, roll_, form):
    return f"SELECT series_id, ts, t, '{method}' AS method, round(score, 6) AS score FROM {expanding_z_sql(src, raw, roll_, 60, 0, form)}"


SCORES = "(" + " UNION ALL ".join([
    _z("rolling_vol", f"(SELECT series_id, ts, t, stddev_samp(ret) {roll(20)} AS x FROM {RET})", "x", 1, "abs"),
    _z("momentum", f"(SELECT series_id, ts, t, close / lag(close, 20) {S}) - 1 AS x FROM {W})", "x", 5, "abs"),
    _z("level", W, "close", 5, "signed"),
]) + ")"
CELLS = f"(SELECT s.*, event_id, ts BETWEEN e.start AND e.stop AS inside FROM {SCORES} s, {EVENTS_SQL} e)"
MOM = f"""(SELECT series_id, method, event_id, count(score) FILTER (inside) AS n1, avg(score) FILTER (inside) AS m1, var_samp(score) FILTER (inside) AS v1, count(score) FILTER (NOT inside) AS n2, avg(score) FILTER (NOT inside) AS m2, var_samp(score) FILTER (NOT inside) AS v2
  FROM {CELLS} GROUP BY ALL HAVING count(score) FILTER (inside) > 0)"""
POOLED = "sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))"
D_SQL = f"(SELECT *, CASE WHEN n1 >= 2 AND n2 >= 2 THEN CASE WHEN {POOLED} < 1e-12 THEN 0.0 ELSE abs(m1 - m2) / {POOLED} END END AS d FROM {MOM})"


def kept_scores(spark, sf):
    """panel_scores written once: for studies that read the scores several times."""
    return kept_table(spark)(panel_scores(spark, sf))


def moments(spark, sf):
    return e.group_moments(panel_scores(spark, sf), p.events_dim(spark))


def effects(spark, sf):
    return e.cohens_d(moments(spark, sf))


@query("a1_group_moments", rounded_sql("series_id, method, event_id, n1, n2", "m1, v1, m2, v2", MOM))
def _(spark, sf):
    return rounded(moments(spark, sf))


@query("e4_cohens_d", rounded_sql("series_id, method, event_id", "d", D_SQL))
def _(spark, sf):
    return rounded(effects(spark, sf).select("series_id", "method", "event_id", "d"))


@query("flagship_leaderboard", f"""SELECT series_id, event_id, round(d, 6) AS d, rank() OVER (PARTITION BY event_id ORDER BY round(d, 6) DESC) AS place FROM {D_SQL} WHERE method = 'rolling_vol' AND d IS NOT NULL""")
def leaderboard(spark, sf):
    """Weekly panel -> rolling volatility -> expanding z -> event windows -> effect size -> places within events."""
    r = returns(spark, sf)
    d = e.cohens_d(e.group_moments(detectors.score_with(r, "rolling_vol").withColumn("score", F.round("score", 6)), p.events_dim(spark)))
    d = d.where("d is not null").select("series_id", "event_id", F.round("d", 6).alias("d"))
    return d.withColumn("place", F.rank().over(Window.partitionBy("event_id").orderBy(F.col("d").desc())))


@query("a2_method_leaderboard", rounded_sql("method, n", "median_d, mean_d, max_d", f"(SELECT method, count(d) AS n, quantile_cont(d, 0.5) AS median_d, avg(d) AS mean_d, max(d) AS max_d FROM {D_SQL} GROUP BY 1)"))
def _(spark, sf):
    g = effects(spark, sf).groupBy("method").agg(F.count("d").alias("n"), F.percentile("d", F.lit(0.5)).alias("median_d"), F.avg("d").alias("mean_d"), F.max("d").alias("max_d"))
    return rounded(g)


@query("a3_category_rollup", rounded_sql("category, method, n", "mean_d", f"(SELECT category, method, count(d) AS n, avg(d) AS mean_d FROM {D_SQL} JOIN {EVENTS_SQL} USING (event_id) GROUP BY GROUPING SETS ((category), (method), (category, method), ()))"))
def _(spark, sf):
    j = effects(spark, sf).join(p.events_dim(spark).select("event_id", "category"), "event_id")
    return rounded(j.cube("category", "method").agg(F.count("d").alias("n"), F.avg("d").alias("mean_d")))


@query("a4_split_metrics", rounded_sql("series_id, split, n", "m, s", f"(SELECT series_id, CASE WHEN ts < DATE '1999-01-01' THEN 'in' ELSE 'out' END AS split, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s FROM {RET} GROUP BY ALL)"))
def _(spark, sf):
    r = returns(spark, sf).withColumn("split", F.when(F.col("ts") < F.to_date(F.lit("1999-01-01")), "in").otherwise("out"))
    return rounded(r.groupBy("series_id", "split").agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s")))


RD = f"(SELECT series_id || event_id AS block, method, round(d, 6) AS d FROM {D_SQL} WHERE d IS NOT NULL)"
FULL = f"(SELECT *, rank() OVER (PARTITION BY block ORDER BY d DESC) + (count(*) OVER (PARTITION BY block, d) - 1) / 2.0::DOUBLE AS rk FROM {RD} WHERE block IN (SELECT block FROM {RD} GROUP BY 1 HAVING count(DISTINCT method) = 3))"


def blocks(spark, sf):
    d = effects(spark, sf).where("d is not null").select(F.concat("series_id", "event_id").alias("block"), "method", F.round("d", 6).alias("d"))
    return kept_table(spark)(d)  # ranks, ties and complete blocks each read it


@query("a5_block_ranks", f"SELECT block, method, rk AS rank FROM {FULL}")
def _(spark, sf):
    return e.complete_ranks(blocks(spark, sf), "block", "method", "d").select("block", "method", "rank")


@query("a6_window_returns", rounded_sql("series_id, event_id", "total", f"(SELECT series_id, event_id, exp(sum(ln(1 + r))) - 1 AS total FROM (SELECT series_id, ts, coalesce(close / lag(close) {S}) - 1, 0) / 10 AS r FROM {W}) JOIN {EVENTS_SQL} ON ts BETWEEN start AND stop GROUP BY ALL)"))
def _(spark, sf):
    from tidewatch.operators.backtest import window_returns

    r = p.weekly(spark, sf).withColumn("r", F.coalesce(f.momentum("close", 1), F.lit(0.0)) / 10)
    return rounded(window_returns(r, p.events_dim(spark)))


@query("a7_cross_section", rounded_sql("series_id, ts", "sd, m, hi, share", f"(SELECT series_id, ts, stddev_samp(score) AS sd, avg(score) AS m, max(score) AS hi, avg((score > 1)::DOUBLE) AS share FROM {SCORES} WHERE score IS NOT NULL GROUP BY ALL)"))
def _(spark, sf):
    g = panel_scores(spark, sf).where("score is not null").groupBy("series_id", "ts").agg(F.stddev_samp("score").alias("sd"), F.avg("score").alias("m"), F.max("score").alias("hi"), F.avg((F.col("score") > 1).cast("double")).alias("share"))
    return rounded(g)


BN = f"(SELECT series_id, ret, close, CASE WHEN max(x) {roll(60)} > min(x) {roll(60)} THEN least(floor((x - min(x) {roll(60)}) / (max(x) {roll(60)} - min(x) {roll(60)}) * 5), 4) WHEN x IS NOT NULL THEN 0 END::INTEGER AS bx, CASE WHEN max(close) {roll(60)} > min(close) {roll(60)} THEN least(floor((close - min(close) {roll(60)}) / (max(close) {roll(60)} - min(close) {roll(60)}) * 5), 4) ELSE 0 END::INTEGER AS bc FROM (SELECT *, round(ret, 9) AS x FROM {RET}))"


@query("a8_joint_histogram", f'SELECT series_id, bx, bc AS "by", count(*) AS n FROM {BN} WHERE bx IS NOT NULL AND bc IS NOT NULL GROUP BY ALL')
def _(spark, sf):
    return detectors.joint_counts(returns(spark, sf).withColumn("x", F.round("ret", 9)), "x", "close", 5, 60)


@query("a9_method_correlation", rounded_sql("a, b", "mean_rho", f"(SELECT a, b, avg(abs(rho)) AS mean_rho FROM (SELECT x.series_id, x.method AS a, y.method AS b, corr(x.score, y.score) AS rho FROM {SCORES} x JOIN {SCORES} y ON x.series_id = y.series_id AND x.t = y.t AND x.method < y.method WHERE x.score IS NOT NULL AND y.score IS NOT NULL GROUP BY ALL) GROUP BY ALL)"))
def _(spark, sf):
    from tidewatch.operators.fusion import method_correlations

    return rounded(method_correlations(panel_scores(spark, sf)).groupBy("a", "b").agg(F.avg(F.abs("rho")).alias("mean_rho")))


RANKED = f"(SELECT *, rank() OVER (PARTITION BY series_id, method, event_id ORDER BY score) + (count(*) OVER (PARTITION BY series_id, method, event_id, score) - 1) / 2.0::DOUBLE AS r FROM {CELLS} WHERE score IS NOT NULL)"
U = f"(SELECT series_id, method, event_id, n1, n2, rs - n1 * (n1 + 1) / 2 AS u FROM (SELECT series_id, method, event_id, sum(r) FILTER (inside) AS rs, (count(*) FILTER (inside))::DOUBLE AS n1, (count(*) FILTER (NOT inside))::DOUBLE AS n2 FROM {RANKED} GROUP BY ALL) WHERE n1 > 0 AND n2 > 0)"


@query("e6_cliffs_delta", f"SELECT series_id, method, event_id, u, round(c, 6) + 0.0 AS cliff, CASE WHEN abs(c) < 0.147 THEN 'negligible' WHEN abs(c) < 0.33 THEN 'small' WHEN abs(c) < 0.474 THEN 'medium' ELSE 'large' END AS cliff_label FROM (SELECT *, 2 * u / (n1 * n2) - 1 AS c FROM {U})")
def _(spark, sf):
    return rounded(e.rank_statistics(kept_scores(spark, sf), p.events_dim(spark)).select("series_id", "method", "event_id", "u", "cliff", "cliff_label"))


@query("e7_welch_t", rounded_sql("series_id, method, event_id", "t=(m1 - m2) / sqrt(v1 / n1 + v2 / n2)", MOM))
def _(spark, sf):
    return rounded(e.welch_t(moments(spark, sf)).select("series_id", "method", "event_id", "t"))


# the logistic approximation of the normal tail: both engines have it, and it orders cells as Welch's own p does for many rows
PV = f"(SELECT series_id, method, event_id, round(2 / (1 + exp(1.5976::DOUBLE * abs(t) + 0.07056::DOUBLE * abs(t) ** 3)), 9) AS p FROM (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t FROM {MOM}) WHERE t IS NOT NULL AND isfinite(t))"


@query("e8_adjusted_p", f"""SELECT series_id, method, event_id, round(least(max(h) OVER (PARTITION BY series_id ORDER BY p ROWS UNBOUNDED PRECEDING), 1.0), 6) + 0.0 AS p_holm, round(least(min(b) OVER (PARTITION BY series_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) + 0.0 AS p_bh
FROM (SELECT *, p * (count(*) OVER (PARTITION BY series_id) - row_number() OVER (PARTITION BY series_id ORDER BY p) + 1) AS h, p * count(*) OVER (PARTITION BY series_id) / row_number() OVER (PARTITION BY series_id ORDER BY p) AS b FROM {PV})""")
def _(spark, sf):
    t = F.abs("t")
    tests = e.welch_t(moments(spark, sf)).where("t is not null and not isnan(t) and abs(t) < double('infinity')")
    pv = tests.select("series_id", "method", "event_id", F.round(2 / (1 + F.exp(1.5976 * t + 0.07056 * F.pow(t, 3))), 9).alias("p"))
    return rounded(e.benjamini_hochberg(e.holm(pv, "p", ["series_id"]), "p", ["series_id"]).drop("p"))


K = "(1 + (n1 + n2) / (0.707::DOUBLE * 0.707))"


@query("e10_bayes_factor", f"SELECT series_id, method, event_id, round(ln(greatest(sqrt({K}) * pow(1 + t * t / df, -(df + 1) / 2.0) / pow(1 + t * t / (df * {K}), -(df + 1) / 2.0), 1e-300)), 6) + 0.0 AS log_bf FROM (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, (n1 + n2 - 2)::DOUBLE AS df FROM {MOM} WHERE v1 > 0 AND n1 > 1)")
def _(spark, sf):
    m = e.welch_t(moments(spark, sf)).where("v1 > 0 and n1 > 1")
    return rounded(m.select("series_id", "method", "event_id", F.log(e.bayes_factor(F.col("t"), (F.col("n1") + F.col("n2")).cast("double"))).alias("log_bf")))


@query("e11_friedman", f"""WITH r AS MATERIALIZED (SELECT * FROM {FULL}), m AS (SELECT method, sum(rk) AS rs, count(*)::DOUBLE AS n FROM r GROUP BY 1), t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY block, d)),
a AS (SELECT sum(rs * rs) AS ss, max(n) AS n, count(*)::DOUBLE AS k FROM m), c AS (SELECT n, k, (12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS chi_sq FROM a, t)
SELECT n, k, round(chi_sq, 6) AS chi_sq, round((n - 1) * chi_sq / (n * (k - 1) - chi_sq), 6) AS f_stat FROM c WHERE n >= 3""")
def _(spark, sf):
    return rounded(e.friedman(blocks(spark, sf), "block").select("n", "k", "chi_sq", "f_stat"))


@query("e12_nemenyi", f"""WITH m AS MATERIALIZED (SELECT method, avg(rk) AS r, count(*) AS n, count(*) OVER () AS k FROM {FULL} GROUP BY 1)
SELECT a.method AS method_a, b.method AS method_b, round(abs(a.r - b.r), 6) AS difference, round(3.314493::DOUBLE / sqrt(2) * sqrt(12 / (6.0::DOUBLE * a.n)), 6) AS cd, abs(a.r - b.r) > 3.314493::DOUBLE / sqrt(2) * sqrt(12 / (6.0::DOUBLE * a.n)) AS significant FROM m a JOIN m b ON a.method < b.method""")
def _(spark, sf):
    return rounded(e.nemenyi(blocks(spark, sf), "block"))


AC = f"(SELECT a.*, 'rolling_vol' AS method, event_id, ts BETWEEN e.start AND e.stop AS inside FROM {ALARM} a, {EVENTS_SQL} e)"


def alarm_rows(spark, sf):
    return kept_table(spark)(quantile_alarms(spark, sf).withColumn("method", F.lit("rolling_vol")))


@query("e13_point_metrics", f"""SELECT series_id, method, event_id, round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) + 0.0 AS f1, delay, round(far, 6) + 0.0 AS false_alarms_per_year FROM (
 SELECT series_id, method, event_id, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0::DOUBLE END AS p, CASE WHEN pos > 0 THEN tp / pos::DOUBLE ELSE 0.0::DOUBLE END AS r, delay, CASE WHEN neg > 0 THEN fp / neg::DOUBLE * 252 ELSE 0.0::DOUBLE END AS far FROM (
  SELECT series_id, method, event_id, count(*) FILTER (alarm AND inside) AS tp, count(*) FILTER (alarm AND NOT inside) AS fp, count(*) FILTER (inside) AS pos, count(*) FILTER (NOT inside) AS neg, min(t) FILTER (alarm AND inside) - min(t) FILTER (inside) AS delay FROM {AC} GROUP BY ALL))""")
def _(spark, sf):
    return rounded(e.point_metrics(alarm_rows(spark, sf), p.events_dim(spark)))


AL = f"(SELECT series_id, method, event_id, t FROM {AC} WHERE alarm)"
BO = f"(SELECT series_id, 'rolling_vol' AS method, event_id, min(t) AS a, max(t) AS b FROM {AC} WHERE inside GROUP BY ALL)"


@query("e14_tolerance_f1", f"""WITH j AS MATERIALIZED (SELECT * FROM {AL} JOIN {BO} USING (series_id, method, event_id)),
f AS (SELECT series_id, event_id, arg_min(t, (abs(t - a), t)) AS x FROM j WHERE abs(t - a) <= 10 GROUP BY ALL), s AS (SELECT j.series_id, j.event_id, arg_min(j.t, (abs(j.t - j.b), j.t)) AS y FROM j LEFT JOIN f USING (series_id, event_id) WHERE abs(j.t - j.b) <= 10 AND (x IS NULL OR j.t <> x) GROUP BY ALL),
n AS (SELECT series_id, event_id, count(*) AS n FROM j GROUP BY ALL), h AS (SELECT o.series_id, o.method, o.event_id, coalesce(n, 0) AS n, (x IS NOT NULL)::INTEGER + (y IS NOT NULL)::INTEGER AS h FROM {BO} o LEFT JOIN f USING (series_id, event_id) LEFT JOIN s USING (series_id, event_id) LEFT JOIN n USING (series_id, event_id)),
q AS (SELECT *, CASE WHEN n > 0 THEN h / n::DOUBLE ELSE 0.0::DOUBLE END AS p, h / 2.0::DOUBLE AS r FROM h)
SELECT series_id, method, event_id, round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) + 0.0 AS f1, h AS n_tp, n - h AS n_fp FROM q""")
def _(spark, sf):
    a = alarm_rows(spark, sf)
    return rounded(e.tolerance_f1(a.where("alarm").select("series_id", "method", "t"), e.event_bounds(a, p.events_dim(spark))))


@query("e15_auc_pr", f"""WITH m AS (SELECT series_id, method, event_id, quantile_cont(score, 0.5) AS med, count(*) FILTER (inside) AS pos, count(*) AS al FROM {CELLS} GROUP BY ALL),
g AS (SELECT series_id, method, event_id, coalesce(score, med) AS s, pos, count(*) FILTER (inside) AS tp, count(*) AS k FROM {CELLS} JOIN m USING (series_id, method, event_id) WHERE pos > 0 AND pos < al AND med IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER w / sum(k) OVER w AS p, sum(tp) OVER w / pos AS r FROM g WINDOW w AS (PARTITION BY series_id, method, event_id ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT series_id, method, event_id, (r - coalesce(lag(r) OVER w, 0)) * (p + coalesce(lag(p) OVER w, 1)) / 2 AS a FROM c WINDOW w AS (PARTITION BY series_id, method, event_id ORDER BY s DESC))
SELECT series_id, method, event_id, round(sum(a), 6) + 0.0 AS auc_pr FROM a GROUP BY ALL""")
def _(spark, sf):
    return rounded(e.auc_pr(kept_scores(spark, sf), p.events_dim(spark)))


ET = f"(SELECT *, coalesce(score > CASE WHEN t >= 60 THEN round(quantile_cont(score, 0.95) OVER g, 9) END, false) AS raw FROM {SC} WINDOW g AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query("e17_lead_time", f"""WITH i AS (SELECT *, t - sum(raw::INTEGER) OVER (PARTITION BY series_id ORDER BY t) AS isle FROM {ET}), a AS MATERIALIZED (SELECT series_id, t, raw AND count(*) OVER (PARTITION BY series_id, raw, isle) >= 3 AS alarm FROM i),
s AS (SELECT series_id, event_id, min(t) AS t0 FROM {W} w JOIN {EVENTS_SQL} e ON w.ts >= e.start GROUP BY ALL), j AS (SELECT a.*, event_id, t0, alarm AND NOT coalesce(lag(alarm) OVER (PARTITION BY a.series_id, event_id ORDER BY t), false) AS onset FROM a JOIN s USING (series_id) WHERE t >= t0 - 252 AND t < t0)
SELECT series_id, event_id, max(t0) - min(t) FILTER (alarm) AS lead_time, sum(onset::INTEGER)::BIGINT AS episodes FROM j GROUP BY ALL""")
def _(spark, sf):
    from tidewatch.operators.joins import lower_bound

    from .detectors import vol_scores

    a = alarms.expanding_threshold(vol_scores(spark, sf), "score").withColumn("threshold", F.round("threshold", 9))
    return e.lead_time(alarms.exceeds(a, "score"), lower_bound(p.weekly(spark, sf), p.events_dim(spark)))


@query("e20_signed_rank", f"""SELECT series_id, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY abs(d)) + (count(*) OVER (PARTITION BY series_id, abs(d)) - 1) / 2.0::DOUBLE AS r FROM (
 SELECT x.series_id, round(x.d - y.d, 6) AS d FROM {D_SQL} x JOIN {D_SQL} y ON x.series_id = y.series_id AND x.event_id = y.event_id AND x.method = 'rolling_vol' AND y.method = 'level') WHERE d <> 0) GROUP BY 1""")
def _(spark, sf):
    d = effects(spark, sf)
    a = d.where("method = 'rolling_vol'").select("series_id", "event_id", F.col("d").alias("x"))
    b = d.where("method = 'level'").select("series_id", "event_id", F.col("d").alias("y"))
    j = a.join(b, ["series_id", "event_id"]).select("series_id", F.round(F.col("x") - F.col("y"), 6).alias("x"), F.lit(0.0).alias("y"))
    return e.signed_rank(j, "x", "y", ["series_id"])


WIDE = f"(SELECT series_id, t, max(score) FILTER (method = 'rolling_vol') AS a, max(score) FILTER (method = 'momentum') AS b, max(score) FILTER (method = 'level') AS c FROM {SCORES} GROUP BY ALL)"


def wide(spark, sf):
    s = panel_scores(spark, sf).groupBy("series_id", "t").pivot("method", list(METHODS)).agg(F.max("score"))
    return s.select("series_id", "t", F.col("rolling_vol").alias("a"), F.col("momentum").alias("b"), F.col("level").alias("c"))


@query("e22_partial_correlation", f"SELECT series_id, round((xy - xz * yz) / sqrt((1 - xz ** 2) * (1 - yz ** 2)), 6) + 0.0 AS partial FROM (SELECT series_id, corr(a, b) AS xy, corr(a, c) AS xz, corr(b, c) AS yz FROM {WIDE} WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1)")
def _(spark, sf):
    return rounded(e.partial_correlation(wide(spark, sf), "a", "b", "c", ["series_id"]))


@query("e22_spearman", f"SELECT series_id, round(corr(ra, rb), 6) + 0.0 AS rho FROM (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY a) + (count(*) OVER (PARTITION BY series_id, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY series_id ORDER BY b) + (count(*) OVER (PARTITION BY series_id, b) - 1) / 2.0::DOUBLE AS rb FROM {WIDE} WHERE a IS NOT NULL AND b IS NOT NULL) GROUP BY 1")
def _(spark, sf):
    return rounded(e.spearman(wide(spark, sf), "a", "b", ["series_id"]))


@query("e22_mcnemar", f"""SELECT series_id, b10, b01, round(CASE WHEN b10 + b01 > 0 THEN greatest(abs(b10 - b01) - 1, 0) ** 2 / (b10 + b01)::DOUBLE END, 6) AS statistic FROM (SELECT series_id, count(*) FILTER ((a > 1.5) = y AND (b > 1.5) <> y) AS b10, count(*) FILTER ((a > 1.5) <> y AND (b > 1.5) = y) AS b01 FROM (
 SELECT w.*, EXISTS (SELECT 1 FROM {EVENTS_SQL} e WHERE p.ts BETWEEN e.start AND e.stop) AS y FROM {WIDE} w JOIN {W} p USING (series_id, t) WHERE a IS NOT NULL AND b IS NOT NULL) GROUP BY 1)""")
def _(spark, sf):
    from tidewatch.operators.joins import union_label

    w = wide(spark, sf).where("a is not null and b is not null").join(union_label(p.weekly(spark, sf), p.events_dim(spark)).select("series_id", "t", "inside"), ["series_id", "t"])
    m = e.mcnemar(w.withColumn("fa", F.col("a") > 1.5).withColumn("fb", F.col("b") > 1.5), "fa", "fb", "inside", ["series_id"])
    return rounded(m.drop("p"))


@query("e24_calibration", f"""SELECT series_id, bin, round(predicted, 6) + 0.0 AS predicted, round(observed, 6) + 0.0 AS observed, n, round(abs(predicted - observed) * n / sum(n) OVER (PARTITION BY series_id), 6) + 0.0 AS ece_part FROM (
 SELECT series_id, least(floor(p * 10), 9)::INTEGER AS bin, avg(p) AS predicted, avg(y::INTEGER) AS observed, count(*) AS n FROM (SELECT w.series_id, round(1 / (1 + exp(-a)), 6) AS p, EXISTS (SELECT 1 FROM {EVENTS_SQL} e WHERE q.ts BETWEEN e.start AND e.stop) AS y FROM {WIDE} w JOIN {W} q USING (series_id, t) WHERE a IS NOT NULL) GROUP BY ALL)""")
def _(spark, sf):
    from tidewatch.operators.joins import union_label

    w = wide(spark, sf).where("a is not null").join(union_label(p.weekly(spark, sf), p.events_dim(spark)).select("series_id", "t", "inside"), ["series_id", "t"])
    w = w.withColumn("p", F.round(1 / (1 + F.exp(-F.col("a"))), 6)).withColumn("y", F.col("inside").cast("int"))
    return rounded(e.calibration(w, "p", "y", ["series_id"]))


@query("e27_score_faults", f"""SELECT series_id, method, count(*) AS n, 'out_of_bounds' AS issue FROM {SCORES} WHERE abs(score) > 3 GROUP BY ALL UNION ALL SELECT series_id, method, count(*) - count(score), 'null_density' FROM {SCORES} GROUP BY 1, 2 HAVING count(score) < 0.5 * count(*)
UNION ALL SELECT series_id, method, count(score), 'constant' FROM {SCORES} GROUP BY 1, 2 HAVING count(score) > 1 AND stddev_samp(score) <= 1e-12 UNION ALL SELECT series_id, min(method), count(*), 'identical' FROM (SELECT series_id, event_id, method, round(d, 6) AS d FROM {D_SQL}) WHERE d IS NOT NULL GROUP BY series_id, event_id, d HAVING count(*) > 1""")
def _(spark, sf):
    return e.score_faults(panel_scores(spark, sf), effects(spark, sf).withColumn("d", F.round("d", 6)), limit=3.0)


@query("e28_claims", f"SELECT method || '/' || series_id AS key, 0.3::DOUBLE AS expected, round(avg(d), 6) AS value, coalesce(abs(0.3 - round(avg(d), 6)) <= 0.1, false) AS ok FROM {D_SQL} GROUP BY method, series_id")
def _(spark, sf):
    stored = effects(spark, sf).groupBy("method", "series_id").agg(F.round(F.avg("d"), 6).alias("value")).select(F.concat_ws("/", "method", "series_id").alias("key"), "value")
    return e.claims_check(stored, stored.select("key", F.lit(0.3).alias("expected")), 0.1)


def rows_only(name, f):
    query(name)(lambda spark, sf: rounded(f(spark, sf)))


rows_only("e7_welch_p", lambda s, d: e.welch_t(moments(s, d)).select("series_id", "method", "event_id", "t", "df", "p"))
rows_only("e8_adjusted_welch", lambda s, d: e.benjamini_hochberg(e.holm(e.welch_t(moments(s, d)).where("p is not null").select("series_id", "method", "event_id", "p"), "p", ["series_id"]), "p", ["series_id"]))


@query("e18_comparison_grid", f"""WITH z AS (SELECT series_id, event_id, min(t) AS t0 FROM {W} w JOIN {EVENTS_SQL} v ON w.ts >= v.start GROUP BY ALL)
SELECT m.series_id, m.method, m.event_id, m.n1, m.n2, round(m1, 6) + 0.0 AS m1, round(v1, 6) + 0.0 AS v1, round(m2, 6) + 0.0 AS m2, round(v2, 6) + 0.0 AS v2, round(CASE WHEN z.t0 IS NOT NULL AND z.t0 < 100 THEN NULL ELSE d END, 6) + 0.0 AS d, coalesce(z.t0 < 100, false) AS skipped
FROM {D_SQL} m LEFT JOIN z ON z.series_id = m.series_id AND z.event_id = m.event_id""")
def _(spark, sf):
    return rounded(e.study(panel_scores(spark, sf), p.events_dim(spark)))


def f1_sql(tol):
    """f1 of every cell at one tolerance."""
    return f"""(WITH j AS MATERIALIZED (SELECT * FROM {AL} JOIN {BO} USING (series_id, method, event_id)),
f AS (SELECT series_id, event_id, arg_min(t, (abs(t - a), t)) AS x FROM j WHERE abs(t - a) <= {tol} GROUP BY ALL), s AS (SELECT j.series_id, j.event_id, arg_min(j.t, (abs(j.t - j.b), j.t)) AS y FROM j LEFT JOIN f USING (series_id, event_id) WHERE abs(j.t - j.b) <= {tol} AND (x IS NULL OR j.t <> x) GROUP BY ALL),
n AS (SELECT series_id, event_id, count(*) AS n FROM j GROUP BY ALL), h AS (SELECT o.series_id, o.method, o.event_id, coalesce(n, 0) AS n, (x IS NOT NULL)::INTEGER + (y IS NOT NULL)::INTEGER AS h FROM {BO} o LEFT JOIN f USING (series_id, event_id) LEFT JOIN s USING (series_id, event_id) LEFT JOIN n USING (series_id, event_id)),
q AS (SELECT *, CASE WHEN n > 0 THEN h / n::DOUBLE ELSE 0.0::DOUBLE END AS p, h / 2.0::DOUBLE AS r FROM h) SELECT series_id, method, event_id, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1_{tol} FROM q)"""


# the other cells' ways of counting: here every row meets every event and curves are summed over all thresholds
AUC_SQL = f"""(WITH c AS MATERIALIZED (SELECT series_id, method, event_id, score, inside FROM {AC}), m AS (SELECT series_id, method, event_id, quantile_cont(score, 0.5) AS med, count(*) FILTER (inside) AS pos, count(*) AS al FROM c GROUP BY ALL),
g AS (SELECT series_id, method, event_id, coalesce(score, med) AS s, pos, count(*) FILTER (inside) AS tp, count(*) AS k FROM c JOIN m USING (series_id, method, event_id) WHERE pos > 0 AND pos < al AND med IS NOT NULL GROUP BY ALL),
k AS (SELECT *, sum(tp) OVER w / sum(k) OVER w AS p, sum(tp) OVER w / pos AS r FROM g WINDOW w AS (PARTITION BY series_id, method, event_id ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT series_id, method, event_id, (r - coalesce(lag(r) OVER w, 0)) * (p + coalesce(lag(p) OVER w, 1)) / 2 AS a FROM k WINDOW w AS (PARTITION BY series_id, method, event_id ORDER BY s DESC))
SELECT series_id, method, event_id, sum(a) AS auc_pr FROM a GROUP BY ALL)"""
POINT_SQL = f"""(SELECT series_id, method, event_id, min(t) FILTER (alarm AND inside) - min(t) FILTER (inside) AS delay, CASE WHEN count(*) FILTER (NOT inside) > 0 THEN count(*) FILTER (alarm AND NOT inside) / (count(*) FILTER (NOT inside))::DOUBLE * 252 ELSE 0.0::DOUBLE END AS far FROM {AC} GROUP BY ALL)"""
ENHANCED = f"(SELECT * FROM {f1_sql(5)} JOIN {f1_sql(10)} USING (series_id, method, event_id) JOIN {f1_sql(30)} USING (series_id, method, event_id) LEFT JOIN {AUC_SQL} USING (series_id, method, event_id) JOIN {POINT_SQL} USING (series_id, method, event_id))"
FIVE = ("f1_5", "f1_10", "f1_30", "auc_pr", "far")


@query("e19_enhanced_metrics", rounded_sql("series_id, method, event_id, delay", ", ".join(FIVE), ENHANCED))
def _(spark, sf):
    return rounded(e.enhanced_metrics(alarm_rows(spark, sf), p.events_dim(spark)))


@query("e19_metric_summary", "SELECT method, count(*) AS n_cells, " + ", ".join(f"round(avg({c}), 6) + 0.0 AS mean_{c}, round(quantile_cont({c}::DOUBLE, 0.5), 6) + 0.0 AS median_{c}" for c in (*FIVE, "delay")) + f" FROM {ENHANCED} GROUP BY 1")
def _(spark, sf):
    return rounded(e.metric_summary(e.enhanced_metrics(alarm_rows(spark, sf), p.events_dim(spark)), [*FIVE, "delay"]))
