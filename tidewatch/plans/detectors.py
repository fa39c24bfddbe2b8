"""Queries of detectors and alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.windows import expanding_z_sql
from tidewatch.operators import alarms, detectors
from tidewatch.operators import features as f
from tidewatch.sources import panels as p

from .features import D, DRET, EX, RET, S, W, X, returns, roll, std, vectors
from .registry import query, rounded, rounded_sql

KEEP = ("series_id", "t", "score")


def scores(name):
    return lambda spark, sf: rounded(detectors.score_with(returns(spark, sf), name).select(*KEEP))


def z(src, raw, roll_, form="abs", extra=""):
    return rounded_sql("series_id, t", "score", expanding_z_sql(src, raw, roll_, 60, 0, form))


query("d1_rolling_vol", z(f"(SELECT series_id, ts, t, stddev_samp(ret) {roll(20)} AS x FROM {RET})", "x", 1))(scores("rolling_vol"))

CUSUM = f"""WITH b AS (SELECT series_id, avg(ret) AS mu, stddev_samp(ret) AS sd FROM {RET} WHERE t < 60 GROUP BY 1),
z AS (SELECT series_id, t, CASE WHEN sd > 1e-12 THEN (coalesce(ret, mu) - mu) / sd ELSE 0 END AS z FROM {RET} JOIN b USING (series_id)),
c AS (SELECT series_id, t, sum(z - 0.5::DOUBLE) {S}) AS p, sum(-z - 0.5::DOUBLE) {S}) AS q FROM z)
{rounded_sql('series_id, t', f'score=CASE WHEN t >= 60 THEN greatest(p - least(0.0::DOUBLE, min(p) {S})), q - least(0.0::DOUBLE, min(q) {S}))) END', 'c')}"""
query("d2_cusum", CUSUM)(scores("cusum"))

EWMA = f"""(WITH RECURSIVE b AS MATERIALIZED (SELECT series_id, t, coalesce(ret * ret, 0) AS r2 FROM {RET}), v AS (SELECT series_id, var_samp(ret) AS v0 FROM {RET} WHERE t < 60 GROUP BY 1),
e AS (SELECT b.series_id, b.t, 0.94::DOUBLE * v0 + 0.06::DOUBLE * r2 AS s FROM b JOIN v USING (series_id) WHERE t = 0 UNION ALL SELECT b.series_id, b.t, 0.94::DOUBLE * e.s + 0.06::DOUBLE * b.r2 FROM e JOIN b ON b.series_id = e.series_id AND b.t = e.t + 1)
SELECT series_id, t, sqrt(s) AS x FROM e)"""
query("d3_ewma_vol", z(EWMA, "x", 1, "positive"))(scores("ewma_vol"))


@query("d7_dispersion", z(f"(SELECT series_id, t - 19 AS t, sqrt((a * a + b * b) / 2 - ((a + b) / 2) ** 2) AS x FROM (SELECT series_id, t, avg(ret) {roll(20)} AS a, avg(close / 1e6) {roll(20)} AS b FROM (SELECT series_id, t - 1 AS t, ret, close FROM {RET} WHERE ret IS NOT NULL)) WHERE t >= 19)", "x", 10))
def _(spark, sf):
    x = f.enriched(vectors(returns(spark, sf))).select("series_id", "ts", (F.col("t") - 19).alias("t"), F.slice("x", 1, 2).alias("x"))
    return rounded(detectors.dispersion(x).select(*KEEP))


@query("d8_risk_premium", z(f"(SELECT w.series_id, w.t, v.value - w.r AS x FROM (SELECT series_id, ts, t, stddev_samp(ret) {roll(20)} * sqrt(252) * 100 AS r FROM {DRET}) w LEFT JOIN {X} v USING (ts))", "x", 1))
def _(spark, sf):
    return rounded(detectors.risk_premium(returns(spark, sf, p.daily), p.exogenous(spark, sf)).select(*KEEP))


@query("d9_exogenous_level", z(f"(SELECT w.series_id, w.t, v.value FROM {D} w LEFT JOIN {X} v USING (ts))", "value", 5, "positive"))
def _(spark, sf):
    return rounded(detectors.exogenous_level(p.daily(spark, sf), p.exogenous(spark, sf)).select(*KEEP))


RN = f"(SELECT series_id, (row_number() OVER (PARTITION BY series_id ORDER BY t) - 1)::BIGINT AS t, round(ret, 9) AS s, abs(round(ret, 9)) AS y FROM {RET} WHERE ret IS NOT NULL)"
bn = lambda v, lo, hi: f"(CASE WHEN {hi} > {lo} THEN least(floor(({v} - {lo}) / ({hi} - {lo}) * 5), 4) ELSE 0 END)::INTEGER"
TE = f"""(WITH x AS MATERIALIZED (SELECT *, lead(y) {S}) AS nx, min(s) {roll(60)} AS slo, max(s) {roll(60)} AS shi, min(y) {roll(60)} AS ylo, max(y) {roll(60)} AS yhi, count(*) {roll(60)} AS k FROM {RN}),
c AS (SELECT w.series_id, w.t, {bn('r.nx', 'w.ylo', 'w.yhi')} AS n, {bn('r.y', 'w.ylo', 'w.yhi')} AS a, {bn('r.s', 'w.slo', 'w.shi')} AS b FROM x w JOIN x r ON r.series_id = w.series_id AND r.t BETWEEN w.t - 59 AND w.t - 1 WHERE w.k = 60),
g AS (SELECT series_id, t, n, a, b, count(*) AS k FROM c GROUP BY ALL),
h AS (SELECT series_id, t, k, sum(k) OVER (PARTITION BY series_id, t, a, b) AS kab, sum(k) OVER (PARTITION BY series_id, t, n, a) AS kna, sum(k) OVER (PARTITION BY series_id, t, a) AS ka, sum(k) OVER (PARTITION BY series_id, t) AS al FROM g),
e AS (SELECT series_id, t, sum(k::DOUBLE / al * ln(k::DOUBLE * ka / (kab::DOUBLE * kna))) AS te FROM h GROUP BY ALL)
SELECT x.series_id, x.t, e.te FROM x LEFT JOIN e USING (series_id, t))"""


@query("d10_transfer_entropy", z(TE, "te", 5))
def _(spark, sf):
    return rounded(detectors.transfer_entropy(returns(spark, sf).withColumn("ret", F.round("ret", 9))).select(*KEEP))


A, B = (f"OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {x} PRECEDING AND {y} PRECEDING)" for x, y in ((30, 1), (40, 11)))
FR = f"""(SELECT series_id, t, CASE WHEN n1 = 30 AND n2 = 30 AND s1 > 1e-12 AND s2 > 1e-12 THEN sqrt(2) * acosh(1 + ((m1 - m2) ** 2 + 2 * (s1 - s2) ** 2) / (2 * s1 * s2)) END AS x
  FROM (SELECT series_id, t, avg(ret) {A} AS m1, stddev_pop(ret) {A} AS s1, avg(ret) {B} AS m2, stddev_pop(ret) {B} AS s2, count(ret) {A} AS n1, count(ret) {B} AS n2 FROM {RET}))"""
query("d13_fisher_rao", z(FR, "x", 5))(scores("fisher_rao"))
LISTS = f"(SELECT series_id, t, list(ret) FILTER (ret IS NOT NULL) {A} AS a, list(ret) FILTER (ret IS NOT NULL) {B} AS b FROM {RET})"
W1 = f"(SELECT series_id, t, CASE WHEN len(a) = 30 AND len(b) = 30 THEN list_sum(list_transform(list_zip(list_sort(a), list_sort(b)), lambda z: abs(z[1] - z[2]))) / 30 END AS x FROM {LISTS})"
query("d14_wasserstein", z(W1, "x", 5))(scores("wasserstein"))
hist = lambda c: f"list_transform(range(30), lambda i: (len(list_filter({c}, lambda v: least(floor((v - lo) / (hi - lo) * 30), 29) = i)) + 1e-10::DOUBLE) / (30 + 3e-9::DOUBLE))"
JS = f"""(SELECT series_id, t, CASE WHEN ok THEN list_sum(list_transform(list_zip(p, q), lambda z: z[1] * ln(z[1] / ((z[1] + z[2]) / 2)) + z[2] * ln(z[2] / ((z[1] + z[2]) / 2)))) / 2 END AS x FROM (
  SELECT series_id, t, ok, {hist('a')} AS p, {hist('b')} AS q FROM (SELECT series_id, t, a, b, least(list_min(a), list_min(b)) AS lo, greatest(list_max(a), list_max(b)) AS hi, len(a) = 30 AND len(b) = 30 AND greatest(list_max(a), list_max(b)) > least(list_min(a), list_min(b)) AS ok
  FROM (SELECT series_id, t, list(ret) FILTER (ret IS NOT NULL) {A} AS a, list(ret) FILTER (ret IS NOT NULL) {B} AS b FROM (SELECT series_id, t, round(ret, 9) AS ret FROM {RET})))))"""


@query("d15_jensen_shannon", z(JS, "x", 5))
def _(spark, sf):
    return rounded(detectors.score_with(returns(spark, sf).withColumn("ret", F.round("ret", 9)), "jensen_shannon").select(*KEEP))


# alarms on the rolling-vol score, rounded so that comparisons with quantiles agree

SC = f"(SELECT series_id, ts, t, round(score, 9) AS score FROM {expanding_z_sql(f'(SELECT series_id, ts, t, stddev_samp(ret) {roll(20)} AS x FROM {RET})', 'x', 1, 60, 0, 'abs')})"


def vol_scores(spark, sf):
    return detectors.score_with(returns(spark, sf), "rolling_vol").withColumn("score", F.round("score", 9))


def islands(src, flag, n, out, cols):
    return f"(SELECT {cols}, {flag} AND count(*) OVER (PARTITION BY series_id, {flag}, isle_{out}) >= {n} AS {out} FROM (SELECT *, t - sum({flag}::INTEGER) OVER (PARTITION BY series_id ORDER BY t) AS isle_{out} FROM {src}))"


THRESHOLD = f"(SELECT *, CASE WHEN t >= 65 AND count(score) OVER g >= 30 THEN round(quantile_cont(score, 0.95) OVER g, 9) END AS threshold FROM {SC} WINDOW g AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 257 PRECEDING AND 6 PRECEDING))"
RAW = f"(SELECT *, coalesce(score > threshold, false) AS raw FROM {THRESHOLD})"
ALARM = islands(RAW, "raw", 3, "alarm", "series_id, ts, t, score, threshold, raw")


def quantile_alarms(spark, sf):
    return alarms.exceeds(alarms.quantile_threshold(vol_scores(spark, sf), "score").withColumn("threshold", F.round("threshold", 9)), "score")


@query("e1_quantile_alarm", f"SELECT series_id, t, raw, alarm FROM {ALARM}")
def _(spark, sf):
    return quantile_alarms(spark, sf).select("series_id", "t", "raw", "alarm")


VZ = f"""(SELECT * EXCLUDE v, CASE WHEN t >= 60 AND count(v) OVER g >= 10 AND stddev_samp(v) OVER g > 1e-12 THEN (v - avg(v) OVER g) / stddev_samp(v) OVER g END AS velocity_z FROM (
  SELECT *, CASE WHEN t = 0 THEN CASE WHEN sm IS NOT NULL THEN 0.0 END ELSE abs(sm - lag(sm) {S})) END AS v FROM (SELECT *, avg(score) {roll(5)} AS sm FROM {SC})) WINDOW g AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))"""
VA = islands(f"(SELECT *, coalesce(velocity_z > 2, false) AS vraw FROM {VZ})", "vraw", 2, "velocity_alarm", "series_id, t, velocity_z")


@query("e2_velocity_alarm", rounded_sql("series_id, t, velocity_alarm", "velocity_z", VA))
def _(spark, sf):
    return rounded(alarms.velocity_alarm(vol_scores(spark, sf), "score").select("series_id", "t", "velocity_alarm", "velocity_z"))


@query("e2_combined_alarm", f"SELECT series_id, count(*) AS n FROM {ALARM} a JOIN {VA} v USING (series_id, t) WHERE a.alarm OR v.velocity_alarm GROUP BY 1")
def _(spark, sf):
    a = alarms.velocity_alarm(quantile_alarms(spark, sf), "score")
    return a.where("alarm or velocity_alarm").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query("e3_cool_down", f"SELECT series_id, t, max(alarm) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS in_cash FROM {ALARM}")
def _(spark, sf):
    return alarms.cool_down(quantile_alarms(spark, sf), "alarm", 10).select("series_id", "t", "in_cash")


@query("t1_level_indicator", f"""SELECT series_id, t, low, low AND NOT coalesce(lag(low) {S}), false) AS onset FROM (SELECT series_id, t, coalesce(count(ret) {roll(20)} >= 10 AND ret < round(avg(ret) {roll(20)} - 1.5::DOUBLE * stddev_samp(ret) {roll(20)}, 9), false) AS low FROM (SELECT series_id, t, round(ret, 9) AS ret FROM {RET}))""")
def _(spark, sf):
    from tidewatch.operators.topology import level_indicator

    return level_indicator(returns(spark, sf).withColumn("ret", F.round("ret", 9)), "ret", 20, 1.5, below=True, out="low").select("series_id", "t", "low", "onset")
