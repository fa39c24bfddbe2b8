"""Queries of score fusion, on three methods' scores of the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.windows import expanding_z_sql
from tidewatch.operators import features as f
from tidewatch.operators import fusion
from tidewatch.operators.joins import union_label
from tidewatch.sources import panels as p
from tidewatch.sources.panels import EVENTS_SQL

from .evaluation import D_SQL, SCORES, effects, panel_scores
from .features import RET, W, returns, roll, std
from .registry import query, rounded, rounded_sql

ROW = "series_id, ts, t"


@query("f7_composites", f"SELECT {ROW}, round(max(score), 6) + 0.0 AS comp_max, round(avg(score), 6) + 0.0 AS comp_mean, round(sqrt(avg(score * score)), 6) + 0.0 AS comp_rms FROM {SCORES} GROUP BY ALL")
def _(spark, sf):
    return rounded(fusion.composite(panel_scores(spark, sf)))


# every row beside its past: k valid values so far, and the share of them that are not greater
SEEN = f"(SELECT a.series_id, a.ts, a.t, a.method, a.score, count(b.score) AS k, sum((b.score <= a.score)::INTEGER)::DOUBLE / nullif(count(b.score), 0) AS share FROM {SCORES} a JOIN {SCORES} b ON a.series_id = b.series_id AND a.method = b.method AND b.t <= a.t GROUP BY ALL)"
PCT = f"(SELECT series_id, ts, t, method, CASE WHEN t >= 60 THEN CASE WHEN k < 10 THEN 0.5 WHEN score IS NOT NULL THEN share END END AS pct FROM {SEEN})"
PCT1 = f"(SELECT series_id, ts, t, method, CASE WHEN t >= 60 AND k >= 10 AND score IS NOT NULL THEN share END AS pct FROM {SEEN})"
ALLROWS = f"(SELECT DISTINCT {ROW} FROM {SCORES})"


@query("f1_rank_fusion", rounded_sql("series_id, t", "score", expanding_z_sql(f"(SELECT {ROW}, fused FROM {ALLROWS} LEFT JOIN (SELECT series_id, t, avg(pct) AS fused FROM {PCT} GROUP BY ALL) USING (series_id, t))", "fused", 10, 60)))
def _(spark, sf):
    return rounded(fusion.rank_fusion(panel_scores(spark, sf)).select("series_id", "t", "score"))


FAM = {"rolling_vol": "risk", "momentum": "risk", "level": "trend"}
FAMILY = f"(SELECT series_id, ts, t, CASE WHEN method = 'level' THEN 'trend' ELSE 'risk' END AS family, round(avg(pct), 9) AS fam FROM {PCT1} GROUP BY ALL)"
PCT2 = f"(SELECT a.series_id, a.t, CASE WHEN a.t >= 60 AND count(b.fam) >= 10 AND a.fam IS NOT NULL THEN sum((b.fam <= a.fam)::INTEGER)::DOUBLE / count(b.fam) END AS pct2 FROM {FAMILY} a JOIN {FAMILY} b ON a.series_id = b.series_id AND a.family = b.family AND b.t <= a.t GROUP BY a.series_id, a.t, a.family, a.fam)"


@query("f4_hierarchical", rounded_sql("series_id, t", "score", expanding_z_sql(f"(SELECT {ROW}, fused FROM {ALLROWS} LEFT JOIN (SELECT series_id, t, avg(pct2) AS fused FROM {PCT2} GROUP BY ALL) USING (series_id, t))", "fused", 10, 60)))
def _(spark, sf):
    return rounded(fusion.hierarchical(panel_scores(spark, sf), FAM).select("series_id", "t", "score"))


DS = f"""(WITH x AS (SELECT s.*, g.target, CASE WHEN s.score IS NOT NULL AND g.target IS NOT NULL THEN s.score END AS a, CASE WHEN s.score IS NOT NULL AND g.target IS NOT NULL THEN g.target END AS b FROM {SCORES} s LEFT JOIN (SELECT series_id, t, {std('ret', 20)} AS target FROM {RET}) g USING (series_id, t)),
w AS (SELECT *, CASE WHEN count(a) OVER v < 10 THEN 1.0::DOUBLE / 3 ELSE greatest(coalesce(CASE WHEN isnan(corr(a, b) OVER v) THEN NULL ELSE corr(a, b) OVER v END, 0), 0) END AS w FROM x WINDOW v AS (PARTITION BY series_id, method ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY series_id, t) < 1e-12 THEN 1.0::DOUBLE / 3 ELSE w / sum(w) OVER (PARTITION BY series_id, t) END AS nw FROM w)
SELECT {ROW}, CASE WHEN t >= 60 THEN sum(nw * coalesce(score, 0)) END AS fused FROM n GROUP BY series_id, ts, t)"""


@query("f3_dynamic_switching", rounded_sql("series_id, t", "score", expanding_z_sql(DS, "fused", 10, 60), 5))
def _(spark, sf):
    target = returns(spark, sf).select("series_id", "t", f.rolling_std("ret", 20).alias("target"))
    return rounded(fusion.dynamic_switching(panel_scores(spark, sf), target).select("series_id", "t", "score"), 5)


@query("f8_softmax_attention", f"SELECT {ROW}, round(sum(exp(abs(score)) * score) / sum(exp(abs(score))), 6) + 0.0 AS attention FROM {SCORES} WHERE score IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return rounded(fusion.softmax_attention(panel_scores(spark, sf)))


@query("f9_votes", f"SELECT {ROW}, round(avg((score > 1.5)::DOUBLE), 6) AS share FROM {SCORES} WHERE score IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return rounded(fusion.votes(panel_scores(spark, sf)))


@query("f9_borda", f"""SELECT {ROW}, round(avg((score > 0)::DOUBLE), 6) AS positive, round(sum(score / (60 + r)) / sum(1 / (60 + r)), 6) + 0.0 AS reciprocal FROM (SELECT *, rank() OVER (PARTITION BY series_id, t ORDER BY score DESC) + (count(*) OVER (PARTITION BY series_id, t, score) - 1) / 2.0::DOUBLE AS r FROM {SCORES} WHERE score IS NOT NULL) GROUP BY ALL""")
def _(spark, sf):
    return rounded(fusion.borda(panel_scores(spark, sf)))


Y = f"(SELECT series_id, t, EXISTS (SELECT 1 FROM {EVENTS_SQL} e WHERE w.ts BETWEEN e.start AND e.stop) AS y FROM {W} w)"


@query("f11_exponential_weights", f"""SELECT {ROW}, round(sum(w * score) / sum(w), 6) + 0.0 AS hedge FROM (SELECT *, exp(0.1::DOUBLE * coalesce(sum(hit) OVER (PARTITION BY series_id, method ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS w FROM (SELECT s.*, ((s.score > 1) = y.y)::INTEGER AS hit FROM {SCORES} s JOIN {Y} y USING (series_id, t) WHERE s.score IS NOT NULL)) GROUP BY ALL""")
def _(spark, sf):
    y = union_label(p.weekly(spark, sf), p.events_dim(spark)).select("series_id", "t", F.col("inside").alias("y"))
    return rounded(fusion.exponential_weights(panel_scores(spark, sf), y))


EM = f"(SELECT method, event_id, start, avg(d) AS d FROM {D_SQL} JOIN {EVENTS_SQL} USING (event_id) GROUP BY ALL)"


@query("f13_best_before", f"SELECT event_id, method, round(mean_d, 6) AS mean_d FROM (SELECT e.event_id, b.method, avg(b.d) AS mean_d FROM (SELECT DISTINCT event_id, start FROM {EM}) e JOIN {EM} b ON b.start < e.start GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(mean_d, 9) DESC, method) = 1")
def _(spark, sf):
    c = effects(spark, sf).join(p.events_dim(spark).select("event_id", "start"), "event_id").groupBy("method", "event_id", "start").agg(F.avg("d").alias("d"))
    return rounded(fusion.best_before(c))


# all rows up to half a year around an event, labelled by whether it holds them
PR = f"(SELECT s.method, e.event_id, e.start, 1 / (1 + exp(-s.score)) AS p, (s.ts BETWEEN e.start AND e.stop)::INTEGER::DOUBLE AS y FROM {SCORES} s JOIN {EVENTS_SQL} e ON s.ts BETWEEN e.start - INTERVAL 182 DAY AND e.stop + INTERVAL 182 DAY WHERE s.score IS NOT NULL)"


@query("f12_brier_weights", f"""SELECT event_id, method, round((1 / b) / sum(1 / b) OVER (PARTITION BY event_id), 6) AS weight FROM (SELECT event_id, method, sum(q) OVER w / sum(n) OVER w AS b FROM (SELECT method, event_id, start, sum((p - y) ** 2) AS q, count(*) AS n FROM {PR} GROUP BY ALL) WINDOW w AS (PARTITION BY method ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE b > 0""")
def _(spark, sf):
    from tidewatch.operators.joins import event_members

    s = event_members(panel_scores(spark, sf).where("score is not null"), p.events_dim(spark), 182)
    s = s.select("method", "event_id", "start", (1 / (1 + F.exp(-F.col("score")))).alias("p"), F.col("ts").between(F.col("start"), F.col("stop")).cast("double").alias("y"))
    return rounded(fusion.brier_weights(s))


cell = lambda c: f"CASE WHEN max({c}) OVER g > min({c}) OVER g THEN least(floor(({c} - min({c}) OVER g) / (max({c}) OVER g - min({c}) OVER g) * 20), 19) ELSE 0 END"
MI = f"""WITH x AS (SELECT s.series_id, s.method, s.score, g.target FROM {SCORES} s JOIN (SELECT series_id, t, round({std('ret', 20)}, 9) AS target FROM {RET}) g USING (series_id, t) WHERE s.score IS NOT NULL AND g.target IS NOT NULL),
c AS (SELECT series_id, method, a, b, count(*) AS k FROM (SELECT *, {cell('score')} AS a, {cell('target')} AS b FROM x WINDOW g AS (PARTITION BY series_id, method)) GROUP BY ALL),
h AS (SELECT *, sum(k) OVER (PARTITION BY series_id, method, a) AS ka, sum(k) OVER (PARTITION BY series_id, method, b) AS kb, sum(k) OVER (PARTITION BY series_id, method) AS n FROM c),
m AS (SELECT series_id, method, sum(k::DOUBLE / n * ln(k::DOUBLE * n / (ka::DOUBLE * kb))) AS mi FROM h GROUP BY ALL), e AS (SELECT *, exp(mi / greatest(max(mi) OVER (PARTITION BY series_id), 1e-12)) AS e FROM m)
SELECT series_id, method, round(mi, 6) AS mi, round(e / sum(e) OVER (PARTITION BY series_id), 6) AS weight FROM e"""


@query("f14_mutual_information", MI)
def _(spark, sf):
    target = returns(spark, sf).select("series_id", "t", F.round(f.rolling_std("ret", 20), 9).alias("target"))
    return rounded(fusion.mutual_information_weights(panel_scores(spark, sf), target))


LLR = f"(SELECT series_id, ts, t, coalesce(avg(CASE WHEN k >= 20 AND t >= 60 THEN score / greatest(sd, 1e-8) - 0.5::DOUBLE END), 0) AS llr FROM (SELECT *, count(score) OVER w AS k, stddev_samp(score) OVER w AS sd FROM {SCORES} WINDOW w AS (PARTITION BY series_id, method ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY ALL)"
EVIDENCE = f"""(WITH RECURSIVE l AS MATERIALIZED (SELECT * FROM {LLR}), e(series_id, t, raw, kept) AS (SELECT series_id, t, 0.0::DOUBLE, 0.0::DOUBLE FROM l WHERE t = 0
 UNION ALL SELECT series_id, t, raw, CASE WHEN raw >= 2.995732 OR raw <= -2.995732 THEN 0.0::DOUBLE ELSE raw END FROM (SELECT l.series_id, l.t, CASE WHEN l.t < 60 THEN 0.0::DOUBLE ELSE 0.95::DOUBLE * e.kept + l.llr END AS raw FROM e JOIN l ON l.series_id = e.series_id AND l.t = e.t + 1))
SELECT l.series_id, l.ts, l.t, e.kept AS evidence, e.raw >= 2.995732 AS alarm FROM e JOIN l USING (series_id, t))"""


@query("f6_sequential_evidence", rounded_sql("series_id, t, alarm", "evidence, score", expanding_z_sql(EVIDENCE, "evidence", 1, 60)))
def _(spark, sf):
    return rounded(fusion.evidence_score(panel_scores(spark, sf)).select("series_id", "t", "alarm", "evidence", "score"))


ENS = {"rolling_vol": 2.0, "momentum": 1.0, "level": 0.5}


@query("st7_weighted_ensemble", f"SELECT {ROW}, round(CASE WHEN count(score) >= 0.5 * count(*) THEN sum(w * score) / nullif(sum(w) FILTER (score IS NOT NULL), 0) END, 6) + 0.0 AS ensemble FROM (SELECT *, CASE method WHEN 'rolling_vol' THEN 2.0::DOUBLE WHEN 'momentum' THEN 1.0 ELSE 0.5 END AS w FROM {SCORES}) GROUP BY ALL")
def _(spark, sf):
    return rounded(fusion.weighted_ensemble(panel_scores(spark, sf), ENS))


@query("f15_cluster_fusion")
def _(spark, sf):
    return rounded(fusion.cluster_fusion(panel_scores(spark, sf), 0.8))


# two channels: the first component in closed form
PAIR = f"(SELECT series_id, ts, t, max(score) FILTER (method = 'rolling_vol') AS a, max(score) FILTER (method = 'momentum') AS b FROM {SCORES} WHERE method <> 'level' GROUP BY ALL)"
PCA = f"""WITH m AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AS whole, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END AS mean, CASE WHEN b IS NOT NULL THEN a END AS u, CASE WHEN a IS NOT NULL THEN b END AS v FROM {PAIR}),
w AS (SELECT *, count(u) OVER p AS k, avg(u) OVER p AS ma, avg(v) OVER p AS mb, var_pop(u) OVER p AS va, var_pop(v) OVER p AS vb, covar_pop(u, v) OVER p AS vab FROM m WINDOW p AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (va + vb) / 2 + sqrt(((va - vb) / 2) ** 2 + vab ** 2) - va AS e FROM w)
SELECT series_id, t, round(CASE WHEN whole AND t >= 100 AND k >= 100 THEN abs((a - ma) * vab + (b - mb) * e) / sqrt(vab ** 2 + e ** 2) ELSE mean END, 7) + 0.0 AS pca FROM l"""


@query("f7_pca_composite", PCA)
def _(spark, sf):
    s = panel_scores(spark, sf).where("method <> 'level'")
    return rounded(fusion.pca_composite(s, ["rolling_vol", "momentum"], 100).select("series_id", "t", "pca"), 7)
