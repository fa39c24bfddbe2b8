"""Queries of null windows, nested logistic models, survival, the copula score, sliced distances, transitions across scales and mixed states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions.stats import normal_quantile_sql
from tidewatch.functions.windows import expanding_z_sql, last_n, ordered
from tidewatch.operators import detectors, fusion, resample, topology
from tidewatch.operators import evaluate as e
from tidewatch.operators import geometry as g
from tidewatch.operators import inference as i
from tidewatch.operators.joins import lower_bound, union_label
from tidewatch.sources import panels as p
from tidewatch.sources.panels import EVENTS_SQL
from tidewatch.sources.results import kept_table

from .evaluation import CELLS, D_SQL, METHODS, POOLED, SCORES, effects, kept_scores, panel_scores, wide
from .features import RET, W, returns, roll, std, vectors
from .geometry import curvature, embedded
from .registry import query, rounded, rounded_sql

# null windows: in SQL every placed window is met with the rows inside it

REPS = 300
SPANS = f"(SELECT series_id, event_id, min(t) AS a, max(t) + 1 AS b FROM {W} w JOIN {EVENTS_SQL} e ON w.ts BETWEEN e.start AND e.stop GROUP BY ALL)"
ROWS = f"(SELECT series_id, max(t) + 1 AS n FROM {W} GROUP BY 1)"


def shifted_sql(reps):
    draw = i.drawn_sql("3", "rep", "series_id")
    return f"""(WITH o AS (SELECT *, least_ + {draw} % greatest(n - least_, 1) AS off FROM (SELECT *, max(b - a) OVER (PARTITION BY series_id) AS least_ FROM {SPANS}) JOIN {ROWS} USING (series_id), (SELECT unnest(range(1, {reps + 1})) AS rep)),
q AS (SELECT series_id, rep, event_id, n, (a + off) % n AS x, (a + off) % n + b - a AS y FROM o)
SELECT series_id, rep, event_id, x AS a, least(y, n) AS b FROM q UNION ALL SELECT series_id, rep, event_id, 0, y - n FROM q WHERE y > n)"""


def placed_sql(reps):
    turn, cut = (i.drawn_sql("5", "rep", "series_id", "event_id", f"'{x}'") for x in ("turn", "cut"))
    return f"""(WITH o AS (SELECT *, b - a AS len, sum(b - a) OVER (PARTITION BY series_id) AS total FROM {SPANS} JOIN {ROWS} USING (series_id), (SELECT unnest(range(1, {reps + 1})) AS rep)),
c AS (SELECT o.*, {cut} % (n - total // {reps} + 1) AS cut, {turn} AS turn FROM o),
k AS (SELECT *, row_number() OVER u AS k, sum(len) OVER u - len AS before, list(cut) OVER (PARTITION BY series_id, rep) AS cuts FROM c WINDOW u AS (PARTITION BY series_id, rep ORDER BY turn, event_id ROWS UNBOUNDED PRECEDING))
SELECT series_id, rep, event_id, (list_sort(cuts)[k] + before)::BIGINT AS a, (list_sort(cuts)[k] + before + len)::BIGINT AS b FROM k)"""


def effects_sql(windows, ids):
    return f"""(WITH s AS MATERIALIZED (SELECT series_id, method, t, score FROM {SCORES}), w AS MATERIALIZED (SELECT * FROM {windows}),
x AS (SELECT s.series_id, s.method, {ids}, count(score) AS n1, sum(score) AS s1, sum(score * score) AS q1 FROM w JOIN s ON s.series_id = w.series_id AND s.t >= w.a AND s.t < w.b GROUP BY ALL),
y AS (SELECT series_id, method, count(score) AS n, sum(score) AS s, sum(score * score) AS q FROM s GROUP BY ALL),
m AS (SELECT series_id, method, {ids}, n1, n - n1 AS n2, s1 / n1 AS m1, (s - s1) / (n - n1) AS m2, (q1 - s1 * s1 / n1) / (n1 - 1) AS v1, (q - q1 - (s - s1) ** 2 / (n - n1)) / (n - n1 - 1) AS v2 FROM x JOIN y USING (series_id, method))
SELECT series_id, method, {ids}, CASE WHEN n1 >= 2 AND n2 >= 2 THEN abs(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) END AS d FROM m)"""


NULLS = f"""(SELECT series_id, method, kind, rep, round(quantile_cont(coalesce(d, 0), 0.5), 9) AS d FROM (
  SELECT *, 'random_windows' AS kind FROM {effects_sql(placed_sql(REPS), 'rep, event_id')} UNION ALL SELECT *, 'circular_shift' FROM {effects_sql(shifted_sql(REPS), 'rep, event_id')}) GROUP BY ALL)"""
REAL = f"(SELECT series_id, method, quantile_cont(coalesce(d, 0), 0.5) AS real_median FROM {effects_sql(SPANS, 'event_id')} GROUP BY ALL)"


@query("e21_null_windows", f"""SELECT series_id, method, kind, round(max(real_median), 5) AS real_median, round(quantile_cont(d, 0.5), 5) AS null_median, round(quantile_cont(d, 0.025), 5) AS q025, round(quantile_cont(d, 0.975), 5) AS q975, round(avg((d >= round(real_median, 9))::INTEGER), 5) AS p
FROM {NULLS} JOIN {REAL} USING (series_id, method) GROUP BY ALL""")
def _(spark, sf):
    return rounded(i.null_windows(kept_scores(spark, sf), p.events_dim(spark), REPS, kept_table(spark)), 5)


@query("e21_circular_shift", f"""SELECT series_id, method, event_id, round(max(s.d), 5) AS d, round((sum(coalesce((round(n.d, 9) >= round(s.d, 9))::INTEGER, 0)) + 1) / 201, 5) AS p
FROM {effects_sql(SPANS, 'event_id')} s JOIN {effects_sql(shifted_sql(200), 'rep, event_id')} n USING (series_id, method, event_id) GROUP BY ALL""")
def _(spark, sf):
    return rounded(i.circular_shift_null(kept_scores(spark, sf), p.events_dim(spark), 200), 5)


@query("e22_likelihood_ratio")
def _(spark, sf):
    """Does momentum tell event weeks beyond volatility, and the other way round?"""
    y = union_label(p.weekly(spark, sf), p.events_dim(spark)).select("series_id", "t", "inside")
    both = wide(spark, sf).join(y, ["series_id", "t"])
    return rounded(i.likelihood_ratio(both, "a", "b", "inside", ["series_id"], kept_table(spark)))


BACK = f"""(WITH z AS (SELECT series_id, event_id, min(t) AS t0 FROM {W} w JOIN {EVENTS_SQL} v ON w.ts >= v.start GROUP BY ALL), s AS (SELECT *, CASE WHEN score IS NOT NULL AND count(score) OVER w >= 10 THEN (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-8) END AS z FROM {SCORES} WINDOW w AS (PARTITION BY series_id, method ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT s.series_id, s.method, z.event_id, s.t, t0 - s.t AS tte, s.z FROM s JOIN z ON s.series_id = z.series_id AND s.t < t0 AND s.t >= t0 - least(252, t0 - 60) AND least(252, t0 - 60) >= 30)"""


@query("e23_survival", f"SELECT method, count(*) AS n, round(corr(z, -ln(tte + 1)), 6) + 0.0 AS beta FROM {BACK} WHERE z IS NOT NULL GROUP BY 1 HAVING count(*) >= 30")
def _(spark, sf):
    return rounded(i.survival_association(i.times_to_events(panel_scores(spark, sf), p.events_dim(spark)))).drop("p")


query("e23_survival_p")(lambda spark, sf: rounded(i.survival_association(i.times_to_events(panel_scores(spark, sf), p.events_dim(spark)))))


@query("e23_kaplan_meier", f"""WITH RECURSIVE s AS (SELECT series_id, method, t, coalesce(score > 1, false) AS alarm FROM {SCORES}), o AS (SELECT series_id, method, t FROM (SELECT *, alarm AND NOT coalesce(lag(alarm) OVER (PARTITION BY series_id, method ORDER BY t), false) AS hit FROM s) WHERE hit),
z AS (SELECT series_id, event_id, min(t) AS t0 FROM {W} w JOIN {EVENTS_SQL} v ON w.ts >= v.start GROUP BY ALL), e AS (SELECT series_id, max(t) AS last FROM {W} GROUP BY 1),
d AS (SELECT o.method, coalesce(min(t0), max(last)) - o.t AS time, min(t0) IS NOT NULL AS seen FROM o JOIN e USING (series_id) LEFT JOIN z ON z.series_id = o.series_id AND t0 > o.t GROUP BY o.series_id, o.method, o.t),
r AS (SELECT *, sum(n) OVER (PARTITION BY method ORDER BY time DESC) AS at_risk FROM (SELECT method, time, count(*) AS n, count(*) FILTER (seen) AS events FROM d GROUP BY method, time)), v AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY time) AS k FROM r WHERE events > 0),
km AS (SELECT method, k, time, at_risk, events, 1 - events / at_risk::DOUBLE AS survival FROM v WHERE k = 1 UNION ALL SELECT v.method, v.k, v.time, v.at_risk, v.events, km.survival * (1 - v.events / v.at_risk::DOUBLE) FROM km JOIN v ON v.method = km.method AND v.k = km.k + 1)
SELECT method, time, at_risk::BIGINT AS at_risk, events, round(survival, 6) + 0.0 AS survival FROM km""")
def _(spark, sf):
    s = panel_scores(spark, sf)
    starts = lower_bound(p.weekly(spark, sf).select("series_id", "ts", "t"), p.events_dim(spark)).where("t0 is not null").select("series_id", "event_id", "t0")
    d = i.alarm_durations(s.withColumn("alarm", F.coalesce(F.col("score") > 1, F.lit(False))), starts)
    return rounded(i.kaplan_meier(d, ["method"]))


# the copula score of three channels: the quadratic form of a three by three correlation in closed form

UU = f"(SELECT x.series_id, x.ts, x.t, x.method, CASE WHEN x.t >= 60 AND x.score IS NOT NULL AND count(y.score) >= 10 THEN least(greatest(sum((y.score <= x.score)::INTEGER)::DOUBLE / count(y.score), 1e-6::DOUBLE), 0.999999::DOUBLE) END AS u FROM {SCORES} x LEFT JOIN {SCORES} y ON x.series_id = y.series_id AND x.method = y.method AND y.t < x.t GROUP BY x.series_id, x.ts, x.t, x.method, x.score)"
GG = "(SELECT series_id, ts, t, " + ", ".join(f"max({normal_quantile_sql('u')}) FILTER (method = '{m}') AS {c}" for m, c in zip(METHODS, "abc")) + f" FROM {UU} GROUP BY ALL)"
CO = "CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN"
COPULA = f"""(SELECT series_id, ts, t, CASE WHEN t < 120 OR n < 30 THEN NULL WHEN a IS NULL OR b IS NULL OR c IS NULL THEN list_avg(list_filter([a, b, c], lambda v: v IS NOT NULL))
 ELSE (a * a * (1 - rbc ** 2) + b * b * (1 - rac ** 2) + c * c * (1 - rab ** 2) + 2 * a * b * (rac * rbc - rab) + 2 * a * c * (rab * rbc - rac) + 2 * b * c * (rab * rac - rbc)) / (1 + 2 * rab * rac * rbc - rab ** 2 - rac ** 2 - rbc ** 2) END AS copula
 FROM (SELECT series_id, ts, t, a, b, c, count({CO} 1 END) OVER p AS n, """ + ", ".join(f"0.9::DOUBLE * corr({CO} {x} END, {CO} {y} END) OVER p AS r{x}{y}" for x, y in ("ab", "ac", "bc")) + f""" FROM {GG} WINDOW p AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


@query("f10_gaussian_copula", rounded_sql("series_id, t", "copula, score", expanding_z_sql(COPULA, "copula", 1, 60), 5))
def _(spark, sf):
    out = fusion.gaussian_copula(panel_scores(spark, sf), list(METHODS))
    return rounded(out.select("series_id", "t", "copula", "score"), 5)


RAYS = detectors.directions(20, 2)
LAGS = [f"OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {x} PRECEDING AND {y} PRECEDING)" for x, y in ((30, 1), (40, 11))]
SLICES = " UNION ALL ".join(f"SELECT series_id, ts, t, {k} AS k, ret * {u!r}::DOUBLE + close / 1e6 * {v!r}::DOUBLE AS v FROM {RET}" for k, (u, v) in enumerate(RAYS))
SLICED = f"""(SELECT series_id, ts, t, avg(w) AS distance FROM (SELECT series_id, ts, t, CASE WHEN len(a) = 30 AND len(b) = 30 THEN list_sum(list_transform(list_zip(list_sort(a), list_sort(b)), lambda z: abs(z[1] - z[2]))) / 30 END AS w
 FROM (SELECT series_id, ts, t, list(v) FILTER (v IS NOT NULL) {LAGS[0].replace('series_id ORDER', 'series_id, k ORDER')} AS a, list(v) FILTER (v IS NOT NULL) {LAGS[1].replace('series_id ORDER', 'series_id, k ORDER')} AS b FROM ({SLICES}))) GROUP BY ALL)"""


@query("d14_sliced_wasserstein", rounded_sql("series_id, t", "distance, score", expanding_z_sql(SLICED, "distance", 15, 60, 0, "abs")))
def _(spark, sf):
    x = returns(spark, sf).withColumn("x", F.array("ret", F.col("close") / 1e6))
    return rounded(detectors.sliced_wasserstein(x, lines=RAYS).select("series_id", "t", "distance", "score"))


LONG = (10, 20, 40)
MEANS = " UNION ALL ".join(f"SELECT series_id, {k} AS scale, t, avg(ret) {roll(k)} AS m FROM {RET}" for k in LONG)


@query("t7_scale_transitions", f"""WITH RECURSIVE s AS MATERIALIZED (SELECT series_id, scale, t, abs(m - lag(m) OVER w) AS change FROM (SELECT series_id, scale, t, avg(m) OVER (PARTITION BY series_id, scale ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM ({MEANS})) WINDOW w AS (PARTITION BY series_id, scale ORDER BY t)),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id, scale ORDER BY t) AS k FROM s WHERE change > 0.02),
e(series_id, scale, k, t, last, taken) AS (SELECT series_id, scale, k, t, t, true FROM c WHERE k = 1 UNION ALL SELECT c.series_id, c.scale, c.k, c.t, CASE WHEN c.t >= e.last + 10 THEN c.t ELSE e.last END, c.t >= e.last + 10 FROM e JOIN c ON c.series_id = e.series_id AND c.scale = e.scale AND c.k = e.k + 1),
f AS (SELECT e.series_id, e.scale, e.t, c.change, greatest(e.t - e.scale + 1, 0) AS a, e.t AS b FROM e JOIN c USING (series_id, scale, k) WHERE taken)
SELECT f.series_id, f.scale, f.t, round(f.change, 6) + 0.0 AS change, f.a, f.b, count(h.t) AS confirmations, count(h.t) >= 1 AS confirmed FROM f LEFT JOIN f h ON h.series_id = f.series_id AND (h.t <> f.t OR h.scale <> f.scale) AND h.a <= f.b AND f.a <= h.b GROUP BY ALL""")
def _(spark, sf):
    r = returns(spark, sf)
    by_scale = {k: r.withColumn("m", F.avg("ret").over(last_n(ordered(), k))) for k in LONG}
    return rounded(topology.scale_transitions(by_scale, "m", 0.02))


@query("t7_curvature_transitions")
def _(spark, sf):
    """The same on the geometric table: integrals of curvature over windows of several lengths."""
    c = kept_table(spark)(curvature(spark, sf))
    return rounded(topology.scale_transitions({k: topology.rolling_integral(c, k) for k in (20, 50, 100)}, "chern", 0.001))


query("x16_mixed_states")(lambda spark, sf: rounded(g.mixed_observables(embedded(spark, sf))))


# resampled cells: in SQL every row meets every event, is numbered on its side and drawn one by one

DRAWS = 200
SIDES = f"(SELECT *, row_number() OVER (PARTITION BY series_id, method, event_id, inside ORDER BY t) - 1 AS i, row_number() OVER (PARTITION BY series_id, method, event_id ORDER BY t) AS spot FROM {CELLS} WHERE score IS NOT NULL)"
BOOT = f"""(WITH r AS MATERIALIZED (SELECT * FROM {SIDES}), g AS (SELECT series_id, method, event_id, inside, count(*) AS n, greatest(round(cbrt(count(*))), 1)::BIGINT AS size FROM r GROUP BY ALL), n AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY series_id, method, event_id) = 2),
b AS (SELECT *, unnest(range(0, (n - 1) // size + 1)) AS b FROM (SELECT *, unnest(range(1, {DRAWS + 1})) AS rep FROM n)), k AS (SELECT *, {i.drawn_sql('7', 'rep', 'series_id', 'method', 'event_id', 'inside::INTEGER', 'b')} % n AS x FROM b),
p AS (SELECT series_id, method, event_id, inside, rep, (x + unnest(range(0, least(size, n - b * size)))) % n AS i FROM k),
m AS (SELECT series_id, method, event_id, rep, count(*) FILTER (inside) AS n1, avg(score) FILTER (inside) AS m1, var_samp(score) FILTER (inside) AS v1, count(*) FILTER (NOT inside) AS n2, avg(score) FILTER (NOT inside) AS m2, var_samp(score) FILTER (NOT inside) AS v2 FROM p JOIN r USING (series_id, method, event_id, inside, i) GROUP BY ALL),
d AS (SELECT *, CASE WHEN n1 >= 2 AND n2 >= 2 THEN CASE WHEN {POOLED} < 1e-12 THEN 0.0 ELSE abs(m1 - m2) / {POOLED} END END AS d FROM m)
SELECT series_id, method, event_id, n1, n2, quantile_cont(d, 0.025) AS ci_lo, quantile_cont(d, 0.975) AS ci_hi FROM d GROUP BY ALL)"""


@query("e5_bootstrap_ci", rounded_sql("series_id, method, event_id, n1, n2", "ci_lo, ci_hi", BOOT))
def _(spark, sf):
    return rounded(resample.block_bootstrap(kept_scores(spark, sf), p.events_dim(spark), DRAWS))


ONE = i.drawn_sql("11", "rep", "series_id", "method", "event_id", "j[1]") + " % j[1] + 1"
PLACES = f"list_reduce(list_prepend([]::BIGINT[], list_transform(range(n - n1 + 1, n + 1), lambda v: [v])), lambda have, j: list_append(have, CASE WHEN list_contains(have, {ONE}) THEN j[1] ELSE {ONE} END))"
PERM = f"""(WITH r AS MATERIALIZED (SELECT * FROM {SIDES}), c AS MATERIALIZED (SELECT series_id, method, event_id, count(*) FILTER (inside) AS n1, count(*) AS n, sum(score) AS s, round(abs(avg(score) FILTER (inside) - avg(score) FILTER (NOT inside)), 9) AS seen FROM r GROUP BY ALL HAVING n1 > 0 AND n1 < n),
k AS (SELECT *, unnest(range(1, {DRAWS + 1})) AS rep FROM c), q AS (SELECT series_id, method, event_id, rep, n1, n, s, seen, unnest({PLACES}) AS spot FROM k),
d AS (SELECT series_id, method, event_id, rep, q.n1, q.n, seen, round(abs(sum(score) / q.n1 - (q.s - sum(score)) / (q.n - q.n1)), 9) AS gap FROM q JOIN r USING (series_id, method, event_id, spot) GROUP BY series_id, method, event_id, rep, q.n1, q.n, seen, q.s)
SELECT series_id, method, event_id, n1, n - n1 AS n2, seen, (sum((gap >= seen)::INTEGER) + 1) / {DRAWS + 1}::DOUBLE AS p FROM d GROUP BY ALL)"""


@query("e9_permutation_test", rounded_sql("series_id, method, event_id, n1, n2", "seen, p", PERM))
def _(spark, sf):
    return rounded(resample.permutation_p(kept_scores(spark, sf), p.events_dim(spark), DRAWS))


# bootstraps and sign changes of effects, and recalibration by the other events

EFFECT = f"(SELECT method, series_id || '/' || event_id AS unit, round(d, 6) AS d FROM {D_SQL} WHERE d IS NOT NULL)"


def effect_units(spark, sf):
    return effects(spark, sf).where("d is not null").select("method", F.concat_ws("/", "series_id", "event_id").alias("unit"), F.round("d", 6).alias("d"))


@query("e20_bootstrap_means", f"""WITH r AS (SELECT method, d, row_number() OVER (PARTITION BY method ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM {EFFECT}),
k AS (SELECT method, rep, {i.drawn_sql('42', 'rep', 'method', 'i')} % n AS i FROM r, (SELECT unnest(range(1, 1001)) AS rep) WHERE n >= 3), m AS (SELECT k.method, rep, avg(d) AS m FROM k JOIN r ON r.method = k.method AND r.i = k.i GROUP BY ALL)
SELECT method, n, round(mean, 6) AS mean, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM (SELECT method, max(n) AS n, avg(d) AS mean FROM r GROUP BY 1) JOIN (SELECT method, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM m GROUP BY 1) USING (method)""")
def _(spark, sf):
    return rounded(i.bootstrap_means(effect_units(spark, sf), "d", ["method"], "unit"))


@query("e20_sign_permutation", f"""WITH r AS (SELECT 'rolling_vol-level' AS pair, x.unit, round(x.d - y.d, 6) AS d FROM {EFFECT} x JOIN {EFFECT} y ON x.unit = y.unit AND x.method = 'rolling_vol' AND y.method = 'level'),
m AS (SELECT pair, rep, avg(d * CASE WHEN {i.drawn_sql('17', 'rep', 'pair', 'unit')} % 2 = 0 THEN 1 ELSE -1 END) AS m FROM r, (SELECT unnest(range(1, 1001)) AS rep) GROUP BY ALL), s AS (SELECT pair, count(*) AS n, avg(d) AS mean FROM r GROUP BY 1)
SELECT pair, max(n) AS n, round(max(mean), 6) + 0.0 AS mean, round((sum((round(abs(m), 9) >= round(abs(mean), 9))::INTEGER) + 1) / 1001, 6) AS p FROM m JOIN s USING (pair) GROUP BY 1""")
def _(spark, sf):
    d = effect_units(spark, sf)
    a, b = (d.where(F.col("method") == m).select("unit", F.col("d").alias(c)) for m, c in (("rolling_vol", "x"), ("level", "y")))
    pairs = a.join(b, "unit").select(F.lit("rolling_vol-level").alias("pair"), "unit", F.round(F.col("x") - F.col("y"), 6).alias("d"))
    return rounded(i.sign_permutation(pairs, "d", ["pair"], "unit"))


PRED = f"(SELECT series_id, year(ts) AS fold, round(1 / (1 + exp(-score)), 6) AS p, EXISTS (SELECT 1 FROM {EVENTS_SQL} e WHERE s.ts BETWEEN e.start AND e.stop)::INTEGER AS y FROM {SCORES} s WHERE method = 'rolling_vol' AND score IS NOT NULL)"


@query("e24_held_out_recalibration", f"""WITH r AS (SELECT *, least(floor(p * 10), 9) AS b FROM {PRED}), o AS (SELECT series_id, b, fold, count(*) AS n, sum(y) AS s FROM r GROUP BY ALL),
q AS (SELECT r.*, (SELECT sum(s) / sum(n)::DOUBLE FROM o WHERE o.series_id = r.series_id AND o.b = r.b AND o.fold <> r.fold) AS share FROM r)
SELECT series_id, fold::INTEGER AS fold, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg((coalesce(share, p) - y) ** 2), 6) AS brier_recalibrated FROM q GROUP BY ALL""")
def _(spark, sf):
    """Probabilities of event weeks recalibrated by the other years."""
    s = panel_scores(spark, sf).where("method = 'rolling_vol' and score is not null")
    y = union_label(p.weekly(spark, sf), p.events_dim(spark)).select("series_id", "t", "inside")
    x = s.join(y, ["series_id", "t"]).select("series_id", F.year("ts").alias("fold"), F.round(1 / (1 + F.exp(-F.col("score"))), 6).alias("p"), F.col("inside").cast("int").alias("y"))
    return rounded(i.held_out_recalibration(x, "p", "y", "fold", ["series_id"]))


CUTS = f"(SELECT series_id, method, quantile_cont(score, 0.9) AS cut FROM {SCORES} GROUP BY ALL)"
OVERLAY = f"(SELECT series_id, method, ret, CASE WHEN score > cut THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END * ret AS held FROM {SCORES} s JOIN {CUTS} USING (series_id, method) JOIN {RET} r USING (series_id, t) WHERE score IS NOT NULL AND ret IS NOT NULL)"


@query("e24_utility_ranking", f"""WITH u AS (SELECT series_id, method, round(avg(held) / stddev_samp(held) * sqrt(252), 6) AS utility, round(avg(held) / stddev_samp(held) * sqrt(252) - avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS gain FROM {OVERLAY} GROUP BY ALL HAVING count(*) >= 30),
d AS (SELECT series_id, method, round(avg(d), 6) AS mean_d FROM {D_SQL} GROUP BY ALL)
SELECT series_id, method, utility + 0.0 AS utility, gain + 0.0 AS gain, mean_d + 0.0 AS mean_d, rank() OVER (PARTITION BY series_id ORDER BY utility DESC)::INTEGER AS place_by_utility, rank() OVER (PARTITION BY series_id ORDER BY mean_d DESC)::INTEGER AS place_by_d FROM u JOIN d USING (series_id, method)""")
def _(spark, sf):
    """Do methods that tell events best also time exposure best? Places by overlay and by effect size."""
    from tidewatch.operators.backtest import overlay_utility

    s = kept_scores(spark, sf)
    d = e.cohens_d(e.group_moments(s, p.events_dim(spark))).groupBy("series_id", "method").agg(F.avg("d").alias("mean_d"))
    x = rounded(overlay_utility(s, returns(spark, sf)).join(d, ["series_id", "method"]))
    place = lambda c: F.rank().over(Window.partitionBy("series_id").orderBy(F.col(c).desc()))
    return x.withColumn("place_by_utility", place("utility")).withColumn("place_by_d", place("mean_d"))
