"""Queries of projections, joins, window features and table sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.windows import expanding_z, expanding_z_sql, fixed_z_sql, forward_fill, ordered, percent_rank_past
from tidewatch.operators import features as f
from tidewatch.operators import joins as j
from tidewatch.sources import panels as p
from tidewatch.sources.panels import EVENTS_SQL, PANEL_SQL

from .registry import query, rounded, rounded_sql

W, D, X, SP = (PANEL_SQL[k] for k in ("weekly", "daily", "exogenous", "sparse"))
S = "OVER (PARTITION BY series_id ORDER BY t"
RET = f"(SELECT *, ln(close / lag(close) {S})) AS ret FROM {W})"
DRET = f"(SELECT *, ln(close / lag(close) {S})) AS ret FROM {D})"


def roll(n):
    return f"{S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def std(x, n):
    return f"CASE WHEN count({x}) {roll(n)} >= {n} THEN stddev_samp({x}) {roll(n)} END"


def returns(spark, sf, panel=p.weekly):
    return f.log_returns(panel(spark, sf))


@query("p1_log_return", rounded_sql("series_id, ts, t", "ret", RET))
def _(spark, sf):
    return rounded(returns(spark, sf).drop("close"))


@query("p2_momentum", rounded_sql("series_id, t", ", ".join(f"mom{k}=close / lag(close, {k}) {S}) - 1" for k in (1, 5, 10, 20, 40, 60)), W))
def _(spark, sf):
    return rounded(p.weekly(spark, sf).select("series_id", "t", *[f.momentum("close", k).alias(f"mom{k}") for k in (1, 5, 10, 20, 40, 60)]))


@query("p4_valid_rows", rounded_sql("series_id, t", "inv", f"(SELECT series_id, t, CASE WHEN isfinite(1.0::DOUBLE / (t % 7)) THEN close / (t % 7) END AS inv FROM {W}) WHERE inv IS NOT NULL"))
def _(spark, sf):
    from tidewatch.functions.windows import finite

    k = (F.col("t") % 7).cast("double")
    return rounded(p.weekly(spark, sf).select("series_id", "t", finite(F.try_divide(F.col("close"), k)).alias("inv")).dropna())


SINGLE = ", ".join(
    [f"vol{n}={std('ret', n)}" for n in (5, 20, 10, 40, 60)]
    + [f"mom{k}=close / lag(close, {k}) {S}) - 1" for k in (5, 20, 10, 40, 60)]
    + ["ret_sq=ret * ret", f"range_20=CASE WHEN count(close) {roll(20)} >= 20 THEN max(close) {roll(20)} / min(close) {roll(20)} - 1 END"]
    + [f"{n}_20=CASE WHEN count(ret) {roll(20)} >= 20 THEN {g}(ret) {roll(20)} END" for n, g in (("skew", "skewness"), ("kurt", "kurtosis"))]
)
COLS = "vol5 vol20 vol10 vol40 vol60 mom5 mom20 mom10 mom40 mom60 ret_sq range_20 skew_20 kurt_20".split()


@query("w2_single_series_features", f"SELECT * FROM ({rounded_sql('series_id, ts, t', 'ret, ' + SINGLE, RET)}) WHERE {' AND '.join(c + ' IS NOT NULL' for c in ['ret', *COLS])}")
def _(spark, sf):
    return rounded(f.single_series_features(p.weekly(spark, sf)))


COMMON = f"(SELECT series_id, ts, close, (row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1)::BIGINT AS t FROM {W} WHERE ts IN (SELECT ts FROM {W} GROUP BY ts HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM {W})))"
CRET = f"(SELECT *, ln(close / lag(close) {S})) AS ret FROM {COMMON})"
P5 = "OVER (PARTITION BY s1, s2 ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
CORR = f"""(SELECT ts, avg(c) AS mean_corr FROM (SELECT ts, CASE WHEN count(CASE WHEN x1 IS NOT NULL AND x2 IS NOT NULL THEN 1 END) {P5} >= 5
  THEN CASE WHEN s1 = s2 THEN 1.0 ELSE corr(x1, x2) {P5} END END AS c
  FROM (SELECT a.ts, a.t, a.series_id AS s1, b.series_id AS s2, a.ret AS x1, b.ret AS x2 FROM {CRET} a JOIN {CRET} b ON a.ts = b.ts)) GROUP BY ts HAVING avg(c) IS NOT NULL)"""


@query("w3_mean_correlation", rounded_sql("ts", "mean_corr", CORR))
def _(spark, sf):
    return rounded(f.mean_correlation(f.log_returns(f.renumbered(f.common_dates(p.weekly(spark, sf)))), "ret", 5))


MULTI = f"(SELECT *, {std('ret', 5)} AS vol5, {std('ret', 20)} AS vol20, close / lag(close, 5) {S}) - 1 AS mom5, close / lag(close, 20) {S}) - 1 AS mom20 FROM {CRET})"


@query("w1_feature_matrix", f"""WITH m AS MATERIALIZED (SELECT * FROM {MULTI}), c AS (SELECT ts, stddev_samp(vol20) AS cross_vol_disp, avg(ret) AS avg_ret FROM m GROUP BY ts)
{rounded_sql('series_id, ts, t', 'ret, vol5, vol20, mom5, mom20, cross_vol_disp, avg_ret, cross_corr5=mean_corr', f'm JOIN c USING (ts) JOIN {CORR} USING (ts)')} WHERE vol20 IS NOT NULL AND mom20 IS NOT NULL AND cross_vol_disp IS NOT NULL""")
def _(spark, sf):
    return rounded(f.multi_series_features(p.weekly(spark, sf)))


def vectors(df):
    """x = [ret, close / 1e6] rows of a returns panel."""
    return df.where("ret is not null").select("series_id", "ts", (F.col("t") - 1).alias("t"), F.array("ret", F.col("close") / 1e6).alias("x"))


EX = " || ".join(f"[{g}(a) {roll(20)}, {g}(b) {roll(20)}]" for g in ("avg", "stddev_pop", "min", "max"))


@query("w4_enriched", f"SELECT series_id, t, pos::INTEGER AS pos, round(x[pos + 1], 6) + 0.0 AS v FROM (SELECT series_id, t, x, unnest(range(8)) AS pos FROM (SELECT series_id, t, {EX} AS x FROM (SELECT series_id, t - 1 AS t, ret AS a, close / 1e6 AS b FROM {RET} WHERE ret IS NOT NULL)) WHERE t >= 19)")
def _(spark, sf):
    return rounded(f.enriched(vectors(returns(spark, sf))).select("series_id", "t", F.posexplode("x").alias("pos", "v")))


B = f"(SELECT ts, stddev_samp(ret) AS xs_std, avg(abs(ret)) AS mean_abs, avg((ret > 0)::DOUBLE) AS share_up, avg(ret) AS mean_x, avg(ret ** 3) - 3 * avg(ret) * avg(ret ** 2) + 2 * avg(ret) ** 3 AS m3, stddev_pop(ret) AS sp FROM {DRET} WHERE ret IS NOT NULL GROUP BY ts)"
O20, O5 = (f"OVER (ORDER BY ts ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)" for k in (19, 4))


@query("w5_breadth", rounded_sql("ts", f"xs_std, mean_abs, share_up, mean_x, ma5=avg(mean_x) {O5}, ma20=avg(mean_x) {O20}, z20=CASE WHEN stddev_samp(mean_x) {O20} > 1e-12 THEN (mean_x - avg(mean_x) {O20}) / stddev_samp(mean_x) {O20} END", B))
def _(spark, sf):
    return rounded(f.breadth(returns(spark, sf, p.daily)).drop("xs_skew"))


@query("w6_delay_embedding", f"SELECT * FROM (SELECT series_id, t, round(ret, 6) + 0.0 AS x0, round(lag(ret, 2) {S}), 6) + 0.0 AS x1, round(lag(ret, 4) {S}), 6) + 0.0 AS x2 FROM {RET}) WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL")
def _(spark, sf):
    return rounded(f.delay_embedding(returns(spark, sf), "ret").select("series_id", "t", *[F.col("x")[k].alias(f"x{k}") for k in range(3)]))


VOL = f"(SELECT *, {std('ret', 20)} AS vol20 FROM {RET})"


@query("w7_expanding_z", rounded_sql("series_id, t", "score", expanding_z_sql(VOL, "vol20", 10, 60)))
def _(spark, sf):
    return rounded(expanding_z(returns(spark, sf).withColumn("vol20", f.rolling_std("ret", 20)), "vol20").select("series_id", "t", "score"))


for _form in ("abs", "positive", "negated"):

    @query(f"w8_expanding_z_{_form}", rounded_sql("series_id, t", "score", expanding_z_sql(VOL, "vol20", 1, 60, 30, _form)))
    def _(spark, sf, form=_form):
        return rounded(expanding_z(returns(spark, sf).withColumn("vol20", f.rolling_std("ret", 20)), "vol20", roll=1, skip=30, form=form).select("series_id", "t", "score"))


@query("w9_robust_z", f"""SELECT series_id, t, round(CASE WHEN k = 30 AND ret IS NOT NULL THEN CASE WHEN mad <= 1e-12 THEN 0.0 ELSE (ret - med) / (1.4826 * mad) END END, 6) + 0.0 AS robust_z FROM (
  SELECT *, len(fr) AS k, list_aggregate(list_transform(fr, lambda v: abs(v - med)), 'median') AS mad FROM (SELECT series_id, t, ret, list(ret) FILTER (ret IS NOT NULL) {roll(30)} AS fr, quantile_cont(ret, 0.5) {roll(30)} AS med FROM {RET}))""")
def _(spark, sf):
    return rounded(f.robust_z(returns(spark, sf), "ret", 30).select("series_id", "t", "robust_z"))


@query("w10_fixed_window_z", rounded_sql("series_id, t", "z", fixed_z_sql(RET, "ret", 60)))
def _(spark, sf):
    return rounded(returns(spark, sf).select("series_id", "t", f.fixed_window_z("ret", 60).alias("z")))


RR = f"(SELECT series_id, t, round(ret, 9) AS ret FROM {RET} WHERE ret IS NOT NULL)"
RANK = "(SELECT a.series_id, a.t, sum((b.ret <= a.ret)::INTEGER)::DOUBLE / count(*) AS pct FROM {r} a JOIN {r} b ON a.series_id = b.series_id AND b.t {op} a.t GROUP BY ALL)"


@query("w11_percentile_rank", rounded_sql("series_id, t", "pct", RANK.format(r=RR, op="<=")))
def _(spark, sf):
    r = returns(spark, sf).where("ret is not null").select("series_id", "t", F.round("ret", 9).alias("ret"))
    return rounded(percent_rank_past(r, "ret", "pct").drop("ret"))


@query("w12_prefix_moments", f"""SELECT series_id, t, n, {', '.join(f'round({c} {S}), 9) + 0.0 AS {n}' for c, n in (('sum(a)', 'sx'), ('sum(b)', 'sy'), ('sum(a * b)', 'sxy')))} FROM (SELECT series_id, t - 1 AS t, ret AS a, close / 1e6 AS b, count(*) {S}) AS n FROM {RET} WHERE ret IS NOT NULL)""")
def _(spark, sf):
    m = f.prefix_moments(vectors(returns(spark, sf)), block=100)
    return rounded(m.where("i = 0 and j = 1").drop("i", "j"), 9)


THR = f"(SELECT series_id, t, ret, CASE WHEN t >= 65 AND count(ret) OVER g >= 30 THEN quantile_cont(ret, 0.95) OVER g END AS threshold FROM {RET} WINDOW g AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 257 PRECEDING AND 6 PRECEDING))"


@query("w13_quantile_threshold", rounded_sql("series_id, t", "threshold", THR))
def _(spark, sf):
    from tidewatch.operators.alarms import quantile_threshold

    return rounded(quantile_threshold(returns(spark, sf), "ret").select("series_id", "t", "threshold"))


EMA_SQL = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT series_id, t, close / 1e6 AS x FROM {W}),
e AS (SELECT series_id, t, x AS ema FROM b WHERE t = 0 UNION ALL SELECT b.series_id, b.t, 0.1::DOUBLE * 2 * b.x + (1 - 0.1::DOUBLE * 2) * e.ema FROM e JOIN b ON b.series_id = e.series_id AND b.t = e.t + 1)
{rounded_sql('series_id, t', f'ema, ema_velocity=ema - lag(ema, 5) {S})', 'e')}"""


@query("w15_ema", EMA_SQL)
def _(spark, sf):
    return rounded(f.ema(p.weekly(spark, sf).withColumn("x", F.col("close") / 1e6), "x", 9).select("series_id", "t", "ema", "ema_velocity"))


SIMPLE = f"(SELECT series_id, t, coalesce(close / lag(close) {S}) - 1, 0) / 10 AS r FROM {W})"
WEALTH = f"(SELECT *, max(wealth) {S}) AS peak FROM (SELECT *, exp(sum(ln(1 + r)) {S})) AS wealth FROM {SIMPLE}))"


@query("w16_drawdown", rounded_sql("series_id, t", "wealth, peak, drawdown=(peak - wealth) / peak", WEALTH))
def _(spark, sf):
    r = p.weekly(spark, sf).withColumn("ret", (F.coalesce(f.momentum("close", 1), F.lit(0.0)) / 10))
    return rounded(f.drawdown(r).select("series_id", "t", "wealth", "peak", "drawdown"))


FLAG = f"(SELECT series_id, t, coalesce(close > avg(close) OVER (PARTITION BY series_id), false) AS up FROM {D})"


@query("w17_persistence", f"SELECT series_id, t, up, up AND count(*) OVER (PARTITION BY series_id, up, isle) >= 3 AS alarm FROM (SELECT *, t - sum(up::INTEGER) {S}) AS isle FROM {FLAG})")
def _(spark, sf):
    return f.persistent(flagged(spark, sf), "up", 3).select("series_id", "t", "up", "alarm")


def flagged(spark, sf):
    from pyspark.sql import Window

    return p.daily(spark, sf).withColumn("up", F.coalesce(F.col("close") > F.avg("close").over(Window.partitionBy("series_id")), F.lit(False)))


@query("w18_onsets", f"SELECT series_id, count(*) AS n FROM (SELECT series_id, up AND NOT coalesce(lag(up) {S}), false) AS edge FROM {FLAG}) WHERE edge GROUP BY series_id")
def _(spark, sf):
    return flagged(spark, sf).select("series_id", f.onsets("up").alias("edge")).where("edge").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query("w19_lag_correlation", f"""SELECT series_id, lag::INTEGER AS lag, round(corr(x, y), 6) + 0.0 AS corr, count(*) AS n FROM (SELECT a.series_id, k AS lag, a.ret AS x, b.vol20 AS y
  FROM {VOL} a, (SELECT unnest(range(-30, 31, 5)) AS k) ks JOIN {VOL} b ON a.series_id = b.series_id AND b.t = a.t + k) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL HAVING count(*) >= 100""")
def _(spark, sf):
    v = returns(spark, sf).withColumn("vol20", f.rolling_std("ret", 20))
    return rounded(f.lag_correlations(v, "ret", "vol20", range(-30, 31, 5)))


@query("w20_autocorrelation", rounded_sql("series_id", "ac1=corr(ret, l1), ac5=corr(ret, l5), ac21=corr(ret, l21)", f"(SELECT series_id, ret, lag(ret, 1) {S}) AS l1, lag(ret, 5) {S}) AS l5, lag(ret, 21) {S}) AS l21 FROM {RET}) GROUP BY series_id"))
def _(spark, sf):
    r = returns(spark, sf)
    r = r.withColumns({f"l{k}": F.lag("ret", k).over(ordered()) for k in (1, 5, 21)})
    return rounded(r.groupBy("series_id").agg(*[F.corr("ret", f"l{k}").alias(f"ac{k}") for k in (1, 5, 21)]))


@query("w21_hurst", f"""SELECT series_id, t, round(CASE WHEN len(fr) = 120 AND s > 1e-12 THEN abs(ln((list_max(cs) - list_min(cs)) / s) / ln(120) - 0.5) END, 6) + 0.0 AS hurst_stress FROM (
  SELECT *, list_transform(range(1, len(fr) + 1), lambda i: list_sum(list_transform(fr[1:i], lambda v: v - m))) AS cs
  FROM (SELECT series_id, t, list(ret) FILTER (ret IS NOT NULL) {roll(120)} AS fr, avg(ret) {roll(120)} AS m, stddev_pop(ret) {roll(120)} AS s FROM {RET}))""")
def _(spark, sf):
    return rounded(f.hurst_stress(returns(spark, sf), "ret").select("series_id", "t", "hurst_stress"))


@query("w22_sign_changes", f"SELECT series_id, t, (sum(flip) {roll(20)})::BIGINT AS sign_changes FROM (SELECT series_id, t, (sign(ret) <> sign(lag(ret) {S})))::INTEGER AS flip FROM {RET})")
def _(spark, sf):
    return f.sign_changes(returns(spark, sf), "ret", 20).select("series_id", "t", "sign_changes")


@query("w24_risk_parity", f"""SELECT series_id, ts, round(iv / sum(iv) OVER (PARTITION BY ts), 6) + 0.0 AS weight FROM (SELECT series_id, ts, 1 / stddev_samp(ret) {S} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS iv, count(ret) {S} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS k FROM {DRET}) WHERE k = 60""")
def _(spark, sf):
    from tidewatch.operators.backtest import inverse_vol_weights

    return rounded(inverse_vol_weights(returns(spark, sf, p.daily), 60).select("series_id", "ts", "weight"))


@query("p11_discretise", f"SELECT series_id, t, CASE WHEN hi > lo THEN least(floor((ret - lo) / (hi - lo) * 5), 4) WHEN ret IS NOT NULL THEN 0 END::INTEGER AS bin FROM (SELECT *, min(ret) {roll(60)} AS lo, max(ret) {roll(60)} AS hi FROM {RR.replace('WHERE ret IS NOT NULL', '')})")
def _(spark, sf):
    return f.discretised(returns(spark, sf).withColumn("ret", F.round("ret", 9)), "ret", 5, 60).select("series_id", "t", "bin")


@query("p15_interpolate", f"""SELECT series_id, t, round(CASE WHEN tb IS NULL OR tb = ta THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 6) + 0.0 AS filled FROM (
  SELECT series_id, t, last_value(CASE WHEN k IS NOT NULL THEN t END IGNORE NULLS) {S}) AS ta, last_value(k IGNORE NULLS) {S}) AS va,
    first_value(CASE WHEN k IS NOT NULL THEN t END IGNORE NULLS) OVER f AS tb, first_value(k IGNORE NULLS) OVER f AS vb
  FROM (SELECT series_id, t, CASE WHEN t % 7 = 3 THEN close END AS k FROM {W}) WINDOW f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def _(spark, sf):
    return rounded(f.interpolated(p.weekly(spark, sf).withColumn("k", F.when(F.col("t") % 7 == 3, F.col("close"))), "k", "filled").select("series_id", "t", "filled"))


@query("p5_sphere_vectors", "SELECT vec_id, pos::INTEGER AS pos, round(v[pos + 1] / (n + 1e-8), 6) + 0.0 AS x FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda a: a * a))) AS n, unnest(range(len(v))) AS pos FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))")
def _(spark, sf):
    e = p.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rounded(e.select("vec_id", F.posexplode(f.sphere()).alias("pos", "x")))


@query("p6_p7_standardise_project", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), e AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(x) AS v FROM v),
s AS (SELECT label, pos, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY ALL), z AS (SELECT vec_id, pos, CASE WHEN s = 0 THEN v - m ELSE (v - m) / s END AS z FROM e JOIN s USING (label, pos))
SELECT vec_id, round(sum(z) FILTER (pos % 2 = 0), 6) + 0.0 AS c0, round(sum(z * pos), 6) + 0.0 AS c1 FROM z GROUP BY vec_id""")
def _(spark, sf):
    e = p.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    comps = F.array(F.array(*[F.lit(1.0 if i % 2 == 0 else 0.0) for i in range(64)]), F.array(*[F.lit(float(i)) for i in range(64)]))
    s = e.select("label", F.posexplode("x").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    s = s.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("q"))  # a label's 64 components
    s = s.select("label", F.transform("q", lambda r: r["m"]).alias("mean"), F.transform("q", lambda r: r["s"]).alias("scale"))
    c = e.join(s, "label").withColumn("z", f.standardised()).withColumn("components", comps).withColumn("c", f.projected())
    return rounded(c.select("vec_id", F.col("c")[0].alias("c0"), F.col("c")[1].alias("c1")))


# joins and alignment


@query("j1_exogenous_join", f"SELECT w.series_id, w.ts, w.t, round(last_value(x.value IGNORE NULLS) OVER (PARTITION BY w.series_id ORDER BY w.t), 6) + 0.0 AS value FROM {SP} w LEFT JOIN (SELECT * FROM {X} WHERE day(ts) % 3 <> 0) x ON w.ts = x.ts")
def _(spark, sf):
    x = p.exogenous(spark, sf).where(F.dayofmonth("ts") % 3 != 0)
    return rounded(j.align_exogenous(p.sparse(spark, sf), x, fill=True).select("series_id", "ts", "t", "value"))


@query("j2_interval_join", f"SELECT o_orderkey, e.event_id, e.category FROM orders JOIN {EVENTS_SQL} e ON (o_orderkey % 2 = 0) = (e.category = 'novel') AND o_orderdate::DATE BETWEEN e.start AND e.stop")
def _(spark, sf):
    o = p.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ts"), F.when(F.col("o_orderkey") % 2 == 0, "novel").otherwise("conventional").alias("category"))
    return j.effective_join(o, p.events_dim(spark), "category").select("o_orderkey", "event_id", "category")


@query("j3_event_membership", f"SELECT w.series_id, w.ts, e.event_id FROM {W} w JOIN {EVENTS_SQL} e ON w.ts BETWEEN e.start - INTERVAL 7 DAY AND e.stop + INTERVAL 7 DAY")
def _(spark, sf):
    return j.event_members(p.weekly(spark, sf), p.events_dim(spark), pad=7).select("series_id", "ts", "event_id")


@query("j3_union_label", f"SELECT w.series_id, w.ts, EXISTS (SELECT 1 FROM {EVENTS_SQL} e WHERE w.ts BETWEEN e.start AND e.stop) AS inside FROM {W} w")
def _(spark, sf):
    return j.union_label(p.weekly(spark, sf), p.events_dim(spark)).select("series_id", "ts", "inside")


@query("j4_lower_bound", f"SELECT series_id, event_id, min(t) AS t0 FROM {SP} w JOIN {EVENTS_SQL} e ON w.ts >= e.start GROUP BY ALL")
def _(spark, sf):
    return j.lower_bound(p.sparse(spark, sf), p.events_dim(spark)).select("series_id", "event_id", "t0")


@query("j5_asof_snapshot", f"""SELECT w.series_id, w.t, coalesce(max(CASE WHEN s.t <= w.t THEN s.t END), min(s.t)) AS refit_t FROM {W} w JOIN (SELECT series_id, t FROM {W} WHERE t % 21 = 20) s USING (series_id) GROUP BY ALL""")
def _(spark, sf):
    w = p.weekly(spark, sf)
    snaps = w.where("t % 21 = 20").select("series_id", F.col("t").alias("refit_t"), F.col("close").alias("level"))
    return j.asof(w, snaps, "refit_t", ["level"]).select("series_id", "t", "refit_t")


@query("j6_common_dates", rounded_sql("series_id, ts", "close", f"{SP} WHERE ts IN (SELECT ts FROM {SP} GROUP BY ts HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM {SP}))"))
def _(spark, sf):
    return rounded(f.common_dates(p.sparse(spark, sf)).select("series_id", "ts", "close"))


@query("j7_state_overlap", f"""SELECT series_id, t, round((a * la + b * lb) ** 2 / ((a * a + b * b) * (la * la + lb * lb)), 6) + 0.0 AS overlap FROM (SELECT series_id, t, ret AS a, close / 1e7 AS b, lag(ret, 3) {S}) AS la, lag(close / 1e7, 3) {S}) AS lb FROM {RET})""")
def _(spark, sf):
    r = returns(spark, sf).select("series_id", "t", F.when(F.col("ret").isNotNull(), F.array("ret", F.col("close") / 1e7)).alias("psi"))
    return rounded(r.select("series_id", "t", j.lag_overlap("psi", 3).alias("overlap")))


@query("j8_overlap_confirmation", f"""WITH x AS (SELECT series_id || ':' || t AS id, series_id, t AS a, t + 2 + t % 5 AS b FROM {FLAG} WHERE up)
SELECT x.id, count(y.id) AS n FROM x LEFT JOIN x y ON x.id <> y.id AND x.a <= y.b AND y.a <= x.b AND x.series_id <> y.series_id GROUP BY x.id""")
def _(spark, sf):
    x = flagged(spark, sf).where("up").select(F.concat_ws(":", "series_id", "t").alias("id"), "series_id", F.col("t").alias("a"), (F.col("t") + 2 + F.col("t") % 5).alias("b"))
    return j.interval_overlaps(x, other_series=True).select("id", "n")


@query("j9_grid", f"SELECT series_id, event_id, k::INTEGER AS k FROM (SELECT DISTINCT series_id FROM {W}), {EVENTS_SQL}, (SELECT unnest(range(5)) AS k)")
def _(spark, sf):
    return j.grid(p.weekly(spark, sf).select("series_id").distinct(), p.events_dim(spark).select("event_id"), spark.range(5).select(F.col("id").cast("int").alias("k")))


@query("j11_missing_work", f"SELECT series_id, event_id FROM (SELECT DISTINCT series_id FROM {W}), {EVENTS_SQL} WHERE event_id NOT IN ('e97', 'e01') AND NOT (series_id = 'ASIA' AND event_id = 'e96')")
def _(spark, sf):
    g = j.grid(p.weekly(spark, sf).select("series_id").distinct(), p.events_dim(spark).select("event_id"))
    done = g.where("event_id in ('e97', 'e01') or (series_id = 'ASIA' and event_id = 'e96')")
    return j.missing_work(g, done, ["series_id", "event_id"])


# sources


@query("s2_unpivot", "SELECT o_orderkey, field, round(value, 6) + 0.0 AS value FROM (SELECT o_orderkey, o_totalprice::DOUBLE AS price, o_custkey::DOUBLE AS customer FROM orders) UNPIVOT (value FOR field IN (price, customer))")
def _(spark, sf):
    o = p.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    return rounded(o.unpivot("o_orderkey", ["price", "customer"], "field", "value"))


@query("s3_bars", """SELECT event_type AS series_id, date_trunc('day', ts)::DATE AS ts, round(arg_min(value, (ts, event_id)), 6) + 0.0 AS open, round(max(value), 6) + 0.0 AS high, round(min(value), 6) + 0.0 AS low,
  round(arg_max(value, (ts, event_id)), 6) + 0.0 AS close, round(sum(value), 4) + 0.0 AS volume FROM events GROUP BY ALL""")
def _(spark, sf):
    from tidewatch.sources.tables import bars

    b = bars(p.table(spark, sf, "events"), "event_type", "value", "event_id")
    return rounded(b.withColumn("volume", F.round("volume", 4)))


@query("s6_level_from_returns", f"SELECT series_id, t, round(100 * exp(sum(ln(1 + coalesce(r, 0))) {S})), 6) + 0.0 AS level FROM {SIMPLE}")
def _(spark, sf):
    from tidewatch.sources.tables import level_from_returns

    r = p.weekly(spark, sf).withColumn("ret", F.coalesce(f.momentum("close", 1), F.lit(0.0)) / 10)
    return rounded(level_from_returns(r).select("series_id", "t", "level"))


@query("s7_trades_to_daily", """WITH t AS (SELECT l_suppkey AS id, l_shipdate::DATE AS ts, l_orderkey, l_linenumber, l_extendedprice AS p, l_quantity AS v FROM lineitem),
d AS (SELECT id, ts, arg_min(p, (l_orderkey, l_linenumber)) AS price, sum(v::DECIMAL(18,2))::DOUBLE AS vol, sum((p::DECIMAL(18,2) * v::DECIMAL(18,2)))::DOUBLE / sum(v::DECIMAL(18,2))::DOUBLE AS vwap FROM t GROUP BY ALL)
SELECT id, ts, price, vol, vwap FROM d QUALIFY count(*) OVER (PARTITION BY id) >= 0.01 * (SELECT count(DISTINCT ts) FROM d)""")
def _(spark, sf):
    from tidewatch.sources.tables import daily_trades

    t = p.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("ts"), F.struct("l_orderkey", "l_linenumber").alias("at"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("v"))
    return daily_trades(t, coverage=0.01)


@query("s8_tenor_pivot", """SELECT ts, round(f, 6) + 0.0 AS iv30, round(r, 6) + 0.0 AS iv91, round(f - r, 6) + 0.0 AS slope FROM (SELECT l_shipdate::DATE AS ts, avg(l_discount) FILTER (l_returnflag = 'R') AS f, avg(l_discount) FILTER (l_returnflag = 'A') AS r
  FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY ALL)""")
def _(spark, sf):
    from tidewatch.sources.tables import tenor_pivot

    x = p.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("ts"), F.when(F.col("l_returnflag") == "R", 30).when(F.col("l_returnflag") == "A", 91).alias("days"), F.col("l_discount").alias("iv")).dropna(subset=["days"])
    return rounded(tenor_pivot(x))


@query("s13_run_diff", f"""WITH a AS (SELECT series_id AS method, year(ts) AS event, avg(close) AS d FROM {W} GROUP BY ALL), b AS (SELECT series_id AS method, year(ts) AS event, quantile_cont(close, 0.5) AS d FROM {SP} GROUP BY ALL)
SELECT coalesce(a.method, b.method) AS method, coalesce(a.event, b.event)::INTEGER AS event, round(b.d - a.d, 4) + 0.0 AS delta, CASE WHEN b.method IS NULL THEN 'removed' WHEN a.method IS NULL THEN 'added' ELSE 'both' END AS state FROM a FULL JOIN b ON a.method = b.method AND a.event = b.event""")
def _(spark, sf):
    from tidewatch.sources.results import run_diff

    # two runs of one study: yearly means of the weekly panel, yearly medians of the daily one
    run = lambda panel, of: panel(spark, sf).withColumn("event", F.year("ts")).withColumnRenamed("series_id", "method").groupBy("method", "event").agg(of.alias("d"))
    a, b = run(p.weekly, F.avg("close")), run(p.sparse, F.percentile("close", F.lit(0.5)))
    return rounded(run_diff(a, b), 4)
