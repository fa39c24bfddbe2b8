"""Queries of fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import features as f
from tidewatch.operators import forests
from tidewatch.operators import models as m
from tidewatch.operators.fusion import hierarchical_learned
from tidewatch.operators.joins import align_exogenous, event_members, union_label
from tidewatch.sources import panels as p
from tidewatch.sources.results import kept_table

from .evaluation import METHODS, panel_scores, wide
from .features import RET, S, W, returns, roll, std, vectors
from .registry import query, rounded, rounded_sql

VR = f"(SELECT series_id, {std('ret', 20)} AS x, close / 1e6 AS y FROM {RET})"


@query("m15_regression", f"""WITH d AS MATERIALIZED (SELECT * FROM {VR} WHERE x IS NOT NULL), g AS (SELECT series_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS n, avg(x) AS mx, var_pop(x) AS vx FROM d GROUP BY 1),
l AS (SELECT series_id, avg(abs((y - intercept - slope * x) / (1 - (1 / n::DOUBLE + (x - mx) ** 2 / (n * vx))))) AS loo_mae FROM d JOIN g USING (series_id) GROUP BY 1)
SELECT series_id, round(slope, 5) + 0.0 AS slope, round(intercept, 5) + 0.0 AS intercept, round(r2, 5) AS r2, n, round(loo_mae, 5) AS loo_mae, round(r2 / (1 - r2) * (n - 2), 5) AS f_stat FROM g JOIN l USING (series_id)""")
def _(spark, sf):
    x = returns(spark, sf).select("series_id", f.rolling_std("ret", 20).alias("x"), (F.col("close") / 1e6).alias("y"))
    return rounded(m.regression(x, "x", "y"), 5)


def rows_only(name, fn):
    query(name)(lambda spark, sf: rounded(fn(spark, sf)))


def keep(df, *cols):
    return df.select("series_id", "t", *cols)


rows_only("m5_hidden_markov", lambda s, d: keep(m.hidden_regimes(returns(s, d)), "p_high"))
rows_only("m6_markov_switching", lambda s, d: keep(m.hidden_regimes(returns(s, d), ar=True), "p_high"))


def garch(spark, sf):
    kept = kept_table(spark)
    x = kept(returns(spark, sf))
    return keep(m.garch_vol(x, m.garch_fit(x, kept)), "sigma", "score")


rows_only("m7_garch", garch)
rows_only("m7_garch_parameters", lambda s, d: m.garch_fit(returns(s, d), kept_table(s)))
rows_only("d5_turbulence_vector", lambda s, d: m.turbulence(returns(s, d).select("series_id", "t", F.array("ret", F.col("close") / 1e6, f.momentum("close", 5)).alias("x"))))
rows_only("m8_isolation_forest", lambda s, d: m.isolation_scores(vectors(returns(s, d))))
rows_only("m13_kernel_gap", lambda s, d: keep(m.kernel_gap(vectors(returns(s, d))), "gap", "score"))
rows_only("m14_structural_breaks", lambda s, d: keep(m.structural_breaks(returns(s, d)), "nearness", "score"))
rows_only("d4_mahalanobis", lambda s, d: m.mahalanobis(vectors(returns(s, d))))
rows_only("d6_absorption_ratio", lambda s, d: m.absorption_ratio(returns(s, d)))
rows_only("d11_online_changepoints", lambda s, d: keep(m.online_changepoints(returns(s, d)), "p_short"))
rows_only("d17_whitened_changepoints", lambda s, d: m.whitened_changepoints(returns(s, d)))
rows_only("d16_sinkhorn", lambda s, d: keep(m.sinkhorn(returns(s, d)), "score"))


@query("m9_held_out_forest")
def _(spark, sf):
    x = returns(spark, sf).withColumns({"vol20": f.rolling_std("ret", 20), "mom20": f.momentum("close", 20)})
    ev = event_members(p.weekly(spark, sf), p.events_dim(spark)).select("series_id", "t", "event_id")
    x = x.join(ev, ["series_id", "t"], "left").withColumn("x", F.array("vol20", "mom20")).where("vol20 is not null and mom20 is not null")
    return rounded(forests.held_out_forest(x, "x", F.col("event_id").isNotNull(), "event_id", [event[0] for event in p.EVENTS]))


@query("m19_held_out_series")
def _(spark, sf):
    """Event weeks told from covariates by forests that never saw the series."""
    x = returns(spark, sf).select("series_id", "ts", "t", F.array(f.rolling_std("ret", 20), f.momentum("close", 20), f.rolling_std("ret", 5)).alias("x"))
    names = [r.r_name for r in p.table(spark, sf, "region").select("r_name").orderBy("r_name").collect()]  # a fixed handful
    return rounded(forests.held_out_forest(union_label(x, p.events_dim(spark)), "x", "inside", "series_id", names).where(F.col("event") == F.col("series_id")))


@query("m10_rolling_forest")
def _(spark, sf):
    """Is the exogenous level high? Trees on the trailing 250 rows, refitted every 21."""
    daily = align_exogenous(returns(spark, sf, p.daily), p.exogenous(spark, sf), fill=True)
    x = daily.withColumn("x", F.array(f.rolling_std("ret", 20), f.momentum("close", 20), F.col("ret"), f.rolling_std("ret", 5)))
    return rounded(forests.rolling_forest(x, "x", "value", 5.0))


def labelled(spark, sf):
    y = union_label(p.weekly(spark, sf), p.events_dim(spark)).select("series_id", "t", "inside")
    return wide(spark, sf).join(y, ["series_id", "t"])


rows_only("m11_logistic_stacking", lambda s, d: keep(m.logistic_stacking(labelled(s, d), ["a", "b", "c"], "inside", 200), "p"))
rows_only("m18_boosted_stacking", lambda s, d: keep(m.boosted_stacking(labelled(s, d), ["a", "b", "c"], "inside", 200, 3), "p"))


def event_labels(spark, sf):
    return union_label(p.weekly(spark, sf), p.events_dim(spark)).select("series_id", "t", F.col("inside").alias("label"))


@query("m12_regime_adaptive")
def _(spark, sf):
    return rounded(m.regime_adaptive(panel_scores(spark, sf), event_labels(spark, sf), list(METHODS)))


@query("f4_learned_families")
def _(spark, sf):
    from .fusion import FAM

    return rounded(hierarchical_learned(panel_scores(spark, sf), FAM, event_labels(spark, sf), 250, kept_table(spark)))
