"""Queries of the spectral embedding: enriched weekly features, standardised, projected and embedded."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.windows import ordered
from tidewatch.operators import features as f
from tidewatch.operators import geometry as g
from tidewatch.operators import topology

from .features import RET, returns, vectors
from .registry import query, rounded

FIT, DIM, COMPONENTS = 100, 4, 3


def features(spark, sf):
    x = f.enriched(vectors(returns(spark, sf)), 10)
    return x.withColumn("t", F.col("t") - 9)


def projected(spark, sf):
    x = features(spark, sf)
    return g.embed_features(x, g.fit_prefix(x, FIT, COMPONENTS), "sphere")


def embedded(spark, sf, want=()):
    x = projected(spark, sf)
    w = ordered()
    x = x.withColumn("x_prev", F.lag("x").over(w)).withColumn("x_next", F.lead("x").over(w))
    return g.spectral_embed(x, g.basis("random", DIM, COMPONENTS), want)


def rows_only(name, fn):
    query(name)(lambda spark, sf: rounded(fn(spark, sf)))


@query("m1_prefix_fit")
def _(spark, sf):
    s = g.fit_prefix(features(spark, sf), FIT, COMPONENTS)
    return rounded(s.select("series_id", "refit_t", F.posexplode("variances").alias("k", "variance")))


@query("m2_expanding_fit")
def _(spark, sf):
    s = g.fit_expanding(features(spark, sf), FIT, 80, COMPONENTS)
    return rounded(s.select("series_id", "refit_t", F.posexplode("variances").alias("k", "variance")))


VEC = f"(SELECT series_id, t - 1 AS t, ret AS a, close / 1e6 AS b FROM {RET} WHERE ret IS NOT NULL)"
AT = f"(SELECT series_id, unnest(range(100, max(t) + 1, 80)) AS refit_t FROM {VEC} GROUP BY 1)"


@query("m2_interval_moments", f"""SELECT s.series_id, s.refit_t, count(*) AS n, round(avg(a), 6) + 0.0 AS mean_a, round(avg(b), 6) + 0.0 AS mean_b, round(var_pop(a), 6) + 0.0 AS var_a, round(var_pop(b), 6) + 0.0 AS var_b, round(covar_pop(a, b), 6) + 0.0 AS cov
FROM {AT} s JOIN {VEC} v ON v.series_id = s.series_id AND v.t < s.refit_t GROUP BY ALL""")
def _(spark, sf):
    """What every refit is made of: moments of all rows before it, by adding up intervals."""
    m = g.interval_sums(vectors(returns(spark, sf)), FIT, 80)
    pick = lambda i, j, c: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col(c)))
    out = m.groupBy("series_id", "refit_t").agg(F.max("n").alias("n"), pick(0, 0, "m").alias("mean_a"), pick(1, 1, "m").alias("mean_b"), pick(0, 0, "c").alias("var_a"), pick(1, 1, "c").alias("var_b"), pick(0, 1, "c").alias("cov"))
    return rounded(out)


@query("j5_causal_embedding")
def _(spark, sf):
    """Rows embedded by the latest of several refits before them."""
    x = features(spark, sf)
    e = g.spectral_embed(g.embed_causal(x, g.fit_expanding(x, FIT, 80, COMPONENTS)), g.basis("random", DIM, COMPONENTS))
    return rounded(e.select("series_id", "t", "refit_t", F.element_at("spectrum", 1).alias("energy"), g.gap().alias("gap")))


@query("g1_spectral_embedding")
def _(spark, sf):
    e = embedded(spark, sf)
    return rounded(e.select("series_id", "t", F.element_at("spectrum", 1).alias("energy"), g.gap().alias("gap"), g.norm("g").alias("metric"), g.norm("f").alias("curvature"), (g.dot("psi_re", "psi_re") + g.dot("psi_im", "psi_im")).alias("norm")))


rows_only("g2_observable_scores", lambda s, d: g.observable_scores(embedded(s, d)))
rows_only("g10_extended_observables", lambda s, d: g.observable_scores(embedded(s, d, tuple(g.EXTRA)), [n for n in g.OBSERVABLES if g._needs(n)]))
rows_only("g9_geometric_ensemble", lambda s, d: g.geometric_ensemble(g.observable_scores(embedded(s, d), list(g.ENSEMBLE))))
rows_only("g4_multi_scale_berry", lambda s, d: g.multi_scale_berry(embedded(s, d)))
rows_only("g20_effective_dimension", lambda s, d: g.effective_dimension(embedded(s, d)))
rows_only("g27_density_observables", lambda s, d: g.density_observables(embedded(s, d)))
rows_only("g30_consensus", lambda s, d: g.consensus(g.observable_scores(embedded(s, d), ["berry_rate", "inverse_gap"])))
rows_only("g31_gap_collapse", lambda s, d: g.gap_collapse(embedded(s, d)))
rows_only("g32_wilson_phase", lambda s, d: g.wilson_phase(embedded(s, d)))
rows_only("g33_run_means", lambda s, d: g.run_means(embedded(s, d, ("schmidt", "sensitivity"))))


rows_only("x3_reference_states", lambda s, d: g.reference_observables(embedded(s, d)))
rows_only("x20_rolling_infidelity", lambda s, d: g.rolling_infidelity(embedded(s, d)))


def curvature(spark, sf):
    e = embedded(spark, sf).select("series_id", "ts", "t", F.element_at("f", 2).alias("f01"), F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    return topology.curvature_integral(e, "f01", "a", "b")


rows_only("t3_rolling_chern", lambda s, d: topology.rolling_integral(curvature(s, d), 20, 5).select("series_id", "t", "chern"))
rows_only("t4_transitions", lambda s, d: topology.transitions(curvature(s, d), "f01", 0.01))


@query("t5_event_classes")
def _(spark, sf):
    from tidewatch.sources import panels as p

    return rounded(topology.classify_events(curvature(spark, sf), p.events_dim(spark), "f01", 30))


# the operators that other plans check against SQL on returns and closes, here on the curvature and gap of the geometric table


def geometric(spark, sf):
    """series_id, ts, t, f01, gap of every embedded row."""
    return embedded(spark, sf).select("series_id", "ts", "t", F.element_at("f", 2).alias("f01"), g.gap().alias("gap"))


@query("g31_gap_ratios")
def _(spark, sf):
    from tidewatch.operators.variants import attribute_split, collapse_ratios
    from tidewatch.sources import panels as p

    ratios = collapse_ratios(geometric(spark, sf), "gap", p.events_dim(spark))
    t = attribute_split(ratios, p.events_dim(spark), "collapse").select("series_id", F.col("t").alias("novel_t"))
    return rounded(ratios.join(t, "series_id", "left"))


@query("t6_geometric_signature")
def _(spark, sf):
    from tidewatch.operators.variants import regime_signature

    return rounded(regime_signature(geometric(spark, sf).withColumn("segment", F.year("ts")), "f01", "gap", "segment"))


@query("t8_geometric_consensus")
def _(spark, sf):
    from tidewatch.operators.variants import scale_consensus, scale_signals

    return rounded(scale_consensus(scale_signals(geometric(spark, sf), "f01", {10: 0.2, 20: 0.2, 30: 0.2, 50: 0.2, 100: 0.2})))


@query("e30_geometric_bounds")
def _(spark, sf):
    from tidewatch.operators.variants import bound_checks

    return rounded(bound_checks(geometric(spark, sf), "f01", "gap"))


@query("x_embedding_vectors")
def _(spark, sf):
    """The vector table embedded: each vector as a point of eight parameters, the means of eighths of its components (all of them, whatever their number), by label."""
    from tidewatch.sources import panels as p

    v = F.col("embedding").cast("array<double>")
    cut = lambda k: F.floor(F.size(v) * k / 8).cast("int")
    part = lambda k: F.slice(v, cut(k) + 1, cut(k + 1) - cut(k))
    mean = lambda k: F.when(cut(k + 1) > cut(k), F.aggregate(part(k), F.lit(0.0), lambda s, x: s + x) / (cut(k + 1) - cut(k))).otherwise(0.0)
    e = p.table(spark, sf, "embeddings").select("vec_id", "label", F.when(v.isNotNull(), F.array(*[mean(k) for k in range(8)])).alias("x"))
    out = g.spectral_embed(e, g.basis("random", 4, 8))
    return rounded(out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(g.gap()).alias("gap"), F.avg(g.norm("f")).alias("curvature")))


SWEPT = ("berry_rate", "inverse_gap", "metric_trace")


def swept(spark, sf, variants):
    """variant, method, series_id, event_id, d of observables for each operator basis; the projected rows are written once."""
    from tidewatch.operators import evaluate as e
    from tidewatch.sources import panels as p
    from tidewatch.sources.results import kept_table

    x, out = kept_table(spark)(projected(spark, sf)), None
    for name, ops in variants.items():
        s = g.observable_scores(g.spectral_embed(x, ops), list(SWEPT)).withColumn("method", F.concat(F.lit(f"{name}/"), "method"))
        out = s if out is None else out.unionByName(s)
    d = e.cohens_d(e.group_moments(out, p.events_dim(spark)))
    return d.select(F.split_part("method", F.lit("/"), F.lit(1)).alias("variant"), F.split_part("method", F.lit("/"), F.lit(2)).alias("method"), "series_id", "event_id", "d")


@query("x22_dimension_sweep")
def _(spark, sf):
    """Median effect of each observable by the dimension of the state space."""
    d = swept(spark, sf, {str(n): g.basis("random", n, COMPONENTS) for n in (2, 4, 8, 16)})
    return rounded(d.groupBy(F.col("variant").cast("int").alias("dim"), "method").agg(F.percentile("d", F.lit(0.5)).alias("median_d"), F.count("d").alias("n")))


@query("e29_seed_robustness")
def _(spark, sf):
    """How far the median effect of each observable moves with the seed of a random basis, and with the kind of basis."""
    variants = {f"random{seed}": g.basis("random", DIM, COMPONENTS, seed=100 * seed) for seed in range(5)} | {kind: g.basis(kind, DIM, COMPONENTS) for kind in ("pauli", "gell_mann")}
    d = swept(spark, sf, variants).groupBy("variant", "method").agg(F.percentile("d", F.lit(0.5)).alias("median_d"))
    kind = F.when(F.col("variant").startswith("random"), "random").otherwise(F.col("variant"))
    g_ = d.groupBy(kind.alias("basis"), "method").agg(F.count(F.lit(1)).alias("n"), F.avg("median_d").alias("mean"), F.min("median_d").alias("least"), F.max("median_d").alias("most"), F.coalesce(F.stddev_samp("median_d"), F.lit(0.0)).alias("deviation"))
    return rounded(g_)


rows_only("x5_floquet", lambda spark, sf: g.floquet_observables(projected(spark, sf), g.basis("random", DIM, COMPONENTS)))
