"""Fusion of score channels: long scores (series_id, method, ts, t, score) -> one score a row of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.folds import ordered_fold
from tidewatch.functions.windows import expanding_z, ordered, past, percent_rank_past, so_far

from .evaluate import average_rank

ROW = ("series_id", "ts", "t")


def per_row(scores: DataFrame, agg: Column, out: str) -> DataFrame:
    return scores.groupBy(*ROW).agg(agg.alias(out))


def composite(scores: DataFrame) -> DataFrame:
    """Null-aware reducers of a row's channels: largest, mean and root mean square."""
    return scores.groupBy(*ROW).agg(F.max("score").alias("comp_max"), F.avg("score").alias("comp_mean"), F.sqrt(F.avg(F.col("score") * F.col("score"))).alias("comp_rms"))


def rank_fusion(scores: DataFrame, roll: int = 10, min_expanding: int = 60, least: int = 10) -> DataFrame:
    """Mean over channels of their percentile ranks so far, from row min_expanding on, smoothed, as a z-score.

    A channel with fewer than `least` values so far ranks 0.5, whatever its score; later a null has no rank.
    """
    seen = F.count("score").over(so_far(ordered("series_id", "method")))
    r = percent_rank_past(scores.withColumn("_seen", seen), "score", "pct", ("series_id", "method"))
    r = r.withColumn("pct", F.when(F.col("t") >= min_expanding, F.when(F.col("_seen") < least, 0.5).otherwise(F.col("pct"))))
    return expanding_z(per_row(r, F.avg("pct"), "fused"), "fused", roll=roll, min_expanding=min_expanding)


def dynamic_switching(scores: DataFrame, target: DataFrame, window: int = 60, roll: int = 10, min_expanding: int = 60) -> DataFrame:
    """Channels weighted by their positive correlation with a target (series_id, t, target) over the past rows; null scores count as 0."""
    w = ordered("series_id", "method").rowsBetween(-window, -1)
    x = scores.join(target, ["series_id", "t"], "left")
    both = F.col("score").isNotNull() & F.col("target").isNotNull()
    x = x.withColumn("_a", F.when(both, F.col("score"))).withColumn("_b", F.when(both, F.col("target")))
    n = F.count("_a").over(w)
    ways = F.count(F.lit(1)).over(Window.partitionBy(*ROW))
    weight = F.when(n < 10, 1.0 / ways).otherwise(F.greatest(F.coalesce(F.nanvl(F.corr("_a", "_b").over(w), F.lit(None)), F.lit(0.0)), F.lit(0.0)))
    x = x.withColumn("_w", weight).withColumn("_k", ways)
    total = F.sum("_w").over(Window.partitionBy(*ROW))
    x = x.withColumn("_w", F.when(total < 1e-12, 1.0 / F.col("_k")).otherwise(F.col("_w") / total))
    fused = per_row(x, F.sum(F.col("_w") * F.coalesce("score", F.lit(0.0))), "fused").withColumn("fused", F.when(F.col("t") >= max(window, min_expanding), F.col("fused")))
    return expanding_z(fused, "fused", roll=roll, min_expanding=min_expanding)


def hierarchical(scores: DataFrame, families: dict[str, str], roll: int = 10, min_expanding: int = 60, least: int = 10) -> DataFrame:
    """Percentile ranks averaged within families, ranked again over time, then averaged across families.

    At both levels a rank needs row min_expanding and `least` values so far.
    """
    m = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    late = lambda c: F.when(F.col("t") >= min_expanding, F.col(c))
    r = percent_rank_past(scores, "score", "pct", ("series_id", "method"), least=least).withColumn("pct", late("pct")).withColumn("family", F.try_element_at(m, F.col("method")))
    fam = r.groupBy(*ROW, "family").agg(F.round(F.avg("pct"), 9).alias("fam"))
    again = percent_rank_past(fam, "fam", "pct2", ("series_id", "family"), least=least).withColumn("pct2", late("pct2"))
    return expanding_z(per_row(again, F.avg("pct2"), "fused"), "fused", roll=roll, min_expanding=min_expanding)


def hierarchical_learned(scores: DataFrame, families: dict[str, str], labels: DataFrame, train_rows: int, keep, c: float = 0.1, roll: int = 15, min_expanding: int = 60, least: int = 10) -> DataFrame:
    """series_id, t, fused, score: family ranks (see hierarchical) combined by a logistic model of labels (series_id, t, label) on each series' rows t < train_rows.

    fused is the linear part of the model; missing family ranks count 0, and rows without any train
    nothing. A series with fewer than 20 training rows or one label weighs families alike.
    `keep` writes a table and reads it back. score is the smoothed z-score.
    """
    from .inference import logistic_models

    m = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    names = sorted(set(families.values()))
    late = F.when(F.col("t") >= min_expanding, F.col("pct"))
    r = percent_rank_past(scores, "score", "pct", ("series_id", "method"), least=least).withColumn("pct", late).withColumn("family", F.try_element_at(m, F.col("method")))
    fam = r.groupBy(*ROW, "family").agg(F.avg("pct").alias("fam")).groupBy(*ROW).pivot("family", names).agg(F.max("fam"))
    fam = keep(fam.select(*ROW, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(f"f{i}") for i, n in enumerate(names)]))
    cols = [f"f{i}" for i in range(len(names))]
    train = fam.where((F.col("t") < train_rows) & (F.greatest(*cols) > 0 if len(cols) > 1 else F.col(cols[0]) > 0)).join(labels.select("series_id", "t", "label"), ["series_id", "t"])
    fits = logistic_models(train, {"families": cols}, "label", ["series_id"], keep, c).where("n >= 20").select("series_id", "weights")
    j = fam.join(fits, "series_id", "left").withColumn("weights", F.coalesce("weights", F.array(*[F.lit(1.0 / len(cols))] * len(cols), F.lit(0.0))))
    fused = F.element_at("weights", -1)
    for i, x in enumerate(cols):  # logistic_models orders weights by column name
        fused = fused + F.col(x) * F.element_at("weights", sorted(cols).index(x) + 1)
    return expanding_z(j.withColumn("fused", fused).select(*ROW, "fused"), "fused", roll=roll, min_expanding=min_expanding)


def softmax_attention(scores: DataFrame) -> DataFrame:
    """Channels weighted by softmax of |score| within the row."""
    w = Window.partitionBy(*ROW)
    x = scores.where("score is not null").withColumn("_e", F.exp(F.abs("score") - F.max(F.abs("score")).over(w)))
    return x.groupBy(*ROW).agg((F.sum(F.col("_e") * F.col("score")) / F.sum("_e")).alias("attention"))


def votes(scores: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Share of channels above a threshold."""
    return per_row(scores.where("score is not null"), F.avg((F.col("score") > threshold).cast("double")), "share")


def borda(scores: DataFrame) -> DataFrame:
    """Share of positive channels and reciprocal-rank weighted mean (weights 1 / (60 + rank))."""
    x = average_rank(scores.where("score is not null"), "score", list(ROW), "_r", descending=True)
    w = 1.0 / (60 + F.col("_r"))
    return x.groupBy(*ROW).agg(F.avg((F.col("score") > 0).cast("double")).alias("positive"), (F.sum(w * F.col("score")) / F.sum(w)).alias("reciprocal"))


def exponential_weights(scores: DataFrame, target: DataFrame, eta: float = 0.1, threshold: float = 1.0) -> DataFrame:
    """Hedge: weights exp(eta * past hits), a hit being agreement of score > threshold with target (series_id, t, y)."""
    x = scores.where("score is not null").join(target, ["series_id", "t"]).withColumn("_hit", ((F.col("score") > threshold) == F.col("y")).cast("int"))
    x = x.withColumn("_w", F.exp(eta * F.coalesce(F.sum("_hit").over(past(ordered("series_id", "method"))), F.lit(0))))
    return x.groupBy(*ROW).agg((F.sum(F.col("_w") * F.col("score")) / F.sum("_w")).alias("hedge"))


def best_before(cells: DataFrame) -> DataFrame:
    """For each event, the method with the largest mean effect over earlier events (by start); cells: method, event_id, start, d."""
    b = cells.select("method", F.col("start").alias("_s"), F.col("d").alias("_d")).where("_d is not null")
    e = cells.select("event_id", "start").distinct()
    g = e.join(b, F.col("_s") < F.col("start")).groupBy("event_id", "method").agg(F.avg("_d").alias("mean_d"))
    w = Window.partitionBy("event_id").orderBy(F.round("mean_d", 9).desc(), "method")
    return g.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("event_id", "method", "mean_d")


def brier_weights(predictions: DataFrame) -> DataFrame:
    """event_id, method, weight proportional to 1 / Brier score over events that started earlier; predictions: method, event_id, start, p, y."""
    s = predictions.groupBy("method", "event_id", "start").agg(F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("q"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("method").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_b", F.sum("q").over(w) / F.sum("n").over(w)).where("_b > 0")
    return s.select("event_id", "method", ((1 / F.col("_b")) / F.sum(1 / F.col("_b")).over(Window.partitionBy("event_id"))).alias("weight"))


def mutual_information_weights(scores: DataFrame, target: DataFrame, bins: int = 20) -> DataFrame:
    """series_id, method, mi, weight (softmax of mi / largest mi): mutual information with a target (series_id, t, target) over a bins x bins histogram. Uses the whole series."""
    x = scores.join(target, ["series_id", "t"]).where("score is not null and target is not null")
    g = Window.partitionBy("series_id", "method")
    cell = lambda c: F.when(F.max(c).over(g) > F.min(c).over(g), F.least(F.floor((F.col(c) - F.min(c).over(g)) / (F.max(c).over(g) - F.min(c).over(g)) * bins), F.lit(bins - 1))).otherwise(0)
    c = x.withColumn("a", cell("score")).withColumn("b", cell("target")).groupBy("series_id", "method", "a", "b").agg(F.count(F.lit(1)).alias("k"))
    over = lambda *k: F.sum("k").over(Window.partitionBy("series_id", "method", *k))
    c = c.withColumns({"ka": over("a"), "kb": over("b"), "n": over()})
    mi = c.groupBy("series_id", "method").agg(F.sum(F.col("k") / F.col("n") * F.log(F.col("k") * F.col("n") / (F.col("ka") * F.col("kb")))).alias("mi"))
    s = Window.partitionBy("series_id")
    mi = mi.withColumn("_e", F.exp(F.col("mi") / F.greatest(F.max("mi").over(s), F.lit(1e-12))))
    return mi.select("series_id", "method", "mi", (F.col("_e") / F.sum("_e").over(s)).alias("weight"))


def method_correlations(scores: DataFrame) -> DataFrame:
    """series_id, a, b, rho of every pair of methods."""
    ok = scores.where("score is not null")
    x = ok.select("series_id", "t", F.col("method").alias("a"), F.col("score").alias("_x"))
    y = ok.select("series_id", "t", F.col("method").alias("b"), F.col("score").alias("_y"))
    return x.join(y, ["series_id", "t"]).where("a < b").groupBy("series_id", "a", "b").agg(F.corr("_x", "_y").alias("rho"))


def cluster_fusion(scores: DataFrame, cut: float = 0.5) -> DataFrame:
    """Mean within clusters of methods with |rho| >= 1 - cut (single linkage), then across clusters.

    Correlations are pooled over series. Only the small method-by-method table reaches the driver,
    where labels are joined until they settle.
    """
    rho = method_correlations(scores).groupBy("a", "b").agg(F.avg(F.abs("rho")).alias("r"))
    close = rho.where(1 - F.col("r") <= cut).select("a", "b").collect()  # methods squared at most
    label: dict[str, str] = {}
    for _ in range(len(close) + 1):
        for a, b in close:
            least = min(label.get(a, a), label.get(b, b))
            label[a] = label[b] = least
    known = F.create_map(*[F.lit(x) for kv in label.items() for x in kv]) if label else F.create_map().cast("map<string,string>")
    labels = F.coalesce(F.try_element_at(known, F.col("method")), F.col("method"))
    inner = scores.where("score is not null").withColumn("cluster", labels).groupBy(*ROW, "cluster").agg(F.avg("score").alias("m"))
    return inner.groupBy(*ROW).agg(F.avg("m").alias("cluster_mean"))


def sequential_evidence(scores: DataFrame, min_expanding: int = 60, decay: float = 0.95, upper: float = 2.995732, lower: float = -2.995732) -> DataFrame:
    """Decayed log-likelihood ratio with barriers and resets: series_id, ts, t, evidence, alarm.

    The average ratio of a row uses the channels' past deviations (20 values at least) and is a
    window expression; the decayed sum that resets at barriers depends on its path and is a fold.
    """
    w = past(ordered("series_id", "method"))
    x = scores.withColumn("_sd", F.greatest(F.stddev_samp("score").over(w), F.lit(1e-8))).withColumn("_n", F.count("score").over(w))
    llr = F.when((F.col("_n") >= 20) & (F.col("t") >= min_expanding), F.col("score") / F.col("_sd") - 0.5)
    r = per_row(x.withColumn("_l", llr), F.coalesce(F.avg("_l"), F.lit(0.0)), "llr")

    def step(state, row):
        (e,) = state
        t, now = row
        e = 0.0 if t < min_expanding else decay * e + now
        alarm = e >= upper
        kept = 0.0 if alarm or e <= lower else e
        return (kept,), (kept, alarm)

    return ordered_fold(r, ["t", "llr"], lambda: (0.0,), step, "evidence double, alarm boolean").drop("llr")


def evidence_score(scores: DataFrame, min_expanding: int = 60, **settings) -> DataFrame:
    """sequential_evidence with its score: the evidence as a z-score against all rows before."""
    return expanding_z(sequential_evidence(scores, min_expanding, **settings), "evidence", roll=1, min_expanding=min_expanding)


def weighted_ensemble(scores: DataFrame, weights: dict[str, float], share: float = 0.5) -> DataFrame:
    """Weighted mean of a row's channels, null unless at least `share` of all channels have a score; a channel without a weight counts 1."""
    m = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    w = F.coalesce(F.try_element_at(m, F.col("method")), F.lit(1.0))
    ok = F.col("score").isNotNull()
    g = scores.groupBy(*ROW).agg(F.sum(F.when(ok, w * F.col("score"))).alias("_s"), F.sum(F.when(ok, w)).alias("_w"), F.count("score").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return g.select(*ROW, F.when((F.col("_n") >= share * F.col("_k")) & (F.col("_w") > 0), F.col("_s") / F.col("_w")).alias("ensemble"))


def gaussian_copula(scores: DataFrame, methods: list[str], min_expanding: int = 60, min_corr: int = 120, least: int = 30, shrink: float = 0.1) -> DataFrame:
    """series_id, ts, t, copula, score: how far a row's channels are jointly out, under a Gaussian copula of the past.

    Each channel becomes the normal quantile of its share of earlier values that are not greater
    (ten at least, from row min_expanding on, kept off 0 and 1 by 1e-6); their correlation over
    all complete rows before, shrunk to the identity, gives the quadratic form. Until row
    min_corr, or with fewer than `least` complete rows before, it is null; an incomplete row has the
    mean of what is there. score is its z against all rows before. A series' rows stream in time
    order through one task, with running sums for its state; a batch's systems are solved together.
    """
    import numpy as np
    import pyarrow as pa

    from tidewatch.functions.stats import normal_quantile

    u = percent_rank_past(scores, "score", "_u", ("series_id", "method"), include_current=False, least=10)
    u = u.withColumn("_u", F.when((F.col("t") >= min_expanding) & F.col("_u").isNotNull(), F.least(F.greatest("_u", F.lit(1e-6)), F.lit(1 - 1e-6))))
    g = u.withColumn("_g", normal_quantile(F.col("_u"))).groupBy(*ROW).pivot("method", methods).agg(F.max("_g"))
    g = g.select(*ROW, F.array(*[F.col(f"`{m}`") for m in methods]).alias("g"))
    d = len(methods)

    def forms(x: np.ndarray, t: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The quadratic form of each row by the sums of complete rows before it."""
        known = ~np.isnan(x)
        out = np.where(known.any(1), np.where(known, x, 0).sum(1) / np.maximum(known.sum(1), 1), np.nan)
        at = np.flatnonzero(known.all(1) & (n >= least))
        if len(at):
            cov = q[at] / n[at, None, None] - np.einsum("ti,tj->tij", s[at], s[at]) / n[at, None, None] ** 2
            sd = np.sqrt(np.maximum(np.einsum("tii->ti", cov), 1e-24))
            r = (1 - shrink) * cov / np.einsum("ti,tj->tij", sd, sd)
            r[:, np.arange(d), np.arange(d)] = 1.0
            out[at] = np.einsum("ti,ti->t", x[at], np.linalg.solve(r, x[at][:, :, None])[:, :, 0])
        out[(t < min_corr) | (n < least)] = np.nan
        return out

    def run(batches):
        key, n0, s0, q0 = None, 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            ids, t = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            x = np.array([[np.nan if v is None else v for v in r] for r in batch.column(3).to_pylist()], float).reshape(-1, d)
            out, a = np.full(len(ids), np.nan), 0
            while a < len(ids):
                b = a + 1
                while b < len(ids) and ids[b] == ids[a]:
                    b += 1
                if ids[a] != key:
                    key, n0, s0, q0 = ids[a], 0, np.zeros(d), np.zeros((d, d))
                part = x[a:b]
                whole = ~np.isnan(part).any(1)
                clean = np.where(whole[:, None], part, 0)
                n = n0 + np.cumsum(whole)
                s, q = s0 + np.cumsum(clean, 0), q0 + np.cumsum(np.einsum("ti,tj->tij", clean, clean), 0)
                shifted = lambda first, run: np.concatenate([np.asarray(first)[None], run[:-1]])
                out[a:b] = forms(part, t[a:b], shifted(n0, n), shifted(s0, s), shifted(q0, q))
                n0, s0, q0, a = int(n[-1]), s[-1], q[-1], b
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, from_pandas=True)], names=[*ROW, "copula"])

    kinds = dict(scores.dtypes)
    made = g.repartition("series_id").sortWithinPartitions("series_id", "t").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ROW) + ", copula double")
    return expanding_z(made, "copula", roll=1, min_expanding=min_expanding)


def pca_composite(scores: DataFrame, methods: list[str], min_window: int = 252) -> DataFrame:
    """|first principal component| of a row's channels, fitted on all complete rows before it; the mean of what is there until `min_window` of them, and in incomplete rows.

    Running moments of complete rows come from blocked sums; a batch's eigenproblems are solved together.
    """
    import numpy as np
    import pyarrow as pa

    from .features import prefix_moments

    wide = scores.groupBy(*ROW).pivot("method", methods).agg(F.max("score"))
    wide = wide.select(*ROW, F.array(*[F.col(f"`{m}`") for m in methods]).alias("x"))
    wide = wide.withColumn("_whole", ~F.exists("x", lambda v: v.isNull()))
    known = F.filter("x", lambda v: v.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))
    wide = wide.withColumn("_mean", mean).withColumn("_c", F.when(F.col("_whole"), F.count(F.when(F.col("_whole"), 1)).over(ordered()) - 1))
    clean = wide.where("_whole").select("series_id", F.col("_c").alias("t"), "x")
    flat = F.array_sort(F.collect_list(F.struct("i", "j", "n", "sx", "sy", "sxy")))  # pairs of channels
    past_sums = prefix_moments(clean).groupBy("series_id", (F.col("t") + 1).alias("_c")).agg(flat.alias("_m"))
    d = len(methods)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            x, m, mean, n = (batch.column(names.index(c)).to_pylist() for c in ("x", "_m", "_mean", "t"))
            out = list(mean)
            at = [k for k in range(len(x)) if m[k] and n[k] >= min_window and m[k][0]["n"] >= min_window]
            if at:
                cov, centre = np.zeros((len(at), d, d)), np.zeros((len(at), d))
                for r, k in enumerate(at):
                    for q in m[k]:
                        i, j, c = q["i"], q["j"], q["n"]
                        cov[r, i, j] = cov[r, j, i] = q["sxy"] / c - q["sx"] / c * q["sy"] / c
                        centre[r, i] = q["sx"] / c
                        centre[r, j] = q["sy"] / c
                top = np.linalg.eigh(cov)[1][:, :, -1]
                for r, k in enumerate(at):
                    out[k] = float(abs(top[r] @ (np.array(x[k]) - centre[r])))
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in ROW], pa.array(out, pa.float64())], names=[*ROW, "pca"])

    j = wide.join(past_sums, ["series_id", "_c"], "left").select(*ROW, "x", "_m", "_mean")
    kinds = dict(scores.dtypes)
    return j.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ROW) + ", pca double")
