"""Model fitting as Spark jobs: keyed fits in Arrow groups, pyspark.ml where it has the model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.windows import expanding_z, ordered


def _series(fit, df: DataFrame, x: str, out: str, keys=("series_id",)) -> DataFrame:
    """One fit a key over its ordered values; `fit` maps the array (nulls dropped) to as many values."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        v = pdf[x].to_numpy(float)
        ok = ~np.isnan(v)
        got = np.full(len(v), np.nan)
        if ok.sum() >= 20:
            got[ok] = fit(v[ok])
        return pd.DataFrame({k: pdf[k] for k in (*keys, "t")} | {out: [None if np.isnan(g) else g for g in got]})

    kinds = dict(df.dtypes)
    fitted = df.select(*keys, "t", x).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in (*keys, "t")) + f", {out} double")
    return df.join(fitted, [*keys, "t"])


def _filter(log_like: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Scaled forward pass: filtered probabilities and log-likelihood."""
    n, k = log_like.shape
    alpha, total, p = np.empty((n, k)), 0.0, start
    for t in range(n):
        top = log_like[t].max()
        a = (p if t == 0 else p @ trans) * np.exp(log_like[t] - top)
        s = a.sum() + 1e-300
        p = alpha[t] = a / s
        total += np.log(s) + top
    return alpha, total


def hmm2(v: np.ndarray, ar: bool = False, rounds: int = 40) -> np.ndarray:
    """P(high-variance state) of a two-state Gaussian model (AR(1) emissions if ar), by expectation maximisation; smoothed, so it looks ahead."""
    lag = np.concatenate([[v[0]], v[:-1]]) if ar else np.zeros(len(v))
    mu, phi = np.full(2, v.mean()), np.zeros(2)
    sd = np.array([0.5, 2.0]) * max(v.std(), 1e-9)
    trans, start = np.array([[0.95, 0.05], [0.05, 0.95]]), np.full(2, 0.5)
    gamma = None
    for _ in range(rounds):
        mean = mu + phi * lag[:, None]
        ll = -0.5 * ((v[:, None] - mean) / sd) ** 2 - np.log(sd)
        alpha, _ = _filter(ll, trans, start)
        beta = np.ones((len(v), 2))
        like = np.exp(ll - ll.max(1, keepdims=True))
        for t in range(len(v) - 2, -1, -1):
            b = trans @ (like[t + 1] * beta[t + 1])
            beta[t] = b / (b.sum() + 1e-300)
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True) + 1e-300
        xi = alpha[:-1, :, None] * trans[None] * (like[1:] * beta[1:])[:, None, :]
        xi /= xi.sum((1, 2), keepdims=True) + 1e-300
        trans = xi.sum(0) + 1e-3
        trans /= trans.sum(1, keepdims=True)
        start = gamma[0]
        for k in range(2):
            w = gamma[:, k]
            if ar:
                xm, ym = np.average(lag, weights=w + 1e-12), np.average(v, weights=w + 1e-12)
                phi[k] = np.sum(w * (lag - xm) * (v - ym)) / (np.sum(w * (lag - xm) ** 2) + 1e-12)
                mu[k] = ym - phi[k] * xm
            else:
                mu[k] = np.average(v, weights=w + 1e-12)
            sd[k] = max(np.sqrt(np.average((v - mu[k] - phi[k] * lag) ** 2, weights=w + 1e-12)), 1e-9)
    return gamma[:, int(sd[1] >= sd[0])]


def hidden_regimes(df: DataFrame, x: str = "ret", ar: bool = False) -> DataFrame:
    """p_high: probability of the high-variance state."""
    return _series(lambda v: hmm2(v, ar), df, x, "p_high")


#: Centre and half-widths of the first search (see garch_candidates), and places tried on each side.
_GARCH_START = ((-2.3, 0.3, -3.0), (2.2, 0.29, 3.0), 3)


def garch_candidates(centre: np.ndarray, width: np.ndarray, side: int = 2) -> np.ndarray:
    """Points (log of 1 less the persistence, share of alpha in it, log of omega in variances) of a grid around a centre, inside their bounds."""
    steps = np.linspace(-1, 1, 2 * side + 1)
    grid = np.stack(np.meshgrid(steps, steps, steps, indexing="ij"), -1).reshape(-1, 3)
    return np.clip(centre + grid * width, (-9.0, 1e-4, -16.0), (-1e-3, 0.9999, 2.0))


def garch_fit(df: DataFrame, keep, x: str = "ret", rounds: int = 14, least: int = 50) -> DataFrame:
    """series_id, alpha, beta, omega, mean, nll: GARCH(1,1) of greatest Gaussian likelihood for every series, around its mean.

    Each round tries a grid of parameters for all series in one pass: a series' rows stream in time
    order through one task, with one variance a candidate for its state. The grid of the next round
    lies around the best candidate and is half as wide, unless the best lay in the grid's outer part.
    A series with fewer than `least` values has the decay of an EWMA (omega 0, alpha 0.06, beta 0.94)
    and a null nll. Null values are left out. `keep` writes a table and reads it back: `df` is computed once, whatever the rounds.
    """
    centre, width, side = _GARCH_START
    pairs = lambda values: F.array(*[F.lit(float(v)) for v in values])
    rows = keep(df.where(F.col(x).isNotNull()).select("series_id", "t", F.col(x).cast("double").alias("r")))
    stats = keep(rows.groupBy("series_id").agg(F.avg("r").alias("mean"), F.greatest(F.var_pop("r"), F.lit(1e-18)).alias("var"), F.count(F.lit(1)).alias("n")))
    fits = stats.withColumn("centre", pairs(centre)).withColumn("width", pairs(width)).withColumn("nll", F.lit(None).cast("double"))

    def params(at: np.ndarray, var: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, share = 1 - np.exp(at[:, 0]), at[:, 1]
        return var * np.exp(at[:, 2]), p * share, p * (1 - share)

    def search(n_side: int):
        def run(batches):
            held = None

            def close():
                at, width_, nll = held["at"], held["width"], held["nll"]
                best = at[int(nll.argmin())]
                moved = np.abs(best - held["centre"]) > width_ * 0.51
                return (held["key"], best.tolist(), (width_ if moved.any() and n_side == 2 else width_ / 2).tolist(), float(nll.min()))

            def batch_of(out):
                return pd.DataFrame(out, columns=["series_id", "centre", "width", "nll"])

            for pdf in batches:
                out = []
                for key, r, var, c, w in zip(pdf["series_id"], pdf["r"], pdf["var"], pdf["centre"], pdf["width"]):
                    if held is None or key != held["key"]:
                        if held is not None:
                            out.append(close())
                        at = garch_candidates(np.asarray(c), np.asarray(w), n_side)
                        omega, alpha, beta = params(at, var)
                        held = {"key": key, "at": at, "width": np.asarray(w), "centre": np.asarray(c), "p": (omega, alpha, beta), "s": np.full(len(at), var), "nll": np.zeros(len(at))}
                    omega, alpha, beta = held["p"]
                    s = held["s"]
                    held["nll"] += 0.5 * (np.log(s) + r * r / s)
                    held["s"] = omega + alpha * (r * r) + beta * s
                if out:
                    yield batch_of(out)
            if held is not None:
                yield batch_of([close()])

        return run

    schema = "series_id string, centre array<double>, width array<double>, nll double"
    for k in range(rounds):
        tried = fits.where(F.col("n") >= least).select("series_id", "mean", "var", "centre", "width")
        at = rows.join(tried, "series_id").withColumn("r", F.col("r") - F.col("mean")).repartition("series_id").sortWithinPartitions("series_id", "t")
        found = at.mapInPandas(search(side if k == 0 else 2), schema)
        fits = keep(stats.join(found, "series_id", "left"))
    p, share, scale = 1 - F.exp(F.element_at("centre", 1)), F.element_at("centre", 2), F.exp(F.element_at("centre", 3))
    ok = F.col("nll").isNotNull()
    return fits.select(
        "series_id", F.when(ok, p * share).otherwise(0.06).alias("alpha"), F.when(ok, p * (1 - share)).otherwise(0.94).alias("beta"),
        F.when(ok, F.col("var") * scale).otherwise(0.0).alias("omega"), "mean", "nll",
    )


def garch_vol(df: DataFrame, fits: DataFrame, x: str = "ret", min_expanding: int = 60) -> DataFrame:
    """sigma, the conditional deviation of fitted parameters before each row, by an ordered fold; and its positive z. A null value counts as the mean."""
    from tidewatch.functions.folds import ordered_fold

    start = df.groupBy("series_id").agg(F.greatest(F.var_pop(x), F.lit(1e-18)).alias("_v"))
    rows = df.join(fits.select("series_id", "alpha", "beta", "omega", F.col("mean").alias("_mean")), "series_id").join(start, "series_id")
    rows = rows.withColumn("_r", F.coalesce(F.col(x) - F.col("_mean"), F.lit(0.0)))

    def step(state, row):
        r, alpha, beta, omega, var = row
        s = var if state[0] is None else state[0]
        if s is None:
            return (None,), (None,)
        return (omega + alpha * r * r + beta * s,), (s**0.5,)

    out = ordered_fold(rows, ["_r", "alpha", "beta", "omega", "_v"], lambda: (None,), step, "sigma double").drop("_r", "_v", "_mean", "alpha", "beta", "omega")
    return expanding_z(out, "sigma", roll=1, min_expanding=min_expanding, form="positive")


def isolation_scores(df: DataFrame, x: str = "x", trees: int = 100, sample: int = 256, seed: int = 1) -> DataFrame:
    """anomaly: isolation-forest score in 0..1, min-max rescaled within the series (which looks ahead).

    Every tree grows in its own group from the rows of smallest hash (a bounded sample by design);
    the small trees are then broadcast, their number and depth being parameters.
    """
    h = F.xxhash64(F.lit(seed), "tree", "series_id", "t")
    rank = F.row_number().over(Window.partitionBy("series_id", "tree").orderBy(h))
    few = df.select("series_id", "t", x).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_k", rank).where(F.col("_k") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = np.array(pdf.sort_values("_k")[x].tolist(), float)
        rng = np.random.default_rng(int(pdf["tree"].iloc[0]) * 7919 + seed)
        nodes = []

        def split(rows, depth):
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, len(rows)])
            lo, hi = rows.min(0), rows.max(0)
            dims = np.flatnonzero(hi > lo)
            if len(rows) > 1 and depth < 8 and len(dims):
                d = int(rng.choice(dims))
                cut = float(rng.uniform(lo[d], hi[d]))
                nodes[at][:2] = d, cut
                nodes[at][2], nodes[at][3] = split(rows[rows[:, d] < cut], depth + 1), split(rows[rows[:, d] >= cut], depth + 1)
            return at

        split(pts, 0)
        n = np.array(nodes, float)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "tree": [pdf["tree"].iloc[0]], "nodes": [n.ravel().tolist()], "rows": [len(pts)]})

    forest = few.groupBy("series_id", "tree").applyInPandas(grow, "series_id string, tree int, nodes array<double>, rows int")
    packed = forest.groupBy("series_id").agg(F.collect_list(F.struct("nodes", "rows")).alias("forest"))  # `trees` entries

    def depth(pdf_iter):
        c = lambda n: 2 * (np.log(max(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n if n > 1 else 0.0
        for pdf in pdf_iter:
            out = []
            for f, v in zip(pdf["forest"], pdf[x]):
                total, size = 0.0, 1
                for tr in f:
                    n, size = np.asarray(tr["nodes"]).reshape(-1, 5), tr["rows"]
                    at = d = 0
                    while n[at, 0] >= 0:
                        at, d = int(n[at, 2] if v[int(n[at, 0])] < n[at, 1] else n[at, 3]), d + 1
                    total += d + c(n[at, 4])
                out.append(2.0 ** (-total / len(f) / max(c(size), 1e-9)))
            yield pdf[["series_id", "t"]].assign(raw=out)

    scored = df.select("series_id", "t", x).join(packed, "series_id").mapInPandas(depth, "series_id string, t long, raw double")
    w = Window.partitionBy("series_id")
    lo, hi = F.min("raw").over(w), F.max("raw").over(w)
    return scored.withColumn("anomaly", F.when(hi > lo, (F.col("raw") - lo) / (hi - lo)).otherwise(0.0))


def _assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.array(*cols)))


def logistic_stacking(df: DataFrame, cols: list[str], label: str, train_rows: int, c: float = 0.1) -> DataFrame:
    """p of an L2 logistic model of score columns fitted on rows t < train_rows; equal weights with too few rows or one class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    x = _assembled(df.fillna(0.0, cols), cols).withColumn("label", F.col(label).cast("double"))
    train = x.where(F.col("t") < train_rows)
    n, k = train.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
    if n < 20 or k < 2:
        total = sum((F.col(v) for v in cols), F.lit(0.0)) / len(cols)
        return x.withColumn("p", 1 / (1 + F.exp(-total))).drop("features", "label")
    model = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0).fit(train)
    return model.transform(x).withColumn("p", vector_to_array("probability")[1]).drop("features", "label", "rawPrediction", "probability", "prediction")


def boosted_stacking(df: DataFrame, cols: list[str], label: str, train_rows: int, rounds: int = 10) -> DataFrame:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    x = _assembled(df.fillna(0.0, cols), cols).withColumn("label", F.col(label).cast("double"))
    model = GBTClassifier(maxIter=rounds, maxDepth=3, seed=1).fit(x.where(F.col("t") < train_rows))
    return model.transform(x).withColumn("p", vector_to_array("probability")[1]).drop("features", "label", "rawPrediction", "probability", "prediction")


def k_means(x: np.ndarray, k: int, starts: int = 10, rounds: int = 100, seed: int = 42) -> np.ndarray:
    """Centres of least total squared distance over several seeded starts, each centre begun far from those before."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))]])
        for _ in range(rounds):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            moved = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
            if np.allclose(moved, c, rtol=0, atol=1e-12):
                break
            c = moved
        cost = ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
        if best is None or cost < best[0] - 1e-12:
            best = (cost, c)
    return best[1]


def ridge_shares(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Absolute ridge coefficients of all columns together (free intercept), as shares; equal ones when all are 0."""
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.abs(np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc))
    return w / w.sum() if w.sum() > 1e-12 else np.full(len(w), 1 / len(w))


def regime_adaptive(scores: DataFrame, labels: DataFrame, methods: list[str], clusters: int = 3, least: int = 252, every: int = 63, roll: int = 15, min_expanding: int = 60, keep_rows: int = 4096) -> DataFrame:
    """series_id, ts, t, regime, fused, score: channels weighted by what they told in the row's regime so far.

    Refits come at rows least, least + every, ... of a series. Each clusters the rows before it by five
    features of a row's channels (deviation, largest absolute value, share above 1, deviation averaged over 20
    rows, mean absolute value; nulls count 0, but for the deviation) and fits labels (series_id, t,
    label) on all channels of each cluster by ridge; shares of absolute coefficients are its weights.
    A cluster with under 20 rows or one label, and a refit with under ten usable rows a cluster, weighs
    channels alike. A refit learns from at most keep_rows rows before it, those of least hash: a
    bounded group, the whole past of a series that is not longer. Rows take the last refit before them (as-of
    join); rows before the first are null. score is the smoothed z-score.
    """
    import pyarrow as pa

    from tidewatch.functions.windows import last_n

    from .joins import asof

    wide = scores.groupBy("series_id", "ts", "t").pivot("method", methods).agg(F.max("score"))
    known = F.array_compact(F.array(*[F.col(f"`{m}`") for m in methods]))
    zero = F.array(*[F.coalesce(F.col(f"`{m}`"), F.lit(0.0)) for m in methods])
    d = len(methods)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total(known) / F.size(known)
    spread = F.when(F.size(known) > 0, F.sqrt(total(F.transform(known, lambda v: F.pow(v - mean, 2))) / F.size(known)))
    x = wide.select("series_id", "ts", "t", zero.alias("x"), spread.alias("_sd"))
    size = F.transform("x", F.abs)
    meta = F.array("_sd", F.array_max(size), F.size(F.filter("x", lambda v: v > 1.0)) / F.lit(float(d)), F.avg("_sd").over(last_n(ordered(), 20)), total(size) / d)
    x = x.withColumn("meta", F.when(F.col("_sd").isNotNull(), meta)).drop("_sd")
    learn = x.join(labels.select("series_id", "t", F.col("label").cast("double").alias("label")), ["series_id", "t"], "left")
    learn = learn.withColumn("_last", F.floor((F.max("t").over(Window.partitionBy("series_id")) - least) / every)).withColumn("_first", F.greatest(F.lit(0), F.floor((F.col("t") - least) / every) + 1))
    learn = learn.where("_first <= _last").withColumn("_k", F.explode(F.sequence("_first", "_last")))
    place = F.row_number().over(Window.partitionBy("series_id", "_k").orderBy(F.xxhash64("t"), "t"))
    learn = learn.withColumn("_n", place).where(F.col("_n") <= keep_rows).select("series_id", (least + F.col("_k") * every).cast("long").alias("refit_t"), "t", "x", "meta", "label")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        xs, ms, y = np.array(table.column("x").to_pylist(), float), table.column("meta").to_pylist(), table.column("label").to_numpy(zero_copy_only=False).astype(float)
        ok = np.array([m is not None and any(v != 0 for v in m) for m in ms], bool)
        centres, weights = np.zeros((0, 5)), np.full((1, d), 1 / d)
        if ok.sum() >= clusters * 10:
            m = np.array([v for v, k in zip(ms, ok) if k], float)
            centres = k_means(m, clusters)
            near = ((m[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            weights = np.full((clusters, d), 1 / d)
            for r in range(clusters):
                xr, yr = xs[ok][near == r], y[ok][near == r]
                xr, yr = xr[~np.isnan(yr)], yr[~np.isnan(yr)]
                if len(yr) >= 20 and yr.min() < yr.max():
                    weights[r] = ridge_shares(xr, yr)
        head = table.select(["series_id", "refit_t"]).slice(0, 1)
        return pa.table({"series_id": head.column(0), "refit_t": head.column(1), "centres": [centres.tolist()], "weights": [weights.tolist()]}, schema=pa.schema([("series_id", pa.string()), ("refit_t", pa.int64()), ("centres", pa.list_(pa.list_(pa.float64()))), ("weights", pa.list_(pa.list_(pa.float64())))]))

    fits = learn.groupBy("series_id", "refit_t").applyInArrow(fit, "series_id string, refit_t long, centres array<array<double>>, weights array<array<double>>")
    j = asof(x, fits, "refit_t", ["centres", "weights"], strict=True)
    far = lambda c: total(F.zip_with(c, "meta", lambda a, b: (a - b) * (a - b)))
    spans = F.transform("centres", far)
    regime = F.when((F.size("centres") > 0) & F.col("meta").isNotNull(), F.array_position(spans, F.array_min(spans)).cast("int") - 1).otherwise(0)
    j = j.withColumn("regime", F.when(F.col("weights").isNotNull(), regime))
    j = j.withColumn("fused", F.when(F.col("weights").isNotNull(), total(F.zip_with(F.element_at("weights", F.col("regime") + 1), "x", lambda w, v: w * v))))
    return expanding_z(j.select("series_id", "ts", "t", "regime", "fused"), "fused", roll=roll, min_expanding=min_expanding)


def mahalanobis(df: DataFrame, least: int = 0, ddof: int = 1, ridge: float = 1e-6) -> DataFrame:
    """series_id, ts, t, d2: squared distance to the mean of all rows so far (the row included, ridge added to the diagonal), from d + 2 rows on.

    Running sums by component pair come from blocked windows; a batch's systems are solved together.
    """
    from .features import prefix_moments

    m = prefix_moments(df)
    packs = m.groupBy("series_id", "t").agg(F.array_sort(F.collect_list(F.struct("i", "j", "n", "sx", "sy", "sxy"))).alias("p"))
    x = df.join(packs, ["series_id", "t"]).select("series_id", "t", "x", "p")

    def run(it):
        for pdf in it:
            out, size = np.full(len(pdf), np.nan), pdf["x"].map(len).to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                p = np.array([[(e["n"], e["sx"], e["sy"], e["sxy"]) for e in row] for row in pdf["p"].iloc[at]], float)
                if p.shape[1] != d * (d + 1) // 2:
                    continue
                i, j = np.triu_indices(d)
                n = p[:, 0, 0]
                ok = n >= max(d + 2, least)
                at, p, n = at[ok], p[ok], n[ok]
                if not len(at):
                    continue
                cov = np.zeros((len(at), d, d))
                cov[:, i, j] = cov[:, j, i] = (p[:, :, 3] - p[:, :, 1] * p[:, :, 2] / n[:, None]) / (n[:, None] - ddof)
                mean = p[:, i == j, 1] / n[:, None]
                z = np.stack([np.asarray(v, float) for v in pdf["x"].iloc[at]]) - mean
                out[at] = np.einsum("ti,ti->t", z, np.linalg.solve(cov + ridge * np.eye(d), z[:, :, None])[:, :, 0])
            yield pd.DataFrame({"series_id": pdf["series_id"], "t": pdf["t"], "d2": pd.Series([None if np.isnan(v) else float(v) for v in out], dtype=object)})

    return x.mapInPandas(run, "series_id string, t long, d2 double")


def turbulence(df: DataFrame, min_expanding: int = 60, ridge: float = 1e-6) -> DataFrame:
    """series_id, t, turbulence, score: Mahalanobis distance of a row's vector x, of any length, from all whole rows up to it; absolute z.

    Rows with a null component have none and don't count.
    """
    whole = df.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    place = (F.row_number().over(ordered()) - 1).cast("long")
    numbered = whole.select("series_id", F.col("t").alias("_t"), "x", place.alias("_n")).withColumnRenamed("_n", "t")
    d2 = mahalanobis(numbered.select("series_id", "t", "x"), ddof=0, ridge=ridge).join(numbered.select("series_id", "t", "_t"), ["series_id", "t"])
    out = df.select("series_id", "t").join(d2.select("series_id", F.col("_t").alias("t"), "d2"), ["series_id", "t"], "left")
    out = out.withColumn("turbulence", F.when((F.col("t") >= min_expanding) & F.col("d2").isNotNull(), F.sqrt(F.greatest("d2", F.lit(0.0)))))
    return expanding_z(out.drop("d2"), "turbulence", roll=1, form="abs", min_expanding=min_expanding)


def absorption_ratio(df: DataFrame, window: int = 120, top: int = 1, x: str = "ret") -> DataFrame:
    """ts, ratio: share of the largest eigenvalues of the series' rolling correlation matrix, on dates common to all."""
    from .features import common_dates, renumbered
    from tidewatch.functions.windows import last_n

    c = renumbered(common_dates(df.where(F.col(x).isNotNull())))
    a = c.select("ts", "t", F.col("series_id").alias("s1"), F.col(x).alias("x1"))
    b = c.select("ts", F.col("series_id").alias("s2"), F.col(x).alias("x2"))
    w = last_n(ordered("s1", "s2"), window)
    r = F.when(F.col("s1") == F.col("s2"), 1.0).otherwise(F.corr("x1", "x2").over(w))
    pairs = a.join(b, "ts").withColumn("r", r).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") == window)
    packs = pairs.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("s1", "s2", "r"))).alias("p"))  # series squared

    def run(it):
        for pdf in it:
            out, size = np.zeros(len(pdf)), pdf["p"].map(len).to_numpy()
            for n in np.unique(size):
                at, k = np.flatnonzero(size == n), int(round(n**0.5))
                r = np.array([[0.0 if q["r"] is None else q["r"] for q in p] for p in pdf["p"].iloc[at]]).reshape(-1, k, k)
                e = np.linalg.eigvalsh(np.nan_to_num(r))
                out[at] = e[:, k - top :].sum(1) / np.maximum(e.sum(1), 1e-12)
            yield pdf[["ts"]].assign(ratio=out)

    return packs.mapInPandas(run, f"ts {dict(df.dtypes)['ts']}, ratio double")


def segment_breaks(v: np.ndarray, penalty: float = 3.0, least: int = 10) -> list[int]:
    """Optimal changepoints of mean and variance, by dynamic programming over prefix sums with pruning."""
    n = len(v)
    z = (v - v.mean()) / max(v.std(), 1e-12)
    s, q = np.concatenate([[0], np.cumsum(z)]), np.concatenate([[0], np.cumsum(z * z)])
    best, last, alive = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.array([0])
    best[0] = -penalty * np.log(n)
    for e in range(least, n + 1):
        a = alive[alive <= e - least]
        m = e - a
        var = np.maximum((q[e] - q[a]) / m - ((s[e] - s[a]) / m) ** 2, 1e-8)
        cost = best[a] + m * np.log(var) + penalty * np.log(n)
        k = int(cost.argmin())
        best[e], last[e] = cost[k], a[k]
        keep = a[cost - penalty * np.log(n) <= best[e] + 1e-9]
        alive = np.concatenate([keep, alive[alive > e - least], [e]])
    out, e = [], n
    while e > 0:
        e = last[e]
        if e > 0:
            out.append(int(e))
    return out[::-1]


def structural_breaks(df: DataFrame, x: str = "ret") -> DataFrame:
    """Inverse distance to the nearest changepoint of the whole series (which looks ahead), and its z."""

    def fit(v):
        cps = np.array(segment_breaks(v) or [-1])
        t = np.arange(len(v))
        return 1.0 / (1.0 + np.abs(t[:, None] - cps[None, :]).min(1)) if cps[0] >= 0 else np.zeros(len(v))

    return expanding_z(_series(fit, df, x, "nearness"), "nearness", roll=5)


def bocpd(v: np.ndarray, hazard: float = 1 / 250, cap: int = 500) -> np.ndarray:
    """Probability of a run shorter than four rows, by the run-length recursion with a constant hazard.

    A run of r rows is judged by a Student t with the normal-gamma statistics of the last r + 1 rows,
    the current one included; r = 0 has the prior (mean 0, all other parameters 1). Runs are
    followed up to `cap` rows, as the method defines it.
    """
    from math import lgamma

    n_all = np.concatenate([[0.0], np.arange(2, cap + 2)])  # rows behind each run length
    table = np.array([lgamma((2 + n) / 2 + 0.5) - lgamma((2 + n) / 2) for n in n_all])
    cs, cq = (np.concatenate([[0.0], np.cumsum(x)]) for x in (v, v * v))
    p, out = np.zeros(cap + 1), np.empty(len(v))
    p[0] = 1.0
    for t, y in enumerate(v):
        m = min(t + 1, cap)
        n = n_all[:m]
        at = (t + 1 - n).astype(int)
        mean = (cs[t + 1] - cs[at]) / np.maximum(n, 1)
        var = np.where(n > 1, np.maximum((cq[t + 1] - cq[at]) / np.maximum(n, 1) - mean**2, 0.0), 0.0)
        kappa, alpha = 1 + n, 1 + n / 2
        mu, beta = n * mean / kappa, 1 + 0.5 * n * var + 0.5 * n * mean**2 / kappa
        scale, df = np.maximum(beta * (kappa + 1) / (kappa * alpha), 1e-12), 2 * alpha
        like = np.exp(table[:m] - 0.5 * np.log(df * np.pi * scale) - (df + 1) / 2 * np.log1p((y - mu) ** 2 / scale / df))
        grown = p[:m] * like
        p[1 : m + 1] = grown * (1 - hazard)
        p[0] = grown.sum() * hazard
        total = p[: m + 1].sum()
        if total > 0:
            p[: m + 1] /= total
        out[t] = p[: min(4, m + 1)].sum()
    return out


def online_changepoints(df: DataFrame, x: str = "ret", hazard: float = 1 / 250) -> DataFrame:
    """p_short: probability of a run of fewer than four rows."""
    return _series(lambda v: bocpd(v, hazard), df, x, "p_short")


def whitened_changepoints(df: DataFrame, x: str = "ret", hazards: tuple[float, ...] = (63, 21), span: int = 21) -> DataFrame:
    """series_id, t, hazard, whitened, p_short: changepoints of x, and of x over its exponentially weighted deviation, by mean run length."""

    def white(v: np.ndarray) -> np.ndarray:
        d = pd.Series(v).ewm(span=span).std().clip(lower=1e-8)
        return (pd.Series(v) / d).fillna(0.0).to_numpy()

    out = None
    for hazard in hazards:
        for flag, prepare in ((False, lambda v: v), (True, white)):
            one = _series(lambda v, h=hazard, f=prepare: bocpd(f(v), 1 / h), df, x, "p_short").select("series_id", "t", F.lit(float(hazard)).alias("hazard"), F.lit(flag).alias("whitened"), "p_short")
            out = one if out is None else out.unionByName(one)
    return out


def kernel_gap(df: DataFrame, features: int = 32, window: int = 60, gamma: float = 1.0, seed: int = 3) -> DataFrame:
    """Ratio of the two largest eigenvalues of the rolling covariance of random Fourier features of x; absolute z."""
    rng = np.random.default_rng(seed)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        v = np.array(pdf["x"].tolist(), float)
        v = (v - v.mean(0)) / np.maximum(v.std(0), 1e-12)
        w, b = rng.normal(size=(v.shape[1], features)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, features)
        z = np.sqrt(2 / features) * np.cos(v @ w + b)
        out = [None] * len(z)
        for t in range(window - 1, len(z)):
            e = np.linalg.eigvalsh(np.cov(z[t - window + 1 : t + 1].T))
            out[t] = float(e[-1] / max(e[-2], 1e-12))
        return pdf[["series_id", "t"]].assign(gap=out)

    got = df.select("series_id", "t", "x").groupBy("series_id").applyInPandas(fit, "series_id string, t long, gap double")
    return expanding_z(df.join(got, ["series_id", "t"]), "gap", roll=5, form="abs")


def sinkhorn(df: DataFrame, x: str = "ret", window: int = 30, shift: int = 10, reg: float = 0.1, rounds: int = 100) -> DataFrame:
    """Sinkhorn divergence of two shifted past windows; absolute z."""
    w = ordered()
    f = df.withColumn("_a", F.collect_list(x).over(w.rowsBetween(-window, -1))).withColumn("_b", F.collect_list(x).over(w.rowsBetween(-(window + shift), -(shift + 1))))

    def cost(a, b):
        c = (a[:, :, None] - b[:, None, :]) ** 2
        k = np.exp(-c / reg)
        u = np.ones(a.shape)
        for _ in range(rounds):
            v = 1 / (k.transpose(0, 2, 1) @ u[:, :, None])[:, :, 0] / b.shape[1]
            u = 1 / (k @ v[:, :, None])[:, :, 0] / a.shape[1]
        return (u[:, :, None] * k * v[:, None, :] * c).sum((1, 2))

    @F.pandas_udf(T.DoubleType())
    def divergence(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        ok = np.array([len(p) == window and len(q) == window for p, q in zip(a, b)])
        if ok.any():
            p, q = (np.array(s[ok].tolist(), float) for s in (a, b))
            sd = np.maximum(np.concatenate([p, q], 1).std(1, keepdims=True), 1e-12)
            p, q = p / sd, q / sd
            out[ok] = cost(p, q) - (cost(p, p) + cost(q, q)) / 2
        return pd.Series([None if np.isnan(v) else v for v in out], dtype="float64")

    return expanding_z(f.withColumn("_x", divergence("_a", "_b")).withColumn("_x", F.when(~F.isnan("_x"), F.col("_x"))).drop("_a", "_b"), "_x", roll=5, form="abs")


def regression(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """slope, intercept, r2, F statistic and leave-one-out mean absolute error (by leverages) of y on x."""
    ok = df.where(f"{x} is not null and {y} is not null")
    g = ok.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"), F.avg(x).alias("_mx"), F.var_pop(x).alias("_vx"))
    j = ok.join(g, list(keys))
    lev = 1 / F.col("n") + F.pow(F.col(x) - F.col("_mx"), 2) / (F.col("n") * F.col("_vx"))
    loo = j.groupBy(*keys).agg(F.avg(F.abs((F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)) / (1 - lev))).alias("loo_mae"))
    return g.join(loo, list(keys)).withColumn("f_stat", F.col("r2") / (1 - F.col("r2")) * (F.col("n") - 2)).drop("_mx", "_vx")
