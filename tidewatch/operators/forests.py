"""Random forests as keyed jobs: every tree, or every refit, grows in a group of bounded size; none is a driver's loop."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a forest that tasks may hold whole.
FOREST_BYTES = 256 << 20


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, tries: int | None = None) -> np.ndarray:
    """Nodes (feature or -1, threshold, left, right, share of ones) of a classification tree: each node takes the split of least Gini impurity among `tries` random features (the root of their number, if not given; more until one can be split)."""
    tries = tries or max(1, int(np.sqrt(x.shape[1])))
    nodes, todo = [[-1.0, 0.0, -1.0, -1.0, 0.0]], [(0, np.arange(len(y)), 0)]
    while todo:
        at, rows, level = todo.pop()
        ones = y[rows].sum()
        nodes[at][4] = ones / len(rows)
        if level == depth or ones in (0, len(rows)):
            continue
        best = None
        for looked, f in enumerate(rng.permutation(x.shape[1])):
            if looked >= tries and best is not None:
                break
            by = rows[np.argsort(x[rows, f], kind="stable")]
            v, left = x[by, f], np.cumsum(y[by])[:-1]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            n = cut + 1.0
            a, b = left[cut], ones - left[cut]
            impurity = a * (n - a) / n + b * (len(by) - n - b) / (len(by) - n)
            k = int(impurity.argmin())
            if best is None or impurity[k] < best[0]:
                best = (impurity[k], int(f), (v[cut[k]] + v[cut[k] + 1]) / 2)
        if best is None:
            continue
        low = x[rows, best[1]] <= best[2]
        nodes[at][:4] = best[1], best[2], len(nodes), len(nodes) + 1
        todo += [(len(nodes), rows[low], level + 1), (len(nodes) + 1, rows[~low], level + 1)]
        nodes += [[-1.0, 0.0, -1.0, -1.0, 0.0], [-1.0, 0.0, -1.0, -1.0, 0.0]]
    return np.array(nodes)


def tree_shares(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of ones where each row ends."""
    at = np.zeros(len(x), int)
    while True:
        f = nodes[at, 0].astype(int)
        live = np.flatnonzero(f >= 0)
        if not len(live):
            return nodes[at, 4]
        low = x[live, f[live]] <= nodes[at[live], 1]
        at[live] = np.where(low, nodes[at[live], 2], nodes[at[live], 3]).astype(int)


def _seeded(*parts) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32("|".join(map(str, parts)).encode()))


def _forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Trees on bootstrap samples."""
    picks = (rng.integers(0, len(y), len(y)) for _ in range(trees))
    return [grow_tree(x[p], y[p], depth, rng) for p in picks]


def rolling_forest(df: DataFrame, x: str, level: str, threshold: float, train: int = 250, refit: int = 21, trees: int = 50, depth: int = 5, least: int = 10, seed: int = 42) -> DataFrame:
    """series_id, t, refit_t, p: P(level > threshold) of each row by a forest of the `train` rows before refit_t, the last refit up to the row.

    Refits come at rows train, train + refit, ... of a series (t from 0); each is a group of train +
    refit rows, so a row travels about train / refit times. Rows with a null component have no p and train
    nothing, rows with a null level train nothing; with fewer than `least` training rows p is null,
    with one class 0, as no forest is grown. Rows before the first refit are left out.
    """
    last = F.floor((F.col("t") - train) / refit)
    rows = df.select("series_id", "t", F.col(x).alias("x"), (F.col(level) > threshold).cast("double").alias("y"))
    test = rows.where(F.col("t") >= train).withColumn("k", last).withColumn("fit", F.lit(False))
    learn = rows.withColumn("k", F.explode(F.sequence(F.greatest(last + 1, F.lit(0)), F.floor(F.col("t") / refit)))).withColumn("fit", F.lit(True))

    def run(table: pa.Table) -> pa.Table:
        series, k = table.column("series_id")[0].as_py(), table.column("k")[0].as_py()
        t, fit = table.column("t").to_numpy(), table.column("fit").to_numpy(zero_copy_only=False)
        y = table.column("y").to_numpy(zero_copy_only=False).astype(float)
        xs = table.column("x").to_pylist()
        clean = np.array([v is not None and all(c is not None for c in v) for v in xs], bool)
        d = max([len(v) for v in xs if v is not None], default=1)
        m = np.array([v if c else [0.0] * d for v, c in zip(xs, clean)], float)
        use = fit & clean & ~np.isnan(y)
        at = np.flatnonzero(~fit)
        p = np.full(len(at), np.nan)
        ok = clean[at]
        if use.sum() >= least and ok.any():
            order = np.flatnonzero(use)[np.argsort(t[use])]
            p[ok] = 0.0
            if 0 < y[order].sum() < len(order):
                forest = _forest(m[order], y[order], trees, depth, _seeded(seed, series, k))
                p[ok] = np.mean([tree_shares(tree, m[at][ok]) for tree in forest], axis=0)
        return pa.table({"series_id": pa.array([series] * len(at), pa.string()), "t": pa.array(t[at], pa.int64()), "refit_t": pa.array([train + k * refit] * len(at), pa.int64()), "p": pa.array(p, from_pandas=True)})

    return test.unionByName(learn).groupBy("series_id", "k").applyInArrow(run, "series_id string, t long, refit_t long, p double")


def held_out_forest(df: DataFrame, x: str, label: str | Column, held: str, names: list[str], trees: int = 200, depth: int = 6, sample: int = 4096, seed: int = 1) -> DataFrame:
    """event, series_id, t, p: forests grown without the rows whose `held` is each of `names`, scoring all rows.

    A tree grows in a group of its own, on a bootstrap of at most about `sample` rows that a hash draws for it (all of
    them, if there are no more): a bound on the training set, by parameter. The trees of all forests are
    of bounded size (checked) and travel to the rows. A training set of one class scores 0. Rows with a
    null component train nothing and have a null p.
    """
    bytes_ = len(names) * trees * 2 ** (depth + 1) * 40
    if bytes_ > FOREST_BYTES:
        raise ValueError(f"forests of {bytes_} bytes are too large to be held by a task: fewer names, trees or levels")
    clean = F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull())
    rows = df.select("series_id", "t", F.col(held).alias("held"), F.col(x).cast("array<double>").alias("x"), (label if isinstance(label, Column) else F.col(label)).cast("double").alias("y"), clean.alias("clean"))
    good = rows.where("clean and y is not null")
    n = good.count()
    drawn = lambda j: F.pmod(F.xxhash64(F.lit(seed), j, F.col("series_id"), F.col("t")), F.lit(max(n, 1))) < sample
    picked = good.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(1), F.lit(trees)), drawn)))
    every = F.array(*[F.lit(v) for v in names])
    picked = picked.withColumn("event", F.explode(F.filter(every, lambda e: ~e.eqNullSafe(F.col("held")))))

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by([("series_id", "ascending"), ("t", "ascending")])
        event, tree = table.column("event")[0].as_py(), table.column("tree")[0].as_py()
        y, m = table.column("y").to_numpy(), np.array(table.column("x").to_pylist(), float)
        made = _forest(m, y, 1, depth, _seeded(seed, event, tree))[0] if 0 < y.sum() < len(y) else np.array([[-1.0, 0, -1, -1, 0.0]])
        return pa.table({"event": pa.array([event], pa.string()), "tree": pa.array([tree], pa.int32()), "nodes": pa.array([made.ravel().tolist()], pa.list_(pa.float64()))})

    grown = picked.select("event", "tree", "series_id", "t", "x", "y").groupBy("event", "tree").applyInArrow(grow, "event string, tree int, nodes array<double>").toArrow()
    forests: dict[str, list[np.ndarray]] = {v: [] for v in names}
    for event, nodes in sorted(zip(grown.column("event").to_pylist(), grown.column("nodes").to_pylist()), key=lambda r: r[0]):
        forests[event].append(np.array(nodes).reshape(-1, 5))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = batch.column("clean").to_numpy(zero_copy_only=False)
            xs = batch.column("x").to_pylist()
            m = np.array([v for v, c in zip(xs, ok) if c], float)
            for event, trees_ in forests.items():
                p = np.full(len(ok), np.nan)
                if len(m):
                    p[ok] = np.mean([tree_shares(tree, m) for tree in trees_], axis=0) if trees_ else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([event] * len(ok), pa.string()), batch.column("series_id"), batch.column("t"), pa.array(p, from_pandas=True)], names=["event", "series_id", "t", "p"])

    return rows.select("series_id", "t", "x", "clean").mapInArrow(score, "event string, series_id string, t long, p double")
