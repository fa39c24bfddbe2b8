"""Exact top-k and approximate neighbours against brute force, and on odd vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import hnsw, topk

from .conftest import plain

VEC = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VEC)


ODD = [(20, None), (21, [1.0, None]), (22, [1.0, math.nan]), (23, [math.inf, 1.0]), (24, []), (None, [1.0, 2.0])]


def random_rows(n, d=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=d).astype(np.float32).tolist()) for i in range(n)]


def test_topk_matches_sql(spark, in_duckdb):
    rows = random_rows(300) + [(i, random_rows(1)[0][1]) for i in range(1000, 1040)] + ODD
    df = vectors(spark, rows).withColumn("rank", F.lit(1)).withColumn("v", F.lit("x")).withColumn("cb", F.lit(2))
    for cells in ({}, {"candidates": 50, "queries": 4}):
        out = topk.top_k(df, **cells)
        got = out.collect()
        assert plain(got) == plain(in_duckdb(topk.oracle(), out.columns, embeddings=df))


def test_topk_ties_few_rows_and_widths(spark):
    got = topk.top_k(vectors(spark, [(0, [1, 1]), (5, [1]), (3, [1, 0]), (7, [-1, 0, 9]), *ODD]), k=5).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 3, 4096), (0, 2, 5, 4096), (0, 3, 7, -4096)]
    assert topk.top_k(vectors(spark, [])).count() == 0
    assert topk.top_k(vectors(spark, [(0, [0, 0]), (1, [1, 1]), (2, [2, 2])]), k=1).collect()[0].vec_id == 1
    repeated = topk.top_k(vectors(spark, [(0, [1, 0]), (0, [2, 0]), (3, [1, 0]), (3, [1, 0])])).collect()
    assert [(r.vec_id, r.score) for r in sorted(repeated, key=lambda r: r.rank)] == [(3, 4096), (3, 4096)]


def test_topk_of_large_components(spark):
    """Components and scores beyond doubles' whole numbers and beyond a long; the width changes with the queries."""
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(0, [1e12, 3.3]), (20, [2.0**60, -1.0]), (40, [1e300, -1e308]), (60, [0.5, 0.25, 0.125]), (1, [1e12, -7.0]), (2, [2.0**47 + 1, 2.0]), (3, [1.0, 1.0]), (4, [-1e308, 1.0]), (5, [0.0])]
    got = topk.top_k(spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in rows], schema), k=4, candidates=3, queries=2).collect()
    from fractions import Fraction

    ints = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in rows}
    for q in (0, 20, 40, 60):
        scores = sorted((-min(max(sum(a * b for a, b in zip(ints[q], v)), -(2**63)), 2**63 - 1), i) for i, v in ints.items() if i != q)[:4]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in scores]


def test_topk_of_long_vectors_and_repeats(spark):
    rows = [(i, [math.sin(i * 31 + j) for j in range(3000)]) for i in range(45)] + [(7, [1.0] * 3000)] * 3
    df = vectors(spark, rows).withColumn("qb", F.lit("x")).withColumn("data", F.lit("x")).withColumn("ids", F.lit(1))
    got = topk.top_k(df, k=3, candidates=20, queries=2).collect()
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float))
    ids = np.array([i for i, _ in rows])
    for q in (0, 20, 40):
        scores = x @ x[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:3]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(ids[i], scores[i]) for i in order]


def test_threshold_stops_early():
    """Skewed lists: far from all rows are scored, and the result is that of scoring all."""
    rng = np.random.default_rng(1)
    rows = np.floor(64 * rng.normal(size=(4000, 6)) * np.exp(rng.normal(size=(4000, 1)) * 1.5))
    lists = topk.SortedLists(np.arange(4000), rows)
    queries = np.floor(64 * rng.normal(size=(30, 6)))
    scored = []
    for q, (best, ids, n) in zip(queries, lists.search(queries, np.full(30, -1), 10)):
        scored.append(n)
        want = rows @ q
        order = np.lexsort((np.arange(4000), -want))[:10]
        assert ids.tolist() == order.tolist() and best.tolist() == want[order].tolist()
    assert np.median(scored) < 2000


def cosines(rows, every, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    c = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    out = {}
    for a, i in enumerate(ids):
        if i % every == 0:
            others = np.flatnonzero(ids != i)
            out[int(i)] = [(int(ids[b]), c[a, b]) for b in others[np.lexsort((ids[others], -c[a, others]))[:k]]]
    return out


@pytest.mark.parametrize("shard", [None, 150])
def test_neighbours_recall(spark, shard):
    rows = random_rows(900, 24)
    df = vectors(spark, rows + [*ODD, (25, [0.0] * 24)]).withColumn("shard", F.lit("x"))
    got = {}
    for r in hnsw.nearest(df, every=15, shard=shard).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = cosines(rows, 15, 5)
    assert set(got) == set(want)
    found = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert found >= 0.95 * 5 * len(want)
    exact = {(q, v): s for q, pairs in cosines(rows, 15, 900).items() for v, s in pairs}
    for q, hits in got.items():
        hits.sort()
        assert [r for r, _, _ in hits] == [1, 2, 3, 4, 5]
        assert all(abs(s - exact[q, v]) < 1e-12 for _, v, s in hits)
        assert [s for _, _, s in hits] == sorted((s for _, _, s in hits), reverse=True)


def test_neighbours_of_odd_magnitudes(spark):
    """Squares of these over- and underflow; cosines are those of the vectors all the same."""
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(0, [1e-200, 1e-200]), (50, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1.0, 0.0]), (3, [5e-324, 5e-324]), (4, [1.7e308, -1.7e308])]
    got = hnsw.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], schema)).collect()
    by = {q: [(r.vec_id, round(r.score, 9)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 50)}
    assert by[0] == [(3, 1.0), (50, 1.0), (1, 0.707106781), (2, 0.707106781), (4, 0.0)]
    assert by[50] == [(0, 1.0), (3, 1.0), (1, 0.707106781), (2, 0.707106781), (4, 0.0)]


def test_neighbours_recall_on_the_table(spark, data):
    """All queries of a whole table against brute force: at least 0.9, in several shards too."""
    df = spark.read.parquet(data.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {q: {v for v, _ in pairs} for q, pairs in cosines(rows, 50, 5).items()}
    for shard in (None, 500):
        got = {}
        for r in hnsw.nearest(df, shard=shard).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * 5 * len(want)


def test_neighbours_of_copies_and_few_rows(spark):
    same = [1.0, 2.0, 3.0]
    got = hnsw.nearest(vectors(spark, [(i, same) for i in range(400)] + [(1000, [3.0, 1.0, 0.0])]), every=50).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 50, 1000)}
    assert by == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 1000: [0, 1, 2, 3, 4]}
    few = hnsw.nearest(vectors(spark, [(0, [1, 0]), (1, [1, 1]), (2, [0, 1])]), every=50).collect()
    assert [(r.vec_id, round(r.score, 6)) for r in sorted(few, key=lambda r: r.rank)] == [(1, 0.707107), (2, 0.0)]
    assert hnsw.nearest(vectors(spark, [])).count() == 0


def test_graph_levels_and_links():
    rows = np.random.default_rng(3).normal(size=(500, 10))
    made = hnsw.build(np.arange(500), rows)
    assert made["nodes"][0] == 500 and sorted(made["nodes"], reverse=True) == made["nodes"] and len(made["nodes"]) >= 2
    base = np.frombuffer(made["neighbours"][0], np.int32).reshape(500, -1)
    assert base.shape[1] == 32 and ((base >= -1) & (base < 500)).all() and (base >= 0).any(1).all()
    assert all(len({x for x in r if x >= 0}) == (r >= 0).sum() and i not in r for i, r in enumerate(base))
