"""K2-treap search: against DuckDB and plain sums, with ties, copies, shards and blocks of every kind."""

from __future__ import annotations

import random
from math import floor, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import treap

from .conftest import plain

COLUMNS = ["item_id", "rank", "doc_id", "score"]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 40), st.integers(0, 30)), st.integers(1, 9), min_size=1, max_size=120), st.lists(st.integers(0, 45), unique=True, max_size=8), st.integers(1, 6), st.integers(1, 12))
def test_descent_finds_the_best_columns(points, rows, k, least):
    (r, c), imp = np.array(list(points)).T, np.array(list(points.values()))
    made = treap.Treap(treap.build_treap(r, c, imp, 6))
    weights = np.arange(1, len(rows) + 1)
    score = {}
    for w, row in zip(weights.tolist(), rows):
        for (pr, pc_), v in points.items():
            if pr == row:
                score[pc_] = score.get(pc_, 0) + w * v
    want = sorted(((s, col) for col, s in score.items()), key=lambda x: (-x[0], x[1]))[:k]
    asked = np.array(rows, np.int64)
    assert made.top(asked, weights, k) == want
    assert [x for x in made.top(asked, weights, k, least) if x[0] >= least] == [x for x in want if x[0] >= least]


def test_search_prunes_most_ranges():
    rng = np.random.default_rng(4)
    r, c = np.arange(4000) // 2, rng.permutation(4000) % 1000
    points = {(int(a), int(b)): int(v) for a, b, v in zip(r, c, rng.integers(1, 100, 4000))}
    rows, cols = np.array(list(points)).T
    made = treap.Treap(treap.build_treap(rows, cols, np.array(list(points.values())), 11))
    opened = []
    inner = made._opened
    made._opened = lambda batch: (opened.extend(batch), inner(batch))[1]
    made.top(np.array([5, 700]), np.array([3, 2]), 1)
    assert len(opened) < 100


def brute(docs, items, k=10):
    import re

    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, t) for d, t in ((d, found(t)) for d, t in docs) if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in set(items):
        got = []
        for d, t in held:
            m = 100 - 90 + 90 * len(t) * n // total
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in set(found(text)) if x in df and x in t)
            got += [(s, d)] if s > 0 else []
        got.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r, d, s) for r, (s, d) in enumerate(got[:k], 1)]
    return out


@pytest.mark.parametrize("limits", [{}, {"POINTS": 40, "ITEM_BYTES": 600, "RANGES": 2, "PIECE": 50}])
def test_ranks_match_brute_force_and_sql(spark, docs, in_duckdb, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(treap, name, value)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Été", "ñandú", "X", "x", "the", "THE", "_", "a-b", "東京"]
    rows = [(i * 3, " ".join(rng.choices(words, [1] * 60 + [3, 2, 2, 2, 20, 9, 1, 3, 2], k=rng.randrange(1, 30)))) for i in range(200)]
    rows += [(5000 + i, "copied words w1 w2 w3 copied") for i in range(40)]
    rows += [(9000, None), (9001, ""), (9002, " .-"), (9003, "w9 the " * 4000), (None, "copied w1"), (None, "w1 copied"), (9004, "same row"), (9004, "same row")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 20)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "nowhere-seen"), (103, "copied"), (104, "w1 w1 W1"), (104, "another text w2"), (105, "same"), (105, "same"), (106, " ".join(words * 3))]
    df = docs(rows, ("terms", "score", "rank"))
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term", "2 as score").repartition(3)
    index = treap.build_index(df.repartition(4))
    got = treap.search_index(index, asked).select(*COLUMNS).collect()
    assert plain(got) == plain(brute(rows, [i for i in items if i[1] is not None]))
    assert plain(got) == plain(in_duckdb(treap.oracle(), COLUMNS, documents=df, benchmark=asked))


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert treap.search_index(treap.build_index(docs([])), some).collect() == []
    assert treap.search_index(treap.build_index(docs([(1, "a b")])), none).collect() == []
    assert treap.search_index(treap.build_index(docs([(1, "a")])), some).count() == 1
