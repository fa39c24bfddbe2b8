"""Near-duplicates by brute force over full shingle sets; components; the Bayesian test."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewatch.llm import neardup, shingles
from tidewatch.llm.components import connected_components


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows, percent=85):
    """Component (least id) of every (doc_id, text), by comparing all pairs."""
    sets = [shingles_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {(d, len(s), least[find(i)], least[find(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets))}


def noisy(rng, words, share):
    return " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(10**6)) if rng.random() < share else w for w in words)


def corpus(seed=0, n=40):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 5])):
            rows.append((len(rows), noisy(rng, words, rng.choice([0, 0.004, 0.01, 0.02, 0.05]))))
    words = [f"h{rng.randrange(3000)}" for _ in range(150)]
    rows += [(len(rows) + i, noisy(rng, words, rng.choice([0.003, 0.01, 0.03]))) for i in range(120)]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one Two"), (5004, "ONE two"), (5005, "two one"), (5006, "É é x"), (5007, "é é x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [neardup.BLOCK, 16])
def test_groups_match_brute_force(docs, block):
    rows = corpus()
    df = docs(rows, ("cls", "th", "label", "cluster", "n_shingles"))
    got = {tuple(r)[:4] for r in neardup.near_duplicates(df, block=block).collect()}
    assert got == groups(rows)


def test_digests_that_share_half_are_told_apart(spark):
    schema = "doc_id long, th long, n_shingles long, cls long, rest long, bands array<long>, sig binary"
    rows = [(1, 1, 5, 7, 100, [1], b"a"), (2, 2, 5, 7, 200, [2], b"b"), (3, 3, 5, 7, 200, [2], b"b"), (4, 4, 5, 8, 100, [3], b"c"), (5, 5, 0, None, None, None, None)]
    got = {r.doc_id: r.cls for r in neardup._apart(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == 7 and got[2] == got[3] not in (7, 8) and got[4] == 8 and got[5] is None
    alone = neardup._apart(spark.createDataFrame(rows[3:], schema))
    assert alone.columns == ["doc_id", "th", "n_shingles", "cls", "bands", "sig"] and {r.cls for r in alone.collect()} == {8, None}
    a, b = (neardup.set_digest(np.array(x, np.uint64)) for x in ([1, 2], [1, 3]))
    assert a != b and len(a) == 2 and neardup.set_digest(np.array([1, 2], np.uint64)) == a


def test_test_data_matches_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert {tuple(r)[:4] for r in neardup.near_duplicates(df).collect()} == groups(rows)


def test_repeated_rows_null_ids_and_survivors(docs):
    text = "a b c d e f g"
    df = docs([(3, text), (3, text), (None, text), (8, text), (None, "no id here at all"), (None, "no id here at all"), (9, None), (9, None)])
    got = sorted(neardup.near_duplicates(df).collect(), key=lambda r: (str(r.component_id), str(r.doc_id)))
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(3, 3, True), (3, 3, True), (8, 3, False), (None, 3, False), (9, 9, True), (9, 9, True), (None, None, True), (None, None, True)]
    kept = sorted((str(r.doc_id), r.text) for r in neardup.keep_representatives(df).collect())
    assert kept == [("3", text), ("9", None), ("9", None), ("None", "no id here at all")]
    assert neardup.near_duplicates(docs([])).count() == 0 and neardup.keep_representatives(docs([])).count() == 0


def test_survivors_keep_their_columns(docs):
    rows = corpus(2, 15)
    df = docs(rows, ("extra", "_n", "_pos", "_did", "size"))
    kept = neardup.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, _, k in groups(rows) if k)


@settings(max_examples=200, deadline=None)
@given(st.text("aAbBé \t\n\r\x0b\x1f一.", max_size=60) | st.text(max_size=40))
def test_shingle_hashes_stand_for_shingles(text):
    assert len(shingles.shingle_set(text.encode("utf-8", "surrogatepass"))) == len(shingles_of(text))
    assert (shingles.shingle_set(text.encode("utf-8", "surrogatepass")) == shingles.shingle_set(lower(text).encode("utf-8", "surrogatepass"))).all()


def test_bands_find_links_and_minima_estimate():
    rng = np.random.default_rng(0)
    hits = []
    for _ in range(300):
        both, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (425, 37, 38))
        x, y = (shingles.minhash(np.unique(np.concatenate([both, s]))) for s in (a, b))
        hits.append(float((x == y).mean()))
        assert (shingles.band_keys(x, neardup.ROWS) == shingles.band_keys(y, neardup.ROWS)).any()
    assert abs(np.mean(hits) - 0.85) < 0.01


def test_posterior_bounds():
    least = neardup.fewest_matches(0.85)
    assert len(least) == 4 and least == sorted(least) and least[-1] / 128 < 0.75
    rng = np.random.default_rng(1)
    for n, m in zip(range(32, 129, 32), least):
        assert (rng.binomial(n, 0.85, 100_000) < m).mean() < 1e-4
        draws = rng.beta(m + 1, n - m + 1, 200_000)
        assert (draws >= 0.85).mean() < 1e-4


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_components_by_union_find(spark, edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {(x, find(x)) for x in up} and len(got) == len(up)


def test_long_chain_components(spark):
    got = connected_components(spark.range(500).selectExpr("id as a", "id + 1 as b")).collect()
    assert len(got) == 501 and {r.root for r in got} == {0}
