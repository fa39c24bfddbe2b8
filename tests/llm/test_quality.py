"""The language model against a plain implementation; the classifier on labelled rows; the pipeline's stages."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import mixing, quality, unigram
from tidewatch.llm.common import materialise, table

from .conftest import plain
from .test_neardup import groups


ORDER = quality.ORDER


def bytes_of(text):
    return [quality.BOUNDARY] * (ORDER - 1) + list((text or "").encode())


class Plain:
    """Interpolated modified Kneser-Ney over dictionaries."""

    def __init__(self, texts):
        c = Counter()
        for t in texts:
            s = bytes_of(t)
            c.update(tuple(s[i : i + ORDER]) for i in range(len(s) - ORDER + 1))
        self.counts = {ORDER: c}
        for k in range(ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.ctx = {}, {}
        for k, c in self.counts.items():
            n = [sum(v == i for v in c.values()) for i in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0
            self.d[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), i) if n[i - 1] and n[0] + 2 * n[1] else 0 for i in (1, 2, 3)]
            self.ctx[k] = {}
            for g, v in c.items():
                t = self.ctx[k].setdefault(g[:-1], [0, 0.0])
                t[0] += v
                t[1] += self.d[k][min(v, 3) - 1]

    def p(self, g):
        if not g:
            return 1 / 256
        k = len(g)
        if g[:-1] not in self.ctx[k]:
            return self.p(g[1:])
        total, off = self.ctx[k][g[:-1]]
        v = self.counts[k].get(g, 0)
        return (v - (self.d[k][min(v, 3) - 1] if v else 0)) / total + off / total * self.p(g[1:])

    def bits(self, text):
        s = bytes_of(text)
        return sum(-math.log2(self.p(tuple(s[i - ORDER + 1 : i + 1]))) for i in range(ORDER - 1, len(s)))


TRUSTED = ["The cat sat on the mat, and the cat ran.\nIt was été à côté.", "A dog. A dog dog barks at 12 cats!", "the of and to in", "Über straße; naïve (x) один два"]


@pytest.mark.parametrize("piece", [quality.PIECE, 40])
def test_costs_are_kneser_neys(spark, docs, monkeypatch, piece):
    """Every document's bits, through chunks and joins, against dictionaries; the model's sums to one."""
    monkeypatch.setattr(quality, "PIECE", piece)
    monkeypatch.setattr(quality, "CHUNK", 60)
    tests = [*TRUSTED, "the the the", "XYZ %%% qqq", "", "été", "dog dog Dog", "два три", None]
    chunks = quality.pack(docs([(i, t, "en") for i, t in enumerate(tests)]).coalesce(1))
    assert chunks.count() > 2
    fit = chunks.select("chunk", F.posexplode("ids").alias("row", "doc_id")).where("doc_id < 4").select("chunk", "row").union(chunks.select("chunk", F.lit(-1)))
    by_chunk = quality.chunk_grams(chunks, fit)
    corpus = by_chunk.groupBy("gram").agg(F.sum("n").alias("n"))
    model = quality.kneser_ney(corpus.where("n > 0"))
    costs = quality.gram_costs(corpus.select("gram", (F.col("n") > 0).alias("seen")), model)
    got = {r.doc_id: (r._n, r._bits / quality.PARTS) for r in quality.score(chunks, by_chunk.join(costs, "gram").select("chunk", "gram", "cost")).collect()}
    plain_model = Plain(TRUSTED)
    for i, t in enumerate(tests):
        assert got[i][0] == len((t or "").encode())
        assert got[i][1] == pytest.approx(plain_model.bits(t), abs=0.01 + 1e-4 * got[i][0])
    context = next(iter(plain_model.ctx[ORDER]))
    assert sum(plain_model.p((*context, b)) for b in range(256)) == pytest.approx(1)


def test_thresholds_by_language(spark):
    rows = [("a", 1000, (2.0 + i / 1000) * 1000 * quality.PARTS) for i in range(2000)] + [("b", 1000, 3.0 * 1000 * quality.PARTS)] * 3
    held = spark.createDataFrame([(x, n, int(b)) for x, n, b in rows], "_lang string, _n long, _bits long")
    got = {r._lang: r for r in quality.thresholds(held, 0.99).collect()}
    assert got["a"]._limit == pytest.approx(3.9, abs=0.1) and got["b"]._limit > 3.5 and got["b"]._mean == pytest.approx(3.0)
    assert set(got) == {"a", "b", quality.POOLED}
    assert quality.thresholds(held.limit(0)).count() == 0


def test_odd_documents(docs):
    rows = [(i, TRUSTED[i % 4], "en") for i in range(40)] + [(50, None, "en"), (51, "", None), (52, "%%% ### @@@ " * 40, "en"), (53, TRUSTED[0], "xx"), (None, TRUSTED[1], "en"), (0, TRUSTED[0], "en")]
    df = docs(rows, ("kept", "_n", "quality", "chunk", "row", "rows", "gram"))
    labels = df.sparkSession.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (52, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(df, labels).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and not got[52].kept and all(r.kept for d, r in got.items() if d != 52)
    assert got[51].lang is None and got[50].n_bytes == 0
    assert quality.classify(df, labels.limit(0)).where("kept").count() == len(rows)
    assert quality.classify(docs([]), labels).count() == 0
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == len(rows) - 1
    assert quality.keep_good(docs([]), labels).count() == 0


def test_long_texts_and_chunks(docs, monkeypatch):
    """Results do not depend on how rows are packed; a text longer than a chunk is whole."""
    rows = [(i, f"{TRUSTED[i % 4]} {i} " * (1 + i % 5), "en") for i in range(60)] + [(99, TRUSTED[0] * 3000, "en")]
    df = docs(rows)
    labels = df.sparkSession.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    want = plain(quality.classify(df, labels).collect())
    monkeypatch.setattr(quality, "CHUNK", 500)
    monkeypatch.setattr(quality, "PIECE", 300)
    assert plain(quality.classify(df.repartition(5), labels).collect()) == want


def test_held_out_accuracy(spark, data):
    """Train on half of the trusted labels; judge the other half and the junk."""
    d = data.replace("sf0.001", "sf0.01")
    df, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = {r.doc_id: r.kept for r in quality.classify(df, labels.where("doc_id % 2 = 0")).collect()}
    rows = labels.where("doc_id % 2 = 1").collect()
    good = [got[r.doc_id] for r in rows if r.quality == 1]
    junk = [got[r.doc_id] for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(junk) <= 0.1 * len(junk)


def kept_by_loops(spark, docs, labels):
    """doc_ids that the classifier keeps, by a dictionary model and NumPy quantiles."""
    rows = docs.select("doc_id", "lang", "text", (F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(quality.HELD_OUT)) == 0).alias("held")).collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    model = Plain([r.text for r in rows if r.doc_id in good and not r.held])
    known = {}

    def cost(g):
        if g not in known:
            known[g] = round(-math.log2(max(model.p(g), quality.LEAST)) * quality.PARTS)
        return known[g]

    def bits(text):
        s = bytes_of(text)
        return sum(cost(tuple(s[i - ORDER + 1 : i + 1])) for i in range(ORDER - 1, len(s))) / quality.PARTS

    scored = [(r.doc_id, r.lang, len((r.text or "").encode()), bits(r.text), r.doc_id in good and r.held) for r in rows]
    held = [x for x in scored if x[4] and x[2]]
    mean = {x: sum(h[3] for h in held if h[1] == x) / sum(h[2] for h in held if h[1] == x) for x in {h[1] for h in held}}
    everything = sum(h[3] for h in held) / sum(h[2] for h in held)
    shrunk = lambda n, b, m: (b + quality.PRIOR * m) / (n + quality.PRIOR)
    above = np.quantile([shrunk(h[2], h[3], mean[h[1]]) - mean[h[1]] for h in held], quality.QUANTILE)
    limit = {x: max(np.quantile([shrunk(h[2], h[3], m) for h in held if h[1] == x], quality.QUANTILE), m + above) for x, m in mean.items()}
    assert len(held) < 1 / (1 - quality.QUANTILE)
    return {d for d, x, n, b, _ in scored if shrunk(n, b, mean.get(x, everything)) <= limit.get(x, everything + above) + 1e-9}


def test_pipeline_stages_by_brute_force(spark, data, in_duckdb):
    """Each stage on its own input: a dictionary model, groups by all pairs, the mix's SQL, the ids' text."""
    docs = table(spark, data, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4 and corpus_pipeline.ORACLE_SQL is None
    quality_stage, neardup_stage, mixing_stage, encoding_stage = (f for _, f in corpus_pipeline.STAGES)

    one = materialise(quality_stage(spark, docs, data))
    want = kept_by_loops(spark, docs, table(spark, data, "labels"))
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted(want)

    two = materialise(neardup_stage(spark, one, data))
    want = {d for d, _, _, k in groups([(r.doc_id, r.text) for r in one.collect()], corpus_pipeline.SIMILAR) if k}
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.select("doc_id").collect()) == sorted(want)

    three = materialise(mixing_stage(spark, two, data))
    copies = Counter(r.doc_id for r in three.select("doc_id").collect())
    plan = {d: n for d, n in in_duckdb(mixing.oracle(), ["doc_id", "copies"], documents=two) if n}
    assert three.columns == docs.columns and dict(copies) == plan

    four = encoding_stage(spark, three, data)
    texts = {r.doc_id: r.text for r in two.collect()}
    back = unigram.decode(four).collect()
    assert len(back) == sum(copies.values()) and all(r.text == (texts[r.doc_id] or "") for r in back)


def test_pipeline_stages_on_odd_rows(spark, docs, data):
    """Nulls, empty and repeated rows, clashing columns and no rows pass through every stage."""
    rows = [(i, f"{TRUSTED[i % 4]} {i}", "en", f"s{i % 3}") for i in range(1, 30)] + [(1, f"{TRUSTED[1]} 1", "en", "s1")] * 2 + [(None, None, None, None), (40, "", "en", "s0"), (None, "x y z", None, "s1")]
    df = docs(rows, ("_did", "_th", "kept", "chunk", "row", "rows", "_n", "size", "position"))
    for rowset in (df, df.limit(0)):
        now = rowset
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = materialise(stage(spark, now, data))
            assert now.columns == df.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, now, data).count() == now.count()


def test_pipeline_runs_whole(spark, data):
    got = corpus_pipeline.run(spark, data).collect()
    assert got and plain([(r.doc_id, len(r.ids)) for r in got])
