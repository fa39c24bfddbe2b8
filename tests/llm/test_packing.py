"""Packing: exact ids, gapless sequences, hardly any padding, neighbours alike, and the curve itself."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from tidewatch.llm import packing, tokens


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 4), (3, 3), (4, 2), (6, 2)])
def test_hilbert_curve_visits_each_cell_once_and_moves_one_step(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = packing.hilbert_key(points, bits)
    assert sorted(key) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_projection_counts_words_whole():
    texts = [b"", b"a bb", b"bb\n a", b"  ", b"longer-than-8 x", b"a", b"abb", b"longer-than-eight x"]
    got = packing.project(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
    alone = np.concatenate([packing.project(np.frombuffer(t, np.uint8), np.array([len(t)])) for t in texts])
    assert np.allclose(got, alone) and not got[[0, 3]].any()
    assert np.allclose(got[1], got[2]) and np.allclose(got[4], got[7]) and not np.allclose(got[5], got[6])


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def checked(rows, pieces, library, length, end):
    """Every id in one piece, sequences gapless; returns the lengths of sequences."""
    want = sorted([(d is not None, d or 0, tuple(library.encode(t or "", add_special_tokens=False).ids) + (end,)) for d, t in rows])
    by_doc, seqs = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id is not None, p.doc_id or 0), []).append(p)
        seqs.setdefault(p.sequence_id, []).append(p)
    got = []
    for (has, d), ps in by_doc.items():
        copies = [x for x in want if x[:2] == (has, d)]
        # rows that share a doc_id: each start comes once a copy, and the ids fit one of them
        left = sorted(ps, key=lambda p: (p.start, p.doc_tokens))
        for _, _, ids in copies:
            at = 0
            while at < len(ids):
                p = next(p for p in left if p.start == at and p.doc_tokens == len(ids) and np.frombuffer(p.ids, "<u4").tolist() == list(ids[at : at + p.length]))
                left.remove(p)
                at += p.length
            got.append((has, d, ids))
        assert not left
    assert sorted(got) == want
    out = []
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length and (at == length or at & (at - 1) == 0)
        out.append(at)
    return out


@pytest.mark.parametrize("length", [2048, 16, 1])
def test_every_id_lies_in_one_piece(docs, library, length, monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 3000)
    monkeypatch.setattr(packing, "BATCH_IDS", 500)
    monkeypatch.setattr(packing, "TOGETHER", 3)
    rng = random.Random(length)
    words = "the of and packing été 12 zebra \n".split(" ")
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "no id"), (202, "twice"), (202, "twice"), (202, "another"), (203, "long words " * 3000 if length > 1 else "long " * 50)]
    df = docs(rows, ("start", "ids", "length", "_key"))
    pieces = packing.pack(df, tokens.default_tokenizer(), length=length, end=1).collect()
    sizes = checked(rows, pieces, library, length, 1)
    assert sum(n == length for n in sizes) >= sum(sizes) // length - 40


def test_digests_and_edges(docs, library):
    rows = [(i, f"document {i} " * (i % 7)) for i in range(50)]
    packed = packing.pack(docs(rows), tokens.default_tokenizer())
    assert all(zlib.crc32(np.asarray(ids, "<u4").tobytes()) == r.ids_crc32 for r, ids in ((r, np.frombuffer(p.ids, "<u4")) for r, p in zip(sorted(packing.digests(packed).collect()), sorted(packed.collect()))))
    assert packing.pack(docs([]), tokens.default_tokenizer()).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs(rows), tokens.default_tokenizer(), length=3)


def test_neighbours_on_the_curve_are_alike(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", packing.curve_key("text").alias("key")).where("lang is not null").orderBy("key", "doc_id").collect()
    langs = [r.lang for r in rows]  # invented words, few dimensions: a language is a wide cloud
    same = np.mean([a == b for a, b in zip(langs, langs[1:])])
    by_chance = sum((langs.count(x) / len(langs)) ** 2 for x in set(langs))
    assert same > by_chance + 0.08
