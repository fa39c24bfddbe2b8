"""Token files and SentencePiece segmentation: against the library and by exhaustive search."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import bytebpe, tokens, unigram

ALPHABET = " \t\n\x1c\x85\xa0abcÀ٣一'stll!²🎉_ªΩж​　 ÿ×"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=60) | st.text(max_size=30))
def test_piecewise_encoding_is_the_librarys(text):
    from tokenizers import Tokenizer

    global _lib
    if "_lib" not in globals():
        _lib = Tokenizer.from_file(tokens.default_tokenizer())
    around = [b"", "the \n\tend".encode(), text.encode(), b" of", text.encode() + b" it's  ", ("x " + text + " " + text).encode()]
    for raw, ids in zip(around, bytebpe.byte_bpe(tokens.default_tokenizer())(around)):
        assert np.frombuffer(ids, "<u2").tolist() == _lib.encode(raw.decode(), add_special_tokens=False).ids


def test_real_texts_encode_as_the_librarys(spark, data, library):
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    encode = bytebpe.ByteBpe(tokens.default_tokenizer())
    for at in (0, 0, 50, 120):  # the second time from kept words
        some = texts[at : at + 60]
        assert [np.frombuffer(x, "<u2").tolist() for x in encode([t.encode() for t in some])] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_full_stores_and_long_words(library, monkeypatch):
    monkeypatch.setattr(bytebpe, "KEEP", 8)
    monkeypatch.setattr(bytebpe, "KEEP_PIECES", 4)
    encode = bytebpe.ByteBpe(tokens.default_tokenizer())
    words = ["a" * 200, "b" * 64, "b" * 65, "don't", "x1y", "…", "é!", "\t\t", "end"]
    for seed in range(30):
        text = " ".join(random.Random(seed).choices(words, k=12)) + "\n"
        assert np.frombuffer(encode([text.encode()])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


#: Two words of equal length whose sums of byte values times powers of an odd number agree modulo 2**64, whatever the values.
ALIKE = ("abbbbbaaaaaabbabaaaaaaaabbbabaaabaaabababbbbaaaabababaaabaaaabbb", "aaaaaababbbaaabaaaaabbaaaaabaaaaabbaaaaaaaaaaabbaaabaaaaaaabaaaa")


def test_words_of_equal_hash_keep_their_own_ids(docs, library, monkeypatch):
    x, y = ALIKE
    texts = [x, y, f"{x} {y} {x} {y}", f"{y} and {x}, {y}", y, x]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    encode = bytebpe.ByteBpe(tokens.default_tokenizer())
    for some in (range(6), range(6), (1, 0), (3,)):  # from one block, from kept words, and alone
        got = encode([texts[i].encode() for i in some])
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [want[i] for i in some]
    got = sorted(tokens.token_digests(tokens.write_tokens(docs([(i, t) for i, t in enumerate(texts)]), tokens.default_tokenizer())).collect())
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(w) + 1, zlib.crc32(np.asarray([*w, 2], "<u4").tobytes())) for w in want]
    # every hash the same: only bytes tell words apart
    monkeypatch.setattr(bytebpe, "_VALUES", np.zeros(256, np.uint64))
    encode = bytebpe.ByteBpe(tokens.default_tokenizer())
    for seed in range(20):
        text = " ".join(random.Random(seed).choices(["ab", "ba", "abc", "don't", "x1", "abcdefgh", "abcdefgi", "abcdefghi", "  "], k=30))
        assert np.frombuffer(encode([text.encode()])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_files_go_to_the_library_whole(tmp_path, library):
    import json

    with open(tokens.default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    assert bytebpe.cuttable(tokens.default_tokenizer())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    assert not bytebpe.cuttable(str(other))
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(str(other)).encode("hello there", add_special_tokens=False).ids
    assert np.frombuffer(bytebpe.ByteBpe(str(other))([b"hello there"])[0], "<u2").tolist() == want


def test_token_file_reads_back(docs, library):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(ALPHABET + "the of and ", k=rng.randrange(200)))) for i in rng.sample(range(1000), 80)]
    rows += [(3000, None), (3001, ""), (3002, "<|endoftext|> x<|endoftext|>"), (3003, "word " * 30_000), (-1, "first"), (-2, "a"), (-2, "a")]
    df = docs(rows, ("start", "n_tokens", "part", "seq", "ids"))
    written = tokens.write_tokens(df, tokens.default_tokenizer())
    got = sorted(tokens.token_digests(written).collect())
    at = 0
    for row, (doc_id, text) in zip(got, sorted(rows, key=lambda r: r[0])):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(row) == (doc_id, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    whole = {r.start: np.frombuffer(r.ids, "<u4") for r in tokens.read_tokens(written).collect()}
    assert sum(r.n for r in tokens.count_token(written, 2).collect()) == sum(int((x == 2).sum()) for x in whole.values())
    shard = {(r.part, r.seq): r for r in tokens.count_token(written, 2).collect()}
    key = next(iter(shard))
    places = sorted(r["at"] for r in tokens.find_token(written, 2).collect() if (r.part, r.seq) == key)
    assert len(places) == shard[key].n
    asked = written.sparkSession.createDataFrame([(*key, p) for p in [*places[:5], places[0], 10**9, -1]] + [(99, 0, 0)], "part int, seq int, at long")
    assert sorted((r["at"], r.token) for r in tokens.tokens_at(written, asked).collect()) == [(p, 2) for p in places[:5]]


def test_access_inflates_one_block_a_plane():
    ids = np.random.default_rng(4).integers(0, 50_000, 400_000).astype("<u2")
    planes, zeros = tokens.build_planes(ids)
    w = tokens.WaveletMatrix(len(ids), zeros, [tokens._pack(p) for p in planes], [tokens.directory(p) for p in planes])
    assert w[123_456] == ids[123_456] and len(w._open) <= 2 * tokens.BITS < sum(-(-len(p) // tokens.BLOCK) for p in planes)


def test_small_shards_and_null_ids(docs, monkeypatch, library):
    df = docs([(None, "x y"), (4, "a b c d"), (None, "z"), (9, "q")])
    got = tokens.token_digests(tokens.write_tokens(df, tokens.default_tokenizer())).collect()
    assert sorted(r.start for r in got)[0] == 0 and {r.doc_id for r in got if r.start < 5} == {None}
    assert tokens.token_digests(tokens.write_tokens(docs([]), tokens.default_tokenizer())).count() == 0
    rows = list(tokens._shard_rows(0, iter([(i, np.full(5, i, "<u2").tobytes()) for i in range(10)])))
    assert len(rows) == 1
    monkeypatch.setattr(tokens, "SHARD_TOKENS", 12)
    rows = list(tokens._shard_rows(0, iter([(i, np.full(5, i, "<u2").tobytes()) for i in range(10)])))
    assert [r["n_docs"] for r in rows] == [3, 3, 3, 1] and [r["seq"] for r in rows] == [0, 1, 2, 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40) | st.integers(0, 65535), max_size=1500))
def test_wavelet_matrix_against_lists(values):
    ids = np.array(values, "<u2")
    planes, zeros = tokens.build_planes(ids)
    assert tokens.decode_planes(planes, zeros, len(ids)).tolist() == values
    w = tokens.WaveletMatrix(len(ids), zeros, [tokens._pack(p) for p in planes], [tokens.directory(p) for p in planes])
    rng = random.Random(len(values))
    for i in rng.sample(range(len(values)), min(8, len(values))):
        assert w[i] == values[i]
        v = values[i]
        places = [k for k, x in enumerate(values) if x == v]
        assert w.count(v) == len(places) and w.rank(v, i) == sum(k < i for k in places)
        assert [w.select(v, j) for j in range(min(5, len(places)))] == places[:5]
    assert w.count(65535) == values.count(65535)
    if len(values) < 200 and values:
        assert w.occurrences(values[0]) == [k for k, x in enumerate(values) if x == values[0]]


@pytest.fixture(scope="module")
def model():
    return unigram.unigram(unigram.default_model())


def best_score(m, text):
    """The best total over all segmentations, by a plain recursion over characters of the whole text."""
    scores = {m.pieces[i]: m.score[i] for i in range(len(m.pieces)) if m.score[i] != 0 or not m.pieces[i].startswith("<")}
    best = [0.0] + [float("-inf")] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 20), e):
            piece = text[s:e]
            if piece in scores:
                best[e] = max(best[e], best[s] + scores[piece])
        if text[e - 1] not in scores:
            best[e] = max(best[e], best[e - 1] + m.unknown)
    return best[-1]


def score_of(m, ids):
    """Total of a segmentation; each run of byte pieces counts once a character."""
    total, held = 0.0, b""
    for i in ids:
        if i in m.byte_id:
            held += m.raw[i]
            try:
                total += m.unknown * len(held.decode())
                held = b""
            except UnicodeDecodeError:
                pass
        else:
            total += m.score[i]
    return total


WORDS = ["the", "hest", "Erthen", "herest", "esuemente", "hello", "  spaces  ", "a\nb", "é", "🎉🎉", "ç一", "Ⅷж", "x" * 150, "tab\tend", "don't", "ññ", "", " ", "▁"]


def test_segmentation_is_the_best(model):
    texts = WORDS + [" ".join(random.Random(i).choices(WORDS, k=5)) for i in range(40)]
    for text, raw in zip(texts, model.encode_batch(texts)):
        ids = np.frombuffer(raw, "<u2").tolist()
        marked = unigram.MARK + text.replace(" ", unigram.MARK) if text else ""
        assert score_of(model, ids) == pytest.approx(best_score(model, marked))
        assert model.decode(raw) == text.replace(unigram.MARK, " ")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(text):
    m = unigram.unigram(unigram.default_model())
    assert m.decode(m.encode_batch([text])[0]) == text.replace(unigram.MARK, " ")


def test_long_and_short_ways_agree(model):
    parts = ["▁hello", "▁éab🎉x", "ⅧΩж", "a", "▁antidisestablishment", "▁▁▁"]
    assert [model._one(p.encode()) for p in parts] == model._many([p.encode() for p in parts])


def test_double_array_against_a_dict(model):
    keys = {p.encode(): i for i, p in enumerate(model.pieces[300:2300])}
    trie = unigram.DoubleArray(keys)
    for probe in [*list(keys)[:500], b"zzzz", b"\xff", b"th", b"t"]:
        state, alive = np.zeros(1, np.int32), True
        for c in probe:
            state, ok = trie.step(state, np.array([c]))
            alive = alive and bool(ok[0])
            if not alive:
                break
        assert (int(trie.value[state[0]]) if alive else -1) == keys.get(probe, -1)


def test_documents_encode_and_decode(docs, model):
    rows = [(1, "the cat"), (1, "the cat"), (2, None), (None, "x"), (3, ""), (4, "word " * 20_000)]
    df = docs(rows, ("ids", "n_ids"))
    enc = unigram.encode(df)
    assert [r.doc_id for r in enc.collect()] and enc.count() == 6
    back = sorted(((r.doc_id or 0), r.text) for r in unigram.decode(enc).collect())
    assert back == sorted((d or 0, t or "") for d, t in rows)
    got = unigram.encode_and_check(df).collect()
    assert all(r.round_trip for r in got) and {r.n_ids for r in got if r.doc_id in (2, 3)} == {0}
    assert unigram.encode_and_check(docs([])).count() == 0
