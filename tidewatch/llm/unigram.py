"""SentencePiece encoding and decoding by unigram Viterbi over a double-array trie.

Pieces and their log scores come from a SentencePiece model file. The best segmentation maximises
the sum of scores; a character that no piece covers costs `unknown` and is written as its UTF-8
bytes' pieces. White space is the marker U+2581, with one before the text. No piece has the
marker after another character, so segmentation splits exactly at every run of markers, and each
distinct stretch is segmented once, many at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceCache

MARK = "▁"
#: What a character without a piece costs below the lowest score.
PENALTY = 10.0
#: Stretches beyond this many bytes are segmented one at a time.
LONG = 96


class DoubleArray:
    """A trie over bytes: the child of state s by byte c is base[s] + c + 1 where check[] of it is s; value[] is a piece or -1."""

    def __init__(self, keys: dict[bytes, int]):
        trie: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys.items():
            node = 0
            for c in key:
                if c not in trie[node]:
                    trie[node][c] = len(trie)
                    trie.append({})
                    values.append(-1)
                node = trie[node][c]
            values[node] = value
        size = len(trie) * 3 + 4096
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[:257] = False  # so that no base is negative
        place, first = [0] * len(trie), 257
        for node, children in enumerate(trie):  # a parent stands before its children
            if not children:
                continue
            codes = np.fromiter(children, np.int64)
            base, at = None, first
            while base is None:  # the first base whose slots are all free, 1024 candidates at a time
                spots = np.flatnonzero(free[at : at + 1024]) + at - codes.min()
                fits = np.flatnonzero(free[spots[:, None] + codes].all(1)) if len(codes) > 1 else spots
                base = int(spots[fits[0]] if len(codes) > 1 else spots[0]) if len(fits) else None
                at += 1024
            state = place[node]
            self.base[state] = base - 1
            for c, child in children.items():
                slot = base + c
                free[slot], self.check[slot], self.value[slot], place[child] = False, state, values[child], slot
            while not free[first]:
                first += 1

    def step(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and which of them exist."""
        nxt = self.base[states] + codes + 1
        return nxt, (nxt > 0) & (self.check[nxt] == states)


class Unigram:
    """Viterbi segmentation with the pieces of a SentencePiece model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        if n > 1 << 16:
            raise ValueError("more than 65,536 pieces")
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_id = np.full(256, sp.unk_id(), np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(self.pieces[i][3:5], 16)] = i
        if any(re.search(f"[^{MARK}]{MARK}|\n.|.\n", self.pieces[i], re.S) for i in plain):
            raise ValueError("a piece goes on past a marker or a newline: stretches can't be cut there")
        self.score = np.zeros(n)
        self.score[plain] = [sp.get_score(i) for i in plain]
        self.unknown = self.score[plain].min() - PENALTY
        self.trie = DoubleArray({self.pieces[i].encode(): i for i in plain})
        self.raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        for i in range(n):
            if sp.is_byte(i):
                self.raw[i] = bytes([int(self.pieces[i][3:5], 16)])
            elif sp.is_control(i):
                self.raw[i] = b""
        self.raw_by_id = dict(enumerate(self.raw))
        self.cache = PieceCache(self.segment)
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian uint16; an empty text has none."""
        return self.cache.join([self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts])

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids: bytes joined, markers spaces, the leading one dropped; broken UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.raw_by_id.__getitem__, np.frombuffer(ids, "<u2").tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def segment(self, stretches: list[str]) -> list[bytes]:
        """Best ids of each stretch (which must hold no place where the text could be cut)."""
        raw = [s.encode("utf-8", "surrogatepass") for s in stretches]
        out: list[bytes] = [b""] * len(raw)
        short = sorted((i for i in range(len(raw)) if len(raw[i]) <= LONG), key=lambda i: len(raw[i]))
        for a in range(0, len(short), 8192):
            for i, ids in zip(part := short[a : a + 8192], self._many([raw[i] for i in part])):
                out[i] = ids
        for i in range(len(raw)):
            if len(raw[i]) > LONG:
                out[i] = self._one(raw[i])
        return out

    def _many(self, raw: list[bytes]) -> list[bytes]:
        n, lens = len(raw), np.array([len(r) for r in raw])
        width = int(lens.max()) if n else 0
        text = np.zeros((n, width + 5), np.int32)
        text[np.arange(width + 5) < lens[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        best = np.full((n, width + 5), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, width + 5), np.int32), np.full((n, width + 5), -1, np.int32)
        for s in range(width):
            rows = np.flatnonzero(best[:, s] > -np.inf)
            rows = rows[lens[rows] > s]
            if not len(rows):
                continue
            first = text[rows, s]
            char = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            single = np.zeros(n, bool)
            size = np.zeros(n, np.int32)
            size[rows] = char
            at, state = rows, np.zeros(len(rows), np.int32)
            for d in range(width - s):
                state, ok = self.trie.step(state, text[at, s + d])
                ok &= lens[at] > s + d
                at, state = at[ok], state[ok]
                if not len(at):
                    break
                p = self.trie.value[state]
                has = p >= 0
                r, p = at[has], p[has]
                single[r[size[r] == d + 1]] = True
                total = best[r, s] + self.score[p]
                up = total > best[r, s + d + 1]
                r = r[up]
                best[r, s + d + 1], start[r, s + d + 1], piece[r, s + d + 1] = total[up], s, p[up]
            r = rows[~single[rows]]
            if len(r):
                e = s + size[r]
                total = best[r, s] + self.unknown
                up = total > best[r, e]
                r, e = r[up], e[up]
                best[r, e], start[r, e], piece[r, e] = total[up], s, -1
        # walk back, all stretches at once; an unknown character gives its bytes, last first
        ids, at = [], lens.copy()
        back = np.full((width, n), -1, np.int64)
        rows, k = np.flatnonzero(at > 0), 0
        while len(rows):
            e = at[rows]
            p, s = piece[rows, e], start[rows, e]
            unknown = p < 0
            byte = self.byte_id[text[rows, e - 1]]
            back[k, rows] = np.where(unknown, byte, p)
            if unknown.any():  # move by one byte; the rest of the character follows
                r, e1 = rows[unknown], e[unknown] - 1
                inside = e1 > s[unknown]
                start[r[inside], e1[inside]], piece[r[inside], e1[inside]] = s[unknown][inside], -1
                s = np.where(unknown, e - 1, s)
            at[rows] = s
            rows, k = rows[s > 0], k + 1
        flipped = back[::-1].T
        keep = flipped >= 0
        ids = flipped[keep].astype("<u2").tobytes()
        stops = np.cumsum(keep.sum(1)) * 2
        return [ids[a:b] for a, b in zip(np.concatenate([[0], stops[:-1]]).tolist(), stops.tolist())]

    def _one(self, raw: bytes) -> bytes:
        """The same for one long stretch, in plain steps over its bytes."""
        base, check, value, score = self._lists()
        n = len(raw)
        best, start, piece = [float("-inf")] * (n + 5), [0] * (n + 5), [-1] * (n + 5)
        best[0] = 0.0
        for s in range(n):
            here = best[s]
            if here == float("-inf"):
                continue
            c = raw[s]
            char, single, state = 1 + (c >= 0xC0) + (c >= 0xE0) + (c >= 0xF0), False, 0
            for e in range(s, n):
                nxt = base[state] + raw[e] + 1
                if nxt <= 0 or check[nxt] != state:
                    break
                state = nxt
                p = value[state]
                if p >= 0:
                    single |= e + 1 - s == char
                    if here + score[p] > best[e + 1]:
                        best[e + 1], start[e + 1], piece[e + 1] = here + score[p], s, p
            if not single and here + self.unknown > best[s + char]:
                best[s + char], start[s + char], piece[s + char] = here + self.unknown, s, -1
        out, e = [], n
        while e > 0:
            s = start[e]
            out += [piece[e]] if piece[e] >= 0 else [int(self.byte_id[c]) for c in raw[s:e][::-1]]
            e = s
        return np.asarray(out[::-1], "<u2").tobytes()

    def _lists(self):
        if not hasattr(self, "_as_lists"):
            self._as_lists = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.score))
        return self._as_lists


_MODELS: dict[str, Unigram] = {}


def unigram(model_file: str) -> Unigram:
    if model_file not in _MODELS:
        _MODELS[model_file] = Unigram(model_file)
    return _MODELS[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mapped(docs: DataFrame, model_file: str, schema: str, of) -> DataFrame:
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
    fields = [f.strip().split(" ") for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids, texts = some.column(0), some.column(1).to_pylist()
                rows = [of(model, t, raw) for t, raw in zip(texts, model.encode_batch(texts))]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, arrow[k]) for c, (_, k) in zip(cols, fields[1:])]], names=[f for f, _ in fields])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text.

    A null or empty text has no ids; a document's result depends on its text alone, so repeated
    rows agree; U+2581 in a text reads as a space; an empty table gives no rows.
    """
    return _mapped(docs, model_file or default_model(), "doc_id long, ids array<int>", lambda m, t, raw: (np.frombuffer(raw, "<u2").astype(np.int32),))


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and text of encoded documents; null ids decode to the empty text."""
    model_file = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(model_file)
        for batch in batches:
            texts = [model.decode(np.asarray(ids or [], "<u2").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_check(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_crc32 (of little-endian uint32 ids), round_trip (decoding gives the text back).

    A null or empty text has 0 ids and makes the round trip; repeated rows agree; other columns are
    ignored; an empty table gives no rows.
    """

    def digest(m: Unigram, text: str, raw: bytes):
        ids = np.frombuffer(raw, "<u2")
        expected = text.replace(MARK, " ")
        return len(ids), int(np.isin(ids, m.byte_id).sum()), zlib.crc32(ids.astype("<u4").tobytes()), m.decode(raw) == expected

    return _mapped(docs, model_file or default_model(), "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean", digest)
