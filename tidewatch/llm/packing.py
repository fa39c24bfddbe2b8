"""Packing documents into training sequences along a Hilbert curve.

Every document's words are hashed into a vector, which is projected to few dimensions; the Hilbert
key of its cell orders documents so that neighbours are alike. Texts are range-sorted by the key;
each partition encodes its own, lays the ids end to end and cuts them into sequences of LENGTH
tokens. What a partition has left, under one sequence, is packed once more over many partitions;
what is left then is cut into powers of two. Every other sequence is full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .bytebpe import _LOW, byte_bpe, eights
from .common import materialise

#: Tokens of a sequence.
LENGTH = 2048
END = 1
#: Components of the hashed vector, of its projection, and bits of each of these in the Hilbert key.
BUCKETS, DIMENSIONS, DEPTH = 1024, 6, 10
#: Text bytes of one range partition, and partitions whose rests are packed together (under 2048 ids each).
PART_BYTES, TOGETHER = 24 << 20, 1024
#: Text bytes encoded, and texts projected, together.
ENCODE_BYTES, PROJECTED = 4 << 20, 256
#: Ids of the pieces in one Arrow batch.
BATCH_IDS = 1 << 20

_RNG = np.random.default_rng(77_031)
#: A random direction for each bucket.
_DIRECTIONS = _RNG.standard_normal((BUCKETS, DIMENSIONS))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def project(raw: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The projections of texts that end at `stops` in raw: damped counts of words by a hash of their first eight bytes,
    scaled to unit length; 0 for no words."""
    word = ~_WHITE[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = len(raw) and word[0], False
    edge[1:-1] = word[1:] & ~word[:-1]
    starts = np.concatenate([[0], stops[:-1]])
    inner = starts[starts < len(raw)]
    edge[inner] = word[inner]
    at = np.flatnonzero(edge)
    ends = np.flatnonzero(np.append(_WHITE[raw], True))
    stop = np.minimum(ends[np.searchsorted(ends, at)], stops[np.searchsorted(stops, at, side="right")]) if len(at) else at
    bucket = ((eights(raw)[at] & _LOW[np.minimum(stop - at, 8)]) * _SPREAD >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    text = np.searchsorted(stops, at, side="right")
    count = np.log1p(np.bincount(text * BUCKETS + bucket, minlength=len(stops) * BUCKETS).reshape(len(stops), BUCKETS))
    norm = np.linalg.norm(count, axis=1, keepdims=True)
    return count @ _DIRECTIONS / np.where(norm == 0, 1, norm)


def hilbert_key(points: np.ndarray, bits: int = DEPTH) -> np.ndarray:
    """Places along the Hilbert curve of integer points (rows), each coordinate of `bits` bits.

    Coordinates are turned level by level, from the coarsest: a set bit mirrors the first
    coordinate's lower bits, a clear one swaps them with the coordinate's; the Gray code is then undone.
    """
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(n):
            up = (x[d] >> level & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(up, low, swap)
            x[d] ^= swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            key = key << 1 | (x[d] >> level & 1)
    return key


def keys_of(projected: np.ndarray) -> np.ndarray:
    """Hilbert keys of projected vectors, each coordinate (close to a normal one of deviation 1) spread evenly over its cells."""
    even = 1 / (1 + np.exp(-1.702 * np.clip(projected, -20, 20)))
    return hilbert_key(np.minimum((even * (1 << DEPTH)).astype(np.int64), (1 << DEPTH) - 1))


@F.arrow_udf(LongType())
def curve_key(text: pa.Array) -> pa.Array:
    """The Hilbert key of each text; a null text is empty."""
    out = [np.zeros(0, np.int64)]
    for a in range(0, len(text), PROJECTED):
        texts = [t or b"" for t in text.slice(a, PROJECTED).cast(pa.binary()).to_pylist()]
        out.append(keys_of(project(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))))
    return pa.array(np.concatenate(out))


class _Pieces:
    """Rows of PIECES gathered into Arrow batches."""

    def __init__(self):
        self.rows, self.held = [], 0

    def add(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int, sequence: int | None, offset: int) -> None:
        self.rows.append((doc_id, start, len(ids) // 2, np.frombuffer(ids, "<u2").astype("<u4").tobytes(), doc_tokens, sequence, offset))
        self.held += len(ids) // 2

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.held = self.rows, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut(spans: Iterator[tuple[int | None, int, bytes, int]], first: int, length: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of spans (doc_id, start, uint16 ids, doc_tokens) laid end to end, in sequences numbered from `first`.

    Under `length` tokens are left at the end. They are cut into powers of two, the largest first, if
    `last`; otherwise they come with no sequence_id, their places in `offset`.
    """
    out, open_, filled, sequence = _Pieces(), [], 0, first
    for doc_id, start, ids, doc_tokens in spans:
        at, n = 0, len(ids) // 2
        while at < n:
            take = min(n - at, length - filled)
            open_.append((doc_id, start + at, ids[2 * at : 2 * (at + take)], doc_tokens))
            at, filled = at + take, filled + take
            if filled == length:
                offset = 0
                for d, s, raw, total in open_:
                    out.add(d, s, raw, total, sequence, offset)
                    offset += len(raw) // 2
                open_, filled, sequence = [], 0, sequence + 1
                if out.held >= BATCH_IDS:
                    yield out.batch()
    if not last:
        offset = 0
        for d, s, raw, total in open_:
            out.add(d, s, raw, total, None, offset)
            offset += len(raw) // 2
    elif filled:
        if out.rows:
            yield out.batch()
        for k in range(filled.bit_length() - 1, -1, -1):
            size, part = filled & 1 << k, []
            while size:
                d, s, raw, total = open_.pop(0)
                take = min(size, len(raw) // 2)
                part.append((d, s, raw[: 2 * take], total))
                if 2 * take < len(raw):
                    open_.insert(0, (d, s + take, raw[2 * take :], total))
                size -= take
            if part:
                yield from cut(iter(part), sequence, 1 << k, False)
                sequence += 1
    if out.rows:
        yield out.batch()


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The written pieces of all documents: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Every document is its ids and id `end`. A sequence has `length` tokens or, at the end of TOGETHER
    partitions, a smaller power of two; all are gapless. sequence_id is unique and ascends along the
    curve within a partition. Documents of equal key (copies) are ordered by doc_id and text. A null or
    empty text has its end id alone; rows that repeat are packed each; a null doc_id stays null; an
    empty table gives no rows; other columns are ignored. `length` has to be a power of two.
    """
    if length < 1 or length & length - 1:
        raise ValueError("length must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # copies of one text share a key: doc_id and a hash of the text let a range end among them
    rows = rows.withColumn("_key", curve_key("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange(size // PART_BYTES + 1, "_key", "doc_id", "_h").sortWithinPartitions("_key", "doc_id", "_h").select("doc_id", "text")
    tail = np.asarray([end], "<u2").tobytes()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode = byte_bpe(tokenizer)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            at, size = 0, 0
            for i, text in enumerate(texts, 1):
                size += len(text)
                if size >= ENCODE_BYTES or i == len(texts):
                    for doc_id, ids in zip(batch.column(0).slice(at, i - at).to_pylist(), encode(texts[at:i])):
                        yield doc_id, 0, ids + tail, len(ids) // 2 + 1
                    at, size = i, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in cut(spans(batches), part << 32, length, last=False):
            yield batch.append_column("part", pa.array([part] * batch.num_rows, pa.int32()))

    cuts = materialise(rows.mapInArrow(run, PIECES + ", part int"), "packing", compression="zstd")
    whole = cuts.where("sequence_id is not null").drop("part")
    # the rests of TOGETHER partitions, under `length` tokens each, follow one another
    rest = cuts.where("sequence_id is null").withColumn("_many", F.floor(F.col("part") / TOGETHER).cast("int"))

    def repack(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by([("part", "ascending"), ("offset", "ascending")])
        first = (table.column("_many")[0].as_py() * TOGETHER << 32) + (1 << 31)
        left = ((d, s, np.frombuffer(i, "<u4").astype("<u2").tobytes(), t) for d, s, i, t in zip(*[table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]))
        return cut(left, first, length, last=True)

    def regrouped(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(repack(table), _ARROW)

    rest = rest.groupBy("_many").applyInArrow(regrouped, PIECES)
    return whole.unionByName(rest)


def digests(pieces: DataFrame) -> DataFrame:
    """pack's rows with the CRC-32 of each piece's ids in their place."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
