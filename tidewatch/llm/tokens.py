"""Token ids as wavelet-matrix shards.

Documents are range-partitioned by doc_id and encoded in that order; every partition is cut into
shards of about SHARD_TOKENS ids. A shard is one row of a Parquet file: the documents' ids and
lengths, and a wavelet matrix of the token ids, one bit-plane per bit of an id, each compressed
on its own with a directory of ranks. Single ids, counts and occurrences are answered from it
without decoding the sequence; read_tokens decodes whole shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import BITS, byte_bpe
from .common import materialise

#: Ids of one shard (a document more at most): bounds what a task holds.
SHARD_TOKENS = 1 << 21
#: Text bytes of one range partition.
PART_BYTES = 24 << 20
#: Text bytes encoded together.
ENCODE_BYTES = 4 << 20
#: Bits between two entries of a plane's rank directory.
STEP = 512
#: Bytes of a plane that are compressed together, and that one access has to inflate; a multiple of STEP / 8.
BLOCK = 16 << 10
END = 2

SHARD_SCHEMA = "part int, seq int, n_docs int, n_tokens long, doc_ids array<long>, lengths array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"


def build_planes(ids: np.ndarray, bits: int = BITS) -> tuple[list[bytes], list[int]]:
    """Bit-planes (packed, most significant bit first) and each plane's number of zeros."""
    cur, planes, zeros = ids, [], []
    for k in range(bits - 1, -1, -1):
        one = (cur & (1 << k)).astype(bool)
        planes.append(np.packbits(one).tobytes())
        # by places: several times as fast as by masks
        low, high = np.flatnonzero(~one), np.flatnonzero(one)
        zeros.append(len(low))
        cur = np.concatenate([cur.take(low), cur.take(high)])
    return planes, zeros


def decode_planes(planes: list[bytes], zeros: list[int], n: int) -> np.ndarray:
    """The whole sequence, from the last plane up."""
    out = np.zeros(n, np.uint16)
    for k, (plane, z) in enumerate(zip(planes[::-1], zeros[::-1])):
        one = np.unpackbits(np.frombuffer(plane, np.uint8), count=n).view(bool)
        up = np.empty(n, np.uint16)
        up[np.flatnonzero(~one)] = out[:z]
        up[np.flatnonzero(one)] = out[z:] | np.uint16(1 << k)
        out = up
    return out


def directory(plane: bytes) -> bytes:
    """Ones before every STEP-th bit, as little-endian uint32."""
    ones = np.bitwise_count(np.frombuffer(plane, np.uint8)).astype(np.uint32)
    whole = np.add.reduceat(ones, np.arange(0, len(ones), STEP // 8)) if len(ones) else ones
    return np.concatenate([[0], np.cumsum(whole)]).astype("<u4").tobytes()


def _pack(raw: bytes) -> bytes:
    """A plane as compressed blocks of BLOCK bytes behind their offsets (little-endian uint32, one more than blocks)."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    blocks = [pack(raw[a : a + BLOCK]) for a in range(0, len(raw), BLOCK)]
    head = 4 * (len(blocks) + 1)
    return np.cumsum([head, *map(len, blocks)]).astype("<u4").tobytes() + b"".join(blocks)


def _block(packed: bytes, b: int) -> bytes:
    """The bytes of one block of a packed plane."""
    import zstandard

    start, stop = np.frombuffer(packed, "<u4", 2, 4 * b).tolist()
    return zstandard.ZstdDecompressor().decompress(packed[start:stop])


def _unpack(packed: bytes) -> bytes:
    if len(packed) <= 4:
        return b""
    return b"".join(_block(packed, b) for b in range(int(np.frombuffer(packed, "<u4", 1)[0]) // 4 - 1))


class WaveletMatrix:
    """Access, rank, count and select on one shard row; a plane's block is inflated when first needed."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros, self._planes, self._open = n, list(zeros), planes, {}
        self._ranks = [np.frombuffer(r, "<u4") for r in ranks]

    def _bytes(self, k: int, block: int) -> np.ndarray:
        if (k, block) not in self._open:
            self._open[k, block] = np.frombuffer(_block(self._planes[k], block), np.uint8)
        return self._open[k, block]

    def _bit(self, k: int, i: int) -> int:
        block, at = divmod(i // 8, BLOCK)
        return int(self._bytes(k, block)[at]) >> (7 - i % 8) & 1

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        step = i // STEP
        ones = int(self._ranks[k][step])
        if i % STEP:
            block, start = divmod(step * STEP // 8, BLOCK)
            part = self._bytes(k, block)[start : start + (i % STEP + 7) // 8]
            ones += int(np.bitwise_count(part[: i % STEP // 8]).sum())
            ones += (int(part[-1]) >> (8 - i % 8)).bit_count() if i % 8 else 0
        return ones

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, z in enumerate(self.zeros):
            bit = self._bit(k, i)
            value, ones = value << 1 | bit, self._rank1(k, i)
            i = z + ones if bit else i - ones
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where value's occurrences among the first i stand after the last plane."""
        a, b = 0, i
        for k, z in enumerate(self.zeros):
            ra, rb = self._rank1(k, a), self._rank1(k, b)
            a, b = (z + ra, z + rb) if value >> (len(self.zeros) - 1 - k) & 1 else (a - ra, b - rb)
        return a, b

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value among the first i ids."""
        a, b = self._range(value, i)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select_bit(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) zero or one of plane k, by bisection on ranks."""
        low, high = 0, self.n - 1
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(k, mid + 1)
            if (ones if bit else mid + 1 - ones) > j:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, value: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of value."""
        a, b = self._range(value, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        at = a + j
        for k in range(len(self.zeros) - 1, -1, -1):
            bit = value >> (len(self.zeros) - 1 - k) & 1
            at = self._select_bit(k, bit, at - self.zeros[k] if bit else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, j) for j in range(self.count(value))]


def _shard_rows(part: int, docs: Iterator[tuple[int | None, bytes]]) -> Iterator[dict]:
    ids: list[bytes] = []
    held: list[tuple[int | None, int]] = []
    total = seq = 0

    def close() -> dict:
        planes, zeros = build_planes(np.frombuffer(b"".join(ids), "<u2"))
        return {
            "part": part, "seq": seq, "n_docs": len(held), "n_tokens": total, "doc_ids": [d for d, _ in held], "lengths": [n for _, n in held],
            "zeros": zeros, "planes": [_pack(p) for p in planes], "ranks": [directory(p) for p in planes],
        }

    for doc_id, raw in docs:
        ids.append(raw)
        held.append((doc_id, len(raw) // 2))
        total += len(raw) // 2
        if total >= SHARD_TOKENS:
            yield close()
            ids, held, total, seq = [], [], 0, seq + 1
    if held:
        yield close()


def write_tokens(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Encode every text, append id `end`, and write the shards; returns the written table (SHARD_SCHEMA).

    Ascending (part, seq) is ascending doc_id, nulls first, equal ids ordered by a hash of the
    text. A null text is empty and yields `end` alone; an empty table writes no shards. One
    shuffle, of the texts; a partition holds about PART_BYTES of them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange(size // PART_BYTES + 1, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    tail = np.asarray([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)

        def encoded():
            for batch in batches:
                at, size = 0, 0
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                for i, text in enumerate(texts, 1):
                    size += len(text)
                    if size >= ENCODE_BYTES or i == len(texts):
                        for d, raw in zip(batch.column(0).slice(at, i - at).to_pylist(), encode(texts[at:i])):
                            yield d, raw + tail
                        at, size = i, 0

        for row in _shard_rows(TaskContext.get().partitionId(), encoded()):
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return materialise(rows.mapInArrow(run, SHARD_SCHEMA), "tokens")


_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
])


def read_tokens(shards: DataFrame) -> DataFrame:
    """Decode written shards: doc_id, start (ids of all documents before), n_tokens, ids (little-endian uint32).

    A row for every document written: null ids come first, repeated rows stay apart, a null or
    empty text has its end id alone, and no shards give no rows.
    """
    return _decoded(shards, "ids binary", lambda raw: raw)


def token_digests(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document's ids, read back from written shards; rows as read_tokens gives."""
    return _decoded(shards, "ids_crc32 long", zlib.crc32)


def _decoded(shards: DataFrame, column: str, of: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_planes([_unpack(p) for p in row["planes"]], row["zeros"], row["n_tokens"]).astype("<u4")
                stops = np.cumsum(row["lengths"])
                starts = stops - row["lengths"]
                last = [of(ids[a:b].tobytes()) for a, b in zip(starts, stops)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in (([row["part"]] * len(last), pa.int32()), ([row["seq"]] * len(last), pa.int32()), (row["doc_ids"], pa.int64()), (starts, pa.int64()), (row["lengths"], pa.int64()), (last, pa.binary() if "binary" in column else pa.int64()))],
                    names=["part", "seq", "doc_id", "_at", "n_tokens", "_last"],
                )

    docs = shards.select("part", "seq", "n_tokens", "doc_ids", "lengths", "zeros", "planes").mapInArrow(run, f"part int, seq int, doc_id long, _at long, n_tokens long, _last {column.split()[1]}")
    heads = shards.select("part", "seq", "n_tokens")
    # two levels of prefix sums: the ordered window runs over one row a partition
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_seq_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("n_tokens").join(parts, "part")
    return docs.join(heads, ["part", "seq"]).select("doc_id", (F.col("_at") + F.col("_seq_start") + F.col("_part_start")).cast("long").alias("start"), "n_tokens", F.col("_last").alias(column.split()[0]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def wavelet(row) -> WaveletMatrix:
    """The succinct structure of one shard row."""
    return WaveletMatrix(row["n_tokens"], row["zeros"], [bytes(p) for p in row["planes"]], [bytes(r) for r in row["ranks"]])


def _on_shards(shards: DataFrame, columns: list[tuple[str, pa.DataType]], schema: str, of: Callable) -> DataFrame:
    """part, seq and the columns that `of` gives for each shard's wavelet matrix; only planes and ranks are read."""
    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for cols in of(wavelet(row), row):
                    n = len(cols[0])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[row["part"]] * n, [row["seq"]] * n, *cols], arrow)], schema=arrow)

    return shards.mapInArrow(run, f"part int, seq int, {schema}")


_PLANES = ("part", "seq", "n_tokens", "zeros", "planes", "ranks")


def count_token(shards: DataFrame, value: int) -> DataFrame:
    """part, seq, n: occurrences of one id in every shard, by rank queries on the planes; 0 where it doesn't occur."""
    return _on_shards(shards.select(*_PLANES), [("n", pa.int64())], "n long", lambda w, _: [([w.count(value)],)])


def find_token(shards: DataFrame, value: int) -> DataFrame:
    """part, seq, at: every place of one id within its shard, by select queries, 4096 to a batch."""

    def places(w: WaveletMatrix, _):
        n = w.count(value)
        for a in range(0, n, 4096):
            yield ([w.select(value, j) for j in range(a, min(n, a + 4096))],)

    return _on_shards(shards.select(*_PLANES), [("at", pa.int64())], "at long", places)


def tokens_at(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """part, seq, at, token for each wanted place (part, seq, at), by access on the planes.

    A place null or outside its shard, or of a shard that is not there, gives no row; a place
    asked twice is answered once. Places of one shard go to it together, as many as were asked.
    """
    asked = wanted.select("part", "seq", "at").where("at >= 0").distinct().groupBy("part", "seq").agg(F.collect_list("at").alias("ats"))

    def read(w: WaveletMatrix, row):
        ats = [i for i in row["ats"] if i < w.n]
        return [(ats, [w[i] for i in ats])] if ats else []

    return _on_shards(shards.select(*_PLANES).join(asked, ["part", "seq"]), [("at", pa.int64()), ("token", pa.int32())], "at long, token int", read)
