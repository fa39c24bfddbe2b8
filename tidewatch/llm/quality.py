"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Grams are runs of ORDER bytes of UTF-8, with boundaries before each document. Rows are packed into
chunks, a table bucketed by chunk, so that texts are shuffled never and only grams, each once a
chunk, travel: counts of trusted text are joined, sharded by gram, into the model, the corpus'
grams are joined with the model, and their costs go back to their chunks, where documents add them
up. A part of the trusted documents is held out of the counts; a document's perplexity, shrunk to
its language's mean by PRIOR bytes, is compared with a quantile of theirs in its language.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fenced, materialise, shared_dir

ORDER = 5
#: Stands before documents; never a byte of UTF-8.
BOUNDARY = 0xFF
#: Bytes' worth of the language's mean that each document starts with.
PRIOR = 64
#: Held-out trusted documents' quantile beyond which a document goes.
QUANTILE = 0.999
#: One trusted document in HELD_OUT, by a hash of its id, is kept from the counts and sets the quantiles.
HELD_OUT = 5
#: Text bytes of a chunk, and those whose grams are listed at once.
CHUNK, PIECE = 32 << 20, 1 << 20
#: Costs are counted in parts of a bit, so that sums don't depend on their order.
PARTS = 10_000
#: Least probability of a gram.
LEAST = 1e-30
#: Stands for all languages together.
POOLED = "*"
_GAP = bytes([BOUNDARY]) * (ORDER - 1)


def grams(texts: list[bytes]) -> np.ndarray:
    """Code of the ORDER bytes that end at each place of the texts and the boundaries between them."""
    raw = np.frombuffer(_GAP + _GAP.join(texts) + _GAP, np.uint8)
    out = np.zeros(len(raw) - ORDER + 1, np.int64)
    for k in range(ORDER):
        out <<= 8
        out |= raw[k : k + len(out)]
    return out


def _pieces(column: pa.ChunkedArray) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of a string column's texts of about PIECE bytes (null is empty), and each run's first place: one run is held at a time."""
    upto = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < len(upto):
        stop = min(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE)) + 1, len(upto))
        yield at, [t or b"" for t in column.slice(at, stop - at).cast(pa.binary()).to_pylist()]
        at = stop


def _count(column: pa.ChunkedArray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of the wanted texts, ascending, and their counts; none that end in a boundary."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def merged() -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)

    for at, texts in _pieces(column):
        codes = grams([t for t, w in zip(texts, wanted[at:]) if w])
        held.append(np.unique(codes[codes & 255 != BOUNDARY], return_counts=True))
        if len(held) > 16:
            held = [merged()]
    return merged()


# --- chunks of rows


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs as chunks of about CHUNK text bytes: chunk, ids (array of doc ids), rows (Arrow stream, zstd).

    Written once, bucketed by chunk, so that joins on chunk move no rows. A longer text is a chunk
    of its own; rows keep all columns; an empty table has no chunks.
    """
    names = docs.columns
    at_text, at_id = names.index(text), names.index(doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seq = [], 0, 0

        def close() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                for some in held:
                    out.write_batch(some)
            chunk = (TaskContext.get().partitionId() << 32) + seq
            ids = [i for some in held for i in some.column(at_id).cast(pa.int64()).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "ids", "rows"])

        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column(at_text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                room = CHUNK - size + (upto[start - 1] if start else 0)
                stop = min(int(np.searchsorted(upto, room)) + 1, batch.num_rows)
                held.append(batch.slice(start, stop - start))
                size += int(upto[stop - 1] - (upto[start - 1] if start else 0))
                start = stop
                if size >= CHUNK:
                    yield close()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield close()

    spark = docs.sparkSession
    name = f"kn_rows_{uuid.uuid4().hex}"
    packed = docs.mapInArrow(run, "chunk long, ids array<long>, rows binary")
    # the table's files lie in the shared folder; its name lives as long as the session
    packed.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.read.table(name)


def _rows(packed: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(packed.column("rows")[0].as_buffer()).read_all()


def _beside(chunks: DataFrame, other: DataFrame, of: Callable[[pa.Table, pa.Table, int], pa.Table], schema) -> DataFrame:
    """`of` each chunk's rows, the rows of `other` that carry its number, and that number; no chunk moves."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return of(_rows(left), right, left.column("chunk")[0].as_py())

    return chunks.select("chunk", "rows").groupBy("chunk").cogroup(other.groupBy("chunk")).applyInArrow(both, schema)


# --- the model


def chunk_grams(chunks: DataFrame, trusted: DataFrame) -> DataFrame:
    """chunk, gram, n: each chunk's distinct grams and how often its trusted rows (chunk, row; row -1 is none) hold them; 0 for those of others only."""

    def count(rows: pa.Table, marked: pa.Table, chunk: int) -> pa.Table:
        fit = np.zeros(rows.num_rows, bool)
        at = marked.column("row").to_numpy()
        fit[at[at >= 0]] = True
        texts = rows.column("text")
        seen, n = _count(texts, fit)
        rest, _ = _count(texts, ~fit)
        rest = np.setdiff1d(rest, seen, assume_unique=True)
        codes = np.concatenate([seen, rest])
        return pa.table({"chunk": pa.array(np.full(len(codes), chunk)), "gram": pa.array(codes), "n": pa.array(np.concatenate([n, np.zeros(len(rest), np.int64)]))})

    return materialise(_beside(chunks, trusted, count, "chunk long, gram long, n long"), "kn-grams")


def _low(k: int) -> Column:
    """The last k bytes of a gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from an order's counts of counts; 0 where these don't tell."""
    n = counts.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in range(1, 5)]).first()
    if not n[0] + 2 * n[1]:
        return [0.0, 0.0, 0.0]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) if n[i - 1] else 0.0 for i in (1, 2, 3)]


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, p) of every gram seen, and (ctx, backoff), what a context leaves to the lower order.

    counts is gram, n of ORDER bytes. Lower orders count the distinct bytes before a gram. Each
    order is one join of grams with their contexts' totals and one with the lower order's
    probabilities, sharded by gram; a context has 256 grams at most.
    """
    orders = [counts]
    for k in range(ORDER - 1, 0, -1):
        orders.append(materialise(orders[-1].groupBy(_low(k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "kn-order"))
    model = []
    for k, table in enumerate(orders[::-1], 1):
        d = _discounts(table)
        kind = F.least("n", F.lit(3))
        off = F.when(kind == 1, d[0]).when(kind == 2, d[1]).otherwise(d[2])
        g = table.withColumn("ctx", F.shiftright("gram", 8)).withColumn("off", off)
        # whole counts by kind: no sum depends on its order
        totals = g.groupBy("ctx").agg(F.sum("n").alias("total"), *[F.count(F.when(kind == i, 1)).alias(f"c{i}") for i in (1, 2, 3)])
        left = (F.col("c1") * d[0] + F.col("c2") * d[1] + F.col("c3") * d[2]) / F.col("total")
        contexts = materialise(totals.select("ctx", "total", left.alias("backoff")), "kn-contexts")
        g = g.join(contexts, "ctx")
        if k == 1:
            low = F.lit(1 / 256)
        else:
            g = g.withColumn("suffix", _low(k - 1)).join(model[-1][0].select(F.col("gram").alias("suffix"), F.col("p").alias("low")), "suffix")
            low = F.col("low")
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("backoff") * low
        model.append((materialise(g.select("gram", p.alias("p")), "kn-p"), contexts.select("ctx", "backoff")))
    return model


def gram_costs(wanted: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """gram, cost: minus log2 of each gram's probability in 1/PARTS bits, for grams seen and unseen (wanted: gram, seen).

    An unseen gram's context, if seen, hands its share on to the gram without its first byte, order
    by order, down to one in 256.
    """
    seen = model[-1][0].select("gram", F.col("p"))
    rows = wanted.where("not seen").select("gram", F.lit(1.0).alias("w"), F.lit(None).cast("double").alias("p"))
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            known = model[k - 1][0].select(F.col("gram").alias("_code"), F.col("p").alias("_p"))
            rows = rows.withColumn("_code", _low(k)).join(known, "_code", "left").withColumn("p", F.coalesce("p", F.col("w") * F.col("_p"))).drop("_code", "_p")
        rows = rows.withColumn("ctx", F.shiftright(_low(k), 8)).join(model[k - 1][1], "ctx", "left")
        rows = rows.withColumn("w", F.when(F.col("p").isNull(), F.col("w") * F.coalesce("backoff", F.lit(1.0))).otherwise(F.col("w"))).drop("ctx", "backoff")
    rows = rows.select("gram", F.coalesce("p", F.col("w") / 256).alias("p"))
    return seen.unionByName(rows).select("gram", F.round(-F.log2(F.greatest("p", F.lit(LEAST))) * PARTS).cast("int").alias("cost"))


def text_costs(texts: pa.ChunkedArray, codes: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bytes and the summed cost of its grams, given the ascending codes of all of them and their costs."""
    out, length = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for at, some in _pieces(texts):
        g = grams(some)
        place = np.minimum(np.searchsorted(codes, g), max(len(codes) - 1, 0))
        upto = np.concatenate([[0], np.cumsum(cost[place])]) if len(codes) else np.zeros(len(g) + 1, np.int64)
        size = np.array([len(t) for t in some], np.int64)
        stop = np.cumsum(size + ORDER - 1) - (ORDER - 1)
        out[at : at + len(some)], length[at : at + len(some)] = upto[stop] - upto[stop - size], size
    return length, out


def score(chunks: DataFrame, costs: DataFrame) -> DataFrame:
    """chunk, row, doc_id, _lang, _n (bytes), _bits (in 1/PARTS bits) of every row, from its chunk's gram costs (chunk, gram, cost)."""

    def add(rows: pa.Table, known: pa.Table, chunk: int) -> pa.Table:
        codes, cost = known.column("gram").to_numpy(), known.column("cost").to_numpy().astype(np.int64)
        order = np.argsort(codes)
        length, bits = text_costs(rows.column("text"), codes[order], cost[order])
        lang = rows.column("lang").to_pylist()
        return pa.table({
            "chunk": pa.array(np.full(len(bits), chunk)), "row": pa.array(np.arange(len(bits))), "doc_id": rows.column("doc_id").cast(pa.int64()),
            "_lang": pa.array([x or "" for x in lang], pa.string()), "_n": pa.array(length), "_bits": pa.array(bits),
        })

    return _beside(chunks, costs, add, "chunk long, row long, doc_id long, _lang string, _n long, _bits long")


# --- decisions


def _shrunk(mean: Column) -> Column:
    """Bits a byte, of the document and PRIOR bytes of its language's mean."""
    return (F.col("_bits") / PARTS + PRIOR * mean) / (F.col("_n") + PRIOR)


def thresholds(held: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """_lang, _mean, _limit from held-out rows (_lang, _n, _bits): mean bits a byte, and the bits a byte a document may cost.

    _limit is the language's quantile. A language with fewer rows than the quantile needs to lie
    below their greatest (1 / (1 - quantile)) has the greater of that and its mean plus the pooled
    quantile of what documents lie above their language's mean. The row POOLED, of all languages
    together, serves those without held-out rows. There is none without any rows.
    """
    means = held.groupBy("_lang").agg((F.sum("_bits") / PARTS / F.sum("_n")).alias("_mean"), F.count(F.lit(1)).alias("_rows"))
    over = held.join(F.broadcast(means), "_lang").withColumn("_x", _shrunk(F.col("_mean")))
    own = over.groupBy("_lang").agg(F.percentile("_x", F.lit(quantile)).alias("_own"))
    above = over.groupBy().agg(F.percentile(F.col("_x") - F.col("_mean"), F.lit(quantile)).alias("_above"), (F.sum("_bits") / PARTS / F.sum("_n")).alias("_all"))
    rows = means.join(own, "_lang").withColumn("_one", F.lit(1)).join(F.broadcast(above.withColumn("_one", F.lit(1))), "_one")
    few = F.col("_rows") < 1 / (1 - quantile)
    own_limit = F.when(few, F.greatest("_own", F.col("_mean") + F.col("_above"))).otherwise(F.col("_own"))
    return rows.select("_lang", "_mean", own_limit.alias("_limit")).unionByName(above.where("_all is not null").select(F.lit(POOLED).alias("_lang"), F.col("_all").alias("_mean"), (F.col("_all") + F.col("_above")).alias("_limit")))


def judged(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds perplexity (of a byte), threshold and kept to rows with _lang, _n and _bits; limits is a row a language, so small."""
    pooled = limits.where(F.col("_lang") == POOLED).first() or {"_mean": None, "_limit": None}
    mean0, limit0 = (F.lit(pooled[name]).cast("double") for name in ("_mean", "_limit"))
    rows = scored.join(F.broadcast(limits.where(F.col("_lang") != POOLED)), "_lang", "left")
    bits, limit = _shrunk(F.coalesce("_mean", mean0)), F.coalesce("_limit", limit0)
    return (
        rows.withColumn("perplexity", F.round(F.pow(F.lit(2.0), bits), 6))
        .withColumn("threshold", F.round(F.pow(F.lit(2.0), limit), 6))
        .withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
        .drop("_mean", "_limit")
    )


def _judge(chunks: DataFrame, labels: DataFrame) -> DataFrame | None:
    """judged rows of all chunks, or None without trusted text."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = chunks.select("chunk", F.posexplode("ids").alias("row", "doc_id")).where("doc_id is not null")
    marked = ids.join(good, "doc_id").select("chunk", "row", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held"))
    marked = materialise(marked, "kn-trusted")
    every = chunks.select("chunk", F.lit(-1).cast("long").alias("row"))
    by_chunk = chunk_grams(chunks, marked.where("not held").select("chunk", F.col("row").cast("long").alias("row")).unionByName(every))
    corpus = materialise(by_chunk.groupBy("gram").agg(F.sum("n").alias("n")), "kn-corpus")
    counts = corpus.where("n > 0")
    if counts.isEmpty():
        return None
    costs = gram_costs(corpus.select("gram", (F.col("n") > 0).alias("seen")), kneser_ney(counts))
    scored = materialise(score(chunks, by_chunk.select("chunk", "gram").join(materialise(costs, "kn-costs"), "gram")), "kn-scored")
    held = scored.join(marked.where("held").select("chunk", "row"), ["chunk", "row"], "left_semi").where("_n > 0").select("_lang", "_n", "_bits")
    return judged(scored, materialise(thresholds(held), "kn-limits"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept for every document.

    Trusted are the documents labelled quality 1. A null or empty text has its language's mean
    perplexity and is kept; a null lang is a language of its own, as is ''; a language without
    held-out trusted text uses the threshold of all; without any trusted or held-out text
    everything is kept, the threshold null. Repeated rows get equal results; other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    found = _judge(pack(rows), labels)
    if found is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    return found.select("doc_id", F.when(F.col("_lang") != "", F.col("_lang")).alias("lang"), F.col("_n").alias("n_bytes"), "perplexity", "threshold", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, all columns; null, empty, repeated and other rows as in classify."""
    inner = fenced(docs, "doc_id", "text", "lang")
    chunks = pack(inner)
    found = _judge(chunks, labels)
    if found is None:
        return docs

    def drop(rows: pa.Table, gone: pa.Table, _: int) -> pa.Table:
        keep = np.ones(rows.num_rows, bool)
        out = gone.column("row").to_numpy()
        keep[out[out >= 0]] = False
        return rows.filter(pa.array(keep))

    # a row of its own for each chunk, so that chunks that lose nothing stay
    gone = found.where("not kept").select("chunk", "row").unionByName(chunks.select("chunk", F.lit(-1).cast("long").alias("row")))
    return _beside(chunks, gone, drop, inner.schema).toDF(*docs.columns)
