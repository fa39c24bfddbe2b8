"""Ranked lexical search on K2-treaps over the grid of terms and documents.

An index row covers one run of documents (a shard): the columns of its grid are the documents by
doc_id, the rows its terms, those of alike document counts that first occur near each other side
by side. The grid is a quadtree compressed level by level: four bits an inner cell for its
children, the largest impact below each cell as the difference from its parent's, and a cell with
one point ends there, with the point. An item descends the paths of all its terms' rows at once,
range of documents by range of documents, the one with the best sum of weighted maxima first,
until no range left can beat its k-th document.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Maximal runs of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Points and documents of a shard, a document more at most.
POINTS, DOCS = 1 << 19, 1 << 16
#: Bytes of a text that are split into terms together.
PIECE = 1 << 20
#: Bytes of items' terms in one block of queries, which the driver and every task hold.
ITEM_BYTES = 16 << 20
#: One shard in so many is searched first; what it finds bounds the search of the others.
SCOUTS = 8
#: Ranges that a search opens together, and cells after which it takes no further range.
RANGES, CELLS = 128, 16384

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
INDEX_SCHEMA = "n_docs long, doc_ids array<long>, terms array<binary>, dfs array<int>, height int, masks array<binary>, singles array<binary>, maxima array<binary>, points array<binary>"
_ARROW = pa.schema([
    ("n_docs", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int32())), ("height", pa.int32()),
    ("masks", pa.list_(pa.binary())), ("singles", pa.list_(pa.binary())), ("maxima", pa.list_(pa.binary())), ("points", pa.list_(pa.binary())),
])


def term_counts(raw: bytes) -> Counter:
    """Occurrences of each term of a UTF-8 text; long texts are split piece by piece."""
    spaced, out, at = raw.translate(_TABLE), Counter(), 0
    while len(spaced) - at > PIECE:
        stop = spaced.rfind(b" ", at, at + PIECE)
        if stop < 0:
            stop = spaced.find(b" ", at + PIECE)
        if stop < 0:
            break
        out.update(spaced[at:stop].split())
        at = stop
    out.update(spaced[at:].split())
    return out


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts with terms, and of their terms with repeats, a batch."""
    for batch in batches:
        n = [term_counts(t.as_buffer().to_pybytes()).total() for t in batch.column(0) if t.is_valid]
        yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["docs", "terms"])


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of x (below 2**31) at even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def _gather(x: np.ndarray) -> np.ndarray:
    """The even bits of x, side by side."""
    x = x & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | x >> np.uint64(shift)) & np.uint64(mask)
    return x.astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(raw: bytes, dtype: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype)


def build_treap(row: np.ndarray, col: np.ndarray, impact: np.ndarray, height: int) -> dict:
    """Levels of the quadtree over distinct points: for level 0 (the root) to `height` its cells in Morton order."""
    code = _spread(row) << np.uint64(1) | _spread(col)
    order = np.argsort(code)
    code, impact = code[order], impact[order].astype(np.int64)
    masks, singles, maxima, points = [], [], [], []
    # the cells of one level: first point, largest impact, difference to the parent's
    starts, counts = np.zeros(1, np.int64), np.array([len(code)])
    best = np.array([impact.max()])
    diff = best
    for level in range(height + 1):
        one = counts == 1
        singles.append(_packed(np.packbits(one)))
        maxima.append(_packed(diff.astype("<u4")))
        points.append(_packed(code[starts[one]].astype("<u8")))
        inner = ~one
        starts, counts, best = starts[inner], counts[inner], best[inner]
        if not len(starts):
            masks.append(_packed(np.zeros(0, np.uint8)))
            break
        cell = np.repeat(np.arange(len(starts)), counts)
        at = np.arange(len(cell)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        key = cell * 4 + (code[at] >> np.uint64(2 * (height - level - 1)) & np.uint64(3)).astype(np.int64)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        child = key[first]
        masks.append(_packed(np.bitwise_or.reduceat(np.uint8(1) << (child & 3).astype(np.uint8), np.flatnonzero(np.diff(child >> 2, prepend=-1)))))
        starts, counts = at[first], np.diff(first, append=len(key))
        parent = best[child >> 2]
        best = np.maximum.reduceat(impact[at], first)
        diff = parent - best
    return {"height": height, "masks": masks, "singles": singles, "maxima": maxima, "points": points}


_ONES = np.array([x.bit_count() for x in range(16)], np.int64)


class Treap:
    """One index row, searchable: cells of all levels in one numbering, level after level.

    A cell is a record of four integers, read together: of an inner cell the first child, -1, the largest
    impact and the mask of its children; of a cell with one point its row, its column, its impact and 0.
    """

    def __init__(self, row: dict):
        self.height = row["height"]
        levels, begin = [], 0
        for level, (mask, single, diff, point) in enumerate(zip(row["masks"], row["singles"], row["maxima"], row["points"])):
            diff = _unpacked(diff, "<u4").astype(np.int64)
            one = np.unpackbits(_unpacked(single, "u1"), count=len(diff)).astype(bool)
            top = diff if not level else np.repeat(inner_best, fan) - diff
            inner, code = _unpacked(mask, "u1"), _unpacked(point, "<u8")
            fan = _ONES[inner]
            begin += len(diff)
            cells = np.zeros((len(diff), 4), np.int32)
            cells[:, 2] = top
            cells[~one, 0], cells[~one, 1], cells[~one, 3] = begin + np.cumsum(fan) - fan, -1, inner
            cells[one, 0], cells[one, 1] = _gather(code >> np.uint64(1)), _gather(code)
            inner_best = top[~one]
            levels.append(cells)
        self.cells = np.concatenate(levels)

    def top(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int = 1) -> list[tuple[int, int]]:
        """(score, column) of the k best columns of at least `floor` by the weighted sum over rows, ties to the smaller column.

        A range holds, for each row with points in it, the record of its cell and its value.
        """
        found: list[tuple[int, int]] = []  # a heap whose least is the k-th: (score, -column)
        root = self.cells[0]
        if not root[3]:
            rows, weights = rows[rows == root[0]], weights[rows == root[0]]
        if not len(rows):
            return []
        value = weights * int(root[2])
        queue = [(-int(value.sum()), 0, 0, np.tile(root, (len(rows), 1)), rows, weights, value)]
        while queue:
            batch, cells = [], 0
            while queue and len(batch) < RANGES and cells < CELLS:
                score, start = -queue[0][0], queue[0][1]
                if score < floor or (len(found) == k and (score, -start) < found[0]):
                    queue.clear()
                    break
                entry = heapq.heappop(queue)
                level, col = entry[2], entry[3][:, 1]
                if level == self.height or (col[0] >= 0 and (col == col[0]).all()):
                    at = start if level == self.height else int(col[0])
                    (heapq.heappush if len(found) < k else heapq.heappushpop)(found, (score, -at))
                    continue
                batch.append(entry)
                cells += len(col)
            if batch:
                for entry in self._opened(batch):
                    if -entry[0] >= floor and (len(found) < k or (-entry[0], -entry[1]) > found[0]):
                        heapq.heappush(queue, entry)
        return sorted(((s, -c) for s, c in found), key=lambda x: (-x[0], x[1]))

    def _opened(self, batch: list[tuple]) -> Iterator[tuple]:
        """Both halves of every range, without the empty ones."""
        n = np.array([len(e[4]) for e in batch])
        cell, row, weight, value = (np.concatenate([e[i] for e in batch]) for i in (3, 4, 5, 6))
        shift = np.repeat([self.height - 1 - e[2] for e in batch], n)
        which = np.repeat(np.arange(len(batch)), n)
        mask, inner = cell[:, 3], cell[:, 3] > 0
        quarter = 2 * (row >> shift & 1)
        half_of_point = cell[:, 1] >> shift & 1
        for half in (0, 1):
            at = np.flatnonzero(np.where(inner, mask >> quarter & 1, half_of_point == half))
            old, deeper, r = cell[at], inner[at], row[at]
            child = old[:, 0] + _ONES[old[:, 3] & ((1 << quarter[at]) - 1)]
            new = np.where(deeper[:, None], self.cells[np.where(deeper, child, 0)], old)
            # a cell that ends with the point of another row
            own = ~deeper | (new[:, 3] > 0) | (new[:, 0] == r)
            if not own.all():
                at, new, r, deeper = at[own], new[own], r[own], deeper[own]
            quarter += 1
            if not len(at):
                continue
            w, of = weight[at], which[at]
            best = np.where(deeper, w * new[:, 2], value[at])
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            total = np.add.reduceat(best, begin)
            for a, b, score in zip(begin.tolist(), [*begin[1:].tolist(), len(at)], total.tolist()):
                _, start, level, *_ = batch[of[a]]
                yield (-score, start + (half << self.height - 1 - level), level + 1, new[a:b], r[a:b], w[a:b], best[a:b])


class _Shard:
    """Documents gathered until a shard is full."""

    def __init__(self):
        self.rows: dict[bytes, int] = {}
        self.ids, self.terms, self.counts, self.lengths = [], [], [], []
        self.points = 0

    def add(self, doc_id: int | None, counts: Counter) -> None:
        rows = self.rows
        self.ids.append(doc_id)
        self.terms.append(np.array([rows.setdefault(t, len(rows)) for t in counts], np.int32))
        self.counts.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.lengths.append(counts.total())
        self.points += len(counts)

    def index_row(self, n_docs: int, n_terms: int) -> dict:
        by = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        row, tf = np.concatenate([self.terms[i] for i in by]), np.concatenate([self.counts[i] for i in by])
        col = np.repeat(np.arange(len(by)), [len(self.terms[i]) for i in by])
        length = np.array([self.lengths[i] for i in by], np.int64)[col]
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * length * n_docs) // n_terms))
        df = np.bincount(row, minlength=len(self.rows))
        first = np.empty(len(df), np.int64)
        first[row[::-1]] = col[::-1]
        # rows by magnitude of their document count, then by first document
        order = np.lexsort((np.arange(len(df)), first, -np.log2(df).astype(int)))
        place = np.empty(len(df), np.int64)
        place[order] = np.arange(len(df))
        height = max(int(max(len(df), len(by)) - 1).bit_length(), 1)
        names = list(self.rows)
        return {"n_docs": len(by), "doc_ids": [self.ids[i] for i in by], "terms": [names[i] for i in order], "dfs": df[order].tolist(), **build_treap(place[row], col, impact, height)}


def build_index(docs: DataFrame) -> DataFrame:
    """The written index, a row a shard (INDEX_SCHEMA), of every row of docs (doc_id, text) that has a term; texts are not shuffled.

    Documents without a term (null and empty texts among them) are not in it; repeated rows are
    documents each; a null doc_id comes last among equals; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_docs, n_terms = rows.select("text").mapInArrow(_totals, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = term_counts(text.as_buffer().to_pybytes()) if text.is_valid else None
                if not counts:
                    continue
                shard.add(doc_id, counts)
                if shard.points >= POINTS or len(shard.ids) >= DOCS:
                    yield pa.RecordBatch.from_pylist([shard.index_row(n_docs, n_terms)], schema=_ARROW)
                    shard = _Shard()
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.index_row(n_docs, n_terms)], schema=_ARROW)

    return materialise(rows.mapInArrow(run, INDEX_SCHEMA), "treap")


def weighted_items(index: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, terms array<struct<term, w>>: the terms of each distinct item (item_id, text) that some document has, with their weights."""
    n_docs = index.agg(F.sum("n_docs")).first()[0] or 0
    found = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    asked = items.select(F.col("item_id"), "text").where("text is not null").distinct().select("item_id", "text", F.explode(found).alias("t")).withColumn("term", F.col("t").cast("binary"))
    pairs = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.dfs").alias("df"))
    df = pairs.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    return asked.join(df.select("term", w.alias("w")), "term").groupBy("item_id", "text").agg(F.collect_list(F.struct("term", "w")).alias("terms")).select("item_id", "terms")


def search_index(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, equal scores by doc_id (nulls last).

    An item's score of a document is the sum of weight times impact over the item's distinct terms.
    Rows of one item_id with different texts are answered each, equal rows once. Items without a
    term, or with none that a document has, give no rows; a null item_id is one like any other.
    """
    asked = weighted_items(index, items).withColumn("_bytes", F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t["term"]) + 16))
    asked = materialise(asked, "treap-items")
    blocks = (asked.agg(F.sum("_bytes")).first()[0] or 0) // ITEM_BYTES + 1
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)))
    out = None
    w = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    id_type = items.schema["item_id"].dataType.simpleString()
    scout = F.pmod(F.xxhash64("doc_ids"), F.lit(SCOUTS)) == 0
    for b in range(blocks):  # a block's bytes are bounded: it goes to every task
        part = asked.where(F.col("_block") == b).drop("_bytes", "_block").toArrow()
        first = materialise(_searched(index.where(scout), part, b, k, id_type, {}), "treap-first")
        # an item's k-th best so far: no document below it is among the best; one number an item
        kth = first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k).select("_item", "score").toArrow()
        floors = dict(zip(kth.column("_item").to_pylist(), kth.column("score").to_pylist()))
        both = first.unionByName(_searched(index.where(~scout), part, b, k, id_type, floors))
        out = both if out is None else out.unionByName(both)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(index: DataFrame, asked: pa.Table, block: int, k: int, id_type: str, known_floors: dict[int, int]) -> DataFrame:
    """_item, item_id, doc_id, score: every shard's candidates for one block of items, of at least the item's floor, where it has one."""
    flat = asked.column("terms").combine_chunks()
    term, weight = flat.flatten().field("term"), flat.flatten().field("w").to_numpy(zero_copy_only=False)
    known = pc.unique(term)
    number = pc.index_in(term, value_set=known).to_numpy(zero_copy_only=False)
    stops = np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    ids = asked.column("item_id").combine_chunks()
    n = len(ids)
    least = [known_floors.get((block << 40) + i, 1) for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: list[list[int]] = [[] for _ in range(n)]  # the k best scores so far in this task
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                place = pc.index_in(known, value_set=row.column("terms").flatten()).fill_null(-1).to_numpy(zero_copy_only=False)
                at = place[number]
                if not (at >= 0).any():
                    continue
                treap = Treap(row.select(["height", "masks", "singles", "maxima", "points"]).to_pylist()[0])
                doc_ids = row.column("doc_ids").flatten()
                items, cols, scores = [], [], []
                for item, (a, b) in enumerate(zip([0, *stops[:-1].tolist()], stops.tolist())):
                    here = (at[a:b] >= 0) & (weight[a:b] > 0)
                    best = floors[item]
                    top = treap.top(at[a:b][here].astype(np.int64), weight[a:b][here], k, max(least[item], best[0]) if len(best) == k else least[item])
                    for score, col in top:
                        (heapq.heappush if len(best) < k else heapq.heappushpop)(best, score)
                        items.append(item)
                        cols.append(col)
                        scores.append(score)
                if items:
                    yield pa.RecordBatch.from_arrays([pa.array([(block << 40) + x for x in items], pa.int64()), ids.take(pa.array(items)), doc_ids.take(pa.array(cols)), pa.array(scores, pa.int64())], names=["_item", "item_id", "doc_id", "score"])

    return index.select("doc_ids", "terms", "height", "masks", "singles", "maxima", "points").mapInArrow(run, f"_item long, item_id {id_type}, doc_id long, score long")


def oracle(k: int = 10) -> str:
    """build_index and search_index in DuckDB SQL."""
    found = lambda text: rf"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{TERM}')"
    return rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {found('text')} AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT rid, doc_id, terms, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM sized),
items AS (SELECT row_number() OVER () AS iid, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (SELECT DISTINCT iid, item_id, unnest({found('text')}) AS term FROM items),
held AS MATERIALIZED (
  SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, n, unnest(terms) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term, nd),
scores AS (
  SELECT iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nt))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), totals GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scores WHERE score > 0)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= {k}"""
