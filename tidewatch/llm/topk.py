"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt into blocks by a hash of their id; a block's dimensions are sorted into lists
once, and all queries pass over it. A list is read from its end of larger contributions for the
query's sign. At growing depths the rows just met are scored in full; the bound on all others is
the query's product with the values at that depth. A query stops when its bound is below its k-th
score. Each block's k best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import block_rows, packed, past_blocks, same_width, unpack, usable

#: Candidates of a block, at least and at most, and queries that pass together: bounds a task's memory.
CANDIDATES, QUERIES = (4096, 65536), 1024
#: Queries whose remaining rows are scored by one matrix product.
TOGETHER = 64
#: Products of components up to LARGE are summed in doubles without rounding (2**53 / 2**40 dimensions at least).
LARGE = 2.0**20
LEAST, MOST = -(2**63), 2**63 - 1


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v: usable vectors with every component x turned into floor(scale * x) / scale; scale is a power of two.

    The division keeps every finite component finite; from 2**46 on components are whole already.
    """
    rows = embeddings.where(usable(embeddings, "embedding") & F.col("vec_id").isNotNull())
    step = lambda x: F.when(F.abs(x) >= 2.0**46, x).otherwise(F.floor(x * float(scale)).cast("double") / float(scale))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), step).alias("v"))


def whole(x: float, scale: int) -> int:
    """scale * x, exactly, for a component of quantised."""
    return int(x) * scale if abs(x) >= 2.0**46 else int(x * scale)


def exact_scores(rows: np.ndarray, query: np.ndarray, scale: int) -> np.ndarray:
    """Integer inner products of any size, those beyond a long as the nearest long."""
    q = [whole(x, scale) for x in query.tolist()]
    return np.array([min(max(sum(whole(x, scale) * y for x, y in zip(r, q)), LEAST), MOST) for r in rows.tolist()], np.int64)


class SortedLists:
    """The candidates of one block with a sorted list of every dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)  # ascending
        self.values = np.take_along_axis(rows, self.order, 0)
        n, self.depths = len(ids), []
        depth = max(16, n // (16 * max(rows.shape[1], 1)))
        while depth < n:
            self.depths.append(depth)
            depth *= 2
        self.depths.append(n)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(query, depth): no row unseen at that depth scores more."""
        n = len(self.ids)
        at = np.minimum(np.array(self.depths), n - 1)
        return np.maximum(queries, 0) @ self.values[n - 1 - at].T + np.minimum(queries, 0) @ self.values[at].T

    def met(self, query: np.ndarray, depth: int) -> np.ndarray:
        """Rows among the first `depth` of a list, each read from its end of larger contributions."""
        n = len(self.ids)
        if depth >= n:
            return np.arange(n)
        seen = np.zeros(n, bool)
        seen[self.order[n - depth :, query > 0]] = True
        seen[self.order[:depth, query < 0]] = True
        return np.flatnonzero(seen)

    def search(self, queries: np.ndarray, owns: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Each query's k best scores but its own row's, best first, their ids, and how many rows were scored.

        A query reads on to the first depth whose bound is below the best score so far, since no
        k-th score can stop it sooner, until its bound is below its k-th score. Queries that then
        hold more than a quarter of all rows are scored against all of them together.
        """
        n, bounds = len(self.ids), self.bounds(queries)
        out: list = [None] * len(queries)
        rest = []
        for i, (query, own, bound) in enumerate(zip(queries, owns.tolist(), bounds)):
            j = 0
            while True:
                at = self.met(query, self.depths[j])
                if 4 * len(at) > n:
                    rest.append(i)
                    break
                found = self._best(self.rows[at] @ query, self.ids[at], own, k)
                # an unseen row of the same score could have a smaller id, so the bound must be below
                if len(found[0]) == k and bound[j] < found[0][-1]:
                    out[i] = (*found, len(at))
                    break
                later = np.flatnonzero(bound[j + 1 :] < found[0][0]) if len(found[0]) else []
                j = j + 1 + int(later[0]) if len(later) else len(self.depths) - 1
        for a in range(0, len(rest), TOGETHER):
            some = rest[a : a + TOGETHER]
            for i, scores in zip(some, queries[some] @ self.rows.T):
                out[i] = (*self._best(scores, self.ids, int(owns[i]), k), n)
        return out

    def _best(self, scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        other = ids != own
        best_ids, best = _first(scores[other], ids[other], k)
        return best, best_ids


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Block:
    """One block's candidates: sorted lists of those with small components, the others beside them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, scale: int):
        self.scale, self.all_ids, self.all_rows = scale, ids, rows
        large = np.abs(rows * scale).max(1, initial=0) > LARGE
        self.large_ids, self.large_rows = ids[large], rows[large]
        self.lists = SortedLists(ids[~large], rows[~large] * scale)

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each query's k best scores and their ids, best first; only components beyond LARGE take Python's integers."""
        out: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qids)
        large = np.abs(queries * self.scale).max(1, initial=0) > LARGE
        small = np.flatnonzero(~large)
        if len(self.lists.ids) and len(small):
            for i, (best, ids, _) in zip(small.tolist(), self.lists.search(queries[small] * self.scale, qids[small], k)):
                out[i] = best.astype(np.int64), ids
        for i, qid in enumerate(qids.tolist()):
            rows, ids = (self.all_rows, self.all_ids) if large[i] else (self.large_rows, self.large_ids)
            if len(ids):
                other = ids != qid
                best, own = out[i]
                ids, best = _first(np.concatenate([best, exact_scores(rows[other], queries[i], self.scale)]), np.concatenate([own, ids[other]]), k)
                out[i] = best, ids
        return out


def _pass(k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["qb"] < 0:
                    held = unpack(row)
                    block = Block(*held, scale)
                    continue
                qids, queries = unpack(row, "q_")
                if block is None or not len(qids):
                    continue
                if queries.shape[1] != held[1].shape[1]:
                    wide, queries = same_width(held[1], queries)
                    if wide is not held[1]:
                        held = held[0], wide
                        block = Block(*held, scale)
                found = block.search(qids, queries, k)
                query = np.repeat(qids, [len(ids) for _, ids in found])
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([i for _, i in found])), pa.array(np.concatenate([s for s, _ in found]))], names=["query_id", "vec_id", "score"])

    return run


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64, candidates: int | None = None, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products, ties to the smaller id.

    Queries are the rows whose vec_id `every` divides. Rows without an id, and vectors that are
    null, empty or hold null or non-finite components, take no part; a shorter vector ends in
    zeros. Of rows that repeat a query's id the least vector is the query, and none of them its
    candidate; other repeated rows are candidates each. Fewer candidates than k are all returned.
    """
    vecs = materialise(quantised(embeddings, scale), "topk")
    n, nq, width = vecs.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.size("v"))).first()
    candidates = candidates or block_rows(vecs, n, width or 1, *CANDIDATES)
    nc, nqb = n // candidates + 1, nq // queries + 1
    cand = packed(vecs.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(nc))), "cb", "vec_id", "v")
    asked = vecs.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = packed(asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(nqb))), "qb", "vec_id", "v")
    found = past_blocks(cand, "cb", nc, asked).mapInArrow(_pass(k, scale), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 20, every: int = 20, scale: int = 64) -> str:
    """top_k in DuckDB SQL, by comparing all pairs (vectors of one length)."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id::BIGINT AS query_id, rank::INTEGER AS rank, vec_id::BIGINT AS vec_id, score FROM r WHERE rank <= {k}"""
