"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are dealt into shards by a hash of their id. A shard's graph holds its distinct directions'
vectors as nodes; levels are drawn from a hash of the vector, links as insertion one by one in
hash order would set them (each node to `M` diversified neighbours among those before it, and
back), and kept as flat neighbour arrays. A search descends from the entry through the upper
levels and keeps a beam of `EF` on the lowest, for all queries of a block together; every shard's
best are scored exactly and merged. Vectors are scaled by powers of two, so that norms of very
large and very small ones are right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import matrix, packed, past_blocks, same_width, scaled, unpack, usable

#: Rows of a shard and bytes of its vectors, whatever the cluster: within it a graph's candidates are searched exhaustively.
SHARD, SHARD_BYTES = 4096, 32 << 20
QUERIES = 1024
M = 16
EF_BUILD, EF = 64, 100

INDEX_SCHEMA = "shard int, width int, ids array<long>, node_stops array<int>, data binary, nodes array<int>, neighbours array<binary>, degrees array<int>"
#: Similarities at once in memory while a graph is built: rows of the block by nodes.
_STRIP = 128


def _diverse(sims: np.ndarray, cand: np.ndarray, unit: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 none) up to `most`: those closer to the row than to any chosen one, then the nearest others."""
    n, c = cand.shape
    own = unit[np.maximum(cand, 0)]
    between = own @ own.transpose(0, 2, 1)
    chosen, count = np.zeros((n, c), bool), np.zeros(n, int)
    closest = np.full((n, c), -np.inf)  # similarity of each candidate to its nearest chosen one
    for t in range(c):
        take = (cand[:, t] >= 0) & (count < most) & (closest[:, t] < sims[:, t])
        chosen[:, t] = take
        count += take
        np.maximum(closest, np.where(take[:, None], between[:, :, t], -np.inf), out=closest)
    rank = np.where(chosen, 0, 1) * c + np.arange(c)
    rank[cand < 0] = 3 * c
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(cand, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _level(unit: np.ndarray, nodes: np.ndarray, m: int, most: int) -> np.ndarray:
    """Neighbour table (len(nodes) x most, node numbers, -1 padded) of one level; nodes in insertion order."""
    x, n = unit[nodes], len(nodes)
    src, dst = [], []
    for a in range(0, n, _STRIP):
        b = min(n, a + _STRIP)
        if b == 1:
            continue
        s = x[a:b] @ x[:b].T
        s[np.arange(b)[None, :] >= np.arange(a, b)[:, None]] = -np.inf
        c = min(EF_BUILD, b - 1)
        cand = np.argpartition(-s, c - 1, axis=1)[:, :c] if c < b else np.tile(np.arange(b), (b - a, 1))
        sims = np.take_along_axis(s, cand, 1)
        by = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, by, 1), np.take_along_axis(sims, by, 1)
        cand[np.isinf(sims)] = -1
        picked = _diverse(sims, cand, x, m)
        r, k = np.nonzero(picked >= 0)
        src.append(r + a)
        dst.append(picked[r, k])
    table = np.full((n, most), -1, np.int32)
    if not src:
        return table
    src, dst = np.concatenate(src), np.concatenate(dst)
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    sims = np.einsum("ij,ij->i", x[src], x[dst])
    by = np.lexsort((-sims, src))
    src, dst, sims = src[by], dst[by], sims[by]
    first = np.searchsorted(src, np.arange(n))
    place = np.arange(len(src)) - first[src]
    degree = np.bincount(src, minlength=n)
    # rows of like degree together; a hub's many links are weighed alone, none left out
    by = np.argsort(degree, kind="stable")
    at = 0
    while at < n:
        rows = by[at : at + (_STRIP if degree[by[min(at + _STRIP, n) - 1]] <= 3 * most else 1)]
        width = max(int(degree[rows].max()), 1)
        inside = np.full(n, -1)
        inside[rows] = np.arange(len(rows))
        part = np.flatnonzero(inside[src] >= 0)
        cand, near = np.full((len(rows), width), -1), np.full((len(rows), width), -np.inf)
        cand[inside[src[part]], place[part]], near[inside[src[part]], place[part]] = dst[part], sims[part]
        table[rows] = _diverse(near, cand, x, most)
        at += len(rows)
    out = np.where(table >= 0, nodes[np.maximum(table, 0)], -1)
    return out.astype(np.int32)


def build(ids: np.ndarray, rows: np.ndarray, m: int = M) -> dict:
    """The graph of one shard as flat arrays (INDEX_SCHEMA without shard); data holds the scaled vectors."""
    rows = scaled(rows)
    keys, inverse = np.unique(np.ascontiguousarray(rows).view([("", rows.dtype)] * rows.shape[1]).ravel(), return_inverse=True)
    vectors = keys.view(rows.dtype).reshape(len(keys), rows.shape[1])
    h = _hash(vectors)
    order = np.argsort(h, kind="stable")
    vectors, h = vectors[order], h[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    node = place[inverse.ravel()]
    by = np.lexsort((ids, node))
    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    draw = (h >> np.uint64(11)).astype(np.float64) / 2.0**53
    level = np.floor(-np.log(np.maximum(draw, 1e-300)) / np.log(m)).astype(int)
    level[0] = max(level.max(initial=0), level[0])
    tables, nodes = [], []
    for k in range(int(level[0]) + 1):
        at = np.flatnonzero(level >= k)
        nodes.append(len(at))
        full = np.full((len(vectors), 2 * m if k == 0 else m), -1, np.int32)
        full[at] = _level(unit, at, m, full.shape[1])
        tables.append(full if k == 0 else np.hstack([at[:, None].astype(np.int32), full[at]]))
    return {
        "width": rows.shape[1], "ids": ids[by].tolist(), "node_stops": np.searchsorted(node[by], np.arange(len(vectors)), side="right").tolist(), "data": vectors.tobytes(),
        "nodes": nodes, "neighbours": [t.tobytes() for t in tables], "degrees": [t.shape[1] for t in tables],
    }


def _hash(vectors: np.ndarray) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in vectors], np.uint64)


class Graph:
    """One shard's index row, searchable."""

    def __init__(self, row: dict):
        stops = np.asarray(row["node_stops"])
        self.ids, self.starts, self.stops = np.asarray(row["ids"], np.int64), np.concatenate([[0], stops[:-1]]), stops
        self.vectors = np.frombuffer(row["data"], np.float64).reshape(len(stops), row["width"])
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.unit = (self.vectors / self.norms[:, None]).astype(np.float32)
        tables = [np.frombuffer(t, np.int32).reshape(-1, d) for t, d in zip(row["neighbours"], row["degrees"])]
        self.base, self.upper = tables[0], []
        for t in tables[1:]:
            full = np.full((len(stops), t.shape[1] - 1), -1, np.int32)
            full[t[:, 0]] = t[:, 1:]
            self.upper.append(full)

    def beam(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """The nodes of each (unit, float32) query's beam, best first, -1 padded."""
        n, nq = len(self.unit), len(queries)
        at = np.zeros(nq, np.int64)
        near = queries @ self.unit[0]
        for table in self.upper[::-1]:
            moving = np.arange(nq)
            while len(moving):
                nb = table[at[moving]]
                s = np.where(nb >= 0, np.einsum("qkd,qd->qk", self.unit[np.maximum(nb, 0)], queries[moving]), -np.inf)
                k = s.argmax(1)
                best = s[np.arange(len(moving)), k]
                up = best > near[moving]
                moving, k, best, nb = moving[up], k[up], best[up], nb[up]
                at[moving], near[moving] = nb[np.arange(len(moving)), k], best
        nodes, sims, open_ = np.full((nq, ef), -1, np.int64), np.full((nq, ef), -np.inf, np.float32), np.zeros((nq, ef), bool)
        nodes[:, 0], sims[:, 0], open_[:, 0] = at, near, True
        seen = np.zeros((nq, n), bool)
        seen[np.arange(nq), at] = True
        live = np.arange(nq)
        while len(live):
            pick = open_[live].argmax(1)  # beams are sorted: the first open node is the best
            open_[live, pick] = False
            nb = self.base[nodes[live, pick]]
            new = (nb >= 0) & ~seen[live[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(new)
            seen[live[r], nb[r, c]] = True
            s = np.full(nb.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.unit[nb[r, c]], queries[live[r]])
            all_s = np.concatenate([sims[live], s], 1)
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
            sims[live] = np.take_along_axis(all_s, order, 1)
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], np.where(new, nb, -1)], 1), order, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], new], 1), order, 1)
            live = live[open_[live].any(1)]
        return nodes

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, cosines) of each query's k best found, its own id left out; ties to the smaller id."""
        if queries.shape[1] != self.vectors.shape[1]:
            wide, queries = same_width(self.vectors, queries)
            self.vectors, self.unit = wide, np.pad(self.unit, ((0, 0), (0, wide.shape[1] - self.unit.shape[1])))
        queries = scaled(queries)
        norms = np.linalg.norm(queries, axis=1)
        beams = self.beam((queries / norms[:, None]).astype(np.float32), max(ef, k + 1))
        for qid, q, norm, nodes in zip(qids.tolist(), queries, norms, beams):
            nodes = nodes[nodes >= 0]
            # Kept whole products, not BLAS sums of varying order: equal vectors get equal scores
            cos = (self.vectors[nodes] * q).sum(1) / (self.norms[nodes] * norm)
            ids = [self.ids[self.starts[v] : min(self.stops[v], self.starts[v] + k + 1)] for v in nodes]
            cos, ids = np.repeat(cos, [len(i) for i in ids]), np.concatenate(ids) if ids else np.zeros(0, np.int64)
            cos, ids = cos[ids != qid], ids[ids != qid]
            order = np.lexsort((ids, -cos))[:k]
            yield qid, ids[order], cos[order]


def nonzero(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part in cosine search."""
    v = F.col("embedding").cast("array<double>")
    ok = usable(embeddings, "embedding") & F.col("vec_id").isNotNull() & F.exists(v, lambda x: x != 0)
    return embeddings.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def build_index(embeddings: DataFrame, shard: int | None = None) -> tuple[DataFrame, int]:
    """The written index, a row a shard (INDEX_SCHEMA), and the number of shards; every usable row is in it."""
    rows = nonzero(embeddings)
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    shards = n // (shard or max(1, min(SHARD, SHARD_BYTES // (8 * (width or 1))))) + 1

    def graph(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        made = build(np.asarray(table.column("vec_id")), matrix(table.column("v").combine_chunks()))
        return pa.Table.from_pylist([{"shard": table.column("shard")[0].as_py(), **made}], schema=_ARROW)

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).select("shard", "vec_id", "v")
    return materialise(dealt.groupBy("shard").applyInArrow(graph, INDEX_SCHEMA), "hnsw"), shards


_ARROW = pa.schema([
    ("shard", pa.int32()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("node_stops", pa.list_(pa.int32())), ("data", pa.binary()),
    ("nodes", pa.list_(pa.int32())), ("neighbours", pa.list_(pa.binary())), ("degrees", pa.list_(pa.int32())),
])


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int = 5, ef: int = EF, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for queries (vec_id, v), every shard searched."""
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = queries.count() // block + 1
    asked = packed(asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "qb", "vec_id", "v")
    rows = past_blocks(index.drop("nodes"), "shard", shards, asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["qb"] < 0:
                    graph = Graph(row)
                    continue
                qids, q = unpack(row, "q_")
                if graph is None or not len(qids):
                    continue
                out: tuple[list, list, list] = ([], [], [])
                for qid, ids, cos in graph.search(qids, q, k, ef):
                    out[0].extend([qid] * len(ids))
                    out[1].extend(ids.tolist())
                    out[2].extend(cos.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50, ef: int = EF, shard: int | None = None) -> DataFrame:
    """Each query's k nearest by cosine; queries are the rows whose vec_id `every` divides.

    Rows without an id, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part; a shorter vector ends in zeros. Equal vectors share a node, so any
    number of copies is found through it, smaller ids first. Of rows that repeat a query's id the
    least vector is the query, and none its candidate. An empty table gives no rows.
    """
    index, shards = build_index(embeddings, shard)
    queries = nonzero(embeddings).where(F.col("vec_id") % every == 0)
    return search_index(index, shards, queries, k, ef)
