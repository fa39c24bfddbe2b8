"""Near-duplicate groups by MinHash with sequential Bayesian verification.

1. Texts with the same shingle set form a class (exact copies never meet as pairs): sets are told
   apart by a 128-bit BLAKE2 digest. Half of it is the class's id; should two digests share that
   half, the second class gets another.
2. 64 bands of 8 minima put classes into buckets; classes that share buckets, directly or through
   others, form a cluster. At similarity 0.85 no band matches with probability 1.4e-9,
   at 0.80 with probability 8e-6.
3. Inside a cluster signatures are compared 32 minima at a time: a pair goes as soon as the
   posterior probability (uniform prior) of similarity >= threshold is below MISS. Survivors are
   verified on the full sets, unless the pair is connected already.
4. A cluster beyond BLOCK classes is cut into blocks. The first pass compares within blocks and
   with the cluster's first class; then members are ordered by the component so far, and only
   pairs of blocks that hold different components are compared. A tight group of any size is thus
   settled in linear work, and no pair of different components is left out.
5. Verified links join classes into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fenced, materialise
from .components import connected_components
from .shingles import band_keys, minhash, runs, shingle_set

ROWS = 8
#: Minima compared by the Bayesian test, and how many at a time.
SIGNATURE, BATCH = 128, 32
#: Chosen probability of pruning a pair that is a link, at each step.
MISS = 1e-8
#: Classes of a cluster that one task holds with their sets.
BLOCK = 1024
LOWEST = -(2**63)


def fewest_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each batch end n: the fewest equal minima m with P(similarity >= threshold | m of n) >= miss.

    The posterior of the uniform prior is Beta(m+1, n-m+1), whose tail is a binomial sum.
    """
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """Both halves of a shingle set's 128-bit digest, as signed integers."""
    return tuple(np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, cls, rest, bands, sigs = [], [], [], [], []
        for text in batch.column(2):
            s = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else None)
            n.append(len(s))
            one, two = set_digest(s) if len(s) else (None, None)
            cls.append(one)
            rest.append(two)
            m = minhash(s) if len(s) else None
            bands.append(band_keys(m, ROWS) if len(s) else None)
            sigs.append(m[:SIGNATURE].astype("<u2").tobytes() if len(s) else None)
        cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(rest, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n_shingles", "cls", "rest", "bands", "sig"])


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.up[at]
        while (deeper := self.up[up]).tobytes() != up.tobytes():
            up = deeper
        self.up[at] = up
        return up

    def join(self, a: int, b: int) -> bool:
        a, b = self.roots(np.array([a, b]))
        self.up[max(a, b)] = min(a, b)
        return a != b


def links(sets: list[np.ndarray], sigs: np.ndarray, label: np.ndarray, lefts: int, percent: int, fewest: list[int]) -> list[tuple[int, int]]:
    """Verified links that connect what `label` does not: of the first `lefts` members with the others (all pairs if there are none).

    A spanning choice: a pair that earlier links (or labels) connect is not looked at again.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    order = np.argsort(label, kind="stable")
    union = _Union(n)
    same = np.flatnonzero(np.diff(label[order]) == 0)
    for i in same:
        union.join(order[i], order[i + 1])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    mark = np.zeros(int(ids.max()) + 1, np.int32)
    out = []
    for i in range(min(lefts, n - 1)):
        js = np.arange(lefts if lefts < n else i + 1, n)
        js = js[(100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i]))]
        if len(js):
            js = js[union.roots(js) != union.roots(np.array([i]))[0]]
        matches = np.zeros(len(js), np.int64)
        for k, least in enumerate(fewest):
            if not len(js):
                break
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches = matches + (sigs[js, part] == sigs[i, part]).sum(1)
            js, matches = js[matches >= least], matches[matches >= least]
        if not len(js):
            continue
        own = ids[ends[i] - size[i] : ends[i]]
        mark[own] = 1
        for j in js[np.argsort(-matches, kind="stable")]:
            both = int(mark[ids[ends[j] - size[j] : ends[j]]].sum())
            if 100 * both >= percent * (size[i] + size[j] - both):
                out.append((i, int(j)))
                union.join(i, int(j))
        mark[own] = 0
    return out


def _compare(percent: int, keys: list[str]):
    """Links within each run of rows; a row's `side` 0 marks what is compared with the rest (all pairs if every side is 0)."""
    fewest = fewest_matches(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, keys):
            rows = list({r["cls"]: r for r in sorted(rows, key=lambda r: -r["side"])}.values())
            rows.sort(key=lambda r: (r["side"], r["cls"]))
            if len(rows) < 2:
                continue
            sets = [shingle_set((r["text"] or "").encode()) for r in rows]
            sigs = np.stack([np.frombuffer(r["sig"], "<u2") for r in rows])
            label = np.unique([r["label"] for r in rows], return_inverse=True)[1]
            lefts = sum(r["side"] == 0 for r in rows)
            found = links(sets, sigs, label, lefts, percent, fewest)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rows[x[k]]["cls"] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs, and text_hash, representative.

    Links need percent/100 or more of Jaccard similarity of five-word shingle sets; a text of fewer
    words is one shingle; a text without words (or null) has none and stands alone. Repeated rows
    are one class. component_id is the least doc_id of the group; a null doc_id never is one
    unless its whole group has none, and is kept only then. `representative` marks rows equal to
    the group's one survivor, told by (doc_id, hash of the text). Classes are told apart by 128-bit
    digests of their sets. An empty table gives no rows; other columns are ignored.
    """
    sketch = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(_sketch, "doc_id long, th long, n_shingles long, cls long, rest long, bands array<long>, sig binary")
    rows = _apart(materialise(sketch, "neardup-sketch"))
    did = F.coalesce("doc_id", F.lit(LOWEST))
    # the survivor is the least (has no id, doc_id, text hash)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), did.alias("did"), F.col("th").alias("th")))
    classes = rows.where("cls is not null").groupBy("cls").agg(first.alias("first"))
    classes = materialise(classes, "neardup-classes")
    bands = rows.join(classes, "cls").where((did == F.col("first.did")) & (F.col("th") == F.col("first.th"))).select("cls", F.explode("bands").alias("band"))
    w = Window.partitionBy("band")
    stars = bands.withColumn("least", F.min("cls").over(w)).where("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b")).distinct()
    clusters = materialise(connected_components(stars), "neardup-clusters").select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    found = _verified(docs, rows, classes, clusters, percent, block)
    roots = connected_components(found).select(F.col("node").alias("cls"), "root")
    comp = classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = comp.groupBy("root").agg(F.min("first").alias("group_first"))
    comp = comp.join(least, "root").select("cls", "group_first")
    out = rows.select("doc_id", "th", "n_shingles", "cls").join(comp, "cls", "left")
    own = F.struct(F.col("doc_id").isNull().alias("none"), did.alias("did"), F.col("th").alias("th"))
    out = out.withColumn("group_first", F.coalesce("group_first", own))
    component = F.when(~F.col("group_first.none"), F.col("group_first.did"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("th").alias("text_hash"), (F.col("group_first") == own).alias("representative"))


def _apart(rows: DataFrame) -> DataFrame:
    """rows without `rest`, their classes told apart by it: of digests that share `cls` all but the one of least `rest` get another id."""
    shared = rows.where("cls is not null").groupBy("cls").agg(F.min("rest").alias("_least"), F.max("rest").alias("_most")).where("_least <> _most")
    if shared.isEmpty():
        return rows.drop("rest")
    j = rows.join(shared, "cls", "left")
    other = F.when(F.col("rest") != F.col("_least"), F.xxhash64("cls", "rest")).otherwise(F.col("cls"))
    return materialise(j.withColumn("cls", other).select("doc_id", "th", "n_shingles", "cls", "bands", "sig"), "neardup-apart")


def _verified(docs: DataFrame, rows: DataFrame, classes: DataFrame, clusters: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) of classes that span every group."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    members = clusters.join(classes, "cls").select("cls", "cluster", F.col("first.did").alias("did"), F.col("first.th").alias("th"))
    sigs = rows.select("cls", did.alias("did"), "th", "sig")
    members = members.join(sigs, ["cls", "did", "th"]).dropDuplicates(["cls"])
    texts = docs.select(did.alias("did"), F.xxhash64("text").alias("th"), "text")
    members = materialise(texts.join(members, ["did", "th"]).select("cls", "cluster", "sig", "text"), "neardup-members")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("head"))
    placed = members.join(sizes, "cluster").withColumn("blk", F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / (block / 2)).cast("long")))
    placed = placed.withColumn("blk", F.when(F.col("n") <= block, F.lit(0).cast("long")).otherwise(F.col("blk")))
    first = placed.select("cluster", "blk", "cls", "sig", "text", F.lit(0).alias("side"), F.col("cls").alias("label"))
    # the cluster's first class goes to every block, so that members tied to it are settled at once
    heads = placed.where("cls = head and n > " + str(block)).withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / (block / 2)).cast("long") - 1)))
    first = first.unionByName(heads.select("cluster", "blk", "cls", "sig", "text", F.lit(0).alias("side"), F.col("cls").alias("label")))
    cols = ["cluster", "blk", "cls", "sig", "text", "side", "label"]
    found = materialise(first.select(cols).repartition("cluster", "blk").sortWithinPartitions("cluster", "blk").mapInArrow(_compare(percent, ["cluster", "blk"]), "a long, b long"), "neardup-links")
    large = sizes.where(F.col("n") > block)
    if large.isEmpty():
        return found
    return found.unionByName(_across(members, large, found, percent, block))


def _across(members: DataFrame, large: DataFrame, found: DataFrame, percent: int, block: int) -> DataFrame:
    """Second pass over large clusters: block pairs that hold different components."""
    roots = connected_components(found).select(F.col("node").alias("cls"), F.col("root").alias("label"))
    m = members.select("cls", "cluster").join(large.select("cluster", "n"), "cluster").join(roots, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    per = m.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k"))
    # labels lie one after the other in the cluster's order, a large one over blocks of its own
    w = Window.partitionBy("cluster").orderBy(F.col("k").desc(), "label").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("at", F.coalesce(F.sum("k").over(w), F.lit(0)))
    m = m.join(per, ["cluster", "label"]).withColumn("spot", F.col("at") + F.pmod(F.xxhash64("cls"), F.col("k")))
    m = materialise(m.select("cls", "cluster", "label", F.floor(F.col("spot") / (block / 2)).cast("int").alias("blk")), "neardup-blocks")
    blocks = m.groupBy("cluster", "blk").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = blocks, blocks.select("cluster", F.col("blk").alias("blk2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = x.join(y, "cluster").where("blk <= blk2 and not (lo = hi and lo2 = hi2 and lo = lo2)").select("cluster", "blk", "blk2")
    sides = pairs.select("cluster", F.col("blk").alias("own"), "blk", "blk2", F.lit(0).alias("side")).union(pairs.where("blk < blk2").select("cluster", F.col("blk2").alias("own"), "blk", "blk2", F.lit(1).alias("side")))
    full = members.select("cls", "sig", "text").join(m.withColumnRenamed("blk", "own"), "cls").join(sides, ["cluster", "own"])
    cols = ["cluster", "blk", "blk2", "cls", "sig", "text", "side", "label"]
    keys = ["cluster", "blk", "blk2"]
    return materialise(full.select(cols).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(percent, keys), "a long, b long"), "neardup-links2")


def keep_representatives(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs with one document of each near-duplicate group; all columns stay."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    kept = near_duplicates(docs, percent).where("representative").select(F.coalesce("doc_id", F.lit(LOWEST)).alias("_did"), F.col("text_hash").alias("_th")).distinct()
    keyed = fenced(docs, "doc_id", "text").withColumn("_did", did).withColumn("_th", F.xxhash64("text"))
    alike = Window.partitionBy("_did", "_th").orderBy("_did")
    out = keyed.join(kept, ["_did", "_th"], "left_semi").withColumn("_nth", F.row_number().over(alike))
    # rows without words stand alone, repeated or not
    return out.where((F.col("_nth") == 1) | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).drop("_did", "_th", "_nth").toDF(*docs.columns)
