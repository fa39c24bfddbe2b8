"""Resampling of event studies from prefix sums: no row is multiplied by events or replicates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.windows import ordered, so_far

from .evaluate import CELL, cohens_d
from .inference import KEYS, drawn
from .joins import event_members


def valid_sums(scores: DataFrame) -> DataFrame:
    """series_id, method, ts, at, x, s, q: the at-th valid score (from 1) less the series' first one, and sums of x and its square so far."""
    w = so_far(ordered(*KEYS))
    x = scores.where("score is not null").withColumn("x", F.col("score") - F.first("score").over(w))
    return x.select(*KEYS, "ts", F.row_number().over(w).cast("long").alias("at"), "x", F.sum("x").over(w).alias("s"), F.sum(F.col("x") * F.col("x")).over(w).alias("q"))


def cell_places(sums: DataFrame, events: DataFrame, pad: int = 0) -> DataFrame:
    """CELL, a, n1, n, s1, q1, s, q: an event's valid rows are a + 1 to a + n1 of the series' n; sums of the event and of the series.

    Cells without a valid row inside or outside are left out.
    """
    total = sums.groupBy(*KEYS).agg(F.max("at").alias("n"), F.max_by("s", "at").alias("s"), F.max_by("q", "at").alias("q"))
    inside = event_members(sums.select(*KEYS, "ts", "at", "x"), events, pad).groupBy(*CELL)
    inside = inside.agg((F.min("at") - 1).alias("a"), F.count(F.lit(1)).alias("n1"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("q1"))
    return inside.join(total, list(KEYS)).where("n1 < n")


def spread(reps: DataFrame) -> DataFrame:
    """Replicates of cells dealt over all shuffle partitions: they are few bytes, so coalescing would leave their draws to one task."""
    return reps.repartition(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), *CELL, "rep")


def block_bootstrap(scores: DataFrame, events: DataFrame, replicates: int = 1000, seed: int = 7, level: float = 0.95, block: int | None = None, pad: int = 0) -> DataFrame:
    """CELL, n1, n2, ci_lo, ci_hi: quantiles of Cohen's d when each side's rows are drawn as circular blocks.

    Blocks have round(n^(1/3)) rows of their side's n, or `block` (1 draws single rows); the last is
    cut to n rows in all. Starts come from hashes, so reruns agree. A block's sums are differences
    of the series' prefix sums at its ends, where places outside an event jump over it: n / length
    look-ups a replicate. Limits are null with fewer than two valid rows on a side.
    """
    sums = valid_sums(scores)
    cells = cell_places(sums, events, pad)
    c = F.col
    side = F.explode(F.array(F.struct(F.lit(True).alias("inside"), c("n1").alias("m")), F.struct(F.lit(False).alias("inside"), (c("n") - c("n1")).alias("m")))).alias("_side")
    sides = cells.select(*CELL, "a", "n1", side).select(*CELL, "a", "n1", "_side.*")
    size = F.lit(block).cast("long") if block else F.greatest(F.round(F.cbrt("m")).cast("long"), F.lit(1).cast("long"))
    draws = spread(sides.withColumn("size", size).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))))
    draws = draws.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((c("m") - 1) / c("size")))))
    draws = draws.withColumn("x", F.pmod(drawn(F.lit(seed), "rep", *CELL, c("inside").cast("int"), "b"), c("m")))
    draws = draws.withColumn("y", c("x") + F.least(c("size"), c("m") - c("b") * c("size")))
    end = lambda at, sign: F.struct(at.alias("at"), F.lit(sign).alias("sign"))
    around = F.array(end(c("m"), 1), end(c("x"), -1), end(c("y") - c("m"), 1), end(F.lit(0).cast("long"), -1))
    ends = draws.withColumn("_e", F.explode(F.when(c("y") > c("m"), around).otherwise(F.array(end(c("y"), 1), end(c("x"), -1)))))
    after = ~c("inside") & (c("_e.at") > c("a"))
    place = F.when(c("inside"), c("_e.at") + c("a")).when(after, c("_e.at") + c("n1")).otherwise(c("_e.at"))
    ends = ends.select(*CELL, "rep", "inside", place.alias("at"), c("_e.sign").alias("sign"), F.when(after, c("_e.sign")).otherwise(0).alias("over")).where("at > 0")
    side_sum = lambda v, flag: F.sum(F.when(c("inside") == F.lit(flag), c("sign") * c(v)))
    g = ends.join(sums.select(*KEYS, "at", "s", "q"), [*KEYS, "at"]).groupBy(*CELL, "rep")
    g = g.agg(side_sum("s", True).alias("is"), side_sum("q", True).alias("iq"), side_sum("s", False).alias("os"), side_sum("q", False).alias("oq"), F.sum("over").alias("over"))
    g = g.join(cells.select(*CELL, "n1", (c("n") - c("n1")).alias("n2"), "s1", "q1"), list(CELL))
    var = lambda n, s, q: F.when(n > 1, F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))
    s2, q2 = c("os") - c("over") * c("s1"), c("oq") - c("over") * c("q1")
    m = g.select(*CELL, "n1", (c("is") / c("n1")).alias("m1"), var(c("n1"), c("is"), c("iq")).alias("v1"), "n2", (s2 / c("n2")).alias("m2"), var(c("n2"), s2, q2).alias("v2"))
    tail = (1 - level) / 2
    return cohens_d(m).groupBy(*CELL, "n1", "n2").agg(F.percentile("d", F.lit(tail)).alias("ci_lo"), F.percentile("d", F.lit(1 - tail)).alias("ci_hi"))


def subset_places(prefix: str, n: int, k: int) -> set[int]:
    """k different numbers of 1 to n, every such set as likely, from the md5 of `prefix` and a counter: each draw that is taken already gives its counter instead."""
    taken: set[int] = set()
    for j in range(n - k + 1, n + 1):
        at = int(hashlib.md5(f"{prefix}|{j}".encode()).hexdigest()[:8], 16) % j + 1
        taken.add(j if at in taken else at)
    return taken


def permutation_p(scores: DataFrame, events: DataFrame, replicates: int = 1000, seed: int = 11, pad: int = 0) -> DataFrame:
    """CELL, n1, n2, seen, p: difference of the means inside and outside an event, and (1 + permutations with as large a one) / (1 + replicates).

    A permutation only decides which rows count as inside: it is drawn as a set of n1 places of the
    series' n valid rows and met with those rows alone. Differences are compared to nine digits.
    """
    sums = valid_sums(scores)
    c = F.col
    gap = lambda inside: F.abs(inside / c("n1") - (c("s") - inside) / (c("n") - c("n1")))
    cells = cell_places(sums, events, pad).select(*CELL, "n1", "n", "s", F.round(gap(c("s1")), 9).alias("seen"))
    kinds = dict(cells.dtypes)
    names = [*CELL, "rep", "at"]
    schema = ", ".join(f"{k} {kinds[k]}" for k in CELL) + ", rep int, at long"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (*CELL, "rep", "n1", "n")]
            for i, (series, method, event, rep, n1, n) in enumerate(zip(*cols)):
                places = pa.array(sorted(subset_places(f"{seed}|{rep}|{series}|{method}|{event}", n, n1)), pa.int64())
                same = pa.array([i] * len(places), pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(same) for k in (*CELL, "rep")], places], names=names)

    reps = cells.select(*CELL, "n1", "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    drawn_sums = spread(reps).mapInArrow(draw, schema).join(sums.select(*KEYS, "at", "x"), [*KEYS, "at"]).groupBy(*CELL, "rep").agg(F.sum("x").alias("_s"))
    j = drawn_sums.join(cells, list(CELL)).withColumn("_hit", (F.round(gap(c("_s")), 9) >= c("seen")).cast("int"))
    return j.groupBy(*CELL).agg(F.max("n1").alias("n1"), F.max(c("n") - c("n1")).alias("n2"), F.max("seen").alias("seen"), ((F.sum("_hit") + 1) / (replicates + 1)).alias("p"))
