"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule, a piecewise-linear multiplier over training time 0 .. 1.
Its target is its share of all words by weight, at most `most` times its own size, the excess
shared again by weight. A source's documents form a shuffled sequence that is passed over as often
as the target asks; the words drawn so far are its cumulative demand. The integral of the schedule
says which fraction of the demand is due by time t: inverting it gives each drawn document its
training position, and the result is range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PRIME, fenced, materialise, mixed, mixed_sql, word_count

#: Slices of each source's shuffled order. A source of any share is summed in this many tasks.
SLICES = 1024
#: Schedules by weight 1, 2, 3: (time, multiplier) knots. Rare sources fade, common ones grow.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (0.5, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(t0, width, m0, slope, cumulative share before) for each segment of a schedule, its integral being 1."""
    parts = [(t0, t1 - t0, m0, (m1 - m0) / (t1 - t0)) for (t0, m0), (t1, m1) in zip(knots, knots[1:])]
    total = sum(w * m + s * w * w / 2 for _, w, m, s in parts)
    out, done = [], 0.0
    for t0, w, m, s in parts:
        out.append((t0, w, m / total, s / total, done))
        done += w * m / total + s / total * w * w / 2
    return out


def time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which `share` of a source's demand is due: the inverse of the integrated schedule."""
    out = None
    for t0, w, m, s, before in segments(knots):
        q = share - F.lit(before)
        x = q / m if s == 0 else (F.sqrt(F.greatest(F.lit(m * m) + 2 * s * q, F.lit(0.0))) - m) / s
        t = F.lit(t0) + F.least(F.greatest(x, F.lit(0.0)), F.lit(w))
        out = t if out is None else F.when(share >= before, t).otherwise(out)
    return out


def _time_sql(share: str, knots: Sequence[tuple[float, float]]) -> str:
    out = ""
    for t0, w, m, s, before in segments(knots):
        q = f"({share} - {before!r})"
        x = f"({q} / {m!r})" if s == 0 else f"((sqrt(greatest({m * m!r} + {2 * s!r} * {q}, 0.0::DOUBLE)) - {m!r}) / {s!r})"
        t = f"({t0!r} + least(greatest({x}, 0.0::DOUBLE), {w!r}))"
        out = t if not out else f"CASE WHEN {share} >= {before!r} THEN {t} ELSE {out} END"
    return out


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """From (skey, source_size), one row a source: weight number, target.

    Water filling in closed form: by rising cap/weight, a source is capped when its cap is below
    its share of what the capped ones before it leave. The window runs over one row a source.
    """
    every = Window.orderBy("skey")
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), "skey")
    all_rows = Window.partitionBy(F.lit(0))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("_all", F.sum("source_size").over(all_rows))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_wleft", F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_capped", F.col("_cap") * F.col("_wleft") < F.col("_left") * F.col("_w"))
        .withColumn("_free", F.col("_all") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0)).over(all_rows))
        .withColumn("_wfree", F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("_w"))).over(all_rows))
    )
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_free").cast("double") * F.col("_w") / F.col("_wfree"))
    return s.select("skey", "source_size", F.col("_w").alias("weight"), F.coalesce(target, F.lit(0.0)).alias("target"))


def plan_mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, schedules=SCHEDULES) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken, copies, position.

    `copies` passes over the whole document are taken; `position` (0 .. 1) is that of the first,
    null when none is. Whole documents only: a source's taken words differ from its target by at
    most half of one document. A null text has size 0 and takes part with no words; a null
    source is a source of its own, the last; a null doc_id is shuffled by its size; repeated rows
    count each; a source without words has target 0 and no copies; an empty table gives no rows.
    """
    return _planned(docs, weights, most, schedules).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def _planned(docs: DataFrame, weights: Sequence[int], most: int, schedules, keep: tuple[str, ...] = ()) -> DataFrame:
    skey = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    size = word_count(F.col("text"))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), skey.alias("skey"), size.alias("size"), *[F.col(k) for k in keep])
    keys = keys.withColumn("_h", mixed(F.coalesce("doc_id", "size"), 23)).withColumn("_slice", F.floor(F.col("_h") * SLICES / PRIME).cast("int"))
    keys = materialise(keys, "mix-keys")
    sums = keys.groupBy("skey", "_slice").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("skey").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sums.groupBy("skey").agg(F.sum("_sum").alias("source_size"))
    offsets = sums.select("skey", "_slice", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_off")).join(source_targets(sizes, weights, most), "skey")
    inside = Window.partitionBy("skey", "_slice").orderBy("_h", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = keys.withColumn("_run", F.sum("size").over(inside)).join(offsets, ["skey", "_slice"])
    rows = rows.withColumn("_before", F.col("_off") + F.col("_run") - F.col("size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_base", F.floor(ratio).cast("long")).withColumn("_part", F.col("target") - F.col("_base") * F.col("source_size"))
    more = (F.col("_part") > 0) & (F.col("_before") + F.col("size") / 2.0 <= F.col("_part"))
    rows = rows.withColumn("copies", (F.col("_base") + more.cast("long")).cast("long"))
    rows = rows.withColumn("taken", F.col("size") * F.col("copies"))
    return rows.withColumn("position", F.when(F.col("copies") > 0, F.round(position(F.lit(0), weights, schedules), 9)))


def position(copy: Column, weights: Sequence[int], schedules=SCHEDULES) -> Column:
    """Training position of the copy-th pass over a planned document."""
    due = copy * F.col("source_size") + F.col("_before") + F.col("size") / 2.0
    share = F.when(F.col("target") > 0, F.least(due / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    out = F.lit(None).cast("double")
    for w, knots in zip(weights, schedules):
        out = F.when(F.col("weight") == w, time_of(share, knots)).otherwise(out)
    return out


def mix_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, schedules=SCHEDULES) -> DataFrame:
    """The mixed corpus itself: the columns of docs, one row a taken copy, range-sorted by training position.

    Rows are matched to their plan by a 64-bit hash of doc_id, source and text; among equal rows one
    carries the passes of all. See plan_mix for the defined cases.
    """
    names, docs = docs.columns, fenced(docs, "doc_id", "source", "text")
    cols = docs.columns
    rid = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))
    plan = _planned(docs.withColumn("_rid", rid), weights, most, schedules, ("_rid",))
    drawn = plan.where("copies > 0").select("_rid", "doc_id", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("_copy"), "source_size", "_before", "size", "target", "weight")
    drawn = drawn.select("_rid", "_copy", position(F.col("_copy"), weights, schedules).alias("_pos"))
    # repeated rows share a _rid: one of them carries the passes of all; window and join share the shuffle
    alike = Window.partitionBy("_rid").orderBy("_rid")
    first = docs.withColumn("_rid", rid).withColumn("_nth", F.row_number().over(alike)).where("_nth = 1")
    out = first.join(drawn, "_rid")
    return out.repartitionByRange(F.col("_pos"), F.col("doc_id")).sortWithinPartitions("_pos", "doc_id", "_copy").select(*cols).toDF(*names)


def oracle(weights: Sequence[int] = (1, 2, 3), most: int = 3, schedules=SCHEDULES) -> str:
    """plan_mix in DuckDB SQL."""
    at = "CASE weight " + " ".join(f"WHEN {w} THEN {_time_sql('share', k)}" for w, k in zip(weights, schedules)) + " END"
    return rf"""
WITH keys AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
hashed AS (SELECT *, {mixed_sql('coalesce(doc_id, size)', 23)} AS h FROM keys),
sources AS (
  SELECT skey, source_size, {list(weights)}[((row_number() OVER (ORDER BY skey) - 1) % {len(weights)} + 1)::BIGINT] AS weight
  FROM (SELECT skey, sum(size)::BIGINT AS source_size FROM hashed GROUP BY skey)),
caps AS (
  SELECT *, {most} * source_size AS cap, sum(source_size) OVER ()::BIGINT AS alls,
    sum(source_size) OVER ()::BIGINT - coalesce(sum({most} * source_size) OVER b, 0)::BIGINT AS lefts,
    sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT AS wleft
  FROM sources WINDOW b AS (ORDER BY ({most} * source_size)::DOUBLE / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, cap * wleft < lefts * weight AS capped FROM caps),
free AS (SELECT *, alls - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()::BIGINT AS fre, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()::BIGINT AS wfree FROM flagged),
targets AS (SELECT skey, source_size, weight, coalesce(CASE WHEN capped THEN cap::DOUBLE ELSE fre::DOUBLE * weight / wfree END, 0.0)::DOUBLE AS target FROM free),
rows AS (
  SELECT *, (sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM hashed JOIN targets USING (skey)),
based AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS base FROM rows),
parted AS (SELECT *, target - base * source_size AS part FROM based),
copied AS (SELECT *, base + CASE WHEN part > 0 AND before + size / 2.0::DOUBLE <= part THEN 1 ELSE 0 END AS copies,
  CASE WHEN target > 0 THEN least((before + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS share FROM parted)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies,
       CASE WHEN copies > 0 THEN round({at}, 9) END AS position
FROM copied"""
