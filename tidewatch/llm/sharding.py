"""Reproducible global shuffle and sharding by a Feistel permutation (DataFrame functions only).

Rows get a global number 0 .. n-1 in an order that depends on their values alone. A keyed
Feistel network over Z_a x Z_b (a*b the smallest near-square cover of n) permutes the numbers;
values that fall outside 0 .. n-1 walk on along their cycle until they are inside. Position p
goes to shard p mod s, slot p div s, so shard sizes differ by one row at most, slots have no
gaps, and both shard and slot can be computed from a row number (and back) without any table.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PRIME, materialise, mixed, mixed_sql

#: Numbering buckets: bounds the offset table, and each window holds 1/4096 of the rows.
BUCKETS = 4096
ROUNDS = 6
#: Steps of cycle walking unrolled in the expression; a row that needed more raises an error.
WALK = 64


def grid(n: int) -> tuple[int, int]:
    """Sides a, b with a*b >= n and a*b - n < a."""
    a = max(1, isqrt(max(n, 1) - 1) + 1) if n > 1 else 1
    return a, -(-max(n, 1) // a)


def round_keys(seed: int) -> list[int]:
    return [(seed * 1_000_003 + i * 7_368_787 + 97) % PRIME for i in range(ROUNDS)]


def walk_steps(n: int) -> int:
    """Cycle steps that suffice: only a*b - n positions lie outside, so small inputs are covered surely."""
    a, b = grid(n)
    return min(WALK, a * b - n + 1)


def _round(v: Column, k: Column) -> Column:
    return F.element_at(F.transform(F.array((v * 48_271 + k) % PRIME), lambda t: (t * t + t * 69_621 + k) % PRIME), 1)


def _feistel(x: Column, n: int, seed: int, forward: bool = True) -> Column:
    a, b = grid(n)
    steps = [(i % 2 == 0, k) for i, k in enumerate(round_keys(seed))]
    rounds = F.array(*[F.struct(F.lit(even).alias("even"), F.lit(k).cast("long").alias("k")) for even, k in (steps if forward else steps[::-1])])
    sign = 1 if forward else -1

    def step(s: Column, c: Column) -> Column:
        return F.struct(
            F.when(c["even"], F.pmod(s["l"] + sign * _round(s["r"], c["k"]), F.lit(a))).otherwise(s["l"]).cast("long").alias("l"),
            F.when(c["even"], s["r"]).otherwise(F.pmod(s["r"] + sign * _round(s["l"], c["k"]), F.lit(b))).cast("long").alias("r"),
        )

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % b).cast("long").alias("r")) if n <= 2**52 else F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def permuted(x: Column, n: int, seed: int = 0, forward: bool = True) -> Column:
    """Position of row number x among n (or, with forward=False, the row number at position x)."""
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(walk_steps(n))),
        x.cast("long"),
        lambda v, i: F.when((i > 1) & (v < n), v).otherwise(_feistel(v, n, seed, forward)),
    )
    return F.element_at(F.transform(F.array(walked), lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("cycle walk left unfinished")).cast("long"))), 1)


def numbered(df: DataFrame, key: Column, order: list[str]) -> tuple[DataFrame, int]:
    """df with row_no 0 .. n-1, and n. Rows are ordered by hash bucket of key, then by `order` in it.

    The numbering depends on values only, never on partitions. Equal rows take adjacent numbers
    in some order, which leaves the result as a set of rows the same. df is read twice: pass a
    materialised one.
    """
    df = df.withColumn("_b", (mixed(key, 11) % BUCKETS).cast("int"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # at most BUCKETS rows: the window below and the broadcast are bounded by that constant
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    inside = Window.partitionBy("_b").orderBy(*order)
    out = df.withColumn("_i", F.row_number().over(inside) - 1).join(F.broadcast(offsets), "_b")
    return out.withColumn("row_no", (F.col("_off") + F.col("_i")).cast("long")).drop("_b", "_i", "_off"), n


def feistel_shards(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """Shard and slot of every document: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no.

    Law `rows`: shard sizes differ by one at most. A null text counts 16 bytes and has a null
    crc32; a null doc_id is numbered by its text; repeated rows get a place each; an empty table
    gives no rows; other columns are ignored. Texts never move: only (doc_id, size, crc) shuffle.
    """
    keys = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        ),
        "shard-keys",
    )
    rows, n = numbered(keys, F.coalesce("doc_id", "text_crc32", F.lit(0)), ["doc_id", "text_crc32", "size"])
    p = rows.withColumn("_p", permuted(F.col("row_no"), max(n, 1), seed))
    return p.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )


def oracle(shards: int = 40, seed: int = 0) -> str:
    """The same in DuckDB SQL, crc32 included (its 256-entry table comes from the polynomial's rule)."""
    ks = round_keys(seed)
    f = lambda v, k: f"list_transform([(({v}) * 48271 + {k}) % {PRIME}], lambda t: (t * t + t * 69621 + {k}) % {PRIME})[1]"
    ctes = []
    for i, k in enumerate(ks):
        if i % 2 == 0:
            ctes.append(f"SELECT row_no, n, a, b, x, step, (l + {f('r', k)}) % a AS l, r FROM prev")
        else:
            ctes.append(f"SELECT row_no, n, a, b, x, step, l, (r + {f('l', k)}) % b AS r FROM prev")
    inner = "SELECT row_no, n, a, b, x, step, x // b AS l, x % b AS r FROM (SELECT row_no, n, a, b, x, step FROM walk WHERE step = 0 OR x >= n)"
    for body in ctes:
        inner = body.replace("FROM prev", f"FROM ({inner})")
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, list_transform(range(8), lambda j: 0::BIGINT)),
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
keys AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 16 AS size,
    CASE WHEN text IS NULL THEN NULL ELSE xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, y: xor(c >> 8, t[((xor(c, y) & 255) + 1)::BIGINT]))) END AS text_crc32
  FROM documents, crc_table),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY b, doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS row_no, count(*) OVER () AS n
  FROM (SELECT *, {mixed_sql('coalesce(doc_id, text_crc32, 0)', 11)} % {BUCKETS} AS b FROM keys)),
sides AS (SELECT n, a, ((n + a - 1) // a)::BIGINT AS b FROM (SELECT DISTINCT n, ceil(sqrt(n::DOUBLE))::BIGINT AS a FROM numbered)),
walk(row_no, n, a, b, x, step) AS (
  SELECT row_no, numbered.n, a, sides.b, row_no, 0 FROM numbered JOIN sides USING (n)
  UNION ALL
  SELECT row_no, n, a, b, l * b + r, step + 1 FROM ({inner})),
placed AS (SELECT row_no, x AS p FROM walk WHERE step > 0 AND x < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INTEGER AS shard, (p // {shards})::BIGINT AS slot,
       NULL::INTEGER AS grown_shard, row_no::BIGINT AS row_no
FROM numbered JOIN placed USING (row_no)"""
