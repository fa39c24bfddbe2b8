"""Merkle fixity audit of WARC replicas.

Records stand in files, each at an offset range. A replica's leaf is the SHA-256 of the bytes it
holds in that range; an inner node hashes its children's hashes in offset order, `fanout` at a
time, up to one root a file. Replicas are compared from the roots down: only the children of
mismatching nodes are read, so the work of an audit follows the damage, not the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mixed, mixed_sql
from .sharding import BUCKETS, numbered

FILE_RECORDS = 1024
FANOUT = 16
#: Hash of a range that a replica cannot read.
GONE = ""


def warc_record(url: Column, html: Column) -> Column:
    """The bytes of one WARC/1.1 resource record; null url and body count as empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(body.cast("binary"), 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def leaves(records: DataFrame, replicas: dict[str, Column], file_records: int = FILE_RECORDS) -> DataFrame:
    """Ordered offset ranges of records (record_id, record bytes) and each replica's digest of them.

    records has record_id (any integer, null allowed) and record (binary); a column of `replicas`
    gives the bytes that replica holds in the record's range, null if it cannot be read. One scan
    reads and hashes the bytes; only digests shuffle. Columns: file, ordinal, start, length,
    record_id and a digest for each replica's name. Files are full but the last.
    """
    hashed = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("_own"),
        *[F.coalesce(F.sha2(c, 256), F.lit(GONE)).alias(name) for name, c in replicas.items()],
    )
    rows, _ = numbered(materialise(hashed, "fixity-digests"), F.coalesce("record_id", "length", F.lit(0)), ["record_id", "_own", "length", *replicas])
    rows = rows.withColumn("file", F.floor(F.col("row_no") / file_records).cast("long")).withColumn("ordinal", (F.col("row_no") % file_records).cast("int"))
    before = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", "ordinal", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("start"), "length", "record_id", *replicas)


def tree(digests: DataFrame, hash_column: str, fanout: int = FANOUT, file_records: int = FILE_RECORDS) -> DataFrame:
    """All nodes of each file's tree: file, level (0: records), node, start, stop, hash."""
    level = digests.select("file", F.lit(0).alias("level"), F.col("ordinal").cast("int").alias("node"), "start", (F.col("start") + F.col("length")).alias("stop"), F.col(hash_column).alias("hash"))
    nodes, width, k = level, file_records, 0
    while width > 1:
        width, k = -(-width // fanout), k + 1
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))  # `fanout` at most
        level = level.groupBy("file", F.floor(F.col("node") / fanout).cast("int").alias("node")).agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), "").cast("binary"), 256).alias("hash")
        ).select("file", F.lit(k).alias("level"), "node", "start", "stop", "hash")
        nodes = nodes.unionByName(level)
    return nodes


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT, file_records: int = FILE_RECORDS) -> DataFrame:
    """Damaged ranges of two replicas' trees: file, node (ordinal), start, stop, both hashes.

    Starts with the roots and keeps, level by level, the children of nodes whose hashes differ; a
    node that one side lacks differs. Equal trees give no rows.
    """
    top, width = 0, file_records
    while width > 1:
        width, top = -(-width // fanout), top + 1
    a = left.select("file", "level", "node", "start", "stop", F.col("hash").alias("left_hash"))
    b = right.select("file", "level", "node", F.col("start").alias("_s"), F.col("stop").alias("_e"), F.col("hash").alias("right_hash"))
    suspects = None
    for k in range(top, -1, -1):
        x, y = a.where(F.col("level") == k), b.where(F.col("level") == k)
        if suspects is not None:
            x, y = (t.withColumn("_up", F.floor(F.col("node") / fanout).cast("int")).join(suspects, ["file", "_up"], "left_semi").drop("_up") for t in (x, y))
        pairs = x.join(y, ["file", "level", "node"], "full_outer").where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
        suspects = pairs.select("file", F.col("node").alias("_up"))
    return pairs.select("file", "node", F.coalesce("start", "_s").alias("start"), F.coalesce("stop", "_e").alias("stop"), "left_hash", "right_hash")


def damaged(record: Column, record_id: Column) -> Column:
    """A second replica with reproducible damage: about one record in 97 has a byte more, one in 101 is unreadable."""
    m = mixed(record_id, 41)
    return F.when(m % 101 == 0, F.lit(None)).when(m % 97 == 0, F.concat(record, F.lit("\0").cast("binary"))).otherwise(record)


def audit_pages(pages: DataFrame, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> DataFrame:
    """WARC records of pages, audited against a replica with reproducible damage: the damaged records.

    record_id, file, ordinal, start, stop, fault (changed or unreadable), both hashes. A null
    page_id is kept and numbered by its length; null url or html count as empty; repeated pages
    are records of their own; an empty table or an undamaged replica gives no rows.
    """
    records = pages.select(F.col("page_id").cast("long").alias("record_id"), warc_record(F.col("url"), F.col("html")).alias("record"))
    own = F.col("record")
    digests = materialise(leaves(records, {"first": own, "second": damaged(own, F.coalesce("record_id", F.lit(0)))}, file_records), "fixity-leaves")
    first, second = (materialise(tree(digests, c, fanout, file_records), f"fixity-{c}") for c in ("first", "second"))
    found = audit(first, second, fanout, file_records)
    index = digests.select("file", F.col("ordinal").alias("node"), "record_id")
    return found.join(index, ["file", "node"]).select(
        "record_id", "file", F.col("node").alias("ordinal"), "start", "stop",
        F.when(F.col("right_hash") == GONE, "unreadable").otherwise("changed").alias("fault"), "left_hash", "right_hash",
    )


def oracle(file_records: int = FILE_RECORDS) -> str:
    """audit_pages in DuckDB SQL, comparing every record."""
    return f"""
WITH bodies AS (SELECT page_id::BIGINT AS record_id, coalesce(url, '') AS url, coalesce(html, '') AS body FROM pages),
records AS (SELECT record_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
  || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || sha256(body) || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || octet_length(encode(body)) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM bodies),
hashed AS (SELECT *, octet_length(encode(record))::BIGINT AS length, sha256(record) AS left_hash, {mixed_sql('coalesce(record_id, 0)', 41)} AS m FROM records),
both_sides AS (SELECT *, CASE WHEN m % 101 = 0 THEN '' WHEN m % 97 = 0 THEN sha256(encode(record) || '\\x00'::BLOB) ELSE left_hash END AS right_hash,
  {mixed_sql('coalesce(record_id, length, 0)', 11)} % {BUCKETS} AS b FROM hashed),
placed AS (SELECT *, row_number() OVER (ORDER BY b, record_id NULLS FIRST, left_hash, length) - 1 AS row_no FROM both_sides),
ranged AS (SELECT *, row_no // {file_records} AS file, row_no % {file_records} AS ordinal,
  coalesce(sum(length) OVER (PARTITION BY row_no // {file_records} ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM placed)
SELECT record_id, file::BIGINT AS file, ordinal::INTEGER AS ordinal, start, start + length AS stop,
  CASE WHEN right_hash = '' THEN 'unreadable' ELSE 'changed' END AS fault, left_hash, right_hash
FROM ranged WHERE left_hash <> right_hash"""
