"""Vectors as packed blocks, and the pass of queries over blocks that searches run on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vector: str) -> Column:
    """True for vectors without null or non-finite components; an empty vector counts as null."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list<double> column as a matrix; shorter rows end in zeros."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), np.float64)
    width = max(width or 0, int(lengths.max()) if len(lengths) else 0)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def packed(df: DataFrame, key: str, id_col: str, vector: str) -> DataFrame:
    """One row a key: key, ids array<long>, width, data binary (row-major float64), in id order."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(id_col)
        m = matrix(table.column(vector).combine_chunks())
        ids = table.column(id_col).combine_chunks()
        return pa.table({key: [table.column(key)[0].as_py()], "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "width": pa.array([m.shape[1]], pa.int32()), "data": pa.array([m.tobytes()], pa.binary())}, schema=pa.schema([(key, pa.int32()), ("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("data", pa.binary())]))

    rows = df.select(F.col(key).cast("int").alias(key), F.col(id_col).cast("long").alias(id_col), F.col(vector).cast("array<double>").alias(vector))
    return rows.groupBy(key).applyInArrow(pack, f"{key} int, ids array<long>, width int, data binary")


def unpack(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(row[prefix + "ids"], np.int64)
    return ids, np.frombuffer(row[prefix + "data"], np.float64).reshape(len(ids), row[prefix + "width"])


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(m if m.shape[1] == w else np.pad(m, ((0, 0), (0, w - m.shape[1]))) for m in (a, b))


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is in [0.5, 1): sums of squares stay finite and above 0,
    and cosines are those of the rows themselves."""
    top = np.abs(m).max(1, initial=0)
    return np.ldexp(m, -np.frexp(top)[1][:, None])


def past_blocks(blocks: DataFrame, key: str, n: int, queries: DataFrame) -> DataFrame:
    """Rows for a pass of all packed queries (qb, ids, width, data) over n blocks (key from 0): in each partition a block's row
    (qb -1), then every query block (columns q_ids, q_width, q_data). Blocks move once and are never copied."""
    asked = queries.select("qb", *[F.col(c).alias(f"q_{c}") for c in ("ids", "width", "data")])
    asked = asked.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))))
    rows = blocks.withColumn("qb", F.lit(-1)).unionByName(asked, allowMissingColumns=True)
    return rows.repartitionById(max(n, 1), key).sortWithinPartitions(key, "qb")


def block_rows(df: DataFrame, n: int, width: int, least: int, most: int, held: int = 64 << 20) -> int:
    """Rows of a block: two blocks a core where n allows, but `least` to `most` rows and `held` bytes of float64 at most."""
    share = -(-n // (2 * df.sparkSession.sparkContext.defaultParallelism))
    return max(1, min(max(share, least), most, held // (8 * max(width, 1))))


def result_batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for cols in rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
