"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every word-based contract: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Modulus of the integer mixer, 2**31 - 1: products of two residues fit a BIGINT.
PRIME = 2_147_483_647


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table (all, if none are named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where unset, a fresh one on a single machine, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = getattr(spark, "_tidewatch_shared", None)
        if where is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="spark-tidewatch-")
            spark._tidewatch_shared = where
    return where


def materialise(df: DataFrame, label: str = "t", partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write df once into the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed(x: Column, salt: int = 0) -> Column:
    """A reproducible scrambling of an integer into 0 .. PRIME-1, in plain BIGINT arithmetic (see mixed_sql)."""
    k = 12_345 + 7_919 * salt
    t = F.pmod(x.cast("long"), F.lit(PRIME))
    t = (t * 48_271 + k) % PRIME
    return F.element_at(F.transform(F.array(t), lambda v: (v * v + v * 69_621 + k) % PRIME), 1)


def mixed_sql(x: str, salt: int = 0) -> str:
    """The same scrambling as a DuckDB expression."""
    k = 12_345 + 7_919 * salt
    t = f"(((({x})::BIGINT % {PRIME} + {PRIME}) % {PRIME}) * 48271 + {k}) % {PRIME}"
    return f"list_transform([({t})::BIGINT], lambda v: (v * v + v * 69621 + {k}) % {PRIME})[1]"


def fenced(df: DataFrame, *needed: str) -> DataFrame:
    """df with every column that is not needed renamed by its place, so that it can't clash with working columns."""
    return df.toDF(*[name if name in needed else f"_x{i}" for i, name in enumerate(df.columns)])
