"""Result tables: registering runs, reading them back, comparing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(cells: DataFrame, path: str, run_id: str) -> None:
    """Appends a run's cells to a table partitioned by run."""
    cells.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def read_runs(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("run_id") == run_id) if run_id else df


def register_run(spark: SparkSession, path: str, run_id: str, created: int, note: str = "") -> None:
    """Appends a run to the register of runs."""
    spark.createDataFrame([(run_id, created, note)], "run_id string, created long, note string").coalesce(1).write.mode("append").parquet(path)


def canonical_run(register: DataFrame, note: str = "canonical") -> DataFrame:
    """The newest run that is marked as the canonical one: one row, run_id."""
    return register.where(F.col("note") == note).agg(F.max_by("run_id", F.struct("created", "run_id")).alias("run_id"))


def latest_run(runs: DataFrame, at: str = "created") -> DataFrame:
    """method, run_id: the newest run that has a method."""
    return runs.groupBy("method").agg(F.max_by("run_id", F.struct(at, "run_id")).alias("run_id"))


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """method, event, delta of d, and whether the cell is in both runs, added or removed."""
    b = after.select("method", "event", F.col("d").alias("d2"), F.lit(1).alias("_b"))
    a = before.select("method", "event", "d", F.lit(1).alias("_a"))
    state = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").otherwise("both")
    return a.join(b, ["method", "event"], "full").select("method", "event", (F.col("d2") - F.col("d")).alias("delta"), state.alias("state"))


def content_key(*columns: str):
    """A cache key of parameter columns."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on one machine, where that is unset."""
    import tempfile

    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-tidewatch-")


def kept_table(spark: SparkSession):
    """A function that writes a DataFrame into the shared folder and reads it back: cut off from what made it."""
    import uuid

    where = shared_folder(spark)

    def keep(df: DataFrame) -> DataFrame:
        path = f"{where}/kept-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
