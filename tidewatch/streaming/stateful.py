"""Keyed, watermarked stateful operators. Each equals its batch twin on replayed input (tests/test_streaming.py replays all).

State is kept per series by transformWithStateInPandas-style processors over RocksDB. Rows of a
micro-batch are sorted by time; rows at or before a key's last time are late and dropped, and
counted in the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a replay that one partition of the state takes.
PARTITION_ROWS = 100_000


@contextmanager
def state_settings(spark: SparkSession, rows: int):
    """For queries that begin inside: RocksDB state, in one partition a core, or one for 100,000 of `rows` if these are more.

    A stateful step opens and commits the stores of all its partitions in every batch, also where they are empty, so
    their number follows the stream and not the session's shuffles (which it never exceeds).
    """
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-rows // PARTITION_ROWS)))
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_PROVIDER, "spark.sql.shuffle.partitions": str(n)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


class Fold(StatefulProcessor):
    """A per-key fold: subclasses give `fields` (state DDL), `start`, and `step(state, row) -> (state, output)`."""

    fields = ""
    outputs: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", f"last timestamp, late long, {self.fields}")

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, value: float | None) -> tuple[tuple, tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._state.get() if self._state.exists() else None
        last, late, state = (held[0], held[1], tuple(held[2:])) if held else (None, 0, self.start())
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        out = []
        for ts, v in zip(batch["ts"], batch["value"]):
            ts = pd.Timestamp(ts).to_pydatetime()
            if last is not None and ts <= last:
                late += 1
                continue
            state, made = self.step(state, None if v is None or pd.isna(v) else float(v))
            last = ts
            out.append((key[0], ts, *made))
        self._state.update((last, late, *state))
        if out:
            yield pd.DataFrame(out, columns=["series_id", "ts", *self.outputs])

    def close(self) -> None:
        pass


class Welford(Fold):
    """Running count, mean and sample variance."""

    fields, outputs = "n long, mean double, m2 double", ("n", "mean", "variance")
    schema = "series_id string, ts timestamp, n long, mean double, variance double"

    def start(self):
        return (0, 0.0, 0.0)

    def step(self, s, v):
        n, mean, m2 = s
        if v is not None:
            n += 1
            d = v - mean
            mean += d / n
            m2 += d * (v - mean)
        return (n, mean, m2), (n, mean, m2 / (n - 1) if n > 1 else None)


class Cusum(Fold):
    """Two-sided CUSUM, standardised by the first `warm` values."""

    fields, outputs = "n long, mean double, m2 double, up double, down double", ("score",)
    schema = "series_id string, ts timestamp, score double"

    def __init__(self, k: float = 0.5, warm: int = 60):
        self.k, self.warm = k, warm

    def start(self):
        return (0, 0.0, 0.0, 0.0, 0.0)

    def step(self, s, v):
        n, mean, m2, up, down = s
        if n < self.warm:
            if v is not None:
                n += 1
                d = v - mean
                mean += d / n
                m2 += d * (v - mean)
            return (n, mean, m2, up, down), (None,)
        sd = np.sqrt(m2 / max(n - 1, 1))
        z = 0.0 if v is None or sd <= 1e-12 else (v - mean) / sd
        up, down = max(0.0, up + z - self.k), max(0.0, down - z - self.k)
        return (n, mean, m2, up, down), (max(up, down),)


class Ewma(Fold):
    """s = decay s + (1 - decay) v^2, begun with the first square; its root."""

    fields, outputs = "n long, s double", ("vol",)
    schema = "series_id string, ts timestamp, vol double"

    def __init__(self, decay: float = 0.94):
        self.decay = decay

    def start(self):
        return (0, 0.0)

    def step(self, state, v):
        n, s = state
        v = v or 0.0
        s = v * v if n == 0 else self.decay * s + (1 - self.decay) * v * v
        return (n + 1, s), (float(np.sqrt(s)),)


class CoolDown(Fold):
    """in_cash on a value above the threshold and the n rows after it."""

    fields, outputs = "left long", ("in_cash",)
    schema = "series_id string, ts timestamp, in_cash boolean"

    def __init__(self, threshold: float, n: int):
        self.threshold, self.n = threshold, n

    def start(self):
        return (-1,)

    def step(self, s, v):
        left = self.n if v is not None and v > self.threshold else s[0] - 1 if s[0] >= 0 else -1
        return (left,), (left >= 0,)


class Evidence(Fold):
    """Decayed log-likelihood ratio of one channel with barriers and resets."""

    fields, outputs = "n long, k long, mean double, m2 double, e double", ("evidence", "alarm")
    schema = "series_id string, ts timestamp, evidence double, alarm boolean"

    def __init__(self, min_expanding: int = 60, decay: float = 0.95, upper: float = 2.995732, lower: float = -2.995732):
        self.args = min_expanding, decay, upper, lower

    def start(self):
        return (0, 0, 0.0, 0.0, 0.0)

    def step(self, s, v):
        n, k, mean, m2, e = s
        first, decay, upper, lower = self.args
        alarm = False
        if n < first:
            e = 0.0
        else:
            llr = v / max(np.sqrt(m2 / (k - 1)), 1e-8) - 0.5 if v is not None and k >= 20 else 0.0
            e = decay * e + llr
            alarm = bool(e >= upper)
            e = 0.0 if alarm or e <= lower else e
        if v is not None:
            k += 1
            d = v - mean
            mean += d / k
            m2 += d * (v - mean)
        return (n + 1, k, mean, m2, float(e)), (float(e), alarm)


class BayesFilter(Fold):
    """P(crisis) of a sticky two-regime Gaussian filter; regime moments from the first `warm` values, split at their 80 % quantile of size."""

    fields, outputs = "n long, seen array<double>, m0 double, s0 double, m1 double, s1 double, p double", ("p_crisis",)
    schema = "series_id string, ts timestamp, p_crisis double"

    def __init__(self, warm: int = 126, stay: float = 0.98):
        self.warm, self.stay = warm, stay

    def start(self):
        return (0, [], 0.0, 1.0, 0.0, 1.0, 0.1)

    def step(self, s, v):
        n, seen, m0, s0, m1, s1, p = s
        if n < self.warm:
            seen = [*seen, v] if v is not None else seen
            if n + 1 == self.warm and len(seen) > 10:
                a = np.array(seen)
                cut = np.percentile(np.abs(a), 80)
                lo, hi = a[np.abs(a) <= cut], a[np.abs(a) > cut]
                m0, s0, m1, s1 = float(lo.mean()), float(max(lo.std(), 1e-8)), float(hi.mean()), float(max(hi.std(), 1e-8))
                seen = []
            return (n + 1, list(seen), m0, s0, m1, s1, p), (None,)
        prior = p * self.stay + (1 - p) * (1 - self.stay)
        if v is not None:
            l0, l1 = (-0.5 * ((v - m) / sd) ** 2 - np.log(sd) for m, sd in ((m0, s0), (m1, s1)))
            prior = 1 / (1 + (1 - prior) / prior * np.exp(np.clip(l0 - l1, -500, 500)))
        p = float(min(max(prior, 0.001), 0.999))
        return (n + 1, list(seen), m0, s0, m1, s1, p), (p,)


class PercentileScore(Fold):
    """2 |percentile - 1/2| of a value among the last `keep` ones, from `least` on."""

    fields, outputs = "seen array<double>", ("score",)
    schema = "series_id string, ts timestamp, score double"

    def __init__(self, keep: int = 500, least: int = 60):
        self.keep, self.least = keep, least

    def start(self):
        return ([],)

    def step(self, s, v):
        seen = list(s[0])
        if v is None:
            return (seen,), (None,)
        seen = [*seen, v][-self.keep :]
        pct = sum(x <= v for x in seen) / len(seen)
        return (seen,), (2 * abs(pct - 0.5) if len(seen) >= self.least else None,)


class Transition(Fold):
    """A change of the running mean of the last `window` values beyond a threshold, `apart` rows at least after the last."""

    fields, outputs = "n long, seen array<double>, last_mean double, taken long", ("transition",)
    schema = "series_id string, ts timestamp, transition boolean"

    def __init__(self, window: int = 5, threshold: float = 1.0, apart: int = 10):
        self.args = window, threshold, apart

    def start(self):
        return (0, [], None, -(2**31))

    def step(self, s, v):
        n, seen, last, taken = s
        window, threshold, apart = self.args
        seen = [*seen, *([v] if v is not None else [])][-window:]
        mean = float(np.mean(seen)) if seen else None
        hit = bool(last is not None and mean is not None and abs(mean - last) > threshold and n - taken >= apart)
        return (n + 1, list(seen), mean, n if hit else taken), (hit,)


def batch_twin(df: DataFrame, processor: Fold) -> DataFrame:
    """The same fold over a finished table (series_id, ts, value), one group a key."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        state, last, out = processor.start(), None, []
        for ts, v in zip(*(pdf.sort_values("ts", kind="stable")[c] for c in ("ts", "value"))):
            if last is not None and ts <= last:
                continue
            state, made = processor.step(state, None if v is None or pd.isna(v) else float(v))
            last = ts
            out.append((key[0], ts, *made))
        return pd.DataFrame(out, columns=["series_id", "ts", *processor.outputs])

    return df.select("series_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).groupBy("series_id").applyInPandas(run, processor.schema)


def stream(df: DataFrame, processor: Fold, watermark: str = "1 day") -> DataFrame:
    """A streaming DataFrame (series_id, ts timestamp, value) through a processor; needs the RocksDB state provider."""
    rows = df.select("series_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).withWatermark("ts", watermark)
    return rows.groupBy("series_id").transformWithStateInPandas(processor, outputStructType=processor.schema, outputMode="Append", timeMode="None")


def replay(spark: SparkSession, source: DataFrame, table: str, checkpoint: str) -> None:
    """Runs a streaming DataFrame over all available input into an in-memory table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    q = source.writeStream.outputMode("append").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def replayed(df: DataFrame, processor: Fold, folder: str, slices: int = 3) -> DataFrame:
    """A finished table (series_id, ts, value) as a stream: what the processor emits.

    The table is cut by time into slices of files; after each slice arrives, the query is started
    from its checkpoint, takes what is available and stops, so that state outlives restarts. Results
    go to files. `folder` is one that all executors share. An empty table emits nothing.
    """
    import uuid

    spark = df.sparkSession
    from tidewatch.sources.results import kept_table

    rows = kept_table(spark)(df.select("series_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")))
    lo, hi, n = rows.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts")), F.count(F.lit(1))).first()
    if lo is None:
        return spark.createDataFrame([], processor.schema)
    root = f"{folder}/stream-{uuid.uuid4().hex}"
    part = F.floor((F.unix_timestamp("ts") - lo) * slices / (hi - lo + 1))
    with state_settings(spark, n):
        for k in range(slices):
            rows.where(part == k).write.mode("append").parquet(f"{root}/in")
            source = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
            q = stream(source, processor).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    return spark.read.schema(processor.schema).parquet(f"{root}/out")


def tick_bars(ticks: DataFrame, series: str, value: str, width: str = "1 hour", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Event-time windows of a (streaming or finished) tick table: count, sum, least, largest."""
    t = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return t.groupBy(F.window("ts", width, slide or width).alias("w"), F.col(series).alias("series_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high")).select("series_id", F.col("w.start").alias("ts"), "n", "total", "low", "high")


def alarm_sessions(alarms: DataFrame, gap: str = "3 days", watermark: str = "1 day") -> DataFrame:
    """Episodes of alarms (series_id, ts): alarms closer than `gap` belong together."""
    t = alarms.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return t.groupBy(F.session_window("ts", gap).alias("w"), "series_id").agg(F.count(F.lit(1)).alias("n")).select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
