"""Thresholds and alarms on score series."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.folds import ordered_fold
from tidewatch.functions.windows import last_n, ordered

from .features import fixed_window_z, persistent


def quantile_threshold(df: DataFrame, score: str, lookback: int = 252, quantile: float = 0.95, gap: int = 5, min_history: int = 60, out: str = "threshold") -> DataFrame:
    """Quantile of the scores in [t - gap - lookback, t - gap), where half of min_history of them are valid."""
    w = ordered().rowsBetween(-(lookback + gap), -(gap + 1))
    thr = F.when((F.col("t") >= min_history + gap) & (F.count(score).over(w) >= min_history // 2), F.percentile(score, F.lit(quantile)).over(w))
    return df.withColumn(out, thr)


def expanding_threshold(df: DataFrame, score: str, quantile: float = 0.95, min_expanding: int = 60, out: str = "threshold") -> DataFrame:
    """Quantile of all earlier valid scores, from row min_expanding on; null where there are none.

    A running quantile from two heaps, the scores up to its rank and those above it: logarithmic time a row, and
    for its state one number for each earlier row of the series in hand.
    """

    def step(heaps, row):
        low, high = heaps  # low holds negated scores, its largest first
        t, x = row
        n = len(low) + len(high)
        at = (n - 1) * quantile
        value = None
        if n and t >= min_expanding:
            value = -low[0] + (at - int(at)) * (high[0] + low[0]) if high else -low[0]
        if x is not None:
            heapq.heappush(high, -heapq.heappushpop(low, -x))
            while len(low) < int(n * quantile) + 1:
                heapq.heappush(low, -heapq.heappop(high))
        return heaps, (value,)

    return ordered_fold(df, ["t", score], lambda: ([], []), step, f"{out} double")


def exceeds(df: DataFrame, score: str, threshold: str = "threshold", persistence: int = 3, out: str = "alarm") -> DataFrame:
    """raw (score > threshold) and the alarm kept for runs of `persistence` rows; nulls are no alarm."""
    df = df.withColumn("raw", F.coalesce(F.col(score) > F.col(threshold), F.lit(False)))
    return persistent(df, "raw", persistence, out)


def velocity_alarm(df: DataFrame, score: str, smoothing: int = 5, lookback: int = 252, z_threshold: float = 2.0, persistence: int = 2, min_history: int = 60) -> DataFrame:
    """velocity_z (change of the smoothed score against its last `lookback` rows) and velocity_alarm."""
    df = df.withColumn("_sm", F.avg(score).over(last_n(ordered(), smoothing)))
    df = df.withColumn("_v", F.when(F.col("t") == 0, F.when(F.col("_sm").isNotNull(), 0.0)).otherwise(F.abs(F.col("_sm") - F.lag("_sm").over(ordered()))))
    df = df.withColumn("velocity_z", F.when(F.col("t") >= min_history, fixed_window_z("_v", lookback, 10)))
    df = df.withColumn("_raw", F.coalesce(F.col("velocity_z") > z_threshold, F.lit(False)))
    return persistent(df, "_raw", persistence, "velocity_alarm").drop("_sm", "_v", "_raw")


def cool_down(df: DataFrame, alarm: str, n: int, out: str = "in_cash") -> DataFrame:
    """TRUE on an alarm and the n rows after it."""
    return df.withColumn(out, F.max(F.coalesce(F.col(alarm), F.lit(False))).over(ordered().rowsBetween(-n, 0)))
