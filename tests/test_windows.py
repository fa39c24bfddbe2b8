"""Window features, alarms and the central z-score: by plain loops, causality and odd inputs."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.windows import expanding_z, finite, percent_rank_past
from tidewatch.operators import alarms, detectors
from tidewatch.operators import features as f


def panel(spark, values, series="a"):
    rows = [(series, pd.Timestamp("2000-01-01") + pd.Timedelta(days=i), i, None if v is None or v != v else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame([(s, t.date(), i, v) for s, t, i, v in rows], "series_id string, ts date, t long, x double")


def column(df, c):
    return [r[c] for r in df.orderBy("series_id", "t").select(c).collect()]


def walk(n=300, seed=0, holes=True):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n)
    v[n // 2 : n // 2 + 40] = v[n // 2 : n // 2 + 40] * 3 + 1.5
    if holes:
        v[::37] = np.nan
    return v


def slow_expanding_z(v, roll, first, skip):
    smooth = pd.Series(v).rolling(roll, min_periods=1).mean().to_numpy()
    out = [None] * len(v)
    for t in range(max(first, skip), len(v)):
        past = smooth[skip:t]
        past = past[~np.isnan(past)]
        if len(past) >= 10 and not np.isnan(smooth[t]):
            sd = past.std(ddof=1)
            out[t] = (smooth[t] - past.mean()) / sd if sd > 1e-12 else 0.0
    return out


@pytest.mark.parametrize(("roll", "first", "skip"), [(10, 60, 0), (1, 30, 45), (5, 10, 0)])
def test_expanding_z(spark, roll, first, skip):
    v = walk()
    got = column(expanding_z(panel(spark, v), "x", roll=roll, min_expanding=first, skip=skip), "score")
    want = slow_expanding_z(v, roll, first, skip)
    assert [g is None for g in got] == [w is None for w in want]
    assert all(w is None or g == pytest.approx(w, abs=1e-9) for g, w in zip(got, want))


def test_flat_series_score_zero(spark):
    got = column(expanding_z(panel(spark, [2.0] * 100), "x"), "score")
    assert got[:60] == [None] * 60 and got[60:] == [0.0] * 40


@pytest.mark.parametrize("name", list(detectors.REGISTRY))
def test_detectors_are_causal_and_react(spark, name):
    """Changing the future leaves the past as it was; a volatile stretch raises the score."""
    a, b = walk(260, 1, False) * 0.01, walk(260, 1, False) * 0.01
    b[200:] *= 100
    df = panel(spark, a, "a").unionByName(panel(spark, b, "b")).withColumnRenamed("x", "ret")
    got = detectors.score_with(df, name).toPandas().pivot(index="t", columns="series_id", values="score")
    assert np.allclose(got["a"][:200].astype(float), got["b"][:200].astype(float), equal_nan=True)
    assert got["a"].notna().sum() > 100
    if name in ("rolling_vol", "cusum", "ewma_vol"):
        assert got["b"][205:].astype(float).mean() > got["a"][205:].astype(float).mean()


def test_cusum_is_the_recursion(spark):
    v = walk(200, 3, False)
    got = column(detectors.score_with(panel(spark, v).withColumnRenamed("x", "ret"), "cusum"), "score")
    z = (v - v[:60].mean()) / v[:60].std(ddof=1)
    up = down = 0.0
    for t in range(200):
        up, down = max(0, up + z[t] - 0.5), max(0, down - z[t] - 0.5)
        assert got[t] is None if t < 60 else got[t] == pytest.approx(max(up, down), abs=1e-9)


def test_linear_recursion_over_chunks(spark):
    v = walk(300, 4, False)
    s = 0.0
    got = column(f.linear_recursion(panel(spark, v), F.col("x"), 0.94, "s", chunk=16), "s")
    for t in range(300):
        s = 0.94 * s + v[t]
        assert got[t] == pytest.approx(s, abs=1e-9)


def test_percent_ranks(spark):
    v = [3.0, 1.0, None, 3.0, 2.0]
    assert column(percent_rank_past(panel(spark, v), "x", "p"), "p") == [1.0, 0.5, None, 1.0, 0.5]
    assert column(percent_rank_past(panel(spark, v), "x", "p", include_current=False), "p") == [None, 0.0, None, 1.0, pytest.approx(1 / 3)]


def test_persistence_onsets_and_cool_down(spark):
    on = [1, 1, 0, 1, 1, 1, 0, 0, 1, 1, 1, 1, 0]
    df = panel(spark, on).withColumn("flag", F.col("x") > 0)
    assert column(f.persistent(df, "flag", 3), "alarm") == [False] * 3 + [True] * 3 + [False] * 2 + [True] * 4 + [False]
    assert sum(column(df.withColumn("o", f.onsets("flag")), "o")) == 3
    cool = column(alarms.cool_down(df.withColumn("flag", F.col("t") == 3), "flag", 4), "in_cash")
    assert cool == [False] * 3 + [True] * 5 + [False] * 5


def test_thresholds_against_numpy(spark):
    v = walk(330, 5)
    got = column(alarms.quantile_threshold(panel(spark, v), "x", lookback=100, min_history=60), "threshold")
    for t in range(330):
        window = v[max(0, t - 105) : max(0, t - 5)]
        window = window[~np.isnan(window)]
        want = np.percentile(window, 95) if t >= 65 and len(window) >= 30 else None
        assert (got[t] is None) == (want is None) and (want is None or got[t] == pytest.approx(want))


def test_values_that_are_not_numbers_become_null(spark):
    df = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(finite(F.col("x"))).collect()] == [None, None, None, 1.0, None]


def test_interpolation_and_embedding(spark):
    got = column(f.interpolated(panel(spark, [None, 1.0, None, None, 4.0, None]), "x", "y"), "y")
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 4.0]
    rows = f.delay_embedding(panel(spark, [0.0, 1, 2, 3, 4]), "x", 2, 2).orderBy("t").collect()
    assert [r.x for r in rows] == [[2.0, 0.0], [3.0, 1.0], [4.0, 2.0]]


def test_prefix_moments_do_not_depend_on_blocks(spark):
    rng = random.Random(2)
    rows = [("a", i, [rng.random(), rng.random()]) for i in range(90)]
    df = spark.createDataFrame(rows, "series_id string, t long, x array<double>")
    key = lambda r: (r.t, r.i, r.j)
    a, b = (sorted(f.prefix_moments(df, block=k).collect(), key=key) for k in (7, 1000))
    assert all(x[:5] == y[:5] and x[5:] == pytest.approx(y[5:]) for x, y in zip(a, b)) and len(a) == 270
    x = np.array([r[2] for r in rows])
    last = [r for r in a if r.t == 89 and r.i == 0 and r.j == 1][0]
    assert last.sxy == pytest.approx((x[:, 0] * x[:, 1]).sum())


def test_empty_panels(spark):
    none = panel(spark, [])
    for df in (expanding_z(none, "x"), f.enriched(none.withColumn("x", F.array("x"))), f.persistent(none.withColumn("g", F.lit(True)), "g", 2), f.robust_z(none, "x", 5), f.ema(none, "x", 5)):
        assert df.count() == 0
