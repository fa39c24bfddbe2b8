"""Hedges on signal, log-return performance and utility of scores against NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from tidewatch.operators import backtest as b


def brute(r):
    r = np.array([x for x in r if x is not None])
    up = np.exp(np.cumsum(r))
    dd = (1 - up / np.maximum.accumulate(up)).max()
    return len(r), r.mean() / r.std(ddof=1) * 252**0.5, dd, r.mean() * 252 / dd


def test_hedges_on_signal(spark):
    rng = np.random.default_rng(1)
    r, z = list(rng.normal(0, 0.02, size=80)), list(rng.normal(1, 1, size=80))
    r[7] = z[9] = z[40] = None
    rows = [("a", t, x, y) for t, (x, y) in enumerate(zip(r, z))]
    df = spark.createDataFrame([(s, t, None if x is None else float(x), None if y is None else float(y)) for s, t, x, y in rows], "series_id string, t long, ret double, z double")
    got = {g.strategy: g for g in b.hedge_timing(df.repartition(3), "z").collect()}
    flat = [0.0 if x is None else x for x in r]
    covered = [x * 0.9 - 0.0005 for x in flat]
    on, off = [y is not None and y > 1.5 for y in z], [y is not None and y <= 1.5 for y in z]
    want = {"none": (0.0, r), "always": (1.0, covered), "timed": (np.mean(on), [c if k else x for c, x, k in zip(covered, flat, on)]), "mistimed": (np.mean(off), [c if k else x for c, x, k in zip(covered, flat, off)])}
    assert set(got) == set(want)
    for k, (hedged, x) in want.items():
        g = got[k]
        assert g.hedged == pytest.approx(hedged) and (g.n, g.sharpe, g.max_drawdown, g.calmar) == pytest.approx(brute(x)), k


def test_performance_of_few_flat_and_rising_returns(spark):
    rows = [("few", t, 0.01 * (-1) ** t) for t in range(5)] + [("one", 0, -0.5)] + [("flat", t, 0.0) for t in range(40)] + [("up", t, 0.01 + t / 1000) for t in range(40)] + [("null", 0, None)]
    df = spark.createDataFrame(rows, "series_id string, t long, r double")
    got = {g.series_id: tuple(g)[1:] for g in b.log_performance(df, "r", ("series_id",)).collect()}
    assert got["few"] == (5, None, pytest.approx(1 - np.exp(-0.01)), None)
    assert got["one"] == (1, None, None, None) and got["flat"] == (40, None, 0.0, None)
    assert got["up"][1] > 0 and got["up"][2:] == (0.0, None) and "null" not in got
    assert b.log_performance(df.limit(0), "r", ("series_id",)).count() == 0


def test_utility_of_scores(spark):
    rng = np.random.default_rng(2)
    r, s = rng.normal(size=60), rng.normal(size=60)
    scores = spark.createDataFrame([("a", m, t, None if t < 5 else float(v)) for m, x in (("m", s), ("few", s[:20])) for t, v in enumerate(x)], "series_id string, method string, t long, score double")
    returns = spark.createDataFrame([("a", t, None if t == 9 else float(v)) for t, v in enumerate(r)], "series_id string, t long, ret double")
    got = {g.method: g for g in b.overlay_utility(scores, returns).collect()}
    at = [t for t in range(5, 60) if t != 9]
    held = np.where(s[at] > np.quantile(s[5:], 0.9), 0.2, 1.0) * r[at]
    sharpe = lambda x: x.mean() / x.std(ddof=1) * 252**0.5
    assert got["m"].utility == pytest.approx(sharpe(held)) and got["m"].gain == pytest.approx(sharpe(held) - sharpe(r[at]))
    assert got["few"].utility is None and got["few"].gain is None
