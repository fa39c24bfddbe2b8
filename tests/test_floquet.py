"""Quasi-energies of a window of Hamiltonians against a product of matrix exponentials by their series."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tidewatch.operators import geometry as g

DAY0 = dt.date(2024, 1, 1)
SCHEMA = "series_id string, ts date, t long, x array<double>"


def exponential(a):
    """exp(a) by halving and its power series."""
    b, out, term = a / 1024, np.eye(len(a), dtype=complex), np.eye(len(a), dtype=complex)
    for k in range(1, 20):
        term = term @ b / k
        out = out + term
    for _ in range(10):
        out = out @ out
    return out


def brute(xs, ops, window):
    period = np.eye(ops.shape[1], dtype=complex)
    for x in xs:
        h = sum((a - v * np.eye(len(a))) @ (a - v * np.eye(len(a))) / 2 for a, v in zip(ops, x))
        period = exponential(-1j * h * 2 * np.pi / window) @ period
    at = sorted(np.angle(np.linalg.eigvals(period)))
    gaps = [b - a for a, b in zip(at, [*at[1:], at[0] + 2 * np.pi])]
    ratios = [min(p, q) / max(p, q) for p, q in zip(gaps, [*gaps[1:], gaps[0]])]
    return min(gaps), np.std(gaps), np.mean(ratios)


@pytest.mark.parametrize("dim", [2, 4])
def test_quasi_energies_of_windows(spark, dim):
    rng, ops = np.random.default_rng(3), g.basis("random", dim, 3)
    xs = {s: [rng.normal(size=3).tolist() for _ in range(14)] for s in "ab"}
    xs["a"][8] = None
    df = spark.createDataFrame([(s, DAY0 + dt.timedelta(days=t), t, x) for s, v in xs.items() for t, x in enumerate(v)], SCHEMA)
    got = {(r.series_id, r.t): r for r in g.floquet_observables(df.repartition(3), ops, 5).collect()}
    assert len(got) == 28
    for (s, t), r in got.items():
        window = xs[s][max(t - 4, 0) : t + 1]
        if len(window) < 5 or None in window:
            assert (r.min_gap, r.gap_std, r.level_ratio) == (None, None, None)
            continue
        low, spread, ratio = brute(window, ops, 5)
        assert (r.min_gap, r.gap_std) == pytest.approx((low, spread), abs=1e-8)
        assert r.level_ratio == (pytest.approx(ratio, abs=1e-8) if dim > 2 else None)
    assert g.floquet_observables(df.limit(0), ops, 5).count() == 0
