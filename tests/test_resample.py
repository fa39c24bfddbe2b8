from __future__ import annotations

import hashlib
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alarms, resample

DAY = date(2020, 1, 1)


def panel(spark, values):
    rows = [("a", "m", DAY + timedelta(days=t), t, None if v is None else float(v)) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, method string, ts date, t long, score double")


def windows(spark, *spans):
    rows = [(f"e{i}", DAY + timedelta(days=a), DAY + timedelta(days=b)) for i, (a, b) in enumerate(spans)]
    return spark.createDataFrame(rows, "event_id string, start date, stop date")


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def brute_d(x, y):
    pooled = np.sqrt(((len(x) - 1) * np.var(x, ddof=1) + (len(y) - 1) * np.var(y, ddof=1)) / (len(x) + len(y) - 2))
    return 0.0 if pooled < 1e-12 else abs(np.mean(x) - np.mean(y)) / pooled


def brute_bootstrap(v, span, event, reps, block=None):
    ok = [(t, x) for t, x in enumerate(v) if x is not None]
    sides = {1: [x for t, x in ok if span[0] <= t <= span[1]], 0: [x for t, x in ok if not span[0] <= t <= span[1]]}
    ds = []
    for rep in range(1, reps + 1):
        got = {}
        for flag, xs in sides.items():
            n = len(xs)
            size = block or max(round(n ** (1 / 3)), 1)
            got[flag] = [xs[(draw(7, rep, "a", "m", event, flag, b) % n + k) % n] for b in range(-(-n // size)) for k in range(min(size, n - b * size))]
        ds.append(brute_d(got[1], got[0]))
    return np.quantile(ds, [0.025, 0.975])


@pytest.mark.parametrize("block", [None, 1, 500])
def test_bootstrap_draws_circular_blocks_of_each_side(spark, block):
    v = list(np.random.default_rng(1).normal(size=90) + 1000)
    v[5] = v[44] = v[70] = None
    spans = [(40, 59), (0, 9), (80, 120)]  # in the middle, at the start, to the end
    got = {r.event_id: r for r in resample.block_bootstrap(panel(spark, v).repartition(3), windows(spark, *spans), 30, block=block).collect()}
    assert len(got) == 3 and (got["e0"].n1, got["e0"].n2) == (19, 68)
    for i, span in enumerate(spans):
        r = got[f"e{i}"]
        assert (r.ci_lo, r.ci_hi) == pytest.approx(tuple(brute_bootstrap(v, span, f"e{i}", 30, block)), abs=1e-6)


def test_cells_without_a_side_and_single_rows(spark):
    v = [None, 1.0, 2.0, 4.0]
    ev = windows(spark, (0, 0), (0, 3), (1, 1))  # no valid row inside, none outside, one inside
    (b,) = resample.block_bootstrap(panel(spark, v), ev, 5).collect()
    assert (b.event_id, b.n1, b.n2, b.ci_lo, b.ci_hi) == ("e2", 1, 2, None, None)
    (p,) = resample.permutation_p(panel(spark, v), ev, 5).collect()
    assert p.event_id == "e2" and p.seen == pytest.approx(2.0) and 0 < p.p <= 1
    empty = panel(spark, v).limit(0)
    assert resample.block_bootstrap(empty, ev, 5).count() == resample.permutation_p(empty, ev, 5).count() == 0


def test_subsets_are_distinct_and_uniform():
    seen: dict[tuple, int] = {}
    for k in range(6000):
        s = resample.subset_places(f"x{k}", 4, 2)
        assert len(s) == 2 and s <= {1, 2, 3, 4}
        seen[tuple(sorted(s))] = seen.get(tuple(sorted(s)), 0) + 1
    assert len(seen) == 6 and max(abs(c - 1000) for c in seen.values()) < 150  # five standard deviations
    assert resample.subset_places("y", 3, 3) == {1, 2, 3}


def test_permutation_p_matches_brute_force(spark):
    v = list(np.random.default_rng(2).normal(size=40))
    v[3] = None
    v[20:25] = [x + 0.5 for x in v[20:25]]
    ev = windows(spark, (20, 24), (0, 5))
    got = {r.event_id: r for r in resample.permutation_p(panel(spark, v).repartition(2), ev, 50).collect()}
    x = np.array([z for z in v if z is not None])
    for event, inside in (("e0", range(19, 24)), ("e1", range(0, 5))):
        gap = lambda at: abs(x[list(at)].mean() - np.delete(x, list(at)).mean())
        hits = sum(gap([k - 1 for k in resample.subset_places(f"11|{rep}|a|m|{event}", len(x), 5)]) >= gap(inside) - 1e-9 for rep in range(1, 51))
        assert got[event].p == pytest.approx((hits + 1) / 51) and got[event].seen == pytest.approx(gap(inside), abs=1e-8)


def test_a_strong_effect_is_never_met_by_permutations(spark):
    v = np.random.default_rng(1).normal(size=120)
    v[40:60] += 3
    assert resample.permutation_p(panel(spark, v), windows(spark, (40, 59)), 40).first().p == pytest.approx(1 / 41)


@pytest.mark.parametrize("quantile", [0.0, 0.5, 0.95, 1.0])
def test_expanding_threshold_is_the_quantile_of_the_past(spark, quantile):
    v = [None if k % 7 == 0 else float(x) for k, x in enumerate(np.random.default_rng(3).integers(0, 30, size=150))]
    got = alarms.expanding_threshold(panel(spark, v).withColumn("series_id", F.lit("b")).unionByName(panel(spark, v)), "score", quantile, 10).orderBy("series_id", "t").collect()
    for half in (got[:150], got[150:]):
        for t, r in enumerate(half):
            past = [x for x in v[:t] if x is not None]
            assert r.threshold == (pytest.approx(np.quantile(past, quantile)) if t >= 10 else None)
