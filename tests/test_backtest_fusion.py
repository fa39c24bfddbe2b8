"""Backtest folds and metrics, fusion, models: on hand-made cases and by loops."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.sources.results import kept_table
from tidewatch.operators import backtest as b
from tidewatch.operators import fusion, models

D0 = dt.date(2000, 1, 1)


def series(spark, name, values, key="a"):
    return spark.createDataFrame([(key, D0 + dt.timedelta(days=i), i, None if v is None else float(v)) for i, v in enumerate(values)], f"series_id string, ts date, t long, {name} double")


def column(df, c):
    return [r[c] for r in df.orderBy("t").select(c).collect()]


def test_min_holding_reverts_early_changes(spark):
    w = [1, 1, 1, 0, 0, 0, 1, 1, 0.5, 0.5, 0.5, 0.5]
    held, last = [w[0]], 0
    for t in range(1, len(w)):
        if abs(w[t] - held[-1]) > 0.01:
            if t - last < 3:
                held.append(held[-1])
                continue
            last = t
        held.append(w[t])
    assert column(b.min_holding(series(spark, "w", w), "w", 3), "held") == held


def test_circuit_breaker_pauses_once(spark):
    dd = [0, 0.2, 0.3, 0.3, 0, 0, 0.3, 0]
    df = series(spark, "dd", dd).withColumn("w", F.lit(1.0))
    assert column(b.circuit_breaker(df, "w", "dd", 0.15, 3), "braked") == [1, 0, 0, 0, 1, 1, 0, 0]


def test_performance_against_numpy(spark):
    r = np.random.default_rng(0).normal(0.0005, 0.01, 300)
    p = b.performance(series(spark, "ret", [*r, None]), "ret").first()
    cum = np.cumprod(1 + r)
    dd = 1 - cum / np.maximum.accumulate(cum)
    assert p.total_return == pytest.approx(cum[-1] - 1) and p.max_drawdown == pytest.approx(dd.max())
    assert p.sharpe == pytest.approx(r.mean() / r.std(ddof=1) * 252**0.5) and p.sortino == pytest.approx(r.mean() * 252 / (r[r < 0].std(ddof=1) * 252**0.5))
    longest = run = 0
    for d in dd:
        run = run + 1 if d > 0.001 else 0
        longest = max(longest, run)
    assert p.max_dd_duration == longest and p.n == 300
    assert b.performance(series(spark, "ret", [0.1]), "ret").count() == 0


def test_strategies_lag_their_signal(spark):
    r = np.random.default_rng(1).normal(0, 0.01, 120)
    df = series(spark, "ret", r).withColumn("p_crisis", F.when(F.col("t") >= 60, 1.0).otherwise(0.0))
    w = column(b.long_flat(df), "weight")
    assert w[0] == 0 and w[60] > 0.1 and w[64] < 0.1 and max(w) <= 1.5
    changed = df.withColumn("p_crisis", F.when(F.col("t") >= 100, 0.5).otherwise(F.col("p_crisis")))
    assert column(b.long_flat(changed), "weight")[:101] == w[:101]
    for f in (b.long_short, b.continuous):
        assert len(column(f(df), "weight")) == 120
    assert column(b.multi_signal(df.withColumn("q", F.col("p_crisis")), ["p_crisis", "q"]), "weight") == pytest.approx(w)


def test_costs(spark):
    df = series(spark, "ret", [0.01, 0.01, 0.01]).withColumn("w", F.col("t").cast("double") / 2)
    assert column(b.net_returns(df, "ret", "w"), "cost") == pytest.approx([0, 0.5 * 1.5e-4, 0.5 * 1.5e-4])


def channels(spark):
    rng = np.random.default_rng(3)
    out = None
    for k, m in enumerate("xyz"):
        s = series(spark, "score", [None if i % 11 == k else v for i, v in enumerate(rng.normal(size=150))]).withColumn("method", F.lit(m))
        out = s if out is None else out.unionByName(s)
    return out


def test_row_reducers(spark):
    s = channels(spark)
    wide = s.toPandas().pivot(index="t", columns="method", values="score")
    got = fusion.composite(s).toPandas().set_index("t").sort_index()
    assert np.allclose(got["comp_max"], wide.max(axis=1)) and np.allclose(got["comp_mean"], wide.mean(axis=1)) and np.allclose(got["comp_rms"], (wide**2).mean(axis=1) ** 0.5)
    att = fusion.softmax_attention(s).toPandas().set_index("t").sort_index()["attention"]
    w = np.exp(wide.abs())
    assert np.allclose(att, (w * wide).sum(axis=1) / w.sum(axis=1))


def test_sequential_evidence_by_loops(spark):
    s = channels(spark)
    wide = s.toPandas().pivot(index="t", columns="method", values="score").to_numpy()
    e, want = 0.0, []
    for t in range(150):
        if t < 60:
            want.append(0.0)
            continue
        ll = []
        for c in range(3):
            past = wide[:t, c][~np.isnan(wide[:t, c])]
            if not np.isnan(wide[t, c]) and len(past) >= 20:
                ll.append(wide[t, c] / past.std(ddof=1) - 0.5)
        e = 0.95 * e + (np.mean(ll) if ll else 0.0)
        if e >= 2.995732 or e <= -2.995732:
            e = 0.0
        want.append(e)
    assert column(fusion.sequential_evidence(s), "evidence") == pytest.approx(want, abs=1e-9)


def test_clusters_and_switching_run(spark):
    s = channels(spark)
    assert fusion.cluster_fusion(s, 0.99).count() == 150
    target = s.where("method = 'x'").select("series_id", "t", F.col("score").alias("target"))
    z = fusion.dynamic_switching(s, target).where("score is not null").count()
    assert z > 50
    mi = {r.method: r.mi for r in fusion.mutual_information_weights(s, target).collect()}
    assert mi["x"] > mi["y"] and mi["x"] > mi["z"]


def regimes(seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 0.01, 150), rng.normal(0, 0.05, 100), rng.normal(0, 0.01, 100)])


@pytest.mark.parametrize("ar", [False, True])
def test_hidden_regimes_find_the_volatile_stretch(spark, ar):
    p = np.array(column(models.hidden_regimes(series(spark, "ret", regimes()), ar=ar), "p_high"), float)
    assert p[160:240].mean() > 0.8 and p[:140].mean() < 0.2


def test_garch_follows_volatility(spark):
    df = series(spark, "ret", regimes())
    fits = models.garch_fit(df, kept_table(spark))
    s = np.array(column(models.garch_vol(df, fits), "sigma"), float)
    f = fits.first()
    assert s[170:250].mean() > 2 * s[100:150].mean() and 0 < f.alpha < 1
    r = np.array([v for v in column(df, "ret") if v is not None])
    r = r - r.mean()

    def nll(omega, alpha, beta):
        v, total = r.var(), 0.0
        for x in r:
            total += 0.5 * (np.log(v) + x * x / v)
            v = omega + alpha * x * x + beta * v
        return total

    assert f.nll == pytest.approx(nll(f.omega, f.alpha, f.beta), rel=1e-9)
    # no nearby parameters, and none of a wide grid, are likelier
    near = [nll(f.omega * a, f.alpha * b, f.beta * c) for a in (0.97, 1, 1.03) for b in (0.97, 1, 1.03) for c in (0.995, 1, 1.005) if f.alpha * b + f.beta * c < 1]
    wide = [nll(r.var() * (1 - a - b), a, b) for a in np.linspace(0.02, 0.6, 9) for b in np.linspace(0.1, 0.95, 9) if a + b < 1]
    assert f.nll < min(near) + 0.01 and f.nll < min(wide) + 1e-6
    few = models.garch_fit(df.where("t < 30"), kept_table(spark)).first()
    assert (few.alpha, few.beta, few.omega, few.nll) == (0.06, 0.94, 0.0, None)


def test_garch_computes_its_input_once(spark):
    """Rounds read what was kept: the input, whatever joins made it, is not computed again in each."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = series(spark, "ret", regimes()).select("series_id", "t", "ret")
    fits = models.garch_fit(df.mapInArrow(counted, df.schema), kept_table(spark), rounds=3)
    assert fits.first().nll == pytest.approx(models.garch_fit(df, kept_table(spark), rounds=3).first().nll, rel=1e-12)
    assert seen.value == df.count()


def test_turbulence_of_any_number_of_features(spark):
    x = np.random.default_rng(8).normal(size=(90, 3))
    df = spark.createDataFrame([("a", i, None if i == 4 else [None, 1.0, 2.0] if i == 5 else v.tolist()) for i, v in enumerate(x)], "series_id string, t long, x array<double>")
    got = column(models.turbulence(df), "turbulence")
    assert got[:60] == [None] * 60
    past = np.delete(x[:81], [4, 5], axis=0)
    z = x[80] - past.mean(0)
    assert got[80] == pytest.approx(np.sqrt(z @ np.linalg.inv(np.cov(past.T, ddof=0) + 1e-6 * np.eye(3)) @ z))


def test_network_score_takes_the_middle_of_even_counts(spark):
    from tidewatch.operators.networks import h0_persistence

    rng = np.random.default_rng(3)
    rows = [(s, w, w * 100 + d, float(v)) for w in range(8) for d in range(12) for s, v in zip("abc", rng.normal(size=3))]
    got = h0_persistence(spark.createDataFrame(rows, "series_id string, w int, ts int, x double"), "w", "x").orderBy("w").collect()
    total = [r.total for r in got]
    for k, r in enumerate(got):
        past = np.array(total[:k])
        if k < 4:
            assert r.score is None
        else:
            m = np.median(past)
            assert r.score == pytest.approx(-(total[k] - m) / (1.4826 * np.median(np.abs(past - m))))


def run_lengths_by_loops(v, hazard=1 / 250, cap=500):
    """P(run < 4) from the recursion over run lengths, one run and row at a time."""
    from math import exp, lgamma, log, pi

    def like(x, mean, scale, df):
        return exp(lgamma((df + 1) / 2) - lgamma(df / 2) - log(df * pi * scale) / 2 - (df + 1) / 2 * log(1 + (x - mean) ** 2 / scale / df))

    mass, out = {0: 1.0}, []
    for t, x in enumerate(v):
        new = {0: 0.0}
        for r in range(min(t + 1, cap)):
            seg = v[t - r : t + 1] if r else []
            n, m = len(seg), float(np.mean(seg)) if r else 0.0
            beta = 1 + n * (float(np.var(seg)) if n > 1 else 0.0) / 2 + n * m * m / (1 + n) / 2
            w = mass.get(r, 0.0) * like(x, n * m / (1 + n), beta * (n + 2) / ((1 + n) * (1 + n / 2)), 2 + n)
            new[r + 1] = w * (1 - hazard)
            new[0] += w * hazard
        total = sum(new.values())
        mass = {r: w / total for r, w in new.items()}
        out.append(sum(mass.get(r, 0.0) for r in range(4)))
    return out


def test_breaks_and_run_lengths(spark):
    v = np.concatenate([np.random.default_rng(1).normal(0, 1, 100), np.random.default_rng(2).normal(4, 1, 100)])
    cps = models.segment_breaks(v)
    assert any(abs(c - 100) <= 2 for c in cps) and len(cps) <= 4
    p = models.bocpd(v)
    # the current row is among a run's own statistics, so the mass of short runs rises for a few rows only
    assert p[99:106].max() > 10 * p[60:95].mean()
    assert p[:40] == pytest.approx(run_lengths_by_loops(v[:40])) and models.bocpd(v, cap=5)[:40] == pytest.approx(run_lengths_by_loops(v[:40], cap=5))
    near = column(models.structural_breaks(series(spark, "ret", v)), "nearness")
    assert np.argmax(near) in range(97, 104)


def test_mahalanobis_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=(50, 2))
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "series_id string, t long, x array<double>")
    got = column(models.mahalanobis(df), "d2")
    assert got[:3] == [None] * 3
    z = x[40] - x[:41].mean(0)
    assert got[40] == pytest.approx(z @ np.linalg.inv(np.cov(x[:41].T) + 1e-6 * np.eye(2)) @ z)


def test_isolation_ranks_outliers(spark):
    x = np.random.default_rng(6).normal(size=(120, 2))
    x[60] = [9, 9]
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "series_id string, t long, x array<double>")
    got = {r.t: r.anomaly for r in models.isolation_scores(df, trees=30, sample=64).collect()}
    assert max(got, key=got.get) == 60 and got[60] == 1.0


def test_regression_leave_one_out(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=30)
    y = 2 * x + rng.normal(size=30) * 0.1
    df = spark.createDataFrame([("a", float(u), float(v)) for u, v in zip(x, y)], "series_id string, x double, y double")
    r = models.regression(df, "x", "y").first()
    errs = []
    for i in range(30):
        k = np.delete(np.arange(30), i)
        c = np.polyfit(x[k], y[k], 1)
        errs.append(abs(y[i] - np.polyval(c, x[i])))
    assert r.slope == pytest.approx(np.polyfit(x, y, 1)[0]) and r.loo_mae == pytest.approx(np.mean(errs))


def test_pca_composite_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3))
    rows = [("a", m, dt.date(2020, 1, 1) + dt.timedelta(days=t), t, None if t == 45 and m == "b" else float(x[t, k])) for t in range(60) for k, m in enumerate("abc")]
    df = spark.createDataFrame(rows, "series_id string, method string, ts date, t long, score double")
    got = {r.t: r.pca for r in fusion.pca_composite(df, ["a", "b", "c"], 30).collect()}
    assert len(got) == 60 and got[10] == pytest.approx(x[10].mean()) and got[45] == pytest.approx((x[45, 0] + x[45, 2]) / 2)
    past = np.delete(x[:50], 45, 0)
    w, u = np.linalg.eigh(np.cov(past.T))
    assert got[50] == pytest.approx(abs(u[:, -1] @ (x[50] - past.mean(0))))
