"""Null windows, nested logistic models, survival, the copula score, sliced distances, scale transitions and mixed states against plain code."""

from __future__ import annotations

import datetime as dt
from math import erf, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.stats import normal_quantile
from tidewatch.operators import detectors, fusion, topology
from tidewatch.operators import geometry as g
from tidewatch.operators import inference as inf
from tidewatch.sources.results import kept_table
from tidewatch.streaming.online import logistic_fit

DAY0 = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in "xy":
        for m in "pq":
            for t in range(150):
                v = None if t % 29 == 5 else float(1000 + rng.normal() + (2 if m == "p" and 60 <= t < 75 else 0))
                rows.append((s, m, DAY0 + dt.timedelta(days=t), t, v))
    return spark.createDataFrame(rows, "series_id string, method string, ts date, t long, score double")


@pytest.fixture(scope="module")
def events(spark):
    day = lambda t: DAY0 + dt.timedelta(days=t)
    return spark.createDataFrame([("a", day(60), day(74)), ("b", day(110), day(114))], "event_id string, start date, stop date")


def effect(x, inside):
    a, b = x[inside & ~np.isnan(x)], x[~inside & ~np.isnan(x)]
    return abs(a.mean() - b.mean()) / sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2))


def series(panel):
    return {k: gr.sort_values("t")["score"].to_numpy(float) for k, gr in panel.toPandas().groupby(["series_id", "method"])}


def test_window_moments_are_those_of_the_rows(panel):
    spark = panel.sparkSession
    w = spark.createDataFrame([(s, k, a, b) for s in "xy" for k, a, b in ((1, 0, 10), (2, 40, 90), (3, 140, 150), (3, 0, 5), (4, 7, 8))], "series_id string, k int, a long, b long")
    x = series(panel)
    got = inf.window_moments(inf.prefix_sums(panel), w, ["k"]).collect()
    assert len(got) == 16
    spans = {1: [(0, 10)], 2: [(40, 90)], 3: [(140, 150), (0, 5)], 4: [(7, 8)]}
    for r in got:
        v = x[r.series_id, r.method]
        inside = np.zeros(len(v), bool)
        for a, b in spans[r.k]:
            inside[a:b] = True
        a, b = (y[~np.isnan(y)] for y in (v[inside], v[~inside]))
        assert (r.n1, r.n2) == (len(a), len(b)) and r.m1 == pytest.approx(a.mean()) and r.m2 == pytest.approx(b.mean()) and r.v2 == pytest.approx(b.var(ddof=1), rel=1e-9)
        assert r.v1 is None if len(a) < 2 else r.v1 == pytest.approx(a.var(ddof=1), rel=1e-9)


def test_null_windows_and_shifts(panel, events):
    spark = panel.sparkSession
    windows = inf.event_windows(panel, events)
    rows = spark.createDataFrame([("x", 150), ("y", 150)], "series_id string, n long")
    placed = inf.disjoint_windows(windows, rows, 400).toPandas()
    assert len(placed) == 2 * 400 * 2
    for _, gr in placed.groupby(["series_id", "rep"]):
        gr = gr.sort_values("a")
        assert gr["a"].iloc[0] >= 0 and gr["b"].iloc[0] <= gr["a"].iloc[1] and gr["b"].iloc[1] <= 150
    lengths = placed.assign(len=placed["b"] - placed["a"]).groupby("event_id")["len"]
    assert lengths.min().to_dict() == lengths.max().to_dict() == {"a": 15, "b": 5}
    # every place is about equally often covered, but for the ends
    cover = np.zeros(150)
    for a, b in zip(placed["a"], placed["b"]):
        cover[a:b] += 1
    assert cover[20:130].min() > 0.6 * cover[20:130].mean() and (placed["a"] == 0).any() and (placed["b"] == 150).any()
    full = inf.disjoint_windows(windows, spark.createDataFrame([("x", 10), ("y", 150)], "series_id string, n long"), 3).toPandas()
    assert set(full["series_id"]) == {"y"}
    out = inf.null_windows(panel, events, 400, kept_table(spark)).collect()
    p = {(r.series_id, r.method, r.kind): r.p for r in out}
    assert len(out) == 8 and all(p["x", "p", k] < 0.1 for k in ("random_windows", "circular_shift")) and p["x", "q", "random_windows"] > 0.05
    x = series(panel)["x", "p"]
    turned = [r for r in inf.shifted_windows(windows, rows, 5).where("series_id = 'x' and event_id = 'a'").collect()]
    cells = {r.event_id: r for r in inf.circular_shift_null(panel, events, 5).where("series_id = 'x' and method = 'p'").collect()}
    inside = np.zeros(150, bool)
    inside[60:75] = True
    more = 0
    for rep in range(1, 6):
        covered = np.zeros(150, bool)
        for r in turned:
            if r.rep == rep:
                covered[r.a : r.b] = True
        assert covered.sum() == 15
        more += effect(x, covered) >= effect(x, inside)
    assert cells["a"].d == pytest.approx(effect(x, inside)) and cells["a"].p == pytest.approx((1 + more) / 6)


def test_likelihood_ratios_by_grouped_newton_steps(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in "uv":
        x, z = rng.normal(size=(2, 300))
        y = rng.random(300) < 1 / (1 + np.exp(-(x if k == "u" else 0.3 * z) + 0.5))
        rows += [(k, float(a), float(b), bool(c)) for a, b, c in zip(x, z, y)]
    rows += [("one class", 1.0, 2.0, True), ("one class", 2.0, 1.0, True), ("u", None, 1.0, True)]
    got = {r.k: r for r in inf.likelihood_ratio(spark.createDataFrame(rows, "k string, vol double, mom double, y boolean"), "vol", "mom", "y", ["k"], kept_table(spark)).collect()}
    assert set(got) == {"u", "v"}
    for k, r in got.items():
        data = np.array([(a, b, c) for kk, a, b, c in rows if kk == k and a is not None], float)

        def nll(cols):
            w = logistic_fit(data[:, cols], data[:, 2])
            z = data[:, cols] @ w[:-1] + w[-1]
            return (np.logaddexp(0, z) - data[:, 2] * z).sum()

        assert (r.n, r.nll_both, r.nll_a, r.nll_b) == (300, pytest.approx(nll([0, 1]), abs=1e-6), pytest.approx(nll([0]), abs=1e-6), pytest.approx(nll([1]), abs=1e-6))
        assert r.p_a_given_b == pytest.approx(1 - erf(sqrt(max(r.lr_a_given_b, 0) / 2)), abs=1e-9)
    assert got["u"].p_a_given_b < 1e-6 < 0.001 < got["u"].p_b_given_a


def test_survival(spark, panel, events):
    durations = [("m", 5, True), ("m", 5, False), ("m", 8, True), ("m", 8, True), ("m", 12, False), ("n", 3, True), ("m", None, True)]
    km = {(r.method, r.time): (r.at_risk, r.events, r.survival) for r in inf.kaplan_meier(spark.createDataFrame(durations, "method string, time int, observed boolean"), ["method"]).collect()}
    assert km == {("m", 5): (5, 1, pytest.approx(0.8)), ("m", 8): (3, 2, pytest.approx(0.8 / 3)), ("n", 3): (1, 1, 0.0)}
    times = inf.times_to_events(panel, events)
    t = times.where("series_id = 'x' and method = 'q'").toPandas()
    assert sorted(t["event_id"].unique()) == ["b"] and (t["tte"].min(), t["tte"].max()) == (1, 50)  # event a starts too early
    x = series(panel)["x", "q"]
    for _, r in t.iterrows():
        before = x[int(r["t"]) - 60 : int(r["t"])]
        before = before[~np.isnan(before)]
        want = (x[int(r["t"])] - before.mean()) / (before.std() + 1e-8)
        assert np.isnan(r["z"]) == np.isnan(want) and (np.isnan(want) or r["z"] == pytest.approx(want))
    a = {r.method: r for r in inf.survival_association(times).collect()}
    ok = times.where("method = 'q' and z is not null").toPandas()
    assert a["q"].beta == pytest.approx(np.corrcoef(ok["z"], -np.log(ok["tte"] + 1))[0, 1])
    starts = spark.createDataFrame([("x", "a", 60), ("x", "b", 110)], "series_id string, event_id string, t0 long")
    al = spark.createDataFrame([("x", "m", t, t in (50, 51, 60, 100, 120)) for t in range(150)], "series_id string, method string, t long, alarm boolean")
    got = sorted((r.t, r.time, r.observed) for r in inf.alarm_durations(al, starts).collect())
    assert got == [(50, 10, True), (60, 50, True), (100, 10, True), (120, 29, False)]


def test_normal_quantile_and_copula(spark):
    u = [1e-9, 1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    z = [r.z for r in spark.createDataFrame([(i, v) for i, v in enumerate(u)], "i int, u double").orderBy("i").select(normal_quantile(F.col("u")).alias("z")).collect()]
    assert [0.5 * (1 + erf(v / sqrt(2))) for v in z] == pytest.approx(u, rel=1e-6)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(170, 3))
    x[:, 1] += 0.8 * x[:, 0]
    x[[130, 20], [2, 1]] = np.nan
    rows = [("s", DAY0, t, m, None if np.isnan(x[t, k]) else float(x[t, k])) for t in range(170) for k, m in enumerate("abc")]
    got = {r.t: r.copula for r in fusion.gaussian_copula(spark.createDataFrame(rows, "series_id string, ts date, t long, method string, score double"), list("abc")).collect()}
    q = lambda p: spark_free_quantile(p)
    gauss = np.full(x.shape, np.nan)
    for t in range(60, 170):
        for k in range(3):
            past = x[:t, k][~np.isnan(x[:t, k])]
            if not np.isnan(x[t, k]):
                gauss[t, k] = q(min(max((past <= x[t, k]).mean(), 1e-6), 1 - 1e-6))
    for t in range(170):
        whole = gauss[:t][~np.isnan(gauss[:t]).any(1)]
        if t < 120 or len(whole) < 30:
            assert got[t] is None
        elif np.isnan(gauss[t]).any():
            assert got[t] == pytest.approx(np.nanmean(gauss[t]), rel=1e-6)
        else:
            r = 0.9 * np.corrcoef(whole.T) + 0.1 * np.eye(3)
            assert got[t] == pytest.approx(gauss[t] @ np.linalg.inv(r) @ gauss[t], rel=1e-6)


def spark_free_quantile(p):
    """By bisection on the error function."""
    lo, hi = -10.0, 10.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + erf(mid / sqrt(2))) < p else (lo, mid)
    return lo


def test_sliced_distance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(70, 3))
    rows = [("s", DAY0, t, None if t == 2 else x[t].tolist()) for t in range(70)]
    lines = detectors.directions(7, 3)
    assert np.allclose(np.linalg.norm(lines, axis=1), 1)
    got = {r.t: r.distance for r in detectors.sliced_wasserstein(spark.createDataFrame(rows, "series_id string, ts date, t long, x array<double>"), lines=lines).collect()}
    for t in range(70):
        if t < 43:  # two windows of 30 rows, ten apart, without row 2
            assert got[t] is None
        else:
            a, b = (np.sort(x[s] @ np.array(lines).T, axis=0) for s in (slice(t - 30, t), slice(t - 40, t - 10)))
            assert got[t] == pytest.approx(np.abs(a - b).mean(0).mean())


def test_transitions_across_scales(spark):
    v = np.zeros(200)
    v[50:] += 5
    v[120:] -= 9
    df = spark.createDataFrame([("s", t, float(v[t])) for t in range(200)] + [("flat", t, 0.0) for t in range(200)], "series_id string, t long, x double")
    got = topology.scale_transitions({10: df, 20: df, 40: df.where("t < 100")}, "x", 0.5, smooth=5, apart=10).collect()
    assert sorted((r.scale, r.t) for r in got) == [(10, 50), (10, 120), (20, 50), (20, 120), (40, 50)]
    assert {(r.scale, r.t): r.confirmations for r in got} == {(10, 50): 2, (20, 50): 2, (40, 50): 2, (10, 120): 1, (20, 120): 1}
    assert all(r.confirmed for r in got) and {(r.scale, r.t): (r.a, r.b) for r in got}[20, 50] == (31, 50)


def test_mixed_states_match_matrix_roots(spark):
    rng = np.random.default_rng(9)
    psi = rng.normal(size=(12, 4)) + 1j * rng.normal(size=(12, 4))
    psi /= np.linalg.norm(psi, axis=1, keepdims=True)
    rows = [("s", DAY0 + dt.timedelta(days=t), t, psi[t].real.tolist(), psi[t].imag.tolist()) for t in range(12)]
    got = g.mixed_observables(spark.createDataFrame(rows, "series_id string, ts date, t long, psi_re array<double>, psi_im array<double>"), 2, 4).orderBy("t").collect()

    def root(m):
        w, u = np.linalg.eigh(m)
        return (u * np.sqrt(np.maximum(w, 0))) @ u.conj().T

    rho = [p.reshape(2, 2) @ p.reshape(2, 2).conj().T for p in psi]
    for t, r in enumerate(got):
        assert r.purity == pytest.approx(np.trace(rho[t] @ rho[t]).real)
        if t == 0:
            assert r.uhlmann_fidelity is None and r.berry_phase is None
            continue
        s = root(rho[t - 1])
        assert r.uhlmann_fidelity == pytest.approx(np.trace(root(s @ rho[t] @ s)).real ** 2)
        assert r.uhlmann_phase == 0.0 and r.berry_phase == pytest.approx(np.angle(np.vdot(psi[t - 1], psi[t])))
    assert [r.loop_phase is None for r in got] == [t < 3 for t in range(12)]
    # a path that comes back the way it went closes without a phase
    back = [psi[0], psi[1], psi[0]]
    rows = [("s", DAY0 + dt.timedelta(days=t), t, p.real.tolist(), p.imag.tolist()) for t, p in enumerate(back)]
    last = g.mixed_observables(spark.createDataFrame(rows, "series_id string, ts date, t long, psi_re array<double>, psi_im array<double>"), 2, 3).orderBy("t").collect()[-1]
    assert last.loop_phase == pytest.approx(0.0, abs=1e-9)


def test_bootstrap_and_sign_changes(spark):
    v = [1.0, 2.0, 4.0, 8.0, 9.0]
    df = spark.createDataFrame([("a", str(k), x) for k, x in enumerate(v)] + [("a", "none", None), ("few", "0", 1.0)], "m string, u string, x double")
    r = inf.bootstrap_means(df, "x", ["m"], "u", 2000).collect()
    assert len(r) == 1 and r[0].n == 5 and r[0].mean == pytest.approx(4.8)
    exact = np.sort(np.array(np.meshgrid(*[v] * 5)).reshape(5, -1).mean(0))
    assert r[0].ci_lo == pytest.approx(np.quantile(exact, 0.025), abs=0.35) and r[0].ci_hi == pytest.approx(np.quantile(exact, 0.975), abs=0.35)
    s = inf.sign_permutation(df.where("m = 'a'"), "x", ["m"], "u", 2000).first()
    assert s.n == 5 and s.p == pytest.approx(2 / 32, abs=0.02)


def test_recalibration_by_the_other_folds(spark):
    rng = np.random.default_rng(6)
    rows = [("k", int(f), float(p), float(rng.random() < p / 2)) for f in range(4) for p in rng.random(60)] + [("k", 9, 0.05, 1.0), ("k", 0, None, 1.0)]
    got = {r.fold: r for r in inf.held_out_recalibration(spark.createDataFrame(rows, "k string, f int, p double, y double"), "p", "y", "f", ["k"], 5).collect()}
    clean = [r for r in rows if r[2] is not None]
    for f, r in got.items():
        own = [x for x in clean if x[1] == f]
        want = []
        for _, _, p, y in own:
            other = [q[3] for q in clean if q[1] != f and int(q[2] * 5) == int(p * 5)]
            want.append(((np.mean(other) if other else p) - y) ** 2)
        assert r.n == len(own) and r.brier == pytest.approx(np.mean([(p - y) ** 2 for _, _, p, y in own])) and r.brier_recalibrated == pytest.approx(np.mean(want))
    assert np.mean([got[f].brier_recalibrated for f in range(4)]) < np.mean([got[f].brier for f in range(4)])
