"""Keyed forests, regime-adaptive refits and learned family weights against plain loops."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tidewatch.operators import forests, fusion, models
from tidewatch.sources.results import kept_table
from tidewatch.streaming.online import logistic_fit

DAY0 = dt.date(2000, 1, 1)


def test_trees_split_where_gini_says():
    x = np.array([[0.0, 5], [1, 5], [2, 5], [3, 5]])
    y = np.array([0.0, 0, 1, 1])
    t = forests.grow_tree(x, y, 3, np.random.default_rng(0), tries=2)
    assert t[0][:2].tolist() == [0, 1.5] and forests.tree_shares(t, x).tolist() == [0, 0, 1, 1]
    assert len(forests.grow_tree(x, np.ones(4), 3, np.random.default_rng(0))) == 1
    assert len(forests.grow_tree(np.zeros((4, 2)), y, 3, np.random.default_rng(0))) == 1
    assert forests.tree_shares(forests.grow_tree(x, y, 0, np.random.default_rng(0)), x).tolist() == [0.5] * 4


@pytest.fixture(scope="module")
def rolled(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in "ab":
        for t in range(130):
            x = rng.normal(size=3)
            level = None if t % 17 == 3 else float(x[0] * 2 + 0.2 * rng.normal()) if s == "a" else -1.0
            rows.append((s, t, None if t == 60 else [float(v) if not (t == 70 and i == 1) else None for i, v in enumerate(x)], level))
    return rows, spark.createDataFrame(rows, "series_id string, t long, x array<double>, level double")


def test_rolling_forest_sees_only_its_window(spark, rolled):
    rows, df = rolled
    args = dict(train=40, refit=15, trees=8, depth=3)
    got = {(r.series_id, r.t): r for r in forests.rolling_forest(df, "x", "level", 0.0, **args).collect()}
    assert set(got) == {(s, t) for s in "ab" for t in range(40, 130)}
    for (s, t), r in got.items():
        k = (t - 40) // 15
        assert r.refit_t == 40 + 15 * k
        part = [q for q in rows if q[0] == s and 15 * k <= q[1] < 40 + 15 * k and q[2] and None not in q[2] and q[3] is not None]
        x = next(q[2] for q in rows if q[:2] == (s, t))
        if x is None or None in x:
            assert r.p is None
        elif s == "b":
            assert r.p == 0.0
        else:
            m, y = np.array([q[2] for q in part]), np.array([float(q[3] > 0) for q in part])
            forest = forests._forest(m, y, 8, 3, forests._seeded(42, s, k))
            assert r.p == pytest.approx(np.mean([forests.tree_shares(t_, np.array([x]))[0] for t_ in forest]))
    right = [(got["a", t].p > 0.5) == (lv > 0) for s, t, x, lv in rows if s == "a" and t >= 40 and lv is not None and got["a", t].p is not None]
    assert np.mean(right) > 0.8
    assert forests.rolling_forest(df.limit(0), "x", "level", 0.0).count() == 0


def test_held_out_forests_never_see_the_held_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for t in range(300):
        e = "p" if 50 <= t < 80 else "q" if 200 <= t < 230 else None
        x = [float(rng.normal() + (4 if e == "p" else 0)), float(rng.normal() + (4 if e == "q" else 0)), 0.0]
        rows.append(("s", t, None if t == 9 else x, e))
    df = spark.createDataFrame(rows, "series_id string, t long, x array<double>, event_id string")
    run = lambda **k: forests.held_out_forest(df, "x", df["event_id"].isNotNull(), "event_id", ["p", "q", "none"], trees=20, **k)
    got = {(r.event, r.t): r.p for r in run().collect()}
    assert len(got) == 900 and got["p", 9] is None
    at = lambda e, a, b: np.mean([got[e, t] for t in range(a, b)])
    # without p's rows nothing says that a large first component is an event; with them everything does
    assert at("p", 50, 80) < 0.35 < 0.6 < at("q", 50, 80) and at("q", 200, 230) < 0.35 < 0.6 < at("p", 200, 230) and at("none", 50, 80) > 0.6
    again = {(r.event, r.t): r.p for r in run().collect()}
    assert again == got
    few = [r.p for r in run(sample=60).where("event = 'none' and t between 50 and 79").collect()]
    assert np.mean(few) > 0.5
    one = forests.held_out_forest(df.where("event_id is null"), "x", df["event_id"].isNotNull(), "event_id", ["p"], trees=2)
    assert {r.p for r in one.collect()} == {0.0, None}
    with pytest.raises(ValueError):
        forests.held_out_forest(df, "x", df["event_id"].isNotNull(), "event_id", ["p"], trees=10, depth=40)


def test_regime_adaptive_weights_by_cluster(spark):
    rng = np.random.default_rng(7)
    n, methods = 150, ["a", "b", "c"]
    x = rng.normal(size=(n, 3)) * np.where(np.arange(n) % 50 < 25, 0.5, 3)[:, None]
    y = (np.where(np.arange(n) % 50 < 25, x[:, 0], x[:, 1]) > 0).astype(float)
    x[[20, 90], [1, 2]] = np.nan
    rows = [("s", DAY0 + dt.timedelta(days=t), t, m, None if np.isnan(x[t, i]) else float(x[t, i])) for t in range(n) for i, m in enumerate(methods)]
    scores = spark.createDataFrame(rows, "series_id string, ts date, t long, method string, score double")
    labels = spark.createDataFrame([("s", t, float(y[t])) for t in range(n)], "series_id string, t long, label double")
    got = {r.t: r for r in models.regime_adaptive(scores, labels, methods, 3, least=80, every=20, min_expanding=60).collect()}
    clean = np.nan_to_num(x)
    sd = np.nanstd(x, axis=1)
    meta = np.column_stack([sd, np.abs(clean).max(1), (clean > 1).sum(1) / 3, [sd[max(0, t - 19) : t + 1].mean() for t in range(n)], np.abs(clean).sum(1) / 3])
    for t in range(n):
        if t < 80:
            assert got[t].fused is None
            continue
        refit = 80 + (t - 80) // 20 * 20
        c = models.k_means(meta[:refit], 3)
        near = ((meta[:refit, None] - c[None]) ** 2).sum(2).argmin(1)
        own = int(((meta[t] - c) ** 2).sum(1).argmin())
        at = near == own
        w = models.ridge_shares(clean[:refit][at], y[:refit][at]) if at.sum() >= 20 and len(set(y[:refit][at])) > 1 else np.full(3, 1 / 3)
        assert got[t].regime == own and got[t].fused == pytest.approx(w @ clean[t])
    # ridge of all columns together
    a = rng.normal(size=(60, 2))
    a[:, 1] += a[:, 0]
    full = np.linalg.lstsq(np.vstack([a - a.mean(0), np.eye(2)]), np.append(a[:, 0] - a[:, 0].mean(), [0, 0]), rcond=None)[0]
    assert models.ridge_shares(a, a[:, 0]) == pytest.approx(np.abs(full) / np.abs(full).sum())


def test_learned_family_weights(spark):
    rng = np.random.default_rng(9)
    n, fam = 200, {"a": "one", "b": "one", "c": "two"}
    x = rng.normal(size=(n, 3))
    y = (x[:, 2] > 0.3).astype(float)
    rows = [("s", DAY0 + dt.timedelta(days=t), t, m, float(x[t, i])) for t in range(n) for i, m in enumerate("abc")]
    rows += [("flat", DAY0 + dt.timedelta(days=t), t, "c", float(t % 7)) for t in range(n)]
    labels = spark.createDataFrame([("s", t, bool(y[t])) for t in range(n)] + [("flat", t, False) for t in range(n)], "series_id string, t long, label boolean")
    out = fusion.hierarchical_learned(spark.createDataFrame(rows, "series_id string, ts date, t long, method string, score double"), fam, labels, 150, kept_table(spark)).collect()
    got = {(r.series_id, r.t): r.fused for r in out}
    rank = np.array([[(x[: t + 1, i] <= x[t, i]).mean() if t >= 60 else np.nan for i in range(3)] for t in range(n)])
    f = np.nan_to_num(np.column_stack([rank[:, :2].mean(1), rank[:, 2]]))
    use = (np.arange(n) < 150) & (f > 0).any(1)
    w = logistic_fit(f[use], y[use], c=0.1)
    assert [got["s", t] for t in range(n)] == pytest.approx((f @ w[:2] + w[2]).tolist(), abs=1e-7)
    flat = [(np.arange(t + 1) % 7 <= t % 7).mean() / 2 if t >= 60 else 0.0 for t in range(n)]
    assert [got["flat", t] for t in range(n)] == pytest.approx(flat)
