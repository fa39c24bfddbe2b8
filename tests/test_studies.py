"""Folds, running ranks, matching, framing tests and networks on small cases, against loops and NumPy."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.folds import ordered_fold
from tidewatch.functions.windows import percent_rank_past
from tidewatch.operators import evaluate as e
from tidewatch.operators import fusion, joins, networks
from tidewatch.operators import variants as v
from tidewatch.sources.results import kept_table

D0 = dt.date(2000, 1, 1)


def panel(spark, values, key="a", name="x"):
    return spark.createDataFrame([(key, D0 + dt.timedelta(days=i), i, None if x is None else float(x)) for i, x in enumerate(values)], f"series_id string, ts date, t long, {name} double")


def test_running_ranks_by_loops(spark):
    rng = random.Random(2)
    values = [None if rng.random() < 0.1 else float(rng.randrange(8)) for _ in range(300)]
    df = panel(spark, values).unionByName(panel(spark, values[::-1], "b"))
    for current in (True, False):
        got = {(r.series_id, r.t): r.p for r in percent_rank_past(df, "x", "p", include_current=current, least=3).collect()}
        for key, vals in (("a", values), ("b", values[::-1])):
            for t, x in enumerate(vals):
                seen = [y for y in vals[: t + current] if y is not None]
                want = sum(y <= x for y in seen) / len(seen) if x is not None and len(seen) >= 3 else None
                assert got[key, t] == (pytest.approx(want) if want is not None else None)
    assert percent_rank_past(df.limit(0), "x", "p").count() == 0


def test_fold_keeps_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = panel(spark, range(50)).unionByName(panel(spark, range(0, 100, 2), "b"))
        got = {(r.series_id, r.t): r.total for r in ordered_fold(df, ["x"], lambda: (0.0,), lambda s, r: ((s[0] + r[0],), (s[0] + r[0],)), "total double").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["a", 49] == sum(range(50)) and got["b", 10] == sum(range(0, 22, 2)) and len(got) == 100
    assert ordered_fold(panel(spark, []), ["x"], lambda: (), lambda s, r: (s, (1.0,)), "total double").count() == 0


def test_equal_rows_match_in_full(spark):
    """80 equal rows on each side match 80 times; the rest by distance, nulls not at all."""
    t = spark.createDataFrame([(i, 1.0) for i in range(80)] + [(100, 5.0), (101, None)], "id long, x double")
    c = spark.createDataFrame([(i, 1.0) for i in range(500, 580)] + [(600, 5.3), (601, 5.2), (602, None)], "id long, x double")
    got = joins.caliper_match(t, c, ["x"], {"x": 0.5}, {"x": 1.0}, kept_table(spark)).collect()
    assert len(got) == 81 and len({r.treated_id for r in got}) == len({r.control_id for r in got}) == 81
    assert [(r.control_id, round(r.distance, 6)) for r in got if r.treated_id == 100] == [(601, 0.2)]
    crowd = spark.createDataFrame([(i, 2.0 + (i % 2) * 0.1) for i in range(60)], "id long, x double")
    assert joins.caliper_match(crowd, crowd.withColumn("x", F.col("x") + 0.05), ["x"], {"x": 0.5}, {"x": 1.0}, kept_table(spark)).count() == 60


def test_copies_match_as_by_all_pairs_without_writing_them(spark):
    """Many copies of few rows: the greedy order over all pairs, though no more rows are written than came."""
    rng = np.random.default_rng(4)
    side = lambda first, n, copies: [(first + i * copies + k, float(x), float(g)) for i, (x, g) in enumerate(zip(rng.integers(0, 40, n) / 4, rng.integers(0, 2, n))) for k in range(copies)]
    t, c = (spark.createDataFrame(rows, "id long, x double, g double") for rows in (side(0, 14, 15), side(10_000, 18, 11)))
    written = []

    def keep(df):
        made = kept_table(spark)(df)
        written.append(made.count())
        return made

    got = joins.caliper_match(t, c, ["x", "g"], {"x": 0.6, "g": 0.0}, {"x": 1.0, "g": 1.0}, keep).collect()
    equal = {(r.treated_id, r.control_id) for r in got if r.distance == 0}
    used = {i for p in equal for i in p}
    near = t.toDF("a", "xa", "ga").crossJoin(c.toDF("b", "xb", "gb")).where("abs(xa - xb) <= 0.6 and ga = gb and xa <> xb")
    want = set()
    for r in near.select("a", "b", F.abs(F.col("xa") - F.col("xb")).alias("d"), F.xxhash64("a", "b").alias("h")).orderBy("d", "h").collect():
        if r.a not in used and r.b not in used:
            used |= {r.a, r.b}
            want.add((r.a, r.b))
    assert equal and len(want) > 30 and {(r.treated_id, r.control_id) for r in got} - equal == want
    assert max(written) <= t.count() + c.count()


def test_critical_differences_of_many_methods(spark):
    from tidewatch.functions.stats import range_quantile

    got = {r.k: r.q for r in spark.createDataFrame([(k,) for k in (2, 3, 5, 10, 20, 46)], "k int").select("k", range_quantile("k").alias("q")).collect()}
    # tabled at 0.05 for infinite degrees of freedom: 2.772, 3.314, 3.858, 4.474, 5.012 over sqrt(2)
    for k, q in ((2, 2.772), (3, 3.314), (5, 3.858), (10, 4.474), (20, 5.012)):
        assert got[k] == pytest.approx(q / 2**0.5, abs=2e-3)
    assert got[46] > got[20]


def test_granger_against_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = np.concatenate([[0], 0.5 * x[:-1]]) + rng.normal(size=200)
    df = panel(spark, x).join(panel(spark, y, name="y").select("t", "y"), "t")
    r = e.granger(df, "x", "y", ["series_id"]).first()
    own = np.column_stack([np.ones(199), y[:-1]])
    full = np.column_stack([own, x[:-1]])
    sse = [((y[1:] - m @ np.linalg.lstsq(m, y[1:], rcond=None)[0]) ** 2).sum() for m in (own, full)]
    assert r.f_stat == pytest.approx((sse[0] - sse[1]) / (sse[1] / (199 - 3))) and r.p < 0.01


def test_network_tree_and_variants(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=40)
    series = {"a": base, "b": base + 0.01 * rng.normal(size=40), "c": rng.normal(size=40)}
    df = None
    for k, x in series.items():
        one = panel(spark, x, k).withColumn("window", F.lit("w"))
        df = one if df is None else df.unionByName(one)
    d = lambda p, q: np.sqrt(2 * (1 - abs(np.corrcoef(series[p], series[q])[0, 1])))
    got = networks.h0_persistence(df, "window", "x").first()
    assert got.total == pytest.approx(d("a", "b") + min(d("a", "c"), d("b", "c"))) and got.score is None
    s = v.volatility_variants(panel(spark, rng.normal(size=200), name="ret"), [("p", 10, 1), ("q", 20, 5)])
    assert {r["method"]: r["n"] for r in s.groupBy("method").agg(F.count("score").alias("n")).collect()} == {"p": 140, "q": 140}


def test_ensemble_needs_half_of_its_channels(spark):
    rows = [("a", m, D0, t, x) for t, xs in enumerate([(1.0, 2.0, 3.0), (1.0, None, 4.0), (None, None, 9.0)]) for m, x in zip("abc", xs)]
    df = spark.createDataFrame(rows, "series_id string, method string, ts date, t long, score double")
    got = {r.t: r.ensemble for r in fusion.weighted_ensemble(df, {"a": 2.0}).collect()}
    assert got == {0: pytest.approx(7 / 4), 1: pytest.approx(2.0), 2: None}
