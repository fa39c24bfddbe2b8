"""Effect sizes, tests and alarm metrics on hand-made cases and against NumPy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import stats
from tidewatch.operators import evaluate as e
from tidewatch.operators import joins
from tidewatch.sources.results import kept_table

D0 = dt.date(2000, 1, 1)


def scores(spark, values, method="m", series="a"):
    rows = [(series, method, D0 + dt.timedelta(days=i), i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, method string, ts date, t long, score double")


def events(spark, *spans):
    rows = [(f"e{k}", D0 + dt.timedelta(days=a), D0 + dt.timedelta(days=b)) for k, (a, b) in enumerate(spans)]
    return spark.createDataFrame(rows, "event_id string, start date, stop date")


def test_cohens_d_against_numpy(spark):
    v = np.random.default_rng(0).normal(size=200)
    v[50:80] += 2
    m = e.cohens_d(e.group_moments(scores(spark, v), events(spark, (50, 79)))).first()
    a, b = v[50:80], np.delete(v, range(50, 80))
    pooled = np.sqrt((29 * a.var(ddof=1) + 169 * b.var(ddof=1)) / 198)
    assert m.d == pytest.approx(abs(a.mean() - b.mean()) / pooled) and (m.n1, m.n2) == (30, 170)
    w = e.welch_t(e.group_moments(scores(spark, v), events(spark, (50, 79)))).first()
    assert w.t == pytest.approx((a.mean() - b.mean()) / np.sqrt(a.var(ddof=1) / 30 + b.var(ddof=1) / 170)) and 0 <= w.p < 1e-6


def test_flat_and_short_groups(spark):
    one = e.cohens_d(e.group_moments(scores(spark, [1.0] * 20), events(spark, (3, 8), (5, 5)))).collect()
    assert {r.event_id: r.d for r in one} == {"e0": 0.0, "e1": None}
    assert e.group_moments(scores(spark, []), events(spark, (1, 2))).count() == 0


def test_ranks_and_cliff(spark):
    v = [1, 2, 2, 3, 5, 5, 0, 4]
    r = e.rank_statistics(scores(spark, v), events(spark, (3, 5))).first()
    a, b = v[3:6], v[:3] + v[6:]
    more, less = sum(x > y for x in a for y in b), sum(x < y for x in a for y in b)
    assert r.cliff == pytest.approx((more - less) / 15) and r.cliff_label == "large"


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([("k", p) for p in (0.01, 0.04, 0.03, 0.005)], "k string, p double")
    got = {r.p: (r.p_holm, r.p_bh) for r in e.benjamini_hochberg(e.holm(df, "p", ["k"]), "p", ["k"]).collect()}
    assert got[0.005] == pytest.approx((0.02, 0.02)) and got[0.01] == pytest.approx((0.03, 0.02)) and got[0.03] == pytest.approx((0.06, 0.04)) and got[0.04] == pytest.approx((0.06, 0.04))


def test_friedman_known_case(spark):
    rows = [(f"b{i}", f"m{j}", float(v)) for i, r in enumerate([(3, 2, 1), (3, 2, 1), (3, 1, 2), (3, 2, 1)]) for j, v in enumerate(r)]
    f = e.friedman(spark.createDataFrame(rows, "event_id string, method string, d double")).first()
    assert f.chi_sq == pytest.approx(6.5) and f.n == 4 and f.k == 3
    few = spark.createDataFrame(rows[:6], "event_id string, method string, d double")
    assert e.friedman(few).count() == 0
    n = {(r.method_a, r.method_b): r for r in e.nemenyi(spark.createDataFrame(rows, "event_id string, method string, d double")).collect()}
    assert n["m0", "m2"].difference == pytest.approx(1.75) and n["m0", "m2"].cd == pytest.approx(2.343 * (12 / 24) ** 0.5, abs=1e-3)


def alarm_rows(spark, at, n=100):
    s = scores(spark, [0.0] * n).withColumn("alarm", F.col("t").isin(list(at)) if at else F.lit(False))
    return s


@pytest.mark.parametrize(("at", "want"), [([40, 60], (1, 1, 1)), ([45, 55], (1, 1, 1)), ([], (0, 0, 0)), ([10], (0, 0, 0)), ([40, 41, 42, 60], (0.5, 1, 2 / 3))])
def test_tolerance_f1(spark, at, want):
    a = alarm_rows(spark, at).where("alarm").select("series_id", "method", "t")
    b = spark.createDataFrame([("a", "m", "e0", 40, 60)], "series_id string, method string, event_id string, t_start long, t_stop long")
    r = e.tolerance_f1(a, b, 10).first()
    assert (r.precision, r.recall, r.f1) == pytest.approx(want)


def test_delay_and_false_alarms(spark):
    r = e.point_metrics(alarm_rows(spark, [2, 45], 272), events(spark, (40, 59))).first()
    assert r.delay == 5 and r.false_alarms_per_year == pytest.approx(1.0) and r.precision == 0.5 and r.recall == pytest.approx(1 / 20)


def test_auc_of_perfect_and_constant_scores(spark):
    perfect = e.auc_pr(scores(spark, [0] * 10 + [5] * 5 + [0] * 5), events(spark, (10, 14))).first()
    assert perfect.auc_pr == pytest.approx(1.0)
    flat = e.auc_pr(scores(spark, [1] * 20), events(spark, (10, 14))).first()
    assert flat.auc_pr == pytest.approx((1 + 0.25) / 2)


def test_lead_time(spark):
    a = alarm_rows(spark, [10, 11, 50, 51], 100)
    starts = spark.createDataFrame([("a", "e0", 80), ("a", "e1", 5)], "series_id string, event_id string, t0 long")
    got = {r.event_id: (r.lead_time, r.episodes) for r in e.lead_time(a, starts, lookback=60).collect()}
    assert got == {"e0": (30, 1), "e1": (None, 0)}


def test_event_membership_pads_and_months(spark):
    df = scores(spark, range(120))
    m = joins.event_members(df, events(spark, (20, 70), (28, 28)), pad=2)
    got = {k: sorted(r.t for r in m.where(F.col("event_id") == k).collect()) for k in ("e0", "e1")}
    assert got == {"e0": list(range(18, 73)), "e1": list(range(26, 31))}


def test_asof_strict_and_first(spark):
    df = spark.createDataFrame([("a", t) for t in range(6)], "series_id string, t long")
    snaps = spark.createDataFrame([("a", 2, 20.0), ("a", 4, 40.0)], "series_id string, refit_t long, level double")
    get = lambda strict: [r.level for r in joins.asof(df, snaps, "refit_t", ["level"], strict).orderBy("t").collect()]
    assert get(False) == [20.0, 20.0, 20.0, 20.0, 40.0, 40.0] and get(True) == [None, None, 20.0, 20.0, 40.0, 40.0]


def test_caliper_matching(spark):
    t = spark.createDataFrame([(1, 0.0), (2, 1.0)], "id long, x double")
    c = spark.createDataFrame([(10, 0.1), (11, 0.4), (12, 9.0)], "id long, x double")
    got = sorted((r.treated_id, r.control_id) for r in joins.caliper_match(t, c, ["x"], {"x": 0.7}, {"x": 1.0}, kept_table(spark)).collect())
    assert got == [(1, 10), (2, 11)]


def test_tail_probabilities(spark):
    df = spark.range(1).select(stats.normal_sf(F.lit(1.959963985)).alias("n"), stats.t_sf(F.lit(2.228138852), F.lit(10)).alias("t"), stats.chi2_sf(F.lit(3.841458821), F.lit(1)).alias("c"), stats.f_sf(F.lit(4.964602744), F.lit(1), F.lit(10)).alias("f"))
    r = df.first()
    assert (r.n, r.t, r.c, r.f) == pytest.approx((0.025, 0.025, 0.05, 0.05), abs=1e-7)
