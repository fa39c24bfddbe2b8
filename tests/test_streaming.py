"""Streams replayed from files equal their batch twins; late rows are dropped."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tidewatch.streaming import stateful as st

SCHEMA = "series_id string, ts timestamp, value double"


def ticks(spark, n=150):
    rng = np.random.default_rng(0)
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), None if i % 17 == 3 else float(rng.normal(scale=1 + 4 * (i > 100)))) for s in "ab" for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


PROCESSORS = [st.Welford(), st.Cusum(0.5, 40), st.Ewma(), st.CoolDown(2.0, 3), st.Evidence(40), st.BayesFilter(60), st.PercentileScore(100, 30), st.Transition(5, 0.8, 10)]


@pytest.mark.parametrize("processor", PROCESSORS, ids=lambda p: type(p).__name__)
def test_replay_equals_batch(spark, tmp_path, processor):
    df = ticks(spark)
    got = sorted(map(tuple, st.replayed(df, processor, str(tmp_path)).collect()))
    want = sorted(map(tuple, st.batch_twin(df, processor).collect()))
    assert len(got) == 300
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], nan_ok=True)


@pytest.mark.parametrize("processor", PROCESSORS, ids=lambda p: type(p).__name__)
def test_batch_twins(spark, processor):
    out = st.batch_twin(ticks(spark), processor)
    assert out.count() == 300
    late = ticks(spark).unionByName(ticks(spark).where("ts < '2024-01-02'"))
    assert st.batch_twin(late, processor).count() == 300
    assert st.batch_twin(ticks(spark).limit(0), processor).count() == 0


def test_bars_and_sessions(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h, m), float(h)) for h, m in ((0, 5), (0, 50), (1, 1), (6, 0), (6, 59))]
    df = spark.createDataFrame(rows, SCHEMA)
    bars = {r.ts.hour: (r.n, r.total) for r in st.tick_bars(df, "series_id", "value").collect()}
    assert bars == {0: (2, 0.0), 1: (1, 1.0), 6: (2, 12.0)}
    s = sorted((r.start.hour, r.n) for r in st.alarm_sessions(df, "2 hours").collect())
    assert s == [(0, 3), (6, 2)]
