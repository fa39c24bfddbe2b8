"""Sources, results and the entry point."""

from __future__ import annotations

import base64
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewatch.sources import results, tables


def test_runs_decode(spark):
    values = np.array([0.0, 1.5, -2.25, 3.4e38, 1e-40, -0.1], "<f4")
    df = spark.createDataFrame([("r", "g", base64.b64encode(values.tobytes()).decode()), ("e", "g", "")], "run_id string, group_label string, payload string")
    got = {r.run_id: r.returns for r in tables.runs_from_base64(df).collect()}
    assert got["r"] == pytest.approx(values.tolist(), rel=1e-6) and got["e"] == []


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0), ("b", dt.date(2021, 1, 1), 2.0)], "series_id string, ts date, close double").write.parquet(str(tmp_path / "p"))
    df = tables.ohlcv(spark, str(tmp_path / "p"), ["a"], "2019-01-01", "2020-12-31")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1 and "PushedFilters: [" in plan and "series_id" in plan.split("PushedFilters")[1]


def test_result_tables(spark, tmp_path):
    cells = spark.createDataFrame([("m", "e", 0.5)], "method string, event string, d double")
    path = str(tmp_path / "runs")
    results.write_run(cells, path, "r1")
    results.write_run(cells.withColumn("d", F.lit(0.7)), path, "r2")
    d = results.run_diff(results.read_runs(spark, path, "r1"), results.read_runs(spark, path, "r2")).first()
    assert d.delta == pytest.approx(0.2) and d.state == "both"
    runs = spark.createDataFrame([("m", "r1", 1), ("m", "r2", 2)], "method string, run_id string, created int")
    assert results.latest_run(runs).first().run_id == "r2"


def test_level_bars_and_trades(spark):
    r = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 0.1, -0.5])], "series_id string, t long, ret double")
    assert [x.level for x in tables.level_from_returns(r).orderBy("t").collect()] == pytest.approx([100, 110, 55])
    t = spark.createDataFrame([("x", dt.date(2020, 1, 1), 1, 10.0, 2.0), ("x", dt.date(2020, 1, 1), 2, 20.0, 2.0), ("y", dt.date(2020, 1, 2), 1, 5.0, 1.0)], "id string, ts date, at int, p double, v double")
    got = {r.id: (r.price, r.vol, r.vwap) for r in tables.daily_trades(t, 0.5).collect()}
    assert got == {"x": (10.0, 4.0, 15.0), "y": (5.0, 1.0, 5.0)}


def test_entry_runs_and_names_agree(spark):
    assert __spark_entry__.entry(spark).count() > 0
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_entry_without_the_optional_parts(monkeypatch):
    monkeypatch.setattr(__spark_entry__, "LLM", False)
    monkeypatch.setattr(__spark_entry__, "PIPELINE", False)
    assert not [k for k in __spark_entry__.queries() if k.startswith("op") and k[2].isdigit()] and "pipeline" not in __spark_entry__.queries()


def test_fallback_register_and_run_payloads(spark, tmp_path):
    day = lambda d: dt.date(2020, 1, d)
    a = spark.createDataFrame([("x", day(1), 1.0)], "series_id string, ts date, close double")
    b = spark.createDataFrame([("x", day(1), 9.0), ("x", day(2), 2.0)], "series_id string, ts date, close double")
    c = spark.createDataFrame([("x", day(2), 8.0), ("y", day(1), 3.0)], "series_id string, ts date, close double")
    assert sorted((r.series_id, r.ts.day, r.close) for r in tables.with_fallback(a, b, c).collect()) == [("x", 1, 1.0), ("x", 2, 2.0), ("y", 1, 3.0)]
    path = str(tmp_path / "register")
    for i, (run, note) in enumerate((("r1", "canonical"), ("r2", "canonical"), ("r3", ""))):
        results.register_run(spark, path, run, i, note)
    assert [r.run_id for r in results.canonical_run(spark.read.parquet(path)).collect()] == ["r2"]
    df = spark.createDataFrame([("r", "g", [0.5, -1.25]), ("e", "g", []), ("n", "g", None)], "run_id string, group_label string, v array<double>")
    got = {r.run_id: r.returns for r in tables.runs_from_base64(tables.runs_to_base64(df, "v")).collect()}
    assert got["r"] == [0.5, -1.25] and got["e"] == [] and not got["n"]
