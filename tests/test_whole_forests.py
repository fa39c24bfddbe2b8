"""The registered forests hold out every event and grow the operators' full number of trees."""

from __future__ import annotations

import inspect

from tidewatch.operators import forests, models
from tidewatch.plans import load
from tidewatch.sources import panels


def spy(monkeypatch, name, module=models, **smaller):
    """Arguments of <module>.<name> as the query gives them; the call itself runs with `smaller`."""
    real, seen = getattr(module, name), {}

    def run(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return real(**{**bound.arguments, **smaller})

    monkeypatch.setattr(module, name, run)
    return seen


def test_every_event_is_held_out(spark, data, monkeypatch):
    seen = spy(monkeypatch, "held_out_forest", forests, trees=2, depth=2)
    got = load()[0]["m9_held_out_forest"](spark, data)
    assert {r.event for r in got.select("event").distinct().collect()} == {r.event_id for r in panels.events_dim(spark).collect()}
    assert seen["trees"] == 200 and seen["depth"] == 6


def test_isolation_forest_is_whole(spark, data, monkeypatch):
    seen = spy(monkeypatch, "isolation_scores", trees=2, sample=16)
    assert load()[0]["m8_isolation_forest"](spark, data).count() > 0
    assert (seen["trees"], seen["sample"]) == (100, 256)
