"""Operators on panels: features, detectors, fusion, alarms, evaluation, models, geometry, backtests."""
