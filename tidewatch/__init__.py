"""Regime analytics and training-data operators on Spark."""
