"""Keyed stateful operators and their batch twins."""
