"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame; sql is the DuckDB query with the same columns."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Every double column to `digits` places, so that two engines' sums compare; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(columns: str, doubles: str, src: str, digits: int = DIGITS) -> str:
    """SELECT of plain columns and of rounded ones (both comma-separated; `a=expr` names an expression)."""

    def one(c: str) -> str:
        name, _, e = c.strip().partition("=")
        return f"round(({e or name})::DOUBLE, {digits}) + 0.0 AS {name.strip()}"

    def part(c: str) -> str:
        name, _, e = c.strip().partition("=")
        return f"{e} AS {name.strip()}" if e else name

    cols = [part(c) for c in _split(columns)] + [one(c) for c in _split(doubles)]
    return f"SELECT {', '.join(cols)} FROM {src}"


def _split(text: str) -> list[str]:
    """Splits at commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += c in "([{"
        depth -= c in ")]}"
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    out.append(text[at:])
    return [x for x in out if x.strip()]
