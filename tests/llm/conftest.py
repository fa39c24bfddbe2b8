from __future__ import annotations

import duckdb
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from (doc_id, text, lang, source) tuples, with clashing extra columns when asked."""

    def make(rows, clash=()):
        df = spark.createDataFrame([(*r, *[None] * (4 - len(r)), None if len(r) < 2 or r[1] is None else len(r[1]))[:5] for r in rows], DOCS)
        for name in clash:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def in_duckdb(spark):
    """Rows of a DuckDB query over DataFrames given by table name, columns in the DataFrame's order."""

    def run(sql, columns, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toArrow())
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        return [tuple(r[names.index(c)] for c in columns) for r in got.fetchall()]

    return run


def plain(rows):
    """Rows as sorted tuples, floats to nine digits."""
    return sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])
