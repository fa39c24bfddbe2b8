"""Fill-in-middle: against a plain scan, DuckDB and the exact text."""

from __future__ import annotations

import hashlib
import random
from itertools import groupby

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import fim

from .conftest import plain

COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def scanned(text):
    """Units by one walk over the characters."""
    out = []
    for letters, run in groupby(text, lambda c: c.isascii() and c.isalpha()):
        out += ["".join(run)] if letters else list(run)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("ab Zé\n<PSM>1🎉", max_size=40), st.integers(1, 9))
def test_units_end_where_a_scan_says_in_one_match_or_in_pieces(text, piece):
    ends, at = [], 0
    for unit in scanned(text):
        at += len(unit)
        ends.append(at)
    assert fim.unit_ends(text).tolist() == ends
    assert fim.unit_ends(text, piece).tolist() == ends


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = scanned(text)
    n = len(units)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    x, y = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    a, m, z = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{z}<P>{a}<M>{m}" if form == "spm" else f"<P>{a}<S>{z}<M>{m}"
    return (doc_id, n, form, len(a), len(m), sha(out), sha(text))


def test_digests_match_brute_force_and_sql(spark, docs, in_duckdb, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ab Zé\n<PSM>1🎉", k=rng.randrange(60)))) for i in range(300)]
    rows += [(500, None), (501, ""), (502, "x<P>y"), (503, "a" * 3_000_000 + "b c" * 200_000), (None, "no id"), (504, "same"), (504, "same"), (-7, "minus"), (505, "<<P<S<M>>x")]
    df = docs(rows, ("n", "form", "output", "text_"))
    monkeypatch.setattr(fim, "BATCH_CHARS", 1000)
    got = fim.digests(fim.fill_in_middle(df)).select(*COLUMNS).collect()
    assert plain(got) == plain(brute(*r) for r in rows)
    assert plain(got) == plain(in_duckdb(fim.oracle(), COLUMNS, documents=df))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert all(r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for r, (_, t) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0]))))


def test_parameters_and_real_outputs(docs):
    rows = [(i, f"word {i} and ünits, {i * i}") for i in range(200)]
    made = fim.fill_in_middle(docs(rows), plain=100, spm=50, seed="run7")
    back = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in back} == {"psm", "spm"}
    assert sorted((r.doc_id, r.back) for r in back) == rows
    assert {r.form for r in fim.fill_in_middle(docs(rows), plain=0).collect()} == {"plain"}
    assert fim.digests(fim.fill_in_middle(docs([]))).collect() == []
