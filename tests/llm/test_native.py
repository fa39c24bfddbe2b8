"""Sharding, mixing, licence scans and fixity: against their SQL, by brute force, and on odd inputs."""

from __future__ import annotations

import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import fixity, licences, mixing, sharding

from .conftest import plain

ODD = [
    (1, "a b c", "en", "s1"), (1, "a b c", "en", "s1"), (None, None, None, None), (None, "x", None, None), (2, "", "en", ""),
    (3, "Released under the MIT License.", "en", "s2"), (4, " \t\n", None, "s2"), (5, "é ü 一 " * 3000, "de", "s3"), (-7, "a b c", "fr", "s1"), (2**40, "z", "fr", None),
]
CLASH = ("size", "shard", "slot", "target", "taken", "_b", "weight", "row_no", "copies", "position", "matches")


def test_shards_match_sql_and_are_whole(docs, in_duckdb):
    df = docs(ODD + [(i, f"t{i}") for i in range(100, 400)], CLASH)
    out = sharding.feistel_shards(df)
    got = out.collect()
    assert plain(got) == plain(in_duckdb(sharding.oracle(), out.columns, documents=df))
    n = len(ODD) + 300
    assert len(got) == n and sorted(r.row_no for r in got) == list(range(n))
    sizes = [sum(r.shard == s for r in got) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert all(r.text_crc32 == zlib.crc32(b"a b c") for r in got if r.doc_id in (1, -7))
    assert plain(out.repartition(7).collect()) == plain(got)


def test_no_rows(docs):
    none = docs([])
    assert sharding.feistel_shards(none).count() == 0
    assert mixing.plan_mix(none).count() == 0
    assert mixing.mix_documents(none).count() == 0
    assert licences.scan_licences(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 12_345])
def test_permutation_is_one_and_invertible(spark, n):
    x = spark.range(n)
    p = x.select("id", sharding.permuted(F.col("id"), n, 3).alias("p"))
    back = p.select("id", "p", sharding.permuted(F.col("p"), n, 3, forward=False).alias("back")).collect()
    assert sorted(r.p for r in back) == list(range(n))
    assert all(r.back == r.id for r in back)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 10**12))
def test_grid_covers(n):
    a, b = sharding.grid(n)
    assert a * b >= n and a * b - n < max(a, b)


def test_mix_matches_sql(docs, in_duckdb):
    df = docs(ODD + [(i, "w " * (i % 17), "en", f"s{i % 5}") for i in range(100, 500)], CLASH)
    out = mixing.plan_mix(df)
    got = out.collect()
    assert plain(got) == plain(in_duckdb(mixing.oracle(), out.columns, documents=df))
    assert all(r.taken <= 3 * r.size for r in got)
    everything = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - everything) <= 12_000


def test_mix_reaches_targets_and_reruns(docs):
    df = docs([(i, "w " * (1 + i % 9), "en", f"s{i % 3 if i % 10 else 3}") for i in range(3000)])
    got = mixing.plan_mix(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= 9 for target, taken in by.values())
    assert plain(mixing.plan_mix(df.repartition(5)).collect()) == plain(got)


def test_water_filling_caps(spark):
    got = {r.skey: r.target for r in mixing.source_targets(spark.createDataFrame([("0a", 1000), ("0b", 10), ("0c", 10), ("0d", 0)], "skey string, source_size long"), (1, 2, 3), 3).collect()}
    assert got == {"0a": 960.0, "0b": 30.0, "0c": 30.0, "0d": 0.0}


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_schedule_inverts(spark, knots):
    """The integral up to time_of(q) is q, by the trapezoid rule on a fine grid."""
    for q, t in [(r.q, r.t) for r in spark.range(0, 101).select((F.col("id") / 100.0).alias("q"), mixing.time_of(F.col("id") / 100.0, knots).alias("t")).collect()]:
        def m(x):
            return next(m0 + (m1 - m0) * (x - t0) / (t1 - t0) for (t0, m0), (t1, m1) in zip(knots, knots[1:]) if t0 <= x <= t1)

        def integral(to, n=400):
            return sum((m(to * i / n) + m(to * (i + 1) / n)) / 2 * to / n for i in range(n))

        assert abs(integral(t) / integral(1.0) - q) < 1e-4


def test_mixed_documents_follow_the_plan(docs):
    df = docs([(i, f"w{i} " * (1 + i % 9), "en", f"s{i % 3}") for i in range(400)] + [(7, "same", "en", "s9")] * 3, ("extra", "_n", "_pos", "_did", "size"))
    plan = {}
    for r in mixing.plan_mix(df).collect():
        plan[r.doc_id, r.size] = plan.get((r.doc_id, r.size), 0) + r.copies
    out = mixing.mix_documents(df)
    got = out.collect()
    assert out.columns == df.columns
    seen = {}
    for r in got:
        key = (r.doc_id, len(r.text.split()))
        seen[key] = seen.get(key, 0) + 1
    assert seen == {k: v for k, v in plan.items() if v}


S = licences.SENTENCES
MIT = S["MIT-GRANT"].replace(" without ", "\nwithout ").replace(" subject", "\n   subject")


def test_licences_match_sql_and_loops(docs, in_duckdb):
    texts = [
        "Text.\nReleased under the MIT License.", "released UNDER the mit license", "x\nThis work is licensed under the GNU General Public License, version 3.\ny",
        "Copyright me\n\n" + MIT + "\n\n" + S["MIT-KEEP"], S["MIT-KEEP"] + "\n" + MIT, MIT,
        "Apache. Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", "licence talk only, no rule", "Licensed under\n\nCC BY 4.0.",
        S["MPL-2.0-HEAD"], "software " * 20_000 + "\nLicensed under CC BY 4.0.", " ".join(S[k] for k in ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES")),
        "Licensed\nunder\nthe Apache License, Version 2.0\n(the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: GPL-2.0-or-later\ncode", "Released under the\nMIT License\nMIT License", MIT + "\n" + S["MIT-KEEP"] + "\nMIT License\n" + S["MIT-GRANT"],
    ]
    df = docs(ODD + [(i, t) for i, t in enumerate(texts, 50)], CLASH)
    out = licences.scan_licences(df).drop("matches")
    got = out.collect()
    assert plain(got) == plain(in_duckdb(licences.oracle(), out.columns, documents=df))
    assert plain(got) == plain([(r.doc_id, *licences.brute_force(r.text)) for r in df.collect()])
    by = {r.doc_id: r.licences for r in got}
    assert by[50] == by[51] == "MIT" and by[52] == "GPL-3.0-only" and by[53] == "MIT" and by[54] == by[55] == "" and by[56] == "Apache-2.0,CC-BY-NC-4.0"
    assert by[57] == by[58] == "" and by[59] == "MPL-2.0" and by[60] == "CC-BY-4.0" and by[61] == "BSD-3-Clause" and by[62] == "Apache-2.0"
    assert by[63] == "GPL-2.0-or-later" and by[64] == by[65] == "MIT"


def test_wrapped_sentences_are_found(docs):
    """Every known sentence, wrapped at 20 to 100 columns, also as comments, is found with its unit span."""
    import textwrap

    rows, want = [], {}
    for sentence, ident in licences.KNOWN.items():
        said = S.get(ident, sentence)
        said = said if licences.normalised(said) == sentence else sentence
        for width, prefix in ((20, ""), (50, " * "), (79, "# "), (100, "")):
            lines = textwrap.wrap(said, width, break_long_words=False, break_on_hyphens=False)
            want[len(rows)] = ident, len(lines)
            rows.append((len(rows), "Some text here.\n" + "\n".join(prefix + line for line in lines) + "\nmore"))
    for r in licences.scan_licences(docs(rows)).collect():
        assert [(m["at"], m["id"]) for m in r.matches] == [(1, want[r.doc_id][0])] and r.matches[0]["units"] >= want[r.doc_id][1]


def test_every_rule_is_reached(docs):
    """Each rule's sentences alone give its licence and no other."""
    said = {ident: sentence for sentence, ident in licences.KNOWN.items()}
    rows = [(i, ".\n".join(said[x] for x in seq)) for i, (_, seq) in enumerate(licences.RULES)]
    assert {r.doc_id: r.licences for r in licences.scan_licences(docs(rows)).collect()} == {i: name for i, (name, _) in enumerate(licences.RULES)}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*S.values(), "MIT License", "Released under the", "Licensed under CC", "BY 4.0.", "word.", "", "x"]), max_size=6), max_size=6))
def test_licences_by_loops_on_random_texts(spark, docs, in_duckdb, parts):
    df = docs([(i, "\n".join(p)) for i, p in enumerate(parts)])
    out = licences.scan_licences(df).drop("matches")
    got = plain(out.collect())
    assert got == plain([(r.doc_id, *licences.brute_force(r.text)) for r in df.collect()]) == plain(in_duckdb(licences.oracle(), out.columns, documents=df))


def test_fixity_matches_sql(spark, in_duckdb):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(700)] + [(5, "http://h/5", "<p>"), (None, None, None), (9, None, "é"), (9, None, "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)).withColumn("hash", F.lit(1))
    out = fixity.audit_pages(df, file_records=64, fanout=4)
    got = out.collect()
    assert len(got) > 5 and {r.fault for r in got} == {"changed", "unreadable"}
    assert plain(got) == plain(in_duckdb(fixity.oracle(64), out.columns, pages=df))
    assert fixity.audit_pages(df.limit(0)).count() == 0


def test_equal_trees_have_no_damage(spark):
    digests = spark.createDataFrame([(0, i, 10 * i, 10, i, f"h{i}", f"h{i}" if i != 33 else "?") for i in range(50)], "file long, ordinal int, start long, length long, record_id long, a string, b string")
    a, b = (fixity.tree(digests, c, 4, 64) for c in "ab")
    assert fixity.audit(a, a, 4, 64).count() == 0
    got = fixity.audit(a, b, 4, 64).collect()
    assert [(r.file, r.node, r.start, r.stop) for r in got] == [(0, 33, 330, 340)]
    lost = b.where("not (level = 0 and node = 33)")
    assert fixity.audit(a, lost, 4, 64).count() == 1
    assert a.where("level = 3").count() == 1
