"""Licence recognition by sentence rules (DataFrame functions only).

A text is cut into units: lines, cut further at sentence ends, each normalised. A known licence
sentence begins and ends with units and may be wrapped over any number of them, but not over a
blank one. The identifiers found, in document order, are matched against ordered licence rules,
and a rule that matches consumes its identifiers. Everything is a row-wise expression over fixed
tables: nothing shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences by identifier, as their licences word them.
SENTENCES = {
    "APACHE-2.0-HEAD": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "APACHE-2.0-COPY": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "APACHE-2.0-COPY-S": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "APACHE-2.0-ASIS": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "APACHE-2.0-TITLE": "Apache License Version 2.0, January 2004",
    "MIT-NAME": "MIT License",
    "MIT-NAME-THE": "The MIT License (MIT)",
    "MIT-GRANT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT-0-GRANT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "MIT-KEEP": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-ASIS": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "MIT-LIABLE": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-GRANT": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD-GRANT": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "ISC-ASIS": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD-GRANT": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-SOURCE": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-BINARY": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-ADVERT": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "BSD-NAMES": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-ASIS": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "MPL-2.0-HEAD": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0-HEAD": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "ZLIB-ASIS": "This software is provided 'as-is', without any express or implied warranty.",
    "ZLIB-GRANT": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0-GRANT": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "UNLICENSE-FREE": "This is free and unencumbered software released into the public domain.",
    "UNLICENSE-ANYONE": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0-WAIVE": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
}

# Ordered rules, the licence and the identifiers that must follow one another; longer forms come first.
TEXT_RULES = [
    ("Apache-2.0", ["APACHE-2.0-HEAD", "APACHE-2.0-COPY", "APACHE-2.0-ASIS"]),
    ("Apache-2.0", ["APACHE-2.0-HEAD", "APACHE-2.0-COPY-S", "APACHE-2.0-ASIS"]),
    ("Apache-2.0", ["APACHE-2.0-HEAD"]),
    ("Apache-2.0", ["APACHE-2.0-TITLE"]),
    ("MIT", ["MIT-GRANT", "MIT-KEEP", "MIT-ASIS", "MIT-LIABLE"]),
    ("MIT", ["MIT-GRANT", "MIT-KEEP"]),
    ("MIT-0", ["MIT-0-GRANT"]),
    ("MIT", ["MIT-NAME", "MIT-GRANT"]),
    ("ISC", ["ISC-GRANT"]),
    ("0BSD", ["0BSD-GRANT"]),
    ("BSD-4-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ADVERT", "BSD-NAMES"]),
    ("BSD-3-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES"]),
    ("BSD-2-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"]),
    ("MPL-2.0", ["MPL-2.0-HEAD"]),
    ("EPL-2.0", ["EPL-2.0-HEAD"]),
    ("Zlib", ["ZLIB-ASIS", "ZLIB-GRANT"]),
    ("BSL-1.0", ["BSL-1.0-GRANT"]),
    ("Unlicense", ["UNLICENSE-FREE", "UNLICENSE-ANYONE"]),
    ("Unlicense", ["UNLICENSE-FREE"]),
    ("CC0-1.0", ["CC0-1.0-WAIVE"]),
]

# The names by which notices call a licence.
NAMES = {
    "Apache-2.0": "Apache License, Version 2.0",
    "MIT": "MIT License",
    "ISC": "ISC License",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "MPL-2.0": "Mozilla Public License 2.0",
    "EPL-2.0": "Eclipse Public License 2.0",
    "Zlib": "zlib License",
    "BSL-1.0": "Boost Software License, Version 1.0",
    "CC0-1.0": "CC0 1.0 Universal",
}
# How a notice begins.
NOTICES = ("Released under the", "Licensed under the", "Distributed under the", "This work is licensed under the", "This project is licensed under the", "This software is licensed under the")
# The GNU licences, their versions and what their notices call the work.
GNU = {"GPL": ("General Public License", ("2.0", "3.0"), "program"), "LGPL": ("Lesser General Public License", ("2.1", "3.0"), "library"), "AGPL": ("Affero General Public License", ("3.0",), "program")}
# Creative Commons conditions and versions.
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = ("3.0", "4.0")

#: Every known sentence holds one of these words, so texts without any need no cutting.
ANCHORS = ("licen", "permission", "redistribut", "software", "advertis", "copyright", "universal")

#: A sentence ends at . ! ? or : before white space or quotes, and at every line end.
_END = r"([.!?:])[\x22')]*[\x20\x09\x0B-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: str) -> str:
    """A-Z in lower case, every run of anything but ASCII letters and digits one space."""
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(_UPPER, _LOWER))).strip()


def _tables() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Identifier by normalised sentence, and all ordered rules: those of licence texts, then of notices and tags."""
    known = {normalised(text): ident for ident, text in SENTENCES.items()}
    rules = list(TEXT_RULES)

    def add(licence: str, ident: str, *texts: str) -> None:
        known.update({normalised(text): ident for text in texts})
        rules.append((licence, [ident]))

    for licence, name in NAMES.items():
        add(licence, f"{licence.upper()}-NOTE", *[f"{start} {name}." for start in NOTICES])
    for short, (name, versions, work) in GNU.items():
        for version in versions:
            said, licence = version.removesuffix(".0"), f"{short}-{version}"
            for mark, free in ((":", "free software:"), (",", "free software;")):
                grant = f"This {work} is {free} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{mark}"
                known[normalised(f"{grant} either version {said} of the License, or (at your option) any later version.")] = f"{licence}-LATER"
                known[normalised(f"{grant} version {said} of the License.")] = f"{licence}-ONLY"
            rules.append((f"{licence}-or-later", [f"{licence}-LATER"]))
            rules.append((f"{licence}-only", [f"{licence}-ONLY"]))
            add(f"{licence}-only", f"{licence}-NOTE", *[f"{start} GNU {name}, version {said}." for start in NOTICES])
            add(f"{licence}-or-later", f"{licence}-NOTE-LATER", *[f"{start} GNU {name}, version {said} or later." for start in NOTICES])
    for short, name in CC.items():
        for version in CC_VERSIONS:
            kind = "International" if version == "4.0" else "Unported"
            add(f"CC-{short}-{version}", f"CC-{short}-{version}-NOTE", f"Licensed under CC {short} {version}.", f"This work is licensed under CC {short} {version}.", f"This work is licensed under a Creative Commons {name} {version} {kind} License.")
    for licence in sorted({name for name, _ in rules}):
        add(licence, f"SPDX-{licence}", f"SPDX-License-Identifier: {licence}")
    assert all(any(a in sentence for a in ANCHORS) for sentence in known)
    return known, rules


KNOWN, RULES = _tables()
#: One match: the unit it begins with (from 0), the units it spans, the sentence's identifier.
MATCHES = "array<struct<at:int,units:int,id:string>>"


def normalised_units(text: Column) -> Column:
    """The units of a text, normalised, a line break between each two."""
    cut = F.translate(F.regexp_replace(text, _END, "$1\n"), _UPPER, _LOWER)
    return F.regexp_replace(F.regexp_replace(cut, r"[^a-z0-9\n]+", " "), r"(?m)^ +| +$", "")


def _line_ends(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))


def sentence_matches(text: Column) -> Column:
    """MATCHES of a text: known sentences in document order, at each place the longest, none over another.

    In the normalised text a known sentence is its words, a space or one line break between each
    two, from a unit's begin to a unit's end.
    """
    longest_first = sorted(KNOWN, key=lambda s: (-s.count(" "), s))
    pattern = "(?m)^(" + "|".join(s.replace(" ", "[ \n]") for s in longest_first) + ")$"
    table = F.create_map(*[F.lit(x) for pair in sorted(KNOWN.items()) for x in pair])
    # each known sentence between two control characters, which normalised texts never hold
    parts = F.split(F.regexp_replace(normalised_units(text), pattern, "\x01$1\x02"), "\x01")

    def gather(ps: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            said = F.substring_index(p, "\x02", 1)
            hit = F.struct(acc["at"].alias("at"), (_line_ends(said) + 1).alias("units"), F.try_element_at(table, F.translate(said, "\n", " ")).alias("id"))
            return F.struct((acc["at"] + _line_ends(p)).alias("at"), F.array_append(acc["found"], hit).alias("found"))

        start = F.struct(_line_ends(F.element_at(ps, 1)).alias("at"), F.array().cast(MATCHES).alias("found"))
        return F.aggregate(F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(0))), start, step)["found"]

    hits = F.element_at(F.transform(F.array(parts), gather), 1)  # binds the parts once
    return F.when(text.rlike("(?i)" + "|".join(ANCHORS)), hits).otherwise(F.array().cast(MATCHES))


def _sequence(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def apply_rules(ids: Column) -> Column:
    """The licences (array, sorted, each once) of an array of sentence identifiers: rules in order, each consuming what it matches."""
    rules = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(_sequence(seq)).alias("seq")) for name, seq in RULES])
    line = F.concat(F.lit(""), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))

    def step(acc: Column, rule: Column) -> Column:
        used = F.struct(F.replace(acc["line"], rule["seq"], F.lit("|")).alias("line"), F.array_append(acc["found"], rule["licence"]).alias("found"))
        return F.when(acc["line"].contains(rule["seq"]), used).otherwise(acc)

    start = F.struct(line.alias("line"), F.array().cast("array<string>").alias("found"))
    return F.array_sort(F.array_distinct(F.aggregate(rules, start, step)["found"]))


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, matches (array of at, units, id), sentence_ids, licences, n_sentences for every document.

    `licences` joins with commas, sorted, the licences whose rules match: a rule's identifiers
    follow one another among the document's known sentences (unknown sentences may stand
    between), and no earlier rule has consumed them. A null or empty text, or one without known
    sentences, has '' for both; repeated sentences count each; repeated rows give a row each; an
    empty table gives none; other columns are ignored.
    """
    found = docs.select("doc_id", F.coalesce(sentence_matches(F.col("text")), F.array().cast(MATCHES)).alias("matches"))
    ids = F.transform("matches", lambda s: s["id"])
    return found.select(
        "doc_id",
        "matches",
        F.array_join(ids, " ").alias("sentence_ids"),
        F.when(F.size("matches") > 0, F.array_join(apply_rules(ids), ",")).otherwise("").alias("licences"),
        F.size("matches").cast("long").alias("n_sentences"),
    )


def brute_force(text: str | None) -> tuple[str, str, int]:
    """sentence_ids, licences and n_sentences of one text, by loops over units and words; for the tests."""
    units = [normalised(u).split() for u in re.sub(_END, r"\1\n", text or "").split("\n")]
    sentences = {tuple(s.split()): ident for s, ident in KNOWN.items()}
    ids, i = [], 0
    while i < len(units):
        words, best, end = [], None, i
        for j in range(i, len(units)):
            words += units[j]
            if not units[j] or len(words) > max(map(len, sentences)):
                break
            if tuple(words) in sentences:
                best, end = sentences[tuple(words)], j
        if best is None:
            i += 1
        else:
            ids.append(best)
            i = end + 1
    left, found = list(ids), set()
    for licence, seq in RULES:
        k = 0
        while k + len(seq) <= len(left):
            if left[k : k + len(seq)] == seq:
                found.add(licence)
                left[k : k + len(seq)] = [None]
            k += 1
    return " ".join(ids), ",".join(sorted(found)), len(ids)


def oracle() -> str:
    """scan_licences without its matches, in DuckDB SQL: every unit's begin beside every sentence of the same first word."""
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({lit(s)}, {lit(i)})" for s, i in KNOWN.items())
    steps = "".join(f", contains(l{k}, {lit(_sequence(seq))}) AS h{k}, replace(l{k}, {lit(_sequence(seq))}, '|') AS l{k + 1}" for k, (_, seq) in enumerate(RULES))
    hits = " || ".join(f"CASE WHEN h{k} THEN [{lit(name)}] ELSE [] END" for k, (name, _) in enumerate(RULES))
    return rf"""
WITH known AS (SELECT s, id, string_split(s, ' ')[1] AS head, strlen(s) AS n, len(string_split(s, ' ')) AS words FROM (VALUES {known}) t(s, id)),
docs AS (SELECT doc_id, row_number() OVER () AS rid, text FROM documents),
cut AS (SELECT rid, list_transform(string_split(translate(regexp_replace(text, {lit(_END)}, '' || chr(10), 'g'), '{_UPPER}', '{_LOWER}'), chr(10)),
          lambda u: trim(regexp_replace(u, '[^a-z0-9]+', ' ', 'g'))) AS us FROM docs WHERE text IS NOT NULL),
units AS (SELECT rid, us, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM cut),
begun AS (SELECT rid, us, i, sum(strlen(u) + 1) OVER (PARTITION BY rid ORDER BY i) - strlen(u) AS pos, string_split(u, ' ')[1] AS head FROM units),
whole AS (SELECT rid, array_to_string(us, chr(10)) || chr(10) AS line FROM cut),
tried AS (SELECT b.rid, b.i, k.id, k.words, substr(w.line, b.pos::BIGINT, k.n + 1) AS said, k.s FROM begun b JOIN known k USING (head) JOIN whole w ON w.rid = b.rid WHERE b.head <> ''),
met AS (SELECT rid, i, id, words, i + len(string_split(said, chr(10))) - 1 AS stop FROM tried
  WHERE right(said, 1) = chr(10) AND strlen(said) = strlen(s) + 1 AND replace(left(said, -1), chr(10), ' ') = s),
lists AS (SELECT rid, list(struct_pack(i := i, stop := stop, id := id) ORDER BY i, words DESC) AS ms FROM met GROUP BY rid),
chosen AS (SELECT rid, list_reduce(ms, lambda a, m: CASE WHEN m.i >= a.stop THEN struct_pack(stop := m.stop, ids := a.ids || [m.id]) ELSE a END,
          struct_pack(stop := 0::BIGINT, ids := []::VARCHAR[])).ids AS ids FROM lists),
ruled AS (SELECT rid, ids, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS l0{steps} FROM chosen),
found AS (SELECT rid, ids, array_to_string(list_sort(list_distinct({hits})), ',') AS licences FROM ruled)
SELECT doc_id, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, coalesce(licences, '') AS licences, coalesce(len(ids), 0)::BIGINT AS n_sentences
FROM docs LEFT JOIN found USING (rid)"""
