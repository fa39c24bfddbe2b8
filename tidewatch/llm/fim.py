"""Fill-in-middle transformation by repeated-capture matching.

A text is a sequence of units, runs of ASCII letters or single other code points. One fullmatch of
(unit)* by the regex library retains every repetition; the ends of group 1 give the number of units
and the offsets of both cuts. Where a document is cut, and into which form it goes, follows from a
hash of its doc_id, so that reruns agree. No row meets another: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of one fullmatch: the library takes some 110 bytes for each and fails beyond about 5 million. A
#: longer text is matched in several, cut between two units.
PIECE = 1 << 20
#: Characters of output put into one Arrow batch.
BATCH_CHARS = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_MATCH = None


def unit_ends(text: str, piece: int = PIECE) -> np.ndarray:
    """Where each unit of the text ends, in code points."""
    global _MATCH
    if _MATCH is None:
        import regex

        _MATCH = regex.compile(f"({UNIT})*"), regex.compile("[A-Za-z]*")
    units, letters = _MATCH
    if len(text) <= piece:
        return np.asarray(units.fullmatch(text).ends(1), np.int64)
    out, at = [], 0
    while at < len(text):
        stop = min(at + piece, len(text))
        stop = letters.match(text, stop).end()  # a run of letters is never split
        out.append(np.asarray(units.fullmatch(text, at, stop).ends(1), np.int64))
        at = stop
    return np.concatenate(out)


def transform(doc_id: int | None, text: str, plain: int = 90, spm: int = 20, seed: str = "1", piece: int = PIECE) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text (see fill_in_middle)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    ends = unit_ends(text, piece)
    n = len(ends)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= plain:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    parts = {PREFIX: text[:a], SUFFIX: text[b:], MIDDLE: text[a:b]}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if h4 % 100 < spm else ("psm", (PREFIX, SUFFIX, MIDDLE))
    return n, form, a, b - a, "".join(mark + parts[mark] for mark in order)


def fill_in_middle(docs: DataFrame, plain: int = 90, spm: int = 20, seed: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of docs (doc_id, text).

    h1 to h4 are the first four 8-digit groups of the hex sha256 of `seed:doc_id`. The prefix ends after
    the smaller of h1 % (n+1) and h2 % (n+1) units, the middle after the larger. A text that is
    empty or holds a marker, or whose h3 % 100 is `plain` or more, stays as it is ("plain", no
    lengths); of the others h4 % 100 < `spm` gives <S>suffix<P>prefix<M>middle, the rest
    <P>prefix<S>suffix<M>middle. A null text is empty; a null doc_id hashes as no digits;
    repeated rows each give the same row; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                made = transform(doc_id, text.as_py() or "", plain, spm, seed)
                rows.append((doc_id, *made))
                size += len(made[-1])
                if size >= BATCH_CHARS:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle rearranged. Its own text holds no marker, and none can arise where a part meets a marker,
    so each marker stands once."""
    last = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    head = F.split_part(output, F.lit(MIDDLE), F.lit(1))
    first = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    one, two = F.split_part(head, first, F.lit(1)).substr(F.lit(4), F.length(output)), F.split_part(head, first, F.lit(2))
    return F.when(form == "psm", F.concat(one, last, two)).when(form == "spm", F.concat(two, last, one)).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """fill_in_middle's rows with hashes in place of the output: its own and that of the text rebuilt from it."""
    hashes = [F.sha2(text.cast("binary"), 256).alias(f"{name}_sha256") for name, text in (("output", F.col("output")), ("restored", restored(F.col("output"), F.col("form"))))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def oracle() -> str:
    """The digests in DuckDB SQL, with the contract's parameters."""
    return rf"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM hashed),
placed AS (
  SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                        ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""
