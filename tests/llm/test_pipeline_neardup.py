"""The pipeline's near-duplicate stage by brute force at its own similarity, 0.80."""

from __future__ import annotations

import random

import corpus_pipeline

from .test_neardup import groups


def pairs_near_the_threshold():
    """Pairs of 204 words whose last m words differ: similarity (200 - m) / (200 + m), from 0.79 to 0.86."""
    rng = random.Random(3)
    rows = []
    for m in (15, 17, 19, 21, 22, 23):
        for _ in range(4):
            words = [f"w{rng.randrange(10**9)}" for _ in range(204)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-m] + [f"x{rng.randrange(10**9)}" for _ in range(m)]))]
    return rows


def test_stage_links_from_080_on(spark, docs, data):
    rows = pairs_near_the_threshold()
    want = sorted(d for d, _, _, k in groups(rows, 80) if k)
    assert len(rows) - len(want) == 20 and sum(k for *_, k in groups(rows, 85)) == len(want) + 16
    kept = corpus_pipeline.neardup_stage(spark, docs(rows), data)
    assert sorted(r.doc_id for r in kept.collect()) == want
