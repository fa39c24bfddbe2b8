"""A training corpus from raw documents: quality, near-duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import mixing, neardup, quality, unigram
from tidewatch.llm.common import materialise, table

#: Percent of Jaccard similarity from which documents are near copies; op3_neardup alone has 85 by contract.
SIMILAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity is beyond their language's threshold; null and empty texts stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, linked at similarity SIMILAR or more; texts without words all stay."""
    return neardup.keep_representatives(docs, SIMILAR)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix draws, in training order; a document without words is drawn like its source's others."""
    return mixing.mix_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each row; a null doc_id stays null."""
    return unigram.encode(docs, os.environ.get("SENTENCEPIECE_MODEL") or unigram.default_model())


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", neardup_stage),
    ("mixing to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: A trained language model and Viterbi segmentation are not expressible in SQL; tests/llm compares
#: every stage with a brute-force version (the mix with its own SQL) and runs odd rows through all.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
