"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fim, fixity, hnsw, licences, mixing, neardup, packing, quality, sharding, tokens, topk, treap, unigram
from .common import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.feistel_shards(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_and_check(table(spark, sf_dir, "documents"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit_pages(table(spark, sf_dir, "pages"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents")).drop("matches")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = tokens.write_tokens(table(spark, sf_dir, "documents"), tokens.default_tokenizer())
    return tokens.token_digests(shards)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.search_index(treap.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokens.default_tokenizer()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": op1_topk,
        "op2_quality": op2_quality,
        "op3_neardup": op3_neardup,
        "op4_sharding": op4_sharding,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_warc_fixity": op6_warc_fixity,
        "op7_neighbours": op7_neighbours,
        "op8_licences": op8_licences,
        "op9_token_file": op9_token_file,
        "op10_mixing": op10_mixing,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_ranked_search": op12_ranked_search,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": topk.oracle(),
        "op4_sharding": sharding.oracle(),
        "op6_warc_fixity": fixity.oracle(),
        "op8_licences": licences.oracle(),
        "op10_mixing": mixing.oracle(),
        "op11_fill_in_middle": fim.oracle(),
        "op12_ranked_search": treap.oracle(),
    }
