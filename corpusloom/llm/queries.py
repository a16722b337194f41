"""The queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import langid, mixing, packing, quantised, radix, secret_scan, sharding, simhash, toxicity, urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of byte-identical texts."""
    return radix.exact_groups(_read(spark, sf_dir, "documents"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near copies."""
    return simhash.near_groups(_read(spark, sf_dir, "documents"))


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity margin and verdict, by a classifier fitted on this table's labels."""
    return toxicity.judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language, by a network fitted on this table's ``lang``."""
    return langid.identified(_read(spark, sf_dir, "documents"))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is used for each of its collections, at tempered weights."""
    return mixing.assigned(_read(spark, sf_dir, "documents"))


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training sequence of every document."""
    return packing.packed(_read(spark, sf_dir, "documents"), mixing.token_count())


def secrets_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in the documents, in whatever encoding."""
    return secret_scan.secret_spans(_read(spark, sf_dir, "documents"))


def near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its group of near copies."""
    return quantised.near_groups(_read(spark, sf_dir, "embeddings"))


def uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, shuffled into shards of equal size."""
    return sharding.sharded(_read(spark, sf_dir, "documents"))


def filtered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the rule that decides on its URL."""
    return urls.filtered(_read(spark, sf_dir, "pages"), urls.rule_table(spark))


QUERIES = {
    "op10_language_id": language_id,
    "op1_toxicity": toxic_documents,
    "op2_mixing": mixture,
    "op3_packing": packed_sequences,
    "op4_secret_scan": secrets_found,
    "op5_embedding_near_dedup": near_embeddings,
    "op6_sharding": uniform_shards,
    "op7_simhash_near_dedup": simhash_near_dedup,
    "op8_exact_dedup": exact_dedup,
    "op9_url_filter": filtered_urls,
}

ORACLE_SQL = {
    "op9_url_filter": urls.oracle(),
    "op8_exact_dedup": """
        SELECT doc_id, min(doc_id) OVER same AS group_id, count(*) OVER same AS copies,
               doc_id = min(doc_id) OVER same AS keep
        FROM documents WINDOW same AS (PARTITION BY text)""",
}
