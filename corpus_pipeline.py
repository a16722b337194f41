"""A corpus pipeline of the training-data operators. Stages read and write Parquet.

Every stage takes documents with nulls in any column, empty and very long texts, ties, repeated rows and further columns
under whatever names, and passes on all columns, the last one excepted; an empty table passes as an empty table. What
a stage decides in these cases is said at its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import mixing, packing, radix, simhash, toxicity
from corpusloom.llm.common import remove, scratch


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. Null and empty texts stay; repeated rows are decided alike; without labels of both classes all stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts stays: that of the least id, a null id first. Null texts all stay, empty ones are identical."""
    return radix.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id, a null id first. Null texts and texts without a word all stay."""
    return simhash.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their collections want them, zero times included; those with neither source nor language go."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence and place of every document, or piece of one; texts without a token are in none."""
    return packing.packed(docs, mixing.token_count())


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

#: Some stages fit models or follow a greedy order, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's rows written as Parquet and read again; a stage's rows are deleted when the next one's are written."""
    at = scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            remove(spark, before)
        before = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
