"""A cleaning pipeline over documents: each stage is written as Parquet and read again as the next one's input.

language: documents without a letter go, and those far less like their language than the labelled ones of their size.
near_duplicates: of each group of near copies the document of the least id stays.
decontamination: documents that hold ten words in a row of a benchmark item go.
secrets: secret spans are masked in the texts, and the recorded lengths follow.
tokens: what stays is encoded and decoded again; one row a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm import bpe_tree, decontaminate, language, near_dup, secrets
from pagewarden.llm.common import stored, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prototypes = language.learn(docs)
    return language.identified(docs, prototypes, language.floors(docs, prototypes))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    changed = F.when(F.col("text").contains(secrets.MASK), F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_tree.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near copies and byte-pair merges are beyond SQL.
ORACLE_SQL = None
