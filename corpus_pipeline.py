"""From documents to packed training sequences: quality rules, language ID, near duplicates, mixing, packing.

Each stage takes what the one before kept; all but the last return the columns of documents. Stages name rows by id and a hash
of the text, so repeated ids are told apart; null ids and texts, empty tables and further columns pass as each operator says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkwarden.llm import jaccard, langid, mixing, packing, rules
from sparkwarden.llm.common import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the latest policy of the rule ledger keeps."""
    return rules.select(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language is found."""
    return langid.select(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least doc_id."""
    return jaccard.select(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.select(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]
#: The stages need Python on the way; tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again, so that none is computed twice."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, scratch.stage(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            scratch.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
