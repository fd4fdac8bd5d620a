"""Cleaning pipeline over ``documents``: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cordon.llm import decontaminate, jaccard_join, mixing, pii, toxicity
from cordon.llm.tables import dropped, read, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6: documents whose text the ordinal model grades toxic go."""
    return toxicity.not_toxic(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: of each group of near copies (five-word shingles, Jaccard 0.8) the least id stays."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 1: documents that leak a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 4: personal data is masked in the text; ``n_chars`` follows."""
    return pii.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5: every document as often as the mix takes it, numbered by ``copy``."""
    return mixing.mixed(docs)


STAGES = [("toxicity", not_toxic), ("near_copies", near_copies), ("decontamination", decontaminated), ("personal_data", masked), ("mixing", mixed)]

#: No SQL: two stages learn from the data and tiles have no relational form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage reads what the one before wrote to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        dropped(before)
    return docs
