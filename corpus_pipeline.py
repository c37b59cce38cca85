"""A training-data pipeline over ``documents``; each stage is one operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontamination, mixing, near_duplicates, quality, tokens
from codeloom.llm.queries import table, tokenizer_path
from codeloom.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_only(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_duplicates.without_near_duplicates(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go; a document of nothing else goes."""
    return decontamination.without_hits(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; rows may repeat."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, written and read back: one row for each row of ``docs``."""
    return tokens.read_ids(tokens.write_ids(docs, tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classified),
    ("near-duplicates", distinct),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("token ids", token_ids),
]

#: The classifier and the tokenizer can't be written in SQL; tests hold the
#: stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's result is stored and read by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
