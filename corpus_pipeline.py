"""From raw documents to token ids: five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortcheck.llm import bpe, mixing, neardup, quality, rules
from cohortcheck.llm.common import importable, read_table, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds good, with sites for which ``source`` and ``lang`` stand."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def keep_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, from hosts that pass the shrunken ones."""
    return rules.keep_good(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return neardup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target weights of sources, languages and topics."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what is left."""
    return bpe.round_trip(docs, bpe.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("quality_rules", keep_rules),
    ("near_duplicates", keep_distinct),
    ("mixing", mix),
    ("bpe", encode),
]

# Raking and the classifier are iterative, near duplicates need components, ids need merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; an empty table gives an empty result of the same columns."""
    importable(spark)
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
