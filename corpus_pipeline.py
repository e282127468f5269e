"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

The quality classifier drops poor documents; of near duplicates one stays; documents that hold benchmark
items go; personal data is replaced; what is left is tokenised and packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brook.llm import decontamination, jaccard_join, packing, pii, quality_classifier
from brook.llm._shared import kept
from brook.llm.queries import table, tokenizer_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on labelled rows of these documents; those that score below one half go."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), sample=8_000)
    return quality_classifier.keep_good(docs, model, threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, shingle=5, similarity=75)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaking(docs, table(spark, sf_dir, "benchmark"), edit_share=0.2, recall=0.98)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and their places in sequences of 1024."""
    return packing.pack(docs, *tokenizer_paths(), capacity=1024, end_id=2, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("packed", packed)]

#: The stages learn, hash and tokenise; SQL can't express them.  Their tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
