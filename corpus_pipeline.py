"""The corpus pipeline: quality rules, quality classifier, near-dedup, packing. Part of the subpackage lattica.llm.

Each stage works on all that the one before it kept. All but the last return the columns of documents, so that any of
them can be read again in place of documents; the last returns the packed pieces.

Defined results: null and empty texts fail the base rules and go; rows that repeat are near-duplicates of each other, and
one stays; a null doc_id is kept like any other; columns beyond those of documents are handed on as they are; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import checkpoint_dir, table
from lattica.llm.near_dedup import keep_one_per_class
from lattica.llm.packing import pack_documents
from lattica.llm.quality_classifier import keep_by_classifier
from lattica.llm.quality_rules import keep_by_rules

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees and the base rules keep."""
    return keep_by_rules(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers, fitted on all documents, score 0.5 or more."""
    return keep_by_classifier(docs, table(spark, sf_dir, "labels"), fit_on=table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates."""
    return keep_one_per_class(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, packed into sequences of 4096 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("near-dedup", near_dedup), ("packing", packing)]

#: SQL can't express fitted trees, co-training, dart signatures or the packing search; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again by the next."""
    import uuid

    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
