"""The corpus pipeline: documents of good quality, then those not toxic, then one of each group of near duplicates, then packed
into training sequences. Each stage works on all that the one before kept, written as Parquet and read again. Models learn from
the labelled documents among a stage's own input, within the operators' bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stripweave.llm import neardup, packing, quality, toxicity
from stripweave.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier of lines calls good. Null and empty texts, repeated rows and extra columns are as in ``quality.score_documents``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what its nearest labelled examples call clean. Odd rows are as in ``toxicity.score_documents``."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; the smallest id of each group stays. Odd rows are as in ``neardup.near_duplicates``."""
    return neardup.keep_one(docs, neardup.Rule(shingle=5, percent=80))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per training sequence, with its documents' ids and tokens. Odd rows are as in ``packing.pack_documents``."""
    docs = docs.select("doc_id", "text")
    return packing.sequences(docs, packing.pack_documents(docs))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: SQL can express neither the models nor best-fit packing; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
