"""The corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All stages but the last return the
columns of documents; ``n_chars`` follows the text where a stage changes it.

As a stage's docs have been written, it first deletes the intermediate tables that the
stage before it left in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.llm import minhash, packing, pii, quality, suffix
from ripplemark.plans.shared import drop_scope, drop_table, scope, write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(function: Stage) -> Stage:
    """Runs a stage in a scope of its own, once the tables of the one before are gone."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scope(spark, "corpus-pipeline")
        with scope("corpus-pipeline"):
            return function(spark, docs, sf_dir)

    return run_stage


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, where there is such a column, counted anew."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or stand on a rejected host, go."""
    return quality.filter_documents(docs)


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.filter_documents(docs, width=5)


@_stage
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes go that a smaller id has in a string of 50."""
    return _counted(suffix.remove_repeats(docs))


@_stage
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are generalised or removed."""
    return _counted(pii.sanitise(docs))


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in bins of the permitted lengths."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Several stages aren't expressible in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_table(before)
        before = docs
    drop_scope(spark, "corpus-pipeline")
    return docs
