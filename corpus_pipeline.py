"""The training-data pipeline: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import stages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", stages.keep_good),
    ("n-gram Jaccard join", stages.one_of_each_group),
    ("benchmark decontamination", stages.drop_contaminated),
    ("PII", stages.replace_private),
    ("BPE encoding and decoding", stages.encode),
]

#: no SQL trains a model or merges byte pairs: tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written as Parquet and read again."""
    return stages.run(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, STAGES)
