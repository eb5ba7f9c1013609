"""Stages of the pipeline: (spark, docs, sf_dir) -> documents that go on, with the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, ngram_join, quality, surrogates
from ._store import Scratch, free_name


def run(spark: SparkSession, docs: DataFrame, sf_dir: str, stages: list) -> DataFrame:
    """The stages in turn; a stage's own tables go as soon as its result is written."""
    scratch = Scratch(spark, "pipeline")
    for name, stage in stages:
        before, known = docs, len(Scratch.opened)
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(before)
        for inner in Scratch.opened[known:]:
            inner.clear()
    return docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, doesn't reject.

    The score goes by names that the documents don't have, so columns named score or predicted keep their values.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, Scratch(spark, "quality"))
    names = free_name("score", docs.columns), free_name("predicted", docs.columns)
    return quality.score(docs, model, names=names).filter(F.col(names[1]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest doc_id.

    Documents without words have no links and stay, as do rows with a null doc_id; rows that share a doc_id go or
    stay together, each by any of their texts that must go.
    """
    groups = ngram_join.ngram_components(docs, Scratch(spark, "groups"))
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate: no hit, or fewer than one word in twenty."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(docs, items, Scratch(spark, "clean"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data, and n_chars of the new text; all other columns stay."""
    out = surrogates.replace_entities(
        docs, Scratch(spark, "surrogates"), surrogates.key_of(spark), count=free_name("n_entities", docs.columns)
    )
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digests of ids and decoded text."""
    return bpe.encode_documents(docs, ids=True)
