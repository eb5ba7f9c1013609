"""Frames derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators.performance import returns


def ticks_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("market"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), "event_id")


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_ticks(ticks_events(spark, sf_dir), "60min", tie="event_id")


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ticks = o.select(
        F.col("o_orderpriority").alias("market"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("size"),
        "o_orderkey",
    )
    return B.from_ticks(ticks, "1D", tie="o_orderkey")


def returns_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(bars_1d(spark, sf_dir))
