"""Layers of stored candles: raw records and processed bars, partitioned by series and time.

Paths are exchange=/market=/resolution=/year=/month= folders, so readers prune by series and month and then filter by
time. A processed day is replaced as a whole; raw records only grow.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import latest
from ..schema import PROCESSED, RAW

KEYS = ["exchange", "market", "resolution"]


def _stamped(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"year": F.year(ts), "month": F.month(ts), "date": F.to_date(ts)})


def store_processed(candles: DataFrame, path: str, format: str = "parquet") -> None:
    """Write bars (KEYS, timestamp, open to volume); a day that is there already is replaced."""
    out = _stamped(candles, "timestamp").select(*KEYS, "year", "month", "date", *[f.name for f in PROCESSED])
    out.repartition(*KEYS, "date").sortWithinPartitions("timestamp").write.partitionBy(*KEYS, "year", "month", "date").option("partitionOverwriteMode", "dynamic").mode("overwrite").format(format).save(path)


def upsert_processed(candles: DataFrame, path: str, arrival: str | None = None) -> None:
    """Merge bars into the days that they touch; of one time the last arrival stays, a new row before a stored one.

    A layer has one writer at a time: of two that merge into the same day, the last one's days stay.
    """
    spark = candles.sparkSession
    new = _stamped(candles, "timestamp").withColumn("_at", F.col(arrival) if arrival else F.lit(0)).withColumn("_new", F.lit(1))
    names = [f.name for f in PROCESSED]
    new = new.select(*KEYS, "date", *names, F.struct("_new", "_at").alias("_order"))
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = None
    if old is not None:
        kind = new.schema["_order"].dataType
        days = new.select(*KEYS, "date").distinct()
        held = old.join(days, [*KEYS, "date"], "left_semi")
        held = held.select(
            *KEYS, "date", *names, F.struct(F.lit(0).alias("_new"), F.lit(None).cast(kind["_at"].dataType).alias("_at")).alias("_order")
        )
        new = held.unionByName(new)
    merged = latest(new, [*KEYS, "timestamp"], "_order").drop("date", "_order")
    # a frame can't replace the files that it reads: the merged days lie beside the layer for a moment
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    merged.write.parquet(staging)
    try:
        store_processed(spark.read.schema(merged.schema).parquet(staging), path)
    finally:
        uri = spark._jvm.org.apache.hadoop.fs.Path(staging)
        uri.getFileSystem(spark._jsc.hadoopConfiguration()).delete(uri, True)


def store_raw(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Append raw records (timestamp as ISO text, market, resolution, exchange, raw_data) as JSON lines."""
    stamped = _stamped(records.withColumn("_t", F.to_timestamp("timestamp")), "_t").drop("_t", "date")
    stamped.write.partitionBy(*KEYS, "year", "month").option("compression", compression).mode("append").json(path)


def store_both(candles: DataFrame, raw_path: str, processed_path: str) -> None:
    """Both layers from one frame that is computed once."""
    candles = candles.persist()
    try:
        values = ["open", "high", "low", "close", "volume"]
        raw = candles.select(
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"),
            *KEYS,
            F.to_json(F.struct(*values)).alias("raw_data"),
            *values,
        )
        store_raw(raw, raw_path)
        store_processed(candles, processed_path)
    finally:
        candles.unpersist()


def _only(df: DataFrame, exchange: str | None, market: str | None, resolution: str | None) -> DataFrame:
    for name, value in zip(KEYS, (exchange, market, resolution), strict=True):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def load_processed(
    spark: SparkSession,
    path: str,
    start: datetime,
    end: datetime,
    exchange: str | None = None,
    market: str | None = None,
    resolution: str | None = None,
    whole_days: bool = True,
) -> DataFrame:
    """Bars from start to end: by days, or to the moment."""
    df = _only(spark.read.parquet(path), exchange, market, resolution).filter(F.col("date").between(start.date(), end.date()))
    return df if whole_days else df.filter(F.col("timestamp").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def load_raw(
    spark: SparkSession,
    path: str,
    start: datetime,
    end: datetime,
    exchange: str | None = None,
    market: str | None = None,
    resolution: str | None = None,
) -> DataFrame:
    """Raw records from start to end; each is read once."""
    schema = RAW
    df = _only(spark.read.schema(schema).option("recursiveFileLookup", "false").json(path), exchange, market, resolution)
    ts = F.to_timestamp("timestamp").cast("timestamp_ntz")
    return df.filter(ts.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def append_raw_live(candles: DataFrame, path: str) -> None:
    """Append live bars (KEYS, timestamp, open to volume) to the raw layer as they come; repeated times stay."""
    values = ["open", "high", "low", "close", "volume"]
    store_raw(
        candles.select(
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"),
            *KEYS,
            F.to_json(F.struct(*values)).alias("raw_data"),
            *values,
        ),
        path,
    )


def store_text(records: DataFrame, path: str, text: str = "text", ts: str = "timestamp") -> None:
    """Append text records (KEYS, a time and a text) to files by month, a line a record."""
    months = records.withColumns({"year": F.year(ts), "month": F.month(ts)}).select(
        *KEYS,
        "year",
        "month",
        F.to_json(F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"), F.col(text).alias("text"))).alias("value"),
    )
    months.write.partitionBy(*KEYS, "year", "month").mode("append").option("compression", "gzip").text(path)


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """KEYS, timestamp and text of the records of ``store_text``."""
    row = F.from_json("value", "timestamp string, text string")
    return spark.read.text(path).select(*KEYS, row["timestamp"].cast("timestamp_ntz").alias("timestamp"), row["text"].alias("text"))


def load_day_files(spark: SparkSession, path: str, layer: str = "processed") -> DataFrame:
    """Files as the file-per-day layout has them: CSV with a header, or JSON arrays (gzip by name)."""
    if layer == "processed":
        return (
            spark.read.schema(PROCESSED)
            .option("header", True)
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.csv*")
            .csv(path)
        )
    return (
        spark.read.schema(RAW)
        .option("multiLine", True)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.raw*")
        .json(path)
    )


def load(spark: SparkSession, path: str, layer: str, start: datetime, end: datetime, **series: str) -> DataFrame:
    return {"raw": load_raw, "processed": load_processed}[layer](spark, path, start, end, **series)


def load_market(spark: SparkSession, path: str, market: str, native: str, start: datetime, end: datetime, **series: str) -> DataFrame:
    """Bars under the exchange's own symbol, else under the given one; an error if there are none."""
    for name in (native, market):
        df = load_processed(spark, path, start, end, market=name, **series)
        if not df.isEmpty():
            return df
    raise ValueError(f"no bars of {market} from {start} to {end}")


def delete_before(spark: SparkSession, path: str, day: str) -> int:
    """Drop whole day folders before a day; the number of them."""
    old = spark.read.parquet(path).filter(F.col("date") < day).select(*KEYS, "year", "month", "date").distinct().collect()  # a row a folder
    for r in old:
        uri = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/" + "/".join(f"{k}={r[k]}" for k in [*KEYS, "year", "month", "date"]))
        uri.getFileSystem(spark._jsc.hadoopConfiguration()).delete(uri, True)
    return len(old)


def copy_layer(spark: SparkSession, source: str, target: str) -> None:
    """A backup of a processed layer."""
    spark.read.parquet(source).write.partitionBy(*KEYS, "year", "month", "date").mode("overwrite").parquet(target)


def save_result(metrics: DataFrame, path: str) -> None:
    """Figures as JSON lines, nested ones flattened a level."""
    flat = [
        F.col(f"{f.name}.{g.name}").alias(f"{f.name}.{g.name}") if hasattr(f.dataType, "fields") else F.col(f"`{f.name}`")
        for f in metrics.schema
        for g in (getattr(f.dataType, "fields", None) or [f])
    ]
    metrics.select(*flat).coalesce(1).write.mode("overwrite").json(path)


def save_backtest(spark: SparkSession, root: str, at: datetime, **frames: DataFrame) -> str:
    """Frames of a backtest (metrics, trades, equity or others) as JSON lines in a folder named by the time; its path."""
    folder = f"{root.rstrip('/')}/{at:%Y%m%d_%H%M%S}"
    for name, df in frames.items():
        save_result(df, f"{folder}/{name}")
    return folder


def save_search(found: DataFrame, best: DataFrame, path: str) -> None:
    """A search's figures and, beside them, each series' best parameters."""
    save_result(found, f"{path}/results")
    save_result(best, f"{path}/best")


def summary_text(row) -> str:
    """A line for each figure of one row."""
    return "\n".join(f"{k.replace('_', ' '):<28}{v:>16,.4f}" if isinstance(v, float) else f"{k.replace('_', ' '):<28}{v!s:>16}" for k, v in row.asDict().items())
