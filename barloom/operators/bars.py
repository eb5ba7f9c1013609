"""Bars from ticks and from other bars; spines; integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as S

BY = S.BY
_UNITS = {"min": 60, "h": 3600, "D": 86400}


def bucket(ts: str | Column, rule: str) -> Column:
    """Begin of the bucket of a rule "Nmin", "Nh", "ND" or "NW"; weeks are labelled by the Sunday that closes them.

    Buckets are counted from 1970, so those that divide a day begin at midnight.
    """
    ts = S.col(ts)
    n, unit = int(rule.rstrip("minhDW")), rule.lstrip("0123456789")
    if unit == "W":
        day = F.date_sub(F.next_day(F.to_date(ts), "MON"), 1)
        return day.cast("timestamp_ntz")
    step = n * _UNITS[unit]
    if step == 86400:
        return F.date_trunc("day", ts).cast("timestamp_ntz")
    return F.window(ts, f"{step} seconds")["start"].cast("timestamp_ntz")


def from_ticks(ticks: DataFrame, rule: str, price: str = "price", size: str = "size", tie: str | None = None, by=BY) -> DataFrame:
    """Bars of ticks; ticks of one time are ordered by ``tie``."""
    at = F.struct("ts", tie) if tie else F.col("ts")
    out = ticks.groupBy(*by, bucket("ts", rule).alias("_ts")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(size).cast("double").alias("volume")
    )
    return out.withColumnRenamed("_ts", "ts")


def resample(bars: DataFrame, rule: str, by=BY) -> DataFrame:
    """Longer bars from shorter ones."""
    out = bars.groupBy(*by, bucket("ts", rule).alias("_ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return out.withColumnRenamed("_ts", "ts")


def spine(bars: DataFrame, step: str, by=BY) -> DataFrame:
    """bars with the empty buckets between a series' first and last: no prices, volume 0. step is an interval."""
    ends = bars.groupBy(*by).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    every = ends.select(*by, F.explode(F.expr(f"sequence(_a, _b, interval {step})")).alias("ts"))
    out = every.join(bars, [*by, "ts"], "left")
    return out.withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def filled(bars: DataFrame, by=BY) -> DataFrame:
    """Prices of empty buckets taken from the bar before."""
    return bars.withColumn("close", S.padded("close", by)).withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")})


def integrity(bars: DataFrame, minutes: int, by=BY) -> DataFrame:
    """Per series: rows, rows that repeat a time, rows with a null, and the rows its span should have."""
    span = (F.max(S.micros(F.col("ts"))) - F.min(S.micros(F.col("ts")))) / (minutes * 60_000_000)
    missing = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull() | F.col("volume").isNull()
    return bars.groupBy(*by).agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct("ts")).alias("n_duplicates"), F.sum(missing.cast("long")).alias("n_nulls"), (F.floor(span) + 1).cast("long").alias("n_expected")
    )


def reconcile(raw: DataFrame, processed: DataFrame, by=BY) -> DataFrame:
    """Per series the rows of both layers and whether they are as many."""
    a, b = raw.groupBy(*by).agg(F.count("*").alias("n_raw")), processed.groupBy(*by).agg(F.count("*").alias("n_processed"))
    out = a.join(b, list(by), "full").fillna(0, ["n_raw", "n_processed"])
    return out.withColumn("matches", F.col("n_raw") == F.col("n_processed"))


def latest(rows: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The last arrival of each key."""
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), arrival).alias("_r"))
    return best.select(*key, "_r.*")


def valid(candles: DataFrame) -> Column:
    """Are all values there, and is the volume not negative?"""
    names = [c for c in ("ts", "timestamp", "open", "high", "low", "close", "volume") if c in candles.columns]
    out = F.col("volume") >= 0
    for c in names:
        out = out & F.col(c).isNotNull()
    return F.coalesce(out, F.lit(False))


def quarantined(candles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows."""
    ok = valid(candles)
    return candles.filter(ok), candles.filter(~ok)


def as_of(left: DataFrame, right: DataFrame, time: str, value: str, name: str, by=BY) -> DataFrame:
    """left (with ``ts``) and the first value of right at or after it, in one sort and no range join."""
    a = left.withColumn("_side", F.lit(0)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, F.col(time).alias("ts"), F.lit(1).alias("_side"), F.col(value).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("ts", "_side").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn(name, F.first("_v", ignorenulls=True).over(w)).filter("_side = 0").drop("_side", "_v")
