"""Queries that write the tables into a layer, a recorded exchange or a stream, and read them back."""

import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources import exchanges as X
from ..sources import shared
from ..sources import storage as S
from ..sources.bars import bars_1d, ticks_events
from ..streaming import live as L
from . import query, rounded
from . import sql as Q

FROM, TO, EVER = dt.datetime(1996, 1, 1), dt.datetime(1999, 6, 30), (dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1))
MONTHS = f"""{Q.BARS_1D}, k AS (SELECT *, date_trunc('month', ts)::TIMESTAMP AS month FROM b),
    wk AS (SELECT market, month AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
      sum(volume) AS volume FROM k GROUP BY market, month)"""
_BAR = ["market", "timestamp", "open", "high", "low", "close", "volume"]
_IN = "ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1999-06-30'"


def _months(spark, sf):
    rows = bars_1d(spark, sf).groupBy("market", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("timestamp")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return rows.withColumns({"exchange": F.lit("drift"), "resolution": F.lit("1M")})


@query(f"WITH {MONTHS} SELECT market, ts AS timestamp, open, high, low, close, volume FROM wk WHERE {_IN}")
def processed_layer(spark, sf):
    path = shared.folder(spark, "processed")
    S.store_processed(_months(spark, sf), path)
    return S.load(spark, path, "processed", FROM, TO, exchange="drift", resolution="1M").select(*_BAR)


@query(f"WITH {MONTHS} SELECT market, ts AS timestamp, open, high, low, close, volume FROM wk WHERE {_IN}")
def raw_layer(spark, sf):
    path = shared.folder(spark, "raw")
    S.append_raw_live(_months(spark, sf), path)
    rows = S.load(spark, path, "raw", FROM, TO, exchange="drift")
    parsed = F.from_json("raw_data", "open double, high double, low double, close double, volume double")
    return rows.select("market", F.to_timestamp("timestamp").cast("timestamp_ntz").alias("timestamp"), parsed.alias("r")).select(
        "market", "timestamp", "r.*"
    )


@query(f"WITH {MONTHS} SELECT market, ts AS timestamp, open, high, low, CASE WHEN month(ts) % 2 = 0 THEN close ELSE -1 END AS close, volume FROM wk")
def upserted_layer(spark, sf):
    """Bars without a close are stored; the true ones of even months replace theirs."""
    path, rows = shared.folder(spark, "upserted"), _months(spark, sf)
    S.upsert_processed(rows.withColumn("close", F.lit(-1.0)), path)
    S.upsert_processed(rows.filter(F.month("timestamp") % 2 == 0), path)
    return spark.read.parquet(path).select(*_BAR)


@query(f"WITH {MONTHS} SELECT market, count(*) AS n_raw, count(*) AS n_processed, true AS matches FROM wk GROUP BY market")
def dual_write(spark, sf):
    raw, done = shared.folder(spark, "both"), shared.folder(spark, "both")
    S.store_both(_months(spark, sf), raw, done)
    return B.reconcile(S.load(spark, raw, "raw", *EVER), S.load(spark, done, "processed", *EVER))


@query(f"""
    WITH {MONTHS},
    z AS (SELECT market, count(*) AS n_backup, count(*) FILTER (ts >= TIMESTAMP '1997-01-01') AS n_kept FROM wk GROUP BY market)
    SELECT * FROM z
""")
def backup_and_prune(spark, sf):
    path, copy = shared.folder(spark, "pruned"), shared.folder(spark, "copy")
    S.store_processed(_months(spark, sf), path)
    S.copy_layer(spark, path, copy)
    S.delete_before(spark, path, "1997-01-01")
    count = lambda p, name: spark.read.parquet(p).groupBy("market").agg(F.count("*").alias(name))
    return count(copy, "n_backup").join(count(path, "n_kept"), "market")


@query(f"WITH {MONTHS} SELECT market, ts AS timestamp, concat('close ', market, ' ', strftime(ts, '%Y-%m-%d')) AS text FROM wk")
def text_records(spark, sf):
    path = shared.folder(spark, "text")
    rows = _months(spark, sf)
    S.store_text(rows.withColumn("text", F.concat(F.lit("close "), "market", F.lit(" "), F.date_format("timestamp", "yyyy-MM-dd"))), path)
    return S.load_text(spark, path).select("market", "timestamp", "text")


START, END = int(dt.datetime(1992, 1, 1, tzinfo=dt.UTC).timestamp()), int(dt.datetime(2009, 12, 31, tzinfo=dt.UTC).timestamp())


def _payload(exchange: str, rows: pd.DataFrame) -> str:
    """A page of bars as the exchange writes it."""
    if exchange == "drift":
        return "start,fillOpen,fillHigh,fillLow,fillClose,baseVolume\n" + "".join(
            f"{r.s * 1000},{r.open!r},{r.high!r},{r.low!r},{r.close!r},{r.volume!r}\n" for r in rows.itertuples()
        )
    listed = [
        [r.s * (1 if exchange == "coinbase" else 1000), *(str(x) for x in (r.open, r.high, r.low, r.close, r.volume))]
        for r in rows.itertuples()
    ]
    return json.dumps({"data": listed} if exchange == "bitget" else {"candles": listed} if exchange == "coinbase" else listed)


def _replayed(spark, sf, exchange):
    """Daily bars recorded as an exchange's pages, a task a page, and read through the source."""
    folder = shared.folder(spark, exchange)
    bars = bars_1d(spark, sf).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    if exchange == "drift":
        first = F.greatest(F.unix_seconds(F.date_trunc("year", F.col("ts").cast("timestamp"))), F.lit(START))
    else:
        step = X.MINUTES["1D"] * 60 * X.PAGE[exchange]
        first = START + F.floor((F.col("s") - START) / step) * step
    kind = "csv" if exchange == "drift" else "json"

    def record(page: pd.DataFrame) -> pd.DataFrame:
        shared.write_text(f"{folder}/{page.market[0]}-{page['first'][0]}.{kind}", _payload(exchange, page.sort_values("s")))
        return page[["market"]].head(1)

    pages = bars.withColumn("first", first.cast("long")).groupBy("market", "first").applyInPandas(record, "market string")
    markets = [r.market for r in pages.distinct().collect()]  # a row a market
    spark.dataSource.register(X.ExchangeSource)
    options = {
        "exchange": exchange, "markets": ",".join(markets), "resolution": "1D", "start": str(START), "end": str(END), "replay": folder
    }
    rows = spark.read.format("exchange").options(**options).load()
    return rows.select("market", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "open", "high", "low", "close", "volume")


_ALL = f"WITH {Q.BARS_1D} SELECT market, ts AS timestamp, open, high, low, close, volume FROM b"


@query(_ALL)
def exchange_binance(spark, sf):
    return _replayed(spark, sf, "binance")


@query(_ALL)
def exchange_coinbase(spark, sf):
    return _replayed(spark, sf, "coinbase")


@query(_ALL)
def exchange_bitget(spark, sf):
    return _replayed(spark, sf, "bitget")


@query(_ALL)
def exchange_drift(spark, sf):
    return _replayed(spark, sf, "drift")


def _ticks(spark, sf):
    """The events as a stream; a last tick of another series moves the watermark past all of them."""
    path = shared.folder(spark, "ticks")
    rows = ticks_events(spark, sf).select("market", F.col("ts").cast("timestamp").alias("ts"), "price", "size")
    end = spark.createDataFrame([("~", dt.datetime(2200, 1, 1), 0.0, 0.0)], rows.schema)
    rows.write.parquet(path)
    end.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _drained(spark, stream):
    """What a stream appends until its input ends, without the last tick's series."""
    out, checkpoint = shared.folder(spark, "out"), shared.folder(spark, "checkpoint")
    q = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).filter("market <> '~'")


@query("""
    SELECT event_type AS market, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low,
      arg_max(value, (ts, value)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2
""")
def stream_bars(spark, sf):
    out = _drained(spark, L.bars(_ticks(spark, sf), "1 hour", "0 seconds"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
    WITH w AS (SELECT event_type AS market, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR])::TIMESTAMP AS start
      FROM events)
    SELECT market, start, start + INTERVAL 2 HOUR AS "end", count(*) AS n, CAST(count(*) AS DOUBLE) AS volume, round(avg(value), 7) AS mean_price
      FROM w GROUP BY market, start""")
def stream_sliding(spark, sf):
    out = _drained(spark, L.sliding(_ticks(spark, sf), "2 hours", "1 hour", "0 seconds"))
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}), digits=7)


@query("""
    WITH e AS (SELECT event_type AS market, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL '37 minutes' THEN 0
      ELSE 1 END AS c FROM events),
    g AS (SELECT *, sum(c) OVER (PARTITION BY market ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT market, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL '37 minutes')::TIMESTAMP AS "end", count(*) AS n,
      CAST(count(*) AS DOUBLE) AS volume FROM g GROUP BY market, g""")
def stream_sessions(spark, sf):
    out = _drained(spark, L.sessions(_ticks(spark, sf), "37 minutes", "0 seconds"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""
    WITH a AS (SELECT event_type AS market, ts, value FROM events WHERE event_id % 2 = 0),
    b AS (SELECT event_type AS market, ts, value FROM events WHERE event_id % 2 = 1)
    SELECT a.market, a.ts::TIMESTAMP AS ts, a.value AS price, b.ts::TIMESTAMP AS right_ts, b.value AS right_price FROM a
      JOIN b ON a.market = b.market AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE""")
def stream_joined(spark, sf):
    """Two streams, the events of even and of odd numbers."""
    sides = []
    for odd in (0, 1):
        path = shared.folder(spark, "side")
        rows = ticks_events(spark, sf).filter(F.col("event_id") % 2 == odd).select(
            "market", F.col("ts").cast("timestamp").alias("ts"), "price"
        )
        rows.write.parquet(path)
        sides.append(spark.readStream.schema(rows.schema).parquet(path))
    out = _drained(spark, L.joined(*sides, "30 minutes", "1 hour"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "right_ts")})


@query(f"WITH {MONTHS} SELECT market, ts AS timestamp, open, high, low, close, volume FROM wk")
def stream_stored(spark, sf):
    """Monthly bars as a stream, upserted into the processed layer and appended to the raw one."""
    path, done, raw = (shared.folder(spark, x) for x in ("candles", "live", "live-raw"))
    rows = _months(spark, sf)
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    L.store(stream, done, shared.folder(spark, "checkpoint"), once=True, raw=raw).awaitTermination()
    kept = S.load_raw(spark, raw, *EVER).select("market", F.to_timestamp("timestamp").cast("timestamp_ntz").alias("timestamp"))
    return spark.read.parquet(done).select(*_BAR).join(kept, ["market", "timestamp"], "left_semi")
