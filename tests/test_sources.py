"""Storage layers, exchange payloads and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barloom.functions import symbols as Y
from barloom.operators import bars as B
from barloom.sources import exchanges as X
from barloom.sources import storage as S
from barloom.streaming import live as L

DAY = dt.datetime(2023, 1, 1)
CANDLES = "exchange string, market string, resolution string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double"


def candles(spark, n=10, close=102.0):
    rows = [
        ("drift", "BTC-PERP", "15", DAY + dt.timedelta(minutes=15 * i), 100.0 + i, 105.0 + i, 95.0 + i, close + i, 1000.0 + 100 * i)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, CANDLES)


def test_both_layers_and_reconciliation(spark, tmp_path):
    df = candles(spark)
    S.store_both(df, f"{tmp_path}/raw", f"{tmp_path}/processed")
    end = DAY + dt.timedelta(days=1)
    raw = S.load(spark, f"{tmp_path}/raw", "raw", DAY, end, market="BTC-PERP")
    done = S.load(spark, f"{tmp_path}/processed", "processed", DAY, end, exchange="drift")
    assert raw.count() == done.count() == 10
    assert B.reconcile(raw, done).first().matches
    assert done.agg(F.max("close")).first()[0] == 111.0
    assert S.load_processed(spark, f"{tmp_path}/processed", DAY, DAY + dt.timedelta(minutes=30), whole_days=False).count() == 3
    S.store_processed(candles(spark, 4), f"{tmp_path}/processed")  # the day is replaced
    assert spark.read.parquet(f"{tmp_path}/processed").count() == 4


def test_upsert_keeps_the_last(spark, tmp_path):
    S.upsert_processed(candles(spark, 3), f"{tmp_path}/p")
    S.upsert_processed(candles(spark, 2, close=7.0), f"{tmp_path}/p")
    rows = spark.read.parquet(f"{tmp_path}/p").orderBy("timestamp").collect()
    assert [r.close for r in rows] == [7.0, 8.0, 104.0]


def test_fallback_symbol_and_deletion(spark, tmp_path):
    S.store_processed(candles(spark), f"{tmp_path}/p")
    end = DAY + dt.timedelta(days=1)
    assert S.load_market(spark, f"{tmp_path}/p", "BTC-PERP", "BTCUSDT_PERP", DAY, end).count() == 10
    with pytest.raises(ValueError):
        S.load_market(spark, f"{tmp_path}/p", "X", "Y", DAY, end)
    S.copy_layer(spark, f"{tmp_path}/p", f"{tmp_path}/backup")
    assert S.delete_before(spark, f"{tmp_path}/p", "2023-01-02") == 1
    assert spark.read.parquet(f"{tmp_path}/backup").count() == 10


def test_day_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "2023-01-01.csv").write_text("timestamp,open,high,low,close,volume\n2023-01-01 00:00:00,1,2,0.5,1.5,10\n")
    assert S.load_day_files(spark, str(tmp_path)).first().close == 1.5
    (tmp_path / "a" / "2023-01-01.raw").write_text(
        json.dumps([{"timestamp": "2023-01-01T00:00:00", "market": "M", "resolution": "1", "exchange": "e", "raw_data": "[1]"}])
    )
    assert S.load_day_files(spark, str(tmp_path), "raw").first().market == "M"


def test_result_file(spark, tmp_path):
    df = spark.sql("select 'm' market, struct(1.5D as sharpe, 2L as n) m")
    S.save_result(df, f"{tmp_path}/r")
    assert json.loads(next((tmp_path / "r").glob("*.json")).read_text()) == {"market": "m", "m.sharpe": 1.5, "m.n": 2}
    assert "sharpe" in S.summary_text(spark.sql("select 1.5D sharpe").first())


def test_payloads():
    k = json.dumps([[1672531200000, "1.0", "2.0", "0.5", "1.5", "10", 1672534799999, "15", 3, "5", "7", "0"]])
    assert next(X.parse_binance(k, "BTCUSDT", "60"))[:6] == (DAY, 1.0, 2.0, 0.5, 1.5, 10.0)
    c = json.dumps([[1672534800, 2, 3, 1, 2, 5], [1672531200, 1, 2, 0.5, 1.5, 10]])
    assert [r[1] for r in X.parse_coinbase(c, "BTC-USD", "60")] == [1.0, 2.0]
    c = json.dumps({"candles": [{"start": "1672531200", "open": "1", "high": "2", "low": "0.5", "close": "1.5", "volume": "10"}]})
    assert next(X.parse_coinbase(c, "BTC-USD", "60"))[4] == 1.5
    assert next(X.parse_bitget(json.dumps({"data": [["1672531200000", "1", "2", "0.5", "1.5", "10"]]}), "BTCUSDT", "60"))[0] == DAY
    d = "start,open,fillOpen,high,low,close,volume\n1672531200000,9,1,2,0.5,1.5,10\n"
    assert next(X.parse_drift(d, "SOL-PERP", "60"))[1:6] == (1.0, 2.0, 0.5, 1.5, 10.0)
    with pytest.raises(X.ExchangeError):
        next(X.parse_bitget(json.dumps([["1672531200000", "1", "2", "0.5", "1.5", "-1"]]), "M", "60"))
    t = X.parse_ticker(json.dumps({"price": "5", "size": "2", "time": "2023-01-01T00:00:00Z"}), "BTC-USD", "1", 0)
    assert t[:6] == (DAY, 5.0, 5.0, 5.0, 5.0, 2.0)
    info = json.dumps(
        {
            "symbols": [
                {"baseAsset": "BTC", "quoteAsset": "USDT", "status": "TRADING"}, {"baseAsset": "X", "quoteAsset": "Y", "status": "BREAK"}
            ]
        }
    )
    assert X.market_info("binance", info) == [("BTC-USDT", "BTC", "USDT")]


def test_pages_cover_the_range():
    p = X.pages("coinbase", ["BTC-USD"], "60", 0, 300 * 3600 * 2 + 5)
    assert [x.first for x in p] == [0, 300 * 3600, 600 * 3600] and p[-1].last == 300 * 3600 * 2 + 5
    assert len(X.pages("drift", ["SOL-PERP"], "60", 1640995200, 1704067200)) == 3
    assert all(X.url(x).startswith("https://") for x in p)


def test_exchange_source(spark, tmp_path):
    rows = [[1672531200000 + 3_600_000 * i, "1", "2", "0.5", str(i), "10"] for i in range(3)]
    (tmp_path / "BTCUSDT-1672531200.json").write_text(json.dumps([*rows, rows[0]]))
    spark.dataSource.register(X.ExchangeSource)
    options = {
        "exchange": "binance", "markets": "BTCUSDT", "resolution": "60", "start": "1672531200", "end": "1672538400", "replay": str(tmp_path)
    }
    df = spark.read.format("exchange").options(**options).load()
    assert sorted(r.close for r in df.collect()) == [0.0, 1.0, 2.0]
    q = (
        spark.readStream.format("exchange")
        .options(**options)
        .load().writeStream.format("memory")
        .queryName("live")
        .option("checkpointLocation", f"{tmp_path}/c")
        .start()
    )
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    ticks = spark.createDataFrame(
        [("m", DAY + dt.timedelta(seconds=37 * i), float((i * 7919) % 101), 1.0) for i in range(400)],
        "market string, ts timestamp, price double, size double",
    )
    ticks.repartition(3).write.parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/t")
    q = L.bars(stream, "10 minutes", "0 seconds").writeStream.format("memory").queryName("bars").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = {
        (r.ts, r.open, r.high, r.low, r.close, r.volume)
        for r in B.from_ticks(ticks.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "10min").collect()
    }
    found = {(r.ts, r.open, r.high, r.low, r.close, r.volume) for r in spark.table("bars").collect()}
    assert found and found <= batch and len(found) >= len(batch) - 2


def joined(spark, folder, lefts, rights, within, files=1, seconds=120):
    """The streams' joined rows; the query must end in time."""
    sides = []
    for name, df in (("left", lefts), ("right", rights)):
        df.repartition(files).write.parquet(f"{folder}/{name}")
        sides.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}"))
    q = (
        L.joined(*sides, within, "3000 days").writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/c")
        .trigger(availableNow=True)
        .start()
    )
    try:
        assert q.awaitTermination(seconds)
    finally:
        q.stop()
    return spark.read.parquet(f"{folder}/out").select("market", "ts", "price", "right_ts", "right_price")


@pytest.mark.parametrize("within", ["30 minutes", "0 seconds", "1 day", "1 month", "-30 minutes"])
def test_joined_streams(spark, tmp_path, within):
    """Ticks on the edges of the reach, and alike ones, in several batches."""
    at = [dt.datetime(2022, 2, 1), DAY, dt.datetime(2023, 1, 31)]
    off = [-86400, -1801, -1800, -1, 0, 0, 1, 1799, 1800, 1801, 3600, 86400, 31 * 86400]
    rows = [(m, t + dt.timedelta(seconds=s), float(i)) for m in "ab" for t in at for i, s in enumerate(off)] + [("a", None, 0.0)]
    df = spark.createDataFrame(rows, "market string, ts timestamp, price double")
    got = joined(spark, tmp_path, df.filter("price % 2 = 0"), df, within, files=3)
    df.createOrReplaceTempView("ticks_joined")
    right = spark.sql(f"""SELECT a.market, a.ts, a.price, b.ts right_ts, b.price right_price FROM ticks_joined a JOIN ticks_joined b
        ON a.market = b.market AND b.ts BETWEEN a.ts AND a.ts + INTERVAL {within} WHERE a.price % 2 = 0""")
    assert got.exceptAll(right).count() == right.exceptAll(got).count() == 0
    assert (right.count() > 0) == (within[0] != "-")


def test_joined_ticks_do_not_meet_a_whole_series(spark, tmp_path):
    """In a long series of few partners time goes with the pairs, not with the square of the series."""
    df = spark.range(60_000).select(F.lit("m").alias("market"), F.timestamp_seconds((F.col("id") + 1) * 60).alias("ts"), F.col("id").cast("double").alias("price"))
    got = joined(spark, tmp_path, df.filter("price % 2 = 0"), df, "1 minute")
    assert got.count() == 60_000 and got.filter("right_price - price > 1").isEmpty()


def test_live_store(spark, tmp_path):
    candles(spark, 5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(candles(spark).schema).parquet(f"{tmp_path}/in")
    L.store(stream, f"{tmp_path}/p", f"{tmp_path}/c", once=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/p").count() == 5


def test_quarantine_and_spine(spark):
    df = spark.createDataFrame(
        [
            ("m", DAY, 1.0, 1.0, 1.0, 1.0, 1.0),
            ("m", DAY + dt.timedelta(hours=3), 1.0, None, 1.0, 2.0, 1.0),
            ("m", DAY, 1.0, 1.0, 1.0, 1.0, -1.0),
        ],
        "market string, ts timestamp_ntz, open double, high double, low double, close double, volume double",
    )
    good, bad = B.quarantined(df)
    assert (good.count(), bad.count()) == (1, 2)
    rows = B.filled(B.spine(df.filter("volume > 0"), "1 hour")).orderBy("ts").collect()
    assert [r.close for r in rows] == [1.0, 1.0, 1.0, 2.0] and [r.volume for r in rows] == [1.0, 0.0, 0.0, 1.0]


def test_listing(spark):
    df = spark.createDataFrame([(f"S{i:02d}",) for i in range(7)], "s string")
    assert [r.s for r in Y.page(df, "s", 9, 3).collect()] == ["S06"]
    mapped = Y.symbol_map(spark, {"binance": ["BTCUSDT"], "coinbase": ["BTC-USDT"]})
    assert Y.supported_symbols(mapped).count() == 2
    assert Y.valid_markets(spark.createDataFrame([("BTCUSDT",), ("ZZZ",)], "symbol string"), mapped).count() == 1
    assert spark.range(1).select(Y.interval("binance", F.lit("60"))).first()[0] == "1h"


def test_incremental_indicators(spark, tmp_path):
    from barloom.functions import recurrences as R

    rows = [
        ("m", DAY + dt.timedelta(minutes=i), 102.0 + (i * 7919) % 13, 98.0 - (i * 31) % 7, 100.0 + (i * 104729) % 9 - 4) for i in range(30)
    ]
    df = spark.createDataFrame(rows, "market string, ts timestamp, high double, low double, close double")
    df.coalesce(1).write.parquet(f"{tmp_path}/t")
    for kernel in L.KERNELS:
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/t")
        q = (
            L.incremental(stream, kernel, 5).writeStream.format("memory")
            .queryName(f"i_{kernel}")
            .outputMode("append")
            .option("checkpointLocation", f"{tmp_path}/{kernel}")
            .start()
        )
        q.processAllAvailable()
        q.stop()
        got = {r.ts: r.value for r in spark.table(f"i_{kernel}").collect()}
        assert len(got) == 30 and got[rows[0][1]] is None and got[rows[-1][1]] is not None
    import numpy as np

    close = np.array([r[4] for r in rows])
    assert {r.ts: r.value for r in spark.table("i_rsi").collect()}[rows[9][1]] == pytest.approx(R.rsi(close[:10], 5)[-1])


def test_settings(tmp_path):
    from barloom import settings

    (tmp_path / "s.json").write_text('{"indicators": {"rsi": {"period": 7}}}')
    s = settings.load(str(tmp_path / "s.json"), {"BARLOOM_INDICATORS__RSI__OVERSOLD": "25", "OTHER": "1"})
    assert (s.get("indicators", "rsi", "period"), s.get("indicators", "rsi", "oversold"), s.get("indicators", "rsi", "overbought"), s.get("x", "y", default=3)) == (7, 25, 70, 3)
    (tmp_path / ".env").write_text("# a comment\nexport BARLOOM_STORAGE__RAW='here or there'\nBARLOOM_N=3 # three\n\nOTHER=x\n")
    s = settings.load(str(tmp_path / ".env"), {})
    assert (s.get("storage", "raw"), s.get("n"), s.get("other")) == ("here or there", 3, None)
    (tmp_path / "s.ini").write_text("[storage]\nraw = here\n")
    assert settings.load(str(tmp_path / "s.ini"), {}).get("storage", "raw") == "here"


def test_signals_by_name(spark, tmp_path):
    """Every indicator by its settings, one of them changed by a file; several as one signal."""
    from barloom import settings
    from barloom.operators import signals as G

    rows = [(m, DAY + dt.timedelta(hours=i), 100.0 + (i * 7919) % 23 + k, 103.0 + (i * 7919) % 23 + k, 97.0 + (i * 31) % 7, 100.0 + (i * 104729) % 19, 10.0 + (i * 17) % 5) for k, m in enumerate("ab") for i in range(80)]
    df = spark.createDataFrame(rows, "market string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    (tmp_path / "s.json").write_text(
        '{"indicators": {"knn": {"short_period": 3, "long_period": 5}, "logistic_regression": {"iterations": 5}, "rsi": {"period": 5}}}'
    )
    own = settings.load(str(tmp_path / "s.json"), {})
    for name in G.INDICATORS:
        out = G.signal(df, name, own)
        assert out.columns == [*df.columns, "signal"] and out.count() == len(rows), name
        assert {r.signal for r in out.select("signal").distinct().collect()} <= {-1, 0, 1}, name
    both = G.multi(df, ["rsi", "bollinger_bands"], [2.0, 1.0], 1.0, own)
    assert both.columns == [*df.columns, "signal"] and both.count() == len(rows)
    with pytest.raises(ValueError):
        G.signal(df, "none")


def test_results_and_latest_candles(spark, tmp_path):
    df = spark.sql("select 'm' market, 1 param_id, 2.0D sharpe")
    folder = S.save_backtest(spark, str(tmp_path), dt.datetime(2024, 5, 6, 7, 8, 9), metrics=df, equity=df)
    assert folder.endswith("20240506_070809") and spark.read.json(f"{folder}/equity").count() == 1
    S.save_search(df, df, f"{tmp_path}/search")
    assert spark.read.json(f"{tmp_path}/search/best").first().sharpe == 2.0
    now = 1672538400
    pay = lambda p: json.dumps([[1000 * (now - 3600 * k), "1", "2", "0.5", str(k), "10"] for k in range(3)])
    assert [r[4] for r in X.latest("binance", "BTCUSDT", "60", pay, now)] == [0.0]
    assert X.latest("binance", "BTCUSDT", "60", lambda p: "[]", now) == []
    csv = "start,open,high,low,close,volume\n1672531200000,9,9,9,1.5,10\n1672534800000,9,9,9,2.5,10\n"
    assert [r[4] for r in X.latest("drift", "SOL-PERP", "60", lambda p: csv, now)] == [2.5]


def test_requests_are_tried_again(monkeypatch):
    import io
    import urllib.error

    answers = [urllib.error.HTTPError("u", 503, "busy", {}, None), OSError("reset"), io.BytesIO(b"[]")]

    def opened(url, timeout):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    monkeypatch.setattr(X.urllib.request, "urlopen", opened)
    monkeypatch.setattr(X.time, "sleep", lambda s: None)
    page = X.Page("binance", "BTCUSDT", "60", 0, 3600)
    assert X.Http("binance")(page) == "[]"
    answers[:] = [urllib.error.HTTPError("u", 404, "none", {}, None)]
    with pytest.raises(X.ExchangeError):
        X.Http("binance")(page)
    answers[:] = [urllib.error.HTTPError("u", 429, "wait", {}, None)] * 3
    with pytest.raises(X.RateLimitError):
        X.Http("binance")(page)
