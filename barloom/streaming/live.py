"""Live candles: bars from a stream of ticks, upserts into the processed layer, and indicators with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import recurrences as R
from ..sources.storage import append_raw_live, upsert_processed

BY = ("market",)


def bars(ticks: DataFrame, width: str, late: str, by=BY) -> DataFrame:
    """Bars of ticks (by, ts, price, size) as soon as the watermark has passed them; ties in time by price."""
    w = F.window("ts", width)
    at = F.struct("ts", "price")
    out = ticks.withWatermark("ts", late).groupBy(*by, w.alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume")
    )
    return out.select(*by, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding(ticks: DataFrame, width: str, slide: str, late: str, by=BY) -> DataFrame:
    """Ticks, size and mean price of windows that begin every ``slide``."""
    out = ticks.withWatermark("ts", late).groupBy(*by, F.window("ts", width, slide).alias("w")).agg(
        F.count("*").alias("n"), F.sum("size").alias("volume"), F.avg("price").alias("mean_price")
    )
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume", "mean_price")


def joined(left: DataFrame, right: DataFrame, within: str, late: str, by=BY) -> DataFrame:
    """Ticks of two streams (by, ts, price): each left one with the right ones up to ``within`` behind it.

    Both sides are kept as long as the watermarks allow a partner. They meet by spans of time as long as ``within``: a left
    tick in each span that it reaches, a right one in its own, so a pair meets once and a tick doesn't meet its whole series.
    """
    reach = F.expr(f"interval {within}")
    # about as long as the reach; it says how many ticks meet, not which
    long = F.greatest(F.abs(F.unix_micros(F.timestamp_seconds(F.lit(0)) + reach)), F.lit(1))

    def span(t):
        return F.call_function("div", F.unix_micros(t), long)

    a = left.withWatermark("ts", late).select(*by, "ts", "price", F.explode(F.sequence(span(F.col("ts")), span(F.col("ts") + reach))).alias("_span"))
    b = right.withWatermark("ts", late).select(*[F.col(c).alias(f"right_{c}") for c in (*by, "ts", "price")], span(F.col("ts")).alias("right__span"))
    same = (F.col("right_ts") >= F.col("ts")) & (F.col("right_ts") <= F.col("ts") + reach)
    for c in (*by, "_span"):
        same = same & (F.col(c) == F.col(f"right_{c}"))
    return a.join(b, same).drop("_span", *[f"right_{c}" for c in (*by, "_span")])


def without_repeats(candles: DataFrame, late: str, ts: str = "timestamp", by=BY) -> DataFrame:
    """The first arrival of each time within the watermark."""
    return candles.withWatermark(ts, late).dropDuplicatesWithinWatermark([*by, ts])


def sessions(ticks: DataFrame, gap: str, late: str, by=BY) -> DataFrame:
    """Spells of ticks that no gap parts."""
    out = ticks.withWatermark("ts", late).groupBy(*by, F.session_window("ts", gap).alias("s")).agg(
        F.count("*").alias("n"), F.sum("size").alias("volume")
    )
    return out.select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "volume")


def store(
    candles: DataFrame, path: str, checkpoint: str, every: str = "60 seconds", once: bool = False, raw: str | None = None
) -> StreamingQuery:
    """Upsert candles into the processed layer, where of one time the last arrival stays, and append them to a raw layer
    if one is named. A batch that is tried again replaces its processed bars and repeats its raw ones."""

    def batch(df: DataFrame, epoch: int) -> None:
        if not df.isEmpty():
            if raw:
                append_raw_live(df, raw)
            upsert_processed(df.withColumn("_epoch", F.lit(epoch)), path, "_epoch")

    writer = candles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _stochastic(p: pd.DataFrame, n: int) -> float:
    high, low = p["high"].tail(n).max(), p["low"].tail(n).min()
    return 0.0 if high == low else 100 * (p["close"].iloc[-1] - low) / (high - low)


def _cci(p: pd.DataFrame, n: int) -> float:
    mean = ((p["high"] + p["low"] + p["close"]) / 3).tail(n)
    dev = (mean - mean.mean()).abs().mean()
    return 0.0 if dev == 0 else (mean.iloc[-1] - mean.mean()) / (0.015 * dev)


def _hlc(p: pd.DataFrame) -> tuple:
    return tuple(p[c].to_numpy(float) for c in ("high", "low", "close"))


#: the last value of an indicator on the bars held, and the bars that it needs for a period n
KERNELS = {
    "rsi": (lambda p, n: R.rsi(p["close"].to_numpy(float), n)[-1], lambda n: n + 1),
    "ema": (lambda p, n: R.ema(p["close"].to_numpy(float), n)[-1], lambda n: n),
    "macd": (lambda p, n: R.macd(p["close"].to_numpy(float), n // 2, n, 9)[0][-1], lambda n: n),
    "atr": (lambda p, n: R.atr(*_hlc(p), n)[-1], lambda n: n + 1),
    "adx": (lambda p, n: R.directional(*_hlc(p), n)[2][-1], lambda n: 2 * n),
    "percent_b": (lambda p, n: (lambda x: 0.5 if x.std(ddof=0) == 0 else (x.iloc[-1] - x.mean() + 2 * x.std(ddof=0)) / (4 * x.std(ddof=0)))(p["close"].tail(n)), lambda n: n),
    "stochastic": (_stochastic, lambda n: n),
    "williams_r": (lambda p, n: _stochastic(p, n) - 100, lambda n: n),
    "cci": (_cci, lambda n: n),
}


class _Indicator(StatefulProcessor):
    """Keeps the last ``size`` bars of a series and computes the kernel on them for each new bar."""

    def __init__(self, kernel: str, n: int):
        self.kernel, self.n, self.size = kernel, n, 3 * n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("bars", "ts timestamp, high double, low double, close double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["ts", "high", "low", "close"]
        held = list(self.state.get()) if self.state.exists() else []
        new = pd.concat(list(rows)).sort_values("ts")
        value, needs = KERNELS[self.kernel]
        out = []
        for row in new[names].itertuples(index=False):
            held = [*held, tuple(row)][-self.size :]
            bars = pd.DataFrame(held, columns=names)
            out.append((*key, row.ts, row.close, float(value(bars, self.n)) if len(held) >= needs(self.n) else None))
        self.state.put([tuple(x) for x in held])
        yield pd.DataFrame(out, columns=["market", "ts", "close", "value"])

    def close(self) -> None:
        pass


def incremental(stream: DataFrame, kernel: str, n: int) -> DataFrame:
    """An indicator of KERNELS on the last 3 * n bars for every bar of a stream (market, ts, high, low, close); null
    until it has enough. Needs the RocksDB state store."""
    return stream.groupBy("market").transformWithStateInPandas(
        _Indicator(kernel, n), "market string, ts timestamp, close double, value double", "Append", "None"
    )
