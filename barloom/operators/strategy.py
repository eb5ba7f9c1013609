"""Strategies: several signals of a bar made into one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions import recurrences as R
from ..functions import series as S

BY = S.BY


def weighted(signals: list[str], weights: list[float] | None = None, threshold: float = 1.0) -> Column:
    """1, -1 or 0 by the weighted sum; missing signals count as 0. Without weights four signals have 2, 2, 1, 1."""
    weights = weights or ([2.0, 2.0, 1.0, 1.0] if len(signals) == 4 else [1.0] * len(signals))
    total = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.coalesce(F.col(s), F.lit(0)) for s, w in zip(signals, weights, strict=True)])
    return S.threshold(total, threshold)


def rsi_signal(x: str = "rsi", low: float = 30.0, high: float = 70.0) -> Column:
    return F.when(F.col(x) > high, -1).when(F.col(x) < low, 1).otherwise(0)


def stochastic_signal(by=BY, low: float = 20.0, high: float = 80.0) -> Column:
    c = S.cross("slow_k", "slow_d", by)
    return (
        F.when((F.col("slow_k") < low) & (F.col("slow_d") < low) & (c == 1), 1)
        .when((F.col("slow_k") > high) & (F.col("slow_d") > high) & (c == -1), -1)
        .otherwise(0)
    )


def cci_signal(by=BY, level: float = 100.0) -> Column:
    return F.when(S.cross("cci", F.lit(-level), by) == 1, 1).when(S.cross("cci", F.lit(level), by) == -1, -1).otherwise(0)


def williams_signal(by=BY, low: float = -80.0, high: float = -20.0) -> Column:
    return F.when(S.cross("williams_r", F.lit(low), by) == 1, 1).when(S.cross("williams_r", F.lit(high), by) == -1, -1).otherwise(0)


def adx_signal(by=BY, least: float = 25.0) -> Column:
    return F.when(F.col("adx") > least, S.cross("plus_di", "minus_di", by)).otherwise(0)


def gate(df: DataFrame, volatility: bool = True, volume: bool = True, by=BY) -> DataFrame:
    """gate: true on the first ten bars; else ATR(1) above ATR(10) and the volume's RSI(14) above 49, as far as asked."""
    made = {
        "_atr": lambda p: R.atr(*(p[c].to_numpy(float) for c in ("high", "low", "close")), 10), "_rsi": lambda p: R.rsi(
            p["volume"].to_numpy(float), 14
        )
    }
    out = R.by_series(df, made, by)
    ok = F.lit(True)
    if volatility:
        ok = ok & F.coalesce(S.true_range(by) > F.col("_atr"), F.lit(True))
    if volume:
        ok = ok & F.coalesce(F.col("_rsi") > 49, F.lit(True))
    first = F.row_number().over(S.order(by)) <= 10
    return out.withColumn("gate", first | ok).drop("_atr", "_rsi")


def segmented(df: DataFrame, by_regime: dict[str, list[str]], threshold: float = 0.0, per_bar: bool = True, by=BY) -> DataFrame:
    """signal by the indicators of the bar's regime, or of the series' last regime for all its bars."""
    df = I.regime(df, by=by)
    if not per_bar:
        df = df.withColumn("regime", F.max_by("regime", "ts").over(S.whole(by)))
    out = F.lit(None)
    for regime, signals in by_regime.items():
        out = F.when(F.col("regime") == regime, weighted(signals, [1.0] * len(signals), threshold)).otherwise(out)
    return df.withColumn("signal", F.coalesce(out, F.lit(0)))


def regime_statistics(df: DataFrame, by=BY) -> DataFrame:
    """Shares of regimes in percent, changes and mean bars between them."""
    x = df.withColumn("_c", (F.col("regime") != S.lag("regime", 1, by)).cast("int"))
    share = lambda r: (F.avg((F.col("regime") == r).cast("double")) * 100).alias(f"{r}_pct")
    changes = F.coalesce(F.sum("_c"), F.lit(0))
    return x.groupBy(*by).agg(
        *[share(r) for r in ("volatile", "trend", "range")],
        changes.cast("long").alias("transitions"),
        (F.count("*") / (changes + 1)).alias("avg_duration"),
    )


def adapted_weights(df: DataFrame, signals: list[str], lookback: int = 50, by=BY) -> DataFrame:
    """Per series and signal the weight 1 * (1 + 0.5 * correlation with the next return on the last 2 * lookback bars),
    brought to a sum of as many as there are signals."""
    x = df.withColumn("_f", F.try_divide(F.lead("close").over(S.order(by)), F.col("close")) - 1).withColumn(
        "_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts")))
    )
    x = x.filter(F.col("_back") <= 2 * lookback)
    long = x.select(
        *by, "_f", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in signals])).alias("s")
    )
    w = long.groupBy(*by, "s.signal").agg((1 + 0.5 * F.coalesce(S.corr("s.v", "_f"), F.lit(0.0))).alias("raw"))
    return w.withColumn("weight", F.col("raw") * len(signals) / F.sum("raw").over(S.whole(by))).drop("raw")


def filters(df: DataFrame, slope: float = -0.1, adx: float = 20.0, ema: int = 200, sma: int = 200, by=BY) -> DataFrame:
    """df with volatility_ok (ATR 14 above ATR 28), slope_ok (the close's change over five bars above ``slope``), adx_ok
    (ADX 14 at least ``adx``), ema_ok and sma_ok (the close above its average) and kernel_ok (the kernel rises).

    A filter that has no value yet doesn't hold.
    """
    hlc = lambda p: [p[c].to_numpy(float) for c in ("high", "low", "close")]
    made = {
        "_a14": lambda p: R.atr(*hlc(p), 14), "_a28": lambda p: R.atr(*hlc(p), 28), "_adx": lambda p: R.directional(*hlc(p), 14)[2], "_ema": lambda p: R.ema(p["close"].to_numpy(float), ema)
    }
    rows = R.by_series(df, made, by).withColumn("_kernel", I.kernel_regression(by=by))
    close, yes = F.col("close"), lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumns({
        "volatility_ok": yes(F.col("_a14") > F.col("_a28")), "slope_ok": yes(close - S.lag("close", 5, by) > slope), "adx_ok": yes(F.col("_adx") >= adx), "ema_ok": yes(close > F.col("_ema")),
        "sma_ok": yes(close > S.sma("close", sma, by)), "kernel_ok": yes(F.col("_kernel") > S.lag("_kernel", 1, by)),
    }).drop("_a14", "_a28", "_adx", "_ema", "_kernel")


def supertrend_signal(df: DataFrame, n: int = 10, factor: float = 3.0, window: int = 100, levels=(0.75, 0.5, 0.25), by=BY) -> DataFrame:
    """supertrend (line), signal (its direction, 1 and -1) and the volatility cluster of each bar."""
    hlc = lambda p: [p[c].to_numpy(float) for c in ("high", "low", "close")]
    rows = R.by_series(
        df, {"supertrend": lambda p: R.supertrend(*hlc(p), n, factor)[0], "signal": lambda p: R.supertrend(*hlc(p), n, factor)[1]}, by
    )
    rows = I.volatility_cluster(rows.withColumn("_atr", I.atr_simple(n, by)), "_atr", window, levels, by)
    return rows.withColumn("signal", F.col("signal").cast("int")).drop("_atr")


def distribution(df: DataFrame, signal: str = "signal", by=BY) -> DataFrame:
    """Bars of each series that buy, sell or do neither."""
    n = lambda v: F.count_if(F.col(signal) == v)
    return df.groupBy(*by).agg(n(1).alias("buy"), n(-1).alias("sell"), n(0).alias("neutral"))


def signal_features(df: DataFrame, signals: list[str], window: int = 10, by=BY) -> DataFrame:
    """Each signal's mean, deviation, greatest, least and changes over the window, and ``agreement``: the share of pairs
    of signals that are equal, from the bar behind the first window on."""
    out = {}
    for s in signals:
        v = F.col(s).cast("double")
        out |= {
            f"{s}_mean": S.rolling(F.avg, v, window, by),
            f"{s}_std": S.rolling(F.stddev_samp, v, window, by),
            f"{s}_max": S.rolling(F.max, v, window, by),
            f"{s}_min": S.rolling(F.min, v, window, by),
        }
        out |= {f"{s}_changes": S.rolling(F.sum, F.abs(v - S.lag(v, 1, by)), window, by)}
    if len(signals) > 1:
        equal = [(F.col(a) == F.col(b)).cast("double") for i, a in enumerate(signals) for b in signals[i + 1 :]]
        share = reduce(lambda a, b: a + b, [F.coalesce(e, F.lit(0.0)) for e in equal]) / len(equal)
        out["agreement"] = F.when(F.row_number().over(S.order(by)) > window, share)
    return df.withColumns(out)


def adapted(
    df: DataFrame, signals: list[str], weights: list[float] | None = None, threshold: float = 1.0, lookback: int = 50, by=BY
) -> DataFrame:
    """df with ``signal``: the weighted sum against the threshold, the weights adapted to the series' last bars.

    A signal's weight grows by half its correlation with the next bar's return over the last 2 * lookback bars if the
    correlation has the sign of the return summed over the last ``lookback`` bars, else it shrinks by as much; then all
    are brought to a sum of as many as there are signals.
    """
    told = adaptation(df, signals, weights, lookback, by).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("signal", "weight"))).alias("_w")
    )
    rows = df.join(told, list(by))
    total = reduce(lambda a, b: a + b, [F.col("_w")[s] * F.coalesce(F.col(s), F.lit(0)) for s in signals])
    return rows.withColumn("signal", S.threshold(total, threshold)).drop("_w")


def adaptation(df: DataFrame, signals: list[str], weights: list[float] | None = None, lookback: int = 50, by=BY) -> DataFrame:
    """by, signal, correlation, weight before and after one adaptation (see ``adapted``), and the change.

    Series of fewer than 2 * lookback bars keep their weights.
    """
    weights = weights or ([2.0, 2.0, 1.0, 1.0] if len(signals) == 4 else [1.0] * len(signals))
    w = S.order(by)
    x = df.withColumns(
        {
            "_r": S.change("close", 1, by),
            "_f": F.try_divide(F.lead("close").over(w), F.col("close")) - 1,
            "_back": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts"))),
            "_n": F.count("*").over(S.whole(by)),
        }
    )
    x = x.filter(F.col("_back") <= 2 * lookback)
    parts = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(float(v)).alias("before"), F.col(s).cast("double").alias("v")) for s, v in zip(signals, weights, strict=True)])
    long = x.select(*by, "_r", "_f", "_back", "_n", F.explode(parts).alias("s"))
    recent = F.sum(F.when(F.col("_back") <= lookback, F.col("_r")))
    told = long.groupBy(*by, "s.signal", "s.before").agg(
        S.corr("s.v", "_f").alias("correlation"), recent.alias("_recent"), F.max("_n").alias("_n")
    )
    right = (F.col("correlation") > 0) & (F.col("_recent") > 0) | (F.col("correlation") < 0) & (F.col("_recent") <= 0)
    step = F.when(F.col("correlation").isNull(), 0.0).when(right, F.abs("correlation") * 0.5).otherwise(-F.abs("correlation") * 0.5)
    long_enough = F.col("_n") >= 2 * lookback
    told = told.withColumn("_raw", F.col("before") * (1 + F.when(long_enough, step).otherwise(0.0)))
    told = told.withColumn(
        "weight", F.when(long_enough, F.col("_raw") * len(signals) / F.sum("_raw").over(S.whole(by))).otherwise(F.col("before"))
    )
    return told.select(*by, "signal", "correlation", "before", "weight", (F.col("weight") - F.col("before")).alias("change"))


def self_metrics(df: DataFrame, signals: list[str], threshold: float = 1.0, lookback: int = 50, by=BY) -> DataFrame:
    """One row a series and signal: the strategy's mean signal quality (signal times the next return), the mean
    deviation of its weights, and the signal's mean correlation, its deviation and the net change of its weight, over
    an adaptation from equal weights at each 2 * lookback bars of the series."""
    at = F.row_number().over(S.order(by)) - 1
    block = F.floor(at / (2 * lookback))
    rows = (
        df.withColumn("_block", block)
        .withColumn("_size", F.count("*").over(Window.partitionBy(*by, "_block")))
        .filter(F.col("_size") == 2 * lookback)
    )
    keys = (*by, "_block")
    told = adaptation(rows, signals, [1.0] * len(signals), lookback, keys)
    spread = told.groupBy(*by, "signal").agg(
        F.avg("correlation").alias("avg_correlation"),
        F.stddev_pop("correlation").alias("correlation_stability"),
        F.sum("change").alias("net_weight_change"),
        F.stddev_pop("weight").alias("_spread"),
        F.max_by("weight", "_block").alias("current_weight"),
    )
    spread = spread.withColumn("weight_stability", F.avg("_spread").over(S.whole(by))).drop("_spread")
    played = adapted(rows, signals, [1.0] * len(signals), threshold, lookback, keys)
    played = played.withColumn("_q", F.col("signal") * (F.try_divide(F.lead("close").over(S.order(by)), F.col("close")) - 1))
    quality = played.groupBy(*by).agg(F.avg("_q").alias("avg_signal_quality"))
    return spread.fillna(0.0, ["avg_correlation", "correlation_stability"]).join(quality, list(by))


def aligned(frames: dict[str, DataFrame], value: str = "signal", by=BY) -> DataFrame:
    """One frame of several ones' values by series and time, a column each, null where a frame has no row.

    The frames' rows meet in one aggregate instead of a chain of outer joins; of rows that repeat a time the greatest
    value stays.
    """
    rows = reduce(
        DataFrame.unionByName,
        [f.select(*by, "ts", F.lit(n).alias("_n"), F.col(value).cast("double").alias("_v")) for n, f in frames.items()],
    )
    return rows.groupBy(*by, "ts").agg(*[F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(n) for n in frames])
