"""Indicators that need windows alone: frames in, frames with more columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import series as S

BY = S.BY


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, by=BY) -> DataFrame:
    """middle, upper, lower (population deviation), percent_b (0.5 on a flat band) and bandwidth (0 if middle is 0)."""
    df = df.withColumn("middle", S.sma("close", n, by)).withColumn("_dev", S.rolling(F.stddev_pop, "close", n, by))
    df = df.withColumn("upper", F.col("middle") + k * F.col("_dev")).withColumn("lower", F.col("middle") - k * F.col("_dev")).drop("_dev")
    width = F.col("upper") - F.col("lower")
    percent = F.when(F.col("middle").isNotNull(), F.when(width == 0, 0.5).otherwise((F.col("close") - F.col("lower")) / width))
    return df.withColumn("percent_b", percent).withColumn("bandwidth", F.when(F.col("middle") == 0, 0.0).otherwise(width / F.col("middle")))


def squeeze(df: DataFrame, window: int = 20, by=BY) -> DataFrame:
    """Is the bandwidth below all of the window before it?"""
    before = S.order(by).rowsBetween(-window, -1)
    enough = F.count("bandwidth").over(before) >= window
    return df.withColumn("squeeze", F.when(enough, F.col("bandwidth") < F.min("bandwidth").over(before)).otherwise(False))


def bollinger_signal() -> Column:
    return F.when(F.col("close") < F.col("lower"), 1).when(F.col("close") > F.col("upper"), -1).otherwise(0)


def stochastic(df: DataFrame, k: int = 14, slow: int = 3, d: int = 3, by=BY) -> DataFrame:
    """slow_k and slow_d, both from the bar on which slow_d has its window."""
    hh, ll = S.rolling(F.max, "high", k, by), S.rolling(F.min, "low", k, by)
    df = df.withColumn("_hh", hh).withColumn("_ll", ll)
    df = df.withColumn(
        "_raw", F.when(F.col("_hh") == F.col("_ll"), 0.0).otherwise(100 * (F.col("close") - F.col("_ll")) / (F.col("_hh") - F.col("_ll")))
    )
    df = df.withColumn("_k", S.sma("_raw", slow, by)).withColumn("slow_d", S.sma("_k", d, by))
    return df.withColumn("slow_k", F.when(F.col("slow_d").isNotNull(), F.col("_k"))).drop("_hh", "_ll", "_raw", "_k")


def williams_r(n: int = 14, by=BY) -> Column:
    hh, ll = S.rolling(F.max, "high", n, by), S.rolling(F.min, "low", n, by)
    return F.when(hh == ll, 0.0).otherwise(-100 * (hh - F.col("close")) / (hh - ll))


def cci(df: DataFrame, n: int = 20, by=BY) -> DataFrame:
    """Commodity channel index; the mean deviation is of the window's own values."""
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    window = S.last_rows(n, by)
    df = df.withColumn("_tps", F.collect_list("_tp").over(window)).withColumn("_mean", S.sma("_tp", n, by))
    dev = F.aggregate("_tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mean"))) / n
    df = df.withColumn("_dev", F.when(F.col("_mean").isNotNull(), dev))
    return df.withColumn("cci", F.when(F.col("_dev") < 1e-12, 0.0).otherwise((F.col("_tp") - F.col("_mean")) / (0.015 * F.col("_dev")))).drop("_tp", "_tps", "_mean", "_dev")


def atr_simple(n: int = 10, by=BY) -> Column:
    """Rolling mean of the true range."""
    return S.sma(S.true_range(by), n, by)


def volatility_cluster(df: DataFrame, atr: str, window: int = 100, levels=(0.75, 0.5, 0.25), by=BY) -> DataFrame:
    """cluster: the nearest of three levels between the window's lowest and highest atr, the first on ties; 0 before."""
    df = df.withColumn("_lo", S.rolling(F.min, atr, window, by)).withColumn("_hi", S.rolling(F.max, atr, window, by))
    far = [F.abs(F.col(atr) - (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * x)) for x in levels]
    nearest = F.least(*far)
    pick = F.when(nearest.isNull(), 0)
    for i, f in enumerate(far):
        pick = pick.when(f == nearest, i)
    return df.withColumn("cluster", pick.cast("int")).drop("_lo", "_hi")


def kernel_regression(h: int = 8, r: float = 8.0, x: int = 25, by=BY) -> Column:
    """Rational quadratic mean of the h bars before; 0 while there are fewer."""
    weights = [(1 + d * d / (2 * r * x)) ** (-r) for d in range(1, h + 1)]
    terms = [w * S.lag("close", d, by) for d, w in enumerate(weights, 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.coalesce(total / sum(weights), F.lit(0.0))


def regime(df: DataFrame, window: int = 20, volatile: float = 0.03, trend: float = 0.5, by=BY) -> DataFrame:
    """regime of each bar's window: volatile, trend or range; trend while the window isn't full."""
    df = df.withColumn("_r", S.change("close", 1, by))
    w = S.last_rows(window, by)
    enough = F.count("close").over(w) >= window
    # the window's own returns: its first bar has none
    std = F.stddev_samp("_r").over(S.last_rows(window - 1, by))
    span = F.max("high").over(w) - F.min("low").over(w)
    moved = F.abs(F.col("close") - S.lag("close", window - 1, by))
    kind = F.when(~enough, "trend").when(std > volatile, "volatile").when((span > 0) & (moved / span > trend), "trend").otherwise("range")
    return df.withColumn("regime", kind).drop("_r")


def features(df: DataFrame, by=BY) -> DataFrame:
    """Momentum, volatility, averages, ranges and volume families for learning."""
    df = df.withColumn("ret", S.change("close", 1, by))
    out = {f"momentum_{n}": S.change("close", n, by) for n in (5, 10, 20)}
    out |= {f"volatility_{n}": S.rolling(F.stddev_samp, "ret", n, by) for n in (5, 20)}
    out |= {f"price_to_sma_{n}": F.try_divide(F.col("close"), S.sma("close", n, by)) - 1 for n in (10, 20)}
    hi, lo = S.rolling(F.max, "high", 20, by), S.rolling(F.min, "low", 20, by)
    out |= {
        "high_low_range": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
        "to_high": F.try_divide(F.col("close"), hi) - 1,
        "to_low": F.try_divide(F.col("close"), lo) - 1,
    }
    out |= {"volume_change": S.change("volume", 1, by), "volume_ratio": F.try_divide(F.col("volume"), S.sma("volume", 20, by))}
    out |= {"price_volume_corr": F.when(F.count("ret").over(S.last_rows(20, by)) >= 20, S.corr("ret", "volume", S.last_rows(20, by)))}
    return df.withColumns(out)


def ranked(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n rows with the largest value."""
    return df.orderBy(F.desc(value)).limit(n)
