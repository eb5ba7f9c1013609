"""Signals by name: every indicator with its settings, gate and holding period behind one call."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions import indicators as I
from ..functions import recurrences as R
from ..functions import series as S
from . import learn as L
from . import strategy as T

BY = S.BY
#: an indicator: bars, its settings and the series' keys give bars with a column ``signal`` of -1, 0 and 1
Indicator = Callable[[DataFrame, Mapping, tuple], DataFrame]


def _hlc(p: pd.DataFrame) -> list:
    return [p[c].to_numpy(float) for c in ("high", "low", "close")]


def _rsi(df: DataFrame, p: Mapping, by) -> DataFrame:
    rows = R.by_series(df, {"_rsi": lambda x: R.rsi(x["close"].to_numpy(float), p["period"])}, by)
    return rows.withColumn("signal", T.rsi_signal("_rsi", p["oversold"], p["overbought"])).drop("_rsi")


def _macd(df: DataFrame, p: Mapping, by) -> DataFrame:
    made = {
        n: lambda x, k=k: R.macd(x["close"].to_numpy(float), p["fast_period"], p["slow_period"], p["signal_period"])[k]
        for k, n in enumerate(("_line", "_trigger"))
    }
    return R.by_series(df, made, by).withColumn("signal", S.cross("_line", "_trigger", by)).drop(*made)


def _stochastic(df: DataFrame, p: Mapping, by) -> DataFrame:
    rows = I.stochastic(df, p["k_period"], p["smoothing"], p["d_period"], by)
    return rows.withColumn("signal", T.stochastic_signal(by, p["oversold"], p["overbought"])).drop("slow_k", "slow_d")


def _cci(df: DataFrame, p: Mapping, by) -> DataFrame:
    up, down = S.cross("cci", F.lit(float(p["oversold"])), by) == 1, S.cross("cci", F.lit(float(p["overbought"])), by) == -1
    return I.cci(df, p["period"], by).withColumn("signal", F.when(up, 1).when(down, -1).otherwise(0)).drop("cci")


def _adx(df: DataFrame, p: Mapping, by) -> DataFrame:
    made = {n: lambda x, k=k: R.directional(*_hlc(x), p["period"])[k] for k, n in enumerate(("plus_di", "minus_di", "adx"))}
    return R.by_series(df, made, by).withColumn("signal", T.adx_signal(by, p["threshold"])).drop(*made)


def _bollinger(df: DataFrame, p: Mapping, by) -> DataFrame:
    rows = I.bollinger(df, p["period"], p["deviations"], by).withColumn("signal", I.bollinger_signal())
    return rows.drop("middle", "upper", "lower", "percent_b", "bandwidth")


def _williams(df: DataFrame, p: Mapping, by) -> DataFrame:
    return (
        df.withColumn("williams_r", I.williams_r(p["period"], by))
        .withColumn("signal", T.williams_signal(by, p["oversold"], p["overbought"]))
        .drop("williams_r")
    )


def _supertrend(df: DataFrame, p: Mapping, by) -> DataFrame:
    return T.supertrend_signal(df, p["atr_length"], p["factor"], p["training_length"], by=by).drop("supertrend", "cluster")


def _logistic(df: DataFrame, p: Mapping, by) -> DataFrame:
    gate = p["filter_signals_by"]
    rows = L.logistic_signal(
        df,
        p["lookback"],
        p["norm_lookback"],
        p["learning_rate"],
        p["iterations"],
        p["use_price_data"],
        gate in ("Volatility", "Both"),
        gate in ("Volume", "Both"),
        p["holding_period"],
        by,
    )
    return rows.drop("loss", "pred")


def _knn(df: DataFrame, p: Mapping, by) -> DataFrame:
    """Bars without enough before them have the signal 0."""
    found = L.knn_signal(df, p["short_period"], p["long_period"], p["base_neighbors"], by).select(*by, "ts", "signal")
    return df.join(found, [*by, "ts"], "left").fillna(0, ["signal"])


def _lorentzian(df: DataFrame, p: Mapping, by) -> DataFrame:
    p = p["general_settings"]
    return L.lorentzian_signal(df, p["max_bars_back"], p["neighbors_count"], by=by).select(*df.columns, "signal")


INDICATORS: dict[str, Indicator] = {
    "rsi": _rsi, "macd": _macd, "stochastic": _stochastic, "cci": _cci, "adx": _adx, "bollinger_bands": _bollinger, "williams_r": _williams, "supertrend": _supertrend, "logistic_regression": _logistic, "knn": _knn, "lorentzian": _lorentzian,
}
#: these gate and limit their signals themselves, or not at all
_WHOLE = {"logistic_regression", "supertrend", "knn", "lorentzian"}


def signal(df: DataFrame, name: str, values: settings.Settings | None = None, by=BY) -> DataFrame:
    """df with ``signal`` by an indicator's settings: gated by what ``filter_signals_by`` names (None, Volatility, Volume
    or Both), then limited by its holding period."""
    if name not in INDICATORS:
        raise ValueError(f"no indicator {name!r}: {', '.join(sorted(INDICATORS))}")
    p = (values or settings.load()).get("indicators", name)
    out = INDICATORS[name](df.drop("signal"), p, by)
    if name in _WHOLE:
        return out
    gate = p.get("filter_signals_by", "None")
    if gate != "None":
        out = (
            T.gate(out, gate in ("Volatility", "Both"), gate in ("Volume", "Both"), by)
            .withColumn("signal", S.gated("signal", F.col("gate")))
            .drop("gate")
        )
    return S.held(out.withColumnRenamed("signal", "_raw"), "_raw", p["holding_period"], "signal", by).drop("_raw") if p.get(
        "holding_period"
    ) else out


def multi(
    df: DataFrame,
    names: list[str],
    weights: list[float] | None = None,
    threshold: float = 1.0,
    values: settings.Settings | None = None,
    by=BY,
) -> DataFrame:
    """df with one ``signal`` of several indicators, aligned by time and weighted (see strategy.weighted)."""
    frames = {n: signal(df, n, values, by) for n in names}
    both = T.aligned(frames, by=by).withColumn("signal", T.weighted(names, weights, threshold))
    return df.drop("signal").join(both.select(*by, "ts", "signal"), [*by, "ts"], "left")
