"""Signals that learn from a series' own past.

Neighbour searches look at all earlier bars of a series by definition; a series is one task, and bars are taken in
blocks so that memory is a block times the series' length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import recurrences as R
from ..functions import series as S
from .strategy import gate

BY = S.BY


def _series(df: DataFrame, run, columns: str, by=BY) -> DataFrame:
    schema = R.widened(df, [tuple(c.split()) for c in columns.split(", ")])
    return df.groupBy(*by).applyInPandas(run, schema)


def knn_features(df: DataFrame, short: int = 14, long: int = 28, by=BY) -> DataFrame:
    """Momentum, mean volume, volatility and mean price over two periods, from a series' long-th row on."""
    df = S.numbered(df, by).withColumn("_r", S.change("close", 1, by))
    out = df.withColumns(
        {
            "mom_short": S.change("close", short, by), "mom_long": S.change("close", long, by), "vol_short": S.sma("volume", short, by), "vol_long": S.sma("volume", long, by),
            "volatility": S.rolling(F.stddev_samp, "_r", long, by), "sma_short": S.sma("close", short, by), "sma_long": S.sma("close", long, by), "label": F.when(S.col(F.lead("close").over(S.order(by))) > F.col("close"), 1).otherwise(-1),
        }
    )
    return out.filter(F.col("idx") >= long).drop("_r")


KNN = ["mom_short", "mom_long", "vol_short", "vol_long", "volatility", "sma_short", "sma_long"]


def knn_signal(df: DataFrame, short: int = 14, long: int = 28, k: int = 252, by=BY) -> DataFrame:
    """signal: the vote of the k nearest earlier bars on whether the next bar rises; ties fall.

    Features are standardised by all bars so far (a constant one by 1). Equally far bars are taken in order of time.
    Bars with fewer than ten feature rows before them have none.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        x, y = pdf[KNN].to_numpy(float), pdf["label"].to_numpy()
        n = np.arange(1, len(x) + 1)[:, None]
        mean = np.cumsum(x, axis=0) / n
        out = np.full(len(x), np.nan)
        for i in range(9, len(x)):
            std = x[: i + 1].std(axis=0)
            std[std < 1e-12 * np.maximum(1, np.abs(mean[i]))] = 1
            far = (((x[:i] - x[i]) / std) ** 2).sum(axis=1)
            near = np.argsort(far, kind="stable")[: min(k, i)]
            out[i] = 1 if y[near].sum() > 0 else -1
        return pdf.assign(signal=pd.array(out, dtype="Float64").astype("Int32"))

    return _series(knn_features(df, short, long, by), run, "signal integer", by)


def lorentzian_features(df: DataFrame, by=BY) -> DataFrame:
    """f1 to f5: RSI 14, wave trend 10/11, CCI 20, ADX 20 and RSI 9."""
    from ..functions.indicators import cci

    made = {
        "f1": lambda p: R.rsi(p["close"].to_numpy(float), 14), "f2": lambda p: R.wave_trend(*(p[c].to_numpy(float) for c in ("high", "low", "close")), 10, 11),
        "f4": lambda p: R.directional(*(p[c].to_numpy(float) for c in ("high", "low", "close")), 20)[2], "f5": lambda p: R.rsi(p["close"].to_numpy(float), 9),
    }
    return R.by_series(S.numbered(cci(df, 20, by).withColumnRenamed("cci", "f3"), by), made, by)


def lorentzian(df: DataFrame, features: list[str], back: int = 2000, k: int = 8, every: int = 4, warm: bool = True, by=BY) -> DataFrame:
    """distance (mean over the k nearest) and signal of each bar among every fourth of the ``back`` bars before it.

    The distance is the sum of ln(1 + difference). Bars with a feature missing are no neighbours and have none; the
    signal is 1 where the nearest bar's distance lies below the mean by more than the deviation of the k distances,
    -1 where the bar before lies above it by more than that; ties go to the earlier bar.
    If ``warm``, the signal of a series' first ``back`` bars is 0.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        x, at = pdf[features].to_numpy(float), pdf["idx"].to_numpy()
        whole = ~np.isnan(x).any(axis=1)
        mean, signal = np.full(len(x), np.nan), np.zeros(len(x), int)
        for i in range(1, len(x)):
            rows = np.flatnonzero(whole[max(0, i - back) : i] & (at[max(0, i - back) : i] % every == 0)) + max(0, i - back)
            if whole[i] and len(rows) >= k:
                far = np.log1p(np.abs(x[rows] - x[i])).sum(axis=1)
                near = np.sort(far)[:k]
                mean[i] = near.mean()
                last = np.log1p(np.abs(x[i - 1] - x[i])).sum() if whole[i - 1] else np.nan
                if warm and at[i] < back:
                    continue
                signal[i] = 1 if last < mean[i] - near.std() else -1 if last > mean[i] + near.std() else 0
        return pdf.assign(distance=mean, signal=signal.astype("int32"))

    out = _series(df, run, "distance double, signal integer", by)
    return out.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))


def lorentzian_signal(
    df: DataFrame, back: int = 2000, k: int = 8, every: int = 4, warm: bool = True, volatility: bool = True, slope: float | None = None, adx: float | None = None, ema: int | None = None, sma: int | None = None, by=BY,
) -> DataFrame:
    """signal of the five features, 0 unless the kernel rises and all filters that are asked for hold.

    volatility: ATR 14 above ATR 28; slope: the close's change over five bars above it; adx: ADX 14 at least it;
    ema, sma: the close above its average of so many bars. A filter that has no value yet doesn't hold.
    """
    from ..functions.indicators import kernel_regression

    hlc = lambda p: [p[c].to_numpy(float) for c in ("high", "low", "close")]
    made = {"_a14": lambda p: R.atr(*hlc(p), 14), "_a28": lambda p: R.atr(*hlc(p), 28)} if volatility else {}
    if adx is not None:
        made["_adx"] = lambda p: R.directional(*hlc(p), 14)[2]
    if ema is not None:
        made["_ema"] = lambda p: R.ema(p["close"].to_numpy(float), ema)
    rows = lorentzian_features(df, by).withColumn("kernel", kernel_regression(by=by))
    rows = lorentzian(R.by_series(rows, made, by) if made else rows, ["f1", "f2", "f3", "f4", "f5"], back, k, every, warm, by)
    close, ok = F.col("close"), F.col("kernel") > S.lag("kernel", 1, by)
    if volatility:
        ok = ok & (F.col("_a14") > F.col("_a28"))
    if slope is not None:
        ok = ok & (close - S.lag("close", 5, by) > slope)
    if adx is not None:
        ok = ok & (F.col("_adx") >= adx)
    if ema is not None:
        ok = ok & (close > F.col("_ema"))
    if sma is not None:
        ok = ok & (close > S.full(S.sma("close", sma, by), "close", sma, by))
    return rows.withColumn("signal", S.gated("signal", ok).cast("int")).drop(*made)


def logistic(df: DataFrame, lookback: int = 10, rate: float = 0.0009, iterations: int = 1000, by=BY) -> DataFrame:
    """loss and pred of a one-weight logistic fit on each full window of prices, ln(abs(p * p - 1) + 0.5) being the target.

    Both are brought to 0 to 1 within the window unless constant. Rows carry their windows, so that any rows can be
    fitted together: an iteration is a few array operations over a batch.
    """
    return _fitted(df, S.last_rows(lookback, by), lookback, rate, iterations).filter(F.col("loss").isNotNull())


def _fitted(df: DataFrame, w: WindowSpec, lookback: int, rate: float, iterations: int, least: float = 0.0, share: float = 0.0) -> DataFrame:
    """loss and pred of the window's fit, null unless it is full; it is constant if its span is at most least + share * low."""
    schema = R.widened(df, [("loss", "double"), ("pred", "double")])
    names = df.columns

    def scaled(m: np.ndarray) -> np.ndarray:
        low, high = m.min(axis=1, keepdims=True), m.max(axis=1, keepdims=True)
        wide = high - low > least + share * np.abs(low)
        return np.where(wide, (m - low) / np.where(wide, high - low, 1), m)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(names))
            full = lists.value_lengths().to_numpy(zero_copy_only=False) >= lookback
            raw = lists.filter(pa.array(full)).flatten().to_numpy().reshape(-1, lookback)
            x, y = scaled(raw), scaled(np.log(np.abs(raw * raw - 1) + 0.5))
            weight, h = np.zeros(len(x)), np.zeros(x.shape)
            for _ in range(iterations):
                h = 1 / (1 + np.exp(-weight[:, None] * x))
                weight = weight - rate * ((h - y) * x).sum(axis=1) / lookback
            safe = np.clip(h, 1e-10, 1 - 1e-10)
            found = np.full((2, b.num_rows), np.nan)
            found[0, full] = -(y * np.log(safe) + (1 - y) * np.log(1 - safe)).sum(axis=1) / lookback
            found[1, full] = 1 / (1 + np.exp(-weight * x[:, -1]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v, mask=~full) for v in found)], [*names, "loss", "pred"])

    return df.withColumn("_x", F.collect_list(F.col("close").cast("double")).over(w)).mapInArrow(fit, schema)


def logistic_signal(
    df: DataFrame, lookback: int = 3, scale: int = 2, rate: float = 0.0009, iterations: int = 1000, price: bool = True, volatility: bool = False, volume: bool = False, holding: int = 5, by=BY,
) -> DataFrame:
    """signal: 1 where the close lies above the loss of a fit on the bars before, -1 where below; a tie keeps the last signal.

    Without ``price`` the prediction takes the close's place. Loss and prediction are scaled by the range of the
    ``scale`` closes before. Bars that fail the gates asked for are 0, as is each one that would make a signal last
    longer than ``holding`` bars after its first.
    """
    w = S.order(by).rowsBetween(-lookback, -1)
    rows = _fitted(df, w, lookback, rate, iterations, 1e-8, 1e-5)
    before = S.order(by).rowsBetween(-scale, -1)
    low, high = F.min("close").over(before), F.max("close").over(before)
    flat = (F.count("close").over(before) < 2) | (high - low <= 1e-8 + 1e-5 * F.abs(low))
    scaled = lambda x: F.when(flat, F.col(x)).otherwise((high - low) * (F.col(x) - low) / (high - low) + low)
    rows = rows.withColumns({"_loss": scaled("loss"), "_value": F.col("close") if price else scaled("pred")})
    rows = gate(rows, volatility, volume, by) if volatility or volume else rows.withColumn("gate", F.lit(True))

    def run(pdf: pd.DataFrame) -> np.ndarray:
        out, last, n = np.zeros(len(pdf)), 0, 0
        for i, (x, loss, ok) in enumerate(
            zip(pdf["_value"].to_numpy(float), pdf["_loss"].to_numpy(float), pdf["gate"].to_numpy(bool), strict=True)
        ):
            if i < lookback:
                n += 1
                continue
            new = (-1 if x < loss else 1 if x > loss else last) if ok else 0
            n = n + 1 if new == last else 0
            if n >= holding and new:
                new, n = 0, 0
            out[i] = last = new
        return out

    return R.by_series(rows, {"signal": run}, by).withColumn("signal", F.col("signal").cast("int")).drop("_loss", "_value", "gate")


def direction_label(ahead: int = 4, by=BY) -> Column:
    """1 if the close rises over the bars ahead, else -1; 0 where there are too few."""
    later = F.lead("close", ahead).over(S.order(by))
    return F.when(later.isNull(), 0).when(later > F.col("close"), 1).otherwise(-1)


def neighbour_label(
    df: DataFrame, features: list[str], label: str = "label", back: int = 2000, k: int = 8, every: int = 4, by=BY
) -> DataFrame:
    """prediction: the mean label of the k nearest among every fourth of the bars before; null for fewer."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        x, at, y = pdf[features].to_numpy(float), pdf["idx"].to_numpy(), pdf[label].to_numpy(float)
        whole, out = ~np.isnan(x).any(axis=1), np.full(len(x), np.nan)
        for i in range(1, len(x)):
            low = max(0, i - back)
            rows = np.flatnonzero(whole[low:i] & (at[low:i] % every == 0)) + low
            if whole[i] and len(rows) >= k:
                far = np.log1p(np.abs(x[rows] - x[i])).sum(axis=1)
                out[i] = y[rows[np.argsort(far, kind="stable")[:k]]].mean()
        return pdf.assign(prediction=out)

    out = _series(df, run, "prediction double", by)
    return out.withColumn("prediction", F.when(~F.isnan("prediction"), F.col("prediction")))


def adaptive_threshold(df: DataFrame, distance: str = "distance", by=BY) -> DataFrame:
    """The mean distance of each series."""
    return df.groupBy(*by).agg(F.avg(distance).alias("threshold"))
