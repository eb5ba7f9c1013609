"""Indicators with memory: exponential and Wilder smoothing, and the supertrend ratchet.

A smoothed value is an affine function of the one before it, y = a * y' + b. Runs of such steps compose to one
affine step, so a long series needs no single task: ``affine_scan`` composes blocks apart, chains the blocks'
two numbers, and finishes the blocks apart. All smoothed indicators have a form by blocks (``with_...``). Where a
series is short, and for what is no affine recurrence, ``by_series`` runs a kernel over a whole series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import series as S

BY = S.BY
BLOCK = 100_000


def smooth(x: np.ndarray, seed: float, alpha: float) -> np.ndarray:
    """seed, then y += alpha * (x - y) for each x."""
    return pd.Series(np.concatenate([[seed], x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def _from(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Smoothing that begins with the mean of the first n values that are not NaN; NaN before."""
    out = np.full(len(x), np.nan)
    first = int(np.argmax(~np.isnan(x))) if (~np.isnan(x)).any() else len(x)
    if len(x) - first >= n:
        out[first + n - 1 :] = smooth(x[first + n :], x[first : first + n].mean(), alpha)
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return _from(x, n, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return _from(x, n, 1 / n)


def rsi(x: np.ndarray, n: int) -> np.ndarray:
    d = np.diff(x, prepend=np.nan)
    up, down = wilder(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), n), wilder(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), n)
    total = up + down
    return np.where(total == 0, 0.0, 100 * up / np.where(total == 0, 1, total))


def macd(x: np.ndarray, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and signal; both averages begin on the slow one's first bar."""
    late = x.astype(float).copy()
    late[: max(0, slow - fast)] = np.nan
    line = ema(late, fast) - ema(x, slow)
    return line, ema(line, signal)


def true_range(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.nan], c[:-1]])
    return np.maximum(np.maximum(h - low, np.abs(h - before)), np.abs(low - before))


def atr(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    return wilder(true_range(h, low, c), n)


def directional(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """+DI, -DI and ADX. Sums begin with the first n - 1 moves and decay by a n-th."""
    up, down = np.diff(h, prepend=np.nan), -np.diff(low, prepend=np.nan)
    moves = [np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0), true_range(h, low, c)]
    sums = []
    for m in moves:
        s = np.full(len(m), np.nan)
        if len(m) > n:
            s[n - 1 :] = smooth(m[n:] * n, m[1:n].sum(), 1 / n)
            s[n - 1] = np.nan
        sums.append(s)
    with np.errstate(divide="ignore", invalid="ignore"):
        plus, minus = (np.where(sums[2] == 0, 0.0, 100 * s / sums[2]) for s in sums[:2])
        dx = np.where(np.isnan(plus), np.nan, np.where(plus + minus == 0, 0.0, 100 * np.abs(plus - minus) / (plus + minus)))
    return plus, minus, wilder(dx, n)


def wave_trend(h: np.ndarray, low: np.ndarray, c: np.ndarray, a: int, b: int) -> np.ndarray:
    mean = (h + low + c) / 3
    base = ema(mean, a)
    far = ema(np.abs(mean - base), a)
    with np.errstate(divide="ignore", invalid="ignore"):
        return ema(np.where(far == 0, np.nan, (mean - base) / (0.015 * far)), b)


def supertrend(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Line and direction: -1 on the lower band after a close above the upper one, 1 on the upper band, 0 at first.

    Inside a direction a band only tightens; a band without a value stays as the comparison leaves it.
    """
    width = factor * pd.Series(true_range(h, low, c)).rolling(n).mean().to_numpy()
    upper, lower = (h + low) / 2 + width, (h + low) / 2 - width
    line, side = np.zeros(len(c)), np.ones(len(c))
    for i in range(1, len(c)):
        side[i] = -1 if c[i - 1] > upper[i - 1] else 1 if c[i - 1] < lower[i - 1] else side[i - 1]
        steady = not (c[i - 1] > upper[i - 1] or c[i - 1] < lower[i - 1])
        if steady and side[i] == -1 and lower[i - 1] > lower[i]:
            lower[i] = lower[i - 1]
        if steady and side[i] == 1 and upper[i - 1] < upper[i]:
            upper[i] = upper[i - 1]
        line[i] = lower[i] if side[i] == -1 else upper[i]
    return line, side


def widened(df: DataFrame, columns: list[tuple[str, str]]) -> T.StructType:
    """df's schema with more columns; a frame's own schema object is kept as it is."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in columns:
        out.add(name, kind)
    return out


def by_series(df: DataFrame, columns: dict[str, Callable[[pd.DataFrame], np.ndarray]], by=BY) -> DataFrame:
    """df with columns made by kernels over a whole series in order of ts; NaN becomes null."""
    names = list(columns)
    schema = widened(df, [(c, "double") for c in names])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        return pdf.assign(**{c: columns[c](pdf) for c in names})

    out = df.groupBy(*by).applyInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def _composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's step composed with all before it, by doubling: log2(rows) array operations."""
    a, b, step = a.astype(float).copy(), b.astype(float).copy(), 1
    while step < len(a):
        b[step:] = a[step:] * b[:-step] + b[step:]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def affine_scan(df: DataFrame, steps: dict[str, tuple[str, str]], by=BY, block: int = BLOCK) -> DataFrame:
    """df (with ``idx``) and, for each name, y = a * y' + b along each series, y' being 0 before the first row.

    steps: names with the columns of a and b, which are dropped. A block's rows meet in one task, blocks of a series
    in many; of a block two numbers a name go on to the chain, which has a row a block.
    """
    keep = [c for c in df.columns if c not in {x for ab in steps.values() for x in ab}]
    rows = df.withColumn("_block", F.floor(F.col("idx") / block))
    inside = [(f"_{k}{n}", "double") for n in steps for k in "ab"]
    schema = widened(rows.select(*keep, "_block"), inside)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        made = {}
        for n, (x, y) in steps.items():
            made[f"_a{n}"], made[f"_b{n}"] = _composed(pdf[x].to_numpy(float), pdf[y].to_numpy(float))
        return pdf[[*keep, "_block"]].assign(**made)

    done = rows.groupBy(*by, "_block").applyInPandas(compose, schema)
    ends = done.groupBy(*by, "_block").agg(*[F.max_by(c, "idx").alias(c) for c, _ in inside])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block", ignore_index=True)
        for n in steps:
            _, after = _composed(pdf[f"_a{n}"].to_numpy(), pdf[f"_b{n}"].to_numpy())
            pdf[f"_y{n}"] = np.concatenate([[0.0], after[:-1]])
        return pdf[[*by, "_block", *[f"_y{n}" for n in steps]]]

    starts = ends.groupBy(*by).applyInPandas(chain, widened(ends.select(*by, "_block"), [(f"_y{n}", "double") for n in steps]))
    out = done.join(starts, [*by, "_block"])
    return out.select(*keep, *[(F.col(f"_a{n}") * F.col(f"_y{n}") + F.col(f"_b{n}")).alias(n) for n in steps])


def smoothed(df: DataFrame, means: dict[str, tuple[str, int, float]], by=BY, block: int = BLOCK) -> DataFrame:
    """df (with ``idx``) and, for each name, the smoothing of a column with a weight, from the mean of its first n values.

    means: names with (column, n, weight). Null before the n-th value; a later null leaves the mean as it is and lets
    it weigh less against the next value.
    """
    whole, before = S.whole(by), Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows, steps = df, {}
    for name, (x, n, alpha) in means.items():
        v, idx = F.col(x), F.col("idx")
        rows = rows.withColumn("_f", F.min(F.when(v.isNotNull(), idx)).over(whole))
        seed = F.avg(F.when(idx < F.col("_f") + n, v)).over(whole)
        gap = idx - F.last(F.when(v.isNotNull(), idx), ignorenulls=True).over(before)
        rows = rows.withColumns({"_seed": seed, "_w": F.pow(F.lit(1 - alpha), gap), f"_at{name}": idx >= F.col("_f") + (n - 1)})
        first = idx == F.col("_f") + (n - 1)
        rows = rows.withColumns({
            f"_x{name}": F.when(~F.coalesce(F.col(f"_at{name}"), F.lit(False)) | first, 0.0).when(v.isNull(), 1.0).otherwise(F.col("_w") / (F.col("_w") + alpha)),
            f"_y{name}": F.when(first, F.col("_seed")).when(F.col(f"_at{name}") & v.isNotNull(), alpha * v / (F.col("_w") + alpha)).otherwise(0.0),
        }).drop("_f", "_seed", "_w")
        steps[name] = (f"_x{name}", f"_y{name}")
    out = affine_scan(rows, steps, by, block)
    out = out.withColumns({name: F.when(F.col(f"_at{name}"), F.col(name)) for name in means})
    return out.drop(*[f"_at{name}" for name in means])


def with_ema(df: DataFrame, n: int, x: str = "close", name: str = "ema", by=BY, block: int = BLOCK) -> DataFrame:
    return smoothed(S.numbered(df, by), {name: (x, n, 2 / (n + 1))}, by, block)


def with_rsi(df: DataFrame, n: int, x: str = "close", name: str = "rsi", by=BY, block: int = BLOCK) -> DataFrame:
    rows = S.numbered(df, by).withColumn("_d", F.col(x) - S.lag(x, 1, by))
    rows = rows.withColumns({"_up": F.greatest(F.col("_d"), F.lit(0.0)), "_down": F.greatest(-F.col("_d"), F.lit(0.0))})
    rows = rows.withColumns({c: F.when(F.col("_d").isNotNull(), F.col(c)) for c in ("_up", "_down")})
    rows = smoothed(rows, {"_u": ("_up", n, 1 / n), "_v": ("_down", n, 1 / n)}, by, block)
    total = F.col("_u") + F.col("_v")
    return rows.withColumn(name, F.when(total == 0, 0.0).otherwise(100 * F.col("_u") / total)).drop("_d", "_up", "_down", "_u", "_v")


def with_macd(df: DataFrame, fast: int, slow: int, signal: int, x: str = "close", by=BY, block: int = BLOCK) -> DataFrame:
    """macd and macd_signal; both averages begin on the slow one's first bar."""
    rows = S.numbered(df, by).withColumn("_late", F.when(F.col("idx") >= max(0, slow - fast), F.col(x)))
    rows = smoothed(rows, {"_f": ("_late", fast, 2 / (fast + 1)), "_s": (x, slow, 2 / (slow + 1))}, by, block)
    rows = rows.withColumn("macd", F.col("_f") - F.col("_s")).drop("_late", "_f", "_s")
    return smoothed(rows, {"macd_signal": ("macd", signal, 2 / (signal + 1))}, by, block)


def with_atr(df: DataFrame, n: int, name: str = "atr", by=BY, block: int = BLOCK) -> DataFrame:
    rows = S.numbered(df, by).withColumn("_tr", S.true_range(by))
    return smoothed(rows, {name: ("_tr", n, 1 / n)}, by, block).drop("_tr")


def with_directional(df: DataFrame, n: int, by=BY, block: int = BLOCK) -> DataFrame:
    """plus_di, minus_di and adx. Sums begin with the first n - 1 moves and decay by a n-th."""
    rows, idx = S.numbered(df, by), F.col("idx")
    up, down = F.col("high") - S.lag("high", 1, by), S.lag("low", 1, by) - F.col("low")
    rows = rows.withColumns({"_up": up, "_down": down, "_tr": S.true_range(by)})
    rows = rows.withColumns(
        {
            "_p": F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0),
            "_m": F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0),
        }
    )
    steps = {}
    for k in ("_p", "_m", "_tr"):
        seed = F.sum(F.when(idx.between(1, n - 1), F.col(k))).over(S.whole(by))
        rows = rows.withColumns(
            {
                f"_x{k}": F.when(idx < n, 0.0).otherwise(1 - 1 / n),
                f"_y{k}": F.when(idx < n - 1, 0.0).when(idx == n - 1, F.coalesce(seed, F.lit(0.0))).otherwise(F.col(k)),
            }
        )
        steps[f"_s{k}"] = (f"_x{k}", f"_y{k}")
    rows = affine_scan(rows, steps, by, block)
    share = lambda k: F.when(idx >= n, F.when(F.col("_s_tr") == 0, 0.0).otherwise(100 * F.col(f"_s{k}") / F.col("_s_tr")))
    rows = rows.withColumns({"plus_di": share("_p"), "minus_di": share("_m")})
    total = F.col("plus_di") + F.col("minus_di")
    rows = rows.withColumn("_dx", F.when(total == 0, 0.0).otherwise(100 * F.abs(F.col("plus_di") - F.col("minus_di")) / total)).drop(
        "_up", "_down", "_tr", "_p", "_m", "_s_p", "_s_m", "_s_tr"
    )
    return smoothed(rows, {"adx": ("_dx", n, 1 / n)}, by, block).drop("_dx")


def with_wave_trend(df: DataFrame, a: int, b: int, name: str = "wavetrend", by=BY, block: int = BLOCK) -> DataFrame:
    rows = S.numbered(df, by).withColumn("_h", (F.col("high") + F.col("low") + F.col("close")) / 3)
    rows = smoothed(rows, {"_base": ("_h", a, 2 / (a + 1))}, by, block).withColumn("_off", F.abs(F.col("_h") - F.col("_base")))
    rows = smoothed(rows, {"_far": ("_off", a, 2 / (a + 1))}, by, block)
    # what rounding leaves of a constant price counts as none
    rows = rows.withColumn("_ci", F.when(F.col("_far") > 1e-12 * F.abs("_h"), (F.col("_h") - F.col("_base")) / (0.015 * F.col("_far"))))
    return smoothed(rows, {name: ("_ci", b, 2 / (b + 1))}, by, block).drop("_h", "_base", "_off", "_far", "_ci")
