"""Windows over ordered series, as column expressions.

``by`` names the columns that tell series apart; rows are ordered by ``ts``. All windows of a frame share one
partitioning and order, so Spark sorts once. A rolling value is null until its window is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BY = ("market",)


def order(by=BY, ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(ts)


def last_rows(n: int, by=BY, ts: str = "ts") -> WindowSpec:
    return order(by, ts).rowsBetween(-(n - 1), 0)


def so_far(by=BY, ts: str = "ts") -> WindowSpec:
    return order(by, ts).rowsBetween(Window.unboundedPreceding, 0)


def whole(by=BY) -> WindowSpec:
    return Window.partitionBy(*by)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(value: Column, x: str | Column, n: int, by=BY) -> Column:
    """value where the last n rows all have x."""
    return F.when(F.count(col(x)).over(last_rows(n, by)) >= n, value)


def sma(x: str | Column, n: int, by=BY) -> Column:
    return full(F.avg(col(x)).over(last_rows(n, by)), x, n, by)


def rolling(f, x: str | Column, n: int, by=BY) -> Column:
    """An aggregate function over the last n rows."""
    return full(f(col(x)).over(last_rows(n, by)), x, n, by)


def lag(x: str | Column, n: int = 1, by=BY) -> Column:
    return F.lag(col(x), n).over(order(by))


def change(x: str | Column, n: int = 1, by=BY) -> Column:
    """Simple return over n rows."""
    return F.try_divide(col(x), lag(x, n, by)) - 1


def padded(x: str | Column, by=BY) -> Column:
    """The last value that is not null."""
    return F.last(col(x), ignorenulls=True).over(so_far(by))


def true_range(by=BY) -> Column:
    """Null on the first bar."""
    before = lag("close", 1, by)
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def cross(a: str | Column, b: str | Column, by=BY) -> Column:
    """1 where a rises through b, -1 where it falls through, else 0; strict on both sides."""
    d = col(a) - col(b)
    before = lag(d, 1, by)
    return F.when((before < 0) & (d > 0), 1).when((before > 0) & (d < 0), -1).otherwise(0)


def numbered(df: DataFrame, by=BY) -> DataFrame:
    """df with ``idx``, the row's place in its series from 0."""
    return df.withColumn("idx", (F.row_number().over(order(by)) - 1).cast("long"))


def runs(df: DataFrame, x: str, name: str = "run", by=BY) -> DataFrame:
    """df with a number for each run of equal x (null equals null)."""
    starts = F.when(F.row_number().over(order(by)) == 1, 1).otherwise((~F.col(x).eqNullSafe(lag(x, 1, by))).cast("int"))
    return df.withColumn("_start", starts).withColumn(name, F.sum("_start").over(so_far(by)).cast("long")).drop("_start")


def held(df: DataFrame, signal: str, holding: int, name: str, by=BY) -> DataFrame:
    """Signals limited by a holding period: every (holding + 1)-th bar of a run of one signal is 0."""
    at = F.row_number().over(order(by))
    starts = (at == 1) | ~F.col(signal).eqNullSafe(lag(signal, 1, by))
    out = df.withColumn("_at", at).withColumn("_first", F.last(F.when(starts, F.col("_at")), ignorenulls=True).over(so_far(by)))
    place = F.col("_at") - F.col("_first") + 1
    return out.withColumn(name, F.when(place % (holding + 1) == 0, 0).otherwise(F.col(signal)).cast("int")).drop("_at", "_first")


def threshold(x: str | Column, t: float) -> Column:
    return F.when(col(x) > t, 1).when(col(x) < -t, -1).otherwise(0)


def gated(signal: str | Column, gate: Column) -> Column:
    return F.when(F.coalesce(gate, F.lit(False)), col(signal)).otherwise(0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def min_max(x: str, by=BY) -> Column:
    """x over its whole series brought to 0 to 1; 0 if it is constant."""
    low, high = F.min(x).over(whole(by)), F.max(x).over(whole(by))
    return F.when(high == low, 0.0).otherwise((F.col(x) - low) / (high - low))


def floor_days(a: str | Column, b: str | Column) -> Column:
    """Whole days from a to b."""
    return F.floor((micros(col(b)) - micros(col(a))) / 86_400_000_000).cast("long")


def hours(a: str | Column, b: str | Column) -> Column:
    return (micros(col(b)) - micros(col(a))) / 3_600_000_000.0


def corr(x: str | Column, y: str | Column, window: WindowSpec | None = None) -> Column:
    """Correlation; null where either is constant."""
    over = (lambda c: c.over(window)) if window is not None else (lambda c: c)
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = over(F.stddev_pop(x)) * over(F.stddev_pop(y))
    return F.when(spread > 1e-12, over(F.covar_pop(x, y)) / spread)


def micros(x: Column) -> Column:
    """Microseconds since 1970 of a time, with or without a zone (UTC sessions)."""
    return F.unix_micros(x.cast("timestamp"))
