"""Grid search and walk-forward evaluation: a parameter set, or a window, is one more key of every partition."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .backtest import Terms, metrics

BY = ("market",)


def combinations(grid: dict[str, list]) -> list[dict]:
    """All combinations of the grid's values."""
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def parameters(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """param_id and a column for each parameter; a grid has as many rows as combinations."""
    rows = [(i, *c.values()) for i, c in enumerate(combinations(grid))]
    return spark.createDataFrame(rows, ["param_id", *grid])


def search(bars: DataFrame, grid: DataFrame, signals: Callable[[DataFrame, tuple], DataFrame], terms: Terms = Terms(), by=BY) -> DataFrame:
    """Backtest figures of every series and parameter set. ``signals`` adds a signal, given frame and keys."""
    every = bars.crossJoin(F.broadcast(grid))  # a grid is a few rows
    keys = (*by, "param_id")
    return metrics(signals(every, keys), terms, keys).join(F.broadcast(grid), "param_id")


def best(found: DataFrame, metric: str, higher: bool = True, by=BY) -> DataFrame:
    """The best parameter set of each series, the first of equals."""
    order = F.desc_nulls_last(metric) if higher else F.asc_nulls_last(metric)
    return (
        found.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "param_id")))
        .filter("_rank = 1")
        .drop("_rank")
    )


def ranking(found: DataFrame, metric: str, higher: bool = True, by=BY) -> DataFrame:
    order = F.desc_nulls_last(metric) if higher else F.asc_nulls_last(metric)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "param_id")))


def heatmap(found: DataFrame, y: str, x: str, metric: str, values: list, by=BY) -> DataFrame:
    """Mean metric with a row for each y and a column for each x."""
    return found.groupBy(*by, y).pivot(x, values).agg(F.avg(metric))


def impact(found: DataFrame, param: str, metric: str, by=BY) -> DataFrame:
    """Linear trend of the metric over a parameter."""
    return found.groupBy(*by).agg(F.regr_slope(metric, param).alias("slope"), F.regr_intercept(metric, param).alias("intercept"))


def windows(bars: DataFrame, train: int, test: int, step: int, by=BY) -> DataFrame:
    """Windows of days that lie wholly inside a series: by, window_id, train_from, test_from, test_to (half open)."""
    ends = bars.groupBy(*by).agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    last = F.date_sub("b", train + test)
    rows = ends.filter(last >= F.col("a")).withColumn(
        "train_from", F.explode(F.sequence(F.col("a"), last, F.expr(f"interval {step} days")))
    )
    rows = rows.withColumn("window_id", F.row_number().over(Window.partitionBy(*by).orderBy("train_from")) - 1)
    return rows.select(
        *by,
        "window_id",
        "train_from",
        F.date_add("train_from", train).alias("test_from"),
        F.date_add("train_from", train + test).alias("test_to"),
    )


def walk_forward(
    bars: DataFrame,
    grid: DataFrame,
    signals: Callable[[DataFrame, tuple], DataFrame],
    metric: str,
    train: int = 180,
    test: int = 60,
    step: int = 30,
    terms: Terms = Terms(),
    by=BY,
) -> DataFrame:
    """Per window the best parameter set on the training part and its figure there and on the test part.

    A bar is repeated for each window that holds it, (train + test) / step times at most; the test part is played
    with the chosen set alone.
    """
    spans = windows(bars, train, test, step, by)
    day = F.to_date("ts")
    placed = bars.join(spans, list(by)).filter((day >= F.col("train_from")) & (day < F.col("test_to")))
    # a window's days are part of its key, so nothing need be joined to it again
    keys = (*by, "window_id", "train_from", "test_from", "test_to")
    early, late = (placed.filter(c) for c in (day < F.col("test_from"), day >= F.col("test_from")))
    found = best(search(early, grid, signals, terms, keys), metric, True, keys)
    chosen = found.select(*keys, "param_id", F.col(metric).alias("train_metric"))
    own = late.join(chosen.select(*keys, "param_id"), list(keys)).join(F.broadcast(grid), "param_id")
    both = (*keys, "param_id")
    tested = metrics(signals(own, both), terms, both).select(*both, F.col(metric).alias("test_metric"))
    out = chosen.join(tested, list(both), "left")
    return out.withColumn("decay", F.col("test_metric") - F.col("train_metric"))


def stability(walked: DataFrame, grid: DataFrame, by=BY) -> DataFrame:
    """Spread of each parameter over a walk-forward's windows: by, param, mean, population deviation, least, greatest,
    share of windows that change it, and the range over the mean."""
    params = [c for c in grid.columns if c != "param_id"]
    rows = walked.select(*by, "window_id", "param_id").join(F.broadcast(grid), "param_id")
    rows = rows.select(*by, "window_id", F.explode(F.array(*[F.struct(F.lit(c).alias("param"), F.col(c).cast("double").alias("value")) for c in params])).alias("x")).select(*by, "window_id", "x.*")
    before = F.lag("value").over(Window.partitionBy(*by, "param").orderBy("window_id"))
    rows = rows.withColumn("_moved", (F.col("value") != before).cast("int"))
    out = rows.groupBy(*by, "param").agg(
        F.count("*").alias("n_windows"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.coalesce(F.avg("_moved"), F.lit(0.0)).alias("share_changed"),
    )
    return out.withColumn("relative_range", F.try_divide(F.col("max") - F.col("min"), F.abs("mean")))
