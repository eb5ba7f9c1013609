"""Monte-Carlo paths as joins and windows.

Draws come from an arithmetic generator, so a path can be made again anywhere. Simulations are the unit of
parallelism: a path never needs another one's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BY = ("market",)
YEAR = 252.0
# fixed values of the generator
_A, _B, _P = 1_103_515_245, 12_345, 2_147_483_647


def draw(sim: Column, step: Column, n: Column | int, seed: int = 7) -> Column:
    """A number from 0 to n - 1 for a simulation and a step."""
    x = F.pmod((sim + 1) * F.lit(_A).cast("long") + (step + 1) * F.lit(_B).cast("long") * (sim + seed), F.lit(_P))
    return F.pmod(F.pmod(x * 48_271, F.lit(_P)), n)


def grid(spark: SparkSession, sims: int, steps: int) -> DataFrame:
    """(sim, step) of all simulations, dealt by simulation."""
    return spark.range(sims).withColumnRenamed("id", "sim").withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(steps)).cast("array<bigint>"))
    )


def bootstrap(
    values: DataFrame, value: str, order: str, sims: int, steps: int | None, seed: int = 7, by=BY, share: float = 1.0
) -> DataFrame:
    """Draws with replacement from each series: by, sim, step, x. steps: a number, or a share of the series' length."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = values.withColumn("_i", F.row_number().over(w) - 1)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    count = F.lit(steps) if steps else F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    paths = sizes.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)).cast("array<bigint>")))
    paths = paths.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), count.cast("long"))))
    paths = paths.withColumn("_i", draw(F.col("sim"), F.col("step"), F.col("_n"), seed))
    return paths.join(rows.select(*by, "_i", F.col(value).alias("x")), [*by, "_i"]).select(*by, "sim", "step", "x")


def _sequence(n: Column | int) -> Column:
    return F.sequence(F.lit(1).cast("long"), (n if isinstance(n, Column) else F.lit(n)).cast("long"))


def drawn(
    values: DataFrame, value: str, order: str, sims: int, steps: int | None, seed: int = 7, by=BY, share: float = 1.0, parts: int = 16
) -> DataFrame:
    """A row a path: by, sim, xs (draws with replacement in the order of steps).

    A series is one array, sent to as many tasks as there are parts of the simulations; draws look up places in it.
    """
    arrays = values.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_s"))
    arrays = arrays.select(*by, F.col("_s.v").alias("_xs"), F.explode(F.sequence(F.lit(0), F.lit(min(parts, sims) - 1))).alias("_part")).repartition(*by, "_part")
    rows = arrays.withColumn("sim", F.explode(F.sequence(F.col("_part"), F.lit(sims - 1), F.lit(min(parts, sims))).cast("array<bigint>")))
    n = F.size("_xs").cast("long")
    count = F.lit(steps) if steps else F.greatest(F.lit(1), F.floor(n * share))
    return rows.select(
        *by,
        "sim",
        F.transform(_sequence(count), lambda s: F.element_at("_xs", (draw(F.col("sim"), s, n, seed) + 1).cast("int"))).alias("xs"),
    )


def path_outcomes(paths: DataFrame, start: float, compounded: bool, by=BY) -> DataFrame:
    """Each drawn path's final value, return and deepest drawdown (percent), by a fold over its draws."""
    first = F.struct(F.lit(float(start)).alias("v"), F.lit(float(start)).alias("peak"), F.lit(0.0).alias("fall"))

    def step(acc: Column, x: Column) -> Column:
        v = acc["v"] * (1 + x) if compounded else acc["v"] + x
        peak = F.greatest(acc["peak"], v)
        return F.struct(v.alias("v"), peak.alias("peak"), F.greatest(acc["fall"], (peak - v) / peak * 100).alias("fall"))

    out = paths.withColumn("_e", F.aggregate("xs", first, step))
    return out.select(
        *by,
        "sim",
        F.col("_e.v").alias("final"),
        F.col("_e.fall").alias("max_drawdown"),
        ((F.col("_e.v") / start - 1) * 100).alias("return_pct"),
    )


def path_values(paths: DataFrame, start: float, compounded: bool, by=BY) -> DataFrame:
    """by, sim, step, value of drawn paths."""
    place = F.posexplode("xs")
    rows = paths.select(*by, "sim", place.alias("step", "x")).withColumn("step", (F.col("step") + 1).cast("long"))
    return compounded_paths(rows, start, by) if compounded else summed_paths(rows, start, by)


def return_summary(ends: DataFrame, start: float, periods: int, confidence: float = 0.95, by=BY) -> DataFrame:
    """Final values, yearly growth and drawdowns of simulated paths: means, medians, deviations and percentiles, the
    interval of the confidence among them, and the share of paths that end above the start."""
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    levels = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "low": low, "p50": 0.5, "high": high, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    rows = ends.withColumn("cagr", (F.pow(F.col("final") / start, YEAR / periods) - 1) * 100)
    told = []
    for name, c in (("final", "final"), ("cagr", "cagr"), ("drawdown", "max_drawdown")):
        q = F.percentile(c, F.array(*[F.lit(x) for x in levels.values()]))
        told += [
            F.avg(c).alias(f"{name}_mean"),
            F.median(c).alias(f"{name}_median"),
            F.stddev_pop(c).alias(f"{name}_std"),
            *[q[i].alias(f"{name}_{k}") for i, k in enumerate(levels)],
        ]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *told, F.avg((F.col("final") > start).cast("double")).alias("profit_probability"))


def shuffled(values: DataFrame, value: str, order: str, sims: int, seed: int = 7, by=BY) -> DataFrame:
    """Each series in another order for every simulation."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = values.withColumn("_i", (F.row_number().over(w) - 1).cast("long")).withColumn(
        "sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)).cast("array<bigint>"))
    )
    mixed = Window.partitionBy(*by, "sim").orderBy(draw(F.col("sim"), F.col("_i"), _P, seed), "_i")
    return rows.withColumn("step", F.row_number().over(mixed).cast("long")).select(*by, "sim", "step", F.col(value).alias("x"))


def summed_paths(draws: DataFrame, start: float, by=BY) -> DataFrame:
    w = Window.partitionBy(*by, "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return draws.withColumn("value", start + F.sum("x").over(w)).select(*by, "sim", "step", "value")


def compounded_paths(draws: DataFrame, start: float = 1.0, by=BY) -> DataFrame:
    w = Window.partitionBy(*by, "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return draws.withColumn("value", start * F.product(1 + F.col("x")).over(w)).select(*by, "sim", "step", "value")


def outcomes(paths: DataFrame, start: float, by=BY) -> DataFrame:
    """Each path's final value, return and deepest drawdown (percent)."""
    w = Window.partitionBy(*by, "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    x = paths.withColumn("peak", F.greatest(F.max("value").over(w), F.lit(start)))
    return (
        x.groupBy(*by, "sim")
        .agg(F.max_by("value", "step").alias("final"), F.max((F.col("peak") - F.col("value")) / F.col("peak") * 100).alias("max_drawdown"))
        .withColumn("return_pct", (F.col("final") / start - 1) * 100)
    )


PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]


def summary(ends: DataFrame, start: float, by=BY) -> DataFrame:
    """Mean, median, population deviation, percentiles of final values, drawdown percentiles and win probability."""
    q = F.percentile("final", F.array(*[F.lit(p / 100) for p in PERCENTILES]))
    return ends.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("final").alias("mean_final"),
        F.median("final").alias("median_final"),
        F.stddev_pop("final").alias("std_final"),
        *[q[i].alias(f"p{p}") for i, p in enumerate(PERCENTILES)],
        F.avg((F.col("final") > start).cast("double")).alias("win_probability"),
        F.avg("max_drawdown").alias("mean_drawdown"),
        F.percentile("max_drawdown", F.lit(0.95)).alias("drawdown_p95"),
    )


def fan(paths: DataFrame, levels=(0.05, 0.5, 0.95), by=BY) -> DataFrame:
    """Percentiles of all paths at every step."""
    q = F.percentile("value", F.array(*[F.lit(x) for x in levels]))
    return paths.groupBy(*by, "step").agg(*[q[i].alias(f"p{round(100 * x)}") for i, x in enumerate(levels)])


def sampled(paths: DataFrame, n: int = 100, seed: int = 7, by=BY) -> DataFrame:
    """The paths of n simulations of each series, for a picture: the first in the order of a hash."""
    sims = paths.select(*by, "sim").distinct()
    order = Window.partitionBy(*by).orderBy(F.xxhash64("sim", F.lit(seed)), "sim")
    chosen = sims.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")
    return paths.join(chosen, [*by, "sim"], "left_semi")


def histogram(ends: DataFrame, value: str = "final", bins: int = 50, by=BY) -> DataFrame:
    """Counts of a value in equal bins between its least and greatest: by, bin (from 0), low, high, n; empty bins are
    left out, and a constant value is one bin."""
    span = ends.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = ends.join(span, list(by))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    out = rows.groupBy(*by, place.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n"))
    return out.select(
        *by, "bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n"
    )
