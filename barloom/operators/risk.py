"""Risk measures of return series (by, ts, r)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series as S
from .performance import returns, unbiased_kurtosis, unbiased_skew

BY = S.BY
YEAR = 252.0


def _deepest(window: Column) -> Column:
    """The deepest fall (0 to 1) of the equity that an array of returns makes, from its first value on."""
    start = F.struct(F.lit(1.0).alias("v"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("low"))

    def step(acc: Column, x: Column) -> Column:
        v = acc["v"] * (1 + x)
        peak = F.greatest(acc["peak"], v)
        return F.struct(v.alias("v"), peak.alias("peak"), F.least(acc["low"], v / peak - 1).alias("low"))

    return F.aggregate(window, start, step, lambda acc: -acc["low"])


def daily_rate(annual: float = 0.0) -> float:
    return (1 + annual) ** (1 / YEAR) - 1


def risk_metrics(r: DataFrame, annual_rate: float = 0.0, by=BY) -> DataFrame:
    """Sharpe, Sortino, omega, VaR and CVaR of 95 %, skewness, kurtosis and tail ratio; all 0 for under 5 returns."""
    rf = daily_rate(annual_rate)
    cut = r.groupBy(*by).agg(F.percentile("r", F.array(F.lit(0.05), F.lit(0.95))).alias("_p"))
    x = r.join(cut, list(by))
    n = F.count("r").cast("double")
    std, down = F.stddev_samp("r"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r")))
    excess = F.avg("r") - F.lit(rf)
    p5, p95 = F.max(F.col("_p")[0]), F.max(F.col("_p")[1])
    root = F.sqrt(F.lit(YEAR))
    some = F.count("r") >= 5
    zero = lambda c: F.when(some, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return x.groupBy(*by).agg(
        F.count("r").alias("n"),
        zero(F.when(std > 0, excess / std * root)).alias("sharpe_ratio"),
        zero(F.when(down > 0, excess / down * root)).alias("sortino_ratio"),
        zero(F.try_divide(F.sum(F.when(F.col("r") > rf, F.col("r"))), F.abs(F.sum(F.when(F.col("r") < rf, F.col("r")))))).alias(
            "omega_ratio"
        ),
        zero(p5).alias("var_95"),
        zero(F.avg(F.when(F.col("r") <= F.col("_p")[0], F.col("r")))).alias("cvar_95"),
        zero(F.when(std > 1e-12, unbiased_skew(F.skewness("r"), n))).alias("skewness"),
        zero(F.when(std > 1e-12, unbiased_kurtosis(F.kurtosis("r"), n))).alias("kurtosis"),
        zero(F.when(p5 != 0, F.abs(p95 / p5))).alias("tail_ratio"),
    )


def risk_report(r: DataFrame, b: DataFrame | None = None, annual_rate: float = 0.0, by=BY) -> DataFrame:
    """Eighteen figures of a return series, percentages but for the ratios; only series of five returns and more.

    Against a benchmark (ts, b): alpha, beta, R squared, tracking error, information ratio; 0 without one.
    """
    rf, year = daily_rate(annual_rate), F.sqrt(F.lit(YEAR))
    w = S.so_far(by)
    x = r.withColumn("_v", F.product(1 + F.col("r")).over(w))
    x = x.withColumn("_fall", (F.max("_v").over(w) - F.col("_v")) / F.max("_v").over(w))
    cut = x.groupBy(*by).agg(F.percentile("r", F.array(F.lit(0.05), F.lit(0.01))).alias("_p"))
    x = x.join(cut, list(by)).join(b, "ts", "left") if b is not None else x.join(cut, list(by)).withColumn("b", F.lit(None).cast("double"))
    mean, std, down = F.avg("r"), F.stddev_samp("r"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r")))
    win, loss = F.avg(F.when(F.col("r") > 0, F.col("r"))), F.abs(F.avg(F.when(F.col("r") < 0, F.col("r"))))
    with_b = F.when(F.col("b").isNotNull(), F.col("r"))
    beta = F.when(F.var_samp("b") > 0, F.covar_samp(with_b, "b") / F.var_samp("b")).otherwise(0.0)
    track = F.stddev_samp(F.col("r") - F.col("b")) * year
    n, fall = F.count("r").cast("double"), F.max("_fall")
    matched = F.count("b") > 1
    told = {
        "annual_return": mean * YEAR * 100, "annual_volatility": std * year * 100, "sharpe_ratio": F.when(std > 0, (mean - rf) / std * year), "sortino_ratio": F.when(down > 0, (mean - rf) / down * year),
        "calmar_ratio": F.when(fall > 0, mean * YEAR / fall), "max_drawdown": fall * 100, "var_95": F.abs(F.max(F.col("_p")[0])) * 100, "var_99": F.abs(F.max(F.col("_p")[1])) * 100,
        "cvar_95": F.abs(F.avg(F.when(F.col("r") <= F.col("_p")[0], F.col("r")))) * 100, "win_rate": F.avg((F.col("r") > 0).cast("double")) * 100, "win_loss_ratio": F.when(loss > 0, win / loss),
        "skewness": F.when(std > 1e-12, unbiased_skew(F.skewness("r"), n)), "kurtosis": F.when(std > 1e-12, unbiased_kurtosis(F.kurtosis("r"), n)),
        "alpha": F.when(matched, ((mean - rf) - beta * (F.avg("b") - rf)) * YEAR * 100), "beta": F.when(matched, beta), "r_squared": F.when(matched, F.pow(S.corr(with_b, F.col("b")), 2)),
        "tracking_error": F.when(matched, track * 100), "information_ratio": F.when(matched & (track > 0), (mean - F.avg("b")) * YEAR / track),
    }
    out = x.groupBy(*by).agg(F.count("r").alias("_n"), *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in told.items()])
    return out.filter("_n >= 5").drop("_n")


def benchmark_metrics(r: DataFrame, b: DataFrame, annual_rate: float = 0.0, by=BY) -> DataFrame:
    """Beta, alpha, Treynor, information ratio, R squared and captures against a benchmark (ts, b)."""
    rf = daily_rate(annual_rate)
    x = r.join(b, "ts").withColumn("_d", F.col("r") - F.col("b"))
    beta = F.try_divide(F.covar_samp("r", "b"), F.var_samp("b"))
    mean, bench = F.avg("r"), F.avg("b")
    track = F.stddev_samp("_d") * F.sqrt(F.lit(YEAR))
    capture = lambda c: F.try_divide(F.avg(F.when(c, F.col("r"))), F.avg(F.when(c, F.col("b")))) * 100
    up, low = capture(F.col("b") > 0), capture(F.col("b") < 0)
    return x.groupBy(*by).agg(
        F.count("*").alias("n"),
        beta.alias("beta"),
        ((mean - (F.lit(rf) + beta * (bench - rf))) * YEAR).alias("alpha"),
        F.when(beta > 0, (mean - rf) / beta * YEAR).otherwise(0.0).alias("treynor_ratio"),
        F.when(track > 0, (mean - bench) * YEAR / track).otherwise(0.0).alias("information_ratio"),
        F.pow(S.corr("r", "b"), 2).alias("r_squared"),
        up.alias("upside_capture"),
        low.alias("downside_capture"),
        F.when(low != 0, up / low).alias("capture_ratio"),
    )


def stability(df: DataFrame, value: str = "close", by=BY) -> DataFrame:
    """R squared of the equity of 1 against time."""
    x = S.numbered(returns(df, value, by), by)
    x = x.withColumn("equity", F.product(1 + F.col("r")).over(S.so_far(by)))
    return x.groupBy(*by).agg(F.regr_r2("equity", "idx").alias("stability"))


def value_at_risk(r: DataFrame, level: float = 0.95, by=BY) -> DataFrame:
    """Historical and normal VaR and the mean loss beyond, in percent and positive; 0 for under 3 returns."""
    q = 1 - level
    z = NormalDist().inv_cdf(q)
    cut = r.groupBy(*by).agg(F.percentile("r", F.lit(q)).alias("_q"))
    x = r.join(cut, list(by))
    some = F.count("r") >= 3
    return x.groupBy(*by).agg(
        F.when(some, F.abs(F.max("_q")) * 100).otherwise(0.0).alias("var_historical"), F.when(some, F.abs(F.avg("r") + z * F.stddev_samp("r")) * 100).otherwise(0.0).alias("var_parametric"), F.when(some, F.abs(F.avg(F.when(F.col("r") <= F.col("_q"), F.col("r")))) * 100).otherwise(0.0).alias("cvar")
    )


# fixed values: falls of markets
SCENARIOS = {
    "2008 financial crisis": -0.50,
    "2020 pandemic": -0.35,
    "dot-com bubble": -0.45,
    "flash crash": -0.10,
    "moderate correction": -0.15,
    "severe correction": -0.25,
}


def stress_test(r: DataFrame, scenarios: dict[str, float] = SCENARIOS, by=BY) -> DataFrame:
    """Value after each fall, and the years in which the mean gain of rising days makes up for it (over 20 returns)."""
    mean = r.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(F.col("r") > 0, F.col("r"))).alias("gain"))
    falls = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("drop")) for k, v in scenarios.items()]))
    x = mean.withColumn("s", falls).select(*by, "s.scenario", "s.drop", "n", "gain")
    return x.select(
        *by,
        "scenario",
        "drop",
        (1 + F.col("drop")).alias("new_value"),
        F.when((F.col("n") > 20) & (F.col("gain") > 0), -F.col("drop") / (1 + F.col("drop")) / F.col("gain") / YEAR).alias(
            "recovery_years"
        ),
    )


def kelly(win_rate: Column, ratio: Column, adjust: float = 0.5) -> Column:
    """Share of capital to risk; 0 for a win rate that is not between 0 and 1."""
    f = adjust * (win_rate * ratio - (1 - win_rate)) / ratio
    return F.when((win_rate > 0) & (win_rate < 1) & (ratio > 0), F.greatest(f, F.lit(0.0))).otherwise(0.0)


def position_sizing(made: DataFrame, capital: float = 10_000.0, risk_pct: float = 2.0, by=BY) -> DataFrame:
    """What trades would have made with a fixed share of capital at risk: sizes, return, drawdown and Kelly share."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("trade")
    rows = made.withColumn("_g", 1 + F.lit(risk_pct / 100) * F.col("pnl_pct") / 100)
    rows = rows.withColumn("after", capital * F.product("_g").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "before", F.coalesce(F.lag("after").over(w), F.lit(capital))
    )
    rows = rows.withColumn("stake", F.col("before") * risk_pct / 100).withColumn(
        "peak", F.greatest(F.max("after").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(capital))
    )
    win = F.avg((F.col("pnl") > 0).cast("double"))
    ratio = F.avg(F.when(F.col("pnl") > 0, F.col("pnl_pct"))) / -F.avg(F.when(F.col("pnl") < 0, F.col("pnl_pct")))
    return rows.groupBy(*by).agg(
        F.avg("stake").alias("avg_size"),
        F.max("stake").alias("max_size"),
        F.min("stake").alias("min_size"),
        ((F.max_by("after", "trade") / capital - 1) * 100).alias("roi_pct"),
        F.max((F.col("peak") - F.col("after")) / F.col("peak") * 100).alias("max_drawdown_pct"),
        F.coalesce(kelly(win, ratio), F.lit(0.0)).alias("kelly"),
    )


def pairs(r: DataFrame, name: str = "market") -> DataFrame:
    """Rows of two different series at a time, each pair once: a below b, x and y.

    The series of a time meet in one array, so returns are shuffled once, by time.
    """
    at = r.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col("r").alias("v")))).alias("s"))
    rows = at.select("s", F.posexplode("s").alias("i", "l"))
    rows = rows.select("l", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("h"))
    return rows.select(F.col("l.k").alias("a"), F.col("h.k").alias("b"), F.col("l.v").alias("x"), F.col("h.v").alias("y"))


def correlation_matrix(r: DataFrame, name: str = "market") -> DataFrame:
    """corr, cov and n of all ordered pairs of series, and of each with itself; a pair is counted once and mirrored."""
    figures = lambda x, y: [S.corr(x, y).alias("corr"), F.covar_samp(x, y).alias("cov"), F.count("*").alias("n")]
    two = pairs(r, name).groupBy("a", "b").agg(*figures("x", "y"))
    sides = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = two.select(sides.alias("s"), "corr", "cov", "n").select("s.a", "s.b", "corr", "cov", "n")
    own = r.groupBy(F.col(name).alias("a")).agg(*figures("r", "r")).select("a", F.col("a").alias("b"), "corr", "cov", "n")
    return both.unionByName(own)


def risk_contribution(r: DataFrame, name: str = "market") -> DataFrame:
    """Equal weights over the times that all series have: marginal, component and percentage contributions (annual)."""
    k = r.select(name).distinct().count()
    if k < 2:
        raise ValueError("at least two series are needed")
    common = r.groupBy("ts").agg(F.count_distinct(name).alias("_k")).filter(F.col("_k") == k).select("ts")
    cov = correlation_matrix(r.join(common, "ts"), name).withColumn("cov", F.col("cov") * YEAR)
    marginal = cov.groupBy("a").agg((F.sum("cov") / k).alias("m"))
    total = marginal.agg(F.sqrt(F.sum("m") / k).alias("vol"))
    out = marginal.join(F.broadcast(total))  # one row
    mcr = F.col("m") / F.col("vol")
    return out.select(
        F.col("a").alias(name),
        F.col("vol").alias("portfolio_volatility"),
        mcr.alias("marginal"),
        (mcr / k).alias("component"),
        (mcr / k / F.col("vol") * 100).alias("percentage"),
    )


def rolling_risk(r: DataFrame, b: DataFrame, window: int = 60, by=BY) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, deepest drawdown, beta, alpha, R squared, VaR and win rate of every full window."""
    x = r.join(b, "ts")
    w = S.last_rows(window, by)
    mean, std = F.avg("r").over(w), F.stddev_samp("r").over(w)
    down = F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).over(w)
    beta = F.try_divide(F.covar_samp("r", "b").over(w), F.var_samp("b").over(w))
    root = F.sqrt(F.lit(YEAR))
    out = x.select(
        *by,
        "ts",
        (F.count("r").over(w) >= window).alias("_full"),
        (mean * YEAR).alias("annual_return"),
        (std * root).alias("volatility"),
        F.when(std > 0, mean / std * root).alias("sharpe"),
        F.when(down > 0, mean / down * root).alias("sortino"),
        (_deepest(F.collect_list("r").over(w)) * 100).alias("max_drawdown"),
        beta.alias("beta"),
        ((mean - beta * F.avg("b").over(w)) * YEAR).alias("alpha"),
        F.pow(S.corr("r", "b", w), 2).alias("r_squared"),
        F.percentile("r", F.lit(0.05)).over(w).alias("var_95"),
        F.avg((F.col("r") > 0).cast("double")).over(w).alias("win_rate"),
    )
    return out.filter("_full").drop("_full")


def value_at_risk_bootstrap(r: DataFrame, draws: int = 10_000, level: float = 0.95, seed: int = 7, by=BY) -> DataFrame:
    """VaR in percent of returns drawn with replacement, by a generator that gives the same draws again."""
    from . import simulate

    x = simulate.bootstrap(r, "r", "ts", draws, 1, seed, by)
    return x.groupBy(*by).agg((F.abs(F.percentile("x", F.lit(1 - level))) * 100).alias("var_bootstrap"))
