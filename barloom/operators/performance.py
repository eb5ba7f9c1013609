"""Returns, drawdowns and trade statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as S

BY = S.BY


def returns(df: DataFrame, value: str = "close", by=BY) -> DataFrame:
    """by, ts, r; a missing value counts as the one before it, and the first row has no return."""
    filled = df.withColumn("_v", S.padded(value, by))
    return filled.withColumn("r", S.change("_v", 1, by)).filter("r is not null").select(*by, "ts", "r")


def log_returns(df: DataFrame, value: str = "close", by=BY) -> DataFrame:
    """by, ts, r: the logarithm of each value over the one before; a missing value counts as the one before it."""
    filled = df.withColumn("_v", S.padded(value, by))
    return filled.withColumn("r", F.log(F.try_divide(F.col("_v"), S.lag("_v", 1, by)))).filter("r is not null").select(*by, "ts", "r")


def underwater(df: DataFrame, value: str = "equity", by=BY) -> DataFrame:
    """df with ``peak`` so far and ``drawdown`` in percent, 0 or below."""
    df = df.withColumn("peak", F.max(value).over(S.so_far(by)))
    return df.withColumn("drawdown", (F.col(value) - F.col("peak")) / F.col("peak") * 100)


def drawdown_periods(df: DataFrame, value: str = "equity", deeper_than: float = 1.0, by=BY) -> DataFrame:
    """Spells under water deeper than a percentage: begin, end (the bar of recovery, null if none), trough, lengths."""
    rows = underwater(df, value, by)
    rows = S.runs(rows.withColumn("_under", F.col("drawdown") < 0), "_under", "_spell", by)
    last = F.max("ts").over(S.whole(by))
    rows = rows.withColumn("_last", last)
    spells = rows.groupBy(*by, "_spell", "_under").agg(
        F.min("ts").alias("start_ts"),
        F.min("drawdown").alias("max_drawdown_pct"),
        F.min_by("ts", F.struct("drawdown", "ts")).alias("trough_ts"),
        F.max("_last").alias("_last"),
    )
    # the spell behind one under water begins on its bar of recovery
    spells = spells.withColumn("end_ts", F.lead("start_ts").over(Window.partitionBy(*by).orderBy("_spell")))
    spells = spells.filter(F.col("_under") & (F.col("max_drawdown_pct") < -deeper_than))
    return spells.select(
        *by, "start_ts", "end_ts", "trough_ts", "max_drawdown_pct", S.floor_days("start_ts", F.coalesce("end_ts", "_last")).alias("duration_days"), F.when(F.col("end_ts").isNotNull(), S.floor_days("trough_ts", "end_ts")).alias("recovery_days")
    )


def drawdown_summary(df: DataFrame, value: str = "equity", by=BY) -> DataFrame:
    """Depth and length figures over all spells deeper than 1 %, ulcer and pain index, Sterling and Burke ratios.

    The current drawdown's days are those since the latest peak. Time to recovery (days) and recovery factor (yearly
    return over depth) are of the deepest spell, 0 if it has not ended.
    """
    rows = underwater(df, value, by).withColumn("_top", F.when(F.col("drawdown") >= 0, F.col("ts")))
    years = S.floor_days(F.min("ts"), F.max("ts")) / 365
    growth = F.max_by(value, "ts") / F.min_by(value, "ts")
    base = rows.groupBy(*by).agg(
        F.sqrt(F.avg(F.pow(F.col("drawdown") / 100, 2))).alias("_u"),
        F.coalesce(F.avg(F.when(F.col("drawdown") < 0, -F.col("drawdown"))), F.lit(0.0)).alias("pain_index"),
        F.max_by("drawdown", "ts").alias("_now"),
        S.floor_days(F.max("_top"), F.max("ts")).alias("_days"),
        F.when(years > 0, (F.pow(growth, 1 / years) - 1) * 100).otherwise(0.0).alias("annual_return_pct"),
    )
    spells = drawdown_periods(df, value, 1.0, by)
    ranked = spells.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("max_drawdown_pct", "start_ts")))
    found = ranked.groupBy(*by).agg(
        F.count("*").alias("n_periods"),
        (-F.min("max_drawdown_pct")).alias("max_drawdown_pct"),
        F.avg("max_drawdown_pct").alias("avg_drawdown_pct"),
        F.max("duration_days").alias("max_duration_days"),
        F.avg("duration_days").alias("avg_duration_days"),
        F.max(F.when(F.col("_rank") == 1, F.col("recovery_days"))).alias("_recovered"),
        F.avg(F.when(F.col("_rank") <= 3, -F.col("max_drawdown_pct"))).alias("_worst"),
        F.sqrt(F.sum(F.pow("max_drawdown_pct", F.lit(2)))).alias("_square"),
    )
    out = base.join(found, list(by), "left").fillna(0, ["n_periods"])
    ratio = lambda x: F.when(x > 0, F.col("annual_return_pct") / x)
    return out.select(
        *by,
        "n_periods",
        "max_drawdown_pct",
        "avg_drawdown_pct",
        "max_duration_days",
        "avg_duration_days",
        (100 * F.col("_u")).alias("ulcer_index"),
        "pain_index",
        (-F.col("_now")).alias("current_drawdown_pct"),
        F.when(F.col("_now") < 0, F.col("_days")).otherwise(0).alias("current_duration_days"),
        F.coalesce("_recovered", F.lit(0)).cast("long").alias("time_to_recovery_days"),
        F.when(F.col("_recovered").isNotNull(), ratio(F.col("max_drawdown_pct"))).otherwise(0.0).alias("recovery_factor"),
        ratio(F.col("max_drawdown_pct")).alias("calmar_ratio"),
        ratio(F.col("_worst")).alias("sterling_ratio"),
        ratio(F.col("_square")).alias("burke_ratio"),
    )


def drawdown_table(df: DataFrame, value: str = "equity", by=BY) -> DataFrame:
    """All spells under water however shallow, the worst as number 1, with the columns of drawdown_periods."""
    spells = drawdown_periods(df, value, 0.0, by)
    return spells.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("max_drawdown_pct", "start_ts")).cast("long"))


def drawdown_totals(df: DataFrame, value: str = "equity", by=BY) -> DataFrame:
    """Over all spells however shallow: number, depth (deepest, mean, median), length, and the bars under water."""
    rows = underwater(df, value, by).groupBy(*by).agg(
        F.sum((F.col("drawdown") < 0).cast("long")).alias("underwater_days"),
        (F.avg((F.col("drawdown") < 0).cast("double")) * 100).alias("underwater_pct"),
    )
    depth, length = F.col("max_drawdown_pct"), F.col("duration_days")
    spells = drawdown_periods(df, value, 0.0, by).groupBy(*by).agg(
        F.count("*").alias("total_drawdowns"),
        F.min(depth).alias("max_drawdown_pct"),
        F.avg(depth).alias("avg_drawdown_pct"),
        F.median(depth).alias("median_drawdown_pct"),
        F.avg(length).alias("avg_duration_days"),
        F.max(length).alias("max_duration_days"),
    )
    return rows.join(spells, list(by), "left").fillna(0, [c for c in spells.columns if c not in by])


def monthly(r: DataFrame, by=BY) -> DataFrame:
    """Sums of simple returns by month, empty months 0: by, month (its first day), r."""
    sums = r.groupBy(*by, F.to_date(F.date_trunc("month", "ts")).alias("month")).agg(F.sum("r").alias("r"))
    ends = sums.groupBy(*by).agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    every = ends.select(*by, F.explode(F.expr("sequence(_a, _b, interval 1 month)")).alias("month"))
    return every.join(sums, [*by, "month"], "left").fillna(0.0, ["r"])


def return_stats(df: DataFrame, value: str = "close", by=BY) -> DataFrame:
    """Totals, means, volatilities, best and worst, and shares of profitable days and months, in percent."""
    r = returns(df, value, by)
    years = S.floor_days(F.min("ts"), F.max("ts")) / 365
    total = F.max_by(value, "ts") / F.min_by(value, "ts")
    base = df.groupBy(*by).agg(
        ((total - 1) * 100).alias("total_return_pct"),
        F.when(years > 0, (F.pow(total, 1 / years) - 1) * 100).otherwise(0.0).alias("annual_return_pct"),
    )
    d = r.groupBy(*by).agg(
        (F.avg("r") * 100).alias("daily_return_pct"),
        (F.stddev_samp("r") * 100).alias("volatility_daily_pct"),
        (F.stddev_samp("r") * 100 * F.sqrt(F.lit(252.0))).alias("volatility_annual_pct"),
        F.coalesce(F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))) * 100 * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias(
            "downside_volatility_pct"
        ),
        (F.max("r") * 100).alias("best_day_pct"),
        (F.min("r") * 100).alias("worst_day_pct"),
        (F.avg((F.col("r") > 0).cast("double")) * 100).alias("pct_profitable_days"),
        F.count("*").alias("trading_days"),
    )
    m = monthly(r, by).groupBy(*by).agg(
        (F.avg("r") * 100).alias("monthly_return_pct"),
        (F.stddev_samp("r") * 100).alias("volatility_monthly_pct"),
        (F.max("r") * 100).alias("best_month_pct"),
        (F.min("r") * 100).alias("worst_month_pct"),
        (F.avg((F.col("r") > 0).cast("double")) * 100).alias("pct_profitable_months"),
        F.coalesce(F.avg(F.when(F.col("r") > 0, F.col("r"))) * 100, F.lit(0.0)).alias("avg_up_month_pct"),
        F.coalesce(F.avg(F.when(F.col("r") < 0, F.col("r"))) * 100, F.lit(0.0)).alias("avg_down_month_pct"),
    )
    return base.join(d, list(by)).join(m, list(by))


def streaks(made: DataFrame, by=BY) -> DataFrame:
    """Longest and current runs of winning and losing trades; a trade without gain or loss breaks them."""
    rows = made.withColumn("_sign", F.signum("pnl").cast("int")).withColumn("ts", F.col("trade"))
    runs = S.runs(rows, "_sign", "_run", by).groupBy(*by, "_run", "_sign").agg(F.count("*").alias("n"))
    final = F.max_by(F.struct("_sign", "n"), "_run")
    longest = lambda s: F.coalesce(F.max(F.when(F.col("_sign") == s, F.col("n"))), F.lit(0)).cast("long")
    out = runs.groupBy(*by).agg(longest(1).alias("max_win_streak"), longest(-1).alias("max_loss_streak"), final.alias("_f"))
    now = lambda s: F.when(F.col("_f._sign") == s, F.col("_f.n")).otherwise(0).cast("long")
    return out.select(*by, "max_win_streak", "max_loss_streak", now(1).alias("current_wins"), now(-1).alias("current_losses"))


def trade_stats(made: DataFrame, by=BY) -> DataFrame:
    """Counts, averages and rates (percent) of trades; profit_factor is null without losses."""
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    held = S.hours("entry_time", "exit_time")
    part = lambda c, x: F.coalesce(F.avg(F.when(c, x)), F.lit(0.0))
    way = lambda d, c=F.lit(True): F.sum(((F.col("direction") == d) & c).cast("long"))
    out = made.groupBy(*by).agg(
        F.count("*").alias("total_trades"),
        F.sum(win.cast("long")).alias("winning_trades"),
        F.sum(loss.cast("long")).alias("losing_trades"),
        F.sum((F.col("pnl") == 0).cast("long")).alias("breakeven_trades"),
        (F.avg(win.cast("double")) * 100).alias("win_rate"),
        (F.sum(F.when(win, F.col("pnl")).otherwise(0.0)) / F.sum(F.when(loss, -F.col("pnl")))).alias("profit_factor"),
        part(win, F.col("pnl")).alias("avg_profit"), part(loss, -F.col("pnl")).alias("avg_loss"),
        F.coalesce(F.max(F.when(win, F.col("pnl"))), F.lit(0.0)).alias("largest_profit"),
        F.coalesce(F.max(F.when(loss, -F.col("pnl"))), F.lit(0.0)).alias("largest_loss"),
        F.avg(held).alias("avg_holding_hours"), part(win, held).alias("avg_profit_hours"), part(loss, held).alias("avg_loss_hours"),
        way(1).alias("long_trades"), way(-1).alias("short_trades"), way(1, win).alias("_lw"), way(-1, win).alias("_sw"), F.sum("pnl").alias(
            "total_profit"
        ),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100).otherwise(0.0)
    out = out.withColumns({"long_win_rate": rate("_lw", "long_trades"), "short_win_rate": rate("_sw", "short_trades")}).drop("_lw", "_sw")
    return out.withColumn("expectancy", F.col("win_rate") / 100 * F.col("avg_profit") - (100 - F.col("win_rate")) / 100 * F.col("avg_loss"))


def trade_breakdown(made: DataFrame, by=BY) -> DataFrame:
    """Trades by exit reason, weekday and hour of entry in one pass: by, kind, key, n."""
    keys = F.array(
        F.struct(F.lit("exit_reason").alias("kind"), F.col("exit_reason").alias("key")),
        F.struct(F.lit("weekday").alias("kind"), F.date_format("entry_time", "EEEE").alias("key")),
        F.struct(F.lit("hour").alias("kind"), F.hour("entry_time").cast("string").alias("key")),
    )
    return made.select(*by, F.explode(keys).alias("k")).groupBy(*by, "k.kind", "k.key").agg(F.count("*").alias("n"))


def rolling(df: DataFrame, value: str = "close", window: int = 60, by=BY) -> DataFrame:
    """Return, volatility, Sharpe (annualised) and deepest drawdown of each full window of returns.

    The drawdown is a fold over the window's values, so work and memory go with rows times window.
    """
    r = df.withColumn("r", S.change(value, 1, by))
    w = S.last_rows(window, by)
    enough = F.count("r").over(w) >= window
    mean, std = F.avg("r").over(w), F.stddev_samp("r").over(w)
    values = F.collect_list(F.col(value)).over(S.last_rows(window + 1, by))
    step = lambda acc, x: F.struct(F.greatest(acc["peak"], x).alias("peak"), F.least(acc["low"], x / F.greatest(acc["peak"], x) - 1).alias("low"))
    deepest = F.aggregate(values, F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("low")), step, lambda acc: -acc["low"] * 100)
    out = r.select(
        *by,
        "ts",
        enough.alias("_full"),
        (F.col(value) / S.lag(value, window, by) - 1).alias("rolling_return"),
        (std * F.sqrt(F.lit(252.0))).alias("rolling_volatility"),
        F.when(std > 0, mean / std * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("rolling_sharpe"),
        deepest.alias("rolling_max_drawdown"),
    )
    return out.filter("_full").drop("_full")


def unbiased_skew(g1: Column, n: Column) -> Column:
    return g1 * F.sqrt(n * (n - 1)) / (n - 2)


def unbiased_kurtosis(g2: Column, n: Column) -> Column:
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def report(df: DataFrame, made: DataFrame | None = None, value: str = "equity", by=BY) -> DataFrame:
    """One nested row a series: returns, drawdowns, risk and, where trades are given, trades and streaks.

    ``by`` may name a strategy: curves of several strategies are compared by giving them as series.
    """
    from . import risk

    parts = {
        "returns": return_stats(df, value, by),
        "drawdowns": drawdown_summary(df, value, by),
        "risk": risk.risk_metrics(returns(df, value, by), by=by),
    }
    if made is not None:
        parts |= {"trades": trade_stats(made, by), "streaks": streaks(made, by)}
    out = df.select(*by).distinct()
    for name, frame in parts.items():
        out = out.join(frame.select(*by, F.struct(*[c for c in frame.columns if c not in by]).alias(name)), list(by), "left")
    return out


def current_drawdown(df: DataFrame, value: str = "equity", by=BY) -> DataFrame:
    """by, drawdown in percent (positive) and whole days since the latest peak."""
    rows = underwater(df, value, by).withColumn("_at", F.when(F.col("drawdown") >= 0, F.col("ts")))
    return rows.groupBy(*by).agg((-F.max_by("drawdown", "ts")).alias("drawdown_pct"), S.floor_days(F.max("_at"), F.max("ts")).alias("days"))
