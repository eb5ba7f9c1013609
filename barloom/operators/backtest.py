"""Backtests as a plan.

With signals of -1, 0 and 1 a position is open during one run of a signal, from the run's first bar until a stop or a
target is touched or the run ends. So a trade is a run, its exit the first of the bars behind the entry (and the one
that ends the run) on which something closes it; money compounds as a running product. There is no loop over bars, and
no join: a bar knows its run's entry, how many closes came before it and what they made of the capital from windows
that all have one partitioning and order, so a series is shuffled and sorted once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as S

BY = S.BY


@dataclass(frozen=True)
class Terms:
    """Money and costs; percentages are of 100. size_pct, stop and target may be names of columns."""

    capital: float = 10_000.0
    size_pct: float | str = 10.0
    stop_pct: float | str | None = None
    target_pct: float | str | None = None
    commission_pct: float = 0.1
    slippage_pct: float = 0.05


def _value(x: float | str | None) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x).cast("double")


def _played(bars: DataFrame, terms: Terms, by=BY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every bar with its mark and the trades that end on it.

    Columns: by, idx, ts, close, ``equity`` and ``unrealized_pnl`` before the bar's trading, ``made`` (one trade that
    the bar closes and, on a series' last bar, the one still open) and ``peak``, the greatest value until the bar
    before.
    """
    slip, comm = terms.slippage_pct / 100, terms.commission_pct / 100
    w, so_far = S.order(by), S.so_far(by)
    before = lambda c: F.lag(c).over(w)
    rows = S.numbered(bars.withColumn("signal", F.coalesce("signal", F.lit(0)).cast("int")), by)
    rows = rows.withColumn("_start", (F.col("idx") == 0) | (F.col("signal") != before("signal")))
    way = F.col("signal")
    price = F.col("close") * (1 + slip * way)
    enters = F.col("_start") & (F.col("idx") >= 1) & (way != 0)
    entry = F.struct(
        F.col("idx").alias("entry_idx"),
        F.col("ts").alias("entry_time"),
        way.alias("direction"),
        price.alias("entry_price"),
        (price * (1 + comm * way)).alias("entry_eff"),
        _value(terms.size_pct).alias("_size_pct"),
    )
    rows = rows.withColumns(
        {
            "_new": F.when(enters, entry),
            "_runs": F.sum(F.col("_start").cast("long")).over(so_far),
            "_trades": F.sum(enters.cast("long")).over(so_far),
            "_last": F.lead("idx").over(w).isNull(),
        }
    )
    # the entry of the bar's run, null if the run opens no trade
    rows = rows.withColumn(
        "_entry",
        F.last(F.when(F.col("_start"), F.struct(F.col("_new").alias("e"), F.col("_trades").alias("trade"), F.col("_runs").alias("run"))), ignorenulls=True).over(so_far),
    )
    eff = F.col("_entry.e.entry_eff")
    rows = rows.withColumn(
        "_levels",
        F.when(
            F.col("_entry.e").isNotNull(),
            F.struct(
                F.col("_entry"),
                (eff * (1 - _value(terms.stop_pct) / 100 * way)).alias("stop"),
                (eff * (1 + _value(terms.target_pct) / 100 * way)).alias("target"),
            ),
        ),
    )
    # each bar may close the trade of the bar before it
    rows = rows.withColumn("_held", before("_levels"))
    long = F.col("_held._entry.e.direction") == 1
    stopped = F.when(long, F.col("low") <= F.col("_held.stop")).otherwise(F.col("high") >= F.col("_held.stop"))
    reached = F.when(long, F.col("high") >= F.col("_held.target")).otherwise(F.col("low") <= F.col("_held.target"))
    rows = rows.withColumn(
        "_why",
        F.when(F.col("_held").isNotNull(), F.when(stopped, "STOP_LOSS").when(reached, "TAKE_PROFIT").when(F.col("_start"), "SIGNAL")),
    )
    # closes up to the bar, and up to the start of its run: the first one behind the start counts
    rows = rows.withColumn("_n", F.count("_why").over(so_far))
    rows = rows.withColumn("_n0", F.last(F.when(F.col("_start"), F.col("_n")), ignorenulls=True).over(so_far))
    rows = rows.withColumn("_open", F.col("_held").isNotNull() & (before("_n") == before("_n0")))
    rows = rows.withColumn("_why", F.when(F.col("_open"), F.col("_why")))
    level = (
        F.when(F.col("_why") == "STOP_LOSS", F.col("_held.stop"))
        .when(F.col("_why") == "TAKE_PROFIT", F.col("_held.target"))
        .otherwise(F.col("close"))
    )

    def growth(e: Column, exit_price: Column) -> Column:
        return 1 + e["_size_pct"] / 100 * e["direction"] * (exit_price - e["entry_eff"]) / e["entry_price"]

    held = F.col("_held._entry.e")
    slipped = F.when(F.col("_why") == "TAKE_PROFIT", level).otherwise(level * (1 - slip * held["direction"]))
    rows = rows.withColumn("_exit", F.when(F.col("_why").isNotNull(), slipped - slipped * comm * held["direction"]))
    rows = rows.withColumn("_after", F.lit(terms.capital) * F.product(F.coalesce(growth(held, F.col("_exit")), F.lit(1.0))).over(so_far))
    rows = rows.withColumn("_before", F.coalesce(before("_after"), F.lit(terms.capital)))
    size = F.col("_before") * held["_size_pct"] / 100 / held["entry_price"]
    mark = F.when(F.col("_open"), (F.col("close") - held["entry_eff"]) * held["direction"] * size).otherwise(0.0)
    rows = rows.withColumn("unrealized_pnl", mark).withColumn("equity", F.col("_before") + F.col("unrealized_pnl"))

    def trade(own: Column, why: Column, at: Column, cash: Column, after: Column) -> Column:
        e = own["e"]
        n = cash * e["_size_pct"] / 100 / e["entry_price"]
        pnl = (at - e["entry_eff"]) * e["direction"] * n
        figures = [
            own["run"].alias("run"),
            *[e[c].alias(c) for c in ("entry_idx", "entry_time", "direction", "entry_price", "entry_eff", "_size_pct")],
            F.col("idx").alias("exit_idx"),
            F.col("ts").alias("exit_time"),
            why.alias("exit_reason"),
            at.alias("exit_price"),
        ]
        return F.struct(
            *figures,
            own["trade"].alias("trade"),
            after.alias("capital_after"),
            cash.alias("capital_before"),
            n.alias("size"),
            pnl.alias("pnl"),
            ((at / e["entry_eff"] - 1) * 100 * e["direction"]).alias("pnl_pct"),
        )

    closed = F.when(
        F.col("_why").isNotNull(), trade(F.col("_held._entry"), F.col("_why"), F.col("_exit"), F.col("_before"), F.col("_after"))
    )
    # a trade that nothing closes ends at the last close without costs
    still = F.col("_last") & F.col("_entry.e").isNotNull() & (F.col("_n") == F.col("_n0"))
    ended = F.when(
        still,
        trade(
            F.col("_entry"),
            F.lit("END_OF_BACKTEST"),
            F.col("close"),
            F.col("_after"),
            F.col("_after") * growth(F.col("_entry.e"), F.col("close")),
        ),
    )
    rows = rows.withColumn("made", F.array_compact(F.array(closed, ended)))
    top = F.greatest(F.when(F.col("idx") >= 1, F.col("equity")), F.array_max(F.transform("made", lambda t: t["capital_after"])))
    peak = F.max(top).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("peak", F.greatest(peak, F.lit(terms.capital))).select(
        *by, "idx", "ts", "close", "equity", "unrealized_pnl", "made", "peak", *keep
    )


def trades(bars: DataFrame, terms: Terms = Terms(), by=BY) -> DataFrame:
    """Trades of bars with a column ``signal`` (null counts as 0), in the order ``trade`` of each series.

    The bar that begins a run other than the series' first bar opens a trade; stops are looked at before targets, and
    both before the signal. A trade that nothing closes ends at the last close without costs.
    """
    out = _played(bars, terms, by).select(*by, F.explode("made").alias("t")).select(*by, "t.*")
    return out.withColumnRenamed("_size_pct", terms.size_pct) if isinstance(terms.size_pct, str) and terms.size_pct not in by else out.drop(
        "_size_pct"
    )


def equity(bars: DataFrame, terms: Terms = Terms(), by=BY) -> DataFrame:
    """Equity before each bar's trading, from the second bar on: closed trades and the open one at the bar's close.

    Columns: by, idx, ts, equity, unrealized_pnl.
    """
    return _played(bars, terms, by).filter("idx >= 1").select(*by, "idx", "ts", "equity", "unrealized_pnl")


def drawdown_marks(bars: DataFrame, terms: Terms = Terms(), by=BY) -> DataFrame:
    """Equity marks and capital after each close in the order in which they happen, with peak and drawdown percent."""
    own = F.when(
        F.col("idx") >= 1, F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("trade"), F.col("equity").alias("value")))
    )
    closes = F.transform("made", lambda t: F.struct(F.lit(1).alias("kind"), t["trade"].alias("trade"), t["capital_after"].alias("value")))
    rows = _played(bars, terms, by).withColumn("_x", F.concat(F.coalesce(own, F.filter(closes, lambda x: F.lit(False))), closes))
    rows = rows.select(*by, "idx", "ts", "peak", "_x", F.posexplode("_x").alias("_i", "x"))
    peak = F.greatest("peak", F.array_max(F.transform(F.slice("_x", F.lit(1), F.col("_i") + 1), lambda x: x["value"])))
    rows = rows.withColumn("peak", peak).select(*by, "idx", "ts", "x.kind", "x.trade", "x.value", "peak")
    return rows.withColumn("drawdown", (F.col("peak") - F.col("value")) / F.col("peak") * 100)


def metrics(bars: DataFrame, terms: Terms = Terms(), by=BY) -> DataFrame:
    """One row a series with 13 figures, as all zeros where nothing was traded; profit_factor is null without losses.

    One aggregate over the played bars: days without a mark count as unchanged in the Sharpe ratio.
    """
    w, day = S.order(by), F.to_date("ts")
    rows = _played(bars, terms, by).filter("idx >= 1")
    # the day's last mark against that of the day with marks before it
    rows = rows.withColumn("_ends", F.coalesce(F.lead(day).over(w) != day, F.lit(True)))
    rows = rows.withColumn(
        "_prev",
        F.last(F.when(F.col("_ends"), F.struct("equity", day.alias("day"))), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)
        ),
    )
    r = F.when(F.col("_ends"), F.col("equity") / F.col("_prev.equity") - 1)
    gap = F.when(F.col("_ends"), F.coalesce(F.datediff(day, F.col("_prev.day")), F.lit(0)))
    down = (F.greatest("peak", "equity") - F.col("equity")) / F.greatest("peak", "equity") * 100
    # a close comes behind its bar's mark and, on the last bar, behind the close before it
    high = lambda c: F.greatest("peak", "equity", *c)
    fell = lambda c: (high(c) - c[-1]) / high(c) * 100
    first, second = (F.get("made", F.lit(i))["capital_after"] for i in (0, 1))
    rows = rows.withColumns({"_r": r, "_gap": gap, "_down": F.greatest(down, fell([first]), fell([first, second]))})
    rows = rows.select(*by, "ts", "_r", "_gap", "_down", F.posexplode_outer("made").alias("_i", "t"))
    once = F.coalesce(F.col("_i") == 0, F.lit(True))
    pnl = F.col("t.pnl")
    win, loss = pnl > 0, pnl < 0
    rate = F.when(once, F.col("_r"))
    agg = rows.groupBy(*by).agg(
        S.floor_days(F.min("ts"), F.max("ts")).alias("days"),
        F.max("_down").alias("max_drawdown"),
        F.sum(F.when(once, F.col("_gap"))).alias("_n"),
        F.sum(rate).alias("_s"),
        F.sum(rate * rate).alias("_q"),
        (F.max_by("t.capital_after", "t.trade") / terms.capital - 1).alias("growth"),
        F.avg(win.cast("double")).alias("win_rate"),
        F.count("t").alias("total_trades"),
        F.sum(win.cast("long")).alias("profitable_trades"),
        F.coalesce(F.avg(F.when(win, pnl)), F.lit(0.0)).alias("avg_profit_trade"),
        F.coalesce(F.avg(F.when(loss, pnl)), F.lit(0.0)).alias("avg_loss_trade"),
        F.coalesce(F.max(F.when(win, pnl)), F.lit(0.0)).alias("largest_win"),
        F.coalesce(F.min(F.when(loss, pnl)), F.lit(0.0)).alias("largest_loss"),
        F.avg(S.hours("t.entry_time", "t.exit_time")).alias("avg_trade_duration_hours"),
        (F.sum(F.when(win, pnl).otherwise(0.0)) / F.sum(F.when(loss, -pnl))).alias("profit_factor"),
    )
    n, s, q = F.col("_n"), F.col("_s"), F.col("_q")
    # a day without a mark is a return of 0: it counts in the moments and adds nothing to the sums
    std = F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
    out = agg.withColumn("sharpe_ratio", F.when((n > 1) & (std > 1e-12), F.sqrt(F.lit(252.0)) * (s / n) / std).otherwise(0.0))
    traded = F.col("total_trades") > 0
    out = out.withColumn("total_return_pct", F.col("growth") * 100).withColumn(
        "annualized_return_pct", F.when(F.col("days") > 0, (F.pow(1 + F.col("growth"), 365 / F.col("days")) - 1) * 100).otherwise(0.0)
    )
    zero = [
        "total_return_pct",
        "annualized_return_pct",
        "win_rate",
        "max_drawdown",
        "sharpe_ratio",
        "total_trades",
        "profitable_trades",
        "avg_profit_trade",
        "avg_loss_trade",
        "largest_win",
        "largest_loss",
        "avg_trade_duration_hours",
    ]
    kinds = {"total_trades": "long", "profitable_trades": "long"}
    return out.select(
        *by,
        *[F.when(traded, F.col(c)).otherwise(0).cast(kinds.get(c, "double")).alias(c) for c in zero],
        F.when(traded, F.col("profit_factor")).otherwise(0.0).alias("profit_factor"),
    )


def excursions(bars: DataFrame, terms: Terms = Terms(), by=BY) -> DataFrame:
    """trades with the deepest adverse and the largest favourable excursion of the bars that held them, in percent of
    the effective entry price; 0 where no bar went that way."""
    rows = _played(bars, terms, by, keep=("high", "low", "_open", "_held"))
    e = F.col("_held._entry.e")
    lower, upper = (e["entry_eff"] - F.col("low")) / e["entry_eff"] * 100, (F.col("high") - e["entry_eff"]) / e["entry_eff"] * 100
    long = e["direction"] == 1
    worst, best = F.max(F.when(long, lower).otherwise(upper)), F.max(F.when(long, upper).otherwise(lower))
    found = rows.filter("_open").groupBy(*by, F.col("_held._entry.run").alias("run")).agg(
        F.greatest(worst, F.lit(0.0)).alias("mae_pct"), F.greatest(best, F.lit(0.0)).alias("mfe_pct")
    )
    return trades(bars, terms, by).join(found, [*by, "run"], "left").fillna(0.0, ["mae_pct", "mfe_pct"])


def panel(bars: DataFrame, terms: Terms = Terms(), by=BY) -> DataFrame:
    """A frame to draw a backtest from: every bar's close, the trades that open and close on it (direction and reason,
    null if none), equity, peak and drawdown in percent."""
    rows = _played(bars, terms, by)
    closes = F.get("made", F.lit(0))
    rows = rows.withColumn("peak", F.greatest("peak", "equity"))
    marks = rows.select(
        *by,
        "idx",
        "ts",
        "close",
        F.when(F.col("idx") >= 1, F.col("equity")).alias("equity"),
        F.when(F.col("idx") >= 1, (F.col("peak") - F.col("equity")) / F.col("peak") * 100).alias("drawdown"),
        closes["exit_reason"].alias("exit_reason"),
    )
    opened = rows.select(*by, F.explode("made").alias("t")).select(
        *by, F.col("t.entry_idx").alias("idx"), F.col("t.direction").alias("entry")
    )
    return marks.join(opened, [*by, "idx"], "left")
