"""Trades, money and statistics on small frames with known results, and against a loop over bars."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as K
from barloom.operators import performance as P
from barloom.operators import risk as R

SCHEMA = "market string, ts timestamp_ntz, open double, high double, low double, close double, volume double, signal int"
DAY = dt.datetime(2023, 1, 1)


def frame(spark, closes, signals, market="m", spread=1.0):
    rows = [(market, DAY + dt.timedelta(days=i), float(c), c + spread, c - spread, float(c), 1.0, s) for i, (c, s) in enumerate(zip(closes, signals, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def test_long_and_short_profit(spark):
    free = K.Terms(size_pct=100, commission_pct=0, slippage_pct=0)
    up = K.trades(frame(spark, [90, 100, 110, 110], [0, 1, 0, 0]), free).first()
    assert (up.entry_price, up.exit_price, round(up.pnl_pct, 6), up.exit_reason) == (100.0, 110.0, 10.0, "SIGNAL")
    assert up.pnl == pytest.approx(1000)
    down = K.trades(frame(spark, [90, 100, 90, 90], [0, -1, 0, 0]), free).first()
    assert down.pnl == pytest.approx(1000) and down.direction == -1


def loop(bars, terms):
    """The same rules bar by bar."""
    slip, comm = terms.slippage_pct / 100, terms.commission_pct / 100
    cash, peak, worst, open_, done, marks = terms.capital, terms.capital, 0.0, None, [], []

    def mark(v):
        nonlocal peak, worst
        peak = max(peak, v)
        worst = max(worst, (peak - v) / peak * 100)

    for i, (high, low, close, signal) in enumerate(bars):
        if i == 0:
            prev = signal
            continue
        value = cash + ((close - open_["eff"]) * open_["d"] * open_["size"] if open_ else 0)
        marks.append(value)
        mark(value)
        if open_:
            d, why, px = open_["d"], None, close
            if terms.stop_pct is not None and (low <= open_["stop"] if d == 1 else high >= open_["stop"]):
                why, px = "STOP_LOSS", open_["stop"]
            elif terms.target_pct is not None and (high >= open_["target"] if d == 1 else low <= open_["target"]):
                why, px = "TAKE_PROFIT", open_["target"]
            elif signal != prev:
                why = "SIGNAL"
            if why:
                px = px if why == "TAKE_PROFIT" else px * (1 - slip * d)
                px -= px * comm * d
                cash += (px - open_["eff"]) * d * open_["size"]
                mark(cash)
                done.append((why, px, cash))
                open_ = None
        if not open_ and signal != 0 and signal != prev:
            px = close * (1 + slip * signal)
            eff = px * (1 + comm * signal)
            open_ = {
                "d": signal,
                "eff": eff,
                "size": cash * terms.size_pct / 100 / px,
                "stop": eff * (1 - (terms.stop_pct or 0) / 100 * signal),
                "target": eff * (1 + (terms.target_pct or 0) / 100 * signal),
            }
        prev = signal
    if open_:
        cash += (close - open_["eff"]) * open_["d"] * open_["size"]
        mark(cash)
        done.append(("END_OF_BACKTEST", close, cash))
    return done, marks, worst


@pytest.mark.parametrize("stop,target", [(None, None), (2.0, 3.0), (1.0, None)])
def test_against_a_loop(spark, stop, target):
    rnd = random.Random(3)
    terms = K.Terms(stop_pct=stop, target_pct=target)
    rows, want = [], {}
    for m in range(12):
        px, bars = 100.0, []
        for i in range(60):
            px *= 1 + rnd.gauss(0, 0.02)
            signal = rnd.choice([0, 0, 1, 1, -1]) if rnd.random() < 0.5 or i == 0 else bars[-1][3]
            bars.append((px * (1 + rnd.random() * 0.02), px * (1 - rnd.random() * 0.02), px, signal))
            rows.append((str(m), DAY + dt.timedelta(days=i), px, bars[-1][0], bars[-1][1], px, 1.0, signal))
        want[str(m)] = loop(bars, terms)
    df = spark.createDataFrame(rows, SCHEMA)
    made = K.trades(df, terms).cache()
    marks = K.equity(df, terms)
    for m, (done, values, worst) in want.items():
        got = made.filter(F.col("market") == m).orderBy("trade").collect()
        assert [(r.exit_reason, pytest.approx(r.exit_price), pytest.approx(r.capital_after)) for r in got] == done
        assert [r.equity for r in marks.filter(F.col("market") == m).orderBy("idx").collect()] == pytest.approx(values)
    deepest = {r.market: r.d for r in K.drawdown_marks(df, terms).groupBy("market").agg(F.max("drawdown").alias("d")).collect()}
    assert deepest == {m: pytest.approx(w) for m, (_, _, w) in want.items()}


def test_no_trades_are_zeros(spark):
    row = K.metrics(frame(spark, [1, 2, 3], [0, 0, 0])).first()
    assert row.total_trades == 0 and row.total_return_pct == 0 and row.profit_factor == 0


def test_drawdown_spells(spark):
    df = frame(spark, [100, 90, 95, 100, 99.5, 101, 50], [0] * 7)
    spells = P.drawdown_periods(df, "close").orderBy("start_ts").collect()
    assert [(s.start_ts.day, s.end_ts and s.end_ts.day, round(s.max_drawdown_pct, 3), s.duration_days, s.recovery_days) for s in spells] == [(2, 4, -10.0, 2, 2), (7, None, -50.495, 0, None)]


def test_returns_fill_gaps(spark):
    df = spark.createDataFrame(
        [("m", DAY, 100.0), ("m", DAY + dt.timedelta(days=1), None), ("m", DAY + dt.timedelta(days=2), 110.0)],
        "market string, ts timestamp_ntz, close double",
    )
    assert [round(r.r, 6) for r in P.returns(df).orderBy("ts").collect()] == [0.0, 0.1]


def test_kelly_and_var(spark):
    one = spark.range(1)
    assert one.select(R.kelly(F.lit(0.6), F.lit(2.0))).first()[0] == pytest.approx(0.2)
    assert one.select(R.kelly(F.lit(0.5), F.lit(1.0))).first()[0] == 0
    r = spark.createDataFrame(
        [("m", DAY + dt.timedelta(days=i), 0.01 * ((i * 7919) % 13 - 6) / 6) for i in range(252)],
        "market string, ts timestamp_ntz, r double",
    )
    v = R.value_at_risk(r).first()
    assert 0 < v.var_historical < 5 and 0 < v.var_parametric < 5 and v.cvar >= v.var_historical


def test_two_series_are_needed(spark):
    r = spark.createDataFrame([("m", DAY, 0.1)], "market string, ts timestamp_ntz, r double")
    with pytest.raises(ValueError):
        R.risk_contribution(r)
