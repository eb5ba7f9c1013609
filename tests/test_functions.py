"""Windows and kernels on small series."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import recurrences as R
from barloom.functions import series as S
from barloom.operators import optimize as O
from barloom.operators import risk as RK

DAY = dt.datetime(2023, 1, 1)


def test_smoothing_seeds():
    x = np.array([1.0, 2, 3, 4, 5])
    assert np.isnan(R.ema(x, 3)[:2]).all() and R.ema(x, 3)[2:].tolist() == [2.0, 3.0, 4.0]
    assert R.wilder(x, 2)[1:].tolist() == [1.5, 2.25, 3.125, 4.0625]
    assert R.rsi(np.ones(20), 14)[14:].tolist() == [0.0] * 6
    assert np.isnan(R.ema(x[:2], 3)).all() and len(R.ema(np.zeros(0), 3)) == 0


def test_limiter_is_the_state_machine(spark):
    rnd = random.Random(5)
    rows, want = [], []
    for m in range(20):
        raw = [rnd.choice([0, 1, -1]) if rnd.random() < 0.4 else None for _ in range(40)]
        for i, x in enumerate(raw):
            raw[i] = x if x is not None else (raw[i - 1] if i else 0)
        last, held = None, 0
        for i, x in enumerate(raw):
            if x != last:
                held = 0
                last = x
            held += 1
            out = x
            if held > 3:
                out, held = 0, 0
            rows.append((str(m), DAY + dt.timedelta(hours=i), x))
            want.append(out)
    df = spark.createDataFrame(rows, "market string, ts timestamp_ntz, raw int")
    got = S.held(df, "raw", 3, "signal").collect()
    by_key = {(r.market, r.ts): r.signal for r in got}
    assert [by_key[m, t] for m, t, _ in rows] == want


def test_affine_scan_over_blocks(spark):
    rnd = random.Random(2)
    rows = [("a", i, rnd.random(), rnd.random()) for i in range(57)] + [("b", i, 0.5, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "market string, idx long, a double, b double")
    got = {(r.market, r.idx): r.y for r in R.affine_scan(df, {"y": ("a", "b")}, block=10).collect()}
    last = {}
    for m, i, a, b in rows:
        last[m] = a * last.get(m, 0.0) + b
        assert got[m, i] == pytest.approx(last[m])


def test_smoothed_by_blocks_as_over_whole_series(spark):
    """Every smoothed indicator, in blocks of 7 bars, against its kernel: a short series and constant bars first."""
    rnd = random.Random(9)
    rows = []
    for m, n in (("a", 90), ("b", 12), ("c", 60), ("d", 1)):
        px = 100.0
        for i in range(n):
            px = px if m == "c" and i < 20 else px * (1 + rnd.gauss(0, 0.02))
            hi, lo = (px, px) if m == "c" and i < 20 else (px * (1 + rnd.random() / 50), px * (1 - rnd.random() / 50))
            rows.append((m, DAY + dt.timedelta(hours=i), hi, lo, px))
    df = spark.createDataFrame(rows, "market string, ts timestamp_ntz, high double, low double, close double")
    hlc = lambda p: [p[c].to_numpy(float) for c in ("high", "low", "close")]
    kernels = {
        "ema": lambda p: R.ema(hlc(p)[2], 5), "rsi": lambda p: R.rsi(hlc(p)[2], 5), "macd": lambda p: R.macd(hlc(p)[2], 4, 9, 3)[0], "macd_signal": lambda p: R.macd(hlc(p)[2], 4, 9, 3)[1], "atr": lambda p: R.atr(*hlc(p), 5),
        "plus_di": lambda p: R.directional(*hlc(p), 5)[0], "minus_di": lambda p: R.directional(*hlc(p), 5)[1], "adx": lambda p: R.directional(*hlc(p), 5)[2], "wavetrend": lambda p: R.wave_trend(*hlc(p), 4, 5),
    }
    want = {(r.market, r.ts): r for r in R.by_series(df, kernels).collect()}
    blocks = {
        ("ema",): lambda d: R.with_ema(d, 5, block=7), ("rsi",): lambda d: R.with_rsi(d, 5, block=7), ("macd", "macd_signal"): lambda d: R.with_macd(d, 4, 9, 3, block=7), ("atr",): lambda d: R.with_atr(d, 5, block=7), ("plus_di", "minus_di", "adx"): lambda d: R.with_directional(d, 5, block=7), ("wavetrend",): lambda d: R.with_wave_trend(d, 4, 5, block=7)
    }
    for names, run in blocks.items():
        got = run(df).collect()
        assert len(got) == len(rows)
        for r in got:
            for n in names:
                w = want[r.market, r.ts][n]
                assert r[n] is None if w is None else r[n] == pytest.approx(w, abs=1e-9), (n, r.market, r.ts)
    assert R.with_rsi(df.filter("market = 'z'"), 5).count() == 0


def test_one_long_series_goes_to_many_tasks(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("'m' market", "id idx", "cast(0.999 as double) a", "cast(id % 7 as double) b")
    out = R.affine_scan(df, {"y": ("a", "b")}, block=n // 8).select("idx", "y")
    x, last = np.arange(n) % 7, 0.0
    got = dict(out.filter("idx in (0, 124999, 125000, 500001, 999999)").collect())
    for i in range(n):
        last = 0.999 * last + x[i]
        if i in got:
            assert got[i] == pytest.approx(last)
    assert len(got) == 5


def test_cross_is_strict(spark):
    df = spark.createDataFrame(
        [("m", DAY + dt.timedelta(days=i), x) for i, x in enumerate([-1.0, 1.0, 0.0, -1.0, 1.0, -1.0])],
        "market string, ts timestamp_ntz, x double",
    )
    assert [r.c for r in df.select("ts", S.cross("x", F.lit(0.0)).alias("c")).orderBy("ts").collect()] == [0, 1, 0, 0, 1, -1]


def test_grid():
    assert len(O.combinations({"a": [5, 10, 15], "b": [20, 30]})) == 6
    assert O.combinations({"a": [1], "b": [2, 3]}) == [{"a": 1, "b": 2}, {"a": 1, "b": 3}]


def test_constant_series_have_no_correlation(spark):
    r = spark.createDataFrame(
        [(m, DAY + dt.timedelta(days=i), 0.0) for m in "ab" for i in range(6)], "market string, ts timestamp_ntz, r double"
    )
    assert {x.corr for x in RK.correlation_matrix(r).collect()} == {None}
    row = RK.risk_metrics(r).first()
    assert row.sharpe_ratio == 0 and row.skewness == 0
    assert RK.benchmark_metrics(r, r.filter("market = 'a'").select("ts", F.col("r").alias("b"))).first().beta is None


def test_moments_are_unbiased(spark):
    x = [1.0, 2.0, 3.5, 9.0, -2.0, 4.0, 0.5]
    r = spark.createDataFrame([("m", DAY + dt.timedelta(days=i), v) for i, v in enumerate(x)], "market string, ts timestamp_ntz, r double")
    row = RK.risk_metrics(r).first()
    n, m = len(x), np.mean(x)
    s = np.std(x)
    assert row.skewness == pytest.approx(np.mean((np.array(x) - m) ** 3) / s**3 * np.sqrt(n * (n - 1)) / (n - 2))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "market string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    from barloom.functions import indicators as I
    from barloom.operators import backtest as K

    assert I.bollinger(empty).count() == 0
    assert K.metrics(empty.withColumn("signal", F.lit(0))).count() == 0
    assert R.by_series(empty, {"e": lambda p: R.ema(p["close"].to_numpy(float), 3)}).count() == 0


def test_report_and_draws(spark):
    from barloom.operators import learn as L
    from barloom.operators import performance as P
    from barloom.operators import simulate as M

    rows = [
        (s, DAY + dt.timedelta(days=i), 100.0 * (1 + 0.001 * i * k) + (i * 7919) % 5) for s, k in (("a", 1), ("b", 2)) for i in range(90)
    ]
    curve = spark.createDataFrame(rows, "strategy string, ts timestamp_ntz, equity double")
    out = {r.strategy: r for r in P.report(curve, by=("strategy",)).collect()}
    assert out["b"].returns.total_return_pct > out["a"].returns.total_return_pct and out["a"].risk.n == 89
    assert P.current_drawdown(curve, by=("strategy",)).count() == 2
    r = P.returns(curve, "equity", ("strategy",))
    assert 0 < RK.value_at_risk_bootstrap(r, 500, by=("strategy",)).first().var_bootstrap < 10
    paths = M.compounded_paths(M.bootstrap(r, "r", "ts", 20, 10, by=("strategy",)), by=("strategy",))
    assert M.sampled(paths, 5, by=("strategy",)).select("strategy", "sim").distinct().count() == 10
    bars = S.numbered(curve.withColumnRenamed("strategy", "market").withColumn("label", F.lit(1)))
    got = L.neighbour_label(bars.withColumn("f", F.col("equity")), ["f"]).filter("prediction is not null")
    assert got.select("prediction").distinct().collect()[0][0] == 1.0
    assert L.adaptive_threshold(bars.withColumn("distance", F.lit(2.0))).first().threshold == 2.0


def test_time_ranges(spark):
    from barloom.functions.times import TimeRange

    r = TimeRange("2024-01-01T00:00:00Z", "2024-02-01T00:00:00+01:00")
    assert TimeRange.from_dict(r.to_dict()) == r and r.checked("2024-03-01T00:00:00Z") is r
    assert r.clamped("2024-01-15T00:00:00Z").end == dt.datetime(2024, 1, 15, tzinfo=dt.UTC)
    for bad in (
        ("2024-01-01T00:00:00", "2024-02-01T00:00:00Z"),
        ("2024-02-01T00:00:00Z", "2024-01-01T00:00:00Z"),
        (None, "2024-01-01T00:00:00Z"),
        ("soon", "later"),
    ):
        with pytest.raises(ValueError):
            TimeRange(*bad)
    with pytest.raises(ValueError):
        r.checked("2024-01-15T00:00:00Z")
    with pytest.raises(ValueError):
        TimeRange.from_dict({"start": "2024-01-01T00:00:00Z"})
    rows = spark.createDataFrame(
        [(DAY,), (dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 31, 23),), (dt.datetime(2024, 1, 31, 23, 1),), (None,)],
        "ts timestamp_ntz",
    )
    assert [x.i for x in rows.select(r.contains(F.col("ts")).alias("i")).collect()][1:] == [True, True, False, None]


def test_drawn_paths_are_those_of_the_joined_form(spark):
    from barloom.operators import simulate as M

    rows = spark.createDataFrame(
        [(m, i, 0.01 * ((i * 7919) % 13 - 6)) for m in "ab" for i in range(20 + 10 * (m == "b"))], "market string, ts int, r double"
    )
    joined = M.outcomes(M.compounded_paths(M.bootstrap(rows, "r", "ts", 7, 12), 1.0), 1.0)
    drawn = M.path_outcomes(M.drawn(rows, "r", "ts", 7, 12, parts=3), 1.0, True)
    key = lambda df: {(r.market, r.sim): (pytest.approx(r.final), pytest.approx(r.max_drawdown)) for r in df.collect()}
    assert {k: v for k, v in key(joined).items()} == {(r.market, r.sim): (r.final, r.max_drawdown) for r in drawn.collect()} and drawn.count() == 14


def test_self_metrics_of_short_series(spark):
    from barloom.operators import strategy as T

    df = spark.createDataFrame(
        [("m", DAY + dt.timedelta(days=i), 100.0 + i, 1, -1) for i in range(5)],
        "market string, ts timestamp_ntz, close double, a int, b int",
    )
    assert {r.weight for r in T.adaptation(df, ["a", "b"], [3.0, 1.0]).collect()} == {3.0, 1.0}
    assert [r.signal for r in T.adapted(df, ["a", "b"], [3.0, 1.0]).collect()] == [1] * 5 and T.self_metrics(df, ["a", "b"]).count() == 0
