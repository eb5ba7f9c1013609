"""Queries of filters, reports and simulations at their full sizes."""

from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions import series as S
from ..functions import symbols as Y
from ..operators import backtest as K
from ..operators import learn as L
from ..operators import optimize as O
from ..operators import performance as P
from ..operators import risk as RK
from ..operators import signals as G
from ..operators import simulate as M
from ..operators import strategy as T
from ..sources.bars import bars_1d, bars_1h, returns_1d
from . import query, rounded
from . import sql as Q
from .backtests import GRID, PATHS, RPATHS, SPELLS, TERMS, TERMS0, TR, WALK, _draw, _grid_sql, grid_signals, made, signalled
from .indicators import ADX, CCI, H1, SUPERTREND, WAVE
from .risk import BENCH, R1
from .signals import GATE, RSI

KERNEL = """kw AS (SELECT d, pow(1 + d * d / (2 * 8.0::DOUBLE * 25), -8) AS w FROM (SELECT unnest(range(1, 9)) AS d)),
    kr AS (SELECT b.market, b.idx, coalesce(CASE WHEN b.idx >= 8 THEN sum(kw.w * p.close) / sum(kw.w) END, 0) AS kernel FROM b CROSS JOIN kw LEFT
      JOIN b p ON p.market = b.market AND p.idx = b.idx - kw.d GROUP BY b.market, b.idx),
    kl AS (SELECT *, lag(kernel) OVER (PARTITION BY market ORDER BY idx) AS kp FROM kr)"""
FILTERS = "volatility_ok slope_ok adx_ok ema_ok sma_ok kernel_ok"


@query(f"""{H1}, {Q.TRUE_RANGE}, {ADX}, {KERNEL}, {Q.wilder('a1', 't', 'tr', 14)}, {Q.wilder('a2', 't', 'tr', 28)}, {Q.ema('e', 'b', 'close', 50)},
    z AS (SELECT *, close - lag(close, 5) OVER {Q.W} AS d, CASE WHEN count(*) OVER {Q.rows(50)} >= 50 THEN avg(close) OVER {Q.rows(50)} END AS m
      FROM b)
    SELECT z.market, z.ts, coalesce(a1.y > a2.y, false) AS volatility_ok, coalesce(z.d > -0.1::DOUBLE, false) AS slope_ok, coalesce(round(ax.y,
      9) >= 20, false) AS adx_ok, coalesce(z.close > e.y, false) AS ema_ok, coalesce(z.close > z.m, false) AS sma_ok, coalesce(kl.kernel > kl.kp,
      false) AS kernel_ok
    FROM z LEFT JOIN a1 USING (market, idx) LEFT JOIN a2 USING (market, idx) LEFT JOIN ax USING (market, idx) LEFT JOIN e USING (market, idx) LEFT
      JOIN kl USING (market, idx)""")
def trend_filters(spark, sf):
    return T.filters(bars_1h(spark, sf), ema=50, sma=50).select("market", "ts", *FILTERS.split())


@query(f"{H1.replace('WITH', 'WITH RECURSIVE')}, {SUPERTREND} SELECT b.market, b.ts, su.dir AS signal FROM b JOIN su USING (market, idx)")
def supertrend_signal(spark, sf):
    return T.supertrend_signal(bars_1h(spark, sf)).select("market", "ts", "signal")


@query(f"""
    {H1}, {Q.BOLL_SIGNAL}
    SELECT market, count(*) FILTER (signal = 1) AS buy, count(*) FILTER (signal = -1) AS sell, count(*) FILTER (signal = 0) AS neutral FROM sig
      GROUP BY market
""")
def signal_distribution(spark, sf):
    rows = I.bollinger(bars_1h(spark, sf)).withColumn("raw", I.bollinger_signal())
    return T.distribution(S.held(rows, "raw", 3, "signal"))


TWO = f"""
    {Q.BOLLINGER},
    sg AS (SELECT market, ts, idx, close, CASE WHEN close < lower THEN 1 WHEN close > upper THEN -1 ELSE 0 END AS a, CASE WHEN close > open THEN 1
      WHEN close < open THEN -1 ELSE 0 END AS c FROM boll)
"""


def _two(bars):
    return I.bollinger(bars).withColumns({"a": I.bollinger_signal(), "c": F.signum(F.col("close") - F.col("open")).cast("int")})


def _stats(s: str) -> str:
    full = f"count({s}) OVER {Q.rows(10)} >= 10"
    parts = [f"round(CASE WHEN {full} THEN {f}({s}) OVER {Q.rows(10)} END, 4) + 0.0 AS {s}_{n}" for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("max", "max"), ("min", "min"))]
    return ", ".join(
        [*parts, f"round(CASE WHEN count(d{s}) OVER {Q.rows(10)} >= 10 THEN sum(d{s}) OVER {Q.rows(10)} END, 4) + 0.0 AS {s}_changes"]
    )


@query(f"""
    WITH {Q.BARS_1D}, {TWO},
    x AS (SELECT *, abs(a - lag(a) OVER {Q.W}) AS da, abs(c - lag(c) OVER {Q.W}) AS dc FROM sg)
    SELECT market, ts, {_stats('a')}, {_stats('c')}, CASE WHEN idx >= 10 THEN (a = c)::INT::DOUBLE END AS agreement FROM x
""")
def signal_features(spark, sf):
    out = T.signal_features(_two(bars_1d(spark, sf)), ["a", "c"])
    return rounded(
        out.select(
            "market",
            "ts",
            *[F.col(f"{s}_{n}").cast("double").alias(f"{s}_{n}") for s in "ac" for n in ("mean", "std", "max", "min", "changes")],
            "agreement",
        )
    )


ADAPT = """
    ar AS (SELECT *, close / lag(close) OVER (PARTITION BY KEYS ORDER BY ts) - 1 AS r, lead(close) OVER (PARTITION BY KEYS
      ORDER BY ts) / close - 1 AS f, row_number() OVER (PARTITION BY KEYS ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY KEYS) AS n FROM SRC),
    al AS (SELECT KEYS, 'a' AS signal, a AS v, r, f, back, n FROM ar WHERE back <= 400 UNION ALL SELECT KEYS, 'c', c, r, f, back, n FROM ar
      WHERE back <= 400),
    ac AS (SELECT KEYS, signal, CASE WHEN stddev_pop(v) FILTER (f IS NOT NULL) * stddev_pop(f) > 1e-12 THEN corr(v, f) END AS correlation,
      sum(r) FILTER (back <= 200) AS recent, max(n) AS n FROM al GROUP BY ALL),
    ad AS (SELECT *, CASE WHEN n < 400 OR correlation IS NULL THEN 0
      WHEN (correlation > 0 AND recent > 0) OR (correlation < 0 AND recent <= 0) THEN abs(correlation) * 0.5 ELSE -abs(correlation) * 0.5 END AS step
      FROM ac),
    aw AS (SELECT *, CASE WHEN n >= 400 THEN (1 + step) * 2 / sum(1 + step) OVER (PARTITION BY KEYS) ELSE 1 END AS weight FROM ad)"""


@query(f"""
    WITH {Q.BARS_1D}, {TWO}, {ADAPT.replace('SRC', 'sg').replace('KEYS', 'market')}
    SELECT market, signal, round(correlation, 4) + 0.0 AS correlation, round(weight, 4) AS weight, round(weight - 1, 4) + 0.0 AS change FROM aw
""")
def weight_adaptation(spark, sf):
    return rounded(T.adaptation(_two(bars_1d(spark, sf)), ["a", "c"], lookback=200).drop("before"))


@query(f"""
    WITH {Q.BARS_1D}, {TWO}, {ADAPT.replace('SRC', 'sg').replace('KEYS', 'market')},
    s AS (SELECT sg.market, ts, round(a * x.weight + c * y.weight, 9) AS s FROM sg JOIN aw x ON x.market = sg.market AND x.signal = 'a'
      JOIN aw y ON y.market = sg.market AND y.signal = 'c')
    SELECT market, ts, CASE WHEN s > 1.5 THEN 1 WHEN s < -1.5 THEN -1 ELSE 0 END AS signal FROM s""")
def adapted_signal(spark, sf):
    return T.adapted(_two(bars_1d(spark, sf)), ["a", "c"], threshold=1.5, lookback=200).select("market", "ts", "signal")


@query(f"""
    WITH {Q.BARS_1D}, {TWO},
    bk AS (SELECT *, idx // 400 AS block FROM sg
      QUALIFY count(*) OVER (PARTITION BY market, idx // 400) = 400), {ADAPT.replace('SRC', 'bk').replace('KEYS', 'market, block')},
    sp AS (SELECT market, signal, avg(correlation) AS avg_correlation, stddev_pop(correlation) AS correlation_stability,
      sum(weight - 1) AS net_weight_change, stddev_pop(weight) AS spread, arg_max(weight, block) AS current_weight FROM aw GROUP BY ALL),
    pl AS (SELECT bk.market, bk.ts, close, round(a * x.weight + c * y.weight, 9) AS s FROM bk
      JOIN aw x ON x.market = bk.market AND x.block = bk.block AND x.signal = 'a'
      JOIN aw y ON y.market = bk.market AND y.block = bk.block AND y.signal = 'c'),
    ql AS (SELECT market, avg(q) AS avg_signal_quality FROM (SELECT market, CASE WHEN s > 1 THEN 1 WHEN s < -1 THEN -1
      ELSE 0 END * (lead(close) OVER (PARTITION BY market ORDER BY ts) / close - 1) AS q FROM pl) GROUP BY market)
    SELECT sp.market, signal,
      {Q.rounded('avg_correlation correlation_stability net_weight_change current_weight').replace('round(avg_correlation', 'round(coalesce(avg_correlation, 0)').replace('round(correlation_stability', 'round(coalesce(correlation_stability, 0)')},
      round(avg(spread) OVER (PARTITION BY sp.market), 4) + 0.0 AS weight_stability, round(avg_signal_quality, 4) + 0.0 AS avg_signal_quality FROM sp
        JOIN ql USING (market)""")
def strategy_self_metrics(spark, sf):
    return rounded(T.self_metrics(_two(bars_1d(spark, sf)), ["a", "c"], lookback=200))


@query(f"""
    WITH {Q.BARS_1D}
    SELECT market, ts, round(r, 4) + 0.0 AS r FROM (SELECT market, ts, ln(close / lag(close) OVER {Q.W}) AS r FROM b) WHERE r IS NOT NULL
""")
def log_returns(spark, sf):
    return rounded(P.log_returns(bars_1d(spark, sf)))


ALL_SPELLS = SPELLS.replace("WHERE max_drawdown_pct < -1)", "WHERE max_drawdown_pct < 0)")


@query(f"""
    WITH {Q.BARS_1D}, {ALL_SPELLS}
    SELECT market, row_number() OVER (PARTITION BY market
      ORDER BY max_drawdown_pct, start_ts) AS n, start_ts, end_ts, trough_ts, round(max_drawdown_pct, 4) AS max_drawdown_pct, duration_days,
      recovery_days FROM dp
""")
def drawdown_table(spark, sf):
    return rounded(P.drawdown_table(bars_1d(spark, sf), "close"))


@query(f"""
    WITH {Q.BARS_1D}, {ALL_SPELLS},
    w AS (SELECT market, count(*) FILTER (dd < 0) AS underwater_days, avg((dd < 0)::INT) * 100 AS p FROM v GROUP BY market),
    t AS (SELECT market, count(*) AS total_drawdowns, min(max_drawdown_pct) AS a, avg(max_drawdown_pct) AS m, median(max_drawdown_pct) AS d,
      avg(duration_days) AS l, max(duration_days) AS max_duration_days FROM dp GROUP BY market)
    SELECT market, underwater_days, round(p, 4) AS underwater_pct, total_drawdowns, round(a, 4) AS max_drawdown_pct, round(m, 4) AS avg_drawdown_pct,
      round(d, 4) AS median_drawdown_pct, round(l, 4) AS avg_duration_days, max_duration_days FROM w JOIN t USING (market)""")
def drawdown_totals(spark, sf):
    return rounded(P.drawdown_totals(bars_1d(spark, sf), "close"))


_EXC = "mae_pct mfe_pct"


@query(f"""
    {TR},
    x AS (SELECT tr.market, trade, max(CASE WHEN direction = 1 THEN (entry_eff - b.low) / entry_eff
      ELSE (b.high - entry_eff) / entry_eff END * 100) AS mae, max(CASE WHEN direction = 1 THEN (b.high - entry_eff) / entry_eff
      ELSE (entry_eff - b.low) / entry_eff END * 100) AS mfe
      FROM tr JOIN b ON b.market = tr.market AND b.idx > entry_idx AND b.idx <= exit_idx GROUP BY ALL) WITHOUT""".replace(" WITHOUT", f" SELECT tr.market, tr.trade, round(greatest(coalesce(mae, 0), 0), 4) AS mae_pct, round(greatest(coalesce(mfe, 0), 0), 4) AS mfe_pct FROM tr LEFT JOIN x ON x.market = tr.market AND x.trade = tr.trade"))
def trade_excursions(spark, sf):
    return rounded(K.excursions(signalled(spark, sf), TERMS).select("market", "trade", *_EXC.split()))


_REPORT = """
    annual_return annual_volatility sharpe_ratio sortino_ratio calmar_ratio max_drawdown var_95 var_99 cvar_95 win_rate win_loss_ratio skewness
      kurtosis alpha beta r_squared tracking_error information_ratio
"""


@query(f"""
    {R1.replace('SELECT market, ts, idx, r FROM', 'SELECT market, ts, idx, r / 100 AS r FROM')}, {BENCH},
    e AS (SELECT *, exp(sum(ln(1 + r)) OVER {Q.W}) AS v FROM r),
    f AS (SELECT *, max(v) OVER {Q.W} AS pk FROM e),
    q AS (SELECT market, quantile_cont(r, 0.05) AS p5, quantile_cont(r, 0.01) AS p1 FROM r GROUP BY market),
    a AS (SELECT market, avg(r) AS m, stddev_samp(r) AS s, stddev_samp(r) FILTER (r < 0) AS d, max((pk - v) / pk) AS fall, max(p5) AS p5,
      max(p1) AS p1, avg(r) FILTER (r <= p5) AS tail, avg((r > 0)::INT) AS w, avg(r) FILTER (r > 0) AS up, abs(avg(r) FILTER (r < 0)) AS dn,
      skewness(r) AS sk, kurtosis(r) AS ku,
      avg(b) AS mb, covar_samp(r, b) / var_samp(b) AS be, corr(r, b) AS c, stddev_samp(r - b) * sqrt(252) AS te FROM f JOIN q USING (market)
        JOIN bm USING (ts) GROUP BY market),
    z AS (SELECT market, m * 252 * 100 AS annual_return, s * sqrt(252) * 100 AS annual_volatility, m / s * sqrt(252) AS sharpe_ratio,
      m / d * sqrt(252) AS sortino_ratio, m * 252 / fall AS calmar_ratio, fall * 100 AS max_drawdown, abs(p5) * 100 AS var_95,
      abs(p1) * 100 AS var_99, abs(tail) * 100 AS cvar_95, w * 100 AS win_rate, up / dn AS win_loss_ratio,
      sk AS skewness, ku AS kurtosis, (m - be * mb) * 252 * 100 AS alpha, be AS beta, c * c AS r_squared, te * 100 AS tracking_error,
        (m - mb) * 252 / te AS information_ratio FROM a) SELECT market, {Q.rounded(_REPORT)} FROM z""")
def risk_report(spark, sf):
    r = returns_1d(spark, sf).withColumn("r", F.col("r") / 100)
    return rounded(RK.risk_report(r, r.groupBy("ts").agg(F.avg("r").alias("b"))))


@query(f"""
    {R1}, {BENCH},
    x AS (SELECT market, ts, r / 100 AS r FROM r),
    l AS (SELECT market, ts, list(r) OVER {Q.rows(60)} AS xs FROM x),
    g AS (SELECT market, ts, unnest(range(1, 61)) AS i, xs FROM l WHERE len(xs) = 60),
    v AS (SELECT market, ts, i, exp(list_sum(list_transform(xs[1:i], lambda y: ln(1 + y)))) AS v FROM g),
    p AS (SELECT *, max(v) OVER (PARTITION BY market, ts ORDER BY i) AS pk FROM v)
    SELECT market, ts, round(max(1 - v / pk) * 100, 4) + 0.0 AS max_drawdown FROM p GROUP BY market, ts""")
def rolling_max_drawdown(spark, sf):
    r = returns_1d(spark, sf)
    b = r.groupBy("ts").agg(F.avg("r").alias("b"))
    return rounded(RK.rolling_risk(r.withColumn("r", F.col("r") / 100), b).select("market", "ts", "max_drawdown"))


@query(f"""
    {R1},
    n AS (SELECT market, r, row_number() OVER (PARTITION BY market ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY market) AS n FROM r),
    z AS (SELECT market, max(n) AS n FROM n GROUP BY market),
    d AS (SELECT market, {_draw('sim', '1', 'n')} AS i FROM z, (SELECT unnest(range(0, 10000))::BIGINT AS sim))
    SELECT market, round(abs(quantile_cont(r, 0.05)) * 100, 4) AS var_bootstrap FROM d JOIN n USING (market, i) GROUP BY market""")
def var_bootstrap(spark, sf):
    return rounded(RK.value_at_risk_bootstrap(returns_1d(spark, sf)))


_LEVELS = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "low": 0.025, "p50": 0.5, "high": 0.975, "p90": 0.9, "p95": 0.95, "p99": 0.99}
_TOLD = ", ".join(f"round(avg({c}), 4) + 0.0 AS {n}_mean, round(median({c}), 4) + 0.0 AS {n}_median, round(stddev_pop({c}), 4) AS {n}_std, " + ", ".join(f"round(quantile_cont({c}, {q}), 4) + 0.0 AS {n}_{k}" for k, q in _LEVELS.items()) for n, c in (("final", "final"), ("cagr", "cagr"), ("drawdown", "dd")))


@query(f"""
    WITH {Q.RETURNS_1D.replace('SELECT market, ts, idx, r FROM', 'SELECT market, ts, idx, r / 100 AS r FROM')}, {RPATHS},
    c AS (SELECT *, (final - 1) * 100 AS cagr FROM o)
    SELECT market, count(*) AS n, {_TOLD}, round(avg((final > 1)::INT), 4) AS profit_probability FROM c GROUP BY market
""")
def mc_return_report(spark, sf):
    """1000 paths of 252 returns, a hundredth of each."""
    r = returns_1d(spark, sf).withColumn("r", F.col("r") / 100)
    return rounded(M.return_summary(M.path_outcomes(M.drawn(r, "r", "ts", 1000, 252), 1.0, True), 1.0, 252))


@query(f"""WITH {Q.BARS_1D}, {WALK}, a AS (WITH {_grid_sql('trn', 'market, window_id')} SELECT market, window_id, param_id, total_return_pct FROM gm),
    c AS (SELECT *, row_number() OVER (PARTITION BY market, window_id ORDER BY round(total_return_pct, 9) DESC, param_id) AS rn FROM a),
    g(param_id, n, k) AS (VALUES (0, 10, 1.5::DOUBLE), (1, 10, 2.0::DOUBLE), (2, 20, 1.5::DOUBLE), (3, 20, 2.0::DOUBLE)),
    l AS (SELECT market, window_id, 'n' AS param, n::DOUBLE AS v FROM c JOIN g USING (param_id) WHERE rn = 1 UNION ALL
      SELECT market, window_id, 'k', k FROM c JOIN g USING (param_id) WHERE rn = 1),
    m AS (SELECT *, v <> lag(v) OVER (PARTITION BY market, param ORDER BY window_id) AS moved FROM l)
    SELECT market, param, count(*) AS n_windows, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS min, max(v) AS max,
      round(coalesce(avg(moved::INT), 0), 4) AS share_changed, round((max(v) - min(v)) / abs(avg(v)), 4) AS relative_range FROM m
      GROUP BY market, param""")
def parameter_stability(spark, sf):
    grid = O.parameters(spark, GRID)
    walked = O.walk_forward(bars_1d(spark, sf), grid, grid_signals, "total_return_pct", 700, 350, 300, TERMS0)
    return rounded(O.stability(walked, grid).withColumn("n_windows", F.col("n_windows").cast("long")))


def _rsi(n: int, p: str) -> str:
    return f"""{Q.wilder(f'{p}u', 'lg', 'up', n)}, {Q.wilder(f'{p}d', 'lg', 'dn', n)},
    {p} AS (SELECT market, idx, CASE WHEN {p}u.y + {p}d.y = 0 THEN 0 ELSE 100 * {p}u.y / ({p}u.y + {p}d.y) END AS f FROM {p}u
      JOIN {p}d USING (market, idx))"""


ADX20 = (
    ADX.replace("/ 14", "/ 20")
    .replace("[14:i]", "[20:i]")
    .replace("[1:13]", "[1:19]")
    .replace("range(14,", "range(20,")
    .replace(Q.wilder('ax', 'dx', 'dx', 14), Q.wilder('ax', 'dx', 'dx', 20))
)


@query(f"""
    {H1}, {Q.TRUE_RANGE},
    lc AS (SELECT *, close - lag(close) OVER {Q.W} AS d FROM b),
    lg AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM lc
      WHERE d IS NOT NULL), {_rsi(14, 'r1')}, {_rsi(9, 'r2')}, {WAVE}, {CCI}, {ADX20}, {KERNEL},
    {Q.wilder('a1', 't', 'tr', 14)}, {Q.wilder('a2', 't', 'tr', 28)},
    lf AS (SELECT b.market, b.ts, b.idx, r1.f AS f1, wt.y AS f2, CASE WHEN dev < 1e-12 THEN 0
      ELSE (tc.tp - tc.m) / (0.015::DOUBLE * dev) END AS f3, ax.y AS f4, r2.f AS f5, coalesce(kernel > kp, false) AND coalesce(a1.y > a2.y,
      false) AS ok
      FROM b LEFT JOIN r1 USING (market, idx) LEFT JOIN wt USING (market, idx) LEFT JOIN tc USING (market, idx) LEFT JOIN ax USING (market, idx) LEFT
        JOIN r2 USING (market, idx) LEFT JOIN kl USING (market, idx) LEFT JOIN a1 USING (market, idx) LEFT JOIN a2 USING (market, idx)),
    ld AS (SELECT x.market, x.idx, y.idx AS j, {' + '.join(f'ln(1 + abs(x.f{i} - y.f{i}))' for i in range(1, 6))} AS far FROM lf x
      JOIN lf y ON x.market = y.market AND y.idx < x.idx AND y.idx >= x.idx - 400 AND (y.idx % 4 = 0 OR y.idx = x.idx - 1)),
    lk AS (SELECT *, row_number() OVER (PARTITION BY market, idx ORDER BY far) AS n FROM ld WHERE far IS NOT NULL AND j % 4 = 0),
    lv AS (SELECT market, idx, avg(far) AS m, stddev_pop(far) AS s FROM lk WHERE n <= 8 GROUP BY ALL HAVING count(*) = 8),
    ls AS (SELECT market, idx, far FROM ld WHERE j = idx - 1)
    SELECT lf.market, lf.ts, CASE WHEN ok AND lf.idx >= 400 THEN CASE WHEN ls.far < m - s THEN 1 WHEN ls.far > m + s THEN -1 ELSE 0 END
      ELSE 0 END AS signal FROM lf LEFT JOIN lv USING (market, idx) LEFT JOIN ls USING (market, idx)""")
def lorentzian_signal(spark, sf):
    """All five features, gated by the kernel's rise and by volatility; 400 bars back, as the tables' series are shorter
    than the 2000 bars within which a signal is 0."""
    return L.lorentzian_signal(bars_1h(spark, sf), back=400).select("market", "ts", "signal")


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'BTC-PERP' WHEN p_partkey % 4 = 1 THEN 'SOL-PERP' WHEN p_partkey % 4 = 2 THEN 'ETH-PERP'
      ELSE 'XRP-USDT' END AS standard FROM part
""")
def perpetual_symbols(spark, sf):
    """The words for perpetual contracts, over a table of symbols."""
    i = F.col("p_partkey") % 4
    name = F.when(i == 0, "BTCPERPETUAL").when(i == 1, "SOLUSDTSWAP").when(i == 2, "ETH-P").otherwise("XRPUSDT")
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", name.alias("symbol"))
    return rows.select("p_partkey", Y.to_standard(F.lit("binance"), F.col("symbol")).alias("standard"))


@query("SELECT o_orderkey, o_orderdate >= DATE '1995-01-01' AND o_orderdate <= least(DATE '1997-01-01', DATE '1996-06-30') AS inside FROM orders")
def time_range(spark, sf):
    """Rows inside a closed range whose end is clamped to the present, here a fixed one."""
    from ..functions.times import TimeRange

    span = TimeRange("1995-01-01T00:00:00+00:00", "1997-01-01T00:00:00+00:00").clamped("1996-06-30T00:00:00+00:00")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", span.contains(F.col("o_orderdate")).alias("inside"))


@query(f"""
    {H1}, {RSI}, {GATE},
    s AS (SELECT b.market, b.ts, b.idx, CASE WHEN NOT gate THEN 0 WHEN rsi > 70 THEN -1 WHEN rsi < 30 THEN 1 ELSE 0 END AS s0 FROM b LEFT
      JOIN rs USING (market, idx) JOIN gt USING (market, idx)),
    c AS (SELECT *, CASE WHEN idx = 0 OR s0 <> lag(s0) OVER {Q.W} THEN 1 ELSE 0 END AS c FROM s), g AS (SELECT *, sum(c) OVER {Q.W} AS g FROM c)
    SELECT market, ts, CASE WHEN row_number() OVER (PARTITION BY market, g ORDER BY ts) % 4 = 0 THEN 0 ELSE s0 END AS signal FROM g""")
def configured_signal(spark, sf):
    """The RSI's signal by its settings: gated by volatility and volume, held for three bars."""
    return G.signal(bars_1h(spark, sf), "rsi").select("market", "ts", "signal")


@query(f"""WITH {Q.BARS_1D}, {Q.BOLL_SIGNAL}
    SELECT market, ts, CASE WHEN volume > 2 THEN s.signal::DOUBLE END AS bands, CASE WHEN idx % 3 = 0 THEN (close > open)::INT::DOUBLE END AS rises
      FROM sig s WHERE volume > 2 OR idx % 3 = 0""")
def aligned_signals(spark, sf):
    """Two signals that are not on the same bars."""
    rows = S.numbered(signalled(spark, sf))
    rises = rows.filter("idx % 3 = 0").withColumn("signal", (F.col("close") > F.col("open")).cast("int"))
    return T.aligned({"bands": rows.filter("volume > 2"), "rises": rises})


@query(f"""
    {TR}, {Q.equity()},
    x AS (SELECT market, idx, ts, equity, greatest(10000, max(equity) OVER (PARTITION BY market ORDER BY idx), max(after) OVER (PARTITION BY market
      ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS pk FROM eq LEFT
      JOIN (SELECT market, exit_idx AS idx, max(capital_after) AS after FROM tr GROUP BY ALL) USING (market, idx)),
    c AS (SELECT market, exit_idx AS idx, arg_min(exit_reason, trade) AS exit_reason FROM tr GROUP BY ALL),
    e AS (SELECT market, entry_idx AS idx, direction AS entry FROM tr)
    SELECT b.market, b.ts, b.close, round(equity, 4) AS equity, round((pk - equity) / pk * 100, 4) + 0.0 AS drawdown, exit_reason, entry FROM b LEFT
      JOIN x USING (market, idx) LEFT JOIN c USING (market, idx) LEFT JOIN e USING (market, idx)""")
def backtest_panel(spark, sf):
    return rounded(
        K.panel(signalled(spark, sf), TERMS).select("market", "ts", "close", "equity", "drawdown", "exit_reason", "entry"),
        "market",
        "ts",
        "close",
        "equity",
        "drawdown",
        "exit_reason",
        "entry",
    )


@query(f"""
    {TR}, {PATHS},
    hs AS (SELECT market, min(final) AS lo, max(final) AS hi FROM o GROUP BY market),
    hz AS (SELECT o.market, lo, (hi - lo) / 20 AS w, final FROM o JOIN hs USING (market)),
    hk AS (SELECT market, lo, w, CASE WHEN w > 0 THEN least(floor((final - lo) / w), 19)::INT ELSE 0 END AS bin FROM hz)
    SELECT market, bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high, count(*) AS n FROM hk GROUP BY market, bin, lo, w""")
def mc_histogram(spark, sf):
    paths = M.drawn(made(spark, sf), "pnl", "trade", 1000, None, share=0.8)
    return rounded(M.histogram(M.path_outcomes(paths, 10_000.0, False), bins=20))


@query(f"""
    WITH {Q.BARS_1D}, {_grid_sql('b', 'market')}
    SELECT market, param_id, round(total_return_pct, 4) + 0.0 AS total_return_pct, row_number() OVER (PARTITION BY market
      ORDER BY total_return_pct DESC, param_id) AS rank FROM gm
""")
def parameter_ranking(spark, sf):
    """All parameter sets of each series, the best first."""
    found = O.search(bars_1d(spark, sf), O.parameters(spark, GRID), grid_signals, TERMS0)
    return rounded(
        O.ranking(found, "total_return_pct").select(
            "market", F.col("param_id").cast("int").alias("param_id"), "total_return_pct", F.col("rank").cast("long").alias("rank")
        )
    )


@query(f"""
    WITH {Q.BARS_1D}
    SELECT market, ts, round(CASE WHEN max(close) OVER z = min(close) OVER z THEN 0
      ELSE (close - min(close) OVER z) / (max(close) OVER z - min(close) OVER z) END, 4) + 0.0 AS scaled, epoch_us(ts) // 1000000 AS seconds FROM b
      WINDOW z AS (PARTITION BY market)
""")
def scaled_prices(spark, sf):
    """Prices between 0 and 1 over a whole series, and times as epoch seconds."""
    return rounded(
        bars_1d(spark, sf).select(
            "market", "ts", S.min_max("close").alias("scaled"), F.floor(S.micros(F.col("ts")) / 1_000_000).cast("long").alias("seconds")
        )
    )


@query("""
    SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '1m' WHEN 1 THEN '1h' WHEN 2 THEN '4h' WHEN 3 THEN '1d' END AS interval, CASE p_size % 5
      WHEN 0 THEN 60 WHEN 1 THEN 3600 WHEN 2 THEN 14400 WHEN 3 THEN 86400 ELSE 60 END AS seconds FROM part
""")
def resolution_map(spark, sf):
    """Resolutions as a provider's intervals and in seconds, over a table; an unknown one has no interval and 60 seconds."""
    names = F.element_at(F.array(*[F.lit(x) for x in ("1", "60", "240", "1D", "7")]), (F.col("p_size") % 5 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", names.alias("r"))
    return rows.select("p_partkey", Y.interval("binance", F.col("r")).alias("interval"), Y.granularity(F.col("r")).alias("seconds"))
