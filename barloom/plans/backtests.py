"""Queries of backtests, their statistics, simulations and searches."""

from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions import series as S
from ..operators import backtest as K
from ..operators import optimize as O
from ..operators import performance as P
from ..operators import risk as RK
from ..operators import simulate as M
from ..sources.bars import bars_1d
from . import query, rounded
from . import sql as Q

D1 = f"WITH {Q.BARS_1D}, {Q.BOLL_SIGNAL}"
TR = f"{D1}, {Q.trades()}"
EQ = f"{TR}, {Q.equity()}"
TERMS = K.Terms(stop_pct=2.0, target_pct=4.0)


def signalled(spark, sf):
    rows = I.bollinger(bars_1d(spark, sf)).withColumn("raw", I.bollinger_signal())
    return S.held(rows, "raw", 3, "signal").select("market", "ts", "open", "high", "low", "close", "volume", "signal")


def made(spark, sf):
    return K.trades(signalled(spark, sf), TERMS)


_TRADE = "entry_price entry_eff exit_price size pnl pnl_pct capital_after"


@query(f"{TR} SELECT market, trade, entry_time, exit_time, direction, exit_reason, {Q.rounded(_TRADE)} FROM tr")
def backtest_trades(spark, sf):
    return rounded(made(spark, sf), "market", "trade", "entry_time", "exit_time", "direction", "exit_reason", *_TRADE.split())


@query(f"{EQ} SELECT market, ts, {Q.rounded('equity unrealized_pnl')} FROM eq")
def backtest_equity(spark, sf):
    return rounded(K.equity(signalled(spark, sf), TERMS), "market", "ts", "equity", "unrealized_pnl")


_METRICS = """
    total_return_pct annualized_return_pct win_rate max_drawdown sharpe_ratio total_trades profitable_trades avg_profit_trade avg_loss_trade
      largest_win largest_loss avg_trade_duration_hours profit_factor
"""
_METRICS_SQL = Q.rounded(_METRICS).replace("round(total_trades, 4) + 0.0 AS", "total_trades AS").replace(
    "round(profitable_trades, 4) + 0.0 AS", "profitable_trades AS"
)


@query(f"{EQ}, {Q.metrics()} SELECT market, {_METRICS_SQL} FROM mt")
def backtest_metrics(spark, sf):
    return rounded(K.metrics(signalled(spark, sf), TERMS), "market", *_METRICS.split())


SPELLS = """
    u AS (SELECT *, max(close) OVER (PARTITION BY market ORDER BY ts) AS pk, max(ts) OVER (PARTITION BY market) AS last FROM b),
    v AS (SELECT *, (close - pk) / pk * 100 AS dd FROM u),
    g AS (SELECT *, count(*) FILTER (dd >= 0) OVER (PARTITION BY market ORDER BY ts) AS g FROM v),
    sp AS (SELECT market, g, min(ts) AS start_ts, min(dd) AS max_drawdown_pct, arg_min(ts, (dd, ts)) AS trough_ts, max(last) AS last FROM g
      WHERE dd < 0 GROUP BY market, g),
    en AS (SELECT sp.*, (SELECT min(ts) FROM v WHERE v.market = sp.market AND v.ts > sp.start_ts AND v.dd >= 0) AS end_ts FROM sp
      WHERE max_drawdown_pct < -1),
    dp AS (SELECT market, start_ts, end_ts, trough_ts, max_drawdown_pct, floor((epoch_us(coalesce(end_ts,
      last)) - epoch_us(start_ts)) / 86400000000)::BIGINT AS duration_days,
      CASE WHEN end_ts IS NOT NULL THEN floor((epoch_us(end_ts) - epoch_us(trough_ts)) / 86400000000)::BIGINT END AS recovery_days FROM en)"""


@query(f"""
    WITH {Q.BARS_1D}, {SPELLS}
    SELECT market, start_ts, end_ts, trough_ts, round(max_drawdown_pct, 4) AS max_drawdown_pct, duration_days, recovery_days FROM dp
""")
def drawdown_periods(spark, sf):
    return rounded(P.drawdown_periods(bars_1d(spark, sf), "close"))


@query(f"""WITH {Q.BARS_1D}, {SPELLS},
    a AS (SELECT market, sqrt(avg(pow(dd / 100, 2))) * 100 AS ulcer_index, coalesce(-avg(dd) FILTER (dd < 0), 0) AS pain_index, -arg_max(dd,
      ts) AS current_drawdown_pct, CASE WHEN arg_max(dd, ts) < 0 THEN floor((epoch_us(max(ts)) - epoch_us(max(ts) FILTER (dd >= 0))) /
      86400000000)::BIGINT ELSE 0 END AS current_duration_days,
      (pow(arg_max(close, ts) / arg_min(close, ts), 1 / (floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) / 365)) - 1) * 100 AS y FROM v
        GROUP BY market),
    rk AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY max_drawdown_pct, start_ts) AS n FROM dp),
    z AS (SELECT market, count(*) AS n_periods, -min(max_drawdown_pct) AS max_drawdown_pct, avg(max_drawdown_pct) AS avg_drawdown_pct,
      max(duration_days) AS max_duration_days, avg(duration_days) AS avg_duration_days, max(recovery_days) FILTER (n = 1) AS rd,
      -avg(max_drawdown_pct) FILTER (n <= 3) AS w, sqrt(sum(pow(max_drawdown_pct, 2))) AS q FROM rk GROUP BY market)
    SELECT market, n_periods, round(max_drawdown_pct, 4) AS max_drawdown_pct, round(avg_drawdown_pct, 4) AS avg_drawdown_pct, max_duration_days,
      round(avg_duration_days, 4) AS avg_duration_days, round(ulcer_index, 4) AS ulcer_index, round(pain_index, 4) AS pain_index,
      round(current_drawdown_pct, 4) + 0.0 AS current_drawdown_pct, current_duration_days, coalesce(rd, 0)::BIGINT AS time_to_recovery_days,
        round(CASE WHEN rd IS NOT NULL THEN y / max_drawdown_pct
        ELSE 0 END, 4) + 0.0 AS recovery_factor, round(y / max_drawdown_pct, 4) + 0.0 AS calmar_ratio, round(y / w, 4) + 0.0 AS sterling_ratio,
        round(y / q, 4) + 0.0 AS burke_ratio FROM a JOIN z USING (market)""")
def drawdown_summary(spark, sf):
    return rounded(P.drawdown_summary(bars_1d(spark, sf), "close"))


MONTHS = """
    ms AS (SELECT market, date_trunc('month', ts)::DATE AS month, sum(r) AS r FROM r GROUP BY 1, 2),
    me AS (SELECT market, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM ms
      GROUP BY market),
    mo AS (SELECT me.market, me.month, coalesce(ms.r, 0) AS r FROM me LEFT JOIN ms ON ms.market = me.market AND ms.month = me.month)"""


@query(f"WITH {Q.RETURNS_1D}, {MONTHS} SELECT market, strftime(month, '%Y-%m') AS month, round(r * 100, 4) + 0.0 AS return_pct FROM mo")
def monthly_returns(spark, sf):
    m = P.monthly(P.returns(bars_1d(spark, sf)))
    return rounded(m.select("market", F.date_format("month", "yyyy-MM").alias("month"), (F.col("r") * 100).alias("return_pct")))


@query(f"""
    WITH {Q.RETURNS_1D}, {MONTHS},
    t AS (SELECT market, arg_max(close, ts) / arg_min(close, ts) AS g, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) / 365 AS y FROM b
      GROUP BY market),
    d AS (SELECT market, avg(r) * 100 AS daily_return_pct, stddev_samp(r) * 100 AS volatility_daily_pct,
      stddev_samp(r) * 100 * sqrt(252) AS volatility_annual_pct, coalesce(stddev_samp(r) FILTER (r < 0) * 100 * sqrt(252),
      0) AS downside_volatility_pct, max(r) * 100 AS best_day_pct, min(r) * 100 AS worst_day_pct, avg((r > 0)::INT) * 100 AS pct_profitable_days,
      count(*) AS trading_days FROM r GROUP BY market),
    m AS (SELECT market, avg(r) * 100 AS monthly_return_pct, stddev_samp(r) * 100 AS volatility_monthly_pct, max(r) * 100 AS best_month_pct,
      min(r) * 100 AS worst_month_pct, avg((r > 0)::INT) * 100 AS pct_profitable_months, coalesce(avg(r) FILTER (r > 0) * 100, 0) AS avg_up_month_pct,
      coalesce(avg(r) FILTER (r < 0) * 100, 0) AS avg_down_month_pct FROM mo GROUP BY market)
    SELECT market, round((g - 1) * 100, 4) AS total_return_pct, round((pow(g, 1 / y) - 1) * 100, 4) AS annual_return_pct, trading_days,
      {Q.rounded('daily_return_pct volatility_daily_pct volatility_annual_pct downside_volatility_pct best_day_pct worst_day_pct pct_profitable_days monthly_return_pct volatility_monthly_pct best_month_pct worst_month_pct pct_profitable_months avg_up_month_pct avg_down_month_pct')}
    FROM t JOIN d USING (market) JOIN m USING (market)""")
def return_stats(spark, sf):
    return rounded(P.return_stats(bars_1d(spark, sf)))


_STATS = """
    win_rate profit_factor avg_profit avg_loss largest_profit largest_loss avg_holding_hours avg_profit_hours avg_loss_hours total_profit
      long_win_rate short_win_rate expectancy
"""


@query(f"""{TR}, h AS (SELECT *, (epoch_us(exit_time) - epoch_us(entry_time)) / 3.6e9 AS hrs FROM tr),
    a AS (SELECT market, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl < 0) AS losing_trades,
      count(*) FILTER (pnl = 0) AS breakeven_trades, avg((pnl > 0)::INT) * 100 AS win_rate, coalesce(sum(pnl) FILTER (pnl > 0),
      0) / -(sum(pnl) FILTER (pnl < 0)) AS profit_factor,
      coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_profit, coalesce(-avg(pnl) FILTER (pnl < 0), 0) AS avg_loss, coalesce(max(pnl) FILTER (pnl > 0),
        0) AS largest_profit, coalesce(-min(pnl) FILTER (pnl < 0), 0) AS largest_loss, avg(hrs) AS avg_holding_hours,
        coalesce(avg(hrs) FILTER (pnl > 0), 0) AS avg_profit_hours, coalesce(avg(hrs) FILTER (pnl < 0), 0) AS avg_loss_hours,
      count(*) FILTER (direction = 1) AS long_trades, count(*) FILTER (direction = -1) AS short_trades, sum(pnl) AS total_profit,
        coalesce(avg((pnl > 0)::INT) FILTER (direction = 1) * 100, 0) AS long_win_rate, coalesce(avg((pnl > 0)::INT) FILTER (direction = -1) * 100,
        0) AS short_win_rate FROM h GROUP BY market),
    e AS (SELECT *, win_rate / 100 * avg_profit - (100 - win_rate) / 100 * avg_loss AS expectancy FROM a)
    SELECT market, total_trades, winning_trades, losing_trades, breakeven_trades, long_trades, short_trades, {Q.rounded(_STATS)} FROM e""")
def trade_stats(spark, sf):
    return rounded(P.trade_stats(made(spark, sf)))


@query(f"""
    {TR}
    SELECT market, 'exit_reason' AS kind, exit_reason AS key, count(*) AS n FROM tr GROUP BY ALL UNION ALL
      SELECT market, 'weekday', dayname(entry_time), count(*) FROM tr GROUP BY ALL UNION ALL
      SELECT market, 'hour', hour(entry_time)::VARCHAR, count(*) FROM tr GROUP BY ALL
""")
def trade_breakdown(spark, sf):
    return P.trade_breakdown(made(spark, sf))


@query(f"""
    {TR},
    s AS (SELECT market, trade, sign(pnl)::INT AS s FROM tr),
    k AS (SELECT *, trade - row_number() OVER (PARTITION BY market, s ORDER BY trade) AS g FROM s),
    n AS (SELECT market, s, g, count(*) AS n, max(trade) AS t FROM k GROUP BY ALL)
    SELECT market, coalesce(max(n) FILTER (s = 1), 0) AS max_win_streak, coalesce(max(n) FILTER (s = -1), 0) AS max_loss_streak, CASE
      WHEN arg_max(s, t) = 1 THEN arg_max(n, t) ELSE 0 END AS current_wins, CASE WHEN arg_max(s, t) = -1 THEN arg_max(n, t)
      ELSE 0 END AS current_losses FROM n GROUP BY market""")
def streaks(spark, sf):
    return P.streaks(made(spark, sf))


@query(f"""
    {TR},
    g AS (SELECT *, 10000 * product(1 + 0.02::DOUBLE * pnl_pct / 100) OVER (PARTITION BY market ORDER BY trade) AS after FROM tr),
    h AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY market
      ORDER BY trade), 10000) * 0.02::DOUBLE AS stake, greatest(10000, max(after) OVER (PARTITION BY market ORDER BY trade)) AS pk FROM g),
    a AS (SELECT market, avg(stake) AS avg_size, max(stake) AS max_size, min(stake) AS min_size, (arg_max(after, trade) / 10000 - 1) * 100 AS roi_pct,
      max((pk - after) / pk * 100) AS max_drawdown_pct, avg((pnl > 0)::INT) AS w, avg(pnl_pct) FILTER (pnl > 0) / -avg(pnl_pct) FILTER (pnl < 0) AS q
      FROM h GROUP BY market),
    k AS (SELECT *, coalesce(CASE WHEN w > 0 AND w < 1 AND q > 0 THEN greatest(0.5 * (w * q - (1 - w)) / q, 0) ELSE 0 END, 0) AS kelly FROM a)
    SELECT market, {Q.rounded('avg_size max_size min_size roi_pct max_drawdown_pct kelly')} FROM k""")
def position_sizing(spark, sf):
    return rounded(RK.position_sizing(made(spark, sf)))


# the generator of draws in SQL: all products stay below 2 ** 63
def _draw(sim: str, step: str, n: str, seed: int = 7) -> str:
    x = f"((({sim} + 1) * 1103515245::BIGINT + ({step} + 1) * 12345::BIGINT * ({sim} + {seed})) % 2147483647)"
    return f"((({x} * 48271) % 2147483647) % {n})"


PATHS = f"""
    n AS (SELECT market, pnl, trade - 1 AS i, count(*) OVER (PARTITION BY market) AS n FROM tr),
    z AS (SELECT market, max(n) AS n FROM n GROUP BY market),
    d AS (SELECT market, sim, step, {_draw('sim', 'step', 'n')} AS i FROM z, (SELECT unnest(range(0, 1000))::BIGINT AS sim),
      LATERAL (SELECT unnest(range(1, greatest(1, floor(n * 0.8::DOUBLE))::BIGINT + 1))::BIGINT AS step)),
    p AS (SELECT d.market, sim, step, 10000 + sum(pnl) OVER (PARTITION BY d.market, sim ORDER BY step) AS value FROM d
      JOIN n ON n.market = d.market AND n.i = d.i),
    pk AS (SELECT *, greatest(10000, max(value) OVER (PARTITION BY market, sim ORDER BY step)) AS pk FROM p),
    o AS (SELECT market, sim, arg_max(value, step) AS final, max((pk - value) / pk * 100) AS dd FROM pk GROUP BY ALL)"""
SUMMARY = f"""
    SELECT market, count(*) AS n, round(avg(final), 4) AS mean_final, round(median(final), 4) AS median_final, round(stddev_pop(final),
      4) AS std_final, {', '.join(f'round(quantile_cont(final, {p / 100}), 4) AS p{p}' for p in M.PERCENTILES)},
    round(avg((final > START)::INT), 4) AS win_probability, round(avg(dd), 4) AS mean_drawdown, round(quantile_cont(dd, 0.95), 4) AS drawdown_p95
      FROM o GROUP BY market"""


@query(f"{TR}, {PATHS} {SUMMARY.replace('START', '10000')}")
def mc_trades(spark, sf):
    paths = M.drawn(made(spark, sf), "pnl", "trade", 1000, None, share=0.8)
    return rounded(M.summary(M.path_outcomes(paths, 10_000.0, False), 10_000.0))


RPATHS = f"""
    n AS (SELECT market, r, row_number() OVER (PARTITION BY market ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY market) AS n FROM r),
    z AS (SELECT market, max(n) AS n FROM n GROUP BY market),
    d AS (SELECT market, sim, step, {_draw('sim', 'step', 'n')} AS i
      FROM z, (SELECT unnest(range(0, 1000))::BIGINT AS sim), (SELECT unnest(range(1, 253))::BIGINT AS step)),
    p AS (SELECT d.market, sim, step, exp(sum(ln(1 + r)) OVER (PARTITION BY d.market, sim ORDER BY step)) AS value FROM d
      JOIN n ON n.market = d.market AND n.i = d.i),
    pk AS (SELECT *, greatest(1, max(value) OVER (PARTITION BY market, sim ORDER BY step)) AS pk FROM p),
    o AS (SELECT market, sim, arg_max(value, step) AS final, max((pk - value) / pk * 100) AS dd FROM pk GROUP BY ALL)"""


def _return_paths(spark, sf):
    # daily closes of single orders jump by orders of magnitude: a hundredth of each return keeps paths in range
    r = P.returns(bars_1d(spark, sf)).withColumn("r", F.col("r") / 100)
    return M.drawn(r, "r", "ts", 1000, 252)


@query(f"""
    WITH {Q.RETURNS_1D.replace('SELECT market, ts, idx, r FROM', 'SELECT market, ts, idx, r / 100 AS r FROM')},
      {RPATHS} {SUMMARY.replace('START', '1')}
""")
def mc_returns(spark, sf):
    return rounded(M.summary(M.path_outcomes(_return_paths(spark, sf), 1.0, True), 1.0))


@query(f"""
    WITH {Q.RETURNS_1D.replace('SELECT market, ts, idx, r FROM', 'SELECT market, ts, idx, r / 100 AS r FROM')}, {RPATHS}
    SELECT market, step, {', '.join(f'round(quantile_cont(value, {q}), 4) AS p{round(100 * q)}' for q in (0.05, 0.5, 0.95))} FROM p
      GROUP BY market, step
""")
def mc_fan(spark, sf):
    return rounded(M.fan(M.path_values(_return_paths(spark, sf), 1.0, True)))


@query(f"""
    {TR},
    z AS (SELECT sim, market, trade, pnl, {_draw('sim', '(trade - 1)', '2147483647')} AS k FROM tr, (SELECT unnest(range(0, 50))::BIGINT AS sim)),
    s AS (SELECT market, sim, row_number() OVER (PARTITION BY market, sim ORDER BY k, trade) AS step, pnl FROM z),
    p AS (SELECT market, sim, step, 10000 + sum(pnl) OVER (PARTITION BY market, sim ORDER BY step) AS value FROM s),
    q AS (SELECT *, greatest(10000, max(value) OVER (PARTITION BY market, sim ORDER BY step)) AS pk FROM p)
    SELECT market, sim, round(arg_max(value, step), 4) AS final, round(max((pk - value) / pk * 100), 4) AS max_drawdown FROM q GROUP BY ALL
""")
def mc_shuffle(spark, sf):
    paths = M.summed_paths(M.shuffled(made(spark, sf), "pnl", "trade", 50), 10_000.0)
    return rounded(M.outcomes(paths, 10_000.0), "market", "sim", "final", "max_drawdown")


GRID = {"n": [10, 20], "k": [1.5, 2.0]}
TERMS0 = K.Terms(size_pct=0.2)
GRID_SIG = f"""
    gp AS (SELECT * FROM (VALUES (0, 10, 1.5::DOUBLE), (1, 10, 2.0::DOUBLE), (2, 20, 1.5::DOUBLE), (3, 20, 2.0::DOUBLE)) g(param_id, n, k)),
    gw AS (SELECT SRC.*, count(*) OVER w10 AS c10, avg(close) OVER w10 AS m10, stddev_pop(close) OVER w10 AS s10, count(*) OVER w20 AS c20,
      avg(close) OVER w20 AS m20, stddev_pop(close) OVER w20 AS s20 FROM SRC
      WINDOW w10 AS (PARTITION BY KEYS ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
      w20 AS (PARTITION BY KEYS ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    gx AS (SELECT *, CASE WHEN n = 10 AND c10 >= 10 THEN m10 WHEN n = 20 AND c20 >= 20 THEN m20 END AS m, CASE WHEN n = 10 AND c10 >= 10 THEN s10
      WHEN n = 20 AND c20 >= 20 THEN s20 END AS s FROM gw, gp),
    gsig AS (SELECT KEYS, param_id, ts, idx, open, high, low, close, CASE WHEN close < m - k * s THEN 1 WHEN close > m + k * s THEN -1
      ELSE 0 END AS signal FROM gx)"""


def _grid_sql(src: str, keys: str) -> str:
    both = f"{keys}, param_id"
    sql = f"{GRID_SIG.replace('SRC', src).replace('KEYS', keys)}, {Q.trades('gsig', both, pct='0.2', stop='NULL', target='NULL')}, {Q.equity('gsig', both)}, {Q.metrics(both)}"
    empty = f"gm AS (SELECT * FROM mt UNION ALL BY NAME SELECT k.*, 0 AS total_return_pct, 0 AS annualized_return_pct, 0 AS win_rate, 0 AS max_drawdown, 0 AS sharpe_ratio, 0 AS total_trades, 0 AS profitable_trades, 0 AS avg_profit_trade, 0 AS avg_loss_trade, 0 AS largest_win, 0 AS largest_loss, 0 AS avg_trade_duration_hours, 0 AS profit_factor FROM (SELECT DISTINCT {both} FROM eq) k ANTI JOIN mt USING ({both}))"
    return f"{sql}, {empty}"


def grid_signals(rows, keys):
    """Bollinger signals where window and width are columns; windows that the grid doesn't have give no signal."""
    mean, dev = F.lit(None).cast("double"), F.lit(None).cast("double")
    for n in GRID["n"]:
        mean = F.when(F.col("n") == n, S.sma("close", n, keys)).otherwise(mean)
        dev = F.when(F.col("n") == n, S.rolling(F.stddev_pop, "close", n, keys)).otherwise(dev)
    rows = rows.withColumn("_m", mean).withColumn("_s", dev)
    return rows.withColumn("signal", F.when(F.col("close") < F.col("_m") - F.col("k") * F.col("_s"), 1).when(F.col("close") > F.col("_m") + F.col("k") * F.col("_s"), -1).otherwise(0)).drop("_m", "_s")


def _searched(spark, sf):
    return O.search(bars_1d(spark, sf), O.parameters(spark, GRID), grid_signals, TERMS0)


@query(f"""
    WITH {Q.BARS_1D}, {_grid_sql('b', 'market')}
    SELECT market, param_id, n, k, total_trades, {Q.rounded('total_return_pct sharpe_ratio max_drawdown win_rate')} FROM gm JOIN gp USING (param_id)
""")
def grid_search(spark, sf):
    return rounded(
        _searched(spark, sf).withColumn("param_id", F.col("param_id").cast("int")).withColumn("n", F.col("n").cast("int")),
        "market",
        "param_id",
        "n",
        "k",
        "total_trades",
        "total_return_pct",
        "sharpe_ratio",
        "max_drawdown",
        "win_rate",
    )


@query(f"""
    WITH {Q.BARS_1D}, {_grid_sql('b', 'market')}
    SELECT market, n, round(avg(total_return_pct) FILTER (k = 1.5), 4) + 0.0 AS k_1_5, round(avg(total_return_pct) FILTER (k = 2.0), 4) + 0.0 AS k_2
      FROM gm JOIN gp USING (param_id) GROUP BY market, n
""")
def param_heatmap(spark, sf):
    out = O.heatmap(_searched(spark, sf), "n", "k", "total_return_pct", GRID["k"])
    return rounded(out.select("market", F.col("n").cast("int").alias("n"), F.col("`1.5`").alias("k_1_5"), F.col("`2.0`").alias("k_2")))


@query(f"""
    WITH {Q.BARS_1D}, {_grid_sql('b', 'market')}
    SELECT market, round(regr_slope(total_return_pct, n), 4) + 0.0 AS slope, round(regr_intercept(total_return_pct, n), 4) + 0.0 AS intercept FROM gm
      JOIN gp USING (param_id) GROUP BY market
""")
def param_impact(spark, sf):
    return rounded(O.impact(_searched(spark, sf), "n", "total_return_pct"))


WALK = f"""
    sp AS (SELECT market, min(ts)::DATE AS a, max(ts)::DATE AS z FROM b GROUP BY market),
    ws AS (SELECT market, unnest(generate_series(a::TIMESTAMP, (z - 1050)::TIMESTAMP, INTERVAL 300 DAY))::DATE AS train_from FROM sp
      WHERE z - 1050 >= a),
    wn AS (SELECT *, row_number() OVER (PARTITION BY market
      ORDER BY train_from) - 1 AS window_id, train_from + 700 AS test_from, train_from + 1050 AS test_to FROM ws),
    trn AS (SELECT market, window_id, ts, open, high, low, close, volume, row_number() OVER (PARTITION BY market, window_id ORDER BY ts) - 1 AS idx
      FROM bars JOIN wn USING (market) WHERE ts::DATE >= train_from AND ts::DATE < test_from),
    tst AS (SELECT market, window_id, ts, open, high, low, close, volume, row_number() OVER (PARTITION BY market, window_id ORDER BY ts) - 1 AS idx
      FROM bars JOIN wn USING (market) WHERE ts::DATE >= test_from AND ts::DATE < test_to)"""


@query(f"""
    WITH {Q.BARS_1D}, {WALK},
    a AS (WITH {_grid_sql('trn', 'market, window_id')} SELECT market, window_id, param_id, total_return_pct FROM gm),
    z AS (WITH {_grid_sql('tst', 'market, window_id')} SELECT market, window_id, param_id, total_return_pct FROM gm),
    c AS (SELECT *, row_number() OVER (PARTITION BY market, window_id ORDER BY round(total_return_pct, 9) DESC, param_id) AS rn FROM a)
    SELECT c.market, c.window_id, strftime(wn.train_from, '%Y-%m-%d') AS train_from, strftime(wn.test_from, '%Y-%m-%d') AS test_from, c.param_id,
      round(c.total_return_pct, 4) + 0.0 AS train_metric, round(z.total_return_pct, 4) + 0.0 AS test_metric FROM c JOIN wn USING (market, window_id)
      LEFT JOIN z USING (market, window_id, param_id) WHERE rn = 1""")
def walk_forward(spark, sf):
    out = O.walk_forward(bars_1d(spark, sf), O.parameters(spark, GRID), grid_signals, "total_return_pct", 700, 350, 300, TERMS0)
    return rounded(
        out.withColumn("param_id", F.col("param_id").cast("int")).withColumns(
            {"window_id": F.col("window_id").cast("long"), **{c: F.date_format(c, "yyyy-MM-dd") for c in ("train_from", "test_from")}}
        ),
        "market",
        "window_id",
        "train_from",
        "test_from",
        "param_id",
        "train_metric",
        "test_metric",
    )
