"""Pieces of SQL that the queries' oracles share."""

BARS_1H = """
    bars AS (SELECT event_type AS market, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
                    arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ts) - 1 AS idx FROM bars)"""

BARS_1D = """
    bars AS (SELECT o_orderpriority AS market, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, (o_orderdate,
      o_orderkey)) AS open, max(o_totalprice) AS high,
                    min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, CAST(count(*) AS DOUBLE) AS volume
                      FROM orders GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ts) - 1 AS idx FROM bars)"""

RETURNS_1D = BARS_1D + """,
    r AS (SELECT market, ts, idx, r FROM (SELECT *, close / lag(close) OVER (PARTITION BY market ORDER BY ts) - 1 AS r FROM b) WHERE r IS NOT NULL)"""

W = "(PARTITION BY market ORDER BY ts)"


def rows(n: int, keys: str = "market") -> str:
    return f"(PARTITION BY {keys} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def smooth(name: str, source: str, x: str, n: int, alpha: str, first: int | None = None, seed: str | None = None) -> str:
    """CTEs for y += alpha * (x - y) along idx, from the mean of the first n values, as a fold over each prefix."""
    first = first or n
    seed = seed or f"list_avg(xs[1:{n}])"
    return f"""
    {name}_l AS (SELECT market, list({x} ORDER BY idx) AS xs, list(idx ORDER BY idx) AS ids FROM {source} WHERE {x} IS NOT NULL GROUP BY market),
    {name}_u AS (SELECT market, xs, ids, unnest(range({first}, len(xs) + 1)) AS i FROM {name}_l),
    {name} AS (SELECT market, ids[i] AS idx, list_reduce(xs[{first} + 1:i], lambda a, v: a + ({alpha}) * (v - a), {seed}) AS y FROM {name}_u)"""


def ema(name: str, source: str, x: str, n: int) -> str:
    return smooth(name, source, x, n, f"2.0::DOUBLE / {n + 1}")


def wilder(name: str, source: str, x: str, n: int) -> str:
    return smooth(name, source, x, n, f"1.0::DOUBLE / {n}")


TRUE_RANGE = """
    t AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr
          FROM (SELECT *, lag(close) OVER (PARTITION BY market ORDER BY ts) AS pc FROM b))"""

BOLLINGER = f"""
    w AS (SELECT *, CASE WHEN count(close) OVER {rows(20)} >= 20 THEN avg(close) OVER {rows(20)} END AS middle, CASE
      WHEN count(close) OVER {rows(20)} >= 20 THEN stddev_pop(close) OVER {rows(20)} END AS dev FROM b),
    boll AS (SELECT *, middle + 2 * dev AS upper, middle - 2 * dev AS lower FROM w)"""

#: signal of the bands, and limited by a holding period
BOLL_SIGNAL = f"""{BOLLINGER},
    raw AS (SELECT *, CASE WHEN close < lower THEN 1 WHEN close > upper THEN -1 ELSE 0 END AS s0 FROM boll),
    run0 AS (SELECT *, sum(c) OVER (PARTITION BY market ORDER BY ts) AS g FROM (SELECT *, CASE WHEN s0 IS DISTINCT
      FROM lag(s0) OVER {W} OR idx = 0 THEN 1 ELSE 0 END AS c FROM raw)),
    sig AS (SELECT market, ts, open, high, low, close, volume, idx, CASE WHEN row_number() OVER (PARTITION BY market, g ORDER BY ts) % 4 = 0 THEN 0
      ELSE s0 END AS signal FROM run0)"""


def trades(
    source: str = "sig", keys: str = "market", capital: float = 10000, pct: str = "10", stop: str = "2", target: str = "4", name: str = "tr"
) -> str:
    """Trades by a range join of entries with the bars behind them."""
    on = " AND ".join(f"e.{k} = x.{k}" for k in keys.split(", "))
    return f"""
    {name}_n AS (SELECT *, lag(signal) OVER (PARTITION BY {keys} ORDER BY idx) AS prev FROM {source}),
    {name}_e AS (SELECT {', '.join('e.' + k for k in keys.split(', '))}, e.idx AS entry_idx, e.ts AS entry_time, e.signal AS direction,
      e.close * (1 + 0.0005::DOUBLE * e.signal) AS entry_price,
                        e.close * (1 + 0.0005::DOUBLE * e.signal) * (1 + 0.001::DOUBLE * e.signal) AS entry_eff FROM {name}_n e
                          WHERE e.idx >= 1 AND e.signal <> 0 AND e.signal <> e.prev),
    {name}_s AS (SELECT *, entry_eff * (1 - {stop}::DOUBLE / 100 * direction) AS sl, entry_eff * (1 + {target}::DOUBLE / 100 * direction) AS tp,
      coalesce(lead(entry_idx) OVER (PARTITION BY {keys} ORDER BY entry_idx), 1000000000) AS nxt FROM {name}_e),
    {name}_b AS (SELECT {', '.join('e.' + k for k in keys.split(', '))}, e.entry_idx, min(x.idx) AS border FROM {name}_s e
      JOIN {name}_n x ON {on} AND x.idx > e.entry_idx AND x.signal <> e.direction GROUP BY ALL),
    {name}_x AS (SELECT {', '.join('e.' + k for k in keys.split(', '))}, e.entry_idx, x.idx AS exit_idx, x.ts AS exit_time, e.direction AS d, e.sl,
      e.tp, x.close,
                        CASE WHEN (e.direction = 1 AND x.low <= e.sl) OR (e.direction = -1 AND x.high >= e.sl) THEN 'STOP_LOSS'
                          WHEN (e.direction = 1 AND x.high >= e.tp) OR (e.direction = -1 AND x.low <= e.tp) THEN 'TAKE_PROFIT'
                          WHEN x.idx = k.border THEN 'SIGNAL' END AS why
                 FROM {name}_s e LEFT JOIN {name}_b k USING ({keys}, entry_idx)
                   JOIN {name}_n x ON {on} AND x.idx > e.entry_idx AND x.idx <= coalesce(k.border, 1000000000)),
    {name}_f AS (SELECT {keys}, entry_idx,
      arg_min({{'exit_idx': exit_idx, 'exit_time': exit_time, 'why': why, 'level': CASE why WHEN 'STOP_LOSS' THEN sl WHEN 'TAKE_PROFIT' THEN tp ELSE close END}}, exit_idx) AS x FROM {name}_x WHERE why IS NOT NULL GROUP BY ALL),
    {name}_l AS (SELECT {keys}, arg_max({{'exit_idx': idx, 'exit_time': ts, 'why': 'END_OF_BACKTEST', 'level': close}}, idx) AS z FROM {name}_n
      GROUP BY ALL),
    {name}_y AS (SELECT e.*, coalesce(f.x, l.z) AS x FROM {name}_s e LEFT JOIN {name}_f f USING ({keys}, entry_idx) JOIN {name}_l l USING ({keys})),
    {name}_p AS (SELECT *, x.exit_idx AS exit_idx, x.exit_time AS exit_time, x.why AS exit_reason,
                        CASE x.why WHEN 'END_OF_BACKTEST' THEN x.level WHEN 'TAKE_PROFIT' THEN x.level * (1 - 0.001::DOUBLE * direction)
                          ELSE x.level * (1 - 0.0005::DOUBLE * direction) * (1 - 0.001::DOUBLE * direction) END AS exit_price FROM {name}_y),
    {name}_g AS (SELECT *, 1 + {pct}::DOUBLE / 100 * direction * (exit_price - entry_eff) / entry_price AS growth FROM {name}_p),
    {name}_c AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY entry_idx) AS trade, {capital} * product(growth) OVER (PARTITION BY {keys}
      ORDER BY entry_idx) AS capital_after FROM {name}_g),
    {name}_d AS (SELECT *, coalesce(lag(capital_after) OVER (PARTITION BY {keys} ORDER BY entry_idx), {capital}) AS capital_before FROM {name}_c),
    {name} AS (SELECT * EXCLUDE (x, sl, tp, nxt, growth), capital_before * {pct}::DOUBLE / 100 / entry_price AS size,
      (exit_price - entry_eff) * direction * capital_before * {pct}::DOUBLE / 100 / entry_price AS pnl,
                      (exit_price / entry_eff - 1) * 100 * direction AS pnl_pct FROM {name}_d)"""


def equity(source: str = "sig", keys: str = "market", capital: float = 10000, tr: str = "tr", name: str = "eq") -> str:
    return f"""
    {name}_k AS (SELECT {', '.join('x.' + k for k in keys.split(', '))}, x.idx, x.ts, x.close, coalesce(arg_max(t.capital_after,
      t.trade) FILTER (t.exit_idx < x.idx), {capital}) AS cash,
                        coalesce(sum((x.close - t.entry_eff) * t.direction * t.size) FILTER (t.exit_idx >= x.idx), 0) AS unrealized_pnl
                 FROM {source} x LEFT JOIN {tr} t ON {' AND '.join(f'x.{k} = t.{k}' for k in keys.split(', '))} AND t.entry_idx < x.idx
                   WHERE x.idx >= 1 GROUP BY ALL),
    {name} AS (SELECT *, cash + unrealized_pnl AS equity FROM {name}_k)"""


def metrics(keys: str = "market", capital: float = 10000, tr: str = "tr", eq: str = "eq", name: str = "mt") -> str:
    return f"""
    {name}_u AS (SELECT {keys}, idx, 0 AS kind, 0 AS trade, equity AS v FROM {eq} UNION ALL SELECT {keys}, exit_idx, 1, trade, capital_after
      FROM {tr}),
    {name}_dd AS (SELECT {keys}, max((pk - v) / pk * 100) AS max_drawdown FROM (SELECT *, greatest({capital}, max(v) OVER (PARTITION BY {keys}
      ORDER BY idx, kind, trade)) AS pk FROM {name}_u) GROUP BY ALL),
    {name}_days AS (SELECT {keys}, ts::DATE AS day, arg_max(equity, ts) AS e FROM {eq} GROUP BY ALL),
    {name}_span AS (SELECT {keys}, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM {name}_days
      GROUP BY {keys}),
    {name}_fill AS (SELECT {keys}, day, last_value(e IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY day) AS e FROM {name}_span LEFT
      JOIN {name}_days USING ({keys}, day)),
    {name}_ret AS (SELECT {keys}, e / lag(e) OVER (PARTITION BY {keys} ORDER BY day) - 1 AS r FROM {name}_fill),
    {name}_sh AS (SELECT {keys}, CASE WHEN stddev_samp(r) > 1e-12 THEN sqrt(252) * avg(r) / stddev_samp(r) ELSE 0 END AS sharpe_ratio FROM {name}_ret
      GROUP BY ALL),
    {name}_days2 AS (SELECT {keys}, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::BIGINT AS days FROM {eq} GROUP BY ALL),
    {name}_t AS (SELECT {keys}, arg_max(capital_after, trade) / {capital} - 1 AS growth, avg((pnl > 0)::INT) AS win_rate, count(*) AS total_trades,
      count(*) FILTER (pnl > 0) AS profitable_trades, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_profit_trade,
                        coalesce(avg(pnl) FILTER (pnl < 0), 0) AS avg_loss_trade, coalesce(max(pnl) FILTER (pnl > 0), 0) AS largest_win,
                          coalesce(min(pnl) FILTER (pnl < 0), 0) AS largest_loss,
                        avg((epoch_us(exit_time) - epoch_us(entry_time)) / 3.6e9) AS avg_trade_duration_hours, coalesce(sum(pnl) FILTER (pnl > 0),
                          0) / -(sum(pnl) FILTER (pnl < 0)) AS profit_factor FROM {tr} GROUP BY ALL),
    {name} AS (SELECT {keys}, growth * 100 AS total_return_pct, CASE WHEN days > 0 THEN (pow(1 + growth, 365.0 / days) - 1) * 100
      ELSE 0 END AS annualized_return_pct, win_rate, max_drawdown, coalesce(sharpe_ratio, 0) AS sharpe_ratio, total_trades, profitable_trades,
                      avg_profit_trade, avg_loss_trade, largest_win, largest_loss, avg_trade_duration_hours, profit_factor
               FROM {name}_t JOIN {name}_dd USING ({keys}) JOIN {name}_sh USING ({keys}) JOIN {name}_days2 USING ({keys}))"""


def rounded(columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns.split())
