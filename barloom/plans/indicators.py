"""Queries of bars and indicators."""

from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions import recurrences as R
from ..functions import series as S
from ..operators import bars as B
from ..sources.bars import bars_1d, bars_1h
from . import query, rounded
from . import sql as Q

H1 = f"WITH {Q.BARS_1H}"
HLC = ("high", "low", "close")
#: bars in a block of the smoothed indicators: small, so that the tables' short series have several
BLOCK = 200


def _np(p, *names):
    return tuple(p[c].to_numpy(float) for c in names)


@query(f"{H1} SELECT market, ts, {Q.rounded('open high low close volume')} FROM b")
def resample_ohlcv(spark, sf):
    return rounded(bars_1h(spark, sf), "market", "ts", "open", "high", "low", "close", "volume")


@query(f"""{H1}, s AS (SELECT market, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b GROUP BY market)
    SELECT s.market, s.ts, {Q.rounded('open high low close')}, coalesce(volume, 0) AS volume FROM s LEFT JOIN b ON b.market = s.market AND b.ts = s.ts""")
def resample_spine(spark, sf):
    return rounded(B.spine(bars_1h(spark, sf), "1 hour"), "market", "ts", "open", "high", "low", "close", "volume")


@query(f"""WITH {Q.BARS_1D}, k AS (SELECT *, (date_trunc('week', ts) + INTERVAL 6 DAY)::TIMESTAMP AS week FROM b)
    SELECT market, week AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
      FROM k GROUP BY market, week""")
def resample_weekly(spark, sf):
    return B.resample(bars_1d(spark, sf), "1W").select("market", "ts", "open", "high", "low", "close", "volume")


@query("""
    SELECT event_type AS market, date_trunc('day', ts)::TIMESTAMP AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
      min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2
""")
def resample_daily_from_hours(spark, sf):
    return B.resample(bars_1h(spark, sf), "1D").select("market", "ts", "open", "high", "low", "close", "volume")


@query(f"""
    {H1}
    SELECT market, count(*) AS n, count(*) - count(DISTINCT ts) AS n_duplicates, 0::BIGINT AS n_nulls,
      floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000)::BIGINT + 1 AS n_expected FROM b GROUP BY market
""")
def integrity_check(spark, sf):
    return B.integrity(bars_1h(spark, sf), 60)


@query(f"{H1} SELECT market, ts, round(CASE WHEN count(close) OVER {Q.rows(14)} >= 14 THEN avg(close) OVER {Q.rows(14)} END, 4) AS sma FROM b")
def sma(spark, sf):
    return rounded(bars_1h(spark, sf).withColumn("sma", S.sma("close", 14)), "market", "ts", "sma")


@query(f"{H1}, {Q.ema('e', 'b', 'close', 14)} SELECT market, ts, round(y, 4) AS ema FROM b LEFT JOIN e USING (market, idx)")
def ema(spark, sf):
    return rounded(R.by_series(bars_1h(spark, sf), {"ema": lambda p: R.ema(_np(p, "close")[0], 14)}), "market", "ts", "ema")


@query(f"{H1}, {Q.ema('e', 'b', 'close', 14)} SELECT market, ts, round(y, 4) AS ema FROM e JOIN b USING (market, idx)")
def ema_blocks(spark, sf):
    """The same average by affine blocks, for series of any length."""
    out = R.with_ema(bars_1h(spark, sf), 14, block=BLOCK)
    return rounded(out.filter(F.col("ema").isNotNull()).select("market", "ts", "ema"))


@query(f"""
    {H1},
    c AS (SELECT *, close - lag(close) OVER {Q.W} AS d FROM b),
    g AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM c WHERE d IS NOT NULL),
    {Q.wilder('u', 'g', 'up', 14)}, {Q.wilder('v', 'g', 'dn', 14)}
    SELECT market, ts, round(CASE WHEN u.y IS NOT NULL THEN CASE WHEN u.y + v.y = 0 THEN 0 ELSE 100 * u.y / (u.y + v.y) END END, 4) AS rsi FROM b LEFT
      JOIN u USING (market, idx) LEFT JOIN v USING (market, idx)""")
def rsi(spark, sf):
    return rounded(R.with_rsi(bars_1h(spark, sf), 14, block=BLOCK), "market", "ts", "rsi")


MACD = f"""late AS (SELECT * FROM b WHERE idx >= 14), {Q.ema('f', 'late', 'close', 12)}, {Q.ema('s', 'b', 'close', 26)},
    l AS (SELECT market, idx, f.y - s.y AS line FROM f JOIN s USING (market, idx)), {Q.ema('g', 'l', 'line', 9)}"""


@query(f"""
    {H1}, {MACD}
    SELECT b.market, b.ts, round(line, 4) + 0.0 AS macd, round(g.y, 4) + 0.0 AS macd_signal FROM b LEFT JOIN l USING (market, idx) LEFT
      JOIN g USING (market, idx)
""")
def macd(spark, sf):
    return rounded(R.with_macd(bars_1h(spark, sf), 12, 26, 9, block=BLOCK), "market", "ts", "macd", "macd_signal")


@query(f"{H1}, {Q.BOLLINGER} SELECT market, ts, {Q.rounded('middle upper lower')} FROM boll")
def bollinger(spark, sf):
    return rounded(I.bollinger(bars_1h(spark, sf)), "market", "ts", "middle", "upper", "lower")


@query(f"""
    {H1}, {Q.BOLLINGER}
    SELECT market, ts, round(CASE WHEN middle IS NOT NULL THEN CASE WHEN upper = lower THEN 0.5
      ELSE (close - lower) / (upper - lower) END END, 4) + 0.0 AS percent_b,
    round(CASE WHEN middle = 0 THEN 0 ELSE (upper - lower) / middle END, 4) AS bandwidth FROM boll""")
def percent_b(spark, sf):
    return rounded(I.bollinger(bars_1h(spark, sf)), "market", "ts", "percent_b", "bandwidth")


@query(f"""{H1}, {Q.BOLLINGER}, q AS (SELECT *, (upper - lower) / middle AS bw FROM boll),
    z AS (SELECT *, count(bw) OVER k AS n, min(bw) OVER k AS m FROM q WINDOW k AS (PARTITION BY market
      ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT market, ts, CASE WHEN n >= 20 THEN bw < m ELSE false END AS squeeze FROM z""")
def squeeze(spark, sf):
    return I.squeeze(I.bollinger(bars_1h(spark, sf))).select("market", "ts", "squeeze")


STOCH = f"""
    h AS (SELECT *, CASE WHEN count(*) OVER {Q.rows(14)} >= 14 THEN max(high) OVER {Q.rows(14)} END AS hh, CASE
      WHEN count(*) OVER {Q.rows(14)} >= 14 THEN min(low) OVER {Q.rows(14)} END AS ll FROM b),
    k0 AS (SELECT *, CASE WHEN hh = ll THEN 0 ELSE 100 * (close - ll) / (hh - ll) END AS raw FROM h),
    k1 AS (SELECT *, CASE WHEN count(raw) OVER {Q.rows(3)} >= 3 THEN avg(raw) OVER {Q.rows(3)} END AS k FROM k0),
    st AS (SELECT *, CASE WHEN count(k) OVER {Q.rows(3)} >= 3 THEN avg(k) OVER {Q.rows(3)} END AS slow_d FROM k1)"""


@query(f"""
    {H1}, {STOCH}
    SELECT market, ts, round(CASE WHEN slow_d IS NOT NULL THEN k END, 4) + 0.0 AS slow_k, round(slow_d, 4) + 0.0 AS slow_d FROM st
""")
def stochastic(spark, sf):
    return rounded(I.stochastic(bars_1h(spark, sf)), "market", "ts", "slow_k", "slow_d")


@query(f"{H1}, {STOCH} SELECT market, ts, round(CASE WHEN hh = ll THEN 0 ELSE -100 * (hh - close) / (hh - ll) END, 4) + 0.0 AS williams_r FROM st")
def williams_r(spark, sf):
    return rounded(bars_1h(spark, sf).withColumn("williams_r", I.williams_r()), "market", "ts", "williams_r")


CCI = f"""tp AS (SELECT *, (high + low + close) / 3 AS tp FROM b), tl AS (SELECT *, list(tp) OVER {Q.rows(20)} AS xs FROM tp),
    tc AS (SELECT *, list_avg(xs) AS m, list_avg([abs(x - list_avg(xs)) for x in xs]) AS dev FROM tl WHERE len(xs) >= 20)"""


@query(f"""
    {H1}, {CCI}
    SELECT b.market, b.ts, round(CASE WHEN dev < 1e-12 THEN 0 ELSE (tp - m) / (0.015::DOUBLE * dev) END, 4) + 0.0 AS cci FROM b LEFT
      JOIN tc USING (market, idx)
""")
def cci(spark, sf):
    return rounded(I.cci(bars_1h(spark, sf)), "market", "ts", "cci")


ADX = f"""mv AS (SELECT *, high - lag(high) OVER {Q.W} AS u, lag(low) OVER {Q.W} - low AS d FROM t),
    dm AS (SELECT *, CASE WHEN u > d AND u > 0 THEN u ELSE 0 END AS pdm, CASE WHEN d > u AND d > 0 THEN d ELSE 0 END AS mdm FROM mv WHERE idx >= 1),
    sm AS (SELECT market, list(pdm ORDER BY idx) AS ps, list(mdm ORDER BY idx) AS ms, list(tr ORDER BY idx) AS trs FROM dm GROUP BY market),
    su AS (SELECT *, unnest(range(14, len(ps) + 1)) AS i FROM sm),
    sv AS (SELECT market, i AS idx, list_reduce(ps[14:i], lambda a, v: a - a / 14 + v, list_sum(ps[1:13])) AS p, list_reduce(ms[14:i], lambda a,
      v: a - a / 14 + v, list_sum(ms[1:13])) AS m, list_reduce(trs[14:i], lambda a, v: a - a / 14 + v, list_sum(trs[1:13])) AS r FROM su),
    di AS (SELECT market, idx, CASE WHEN r = 0 THEN 0 ELSE 100 * p / r END AS plus_di, CASE WHEN r = 0 THEN 0 ELSE 100 * m / r END AS minus_di
      FROM sv),
    dx AS (SELECT *, CASE WHEN plus_di + minus_di = 0 THEN 0 ELSE 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END AS dx
      FROM di), {Q.wilder('ax', 'dx', 'dx', 14)}"""


@query(f"""
    {H1}, {Q.TRUE_RANGE}, {ADX}
    SELECT b.market, b.ts, {Q.rounded('plus_di minus_di')}, round(ax.y, 4) AS adx FROM b LEFT JOIN di USING (market, idx) LEFT
      JOIN ax USING (market, idx)
""")
def adx_di(spark, sf):
    return rounded(R.with_directional(bars_1h(spark, sf), 14, block=BLOCK), "market", "ts", "plus_di", "minus_di", "adx")


@query(f"{H1}, {Q.TRUE_RANGE}, {Q.wilder('a', 't', 'tr', 14)} SELECT market, ts, round(a.y, 4) AS atr FROM b LEFT JOIN a USING (market, idx)")
def atr_wilder(spark, sf):
    return rounded(R.with_atr(bars_1h(spark, sf), 14, block=BLOCK), "market", "ts", "atr")


ATR_SIMPLE = f"{Q.TRUE_RANGE}, ats AS (SELECT *, CASE WHEN count(tr) OVER {Q.rows(10)} >= 10 THEN avg(tr) OVER {Q.rows(10)} END AS atr FROM t)"


@query(f"{H1}, {ATR_SIMPLE} SELECT market, ts, round(atr, 4) AS atr FROM ats")
def atr_simple(spark, sf):
    return rounded(bars_1h(spark, sf).withColumn("atr", I.atr_simple()), "market", "ts", "atr")


SUPERTREND = f"""{ATR_SIMPLE}, sb AS (SELECT market, idx, ts, close, (high + low) / 2 + 3 * atr AS ub, (high + low) / 2 - 3 * atr AS lb FROM ats),
    su(market, idx, close, up, lo, dir, line) AS (
        SELECT market, idx, close, ub, lb, 1, 0.0::DOUBLE FROM sb WHERE idx = 0
        UNION ALL
        SELECT market, idx, close, u2, l2, dir, CASE WHEN dir = -1 THEN l2 ELSE u2 END FROM (
            SELECT x.market, x.idx, x.close, d.dir, CASE WHEN d.steady AND d.dir = 1 AND p.up < x.ub THEN p.up ELSE x.ub END AS u2, CASE
              WHEN d.steady AND d.dir = -1 AND p.lo > x.lb THEN p.lo ELSE x.lb END AS l2
            FROM su p JOIN sb x ON x.market = p.market AND x.idx = p.idx + 1,
            LATERAL (SELECT CASE WHEN p.close > p.up THEN -1 WHEN p.close < p.lo THEN 1
              ELSE p.dir END AS dir, NOT (coalesce(p.close > p.up, false) OR coalesce(p.close < p.lo, false)) AS steady) d))"""


@query(f"""
    {H1.replace('WITH', 'WITH RECURSIVE')}, {SUPERTREND}
    SELECT b.market, b.ts, round(su.line, 4) AS supertrend, su.dir AS direction FROM b JOIN su USING (market, idx)
""")
def supertrend(spark, sf):
    made = {n: lambda p, k=k: R.supertrend(*_np(p, *HLC), 10, 3.0)[k] for k, n in enumerate(("supertrend", "direction"))}
    return rounded(
        R.by_series(bars_1h(spark, sf), made).withColumn("direction", F.col("direction").cast("int")),
        "market",
        "ts",
        "supertrend",
        "direction",
    )


@query(f"""
    {H1}, {ATR_SIMPLE},
    q AS (SELECT *, CASE WHEN count(atr) OVER {Q.rows(100)} >= 100 THEN min(atr) OVER {Q.rows(100)} END AS lo, CASE
      WHEN count(atr) OVER {Q.rows(100)} >= 100 THEN max(atr) OVER {Q.rows(100)} END AS hi FROM ats),
    f AS (SELECT *, abs(atr - (lo + (hi - lo) * 0.75)) AS a, abs(atr - (lo + (hi - lo) * 0.5)) AS m, abs(atr - (lo + (hi - lo) * 0.25)) AS c FROM q)
    SELECT market, ts, CASE WHEN a IS NULL THEN 0 WHEN a <= m AND a <= c THEN 0 WHEN m <= c THEN 1 ELSE 2 END AS cluster FROM f""")
def vol_cluster(spark, sf):
    return I.volatility_cluster(bars_1h(spark, sf).withColumn("atr", I.atr_simple()), "atr").select("market", "ts", "cluster")


WAVE = f"""wh AS (SELECT *, (high + low + close) / 3 AS h3 FROM b), {Q.ema('wa', 'wh', 'h3', 10)},
    wd AS (SELECT wh.market, wh.idx, h3, wa.y AS esa, abs(h3 - wa.y) AS far FROM wh JOIN wa USING (market, idx)), {Q.ema('wf', 'wd', 'far', 10)},
    wc AS (SELECT wd.market, wd.idx, (h3 - esa) / (0.015::DOUBLE * wf.y) AS ci FROM wd JOIN wf USING (market, idx)
      WHERE wf.y <> 0), {Q.ema('wt', 'wc', 'ci', 11)}"""


@query(f"{H1}, {WAVE} SELECT market, ts, round(wt.y, 4) + 0.0 AS wavetrend FROM b LEFT JOIN wt USING (market, idx)")
def wavetrend(spark, sf):
    return rounded(R.with_wave_trend(bars_1h(spark, sf), 10, 11, block=BLOCK), "market", "ts", "wavetrend")


@query(f"""{H1}, w AS (SELECT unnest(range(1, 9)) AS d), k AS (SELECT d, pow(1 + d * d / (2 * 8.0::DOUBLE * 25), -8) AS w FROM w)
    SELECT b.market, b.ts, round(coalesce(CASE WHEN b.idx >= 8 THEN sum(k.w * p.close) / sum(k.w) END, 0), 4) AS kernel FROM b CROSS JOIN k LEFT
      JOIN b p ON p.market = b.market AND p.idx = b.idx - k.d GROUP BY b.market, b.ts, b.idx""")
def kernel_regression(spark, sf):
    return rounded(bars_1h(spark, sf).withColumn("kernel", I.kernel_regression()), "market", "ts", "kernel")


@query(f"""{H1}, q AS (SELECT *, close / lag(close) OVER {Q.W} - 1 AS r FROM b),
    z AS (SELECT *, count(*) OVER {Q.rows(20)} AS n, stddev_samp(r) OVER {Q.rows(19)} AS sd,
      max(high) OVER {Q.rows(20)} - min(low) OVER {Q.rows(20)} AS span, abs(close - lag(close, 19) OVER {Q.W}) AS mv FROM q)
    SELECT market, ts, CASE WHEN n < 20 THEN 'trend' WHEN sd > 0.9 THEN 'volatile' WHEN span > 0 AND mv / span > 0.5 THEN 'trend'
      ELSE 'range' END AS regime FROM z""")
def regime(spark, sf):
    return I.regime(bars_1h(spark, sf), volatile=0.9).select("market", "ts", "regime")


FEATURES = """
    ret momentum_5 momentum_10 momentum_20 volatility_5 volatility_20 price_to_sma_10 price_to_sma_20 high_low_range to_high to_low volume_change
      volume_ratio price_volume_corr
"""


def _sql_window(f: str, n: int, x: str = "close") -> str:
    return f"CASE WHEN count({x}) OVER {Q.rows(n)} >= {n} THEN {f}({x}) OVER {Q.rows(n)} END"


@query(f"""WITH {Q.BARS_1D}, q AS (SELECT *, close / lag(close) OVER {Q.W} - 1 AS ret FROM b),
    f AS (SELECT market, ts, ret, {', '.join(f'close / lag(close, {n}) OVER {Q.W} - 1 AS momentum_{n}' for n in (5, 10, 20))},
      {', '.join(f"{_sql_window('stddev_samp', n, 'ret')} AS volatility_{n}" for n in (5, 20))},
      {', '.join(f"close / ({_sql_window('avg', n)}) - 1 AS price_to_sma_{n}" for n in (10, 20))}, (high - low) / close AS high_low_range,
        close / ({_sql_window('max', 20, 'high')}) - 1 AS to_high, close / ({_sql_window('min', 20, 'low')}) - 1 AS to_low,
      volume / lag(volume) OVER {Q.W} - 1 AS volume_change, volume / ({_sql_window('avg', 20, 'volume')}) AS volume_ratio,
      CASE WHEN count(ret) OVER {Q.rows(20)} >= 20 AND stddev_pop(ret) OVER {Q.rows(20)} * stddev_pop(volume) OVER {Q.rows(20)} > 1e-12 THEN corr(ret,
        volume) OVER {Q.rows(20)} END AS price_volume_corr FROM q)
    SELECT market, ts, {Q.rounded(FEATURES)} FROM f""")
def feature_matrix(spark, sf):
    return rounded(I.features(bars_1d(spark, sf)), "market", "ts", *FEATURES.split())


@query("SELECT event_type AS market, user_id, arg_max(value, (ts, event_id)) AS price, max(ts) AS ts FROM events GROUP BY 1, 2")
def dedupe_latest(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select(
        F.col("event_type").alias("market"), "user_id", F.col("value").alias("price"), "ts", F.struct("ts", "event_id").alias("at")
    )
    return B.latest(rows, ["market", "user_id"], "at").select("market", "user_id", "price", "ts")
