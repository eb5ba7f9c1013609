"""Queries of signals, strategies and learning indicators."""

from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions import recurrences as R
from ..functions import series as S
from ..operators import learn as L
from ..operators import strategy as T
from ..sources.bars import bars_1d, bars_1h
from . import query, rounded
from . import sql as Q
from .indicators import ADX, CCI, H1, MACD, STOCH, WAVE

HLC = ("high", "low", "close")


def _cross(a: str, b: str) -> str:
    d = f"({a} - {b})"
    return f"CASE WHEN lag{d} OVER {Q.W} < 0 AND {d} > 0 THEN 1 WHEN lag{d} OVER {Q.W} > 0 AND {d} < 0 THEN -1 ELSE 0 END"


@query(f"""
    {H1}, {MACD},
    ms AS (SELECT b.market, b.ts, line, g.y AS trig FROM b LEFT JOIN l USING (market, idx) LEFT JOIN g USING (market, idx))
    SELECT market, ts, {_cross('line', 'trig')} AS signal FROM ms
""")
def macd_signal(spark, sf):
    made = {
        "line": lambda p: R.macd(p["close"].to_numpy(float), 12, 26, 9)[0], "trigger": lambda p: R.macd(p["close"].to_numpy(float), 12, 26, 9)[1]
    }
    return R.by_series(bars_1h(spark, sf), made).select("market", "ts", S.cross("line", "trigger").alias("signal"))


@query(f"""
    {H1}, {STOCH},
    x AS (SELECT *, CASE WHEN slow_d IS NOT NULL THEN k END AS slow_k FROM st),
    y AS (SELECT *, {_cross('slow_k', 'slow_d')} AS c FROM x)
    SELECT market, ts, CASE WHEN slow_k < 20 AND slow_d < 20 AND c = 1 THEN 1 WHEN slow_k > 80 AND slow_d > 80 AND c = -1 THEN -1 ELSE 0 END AS signal
      FROM y""")
def stochastic_signal(spark, sf):
    return I.stochastic(bars_1h(spark, sf)).select("market", "ts", T.stochastic_signal().alias("signal"))


@query(f"""
    {H1}, {CCI},
    y AS (SELECT b.*, CASE WHEN dev < 1e-12 THEN 0 ELSE (tp - m) / (0.015::DOUBLE * dev) END AS cci FROM b LEFT JOIN tc USING (market, idx))
    SELECT market, ts, CASE WHEN {_cross('cci', '-100')} = 1 THEN 1 WHEN {_cross('cci', '100')} = -1 THEN -1 ELSE 0 END AS signal FROM y""")
def cci_signal(spark, sf):
    return I.cci(bars_1h(spark, sf)).select("market", "ts", T.cci_signal().alias("signal"))


@query(f"""{H1}, {STOCH}, y AS (SELECT *, CASE WHEN hh = ll THEN 0 ELSE -100 * (hh - close) / (hh - ll) END AS wr FROM st)
    SELECT market, ts, CASE WHEN {_cross('wr', '-80')} = 1 THEN 1 WHEN {_cross('wr', '-20')} = -1 THEN -1
      ELSE 0 END AS cross_levels, {_cross('wr', '-50')} AS cross_middle FROM y""")
def cross_signals(spark, sf):
    rows = bars_1h(spark, sf).withColumn("williams_r", I.williams_r())
    return rows.select("market", "ts", T.williams_signal().alias("cross_levels"), S.cross("williams_r", F.lit(-50.0)).alias("cross_middle"))


@query(f"""
    {H1}, {Q.TRUE_RANGE}, {ADX},
    y AS (SELECT b.market, b.ts, plus_di, minus_di, ax.y AS adx FROM b LEFT JOIN di USING (market, idx) LEFT JOIN ax USING (market, idx))
    SELECT market, ts, CASE WHEN adx > 25 THEN {_cross('plus_di', 'minus_di')}
      ELSE 0 END AS signal, coalesce(sign(plus_di - minus_di), 0)::INT AS direction FROM y""")
def adx_signal(spark, sf):
    made = {
        n: lambda p, k=k: R.directional(*(p[c].to_numpy(float) for c in HLC), 14)[k] for k, n in enumerate(("plus_di", "minus_di", "adx"))
    }
    rows = R.by_series(bars_1h(spark, sf), made)
    return rows.select(
        "market",
        "ts",
        T.adx_signal().alias("signal"),
        F.coalesce(F.signum(F.col("plus_di") - F.col("minus_di")), F.lit(0)).cast("int").alias("direction"),
    )


@query(f"{H1}, {Q.BOLL_SIGNAL} SELECT market, ts, signal FROM sig")
def holding_limiter(spark, sf):
    rows = I.bollinger(bars_1h(spark, sf)).withColumn("raw", I.bollinger_signal())
    return S.held(rows, "raw", 3, "signal").select("market", "ts", "signal")


GATE = f"""{Q.TRUE_RANGE}, {Q.wilder('a', 't', 'tr', 10)}, vc AS (SELECT market, idx, volume - lag(volume) OVER {Q.W} AS d FROM b),
    vg AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM vc
      WHERE d IS NOT NULL), {Q.wilder('u', 'vg', 'up', 14)}, {Q.wilder('v', 'vg', 'dn', 14)},
    gt AS (SELECT t.market, t.ts, t.idx, t.close, t.idx < 10 OR (coalesce(t.tr > a.y, true) AND coalesce(round(CASE WHEN u.y + v.y = 0 THEN 0
      ELSE 100 * u.y / (u.y + v.y) END, 9) > 49, true)) AS gate
           FROM t LEFT JOIN a USING (market, idx) LEFT JOIN u USING (market, idx) LEFT JOIN v USING (market, idx))"""


@query(f"{H1}, {GATE} SELECT market, ts, gate FROM gt")
def gate_filter(spark, sf):
    return T.gate(bars_1h(spark, sf)).select("market", "ts", "gate")


RSI = f"""
    rc AS (SELECT *, close - lag(close) OVER {Q.W} AS d FROM b),
    rg AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM rc WHERE d IS NOT NULL),
    {Q.wilder('ru', 'rg', 'up', 14)}, {Q.wilder('rd', 'rg', 'dn', 14)},
    rs AS (SELECT market, idx, CASE WHEN ru.y + rd.y = 0 THEN 0 ELSE 100 * ru.y / (ru.y + rd.y) END AS rsi FROM ru JOIN rd USING (market, idx))"""


@query(f"""
    {H1}, {RSI},
    s AS (SELECT b.market, b.ts, CASE WHEN rsi > 70 THEN -1 WHEN rsi < 30 THEN 1 ELSE 0 END AS s0, b.idx FROM b LEFT JOIN rs USING (market, idx)),
    c AS (SELECT *, CASE WHEN idx = 0 OR s0 <> lag(s0) OVER {Q.W} THEN 1 ELSE 0 END AS c FROM s), g AS (SELECT *, sum(c) OVER {Q.W} AS g FROM c)
    SELECT market, ts, CASE WHEN row_number() OVER (PARTITION BY market, g ORDER BY ts) % 4 = 0 THEN 0 ELSE s0 END AS signal FROM g""")
def rsi_signal(spark, sf):
    rows = R.by_series(bars_1h(spark, sf), {"rsi": lambda p: R.rsi(p["close"].to_numpy(float), 14)}).withColumn("raw", T.rsi_signal())
    return S.held(rows, "raw", 3, "signal").select("market", "ts", "signal")


@query(f"""{H1}, {STOCH}, {Q.BOLLINGER}, y AS (SELECT s.market, s.ts, CASE WHEN s.close < lower THEN 1 WHEN s.close > upper THEN -1 ELSE 0 END AS s1,
      CASE WHEN hh = ll THEN 0 WHEN -100 * (hh - s.close) / (hh - ll) < -80 THEN 1 WHEN -100 * (hh - s.close) / (hh - ll) > -20 THEN -1
        ELSE 0 END AS s2,
      CASE WHEN k < 20 AND slow_d IS NOT NULL THEN 1 WHEN k > 80 AND slow_d IS NOT NULL THEN -1 ELSE 0 END AS s3, CASE WHEN s.close > s.open THEN 1
        WHEN s.close < s.open THEN -1 ELSE 0 END AS s4
      FROM st s JOIN boll USING (market, idx))
    SELECT market, ts, CASE WHEN 2 * s1 + 2 * s2 + s3 + s4 > 2 THEN 1 WHEN 2 * s1 + 2 * s2 + s3 + s4 < -2 THEN -1 ELSE 0 END AS signal FROM y""")
def multi_indicator(spark, sf):
    rows = I.stochastic(I.bollinger(bars_1h(spark, sf))).withColumn("w", I.williams_r())
    level = lambda c, low, high: F.when(F.col(c) < low, 1).when(F.col(c) > high, -1).otherwise(0)
    rows = rows.withColumns(
        {
            "s1": I.bollinger_signal(),
            "s2": level("w", -80, -20),
            "s3": level("slow_k", 20, 80),
            "s4": F.signum(F.col("close") - F.col("open")).cast("int"),
        }
    )
    return rows.select("market", "ts", T.weighted(["s1", "s2", "s3", "s4"], threshold=2.0).alias("signal"))


@query(f"""{H1}, {STOCH}, {Q.BOLLINGER}, q AS (SELECT *, close / lag(close) OVER {Q.W} - 1 AS r FROM b),
    z AS (SELECT *, count(*) OVER {Q.rows(20)} AS n, stddev_samp(r) OVER {Q.rows(19)} AS sd,
      max(high) OVER {Q.rows(20)} - min(low) OVER {Q.rows(20)} AS span, abs(close - lag(close, 19) OVER {Q.W}) AS mv FROM q),
    g AS (SELECT market, idx, CASE WHEN n < 20 THEN 'trend' WHEN sd > 0.03 THEN 'volatile' WHEN span > 0 AND mv / span > 0.5 THEN 'trend'
      ELSE 'range' END AS regime FROM z),
    e AS (SELECT market, arg_max(regime, idx) AS regime FROM g GROUP BY market)
    SELECT s.market, s.ts, CASE WHEN regime = 'volatile' THEN CASE WHEN s.close < lower THEN 1 WHEN s.close > upper THEN -1 ELSE 0 END ELSE CASE
      WHEN s.close > s.open THEN 1 WHEN s.close < s.open THEN -1 ELSE 0 END END AS signal
    FROM st s JOIN boll USING (market, idx) JOIN e USING (market)""")
def segmented(spark, sf):
    rows = I.bollinger(bars_1h(spark, sf)).withColumns(
        {"a": I.bollinger_signal(), "b": F.signum(F.col("close") - F.col("open")).cast("int")}
    )
    return T.segmented(rows, {"volatile": ["a"], "trend": ["b"], "range": ["b"]}, per_bar=False).select("market", "ts", "signal")


@query(f"""WITH {Q.BARS_1D}, q AS (SELECT *, close / lag(close) OVER {Q.W} - 1 AS r FROM b),
    z AS (SELECT *, count(*) OVER {Q.rows(20)} AS n, stddev_samp(r) OVER {Q.rows(19)} AS sd,
      max(high) OVER {Q.rows(20)} - min(low) OVER {Q.rows(20)} AS span, abs(close - lag(close, 19) OVER {Q.W}) AS mv FROM q),
    g AS (SELECT market, ts, idx, CASE WHEN n < 20 THEN 'trend' WHEN sd > 1.5 THEN 'volatile' WHEN span > 0 AND mv / span > 0.5 THEN 'trend'
      ELSE 'range' END AS regime FROM z),
    h AS (SELECT *, regime <> lag(regime) OVER {Q.W} AS c FROM g)
    SELECT market, round(avg((regime = 'volatile')::INT) * 100, 4) AS volatile_pct, round(avg((regime = 'trend')::INT) * 100, 4) AS trend_pct,
      round(avg((regime = 'range')::INT) * 100, 4) AS range_pct,
      coalesce(sum(c::INT), 0)::BIGINT AS transitions, round(count(*) / (coalesce(sum(c::INT), 0) + 1), 4) AS avg_duration FROM h GROUP BY market""")
def regime_statistics(spark, sf):
    return rounded(T.regime_statistics(I.regime(bars_1d(spark, sf), volatile=1.5)))


@query(f"""
    WITH {Q.BARS_1D}, {Q.BOLLINGER},
    x AS (SELECT market, ts, lead(close) OVER {Q.W} / close - 1 AS f, CASE WHEN close < lower THEN 1 WHEN close > upper THEN -1 ELSE 0 END AS a, CASE
      WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS c,
      row_number() OVER (PARTITION BY market ORDER BY ts DESC) AS back FROM boll),
    aw AS (SELECT market, 'a' AS signal, corr(a, f) AS k FROM x WHERE back <= 400 GROUP BY market UNION ALL SELECT market, 'c', corr(c, f) FROM x
      WHERE back <= 400 GROUP BY market),
    r AS (SELECT market, signal, 1 + 0.5 * CASE WHEN k IS NULL OR isnan(k) THEN 0 ELSE k END AS raw FROM aw)
    SELECT market, signal, round(raw * 2 / sum(raw) OVER (PARTITION BY market), 4) AS weight FROM r""")
def adapted_weights(spark, sf):
    rows = I.bollinger(bars_1d(spark, sf)).withColumns(
        {"a": I.bollinger_signal(), "c": F.signum(F.col("close") - F.col("open")).cast("int")}
    )
    return rounded(T.adapted_weights(rows, ["a", "c"], lookback=200))


_KNN = "mom_short mom_long vol_short vol_long volatility sma_short sma_long".split()


def _avg(x: str, n: int) -> str:
    return f"avg({x}) OVER {Q.rows(n)}"


@query(f"""{H1}, q AS (SELECT *, close / lag(close) OVER {Q.W} - 1 AS r, lead(close) OVER {Q.W} AS nx FROM b),
    f AS (SELECT market, ts, idx, close / lag(close, 14) OVER {Q.W} - 1 AS mom_short, close / lag(close, 28) OVER {Q.W} - 1 AS mom_long,
      {_avg('volume', 14)} AS vol_short, {_avg('volume', 28)} AS vol_long,
      stddev_samp(r) OVER {Q.rows(28)} AS volatility, {_avg('close', 14)} AS sma_short, {_avg('close', 28)} AS sma_long, CASE WHEN nx > close THEN 1
        ELSE -1 END AS label FROM q),
    g AS (SELECT *, {', '.join(f'stddev_pop({c}) OVER (PARTITION BY market ORDER BY ts) AS s_{c}' for c in _KNN)},
      row_number() OVER (PARTITION BY market ORDER BY ts) - 1 AS i FROM f WHERE idx >= 28),
    d AS (SELECT x.market, x.i, x.ts, y.i AS j, y.label,
      {' + '.join(f'pow((y.{c} - x.{c}) / CASE WHEN x.s_{c} < 1e-9 THEN 1 ELSE x.s_{c} END, 2)' for c in _KNN)} AS far FROM g x
      JOIN g y ON x.market = y.market AND y.i < x.i WHERE x.i >= 9),
    k AS (SELECT *, row_number() OVER (PARTITION BY market, i ORDER BY far, j) AS n FROM d),
    v AS (SELECT market, ts, CASE WHEN sum(label) > 0 THEN 1 ELSE -1 END AS signal FROM k WHERE n <= 252 GROUP BY market, ts)
    SELECT g.market, g.ts, v.signal FROM g LEFT JOIN v ON v.market = g.market AND v.ts = g.ts""")
def knn_signal(spark, sf):
    return L.knn_signal(bars_1h(spark, sf)).select("market", "ts", "signal")


@query(f"""
    {H1}, {STOCH}, {CCI},
    f AS (SELECT st.market, st.ts, st.idx, CASE WHEN hh = ll THEN 0 ELSE -100 * (hh - close) / (hh - ll) END AS f1, CASE
      WHEN slow_d IS NOT NULL THEN k END AS f2, tt.cci AS f3
      FROM st LEFT JOIN (SELECT market, idx, CASE WHEN dev < 1e-12 THEN 0 ELSE (tp - m) / (0.015::DOUBLE * dev) END AS cci
        FROM tc) tt USING (market, idx)),
    d AS (SELECT x.market, x.idx, y.idx AS j, ln(1 + abs(x.f1 - y.f1)) + ln(1 + abs(x.f2 - y.f2)) + ln(1 + abs(x.f3 - y.f3)) AS far FROM f x
      JOIN f y ON x.market = y.market AND y.idx < x.idx AND y.idx >= x.idx - 2000 AND y.idx % 4 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY market, idx ORDER BY far) AS n FROM d WHERE far IS NOT NULL),
    v AS (SELECT market, idx, avg(far) AS distance FROM k WHERE n <= 8 GROUP BY market, idx HAVING count(*) = 8)
    SELECT market, ts, round(distance, 4) AS distance FROM f LEFT JOIN v USING (market, idx)""")
def lorentzian_neighbors(spark, sf):
    rows = S.numbered(I.cci(I.stochastic(bars_1h(spark, sf)))).withColumn("f1", I.williams_r())
    rows = rows.select("market", "ts", "idx", "f1", F.col("slow_k").alias("f2"), F.col("cci").alias("f3"))
    return rounded(L.lorentzian(rows, ["f1", "f2", "f3"]), "market", "ts", "distance")


@query(f"""{H1}, w AS (SELECT market, ts, list(close) OVER {Q.rows(10)} AS xs, list(ln(abs(close * close - 1) + 0.5)) OVER {Q.rows(10)} AS ys FROM b),
    s AS (SELECT market, ts, CASE WHEN list_max(xs) > list_min(xs) THEN [(x - list_min(xs)) / (list_max(xs) - list_min(xs)) for x in xs]
      ELSE xs END AS x, CASE WHEN list_max(ys) > list_min(ys) THEN [(y - list_min(ys)) / (list_max(ys) - list_min(ys)) for y in ys] ELSE ys END AS y
      FROM w WHERE len(xs) = 10),
    it(k, market, ts, x, y, w, loss) AS (SELECT 0, market, ts, x, y, 0.0::DOUBLE, 0.0::DOUBLE FROM s UNION ALL
      SELECT k + 1, market, ts, x, y, w - 0.0009::DOUBLE * list_sum([(1 / (1 + exp(-w * x[i])) - y[i]) * x[i] for i in range(1, 11)]) / 10,
        list_sum([-(y[i] * ln(least(greatest(1 / (1 + exp(-w * x[i])), 1e-10),
          1 - 1e-10)) + (1 - y[i]) * ln(1 - least(greatest(1 / (1 + exp(-w * x[i])), 1e-10), 1 - 1e-10))) for i in range(1, 11)]) / 10 FROM it
          WHERE k < 1000)
    SELECT market, ts, round(loss, 4) AS loss, round(1 / (1 + exp(-w * x[10])), 4) AS pred FROM it WHERE k = 1000""".replace("WITH", "WITH RECURSIVE", 1))
def logistic_gd(spark, sf):
    return rounded(L.logistic(bars_1h(spark, sf)), "market", "ts", "loss", "pred")


@query(f"""
    {H1}, {WAVE},
    l AS (SELECT *, lead(close, 4) OVER {Q.W} AS nx FROM b)
    SELECT market, ts, CASE WHEN nx IS NULL THEN 0 WHEN nx > close THEN 1 ELSE -1 END AS label FROM l
""")
def direction_label(spark, sf):
    return bars_1h(spark, sf).select("market", "ts", L.direction_label().alias("label"))
