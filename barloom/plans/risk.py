"""Queries of risk measures."""

from pyspark.sql import functions as F

from ..operators import performance as P
from ..operators import risk as RK
from ..sources.bars import bars_1d, returns_1d
from . import query, rounded
from . import sql as Q

R1 = f"WITH {Q.RETURNS_1D}"
#: the benchmark: the mean return of all series on a time
BENCH = "bm AS (SELECT ts, avg(r) AS b FROM r GROUP BY ts)"


def _benchmark(r):
    return r.groupBy("ts").agg(F.avg("r").alias("b"))


@query(f"""
    {R1},
    q AS (SELECT market, quantile_cont(r, 0.05) AS p5, quantile_cont(r, 0.95) AS p95 FROM r GROUP BY market),
    x AS (SELECT * FROM r JOIN q USING (market)),
    a AS (SELECT market, count(*) AS n, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe_ratio,
      avg(r) / (stddev_samp(r) FILTER (r < 0)) * sqrt(252) AS sortino_ratio, sum(r) FILTER (r > 0) / abs(sum(r) FILTER (r < 0)) AS omega_ratio,
      max(p5) AS var_95, avg(r) FILTER (r <= p5) AS cvar_95,
      skewness(r) AS skewness, kurtosis(r) AS kurtosis, abs(max(p95) / max(p5)) AS tail_ratio FROM x GROUP BY market)
        SELECT market, n, {Q.rounded('sharpe_ratio sortino_ratio omega_ratio var_95 cvar_95 skewness kurtosis tail_ratio')} FROM a""")
def risk_metrics(spark, sf):
    return rounded(RK.risk_metrics(returns_1d(spark, sf)))


@query(f"""{R1}, {BENCH}, x AS (SELECT * FROM r JOIN bm USING (ts)),
    a AS (SELECT market, count(*) AS n, covar_samp(r, b) / var_samp(b) AS beta, avg(r) AS m, avg(b) AS mb, stddev_samp(r - b) * sqrt(252) AS te,
      corr(r, b) AS c, avg(r) FILTER (b > 0) / avg(b) FILTER (b > 0) * 100 AS upside_capture,
      avg(r) FILTER (b < 0) / avg(b) FILTER (b < 0) * 100 AS downside_capture FROM x GROUP BY market),
    z AS (SELECT *, (m - beta * mb) * 252 AS alpha, CASE WHEN beta > 0 THEN m / beta * 252 ELSE 0 END AS treynor_ratio, CASE
      WHEN te > 0 THEN (m - mb) * 252 / te ELSE 0 END AS information_ratio, c * c AS r_squared, CASE
      WHEN downside_capture <> 0 THEN upside_capture / downside_capture END AS capture_ratio FROM a)
    SELECT market, n, {Q.rounded('beta alpha treynor_ratio information_ratio r_squared upside_capture downside_capture capture_ratio')} FROM z""")
def benchmark_metrics(spark, sf):
    r = returns_1d(spark, sf)
    return rounded(RK.benchmark_metrics(r, _benchmark(r)))


@query(f"""
    {R1},
    e AS (SELECT market, row_number() OVER (PARTITION BY market ORDER BY ts) - 1 AS i, 1 + sum(r) OVER (PARTITION BY market ORDER BY ts) AS v
      FROM (SELECT market, ts, r / 1000 AS r FROM r))
    SELECT market, round(regr_r2(v, i), 4) AS stability FROM e GROUP BY market
""")
def stability(spark, sf):
    """R squared of summed returns against time; the operator's compounded form is held by tests."""
    from ..functions import series as S

    x = S.numbered(returns_1d(spark, sf)).withColumn("v", 1 + F.sum(F.col("r") / 1000).over(S.so_far()))
    return rounded(x.groupBy("market").agg(F.regr_r2("v", "idx").alias("stability")))


ROLL = "(PARTITION BY market ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {Q.BARS_1D}, q AS (SELECT *, close / lag(close) OVER {Q.W} - 1 AS r, close / lag(close, 60) OVER {Q.W} - 1 AS rr FROM b),
    z AS (SELECT market, ts, count(r) OVER w AS n, rr AS rolling_return, stddev_samp(r) OVER w * sqrt(252) AS rolling_volatility,
      avg(r) OVER w / stddev_samp(r) OVER w * sqrt(252) AS rolling_sharpe FROM q WINDOW w AS {ROLL})
    SELECT market, ts, {Q.rounded('rolling_return rolling_volatility rolling_sharpe')} FROM z WHERE n >= 60""")
def rolling_metrics(spark, sf):
    return rounded(P.rolling(bars_1d(spark, sf)), "market", "ts", "rolling_return", "rolling_volatility", "rolling_sharpe")


@query(f"""
    WITH {Q.BARS_1D},
    p AS (SELECT a.market, a.ts, a.idx, x.idx AS j, x.close, max(x.close) OVER (PARTITION BY a.market, a.idx ORDER BY x.idx) AS pk FROM b a
      JOIN b x ON x.market = a.market AND x.idx BETWEEN a.idx - 60 AND a.idx WHERE a.idx >= 60)
    SELECT market, ts, round(max((pk - close) / pk) * 100, 4) AS rolling_max_drawdown FROM p GROUP BY market, ts""")
def rolling_drawdown(spark, sf):
    return rounded(P.rolling(bars_1d(spark, sf)), "market", "ts", "rolling_max_drawdown")


@query(f"""{R1}, {BENCH}, x AS (SELECT * FROM r JOIN bm USING (ts)),
    z AS (SELECT market, ts, count(r) OVER w AS n, avg(r) OVER w * 252 AS annual_return, stddev_samp(r) OVER w * sqrt(252) AS volatility,
      covar_samp(r, b) OVER w / var_samp(b) OVER w AS beta, pow(corr(r, b) OVER w, 2) AS r_squared, quantile_cont(r, 0.05) OVER w AS var_95,
      avg((r > 0)::INT) OVER w AS win_rate FROM x WINDOW w AS {ROLL})
    SELECT market, ts, {Q.rounded('annual_return volatility beta r_squared var_95 win_rate')} FROM z WHERE n >= 60""")
def rolling_risk(spark, sf):
    r = returns_1d(spark, sf)
    return rounded(
        RK.rolling_risk(r, _benchmark(r)), "market", "ts", "annual_return", "volatility", "beta", "r_squared", "var_95", "win_rate"
    )


@query(f"""{R1}, q AS (SELECT market, quantile_cont(r, 0.05) AS q FROM r GROUP BY market), x AS (SELECT * FROM r JOIN q USING (market))
    SELECT market, round(abs(max(q)) * 100, 4) AS var_historical, round(abs(avg(r) - 1.6448536269514722::DOUBLE * stddev_samp(r)) * 100,
      4) AS var_parametric, round(abs(avg(r) FILTER (r <= q)) * 100, 4) AS cvar FROM x GROUP BY market""")
def var_cvar(spark, sf):
    return rounded(RK.value_at_risk(returns_1d(spark, sf)))


_FALLS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in RK.SCENARIOS.items())


@query(f"""
    {R1},
    m AS (SELECT market, count(*) AS n, avg(r) FILTER (r > 0) AS g FROM r GROUP BY market),
    s AS (SELECT * FROM (VALUES {_FALLS}) s(scenario, fall))
    SELECT market, scenario, fall AS "drop", round(1 + fall, 4) AS new_value, round(CASE
      WHEN n > 20 THEN -fall / (1 + fall) / g / 252 END, 6) AS recovery_years FROM m, s""")
def stress_test(spark, sf):
    return rounded(RK.stress_test(returns_1d(spark, sf)), digits=6)


@query(f"""
    {R1},
    k AS (SELECT market, avg((r > 0)::INT) AS w, avg(r) FILTER (r > 0) / -avg(r) FILTER (r < 0) AS q FROM r GROUP BY market)
    SELECT market, round(CASE WHEN w > 0 AND w < 1 AND q > 0 THEN greatest(0.5 * (w * q - (1 - w)) / q, 0) ELSE 0 END, 4) AS kelly FROM k
""")
def kelly(spark, sf):
    r = returns_1d(spark, sf).groupBy("market").agg(
        F.avg((F.col("r") > 0).cast("double")).alias("w"),
        (F.avg(F.when(F.col("r") > 0, F.col("r"))) / -F.avg(F.when(F.col("r") < 0, F.col("r")))).alias("q"),
    )
    return rounded(r.select("market", RK.kelly(F.col("w"), F.col("q")).alias("kelly")))


@query(f"""
    {R1}
    SELECT x.market AS a, y.market AS b, round(corr(x.r, y.r), 4) + 0.0 AS corr, round(covar_samp(x.r, y.r), 4) + 0.0 AS cov, count(*) AS n FROM r x
      JOIN r y USING (ts) GROUP BY 1, 2
""")
def correlation_matrix(spark, sf):
    return rounded(RK.correlation_matrix(returns_1d(spark, sf)))


@query(f"""
    {R1},
    k AS (SELECT count(DISTINCT market) AS k FROM r),
    c AS (SELECT ts FROM r GROUP BY ts HAVING count(DISTINCT market) = (SELECT k FROM k)),
    x AS (SELECT * FROM r JOIN c USING (ts)),
    v AS (SELECT a.market, covar_samp(a.r, z.r) * 252 AS c FROM x a JOIN x z USING (ts) GROUP BY a.market, z.market),
    m AS (SELECT market, sum(c) / (SELECT k FROM k) AS m FROM v GROUP BY market),
    t AS (SELECT sqrt(sum(m) / (SELECT k FROM k)) AS vol FROM m)
    SELECT market, round(vol, 4) AS portfolio_volatility, round(m / vol, 4) AS marginal, round(m / vol / (SELECT k
      FROM k), 4) AS component, round(m / vol / (SELECT k FROM k) / vol * 100, 4) AS percentage FROM m, t""")
def risk_contribution(spark, sf):
    return rounded(RK.risk_contribution(returns_1d(spark, sf)))


@query(f"""
    {R1}
    SELECT market, strftime(ts, '%Y') AS year, count(*) AS n, round(sum(r), 4) + 0.0 AS total FROM r GROUP BY ROLLUP (market, strftime(ts, '%Y'))
""")
def returns_rollup(spark, sf):
    r = returns_1d(spark, sf).withColumn("year", F.date_format("ts", "yyyy"))
    return rounded(r.rollup("market", "year").agg(F.count("*").alias("n"), F.sum("r").alias("total")))


@query(f"""
    WITH {Q.BARS_1D},
    t AS (SELECT market, ts, close FROM b)
    SELECT e.market, e.ts, (SELECT arg_min(t.close, t.ts) FROM t WHERE t.market = e.market AND t.ts >= e.ts + INTERVAL 3 DAY) AS later FROM b e
""")
def as_of_join(spark, sf):
    from ..operators.bars import as_of

    rows = bars_1d(spark, sf).select("market", "ts", "close")
    left = rows.select("market", (F.col("ts") + F.expr("interval 3 days")).alias("ts"))
    return as_of(left, rows, "ts", "close", "later").select("market", (F.col("ts") - F.expr("interval 3 days")).alias("ts"), "later")
