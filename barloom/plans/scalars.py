"""Queries of symbols, times and listings; the part table's keys pick from the symbols and times below."""

from pyspark.sql import functions as F

from ..functions import symbols as Y
from . import query

# exchange symbols with their standard form, and standard ones with an exchange's form
PAIRS = [
    ("binance", "BTCUSDT", "BTC-USDT"),
    ("binance", "BTCUSDT_PERP", "BTC-PERP"),
    ("coinbase", "BTC-USD", "BTC-USD"),
    ("drift", "SOL-PERP", "SOL-PERP"),
    ("binance", "BTCBUSD", "BTC-BUSD"),
    ("binance", "ETHBTC", "ETH-BTC"),
    ("kraken", "XBT", "BTC"),
    ("bitget", "SOLUSDC", "SOL-USDC"),
    ("binance", "DAIUSDT", "DAI-USDT"),
]
BACK = [
    ("binance", "BTC-PERP", "BTCUSDT_PERP"),
    ("binance", "BTC-USDT", "BTCUSDT"),
    ("binance", "ETH", "ETHUSDT"),
    ("coinbase", "ETH", "ETH-USD"),
    ("drift", "SOL", "SOL-PERP"),
    ("coinbase", "BTC-USD", "BTC-USD"),
    ("bitget", "BTC-USDT", "BTCUSDT"),
]
TIMES = [
    ("2023-01-01T12:00:00Z", "2023-01-01 12:00:00"),
    ("2023-01-01T12:00:00+02:00", "2023-01-01 10:00:00"),
    ("1672574400", "2023-01-01 12:00:00"),
    ("1672574400500", "2023-01-01 12:00:00.5"),
    ("nonsense", None),
]
DATES = [
    ("2024-02-03", "2024-02-03 00:00:00"),
    ("2024-02-03 04:05", "2024-02-03 04:05:00"),
    ("now", "2024-03-10 15:30:00"),
    ("today", "2024-03-10 00:00:00"),
    ("yesterday", "2024-03-09 00:00:00"),
    ("3d", "2024-03-07 15:30:00"),
    ("12h", "2024-03-10 03:30:00"),
    ("soon", None),
]


def _sql(rows: list[tuple], *columns: str) -> str:
    """A row of the part table a row, with the values that its key picks."""
    lists = ["[" + ", ".join("NULL" if r[k] is None else f"'{r[k]}'" for r in rows) + "]" for k in range(len(columns))]
    return "SELECT p_partkey, " + ", ".join(
        f"{x}[p_partkey % {len(rows)} + 1] AS {c}" for x, c in zip(lists, columns, strict=True)
    ) + " FROM part"


def _picked(spark, sf, rows: list[tuple], *columns: str):
    """The part table's keys with values that they pick; an unnamed column is left out."""
    at = (F.col("p_partkey") % len(rows) + 1).cast("int")
    picked = [F.element_at(F.array(*[F.lit(r[k]) for r in rows]), at).alias(c) for k, c in enumerate(columns) if c]
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", *picked)


@query(_sql(PAIRS, "exchange", "symbol", "standard"))
def symbol_map(spark, sf):
    df = _picked(spark, sf, PAIRS, "exchange", "symbol")
    return df.withColumn("standard", Y.to_standard(F.col("exchange"), F.col("symbol")))


@query(_sql(BACK, "exchange", "standard", "symbol"))
def symbol_to_exchange(spark, sf):
    df = _picked(spark, sf, BACK, "exchange", "standard")
    return df.withColumn("symbol", Y.to_exchange(F.col("exchange"), F.col("standard")))


@query(f"""
    SELECT standard AS standard_symbol, array_to_string(list_sort(list(DISTINCT exchange)), ',') AS exchanges
      FROM ({_sql(PAIRS, 'exchange', 'symbol', 'standard')}) GROUP BY 1
""")
def supported_exchanges(spark, sf):
    mapped = symbol_map(spark, sf).withColumnRenamed("standard", "standard_symbol")
    return Y.supported_exchanges(mapped).select("standard_symbol", F.array_join("exchanges", ",").alias("exchanges"))


@query(f"SELECT p_partkey, raw, CAST(ts AS TIMESTAMP) AS ts FROM ({_sql(TIMES, 'raw', 'ts')})")
def timestamp_normalize(spark, sf):
    return _picked(spark, sf, TIMES, "raw").withColumn("ts", Y.normalised_time(F.col("raw")))


@query(f"SELECT p_partkey, raw, CAST(ts AS TIMESTAMP) AS ts FROM ({_sql(DATES, 'raw', 'ts')})")
def date_parser(spark, sf):
    df = _picked(spark, sf, DATES, "raw")
    return df.withColumn("ts", Y.parsed_date(F.col("raw"), F.to_timestamp(F.lit("2024-03-10 15:30:00"))).cast("timestamp_ntz"))


@query("SELECT p_name FROM part WHERE contains(upper(p_name), 'A') ORDER BY p_name LIMIT 25 OFFSET 25")
def market_listing(spark, sf):
    """The second page of a listing: the limit is the page."""
    return Y.page(spark.read.parquet(f"{sf}/part.parquet").select("p_name"), "p_name", 2, 25, "a")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT strftime(ts, '%A') AS weekday, hour(ts) AS hour, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1, 2, 3")
def time_keys(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy(F.date_format("ts", "EEEE").alias("weekday"), F.hour("ts").cast("long").alias("hour"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
