"""Symbols of exchanges, times and resolutions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: quote assets, asset names that differ, and words for perpetual contracts
QUOTES = ["USD", "USDT", "USDC", "BUSD", "DAI"]  # the longest that fits is taken
PERPETUAL = ["PERP", "PERPETUAL", "-P", "-PERP", "SWAP"]
ALIASES = {"XBT": "BTC"}
# resolution in minutes (or D, W) to the providers' names
INTERVALS = {
    "binance": {"1": "1m", "5": "5m", "15": "15m", "30": "30m", "60": "1h", "240": "4h", "1D": "1d"},
    "coinbase": {"1": "60", "5": "300", "15": "900", "60": "3600", "120": "7200", "240": "14400", "360": "21600", "1D": "86400"},
    "bitget": {"1": "1m", "5": "5m", "15": "15m", "30": "30m", "60": "1H", "240": "4H", "1D": "1D"},
}


def standard_asset(a: Column) -> Column:
    up = F.upper(a)
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(names[up], up)


def split_pair(s: Column) -> Column:
    """BASE-QUOTE of joined letters: the longest known quote, else the last three letters; null if too short."""
    out = F.when(F.length(s) > 3, F.concat(F.substring(s, F.lit(1), F.length(s) - 3), F.lit("-"), F.substring(s, -3, 3)))
    for q in sorted(QUOTES, key=len):
        out = F.when(s.endswith(q) & (F.length(s) > len(q)), F.concat(F.substring(s, F.lit(1), F.length(s) - len(q)), F.lit(f"-{q}"))).otherwise(out)
    return out


def to_standard(exchange: Column, symbol: Column) -> Column:
    """An exchange's symbol in the form BASE-QUOTE or BASE-PERP."""
    s = F.upper(symbol)
    words = "|".join(sorted({p.strip("-") for p in PERPETUAL if len(p) > 2}))
    perp = F.regexp_extract(s, f"^([A-Z0-9]+?)(?:USDT?)?(?:[_\\-]?(?:{words})|-P)$", 1)
    return (
        F.when(perp != "", F.concat(standard_asset(perp), F.lit("-PERP")))
        .when(s.contains("-"), s)
        .when(F.length(s) <= 4, standard_asset(s))
        .otherwise(split_pair(s))
    )


def to_exchange(exchange: Column, symbol: Column) -> Column:
    """A standard symbol in an exchange's form; a bare asset gets the exchange's usual quote."""
    s = F.upper(symbol)
    base, quote = F.substring_index(s, "-", 1), F.substring_index(s, "-", -1)
    bare = ~s.contains("-")
    binance = (
        F.when(bare, F.concat(s, F.lit("USDT")))
        .when(quote == "PERP", F.concat(base, F.lit("USDT_PERP")))
        .otherwise(F.concat(base, quote))
    )
    coinbase = F.when(bare, F.concat(s, F.lit("-USD"))).otherwise(s)
    drift = F.when(bare, F.concat(s, F.lit("-PERP"))).otherwise(s)
    return (
        F.when(exchange == "binance", binance)
        .when(exchange == "coinbase", coinbase)
        .when(exchange == "drift", drift)
        .when(exchange == "bitget", F.when(bare, F.concat(s, F.lit("USDT"))).otherwise(F.concat(base, quote)))
    )


def symbol_map(spark: SparkSession, symbols: dict[str, list[str]]) -> DataFrame:
    """(exchange, exchange_symbol, standard_symbol) of the symbols that exchanges list."""
    rows = [(e, s) for e, ss in symbols.items() for s in ss]
    df = spark.createDataFrame(rows, "exchange string, exchange_symbol string")
    return df.withColumn("standard_symbol", to_standard(F.col("exchange"), F.col("exchange_symbol")))


def supported_exchanges(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("standard_symbol").agg(F.array_sort(F.collect_set("exchange")).alias("exchanges"))


def supported_symbols(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("exchange").agg(F.array_sort(F.collect_set("standard_symbol")).alias("symbols"))


def valid_markets(wanted: DataFrame, mapped: DataFrame, name: str = "symbol") -> DataFrame:
    """The wanted symbols that some exchange lists, in either form."""
    known = mapped.select(F.explode(F.array("exchange_symbol", "standard_symbol")).alias(name)).distinct()
    return wanted.join(known, name, "left_semi")


# fixed value: seconds of a candle where the resolution is not known
DEFAULT_SECONDS = 60
SECONDS = {"1": 60, "5": 300, "15": 900, "30": 1800, "60": 3600, "120": 7200, "240": 14400, "360": 21600, "1D": 86400}


def granularity(resolution: Column) -> Column:
    """Seconds of a resolution."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SECONDS.items() for x in kv])[resolution], F.lit(DEFAULT_SECONDS))


def interval(exchange: str, resolution: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in INTERVALS[exchange].items() for x in kv])[resolution]


def page(df: DataFrame, order: str, page: int, size: int, contains: str | None = None) -> DataFrame:
    """A page of a sorted listing, from 1; numbers beyond the ends are the nearest page."""
    if contains:
        df = df.filter(F.upper(order).contains(contains.upper()))
    pages = max(1, -(-df.count() // size))
    return df.orderBy(order).offset((min(max(1, page), pages) - 1) * size).limit(size)


def normalised_time(x: Column) -> Column:
    """A time from ISO text, or from epoch seconds or (more than ten digits) milliseconds as text; UTC, without a zone."""
    number = x.rlike(r"^\d+$")
    value = F.when(number, x).cast("long")
    from_number = F.when(F.length(x) > 10, F.timestamp_millis(value)).otherwise(F.timestamp_seconds(value))
    iso = F.try_to_timestamp(F.regexp_replace(x, "Z$", "+00:00"))
    return F.when(number, from_number).otherwise(iso).cast("timestamp_ntz")


def parsed_date(x: Column, now: Column) -> Column:
    """A day, a day and time, "today", "yesterday", "now", or "3d" and "12h" before now; else null."""
    ago = F.regexp_extract(x, r"^(\d+)[dh]$", 1)
    back = F.when(x.endswith("d"), F.make_dt_interval(days=F.try_to_number(ago, F.lit("999999")).cast("int"))).otherwise(
        F.make_dt_interval(hours=F.try_to_number(ago, F.lit("999999")).cast("int"))
    )
    day = F.date_trunc("day", now)
    return (
        F.when(x == "now", now).when(x == "today", day).when(x == "yesterday", day - F.expr("interval 1 day")).when(ago != "", now - back)
        .otherwise(F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))))
    )
