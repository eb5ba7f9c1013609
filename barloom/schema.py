"""Schemas of bars, candles and trades."""

from pyspark.sql import types as T

SERIES = ["market"]

BAR = T.StructType([T.StructField("market", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])

CANDLE = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
        *[T.StructField(c, T.StringType()) for c in ("source", "resolution", "market", "raw_data")],
    ]
)

#: a processed day file
PROCESSED = T.StructType([T.StructField("timestamp", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])

#: a raw record, with the bar's values where a live feed has them
RAW = T.StructType([*[T.StructField(c, T.StringType()) for c in ("timestamp", "market", "resolution", "exchange", "raw_data")], *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
