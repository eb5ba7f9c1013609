"""Registered queries over the driver's tables, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *keep: str, digits: int = 4) -> DataFrame:
    """df with doubles rounded, without negative zeros; columns in ``keep`` or all."""
    names = list(keep) or df.columns
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in names])


from . import backtests, indicators, layers, risk, scalars, signals, studies  # noqa: E402,F401  register their queries
