"""Collects queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query. `sql` is its DuckDB counterpart; `views` the WITH list it starts from."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = f"WITH {views}\n{sql}" if views else sql
        return function

    return register


# Halves are lifted a little before rounding, on both sides, so that neither the order of a sum nor
# an engine's way to round decimals can tip them. Adding 0.0 turns a negative zero into zero.
LIFT = 0.001


def out(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Comparable output: doubles rounded, dates as text."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            scale = 10.0 ** special.get(field.name, digits)
            c = F.rint(c.cast("double") * scale + LIFT) / scale + 0.0
        elif isinstance(field.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """SQL for a double rounded as in `out`."""
    scale = f"1e{digits}"
    return f"round(({expression}) * {scale} + {LIFT}) / {scale} + 0.0 AS {name or expression}"
