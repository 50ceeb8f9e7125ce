"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.functions import as_column, inf_to_null
from weekloom.operators.schema import columns_by_type


def select_slice(df: DataFrame, **values) -> DataFrame:
    """Keep the rows where each named column has the given value, then drop those columns."""
    for name, value in values.items():
        df = df.filter(as_column(name) == F.lit(value))
    return df.drop(*values)


def before_year(df: DataFrame, column: str, year: int) -> DataFrame:
    """Rows of earlier years. On a date column the comparison is with a date, so it reaches the scan."""
    if isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df.filter(as_column(column) < F.lit(date(year, 1, 1)))
    return df.filter(as_column(column) < year)


def in_year(df: DataFrame, column: str, year: int) -> DataFrame:
    """Rows of a date column that lie in the year, by two dates, so that the comparison reaches the scan."""
    return df.filter((as_column(column) >= F.lit(date(year, 1, 1))) & (as_column(column) < F.lit(date(year + 1, 1, 1))))


def filter_level(df: DataFrame, column: str, level) -> DataFrame:
    return df.filter(as_column(column) == F.lit(level))


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null, or a NaN, in any column of the subset."""
    return df.dropna("any", subset=list(subset) if subset else None)


def infinite_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Infinite and NaN values of floating columns become null."""
    floating = [name for _, name in columns_by_type(df, T.DoubleType, T.FloatType)]
    wanted = floating if columns is None else columns
    return df.withColumns({c: inf_to_null(c) for c in wanted})


def null_keys(df: DataFrame, key: str | Sequence[str], measure: str | Column) -> DataFrame:
    """Distinct keys that have a row without the measure."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.filter(as_column(measure).isNull()).select(*[as_column(k) for k in keys]).distinct()
