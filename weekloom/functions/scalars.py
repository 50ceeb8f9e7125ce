"""Column expressions. All are built-in Spark functions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "as_column", "parse_percent", "truncate_int", "date_features", "year_to_date", "week_ending",
    "log_plus_one", "log_target", "unlog", "band_sum", "round_4", "percent_error", "clamp",
    "threshold_class", "label_name", "ordinal", "strip_prefix", "inf_to_null", "clean_name",
]


def as_column(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(f"`{c}`")


def parse_percent(c: str | Column) -> Column:
    """`'2.3%'` becomes 2.3. Text that is no number raises, as a cast does under ANSI."""
    return F.trim(F.translate(as_column(c), "%", "")).cast("double")


def truncate_int(c: str | Column) -> Column:
    """Cut decimals toward zero."""
    return as_column(c).cast("bigint")


# Parts a date can be split into, by the suffix of the new column. Fixed values.
DATE_PARTS = {
    "Yr": F.year,
    "Day": F.dayofyear,
    "Week": F.weekofyear,
    "Mon": F.month,
    "Qtr": F.quarter,
}


def date_features(c: str | Column, prefix: str, parts: Sequence[str]) -> list[Column]:
    """One integer column per part, named prefix + part; `Week` is the ISO week."""
    return [DATE_PARTS[part](as_column(c)).alias(prefix + part) for part in parts]


def year_to_date(c: str | Column) -> Column:
    """Year number to its first of January."""
    return F.make_date(as_column(c), F.lit(1), F.lit(1))


def week_ending(c: str | Column) -> Column:
    """The Sunday that closes the week of a date; a Sunday is its own week end."""
    return F.next_day(F.date_sub(as_column(c).cast("date"), 1), "SUN")


def log_plus_one(c: str | Column) -> Column:
    """log(1 + x) as a float feature. Spark gives null at x <= -1."""
    return F.log1p(as_column(c)).cast("float")


def log_target(c: str | Column) -> Column:
    return F.log1p(as_column(c))


def unlog(c: str | Column) -> Column:
    return F.expm1(as_column(c))


def band_sum(columns: Sequence[str | Column]) -> Column:
    """Sum of fine bands; null as soon as one band is null."""
    total = as_column(columns[0])
    for c in columns[1:]:
        total = total + as_column(c)
    return total


def round_4(c: str | Column) -> Column:
    return F.round(as_column(c), 4)


def percent_error(actual: str | Column, predicted: str | Column, signed: bool = False) -> Column:
    """100 (actual - predicted) / actual; null where actual is 0."""
    gap = as_column(actual) - as_column(predicted)
    return F.try_divide(F.lit(100.0) * (gap if signed else F.abs(gap)), as_column(actual))


def clamp(c: str | Column, low, high) -> Column:
    return F.greatest(F.least(as_column(c), F.lit(high)), F.lit(low))


def threshold_class(probability: str | Column) -> Column:
    """Nearest of 0 and 1, halves to even: 0.5 gives 0."""
    return F.rint(as_column(probability)).cast("int")


def label_name(c: str | Column, names: Mapping) -> Column:
    """Look a value up in a small mapping; unknown values give null."""
    pairs = [F.lit(x) for x in chain.from_iterable(names.items())]
    return F.try_element_at(F.create_map(*pairs), as_column(c))


def ordinal(c: str | Column, labels: Sequence[str]) -> Column:
    """Position of a label in its fixed order; unknown labels give null."""
    return label_name(c, {label: i for i, label in enumerate(labels)})


def strip_prefix(c: str | Column, length: int = 1) -> Column:
    return F.substring(as_column(c), length + 1, 2**31 - 1)


def inf_to_null(c: str | Column) -> Column:
    """Infinite and NaN values become null."""
    x = as_column(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clean_name(name: str) -> str:
    """Column name without double quotes, spaces as underscores."""
    return name.replace('"', "").replace(" ", "_")
