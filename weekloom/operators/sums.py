"""Sums of doubles that do not depend on the order in which rows are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a value is cut into. Each keeps 52 bits less the logarithm of the number of rows.
PARTS = 3


def steady_parts(df: DataFrame, x: Column) -> list[Column]:
    """`x` as a sum of parts, so that the parts of all rows of `df` add up without any rounding.

    A part is a multiple of a unit, and all parts of a kind together stay below 2 ** 52 of it, in any order and in any
    group of the rows. The unit comes from the number of rows and the greatest value, which are read as a scalar
    subquery: one more pass over `df`. What is left below the last unit is dropped. Values from about 1e290 on do
    not fit.
    """
    size = df.agg(F.max(F.abs(x)).alias("most"), F.count(x).alias("n")).select(
        F.coalesce(F.ceil(F.log2(F.col("most"))), F.lit(0)).cast("double").alias("most"),
        F.coalesce(F.ceil(F.log2(F.col("n"))), F.lit(0)).cast("double").alias("rows"),
    )
    bits = size.select(F.struct("most", "rows")).scalar()
    rows = bits["rows"]
    reach = bits["most"] + rows
    out, rest = [], x
    for _ in range(PARTS):
        # Adding and taking away one and a half times a power of two rounds to a multiple of its last bit.
        large = F.lit(1.5) * F.pow(F.lit(2.0), reach)
        part = (rest + large) - large
        out.append(part)
        rest, reach = rest - part, reach + rows - 52
    return out


def steady_sum(df: DataFrame, x: Column) -> Column:
    """The sum of `x` over any groups of `df`, the same however its rows are dealt."""
    sums = [F.sum(p) for p in steady_parts(df, x.cast("double"))]
    total = sums[-1]
    for s in reversed(sums[:-1]):
        total = s + total
    return total
