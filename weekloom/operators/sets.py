"""Set operations on tables and on the keys of segments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions import as_column, ordinal
from weekloom.operators.joins import join_left


def union_vintages(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column missing from one of them is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def intersect_keys(df: DataFrame, segment: str, key: str, first, second) -> DataFrame:
    """Keys that occur in both segments."""

    def keys(value) -> DataFrame:
        return df.filter(as_column(segment) == F.lit(value)).select(as_column(key))

    return keys(first).intersect(keys(second))


def overlap_resolve(df: DataFrame, segment: str, key: str, priority: Sequence[str]) -> DataFrame:
    """A key found in several segments belongs, with all its rows, to the first of them in `priority`."""
    rank = ordinal(segment, priority)
    best = df.groupBy(as_column(key)).agg(F.min(rank).alias("_rank"))
    labels = F.array(*[F.lit(p) for p in priority])
    resolved = join_left(df, best, [key]).select(*[as_column(c) for c in df.columns], "_rank").withColumn(
        segment, F.coalesce(F.try_element_at(labels, F.col("_rank") + 1), as_column(segment))
    )
    return resolved.drop("_rank")
