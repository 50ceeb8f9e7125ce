"""Joins and look-ups.

None carries a hint. The planner broadcasts a side when its measured bytes are below the session's
threshold; otherwise both sides are shuffled, and adaptive execution splits the partitions that hot keys,
new ones and null ones included, make too large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def join_left(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on shared key names. The planner picks the strategy from measured sizes."""
    return left.join(right, list(on), "left")


def join_left_diffkeys(left: DataFrame, right: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Left join where the keys have other names on the right; both sides' keys stay."""
    condition = None
    for a, b in keys.items():
        equal = left[a] == right[b]
        condition = equal if condition is None else condition & equal
    return left.join(right, condition, "left")


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in `keys`: a left semi join."""
    on = list(on)
    return df.join(keys.select(*on), on, "left_semi")
