"""Ordered work over data of any size and skew.

A Spark window holds a whole window group in one task, and a global window holds everything.
The helpers here cut ordered rows into runs of similar size by range partitioning, work inside
the runs, and carry the little that crosses a border in a table with one row per run.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.functions import as_column
from weekloom.operators.sums import steady_parts
from weekloom.session import materialize

RUN = "_run"


def cut_into_runs(df: DataFrame, order: Sequence[str | Column], runs: int | None = None) -> DataFrame:
    """Add `_run`: consecutive numbers along `order`, each run holding a similar share of rows.

    Range partitioning samples the whole `order` tuple, so a single hot series is cut as well as
    long as `order` ends in something that tells its rows apart. There are `runs` of them, or as many as the session
    has shuffle partitions, less those that adaptive execution merges because they are small. The result is a
    written table, since the borders come from a sample and every later reader has to see the same ones; it is the
    only one that is written. Sampling goes over the rows once more, from the last shuffle below them on.
    """
    columns = [as_column(c) for c in order]
    ranged = df.repartitionByRange(runs, *columns) if runs else df.repartitionByRange(*columns)
    return materialize(ranged.withColumn(RUN, F.spark_partition_id()), "runs")


def running_total(
    df: DataFrame, order: Sequence[str | Column], value: str | Column, name: str, runs: int | None = None
) -> DataFrame:
    """Global running sum of `value` along `order`, without bringing all rows to one task. The sum of floating
    point numbers is the same wherever runs end: it adds up parts that a double holds exactly."""
    valued = df.withColumn("_value", as_column(value) if isinstance(value, str) else value)
    if isinstance(valued.schema["_value"].dataType, (T.FloatType, T.DoubleType)):
        cut = cut_into_runs(valued, order, runs)  # written, so that looking for the size makes no row again
        parts = steady_parts(cut, F.col("_value").cast("double"))
    else:
        cut = cut_into_runs(valued, order, runs)
        parts = [F.col("_value")]
    names = [f"_part{i}" for i in range(len(parts))]
    cut = cut.withColumns(dict(zip(names, parts)))
    # One row per run, so never more rows than range partitions.
    earlier = Window.orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy(RUN)
        .agg(*[F.sum(p).alias(p) for p in names])
        .select(RUN, *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(f"_before{p}") for p in names])
    )
    inside = Window.partitionBy(RUN).orderBy(*[as_column(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.col(f"_before{p}") + F.sum(p).over(inside) for p in names]
    total = sums[-1]
    for part in reversed(sums[:-1]):
        total = part + total
    return (
        cut.join(F.broadcast(before), RUN)
        .withColumn(name, total)
        .drop(RUN, "_value", *names, *[f"_before{p}" for p in names])
    )


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, runs: int | None = None) -> DataFrame:
    """Global row number from 1 along `order`."""
    return running_total(df, order, F.lit(1).cast("bigint"), name, runs)


@dataclass(frozen=True)
class _Cell:
    """Neighbouring values of a column: the least and the greatest, how many there are, and how many are less."""

    column: str
    low: float
    high: float
    count: int
    before: int

    def value(self, rank: int) -> float | None:
        """The value at a rank of the column, if the ends of the cell tell."""
        at = rank - self.before
        if self.low == self.high or at == 0:
            return self.low
        return self.high if at == self.count - 1 else None


#: Cells to an octave in the first pass, cells of a cell in the others, and rows of a cell that are
#: counted value by value.
_OCTAVE, _CELLS, EXACT = 32, 1 << 14, 1 << 14
_MOST = 1100 * _OCTAVE  # no finite double has a logarithm, to base 2, of 1100 or more, or of -1100 or less


def _octave_cell(x: Column) -> Column:
    """A number that does not fall where `x` rises: sign, exponent and the first bits of the mantissa."""
    size = F.floor(F.log2(F.abs(x)) * _OCTAVE).cast("int") + 2 * _MOST
    infinite = F.abs(x) == float("inf")
    steps = F.when(infinite, F.lit(4 * _MOST)).otherwise(size)
    return F.when(x == 0, 0).when(x > 0, steps).otherwise(-steps)


def _cells(values: DataFrame, column: str, inside: Sequence[_Cell] | None, exact: int) -> DataFrame:
    """Rows of `column` counted by cell: all of them by octaves, or those in the cells `inside`
    (in their order) by parts of these."""
    x = F.col("x")
    rows = values.select(as_column(column).alias("x")).filter("x IS NOT NULL")
    if inside is None:
        keyed = rows.select(F.lit(0).alias("parent"), _octave_cell(x).cast("double").alias("cell"), "x")
    else:
        parent = part = F.lit(None)
        for i, c in enumerate(inside):
            here = (x >= c.low) & (x <= c.high)
            # The greater of two values never gets the lesser part, however the division rounds.
            share = x if c.count <= exact else F.floor((x - c.low) / (c.high - c.low) * _CELLS).cast("double")
            parent, part = F.when(here, F.lit(i)).otherwise(parent), F.when(here, share).otherwise(part)
        keyed = rows.select(parent.alias("parent"), part.alias("cell"), "x").filter("parent IS NOT NULL")
    counted = keyed.groupBy("parent", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    return counted.select(F.lit(column).alias("column"), "parent", "low", "high", "n")


def _descend(values: DataFrame, inside: dict[str, list[_Cell] | None], exact: int) -> dict[str, list[_Cell]]:
    """One pass over the columns: the cells, in order, that the rows of all columns, or of these cells, are in."""
    counted = reduce(DataFrame.unionAll, [_cells(values, c, cells, exact) for c, cells in inside.items()])
    rows: dict[tuple[str, int], list] = {}
    for r in counted.collect():  # no more rows than cells, whatever the data
        rows.setdefault((r["column"], r["parent"]), []).append((r["low"], r["high"], r["n"]))
    out: dict[str, list[_Cell]] = {c: [] for c in inside}
    for (column, parent), found in sorted(rows.items()):
        before = 0 if inside[column] is None else inside[column][parent].before
        for low, high, n in sorted(found):
            out[column].append(_Cell(column, low, high, n, before))
            before += n
    return out


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], exact: int = EXACT
) -> dict[str, list[float]]:
    """Exact quantiles with linear interpolation, for every column in the same few passes.

    `percentile` keeps every distinct value of a column in one task. This is a radix selection instead: rows are
    counted by cells that follow the order of the values, by exponent and first bits of the mantissa, then the
    cells that hold wanted ranks are cut into 16,384 parts each, until a cell has one value or few rows. A double
    has 64 bits, so there are five passes at most, whatever the values; later ones count the few rows of the
    cells that are left. A pass is a code-generated hash aggregate without a sketch or a list, and the driver sees
    a row per cell. Null and NaN do not count.
    """
    values = df.select(*[as_column(c).cast("double").alias(c) for c in columns])
    # Only these columns are read again, so only they are written.
    values = materialize(
        values.select(*[F.when(~F.isnan(as_column(c)), as_column(c)).alias(c) for c in columns]), "quantiles"
    )
    cells = _descend(values, {c: None for c in columns}, exact)
    size = {c: cells[c][-1].before + cells[c][-1].count for c in columns if cells[c]}
    positions = {(c, p): p * (n - 1) for c, n in size.items() for p in probabilities}
    open_ = {(c, rank) for (c, _), x in positions.items() for rank in (math.floor(x), math.ceil(x))}
    known: dict[tuple[str, int], float] = {}
    while True:
        inside: dict[str, list[_Cell]] = {}
        for column, rank in sorted(open_):
            cell = cells[column][bisect_right(cells[column], rank, key=lambda c: c.before) - 1]
            if (value := cell.value(rank)) is not None:
                known[column, rank] = value
            elif cell not in inside.setdefault(column, []):
                inside[column].append(cell)
        inside = {c: found for c, found in inside.items() if found}
        open_ -= known.keys()
        if not open_:
            break
        cells |= _descend(values, inside, exact)

    def at(c: str, p: float) -> float | None:
        if (c, p) not in positions:
            return None
        position = positions[c, p]
        low, high = known[c, math.floor(position)], known[c, math.ceil(position)]
        return low if low == high else low + (high - low) * (position - math.floor(position))

    return {c: [at(c, p) for p in probabilities] for c in columns}
