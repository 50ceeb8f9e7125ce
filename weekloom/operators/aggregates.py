"""Aggregations and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.functions import as_column
from weekloom.session import materialize


def group_reduce(
    df: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), means: Sequence[str] = ()
) -> DataFrame:
    """One row per key: sums (0 where all values are null) and means. Rows with a null key are left out."""
    return (
        df.dropna("any", subset=list(keys))
        .groupBy(*[as_column(k) for k in keys])
        .agg(
            *[F.coalesce(F.sum(as_column(c)), F.lit(0)).alias(c) for c in sums],
            *[F.avg(as_column(c)).alias(c) for c in means],
        )
    )


def share_of_total(df: DataFrame, value: str | Column, name: str) -> DataFrame:
    """Each row's share of the grand total, which is read as a scalar subquery."""
    value = as_column(value)
    total = df.agg(F.sum(value).alias("_total")).scalar()
    return df.withColumn(name, F.try_divide(value, total))


def combination_sales(
    df: DataFrame, keys: Sequence[str], price: str, quantity: str
) -> DataFrame:
    """Mean price, total quantity and sales (their product) per key, each key's share of all sales,
    and its row count as `n`."""
    grouped = (
        df.groupBy(*[as_column(k) for k in keys])
        .agg(
            F.avg(as_column(price)).alias(price),
            F.sum(as_column(quantity)).alias(quantity),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("sales", as_column(price) * as_column(quantity))
    )
    return share_of_total(grouped, "sales", "sales_share")


def value_counts(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Rows per label as `n`, and their share of all labelled rows."""
    names = [columns] if isinstance(columns, str) else list(columns)
    present = df.dropna("any", subset=names)
    counts = present.groupBy(*[as_column(c) for c in names]).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n").alias("_all")).scalar())


def _unpivot(row: DataFrame, names: Sequence[str], label: str, *values: str) -> DataFrame:
    """A one-row frame with columns `<i>_<value>` to one row per name."""
    entries = [
        F.struct(F.lit(name).alias(label), *[F.col(f"{i}_{v}").alias(v) for v in values])
        for i, name in enumerate(names)
    ]
    return row.select(F.inline(F.array(*entries)))


def null_audit(df: DataFrame) -> DataFrame:
    """Null count per column, in one pass."""
    row = df.agg(*[F.count_if(as_column(c).isNull()).alias(f"{i}_nulls") for i, c in enumerate(df.columns)])
    return _unpivot(row, df.columns, "column", "nulls")


def count_by_column(df: DataFrame, columns: Sequence[tuple[int, str]]) -> DataFrame:
    """Position, name and non-null count of the given columns, as `columns_by_type` lists them."""
    row = df.agg(*[F.count(as_column(c)).alias(f"{i}_present") for i, (_, c) in enumerate(columns)])
    positions = F.create_map(*[F.lit(x) for p, c in columns for x in (c, p)])
    out = _unpivot(row, [c for _, c in columns], "column", "present")
    return out.select(F.element_at(positions, F.col("column")).alias("position"), "column", "present")


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def cardinality(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column, null counted as a value.

    The exact count makes each column's values distinct by themselves, in every task before the shuffle and after it,
    so no row is expanded; the columns are written once, and each is read alone. `approximate` takes one pass.
    """
    if approximate:
        row = df.agg(
            *[
                (F.approx_count_distinct(as_column(c)) + F.coalesce(F.max(as_column(c).isNull().cast("int")), F.lit(0))).alias(
                    f"{i}_distinct"
                )
                for i, c in enumerate(columns)
            ]
        )
        return _unpivot(row, columns, "column", "distinct")
    written = materialize(df.select(*[as_column(c).alias(f"c{i}") for i, c in enumerate(columns)]), "columns")
    values = [written.select(F.lit(c).alias("column"), f"c{i}").distinct().select("column") for i, c in enumerate(columns)]
    counted = reduce(DataFrame.unionAll, values).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    # A column of a table without rows has none.
    return names.join(counted, "column", "left").select("column", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def segment_profile(df: DataFrame, segment: str, key: str, measures: Sequence[str]) -> DataFrame:
    """Per segment: rows, most frequent key (lowest on ties), and mean, least and greatest of each measure.

    Keys are counted first, so the most frequent one needs no value map held in a task.
    """
    by_key = df.groupBy(as_column(segment).alias(segment), as_column(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            a
            for i, m in enumerate(measures)
            for a in (
                F.sum(as_column(m)).alias(f"_s{i}"),
                F.count(as_column(m)).alias(f"_c{i}"),
                F.min(as_column(m)).alias(f"_a{i}"),
                F.max(as_column(m)).alias(f"_b{i}"),
            )
        ],
    )
    return by_key.groupBy(as_column(segment)).agg(
        F.sum("_n").alias("total_count"),
        F.min_by("_key", F.struct(-F.col("_n"), F.col("_key"))).alias(key),
        *[
            a
            for i, m in enumerate(measures)
            for a in (
                F.try_divide(F.sum(f"_s{i}"), F.sum(f"_c{i}")).alias(f"{m}_mean"),
                F.min(f"_a{i}").alias(f"{m}_min"),
                F.max(f"_b{i}").alias(f"{m}_max"),
            )
        ],
    )


def distinct_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[as_column(c) for c in columns]).distinct()


def segment_key_share(df: DataFrame, segment: str, key: str) -> DataFrame:
    """Distinct keys per segment over distinct keys overall."""
    pairs = distinct_keys(df, segment, key)
    overall = pairs.agg(F.count_distinct(as_column(key)).alias("_all")).scalar()
    per_segment = pairs.groupBy(as_column(segment)).agg(F.count(as_column(key)).alias("keys"))
    return per_segment.withColumn("key_share", F.col("keys") / overall)


def _pearson(x: Column, y: Column) -> Column:
    """Over the rows that have both values; null where one of them does not vary. `corr` itself
    raises there under ANSI."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    # Rounding leaves a constant some variance, so least and greatest values are compared.
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))


#: Columns up to which every pair of them is an expression of one aggregation.
PAIRED = 24


def correlation_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of all column pairs in long form (a, b, r), optionally per group, each over the rows that
    have both values; null where one of them does not vary.

    Pairs run over columns, never over rows. Up to `PAIRED` columns every pair comes out of the same aggregation; with
    more, tasks add up products of the columns as matrices, and a row per column and task is merged.
    """
    if len(columns) > PAIRED:
        return _gram_correlations(df, columns, by)
    pairs = list(combinations(range(len(columns)), 2))
    x = [as_column(c).cast("double") for c in columns]
    grouped = df.groupBy(*[as_column(c) for c in by]).agg(
        *[_pearson(x[i], x[j]).alias(f"_r{i}_{j}") for i, j in pairs],
        *[F.when(F.min(x[i]) < F.max(x[i]), 1.0).alias(f"_r{i}_{i}") for i in range(len(columns))],
    )
    entries = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_r{min(i, j)}_{max(i, j)}").alias("r")
        )
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return grouped.select(*[as_column(c) for c in by], F.inline(F.array(*entries)))


def _gram_correlations(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """By sums of products. Values are taken relative to the mean of their column, so that little cancels."""
    x = [as_column(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    keys = [as_column(c).alias(f"k{i}") for i, c in enumerate(by)]
    rows = materialize(df.select(*keys, *x), "columns")
    means = list(rows.agg(*[F.coalesce(F.avg(f"x{i}"), F.lit(0.0)) for i in range(len(columns))]).first())
    kinds = [f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(by))]
    if by:
        rows = rows.sortWithinPartitions(*[f"k{i}" for i in range(len(by))])
    sums = rows.mapInArrow(_gram_rows(len(by), means), ", ".join([*kinds, "i int, sums array<double>"]))
    order = [*[f"k{i}" for i in range(len(by))], "i"]
    merged = sums.repartition(*order).sortWithinPartitions(*order)
    found = merged.mapInArrow(_merged_correlations(len(by)), ", ".join([*kinds, "i int, r array<double>"]))
    name = F.array(*[F.lit(c) for c in columns])
    long = found.select(*order[:-1], name[F.col("i")].alias("a"), F.posexplode("r").alias("j", "r"))
    return long.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(by)], "a", name[F.col("j")].alias("b"), "r")


def _key_runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, int, int]]:
    """Keys, begin and end of the runs of equal keys in the first columns."""
    if not keys:
        yield (), 0, batch.num_rows
        return
    rows = list(zip(*[batch.column(i).to_pylist() for i in range(keys)], strict=True))
    begin = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[begin]:
            yield rows[begin], begin, i
            begin = i


def _gram_rows(keys: int, means: list[float]) -> Callable:
    """For mapInArrow over rows sorted by their keys: for every group and column i, over the rows that have both i and
    j, for all j: their number, sum of i, of its squares, of j, of its squares, and of the products."""
    n = len(means)

    def out(kinds: list[pa.DataType], key: tuple, m: np.ndarray) -> pa.RecordBatch:
        # m: mask * mask, values * mask, squares * mask, values * values
        parts = np.concatenate([m[0], m[1], m[2], m[1].T, m[2].T, m[3]], axis=1)
        columns = [pa.array([k] * n, t) for k, t in zip(key, kinds, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 6 * n * n + 1, 6 * n, dtype=np.int32)), pa.array(parts.ravel()))
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.arange(n, dtype=np.int32)), lists], [*[f"k{i}" for i in range(keys)], "i", "sums"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, kinds = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.column(i).type for i in range(keys)]
            held = np.stack([~np.asarray(batch.column(keys + i).is_null()) for i in range(n)], axis=1).astype(float)
            values = np.stack(
                [pc.fill_null(batch.column(keys + i), means[i]).to_numpy(zero_copy_only=False) - means[i] for i in range(n)], axis=1
            )
            for key, low, high in _key_runs(batch, keys):
                if total is not None and key != current:
                    yield out(kinds, current, total)
                    total = None
                mask, x = held[low:high], values[low:high]
                square = x * x
                part = np.stack([mask.T @ mask, x.T @ mask, square.T @ mask, x.T @ x])
                current, total = key, part if total is None else total + part
        if total is not None:
            yield out(kinds, current, total)

    return run


def _merged_correlations(keys: int) -> Callable:
    """For mapInArrow over the rows of `_gram_rows` sorted by keys and column: the correlations of a column."""

    def correlations(sums: np.ndarray, i: int) -> list[float | None]:
        n, sx, sxx, sy, syy, sxy = sums.reshape(6, -1)
        with np.errstate(invalid="ignore", divide="ignore"):
            vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
            r = (sxy / n - sx * sy / n**2) / np.sqrt(vx * vy)
            varies = (n > 0) & (vx > _NOTHING * sxx / n) & (vy > _NOTHING * syy / n)
        r = np.clip(r, -1, 1)
        r[i] = 1.0
        return [float(x) if ok else None for x, ok in zip(r, varies, strict=True)]

    def out(kinds: list[pa.DataType], key: tuple, total: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([k], t) for k, t in zip(key, kinds, strict=True)]
        names = [*[f"k{i}" for i in range(keys)], "i", "r"]
        return pa.RecordBatch.from_arrays([*columns, pa.array([correlations(total, key[-1])], pa.list_(pa.float64()))], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, kinds = None, None, []
        for batch in batches:
            kinds = [batch.column(i).type for i in range(keys + 1)]
            sums = batch.column(keys + 1)
            for key, low, high in _key_runs(batch, keys + 1):
                if total is not None and key != current:
                    yield out(kinds, current, total)
                    total = None
                part = sums.slice(low, high - low).flatten().to_numpy().reshape(high - low, -1).sum(axis=0)
                current, total = key, part if total is None else total + part
        if total is not None:
            yield out(kinds, current, total)

    return run


#: What is left of a square mean by rounding, where a column does not vary.
_NOTHING = 1e-13


def argmin_row(df: DataFrame, key: str, metric: str) -> DataFrame:
    """Key at the minimum of a metric; the lowest key on ties."""
    order = F.struct(as_column(metric), as_column(key))
    return df.filter(as_column(metric).isNotNull()).agg(
        F.min_by(as_column(key), order).alias(key), F.min(as_column(metric)).alias(metric)
    )


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First rows by an explicit order."""
    return df.orderBy(*[as_column(c).asc() for c in order]).limit(n)


def tail(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """Last rows by an explicit order: the first rows of the reversed one."""
    return df.orderBy(*[as_column(c).desc() for c in order]).limit(n)


def sort_multi(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*[as_column(c).asc() for c in order])
