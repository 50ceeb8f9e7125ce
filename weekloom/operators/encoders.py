"""Encoders: sorted distinct values become 0..n-1. The fitted dictionary is a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.functions import as_column, clamp
from weekloom.operators.aggregates import cardinality
from weekloom.operators.joins import join_left
from weekloom.operators.ordered import numbered
from weekloom.session import materialize

_WHOLE = (T.IntegralType,)
_FRACTION = (T.FractionalType,)
#: Labels of a column that a row may be compared with one by one.
PACKED = 64


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (feature, label) for all columns in one aggregation. Labels are text; `_whole` and
    `_fraction` keep the order of numbers."""
    entries = []
    for c in columns:
        kind = df.schema[c].dataType
        entries.append(
            F.struct(
                F.lit(c).alias("feature"),
                as_column(c).cast("string").alias("label"),
                (as_column(c) if isinstance(kind, _WHOLE) else F.lit(None)).cast("bigint").alias("_whole"),
                (as_column(c) if isinstance(kind, _FRACTION) else F.lit(None)).cast("double").alias("_fraction"),
            )
        )
    return (
        df.select(F.inline(F.array(*entries)))
        .filter(F.col("label").isNotNull())
        .groupBy("feature", "label", "_whole", "_fraction")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@dataclass(frozen=True)
class Encoder:
    """A dictionary table (feature, label, code, n) and how many entries each feature has."""

    table: DataFrame
    entries: dict[str, int]

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Encoder:
        return Encoder.of(spark.read.parquet(path))

    @staticmethod
    def of(table: DataFrame) -> Encoder:
        # One row per encoded column.
        sizes = table.groupBy("feature").agg(F.count(F.lit(1)).alias("size")).collect()
        return Encoder(table, {r["feature"]: r["size"] for r in sizes})

    def transform(
        self, df: DataFrame, columns: Sequence[str] | None = None, suffix: str = "_code", reserve: bool = False
    ) -> DataFrame:
        """Add `<column><suffix>`. A label the dictionary does not know gives null, or with
        `reserve` the code after the last.

        All columns of up to `PACKED` labels are looked up in one projection, in a map each that is part of it; any
        other column takes a join.
        """
        columns, before = list(columns or self.entries), df.columns
        short = [c for c in columns if self.entries.get(c, 0) <= PACKED]
        words: dict[str, list] = {c: [] for c in short}
        for r in self.table.filter(F.col("feature").isin(short)).collect() if short else []:  # PACKED rows per column
            words[r["feature"]] += [F.lit(r["label"]), F.lit(r["code"])]
        codes = {}
        for c in short:
            code = F.try_element_at(F.create_map(*words[c]), as_column(c).cast("string")) if words[c] else F.lit(None)
            code = code.cast("int")
            codes[c + suffix] = F.coalesce(code, F.lit(self.entries.get(c, 0))) if reserve else code
        df = df.withColumns(codes)
        for c in columns:
            if c in words:
                continue
            key = f"_key_{c}"
            known = self.table.filter(F.col("feature") == c).select(
                F.col("label").alias(key), F.col("code").alias(c + suffix)
            )
            df = join_left(df.withColumn(key, as_column(c).cast("string")), known, [key]).drop(key)
            if reserve:
                df = df.withColumn(c + suffix, F.coalesce(as_column(c + suffix), F.lit(self.entries.get(c, 0))))
        added = [c + suffix for c in columns]
        return df.select(*[as_column(c) for c in before if c not in added], *[as_column(c) for c in added])


def fit_encoder(df: DataFrame, columns: Sequence[str]) -> Encoder:
    """Number the sorted distinct values of each column, numbers in numeric order."""
    counts = _value_counts(df, columns)
    ranked = numbered(counts, ["feature", "_whole", "_fraction", "label"], "_position")
    starts = ranked.groupBy("feature").agg(F.min("_position").alias("_start"))  # one row per column
    table = ranked.join(F.broadcast(starts), "feature").select(
        "feature", "label", (F.col("_position") - F.col("_start")).cast("int").alias("code"), "n"
    )
    return Encoder.of(materialize(table, "dictionary"))


def embedding_sizes(
    df: DataFrame, categorical: Sequence[str], time: Sequence[str],
    categorical_range: tuple[int, int] = (4, 50), time_range: tuple[int, int] = (3, 12),
) -> DataFrame:
    """Distinct values per column, limited to the range of its kind."""
    counts = cardinality(df, [*categorical, *time])
    is_time = F.col("column").isin(*time) if time else F.lit(False)
    size = F.when(is_time, clamp("distinct", *time_range)).otherwise(clamp("distinct", *categorical_range))
    return counts.withColumn("size", size)
