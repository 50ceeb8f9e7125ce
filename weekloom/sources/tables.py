"""Tables and yearly CSV files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.operators.schema import VintageNames, add_literal, rename_vintage
from weekloom.operators.sets import union_vintages


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalogue table by name, or a parquet path."""
    return spark.read.parquet(name) if "/" in name else spark.read.table(name)


def scan_features(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A prepared frame; NaN in floating columns becomes null, as later sums and counts expect."""
    df = scan_table(spark, path)
    if columns is not None:
        df = df.select(*columns)
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floating})


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with a header. With a schema there is no pass over the file to infer types."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def scan_csv_vintages(
    spark: SparkSession, paths: Mapping[int, str], names: VintageNames,
    schemas: Mapping[int, T.StructType | str] | None = None, year: str = "YEAR",
) -> DataFrame:
    """Yearly files in one frame: common column names, the year as a column, gaps as nulls."""
    frames = []
    for y, path in sorted(paths.items()):
        raw = scan_csv(spark, path, schemas[y] if schemas else None)
        frames.append(add_literal(rename_vintage(raw, y, names), year, y))
    return union_vintages(frames)


def write_table(df: DataFrame, target: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a catalogue table by name, or a parquet path."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target) if "/" in target else writer.saveAsTable(target)
