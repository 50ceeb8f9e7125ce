"""Scalers: one aggregation fits every column; the parameters are a table with a row per column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.functions import as_column
from weekloom.operators.ordered import exact_quantiles

PARAMETERS = "feature string, kind string, center double, spread double, low double, high double"


@dataclass(frozen=True)
class Scaler:
    """Per column: scaled = (x - center) / spread * (high - low) + low."""

    parameters: dict[str, dict]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, p["kind"], p["center"], p["spread"], p["low"], p["high"]) for c, p in self.parameters.items()]
        return spark.createDataFrame(rows, PARAMETERS)

    @staticmethod
    def of(table: DataFrame) -> Scaler:
        # One row per scaled column.
        return Scaler({r["feature"]: r.asDict() for r in table.collect()})

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scaler:
        return Scaler.of(spark.read.parquet(path))

    def _scaled(self, c: str) -> Column:
        p = self.parameters[c]
        if p["center"] is None:
            return F.lit(None).cast("double")
        unit = (as_column(c) - p["center"]) / F.lit(p["spread"] or 1.0)
        return unit * (p["high"] - p["low"]) + p["low"]

    def _unscaled(self, c: str) -> Column:
        p = self.parameters[c]
        if p["center"] is None:
            return F.lit(None).cast("double")
        return (as_column(c) - p["low"]) / (p["high"] - p["low"]) * (p["spread"] or 1.0) + p["center"]

    def transform(self, df: DataFrame) -> DataFrame:
        """Scale the fitted columns in place. A constant column goes to the low end."""
        return df.withColumns({c: self._scaled(c) for c in self.parameters})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self._unscaled(c) for c in self.parameters})


def _fit(df: DataFrame, columns: Sequence[str], center, spread, kind: str, low: float, high: float) -> Scaler:
    row = df.agg(
        *[
            e
            for i, c in enumerate(columns)
            for e in (center(c).cast("double").alias(f"c{i}"), spread(c).cast("double").alias(f"s{i}"))
        ]
    ).first()
    return Scaler(
        {
            c: {"kind": kind, "center": row[f"c{i}"], "spread": row[f"s{i}"], "low": low, "high": high}
            for i, c in enumerate(columns)
        }
    )


def fit_minmax(df: DataFrame, columns: Sequence[str], low: float = 1.0, high: float = 2.0) -> Scaler:
    return _fit(
        df, columns, lambda c: F.min(as_column(c)), lambda c: F.max(as_column(c)) - F.min(as_column(c)),
        "minmax", float(low), float(high),
    )


def fit_standard(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """Zero mean, unit population deviation."""
    return _fit(
        df, columns, lambda c: F.avg(as_column(c)), lambda c: F.stddev_pop(as_column(c)), "standard", 0.0, 1.0
    )


def fit_robust(
    df: DataFrame, columns: Sequence[str], low: float = 10, high: float = 90, approximate: bool = False
) -> Scaler:
    """Zero median, unit distance between the two percentiles."""
    points = [0.5, low / 100, high / 100]
    if approximate:
        row = df.agg(
            *[F.percentile_approx(as_column(c).cast("double"), points).alias(f"q{i}") for i, c in enumerate(columns)]
        ).first()
        quantiles = {c: row[f"q{i}"] for i, c in enumerate(columns)}
    else:
        quantiles = exact_quantiles(df, columns, points)
    parameters = {}
    for c, q in quantiles.items():
        spread = None if q is None or q[0] is None else q[2] - q[1]
        parameters[c] = {
            "kind": "robust", "center": q[0] if q else None, "spread": spread, "low": 0.0, "high": 1.0,
        }
    return Scaler(parameters)


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "minmax", **options) -> Scaler:
    """`minmax`, `standard` or `robust`; options as in the fit function of that kind."""
    return {"minmax": fit_minmax, "standard": fit_standard, "robust": fit_robust}[kind](df, columns, **options)
