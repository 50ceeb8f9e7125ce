"""Weekly sales to a log-quantity regression and its error statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.functions import as_column, date_features, log_plus_one, log_target, parse_percent, truncate_int
from weekloom.operators.encoders import Encoder, fit_encoder
from weekloom.operators.evaluation import percent_error_stats
from weekloom.operators.filters import before_year, in_year, select_slice
from weekloom.operators.joins import keep_keys
from weekloom.operators.learning import FeatureSpec, fit_with_validation, score_table
from weekloom.operators.scalers import Scaler, fit_minmax
from weekloom.operators.series import denoise_series
from weekloom.operators.shares import cumulative_share_cut
from weekloom.operators.weights import add_weights, quantile_bins, sample_weights, stratified_split
from weekloom.session import materialize


@dataclass(frozen=True)
class SalesColumns:
    """Names of the input columns by role."""

    categorical: tuple[str, ...] = ("brand", "ka", "fsa")
    week: str = "week_end"
    population: str = "population"
    inflation: str = "inflation_text"
    price: str = "price"
    quantity: str = "qty"
    time: tuple[str, ...] = ("Time_Yr", "Time_Week", "Time_Mon")

    @property
    def key(self) -> list[str]:
        return [*self.categorical, self.week]


def denoised_sales(
    sales: DataFrame, columns: SalesColumns, stop_year: int, threshold: float = 0.01,
    one_row_per_date: bool = False, **slice_,
) -> DataFrame:
    """One slice of the sales, typed, with date parts, before `stop_year`, price and quantity denoised."""
    c = columns
    data = before_year(select_slice(sales, **slice_), c.week, stop_year).select(
        *[as_column(k) for k in c.key],
        *date_features(c.week, "Time_", [t.removeprefix("Time_") for t in c.time]),
        truncate_int(c.population).alias(c.population),
        parse_percent(c.inflation).alias(c.inflation),
        as_column(c.price),
        truncate_int(c.quantity).alias(c.quantity),
    )
    return denoise_series(data, c.categorical, [c.week], [c.price, c.quantity], threshold, one_row_per_date)


def large_combinations(
    data: DataFrame, columns: SalesColumns, share_year: int, threshold: float = 0.05, one_row_per_date: bool = False
) -> DataFrame:
    """Rows of the combinations that are left after the smallest ones of one year are dropped."""
    c = columns
    data = materialize(data, "denoised")
    judged = in_year(data, c.week, share_year)
    kept = cumulative_share_cut(judged, c.categorical, c.price, c.quantity, threshold)
    return keep_keys(data, kept, c.categorical)


@dataclass(frozen=True)
class SalesFeatures:
    rows: DataFrame
    spec: FeatureSpec
    encoder: Encoder
    scaler: Scaler

    def save(self, path: str) -> None:
        """The dictionary and the scaling, to be applied to new rows by `NewSales`."""
        self.encoder.save(f"{path}/encoder")
        self.scaler.save(self.rows.sparkSession, f"{path}/scaler")


@dataclass(frozen=True)
class NewSales:
    """Saved parameters, for rows that came later. A label that the fit did not see gets the code after the last."""

    encoder: Encoder
    scaler: Scaler

    @staticmethod
    def load(spark: SparkSession, path: str) -> NewSales:
        return NewSales(Encoder.load(spark, f"{path}/encoder"), Scaler.load(spark, f"{path}/scaler"))

    def features(self, rows: DataFrame, columns: SalesColumns) -> DataFrame:
        """Codes, scaled measures and the logged price for typed rows with date parts."""
        coded = self.encoder.transform(rows, [*columns.categorical, *columns.time], reserve=True)
        return self.scaler.transform(coded).withColumn(f"log_{columns.price}", log_plus_one(columns.price))

    def score(self, rows: DataFrame, columns: SalesColumns, model: PipelineModel) -> DataFrame:
        """The key and the predicted log quantity."""
        return score_table(model, self.features(rows, columns), columns.key)


def sales_features(
    data: DataFrame, columns: SalesColumns, weight_by: str = "brand", fit_on: str = "train", seed: int = 75,
    duplicates: str = "raise",
) -> SalesFeatures:
    """Split by quartiles of the log target, then encode, scale, log and weight. Parameters come
    from the training rows, or from all rows with `fit_on="all"`. Quartiles that coincide are an error,
    or with `duplicates="drop"` fewer strata."""
    c = columns
    label = "log_quantity"
    data = materialize(data, "large")
    binned = quantile_bins(data.withColumn(label, log_target(c.quantity)), label, 4, "stratum", duplicates=duplicates)
    split = materialize(
        stratified_split(binned, c.key, "stratum", test=0.05, validation=0.15, seed=seed), "sales"
    )
    base = split if fit_on == "all" else split.filter(F.col("part") == "train")
    encoder = fit_encoder(base, [*c.categorical, *c.time])
    scaler = fit_minmax(base, [c.population, c.inflation], 1.0, 2.0)
    coded = encoder.transform(split, reserve=True)
    weighted = add_weights(coded, sample_weights(base, weight_by), weight_by).withColumn(
        "weight", F.coalesce("weight", F.lit(1.0))
    )
    rows = scaler.transform(weighted).withColumn(f"log_{c.price}", log_plus_one(c.price))
    spec = FeatureSpec(
        codes=[f"{x}_code" for x in (*c.categorical, *c.time)],
        scaled=[c.population, c.inflation],
        logged=[f"log_{c.price}"],
        label=label,
        weight="weight",
    )
    return SalesFeatures(materialize(rows, "features"), spec, encoder, scaler)


@dataclass(frozen=True)
class SalesModel:
    """Errors on the test rows, in log scale: of the fit on the training rows, and of the final one."""

    model: PipelineModel
    scored: DataFrame
    first_errors: DataFrame
    errors: DataFrame
    iterations: int


def sales_regression(features: SalesFeatures, columns: SalesColumns, max_iter: int = 20, **options) -> SalesModel:
    """Fit with the validation stop, fit again on the wider set, report both on the test rows."""
    label = features.spec.label
    part = {p: features.rows.filter(F.col("part") == p) for p in ("train", "validation", "test")}
    fit = fit_with_validation(part["train"], part["validation"], features.spec, max_iter=max_iter, **options)
    first, scored = (score_table(m, part["test"], [*columns.key, label]) for m in (fit.first, fit.model))
    return SalesModel(
        fit.model,
        scored,
        percent_error_stats(first, label, "prediction"),
        percent_error_stats(scored, label, "prediction"),
        fit.iterations,
    )
