"""A feature table to a class-weighted classifier and its reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.operators.encoders import Encoder, fit_encoder
from weekloom.operators.evaluation import classification_report, confusion_matrix
from weekloom.operators.learning import FeatureSpec, fit_with_validation, score_table, train_classifier
from weekloom.operators.scalers import Scaler, fit_minmax
from weekloom.operators.weights import add_weights, class_weights, stratified_split
from weekloom.session import materialize


@dataclass(frozen=True)
class LoanFeatures:
    rows: DataFrame
    spec: FeatureSpec
    target: str
    encoder: Encoder
    scaler: Scaler

    def save(self, path: str) -> None:
        """The dictionary and the scaling, to be applied to new rows by `NewLoans`."""
        self.encoder.save(f"{path}/encoder")
        self.scaler.save(self.rows.sparkSession, f"{path}/scaler")


@dataclass(frozen=True)
class NewLoans:
    """Saved parameters, for rows that came later. A label that the fit did not see gets the code after the last."""

    encoder: Encoder
    scaler: Scaler

    @staticmethod
    def load(spark: SparkSession, path: str) -> NewLoans:
        return NewLoans(Encoder.load(spark, f"{path}/encoder"), Scaler.load(spark, f"{path}/scaler"))

    def features(self, rows: DataFrame, codes: Sequence[str]) -> DataFrame:
        return self.scaler.transform(self.encoder.transform(rows, codes, reserve=True))

    def score(self, rows: DataFrame, codes: Sequence[str], model: PipelineModel, keep: Sequence[str]) -> DataFrame:
        """`keep` columns, the prediction and the class probabilities."""
        return score_table(model, self.features(rows, codes), keep)


def loan_features(
    df: DataFrame, key: Sequence[str], categorical: Sequence[str], time: Sequence[str], continuous: Sequence[str],
    target: str, seed: int = 75, fit_on: str = "train",
) -> LoanFeatures:
    """Split by class, encode, scale to 1..3, encode the target, weight by class."""
    split = materialize(stratified_split(df, key, target, test=0.05, validation=0.20, seed=seed), "loans")
    base = split if fit_on == "all" else split.filter(F.col("part") == "train")
    encoder = fit_encoder(base, [*categorical, *time, target])
    scaler = fit_minmax(base, continuous, 1.0, 3.0)
    coded = encoder.transform(split, [*categorical, *time], reserve=True)
    coded = encoder.transform(coded, [target])
    lost = [r[target] for r in split.select(target).distinct().join(base.select(target).distinct(), target, "left_anti").collect()]
    if lost:
        raise ValueError(f"classes without a training row: {lost}")
    weighted = add_weights(coded, class_weights(base, target), target)
    spec = FeatureSpec(
        codes=[f"{c}_code" for c in (*categorical, *time)],
        scaled=list(continuous),
        label=f"{target}_code",
        weight="weight",
    )
    return LoanFeatures(materialize(scaler.transform(weighted), "features"), spec, target, encoder, scaler)


@dataclass(frozen=True)
class Scored:
    """A model and its answer for every row. Parts: train, validation, test, or all but test."""

    model: PipelineModel
    rows: DataFrame
    label: str

    def confusion(self, part: str) -> DataFrame:
        return confusion_matrix(self._part(part), "actual", "predicted")

    def report(self, part: str) -> DataFrame:
        return classification_report(self._part(part), "actual", "predicted")

    def _part(self, part: str) -> DataFrame:
        chosen = F.col("part") != "test" if part == "all" else F.col("part") == part
        return self.rows.filter(chosen).select(
            F.col(self.label).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted")
        )


@dataclass(frozen=True)
class LoanModels:
    """`first` is fitted on the training rows, `final` on training and validation rows."""

    first: Scored
    final: Scored


def loan_classification(
    features: LoanFeatures, key: Sequence[str], kind: str = "logistic", max_iter: int = 20, **options
) -> LoanModels:
    """Train on the training rows, then again with the validation rows; boosted trees stop by the
    validation loss. The test rows are never trained on."""
    rows, spec = features.rows, features.spec
    train, validation = (rows.filter(F.col("part") == p) for p in ("train", "validation"))
    if kind == "gbt":
        fit = fit_with_validation(train, validation, spec, "classification", max_iter, **options)
        models = fit.first, fit.model
    else:
        wider = train.unionByName(validation)
        models = tuple(train_classifier(part, spec, kind, **options) for part in (train, wider))
    # Every report reads the scores; each model scores once.
    scores = [materialize(score_table(m, rows, [*key, "part", spec.label]), "scores") for m in models]
    first, final = (Scored(m, s, spec.label) for m, s in zip(models, scores, strict=True))
    return LoanModels(first, final)
