"""Weighted regression and classification with Spark ML, with a validation stop.

Codes are categories to every learner: the linear ones get a column per code, trees get nominal features, which they
split by sets of codes, whatever the order of the labels is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions import as_column
from weekloom.session import materialize


@dataclass(frozen=True)
class FeatureSpec:
    """Column names by role. Codes are encoded columns; scaled and logged are numeric."""

    codes: Sequence[str] = ()
    scaled: Sequence[str] = ()
    logged: Sequence[str] = ()
    label: str = "label"
    weight: str | None = None

    @property
    def numeric(self) -> list[str]:
        return [*self.scaled, *self.logged]


#: Codes that a tree feature tells apart. Of a column with more, codes with a similar mean label share a bin.
MAX_CODES = 200
#: Trees whose answers are worked out anew for every row before margins are written.
_BLOCK = 5


def _one_hot(spec: FeatureSpec) -> list:
    if not spec.codes:
        return [VectorAssembler(inputCols=spec.numeric, outputCol="features")]
    vectors = [f"{c}_vector" for c in spec.codes]
    return [
        OneHotEncoder(inputCols=list(spec.codes), outputCols=vectors, handleInvalid="keep"),
        VectorAssembler(inputCols=[*vectors, *spec.numeric], outputCol="features"),
    ]


def _bins(df: DataFrame, code: str, spec: FeatureSpec, bins: int) -> list[int]:
    """A bin for every code from 0 on, by mean label and in shares of the rows. A code without rows gets the last bin."""
    weight = as_column(spec.weight) if spec.weight else F.lit(1.0)
    counted = df.groupBy(as_column(code).cast("int").alias("code")).agg(
        F.sum(weight).alias("w"), F.sum(weight * as_column(spec.label)).alias("s")
    )
    rows = sorted(counted.filter("code >= 0").collect(), key=lambda r: (r["s"] / r["w"], r["code"]))  # a row per code
    total, before = sum(r["w"] for r in rows), 0.0
    out = [bins - 1] * (max((r["code"] for r in rows), default=-1) + 1)
    for r in rows:
        out[r["code"]] = min(bins - 1, int(bins * before / total))
        before += r["w"]
    return out


def _nominal(df: DataFrame, spec: FeatureSpec, max_codes: int) -> tuple[list, int]:
    """Stages that make nominal features of the codes, and the bins that trees need for them.

    Codes go through an index, whose metadata tells the trees which features are nominal and how many values they
    have; a code that the fit did not see gets a value of its own. A column of more than `max_codes` codes is
    folded first: a list with the bin of each code, in mean-label order, travels with the model.
    """
    if not spec.codes:
        return [VectorAssembler(inputCols=spec.numeric, outputCol="features")], 0
    counts = df.agg(*[F.count_distinct(as_column(c)).alias(f"n{i}") for i, c in enumerate(spec.codes)]).first()
    stages, inputs = [], []
    for i, c in enumerate(spec.codes):
        if counts[f"n{i}"] <= max_codes:
            inputs.append(c)
            continue
        listed = ", ".join(map(str, _bins(df, c, spec, max_codes)))
        stages.append(SQLTransformer(
            statement=f"SELECT *, coalesce(get(array({listed}), CAST(`{c}` AS INT)), {max_codes - 1}) AS `{c}_bin` FROM __THIS__"))
        inputs.append(f"{c}_bin")
    nominal = [f"{c}_nominal" for c in spec.codes]
    stages.append(StringIndexer(inputCols=inputs, outputCols=nominal, handleInvalid="keep", stringOrderType="alphabetAsc"))
    stages.append(VectorAssembler(inputCols=[*nominal, *spec.numeric], outputCol="features"))
    most = max(min(counts[f"n{i}"], max_codes) for i in range(len(spec.codes)))
    return stages, most + 1


def _trained_on(features: PipelineModel, df: DataFrame, spec: FeatureSpec, *more: str) -> DataFrame:
    """The columns a learner reads, written once and dealt evenly: it goes over them again and again, and a small
    table that lies in one file would be read by one task each time."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = ["features", spec.label, *([spec.weight] if spec.weight else []), *more]
    return materialize(features.transform(df).select(*columns).repartition(parts), "training")


def _fit(df: DataFrame, spec: FeatureSpec, learner, by_tree: bool, max_codes: int) -> PipelineModel:
    stages, bins = _nominal(df, spec, max_codes) if by_tree else (_one_hot(spec), 0)
    if by_tree:
        learner = learner.setMaxBins(max(learner.getMaxBins(), bins))
    features = Pipeline(stages=stages).fit(df)
    model = _learner(spec, learner).fit(_trained_on(features, df, spec))
    return PipelineModel(stages=[*features.stages, model])


def _learner(spec: FeatureSpec, learner):
    learner = learner.setFeaturesCol("features").setLabelCol(spec.label)
    return learner.setWeightCol(spec.weight) if spec.weight else learner


def train_regressor(
    df: DataFrame, spec: FeatureSpec, kind: str = "gbt", seed: int = 75, max_codes: int = MAX_CODES, **options
) -> PipelineModel:
    """`gbt` takes codes as nominal features, `linear` one-hot. Of a column with more than `max_codes` codes,
    trees see that many bins of codes with similar mean labels."""
    learner = GBTRegressor(seed=seed, **options) if kind == "gbt" else LinearRegression(**options)
    return _fit(df, spec, learner, kind == "gbt", max_codes)


def train_classifier(
    df: DataFrame, spec: FeatureSpec, kind: str = "logistic", seed: int = 75, max_codes: int = MAX_CODES, **options
) -> PipelineModel:
    """A probability per class: `logistic` (codes one-hot), `forest`, or `gbt` for two classes (codes nominal)."""
    if kind == "logistic":
        learner = LogisticRegression(**options)
    elif kind == "forest":
        learner = RandomForestClassifier(seed=seed, **options)
    else:
        learner = GBTClassifier(seed=seed, **options)
    return _fit(df, spec, learner, kind != "logistic", max_codes)


def best_count(losses: Sequence[float], patience: int, min_delta: float) -> int:
    """How many iterations to keep: up to the least loss seen before `patience` iterations in a row
    failed to improve the best loss by more than `min_delta`."""
    best, waited, seen = float("inf"), 0, 0
    for loss in losses:
        seen += 1
        if loss < best - min_delta:
            best, waited = loss, 0
        else:
            waited += 1
            if waited >= patience:
                break
    window = list(losses[:seen])
    return window.index(min(window)) + 1


def stops(losses: Sequence[float], patience: int, min_delta: float) -> bool:
    """Have the last `patience` iterations failed to improve the best loss by more than `min_delta`?"""
    best, waited = float("inf"), 0
    for loss in losses:
        best, waited = (loss, 0) if loss < best - min_delta else (best, waited + 1)
        if waited >= patience:
            return True
    return False


@dataclass(frozen=True)
class ValidatedFit:
    """`first` saw the training rows only, and has all trees that were grown; `model` is the second fit, on the
    wider set, with the best number of them."""

    first: PipelineModel
    model: PipelineModel
    iterations: int
    losses: list[float]

    def history(self, df: DataFrame) -> DataFrame:
        """Validation loss by iteration, counted from 1."""
        rows = [(i + 1, float(v)) for i, v in enumerate(self.losses)]
        return df.sparkSession.createDataFrame(rows, "iteration int, loss double")


def _boost(
    train: DataFrame, validation: DataFrame, spec: FeatureSpec, task: str, max_iter: int, patience: int,
    min_delta: float, seed: int, step: float, tree_options: dict,
) -> tuple[list, list[float], list[float]]:
    """Trees, their weights and the validation loss after each. A tree is grown on what the loss asks to be added to
    the sum of those before it, and growing stops by the validation loss. Sums are written every few trees."""
    weight = as_column(spec.weight) if spec.weight else F.lit(1.0)
    label, so_far = as_column(spec.label).cast("double"), F.col("_sum")
    if task == "regression":
        target = label
        wanted = 2 * (target - so_far)
        loss = (target - so_far) * (target - so_far)
    else:  # classes -1 and 1, log loss
        target = 2 * label - 1
        wanted = 4 * target / (1 + F.exp(2 * target * so_far))
        loss = 2 * F.log1p(F.exp(-2 * target * so_far))
    sides = [df.withColumn("_sum", F.lit(0.0)) for df in (train, validation)]
    trees, weights, losses = [], [], []
    for m in range(max_iter):
        learner = RandomForestRegressor(
            numTrees=1, bootstrap=False, seed=seed + m, labelCol="_wanted", predictionCol="_answer", **tree_options
        )
        if spec.weight:
            learner = learner.setWeightCol(spec.weight)
        grown = learner.fit(sides[0].withColumn("_wanted", wanted if m else target)).trees[0].setPredictionCol("_answer")
        trees.append(grown)
        weights.append(step if m else 1.0)
        sides = [
            grown.transform(side).withColumn("_sum", so_far + F.lit(weights[-1]) * F.col("_answer")).drop("_answer")
            for side in sides
        ]
        if (m + 1) % _BLOCK == 0:
            sides = [materialize(side, "boosted") for side in sides]
        row = sides[1].agg(F.sum(loss * weight).alias("loss"), F.sum(weight).alias("n")).first()
        losses.append(row["loss"] / row["n"])
        if stops(losses, patience, min_delta):
            break
    return trees, weights, losses


def _ensemble(df: DataFrame, trees: list, weights: list[float], task: str):
    """The trees as the boosted model that Spark's own learner gives."""
    context = df.sparkSession.sparkContext
    gateway, jvm = context._gateway, context._jvm.org.apache.spark.ml
    name, python = (
        (jvm.regression.GBTRegressionModel, GBTRegressionModel)
        if task == "regression"
        else (jvm.classification.GBTClassificationModel, GBTClassificationModel)
    )
    listed = gateway.new_array(jvm.regression.DecisionTreeRegressionModel, len(trees))
    factors = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        listed[i], factors[i] = tree._java_obj, float(weight)
    return python(name(f"{python.__name__}_{uuid4().hex[:12]}", listed, factors))


def fit_with_validation(
    train: DataFrame, validation: DataFrame, spec: FeatureSpec, task: str = "regression",
    max_iter: int = 20, patience: int = 5, min_delta: float = 0.0, seed: int = 75, max_codes: int = MAX_CODES,
    stepSize: float = 0.1, **options,
) -> ValidatedFit:
    """Boost on the training rows, read the validation loss after every tree, stop growing once it has not improved
    for `patience` trees, keep the best number of trees, and fit that many on training and validation rows
    together."""
    stages, bins = _nominal(train, spec, max_codes)
    features = Pipeline(stages=stages).fit(train)
    sides = [_trained_on(features, df, spec) for df in (train, validation)]
    tree_options = options | {"maxBins": max(options.get("maxBins", 32), bins)}
    tree_options.setdefault("featureSubsetStrategy", "all")
    trees, weights, losses = _boost(
        *sides, spec, task, max_iter, patience, min_delta, seed, stepSize, tree_options
    )
    first = PipelineModel(stages=[*features.stages, _ensemble(train, trees, weights, task)])
    count = best_count(losses, patience, min_delta)
    fit = train_regressor if task == "regression" else train_classifier
    second = fit(
        train.unionByName(validation), spec, kind="gbt", seed=seed, max_codes=max_codes, maxIter=count, stepSize=stepSize,
        **options,
    )
    return ValidatedFit(first, second, count, losses)


def score_table(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Kept columns, the prediction, and the class probabilities as an array where there are any."""
    scored = model.transform(df)
    out = [as_column(c) for c in (keep or df.columns)] + [F.col("prediction")]
    if "probability" in scored.columns:
        out.append(vector_to_array("probability").alias("probability"))
    return scored.select(*out)
