"""Error statistics and classification reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions import as_column, percent_error
from weekloom.operators.ordered import running_total

# Least absolute actual value a relative error is divided by: fixed value.
LEAST_ACTUAL = 1e-7


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean squared, absolute and absolute percentage error."""
    gap = as_column(actual) - as_column(predicted)
    relative = F.abs(gap) / F.greatest(F.abs(as_column(actual)), F.lit(LEAST_ACTUAL))
    return df.agg(
        F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"), F.avg(relative * 100).alias("mape")
    )


def percent_error_stats(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean and population deviation of the percent error, absolute and signed."""
    absolute = percent_error(actual, predicted)
    signed = percent_error(actual, predicted, signed=True)
    return df.agg(
        F.avg(absolute).alias("abs_mean"),
        F.stddev_pop(absolute).alias("abs_std"),
        F.avg(signed).alias("signed_mean"),
        F.stddev_pop(signed).alias("signed_std"),
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows by (actual, predicted) as `n`, with the empty cells. The grid is classes by classes."""
    counts = df.groupBy(as_column(actual).alias("actual"), as_column(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    labels = counts.agg(
        F.sort_array(
            F.array_distinct(F.concat(F.collect_set("actual"), F.collect_set("predicted")))
        ).alias("labels")
    )
    grid = labels.select(F.explode("labels").alias("actual"), "labels").select(
        "actual", F.explode("labels").alias("predicted")
    )
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    Works on the confusion table; a ratio without a denominator is 0.
    """
    counts = df.groupBy(as_column(actual).alias("a"), as_column(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).alias("chosen"),
                         F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("p").alias("label"), F.lit(0).alias("support"), F.col("n").alias("chosen"),
                         F.lit(0).alias("hits")),
            )
        )
    )
    totals = sides.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hits").alias("hits")
    )
    precision = _ratio(F.col("hits"), F.col("chosen"))
    recall = _ratio(F.col("hits"), F.col("support"))
    classes = totals.select(
        F.col("label").cast("string").alias("label"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"),
        "support",
        "hits",
    )
    total = F.sum("support")

    def weighted(c: str):
        return F.sum(F.col(c) * F.col("support")) / total

    accuracy = F.sum("hits") / total
    none = F.lit(None).cast("double")

    def line(label, p, r, f):
        return F.struct(
            F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), total.alias("support")
        )

    summary = classes.agg(
        F.array(
            line("accuracy", none, none, accuracy),
            line("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
            line("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
        ).alias("lines")
    ).select(F.inline("lines"))
    return classes.drop("hits").unionByName(summary)


def auc(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Area under the ROC curve; equal scores count half. Rows are first counted per score."""
    positive = as_column(actual) == 1
    by_score = df.groupBy(as_column(score).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    ranked = running_total(by_score, ["score"], "neg", "upto")
    wins = F.col("pos") * (F.col("upto") - F.col("neg") / 2)
    return ranked.agg(F.try_divide(F.sum(wins), F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def binary_metrics(df: DataFrame, actual: str, predicted: str, score: str) -> DataFrame:
    """Accuracy, precision, recall of class 1, and AUC of its score."""
    a, p = as_column(actual) == 1, as_column(predicted) == 1
    hits = F.count_if(a & p)
    counts = df.agg(
        F.avg((a == p).cast("double")).alias("accuracy"),
        _ratio(hits, F.count_if(p)).alias("precision"),
        _ratio(hits, F.count_if(a)).alias("recall"),
    )
    return counts.withColumn("auc", auc(df, actual, score).scalar())


def actual_vs_predicted(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """The pairs behind a scatter plot."""
    return df.select(as_column(actual).alias("actual"), as_column(predicted).alias("predicted"))
