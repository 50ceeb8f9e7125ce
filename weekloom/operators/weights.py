"""Row weights, quantile bins and the stratified split."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions import as_column
from weekloom.operators.aggregates import value_counts
from weekloom.operators.joins import join_left
from weekloom.operators.ordered import exact_quantiles, numbered
from weekloom.session import materialize


def rank_pairing(counts: DataFrame, label: str, value: str) -> DataFrame:
    """Labels by falling `n` (label on ties); the label at rank i gets `weight`, the value at rank n+1-i."""
    ranked = numbered(counts.withColumn("_order", -F.col("n")), ["_order", label], "rank")
    size = ranked.agg(F.count(F.lit(1)).alias("_size")).scalar()
    other = ranked.select((size + 1 - F.col("rank")).alias("rank"), as_column(value).alias("weight"))
    return ranked.join(other, "rank").select(label, "n", value, "rank", "weight")


def sample_weights(df: DataFrame, label: str, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """Weight per label: shares scaled to [low, high], then handed out in reverse order of frequency."""
    counts = value_counts(df, label)
    least = counts.agg(F.min("share").alias("_min")).scalar()
    greatest = counts.agg(F.max("share").alias("_max")).scalar()
    unit = F.coalesce(F.try_divide(F.col("share") - least, greatest - least), F.lit(0.0))
    return rank_pairing(counts.withColumn("scaled", unit * (high - low) + low), label, "scaled")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight per label: the shares themselves in reverse order of frequency."""
    return rank_pairing(value_counts(df, label), label, "share")


def add_weights(df: DataFrame, weights: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Give each row the weight of its label."""
    looked_up = join_left(df, weights.select(label, F.col("weight").alias(name)), [label])
    return looked_up.select(*[as_column(c) for c in df.columns], name)


def quantile_edges(df: DataFrame, column: str, bins: int = 4) -> list[float]:
    """Cut points, ends included, for bins of equal count."""
    return exact_quantiles(df, [column], [i / bins for i in range(bins + 1)])[column]


def quantile_bins(
    df: DataFrame, column: str, bins: int = 4, name: str = "bin", duplicates: str = "raise",
    approximate: bool = False,
) -> DataFrame:
    """Bin number 0.. by exact quantiles, right-closed, lowest value included."""
    if approximate:
        points = [i / bins for i in range(bins + 1)]
        edges = df.agg(F.percentile_approx(as_column(column).cast("double"), points).alias("q")).first()["q"]
    else:
        edges = quantile_edges(df, column, bins)
    if None in edges:
        raise ValueError(f"{column} has no values to bin")
    if len(set(edges)) < len(edges):
        if duplicates != "drop":
            raise ValueError(f"bin edges of {column} are not distinct: {edges}")
        edges = sorted(set(edges))
    return df.withColumn(name, _bin_of(as_column(column), edges))


def _bin_of(x: Column, edges: Sequence[float]) -> Column:
    inner = edges[1:-1]
    number = F.lit(0)
    for edge in inner:
        number = number + (x > edge).cast("int")
    return F.when(x.isNotNull(), number)


def _allocate(counts: dict, draws: int) -> dict:
    """Share `draws` over strata in proportion to their counts: floors first, then the largest
    remainders, equal remainders by label."""
    total = sum(counts.values())
    exact = {s: n * draws / total for s, n in counts.items()}
    quota = {s: math.floor(v) for s, v in exact.items()}
    rest = draws - sum(quota.values())
    for s in sorted(counts, key=lambda s: (-(exact[s] - quota[s]), str(s)))[:rest]:
        quota[s] += 1
    return quota


def split_quotas(counts: dict, test: float, validation: float) -> dict:
    """Rows per stratum for (test, validation): a share of all rows, then a share of the rest."""
    total = sum(counts.values())
    rest = _allocate(counts, total - math.ceil(test * total))
    n_rest = sum(rest.values())
    if not n_rest:
        raise ValueError(f"{total} rows are too few to split: none is left beside the test rows")
    train = _allocate(rest, n_rest - math.ceil(validation * n_rest))
    return {s: (counts[s] - rest[s], rest[s] - train[s]) for s in counts}


#: Rows that share a hash prefix and are put in order in one place, at most.
CELL_ROWS = 100_000
#: Strata are classes or bins; the driver holds a row for each.
MOST_STRATA = 10_000
_DIGITS = 4


def _in_cells(strata: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of the cells that quotas end in, once per quota."""
    same = F.expr("s._stratum <=> e._stratum and startswith(s._hash, e._prefix)")
    return strata.alias("s").join(F.broadcast(ends.alias("e")), same).select(
        "s._stratum", "s._hash", "e._cut", "e._prefix", "e._nth"
    )


def _narrowed(strata: DataFrame, ends: DataFrame) -> list[tuple]:
    """The cells that quotas end in, by prefixes a few digits longer: one count over the rows of the old ones."""
    longer = F.expr(f"substring(_hash, 1, length(_prefix) + {_DIGITS})")
    cells = _in_cells(strata, ends).groupBy("_stratum", "_cut", "_nth", longer.alias("_prefix")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    along = Window.partitionBy("_stratum", "_cut").orderBy("_prefix")  # at most 65,536 prefixes
    reached = cells.withColumn("_after", F.sum("_n").over(along)).filter("_after >= _nth and _after - _n < _nth")
    rows = reached.select("_stratum", "_cut", "_prefix", F.expr("_nth - (_after - _n)").alias("_nth"), "_n").collect()
    return [tuple(r) for r in rows]


def stratified_split(
    df: DataFrame, key: Sequence[str], stratum: str, test: float = 0.05, validation: float = 0.15,
    seed: int = 75, name: str = "part",
) -> DataFrame:
    """Label each row `test`, `validation` or `train` with exact quotas per stratum.

    Rows are taken in the order of a seeded hash of their key, which has to identify a row, so the
    outcome does not depend on partitioning. Nothing is sorted or shuffled as a whole: hash prefixes
    are counted per stratum, longer ones in every pass, until the prefix where a quota ends holds few
    rows; only these are ranked, and every row is then compared with the end points of its stratum.
    """
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_column(k).cast("string") for k in key]))
    placed = df.withColumn("_hash", place)
    strata = materialize(placed.select(as_column(stratum).alias("_stratum"), "_hash"), "strata")
    # Strata are classes or bins: one row each, and a stop if they are not.
    found = strata.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n")).limit(MOST_STRATA + 1).collect()
    if len(found) > MOST_STRATA:
        raise ValueError(f"{stratum} has more than {MOST_STRATA} values; strata are classes or bins")
    counts = {r["_stratum"]: r["n"] for r in found}
    quotas = split_quotas(counts, test, validation)
    spark = df.sparkSession
    kind = df.schema[stratum].dataType.simpleString()
    schema = f"_stratum {kind}, _cut string, _prefix string, _nth bigint, _n bigint"
    ends = [
        (s, cut, "", upto, counts[s]) for s, (t, v) in quotas.items() for cut, upto in (("_t", t), ("_v", t + v)) if upto
    ]
    while any(end[4] > CELL_ROWS for end in ends) and len(ends[0][2]) < 32:
        ends = _narrowed(strata, spark.createDataFrame(ends, schema))
    in_cell = Window.partitionBy("_stratum", "_cut").orderBy("_hash")
    borders = (
        _in_cells(strata, spark.createDataFrame(ends, schema) if ends else spark.createDataFrame([], schema))
        .withColumn("_row", F.row_number().over(in_cell))
        .filter("_row = _nth")
        .select("_stratum", "_cut", "_hash")
        .collect()  # two end points per stratum
    )
    points = {(r["_stratum"], r["_cut"]): r["_hash"] for r in borders}
    limits = spark.createDataFrame(
        [(s, points.get((s, "_t"), ""), points.get((s, "_v"), "")) for s in counts],
        f"_stratum {kind}, _test string, _validation string",
    )
    part = (
        F.when(F.col("_hash") <= F.col("_test"), "test")
        .when(F.col("_hash") <= F.col("_validation"), "validation")
        .otherwise("train")
    )
    return (
        placed.join(F.broadcast(limits), as_column(stratum).eqNullSafe(F.col("_stratum")), "left")
        .withColumn(name, part)
        .drop("_hash", "_stratum", "_test", "_validation")
    )
