"""Clustering of rows with numeric and categorical columns (k-prototypes), and the segments it gives.

Distance of a row to a prototype: squared numeric distance plus gamma times the number of
categorical mismatches. The driver keeps k prototypes. In a pass every task adds up its own rows, as arrays, for
all runs at once; sums and label counts are merged in a shuffle, and at most k rows per categorical column come back.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.functions import as_column, label_name
from weekloom.operators.aggregates import segment_key_share, segment_profile
from weekloom.operators.scalers import Scaler, fit_minmax
from weekloom.operators.sets import overlap_resolve
from weekloom.session import materialize


@dataclass(frozen=True)
class Prototypes:
    """Centers of clusters. `cost` is that of these centers; `converged` says that another pass would not
    move them."""

    numeric: list[str]
    categorical: list[str]
    gamma: float
    centers: list[tuple[tuple, tuple]]  # (numeric values, categorical values) per cluster
    cost: float | None = None
    iterations: int = 0
    converged: bool = False

    def nearest(self) -> Column:
        """Distance and number of the nearest center, the lowest number on ties. The centers are one
        literal, so neither the plan nor its compiled code changes with them."""
        values = [
            F.struct(
                *[F.lit(float(v)).alias(f"n{i}") for i, v in enumerate(numbers)],
                *[F.lit(v).cast("string").alias(f"l{i}") for i, v in enumerate(labels)],
            )
            for numbers, labels in self.centers
        ]

        def distance(center: Column, number: Column) -> Column:
            d = F.lit(0.0)
            for i, c in enumerate(self.numeric):
                gap = as_column(c) - center[f"n{i}"]
                d = d + gap * gap
            for i, c in enumerate(self.categorical):
                same = as_column(c).cast("string").eqNullSafe(center[f"l{i}"])
                d = d + F.when(same, 0.0).otherwise(self.gamma)
            return F.struct(d.alias("distance"), number.alias("cluster"))

        return F.array_min(F.transform(F.array(*values), distance))

    def assign(self, df: DataFrame, cluster: str = "cluster", distance: str | None = None) -> DataFrame:
        """Nearest prototype of each row. A row-local expression."""
        near = df.withColumn("_near", self.nearest()).withColumn(cluster, F.col("_near.cluster"))
        if distance:
            near = near.withColumn(distance, F.col("_near.distance"))
        return near.drop("_near")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, c, float(v), None)
            for i, (numbers, _) in enumerate(self.centers)
            for c, v in zip(self.numeric, numbers)
        ] + [
            (i, c, None, v)
            for i, (_, labels) in enumerate(self.centers)
            for c, v in zip(self.categorical, labels)
        ]
        return spark.createDataFrame(rows, "cluster int, feature string, value double, label string")


def mixed_gamma(df: DataFrame, numeric: Sequence[str]) -> float:
    """Half the mean population deviation of the numeric columns."""
    if not numeric:
        return 1.0
    row = df.agg(*[F.stddev_pop(as_column(c)).alias(f"s{i}") for i, c in enumerate(numeric)]).first()
    return 0.5 * sum(v or 0.0 for v in row) / len(numeric)


def _center(values, n: int) -> tuple[tuple, tuple]:
    return tuple(float(v) for v in values[:n]), tuple(values[n:])


def _far_seeds(data: DataFrame, start: Prototypes, k: int, seed: int) -> list[tuple[tuple, tuple]]:
    """The row with the least seeded hash, then again and again the row farthest from all seeds."""
    columns = [as_column(c) for c in [*start.numeric, *start.categorical]]
    row = F.struct(*columns)
    order = F.xxhash64(F.lit(seed), *columns)
    n = len(start.numeric)
    seeds = [_center(data.agg(F.min_by(row, F.struct(order, row)).alias("r")).first()["r"], n)]
    while len(seeds) < k:
        far = replace(start, centers=seeds).nearest()["distance"]
        seeds.append(_center(data.agg(F.max_by(row, F.struct(far, order, row)).alias("r")).first()["r"], n))
    return seeds


def _random_seeds(data: DataFrame, start: Prototypes, k: int, seed: int) -> list[tuple[tuple, tuple]]:
    """The k different rows with the least seeded hashes."""
    columns = [as_column(c) for c in [*start.numeric, *start.categorical]]
    rows = data.select(*columns).distinct().orderBy(F.xxhash64(F.lit(seed), *columns), *columns).limit(k).collect()
    return [_center(rows[i % len(rows)], len(start.numeric)) for i in range(k)]


def _huang_seeds(data: DataFrame, start: Prototypes, k: int, seed: int) -> list[tuple[tuple, tuple]]:
    """Labels drawn by how frequent they are, numbers from the normal distribution of their column, and each
    such point moved to the row nearest to it that no other point has."""
    n, m = len(start.numeric), len(start.categorical)
    spread = data.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(as_column(c)).alias(f"m{i}") for i, c in enumerate(start.numeric)],
        *[F.stddev_pop(as_column(c)).alias(f"s{i}") for i, c in enumerate(start.numeric)],
    ).first()
    draw = random.Random(seed)
    numbers = [tuple(draw.gauss(spread[f"m{i}"] or 0.0, spread[f"s{i}"] or 0.0) for i in range(n)) for _ in range(k)]
    labels: list[list] = []
    for j, c in enumerate(start.categorical):
        # The least of exponential waiting times whose rates are the counts: drawn in proportion to them.
        unit = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(j), F.lit(i), as_column(c)), F.lit(1 << 52)) + 0.5) / float(1 << 52) for i in range(k)]
        counted = data.groupBy(as_column(c)).agg(F.count(F.lit(1)).alias("_n"))
        first = [F.min_by(as_column(c), F.struct(-F.log(u) / F.col("_n"), as_column(c))).alias(f"l{i}") for i, u in enumerate(unit)]
        labels.append(list(counted.agg(*first).first()))
    drawn = [(numbers[i], tuple(labels[j][i] for j in range(m))) for i in range(k)]

    columns = [as_column(c) for c in [*start.numeric, *start.categorical]]
    row, order = F.struct(*columns), F.xxhash64(F.lit(seed), *columns)
    seeds: dict[int, tuple[tuple, tuple]] = {}
    while len(seeds) < k:
        taken = [_same_row(start, center) for center in seeds.values()]
        left = data.filter(~_any_of(taken)) if taken else data
        open_ = [i for i in range(k) if i not in seeds]
        near = [replace(start, centers=[drawn[i]]).nearest()["distance"] for i in open_]
        found = left.agg(*[F.min_by(row, F.struct(d, order, row)).alias(f"r{i}") for i, d in zip(open_, near)]).first()
        for i in open_:
            if found[f"r{i}"] is None:  # fewer different rows than clusters
                seeds[i] = next(iter(seeds.values()), drawn[i])
            elif (center := _center(found[f"r{i}"], n)) not in seeds.values():
                seeds[i] = center
    return [seeds[i] for i in range(k)]


def _any_of(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _same_row(start: Prototypes, center: tuple[tuple, tuple]) -> Column:
    same = F.lit(True)
    for c, value in zip([*start.numeric, *start.categorical], [*center[0], *center[1]], strict=True):
        same = same & as_column(c).eqNullSafe(F.lit(value))
    return same


#: Rounds of the oversampling, and rows drawn in each for every cluster, on average.
_ROUNDS, _OVERSAMPLE = 5, 2


def _parallel_seeds(data: DataFrame, start: Prototypes, k: int, seed: int) -> list[tuple[tuple, tuple]]:
    """Rows drawn with chances in proportion to their distances from those drawn before, several at once and in
    a few rounds, then the k of them that stand for most rows and lie far apart."""
    columns = [as_column(c) for c in [*start.numeric, *start.categorical]]
    n, row = len(start.numeric), F.struct(*columns)
    order = F.xxhash64(F.lit(seed), *columns)
    seeds = [_center(data.agg(F.min_by(row, F.struct(order, row)).alias("r")).first()["r"], n)]
    for round_ in range(_ROUNDS):
        far = replace(start, centers=seeds).nearest()["distance"]
        cost = data.agg(F.sum(far)).first()[0]
        if not cost:
            break
        # By a hash of the row's values: the same draws however rows are dealt, and equal rows are drawn as one.
        unit = F.pmod(F.xxhash64(F.lit(seed), F.lit(round_), *columns), F.lit(1 << 52)) / float(1 << 52)
        chosen = data.filter(unit < far * float(_OVERSAMPLE * k / cost)).select(*columns).distinct()
        # No more than 2 k rows on average, since the chances of all rows add up to that.
        seeds += sorted((_center(r, n) for r in chosen.collect()), key=repr)
    weights = {r["c"]: r["n"] for r in data.groupBy(replace(start, centers=seeds).nearest()["cluster"].alias("c")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    weight = np.array([weights.get(i, 0) for i in range(len(seeds))], float)
    apart = np.array([[_distance(start, a, b) for b in seeds] for a in seeds])
    picked = [int(weight.argmax())]
    while len(picked) < min(k, len(seeds)):
        gain = weight * apart[picked].min(axis=0)
        gain[picked] = -1
        picked.append(int(gain.argmax()))
    return [seeds[picked[i % len(picked)]] for i in range(k)]


def _distance(start: Prototypes, a: tuple[tuple, tuple], b: tuple[tuple, tuple]) -> float:
    numbers = sum((x - y) ** 2 for x, y in zip(a[0], b[0], strict=True))
    return numbers + start.gamma * sum(x != y for x, y in zip(a[1], b[1], strict=True))


#: Labels that a task counts, over all runs and clusters, before it hands the counts on.
_COUNTED = 1 << 17
_ADDED = "run int, cluster int, j int, label string, n bigint, cost double, sums array<double>"


def _adder(runs: list[Prototypes]) -> Callable:
    """For mapInArrow over the numeric and then the categorical columns: what the task's rows add to every cluster
    of every run. A row with j = -1 has the rows, the distances and the sums of a cluster; one with j >= 0 has how
    often it has a label in column j."""
    numeric, categorical, gamma = len(runs[0].numeric), len(runs[0].categorical), [run.gamma for run in runs]
    centers = [run.centers for run in runs]

    def counted(labels: dict[tuple[int, int, int, str | None], int]) -> pa.RecordBatch:
        keys = list(labels)
        columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
        columns += [pa.array([k[3] for k in keys], pa.string()), pa.array(labels.values(), pa.int64())]
        none = [pa.nulls(len(keys), pa.float64()), pa.nulls(len(keys), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([*columns, *none], names=_NAMES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), numeric)) for c in centers]
        sizes = [np.zeros(len(c), np.int64) for c in centers]
        costs = [np.zeros(len(c)) for c in centers]
        labels: dict[tuple[int, int, int, str | None], int] = {}
        for batch in batches:
            x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(numeric)]
            coded = [batch.column(numeric + j).dictionary_encode(null_encoding="encode") for j in range(categorical)]
            names = [c.dictionary.to_pylist() for c in coded]
            numbers_of = [{label: i for i, label in enumerate(known)} for known in names]
            codes = [c.indices.to_numpy(zero_copy_only=False) for c in coded]
            for i, of_run in enumerate(centers):
                far = np.empty((len(of_run), batch.num_rows))
                for k, (numbers, wanted) in enumerate(of_run):
                    d = np.zeros(batch.num_rows)
                    for column, center in zip(x, numbers, strict=True):
                        gap = column - center
                        d += gap * gap
                    for code, number, label in zip(codes, numbers_of, wanted, strict=True):
                        d += np.where(code == number.get(label, -1), 0.0, gamma[i])
                    far[k] = d
                near = far.argmin(axis=0)
                size = len(of_run)
                sizes[i] += np.bincount(near, minlength=size)
                costs[i] += np.bincount(near, far[near, np.arange(len(near))], minlength=size)
                for c, column in enumerate(x):
                    sums[i][:, c] += np.bincount(near, column, minlength=size)
                for j, (code, known) in enumerate(zip(codes, names, strict=True)):
                    count = np.bincount(near * len(known) + code, minlength=size * len(known))
                    for at in np.flatnonzero(count).tolist():
                        key = (i, at // len(known), j, known[at % len(known)])
                        labels[key] = labels.get(key, 0) + int(count[at])
            if len(labels) > _COUNTED:
                yield counted(labels)
                labels = {}
        if labels:
            yield counted(labels)
        at = [(i, k) for i, size in enumerate(sizes) for k in np.flatnonzero(size).tolist()]
        columns = [pa.array([x[0] for x in at], pa.int32()), pa.array([x[1] for x in at], pa.int32())]
        columns += [pa.array([-1] * len(at), pa.int32()), pa.nulls(len(at), pa.string())]
        columns += [pa.array([int(sizes[i][k]) for i, k in at], pa.int64()), pa.array([float(costs[i][k]) for i, k in at], pa.float64())]
        columns += [pa.array([sums[i][k].tolist() for i, k in at], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return run


_NAMES = ["run", "cluster", "j", "label", "n", "cost", "sums"]


def _pass(data: DataFrame, runs: list[Prototypes]) -> list[tuple[list[tuple[tuple, tuple]], float]]:
    """For each run, assign every row and compute the next prototypes (means, and the most frequent label,
    lowest on ties) and the cost of the present ones. All runs share the pass over the data."""
    numeric, categorical = runs[0].numeric, runs[0].categorical
    added = data.select(*[as_column(c) for c in [*numeric, *categorical]]).mapInArrow(_adder(runs), _ADDED)
    counted = added.groupBy("run", "cluster", "j", "label").agg(
        F.sum("n").alias("n"),
        F.sum("cost").alias("cost"),
        *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(len(numeric))],
    )
    rows = (
        counted.groupBy("run", "cluster", "j")
        .agg(
            F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"),
            F.sum("n").alias("n"),
            F.sum("cost").alias("cost"),
            *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(numeric))],
        )
        .collect()  # for each cluster a row, and one per categorical column
    )
    found = {(r["run"], r["cluster"], r["j"]): r for r in rows}
    out = []
    for number, run in enumerate(runs):
        centers, cost = [], 0.0
        for cluster, old in enumerate(run.centers):
            r = found.get((number, cluster, -1))
            if r is None:  # nobody chose it: it stays where it is
                centers.append(old)
                continue
            cost += r["cost"]
            # Rounded, so that the order in which partitions are summed does not show.
            means = tuple(round(r[f"s{i}"] / r["n"], 9) for i in range(len(numeric)))
            modes = tuple(found[number, cluster, j]["label"] for j in range(len(categorical)))
            centers.append((means, modes))
        out.append((centers, cost))
    return out


def _fit_all(data: DataFrame, runs: list[Prototypes], max_passes: int, tolerance: float) -> list[Prototypes]:
    """Move the centers of all runs until each has settled, then find the cost of those that were stopped."""
    open_ = list(range(len(runs)))
    for _ in range(max_passes):
        moved = _pass(data, [runs[i] for i in open_])
        going = []
        for i, (centers, cost) in zip(open_, moved, strict=True):
            run = runs[i]
            converged = centers == run.centers
            slow = run.cost is not None and run.cost - cost <= tolerance * cost and tolerance > 0
            runs[i] = replace(run, centers=centers, cost=cost, iterations=run.iterations + 1, converged=converged)
            if not converged and not slow:
                going.append(i)
        open_ = going
        if not open_:
            break
    stopped = [i for i, run in enumerate(runs) if not run.converged]
    if stopped:
        for i, (_, cost) in zip(stopped, _pass(data, [runs[i] for i in stopped]), strict=True):
            runs[i] = replace(runs[i], cost=cost)
    return [replace(run, centers=sorted(run.centers, key=lambda c: (c[0], c[1]))) for run in runs]


def _starts(
    data: DataFrame, numeric: Sequence[str], categorical: Sequence[str], k: int, gamma: float, seed: int, starts: int,
    init: str,
) -> list[Prototypes]:
    """`far`: one start from rows far apart, the others from rows picked by seeded hashes. `huang` and `parallel`:
    all starts by that way of seeding."""
    bare = Prototypes(list(numeric), list(categorical), gamma, [])
    if init == "far":
        centers = [_far_seeds(data, bare, k, seed)] + [_random_seeds(data, bare, k, seed + i) for i in range(1, starts)]
    else:
        seeding = {"huang": _huang_seeds, "parallel": _parallel_seeds}[init]
        centers = [seeding(data, bare, k, seed + i) for i in range(starts)]
    return [replace(bare, centers=c) for c in centers]


def _best(runs: Sequence[Prototypes]) -> Prototypes:
    return min(runs, key=lambda run: (run.cost, run.centers))


def _measures(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """The needed columns, written once to the shared folder."""
    return materialize(
        df.select(
            *[as_column(c).cast("double").alias(c) for c in numeric],
            *[as_column(c).cast("string").alias(c) for c in categorical],
        ),
        "prototypes",
    )


def kprototypes_fit(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], k: int = 2,
    gamma: float | None = None, seed: int = 0, max_passes: int = 100, tolerance: float = 0.0,
    start: Sequence[tuple[tuple, tuple]] | None = None, starts: int = 3, init: str = "far",
) -> Prototypes:
    """Prototypes of k clusters, numbered by their first numeric value. Numbers must not be null.

    Starts from `start`, or from `starts` sets of rows, and keeps the cheapest outcome; the runs share their passes
    over the data. `init` says how rows to start from are found: `far` (one set of rows far apart, the others by
    hash), `huang` (labels drawn by frequency, numbers from the spread of their column, each moved to its nearest
    row) or `parallel` (rows drawn by distance, many at once, in a few rounds). A seed gives the same rows however
    they are partitioned. A run ends when a pass changes nothing, or lowers the cost by no more than `tolerance`
    of it; `converged` says which.
    """
    data = _measures(df, numeric, categorical)
    gamma = mixed_gamma(data, numeric) if gamma is None else gamma
    if start:
        runs = [Prototypes(list(numeric), list(categorical), gamma, list(start))]
    else:
        runs = _starts(data, numeric, categorical, k, gamma, seed, starts, init)
    return _best(_fit_all(data, runs, max_passes, tolerance))


def elbow_curve(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], ks: Sequence[int] = range(1, 10),
    seed: int = 0, max_passes: int = 100, tolerance: float = 0.0, starts: int = 3, init: str = "far",
    gamma: float | None = None, start: Mapping[int, Sequence[tuple[tuple, tuple]]] | None = None,
) -> DataFrame:
    """Cost for each number of clusters, and whether its fit converged; all numbers share their passes.

    `start` has prototypes to start from by number of clusters; numbers that it lacks start as in `kprototypes_fit`.
    """
    data = _measures(df, numeric, categorical)
    gamma = mixed_gamma(data, numeric) if gamma is None else gamma
    runs = []
    for k in ks:
        if start and k in start:
            runs.append(Prototypes(list(numeric), list(categorical), gamma, list(start[k])))
        else:
            runs += _starts(data, numeric, categorical, k, gamma, seed, starts, init)
    fitted = _fit_all(data, runs, max_passes, tolerance)
    best = [_best([run for run in fitted if len(run.centers) == k]) for k in ks]
    rows = [(k, float(run.cost), run.converged) for k, run in zip(ks, best, strict=True)]
    return df.sparkSession.createDataFrame(rows, "k int, cost double, converged boolean")


@dataclass(frozen=True)
class Segments:
    rows: DataFrame
    prototypes: Prototypes
    scaler: Scaler

    def profile(self, key: str) -> DataFrame:
        return segment_profile(self.rows, "segment", key, self.prototypes.numeric)

    def key_share(self, key: str) -> DataFrame:
        return segment_key_share(self.rows, "segment", key)


# Segment names by cluster number, in order of priority: fixed values.
SEGMENT_NAMES: Mapping[int, str] = {0: "First", 1: "Second", 2: "Third", 3: "Fourth"}


def cluster_segments(
    df: DataFrame, key: str, numeric: Sequence[str], k: int = 2, seed: int = 0, max_passes: int = 100,
    tolerance: float = 0.0, start: Sequence[tuple[tuple, tuple]] | None = None, gamma: float | None = None,
    init: str = "far",
) -> Segments:
    """Scale to 0..1, cluster on the measures and the key, name the clusters, give each key to one
    segment, and scale back."""
    scaler = fit_minmax(df, numeric, 0.0, 1.0)
    scaled = scaler.transform(df)
    prototypes = kprototypes_fit(
        scaled, numeric, [key], k, gamma, seed, max_passes, tolerance, start, init=init
    )
    names = {i: SEGMENT_NAMES.get(i, f"Segment {i + 1}") for i in range(k)}
    named = prototypes.assign(scaled).withColumn("segment", label_name("cluster", names))
    resolved = overlap_resolve(named, "segment", key, list(names.values()))
    return Segments(scaler.inverse(resolved), prototypes, scaler)
