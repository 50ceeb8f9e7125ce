import numpy as np
import pytest

from weekloom.operators import joins, ordered, sets, shares


@pytest.mark.parametrize("direct", [1, 16384])
@pytest.mark.parametrize("kind", ["uniform", "ties", "constant", "two", "skewed", "close", "wide", "signs"])
def test_exact_quantiles(frame, kind, direct):
    rng = np.random.default_rng(1)
    x = {
        "uniform": rng.uniform(-5, 5, 3000),
        "ties": np.concatenate([np.full(1000, 2.0), rng.uniform(0, 4, 2000)]),
        "constant": np.full(50, 3.0),
        "two": np.array([1.0, 2.0]),
        "skewed": np.exp(rng.normal(0, 3, 2500)),
        "close": 1 + rng.integers(0, 3000, 3000) * 2.0**-52,  # neighbouring doubles
        "wide": np.r_[5e-324, 1e-310, 2.0 ** rng.integers(-1000, 1000, 2000), 1.7e308],
        "signs": np.r_[-rng.uniform(0, 1, 800), 0.0, -0.0, 0.0, np.exp(rng.normal(0, 40, 900)), -1e300],
    }[kind]
    probabilities = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]
    df = frame([(float(v), None) for v in x], "x double, empty double")
    got = ordered.exact_quantiles(df, ["x", "empty"], probabilities, exact=direct)
    assert got["x"] == pytest.approx(list(np.quantile(x, probabilities)), rel=1e-12)
    assert got["empty"] == [None] * 7


def test_exact_quantiles_of_infinite_values(frame):
    inf = float("inf")
    df = frame([(v,) for v in (-inf, -inf, -1.0, 0.0, 2.0, inf, inf, float("nan"), None)], "x double")
    assert ordered.exact_quantiles(df, ["x"], [0, 1 / 6, 0.5, 4 / 6, 1])["x"] == [-inf, -inf, 0.0, 2.0, inf]


@pytest.mark.parametrize("runs", [None, 7])
def test_running_total_and_numbers(frame, runs):
    rng = np.random.default_rng(2)
    rows = [(int(v), i) for i, v in enumerate(rng.integers(0, 5, 500))]  # many equal values
    df = frame(rows, "v int, id int")
    got = ordered.running_total(df, ["v", "id"], "v", "total", runs).orderBy("v", "id").collect()
    assert [r.total for r in got] == list(np.cumsum(sorted(v for v, _ in rows)))
    numbers = ordered.numbered(df, ["v", "id"], "n", runs).orderBy("v", "id").collect()
    assert [r.n for r in numbers] == list(range(1, 501))


def test_cumulative_share_cut(frame):
    rows = [("a", 1.0, 1.0), ("b", 1.0, 4.0), ("c", 1.0, 5.0), ("d", 1.0, 90.0)]
    kept = shares.cumulative_share_cut(frame(rows, "k string, p double, q double"), ["k"], "p", "q", 0.05)
    assert sorted(r.k for r in kept.collect()) == ["b", "c", "d"]


def test_sums_do_not_depend_on_partitions(frame):
    """Values whose plain sums differ from order to order; exact to the last bit here."""
    import math

    from weekloom.operators.sums import steady_sum

    rng = np.random.default_rng(4)
    values = [*(rng.normal(0, 1, 3000) * 10.0 ** rng.integers(-12, 9, 3000)).tolist(), 0.0, -0.0]
    df = frame([(i, i % 3, float(v)) for i, v in enumerate(values)], "id int, k int, v double")
    seen = set()
    for n in (1, 7, 211):
        dealt = df.repartition(n)
        rows = dealt.groupBy("k").agg(steady_sum(dealt, dealt["v"]).alias("s")).orderBy("k").collect()
        total = ordered.running_total(dealt, ["id"], "v", "total", n).orderBy("id").collect()
        seen.add((*[r.s for r in rows], *[r.total for r in total]))
    assert len(seen) == 1
    got = seen.pop()
    assert got[:3] == pytest.approx([math.fsum(values[k::3]) for k in range(3)], rel=1e-15)
    assert got[-1] == pytest.approx(math.fsum(values), rel=1e-15)
    assert frame([], "v double").agg(steady_sum(frame([], "v double"), ordered.as_column("v"))).first()[0] is None


def test_a_share_that_meets_the_threshold_is_kept_wherever_runs_end(spark, frame):
    """Two thousand equal combinations: the hundredth makes up 5 % exactly."""
    rows = [(f"k{i:04}", 0.1 * j, 0.3) for i in range(2000) for j in range(3)]
    df = frame(rows, "k string, p double, q double")
    before, kept = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for n in (1, 7, 61):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found = shares.cumulative_share_cut(df.repartition(n), ["k"], "p", "q", 0.05).collect()
            kept.add(tuple(sorted((r.k, r.sales_share, r.cum_share) for r in found)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(kept) == 1 and len(kept.pop()) in (1900, 1901)


def test_runs_are_written_once(spark, frame, monkeypatch):
    written = []
    monkeypatch.setattr(ordered, "materialize", lambda df, label: written.append(label) or df)
    ordered.cut_into_runs(frame([(1, 2)], "k int, d int"), ["k", "d"])
    assert written == ["runs"]


@pytest.mark.parametrize("hot", ["k1", "unknown", None])
def test_lookups_split_a_hot_key(spark, frame, hot):
    """A key that the table knows, one it doesn't and null: none leaves most rows to one task."""
    from pyspark.sql import functions as F

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, value in settings.items():
            spark.conf.set(k, value)
        key = F.when(F.col("id") % 10 > 0, F.lit(hot)).otherwise(F.concat(F.lit("k"), F.col("id") % 7))
        df = spark.range(0, 100_000, 1, 8).select(key.alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("wide"))
        table = frame([(f"k{i}", i) for i in range(7)], "k string, v int")
        joined = joins.join_left(df, table, ["k"]).withColumn("task", F.spark_partition_id())
        sizes = [r["n"] for r in joined.groupBy("task").agg(F.count("*").alias("n"), F.max("wide"), F.max("v")).collect()]
        assert sum(sizes) == 100_000 and max(sizes) < 25_000
        assert joins.keep_keys(df, table, ["k"]).count() == (100_000 if hot == "k1" else 10_000)
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def test_overlap_resolve(frame):
    rows = [("x", "First"), ("x", "Second"), ("y", "Second"), ("z", "Third"), ("z", "Second"), ("w", None)]
    df = frame(rows, "fsa string, segment string")
    got = sets.overlap_resolve(df, "segment", "fsa", ["First", "Second", "Third"]).collect()
    assert sorted((r.fsa, r.segment or "") for r in got) == [
        ("w", ""), ("x", "First"), ("x", "First"), ("y", "Second"), ("z", "Second"), ("z", "Second")]


def test_union_fills_missing_columns(frame):
    stacked = sets.union_vintages([frame([(1, 2)], "a int, b int"), frame([(3,)], "a int")])
    assert sorted((r.a, r.b) for r in stacked.collect() if r.b) == [(1, 2)]
    assert stacked.count() == 2
