import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weekloom.operators import encoders, scalers, weights
from weekloom.operators.aggregates import value_counts


def test_short_dictionaries_take_no_join(frame):
    """Columns of few labels are looked up in one projection, one of many by a join, with the same codes."""
    rows = [(f"a{i % 3}", i % 60, f"label{i}") for i in range(200)] + [(None, None, None)]
    df = frame(rows, "a string, b int, many string")
    fitted = encoders.fit_encoder(df, ["a", "b", "many"])
    short = fitted.transform(df, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in short and "Generate" not in short
    assert fitted.transform(df)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    codes = {(r.a, r.b, r.many): (r.a_code, r.b_code, r.many_code) for r in fitted.transform(df).collect()}
    order = sorted(f"label{i}" for i in range(200))
    assert codes == {(a, b, m): (a and int(a[1]), b, m and order.index(m)) for a, b, m in rows}
    new = fitted.transform(frame([("z", 99, "z"), (None, None, None)], "a string, b int, many string"), ["a", "b", "many"], reserve=True)
    assert [tuple(r)[3:] for r in new.collect()] == [(3, 60, 200)] * 2


def test_cardinality_expands_no_row(frame):
    from weekloom.operators.aggregates import cardinality

    df = frame([(i % 7, f"s{i % 11}", None if i % 5 == 0 else i % 3, None) for i in range(300)], "a int, b string, c int, d int")
    counted = cardinality(df, ["a", "b", "c", "d"])
    assert "Expand" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert {r["column"]: r.distinct for r in counted.collect()} == {"a": 7, "b": 11, "c": 4, "d": 1}
    assert {r["column"]: r.distinct for r in cardinality(df.limit(0), ["a", "d"]).collect()} == {"a": 0, "d": 0}


def test_encode_numbers_in_numeric_order(frame):
    df = frame([(9, 2.5, "b"), (10, 10.0, "a"), (11, 2.5, None)], "week int, x double, s string")
    rows = encoders.fit_encoder(df, ["week", "x", "s"]).transform(df).orderBy("week").collect()
    assert [(r.week_code, r.x_code, r.s_code) for r in rows] == [(0, 0, 1), (1, 1, 0), (2, 0, None)]


def test_unseen_labels(frame, tmp_path, spark):
    known = frame([(f"k{i:03d}",) for i in range(200)] + [("hot",)] * 300, "s string")
    fitted = encoders.fit_encoder(known, ["s"])
    fitted.save(str(tmp_path / "dictionary"))
    loaded = encoders.Encoder.load(spark, str(tmp_path / "dictionary"))
    assert loaded.entries == {"s": 201}
    new = frame([("k005",), ("hot",), ("new",), ("k199",)], "s string")
    assert {r.s: r.s_code for r in loaded.transform(new).collect()} == {"hot": 0, "k005": 6, "k199": 200, "new": None}
    assert {r.s: r.s_code for r in loaded.transform(new, reserve=True).collect()}["new"] == 201


def test_embedding_sizes(frame):
    df = frame([(str(i), i % 2, None if i else "x") for i in range(60)], "a string, t int, b string")
    got = {r["column"]: (r["distinct"], r["size"]) for r in encoders.embedding_sizes(df, ["a", "b"], ["t"]).collect()}
    assert got == {"a": (60, 50), "b": (2, 4), "t": (2, 3)}


def test_minmax_constant_column_goes_low(frame):
    df = frame([(5.0, 1.0), (5.0, 3.0)], "c double, x double")
    scaled = scalers.fit_minmax(df, ["c", "x"]).transform(df).orderBy("x").collect()
    assert [(r.c, r.x) for r in scaled] == [(1.0, 1.0), (1.0, 2.0)]


@pytest.mark.parametrize("kind", ["minmax", "standard", "robust"])
def test_scale_and_back(frame, spark, tmp_path, kind):
    x = [1.0, 2.0, 4.0, 8.0, 16.0]
    df = frame([(v,) for v in x], "x double")
    scaler = scalers.fit_scaler(df, ["x"], kind)
    scaler.save(spark, str(tmp_path / kind))
    loaded = scalers.Scaler.load(spark, str(tmp_path / kind))
    back = loaded.inverse(loaded.transform(df)).orderBy("x").collect()
    assert [r.x for r in back] == pytest.approx(x)


def test_standard_uses_population_deviation(frame):
    df = frame([(1.0,), (3.0,)], "x double")
    assert sorted(r.x for r in scalers.fit_standard(df, ["x"]).transform(df).collect()) == [-1.0, 1.0]


def test_robust(frame):
    df = frame([(float(i),) for i in range(11)], "x double")
    got = sorted(r.x for r in scalers.fit_robust(df, ["x"]).transform(df).collect())
    assert got == pytest.approx([(i - 5) / 8 for i in range(11)])


def labelled(frame, counts):
    return frame([(k,) for k, n in counts.items() for _ in range(n)], "label string")


def test_sample_weights(frame):
    got = {r.label: r.weight for r in weights.sample_weights(labelled(frame, {"a": 5, "b": 3, "c": 2}), "label").collect()}
    assert got == pytest.approx({"a": 0.8, "b": 0.8 + 0.4 / 3, "c": 1.2})


def test_class_weights_and_lookup(frame):
    df = labelled(frame, {"a": 5, "b": 3, "c": 2})
    table = weights.class_weights(df, "label")
    assert {r.label: r.weight for r in table.collect()} == pytest.approx({"a": 0.2, "b": 0.3, "c": 0.5})
    rows = weights.add_weights(df, table, "label").collect()
    assert Counter((r.label, round(r.weight, 6)) for r in rows) == {("a", 0.2): 5, ("b", 0.3): 3, ("c", 0.5): 2}


def test_single_label_weights(frame):
    assert [r.weight for r in weights.sample_weights(labelled(frame, {"a": 5}), "label").collect()] == [0.8]


def test_value_counts_ignores_nulls(frame):
    got = value_counts(frame([("a",), ("a",), ("b",), (None,)], "x string"), "x").collect()
    assert sorted((r.x, r.n, r.share) for r in got) == [("a", 2, 2 / 3), ("b", 1, 1 / 3)]


def test_quantile_bins(frame):
    df = frame([(float(i),) for i in range(1, 6)], "x double")
    assert [r.bin for r in weights.quantile_bins(df, "x").orderBy("x").collect()] == [0, 0, 1, 2, 3]


def test_quantile_bins_duplicate_edges(frame):
    df = frame([(1.0,), (1.0,), (1.0,), (3.0,)], "x double")
    with pytest.raises(ValueError, match="not distinct"):
        weights.quantile_bins(df, "x")
    assert len(weights.quantile_bins(df, "x", duplicates="drop").collect()) == 4


def parts(df, **options):
    return {r.id: r.part for r in weights.stratified_split(df, ["id"], "s", **options).collect()}


def test_split_is_exact_complete_and_stable(frame):
    counts = {"a": 333, "b": 101, "c": 7}
    rows = [(f"{s}{i}", s) for s, n in counts.items() for i in range(n)]
    df = frame(rows, "id string, s string")
    got = parts(df)
    assert len(got) == len(rows)
    quota = weights.split_quotas(counts, 0.05, 0.15)
    total = Counter(got.values())
    assert total["test"] == math.ceil(0.05 * len(rows))
    assert total["validation"] == math.ceil(0.15 * (len(rows) - total["test"]))
    for s, (test, validation) in quota.items():
        mine = Counter(p for i, p in got.items() if i[0] == s)
        assert (mine["test"], mine["validation"]) == (test, validation)
        assert abs(test - total["test"] * counts[s] / len(rows)) < 1
    assert parts(df.repartition(7)) == got
    assert parts(df.orderBy(F.desc("id"))) == got
    assert parts(df, seed=76) != got


def test_split_with_a_null_stratum(frame):
    df = frame([(i, None if i % 2 else "x") for i in range(100)], "id int, s string")
    got = Counter(parts(df, test=0.1, validation=0.2).values())
    assert got == {"test": 10, "validation": 18, "train": 72}


def test_quotas_sum_up():
    quota = weights.split_quotas({"a": 1, "b": 1, "c": 998}, 0.05, 0.2)
    assert sum(t for t, _ in quota.values()) == 50
    assert sum(v for _, v in quota.values()) == 190


def test_split_does_not_depend_on_the_cells(frame, monkeypatch):
    df = frame([(i, "a" if i % 3 else "b") for i in range(2000)], "id int, c string")
    whole = {r.id: r.part for r in weights.stratified_split(df, ["id"], "c").collect()}
    monkeypatch.setattr(weights, "CELL_ROWS", 1)
    monkeypatch.setattr(weights, "_DIGITS", 1)
    assert {r.id: r.part for r in weights.stratified_split(df, ["id"], "c").collect()} == whole


def test_split_says_what_it_cannot_do(frame, monkeypatch):
    with pytest.raises(ValueError, match="too few"):
        weights.stratified_split(frame([(1, "a")], "id int, c string"), ["id"], "c")
    monkeypatch.setattr(weights, "MOST_STRATA", 5)
    with pytest.raises(ValueError, match="more than 5"):
        weights.stratified_split(frame([(i, str(i)) for i in range(50)], "id int, c string"), ["id"], "c")


def test_loans_score_new_rows_with_saved_parameters(spark, frame, tmp_path):
    from weekloom.plans import loans

    rows = frame([(i, "x" if i % 2 else "y", float(i % 7), "n" if i % 3 else "p") for i in range(300)], "id int, k string, v double, t string")
    fitted = loans.loan_features(rows, ["id"], ["k"], [], ["v"], "t")
    fitted.save(str(tmp_path / "loans"))
    models = loans.loan_classification(fitted, ["id"])
    new = frame([(1000, "x", 3.0), (1001, "z", 6.0)], "id int, k string, v double")
    loaded = loans.NewLoans.load(spark, str(tmp_path / "loans"))
    scored = {r.id: r for r in loaded.score(new, ["k"], models.final.model, ["id", "k_code", "v"]).collect()}
    assert (scored[1000].k_code, scored[1000].v) == (0, 2.0) and (scored[1001].k_code, scored[1001].v) == (2, 3.0)
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in scored.values())


def test_loans_need_every_class_in_training(frame):
    from weekloom.plans import loans

    rows = frame([(i, "x", 1.0, "rare" if i == 0 else "often") for i in range(40)], "id int, k string, v double, t string")
    try:
        parts = {r.id: r.part for r in weights.stratified_split(rows, ["id"], "t", test=0.05, validation=0.2).collect()}
        loans.loan_features(rows, ["id"], ["k"], [], ["v"], "t")
        assert parts[0] == "train"
    except ValueError as error:
        assert "rare" in str(error) and parts[0] != "train"
