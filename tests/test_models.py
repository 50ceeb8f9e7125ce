import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from weekloom.operators import aggregates, clustering, evaluation, learning
from weekloom.sources.models import load_model, save_model

NUMBERS = ["x", "y"]


@pytest.fixture
def blobs(frame):
    rng = np.random.default_rng(5)
    rows = [(*map(float, rng.normal(0, 0.1, 2)), "a", i) for i in range(60)]
    rows += [(*map(float, rng.normal(3, 0.1, 2)), "b", 60 + i) for i in range(40)]
    return frame(rows, "x double, y double, k string, id int")


def test_prototypes_find_the_blobs(blobs):
    fitted = clustering.kprototypes_fit(blobs, NUMBERS, ["k"], k=2)
    got = {r.id: r.cluster for r in fitted.assign(blobs).collect()}
    assert all(got[i] == (i >= 60) for i in got)
    assert [c[1] for c in fitted.centers] == [("a",), ("b",)]
    assert fitted.centers[0][0] < fitted.centers[1][0]


def test_every_row_is_at_its_nearest_prototype_and_cost_adds_up(blobs):
    fitted = clustering.kprototypes_fit(blobs, NUMBERS, ["k"], k=3)
    rows = fitted.assign(blobs, "c", "d").collect()

    def distance(row, center):
        numbers, labels = center
        return (row.x - numbers[0]) ** 2 + (row.y - numbers[1]) ** 2 + fitted.gamma * (row.k != labels[0])

    for row in rows:
        all_distances = [distance(row, c) for c in fitted.centers]
        assert row.d == pytest.approx(min(all_distances))
        assert row.c == all_distances.index(min(all_distances))
    assert fitted.cost == pytest.approx(sum(r.d for r in rows), rel=1e-6)


def test_prototypes_do_not_depend_on_partitioning(blobs):
    a = clustering.kprototypes_fit(blobs, NUMBERS, ["k"], k=3)
    b = clustering.kprototypes_fit(blobs.repartition(9), NUMBERS, ["k"], k=3)
    assert a.centers == b.centers


def test_elbow_cost_falls(blobs):
    costs = [r.cost for r in clustering.elbow_curve(blobs, NUMBERS, ["k"], [1, 2]).orderBy("k").collect()]
    assert costs[1] < costs[0]


def slow_pass(rows, centers, gamma):
    """Next prototypes and the cost of the present ones, row by row."""
    members = [[] for _ in centers]
    cost = 0.0
    for x, y, k, g in rows:
        far = [(x - n[0]) ** 2 + (y - n[1]) ** 2 + gamma * (k != c[0]) + gamma * (g != c[1]) for n, c in centers]
        members[far.index(min(far))].append((x, y, k, g))
        cost += min(far)
    moved = []
    for old, found in zip(centers, members):
        if not found:
            moved.append(old)
            continue
        means = tuple(round(sum(m[i] for m in found) / len(found), 9) for i in (0, 1))
        labels = tuple(max(sorted({m[i] for m in found}), key=[m[i] for m in found].count) for i in (2, 3))
        moved.append((means, labels))
    return moved, cost


def test_a_pass_against_brute_force(frame, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(float(rng.normal()), float(rng.normal()), f"k{rng.integers(0, 6)}", f"g{rng.integers(0, 3)}") for _ in range(400)]
    data = frame(rows, "x double, y double, k string, g string").repartition(5)
    runs = []
    for k in (1, 2, 5):
        centers = [((float(rng.normal()), float(rng.normal())), (f"k{i}", f"g{i % 4}")) for i in range(k)]
        runs.append(clustering.Prototypes(NUMBERS, ["k", "g"], 0.4, centers))
    runs.append(clustering.Prototypes(NUMBERS, ["k", "g"], 0.4, [((50.0, 50.0), ("k1", "g1")), ((0.0, 0.0), ("k1", "none"))]))
    for (centers, cost), run in zip(clustering._pass(data, runs), runs):
        expected, expected_cost = slow_pass(rows, run.centers, 0.4)
        assert cost == pytest.approx(expected_cost, rel=1e-12)
        assert [c[1] for c in centers] == [c[1] for c in expected]
        assert np.allclose([c[0] for c in centers], [c[0] for c in expected], atol=2e-9)


def test_a_pass_does_not_multiply_rows(blobs):
    plan = blobs.select("x", "y", "k").mapInArrow(
        clustering._adder([clustering.Prototypes(NUMBERS, ["k"], 1.0, [((0.0, 0.0), ("a",))])]), clustering._ADDED
    )._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Expand" not in plan


@pytest.mark.parametrize("init", ["huang", "parallel"])
def test_seeding(blobs, frame, init):
    """Seeds are rows, the same however rows are partitioned, and lead to no dearer prototypes."""
    rows = {(r.x, r.y, r.k) for r in blobs.collect()}
    bare = clustering.Prototypes(NUMBERS, ["k"], 0.5, [])
    seeding = {"huang": clustering._huang_seeds, "parallel": clustering._parallel_seeds}[init]
    for k in (1, 2, 5):
        seeds = seeding(blobs.repartition(1), bare, k, 3)
        assert seeds == seeding(blobs.repartition(50), bare, k, 3)
        assert len(seeds) == k == len({*map(repr, seeds)}) and {(*n, *c) for n, c in seeds} <= rows
    for k in (2, 3, 4):
        cost = clustering.kprototypes_fit(blobs, NUMBERS, ["k"], k, init=init).cost
        assert cost <= clustering.kprototypes_fit(blobs, NUMBERS, ["k"], k).cost * (1 + 1e-9)
    few = frame([(1.0, 1.0, "a")] * 5 + [(2.0, 2.0, "b")], "x double, y double, k string")
    assert len(clustering.kprototypes_fit(few, NUMBERS, ["k"], 4, init=init).centers) == 4


def test_huang_draws_labels_by_frequency(frame):
    """Labels of 70 and 30 % among rows that differ in nothing else."""
    df = frame([(0.0, 0.0, "often")] * 70 + [(0.0, 0.0, "seldom")] * 30, "x double, y double, k string")
    bare = clustering.Prototypes(NUMBERS, ["k"], 1.0, [])
    drawn = [clustering._huang_seeds(df, bare, 1, seed)[0][1][0] for seed in range(30)]
    assert 16 <= drawn.count("often") <= 28


def test_elbow_of_given_starts(blobs):
    start = {2: [((0.0, 0.0), ("a",)), ((3.0, 3.0), ("b",))]}
    rows = clustering.elbow_curve(blobs, NUMBERS, ["k"], [1, 2], start=start, gamma=0.5).orderBy("k").collect()
    fitted = [clustering.kprototypes_fit(blobs, NUMBERS, ["k"], k, 0.5) for k in (1, 2)]
    assert [r.cost for r in rows] == pytest.approx([f.cost for f in fitted]) and all(r.converged for r in rows)


def test_a_fit_that_was_stopped_reports_the_cost_of_its_prototypes(blobs):
    for options in ({"max_passes": 1}, {"max_passes": 2}, {"tolerance": 0.5}):
        fitted = clustering.kprototypes_fit(blobs, NUMBERS, ["k"], k=4, **options)
        again = fitted.assign(blobs, "c", "d").agg(F.sum("d")).first()[0]
        assert fitted.cost == pytest.approx(again, rel=1e-9)
    settled = clustering.kprototypes_fit(blobs, NUMBERS, ["k"], k=4)
    assert settled.converged and not clustering.kprototypes_fit(blobs, NUMBERS, ["k"], k=4, max_passes=1).converged


def test_more_starts_are_never_worse(blobs):
    costs = [clustering.kprototypes_fit(blobs, NUMBERS, ["k"], k=5, starts=n).cost for n in (1, 4)]
    assert costs[1] <= costs[0]


def test_a_scope_deletes_what_was_written(spark, blobs):
    import glob

    from weekloom.session import run_scope, shared_folder

    before = set(glob.glob(shared_folder(spark) + "/*"))
    with run_scope(spark):
        clustering.kprototypes_fit(blobs, NUMBERS, ["k"], k=2)
        assert set(glob.glob(shared_folder(spark) + "/*")) > before
    assert set(glob.glob(shared_folder(spark) + "/*")) == before


def test_gamma_is_half_the_mean_deviation(frame):
    df = frame([(0.0, 0.0), (2.0, 4.0)], "x double, y double")
    assert clustering.mixed_gamma(df, NUMBERS) == pytest.approx(0.5 * (1 + 2) / 2)


def test_segments_end_to_end(blobs):
    found = clustering.cluster_segments(blobs, "k", NUMBERS, 2)
    profile = {r.segment: r for r in found.profile("k").collect()}
    assert (profile["First"].total_count, profile["First"].k) == (60, "a")
    assert (profile["Second"].total_count, profile["Second"].k) == (40, "b")
    raw = blobs.agg(F.max("x")).first()[0]
    assert profile["Second"].x_max == pytest.approx(raw)  # scaled back
    shares = {r.segment: r.key_share for r in found.key_share("k").collect()}
    assert shares == {"First": 0.5, "Second": 0.5}


def test_segment_profile_breaks_ties_by_label(frame):
    df = frame([("s", "b", 1.0), ("s", "a", 3.0), ("s", "b", None), ("s", "a", 5.0)], "seg string, k string, v double")
    row = aggregates.segment_profile(df, "seg", "k", ["v"]).first()
    assert (row.total_count, row.k, row.v_mean, row.v_min, row.v_max) == (4, "a", 3.0, 1.0, 5.0)


def test_correlation_of_a_constant_is_null(frame):
    df = frame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in aggregates.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "c"] is None and got["a", "a"] == 1.0


def test_correlations_by_sums_of_products(frame, monkeypatch):
    """The same as an expression per pair, by group too, with nulls, constants and columns far from zero."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        x = rng.normal(0, 1, 5)
        x[1] += x[0]
        x[2] = 1e6 + 0.01 * x[2] - x[0]
        values = [None if rng.random() < 0.1 else float(v) for v in x]
        rows.append((i % 3 if i % 7 else None, f"g{i % 2}", *values, 0.1, None, i if i < 2 else None))
    names = ["v0", "v1", "v2", "v3", "v4", "constant", "empty", "two"]
    df = frame(rows, "g int, h string, " + ", ".join(f"{n} double" for n in names[:-1]) + ", two int").repartition(4)
    for by in ([], ["g"], ["g", "h"]):
        monkeypatch.setattr(aggregates, "PAIRED", 24)
        paired = aggregates.correlation_matrix(df, names, by)
        monkeypatch.setattr(aggregates, "PAIRED", 1)
        gram = aggregates.correlation_matrix(df, names, by)
        assert gram.columns == paired.columns
        a, b = ({tuple(r)[:-1]: r.r for r in x.collect()} for x in (paired, gram))
        assert a.keys() == b.keys()
        wrong = {k: (a[k], b[k]) for k in a if (a[k] is None) != (b[k] is None) or (a[k] is not None and abs(a[k] - b[k]) > 1e-6)}
        assert wrong == {}
        assert sum(v is not None for v in a.values()) > 20


def test_correlations_of_many_columns(frame):
    rng = np.random.default_rng(7)
    data = rng.normal(0, 1, (200, 120))
    data[:, 1:] += data[:, :-1]
    names = [f"c{i}" for i in range(120)]
    got = aggregates.correlation_matrix(frame([tuple(map(float, r)) for r in data], ", ".join(f"{n} double" for n in names)), names)
    r = {(x.a, x.b): x.r for x in got.collect()}
    expected = np.corrcoef(data.T)
    assert len(r) == 14400
    assert np.allclose([[r[a, b] for b in names] for a in names], expected, atol=1e-12)


# ---- learning

def test_best_count():
    assert learning.best_count([5, 4, 3, 2], 2, 0.0) == 4
    assert learning.best_count([5, 4, 4.1, 4.2, 1], 2, 0.0) == 2
    assert learning.best_count([5, 4.99, 4.98], 2, 0.1) == 3
    assert learning.best_count([1.0], 5, 0.0) == 1


@pytest.fixture
def line(frame):
    rng = np.random.default_rng(9)
    rows = [(i, float(x), float(2 * x + 1 + rng.normal(0, 0.05)), 1.0 + i % 2) for i, x in enumerate(rng.uniform(0, 4, 300))]
    return frame(rows, "id int, x double, label double, w double")


@pytest.mark.parametrize("kind", ["gbt", "linear"])
def test_regressor_beats_the_mean(line, kind, tmp_path):
    spec = learning.FeatureSpec(scaled=["x"], weight="w")
    options = {"maxIter": 5} if kind == "gbt" else {}
    model = learning.train_regressor(line, spec, kind, **options)
    save_model(model, str(tmp_path / kind))
    scored = learning.score_table(load_model(str(tmp_path / kind)), line, ["id", "label"])
    mse = evaluation.regression_metrics(scored, "label", "prediction").first().mse
    assert mse < 0.1 * line.agg(F.var_pop("label")).first()[0]


def test_validated_fit_refits_with_the_best_count(line):
    spec = learning.FeatureSpec(scaled=["x"], weight="w")
    train, validation = line.filter("id % 4 > 0"), line.filter("id % 4 = 0")
    fit = learning.fit_with_validation(train, validation, spec, max_iter=5, patience=2, maxDepth=2)
    assert fit.iterations == learning.best_count(fit.losses, 2, 0.0)
    assert fit.model.stages[-1].getNumTrees == fit.iterations
    best = aggregates.argmin_row(fit.history(line), "iteration", "loss").first()
    assert best.loss == min(fit.losses)


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_boosting_by_tree_is_what_the_learner_of_spark_does(line, task, tmp_path):
    if task == "classification":
        line = line.withColumn("label", (F.col("x") + F.sin("id") > 2).cast("double"))
    spec = learning.FeatureSpec(codes=["c"], scaled=["x"], weight="w")
    line = line.withColumn("c", F.col("id") % 3)
    train, validation = line.filter("id % 4 > 0"), line.filter("id % 4 = 0")
    fit = learning.fit_with_validation(train, validation, spec, task, max_iter=8, patience=8, maxDepth=3)
    train_by = learning.train_regressor if task == "regression" else learning.train_classifier
    whole = train_by(train, spec, "gbt", maxIter=8, maxDepth=3)
    prepared = PipelineModel(whole.stages[:-1]).transform(validation)
    more = ["squared"] if task == "regression" else []
    assert fit.losses == pytest.approx(whole.stages[-1].evaluateEachIteration(prepared, *more), rel=1e-6)
    save_model(fit.first, str(tmp_path / task))
    answers = [
        [r.prediction for r in learning.score_table(m, validation, ["id"]).orderBy("id").collect()]
        for m in (whole, fit.first, load_model(str(tmp_path / task)))
    ]
    assert answers[1] == pytest.approx(answers[0]) and answers[2] == answers[1]


def test_growing_stops_with_the_validation_loss(frame):
    """Validation rows that contradict the training rows: every tree makes them worse."""
    rows = [(float(i % 10), float(i % 10), i) for i in range(200)]
    train = frame(rows, "x double, label double, id int")
    fit = learning.fit_with_validation(
        train, train.withColumn("label", -F.col("label") + 20), learning.FeatureSpec(scaled=["x"]), max_iter=20,
        patience=3, maxDepth=2)
    assert fit.iterations == 1 and len(fit.losses) == 4 == fit.first.stages[-1].getNumTrees


def test_trees_split_by_sets_of_codes(frame):
    """The label depends on whether a code is in a set that no order of the codes shows."""
    chosen = {c for c in range(64) if (c * 37 + 11) % 64 < 32}
    rows = [(i, i % 64, 10.0 * (i % 64 in chosen)) for i in range(1280)]
    df = frame(rows, "id int, c int, label double")
    spec = learning.FeatureSpec(codes=["c"])
    model = learning.train_regressor(df, spec, maxIter=1, maxDepth=1)
    scored = learning.score_table(model, df, ["label"]).collect()
    assert all(r.prediction == pytest.approx(r.label) for r in scored)
    new = learning.score_table(model, frame([(0, 999, 0.0)], "id int, c int, label double")).collect()
    assert len(new) == 1 and 0 <= new[0].prediction <= 10


def test_many_codes_are_folded_by_their_mean_label(frame, tmp_path):
    level = lambda c: float((c * 7919) % 5)
    df = frame([(i, i % 500, level(i % 500)) for i in range(2000)], "id int, c int, label double")
    model = learning.train_regressor(df, learning.FeatureSpec(codes=["c"]), max_codes=20, maxIter=1)
    save_model(model, str(tmp_path / "folded"))
    unknown = frame([(0, 5000, 0.0), (1, -1, 0.0)], "id int, c int, label double")
    for fitted in (model, load_model(str(tmp_path / "folded"))):
        assert all(abs(r.prediction - r.label) < 1e-9 for r in learning.score_table(fitted, df, ["label"]).collect())
        assert learning.score_table(fitted, unknown, ["id"]).count() == 2


def test_classifier_gives_probabilities(line):
    data = line.withColumn("label", (F.col("x") > 2).cast("int")).withColumn("c", F.col("id") % 3)
    model = learning.train_classifier(data, learning.FeatureSpec(codes=["c"], scaled=["x"]), maxIter=20)
    rows = learning.score_table(model, data, ["id", "label"]).collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in rows)
    assert sum(r.prediction == r.label for r in rows) > 280


# ---- evaluation

def test_confusion_has_empty_cells(frame):
    df = frame([(0, 0), (0, 0), (1, 0), (2, 1)], "y int, p int")
    got = {(r.actual, r.predicted): r.n for r in evaluation.confusion_matrix(df, "y", "p").collect()}
    assert len(got) == 9 and got[0, 0] == 2 and got[1, 0] == 1 and got[2, 1] == 1 and got[2, 2] == 0


def test_report_by_hand(frame):
    df = frame([(0, 0), (0, 0), (1, 0), (2, 1)], "y int, p int")
    got = {r.label: r for r in evaluation.classification_report(df, "y", "p").collect()}
    assert (got["0"].precision, got["0"].recall, got["0"].support) == (pytest.approx(2 / 3), 1.0, 2)
    assert (got["2"].precision, got["2"].recall, got["2"].f1) == (0.0, 0.0, 0.0)
    assert got["accuracy"].f1 == 0.5
    assert got["macro avg"].recall == pytest.approx(1 / 3)
    assert got["weighted avg"].recall == 0.5


def test_auc_counts_ties_half(frame):
    rng = np.random.default_rng(4)
    rows = [(int(y), float(s)) for y, s in zip(rng.integers(0, 2, 80), rng.integers(0, 6, 80) / 5)]
    positive = [s for y, s in rows if y == 1]
    negative = [s for y, s in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    got = evaluation.auc(frame(rows, "y int, s double"), "y", "s").first().auc
    assert got == pytest.approx(wins / len(positive) / len(negative))


def test_errors(frame):
    df = frame([(2.0, 1.0), (4.0, 5.0)], "y double, p double")
    stats = evaluation.percent_error_stats(df, "y", "p").first()
    assert (stats.abs_mean, stats.abs_std, stats.signed_mean) == (37.5, 12.5, 12.5)
    metrics = evaluation.regression_metrics(df, "y", "p").first()
    assert (metrics.mse, metrics.mae, metrics.mape) == (1.0, 1.0, 37.5)
    assert math.isclose(stats.signed_std, 37.5)
