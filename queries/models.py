"""Clustering, training and evaluation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from queries import views as v
from queries.registry import out, query, r
from weekloom.functions import date_features, log_plus_one, log_target
from weekloom.operators import evaluation, learning, weights
from weekloom.operators.clustering import Prototypes, cluster_segments, elbow_curve, kprototypes_fit
from weekloom.operators.encoders import fit_encoder
from weekloom.operators.scalers import fit_minmax
from weekloom.operators.sets import union_vintages
from weekloom.session import materialize, scratch_path
from weekloom.sources.models import load_model, save_model

_MEASURES = ["qty", "price", "population"]


# ---- clustering

def _scaled_weeks(spark, sf):
    weekly = materialize(v.pos_week(spark, sf).select("province", "fsa", "week_end", *_MEASURES), "weeks")
    return fit_minmax(weekly, _MEASURES, 0.0, 1.0).transform(weekly)


# Two prototypes to assign rows to: fixed values.
_CENTERS = [((0.2, 0.25, 0.5), ("NATION_1",)), ((0.35, 0.3, 0.4), ("NATION_7",))]
_GAMMA = 0.05


def _distance_sql(center) -> str:
    numbers, (label,) = center
    terms = [f"({c} - {x}) * ({c} - {x})" for c, x in zip(_MEASURES, numbers)]
    return " + ".join([*terms, f"CASE WHEN fsa = '{label}' THEN 0.0 ELSE {_GAMMA} END"])


@query("kprototypes_assign", f"""SELECT province, fsa, CAST(week_end AS VARCHAR) AS week_end,
  CASE WHEN {_distance_sql(_CENTERS[1])} < {_distance_sql(_CENTERS[0])} THEN 1 ELSE 0 END AS cluster,
  {r(f'least({_distance_sql(_CENTERS[0])}, {_distance_sql(_CENTERS[1])})', 'distance')} FROM scaled""",
  v.POS_WEEK + ",\nscaled AS (SELECT province, fsa, week_end, " + ", ".join(
      f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in _MEASURES) + " FROM pos_week)")
def kprototypes_assign(spark, sf):
    prototypes = Prototypes(_MEASURES, ["fsa"], _GAMMA, _CENTERS)
    assigned = prototypes.assign(_scaled_weeks(spark, sf), "cluster", "distance")
    return out(assigned.select("province", "fsa", "week_end", "cluster", "distance"))


_SCALED = v.POS_WEEK + ",\nscaled AS (SELECT province, fsa, week_end, " + ", ".join(
    f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in _MEASURES) + " FROM pos_week)"
_MOVED = _SCALED + f""",
assigned AS (SELECT *, CASE WHEN {_distance_sql(_CENTERS[1])} < {_distance_sql(_CENTERS[0])} THEN 1 ELSE 0 END AS was FROM scaled),
modes AS (SELECT was, fsa AS label FROM (
  SELECT was, fsa, row_number() OVER (PARTITION BY was ORDER BY count(*) DESC, fsa) AS place FROM assigned GROUP BY 1, 2) WHERE place = 1),
means AS (SELECT was, CAST(row_number() OVER (ORDER BY avg({_MEASURES[0]})) - 1 AS INTEGER) AS cluster, {', '.join(f'avg({c}) AS {c}' for c in _MEASURES)}
  FROM assigned GROUP BY 1)"""


@query("kprototypes_one_pass", " UNION ALL ".join(
    f"SELECT cluster, '{c}' AS feature, {r(c, 'value')}, CAST(NULL AS VARCHAR) AS label FROM means" for c in _MEASURES)
    + " UNION ALL SELECT cluster, 'fsa', NULL, label FROM means JOIN modes USING (was)", _MOVED)
def kprototypes_one_pass(spark, sf):
    """Prototypes after one pass from given ones."""
    fitted = kprototypes_fit(_scaled_weeks(spark, sf), _MEASURES, ["fsa"], gamma=_GAMMA, max_passes=1, start=_CENTERS)
    return out(fitted.table(spark))


# Passes of a fit that the SQL unrolls; more than any fit below needs, and further ones change nothing.
_UNROLLED = 60


def _fit_sql(source: str, centers, passes: int = _UNROLLED, measures=_MEASURES) -> str:
    """CTEs p0, p1, ...: both prototypes after each pass over the rows of `source`, in one row."""
    near = " + ".join([*[f"({c} - {{p}}_{c}) * ({c} - {{p}}_{c})" for c in measures], f"CASE WHEN fsa = {{p}}_label THEN 0.0 ELSE {_GAMMA} END"])
    first = ", ".join(
        [f"CAST({x} AS DOUBLE) AS {p}_{c}" for p, (numbers, _) in zip("ab", centers) for c, x in zip(measures, numbers)]
        + [f"'{label}' AS {p}_label" for p, (_, (label,)) in zip("ab", centers)])
    parts = [f"p0 AS MATERIALIZED (SELECT {first})"]
    for i in range(1, passes + 1):
        parts.append(f"""d{i} AS MATERIALIZED (SELECT {source}.*, ({near.format(p='b')}) < ({near.format(p='a')}) AS second FROM {source}, p{i - 1})""")
        columns = [
            f"coalesce((SELECT round(avg({c}), 9) FROM d{i} WHERE {'' if p == 'b' else 'NOT '}second), (SELECT {p}_{c} FROM p{i - 1})) AS {p}_{c}"
            for p in "ab" for c in measures]
        columns += [
            f"coalesce((SELECT fsa FROM d{i} WHERE {'' if p == 'b' else 'NOT '}second GROUP BY fsa ORDER BY count(*) DESC, fsa LIMIT 1), "
            f"(SELECT {p}_label FROM p{i - 1})) AS {p}_label" for p in "ab"]
        parts.append(f"p{i} AS MATERIALIZED (SELECT {', '.join(columns)})")
    # Numbered by the first measure.
    swap = f"b_{measures[0]} < a_{measures[0]}"
    chosen = [f"CASE WHEN {swap} THEN {q}_{c} ELSE {p}_{c} END AS {p}_{c}" for p, q in ("ab", "ba") for c in (*measures, "label")]
    return ",\n".join([*parts, f"fitted AS (SELECT {', '.join(chosen)} FROM p{passes})"])


def _fitted_rows(measures) -> str:
    """The rows of `scaled` with their cluster and distance."""
    a, b = (" + ".join([*[f"({c} - {p}_{c}) * ({c} - {p}_{c})" for c in measures], f"CASE WHEN fsa = {p}_label THEN 0.0 ELSE {_GAMMA} END"])
            for p in "ab")
    return f"placed AS (SELECT scaled.*, CASE WHEN ({b}) < ({a}) THEN 1 ELSE 0 END AS cluster, least({a}, {b}) AS distance FROM scaled, fitted)"


@query("kprototypes_fit", "SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT {i} AS cluster, '{c}' AS feature, {r(f'{p}_{c}', 'value')}, CAST(NULL AS VARCHAR) AS label FROM fitted"
     for i, p in enumerate("ab") for c in _MEASURES]
    + [f"SELECT {i}, 'fsa', NULL, {p}_label FROM fitted" for i, p in enumerate("ab")])
    + f") JOIN (SELECT cluster, count(*) AS rows, {r('sum(distance)', 'cost')} FROM placed GROUP BY 1) USING (cluster)",
    _SCALED + ",\n" + _fit_sql("scaled", _CENTERS) + ",\n" + _fitted_rows(_MEASURES))
def kprototypes(spark, sf):
    """Rows, cost and prototype of each cluster, from given starts until nothing changes."""
    scaled = _scaled_weeks(spark, sf)
    fitted = kprototypes_fit(scaled, _MEASURES, ["fsa"], gamma=_GAMMA, start=_CENTERS)
    assert fitted.converged
    sizes = fitted.assign(scaled, "cluster", "distance").groupBy("cluster").agg(
        F.count("*").alias("rows"), F.sum("distance").alias("cost"))
    return out(fitted.table(spark).join(sizes, "cluster", "left"))


# Starts of one to four clusters, and the passes that both sides make: fixed values.
_ELBOW_STARTS = {
    1: [((0.3, 0.3, 0.5), ("NATION_1",))],
    2: _CENTERS,
    3: [*_CENTERS, ((0.1, 0.6, 0.8), ("NATION_3",))],
    4: [*_CENTERS, ((0.1, 0.6, 0.8), ("NATION_3",)), ((0.6, 0.5, 0.1), ("NATION_11",))],
}
_ELBOW_PASSES = 8


def _elbow_sql() -> str:
    """CTEs c0, c1, ...: all prototypes, by number of clusters, after each pass over the rows of `scaled`."""
    values = ", ".join(
        f"({k}, {i}, {', '.join(f'CAST({x} AS DOUBLE)' for x in numbers)}, '{label}')"
        for k, centers in _ELBOW_STARTS.items() for i, (numbers, (label,)) in enumerate(centers))
    names = ", ".join(f"c_{c}" for c in _MEASURES)
    near = " + ".join([*[f"({c} - c_{c}) * ({c} - c_{c})" for c in _MEASURES], f"CASE WHEN fsa = label THEN 0.0 ELSE {_GAMMA} END"])
    parts = ["numbered AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM scaled)",
             f"c0 AS MATERIALIZED (SELECT * FROM (VALUES {values}) t(k, cluster, {names}, label))"]
    for i in range(1, _ELBOW_PASSES + 2):
        parts.append(f"""n{i} AS MATERIALIZED (SELECT k, id, min({near}) AS distance, arg_min(cluster, {{'d': {near}, 'c': cluster}}) AS cluster
  FROM numbered, c{i - 1} GROUP BY k, id)""")
        parts.append(f"""m{i} AS (SELECT k, n.cluster, {', '.join(f'round(avg({c}), 9) AS m_{c}' for c in _MEASURES)}
  FROM n{i} n JOIN numbered USING (id) GROUP BY 1, 2)""")
        parts.append(f"""l{i} AS (SELECT k, cluster, fsa AS often FROM (SELECT k, n.cluster, fsa,
  row_number() OVER (PARTITION BY k, n.cluster ORDER BY count(*) DESC, fsa) AS place FROM n{i} n JOIN numbered USING (id) GROUP BY 1, 2, 3) WHERE place = 1)""")
        moved = ", ".join(f"coalesce(m_{c}, c_{c}) AS c_{c}" for c in _MEASURES)
        parts.append(f"c{i} AS MATERIALIZED (SELECT k, cluster, {moved}, coalesce(often, label) AS label FROM c{i - 1} LEFT JOIN m{i} USING (k, cluster) LEFT JOIN l{i} USING (k, cluster))")
    return ",\n".join(parts)


@query("elbow_curve", f"""SELECT k, {r('sum(distance)', 'cost')}, k NOT IN (
    SELECT k FROM (SELECT * FROM c{_ELBOW_PASSES} EXCEPT SELECT * FROM c{_ELBOW_PASSES - 1})) AS converged
  FROM n{_ELBOW_PASSES + 1} GROUP BY k""", _SCALED + ",\n" + _elbow_sql())
def elbow(spark, sf):
    """Cost of one to four clusters after eight passes from given starts, and whether another would change them."""
    curve = elbow_curve(_scaled_weeks(spark, sf), _MEASURES, ["fsa"], list(_ELBOW_STARTS), gamma=_GAMMA,
                        start=_ELBOW_STARTS, max_passes=_ELBOW_PASSES)
    return out(curve)


@query("elbow_curve_own_starts")
def elbow_of_own_starts(spark, sf):
    """One to nine clusters from the starts that the fit finds by itself: their costs. SQL cannot follow the
    starts; tests compare the costs with the rows."""
    return out(elbow_curve(_scaled_weeks(spark, sf), _MEASURES, ["fsa"]))


@query("kprototypes_seeding")
def kprototypes_seeding(spark, sf):
    """Prototypes of four clusters by each way of finding the starts. Tests compare their costs."""
    scaled = materialize(_scaled_weeks(spark, sf), "scaled")
    fitted = {init: kprototypes_fit(scaled, _MEASURES, ["fsa"], 4, _GAMMA, init=init) for init in ("far", "huang", "parallel")}
    return out(union_vintages([p.table(spark).withColumn("init", F.lit(init)) for init, p in fitted.items()]))


# Two kinds of areas to start from, by their scaled population: fixed values.
_AREA_STARTS = [((0.3,), ("NATION_1",)), ((0.7,), ("NATION_7",))]
_AREA_YEARS = v.POS + """,
yearly AS (SELECT fsa, year(week_end) AS yr, floor(avg(population) * 100 + 0.500001) / 100 AS population FROM pos GROUP BY 1, 2),
scaled AS (SELECT fsa, yr, population AS raw, (population - min(population) OVER ()) / (max(population) OVER () - min(population) OVER ()) AS population
  FROM yearly)"""


@query("cluster_segments_yearly", f"""SELECT segment, count(*) AS total_count, min(fsa) FILTER (place = 1) AS fsa,
  {r('avg(raw)', 'population_mean', 4)}, {r('min(raw)', 'population_min', 4)}, {r('max(raw)', 'population_max', 4)}
  FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, fsa) AS place FROM (
    SELECT *, count(*) OVER (PARTITION BY segment, fsa) AS n FROM (
      SELECT fsa, raw, CASE WHEN min(cluster) OVER (PARTITION BY fsa) = 0 THEN 'First' ELSE 'Second' END AS segment FROM placed)))
  GROUP BY 1""", _AREA_YEARS + ",\n" + _fit_sql("scaled", _AREA_STARTS, measures=["population"]) + ",\n" + _fitted_rows(["population"]))
def yearly_segments(spark, sf):
    """Areas by what their years look like: every area belongs to one segment, and there are two."""
    yearly = materialize(
        v.pos(spark, sf).groupBy("fsa", F.year("week_end").alias("yr")).agg(
            v.half_up(F.avg("population"), 100).alias("population")), "years")
    found = cluster_segments(yearly, "fsa", ["population"], k=2, start=_AREA_STARTS, gamma=_GAMMA)
    assert found.prototypes.converged
    return out(found.profile("fsa"), 4)


_RAW_SCALED = v.POS_WEEK + ",\nscaled AS (SELECT province, fsa, week_end, " + ", ".join(
    f"{c} AS raw_{c}, ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in _MEASURES) + " FROM pos_week)"
_PROFILES = ", ".join(r(f"{f}(raw_{c})", f"{c}_{name}", 4) for c in _MEASURES for f, name in (("avg", "mean"), ("min", "min"), ("max", "max")))


@query("cluster_segments", f"""SELECT segment, count(*) AS total_count, min(fsa) FILTER (place = 1) AS fsa, {_PROFILES}
  FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, fsa) AS place FROM (
    SELECT *, count(*) OVER (PARTITION BY segment, fsa) AS n FROM (
      SELECT *, CASE WHEN min(cluster) OVER (PARTITION BY fsa) = 0 THEN 'First' ELSE 'Second' END AS segment FROM placed)))
  GROUP BY 1""", _RAW_SCALED + ",\n" + _fit_sql("scaled", _CENTERS) + ",\n" + _fitted_rows(_MEASURES))
def segments(spark, sf):
    """Areas by all their weeks and measures. An area with weeks in both clusters belongs to the first."""
    weekly = materialize(v.pos_week(spark, sf).select("province", "fsa", "week_end", *_MEASURES), "weeks")
    found = cluster_segments(weekly, "fsa", _MEASURES, k=2, start=_CENTERS, gamma=_GAMMA)
    assert found.prototypes.converged
    return out(found.profile("fsa"), 4)


# ---- training

def _sales_rows(spark, sf):
    """Encoded series, time parts, scaled and logged measures, weights by how common a brand is."""
    data = materialize(
        v.pos(spark, sf).select(
            *v.FLAGGED, "week_end", "population", F.col("qty").alias("raw_qty"),
            *date_features("week_end", "t_", ["Yr", "Mon"]),
            log_plus_one("price").cast("double").alias("log_price"), log_target("qty").alias("log_qty"),
        ),
        "sales",
    )
    coded = fit_encoder(data, [*v.FLAGGED, "t_Yr", "t_Mon"]).transform(data)
    weighted = weights.add_weights(coded, weights.sample_weights(data, "brand"), "brand")
    return materialize(fit_minmax(data, ["population"]).transform(weighted), "features")


_SALES = learning.FeatureSpec(
    codes=[f"{c}_code" for c in (*v.FLAGGED, "t_Yr", "t_Mon")], scaled=["population"], logged=["log_price"],
    label="log_qty", weight="weight",
)

# A label that a known function gives: one of five levels for each brand, in no order that the brand's name shows,
# half a level more in two market segments, and an error of three tenths at most. A fit has to tell all of them apart.
_LEVEL_SQL = "10 * ((CAST(substr(brand, 7) AS INTEGER) * 7) % 5) + CASE WHEN ka IN ('AUTOMOBILE', 'HOUSEHOLD') THEN 5 ELSE 0 END"
_PLANTED_SQL = f"SELECT brand, ka, fsa, segment, CAST(week_end AS VARCHAR) AS week_end, CAST({_LEVEL_SQL} AS BIGINT) AS level{{more}} FROM pos"


def _planted_rows(spark, sf):
    """`_sales_rows` with the planted label."""
    brand = F.substring("brand", 7, 10).cast("int")
    level = 10 * (brand * 7 % 5) + F.when(F.col("ka").isin("AUTOMOBILE", "HOUSEHOLD"), 5).otherwise(0)
    error = (F.col("raw_qty").cast("bigint") % 7 - 3) / 10
    return _sales_rows(spark, sf).withColumn("planted", (level + error).cast("double"))


_PLANTED = learning.FeatureSpec(codes=_SALES.codes, scaled=["population"], logged=["log_price"], label="planted")


def _level(scored):
    """The level, a multiple of five, that a prediction is nearest to: a mean or a wrong level does not give it."""
    level = (5 * F.rint(F.col("prediction") / 5)).cast("bigint")
    return out(scored.select(*v.FLAGGED, "week_end", level.alias("level")))


@query("train_regressor", _PLANTED_SQL.format(more=""), v.POS)
def train_regressor(spark, sf):
    """Boosted trees on a planted label: the level that every row's prediction is nearest to."""
    rows = materialize(_planted_rows(spark, sf), "planted")
    model = learning.train_regressor(rows, _PLANTED, "gbt", maxIter=20)
    return _level(learning.score_table(model, rows, [*v.FLAGGED, "week_end"]))


@query("fit_with_validation", _PLANTED_SQL.format(more=", true AS within"), v.POS)
def fit_with_validation(spark, sf):
    """Boosted trees with the validation stop on a planted label, and whether the number of trees is the best one."""
    rows = materialize(_planted_rows(spark, sf), "planted")
    late = F.col("week_end") >= F.lit(date(2000, 1, 1))
    fit = learning.fit_with_validation(rows.filter(~late), rows.filter(late), _PLANTED)
    within = 1 <= fit.iterations <= len(fit.losses) <= 20 and fit.losses[fit.iterations - 1] == min(fit.losses)
    return _level(learning.score_table(fit.model, rows, [*v.FLAGGED, "week_end"])).withColumn("within", F.lit(within))


# A planted class for each market segment, in no order that their names show: fixed values.
_CLASSES_OF_KA = {"AUTOMOBILE": 2, "BUILDING": 0, "FURNITURE": 1, "HOUSEHOLD": 0, "MACHINERY": 2}
_CLASS_SQL = "CASE ka " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in _CLASSES_OF_KA.items()) + " END"


@query("train_classifier", f"""SELECT o_orderkey, kind, {_CLASS_SQL} AS class, true AS adds_up
  FROM loan, (SELECT unnest(['forest', 'logistic']) AS kind)""", v.LOAN)
def train_classifier(spark, sf):
    """A planted class by class weights: each learner's likeliest class, and that its probabilities add up to 1."""
    planted = F.coalesce(*[F.when(F.col("ka") == k, F.lit(c)) for k, c in _CLASSES_OF_KA.items()])
    data = materialize(v.loan(spark, sf).select("o_orderkey", "priority", "ka", "amount", "balance", planted.alias("class"),
                                                *date_features("order_date", "t_", ["Yr", "Qtr"])), "loans")
    coded = fit_encoder(data, ["priority", "ka", "t_Yr", "t_Qtr"]).transform(data)
    weighted = weights.add_weights(coded, weights.class_weights(data, "class"), "class")
    rows = materialize(fit_minmax(data, ["amount", "balance"], 1.0, 3.0).transform(weighted), "features")
    spec = learning.FeatureSpec(
        codes=["priority_code", "ka_code", "t_Yr_code", "t_Qtr_code"], scaled=["amount", "balance"], label="class", weight="weight")
    answers = []
    for kind, options in (("forest", {"featureSubsetStrategy": "all", "numTrees": 5}), ("logistic", {})):
        model = learning.train_classifier(rows, spec, kind, **options)
        p = F.col("probability")
        total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
        likeliest = F.array_position(p, F.array_max(p)).cast("int") - 1
        answers.append(learning.score_table(model, rows, ["o_orderkey"]).select(
            "o_orderkey", F.lit(kind).alias("kind"), likeliest.alias("class"), (F.abs(total - 1) < 1e-9).alias("adds_up")))
    return union_vintages(answers)


def _line(spark, sf):
    data = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("price"))
    spec = learning.FeatureSpec(scaled=["l_quantity"], label="price")
    return data, learning.train_regressor(data, spec, "linear", solver="normal")


_LINE_SQL = f"""SELECT l_orderkey, l_linenumber, {r('a + b * l_quantity', 'prediction', 4)} FROM lineitem,
  (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)"""


@query("score_table", _LINE_SQL)
def score_table(spark, sf):
    data, model = _line(spark, sf)
    return out(learning.score_table(model, data, ["l_orderkey", "l_linenumber"]), 4)


@query("save_model", f"SELECT {r('regr_intercept(l_extendedprice, l_quantity)', 'intercept', 4)}, "
       f"{r('regr_slope(l_extendedprice, l_quantity)', 'slope', 4)} FROM lineitem")
def save(spark, sf):
    """Coefficients of the model as written."""
    _, model = _line(spark, sf)
    path = scratch_path(spark, "model")
    save_model(model, path)
    line = load_model(path).stages[-1]
    return out(spark.createDataFrame([(line.intercept, float(line.coefficients[0]))], "intercept double, slope double"), 4)


@query("load_model", _LINE_SQL)
def load(spark, sf):
    data, model = _line(spark, sf)
    path = scratch_path(spark, "model")
    save_model(model, path)
    return out(learning.score_table(load_model(path), data, ["l_orderkey", "l_linenumber"]), 4)


# ---- evaluation, with the previous week's quantity as the prediction

def _predicted(spark, sf):
    from pyspark.sql import Window

    along = Window.partitionBy("province", "fsa").orderBy("week_end")  # one row per area and week
    weekly = v.pos_week(spark, sf).select("province", "fsa", "week_end", "qty")
    return weekly.withColumn("predicted", F.lag("qty").over(along)).filter(F.col("predicted").isNotNull())


_PREDICTED = v.POS_WEEK + """,
predicted AS (SELECT * FROM (
  SELECT province, fsa, week_end, qty, lag(qty) OVER (PARTITION BY province, fsa ORDER BY week_end) AS predicted FROM pos_week)
  WHERE predicted IS NOT NULL)"""


@query("regression_metrics", f"SELECT {r('avg((qty - predicted) * (qty - predicted))', 'mse')}, {r('avg(abs(qty - predicted))', 'mae')}, "
       f"{r('avg(abs(qty - predicted) / qty * 100)', 'mape')} FROM predicted", _PREDICTED)
def regression_metrics(spark, sf):
    return out(evaluation.regression_metrics(_predicted(spark, sf), "qty", "predicted"))


@query("percent_error_stats", f"""SELECT {r('avg(abs(e))', 'abs_mean')}, {r('stddev_pop(abs(e))', 'abs_std')},
  {r('avg(e)', 'signed_mean')}, {r('stddev_pop(e)', 'signed_std')} FROM (SELECT 100 * (qty - predicted) / qty AS e FROM predicted)""", _PREDICTED)
def percent_error_stats(spark, sf):
    return out(evaluation.percent_error_stats(_predicted(spark, sf), "qty", "predicted"))


@query("actual_vs_predicted", f"SELECT {r('qty', 'actual')}, {r('predicted')} FROM predicted", _PREDICTED)
def actual_vs_predicted(spark, sf):
    return out(evaluation.actual_vs_predicted(_predicted(spark, sf), "qty", "predicted"))


# Statuses against a rule that never answers P: the grid has empty cells.
_CLASSES = v.LOAN + """,
judged AS (SELECT CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS actual,
  CASE WHEN amount > 250000 THEN 1 ELSE 0 END AS predicted FROM loan)"""


def _judged(spark, sf):
    status = F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1).otherwise(2)
    guess = F.when(F.col("amount") > 250_000, 1).otherwise(0)
    return v.loan(spark, sf).select(status.alias("actual"), guess.alias("predicted"))


@query("confusion_matrix", """SELECT a.actual, p.predicted, count(judged.actual) AS n
  FROM (SELECT DISTINCT actual FROM judged) a CROSS JOIN (SELECT DISTINCT actual AS predicted FROM judged) p
  LEFT JOIN judged ON judged.actual = a.actual AND judged.predicted = p.predicted GROUP BY 1, 2""", _CLASSES)
def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(_judged(spark, sf), "actual", "predicted")


_REPORT = _CLASSES + """,
per_class AS (
  SELECT label, hits, support, CASE WHEN chosen = 0 THEN 0.0 ELSE hits / chosen END AS p, CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS r
  FROM (SELECT l.label, count(*) FILTER (actual = l.label AND predicted = l.label) AS hits,
          count(*) FILTER (predicted = l.label) AS chosen, count(*) FILTER (actual = l.label) AS support
        FROM judged, (SELECT DISTINCT actual AS label FROM judged) l GROUP BY 1)),
scored AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM per_class)"""


@query("classification_report", f"""
  SELECT CAST(label AS VARCHAR) AS label, {r('p', 'precision')}, {r('r', 'recall')}, {r('f', 'f1')}, CAST(support AS BIGINT) AS support FROM scored
  UNION ALL SELECT 'accuracy', NULL, NULL, {r('sum(hits) / sum(support)', 'f1')}, CAST(sum(support) AS BIGINT) FROM scored
  UNION ALL SELECT 'macro avg', {r('avg(p)', 'p')}, {r('avg(r)', 'r')}, {r('avg(f)', 'f')}, CAST(sum(support) AS BIGINT) FROM scored
  UNION ALL SELECT 'weighted avg', {r('sum(p * support) / sum(support)', 'p')}, {r('sum(r * support) / sum(support)', 'r')},
    {r('sum(f * support) / sum(support)', 'f')}, CAST(sum(support) AS BIGINT) FROM scored""", _REPORT)
def classification_report(spark, sf):
    return out(evaluation.classification_report(_judged(spark, sf), "actual", "predicted"))


@query("binary_metrics", f"""SELECT {r('avg(CASE WHEN quality = guess THEN 1.0 ELSE 0.0 END)', 'accuracy')},
  {r('count(*) FILTER (quality = 1 AND guess = 1) / count(*) FILTER (guess = 1)', 'precision')},
  {r('count(*) FILTER (quality = 1 AND guess = 1) / count(*) FILTER (quality = 1)', 'recall')},
  {r('(sum(place) FILTER (quality = 1) - any_value(n1) * (any_value(n1) + 1) / 2) / (any_value(n1) * any_value(n0))', 'auc')}
  FROM (SELECT quality, guess, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS place,
    count(*) FILTER (quality = 1) OVER () AS n1, count(*) FILTER (quality <> 1) OVER () AS n0 FROM loan_binary)""", v.LOAN_BINARY)
def binary_metrics(spark, sf):
    return out(evaluation.binary_metrics(v.loan_binary(spark, sf), "quality", "guess", "score"))
