"""The three flows from raw tables to reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from queries import views as v
from queries.features import split_sql
from queries.registry import out, query, r
from queries.series import LARGE
from weekloom.functions import date_features, log_target
from weekloom.operators.encoders import fit_encoder
from weekloom.operators.joins import keep_keys
from weekloom.operators.learning import FeatureSpec, score_table, train_regressor
from weekloom.operators.scalers import fit_minmax
from weekloom.operators.sets import union_vintages
from weekloom.plans import loans, sales, segments
from weekloom.session import materialize, scratch_path
from weekloom.sources.models import load_model, save_model


@query("sales_flow")
def sales_flow(spark, sf):
    """Log-quantity regression of one region and return flag; error statistics on the test rows, of
    the fit on the training rows and of the final one."""
    columns = sales.SalesColumns()
    data = sales.denoised_sales(v.pos(spark, sf), columns, 2001, one_row_per_date=True, province="ASIA", segment="N")
    large = sales.large_combinations(data, columns, 2000, one_row_per_date=True)
    features = sales.sales_features(large, columns)
    fitted = sales.sales_regression(features, columns)
    first, final = (e.withColumn("fit", F.lit(n)) for n, e in (("first", fitted.first_errors), ("final", fitted.errors)))
    return out(first.unionByName(final))


# Quantities that a known function gives: 100 doubled up to four times, by brand, in no order that the names show.
_POWER_SQL = "(CAST(substr(brand, 7) AS INTEGER) * 7) % 5"
_PLANTED_POS = (
    v.POS.replace("pos AS (", "sold AS (", 1)
    + f""",
pos AS (SELECT * REPLACE (100.0 * 2 ** ({_POWER_SQL}) AS qty) FROM sold
  WHERE province = 'ASIA' AND segment = 'N' AND week_end < DATE '2001-01-01')"""
    + LARGE.removeprefix(v.POS)
)


@query("sales_flow_planted", f"""SELECT brand, ka, fsa, CAST(week_end AS VARCHAR) AS week_end, CAST({_POWER_SQL} AS BIGINT) AS power
  FROM denoised WHERE (brand, ka, fsa) IN (SELECT (brand, ka, fsa) FROM kept) QUALIFY count(*) OVER (PARTITION BY brand) >= 20""", _PLANTED_POS)
def sales_flow_planted(spark, sf):
    """The sales flow on planted quantities: the doublings that the prediction for every row of its table stands for.
    A mean, or a fit that takes the order of brands for theirs, gives others. Brands of fewer than 20 rows are left
    out: all rows of such a brand may be test rows, whose level nothing tells."""
    columns = sales.SalesColumns()
    power = F.substring("brand", 7, 10).cast("int") * 7 % 5
    planted = v.pos(spark, sf).withColumn("qty", 100.0 * F.pow(F.lit(2.0), power))
    data = sales.denoised_sales(planted, columns, 2001, one_row_per_date=True, province="ASIA", segment="N")
    large = sales.large_combinations(data, columns, 2000, one_row_per_date=True)
    features = sales.sales_features(large, columns, duplicates="drop")
    fitted = sales.sales_regression(features, columns)
    scored = score_table(fitted.model, features.rows, columns.key)
    often = scored.groupBy("brand").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")  # a row per brand
    scored = keep_keys(scored, often, ["brand"])
    return out(scored.select(*columns.key, F.rint(F.log2(F.expm1("prediction") / 100)).cast("bigint").alias("power")))


_BANDS = {"Younger": ["Age Band 1", "Age Band 2"], "Older": ["Age Band 3", "Age Band 4", "Age Band 5"],
          "Lower income": ["Income Band 1", "Income Band 2"], "Higher income": ["Income Band 3", "Income Band 4"]}


_CHANGED = ["qty", "Younger", "Older"]
_SUMS = ", ".join(f"{' + '.join(f'd.\"{m}\"' for m in parts)} AS \"{name.replace(' ', '_')}\"" for name, parts in _BANDS.items())
_KEPT_AREA = ["qty", "price", *[b.replace(" ", "_") for b in _BANDS], "Average_Income"]


@query("area_changes", "SELECT province, fsa, CAST(week_end AS VARCHAR) AS week_end, " + ", ".join(r(c, c) for c in _KEPT_AREA)
       + " FROM changed WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _CHANGED),
       v.POS + ",\n" + v.DEMO_WEEKS + ",\ndemo_week AS (" + v.weekly_select(v.LINEAR) + f"""),
joined AS (SELECT p.province, p.fsa, p.week_end, p.qty, p.price, {_SUMS}, d."Average Income" AS "Average_Income"
  FROM (SELECT province, fsa, week_end, sum(qty) AS qty, avg(price) AS price FROM pos GROUP BY 1, 2, 3) p
  JOIN demo_week d ON p.fsa = d.code AND p.week_end = d.week_end),
complete AS (SELECT * FROM joined WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _KEPT_AREA)}),
changed AS (SELECT province, fsa, week_end, {', '.join(
    f'{c} / nullif(lag({c}) OVER w, 0) - 1 AS {c}' if c in _CHANGED else c for c in _KEPT_AREA)}
  FROM complete WINDOW w AS (PARTITION BY province, fsa ORDER BY complete.week_end))""")
def area_changes(spark, sf):
    """What the segment flow clusters: weekly sales and yearly demographics as relative changes."""
    columns = segments.AreaColumns()
    weekly = segments.weekly_area_sales(v.pos(spark, sf), columns)
    demo = segments.weekly_demographics(v.demo(spark, sf), v.MEASURES)
    changes = segments.area_changes(weekly, demo, columns, _BANDS, _CHANGED, ["Average Income"])
    return out(changes.select("province", "fsa", "week_end", *_KEPT_AREA))


@query("segments_flow")
def segments_flow(spark, sf):
    """Segments of one region's areas from sales changes, prices and income; their profile and the share of
    the areas that each has."""
    columns = segments.AreaColumns()
    weekly = segments.weekly_area_sales(v.pos(spark, sf), columns)
    demo = segments.weekly_demographics(v.demo(spark, sf), v.MEASURES)
    changes = segments.area_changes(weekly, demo, columns, _BANDS, ["qty", "Younger", "Older"], ["Average Income"])
    measures = ["qty", "price", "Lower_income", "Higher_income", "Average_Income"]
    found = segments.area_segments(changes, columns, "ASIA", measures)
    return out(found.profile("fsa").join(found.key_share("fsa"), "segment"))


_LOAN_CODES = ["priority", "ka", "t_Yr", "t_Qtr", "status"]
_DICTIONARIES = ",\n".join(
    f"by_{c} AS (SELECT {c}, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_code FROM (SELECT DISTINCT {c} FROM base))"
    for c in _LOAN_CODES)


@query("loan_features", f"""SELECT o_orderkey, part, {', '.join(f'{c}_code' for c in _LOAN_CODES)},
  {', '.join(r(f'({c} - (SELECT min({c}) FROM base)) / (SELECT max({c}) - min({c}) FROM base) * 2 + 1', c) for c in ('amount', 'balance'))},
  {r('share', 'weight')} FROM split {' '.join(f'JOIN by_{c} USING ({c})' for c in _LOAN_CODES)} JOIN weights USING (status)""",
    v.LOAN + """,
dated AS (SELECT *, CAST(year(order_date) AS INTEGER) AS "t_Yr", CAST(quarter(order_date) AS INTEGER) AS "t_Qtr" FROM loan),
""" + split_sql("dated", "concat_ws('|', '75', CAST(o_orderkey AS VARCHAR))", "status", 0.05, 0.20) + f""",
base AS (SELECT * FROM split WHERE part = 'train'),
{_DICTIONARIES},
ranked AS (SELECT status, count(*) / (SELECT count(*) FROM base) AS share,
  row_number() OVER (ORDER BY count(*) DESC, status) AS place FROM base GROUP BY 1),
weights AS (SELECT a.status, b.share FROM ranked a JOIN ranked b ON a.place + b.place = (SELECT count(*) + 1 FROM ranked))""")
def loan_features(spark, sf):
    """What the loan flow trains on: parts, codes, scaled measures and class weights, fitted on the training rows."""
    data = v.loan(spark, sf).select(
        "o_orderkey", "priority", "ka", "amount", "balance", "status", *date_features("order_date", "t_", ["Yr", "Qtr"]))
    found = loans.loan_features(data, ["o_orderkey"], ["priority", "ka"], ["t_Yr", "t_Qtr"], ["amount", "balance"], "status")
    return out(found.rows.select("o_orderkey", "part", *[f"{c}_code" for c in _LOAN_CODES], "amount", "balance", "weight"))


@query("loans_flow")
def loans_flow(spark, sf):
    """Order status from order features with class weights; reports on validation, test and all."""
    data = v.loan(spark, sf).select(
        "o_orderkey", "priority", "ka", "amount", "balance", "status", *date_features("order_date", "t_", ["Yr", "Qtr"]))
    features = loans.loan_features(data, ["o_orderkey"], ["priority", "ka"], ["t_Yr", "t_Qtr"], ["amount", "balance"], "status")
    models = loans.loan_classification(features, ["o_orderkey"])
    reports = {"first validation": models.first.report("validation"), "first test": models.first.report("test"),
               "final all": models.final.report("all"), "final test": models.final.report("test")}
    return out(union_vintages([df.withColumn("on", F.lit(name)) for name, df in reports.items()]))


# A planted class for each market segment, in no order that their names show: fixed values.
_PLANTED_STATUS = {"AUTOMOBILE": 2, "BUILDING": 0, "FURNITURE": 1, "HOUSEHOLD": 0, "MACHINERY": 2}
_REPORTED = {"first validation": "part = 'validation'", "first test": "part = 'test'", "final all": "part <> 'test'", "final test": "part = 'test'"}


@query("loans_flow_planted", " UNION ALL ".join(
    f"""SELECT '{name}' AS "on", CAST(planted AS VARCHAR) AS label, 1e0 AS precision, 1e0 AS recall, 1e0 AS f1, count(*) AS support
  FROM split WHERE {where} GROUP BY planted
  UNION ALL SELECT '{name}', 'accuracy', NULL, NULL, 1e0, count(*) FROM split WHERE {where}
  UNION ALL SELECT '{name}', unnest(['macro avg', 'weighted avg']), 1e0, 1e0, 1e0, count(*) FROM split WHERE {where}"""
    for name, where in _REPORTED.items()),
    v.LOAN + f""",
classed AS (SELECT *, CASE ka {' '.join(f"WHEN '{k}' THEN {c}" for k, c in _PLANTED_STATUS.items())} END AS planted FROM loan),
""" + split_sql("classed", "concat_ws('|', '75', CAST(o_orderkey AS VARCHAR))", "planted", 0.05, 0.20))
def loans_flow_planted(spark, sf):
    """The loan flow on a planted class: every report has to find all rows right, on as many rows as the split gives."""
    planted = F.coalesce(*[F.when(F.col("ka") == k, F.lit(c)) for k, c in _PLANTED_STATUS.items()])
    data = v.loan(spark, sf).select(
        "o_orderkey", "priority", "ka", "amount", "balance", planted.alias("planted"), *date_features("order_date", "t_", ["Yr", "Qtr"]))
    features = loans.loan_features(data, ["o_orderkey"], ["priority", "ka"], ["t_Yr", "t_Qtr"], ["amount", "balance"], "planted")
    models = loans.loan_classification(features, ["o_orderkey"])
    reports = {"first validation": models.first.report("validation"), "first test": models.first.report("test"),
               "final all": models.final.report("all"), "final test": models.final.report("test")}
    return out(union_vintages([df.withColumn("on", F.lit(name)) for name, df in reports.items()]))


_SOURCE_SQL = "(CAST(substr(source, 4) AS INTEGER) * 5) % 7 % 2"


@query("loans_binary_flow_planted", f"""SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted, count(planted) AS n
  FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS p)
  LEFT JOIN (SELECT planted FROM split WHERE part <> 'test') ON planted = a AND planted = p GROUP BY 1, 2""",
    v.LOAN_BINARY + f""",
classed AS (SELECT *, {_SOURCE_SQL} AS planted FROM loan_binary),
""" + split_sql("classed", "concat_ws('|', '75', CAST(doc_id AS VARCHAR))", "planted", 0.05, 0.20))
def loans_binary_flow_planted(spark, sf):
    """Boosted trees with the validation stop on a planted class of sources: a confusion without a wrong answer."""
    planted = F.substring("source", 4, 10).cast("int") * 5 % 7 % 2
    data = v.loan_binary(spark, sf).select(
        "doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), planted.alias("planted"))
    features = loans.loan_features(data, ["doc_id"], ["lang", "source"], [], ["n_chars"], "planted")
    return loans.loan_classification(features, ["doc_id"], "gbt").final.confusion("all")


@query("loans_binary_flow")
def loans_binary_flow(spark, sf):
    """Document quality by boosted trees with the validation stop; confusion on the training and validation rows."""
    data = v.loan_binary(spark, sf).select("doc_id", "lang", "source", F.col("n_chars").cast("double"), "quality")
    features = loans.loan_features(data, ["doc_id"], ["lang", "source"], [], ["n_chars"], "quality")
    return loans.loan_classification(features, ["doc_id"], "gbt").final.confusion("all")


_EARLY = "week_end < DATE '2000-01-01'"
_CODED = ["brand", "ka", "fsa", "Time_Yr", "Time_Mon"]


def _code_sql(c: str) -> str:
    """The place of a label among the early ones, or the place after the last."""
    return (f"coalesce((SELECT n FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS n FROM "
            f"(SELECT DISTINCT {c} FROM early)) WHERE x = late.{c}), (SELECT count(DISTINCT {c}) FROM early)) AS {c}_code")


@query("sales_new_rows", f"""SELECT brand, ka, fsa, segment, CAST(week_end AS VARCHAR) AS week_end, {', '.join(_code_sql(c) for c in _CODED)},
  {r('(population - (SELECT min(population) FROM early)) / (SELECT max(population) - min(population) FROM early) + 1', 'population')},
  {r('CAST(CAST(ln(1 + price) AS FLOAT) AS DOUBLE)', 'log_price', 4)}, true AS predicted FROM late""",
    v.POS + f""",
parts AS (SELECT *, CAST(year(week_end) AS INTEGER) AS "Time_Yr", CAST(month(week_end) AS INTEGER) AS "Time_Mon" FROM pos),
early AS (SELECT * FROM parts WHERE {_EARLY}),
late AS (SELECT * FROM parts WHERE NOT {_EARLY})""")
def sales_new_rows(spark, sf):
    """Fit on the weeks before 2000, save parameters and model, load them, and score the weeks since."""
    columns = sales.SalesColumns(time=("Time_Yr", "Time_Mon"))
    border = F.lit(date(2000, 1, 1))
    parts = date_features("week_end", "Time_", ["Yr", "Mon"])
    rows = materialize(
        v.pos(spark, sf).select(*columns.key, "segment", "population", "price", log_target("qty").alias("log_quantity"), *parts), "sales")
    early, late = rows.filter(F.col("week_end") < border), rows.filter(F.col("week_end") >= border)
    encoder = fit_encoder(early, [*columns.categorical, *columns.time])
    scaler = fit_minmax(early, ["population"], 1.0, 2.0)
    spec = FeatureSpec([f"{c}_code" for c in _CODED], ["population"], ["log_price"], "log_quantity")
    folder = scratch_path(spark, "fitted")
    fitted = sales.SalesFeatures(sales.NewSales(encoder, scaler).features(early, columns), spec, encoder, scaler)
    fitted.save(folder)
    save_model(train_regressor(fitted.rows, spec, "linear"), f"{folder}/model")
    loaded = sales.NewSales.load(spark, folder)
    features = loaded.features(late, columns)
    scored = score_table(load_model(f"{folder}/model"), features,
                         [*columns.key, "segment", *[f"{c}_code" for c in _CODED], "population", "log_price"])
    return out(scored.withColumn("predicted", F.col("prediction").isNotNull()).drop("prediction"), log_price=4)
