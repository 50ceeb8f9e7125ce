"""Sources, sinks, schema, filters, scalar functions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from queries import views as v
from queries.registry import out, query, r
from weekloom import functions as fn
from weekloom.operators import aggregates, filters, schema
from weekloom.operators.scalers import Scaler, fit_minmax
from weekloom.operators.sets import union_vintages
from weekloom.session import materialize, scratch_path
from weekloom.sources import tables

KEYS = ["brand", "ka", "fsa", "segment", "week_end"]
KEYS_SQL = "brand, ka, fsa, segment, CAST(week_end AS VARCHAR) AS week_end"


# ---- sources and sinks

@query("scan_table", "SELECT l_returnflag, count(*) AS n, " + r("sum(l_quantity)", "quantity") + " FROM lineitem GROUP BY 1")
def scan_table(spark, sf):
    lines = tables.scan_table(spark, f"{sf}/lineitem.parquet")
    return out(lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")))


_MEASURES_SQL = ", ".join(r(f'"{m}"', f'"{m}"', 2) for m in v.MEASURES)


@query("scan_csv_vintages", f'SELECT "CODE", "GEO", "YEAR", {_MEASURES_SQL} FROM demo', v.DEMO)
def scan_csv_vintages(spark, sf):
    paths, schemas = {}, {}
    for year, vintage in v.demo_vintages(spark, sf).items():
        paths[year], schemas[year] = scratch_path(spark, f"csv-{year}"), vintage.schema
        vintage.write.csv(paths[year], header=True)
    return out(tables.scan_csv_vintages(spark, paths, v.DEMO_NAMES, schemas), 2)


@query("scan_features", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_features(spark, sf):
    return tables.scan_features(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "source", "n_chars"])


@query("write_table", f"SELECT {KEYS_SQL}, {r('qty')}, {r('price')} FROM pos", v.POS)
def write_table(spark, sf):
    target = scratch_path(spark, "pos")
    tables.write_table(v.pos(spark, sf).select(*KEYS, "qty", "price"), target, partition_by=["segment"])
    return out(spark.read.parquet(target).select(*KEYS, "qty", "price"))


_PARAMS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'minmax' AS kind, {r(f'min({c})', 'center')}, {r(f'max({c}) - min({c})', 'spread')}, "
    "CAST(1 AS DOUBLE) AS low, CAST(2 AS DOUBLE) AS high FROM pos"
    for c in ("population", "price")
)


@query("save_params", _PARAMS_SQL, v.POS)
def save_params(spark, sf):
    path = scratch_path(spark, "params")
    fit_minmax(v.pos(spark, sf), ["population", "price"]).save(spark, path)
    return out(spark.read.parquet(path))


@query(
    "load_params",
    f"SELECT {KEYS_SQL}, {r('(price - a) / (b - a) + 1', 'price')} "
    "FROM pos, (SELECT min(price) AS a, max(price) AS b FROM pos)",
    v.POS,
)
def load_params(spark, sf):
    path = scratch_path(spark, "params")
    data = v.pos_rows(spark, sf, *KEYS, "price")
    fit_minmax(data, ["price"]).save(spark, path)
    return out(Scaler.load(spark, path).transform(data))


# ---- projection and schema

@query(
    "clean_colnames",
    'SELECT "CODE", "YEAR", ' + ", ".join(r(f'"{m}"', m.replace(" ", "_"), 2) for m in v.MEASURES) + " FROM demo",
    v.DEMO,
)
def clean_colnames(spark, sf):
    quoted = v.demo(spark, sf).drop("GEO").withColumnRenamed("Average Income", 'Average "Income"')
    return out(schema.clean_colnames(quoted), 2)


@query("rename_vintage", f'SELECT "CODE", "GEO", {_MEASURES_SQL}, "YEAR" FROM demo', v.DEMO)
def rename_vintage(spark, sf):
    """Every vintage under its own vendor codes, renamed and stacked."""
    renamed = [
        schema.rename_vintage(df, year, v.DEMO_NAMES).withColumn("YEAR", F.lit(year))
        for year, df in v.demo_vintages(spark, sf).items()
    ]
    return out(union_vintages(renamed), 2)


# The six demographic files stand on six order years; measure i counts orders whose customer falls to it.
_FILES = dict(zip(schema.DEMOGRAPHIC_NAMES.prefixes, range(1995, 2001)))
_NAMES = list(schema.DEMOGRAPHIC_NAMES.suffixes.values())


def _name_sql(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@query("rename_demographics", """SELECT n_name AS "CODE", CAST(year(o_orderdate) + 21 AS INTEGER) AS "YEAR", """ + ", ".join(
    f"count(*) FILTER (o_custkey % {len(_NAMES)} = {i}) AS {_name_sql(name)}" for i, name in enumerate(_NAMES))
    + """ FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE year(o_orderdate) BETWEEN 1995 AND 2000 GROUP BY 1, 2""")
def rename_demographics(spark, sf):
    """All 41 measures of all six files, under each year's vendor codes, renamed and stacked."""
    orders = (
        v.table(spark, sf, "orders")
        .join(v.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(v.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    measure = [F.count_if(F.col("o_custkey") % len(_NAMES) == i).alias(f"m{i}") for i in range(len(_NAMES))]
    counts = materialize(
        orders.groupBy(F.col("n_name").alias("CODE"), F.year("o_orderdate").alias("year")).agg(*measure), "counts")
    files = []
    for year, ordered in _FILES.items():
        codes = {name: code for code, name in schema.DEMOGRAPHIC_NAMES.mapping(year).items()}
        file = counts.filter(F.col("year") == ordered).select(
            "CODE", *[F.col(f"m{i}").alias(codes[name]) for i, name in enumerate(_NAMES)])
        files.append(schema.add_literal(schema.rename_vintage(file, year), "YEAR", year))
    return union_vintages(files)


@query("rename_columns", "SELECT l_orderkey AS order_id, l_linenumber AS line, " + r("l_quantity", "sold") + " FROM lineitem")
def rename_columns(spark, sf):
    lines = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return out(schema.rename_columns(lines, {"l_orderkey": "order_id", "l_linenumber": "line", "l_quantity": "sold"}))


@query("select_columns", "SELECT o_orderkey, o_orderpriority, " + r("o_totalprice") + " FROM orders")
def select_columns(spark, sf):
    return out(schema.select_columns(v.table(spark, sf, "orders"), ["o_orderkey", "o_orderpriority", "o_totalprice"]))


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def drop_columns(spark, sf):
    return out(schema.drop_columns(v.table(spark, sf, "orders"), ["o_orderdate", "o_totalprice"]))


@query("add_literal", f'SELECT "CODE", "GEO", {_MEASURES_SQL}, "YEAR" FROM demo', v.DEMO)
def add_literal(spark, sf):
    tagged = [
        schema.add_literal(schema.rename_vintage(df, year, v.DEMO_NAMES), "YEAR", year)
        for year, df in v.demo_vintages(spark, sf).items()
    ]
    return out(union_vintages(tagged), 2)


@query("cast_numeric", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    r(c) for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem")
def cast_numeric(spark, sf):
    keys, numbers = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount"]
    text = v.table(spark, sf, "lineitem").select(*keys, *[F.col(c).cast("string").alias(c) for c in numbers])
    return out(schema.cast_numeric(text, keep=keys))


@query(
    "columns_by_type",
    "SELECT 0 AS position, 'province' AS \"column\", count(province) AS present FROM pos"
    " UNION ALL SELECT 1, 'fsa', count(fsa) FROM pos UNION ALL SELECT 2, 'brand', count(brand) FROM pos"
    " UNION ALL SELECT 3, 'ka', count(ka) FROM pos UNION ALL SELECT 4, 'segment', count(segment) FROM pos"
    " UNION ALL SELECT 8, 'inflation_text', count(inflation_text) FROM pos",
    v.POS,
)
def columns_by_type(spark, sf):
    data = v.pos(spark, sf)
    return aggregates.count_by_column(data, schema.columns_by_type(data))


@query(
    "assemble_features",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(
        r(c, f"f{i}") for i, c in enumerate(["CAST(l_linenumber AS DOUBLE)", "CAST(month(l_shipdate) AS DOUBLE)",
                                             "l_discount", "ln(1 + l_extendedprice)"])
    ) + ", " + r("l_tax", "weight") + " FROM lineitem",
)
def assemble_features(spark, sf):
    lines = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", F.month("l_shipdate").alias("month"),
        F.col("l_tax").alias("weight"), fn.log_target("l_extendedprice").alias("log_price"),
    )
    vectors = schema.assemble_features(
        lines, ["l_linenumber"], ["month"], ["l_discount"], ["log_price"], keep=["l_orderkey", "l_linenumber", "weight"]
    )
    values = vector_to_array("features")
    return out(vectors.select("l_orderkey", "l_linenumber", *[values[i].alias(f"f{i}") for i in range(4)], "weight"))


# ---- filters

@query("select_slice", f"SELECT brand, ka, fsa, CAST(week_end AS VARCHAR) AS week_end, {r('qty')}, {r('price')} "
       "FROM pos WHERE province = 'ASIA' AND segment = 'N'", v.POS)
def select_slice(spark, sf):
    sliced = filters.select_slice(v.pos(spark, sf), province="ASIA", segment="N")
    return out(sliced.select("brand", "ka", "fsa", "week_end", "qty", "price"))


@query("before_year", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ship_date "
       "FROM lineitem WHERE year(l_shipdate) < 2001")
def before_year(spark, sf):
    lines = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    kept = filters.before_year(lines, "l_shipdate", 2001)
    return out(kept.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("ship_date")))


@query("filter_level", f'SELECT "CODE", "YEAR", {_MEASURES_SQL} FROM demo WHERE "GEO" = \'EUROPE\'', v.DEMO)
def filter_level(spark, sf):
    return out(filters.filter_level(v.demo(spark, sf), "GEO", "EUROPE").drop("GEO"), 2)


@query("drop_nulls", f'SELECT "CODE", "GEO", "YEAR", {_MEASURES_SQL} FROM demo '
       'WHERE "Age Band 3" IS NOT NULL AND "Income Band 5" IS NOT NULL', v.DEMO)
def drop_nulls(spark, sf):
    return out(filters.drop_nulls(v.demo(spark, sf), ["Age Band 3", "Income Band 5"]), 2)


@query("inf_to_null", "SELECT l_orderkey, l_linenumber, " + r("CASE WHEN l_tax > 0 THEN l_discount / l_tax END", "ratio")
       + " FROM lineitem")
def inf_to_null(spark, sf):
    tax = F.col("l_tax")
    lines = v.table(spark, sf, "lineitem")
    # What a division without the ANSI error gives: infinite, or NaN for 0 / 0.
    ratio = (
        F.when(tax > 0, F.try_divide("l_discount", tax))
        .when(F.col("l_discount") > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("nan")))
    )
    return out(filters.infinite_to_null(lines.select("l_orderkey", "l_linenumber", ratio.alias("ratio"))))


@query("null_keys", 'SELECT DISTINCT "CODE" FROM demo WHERE "Average Balance" IS NULL', v.DEMO)
def null_keys(spark, sf):
    return filters.null_keys(v.demo(spark, sf), "CODE", "Average Balance")


# ---- scalar functions

@query("parse_percent", f"SELECT {KEYS_SQL}, " + r("CAST(replace(inflation_text, '%', '') AS DOUBLE)", "inflation")
       + " FROM pos", v.POS)
def parse_percent(spark, sf):
    return out(v.pos(spark, sf).select(*KEYS, fn.parse_percent("inflation_text").alias("inflation")))


@query("truncate_int", f"SELECT {KEYS_SQL}, CAST(trunc(population) AS BIGINT) AS population FROM pos", v.POS)
def truncate_int(spark, sf):
    return out(v.pos(spark, sf).select(*KEYS, fn.truncate_int("population").alias("population")))


@query("date_features", "SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS Time_Yr, "
       "CAST(week(l_shipdate) AS INTEGER) AS Time_Week, CAST(month(l_shipdate) AS INTEGER) AS Time_Mon, "
       "CAST(quarter(l_shipdate) AS INTEGER) AS Time_Qtr, CAST(dayofyear(l_shipdate) AS INTEGER) AS Time_Day FROM lineitem")
def date_features(spark, sf):
    parts = fn.date_features("l_shipdate", "Time_", ["Yr", "Week", "Mon", "Qtr", "Day"])
    return v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *parts)


@query("year_to_date", 'SELECT "CODE", "YEAR", CAST(make_date("YEAR", 1, 1) AS VARCHAR) AS start FROM demo', v.DEMO)
def year_to_date(spark, sf):
    return out(v.demo(spark, sf).select("CODE", "YEAR", fn.year_to_date("YEAR").alias("start")))


@query("log_features", f"SELECT {KEYS_SQL}, " + r("CAST(CAST(ln(1 + price) AS FLOAT) AS DOUBLE)", "log_price", 4) + ", "
       + r("CAST(CAST(ln(1 + qty) AS FLOAT) AS DOUBLE)", "log_qty", 4) + " FROM pos", v.POS)
def log_features(spark, sf):
    logs = [fn.log_plus_one(c).alias(f"log_{c}") for c in ("price", "qty")]
    return out(v.pos(spark, sf).select(*KEYS, *logs), 4)


@query("log_target", f"SELECT {KEYS_SQL}, {r('ln(1 + qty)', 'log_qty')}, {r('qty', 'back')} FROM pos", v.POS)
def log_target(spark, sf):
    logged = v.pos(spark, sf).select(*KEYS, fn.log_target("qty").alias("log_qty"))
    return out(logged.withColumn("back", fn.unlog("log_qty")))


_BANDS = {"Young": v.MEASURES[:2], "Old": v.MEASURES[2:5], "Low income": v.MEASURES[5:7], "High income": v.MEASURES[7:10]}


@query("band_sums", 'SELECT "CODE", "YEAR", ' + ", ".join(
    r(" + ".join(f'"{m}"' for m in parts), f'"{band}"', 2) for band, parts in _BANDS.items()) + " FROM demo", v.DEMO)
def band_sums(spark, sf):
    sums = [fn.band_sum(parts).alias(band) for band, parts in _BANDS.items()]
    return out(v.demo(spark, sf).select("CODE", "YEAR", *sums), 2)


@query("round_4", "SELECT l_orderkey, l_linenumber, " + r("l_extendedprice / 7", "price", 4) + " FROM lineitem")
def round_4(spark, sf):
    daily = F.col("l_extendedprice") / 7
    return v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.round_4(daily).alias("price"))


@query("percent_error", f"SELECT {KEYS_SQL}, " + r("100.0 * abs(qty - guess) / qty", "error") + ", "
       + r("100.0 * (qty - guess) / qty", "signed_error") + " FROM (SELECT *, 25.5 AS guess FROM pos)", v.POS)
def percent_error(spark, sf):
    guess = F.lit(25.5)
    return out(v.pos(spark, sf).select(
        *KEYS,
        fn.percent_error("qty", guess).alias("error"),
        fn.percent_error("qty", guess, signed=True).alias("signed_error"),
    ))


@query("clamp", "SELECT l_orderkey, l_linenumber, " + r("least(greatest(l_quantity, 4), 40)", "quantity") + " FROM lineitem")
def clamp(spark, sf):
    return out(v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", fn.clamp("l_quantity", 4.0, 40.0).alias("quantity")))


@query("threshold_class", "SELECT doc_id, " + r("score") + ", CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS guess FROM loan_binary",
       v.LOAN_BINARY)
def threshold_class(spark, sf):
    return out(v.loan_binary(spark, sf).select("doc_id", "score", fn.threshold_class("score").alias("guess")))


@query("label_name", "SELECT n_nationkey, n_name, CASE n_regionkey WHEN 0 THEN 'First' WHEN 1 THEN 'Second' END AS name, "
       "c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def label_name(spark, sf):
    joined = v.table(spark, sf, "customer").join(
        v.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("n_nationkey", "n_name", fn.label_name("n_regionkey", {0: "First", 1: "Second"}).alias("name"), "c_custkey")


@query("strip_prefix", "SELECT c_custkey, substr(c_name, 2) AS name FROM customer")
def strip_prefix(spark, sf):
    return v.table(spark, sf, "customer").select("c_custkey", fn.strip_prefix("c_name").alias("name"))


@query("ordered_category", "SELECT l_returnflag, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 WHEN 'A' THEN 2 END AS place, "
       "count(*) AS n FROM lineitem GROUP BY 1, 2")
def ordered_category(spark, sf):
    counted = v.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return counted.withColumn("place", fn.ordinal("l_returnflag", ["R", "N", "A"])).orderBy("place")


# ---- stacking

@query("union_vintages", f'SELECT "CODE", "GEO", "YEAR", {_MEASURES_SQL} FROM demo', v.DEMO)
def union_all_vintages(spark, sf):
    frames = [
        schema.add_literal(schema.rename_vintage(vintage, y, v.DEMO_NAMES), "YEAR", y)
        for y, vintage in v.demo_vintages(spark, sf).items()
    ]
    return out(union_vintages(frames), 2)
