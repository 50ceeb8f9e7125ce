"""Joins, aggregations, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import views as v
from queries.registry import out, query, r
from weekloom.operators import aggregates as agg
from weekloom.operators import joins, sets
from weekloom.operators.series import interpolate_linear
from weekloom.operators.shares import cumulative_share_cut
from weekloom.session import materialize

WEEK_KEYS = "province, fsa, CAST(week_end AS VARCHAR) AS week_end"


# ---- joins

@query("join_left", f"""SELECT a.province, a.fsa, CAST(a.week_end AS VARCHAR) AS week_end, {r('a.qty', 'qty')}, {r('b.price', 'price')}
  FROM (SELECT province, fsa, week_end, sum(qty) AS qty FROM pos GROUP BY 1, 2, 3) a
  LEFT JOIN (SELECT province, fsa, week_end, avg(price) AS price FROM pos WHERE segment = 'R' GROUP BY 1, 2, 3) b
  ON a.province = b.province AND a.fsa = b.fsa AND a.week_end = b.week_end""", v.POS)
def join_left(spark, sf):
    keys = ["province", "fsa", "week_end"]
    sold = agg.group_reduce(v.pos(spark, sf), keys, sums=["qty"])
    prices = agg.group_reduce(v.pos(spark, sf).filter(F.col("segment") == "R"), keys, means=["price"])
    return out(joins.join_left(sold, prices, keys))


_DEMO_JOIN = v.DEMO_WEEKS + ",\ndemo_week AS (" + v.weekly_select(v.LINEAR) + ")"


@query("join_left_diffkeys", f"""SELECT p.province, p.fsa, CAST(p.week_end AS VARCHAR) AS week_end, {r('p.qty', 'qty')},
  d.code AS "CODE", {r('d."Age Band 1"', '"Age Band 1"', 4)}, {r('d."Average Income"', '"Average Income"', 4)}
  FROM pos_week p LEFT JOIN demo_week d ON p.fsa = d.code AND p.week_end = d.week_end""", v.POS_WEEK + ",\n" + _DEMO_JOIN)
def join_left_diffkeys(spark, sf):
    weekly = v.pos_week(spark, sf).select("province", "fsa", "week_end", "qty")
    demo = interpolate_linear(v.demo(spark, sf), "CODE", "YEAR", ["Age Band 1", "Average Income"])
    joined = joins.join_left_diffkeys(
        weekly, demo.withColumnRenamed("week_end", "demo_week"), {"fsa": "CODE", "week_end": "demo_week"})
    return out(joined.drop("demo_week"), 4, qty=6)


SHARES = """judged AS (
  SELECT brand, ka, fsa, avg(price) AS price, sum(qty) AS qty, count(*) AS n, avg(price) * sum(qty) AS sales
  FROM pos WHERE year(week_end) = 2000 GROUP BY 1, 2, 3),
shares AS (SELECT *, sales / (SELECT sum(sales) FROM judged) AS sales_share FROM judged),
kept AS (SELECT * FROM (
  SELECT *, sum(sales_share) OVER (ORDER BY sales_share, brand, ka, fsa ROWS UNBOUNDED PRECEDING) AS cum_share
  FROM shares) WHERE cum_share >= 0.05)"""


@query("join_right_semi", f"""SELECT brand, ka, fsa, segment, CAST(week_end AS VARCHAR) AS week_end, {r('qty')}, {r('price')}
  FROM pos WHERE (brand, ka, fsa) IN (SELECT (brand, ka, fsa) FROM kept)""", v.POS + ",\n" + SHARES)
def join_right_semi(spark, sf):
    data = v.pos_rows(spark, sf, "brand", "ka", "fsa", "segment", "week_end", "qty", "price")
    kept = cumulative_share_cut(v.pos(spark, sf, 2000), v.SERIES, "price", "qty", 0.05)
    return out(joins.keep_keys(data, kept, v.SERIES))


@query("lookup_join", f"""SELECT brand, ka, fsa, segment, CAST(week_end AS VARCHAR) AS week_end, {r('qty')}, {r('mean_price', None, 4)}
  FROM pos JOIN (SELECT brand, avg(price) AS mean_price FROM pos GROUP BY 1) USING (brand)""", v.POS)
def lookup_join(spark, sf):
    data = v.pos_rows(spark, sf, "brand", "ka", "fsa", "segment", "week_end", "qty", "price")
    table = data.groupBy("brand").agg(F.avg("price").alias("mean_price"))
    joined = joins.join_left(data, table, ["brand"])
    return out(joined.select("brand", "ka", "fsa", "segment", "week_end", "qty", "mean_price"), mean_price=4)


@query("is_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN "
       "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def is_in(spark, sf):
    keys = v.table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("o_custkey"))
    return joins.keep_keys(v.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), keys, ["o_custkey"])


# ---- aggregations

@query("group_sum_mean", f"SELECT {WEEK_KEYS}, {r('sum(qty)', 'qty')}, {r('avg(price)', 'price')}, "
       f"{r('avg(population)', 'population')} FROM pos GROUP BY province, fsa, week_end", v.POS)
def group_sum_mean(spark, sf):
    return out(agg.group_reduce(v.pos(spark, sf), ["province", "fsa", "week_end"], ["qty"], ["price", "population"]))


@query("group_mean_sum", f"SELECT brand, ka, fsa, {r('avg(price)', 'price')}, {r('sum(qty)', 'qty')} FROM pos "
       "WHERE year(week_end) = 2000 GROUP BY 1, 2, 3", v.POS)
def group_mean_sum(spark, sf):
    year = v.pos(spark, sf, 2000)
    return out(agg.group_reduce(year, v.SERIES, sums=["qty"], means=["price"]))


@query("grand_total_share", f"SELECT brand, ka, fsa, {r('sales', None, 5)}, {r('sales_share', None, 9)} FROM shares",
       v.POS + ",\n" + SHARES)
def grand_total_share(spark, sf):
    year = v.pos(spark, sf, 2000)
    sales = agg.combination_sales(year, v.SERIES, "price", "qty")
    return out(sales.select(*v.SERIES, "sales", "sales_share"), sales=5, sales_share=9)


@query("value_counts", "SELECT brand, count(*) AS n, " + r("count(*) / (SELECT count(*) FROM pos)", "share")
       + " FROM pos GROUP BY 1", v.POS)
def value_counts(spark, sf):
    counts = agg.value_counts(v.pos(spark, sf), "brand")
    return out(counts).orderBy(F.desc("n"), "brand")


@query("null_audit", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS nulls FROM demo""" for c in ["CODE", "GEO", "YEAR", *v.MEASURES]),
    v.DEMO)
def null_audit(spark, sf):
    return agg.null_audit(v.demo(spark, sf))


@query("table_shape", "SELECT count(*) AS rows, 10 AS columns FROM pos", v.POS)
def table_shape(spark, sf):
    return agg.table_shape(v.pos(spark, sf))


@query("distinct_keys", "SELECT DISTINCT segment, fsa FROM pos", v.POS)
def distinct_keys(spark, sf):
    return agg.distinct_keys(v.pos(spark, sf), "segment", "fsa")


_TAX = "(SELECT *, CASE WHEN l_tax > 0 THEN l_tax END AS tax FROM lineitem)"


@query("cardinality", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INTEGER) AS "distinct" FROM {_TAX}"""
    for c in ("l_partkey", "l_returnflag", "tax")))
def cardinality(spark, sf):
    lines = v.table(spark, sf, "lineitem").withColumn("tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    return agg.cardinality(lines, ["l_partkey", "l_returnflag", "tax"])


_PROFILE = ["qty", "price", "population"]


@query("segment_profile", "SELECT segment, count(*) AS total_count, min(fsa) FILTER (place = 1) AS fsa, " + ", ".join(
    f"{r(f'avg({m})', f'{m}_mean', 4)}, {r(f'min({m})', f'{m}_min')}, {r(f'max({m})', f'{m}_max')}" for m in _PROFILE)
    + """ FROM pos JOIN (SELECT segment, fsa, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, fsa) AS place
  FROM pos GROUP BY 1, 2) USING (segment, fsa) GROUP BY 1""", v.POS)
def segment_profile(spark, sf):
    return out(agg.segment_profile(v.pos(spark, sf), "segment", "fsa", _PROFILE), **{f"{m}_mean": 4 for m in _PROFILE})


# The return flag that sold most in each year of a series: some series never lead with the first one.
LEAD_ROWS = """lead_rows AS (
  SELECT series, CAST(yr AS INTEGER) AS yr, qty, CASE segment WHEN 'A' THEN 'First' WHEN 'N' THEN 'Second' ELSE 'Third' END AS segment
  FROM (
    SELECT brand || '/' || ka || '/' || fsa AS series, year(week_end) AS yr, segment, sum(qty) AS qty,
      row_number() OVER (PARTITION BY brand || '/' || ka || '/' || fsa, year(week_end) ORDER BY sum(qty) DESC, segment) AS place
    FROM pos GROUP BY 1, 2, 3)
  WHERE place = 1)"""


def lead_rows(spark, sf):
    series = F.concat_ws("/", *v.SERIES)
    sold = v.pos(spark, sf).groupBy(series.alias("series"), F.year("week_end").alias("yr"), "segment").agg(
        F.sum("qty").alias("qty"))
    lead = sold.groupBy("series", "yr").agg(F.min_by(F.struct("segment", "qty"), F.struct(-F.col("qty"), "segment")).alias("top"))
    flag = F.col("top.segment")
    names = F.when(flag == "A", "First").when(flag == "N", "Second").otherwise("Third")
    return lead.select("series", "yr", F.col("top.qty").alias("qty"), names.alias("segment"))


@query("segment_key_share", "SELECT segment, count(DISTINCT series) AS keys, "
       + r("count(DISTINCT series) / (SELECT count(DISTINCT series) FROM lead_rows)", "key_share") + " FROM lead_rows GROUP BY 1",
       v.POS + ",\n" + LEAD_ROWS)
def segment_key_share(spark, sf):
    return out(agg.segment_key_share(lead_rows(spark, sf), "segment", "series"))


_CORR = ["qty", "price", "population"]


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT province, '{a}' AS a, '{b}' AS b, {r('max(1.0)' if a == b else f'corr({a}, {b})', 'r')} FROM pos_week GROUP BY 1"
    for a in _CORR for b in _CORR) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'all' AS province, '{a}' AS a, '{b}' AS b, {r('max(1.0)' if a == b else f'corr({a}, {b})', 'r')} FROM pos_week"
    for a in _CORR for b in _CORR), v.POS_WEEK)
def correlation_matrix(spark, sf):
    weekly = v.pos_week(spark, sf)
    whole = agg.correlation_matrix(weekly, _CORR).select(F.lit("all").alias("province"), "a", "b", "r")
    return out(agg.correlation_matrix(weekly, _CORR, by=["province"]).unionByName(whole))


@query("argmin_row", f"SELECT CAST(week_end AS VARCHAR) AS week_end, {r('qty')} FROM "
       "(SELECT week_end, sum(qty) AS qty FROM pos_week GROUP BY 1) ORDER BY qty, week_end LIMIT 1", v.POS_WEEK)
def argmin_row(spark, sf):
    return out(agg.argmin_row(agg.group_reduce(v.pos_week(spark, sf), ["week_end"], sums=["qty"]), "week_end", "qty"))


# ---- sorts

_ORDER = ["brand", "ka", "fsa", "segment", "week_end"]
_SORT_SQL = f"SELECT brand, ka, fsa, segment, CAST(week_end AS VARCHAR) AS week_end, {r('qty')} FROM pos "


@query("sort_multi", _SORT_SQL + "ORDER BY brand, ka, fsa, segment, pos.week_end", v.POS)
def sort_multi(spark, sf):
    return out(agg.sort_multi(v.pos(spark, sf).select(*_ORDER, "qty"), _ORDER))


@query("head", _SORT_SQL + "ORDER BY brand, ka, fsa, segment, pos.week_end LIMIT 5", v.POS)
def head(spark, sf):
    return out(agg.head(v.pos(spark, sf).select(*_ORDER, "qty"), _ORDER, 5))


@query("tail", _SORT_SQL + "ORDER BY brand DESC, ka DESC, fsa DESC, segment DESC, pos.week_end DESC LIMIT 5", v.POS)
def tail(spark, sf):
    return out(agg.tail(v.pos(spark, sf).select(*_ORDER, "qty"), _ORDER, 5))


# ---- set operations

@query("intersect_keys", "SELECT series FROM lead_rows WHERE segment = 'First' INTERSECT SELECT series FROM lead_rows WHERE segment = 'Second'",
       v.POS + ",\n" + LEAD_ROWS)
def intersect_keys(spark, sf):
    return sets.intersect_keys(lead_rows(spark, sf), "segment", "series", "First", "Second")


@query("overlap_resolve", f"""SELECT series, yr, {r('qty')}, was,
  CASE min(CASE was WHEN 'First' THEN 0 WHEN 'Second' THEN 1 ELSE 2 END) OVER (PARTITION BY series)
    WHEN 0 THEN 'First' WHEN 1 THEN 'Second' ELSE 'Third' END AS segment
  FROM (SELECT * RENAME (segment AS was) FROM lead_rows)""", v.POS + ",\n" + LEAD_ROWS)
def overlap_resolve(spark, sf):
    rows = materialize(
        lead_rows(spark, sf).select("series", "yr", "qty", F.col("segment").alias("was"), "segment"), "leading")
    return out(sets.overlap_resolve(rows, "segment", "series", ["First", "Second", "Third"]))
