"""Bindings: the given star-schema tables in the shapes the operators work on, in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.functions import week_ending
from weekloom.operators.filters import in_year
from weekloom.operators.schema import VintageNames, add_literal, rename_vintage
from weekloom.operators.sets import union_vintages
from weekloom.session import materialize, scratch_path

SERIES = ["brand", "ka", "fsa"]
# With the return flag, a week has one row.
FLAGGED = [*SERIES, "segment"]


_written: dict[str, str] = {}


def write_pos(spark: SparkSession, sf: str) -> None:
    """Write `pos` once; from then on queries over this data start from the written table, so that a
    benchmark times the operators and not the view."""
    path = scratch_path(spark, "pos")
    pos(spark, sf).write.parquet(path)
    _written[sf] = path


def week_range(year: int) -> tuple[datetime, datetime]:
    """The days, first one and one past the last, that belong to weeks whose Sunday lies in the year."""
    first, last = datetime(year, 1, 1), datetime(year, 12, 31)
    opens = first + timedelta(days=6 - first.weekday())
    closes = last - timedelta(days=(last.weekday() + 1) % 7)
    return opens - timedelta(days=6), closes + timedelta(days=1)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def half_up(c: Column, scale: int) -> Column:
    """Rounding by floor, with halves lifted a little so that the order of a sum cannot tip them."""
    return F.floor(c * scale + 0.500001).cast("double") / scale


def pos(spark: SparkSession, sf: str, year: int | None = None) -> DataFrame:
    """Weekly sales by region, nation, brand, market segment and return flag.

    The names are grouping columns, so a filter on any of them reaches the scans and joins below. With
    `year`, the weeks that end in it: as two dates on the ship date, which the scan can prune by.
    """
    if sf in _written:
        rows = spark.read.parquet(_written[sf])
        return rows if year is None else in_year(rows, "week_end", year)
    lines = table(spark, sf, "lineitem")
    if year is not None:
        days = week_range(year)
        lines = lines.filter((F.col("l_shipdate") >= F.lit(days[0])) & (F.col("l_shipdate") < F.lit(days[1])))
    area = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    joined = (
        lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(area, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.groupBy(
        F.col("r_name").alias("province"),
        F.col("n_name").alias("fsa"),
        F.col("p_brand").alias("brand"),
        F.col("c_mktsegment").alias("ka"),
        F.col("l_returnflag").alias("segment"),
        week_ending("l_shipdate").alias("week_end"),
    ).agg(
        F.sum("l_quantity").alias("qty"),
        half_up(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 100).alias("price"),
        F.concat(half_up(F.avg("l_tax") * 100, 10).cast("string"), F.lit("%")).alias("inflation_text"),
        half_up(F.avg("c_acctbal"), 100).alias("population"),
    )


def pos_rows(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of `pos` as a written table, for operators that go over their input more than once."""
    return materialize(pos(spark, sf).select(*columns), "pos")


POS = """pos AS (
  SELECT r_name AS province, n_name AS fsa, p_brand AS brand, c_mktsegment AS ka, l_returnflag AS segment,
         CAST(l_shipdate AS DATE) + CAST(7 - isodow(CAST(l_shipdate AS DATE)) AS INTEGER) AS week_end,
         sum(l_quantity) AS qty,
         floor(avg(l_extendedprice / l_quantity) * 100 + 0.500001) / 100 AS price,
         CAST(floor(avg(l_tax) * 100 * 10 + 0.500001) / 10 AS VARCHAR) || '%' AS inflation_text,
         floor(avg(c_acctbal) * 100 + 0.500001) / 100 AS population
  FROM lineitem JOIN part ON l_partkey = p_partkey
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4, 5, 6)"""


def pos_week(spark: SparkSession, sf: str) -> DataFrame:
    """`pos` with one row per region, nation and week."""
    return (
        pos(spark, sf)
        .groupBy("province", "fsa", "week_end")
        .agg(
            F.sum("qty").alias("qty"),
            half_up(F.avg("price"), 100).alias("price"),
            half_up(F.avg("population"), 100).alias("population"),
        )
    )


POS_WEEK = POS + """,
pos_week AS (
  SELECT province, fsa, week_end, sum(qty) AS qty,
         floor(avg(price) * 100 + 0.500001) / 100 AS price,
         floor(avg(population) * 100 + 0.500001) / 100 AS population
  FROM pos GROUP BY 1, 2, 3)"""

DEMO_YEARS = range(1995, 2002)

# Bands: order priorities, and ranges of the order value (lowest included), open at both ends. Fixed values.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRICE_RANGES = ["-Infinity", 100_000, 200_000, 300_000, 400_000, "Infinity"]

DEMO_NAMES = VintageNames(
    prefixes={y: f"D{y % 100:02d}_" for y in DEMO_YEARS},
    suffixes={
        **{f"AGE{i}": f"Age Band {i}" for i in range(1, 6)},
        **{f"INC{i}": f"Income Band {i}" for i in range(1, 6)},
        "AVGBAL": "Average Balance",
        "AVGINC": "Average Income",
    },
    exceptions={1998: {"AVGINC": "D99_AVGINC"}},
)
MEASURES = list(DEMO_NAMES.suffixes.values())
# Suffixes that a year's file does not have: a first, a middle and a last year.
MISSING = {1995: "AVGBAL", 1997: "AGE3", 2001: "INC5"}


def demo_vintages(spark: SparkSession, sf: str) -> dict[int, DataFrame]:
    """Yearly figures per nation, one frame per year under that year's column names."""
    price = F.col("o_totalprice")
    figures = {f"AGE{i}": F.count_if(F.col("o_orderpriority") == p).cast("double") for i, p in enumerate(PRIORITIES, 1)}
    for i, (low, high) in enumerate(zip(PRICE_RANGES, PRICE_RANGES[1:]), 1):
        inside = (price >= F.lit(low).cast("double")) & (price < F.lit(high).cast("double"))
        figures[f"INC{i}"] = F.round(F.sum(F.when(inside, price).otherwise(0.0)), 2)
    figures["AVGBAL"] = half_up(F.avg("c_acctbal"), 100)
    figures["AVGINC"] = half_up(F.avg("o_totalprice"), 100)
    grouped = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.year("o_orderdate").alias("year"))
        .agg(*[x.alias(s) for s, x in figures.items()])
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_name").alias("CODE"), F.col("r_name").alias("GEO"), "year", *figures)
    )
    yearly = materialize(grouped, "yearly")
    return {y: _vintage(yearly, y) for y in DEMO_YEARS}


def _vintage(yearly: DataFrame, year: int) -> DataFrame:
    vendor = {name: code for code, name in DEMO_NAMES.mapping(year).items()}
    return yearly.filter(F.col("year") == year).select(
        "CODE",
        "GEO",
        *[F.col(s).alias(vendor[name]) for s, name in DEMO_NAMES.suffixes.items() if s != MISSING.get(year)],
    )


def demo(spark: SparkSession, sf: str) -> DataFrame:
    """All vintages, renamed, tagged and stacked."""
    return union_vintages(
        [add_literal(rename_vintage(df, y, DEMO_NAMES), "YEAR", y) for y, df in demo_vintages(spark, sf).items()]
    )


def _demo_sql() -> str:
    price = "o_totalprice"
    figures = {f"AGE{i}": f"CAST(count(*) FILTER (o_orderpriority = '{p}') AS DOUBLE)" for i, p in enumerate(PRIORITIES, 1)}
    for i, (low, high) in enumerate(zip(PRICE_RANGES, PRICE_RANGES[1:]), 1):
        figures[f"INC{i}"] = f"round(sum(CASE WHEN {price} >= CAST('{low}' AS DOUBLE) AND {price} < CAST('{high}' AS DOUBLE) THEN {price} ELSE 0.0 END), 2)"
    figures["AVGBAL"] = "floor(avg(c_acctbal) * 100 + 0.500001) / 100"
    figures["AVGINC"] = "floor(avg(o_totalprice) * 100 + 0.500001) / 100"
    without = {s: y for y, s in MISSING.items()}
    columns = [
        (f"CASE WHEN year(o_orderdate) <> {without[s]} THEN {x} END" if s in without else x)
        + f' AS "{DEMO_NAMES.suffixes[s]}"'
        for s, x in figures.items()
    ]
    return f"""demo AS (
  SELECT n_name AS "CODE", r_name AS "GEO", CAST(year(o_orderdate) AS INTEGER) AS "YEAR",
         {(',' + chr(10) + '         ').join(columns)}
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  GROUP BY n_name, r_name, year(o_orderdate))"""


DEMO = _demo_sql()


def _weekly_sql() -> str:
    """Weekly values by definition: for every week of a code, look up the known points around it."""
    grid = """points AS (
  SELECT "CODE" AS code, jan1 + CAST(7 - isodow(jan1) AS INTEGER) AS week_end, * EXCLUDE ("CODE", jan1)
  FROM (SELECT *, make_date("YEAR", 1, 1) AS jan1 FROM demo)),
spans AS (SELECT code, min(week_end) AS a, max(week_end) AS b FROM points GROUP BY 1),
weeks AS (
  SELECT code, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_end
  FROM spans)"""
    parts = []
    for i, m in enumerate(MEASURES):
        parts.append(
            f""",
known{i} AS (SELECT code, week_end AS w0, "{m}" AS v0,
    lead(week_end) OVER (PARTITION BY code ORDER BY week_end) AS w1,
    lead("{m}") OVER (PARTITION BY code ORDER BY week_end) AS v1
  FROM points WHERE "{m}" IS NOT NULL)"""
        )
    return grid + "".join(parts)


DEMO_WEEKS = DEMO + ",\n" + _weekly_sql()


def weekly_select(value: str) -> str:
    """Weekly values; `value` is a template over v0, v1, w0, w1 and the week."""
    columns, joins = [], []
    for i, m in enumerate(MEASURES):
        columns.append(f'{value.format(k=f"k{i}")} AS "{m}"')
        joins.append(
            f"LEFT JOIN known{i} AS k{i} ON k{i}.code = weeks.code AND k{i}.w0 <= weeks.week_end "
            f"AND (weeks.week_end < k{i}.w1 OR k{i}.w1 IS NULL)"
        )
    return f"SELECT weeks.code, weeks.week_end, {', '.join(columns)} FROM weeks\n" + "\n".join(joins)


LINEAR = (
    "{k}.v0 + coalesce(({k}.v1 - {k}.v0) * date_diff('day', {k}.w0, weeks.week_end)"
    " / date_diff('day', {k}.w0, {k}.w1), 0.0)"
)
FORWARD = "{k}.v0"


def loan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        "o_orderkey",
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("ka"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").alias("amount"),
        F.col("c_acctbal").alias("balance"),
        F.col("o_orderstatus").alias("status"),
    )


LOAN = """loan AS (
  SELECT o_orderkey, o_orderpriority AS priority, c_mktsegment AS ka, CAST(o_orderdate AS DATE) AS order_date,
         o_totalprice AS amount, c_acctbal AS balance, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def loan_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a quality label; `score` and `guess` stand in for a model's output."""
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    score = F.col("n_chars") / (F.col("n_chars") + 1000)
    return joined.select(
        "doc_id", "lang", "source", "n_chars", "quality", half_up(score, 100).alias("score")
    ).withColumn("guess", F.rint("score").cast("int"))


LOAN_BINARY = """loan_binary AS (
  SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS guess FROM (
    SELECT documents.doc_id, lang, source, n_chars, quality,
           floor(n_chars / (n_chars + 1000) * 100 + 0.500001) / 100 AS score
    FROM documents JOIN labels ON documents.doc_id = labels.doc_id))"""
