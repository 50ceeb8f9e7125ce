"""Encoders, scalers, weights, bins and the split."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import views as v
from queries.registry import out, query, r
from weekloom.functions import date_features
from weekloom.operators import encoders, scalers, weights
from weekloom.operators.aggregates import value_counts
from weekloom.session import scratch_path

KEYS = ["brand", "ka", "fsa", "segment", "week_end"]
KEYS_SQL = "brand, ka, fsa, segment, CAST(pos.week_end AS VARCHAR) AS week_end"


def code_sql(source: str, column: str) -> str:
    return f"(SELECT {column}, CAST(row_number() OVER (ORDER BY {column}) - 1 AS INTEGER) AS {column}_code FROM (SELECT DISTINCT {column} FROM {source}))"


@query("encode_categorical", f"SELECT {KEYS_SQL}, brand_code, ka_code, fsa_code FROM pos"
       + "".join(f" JOIN {code_sql('pos', c)} AS d_{c} USING ({c})" for c in v.SERIES), v.POS)
def encode_categorical(spark, sf):
    data = v.pos_rows(spark, sf, *KEYS)
    return out(encoders.fit_encoder(data, v.SERIES).transform(data))


_TIME = """timed AS (SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS t_Yr,
  CAST(week(l_shipdate) AS INTEGER) AS t_Week, CAST(month(l_shipdate) AS INTEGER) AS t_Mon,
  CAST(quarter(l_shipdate) AS INTEGER) AS t_Qtr FROM lineitem)"""
_TIMES = ["t_Yr", "t_Week", "t_Mon", "t_Qtr"]


def _timed(spark, sf):
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", *date_features("l_shipdate", "t_", ["Yr", "Week", "Mon", "Qtr"]))


@query("encode_time", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{c}, {c}_code" for c in _TIMES) + " FROM timed"
       + "".join(f" JOIN {code_sql('timed', c)} AS d_{c} USING ({c})" for c in _TIMES), _TIME)
def encode_time(spark, sf):
    data = _timed(spark, sf)
    return encoders.fit_encoder(data, _TIMES).transform(data)


@query("embedding_sizes", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct", least(greatest(count(DISTINCT {c}), {low}), {high}) AS size FROM {t}"""
    for c, t, low, high in [("brand", "pos", 4, 50), ("ka", "pos", 4, 50), ("fsa", "pos", 4, 50), ("province", "pos", 4, 50),
                            ("t_Yr", "posyear", 3, 12), ("t_Mon", "posyear", 3, 12)]),
    v.POS + ",\nposyear AS (SELECT year(week_end) AS t_Yr, month(week_end) AS t_Mon FROM pos)")
def embedding_sizes(spark, sf):
    data = v.pos(spark, sf).select("brand", "ka", "fsa", "province", *date_features("week_end", "t_", ["Yr", "Mon"]))
    return encoders.embedding_sizes(data, ["brand", "ka", "fsa", "province"], ["t_Yr", "t_Mon"])


@query("encode_target", f"SELECT o_orderkey, status, status_code FROM loan JOIN {code_sql('loan', 'status')} AS d USING (status)", v.LOAN)
def encode_target(spark, sf):
    data = v.loan(spark, sf).select("o_orderkey", "status")
    return encoders.fit_encoder(data, ["status"]).transform(data)


@query("transform_new_data", f"""SELECT l_orderkey, l_linenumber, p_brand, p_type, brand_code, type_code, {r('qty', 'l_quantity')} FROM (
  SELECT l_orderkey, l_linenumber, p_brand, p_type, b.code AS brand_code, t.code AS type_code, (l_quantity - s.a) / (s.b - s.a) * 2 + 1 AS qty
  FROM lines LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_brand AS v FROM old)) b ON p_brand = b.v
  LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_type AS v FROM old)) t ON p_type = t.v,
  (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM old) s WHERE year(l_shipdate) >= 1996)""",
  """lines AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey),
old AS (SELECT * FROM lines WHERE year(l_shipdate) < 1996 AND p_brand <> 'Brand#7' AND l_quantity < 40)""")
def transform_new_data(spark, sf):
    """Parameters from early rows that lack one brand and the large quantities, saved, then put to the later rows."""
    lines = v.table(spark, sf, "lineitem").join(v.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "p_brand", "p_type")
    start = F.lit("1996-01-01").cast("timestamp_ntz")
    old = lines.filter((F.col("l_shipdate") < start) & (F.col("p_brand") != "Brand#7") & (F.col("l_quantity") < 40))
    paths = [scratch_path(spark, "dictionary"), scratch_path(spark, "params")]
    encoders.fit_encoder(old, ["p_brand", "p_type"]).save(paths[0])
    scalers.fit_minmax(old, ["l_quantity"], 1.0, 3.0).save(spark, paths[1])
    new = lines.filter(F.col("l_shipdate") >= start).drop("l_shipdate")
    coded = encoders.Encoder.load(spark, paths[0]).transform(new)
    scaled = scalers.Scaler.load(spark, paths[1]).transform(coded)
    return out(scaled.withColumnsRenamed({"p_brand_code": "brand_code", "p_type_code": "type_code"}))


# ---- scalers

_CONT = ["population", "price"]


def _scaled_sql(center: str, spread: str, low=0.0, high=1.0, columns=_CONT) -> str:
    """`center` and `spread` are templates over a column name."""
    fits = ", ".join(f"{center.format(c=c)} AS c_{c}, {spread.format(c=c)} AS s_{c}" for c in columns)
    values = ", ".join(r(f"({c} - c_{c}) / s_{c} * {high - low} + {low}", c) for c in columns)
    return f"SELECT {KEYS_SQL}, {values} FROM pos, (SELECT {fits} FROM pos)"


@query("scale_minmax", _scaled_sql("min({c})", "(max({c}) - min({c}))", 1.0, 2.0), v.POS)
def scale_minmax(spark, sf):
    data = v.pos_rows(spark, sf, *KEYS, *_CONT)
    return out(scalers.fit_scaler(data, _CONT, "minmax", low=1, high=2).transform(data))


@query("scale_standard", _scaled_sql("avg({c})", "stddev_pop({c})"), v.POS)
def scale_standard(spark, sf):
    data = v.pos_rows(spark, sf, *KEYS, *_CONT)
    return out(scalers.fit_scaler(data, _CONT, "standard").transform(data))


@query("scale_robust", _scaled_sql("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1))"), v.POS)
def scale_robust(spark, sf):
    data = v.pos_rows(spark, sf, *KEYS, *_CONT)
    return out(scalers.fit_scaler(data, _CONT, "robust").transform(data))


@query("scale_target", _scaled_sql("min({c})", "(max({c}) - min({c}))", 1.0, 2.0, ["qty"]), v.POS)
def scale_target(spark, sf):
    data = v.pos_rows(spark, sf, *KEYS, "qty")
    return out(scalers.fit_scaler(data, ["qty"], "minmax", low=1, high=2).transform(data))


@query("unscale_minmax", f"SELECT {KEYS_SQL}, {r('population')}, {r('price')} FROM pos", v.POS)
def unscale_minmax(spark, sf):
    data = v.pos_rows(spark, sf, *KEYS, *_CONT)
    scaler = scalers.fit_minmax(data, _CONT, 0.0, 1.0)
    return out(scaler.inverse(scaler.transform(data)))


# ---- weights, bins, split

def paired_sql(label: str, source: str, scaled: bool) -> str:
    value = "0.8 + (share - min(share) OVER ()) / (max(share) OVER () - min(share) OVER ()) * (1.2 - 0.8)" if scaled else "share"
    return f"""counts AS (SELECT {label}, count(*) AS n, count(*) / (SELECT count(*) FROM {source}) AS share FROM {source} GROUP BY 1),
ranked AS (SELECT {label}, n, share, {value} AS value, row_number() OVER (ORDER BY n DESC, {label}) AS rank, count(*) OVER () AS size FROM counts),
paired AS (SELECT a.{label}, a.n, a.share, a.rank, b.value AS weight FROM ranked a JOIN ranked b ON b.rank = a.size + 1 - a.rank)"""


@query("rank_pairing", f"SELECT brand, n, {r('share')}, CAST(rank AS BIGINT) AS rank, {r('weight')} FROM paired",
       v.POS + ",\n" + paired_sql("brand", "pos", False))
def rank_pairing(spark, sf):
    return out(weights.rank_pairing(value_counts(v.pos(spark, sf), "brand"), "brand", "share"))


@query("sample_weights", f"SELECT {KEYS_SQL}, {r('weight')} FROM pos JOIN paired USING (brand)",
       v.POS + ",\n" + paired_sql("brand", "pos", True))
def sample_weights(spark, sf):
    data = v.pos_rows(spark, sf, *KEYS)
    return out(weights.add_weights(data, weights.sample_weights(data, "brand"), "brand"))


@query("class_weights", f"SELECT doc_id, quality, {r('weight')} FROM loan_binary JOIN paired USING (quality)",
       v.LOAN_BINARY + ",\n" + paired_sql("quality", "loan_binary", False))
def class_weights(spark, sf):
    data = v.loan_binary(spark, sf).select("doc_id", "quality")
    return out(weights.add_weights(data, weights.class_weights(data, "quality"), "quality"))


_BINS = """edges AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3 FROM pos),
binned AS (SELECT pos.*, CASE WHEN price <= q1 THEN 0 WHEN price <= q2 THEN 1 WHEN price <= q3 THEN 2 ELSE 3 END AS bin FROM pos, edges)"""


@query("quantile_bins", f"SELECT {KEYS_SQL.replace('pos.week_end', 'binned.week_end')}, {r('price')}, bin FROM binned", v.POS + ",\n" + _BINS)
def quantile_bins(spark, sf):
    return out(weights.quantile_bins(v.pos_rows(spark, sf, *KEYS, "price"), "price", 4))


def split_sql(source: str, key: str, stratum: str, test: float, validation: float) -> str:
    """Quotas by largest remainder for what stays in, then rows in the order of their hash."""
    return f"""strata AS (SELECT {stratum} AS s, count(*) AS n FROM {source} GROUP BY 1),
t1 AS (SELECT sum(n) - ceil({test} * sum(n)) AS draws, sum(n) AS total FROM strata),
q1 AS (SELECT s, n, n * draws / total AS exact, draws FROM strata, t1),
r1 AS (SELECT s, n, CAST(floor(exact) AS BIGINT) + CASE WHEN
    row_number() OVER (ORDER BY exact - floor(exact) DESC, CAST(s AS VARCHAR)) <= draws - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS rest FROM q1),
t2 AS (SELECT sum(rest) - ceil({validation} * sum(rest)) AS draws, sum(rest) AS total FROM r1),
q2 AS (SELECT s, n, rest, rest * draws / total AS exact, draws FROM r1, t2),
r2 AS (SELECT s, n, rest, CAST(floor(exact) AS BIGINT) + CASE WHEN
    row_number() OVER (ORDER BY exact - floor(exact) DESC, CAST(s AS VARCHAR)) <= draws - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS train FROM q2),
placed AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY md5({key})) AS place FROM {source}),
split AS (SELECT placed.*, CASE WHEN place <= n - rest THEN 'test' WHEN place <= n - train THEN 'validation' ELSE 'train' END AS part
  FROM placed JOIN r2 ON {stratum} = s)"""


@query("stratified_split", "SELECT o_orderkey, status, part FROM split",
       v.LOAN + ",\n" + split_sql("loan", "concat_ws('|', '75', CAST(o_orderkey AS VARCHAR))", "status", 0.05, 0.20))
def stratified_split(spark, sf):
    data = v.loan(spark, sf).select("o_orderkey", "status")
    return weights.stratified_split(data, ["o_orderkey"], "status", test=0.05, validation=0.20)


@query("stratified_split_quartiles", f"SELECT {KEYS_SQL.replace('pos.week_end', 'split.week_end')}, bin, part FROM split",
       v.POS + ",\n" + _BINS + ",\n" + split_sql(
           "binned", "concat_ws('|', '75', brand, ka, fsa, segment, CAST(week_end AS VARCHAR))", "bin", 0.05, 0.15))
def stratified_split_quartiles(spark, sf):
    binned = weights.quantile_bins(v.pos_rows(spark, sf, *KEYS, "price"), "price", 4)
    return out(weights.stratified_split(binned, KEYS, "bin", test=0.05, validation=0.15).drop("price"))
