"""The operators of this folder bound to the test tables, next to their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm import (
    bpe,
    chat,
    contamination,
    exact,
    html,
    language,
    lines,
    neardup,
    quality,
    repeats,
    runs,
    search,
    sharding,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = 24


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(column: str = "doc_id") -> Column:
    """Documents that no model learns from."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


@query("op1_vector_packing")
def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.pack_documents(table(spark, sf_dir, "documents"), SHARDS)
    return packed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query("op2_pair_index_bpe")
def op2_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), TOKENIZER)


@query(
    "op3_odd_sketch_minhash",
    """WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, w[p] || ' ' || coalesce(w[p + 1], '') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS p FROM w WHERE len(w) > 0)
    ), n AS (
        SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), c AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL
    ), l AS (
        SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
    ), e AS (
        SELECT a, b FROM l UNION ALL SELECT b, a FROM l
    ), r(doc_id, m) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b
    )
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(m) AS component_id, doc_id = min(m) AS kept
    FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
)
def op3_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@query("op4_output_codes_language")
def op4_output_codes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~held_out()))
    return language.identify(docs, model).withColumn("held_out", held_out())


_HIT_SQL = """WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    ), i AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
    ), v AS (
        SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS p FROM i WHERE len(w) > 0)
    ), x AS (
        SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM v))
    ), o AS (
        SELECT doc_id, item_id, p, n FROM x JOIN v USING (n, g)
    ), h AS (
        SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM o) GROUP BY doc_id
    ), m AS (
        SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
        FROM o GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query("op5_training_suffix_arrays", _HIT_SQL)
def op5_training_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    "op6_salted_exact_dedup",
    """WITH t AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n
        FROM documents
    )
    SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
        doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
    FROM t""",
)
def op6_salted_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query(
    "op7_winnowed_seed_extend",
    """WITH d AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), x AS (
        SELECT doc_id, p, md5(array_to_string(w[p : p + 19], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)
    ), r AS (
        SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM x) WHERE n > 1
    ), q AS (
        SELECT doc_id, list(DISTINCT p + k) AS gone FROM r, range(20) t(k) GROUP BY doc_id
    ), e AS (
        SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)
    ), k AS (
        SELECT e.doc_id, string_agg(word, ' ' ORDER BY p) AS kept
        FROM e LEFT JOIN (SELECT doc_id, unnest(gone) AS p, true AS out FROM q) o USING (doc_id, p) WHERE out IS NULL GROUP BY e.doc_id
    )
    SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN q USING (doc_id) LEFT JOIN k USING (doc_id)""",
)
def op7_winnowed_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(table(spark, sf_dir, "documents"), digests=True)


@query(
    "op8_snapshot_collapse",
    """WITH t AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place
        FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
    ), r AS (
        SELECT conv_id, place, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place)
            OVER (PARTITION BY conv_id ORDER BY place) AS said
        FROM t
    ), c AS (
        SELECT conv_id, max(place) AS turns, arg_max(said, place) AS rendered FROM r GROUP BY conv_id
    ), short AS (
        SELECT DISTINCT said FROM r JOIN c USING (conv_id) WHERE place < turns
    )
    SELECT min(conv_id) AS conv_id, turns, count(*) AS copies, rendered
    FROM c WHERE rendered NOT IN (SELECT said FROM short) GROUP BY rendered, turns""",
)
def op8_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_conversations(table(spark, sf_dir, "conversations"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    labels = table(spark, sf_dir, "labels")
    return quality.train(table(spark, sf_dir, "documents"), labels.filter(~held_out()))


@query("op10_naive_bayes_support_vectors")
def op10_naive_bayes_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int")).withColumn("held_out", held_out())


@query("op9_boosted_dom_trees")
def op9_boosted_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages))


def with_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document, by its hash, goes on with one period from some word on."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size("words")
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = F.floor(1 + (n - F.col("a")) / (3 + F.pmod(g, F.lit(8)))).cast("int")
    tail = F.transform(
        F.sequence(F.col("a"), n - 1), lambda i: F.get("words", F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
    )
    periodic = F.array_join(F.concat(F.slice("words", 1, F.col("a")), tail), " ")
    chosen = docs.withColumn("words", F.when(F.pmod(h, F.lit(10)) == 0, words)).withColumn("a", a).withColumn("p", p)
    return chosen.select("doc_id", F.when(n > 0, periodic).otherwise(F.col("text")).alias("text"))


@query(
    "op11_suffix_tree_runs",
    """WITH t AS (
        SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(k))
    ), h AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
            xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
        FROM documents, t
    ), a AS (
        SELECT *, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM h
    ), d AS (
        SELECT doc_id, CASE WHEN h % 10 = 0 THEN list_transform(range(len(w)),
            lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // k) END]) ELSE w END AS w
        FROM a
    ), e AS (
        SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM d
    ), m AS (
        SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS g
        FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
    ), s AS (
        SELECT doc_id, q, min(i) AS i, count(*) + q AS n FROM m GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(24, 3 * q)
    ), r AS (
        SELECT doc_id, i, n, min(q) AS q FROM s GROUP BY doc_id, i, n
    ), b AS (
        SELECT doc_id, count(*) AS n_runs, arg_min({'i': i, 'n': n, 'q': q}, {'x': -n / q, 'i': i, 'q': q}) AS b,
            string_agg(concat(i, ',', n, ',', q, chr(10)), '' ORDER BY i, q) AS listed FROM r GROUP BY doc_id
    ), o AS (
        SELECT DISTINCT doc_id, unnest(range(i + q, i + n)) AS i, true AS gone FROM r
    ), c AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e LEFT JOIN o USING (doc_id, i) WHERE gone IS NULL GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.i AS start, b.n AS length, b.q AS period, 1000 * b.n // b.q AS exponent_milli,
        sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)""",
)
def op11_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(with_periods(table(spark, sf_dir, "documents")))
    exponent = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"] / r["period"], -r["start"], -r["period"], r["length"]))
    )
    best = found.withColumn("best", exponent)
    start, length, period = -F.col("best.col2"), F.col("best.length"), -F.col("best.col3")
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


@query(
    "op12_perfect_hash_lines",
    """WITH l AS (
        SELECT doc_id, p, s[p] AS line, regexp_replace(translate(s[p], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS k
        FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS p
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
    ), c AS (
        SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
    FROM l LEFT JOIN c USING (k) GROUP BY doc_id""",
)
def op12_perfect_hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_common_lines(table(spark, sf_dir, "documents"))
    n_dropped = F.size("dropped").cast("bigint")
    return kept.select(
        "doc_id", "n_lines", n_dropped.alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query(
    "op13_range_maximum_search",
    """WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
    ), i AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
    ), s AS (
        SELECT count(*) FILTER (len(w) > 0) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d
    ), p AS (
        SELECT doc_id, n, term, count(*) AS tf
        FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN i USING (term) GROUP BY ALL
    ), f AS (
        SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term
    ), x AS (
        SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l))))) AS BIGINT) AS score
        FROM i JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL
    ), r AS (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM x WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
)
def op13_range_maximum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
