"""Exact duplicates, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.frames import having, lower_ascii, only
from weekloom.session import materialize

#: A digest is hot from this share of the rows on, so there are at most HOT_PARTS hot digests.
HOT_PARTS = 1000
SALTS = 64


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Groups of equal texts: one row per document with `keep_id`, `group_size`, `kept` and `text_sha256`.

    Texts are equal when they are identical after A-Z have been lower-cased; a null text counts as empty.
    The row with the largest id stays. A null id is smaller than any other. Rows that repeat an id and a
    text each count in `group_size`, and each of them is `kept` if the id stays; further columns are left
    out; an empty table gives an empty one.

    Rows are combined three times, each time by digest and full text: by Spark's partial aggregation
    where they are read, then by digest and salt, then over the salts of a digest. Only digests that hold
    a thousandth of all rows have more than one salt (there can be a thousand of them at most), so the
    texts of all others travel once. Which digests those are is found by a count over digests alone.
    """
    rows = only(docs, id_column, text_column).select(
        F.col(id_column).alias("doc_id"), lower_ascii(F.coalesce(F.col(text_column), F.lit(""))).alias("text")
    )
    digests = materialize(
        rows.select("doc_id", F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("second")), "digests"
    )
    total = digests.count()
    hot = [
        r["digest"]
        for r in digests.groupBy("digest").count().orderBy(F.desc("count"), "digest").limit(HOT_PARTS).collect()
        if r["count"] * HOT_PARTS >= total and r["count"] >= SALTS
    ]
    digest = F.sha2("text", 256)
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)
    # Salted by the digest-independent id: copies of one text spread over the salts.
    salted = rows.withColumn("digest", digest).withColumn(
        "salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0))
    )
    by_salt = salted.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    parts = materialize(by_salt, "salted") if hot else by_salt
    groups = parts.filter(~is_hot).select("digest", F.xxhash64("text").alias("second"), "keep_id", "group_size")
    if hot:
        winners = (
            parts.filter(is_hot)
            .groupBy("digest", "text")
            .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
            .select("digest", F.xxhash64("text").alias("second"), "keep_id", "group_size")
        )
        groups = groups.unionByName(winners)
    # Two digests name the group of a row; the groups themselves were told apart by their texts.
    return digests.join(groups, ["digest", "second"]).select(
        F.col("doc_id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Of rows that repeat both id and text all stay."""
    kept = exact_groups(docs, id_column, text_column).filter("kept").select(id_column)
    return having(docs, kept, id_column)
