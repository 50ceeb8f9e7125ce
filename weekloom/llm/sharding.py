"""Documents into shards of equal size, by vector bin packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.frames import only
from weekloom.session import materialize

#: Light groups are bundled by a hash of their text into this many bundles.
BUNDLES = 1 << 14
#: A group that holds this part of all bytes, tokens or rows is placed by itself: 3 * HEAVY groups at most.
HEAVY = 4096
MEASURES = ("bytes", "tokens", "rows")


#: Bytes count so many times as much as tokens and rows when shards swap items.
BYTES_FIRST = 16
#: Of each shard so many of its smallest items can be swapped.
SWAPPED = 1024


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item, given its (bytes, tokens, rows).

    Sizes are taken as shares of what one shard should get. Items are placed from the largest to the
    smallest, each where the dot product with the residual capacity is highest among the shards that
    still have room for it in all measures, or, when none has, among all. Then shards swap items, see `_even`.
    """
    share = sizes / np.maximum(sizes.sum(axis=0), 1) * shards
    residual = np.ones((shards, sizes.shape[1]))
    out = np.empty(len(sizes), np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -share.max(axis=1), -share.sum(axis=1))).tolist():
        item = share[i]
        fits = (residual >= item).all(axis=1)
        place = int(np.argmax(np.where(fits | ~fits.any(), residual @ item, -np.inf)))
        residual[place] -= item
        out[i] = place
    return _even(share, out, shards)


def _even(share: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Two shards far apart swap an item each, or one hands over an item, while that brings them closer.

    Closeness is the squared distance of their loads, bytes weighted by BYTES_FIRST. A swap has to take off
    a fiftieth of it, so the distances fall in steps and the loop ends. Pairs of shards are tried from the
    farthest on, one for each shard; of a shard its SWAPPED smallest items.
    """
    weighed = share * np.r_[BYTES_FIRST, np.ones(share.shape[1] - 1)]
    load = np.zeros((shards, share.shape[1]))
    np.add.at(load, shard, weighed)
    one, other = np.triu_indices(shards, 1)
    nothing = np.zeros((1, share.shape[1]))
    small = np.argsort(share.sum(axis=1), kind="stable")
    found = True
    while found:
        apart = ((load[one] - load[other]) ** 2).sum(axis=1)
        found = False
        for k in np.argsort(-apart, kind="stable")[:shards].tolist():
            a, b = one[k], other[k]
            of_a, of_b = (small[shard[small] == s][:SWAPPED] for s in (a, b))
            given, taken = np.r_[weighed[of_a], nothing], np.r_[weighed[of_b], nothing]
            after = np.zeros((len(given), len(taken)))
            for m, gap in enumerate(load[a] - load[b]):
                after += (gap - 2 * (given[:, m, None] - taken[None, :, m])) ** 2
            p, q = np.unravel_index(int(after.argmin()), after.shape)
            if after[p, q] < 0.98 * apart[k]:
                load[a] += taken[q] - given[p]
                load[b] += given[p] - taken[q]
                shard[of_a[p : p + 1]], shard[of_b[q : q + 1]] = b, a
                found = True
                break
    return shard


def pack_documents(
    docs: DataFrame,
    shards: int,
    tokens: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    overhead: int = 8,
) -> DataFrame:
    """Put every row into a shard: the id, `size`, `tokens`, `text_crc32`, `shard` and `slot`.

    `size` is the text's UTF-8 bytes plus `overhead`; `tokens` may be any count per row and is the number
    of words between white space by default. Rows of equal text are a group and stay together, unless the
    group is larger than a shard should be; then it is cut by a hash of the id, and where one id has many
    rows, by their position. `slot` numbers the rows of
    a shard from 0 without gaps, in a stable order. A null text counts as empty and has no size but the
    overhead; null ids and repeated rows are placed like any others (of identical rows, which gets which
    slot makes no difference); further columns are left out; an empty table gives an empty one.

    Only sums reach the driver: one for each bundle of light groups and one for each piece of a heavy
    group, a number that depends on BUNDLES and HEAVY and not on the data. The text is read once.
    """
    spark = docs.sparkSession
    names = [id_column, text_column] if tokens is None else [id_column, text_column, "_tokens"]
    counted = docs if tokens is None else docs.withColumn("_tokens", tokens)
    frame = only(counted, *names).toDF("doc_id", "text", *names[2:])
    text = F.coalesce(F.col("text"), F.lit(""))
    n_tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) if tokens is None else F.col("_tokens")
    rows = materialize(
        frame.select(
            "doc_id",
            (F.octet_length(text) + F.lit(overhead)).cast("bigint").alias("size"),
            n_tokens.cast("bigint").alias("tokens"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shards",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    totals = rows.agg(*sums).first()
    if not totals["rows"]:
        nowhere = F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot")
        return rows.select(F.col("doc_id").alias(id_column), "size", "tokens", "text_crc32", *nowhere)
    groups = rows.groupBy("digest").agg(*sums)
    heavy_rule = F.lit(False)
    for name in MEASURES:
        heavy_rule |= F.col(name) * HEAVY >= max(totals[name] or 0, 1)
    # Groups of a small table would all be heavy; that is right, they are then placed one by one.
    large = groups.filter(heavy_rule).collect()
    heavy = sorted((bytes(r["digest"]), r["bytes"], r["tokens"] or 0, r["rows"]) for r in large)

    part = max(1, -(-totals["rows"] // BUNDLES))
    parts = [-(-n // part) for *_, n in heavy]
    begin = (BUNDLES + np.cumsum([0, *parts])[:-1]).tolist() if parts else []
    schema = "digest binary, begin int, parts int"
    known = F.broadcast(spark.createDataFrame([(d, b, p) for (d, *_), b, p in zip(heavy, begin, parts)], schema))
    # Rows of one id and one text that would make up more than a piece: at most BUNDLES such ids.
    marked = rows.join(known, "digest", "left")
    repeated = marked.filter("begin is not null").groupBy("digest", "doc_id").count().filter(F.col("count") > part)
    repeated = repeated.select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_id"), F.lit(True).alias("hot"))
    same = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    spread = F.when(F.col("hot"), F.xxhash64("doc_id", "row")).otherwise(F.xxhash64("doc_id"))
    unit = F.col("begin") + F.pmod(spread, F.col("parts")).cast("int")
    light = F.pmod(F.xxhash64("digest"), F.lit(BUNDLES)).cast("int")
    placed = marked.join(F.broadcast(repeated), same, "left").withColumn("unit", F.coalesce(unit, light))
    measured = placed.groupBy("unit").agg(*sums).collect()
    units = sorted((r["unit"], r["bytes"], r["tokens"] or 0, r["rows"]) for r in measured)

    numbers = np.array([u[0] for u in units])
    sizes = np.array([u[1:] for u in units], float)
    # A heavy group that fits into a shard is one item; its units stay together.
    item = numbers.copy()
    limit = sizes.sum(axis=0) / shards
    for (_, *size), b, p in zip(heavy, begin, parts, strict=True):
        if (np.array(size, float) <= limit).all():
            item[(numbers >= b) & (numbers < b + p)] = b
    items, of = np.unique(item, return_inverse=True)
    summed = np.zeros((len(items), len(MEASURES)))
    np.add.at(summed, of, sizes)
    shard = pack(summed, shards)[of]
    offset = np.zeros(len(units), np.int64)
    for s in range(shards):
        inside = np.flatnonzero(shard == s)
        offset[inside] = np.cumsum(np.r_[0, sizes[inside, 2]])[:-1]
    table = [(int(u), int(s), int(o)) for u, s, o in zip(numbers, shard, offset)]
    plan = F.broadcast(spark.createDataFrame(table, "unit int, shard int, offset bigint"))
    order = Window.partitionBy("unit").orderBy("doc_id", "digest")
    return placed.withColumn("place", F.row_number().over(order)).join(plan, "unit").select(
        F.col("doc_id").alias(id_column),
        "size",
        "tokens",
        "text_crc32",
        "shard",
        (F.col("offset") + F.col("place") - 1).alias("slot"),
    )
