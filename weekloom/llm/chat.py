"""Conversations that were logged again after every turn: keep the longest of each, then render it.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.frames import only
from weekloom.operators.ordered import RUN, cut_into_runs
from weekloom.session import materialize

#: Turn numbers of a conversation that are hashed in one place; longer conversations are cut into such blocks.
BLOCK = 1024
#: Where a block has more rows than this, as when turn numbers repeat or are null, blocks are cut by rows.
CROWDED = 1 << 16
_NO_TURN = -(1 << 62)


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """Every distinct turn with its `place` in the conversation (from 1) and the rolling hashes `a` and `b` of the
    turns up to it.

    The hash of a prefix is the XOR of the hashes of its (place, role, text), 128 bits in two columns, so
    it can be put together from parts: conversations are cut into blocks of turn numbers, and a block
    starts from what the blocks before it add up to. If so many turns share a block, their numbers being
    repeated or null, that it is CROWDED, blocks are ranges of rows in the order of conversation, number,
    role and text instead. A conversation of any length is spread over tasks.
    """
    given = only(conversations, "conv_id", "turn", "role", "text")
    turns = given.distinct()
    by_number = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(_NO_TURN))
    crowded = given.groupBy("conv_id", by_number.alias("block")).count().filter(F.col("count") > CROWDED)
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    if crowded.isEmpty():
        cut = turns.withColumn("block", by_number)
    else:
        cut = cut_into_runs(turns, [F.asc_nulls_first("conv_id"), *order]).withColumnRenamed(RUN, "block")
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    local = cut.withColumn("place", F.row_number().over(inside))
    placed = _add(local, sizes).withColumn("place", F.col("place") + F.col("earlier")).drop("earlier")
    said = [F.coalesce(F.sha2(c, 256), F.lit("-")) for c in ("role", "text")]
    hashed = placed.withColumn("a", F.xxhash64(F.lit(1), "place", *said)).withColumn(
        "b", F.xxhash64(F.lit(2), "place", *said)
    )
    hashed = materialize(hashed, "turns")
    sums = hashed.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    sums = sums.select(
        "conv_id",
        "block",
        *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"from_{x}") for x in ("xa", "xb")],
    )
    running = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumn("a", F.bit_xor("a").over(running)).withColumn("b", F.bit_xor("b").over(running))
    return (
        _add(rolled, sums)
        .withColumn("a", F.col("a").bitwiseXOR(F.col("from_xa")))
        .withColumn("b", F.col("b").bitwiseXOR(F.col("from_xb")))
        .drop("from_xa", "from_xb", "block")
    )


def _add(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    other = blocks.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    same = turns["conv_id"].eqNullSafe(other["_conv"]) & (turns["block"] == other["_block"])
    return turns.join(other, same).drop("_conv", "_block")


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations that are not the beginning of a longer one: `conv_id`, `turns`, `copies` and the hashes.

    Two conversations begin alike when roles and texts agree turn by turn, by 128-bit hashes; turn
    numbers only give the order. Of conversations that are the same to their end, the smallest conv_id
    stays and `copies` counts them all. Rows that repeat a whole turn (conversation, number, role, text)
    count once. Turns with the same number are ordered by role and text, null before all else; a null
    conv_id is a conversation of its own; null roles and texts equal each other only. Further columns are
    left out; an empty table gives an empty one.
    """
    rolled = materialize(turn_prefixes(conversations), "prefixes")
    return _maximal(rolled)


def _maximal(rolled: DataFrame) -> DataFrame:
    ends = rolled.groupBy("conv_id").agg(
        F.max("place").alias("turns"),
        F.max_by(F.struct("a", "b"), "place").alias("hash"),
    )
    whole = ends.select("conv_id", "turns", "hash.a", "hash.b")
    same = whole.groupBy("a", "b", "turns").agg(
        F.min_by("conv_id", F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("conv_id"),
        F.count("*").alias("copies"),
    )
    # Prefixes that stop short of their conversation's end; what equals one of them goes.
    other = ends.select(F.col("conv_id").alias("_conv"), F.col("turns").alias("_turns"))
    short = (
        rolled.join(other, rolled["conv_id"].eqNullSafe(other["_conv"]))
        .filter("place < _turns")
        .groupBy("a", "b", F.col("place").alias("turns"))
        .agg(F.count("*").alias("n"))
    )
    return same.join(short, ["a", "b", "turns"], "left_anti").select("conv_id", "turns", "copies", "a", "b")


def render_conversations(conversations: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """One training text per maximal conversation: `conv_id`, `turns`, `copies`, `rendered`.

    A turn becomes begin, role, line break, text, end, line break; null roles and texts are rendered as
    empty. See `maximal_conversations` for which conversations stay and how odd rows are treated. A
    rendered conversation is one value, so it has to fit one row.
    """
    rolled = materialize(turn_prefixes(conversations), "prefixes")
    kept = _maximal(rolled).withColumnRenamed("conv_id", "_conv").select("_conv", "turns", "copies")
    piece = F.concat(
        F.lit(begin),
        F.coalesce("role", F.lit("")),
        F.lit("\n"),
        F.coalesce("text", F.lit("")),
        F.lit(end + "\n"),
    )
    said = rolled.join(kept, rolled["conv_id"].eqNullSafe(kept["_conv"])).groupBy("conv_id").agg(
        F.first("turns").alias("turns"),
        F.first("copies").alias("copies"),
        F.sort_array(F.collect_list(F.struct("place", piece.alias("said")))).alias("all"),
    )
    return said.select("conv_id", "turns", "copies", F.array_join("all.said", "").alias("rendered"))
