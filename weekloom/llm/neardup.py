"""Near-duplicate documents by MinHash bands and odd sketches.

A document's set of word shingles gives a row of MinHash samples. Bands of samples find candidates;
the samples folded into a parity bitmap, an odd sketch, rule out nearly all that are too different by
the population count of an XOR; the sets themselves confirm each link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.components import connected_components
from weekloom.llm.frames import having, only
from weekloom.llm.words import SPACED_LOWER, gram_hashes, mix, pieces, random_words, read_words
from weekloom.session import materialize

SAMPLES, BAND = 128, 4
BANDS = SAMPLES // BAND
#: Bits of an odd sketch.
SKETCH = 256
#: Members of a bucket whose sketches are compared in one block, members whose sets are, and shingles of these.
SKETCH_BLOCK, BLOCK, BLOCK_SHINGLES = 16_384, 1024, 4 << 20
#: Members that a task keeps before it hands them on.
_HANDED_ON = 1 << 17
#: Members that are confirmed against one hub in one place.
HUB_PART = 256

_FACTORS = (random_words(SAMPLES, 21) | np.uint64(1)).astype(np.uint32) | np.uint32(1)
_ADDENDS = random_words(SAMPLES, 22).astype(np.uint32)


def most_odd_bits(similarity: float, samples: int = SAMPLES, bits: int = SKETCH, sigmas: float = 6.0) -> int:
    """Bits that two sketches may differ in at this similarity, but for a chance of about 1e-9.

    The samples that differ are binomial; each toggles a bit in either sketch.
    """
    mean = samples * (1 - similarity)
    worst = min(samples, mean + sigmas * (samples * similarity * (1 - similarity)) ** 0.5)
    odd = bits / 2 * (1 - (1 - 2 / bits) ** (2 * worst))
    return int(odd + sigmas / 2 * (bits / 4 * (odd / bits)) ** 0.5) + 1


def estimated_similarity(odd: np.ndarray, samples: int = SAMPLES, bits: int = SKETCH) -> np.ndarray:
    """Similarity that a number of differing bits stands for."""
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * np.asarray(odd) / bits, 1e-9))


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text with fewer words has all of them as one."""
    words = read_words(texts, SPACED_LOWER)
    grams = gram_hashes(words.hashes, shingle)
    out = []
    for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if j - i >= shingle:
            ordered = np.sort(grams[i : j - shingle + 1])
            out.append(ordered[np.r_[True, ordered[1:] != ordered[:-1]]])
        elif j > i:
            out.append(gram_hashes(words.hashes[i:j], j - i, seed=j - i))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least of the shingles' values under each of SAMPLES hash functions."""
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for part in range(0, len(folded), 4096):
        values = folded[part : part + 4096]
        np.minimum(low, (_FACTORS[:, None] * values + _ADDENDS[:, None]).min(axis=1), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Rows of samples to rows of SKETCH / 64 words: bit h(i, sample i) toggled for each i."""
    numbers = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
    place = (mix(samples.astype(np.uint64) | numbers) % np.uint64(SKETCH)).astype(np.int64)
    out = np.zeros((len(samples), SKETCH // 64), np.uint64)
    rows = np.repeat(np.arange(len(samples)), SAMPLES)
    flat = place.ravel()
    np.bitwise_xor.at(out, (rows, flat // 64), np.uint64(1) << (flat % 64).astype(np.uint64))
    return out


def band_hashes(samples: np.ndarray) -> np.ndarray:
    """One value per band, different between bands."""
    total = np.zeros((len(samples), BANDS), np.uint64)
    weights = random_words(SAMPLES, 23) | np.uint64(1)
    cut = samples.astype(np.uint64).reshape(len(samples), BANDS, BAND)
    for k in range(BAND):
        total += mix(cut[:, :, k] + np.uint64(k << 40)) * weights[k]
    return mix(total + random_words(BANDS, 24))


_SIGNED = ["n_shingles bigint", "content string", "bands array<bigint>", *[f"s{i} bigint" for i in range(SKETCH // 64)]]


def signatures(docs: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """`id`, `n_shingles`, `content` (a digest of the set, null if empty), `bands` and the sketch `s0`, ..."""
    frame = only(docs, id_column, text_column)
    kind = frame.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            sets = shingle_sets(batch.column(1), shingle)
            sizes = np.array([len(s) for s in sets], np.int64)
            digests = [hashlib.sha256(s.tobytes()).hexdigest()[:32] if len(s) else None for s in sets]
            samples = np.stack([min_hashes(s) for s in sets])
            bands = band_hashes(samples).view(np.int64)
            sketch = odd_sketch(samples).view(np.int64)
            offsets = pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(bands.ravel())),
                    *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH // 64)],
                ],
                ["id", "n_shingles", "content", "bands", *[f"s{i}" for i in range(SKETCH // 64)]],
            )

    return frame.mapInArrow(run, ", ".join([f"id {kind}", *_SIGNED]))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    similarity: tuple[int, int] = (80, 100),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Classes of near-duplicate documents: the id, `n_shingles`, `component_id` and `kept`, a row per row.

    Words are runs without white space, A-Z in lower case; a document's set holds its distinct shingles
    of `shingle` words, or all its words as one if it has fewer. Documents are linked when the sets'
    intersection is at least similarity[0] / similarity[1] of their union. `component_id` is the smallest
    id that can be reached by links, and `kept` says that it is the row's own.

    Null and empty texts have an empty set and are linked with nothing. Ids should tell documents apart:
    rows that share one are linked by it, and a row with a null id is only linked with rows of the same
    set (alone among null ids, it is kept). Further columns are left out; an empty table gives an empty one.

    Equal sets are collapsed before anything is paired. A band's bucket is compared with one member, its
    hub; after links have made components, what lies in the same bucket but in different components is
    compared, block by block: by sketches first, and by the sets where a member has a sketch that is close
    enough. So a bucket of copies costs a pair each, and no candidate is dropped. A bucket of m members in many
    components sends m * m / 16,384 sketches; those of them that are close to each other without being linked,
    say c, send c * c / 1,024 texts or more if they are long, which is quadratic, with a small factor.
    """
    signed = materialize(signatures(docs, shingle, id_column, text_column), "signatures")
    sketch = [f"s{i}" for i in range(SKETCH // 64)]
    whole = signed.filter("content is not null and id is not null")
    nodes = materialize(
        whole.groupBy("content").agg(
            F.min("id").alias("node"), *[F.any_value(c).alias(c) for c in ("n_shingles", "bands", *sketch)]
        ),
        "nodes",
    )
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = materialize(_with_hubs(placed.join(shared, "bucket")), "buckets")

    # Texts of documents that share a bucket at all; only they are needed again.
    involved = buckets.select("node").distinct()
    texts = only(docs, id_column, text_column).toDF("id", "text")
    texts = texts.join(involved, texts["id"] == involved["node"], "left_semi").dropDuplicates(["id"])
    texts = materialize(texts, "texts")

    limit = most_odd_bits(similarity[0] / similarity[1])
    stars = buckets.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(_confirmed(_alike(stars, nodes, sketch, limit), texts, shingle, similarity), "links")
    components = materialize(connected_components(links), "components")

    more = materialize(_across(buckets, nodes, texts, components, shingle, similarity, limit), "links")
    if not more.isEmpty():
        components = materialize(connected_components(links.union(more)), "components")

    # A class is named by its smallest id, and by a null one only if it has no other.
    named = nodes.select("content", "node").join(components, "node", "left")
    named = named.select("content", F.coalesce("component", "node").alias("component"))
    return signed.join(named, "content", "left").select(
        F.col("id").alias(id_column),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component", "id")).alias("kept"),
    )


def _with_hubs(members: DataFrame) -> DataFrame:
    """Members of buckets with the `hub` of each: the member that meets most others over all its buckets.

    Copies that were each changed elsewhere share more bands with their source than with each other, so the
    source is the hub of their buckets, and stars around hubs already link them all.
    """
    central = members.groupBy("node").agg(F.sum("size").alias("met"))
    known = members.select("bucket", "node").join(central, "node")
    hubs = known.groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("met"), F.col("node"))).alias("hub"))
    return members.select("bucket", "node").join(hubs, "bucket")


def _odd(a: str, b: str, sketch: list[str]) -> Column:
    total = F.lit(0)
    for s in sketch:
        total = total + F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")))
    return total


def _alike(pairs: DataFrame, nodes: DataFrame, sketch: list[str], limit: int) -> DataFrame:
    """Pairs (a, b) whose sketches differ in no more than `limit` bits."""
    left = nodes.select(F.col("node").alias("a"), F.struct(*sketch).alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.struct(*sketch).alias("y"))
    return pairs.join(left, "a").join(right, "b").filter(_odd("x", "y", sketch) <= limit).select("a", "b")


def _across(
    buckets: DataFrame, nodes: DataFrame, texts: DataFrame, components: DataFrame, shingle: int,
    similarity: tuple[int, int], limit: int,
) -> DataFrame:
    """Links within a bucket between members of different components.

    A bucket's largest component needs no comparison within itself. The members of the others are cut into
    blocks; everyone in the bucket meets every block, which is streamed past it. That is done with sketches
    alone first, which leave the members that are close to one of another component, and with the texts of these
    then. Only links leave the task: a family whose members are all nearly, but not quite, similar enough makes no
    table of pairs.
    """
    known = components.withColumnRenamed("component", "c")
    members = buckets.join(known, "node", "left").withColumn("c", F.coalesce("c", "node"))
    members = materialize(_mixed(members).join(nodes.select("node", "n_shingles"), "node"), "mixed")
    kind = members.schema["node"].dataType.simpleString()

    light = _met(members, F.ceil(F.col("minor") / SKETCH_BLOCK))
    sketches = nodes.select("node", "bands", *[f"s{i}" for i in range(SKETCH // 64)])
    light = _by_block(light.join(sketches, "node"))
    columns = ["bucket", "block", "first", "own", "node", "c", "hub", "bands", *[f"s{i}" for i in range(SKETCH // 64)]]
    close = light.select(*columns).mapInArrow(_close_members(limit), f"bucket bigint, node {kind}").distinct()

    near = materialize(_mixed(members.join(close, ["bucket", "node"])), "close")
    by_size = F.greatest(F.ceil(F.col("minor") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    met = _by_block(_met(near, by_size).join(texts.withColumnRenamed("id", "node"), "node"))
    columns = ["bucket", "block", "first", "own", "node", "c", "hub", "text"]
    links = met.select(*columns).mapInArrow(_compare_blocks(shingle, similarity, limit), f"a {kind}, b {kind}")
    return links.distinct()


def _mixed(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component."""
    mixed = members.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    return members.join(mixed.select("bucket"), "bucket")


def _met(members: DataFrame, blocks: Column) -> DataFrame:
    """Members once for every block of their bucket; `own` is the block a member is in, -1 if it is of the largest
    component, and `first` says that it is this one."""
    sizes = members.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    main = sizes.groupBy("bucket").agg(
        F.max_by("c", F.struct("n", "c")).alias("main"),
        (F.sum("n") - F.max("n")).alias("minor"),
        (F.sum("m") - F.max_by("m", F.struct("n", "c"))).alias("shingles"),
    )
    rows = members.join(main.withColumn("blocks", blocks.cast("int")), "bucket")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", F.when(F.col("c") != F.col("main"), own).otherwise(F.lit(-1)))
    met = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumn("first", F.col("own") == F.col("block"))


def _by_block(met: DataFrame) -> DataFrame:
    return met.repartition("bucket", "block").sortWithinPartitions("bucket", "block", F.desc("first"), "node")


@dataclass
class _Members:
    """Some members of a bucket: who they are, and their sets, sketches and bands."""

    first: np.ndarray
    own: np.ndarray
    node: np.ndarray
    c: np.ndarray
    hub: np.ndarray
    sketch: np.ndarray
    bands: np.ndarray
    sets: list[np.ndarray]

    def pick(self, rows: np.ndarray) -> _Members:
        arrays = (getattr(self, f)[rows] for f in ("first", "own", "node", "c", "hub", "sketch", "bands"))
        return _Members(*arrays, [self.sets[i] for i in rows.tolist()])


def _blocks_met(rows: Iterable[tuple[np.ndarray, np.ndarray, _Members]]) -> Iterator[tuple[int, _Members, _Members]]:
    """Bucket, members of a block and members that meet them, in parts, from (bucket, block, members) in the order of
    `_by_block`. Sets that are not held are empty."""
    key, block = None, []
    for bucket, number, members in rows:
        cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (number[1:] != number[:-1])) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
            if key != (bucket[i], number[i]):
                key, block = (bucket[i], number[i]), []
            for k in range(i, j, 256):
                part = members.pick(np.arange(k, min(j, k + 256)))
                for held in block:
                    yield int(bucket[i]), held, part
                if part.first.any():
                    mine = part.pick(np.flatnonzero(part.first))
                    yield int(bucket[i]), mine, part
                    block.append(mine)


def _close_members(limit: int):
    """For mapInArrow: the members, by bucket, whose sketch is close to that of a member of another component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.null()

        def members() -> Iterator[tuple[np.ndarray, np.ndarray, _Members]]:
            nonlocal kind
            for batch in batches:
                if not batch.num_rows:
                    continue
                kind = batch.schema.field("node").type
                plain = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
                bands = np.asarray(batch.column(7).flatten()).reshape(-1, BANDS).view(np.uint64)
                sketch = np.stack([np.asarray(batch.column(8 + i)) for i in range(SKETCH // 64)], axis=1).view(np.uint64)
                yield plain[0], plain[1], _Members(*plain[2:], sketch, bands, [None] * batch.num_rows)

        found: set[tuple] = set()
        for bucket, held, part in _blocks_met(members()):
            a, b = _close(held, part, bucket, limit)
            found.update((bucket, x) for x in (*np.unique(held.node[a]).tolist(), *np.unique(part.node[b]).tolist()))
            if len(found) >= _HANDED_ON:
                yield _pairs(found, kind)
                found.clear()
        if found:
            yield _pairs(found, kind)

    return run


def _pairs(found: set[tuple], kind: pa.DataType) -> pa.RecordBatch:
    buckets, nodes = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(nodes, kind)], ["bucket", "node"])


def _compare_blocks(shingle: int, similarity: tuple[int, int], limit: int):
    """For mapInArrow: links between the members of blocks and those that meet them, by their full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.null()

        def members() -> Iterator[tuple[np.ndarray, np.ndarray, _Members]]:
            nonlocal kind
            for batch in pieces(batches, 7, 1 << 20):
                kind = batch.schema.field("node").type
                plain = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
                sets = shingle_sets(batch.column(7), shingle)
                samples = np.stack([min_hashes(s) for s in sets])
                yield plain[0], plain[1], _Members(*plain[2:], odd_sketch(samples), band_hashes(samples), sets)

        for bucket, held, part in _blocks_met(members()):
            a, b = _close(held, part, bucket, limit)
            found = [
                (held.node[i], part.node[j])
                for i, j in zip(a.tolist(), b.tolist(), strict=True)
                if _similar(held.sets[i], part.sets[j], similarity)
            ]
            if found:
                left, right = (pa.array(list(side), kind) for side in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([left, right], ["a", "b"])

    return run


def _close(held: _Members, rows: _Members, bucket: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Held members of this block and further rows, in other components, whose sketches are close."""
    odd = np.zeros((len(held.node), len(rows.node)), np.uint16)
    for i in range(held.sketch.shape[1]):
        odd += np.bitwise_count(held.sketch[:, i, None] ^ rows.sketch[None, :, i])
    good = (odd <= limit) & (held.c[:, None] != rows.c[None, :])
    # Hubs have been compared with all; two minor members meet in both their blocks, once is enough.
    good &= (held.node != held.hub)[:, None] & (rows.node != rows.hub)[None, :]
    good &= (rows.own < 0)[None, :] | (held.node[:, None] < rows.node[None, :])
    a, b = np.nonzero(good)
    # Of the buckets that two members share, only the first counts.
    band = (held.bands[0].view(np.int64) == bucket).argmax() if len(held.node) else 0
    once = (held.bands[a] == rows.bands[b])[:, :band].any(axis=1)
    return a[~once], b[~once]


def _similar(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether two sorted sets are similar enough, by counting what they have in common."""
    least, whole = similarity
    if min(len(a), len(b)) * whole < least * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return whole * common >= least * (len(a) + len(b) - common)


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough.

    Members b are brought to their hub a, in parts of HUB_PART where a hub has many.
    """
    pairs = materialize(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    members = pairs.join(parts, "a").select("a", part.alias("part"), F.col("b").alias("id"), F.lit(1).alias("role"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    hubs = parts.select("a", every.alias("part"), F.col("a").alias("id"), F.lit(0).alias("role"))
    rows = members.unionByName(hubs).join(texts, "id").select("a", "part", "role", "id", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role", "id")
    kind = rows.schema["a"].dataType.simpleString()
    return rows.mapInArrow(_confirm(shingle, similarity), f"a {kind}, b {kind}")


def _confirm(shingle: int, similarity: tuple[int, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.empty(0, np.uint64)
        for batch in pieces(batches, 4):
            role = batch.column(2).to_numpy()
            linked = np.zeros(batch.num_rows, bool)
            for i, own in enumerate(shingle_sets(batch.column(4), shingle)):
                if role[i] == 0:
                    hub = own
                    continue
                linked[i] = _similar(hub, own, similarity)
            kept = batch.filter(pa.array(linked))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(3)], ["a", "b"])

    return run


def drop_near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    similarity: tuple[int, int] = (80, 100),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows of `docs` whose class is named after them, with all their columns."""
    kept = near_duplicates(docs, shingle, similarity, id_column, text_column).filter("kept").select(id_column)
    return having(docs, kept, id_column)
