"""Passages that repeat across or within documents: seeds from winnowed anchors, extended to whole windows.

A window is `length` consecutive words. Winnowing picks one short word gram in every window, its anchor,
by the least hash, so equal windows have equal anchors at equal offsets. Anchors that occur only once rule
out all their windows. What is left is extended: the windows around a repeated anchor are compared as a
whole, and maximal runs of repeated windows are what is removed.

Rows travel packed: a piece of text gives one row per bucket, with arrays, and it names every anchor or
window once, so a passage that a third of all documents share meets itself once per piece, not per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.frames import only
from weekloom.llm.words import SPACED, Words, gram_hashes, inside_one_text, pieces, read_words

LENGTH = 20
#: Words of an anchor.
ANCHOR = 8
#: Text bytes for each bucket; the anchors and windows of a bucket are sorted in memory.
BUCKET_BYTES = 128 << 20
_LAST = np.iinfo(np.int64).max


def winnow(words: Words, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that lie in one text (their first words), the anchor of each, and all gram hashes.

    The anchor is the leftmost gram with the least hash.
    """
    grams = gram_hashes(words.hashes, anchor)
    inside = np.flatnonzero(inside_one_text(words.first, length))
    if not len(inside):
        return inside, inside, grams
    span = length - anchor + 1
    n = len(grams) - span + 1
    least, offset = grams[:n].copy(), np.zeros(n, np.int8)
    for k in range(1, span):
        later = grams[k : n + k]
        smaller = later < least
        np.minimum(least, later, out=least)
        offset[smaller] = k
    return inside, inside + offset[inside], grams


def _rows(bucket: np.ndarray, n: int, columns: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """Columns as lists, one per bucket from 0 to n - 1, and the order they were put in."""
    order = np.argsort(bucket, kind="stable")
    offsets = np.searchsorted(bucket[order], np.arange(n + 1))
    return offsets, [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(c[order])) for c in columns]


def _packed(parts: list[tuple[np.ndarray, list[np.ndarray]]], buckets: int, names: list[str]) -> pa.RecordBatch:
    """One row per bucket that has anything, from several groups of columns with buckets of their own."""
    used = np.unique(np.concatenate([b for b, _ in parts]))
    arrays: list[pa.Array] = [pa.array(used.astype(np.int32))]
    for bucket, columns in parts:
        arrays += _rows(np.searchsorted(used, bucket), len(used), columns)[1]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *names])


def _flat(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).flatten().to_numpy()


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a bucket together; they come sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for i, j in zip(cut, cut[1:]):
            if i == j:
                continue
            if held and held[0].column(0)[0].as_py() != int(bucket[i]):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal values together, and where each group begins in it."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(values) else np.empty(0, np.int64)
    return order, begin


_ANCHORS = "bucket int, hashes array<bigint>, docs array<int>, places array<int>, known_docs array<int>, known_places array<int>"


def _anchors(buckets: int, length: int, anchor: int):
    """(key, text) to anchors, packed by hash; those that repeat within a piece are known to repeat."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            words = read_words(batch.column(1), SPACED)
            _, chosen, grams = winnow(words, length, anchor)
            if not len(chosen):
                continue
            # Anchors ascend only nearly; each place once.
            flags = np.zeros(len(words.hashes), bool)
            flags[chosen] = True
            at = np.flatnonzero(flags)
            hashes = grams[at]
            text = np.searchsorted(words.first, at, "right") - 1
            place = (at - words.first[text]).astype(np.int32)
            key = _short(batch.column(0).to_numpy())[text]
            order, begin = _groups(hashes)
            size = np.diff(np.r_[begin, len(hashes)])
            one = order[begin]
            known = order[np.repeat(size > 1, size)]
            yield _packed(
                [
                    ((hashes[one] % np.uint64(buckets)).astype(np.int64), [hashes[one].view(np.int64), key[one], place[one]]),
                    (key[known].astype(np.int64) % buckets, [key[known], place[known]]),
                ],
                buckets,
                ["hashes", "docs", "places", "known_docs", "known_places"],
            )

    return run


def _short(key: np.ndarray) -> np.ndarray:
    """32 bits of a document's key. Documents that share them share hints, which does no harm."""
    return (key >> 32).astype(np.int32)


_REPEATED = "bucket int, docs array<int>, places array<int>"
_HINTS = "doc int, places array<int>"


def _repeated(buckets: int):
    """Packed anchors to places of anchors that occur in more than one piece or are known to repeat, packed
    by document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _by_bucket(batches):
            hashes, docs, places, known_docs, known_places = (_flat(bucket, i) for i in range(1, 6))
            order, begin = _groups(hashes)
            size = np.diff(np.r_[begin, len(hashes)])
            twice = order[np.repeat(size > 1, size)]
            doc = np.concatenate((docs[twice], known_docs))
            place = np.concatenate((places[twice], known_places))
            if len(doc):
                yield _packed([(doc.astype(np.int64) % buckets, [doc, place])], buckets, ["docs", "places"])

    return run


def _hints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All repeated places of a document in one row."""
    for bucket in _by_bucket(batches):
        doc, place = _flat(bucket, 1), _flat(bucket, 2)
        order, begin = _groups(doc)
        offsets = pa.array(np.r_[begin, len(doc)], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[order][begin]), pa.ListArray.from_arrays(offsets, pa.array(place[order]))], ["doc", "places"]
        )


_WINDOWS = (
    "bucket int, hashes array<bigint>, ids array<bigint>, keys array<bigint>, starts array<int>, counts array<int>, "
    "gone_ids array<bigint>, gone_keys array<bigint>, gone_starts array<int>, gone_counts array<int>"
)


def _stretches(text: np.ndarray, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Where stretches of consecutive windows of one text and bucket begin; windows come in order."""
    if not len(start):
        return np.empty(0, np.int64)
    fresh = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1) | (bucket[1:] != bucket[:-1])
    return np.flatnonzero(np.r_[True, fresh])


def _windows(buckets: int, length: int, anchor: int):
    """(id, key, text, places of repeated anchors) to the windows around these anchors, packed by anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            words = read_words(batch.column(2), SPACED)
            windows, chosen, grams = winnow(words, length, anchor)
            if not len(windows):
                continue
            hints = batch.column(3)
            counts = np.diff(hints.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), counts)
            hinted = words.first[owner] + hints.flatten().to_numpy()
            hinted = hinted[hinted < words.first[owner + 1]]
            marked = np.zeros(len(words.hashes), bool)
            marked[hinted] = True
            mine = marked[chosen]
            at, seed = windows[mine], chosen[mine]
            if not len(at):
                continue
            whole = gram_hashes(words.hashes, length, seed=1)[at]
            text = np.searchsorted(words.first, at, "right") - 1
            start = at - words.first[text]
            ids = np.where(np.asarray(batch.column(0).is_null()), _LAST, batch.column(0).fill_null(0).to_numpy())
            keys = batch.column(1).to_numpy()
            # The earliest place of each window in this piece goes on; later ones are repeats in any case.
            code = _order_codes(ids, keys)[text] << 32 | start
            order, begin = _groups(whole)
            size = np.diff(np.r_[begin, len(whole)])
            earliest = np.minimum.reduceat(code[order], begin)
            later = np.empty(len(whole), bool)
            later[order] = code[order] > np.repeat(earliest, size)
            parts = []
            spread = (keys >> 8) % buckets
            for some, bucket, with_hashes in (
                (~later, (grams[seed] % np.uint64(buckets)).astype(np.int64), True),
                (later, spread[text], False),
            ):
                t, s, b, h = text[some], start[some], bucket[some], whole[some]
                begin = _stretches(t, s, b)
                n = np.diff(np.r_[begin, len(s)])
                if with_hashes:
                    parts.append((b, [h.view(np.int64)]))
                tb = t[begin]
                parts.append((b[begin], [ids[tb], keys[tb], s[begin].astype(np.int32), n.astype(np.int32)]))
            yield _packed(
                parts,
                buckets,
                ["hashes", "ids", "keys", "starts", "counts", "gone_ids", "gone_keys", "gone_starts", "gone_counts"],
            )

    return run


def _order_codes(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers in the order of (id, key); equal pairs get equal numbers."""
    order = np.lexsort((keys, ids))
    fresh = np.r_[False, (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])]
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(fresh)
    return out


_GONE = "bucket int, ids array<bigint>, keys array<bigint>, starts array<int>, counts array<int>"
_BY_DOCUMENT = "id bigint, key bigint, starts array<int>, counts array<int>"


def _later(buckets: int):
    """Packed windows to the stretches of windows that also start earlier, packed by document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _by_bucket(batches):
            gone = _gone(bucket)
            if len(gone[0]):
                yield _packed([((gone[1] >> 8) % buckets, gone)], buckets, ["ids", "keys", "starts", "counts"])

    return run


def _gone(bucket: pa.RecordBatch) -> list[np.ndarray]:
    """Id, key, start and number of windows of every stretch of a bucket that also starts earlier."""
    hashes, ids, keys, starts, counts = (_flat(bucket, i) for i in range(1, 6))
    gone = [_flat(bucket, i) for i in range(6, 10)]
    if not len(hashes):
        return gone
    number = _order_codes(ids, keys)
    stretch = np.repeat(np.arange(len(starts)), counts)
    ends = np.cumsum(counts.astype(np.int64))
    start = np.arange(len(hashes)) - (ends - counts)[stretch] + starts[stretch]
    code = number[stretch] << 32 | start
    order, begin = _groups(hashes)
    size = np.diff(np.r_[begin, len(hashes)])
    later = np.zeros(len(hashes), bool)
    later[order] = code[order] > np.repeat(np.minimum.reduceat(code[order], begin), size)
    s, w = stretch[later], start[later]
    begin = _stretches(s, w, s)
    n = np.diff(np.r_[begin, len(w)])
    more = ids[s[begin]], keys[s[begin]], w[begin].astype(np.int32), n.astype(np.int32)
    return [np.concatenate(pair) for pair in zip(gone, more, strict=True)]


def _by_document(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All stretches of a document in one row."""
    for bucket in _by_bucket(batches):
        gone = [_flat(bucket, i) for i in range(1, 5)]
        order, begin = _groups(_order_codes(gone[0], gone[1]))
        offsets = pa.array(np.r_[begin, len(order)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(g[order])) for g in gone[2:]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(gone[0][order][begin]), pa.array(gone[1][order][begin]), *lists], ["id", "key", "starts", "counts"]
        )


def _cut(length: int, schema_names: list[str], digests: bool):
    """(id, text, starts, counts) to what is left of the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            words = read_words(batch.column(1), SPACED)
            n = len(words.hashes)
            depth = np.zeros(n + 1, np.int64)
            starts, counts = batch.column(2), batch.column(3)
            lists = np.diff(starts.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), lists)
            begin = words.first[owner] + starts.flatten().to_numpy()
            end = begin + counts.flatten().to_numpy() + length - 1
            np.add.at(depth, begin, 1)
            np.add.at(depth, end, -1)
            kept = np.cumsum(depth[:-1]) == 0
            n_kept = np.diff(np.r_[0, np.cumsum(kept)][words.first])
            # Kept words with a space after each; the last one's is left off.
            at, size = words.start[kept], words.end[kept] - words.start[kept] + 1
            stop = np.cumsum(size)
            take = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(at - (stop - size), size)
            joined = np.r_[words.data, np.uint8(32)][take]
            joined[stop - 1] = 32
            raw = joined.tobytes()
            edges = np.r_[0, stop][np.r_[0, np.cumsum(n_kept)]]
            texts = [raw[a : max(a, b - 1)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            result = (
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                if digests
                else pa.array([t.decode() for t in texts], pa.string())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words.counts, pa.int64()), pa.array(words.counts - n_kept, pa.int64()), result],
                schema_names,
            )

    return run


def _at_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def drop_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    id_column: str = "doc_id",
    text_column: str = "text",
    digests: bool = False,
) -> DataFrame:
    """Texts without the words of any passage of `length` or more words that also starts earlier: the id,
    `n_words`, `n_removed` and `kept_text` (the other words with one space between them; with `digests`
    the SHA-256 of that instead, as `kept_sha256`). A row per row.

    Words are runs without white space, as they are. Earlier means a smaller id, or the same document and an
    earlier start; windows are judged on the input. Null and empty texts have no words. Ids are integers; a
    null id comes last. Rows that repeat both id and text are one document and get the same result; texts
    that share an id are told apart and ordered by a hash. Further columns are left out; an empty table
    gives an empty one.
    """
    anchor = min(ANCHOR, length)
    spark = docs.sparkSession
    rows = only(docs, id_column, text_column).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

    packed = rows.select("key", "text").mapInArrow(_anchors(buckets, length, anchor), _ANCHORS)
    hints = _at_bucket(_at_bucket(packed).mapInArrow(_repeated(buckets), _REPEATED)).mapInArrow(_hints, _HINTS)
    hinted = rows.withColumn("doc", F.shiftright("key", 32).cast("int")).join(hints, "doc")
    windows = hinted.select(F.col("id").cast("bigint").alias("id"), "key", "text", "places").mapInArrow(
        _windows(buckets, length, anchor), _WINDOWS
    )
    gone = _at_bucket(_at_bucket(windows).mapInArrow(_later(buckets), _GONE)).mapInArrow(_by_document, _BY_DOCUMENT)
    gone = gone.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "starts", "counts")
    ids = F.coalesce(rows["id"].cast("bigint"), F.lit(int(_LAST)))
    none = F.array().cast("array<int>")
    joined = rows.join(gone, (rows["key"] == gone["_key"]) & (ids == gone["_id"]), "left").select(
        "id", "text", *[F.coalesce(c, none).alias(c) for c in ("starts", "counts")]
    )
    names = [id_column, "n_words", "n_removed", "kept_sha256" if digests else "kept_text"]
    schema = f"`{id_column}` {kind}, n_words bigint, n_removed bigint, {names[3]} string"
    return joined.mapInArrow(_cut(length, names, digests), schema)
