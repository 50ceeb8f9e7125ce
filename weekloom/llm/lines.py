"""Lines that many documents repeat, found in sharded perfect-hash tables that documents probe.

Distinct line keys are counted once; those in enough documents go into shards, each a minimal perfect hash with
arrays at its numbers: a fingerprint, the count of documents and the document that keeps the line. Shards go to the
tasks, so documents are read where they lie and no line is joined with anything.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.frames import only
from weekloom.llm.perfecthash import PerfectHash
from weekloom.llm.words import pieces
from weekloom.session import materialize

MIN_CHARS, MIN_DOCS = 40, 5
#: Lines of a shard, about, and bytes of the shards that tasks get at once.
SHARD_LINES = 1 << 20
TABLE_BYTES = 64 << 20
_SMALL_SHARD = 1000
#: Distinct lines a task counts before it hands them on.
_COUNTED = 1 << 18

_SPACE = b" \t\n\v\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))


def _key(line: bytes, min_chars: int) -> bytes | None:
    """What lines are compared by, if it is long enough."""
    key = line.strip(_SPACE)
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key.translate(None, _CONTINUATION)) < min_chars:
        return None
    return key.lower()  # of bytes: A-Z only


_HALF = 1 << 64


def _hashes(digests: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests as two columns: one that places a line, and its fingerprint."""
    n = len(digests)
    high = np.fromiter((d >> 64 for d in digests), np.uint64, n)
    low = np.fromiter((d % _HALF for d in digests), np.uint64, n)
    return high, low


def _line_digests(text: bytes | None, min_chars: int) -> list[int | None]:
    """Of every line; None for a line that is too short."""
    out: list[int | None] = []
    for line in (text or b"").split(b"\n"):
        key = _key(line, min_chars)
        out.append(None if key is None else xxhash.xxh3_128_intdigest(key))
    return out


def _counter(min_chars: int) -> Callable:
    """For mapInArrow: (place, fingerprint, documents, largest id), each line once per so many lines."""

    def handed_on(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        grouped = pa.concat_tables(parts).group_by(["place", "print"])
        table = grouped.aggregate([("id", "count", pc.CountOptions(mode="all")), ("id", "max")])
        table = table.select(["place", "print", "id_count", "id_max"]).rename_columns(["place", "print", "n", "keeper"])
        yield from table.to_batches(max_chunksize=1 << 16)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in pieces(batches, 1):
            digests, rows = [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                lines = {d for d in _line_digests(text, min_chars) if d is not None}
                digests += lines
                rows += [row] * len(lines)
            place, print_ = _hashes(digests)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            parts.append(pa.table({"place": place.view(np.int64), "print": print_.view(np.int64), "id": ids}))
            held += len(rows)
            if held >= _COUNTED:
                yield from handed_on(parts)
                parts, held = [], 0
        if held:
            yield from handed_on(parts)

    return run


def line_counts(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Lines of `min_docs` documents or more: `place` and `print` (the halves of the key's 128-bit hash), `n` (the
    documents) and `keeper` (the largest of their ids). Tasks count their lines before the shuffle."""
    rows = only(docs, id_column, text_column).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(_counter(min_chars), f"place bigint, print bigint, n bigint, keeper {kind}")
    return (
        counted.groupBy("place", "print").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")).filter(F.col("n") >= min_docs)
    )


@dataclass(frozen=True)
class Shard:
    """Arrays by the numbers of a perfect hash over line places; lines that share a place are one entry of
    `twins` each."""

    numbers: PerfectHash
    prints: np.ndarray
    counts: np.ndarray
    keepers: pa.Array
    twins: dict[tuple[int, int], tuple[int, int]]  # (place, print) to (count, position among the keepers)

    @classmethod
    def build(cls, place: np.ndarray, prints: np.ndarray, counts: np.ndarray, keepers: pa.Array) -> Shard:
        _, first = np.unique(place, return_index=True)
        numbers = PerfectHash.build(place[first])
        order = np.empty(len(first), np.int64)
        order[numbers.numbers(place[first])] = first
        rest = np.setdiff1d(np.arange(len(place)), first)
        twins = {
            (int(place[i]), int(prints[i])): (int(counts[i]), len(first) + k) for k, i in enumerate(rest.tolist())
        }
        small = np.minimum(counts[order], np.iinfo(np.uint32).max).astype(np.uint32)
        return cls(numbers, prints[order], small, keepers.take(pa.array(np.r_[order, rest])), twins)

    def find(self, place: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of every line, 0 if it is not here, and where its keeper is."""
        at = self.numbers.numbers(place)
        known = at >= 0
        known[known] = self.prints[at[known]] == prints[known]
        counts = np.zeros(len(place), np.int64)
        counts[known] = self.counts[at[known]]
        if self.twins:
            for i in np.flatnonzero(~known).tolist():
                twin = self.twins.get((int(place[i]), int(prints[i])))
                if twin is not None:
                    counts[i], at[i] = twin
        return counts, at


def _shard_of(place: np.ndarray, shards: int) -> np.ndarray:
    return (place >> np.uint64(32)) % np.uint64(shards)


def _shard_column(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("place", 32), F.lit(shards)).cast("int")


def _builder(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows sorted by shard: a row per shard, with its table and the bytes of it."""

    def built(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        place, prints, n = (table.column(k).to_numpy() for k in ("place", "print", "n"))
        keepers = table.column("keeper").chunk(0)
        data = pickle.dumps(Shard.build(place.view(np.uint64), prints.view(np.uint64), n, keepers), 5)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())],
            names=["shard", "bytes", "data"],
        )

    current, parts = None, []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        borders = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)].tolist()
        for low, high in zip(borders[:-1], borders[1:], strict=True):
            if low == high:
                continue
            if shard[low] != current:
                if parts:
                    yield built(current, parts)
                current, parts = int(shard[low]), []
            parts.append(batch.slice(low, high - low))
    if parts:
        yield built(current, parts)


@dataclass(frozen=True)
class LineTable:
    """Shards as a written table of `shard`, `bytes`, `data`."""

    table: DataFrame
    shards: int

    def blocks(self, max_bytes: int) -> list[list[int]]:
        """Numbers of the shards, as many together as have `max_bytes`, or one; one empty block if there are none."""
        sizes = self.table.select("shard", "bytes").collect()  # two numbers per shard of a million lines
        blocks, held = [[]], 0
        for shard, size in sorted(sizes):
            if blocks[-1] and held + size > max_bytes:
                blocks.append([])
                held = 0
            blocks[-1].append(shard)
            held += size
        return blocks

    def read(self, block: list[int]) -> dict[int, Shard]:
        rows = self.table.filter(F.col("shard").isin(block)).select("shard", "data").collect() if block else []
        return {r["shard"]: pickle.loads(r["data"]) for r in rows}


def build_table(counts: DataFrame, shard_lines: int = SHARD_LINES) -> LineTable:
    """Shards over the lines of `line_counts`, built by the tasks: of `shard_lines` lines, or fewer where all tasks
    of a shuffle then have one of at least a thousand."""
    counts = materialize(counts, "lines")
    n, tasks = counts.count(), int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // shard_lines), min(tasks, n // _SMALL_SHARD))
    dealt = counts.withColumn("shard", _shard_column(shards)).repartition(F.col("shard")).sortWithinPartitions("shard")
    table = dealt.mapInArrow(_builder, "shard int, bytes bigint, data binary")
    return LineTable(materialize(table, "line-shards"), shards)


_FOUND = "array<struct<line:int,n_docs:bigint>>"
_FOUND_ARROW = pa.list_(pa.struct([("line", pa.int32()), ("n_docs", pa.int64())]))


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Equal, or both null."""
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def _prober(shared, shards: int, min_chars: int, min_docs: int, last: bool) -> Callable:
    """For mapInArrow: adds to `found` the lines that these shards hold and another document keeps. With `last`
    the text comes without all lines that were found."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in pieces(batches, 1):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            digests, rows, numbers = [], [], []
            for row, text in enumerate(texts):
                for number, d in enumerate(_line_digests(text, min_chars)):
                    if d is not None:
                        digests.append(d)
                        rows.append(row)
                        numbers.append(number)
            lost = _lost(block, shards, min_docs, batch.column(0), digests, np.array(rows, np.int64), np.array(numbers, np.int64))
            found = [x or [] for x in batch.column(2).to_pylist()]
            for row, number, n in lost:
                found[row].append({"line": number, "n_docs": n})
            text, n_lines = batch.column(1), batch.column(3)
            if last:
                n_lines = pa.array([(t or b"").count(b"\n") + 1 for t in texts], pa.int64())
                text = pa.array([_without(t, x) for t, x in zip(texts, found, strict=True)], pa.binary()).cast(text.type)
            columns = [batch.column(0), text, pa.array(found, _FOUND_ARROW), n_lines]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "found", "n_lines"])

    return run


def _lost(
    block: dict[int, Shard], shards: int, min_docs: int, ids: pa.Array, digests: list[int], rows: np.ndarray, numbers: np.ndarray
) -> list[list[int]]:
    """Row, line number and count of the lines that go, in this order."""
    place, prints = _hashes(digests)
    shard = _shard_of(place, shards)
    gone = [np.empty((0, 3), np.int64)]
    for k in np.unique(shard).tolist():
        if k not in block:
            continue
        here = np.flatnonzero(shard == k)
        counts, at = block[k].find(place[here], prints[here])
        often = np.flatnonzero(counts >= min_docs)
        keepers = block[k].keepers.take(pa.array(at[often]))
        elsewhere = ~_same(ids.take(pa.array(rows[here[often]])), keepers)
        lost = here[often[elsewhere]]
        gone.append(np.stack([rows[lost], numbers[lost], counts[often[elsewhere]]], axis=1))
    lost = np.concatenate(gone)
    return lost[np.lexsort((lost[:, 1], lost[:, 0]))].tolist()


def _without(text: bytes | None, found: list[dict]) -> bytes:
    if not found:
        return text or b""
    gone = {x["line"] for x in found}
    return b"\n".join([line for i, line in enumerate(text.split(b"\n")) if i not in gone])


def drop_common_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    id_column: str = "doc_id",
    text_column: str = "text",
    shard_lines: int = SHARD_LINES,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """Texts without lines that many documents have: the id, `n_lines`, `dropped` (line numbers from 0, with the
    documents that have the line) and `kept_text`, the other lines joined by \\n. A row per row.

    A line's key is the line without white space (space and U+0009 to U+000D) at either end and with A-Z in lower
    case. A key of `min_chars` code points or more that `min_docs` documents or more have keeps its lines in the
    document with the largest id only, all of them. Null and empty texts are one empty line. Rows are documents of
    their own even if they repeat: each counts, and all that have the largest id keep the line; a null id is
    less than any other. Ids are of any ordered type; further columns are left out; an empty table gives an empty one.

    Keys are compared by 128-bit hashes. Documents are not shuffled, lines only to be counted. Tables go to the
    tasks `table_bytes` at a time (or one shard of about `shard_lines` lines); with more of them the documents and
    what was found so far are written in between.
    """
    lines = build_table(line_counts(docs, min_chars, min_docs, id_column, text_column), shard_lines)
    rows = only(docs, id_column, text_column).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    frame = rows.withColumns({"found": F.lit(None).cast(_FOUND), "n_lines": F.lit(None).cast("bigint")})
    schema = f"id {kind}, text string, found {_FOUND}, n_lines bigint"
    context = docs.sparkSession.sparkContext
    blocks = lines.blocks(table_bytes)
    for number, block in enumerate(blocks):
        if number:
            frame = materialize(frame, "found-lines")
        shared = context.broadcast(lines.read(block))
        frame = frame.mapInArrow(_prober(shared, lines.shards, min_chars, min_docs, block is blocks[-1]), schema)
    return frame.select(
        F.col("id").alias(id_column), "n_lines", F.array_sort("found").alias("dropped"), F.col("text").alias("kept_text")
    )
