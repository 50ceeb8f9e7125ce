"""The best documents for each of many texts, by sums of term weights, without scoring every document.

A task cuts its documents into shards and gives every term a posting list in the order of document ids, with a
sparse table that answers where in a stretch of the list the greatest impact is. A stretch of documents cannot
hold a better one than the sum of the greatest impacts of all terms in it. Stretches are taken best bound first;
each is split at its document of greatest impact, which is scored, until no stretch can reach the ones found.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.frames import only
from weekloom.llm.words import ALPHANUMERIC, pieces, read_words

TOP = 10
#: Text bytes of the items that tasks get at once, and of the documents that are indexed together (or one).
ITEM_BYTES = 16 << 20
SHARD_BYTES = 8 << 20
#: Documents of a shard times terms of the longest item, at most: the stretches of a search hold so many numbers.
_SHARD_PLACES = 4 << 20
#: Stretches of an item that are split at once, best bounds first.
_SPLIT_AT_ONCE = 64
#: Parts that the hits of an item are ranked in before all of them are.
_PARTS = 64


@dataclass(frozen=True)
class Items:
    """The terms of all items: sorted hashes, and for each item their numbers."""

    terms: np.ndarray
    of_item: list[np.ndarray]


def read_items(texts: list[str | None]) -> Items:
    words = read_words(pa.array(texts, pa.string()), ALPHANUMERIC)
    terms, number = np.unique(words.hashes, return_inverse=True)
    first = words.first
    return Items(terms, [np.unique(number[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)])


@dataclass(frozen=True)
class Statistics:
    """What the whole corpus adds to scores: documents with a term, all their terms, and a weight per term."""

    documents: int
    length: int
    weights: np.ndarray


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def _postings(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term, document and occurrences of every posting, by term and document, and the length of each document."""
    words = read_words(texts, ALPHANUMERIC)
    at = np.searchsorted(terms, words.hashes)
    at[at == len(terms)] = 0
    known = np.flatnonzero(terms[at] == words.hashes) if len(terms) else np.empty(0, np.int64)
    documents = max(1, len(texts))
    key, tf = np.unique(at[known] * documents + words.text_of_word()[known], return_counts=True)
    return key // documents, key % documents, tf, words.counts


def _counter(items) -> Callable:
    """For mapInArrow: a row per task and term with the documents that hold it; at term -1 the documents that have
    terms, and at -2 all their terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = items.value.terms
        having, documents, length = np.zeros(len(terms), np.int64), 0, 0
        for batch in pieces(batches, 0):
            term, _, _, counts = _postings(batch.column(0), terms)
            having += np.bincount(term, minlength=len(terms))
            documents += int(np.count_nonzero(counts))
            length += int(counts.sum())
        seen = np.flatnonzero(having)
        numbers = pa.array(np.r_[-1, -2, seen].astype(np.int32))
        yield pa.RecordBatch.from_arrays([numbers, pa.array(np.r_[documents, length, having[seen]])], names=["term", "n"])

    return run


def statistics(docs: DataFrame, items, terms: int) -> Statistics:
    counted = docs.select("text").mapInArrow(_counter(items), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}  # no more rows than terms of the items
    documents, length = found.get(-1, 0), found.get(-2, 0)
    weights = np.array([weight(documents, found.get(t, 0)) for t in range(terms)], np.int64)
    return Statistics(documents, length, weights)


class Shard:
    """Posting lists of some documents, one after another by term and document.

    `key` is term * documents + document. Level k of the sparse table says for every posting which of the 2 ** k
    from it on has the greatest impact, the first one on ties; stretches that are asked for lie inside one list.
    """

    def __init__(self, texts: pa.Array, terms: np.ndarray, corpus: Statistics):
        term, document, tf, n = _postings(texts, terms)
        self.documents = len(texts)
        norm = 100 - 90 + (90 * n.astype(np.int64) * corpus.documents) // max(1, corpus.length)
        self.document = document
        self.impact = corpus.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[document]))
        self.key = term * max(1, self.documents) + document
        longest = int(np.bincount(term).max()) if len(term) else 0
        self._table = [np.arange(len(term), dtype=np.int32)]
        while 2 << (len(self._table) - 1) <= longest:
            half, last = 1 << (len(self._table) - 1), self._table[-1]
            self._table.append(self._better(last[:-half], last[half:]))

    def _better(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self.impact[b] > self.impact[a], b, a)

    def place(self, terms: np.ndarray, documents: np.ndarray) -> np.ndarray:
        """The first posting at or after each document, for every term."""
        return np.searchsorted(self.key, terms * self.documents + documents[:, None])

    def greatest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest impact among the postings low to high - 1 and where it is; 0 if there are none."""
        count = high - low
        level = np.frexp(np.maximum(count, 1))[1] - 1
        at = np.zeros(count.shape, np.int64)
        for k in np.unique(level[count > 0]).tolist():
            asked = (level == k) & (count > 0)
            row = self._table[k]
            at[asked] = self._better(row[low[asked]], row[high[asked] - (1 << k)])
        impact = np.where(count > 0, self.impact[at] if len(self.impact) else 0, 0)
        return impact, at


class _Best:
    """The best documents of an item so far: score and id, higher scores and then lesser ids first, null last."""

    def __init__(self, top: int):
        self.top = top
        self.rows: list[tuple] = []  # (-score, id is null, id)

    def full(self) -> bool:
        return len(self.rows) >= self.top

    def add(self, rows: list[tuple]) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: r[:2] if r[1] else r)[: self.top]


def _search(shard: Shard, terms: np.ndarray, ids: list, best: _Best) -> None:
    """Put the shard's documents that belong among the best there. `ids` are sorted, null last."""
    start = np.zeros(1, np.int64)
    low, high = shard.place(terms, start), shard.place(terms, start + shard.documents)
    there = (high > low)[0]
    if not there.any():
        return
    terms, low, high = terms[there], low[:, there], high[:, there]
    begin = start
    known = len(ids) - sum(1 for _ in _nulls(ids))
    while len(begin):
        impact, at = shard.greatest(low, high)
        bound = impact.sum(axis=1)
        hope = bound > 0
        if best.full():
            least, null, worst = (-best.rows[-1][0], best.rows[-1][1], best.rows[-1][2])
            # Documents of the same score count only up to the last of the best.
            limit = len(ids) if null else bisect_left(ids, worst, 0, known)
            hope &= (bound > least) | ((bound == least) & (begin < limit))
        keep = np.flatnonzero(hope)
        if not len(keep):
            return
        order = keep[np.lexsort((begin[keep], -bound[keep]))]
        now, later = order[:_SPLIT_AT_ONCE], order[_SPLIT_AT_ONCE:]
        row = np.arange(len(now))
        pivot = shard.document[at[now][row, impact[now].argmax(axis=1)]]
        middle = shard.place(terms, pivot)
        holds = (middle < high[now]) & (shard.document[np.minimum(middle, len(shard.document) - 1)] == pivot[:, None])
        score = np.where(holds, shard.impact[np.minimum(middle, len(shard.impact) - 1)], 0).sum(axis=1)
        best.add([(-s, ids[p] is None, ids[p]) for s, p in zip(score.tolist(), pivot.tolist(), strict=True)])
        begin = np.concatenate([begin[later], begin[now], pivot + 1])
        low, high = (
            np.concatenate([low[later], low[now], middle + holds]),
            np.concatenate([high[later], middle, high[now]]),
        )


def _nulls(ids: list) -> Iterator[None]:
    for x in reversed(ids):
        if x is not None:
            return
        yield x


def _shards(batches: Iterable[pa.RecordBatch], max_bytes: int, max_rows: int) -> Iterator[pa.Table]:
    """Documents in the order of their ids, null last, with so many bytes of text and rows together, or one."""
    parts, held, rows = [], 0, 0

    def together() -> pa.Table:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table.take(pc.sort_indices(table.column(0), null_placement="at_end"))

    small = (b.slice(i, max_rows) for b in batches for i in range(0, b.num_rows, max_rows))
    for piece in pieces(small, 1, max_bytes):
        size = pc.sum(pc.binary_length(piece.column(1))).as_py() or 0
        if parts and (held + size > max_bytes or rows + piece.num_rows > max_rows):
            yield together()
            parts, held, rows = [], 0, 0
        parts.append(piece)
        held += size
        rows += piece.num_rows
    if parts:
        yield together()


def _searcher(items, corpus, top: int, kind: pa.DataType, shard_bytes: int) -> Callable:
    """For mapInArrow: the best documents of the task for every item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = items.value, corpus.value
        best = [_Best(top) for _ in wanted.of_item]
        max_rows = max(1, _SHARD_PLACES // max([1, *map(len, wanted.of_item)]))
        for table in _shards(batches, shard_bytes, max_rows):
            shard = Shard(table.column(1), wanted.terms, known)
            ids = table.column(0).to_pylist()
            for terms, found in zip(wanted.of_item, best, strict=True):
                if len(terms):
                    _search(shard, terms, ids, found)
        rows = [(i, r[2], -r[0]) for i, found in enumerate(best) for r in found.rows]
        numbers, ids, scores = zip(*rows, strict=True) if rows else ((), (), ())
        columns = [pa.array(numbers, pa.int32()), pa.array(ids, kind), pa.array(scores, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "id", "score"])

    return run


def _item_blocks(items: DataFrame, max_bytes: int) -> Iterator[list]:
    """Different items, in blocks of so many text bytes, about, or one item."""
    items = items.filter("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // max_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for k in range(blocks):
        yield items.filter(part == k).collect()


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    shard_bytes: int = SHARD_BYTES,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The `top` documents of every item by score, those above 0: item id, `rank` from 1, document id and `score`.

    Terms are runs of letters and digits, with every character beyond ASCII counting as one, after A-Z have been
    lower-cased. With N documents that have terms, L terms in them, n terms in the document, tf times this one,
    which df documents hold, a term adds floor(1000 ln((2N+2)/(2df+1))) * (1000000000 tf div (1000 tf + 8 m)) with
    m = 10 + 90 n N div L. A term of an item counts once. Equal scores rank by id, null last.

    Null and empty texts have no terms, on either side: such items get no rows, such documents are never found and
    count nowhere. Repeated documents are ranked each; items that repeat id and text are one item, items that
    repeat the id only are ranked apart. Ids are of any ordered type; further columns are left out; an empty table
    on either side gives an empty one.

    Terms are compared by 64-bit hashes. Documents are not shuffled; they are read twice for each block of items of
    `item_bytes` of text. A task indexes `shard_bytes` of text at once and hands on `top` rows for each item at most.
    """
    rows = only(docs, id_column, text_column).toDF("id", "text")
    asked = only(items, item_column, item_text_column).toDF("item", "text")
    kind, item_kind = rows.schema["id"].dataType, asked.schema["item"].dataType
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    arrow = pa.schema(rows.select("id").limit(0).toArrow().schema).field(0).type
    ranked = []
    for block in _item_blocks(asked, item_bytes):
        read = read_items([r["text"] for r in block])
        shared = context.broadcast(read)
        corpus = context.broadcast(statistics(rows, shared, len(read.terms)))
        searcher = _searcher(shared, corpus, top, arrow, shard_bytes)
        hits = rows.mapInArrow(searcher, f"item int, id {kind.simpleString()}, score bigint")
        order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
        # An item's hits are as many as tasks: they are ranked in parts first.
        part = Window.partitionBy("item", F.pmod(F.xxhash64("id", "score"), F.lit(_PARTS))).orderBy(*order)
        hits = hits.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
        names = spark.createDataFrame(
            [(i, r["item"]) for i, r in enumerate(block)], f"item int, item_id {item_kind.simpleString()}"
        )
        ranked.append(hits.filter(F.col("rank") <= top).join(names, "item"))
    out = ranked[0]
    for more in ranked[1:]:
        out = out.unionAll(more)
    return out.select(F.col("item_id").alias(item_column), "rank", F.col("id").alias(id_column), "score")
