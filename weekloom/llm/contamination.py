"""Passages of benchmark items in documents, found by suffix arrays over the documents.

Each piece of a partition becomes a shard with a suffix array over its words. Every suffix of an item
that begins a window is looked up by binary search, one word deeper at a time, in all shards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.frames import only
from weekloom.llm.words import ALPHANUMERIC, Words, pieces, read_words
from weekloom.operators.ordered import running_total
from weekloom.session import materialize

WINDOW = 13
#: Text of benchmark items that is sent to the tasks at a time; a larger benchmark goes in several rounds.
BLOCK_BYTES = 32 << 20


class SuffixArray:
    """Word positions of a shard in the order of the words from there on, as far as `depth` words.

    A mark (code 0) stands after every text, so no match runs into the next text.
    """

    def __init__(self, words: Words, depth: int):
        texts = len(words.first) - 1
        n = len(words.hashes) + texts
        self.bits = max(1, int(n).bit_length())
        self.hashes = np.zeros(n, np.uint64)
        # Word j of text i stands at j + i.
        self.place = np.arange(len(words.hashes)) + words.text_of_word()
        self.hashes[self.place] = words.hashes
        self.codes = self.hashes >> np.uint64(self.bits)
        self.order = self._sorted(depth)

    def _sorted(self, depth: int) -> np.ndarray:
        n, bits = len(self.codes), self.bits
        mask = np.uint64((1 << bits) - 1)
        keys = np.sort((self.codes << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
        order = (keys & mask).astype(np.int64)
        codes = keys >> np.uint64(bits)
        slots = np.arange(n)
        fresh = np.r_[True, codes[1:] != codes[:-1]]
        rank = np.zeros(n + depth, np.int64)
        start = slots[np.maximum.accumulate(np.where(fresh, np.arange(n), 0))]
        rank[order] = start
        tied = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]) & (codes != 0))
        step = 1
        while step < depth and len(tied):  # places that agree so far are put in order by what follows
            at = order[tied]
            if 3 * bits <= 64:
                key = (rank[at] << (2 * bits)) | (rank[at + step] << bits) | at
                at = np.sort(key.view(np.uint64)).view(np.int64) & ((1 << bits) - 1)
            else:  # a text of millions of words
                at = at[np.lexsort((rank[at + step], rank[at]))]
            a, b = rank[at], rank[at + step]
            fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            order[tied] = at
            rank[at] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            tied = tied[~(fresh & np.r_[fresh[1:], True])]
            step *= 2
        return order

    def find(self, hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places where hashes[start[i]:start[i] + length[i]] occur: the places, and i for each."""
        codes = hashes >> np.uint64(self.bits)
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.order), np.int64)
        going = np.arange(len(start))
        for depth in range(int(length.max()) if len(length) else 0):
            going = going[(length[going] > depth) & (high[going] > low[going])]
            if not len(going):
                break
            wanted = codes[start[going] + depth]
            left = self._bisect(low[going], high[going], depth, wanted, False)
            high[going] = self._bisect(left, high[going], depth, wanted, True)
            low[going] = left
        counts = np.maximum(high - low, 0)
        who = np.repeat(np.arange(len(start)), counts)
        ends = np.cumsum(counts)
        at = self.order[np.arange(len(who)) + np.repeat(low - (ends - counts), counts)]
        # Codes are shortened hashes; whole ones decide.
        good = np.ones(len(at), bool)
        for depth in range(int(length.max()) if len(length) else 0):
            check = np.flatnonzero(good & (length[who] > depth))
            good[check] = self.hashes[at[check] + depth] == hashes[start[who[check]] + depth]
        return at[good], who[good]

    def _bisect(self, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        last = len(self.codes) - 1
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) >> 1
            here = self.codes[np.minimum(self.order[middle] + depth, last)]
            right = here <= wanted[open_] if after else here < wanted[open_]
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]


@dataclass
class Items:
    """Benchmark items of different text: their words, all their ids, and the windows to look for."""

    words: Words
    names: list[list[str]]
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray


def read_items(rows: list[tuple], window: int) -> Items:
    """Items from (id, text); items of the same text are looked up once, items without words never."""
    by_text: dict[str, set[str]] = {}
    for name, text in rows:
        by_text.setdefault(text or "", set()).add(str(name))
    words = read_words(pa.array(list(by_text), pa.string()), ALPHANUMERIC)
    start, length, item = [], [], []
    for i, n in enumerate(words.counts.tolist()):
        if n:
            begin = np.arange(max(1, n - window + 1)) + words.first[i]
            start.append(begin)
            length.append(np.full(len(begin), min(n, window)))
            item.append(np.full(len(begin), i))
    cat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return Items(words, [sorted(v) for v in by_text.values()], cat(start), cat(length), cat(item))


@dataclass
class Found:
    """What was found in the texts of a piece; lists and arrays have an entry for every text."""

    n_words: np.ndarray
    spans: list[list[tuple[int, int]]]
    items: list[set[str]]
    longest: np.ndarray


def search(texts: pa.Array, items: Items, window: int) -> Found:
    """Look up all windows of the items in the texts."""
    words = read_words(texts, ALPHANUMERIC)
    n = len(words.first) - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    names: list[set[str]] = [set() for _ in range(n)]
    longest = np.zeros(n, np.int64)
    if len(words.hashes) and len(items.start):
        array = SuffixArray(words, window)
        at, who = array.find(items.words.hashes, items.start, items.length)
        text = np.searchsorted(words.first + np.arange(n + 1), at, "right") - 1
        at = at - text  # word numbers without the marks
        length = items.length[who]
        # Occurrences that go on along a text and an item at once are one longer match.
        order = np.lexsort((at, at - items.start[who]))
        a, w = at[order], who[order]
        joined = (np.diff(a) == 1) & (np.diff(w) == 1) & (text[order][1:] == text[order][:-1])
        joined &= items.item[w[1:]] == items.item[w[:-1]]
        begin = np.flatnonzero(np.r_[True, ~joined]) if len(a) else np.empty(0, np.int64)
        end = np.r_[begin[1:], len(a)] - 1
        if len(begin):
            np.maximum.at(longest, text[order][begin], a[end] - a[begin] + length[order][begin])
        # Words covered by any of them.
        depth = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + length, -1)
        hit = np.cumsum(depth[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            while s < e:  # a run of covered words may go on from one text to the next
                t = int(np.searchsorted(words.first, s, "right")) - 1
                stop = min(e, int(words.first[t + 1]))
                spans[t].append((s - int(words.first[t]), stop - s))
                s = stop
        for pair in np.unique(text * len(items.names) + items.item[who]).tolist():
            names[pair // len(items.names)].update(items.names[pair % len(items.names)])
    return Found(words.counts, spans, names, longest)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + length - out[-1][0]))
        else:
            out.append((start, length))
    return out


def _blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple]]:
    """Distinct items with text in blocks of BLOCK_BYTES, ids included, and at most one item more; one block at least."""
    items = only(benchmark, id_column, text_column).toDF("id", "text").filter(F.octet_length("text") > 0).distinct()
    size = F.octet_length("text").cast("bigint") + F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(0)) + 8
    if (items.agg(F.sum(size)).first()[0] or 0) <= BLOCK_BYTES:
        yield [tuple(r) for r in items.collect()]
        return
    dealt = running_total(items, [F.xxhash64("id", "text"), "id", "text"], size, "upto")
    dealt = materialize(dealt.withColumn("block", F.floor((F.col("upto") - 1) / BLOCK_BYTES)).drop("upto"), "items")
    for i in range(dealt.agg(F.max("block")).first()[0] + 1):
        yield [tuple(r) for r in dealt.filter(F.col("block") == i).drop("block").collect()]


_SPANS = "array<struct<start:bigint,length:bigint>>"


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Benchmark passages in every document: id, `n_words`, `spans` (start and length of every stretch of
    words that windows cover), `items` (ids of the items with such windows, as text, sorted) and
    `longest` (words of the longest verbatim match).

    Words are runs of letters and digits, with every character beyond ASCII counting as one, after A-Z
    have been lower-cased. A window is `window` consecutive words of an item, or all of a shorter item.
    Null and empty texts have no words, on either side; a null item id is called None; repeated items
    count once, repeated documents are searched each; further columns are left out; without items or
    documents nothing is found.

    Documents are not shuffled. Distinct items go to the tasks in blocks of 32 MB of text and one item more at most;
    with more than one block the documents and what was found so far are written in between.
    """
    found = _searched(only(docs, id_column, text_column), 1, benchmark, window, item_column, item_text_column)
    return found.select(F.col("c0").alias(id_column), "n_words", "spans", "items", "longest")


def _searched(
    docs: DataFrame, text: int, benchmark: DataFrame, window: int, item_column: str, item_text_column: str
) -> DataFrame:
    """The columns of `docs` as c0, c1, ..., then spans, items, longest, n_words; `text` is a position."""
    frame = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumns(
        {
            "spans": F.lit(None).cast("array<struct<start:bigint,length:bigint>>"),
            "items": F.lit(None).cast("array<string>"),
            "longest": F.lit(0).cast("bigint"),
            "n_words": F.lit(0).cast("bigint"),
        }
    )
    schema = frame.schema
    for round_, rows in enumerate(_blocks(benchmark, item_column, item_text_column)):
        if round_:
            frame = materialize(frame, "passages")
        items = docs.sparkSession.sparkContext.broadcast(read_items(rows, window))
        frame = frame.mapInArrow(_searcher(items, text, window), schema)
    return frame


def _searcher(items, text: int, window: int):
    """A function for mapInArrow that fills in the last four columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found = search(batch.column(text), items.value, window)
            spans, names, longest = found.spans, found.items, found.longest
            old = batch.columns[-4:]
            if old[0].null_count < batch.num_rows:  # from earlier blocks
                spans = [
                    _merge([*new, *((x["start"], x["length"]) for x in before)])
                    for new, before in zip(spans, old[0].to_pylist(), strict=True)
                ]
                names = [n.union(before) for n, before in zip(names, old[1].to_pylist(), strict=True)]
                longest = np.maximum(longest, old[2].to_numpy())
            filled = [
                pa.array([[{"start": s, "length": n} for s, n in x] for x in spans], old[0].type),
                pa.array([sorted(x) for x in names], old[1].type),
                pa.array(longest, pa.int64()),
                pa.array(found.n_words, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *filled], schema=batch.schema)

    return run


def _judged(found: DataFrame, least_share: int) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["length"])
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least_share >= F.col("n_words"))
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_share: int = 20, **columns: str
) -> DataFrame:
    """`find_passages` with `n_hit`, the number of covered words, and `contaminated`: at least one word in
    `least_share` is covered, and at least one at all."""
    return _judged(find_passages(docs, benchmark, window, **columns), least_share)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    least_share: int = 20,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """The documents that are not contaminated, with all their columns; see `contamination`.

    Rows are filtered where they are read, without a join.
    """
    found = _searched(docs, docs.columns.index(text_column), benchmark, window, item_column, item_text_column)
    kept = _judged(found, least_share).filter(~F.col("contaminated"))
    return kept.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
