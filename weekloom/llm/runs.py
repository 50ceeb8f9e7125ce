"""Periodic runs of words: stretches that repeat themselves with one period, and texts with each run cut down
to its first period.

Every run has a Lyndon root, and the root that starts at a word, if any, is the longest Lyndon word that does,
in the order of the words or in that order turned round. So the candidates are two per word; each is extended
in both directions by longest common extensions, which suffix trees of the words and of their reversal give in
constant time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.frames import only
from weekloom.llm.suffixtree import Extensions, SuffixTree
from weekloom.llm.words import SPACED, Words, gram_hashes, inside_one_text, mix, pieces, random_words, read_words

MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Text bytes that are looked at together, or one text.
_PIECE = 2 << 20


def _lyndon_ends(rank: list[int]) -> np.ndarray:
    """Where the longest Lyndon word from every place ends: at the next suffix that comes earlier."""
    n = len(rank)
    out = [n] * n
    stack: list[int] = []
    for i in range(n):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def find_runs(symbols: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Runs of `symbols`, numbers from 1 on: rows of start, length and smallest period, by start and period."""
    n = len(symbols)
    if n < max(min_length, 2):
        return np.empty((0, 3), np.int64)
    tree = SuffixTree(symbols)
    forward, backward = Extensions(tree), Extensions(SuffixTree(symbols[::-1]))
    at = np.arange(n)
    found = []
    for descending in (False, True):
        end = _lyndon_ends(tree.ranks(descending)[:n])
        period = end - at
        left = backward.lengths(n - at, n - end)
        right = forward.lengths(at, end)
        length = left + period + right
        good = length >= np.maximum(min_length, min_exponent * period)
        found.append(np.stack([at - left, length, period], axis=1)[good])
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _live_stretches(words: Words, min_length: int, min_exponent: int) -> Iterator[tuple[int, int, int]]:
    """Text, first word and end of all stretches that can hold runs.

    In a run every gram of a few words comes again in the same run, one period on or one period back. A stretch
    without a gram that its text has only once is all that is left to look at; neighbours of a stretch are in no
    run, so runs of a stretch are runs of the text.
    """
    gram = max(1, min_length // 3) if min_exponent >= 3 else 1
    hashes = gram_hashes(words.hashes, gram)
    inside = np.flatnonzero(inside_one_text(words.first, gram))
    if not len(inside):
        return
    text = words.text_of_word()[inside]
    with np.errstate(over="ignore"):
        key = mix(hashes[inside] ^ (random_words(1, 11)[0] * (text.astype(np.uint64) + np.uint64(1))))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    going = np.zeros(len(words.hashes) + 2, bool)
    going[inside[again] + 1] = True
    # A text's last grams cross into the next text and are never marked, unless grams are single words.
    cut = going[1:] & ~going[:-1]
    stop = ~going[1:] & going[:-1]
    begins, ends = np.flatnonzero(cut), np.flatnonzero(stop)
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        while b < e:
            t = int(np.searchsorted(words.first, b, "right")) - 1
            until = min(e, int(words.first[t + 1]))
            if until - b + gram - 1 >= min_length:
                yield t, b - int(words.first[t]), until + gram - 1 - int(words.first[t])
            b = until


def text_runs(
    texts: pa.Array, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> tuple[list[list[bytes]], dict[int, np.ndarray]]:
    """The words of all texts, and the runs of those that have some."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    split = [t.split() for t in raw]
    found: dict[int, list[np.ndarray]] = {}
    for t, begin, end in _live_stretches(read_words(texts, SPACED), min_length, min_exponent):
        number: dict[bytes, int] = {}
        symbols = [number.setdefault(w, len(number) + 1) for w in split[t][begin:end]]
        runs = find_runs(symbols, min_length, min_exponent)
        if len(runs):
            found.setdefault(t, []).append(runs + np.array([begin, 0, 0]))
    return split, {t: np.concatenate(parts) for t, parts in found.items()}


def _collapsed(words: list[bytes], runs: np.ndarray | None) -> bytes:
    if runs is None:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _runs_column(found: dict[int, np.ndarray], n: int) -> pa.Array:
    counts = np.zeros(n, np.int64)
    for t, runs in found.items():
        counts[t] = len(runs)
    rows = np.concatenate([found[t] for t in sorted(found)]) if found else np.empty((0, 3), np.int64)
    fields = [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)]
    values = pa.StructArray.from_arrays(fields, fields=list(_RUNS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values).cast(_RUNS)


def _collapser(min_length: int, min_exponent: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, _PIECE):
            split, found = text_runs(batch.column(1), min_length, min_exponent)
            texts = [_collapsed(words, found.get(t)) for t, words in enumerate(split)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(words) for words in split], pa.int64()),
                    _runs_column(found, len(split)),
                    pa.array(texts, pa.binary()).cast(batch.column(1).type),
                ],
                names=["id", "n_words", "runs", "collapsed_text"],
            )

    return run


def collapse_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Periodic runs of every text: the id, `n_words`, `runs` (start, length and smallest period in words, by
    start and period) and `collapsed_text`, the words joined by one space without those that any run holds after
    its first period. A row per row, in the order of the input.

    Words are runs without white space (space and U+0009 to U+000D), as they are. A run has `min_length` words
    and `min_exponent` (2 or more) periods at least, and no word beside it goes on with its period. Null and
    empty texts have no words and no runs; ids are of any type and may be null or repeated; further columns are
    left out; an empty table gives an empty one.

    Rows are not shuffled. Only stretches of a text whose every gram of `min_length` / 3 words comes twice get
    suffix trees, of some 1 kB per word; the rest of a text cannot hold a run.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period: min_exponent is 2 or more")
    rows = only(docs, id_column, text_column).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text string"
    found = rows.mapInArrow(_collapser(min_length, min_exponent), schema)
    return found.withColumnRenamed("id", id_column)
