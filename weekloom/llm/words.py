"""Texts of an Arrow batch as arrays of 64-bit word hashes.

Everything here is array work on the bytes of a whole batch, so a batch costs a fixed number of
numpy calls however many texts and words it has. Word identity is a 64-bit hash of the word's bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20
_SLICE = 1 << 20
_POWER = 0x9E6C63D0876A9A47 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """The same `n` pseudo-random 64-bit values on every machine."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * step)


@dataclass(frozen=True)
class Alphabet:
    """Which bytes make up words, and a value for each of them."""

    is_word: np.ndarray
    value: np.ndarray


def _alphabet(separators: Iterable[int], lower: bool) -> Alphabet:
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    value = random_words(256, 7) | np.uint64(1)
    if lower:
        value[65:91] = value[97:123]
    value[~is_word] = 0
    return Alphabet(is_word, value)


_SPACES = [0x20, *range(0x09, 0x0E)]
#: `[^\x20\x09-\x0D]+`, as it stands or with A-Z in lower case.
SPACED = _alphabet(_SPACES, lower=False)
SPACED_LOWER = _alphabet(_SPACES, lower=True)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z have been lower-cased.
ALPHANUMERIC = _alphabet(
    [b for b in range(128) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)], lower=True
)


@dataclass
class Words:
    """Words of several texts, one after another.

    `start` and `end` are byte positions in `data`; the words of text i are first[i] to first[i + 1].
    """

    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    first: np.ndarray
    alphabet: Alphabet

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def end(self) -> np.ndarray:
        stop = _starts(~self.alphabet.is_word[self.data], self.offsets, after=True)
        return stop

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _starts(inside: np.ndarray, offsets: np.ndarray, after: bool = False) -> np.ndarray:
    """Where runs of `inside` begin; no run crosses a text. With `after`, where words end."""
    if after:  # first byte after each run of word bytes
        word = ~inside
        stop = np.empty(len(word) + 1, bool)
        stop[0] = False
        stop[-1] = word[-1] if len(word) else False
        stop[1:-1] = word[:-1] & inside[1:]
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(word))]
        stop[borders] |= word[borders - 1]
        return np.flatnonzero(stop)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    borders = offsets[:-1]
    borders = borders[borders < len(inside)]
    begin[borders] = inside[borders]
    return np.flatnonzero(begin)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _SLICE
    while size < n:
        size *= 2
    if size not in _powers:
        inverse = pow(_POWER, -1, 1 << 64)
        with np.errstate(over="ignore"):
            tables = tuple(
                np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, p, np.uint64)]) for p in (_POWER, inverse)
            )
        if size > _SLICE:
            return tables  # a word longer than a slice: not worth keeping
        _powers[size] = tables
    return _powers[size]


def run_hashes(data: np.ndarray, start: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A hash for the bytes from each start to the next; bytes of value 0 don't count.

    A polynomial over the bytes, summed run by run. Work goes by slices that end between runs.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(start, start[i] + _SLICE, "right")) - 1)
            low, high = int(start[i]), int(start[j]) if j < len(start) else len(data)
            if high - low > _SLICE and j == len(start) and j - i > 1:
                j -= 1
                high = int(start[j])
            power, inverse = _power_tables(high - low)
            local = start[i:j] - low
            out[i:j] = np.add.reduceat(value[data[low:high]] * power[: high - low], local) * inverse[local]
            i = j
    return mix(out)


def read_words(texts: pa.Array, alphabet: Alphabet) -> Words:
    data, offsets = text_bytes(texts)
    start = _starts(alphabet.is_word[data], offsets) if len(data) else np.empty(0, np.int64)
    hashes = run_hashes(data, start, alphabet.value)
    return Words(data, offsets, hashes, start, np.searchsorted(start, offsets), alphabet)


def gram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash for every n consecutive words, whatever text they are in."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    weights = random_words(n, 100 + seed) | np.uint64(1)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total += hashes[k : len(hashes) - n + 1 + k] * weights[k]
    return mix(total)


def inside_one_text(first: np.ndarray, n: int) -> np.ndarray:
    """For every n-gram over all words: does it lie in one text?"""
    words = int(first[-1])
    fits = np.ones(max(0, words - n + 1), bool)
    for k in range(1, n):  # a gram that starts k words before a text ends runs over, if k < n
        at = first[1:-1] - k
        at = at[(at >= 0) & (at < len(fits))]
        fits[at] = False
    return fits


def pieces(batches: Iterable[pa.RecordBatch], column: str | int, max_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many bytes of `column`, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        i, before = 0, 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(i, j - i)
            i, before = j, int(ends[j - 1])
