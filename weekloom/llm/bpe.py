"""Byte-pair encoding of whole texts, and back.

The merges of a piece of a partition are done together. Its distinct words lie in one flat array of
symbols, an index maps every pair that has a rank to all positions where it stands, and the ranks
that are active are taken in ascending order: one rank is applied at all its positions at once, and
the pairs this makes are added to the lists of their ranks. Ranks only ever create pairs of higher
rank in a trained vocabulary; a heap keeps the order right in any case.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from weekloom.llm.frames import only
from weekloom.llm.words import mix, pieces, random_words, run_hashes, text_bytes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Endings that stand apart after an apostrophe; fixed values of this kind of tokenizer.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_WHITE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_SIDE = 1 << 16

_classes: np.ndarray | None = None


def character_classes() -> np.ndarray:
    """White space, letter, number or other, for every code point."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter(
            (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
        )
        table[_WHITE] = SPACE
        _classes = table
    return _classes


def word_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin in texts given as code points; text i is points[offsets[i]:offsets[i + 1]].

    A word is a run of letters, of numbers or of other characters, with a space before it if there is
    one; a contraction; or white space, of which the last character before a word stands apart.
    """
    n = len(points)
    if n == 0:
        return np.empty(0, np.int64)
    kind = character_classes()[points]
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start |= border[:n]
    # White space before a word: its last character begins a word of its own, or the next word if it is a space.
    last = (kind == SPACE) & np.r_[start[1:], True] & ~border[1:]
    at = np.flatnonzero(last)
    at = at[at + 1 < n]
    start[at] = True
    joined = at[points[at] == 32] + 1
    start[joined] = False
    # Contractions: an apostrophe that begins a word and has letters right after it.
    quotes = np.flatnonzero(start & (points == 39))
    for q in quotes.tolist():
        stop = q + 1
        while stop < n and stop < q + 3 and kind[stop] == LETTER and not border[stop]:
            stop += 1
        tail = "".join(map(chr, points[q + 1 : stop]))
        for ending in CONTRACTIONS:
            if tail.startswith(ending):
                start[q + 1] = False
                after = q + 1 + len(ending)
                if after < n:
                    start[after] = True  # a new run, or the rest of the letters
                break
    return np.flatnonzero(start)


class Bpe:
    """A byte-level vocabulary with ranked merges, from the JSON text of a tokenizer file."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocabulary: dict[str, int] = model["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        byte_of = {symbol: byte for byte, symbol in _byte_symbols().items()}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for token, i in vocabulary.items():
            raw[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.array([len(r) for r in raw], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.byte_id = np.array([vocabulary[_byte_symbols()[b]] for b in range(256)], np.int64)
        self.left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        self.right = np.array([vocabulary[b] for _, b in merges], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        # All ranked pairs in order of their key, to look many pairs up at once.
        keys = self.left * _SIDE + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 without one."""
        key = left * _SIDE + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words given as bytes; word i is data[first[i]:first[i + 1]]. Returns tokens and their offsets."""
        n = len(data)
        ids = self.byte_id[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[first[1:] - 1] = -1
        before[first[:-1]] = -1
        alive = np.ones(n, bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(positions: np.ndarray) -> None:
            """Enter pairs that begin at these positions into the lists of their ranks."""
            positions = positions[after[positions] >= 0]
            rank = self.rank_of(ids[positions], ids[after[positions]])
            known = rank >= 0
            rank, positions = rank[known], positions[known]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, positions = rank[order], positions[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            lists = np.split(positions, cut) if len(cut) else [positions]
            for r, some in zip(rank[np.r_[0, cut]].tolist(), lists, strict=True):
                if r in index:
                    index[r].append(some)
                else:
                    index[r] = [some]
                    heapq.heappush(active, r)

        note(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, made = int(self.left[rank]), int(self.right[rank]), int(self.made[rank])
            partner = after[at]
            good = (ids[at] == a) & (partner >= 0) & alive[at]
            good &= ids[partner] == b
            at = at[good]
            if a == b and len(at) > 1:  # of pairs that overlap, every second one from the left
                at = np.unique(at)
                chained = np.r_[False, before[at[1:]] == at[:-1]]
                place = np.arange(len(at))
                begin = np.maximum.accumulate(np.where(chained, 0, place))
                at = at[(place - begin) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            ids[at] = made
            alive[gone] = False
            nxt = after[gone]
            after[at] = nxt
            linked = nxt >= 0
            before[nxt[linked]] = at[linked]
            previous = before[at]
            previous = previous[previous >= 0]
            previous = previous[ids[previous] != made]
            note(np.concatenate((previous, at)))
        kept = np.concatenate(([0], np.cumsum(alive)))
        return ids[alive], kept[first]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts and where each text's begin; null counts as empty."""
        data, offsets = text_bytes(texts)
        plain = data.tobytes()
        marks = [s.encode() for s in self.special if s.encode() in plain]
        owner, cuts, between = None, offsets, []
        if marks:
            cuts, owner, between = self._split_at_special(plain, offsets)
            data = np.frombuffer(b"".join(plain[a:b] for a, b in cuts), np.uint8)
            cuts = np.r_[0, np.cumsum([b - a for a, b in cuts])].astype(np.int64)
        tokens, first = self._encode_plain(data, cuts)
        if owner is None:
            return tokens, first
        out, counts = [], np.zeros(len(offsets) - 1, np.int64)
        for k, text in enumerate(owner):
            part = tokens[first[k] : first[k + 1]]
            if between[k] is not None:
                part = np.r_[part, between[k]]
            out.append(part)
            counts[text] += len(part)
        return (np.concatenate(out) if out else tokens), np.r_[0, np.cumsum(counts)]

    def _split_at_special(self, plain: bytes, offsets: np.ndarray):
        """Parts between special tokens: byte ranges, the text of each, and the special token after it."""
        import regex

        pattern = regex.compile(b"|".join(regex.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True)))
        cuts, owner, between = [], [], []
        for text, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            at = low
            for found in pattern.finditer(plain, low, high):
                cuts.append((at, found.start()))
                owner.append(text)
                between.append(self.special[found.group().decode()])
                at = found.end()
            cuts.append((at, high))
            owner.append(text)
            between.append(None)
        return cuts, owner, between

    def _encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        head = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of every code point
        starts = head[word_starts(points, np.searchsorted(head, offsets))]
        # Words count as equal by a hash of their bytes; the text made from the tokens is compared below.
        codes, _ = pd.factorize(run_hashes(data, starts, _BYTES))
        order = np.zeros(codes.max() + 1, np.int64)
        order[codes[::-1]] = np.arange(len(codes))[::-1]  # the first place of every distinct word
        lengths = np.diff(np.r_[starts, len(data)])
        firsts = np.r_[0, np.cumsum(lengths[order])]
        distinct = data[_ranges(starts[order], lengths[order])]
        if not np.array_equal(distinct[_ranges(firsts[codes], lengths[order][codes])], data):
            firsts, distinct, codes = np.r_[starts, len(data)], data, np.arange(len(starts))
        tokens, first = self.encode_words(distinct, firsts)
        counts = np.diff(first)[codes]
        total = np.r_[0, np.cumsum(counts)]
        return tokens[_ranges(first[codes], counts)], total[np.searchsorted(starts, offsets)]

    def decode(self, tokens: np.ndarray) -> bytes:
        """The bytes that the tokens stand for, special tokens included."""
        return self.raw[_ranges(self.offset[tokens], self.length[tokens])].tobytes()


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] places, then the same from start[1], and so on."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)


_BYTES = mix(random_words(256, 11)) | np.uint64(1)


def _byte_symbols() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as they are, the rest from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Text that is encoded at a time; its arrays take about thirty times as much memory.
PIECE_BYTES = 2 << 20


def read_tokenizer(path: str) -> Bpe:
    return Bpe(Path(path).read_text(encoding="utf-8"))


def encode_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokens of every whole text: the id, `ids` (array of int) and `decoded` (the text made from them).

    `tokenizer` is the path of a tokenizer file; the driver reads it and broadcasts its tables (a few MB,
    whatever the size of the data). A null text counts as empty and gives no tokens; repeated rows give repeated
    rows; further columns are left out; an empty table gives an empty one. One pass, no shuffle: memory is
    bounded by a piece of 2 MB of text, or by the longest text.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, first, decoded in _encoded(batches, model):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(tokens, pa.int32())), pa.array(decoded)],
                [id_column, "ids", "decoded"],
            )

    frame = only(docs, id_column, text_column)
    kind = frame.schema[id_column].dataType.simpleString()
    return frame.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, decoded string")


def token_digests(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As `encode_documents`, with the number of tokens and SHA-256 digests of tokens and text in their place.

    Digests are taken where the tokens are, so that tokens need not be sent back from the Python worker.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, first, decoded in _encoded(batches, model):
            packed = tokens.astype("<u4")
            bounds = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([hashlib.sha256(packed[a:b].tobytes()).hexdigest() for a, b in bounds], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                ],
                [id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    frame = only(docs, id_column, text_column)
    kind = frame.schema[id_column].dataType.simpleString()
    return frame.mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _encoded(batches: Iterable[pa.RecordBatch], model) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[str]]]:
    """Per piece: ids, tokens, their offsets, and the texts decoded from them."""
    for batch in pieces(batches, 1, PIECE_BYTES):
        tokens, first = model.value.encode(batch.column(1))
        raw = model.value.decode(tokens)
        ends = np.r_[0, np.cumsum(model.value.length[tokens])][first]
        decoded = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield batch.column(0), tokens, first, decoded
