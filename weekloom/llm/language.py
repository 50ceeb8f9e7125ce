"""Language identification by error-correcting output codes.

Every language has a codeword. One binary classifier for each bit, a logistic model over hashed byte
n-grams, predicts that bit; decoding takes the language whose codeword has the least total logistic loss,
with bits weighted by how well they were learned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.frames import only
from weekloom.llm.words import pieces, random_words, text_bytes

#: Hashed n-grams.
WIDTH = 1 << 12
#: Documents that the bit classifiers are fitted on, about, over all languages.
SAMPLE = 3000
UNKNOWN = "und"
#: A prediction is ambiguous if the second language's probability comes this near to the first's.
AMBIGUOUS = 0.2

_FACTORS = (random_words(3, 41) | np.uint64(1)).astype(np.uint32) | np.uint32(1)


def _letters() -> np.ndarray:
    """Letters in lower case and bytes beyond ASCII as they are, all else as a space."""
    table = np.full(256, 32, np.uint32)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_LETTER = _letters()


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hashed 3-gram that begins at every byte. Beyond the end of its text there are spaces."""
    plain = np.r_[_LETTER[data], np.uint32(32), np.uint32(32)]
    second, third = plain[1:-1].copy(), plain[2:].copy()
    last = offsets[1:][np.diff(offsets) > 0] - 1
    second[last] = third[last] = third[last[last > 0] - 1] = 32
    value = plain[:-2] * _FACTORS[0] + second * _FACTORS[1] + third * _FACTORS[2]
    value ^= value >> np.uint32(15)
    return ((value * np.uint32(2246822519)) >> np.uint32(20)).astype(np.int64)


def code_words(languages: int) -> np.ndarray:
    """A codeword of -1 and 1 for each language.

    All ways to split up to five languages in two; random splits, as far apart as a few tries get, for more.
    """
    if languages <= 5:
        bits = max(1, 2 ** (languages - 1) - 1)
        numbers = np.arange(1, bits + 1)
        return np.stack([np.ones(bits), *[1 - 2.0 * (numbers >> i & 1) for i in range(languages - 1)]])[:languages]
    bits = int(np.ceil(10 * np.log2(languages)))
    best, apart = None, -1
    for seed in range(20):
        code = np.where(np.random.default_rng(seed).random((languages, bits)) < 0.5, -1.0, 1.0)
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        near = min(int((code[i] != code[j]).sum()) for i in range(languages) for j in range(i))
        if near > apart:
            best, apart = code, near
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its probability and whether it is ambiguous, for each text."""
        n = len(texts)
        data, offsets = text_bytes(texts)
        names, score, ambiguous = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
        has_letter = _with_letter(data, offsets)
        if not self.languages or not has_letter.any():
            return names, score, ambiguous
        found = grams(data, offsets)
        lengths = np.maximum(np.diff(offsets), 1)
        some = np.flatnonzero(np.diff(offsets) > 0)
        margins = np.zeros((n, len(self.bias)))
        for bit in range(len(self.bias)):
            margins[some, bit] = np.add.reduceat(self.weight[:, bit][found], offsets[some])
        margins = margins / lengths[:, None] + self.bias
        loss = np.zeros((n, len(self.languages)))
        for k in range(len(self.languages)):
            loss[:, k] = np.logaddexp(0, -margins * self.code[k]) @ self.trust
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        ranked = np.sort(share, axis=1)
        score = np.where(has_letter, ranked[:, -1], 0.0)
        if len(self.languages) > 1:
            ambiguous = has_letter & (ranked[:, -1] - ranked[:, -2] < AMBIGUOUS)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has_letter.tolist(), strict=True)]
        return names, score, ambiguous


def _with_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter of any script."""
    if not len(data):
        return np.zeros(len(offsets) - 1, bool)
    ascii_letter = (data | 32) - np.uint8(97) < 26
    out = np.diff(np.r_[0, np.cumsum(ascii_letter)][offsets]) > 0
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
        out[i] = any(c.isalpha() for c in text)
    return out


def _gradient_fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Logistic models for all columns of y (-1 or 1) at once, by accelerated gradient steps."""
    n = len(x)
    x1 = np.c_[x, np.ones((n, 1), x.dtype)]
    direction = np.ones(x1.shape[1], x.dtype)
    for _ in range(20):  # the largest curvature, by power iteration
        direction = x1.T @ (x1 @ direction)
        size = float(np.linalg.norm(direction))
        direction /= max(size, 1e-12)
    step = 3.6 / max(size / n, 1e-9)
    theta = np.zeros((x1.shape[1], y.shape[1]))
    ahead, t = theta, 1.0
    for _ in range(rounds):
        push = -y / (1 + np.exp(np.clip(y * (x1 @ ahead.astype(x.dtype)), -30, 30)))
        new = ahead - step * (x1.T @ push.astype(x.dtype) / n + penalty * ahead)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, theta = new + (before - 1) / t * (new - theta), new
    return theta[:-1], theta[-1]


def fit(counts: np.ndarray, labels: list[str]) -> Model:
    """Bit classifiers from rows of n-gram counts and their languages. Without rows nothing is ever predicted."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        one = np.ones((len(languages), 1))
        return Model(languages, one, np.zeros((WIDTH, 1)), np.full(1, 3.0), np.ones(1))
    code = code_words(len(languages))
    share = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    scale = 1 / (share.std(axis=0) + 1e-4)
    center = share.mean(axis=0)
    x = (share - center) * scale / np.float32(np.sqrt(WIDTH))
    place = {name: i for i, name in enumerate(languages)}
    y = code[[place[name] for name in labels]]
    weight, bias = _gradient_fit(x, y)
    right = (np.sign(x @ weight + bias) == y).mean(axis=0)
    trust = np.log((right + 0.01) / (1.01 - right))
    weight = weight * (scale / np.sqrt(WIDTH))[:, None]
    return Model(languages, code, weight, bias - center @ weight, np.maximum(trust / trust.max(), 0.01))


def train(
    docs: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang"
) -> Model:
    """Learn from about `sample` documents, the same number of each language, those with the least hashes.

    Rows without a language or text are left out. What reaches the driver are n-gram counts of the sample.
    """
    rows = only(docs, id_column, text_column, language_column).toDF("id", "text", "lang")
    rows = rows.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return fit(np.empty((0, WIDTH)), [])
    each = -(-sample // len(sizes))
    span = 1 << 20
    shares = [(name, min(span, int(span * each / size) + 1)) for name, size in sizes.items()]
    # One row for each language, joined without a hint: a plan as deep for a thousand languages as for two.
    share = docs.sparkSession.createDataFrame(shares, f"lang {rows.schema['lang'].dataType.simpleString()}, share bigint")
    picked = F.pmod(F.xxhash64("id", "text"), F.lit(span)) < F.col("share")
    found = rows.join(share, "lang").filter(picked).select("lang", "text").mapInArrow(_counts_of, "lang string, counts binary").toArrow()
    counts = [np.frombuffer(c, np.float32) for c in found.column("counts").to_pylist()]
    return fit(np.stack(counts) if counts else np.empty((0, WIDTH)), found.column("lang").to_pylist())


def _counts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        data, offsets = text_bytes(batch.column(1))
        found = grams(data, offsets)
        rows = [
            np.bincount(found[a:b], minlength=WIDTH).astype(np.float32).tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "counts"])


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, `lang_pred`, `score` (its probability) and `ambiguous` for every row, from the whole text alone.

    A text that is null or has no letter of any script is `und` with score 0; repeated rows get the same
    result; further columns are left out; an empty table gives an empty one. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    frame = only(docs, id_column, text_column)
    kind = frame.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            names, score, ambiguous = sent.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(ambiguous)],
                [id_column, "lang_pred", "score", "ambiguous"],
            )

    return frame.mapInArrow(run, f"`{id_column}` {kind}, lang_pred string, score double, ambiguous boolean")
