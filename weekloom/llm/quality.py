"""Text quality by Naive Bayes support vectors.

Features are indicators of hashed n-grams: words and pairs of words as they stand, the shapes of words and
pairs of shapes, and runs of "same word as before". Each is scaled by the log ratio of its smoothed shares in the two classes, rows get length 1,
and a linear model with hinge loss is fitted by dual coordinate descent. A logistic curve over
cross-fitted margins turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.frames import only
from weekloom.llm.words import SPACED, gram_hashes, mix, pieces, random_words, read_words, run_hashes

#: Hashed features: words and their pairs below SHAPES, shapes and all else from there on.
BITS = 20
WIDTH = 1 << BITS
SHAPES = WIDTH >> 1
#: Labelled rows that the model is fitted on, about.
SAMPLE = 8192
THRESHOLD = 0.7
#: Runs of one word repeated, from three up to so many more, are n-grams of "same as before".
REPEATS = 6


def _shapes() -> np.ndarray:
    """Letters of one case, digits, and characters beyond ASCII look alike; the rest stand for themselves."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] = 65
    table[97:123] = 97
    table[48:58] = 48
    table[128:] = 97
    return table


_SHAPE = _shapes()
_VALUE = random_words(256, 31) | np.uint64(1)
_SALTS = random_words(4, 32) | np.uint64(1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text in ascending order, one text after another, and where each text's begin."""
    words = read_words(texts, SPACED)
    n = len(words.first) - 1
    if not len(words.hashes):
        return np.empty(0, np.int64), np.zeros(n + 1, np.int64)
    # A word's shape, with runs of alike characters as one: keep the first byte of each run and hash those.
    shape = _SHAPE[words.data]
    keep = np.r_[True, shape[1:] != shape[:-1]]
    keep[words.start] = True
    keep &= SPACED.is_word[words.data]
    shapes = run_hashes(shape[keep], (np.cumsum(keep) - 1)[words.start], _VALUE)
    text = words.text_of_word()
    alike = text[1:] == text[:-1]
    same = (words.hashes[1:] == words.hashes[:-1]) & alike
    pairs = shapes[:-1] * _SALTS[0] + shapes[1:] * _SALTS[1] + same.astype(np.uint64) * _SALTS[2]
    said = _codes([text, text[1:][alike]], [words.hashes, gram_hashes(words.hashes, 2)[alike]], 0)
    owner, value = [text, text[1:][alike]], [shapes, mix(pairs[alike])]
    run = same
    for k in range(REPEATS):  # the same word three times and more
        run = run[1:] & same[: len(run) - 1]
        at = np.flatnonzero(run)
        owner.append(text[at])
        value.append(np.full(len(at), mix(_SALTS[3:] + np.uint64(k))[0]))
    code = np.sort(np.r_[said, _codes(owner, value, SHAPES)])
    code = code[np.r_[True, code[1:] != code[:-1]]]
    return code & (WIDTH - 1), np.searchsorted(code >> BITS, np.arange(n + 1))


def _codes(owner: list[np.ndarray], value: list[np.ndarray], base: int) -> np.ndarray:
    """Text and feature in one number, features in the half of WIDTH that begins at `base`."""
    feature = (np.concatenate(value) & np.uint64(SHAPES - 1)).astype(np.int64)
    return np.concatenate(owner) << BITS | feature + base


@dataclass(frozen=True)
class Model:
    """Margin = sum(weight * scaled ratio) + bias over a text's features; a, b: the logistic curve."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    a: float
    b: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        found, first = features(texts)
        return 1 / (1 + np.exp(-(self.a * _margins(found, first, self.ratio, self.weight, self.bias) + self.b)))


def _scaled(found: np.ndarray, first: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Ratios of the features of each text, words and shapes at equal length, the whole at length 1.

    Every text is summed by itself, so that its values don't depend on its neighbours.
    """
    n = len(first) - 1
    values = ratio[found]
    part = 2 * np.repeat(np.arange(n), np.diff(first)) + (found >= SHAPES)
    length = np.sqrt(np.bincount(part, values**2, 2 * n))
    parts = np.maximum((length > 1e-6).reshape(n, 2).sum(axis=1), 1)
    return values / (np.maximum(length, 1e-6) * np.sqrt(np.repeat(parts, 2)))[part]


def _margins(found: np.ndarray, first: np.ndarray, ratio: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    return np.bincount(text, _scaled(found, first, ratio) * weight[found], n) + bias


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log of how much more often each feature occurs in class 1, with one more row of each class having all.
    A feature that no row has says nothing: 0."""
    counts = np.ones((2, WIDTH))
    for row, label in zip(rows, labels, strict=True):
        counts[int(label), row] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.where(counts.sum(axis=0) > 2, np.log(shares[1] / shares[0]), 0.0)


def dual_coordinate_descent(
    rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = 1.0, passes: int = 10
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * hinge losses, one dual variable at a time."""
    sign = np.where(labels > 0, 1.0, -1.0)
    scaled = [_scaled(row, np.array([0, len(row)]), ratio) for row in rows]
    square = np.array([v @ v + 1 for v in scaled])
    weight, bias, alpha = np.zeros(WIDTH), 0.0, np.zeros(len(rows))
    turn = np.random.default_rng(0)
    for _ in range(passes):
        for i in turn.permutation(len(rows)).tolist():
            slope = sign[i] * (weight[rows[i]] @ scaled[i] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                alpha[i] = new
                weight[rows[i]] += step * scaled[i]
                bias += step
    return weight, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * margin + b))), by Newton steps on targets drawn in a little from 0 and 1."""
    ones = labels.sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * theta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= step * min(1.0, 5 / max(float(np.abs(step).max()), 1e-9))
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, folds: int = 3) -> Model:
    """A model from feature rows and 0/1 labels. Without both classes, a constant score: the share of ones."""
    labels = np.asarray(labels, float)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0, float(np.log(share / (1 - share))))
    fold = np.random.default_rng(1).permutation(len(rows)) % folds
    margins = np.zeros(len(rows))
    for k in range(folds):
        train, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(labels[train].tolist())) < 2 or not len(rest):
            continue
        part = [rows[i] for i in train]
        ratio = log_ratios(part, labels[train])
        weight, bias = dual_coordinate_descent(part, labels[train], ratio)
        for i in rest.tolist():
            margins[i] = _margins(rows[i], np.array([0, len(rows[i])]), ratio, weight, bias)[0]
    ratio = log_ratios(rows, labels)
    weight, bias = dual_coordinate_descent(rows, labels, ratio)
    return Model(ratio, weight, bias, *logistic_curve(margins, labels))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text"
) -> Model:
    """Fit on about `sample` labelled documents, those with the least hashes of their ids.

    Labels that are null or not 0 or 1 are left out; of several labels of an id the larger counts. Only the
    sampled labels are broadcast, and only the features of sampled documents reach the driver.
    """
    known = only(labels, id_column, label).toDF("id", "label").filter("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    share = min(1.0, sample / max(known.count(), 1))
    picked = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = only(docs, id_column, text_column).toDF("id", "text")
    rows = texts.join(F.broadcast(picked), "id").select("label", "text").mapInArrow(_features_of, "label int, found binary")
    found = rows.collect()
    return fit([np.frombuffer(r["found"], np.int32) for r in found], np.array([r["label"] for r in found]))


def _features_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        found, first = features(batch.column(1))
        ids = found.astype(np.int32)
        rows = pa.array([ids[i:j].tobytes() for i, j in zip(first, first[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), rows], ["label", "found"])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and `score`, the probability of label 1, for every row, from the whole text alone.

    Null and empty texts have no features and get what the model says without any; repeated rows get the
    same score; further columns are left out; an empty table gives an empty one. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    frame = only(docs, id_column, text_column)
    kind = frame.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(batch.column(1)))], [id_column, "score"])

    return frame.mapInArrow(run, f"`{id_column}` {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows that score `threshold` or more, with all their columns, filtered where they are read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column):
            yield batch.filter(pa.array(sent.value.scores(batch.column(column)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
