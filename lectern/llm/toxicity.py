"""Toxicity by a linear-chain conditional random field.

Tokens are runs of letters (A-Z lower-cased). Labels of documents become labels of tokens: features of tokens (the whole
word and its first 4, 5 and 6 bytes) whose lower confidence bound of the log-odds between toxic and clean documents is
high are candidates, and a token of a toxic document that has one is toxic. On these labelled tokens the field is fitted
by gradient ascent of the conditional likelihood: a weight for each candidate feature, a bias and four transitions.

Forward-backward marginals of the toxic state then tag every token of every whole text. A document's score is its
largest marginal; runs of tokens with a marginal of `SPAN` at least are the offending offsets (of bytes). Between tokens
with candidate features all steps are alike, so the passes cross such a gap by a power of the step's matrix, in the time
of one step: exact, and linear in the number of featured tokens.

Scale: the field is fitted on the driver from at most `SAMPLE` labelled rows, whatever the input; scoring is one scan
without a shuffle. The model is a few thousand numbers.

Cases: null and empty texts have no token and get the background's score. If no label is known, or no toxic one, the
field has no features and every score is the background's. Null ids are scored like any other. Rows stay as they are,
repeated ones too; `filtered` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, sample
from .shared import _LOWER_BYTE, Rolling, give_back, lean, list_array, mix, slices, small_batches, utf8

#: Labelled rows that the field is fitted on: of label 0 and of label 1 at most.
SAMPLE = {0: 2000, 1: 1000}
THRESHOLD = 0.3
SPAN = 0.5
PREFIXES = (4, 5, 6)
#: A candidate is in so many toxic documents at least, and its log-odds less one standard error reach so much.
LEAST, BOUND = 5, 2.0
_SEGMENT, _STEPS, _RATE, _RIDGE = 64, 40, 0.3, 1e-3
_KINDS = mix(np.arange(501, 501 + 1 + len(PREFIXES), dtype=np.uint64))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of letters."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = _LETTER[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    opens[at] = inside[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    closes[at] = inside[at]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One row of hashes for each token: its word, then its prefixes (0 where the token is shorter)."""
    rolling = Rolling(data, _LOWER_BYTE)
    out = np.empty((len(start), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = rolling.of(start, end) ^ _KINDS[0]
    for k, n in enumerate(PREFIXES):
        out[:, 1 + k] = np.where(end - start >= n, rolling.of(start, np.minimum(start + n, end)) ^ _KINDS[1 + k], np.uint64(0))
    return out


@dataclass
class Field:
    """Weights of candidate features (hashes sorted), bias of the toxic state, transitions [from, to]."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    transitions: np.ndarray

    def __post_init__(self):
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        step = np.exp(self.transitions) * np.array([1.0, np.exp(self.bias)])
        values, vectors = np.linalg.eig(step)
        order = np.argsort(-values.real)
        self.ratio = float(values.real[order[1]] / values.real[order[0]])
        self.vectors = vectors.real[:, order]
        self.inverse = np.linalg.inv(self.vectors)
        left, right = self.inverse[0], self.vectors[:, 0]
        #: Marginal of the toxic state far from any featured token.
        self.background = float(np.clip(left[1] * right[1] / (left @ right), 0, 1))
        self.step = step

    def emissions(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens have candidate features, and the sums of their weights."""
        total, any_ = np.zeros(len(found)), np.zeros(len(found), bool)
        for k in range(found.shape[1]):
            h = found[:, k]
            at = np.flatnonzero(self.seen[(h >> np.uint64(48)).astype(np.int64)])
            if len(at) and len(self.hashes):
                place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
                hit = self.hashes[place] == h[at]
                total[at[hit]] += self.weights[place[hit]]
                any_[at[hit]] = True
        return any_, total

    def _gap(self, n: int) -> np.ndarray:
        """The step's matrix to the power n, scaled."""
        return (self.vectors * np.array([1.0, self.ratio**n])) @ self.inverse

    def marginals(self, at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Of the featured tokens at places `at` (from 0, ascending) of n tokens: marginals of the toxic state."""
        boost = np.exp(np.minimum(weight, 50.0))
        ahead = np.empty((len(at), 2))
        vector, before = np.array([1.0, np.exp(self.bias)]), 0
        for i, p in enumerate(at):
            vector = vector @ self._gap(int(p) - before)
            vector = vector * np.array([1.0, boost[i]])
            vector /= vector.sum()
            ahead[i], before = vector, int(p)
        behind = np.empty((len(at), 2))
        vector, after = np.ones(2), n - 1
        for i in range(len(at) - 1, -1, -1):
            vector = self._gap(after - int(at[i])) @ vector
            vector /= vector.sum()
            behind[i], after = vector, int(at[i])
            vector = vector * np.array([1.0, boost[i]])
        both = np.clip(ahead * behind, 0, None)
        return both[:, 1] / both.sum(1)


def fit(rows: list[tuple[str, int]]) -> Field:
    """From (text, label) of documents."""
    none = Field(np.zeros(0, np.uint64), np.zeros(0), -7.0, np.zeros((2, 2)))
    label = np.array([x[1] for x in rows], bool)
    if not label.any() or label.all():
        return none
    counts = np.zeros(len(rows), np.int64)
    seen: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for r, (text, toxic) in enumerate(rows):
        found = _features_of(text)
        counts[r] = len(found)
        seen[toxic].append(np.unique(found[found != 0]))
    # Documents that have each feature, toxic (a) and clean (b).
    names, a = np.unique(np.concatenate(seen[1]), return_counts=True)
    others, of_others = np.unique(np.concatenate(seen[0]), return_counts=True)
    del seen
    b = np.zeros(len(names), np.int64)
    both, at, there = np.intersect1d(names, others, assume_unique=True, return_indices=True)
    b[at] = of_others[there]
    del others, of_others, both
    odds = np.log((a + 0.5) / (label.sum() + 1)) - np.log((b + 0.5) / ((~label).sum() + 1))
    hashes = names[(a >= LEAST) & (odds - np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= BOUND)]
    if not len(hashes):
        return none
    token, feature = [], []
    for before, (text, _) in zip(np.cumsum(counts) - counts, rows):
        found = _features_of(text)
        place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        i, k = np.nonzero(hashes[place] == found)
        token.append(i + before)
        feature.append(place[i, k])
    return _fitted(hashes, np.concatenate(token), np.concatenate(feature), np.repeat(label, counts), counts)


def _features_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = tokens(data, np.array([0, len(data)]))
    return features(data, start, end)


def _fitted(hashes: np.ndarray, token: np.ndarray, feature: np.ndarray, toxic: np.ndarray, counts: np.ndarray) -> Field:
    """Gradient ascent on segments of tokens, padded to one length. token and feature: which token has which; toxic: of each token's document; counts: tokens of each document."""
    n = len(toxic)
    tag = np.zeros(n, bool)
    tag[token] = True
    tag &= toxic
    column = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    segment = np.cumsum(column % _SEGMENT == 0) - 1
    column %= _SEGMENT
    many = int(segment[-1]) + 1
    real = np.zeros((_SEGMENT, many), bool)
    real[column, segment] = True
    truth = np.zeros((_SEGMENT, many), bool)
    truth[column, segment] = tag
    size = len(hashes)
    theta = np.zeros(size + 5)
    theta[size] = -4.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    both = real[1:]
    observed = np.zeros_like(theta)
    observed[:size] = np.bincount(feature, weights=tag[token], minlength=size)
    observed[size] = tag.sum()
    pairs = truth[:-1] * 2 + truth[1:]
    observed[size + 1 :] = np.bincount(pairs[both], minlength=4)
    for t in range(1, _STEPS + 1):
        emission = np.zeros((_SEGMENT, many), np.float32)
        per_token = np.bincount(token, weights=theta[feature], minlength=n) + theta[size]
        emission[column, segment] = per_token
        boost, trans = np.exp(np.clip(emission, -30, 30)), np.exp(theta[size + 1 :].reshape(2, 2)).astype(np.float32)
        ahead, behind = np.empty((_SEGMENT, 2, many), np.float32), np.empty((_SEGMENT, 2, many), np.float32)
        ahead[0, 0], ahead[0, 1] = 1, boost[0]
        ahead[0] /= ahead[0].sum(0)
        for s in range(1, _SEGMENT):
            x0 = ahead[s - 1, 0] * trans[0, 0] + ahead[s - 1, 1] * trans[1, 0]
            x1 = (ahead[s - 1, 0] * trans[0, 1] + ahead[s - 1, 1] * trans[1, 1]) * boost[s]
            total = x0 + x1
            ahead[s, 0], ahead[s, 1] = np.where(real[s], x0 / total, ahead[s - 1, 0]), np.where(real[s], x1 / total, ahead[s - 1, 1])
        behind[-1] = 0.5
        expected = np.zeros_like(theta)
        for s in range(_SEGMENT - 2, -1, -1):
            y0, y1 = behind[s + 1, 0], behind[s + 1, 1] * boost[s + 1]
            x0, x1 = trans[0, 0] * y0 + trans[0, 1] * y1, trans[1, 0] * y0 + trans[1, 1] * y1
            total = x0 + x1
            behind[s, 0], behind[s, 1] = np.where(real[s + 1], x0 / total, 0.5), np.where(real[s + 1], x1 / total, 0.5)
            joint = [[ahead[s, i] * trans[i, j] * y for j, y in enumerate((y0, y1))] for i in (0, 1)]
            z = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
            for i in (0, 1):
                for j in (0, 1):
                    expected[size + 1 + 2 * i + j] += (joint[i][j] / z)[real[s + 1]].sum()
        marginal = ahead[:, 1] * behind[:, 1] / (ahead * behind).sum(1)
        p = marginal[column, segment]
        expected[:size] = np.bincount(feature, weights=p[token], minlength=size)
        expected[size] = p.sum()
        gradient = (observed - expected) / max(1, tag.sum()) - _RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta += _RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Field(hashes, theta[:size], float(theta[size]), theta[size + 1 :].reshape(2, 2))


def tagged(field: Field, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Score of each row, and its offending offsets (start, end of bytes)."""
    start, end, row = tokens(data, offsets)
    has, weight = field.emissions(features(data, start, end))
    n = len(offsets) - 1
    score, spans = np.full(n, field.background), [np.zeros((0, 2), np.int64)] * n
    at = np.flatnonzero(has)
    first = np.searchsorted(row, np.arange(n + 1))
    for group in np.split(at, np.flatnonzero(np.diff(row[at])) + 1) if len(at) else []:
        r = row[group[0]]
        p = field.marginals(group - first[r], weight[group], int(first[r + 1] - first[r]))
        score[r] = max(score[r], min(1.0, float(p.max())))
        bad = group[p >= SPAN]
        if len(bad):
            runs = np.split(bad, np.flatnonzero(np.diff(bad) > 1) + 1)
            spans[r] = np.array([[start[x[0]] - offsets[r], end[x[-1]] - offsets[r]] for x in runs])
    return score, spans


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score and spans (list of (start, end) in bytes) of each row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((field.hashes, field.weights, field.bias, field.transitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                score, spans = tagged(own, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
                pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
                at = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.ListArray.from_arrays(pa.array(at), pairs)], ["doc_id", "score", "spans"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of each row."""
    rows = scored(docs, fit(sample(docs, labels, "toxic", SAMPLE)))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that are not predicted toxic. Only texts go through Python; rows stay where they are."""
    small_batches(docs.sparkSession)
    field = fit(sample(docs, labels, "toxic", SAMPLE))
    shared = docs.sparkSession.sparkContext.broadcast((field.hashes, field.weights, field.bias, field.transitions))

    @F.arrow_udf(T.DoubleType())
    def score_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Field(*shared.value)
        try:
            for column in texts:
                data, offsets = utf8(column)
                found = [tagged(own, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0] for i, j in slices(offsets)]
                yield pa.array(np.concatenate(found) if found else np.zeros(0))
        finally:
            give_back()

    return docs.where(score_of(F.col("text")) < THRESHOLD)
