"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is described by hashed counts of its byte pairs and of triples of byte classes (kinds of letters, digits, spaces
and each mark of its own), damped and scaled to unit length, and by how many of its words repeat the word before. A truncated singular value decomposition of the labelled
sample's descriptions gives latent directions; texts are projected on them. Every document's cosine with every labelled
vector is computed exactly, in blocks, and its `NEIGHBOURS` nearest vote with their similarities as weights.

Scale: the sample of labelled rows is bounded by `SAMPLE` whatever the input (its vectors, under 1 MB, are broadcast);
scoring is one scan without a shuffle. Labels of held-out rows are never read into the sample.

Cases: null and empty texts have a zero vector, are as near to one labelled vector as to another, and get the sample's
share of good ones; without any label every score is 0.5. Rows stay as they are, repeated ones too. Ties between
neighbours of equal similarity go to the earlier one in the sample's fixed order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, sample
from .shared import lean, mix, slices, small_batches, utf8, word_hashes, words

#: Labelled rows whose vectors vote, at most.
SAMPLE = 4096
THRESHOLD = 0.7
NEIGHBOURS = 15
DIRECTIONS = 48
PAIRS, TRIPLES = 512, 1536
_BLOCK = 256

# Classes of bytes: lower and upper case, digits, blanks, line ends, bytes of other alphabets, and each mark of its own.
_CLASS = np.arange(256, dtype=np.uint64) + np.uint64(16)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 32), (10, 11, 12, 13), range(128, 256))):
    _CLASS[list(_bytes)] = _k
_A = mix(np.arange(256, dtype=np.uint64) + np.uint64(9000))
_B = mix(np.arange(256, dtype=np.uint64) + np.uint64(9500))
_PAIR_OF = (mix((_A[:, None] * np.uint64(3)) ^ _B[None, :]) % np.uint64(PAIRS)).astype(np.int32).reshape(-1)
_CLASSES = {int(c): i for i, c in enumerate(np.unique(_CLASS))}
_SMALL = np.array([_CLASSES[int(c)] for c in _CLASS], np.int32)
_KINDS = len(_CLASSES)
_TRIPLE_OF = (mix(np.arange(_KINDS**3, dtype=np.uint64) + np.uint64(77_000)) % np.uint64(TRIPLES)).astype(np.int32) + PAIRS
#: Bins of the share of words that repeat the word before, and what a text's own bin counts.
_REPEATS = np.array([0.01, 0.03, 0.06, 0.12, 0.25, 0.5])
_REPEATS_WEIGH = 0.6
_COUNTED = PAIRS + TRIPLES
DIMENSIONS = _COUNTED + len(_REPEATS) + 1


def descriptions(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A unit row (or zero, for an empty text) for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    start, end, row = words(data, offsets)
    name = word_hashes(data, start, end)
    again = np.bincount(row[1:][(name[1:] == name[:-1]) & (row[1:] == row[:-1])], minlength=n) / np.maximum(1, np.bincount(row, minlength=n))
    place = _COUNTED + np.searchsorted(_REPEATS, again)
    for r in range(n):
        x = data[offsets[r] : offsets[r + 1]]
        if len(x) > 1:
            x = x.astype(np.int32)
            counts = np.bincount(_PAIR_OF[x[:-1] * 256 + x[1:]], minlength=_COUNTED).astype(np.float64)
            c = _SMALL[x]
            if len(x) > 2:
                counts += np.bincount(_TRIPLE_OF[(c[:-2] * _KINDS + c[1:-1]) * _KINDS + c[2:]], minlength=_COUNTED)
            share = np.sqrt(counts / len(x))
            out[r, :_COUNTED] = share / np.linalg.norm(share)
            out[r, place[r]] = _REPEATS_WEIGH
            out[r] /= np.linalg.norm(out[r])
    return out


class Voters:
    """The labelled vectors, the directions they were projected on, and the mean they are seen from."""

    def __init__(self, mean: np.ndarray, directions: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.mean, self.directions, self.vectors, self.labels = mean, directions, vectors, labels

    def parts(self) -> tuple:
        return self.mean, self.directions, self.vectors, self.labels

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = (rows - self.mean) @ self.directions
        latent[~rows.any(1)] = 0
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.divide(latent, norm, out=np.zeros_like(latent), where=norm > 1e-9)

    def votes(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        out = np.empty(len(rows))
        k = min(NEIGHBOURS, len(self.labels))
        latent = self.project(rows)
        for i in range(0, len(rows), _BLOCK):
            near = latent[i : i + _BLOCK] @ self.vectors.T
            edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k][:, None]
            above, level = near > edge, near == edge
            # Of those at the edge the first ones, as many as there is room for.
            chosen = above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True)))
            weight = np.where(chosen, np.maximum(near, 0), 0).astype(np.float64)
            total = weight.sum(1)
            out[i : i + _BLOCK] = np.where(total > 0, weight @ self.labels / np.where(total > 0, total, 1), self.labels.mean())
        return np.clip(out, 0.0, 1.0)


def fit(rows: list[tuple[str, int]]) -> Voters:
    if not rows:
        return Voters(np.zeros(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    raw = [np.frombuffer(text.encode(), np.uint8) for text, _ in rows]
    x = np.concatenate([descriptions(r, np.array([0, len(r)])) for r in raw])
    mean = x.mean(0)
    centred = x - mean
    # The covariance's leading eigenvectors are the leading right singular vectors.
    values, vectors = np.linalg.eigh((centred.T @ centred).astype(np.float64))
    keep = np.argsort(-values)[: min(DIRECTIONS, len(rows))]
    directions = vectors[:, keep].astype(np.float32)
    voters = Voters(mean, directions, np.zeros((0, len(keep)), np.float32), np.array([y for _, y in rows], float))
    voters.vectors = voters.project(x)
    return voters


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, "quality", SAMPLE)).parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(*shared.value)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                votes = voters.votes(descriptions(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(votes)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", "text").mapInArrow(lean(run), T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())]))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
