"""Kernels over whole documents: Arrow tables in, arrays out. Rows of many documents are counted at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .. import config as C

WORDS = re.compile(r"\w{2,}")
TOKENS = re.compile(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?")
#: Sides of the blocks in which a large document's questions are compared.
ROWS, COLUMNS = 1024, 4096


def documents(batches: Iterator[pa.RecordBatch], key: str = "doc_id") -> Iterator[pa.Table]:
    """Tables of whole documents, from batches in which each document's rows follow one another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, _ = codes(batch.column(key))
        cut = int(np.flatnonzero(ids == ids[-1])[0])
        if held and (cut or held[-1].column(key)[-1] != batch.column(key)[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks()
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def codes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Each value's number among the distinct ones, and these."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    encoded = column.dictionary_encode(null_encoding="encode")
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()


def expanded(which: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values lie in lists of counts. Of each of the lists that are asked for: its place in which, the values, and how many are left, the value itself included."""
    first = np.cumsum(counts) - counts
    own = counts[which]
    of = np.repeat(np.arange(len(which)), own)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(own) - own, own)
    return of, values[first[which][of] + inside], own[of] - inside


def found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table; -1: absent."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return np.where(table[at] == keys, at, -1) if len(table) else np.full(len(keys), -1)


def _numbered(texts: list, pattern: re.Pattern, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each text's words, one after the other, and how many."""
    lists = [pattern.findall(t or "") for t in texts]
    flat = [numbers.setdefault(w, len(numbers)) for own in lists for w in own]
    return np.array(flat, np.int64), np.array([len(own) for own in lists], np.int64)


def tfidf(table: pa.Table) -> np.ndarray:
    """Of each row (doc_id, sentence_index, source_sentence, normalized_text) the largest weight that its phrase or one of the phrase's words has in its sentence, 0 if none is a feature.

    Features are n-grams (1 to 5) of words of two characters at least, over a document's distinct sentences; document
    frequencies are smoothed; sentences have unit length. A gram is numbered by the one before it and its last word.
    """
    doc, _ = codes(table["doc_id"])
    text, texts = codes(table["source_sentence"])
    phrase, phrases = codes(table["normalized_text"])
    sentences, sentence = np.unique(doc * len(texts) + text, return_inverse=True)
    of_doc = sentences // len(texts)
    n = np.bincount(of_doc)
    numbers: dict[str, int] = {}
    values, counts = _numbered([(t or "").lower() for t in texts], WORDS, numbers)
    of, word, left = expanded(sentences % len(texts), values, counts)
    asked, asked_counts = _numbered(phrases, TOKENS, numbers)
    row, token, token_left = expanded(phrase, asked, asked_counts)
    many = len(numbers)

    squares, best = np.zeros(len(sentences)), np.zeros(len(phrase))
    gram, wanted = of_doc[of], doc[row]
    size = asked_counts[phrase]
    # Of each row's phrase its first words' gram, as far as that is known.
    start = np.cumsum(size) - size
    held = doc.copy()
    for k in range(1, C.CANDIDATE_MAX_TOKENS + 1):
        fits = np.flatnonzero(left >= k)
        known, number = np.unique(gram[fits] * many + word[fits + k - 1], return_inverse=True)
        gram = np.full(len(word), -1)
        gram[fits] = number
        width = max(len(known), 1)
        pairs, tf = np.unique(of[fits] * width + number, return_counts=True)
        at, which = pairs // width, pairs % width
        weight = tf * (np.log((1 + n[of_doc[at]]) / (1 + np.bincount(which, minlength=len(known))[which])) + 1)
        squares += np.bincount(at, weight * weight, len(sentences))

        def weigh(rows: np.ndarray, grams: np.ndarray) -> None:
            place = found(pairs, sentence[rows] * width + grams)  # noqa: B023
            good = (grams >= 0) & (place >= 0)
            np.maximum.at(best, rows[good], weight[place[good]])  # noqa: B023

        if k == 1:
            weigh(row, found(known, wanted * many + token))
        rows = np.flatnonzero((size >= k) & (held >= 0))
        held_next = np.full(len(size), -1)
        held_next[rows] = found(known, held[rows] * many + token[start[rows] + k - 1])
        held = held_next
        whole = np.flatnonzero((size == k) & (held >= 0))
        weigh(whole, held[whole])
    score = best / np.sqrt(np.where(squares > 0, squares, 1.0))[sentence]
    # A repeated doc_id may give one place several sentences.
    places, _ = codes(table["sentence_index"])
    _, group = np.unique((doc * (places.max() + 1) + places) * len(phrases) + phrase, return_inverse=True)
    most = np.zeros(len(score))
    np.maximum.at(most, group, score)
    return most[group]


def word_grams(word: str) -> dict[str, int]:
    """Counts of 3- to 5-grams of a word padded with blanks; one shorter than n counts once, whole."""
    padded, out = f" {word} ", {}
    for n in (3, 4, 5):
        for i in range(max(1, len(padded) - n + 1)):
            out[padded[i : i + n]] = out.get(padded[i : i + n], 0) + 1
        if len(padded) <= n:
            break
    return out


def near(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (doc_id, words; a document's rows follow one another) of a document, the earlier first, whose TF-IDF cosine by characters reaches the threshold or misses it by rounding; and the cosine."""
    doc, _ = codes(table["doc_id"])
    lists = table["words"].combine_chunks()
    word, words = codes(lists.flatten())
    sizes = np.diff(lists.offsets.to_numpy())
    numbers: dict[str, int] = {}
    counted = [word_grams(w) for w in words]
    values = np.array([numbers.setdefault(g, len(numbers)) for c in counted for g in c], np.int64)
    times = np.array([t for c in counted for t in c.values()], np.int64)
    lengths = np.array([len(c) for c in counted], np.int64)
    of, place, _ = expanded(word, np.arange(len(values)), lengths)
    row = np.repeat(np.arange(len(doc)), sizes)[of]
    many = max(len(numbers), 1)
    pairs, inverse = np.unique(row * many + values[place], return_inverse=True)
    tf = np.bincount(inverse, times[place], len(pairs))
    row, gram = pairs // many, pairs % many
    _, column, spread = np.unique(doc[row] * many + gram, return_inverse=True, return_counts=True)
    weight = tf * (np.log((1 + np.bincount(doc)[doc[row]]) / (1 + spread[column])) + 1)
    weight /= np.sqrt(np.bincount(row, weight * weight, len(doc)))[row]

    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        p, q = np.searchsorted(row, (a, b))
        if p < q:
            for i, j, cosine in _reaching(row[p:q] - a, np.unique(column[p:q], return_inverse=True)[1], weight[p:q], b - a, threshold - 1e-6):
                out.append((i + a, j + a, cosine))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(map(np.concatenate, zip(*out)))


def _reaching(row: np.ndarray, column: np.ndarray, weight: np.ndarray, n: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a document's n rows, in blocks, the pairs whose product is at least so large, and positive."""
    width = int(column.max()) + 1

    def block(at: int, start: int) -> np.ndarray:
        p, q = np.searchsorted(row, (at, at + ROWS))
        own = (column[p:q] >= start) & (column[p:q] < start + COLUMNS)
        out = np.zeros((min(ROWS, n - at), min(COLUMNS, width - start)))
        out[row[p:q][own] - at, column[p:q][own] - start] = weight[p:q][own]
        return out

    for a in range(0, n, ROWS):
        for b in range(a, n, ROWS):
            product = np.zeros((min(ROWS, n - a), min(ROWS, n - b)))
            for start in range(0, width, COLUMNS):
                left = block(a, start)
                product += left @ (left if a == b else block(b, start)).T
            good = (product >= least) & (product > 0)
            i, j = np.nonzero(np.triu(good, 1) if a == b else good)
            yield i + a, j + b, product[i, j]
