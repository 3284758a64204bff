"""Removal of byte strings of `LENGTH` that start earlier, in another document or in the same one.

What is removed is exactly the bytes that some repeated string of 100 bytes covers, as judged on the input; an earlier
start is one in a document with a smaller id, or before in the same document.

1. Every 100-byte string holds an anchor: of its substrings of `GRAM` bytes the one with the smallest hash, the first of
   equal ones. Equal strings have equal anchors at equal places. Strings that follow each other and share an anchor make
   a run; two runs with the same bytes around their anchors hold the same strings.
2. Runs are dealt by their anchors. Of runs that are alike all but the first are removed: alike by their bytes where they
   meet in a batch of documents, elsewhere by 64 bits each of two hashes, of the anchor and, not linear, of the whole run.
   An anchor whose runs are all alike needs nothing else.
3. Where runs of one anchor differ, their bytes are fetched, and what they hold to the right of the anchor and, reversed,
   to its left, is sorted by a suffix array (linear grouping construction) over blocks of bytes. Common prefixes of
   neighbours in the two orders say which runs agree up to any place; two strings are equal if they agree on both sides.
4. An anchor with more than `HOT` different runs is split: its runs are cut by how many bytes a string has before the
   anchor, and dealt by the bytes that all strings of a part have in common places, so equal strings still meet. Beyond
   `HOTTER` each string is dealt by itself. Alike parts of a batch of documents go on as one.

Scale: texts are read in segments of bounded size. Runs are pre-aggregated where they are read, so a passage that a third
of all documents share reaches its anchor's task once for each batch of documents, not once for each document; of runs
with the same bytes only the first is held. Texts are shuffled by id, once for both steps that need them. Nothing is
collected, and there is no limit on how often a string may occur.

Cases: null texts are empty; a text under 100 bytes loses nothing. A row with a null id loses nothing and removes nothing.
Rows that repeat an id and a text are one document, and each row gets its result; texts that differ under one id are
ordered by a hash. `reduced` (the pipeline's form) keeps all rows and columns, whatever their names, with the bytes that
are left as text: parts of characters that a cut leaves behind go too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import CHUNK_BYTES, Rolling, lean, mix, shuffle_partitions, signed, slices, small_batches, spare, stored, utf8
from .suffix_array import suffix_array

LENGTH = 100
GRAM = 32
#: Strings that may share one anchor.
SPAN = LENGTH - GRAM + 1
#: Bytes of a text that are read at once.
SEGMENT = 4 << 20
#: Bytes of documents whose alike runs go on as one.
BATCH = 12 << 20
#: Bits of an anchor's place in its segment, and so of its hash.
_PLACE = 24
#: Bytes in a symbol of the suffix arrays' sequences.
_SYMBOL = 23
#: Rows of runs, and of runs' bytes, that are worked on at once.
_ROWS, _TEXTS = 200_000, 20_000
#: Different runs of an anchor from which on it is split by parts, and by strings.
HOT, HOTTER = 256, 1 << 16
#: Parts: strings with so many bytes, from and to, before the anchor.
_PARTS = ((0, 0), (1, 2), (3, 6), (7, 14), (15, 30), (31, 37), (38, 53), (54, 61), (62, 65), (66, 67), (68, 68))

#: no counts an anchor's different runs, from 0.
_RUN = "h long, c long, doc_id long, tag long, start long, width int, lead short, no int"
_NAMES = ["h", "c", "doc_id", "tag", "start", "width", "lead", "no"]
_WORDS = mix(np.arange(7001, 7001 + (LENGTH + SPAN) // 8 + 1, dtype=np.uint64))


def gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of substrings, one after the other, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])], bounds


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number; those behind the end are 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), np.uint64, buffer=padded.data, strides=(1,))


def _eighth(word: np.ndarray, begin: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray | slice, np.ndarray]:
    """Of substrings: which have bytes from 8 * k on, and the first 8 of those as a number."""
    if 8 * k + 8 <= LENGTH and (size >= 8 * k + 8).all():
        return slice(None), word[begin + 8 * k]
    at = np.flatnonzero(size > 8 * k)
    return at, word[begin[at] + 8 * k] << (8 * np.maximum(0, 8 * k + 8 - size[at])).astype(np.uint64)


def hash_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of substrings of up to LENGTH + SPAN bytes: each word of 8 bytes is mixed with its place and all are added."""
    word, total = _eights(data), mix(size.astype(np.uint64) + np.uint64(1))
    for k in range((int(size.max()) + 7) // 8 if len(size) else 0):
        at, value = _eighth(word, begin, size, k)
        total[at] += mix(value ^ _WORDS[k])
    return mix(total)


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """bytes, offsets of parts, the row of each part, and where it starts in its text; parts of a text overlap by LENGTH - 1."""
    for i, j in slices(offsets, min(CHUNK_BYTES, SEGMENT)):
        part = data[offsets[i] : offsets[j]]
        if len(part) <= SEGMENT + LENGTH:
            yield part, offsets[i : j + 1] - offsets[i], np.arange(i, j), np.zeros(j - i, np.int64)
        else:
            for at in range(0, len(part) - LENGTH + 1, SEGMENT):
                piece = part[at : at + SEGMENT + LENGTH - 1]
                yield piece, np.array([0, len(piece)]), np.array([i]), np.array([at], np.int64)


def anchored_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run: its part, the start of its first string (in data), how far its last one starts behind it, how far the anchor does, and hashes of the anchor and of the run."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 6
    rolling = Rolling(data)
    grams = rolling.every(GRAM)
    least = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while 2 * reach <= SPAN:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - reach)], least[SPAN - reach :])
    anchor = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    lengths = np.diff(offsets)
    long = lengths >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, np.minimum(offsets[1:][long] - LENGTH + 1, n), -1)
    start = np.flatnonzero(np.cumsum(inside[:n], dtype=np.int8) > 0)
    if not len(start):
        return (np.zeros(0, np.int64),) * 6
    anchor = anchor[start]
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    begin, width, at = start[first], start[last] - start[first], anchor[first]
    part = np.searchsorted(offsets, begin, side="right") - 1
    whole = hash_of(data, begin, width + LENGTH)
    c = mix(whole ^ mix(((at - begin) << 8 | width).astype(np.uint64) + np.uint64(1)))
    return part, begin, width, at - begin, grams[at], c


def _alike(data: np.ndarray, begin: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether substrings one[k] and two[k] (places in begin) have the same bytes; their sizes are equal."""
    word, sizes, out = _eights(data), size[one], np.ones(len(one), bool)
    for k in range((int(sizes.max()) + 7) // 8 if len(one) else 0):
        at, left = _eighth(word, begin[one], sizes, k)
        _, right = _eighth(word, begin[two], sizes, k)
        out[at] &= left == right
    return out


def _firsts(keys: list[np.ndarray], doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows in the order of (keys, doc, tag, start); and in that order which have the keys of the row before, and where their first one is."""
    order = np.lexsort((start, tag, doc, *keys[::-1]))
    again = np.zeros(len(order), bool)
    if len(order):
        again[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    return order, again, np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of documents (doc_id, tag, text); of alike runs in a batch the first. The others are spans to remove: lead -1, h any, width how far the last string starts behind."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH:
            yield from _batch_runs(_one(held))
            held, size = [], 0
    if held:
        yield from _batch_runs(_one(held))


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _batch_runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    tags = batch.column(1).to_numpy(zero_copy_only=False)
    data, offsets = utf8(batch.column(2))
    found = []
    for piece, at, rows, base in _segments(data, offsets):
        part, begin, width, lead, h, c = anchored_runs(piece, at)
        if len(part):
            found.append((rows[part].astype(np.int32), begin - at[part] + base[part], width.astype(np.int16), lead.astype(np.int16), h, c))
    if found:
        row, start, width, lead, h, c = (np.concatenate(x) for x in zip(*found))
        del found
        doc, tag = ids[row], tags[row]
        order, again, head = _firsts([c], doc, tag, start)
        begin, size = offsets[row] + start, width + LENGTH
        # What hashes alike but isn't stays a run of its own.
        at = np.flatnonzero(again)
        again[at] = (size[order[at]] == size[order[head[at]]]) & (lead[order[at]] == lead[order[head[at]]])
        at = np.flatnonzero(again)
        again[at] = _alike(data, begin, size, order[at], order[head[at]])
        # The same run of a row that repeats an id and a text is not a second one, but changes nothing either: it is removed only if it starts after.
        same = (doc[order] == doc[order[head]]) & (tag[order] == tag[order[head]]) & (start[order] == start[order[head]])
        # What is known to go is given out as spans, each of all runs that overlap.
        gone = np.sort(order[again & ~same])
        gone = gone[np.argsort(begin[gone], kind="stable")]
        reach = np.maximum.accumulate(begin[gone] + size[gone])
        opens = np.flatnonzero(np.concatenate([[True], (begin[gone][1:] > reach[:-1]) | (row[gone][1:] != row[gone][:-1])])) if len(gone) else gone
        span = reach[np.concatenate([opens[1:], [len(gone)]]) - 1] - begin[gone[opens]] if len(gone) else gone
        first, kept = gone[opens], order[~again]
        both = np.concatenate([kept, first])
        widths = np.concatenate([width[kept], span - LENGTH]).astype(np.int32)
        leads = np.concatenate([lead[kept], np.full(len(first), -1)]).astype(np.int16)
        yield pa.RecordBatch.from_arrays([pa.array(signed(h[both])), pa.array(signed(c[both])), pa.array(doc[both]), pa.array(tag[both]), pa.array(start[both]), pa.array(widths), pa.array(leads), pa.array(np.zeros(len(both), np.int32))], _NAMES)


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (h, c, doc_id, tag, start): strings to remove (lead -1) pass; of alike runs all but the first become such; of an anchor with different runs, these stay as questions, numbered.

    Of the last anchor so far only its last different run is held, whatever their number, and whether it was given out.
    """
    held: list[np.ndarray] | None = None
    given = False

    def solve(x: list[np.ndarray], final: bool) -> list[np.ndarray]:
        nonlocal held, given
        h, c, doc, tag, start, _, lead, no = x
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
        remove = again & ~((doc == doc[head]) & (tag == tag[head]) & (start == start[head]))
        f = np.flatnonzero(~again)
        turn = np.concatenate([[True], h[f][1:] != h[f][:-1]])
        first = np.flatnonzero(turn)[np.cumsum(turn) - 1]
        number = np.arange(len(f)) - first
        if held is not None:
            number[first == 0] += no[0]
        lone = turn & np.concatenate([turn[1:], [final]])
        if held is not None and given:
            lone[0] = False
        waiting = np.zeros(len(f), bool)
        waiting[-1] = not final and turn[-1] and not (held is not None and given and len(f) == 1)
        out = remove.copy()
        out[f[~lone & ~waiting]] = True
        if held is not None and given:
            out[0] = False
        numbers = np.zeros(len(h), np.int32)
        numbers[f] = number
        result = [a[out] for a in (h, c, doc, tag, start, x[5], np.where(remove, np.int16(-1), lead), numbers)]
        given = not waiting[-1]
        held = [a[f[-1] : f[-1] + 1] for a in (*x[:7], numbers)]
        return result

    def batch_of(x: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a) for a in x], _NAMES)

    pending, rows = [], 0
    for batch in batches:
        x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        passing = x[6] < 0
        if passing.any():
            yield batch_of([a[passing] for a in x])
            x = [a[~passing] for a in x]
        pending.append(x)
        rows += len(x[0])
        if rows >= _ROWS:
            out = solve([np.concatenate(a) for a in zip(*([held] if held else []), *pending)], False)
            pending, rows = [], 0
            if len(out[0]):
                yield batch_of(out)
    if rows or held:
        out = solve([np.concatenate(a) for a in zip(*([held] if held else []), *pending)], True)
        if len(out[0]):
            yield batch_of(out)


def split_runs(h: np.ndarray, width: np.ndarray, lead: np.ndarray, data: np.ndarray, begin: np.ndarray, parts: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs, those of their parts that hold strings: (run, its new anchor's hash, bytes before the anchor of the part's first string and of its last one)."""
    rows, keys, most, least = [], [], [], []
    for low, high in parts:
        a, b = np.minimum(lead, high), np.maximum(lead - width, low)
        at = np.flatnonzero(a >= b)
        if not len(at):
            continue
        anchor = begin[at] + lead[at]
        # All strings of the part hold these bytes, at the same places around the anchor.
        common = hash_of(data, anchor - low, np.full(len(at), LENGTH - high + low))
        rows.append(at)
        keys.append(mix(common ^ mix(h[at] + np.uint64(low * 128 + high))))
        most.append(a[at])
        least.append(b[at])
    return tuple(np.concatenate(x) for x in (rows, keys, most, least))


_SINGLE = tuple((a, a) for a in range(SPAN))


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, tag, text, list of runs): each run with its bytes, split if its anchor is hot; of alike parts in a batch the first, the others as strings to remove (lead -1)."""
    for batch in batches:
        batch = batch.filter(batch.column(3).is_valid())
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(2))
        asked = batch.column(3)
        flat = asked.flatten()
        counts = np.diff(asked.offsets.to_numpy())
        row = np.repeat(np.arange(len(counts)), counts)
        h, start, width, lead, level = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        h, width, lead = h.view(np.uint64), width.astype(np.int64), lead.astype(np.int64)
        ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        remove = np.zeros(len(row), bool)
        if level.any():
            parts = [(np.flatnonzero(level == 0), None)]
            for kind, cuts in ((1, _PARTS), (2, _SINGLE)):
                at = np.flatnonzero(level == kind)
                if len(at):
                    parts.append((at, split_runs(h[at], width[at], lead[at], data, offsets[row[at]] + start[at], cuts)))
            plain = parts[0][0]
            made = [(row[plain], h[plain], start[plain], width[plain], lead[plain], np.zeros(len(plain), bool))]
            for at, (run, key, most, least) in parts[1:]:
                own = at[run]
                new_row, new_start, new_width = row[own], start[own] + lead[own] - most, most - least
                order, again, head = _firsts([key, most, least], ids[new_row], tags[new_row], new_start)
                place = np.flatnonzero(again)
                again[place] = _alike(data, offsets[new_row] + new_start, new_width + LENGTH, order[place], order[head[place]])
                same = (ids[new_row][order] == ids[new_row][order[head]]) & (tags[new_row][order] == tags[new_row][order[head]]) & (new_start[order] == new_start[order[head]])
                keep = ~(again & same)
                order, again = order[keep], again[keep]
                made.append((new_row[order], key[order], new_start[order], new_width[order], most[order], again))
            row, h, start, width, lead, remove = (np.concatenate(x) for x in zip(*made))
        begin, size = offsets[row] + start, np.where(remove, 0, width + LENGTH)
        lead = np.where(remove, -1, lead)
        for i in range(0, len(row), _TEXTS):
            s = slice(i, i + _TEXTS)
            content, bounds = gathered(data, begin[s], size[s])
            run = pa.Array.from_buffers(pa.binary(), len(size[s]), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(content.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.ascontiguousarray(h[s]))), pa.array(ids[row[s]]), pa.array(tags[row[s]]), pa.array(start[s]), pa.array(width[s].astype(np.int16)), pa.array(lead[s].astype(np.int16)), run], ["h", "doc_id", "tag", "start", "width", "lead", "run"])


def _sides(run: np.ndarray, bounds: np.ndarray, width: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes behind the anchor and, reversed, before it, as rows padded with 0, and their lengths."""
    n, most = len(width), LENGTH - GRAM
    right_size, left_size = LENGTH + width - lead - GRAM, lead
    column = np.arange(most)[None, :]
    right_at = (bounds[:-1] + lead + GRAM)[:, None] + column
    left_at = (bounds[:-1] + lead - 1)[:, None] - column
    right_has, left_has = column < right_size[:, None], column < left_size[:, None]
    right, left = np.zeros((n, most), np.uint8), np.zeros((n, most), np.uint8)
    right[right_has] = run[right_at[right_has]]
    left[left_has] = run[left_at[left_has]]
    return right, right_size, left, left_size


def _orders(group: np.ndarray, right: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows by (group, right) and by (group, left): from one suffix array over symbols, each of _SYMBOL bytes, of both sides of all rows.

    A symbol's last byte says how many of its bytes are the side's own, so an end sorts before any byte, 0 included.
    """
    n = len(group)
    parts = -(-right.shape[1] // _SYMBOL)
    padded = np.zeros((2 * n, parts * _SYMBOL), np.uint8)
    padded[:n, : right.shape[1]], padded[n:, : left.shape[1]] = right, left
    own = np.clip(np.concatenate([right_size, left_size])[:, None] - _SYMBOL * np.arange(parts), 0, _SYMBOL).astype(np.uint8)
    blocks = np.concatenate([padded.reshape(2 * n * parts, _SYMBOL), own.reshape(-1, 1)], 1).view(f"S{_SYMBOL + 1}").reshape(-1)
    _, symbol = np.unique(blocks, return_inverse=True)
    groups = int(group.max()) + 1
    text = np.empty((2 * n, parts + 1), np.int64)
    text[:n, 0], text[n:, 0] = group, group + groups
    text[:, 1:] = symbol.reshape(2 * n, parts) + 2 * groups
    order = np.array(suffix_array(text.reshape(-1).tolist()))
    row = order[order % (parts + 1) == 0] // (parts + 1)
    return row[row < n], row[row >= n] - n


def _common(order: np.ndarray, group: np.ndarray, side: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each row in the order, how many bytes it shares with the row before; -1 across groups."""
    a, b = order[:-1], order[1:]
    differ = side[a] != side[b]
    common = np.where(differ.any(1), differ.argmax(1), side.shape[1])
    common = np.minimum(common, np.minimum(size[a], size[b]))
    common = np.where(group[a] == group[b], common, -1)
    return np.concatenate([[-1], common])


def repeated(h: np.ndarray, rank: np.ndarray, width: np.ndarray, lead: np.ndarray, run: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs (rank: their order in the table), the strings that an earlier run holds too: (run, how far it starts behind the run's first)."""
    width, lead = width.astype(np.int64), lead.astype(np.int64)
    # An anchor is its bytes; they differ under one hash only by chance.
    _, first, group = np.unique(h, return_index=True, return_inverse=True)
    at, grams = bounds[:-1] + lead, np.full(len(h), GRAM)
    if not _alike(run, at, grams, np.arange(len(h)), first[group]).all():
        spelt = np.ones((len(h), GRAM + 1), np.uint8)  # a last byte keeps zeros
        spelt[:, :-1] = run[at[:, None] + np.arange(GRAM)]
        _, group = np.unique(spelt.view(f"S{GRAM + 1}").reshape(-1), return_inverse=True)
    right, right_size, left, left_size = _sides(run, bounds, width, lead)
    by_right, by_left = _orders(group, right, right_size, left, left_size)
    common_right, common_left = _common(by_right, group, right, right_size), _common(by_left, group, left, left_size)
    rows, offs = [], []
    class_right, class_left = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    for a in range(SPAN):  # bytes of the string before the anchor
        active = np.flatnonzero((a <= lead) & (a >= lead - width))
        if len(active) < 2:
            continue
        class_right[by_right] = np.cumsum(common_right < LENGTH - GRAM - a)
        class_left[by_left] = np.cumsum(common_left < a)
        key = class_right[active] * (len(h) + 1) + class_left[active]
        order = np.lexsort((rank[active], key))
        again = np.concatenate([[False], key[order][1:] == key[order][:-1]])
        hit = active[order[again]]
        rows.append(hit)
        offs.append(lead[hit] - a)
    return (np.concatenate(rows), np.concatenate(offs)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with bytes, sorted by h: strings to remove, as (doc_id, tag, start, stop). Those known already (lead -1) pass."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        h, doc, tag, start, width, lead = (table.column(k).to_numpy() for k in range(6))
        order = np.lexsort((start, tag, doc, h))
        twice = np.zeros(len(h), bool)  # runs of rows that repeat an id and a text
        twice[order[1:]] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (h, doc, tag, start)])
        if twice.any():
            return solve(table.filter(pa.array(~twice)).combine_chunks())
        raw, bounds = _binary(table.column(6))
        order = np.lexsort((start + lead, tag, doc))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row, off = repeated(h, rank, width, lead, raw, bounds)
        order = np.lexsort((off, row))
        row, off = row[order], off[order]
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1)]) if len(row) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        last = np.concatenate([first[1:], [len(row)]]).astype(np.int64) - 1 if len(row) else first
        r = row[first]
        return pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(tag[r]), pa.array(start[r] + off[first]), pa.array(start[r] + off[last] + LENGTH)], ["doc_id", "tag", "start", "stop"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        known = pa.compute.less(batch.column(5), 0)
        if pa.compute.any(known).as_py():
            gone = batch.filter(known)
            stop = pa.compute.add(pa.compute.add(gone.column(3), gone.column(4).cast(pa.int64())), LENGTH)
            yield pa.RecordBatch.from_arrays([gone.column(1), gone.column(2), gone.column(3), stop], ["doc_id", "tag", "start", "stop"])
            batch = batch.filter(pa.compute.invert(known))
        if not batch.num_rows:
            continue
        if rows + batch.num_rows >= _TEXTS:
            h = batch.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if cut or (held and held[-1].column(0)[-1].as_py() != h[0]):
                yield solve(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held, rows = [], 0
                batch = batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield solve(pa.Table.from_batches(held).combine_chunks())


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _questions(known: DataFrame, many: int) -> DataFrame:
    """The table that _resolved gives."""
    runs = known.mapInArrow(lean(_runs), _RUN)
    # What is already known to go needs no anchor: it is dealt by its document.
    dealt = F.when(F.col("lead") < 0, F.xxhash64("doc_id", "start")).otherwise(F.col("h"))
    sorted_runs = runs.withColumn("deal", dealt).repartition(many, "deal").drop("deal").sortWithinPartitions("h", "c", "doc_id", "tag", "start")
    return sorted_runs.mapInArrow(lean(_resolved), _RUN)


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) with tag, dealt by id; and per document that loses bytes its list of (start, stop)."""
    small_batches(docs.sparkSession)
    many = shuffle_partitions(docs.sparkSession)
    tagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"))
    resolved = stored(_questions(tagged.where("doc_id is not null").select("doc_id", "tag", "text"), many), large=True)
    gone = resolved.where("lead < 0").select("doc_id", "tag", "start", (F.col("start") + F.col("width") + LENGTH).alias("stop"))
    # An anchor's run of number HOT, or HOTTER, stands for the anchor.
    hot = resolved.where(f"lead >= 0 and no in ({HOT}, {HOTTER})").groupBy("h").agg(F.when(F.max("no") == HOTTER, 2).otherwise(1).cast("short").alias("level"))
    questions = resolved.where("lead >= 0").join(hot, "h", "left").withColumn("level", F.coalesce("level", F.lit(0).cast("short")))
    asked = questions.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("h", "start", "width", "lead", "level")).alias("asked"))
    asked = asked.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "asked")
    # The same join of texts as the one with the spans, so that both read one exchange.
    fetched = _joined(tagged, asked).select("doc_id", "tag", "text", "asked").mapInArrow(lean(_fetched), "h long, doc_id long, tag long, start long, width short, lead short, run binary")
    dealt = F.when(F.col("lead") < 0, F.xxhash64("doc_id", "start")).otherwise(F.col("h"))
    answered = fetched.withColumn("deal", dealt).repartition(many, "deal").drop("deal").sortWithinPartitions("h").mapInArrow(lean(_answered), "doc_id long, tag long, start long, stop long")
    spans = gone.unionByName(answered).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return tagged, spans.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "spans")


def _joined(tagged: DataFrame, found: DataFrame) -> DataFrame:
    return tagged.join(found, (F.col("doc_id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of bytes that any of (start, stop) covers."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(fresh)
    return np.stack([spans[first, 0], reach[np.concatenate([first[1:], [len(spans)]]) - 1]], 1)


def _judged(batches: Iterator[pa.RecordBatch], text_at: int, spans_at: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, bytes]]]]:
    for batch in batches:
        data, offsets = utf8(batch.column(text_at))
        lists = batch.column(spans_at)
        out = []
        for r in range(batch.num_rows):
            whole = data[offsets[r] : offsets[r + 1]]
            item = lists[r]
            if not item.is_valid:
                out.append((len(whole), 0, 0, whole.tobytes()))
                continue
            flat = item.values
            runs = merged(np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], 1))
            keep = np.ones(len(whole), bool)
            for a, b in runs:
                keep[a:b] = False
            out.append((len(whole), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), whole[keep].tobytes()))
        yield batch, out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _judged(batches, 1, 2):
            numbers = np.array([x[:3] for x in rows], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(numbers[:, k]) for k in range(3)), pa.array([hashlib.sha256(x[3]).hexdigest() for x in rows], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _joined(*_spans(docs.select("doc_id", "text")))
    return rows.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "spans").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def reduced(docs: DataFrame) -> DataFrame:
    """The rows of docs with what is left of their texts; n_chars, if it is a column, is that of the new text."""
    names = docs.columns
    _, spans = _spans(docs.select("doc_id", "text"))
    doc, tag, own = spare(names, "_id", "_tag", "_spans")
    spans = spans.toDF(doc, tag, own)
    rows = docs.join(spans, (F.col("doc_id") == F.col(doc)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(tag)), "left").select(*names, own)
    at = [c.lower() for c in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _judged(batches, at, len(names)):
            columns = list(batch.columns[:-1])
            changed = pa.array([x[3].decode("utf-8", "ignore") for x in found], pa.string())
            columns[at] = pa.compute.if_else(columns[at].is_null(), columns[at], changed) if columns[at].null_count else changed
            yield pa.RecordBatch.from_arrays(columns, names)

    out = rows.mapInArrow(lean(run), T.StructType(docs.schema.fields))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else out
