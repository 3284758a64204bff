"""Best-fit packing of tokenised documents into sequences, by swap-based local search.

A document's tokens are its ids and a closing id; only documents longer than a sequence are cut, into whole sequences and
a rest. Pieces are dealt to blocks of about `BLOCK_TOKENS` tokens by a hash. Each block is packed by best fit in
descending order and then searched: pieces move, or are exchanged one for one or two for one, between bins that are not
full, always from an emptier bin towards a fuller one, so that the sum of squared fills grows, until bins run empty, no
exchange is left or the bound of total / length is met. Bins that are still open after that, a few in each block, are
dissolved, and their pieces are packed the same way once more across blocks.

Tokenising. Ids equal those of the tokenizer's file, whatever it is. If its steps are those that `_STEPS` states, then a
text that holds only characters below U+0180 without controls has a plain normal form and plain pre-tokens, which are
looked up in a bounded table of ids that the tokenizer's model itself fills; any other text, and every text under another
tokenizer, goes through the tokenizer whole. The table lasts for one task.

Scale: texts are read once and never shuffled; what moves is a row of numbers for each piece. Blocks bound what one task
holds, whatever the table's size, and no group of documents shares a key.

Cases: null and empty texts are one closing id. A null id, and rows that repeat an id, are packed as rows of their own.
Other columns are not carried by `pack`. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, small_batches, stored

LENGTH = 4096
CLOSING = 1
BLOCK_TOKENS = 1 << 21
#: Bins filled less than this share of the length are dissolved after the first round.
OPEN = 0.97
#: Pre-tokens whose ids a worker holds.
TABLE = 400_000

_L, _N = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t\n\x0b\x0c\r "
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa1-\xac\xae-įı-ſ]")
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+")
#: The steps of a tokenizer's file that _OTHER and _PRE stand for.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        added = [x["content"] for x in steps["added_tokens"]]
        model = steps["model"]
        #: Whether plain texts may be looked up by pre-tokens.
        self.known = all(steps[k] == v for k, v in _STEPS.items()) and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and all(x.startswith("<|") for x in added)
        #: The same model for text that is split and lower-cased already; the last id of a pre-token is one that ends a word.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.table: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        """Pre-tokens, one after the other in a text of their own."""
        ids = np.asarray(self.plain.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        bounds = np.flatnonzero(self.ends[ids]) + 1
        if len(bounds) != len(parts):
            raise ValueError("pre-tokens and the tokenizer's own differ")
        whole, start = ids.tobytes(), 0
        for part, end in zip(parts, (bounds * 4).tolist()):
            self.table[part] = whole[start:end]
            start = end

    def encode(self, text: str) -> bytes:
        if not self.known or _OTHER.search(text) or "<|" in text:
            return self._whole(text)
        parts = _PRE.findall(text.lower())
        table = self.table
        try:
            return b"".join([table[p] for p in parts])
        except KeyError:
            pass
        if len(table) > TABLE:
            table.clear()
        self._learn(list({p for p in parts if p not in table}))
        return b"".join([table[p] for p in parts])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, *, length: int = LENGTH, closing: int = CLOSING, with_ids: bool = False) -> DataFrame:
    """doc_id, row, piece, start, length and ids_crc32, and the ids themselves if asked for, of each piece. row tells pieces of rows that repeat an id apart."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    end = np.asarray([closing], "<u4").tobytes()
    step = 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        try:
            yield from encoded(own, batches)
        finally:  # workers outlive their tasks
            own.table.clear()
            del own
            _ENCODERS.clear()

    def encoded(own: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, rows, ids = [], [], []
            for r, text in enumerate(batch.column(1)):
                whole = own.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(whole), step)):
                    part = whole[at : at + step]
                    source.append(r)
                    rows.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            numbers = np.array(rows, np.int64).reshape(-1, 4)
            taken = pa.array(source, pa.int64())
            columns = [batch.column(0).take(taken), batch.column(2).take(taken), pa.array(numbers[:, 0].astype(np.int32)), *(pa.array(numbers[:, c]) for c in (1, 2, 3))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = f"doc_id {kind.simpleString()}, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(lean(run), schema)


# --- one block -------------------------------------------------------------------------------------------------------


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of places in sizes: each piece, in descending order, goes where it leaves least."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            left, b = free.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        else:
            b, left = len(bins), room - sizes[i]
            bins.append([i])
        if left:
            insort(free, (left, b))
    return bins


def search(bins: list[list[int]], sizes: list[int], room: int) -> list[list[int]]:
    """Empties bins by moves and exchanges that raise the sum of squared fills."""
    least = -(-sum(sizes) // room)
    fill = [sum(sizes[i] for i in b) for b in bins]
    live = [b for b in range(len(bins)) if bins[b]]
    count = len(live)
    opened = [b for b in live if fill[b] < room]
    improved = True
    while improved and count > least:
        improved = False
        for v in sorted(opened, key=lambda b: fill[b]):
            if not bins[v] or count <= least:
                continue
            again = True
            while again and bins[v]:
                again = _step(v, bins, fill, sizes, room, opened)
                improved |= again
            if not bins[v]:
                count -= 1
        opened = [b for b in opened if bins[b] and fill[b] < room]
    return [b for b in bins if b]


def _thinned(own: list[int], sizes: list[int]) -> list[int]:
    """Of pieces in the order of their sizes, two of each size at most."""
    return [i for k, i in enumerate(own) if k < 2 or sizes[own[k - 2]] != sizes[i]]


def _largest(lengths: list[int], most: int) -> tuple[int, int] | None:
    """Places of two of the ascending lengths whose sum is largest of those up to `most`, by two pointers."""
    best, found, i, k = -1, None, 0, len(lengths) - 1
    while i < k:
        both = lengths[i] + lengths[k]
        if both > most:
            k -= 1
        else:
            if both > best:
                best, found = both, (i, k)
            i += 1
    return found


def _smallest(lengths: list[int], least: int) -> tuple[int, int] | None:
    """Places of two of the ascending lengths whose sum is smallest of those from `least` on, by two pointers."""
    best, found, i, k = None, None, 0, len(lengths) - 1
    while i < k:
        both = lengths[i] + lengths[k]
        if both < least:
            i += 1
        else:
            if best is None or both < best:
                best, found = both, (i, k)
            k -= 1
    return found


def _step(v: int, bins: list[list[int]], fill: list[int], sizes: list[int], room: int, opened: list[int]) -> bool:
    """One move or exchange out of bin v, of the first kind that any piece allows: a move; one for one; one for two or two for one."""
    others = [b for b in opened if b != v and bins[b] and fill[b] >= fill[v]]
    for x in sorted(bins[v], key=lambda i: -sizes[i]):
        fitting = [b for b in others if room - fill[b] >= sizes[x]]
        if fitting:
            b = max(fitting, key=lambda b: fill[b])
            bins[v].remove(x)
            bins[b].append(x)
            fill[v] -= sizes[x]
            fill[b] += sizes[x]
            return True
    best: tuple[int, int, tuple[int, ...], tuple[int, ...]] | None = None

    def offer(b: int, give: tuple[int, ...], get: tuple[int, ...]) -> None:
        nonlocal best
        gain = sum(sizes[i] for i in give) - sum(sizes[i] for i in get)
        if 0 < gain <= room - fill[b] and (best is None or gain > best[0]):
            best = (gain, b, give, get)

    held = [(b, own := sorted(bins[b], key=lambda i: sizes[i]), [sizes[i] for i in own], room - fill[b]) for b in others]
    for b, own, lengths, free in held:
        for x in bins[v]:
            at = bisect_left(lengths, sizes[x] - free)
            if at < len(own):
                offer(b, (x,), (own[at],))
    # Pieces of one length are alike: one of each length stands for single pieces, two of each for pairs.
    mine = _thinned(sorted(bins[v], key=lambda i: sizes[i]), sizes) if best is None else []
    of_mine = [sizes[i] for i in mine]
    for b, own, _, free in held if best is None else ():
        own = _thinned(own, sizes)
        of_own = [sizes[i] for i in own]
        for y in {sizes[i]: i for i in own}.values():  # two for one: the largest sum that still fits where y was
            found = _largest(of_mine, sizes[y] + free)
            if found:
                offer(b, (mine[found[0]], mine[found[1]]), (y,))
        for x in {sizes[i]: i for i in mine}.values():  # one for two: the smallest sum that still lets x in
            found = _smallest(of_own, sizes[x] - free)
            if found:
                offer(b, (x,), (own[found[0]], own[found[1]]))
    if best is None:
        return False
    gain, b, give, get = best
    for i in give:
        bins[v].remove(i)
    for i in get:
        bins[b].remove(i)
    bins[v].extend(get)
    bins[b].extend(give)
    fill[v] -= gain
    fill[b] += gain
    return True


def packed(sizes: list[int], room: int = LENGTH) -> list[list[int]]:
    full = [[i] for i, n in enumerate(sizes) if n == room]
    rest = [i for i, n in enumerate(sizes) if n != room]
    part = [sizes[i] for i in rest]
    return full + [[rest[i] for i in b] for b in search(best_fit(part, room), part, room)]


# --- the table -------------------------------------------------------------------------------------------------------


def pack(rows: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """rows, a written table of pieces: adds sequence_id and offset."""
    names = rows.columns
    first = _round(rows, length, 0)
    placed = stored(first)
    again = _round(placed.where("open").select(*names), length, 1)
    return placed.where("not open").drop("open").unionByName(again.drop("open"))


def _round(rows: DataFrame, length: int, level: int) -> DataFrame:
    total = rows.agg(F.sum("length")).first()[0] or 0
    many = max(1, -(-total // BLOCK_TOKENS))
    number = F.pmod(F.xxhash64("row", "piece"), F.lit(many))
    numbered = rows.withColumn("_block", number)
    names = rows.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ids_crc32", "row", "piece"], kind="stable").reset_index(drop=True)
        sizes = frame["length"].tolist()
        sequence, offset, dissolved = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        base = (level << 58) | (int(frame["_block"].iloc[0]) << 22)
        for b, own in enumerate(packed(sizes, length)):
            at = 0
            for i in own:
                sequence[i], offset[i] = base + b, at
                at += sizes[i]
            if level == 0 and at < OPEN * length:
                dissolved[own] = True
        return frame[names].assign(sequence_id=sequence, offset=offset, open=dissolved)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long, open boolean"
    return numbered.groupBy("_block").applyInPandas(run, schema)


def packed_documents(docs: DataFrame, tokenizer: str, *, length: int = LENGTH, closing: int = CLOSING, with_ids: bool = False) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32, sequence_id and offset (and ids) of each piece of all documents."""
    made = stored(pieces(docs, tokenizer, length=length, closing=closing, with_ids=with_ids))
    if not with_ids:
        return pack(made, length=length)
    # The search moves numbers only; ids come back by row and piece.
    placed = pack(made.drop("ids"), length=length)
    return placed.join(made.select("row", "piece", "ids"), ["row", "piece"]).select(*made.columns, "sequence_id", "offset")
