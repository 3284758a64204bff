"""MinHash near-dedup by circulant signatures.

A document's set holds its distinct shingles of five words (A-Z lower-cased; with fewer words, the whole sequence is the
one shingle). One permutation of the 64-bit hashes shuffles them; a second one, circularly shifted by multiples of a
constant modulo 2**64, generates all coordinates of the signature. Coordinates are banded, documents that agree in a
band meet in a bucket, and the Jaccard similarity of their full sets decides on each link.

No bucket is expanded into pairs, and no link between different sets that meet in a bucket is lost:
1. documents with equal sets are one class, which its smallest id stands for;
2. each member of a bucket is held against the bucket's pivot; links found join components;
3. where members of a bucket are still in different components, those outside the bucket's largest component are
   queries against all its members outside their own component; in large buckets in blocks, which give back no more
   links than connect what they hold.
Pairs within a component need no test, as they cannot change it.

Bands have `ROWS` coordinates, and there are as many as it takes (`bands_for`) that a pair at the threshold misses all
buckets with probability `MISS` at most: 20 at 0.85, (1 - 0.85**5)**20 = 8e-6, and 29 at 0.80, (1 - 0.8**5)**29 = 1e-5;
more similar pairs less.

Scale: texts are read once for signatures, and those of documents in a bucket of two or more once more for their sets.
Shuffles carry ids, 64-bit digests and band keys, summed up by key before the shuffle; the set of a pivot that very many
members are held against is sent along in copies, one for each `SALTED` of them, and the blocks of a large bucket, which
hold `CELL` bytes of sets at most, are tasks of their own.

Cases: null, empty or blank texts have an empty set and link with nothing. A row with a null id takes part in nothing
and is kept. Rows that repeat an id are one vertex, which has the links of each of its sets. Other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .covertree import stars
from .shared import lean, list_array, mix, shuffle_partitions, signed, slices, small_batches, stored, utf8, word_hashes, words

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
ROWS, MISS = 5, 1e-5
#: Queries times members up to which a bucket's tests are rows of their own; beyond, they are made in blocks of GRID by GRID.
SMALL, GRID = 1024, 1024
#: Bytes of sets in such a block, about (a set that is larger is alone); tests of one set that one task makes, about.
CELL, SALTED = 64 << 20, 256

_C = mix(np.arange(1001, 1001 + 16, dtype=np.uint64))
_STEP = int(mix(np.array([5], np.uint64))[0]) | 1
#: Bytes of text at once, so that the working arrays stay in a core's cache.
_CHUNK = 1 << 18


def bands_for(percent: int) -> int:
    """The fewest bands by which a pair at the threshold is missed with probability MISS at most."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent is {percent}")
    one = (percent / 100) ** ROWS
    return 1 if one == 1 else math.ceil(math.log(MISS) / math.log1p(-one))


BANDS = bands_for(PERCENT)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sets, each sorted, one after the other, and their sizes."""
    start, end, row = words(data, offsets)
    w = word_hashes(data, start, end)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    full = max(0, len(w) - WORDS + 1)
    value = np.zeros(len(w), np.uint64)
    for j in range(WORDS):
        value[:full] += w[j : j + full] * _C[j]
    here = np.zeros(len(w), bool)
    if full:
        here[:full] = row[:full] == row[WORDS - 1 :]
    for r in np.flatnonzero((count > 0) & (count < WORDS)):
        s, c = first[r], count[r]
        value[s] = (w[s : s + c] * _C[:c]).sum() ^ _C[8 + c]
        here[s] = True
    value, row = mix(value[here]), row[here]
    bound = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    for a, b in zip(bound[:-1], bound[1:]):
        value[a:b].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[fresh], np.bincount(row[fresh], minlength=n)


def _permuted(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, np.uint64(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint64(factor), out=x)
    np.right_shift(x, np.uint64(31), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def signatures(values: np.ndarray, counts: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The signatures of sets that are not empty: one row of coordinates for each."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    shuffled = mix(values ^ _C[15])
    out = np.empty((len(counts), coordinates), np.uint64)
    x, spare = np.empty_like(shuffled), np.empty_like(shuffled)
    for k in range(coordinates):
        np.add(shuffled, np.uint64(k * _STEP & 0xFFFFFFFFFFFFFFFF), out=x)
        out[:, k] = np.minimum.reduceat(_permuted(x, spare), starts)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows)
    key = np.arange(bands, dtype=np.uint64) * _C[14]
    for j in range(rows):
        key = key + parts[:, :, j] * _C[j]
    return mix(key)


_SIGNED = "n_shingles long, d1 long, d2 long, bands array<long>"


def _signer(bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, _CHUNK):
                values, counts = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                full = counts > 0
                d1, d2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                keys = np.zeros((0, bands), np.uint64)
                if full.any():
                    starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]]).astype(np.int64)
                    d1[full] = np.add.reduceat(mix(values ^ _C[12]), starts)
                    d2[full] = np.add.reduceat(mix(values ^ _C[13]), starts)
                    keys = band_keys(signatures(values, counts[full], bands * ROWS), bands)
                listed = list_array(signed(keys.reshape(-1)), full * bands, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(signed(d1)), pa.array(signed(d2)), listed], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in slices(offsets):
            values, counts = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            d1 = np.zeros(j - i, np.uint64)
            if len(values):
                starts = np.concatenate([[0], np.cumsum(counts[counts > 0])[:-1]]).astype(np.int64)
                d1[counts > 0] = np.add.reduceat(mix(values ^ _C[12]), starts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(signed(d1)), list_array(signed(values), counts, pa.int64())], ["id", "d1", "set"])


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = stored(texts.mapInArrow(lean(_signer(bands_for(percent))), f"doc_id long, {_SIGNED}"))
    taking_part = rows.where("n_shingles > 0 and doc_id is not null")
    classes = stored(taking_part.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")))
    # A class is known by its smallest id and, as rows may repeat an id, its digest.
    met = classes.select("rep", "d1", F.col("n_shingles").cast("int").alias("length"), F.explode("bands").alias("key"))
    sizes = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(met.join(sizes, "key").select("key", "rep", "d1", "length", "n"))
    # A bucket's pivot is its member that meets most others over all buckets: near the middle of a group of copies.
    meets = shared.groupBy("rep", "d1").agg(F.sum("n").alias("meets"))
    pivots = shared.select("key", "rep", "d1").join(meets, ["rep", "d1"]).groupBy("key").agg(F.max_by(F.struct("rep", "d1"), F.struct("meets", -F.col("rep"), "d1")).alias("pivot"))
    members = stored(shared.join(pivots, "key").select("key", "rep", "d1", "length", F.col("pivot.rep").alias("pivot"), F.col("pivot.d1").alias("pd1")))
    star = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("pd1").alias("da"), F.col("rep").alias("b"), F.col("d1").alias("db")).distinct()
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = texts.join(stored(needed), "doc_id", "left_semi").mapInArrow(lean(_sets), "id long, d1 long, set array<long>")
    sets = stored(sets.groupBy("id", "d1").agg(F.any_value("set").alias("set")))
    tested = stored(_tested(star, sets, percent))
    found = components(tested.where("linked").select("a", "b"))
    placed = members.join(found, members["rep"] == found["id"], "left").select("key", "rep", "d1", "length", F.coalesce("component", "rep").alias("component"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.max("length").alias("length")).groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max("length").alias("longest"), F.max(F.struct("n", "component")).alias("most"))
    open_ = parts.where("parts > 1").select("key", F.col("most.component").alias("main"), "size", "longest", (F.col("size") - F.col("most.n")).alias("asking"))
    split = stored(placed.drop("length").join(open_, "key").withColumn("asks", F.col("component") != F.col("main")))
    small = F.col("asking") * F.col("size") <= SMALL
    few = split.where(small)
    asked = few.where("asks").select("key", F.col("rep").alias("a"), F.col("d1").alias("da"), F.col("component").alias("of"))
    rest = asked.join(few, "key").where("of <> component").select("a", "da", F.col("rep").alias("b"), F.col("d1").alias("db"))
    # Each pair once, in either order.
    one, two = F.struct(F.col("a").alias("v"), F.col("da").alias("d")), F.struct(F.col("b").alias("v"), F.col("db").alias("d"))
    low, high = F.least(one, two), F.greatest(one, two)
    rest = rest.select(low["v"].alias("a"), low["d"].alias("da"), high["v"].alias("b"), high["d"].alias("db")).distinct()
    done = tested.select("a", "da", "b", "db")
    rest = rest.join(done.union(done.select("b", "db", "a", "da")), ["a", "da", "b", "db"], "left_anti")
    more = _tested(rest, sets, percent).where("linked").select("a", "b")
    whole = components(tested.where("linked").select("a", "b").union(more).union(_gridded(split.where(~small), sets, percent)))
    back = rows.drop("bands").join(classes.select("n_shingles", "d1", "d2", "rep"), ["n_shingles", "d1", "d2"], "left")
    joined = back.join(whole, F.col("rep") == F.col("id"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _gridded(split: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what the large buckets' queries link with: a grid of blocks of queries by blocks of members."""
    grid = F.greatest(F.lit(1), F.least(F.lit(GRID), (F.lit(CELL // 16) / F.col("longest")).cast("int")))
    across, down = F.ceil(F.col("size") / grid).cast("int"), F.ceil(F.col("asking") / grid).cast("int")
    spread = F.xxhash64("rep", "d1", "key")
    column, line = F.pmod(spread, across).cast("int"), F.pmod(spread, down).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    held = split.select("key", "rep", "d1", "component", F.lit(False).alias("asks"), column.alias("x"), F.explode(upto(down)).alias("y"))
    asking = split.where("asks").select("key", "rep", "d1", "component", "asks", F.explode(upto(across)).alias("x"), line.alias("y"))
    cells = held.union(asking).join(sets.withColumnRenamed("id", "rep"), ["rep", "d1"]).select("key", "x", "y", "asks", "rep", "component", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        for batch in batches:
            start = 0
            cell = [batch.column(k).to_numpy() for k in range(3)]
            turns = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cell])) + 1
            if pending and any(pending[-1].column(k)[-1] != batch.column(k)[0] for k in range(3)):
                yield _cell(pending, percent)
                pending = []
            for end in [*turns.tolist(), batch.num_rows]:
                pending.append(batch.slice(start, end - start))
                if end < batch.num_rows:
                    yield _cell(pending, percent)
                    pending = []
                start = end
        if pending:
            yield _cell(pending, percent)

    many = shuffle_partitions(split.sparkSession)
    return cells.repartition(many, "key", "x", "y").sortWithinPartitions("key", "x", "y", "asks").mapInArrow(lean(run), "a long, b long")


def _cell(batches: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """Holds a cell's queries against its members by their shingles' postings."""
    table = pa.Table.from_batches(batches).combine_chunks()
    asks, rep, component = (table.column(k).to_numpy() for k in (3, 4, 5))
    lists = table.column(6).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    values, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
    sizes = np.diff(bounds)
    of = np.repeat(np.arange(len(rep)), sizes)
    held = ~asks[of]
    order = np.argsort(values[held], kind="stable")
    posted, member = values[held][order], of[held][order]
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for q in np.flatnonzero(asks):
        own = values[bounds[q] : bounds[q + 1]]
        low, high = np.searchsorted(posted, own, "left"), np.searchsorted(posted, own, "right")
        count = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        both = np.bincount(member[at], minlength=len(rep))
        hit = np.flatnonzero((both > 0) & (100 * both >= percent * (sizes[q] + sizes - both)) & (component != component[q]))
        ends.append((np.full(len(hit), q), hit))
    if not ends:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
    edges = stars(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]), len(rep))
    return pa.RecordBatch.from_arrays([pa.array(rep[edges[:, 0]]), pa.array(rep[edges[:, 1]])], ["a", "b"])


def _tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, da, b, db: ids and digests) and whether their sets are similar enough. Of an a that many are held against, the set is sent in copies."""
    hot = pairs.groupBy("a", "da").agg(F.count("*").alias("n")).where(F.col("n") > SALTED).select("a", "da", F.ceil(F.col("n") / SALTED).cast("int").alias("copies"))
    hot = stored(hot)
    salt = F.coalesce(F.pmod(F.xxhash64("b", "db"), F.col("copies")).cast("int"), F.lit(0))
    salted = pairs.join(hot, ["a", "da"], "left").withColumn("salt", salt).drop("copies")
    one = sets.select(F.col("id").alias("a"), F.col("d1").alias("da"), F.col("set").alias("sa")).join(hot, ["a", "da"], "left")
    one = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    two = sets.select(F.col("id").alias("b"), F.col("d1").alias("db"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    near = (100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb")))
    return salted.join(two, ["b", "db"]).join(one, ["a", "da", "salt"]).select("a", "da", "b", "db", (near & linked).alias("linked"))
