"""Cover trees over blocks of vectors, and the two dual traversals: exact threshold pairs and exact top-k search.

A tree's levels are nested and their radii halve: a node's own point is the first child's, and further children are
points of the node that no earlier child covers within half the node's radius, so that siblings are more than that
apart. Each node also knows its true covering radius.

Threshold pairs: pairs of nodes are expanded, both sides at once, unless their covering radii put all their pairs below
or above the threshold. Top-k: a group of queries (a node of the queries' tree) holds a set of data nodes; of query group
and data nodes those with the larger radii are expanded, and a data node goes as soon as its bound falls below what every
query of the group reaches already, by its worst kth score so far or by the scores that the set's points promise.

Scale: rows are dealt to cells around at most `PIVOTS` vectors (the smallest hashes, a bounded sample; cells only steer
the work, every row is indexed); a cell of more than `BLOCK` rows is split by a hash, so a third of all vectors in one
place makes many blocks. A block is one packed row. Above the blocks are pages: cover trees over up to `PAGE` blocks'
centres, whose nodes' radii include the blocks' own. Only pages meet page by page; a dual traversal of two of them yields
the pairs of blocks that bounds don't rule out. Blocks that are neighbours in a page's tree make a tile, and blocks are
sent to pairs of tiles, not to pairs of blocks. A search has two rounds: a block of queries first meets the data of its
own cell, and the worst kth scores that it takes from there decide which other blocks it meets, best bound first.
Vectors of many directions leave such bounds nothing to prune, and then all pairs of blocks meet, in matrix products;
that is what an exact answer costs there.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import lean, stored

BLOCK = 4096
#: Queries of a block of them.
ASKED = 512
PIVOTS = 1024
#: Blocks of a page, and of a tile of data or of queries.
PAGE, TILE, ASKING_TILE = 4096, 4, 16
#: More than the error of a distance that is taken from products of unit vectors (about 2e-8).
_EPS = 1e-7
#: Rows of a product at once.
_ROWS = 1024


class Tree:
    """Nodes in arrays: point, covering radius, first child and the one after the last, and where its points are in `order`."""

    def __init__(self, x: np.ndarray, parts: tuple[np.ndarray, ...]):
        self.x = x
        self.point, self.radius, self.first, self.last, self.low, self.high, self.order = parts
        self.size = self.high - self.low

    def dump(self) -> bytes:
        return pickle.dumps((self.point, self.radius, self.first, self.last, self.low, self.high, self.order), protocol=5)

    @classmethod
    def load(cls, x: np.ndarray, data: bytes) -> Tree:
        return cls(x, pickle.loads(data))

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = 1) -> Tree:
        """x has one row at least."""
        square = (x * x).sum(1)
        gram = x @ x.T if len(x) <= BLOCK else None
        n = len(x)
        point, first, last = [0], [0], [0]
        members = [np.arange(n)]
        radii = [float(np.sqrt(max(0.0, (square + square[0] - 2 * x @ x[0]).max())))]
        node, count = 0, 1
        while node < count:
            own, radius = members[node], radii[node]
            if len(own) > leaf and radius > _EPS:
                half, rest, c = radius / 2, own, point[node]
                first[node] = count
                while len(rest):
                    products = gram[c, rest] if gram is not None else x[rest] @ x[c]
                    distance = np.sqrt(np.maximum(0.0, square[rest] + square[c] - 2 * products))
                    near = distance <= half
                    near[rest == c] = True
                    members.append(rest[near])
                    point.append(int(c))
                    radii.append(float(distance[near].max()))
                    first.append(0)
                    last.append(0)
                    count += 1
                    rest = rest[~near]
                    c = rest[0] if len(rest) else 0
                last[node] = count
            node += 1
        low, high = np.zeros(count, np.int64), np.zeros(count, np.int64)
        high[0] = n
        order = np.arange(n)
        for node in range(count):  # parents come before their children
            if last[node]:
                at = low[node]
                for child in range(first[node], last[node]):
                    low[child], high[child] = at, at + len(members[child])
                    at = high[child]
            else:
                order[low[node] : high[node]] = members[node]
        return cls(x, (np.array(point), np.array(radii), np.array(first), np.array(last), low, high, order))

    def members(self, node: int) -> np.ndarray:
        return self.order[self.low[node] : self.high[node]]

    def children(self, node: int) -> np.ndarray:
        return np.arange(self.first[node], self.last[node])

    def is_leaf(self, node: int) -> bool:
        return self.last[node] == 0


def linked(a: Tree, b: Tree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: how many of b each of a links with, and of a each of b; and star edges (place in a, then len(a) + place in b) that connect what links connect."""
    limit = float(np.sqrt(2 - 2 * cosine))
    na, nb = len(a.x), len(b.x)
    count_a, count_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    if not na or not nb:
        return count_a, count_b, np.zeros((0, 2), np.int64)

    def exact(rows: np.ndarray, cols: np.ndarray) -> None:
        found = a.x[rows] @ b.x[cols].T >= cosine
        count_a[rows] += found.sum(1)
        count_b[cols] += found.sum(0)
        i, j = np.nonzero(found)
        ends.append((rows[i], cols[j]))

    def whole(rows: np.ndarray, cols: np.ndarray) -> None:
        count_a[rows] += len(cols)
        count_b[cols] += len(rows)
        ends.append((np.concatenate([rows, np.full(len(cols), rows[0])]), np.concatenate([np.full(len(rows), cols[0]), cols])))

    pending = [(0, 0)]
    while pending:
        i, j = pending.pop()
        apart = float(np.linalg.norm(a.x[a.point[i]] - b.x[b.point[j]]))
        reach = a.radius[i] + b.radius[j]
        if apart > limit + reach + _EPS:
            continue
        if apart + reach < limit - _EPS:
            whole(a.members(i), b.members(j))
            continue
        if a.is_leaf(i) and b.is_leaf(j):
            exact(a.members(i), b.members(j))
            continue
        left = np.array([i]) if a.is_leaf(i) else a.children(i)
        right = np.array([j]) if b.is_leaf(j) else b.children(j)
        # What even the largest radii rule out is dropped from the products; each pair's own bound decides on the rest.
        least = 1 - min(2.0, limit + float(a.radius[left].max() + b.radius[right].max()) + _EPS) ** 2 / 2 - 1e-12
        for rows in range(0, len(left), _ROWS):
            part = left[rows : rows + _ROWS]
            products = a.x[a.point[part]] @ b.x[b.point[right]].T
            p, q = np.nonzero(products >= least)
            product = products[p, q]
            p, q = part[p], right[q]
            near = np.sqrt(np.maximum(0.0, 2 - 2 * product)) <= limit + a.radius[p] + b.radius[q] + _EPS
            p, q, product = p[near], q[near], product[near]
            single = (a.size[p] == 1) & (b.size[q] == 1)
            hit = single & (product >= cosine)
            if hit.any():
                u, v = a.point[p[hit]], b.point[q[hit]]
                np.add.at(count_a, u, 1)
                np.add.at(count_b, v, 1)
                ends.append((u, v))
            pending.extend(zip(p[~single].tolist(), q[~single].tolist()))
    if not ends:
        return count_a, count_b, np.zeros((0, 2), np.int64)
    u, v = np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]) + na
    return count_a, count_b, stars(u, v, na + nb)


def stars(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Edges (v, smallest of its component) for every vertex of the edges u-v that is not itself the smallest."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            onward = label[label]
            if (onward == label).all():
                break
            label = onward
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
        if (before == label).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return np.stack([moved, label[moved]], 1)


def meeting(a: Tree, b: Tree, near: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of points that no pair of nodes above them rules out; near(products, nodes of a, nodes of b) says which pairs of nodes it doesn't."""
    rows, cols = [], []
    pending = [(0, 0)]
    while pending:
        i, j = pending.pop()
        left = np.array([i]) if a.is_leaf(i) else a.children(i)
        right = np.array([j]) if b.is_leaf(j) else b.children(j)
        for at in range(0, len(left), _ROWS // 2):
            part = left[at : at + _ROWS // 2]
            p, q = np.nonzero(near(a.x[a.point[part]] @ b.x[b.point[right]].T, part, right))
            p, q = part[p], right[q]
            done = (a.last[p] == 0) & (b.last[q] == 0)
            single = done & (a.size[p] == 1) & (b.size[q] == 1)
            rows.append(a.point[p[single]])
            cols.append(b.point[q[single]])
            for u, v in zip(p[done & ~single], q[done & ~single]):
                x, y = a.members(u), b.members(v)
                rows.append(np.repeat(x, len(y)))
                cols.append(np.tile(y, len(x)))
            pending.extend(zip(p[~done].tolist(), q[~done].tolist()))
    return np.concatenate(rows), np.concatenate(cols)


class Search:
    """The k highest inner products of each query of a tree, ties to smaller ids, over one tree of data after the other."""

    def __init__(self, queries: Tree, ids: np.ndarray, k: int, worst: np.ndarray | None = None):
        n = len(queries.x)
        self.tree, self.ids, self.k = queries, ids, k
        self.norm = np.linalg.norm(queries.x, axis=1)
        self.score, self.name = [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n
        #: What a new score has to reach.
        self.worst = np.full(n, -np.inf) if worst is None else worst.copy()
        #: Inner products so far.
        self.products = 0

    def over(self, data: Tree, ids: np.ndarray) -> None:
        queries, norm = self.tree, np.linalg.norm(data.x, axis=1)
        # So many points of data may be a query's own.
        promised = self.k + int(np.unique(ids, return_counts=True)[1].max())
        pending = [(np.array([0]), np.array([0]), np.full((1, 1), np.nan))]
        while pending:
            group, held, products = pending.pop()
            points = data.point[held]
            fresh = np.isnan(products[0])
            products[:, fresh] = queries.x[queries.point[group]] @ data.x[points[fresh]].T
            self.products += len(group) * int(fresh.sum())
            reach, size = queries.radius[group][:, None], norm[points][None, :]
            most = products + self.norm[queries.point[group]][:, None] * data.radius[held] + reach * (size + data.radius[held])
            most += np.abs(most) * 1e-12 + 1e-6
            for row, c in enumerate(group):
                own = queries.members(c)
                least = self.worst[own].min()
                if len(held) >= promised:
                    safe = products[row] - queries.radius[c] * norm[points]
                    least = max(least, np.partition(safe, len(safe) - promised)[len(safe) - promised] - 1e-6)
                keep = most[row] >= least
                if not keep.any():
                    continue
                left = held[keep]
                inner = data.last[left] > 0
                widest = data.radius[left[inner]].max() if inner.any() else -1.0
                known = products[row][keep]
                if not queries.is_leaf(c) and queries.radius[c] >= widest:
                    below = queries.children(c)
                    pending.append((below, left, np.full((len(below), len(left)), np.nan)))
                elif inner.any():
                    wide = inner & (data.radius[left] >= widest / 2)
                    below = [data.children(j) for j in left[wide]]
                    # A node's first child has its point, and so its product.
                    again = np.concatenate([known[~wide], *(np.r_[p, np.full(len(b) - 1, np.nan)] for p, b in zip(known[wide], below))])
                    pending.append((np.array([c]), np.concatenate([left[~wide], *below]), again[None, :]))
                else:
                    self._take(own, data, ids, left, known)

    def _take(self, own: np.ndarray, data: Tree, ids: np.ndarray, left: np.ndarray, products: np.ndarray) -> None:
        sizes = data.size[left]
        cols = data.point[left] if (sizes == 1).all() else np.concatenate([data.members(j) for j in left])
        alike = len(own) == 1 and not data.radius[left].any()
        for q in own:
            line = np.repeat(products, sizes) if alike else data.x[cols] @ self.tree.x[q]
            new = np.flatnonzero(line >= self.worst[q])
            new = new[ids[cols[new]] != self.ids[q]]
            if len(new) > self.k:
                edge = np.partition(line[new], len(new) - self.k)[len(new) - self.k]
                new = new[line[new] >= edge]
            score, name = np.concatenate([self.score[q], line[new]]), np.concatenate([self.name[q], ids[cols[new]]])
            order = np.lexsort((name, -score))[: self.k]
            self.score[q], self.name[q] = score[order], name[order]
            if len(order) == self.k:
                self.worst[q] = max(self.worst[q], score[order[-1]])


# --- blocks ----------------------------------------------------------------------------------------------------------


def _valid(rows: DataFrame, keep_zero: bool) -> DataFrame:
    """vec_id and embedding, in double precision, of the rows that take part."""
    valid = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if not keep_zero:
        valid = valid & F.exists("embedding", lambda x: x != 0)
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & valid)


def pivots_of(rows: DataFrame) -> list[np.ndarray]:
    """Vectors with the smallest hashes, one for each BLOCK rows, `PIVOTS` at most."""
    total = rows.count()
    many = max(1, min(PIVOTS, -(-total // BLOCK)))
    place = F.xxhash64("vec_id", "embedding")
    # About four times as many as are wanted pass, wherever they lie.
    few = rows.where(F.pmod(place, F.lit(max(1, total))) < 4 * many + 64) if total > 8 * many + 128 else rows
    return [np.array(r["embedding"]) for r in few.orderBy(place, "vec_id").limit(many).collect()]


def blocks(rows: DataFrame, pivots: list[np.ndarray], *, prepare: Callable[[np.ndarray], np.ndarray], size: int) -> DataFrame:
    """Valid rows packed into blocks (a written table) of prepared vectors, each with its tree."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, tuple[list[int], np.ndarray]] = {}
        for c, p in enumerate(shared.value):
            by_length.setdefault(len(p), ([], []))[0].append(c)
            by_length[len(p)][1].append(p / max(np.linalg.norm(p), 1e-300))
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            cell = -lengths.astype(np.int64) - 1
            for dims, (names, p) in by_length.items():
                own = np.flatnonzero(lengths == dims)
                if len(own):
                    x = flat[(starts[own][:, None] + np.arange(dims)).reshape(-1)].reshape(-1, dims)
                    cell[own] = np.array(names)[np.argmax(x @ np.array(p).T, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(lengths.astype(np.int32)), batch.column(0), batch.column(1)], ["cell", "dims", "vec_id", "embedding"])

    dealt = stored(rows.mapInArrow(lean(deal), "cell long, dims int, vec_id long, embedding array<double>"))
    sizes = dealt.groupBy("cell", "dims").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))
    split = dealt.join(sizes, ["cell", "dims"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.col("embedding")), F.col("parts")))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        x = prepare(np.stack(frame["embedding"].to_numpy()))
        tree = Tree.build(x)
        return pd.DataFrame([(*key, len(x), frame["vec_id"].to_numpy(np.int64).tobytes(), x.tobytes(), tree.dump(), x[tree.point[0]], float(tree.radius[0]))], columns=["cell", "dims", "part", "n", "ids", "vectors", "tree", "centre", "radius"])

    packed = split.groupBy("cell", "dims", "part").applyInPandas(pack, "cell long, dims int, part long, n int, ids binary, vectors binary, tree binary, centre array<double>, radius double")
    return stored(packed.withColumn("block", F.xxhash64("ids", "vectors")))


def _unpacked(ids: bytes, raw: bytes, tree: bytes, dims: int) -> tuple[np.ndarray, Tree]:
    return np.frombuffer(ids, np.int64), Tree.load(np.frombuffer(raw, np.float64).reshape(-1, dims), tree)


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# --- pages and tiles -------------------------------------------------------------------------------------------------


def pages(packed: DataFrame, tile: int, floor: str = "radius") -> DataFrame:
    """Blocks' balls, up to PAGE of one length packed into a row with a tree; floor: a column to carry."""
    parts = -(-packed.count() // PAGE) or 1
    light = packed.select("block", "dims", "centre", "radius", F.col(floor).alias("floor"), F.pmod(F.xxhash64("block"), F.lit(parts)).alias("page"))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", kind="stable")
        x = np.stack(frame["centre"].to_numpy())
        tree = Tree.build(x)
        tiles = np.empty(len(x), np.int64)
        tiles[tree.order] = (int(key[0]) * parts + int(key[1])) * PAGE + np.arange(len(x)) // tile
        arrays = (frame["block"].to_numpy(np.int64), x, frame["radius"].to_numpy(float), frame["floor"].to_numpy(float), tiles)
        return pd.DataFrame([(*key, *(v.tobytes() for v in arrays), tree.dump())], columns=["dims", "page", "blocks", "centres", "radii", "floors", "tiles", "tree"])

    return light.groupBy("dims", "page").applyInPandas(pack, "dims int, page long, blocks binary, centres binary, radii binary, floors binary, tiles binary, tree binary")


class Page:
    def __init__(self, dims: int, blocks: bytes, centres: bytes, radii: bytes, floors: bytes, tiles: bytes, tree: bytes):
        self.blocks, self.tiles = np.frombuffer(blocks, np.int64), np.frombuffer(tiles, np.int64)
        self.radii, self.floors = np.frombuffer(radii), np.frombuffer(floors)
        self.tree = Tree.load(np.frombuffer(centres).reshape(-1, dims), tree)
        t = self.tree
        within = [t.members(n) for n in range(len(t.point))]
        #: Of each node: radius with its blocks' own, least floor, norm and square of its point.
        self.reach = t.radius + np.array([self.radii[m].max() for m in within])
        self.floor = np.array([self.floors[m].min() for m in within])
        self.square = (t.x[t.point] ** 2).sum(1)
        self.norm = np.sqrt(self.square)


#: Of products of centres, and nodes of two pages: which pairs of nodes may hold pairs of interest; and a bound to sort by.
Bound = Callable[[Page, Page, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def within(limit: float) -> Bound:
    """Pairs of vectors that may be as near as limit."""

    def bound(a: Page, b: Page, products: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = np.sqrt(np.maximum(0.0, a.square[i][:, None] + b.square[j] - 2 * products))
        slack = limit + a.reach[i][:, None] + b.reach[j] + 1e-6 - apart
        return slack >= 0, slack

    return bound


def reaching(a: Page, b: Page, products: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of queries and vectors whose product may reach the floor."""
    most = products + a.norm[i][:, None] * b.reach[j] + a.reach[i][:, None] * (b.norm[j] + b.reach[j])
    most += np.abs(most) * 1e-12 + 1e-6
    return most >= a.floor[i][:, None], most


_PAGE = ("blocks", "centres", "radii", "floors", "tiles", "tree")


def block_pairs(one: DataFrame, two: DataFrame | None, bound: Bound) -> DataFrame:
    """(ti, tj, i, j): pairs of blocks, and their tiles, that the bound doesn't rule out; of one table with itself (two: None) each pair once."""
    left = one.select("dims", F.col("page").alias("p"), *(F.col(c).alias(f"{c}_i") for c in _PAGE))
    right = (two or one).select("dims", F.col("page").alias("q"), *(F.col(c).alias(f"{c}_j") for c in _PAGE))
    met = left.join(right, ["dims"])
    if two is None:
        met = met.where("p <= q")
    alone = two is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, p, q, *bodies in zip(*batch.columns):
                values = [x.as_py() for x in bodies]
                a, b = Page(dims.as_py(), *values[:6]), Page(dims.as_py(), *values[6:])
                i, j = meeting(a.tree, b.tree, lambda products, u, v: bound(a, b, products, u, v)[0])
                if alone:
                    once = (p.as_py() != q.as_py()) | (a.tiles[i] < b.tiles[j]) | ((a.tiles[i] == b.tiles[j]) & (i <= j))
                    i, j = i[once], j[once]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.tiles[i], b.tiles[j], a.blocks[i], b.blocks[j])], ["ti", "tj", "i", "j"])

    return met.select("dims", "p", "q", *(f"{c}_i" for c in _PAGE), *(f"{c}_j" for c in _PAGE)).mapInArrow(lean(run), "ti long, tj long, i long, j long")


def tiled(pairs: DataFrame, one: DataFrame, two: DataFrame, kernel: Callable[[dict, dict, list[tuple[int, int]]], list[pa.RecordBatch]], schema: str) -> DataFrame:
    """Sends blocks to pairs of tiles and runs kernel(left bodies, right bodies, pairs of blocks) on each; one and two: block and body columns, of the same names."""
    body = [c for c in one.columns if c != "block"]
    grouped = pairs.groupBy("ti", "tj").agg(F.collect_list(F.struct("i", "j")).alias("pairs"))  # of two tiles, so few
    side = lambda k, c: F.transform(F.array_distinct(F.transform("pairs", lambda p: p[c])), lambda b: F.struct(F.lit(k).alias("side"), b.alias("of")))
    needs = grouped.select("ti", "tj", "pairs", F.explode(F.concat(side(0, "i"), side(1, "j"))).alias("b")).select("ti", "tj", "pairs", "b.side", "b.of")
    parts = [needs.where(F.col("side") == k).join(bodies, F.col("of") == F.col("block")).drop("block") for k, bodies in ((0, one), (1, two))]
    names = ["ti", "tj", "pairs", "side", "of", *body]
    together = parts[0].select(*names).unionByName(parts[1].select(*names))

    def run(table: pa.Table) -> pa.Table:
        sides: tuple[dict, dict] = ({}, {})
        for row in table.drop_columns(["pairs"]).to_pylist():
            sides[row["side"]][row["of"]] = row
        asked = [(p["i"], p["j"]) for p in table.column("pairs")[0].as_py()]
        return pa.Table.from_batches(kernel(*sides, asked))

    return together.groupBy("ti", "tj").applyInArrow(run, schema)


def near_pairs(rows: DataFrame, cosine: float) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do those of other
    lengths or with a null id. Rows that repeat an id are vectors of their own that share its component; each counts.
    """
    valid = _valid(rows, False)
    packed = blocks(valid, pivots_of(valid), prepare=directions, size=BLOCK)
    pairs = stored(block_pairs(pages(packed, TILE), None, within(float(np.sqrt(2 - 2 * cosine)))))
    bodies = packed.select("block", "dims", "ids", "vectors", "tree")

    def kernel(left: dict, right: dict, asked: list[tuple[int, int]]) -> list[pa.RecordBatch]:
        trees: dict[int, tuple[np.ndarray, Tree]] = {}
        for row in (*left.values(), *right.values()):
            trees[row["of"]] = _unpacked(row["ids"], row["vectors"], row["tree"], row["dims"])
        out = []
        for i, j in asked:
            (na, a), (nb, b) = trees[i], trees[j]
            ca, cb, edges = linked(a, b, cosine)
            if i == j:
                names, count, edges = na, ca - 1, edges % len(na)  # without itself
            else:
                names, count = np.concatenate([na, nb]), np.concatenate([ca, cb])
            own = np.flatnonzero(count > 0)
            n, m = len(own), len(edges)
            first = np.concatenate([names[own], names[edges[:, 0]]])
            second = np.concatenate([np.zeros(n, np.int64), names[edges[:, 1]]])
            links = np.concatenate([count[own], np.zeros(m, np.int64)])
            out.append(pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(links), pa.array(np.arange(n + m) >= n)], ["a", "b", "links", "edge"]))
        return out

    found = stored(tiled(pairs, bodies, bodies, kernel, "a long, b long, links long, edge boolean"))
    counts = found.where("not edge").groupBy(F.col("a").alias("of")).agg(F.sum("links").alias("links"))
    labels = components(found.where("edge").select("a", "b"))
    out = rows.select("vec_id").join(counts, F.col("vec_id") == F.col("of"), "left").join(labels, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


_FOUND = "query_id long, vec_id long, score long"


def _answers(search: Search) -> pa.RecordBatch:
    names = np.repeat(search.ids, [len(x) for x in search.name])
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate(search.name)), pa.array(np.concatenate(search.score).astype(np.int64))], ["query_id", "vec_id", "score"])


def top_k(rows: DataFrame, queries: DataFrame, k: int, scale: float) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows with the highest inner product of floor(scale * x), ties to smaller ids.

    Vectors that are null, empty, or hold null or non-finite components take no part; zero vectors do. A query is held
    against rows of its own length, without its own id. Of rows that repeat a query's id the one with the least vector
    asks; rows that repeat a data id are candidates of their own.
    """
    whole = lambda x: np.floor(scale * x)
    valid, asking = _valid(rows, True), _valid(queries, True).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    pivots = pivots_of(valid)
    data, asked = blocks(valid, pivots, prepare=whole, size=BLOCK), blocks(asking, pivots, prepare=whole, size=ASKED)
    home = data.where("part = 0").select("cell", "dims", F.col("block").alias("met"), *(F.col(c).alias(f"{c}_j") for c in ("ids", "vectors", "tree")))
    body = ["block", "dims", "centre", "radius", "ids", "vectors", "tree"]
    first = asked.join(home, ["cell", "dims"], "left").select(*body, "met", "ids_j", "vectors_j", "tree_j")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worst, floor, found = [], [], []
            for row in batch.to_pylist():
                search = Search(_tree_of(row), np.frombuffer(row["ids"], np.int64), k)
                if row["met"] is not None:
                    ids, tree = _unpacked(row["ids_j"], row["vectors_j"], row["tree_j"], row["dims"])
                    search.over(tree, ids)
                worst.append(search.worst.tobytes())
                floor.append(float(search.worst.min()))
                found.append(_answers(search).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(worst, pa.binary()), pa.array(floor, pa.float64()), pa.array(found, pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])))], [*body, "met", "worst", "floor", "found"])

    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in body)
    begun = stored(first.mapInArrow(lean(start), f"{kinds}, met long, worst binary, floor double, found array<struct<query_id:bigint,vec_id:bigint,score:bigint>>"))
    pairs = stored(block_pairs(pages(begun, ASKING_TILE, "floor"), pages(data, TILE), reaching))
    none = F.lit(None)
    one = begun.select("block", "dims", "ids", "vectors", "tree", "centre", "radius", "met", "worst")
    two = data.select("block", "dims", "ids", "vectors", "tree", "centre", "radius", none.cast("long").alias("met"), none.cast("binary").alias("worst"))

    def kernel(left: dict, right: dict, asked: list[tuple[int, int]]) -> list[pa.RecordBatch]:
        trees = {j: _unpacked(r["ids"], r["vectors"], r["tree"], r["dims"]) for j, r in right.items()}
        out = []
        for i, row in left.items():
            search = Search(_tree_of(row), np.frombuffer(row["ids"], np.int64), k, np.frombuffer(row["worst"]))
            centre = np.array(row["centre"])
            near = []
            for j in (y for x, y in asked if x == i and y != row["met"]):
                other, reach = np.array(right[j]["centre"]), right[j]["radius"]
                near.append((centre @ other + np.linalg.norm(centre) * reach + row["radius"] * (np.linalg.norm(other) + reach), j))
            for most, j in sorted(near, reverse=True):
                if most + abs(most) * 1e-12 + 1e-6 >= search.worst.min():
                    search.over(trees[j][1], trees[j][0])
            out.append(_answers(search))
        return out

    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = begun.select(F.explode("found").alias("f")).select("f.*").unionByName(tiled(pairs, one, two, kernel, _FOUND))
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _tree_of(row: dict) -> Tree:
    return _unpacked(row["ids"], row["vectors"], row["tree"], row["dims"])[1]
