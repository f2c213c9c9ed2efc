"""Embedding near-duplicates with a forest of random projection trees.

Trees split by random directions at the median, with spill: a row close to the
border goes to both sides.  The upper levels are fitted on a sample; leaves that
are still too large are split further in rounds, each fitted on rows of its own,
so that leaves have one size whatever the number of rows.  Rows are compared
inside leaves.  A pair that shares several leaves counts in the first of them
only, so leaves hand on counts and star edges, a row per vector, and never pairs.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

#: Trees, rows of a leaf, spill, and rows of a block of a leaf that can't be split.
TREES, LEAF, SPILL, BLOCK = 12, 512, 0.2, 1536
#: The upper levels are fitted on at most SAMPLE vectors, those with the smallest hashes of their ids, and a leaf that
#: is split further on about FIT of its own; every vector is routed.  A leaf holds LEAST rows of a sample or more.
SAMPLE, FIT, LEAST = 16384, 2048, 32
#: Rows of a leaf that one task routes at a time, and from how many times LEAF on a leaf is split further.
PART, LARGE = 8192, 1.25
#: Copies of vectors, one a row and leaf, that stand on disk at a time, about: leaves are dealt to so many rounds, at most ROUNDS.
COPIES, ROUNDS = 3_000_000, 32


class Tree:
    """Directions, borders and children of the inner nodes, the root first; leaves are numbered from 0, as -1 - number."""

    def __init__(self, sample: np.ndarray, leaf: float, margin: float, seed: int):
        self.margin, self.leaves = margin, 0
        self.directions, self.borders, self.children = [], [], []
        rng = np.random.default_rng(seed)
        self.root = self._grow(sample, np.arange(len(sample)), max(leaf, LEAST), rng, 0)

    def _grow(self, x, rows, leaf, rng, depth):
        if len(rows) > leaf and depth < 40:
            ways = rng.normal(size=(x.shape[1], 3))
            at = x[rows] @ (ways / np.linalg.norm(ways, axis=0))
            widest = int(np.argmax(at.std(axis=0)))  # of three random directions
            at, border = at[:, widest], float(np.median(at[:, widest]))
            left, right = rows[at <= border + self.margin], rows[at >= border - self.margin]
            # A clump within the margin can't be split: it stays a leaf, which is compared in blocks.
            if max(len(left), len(right)) <= 0.85 * len(rows):
                me = len(self.borders)
                self.directions.append(ways[:, widest] / np.linalg.norm(ways[:, widest]))
                self.borders.append(border)
                self.children.append(None)
                self.children[me] = (self._grow(x, left, leaf, rng, depth + 1), self._grow(x, right, leaf, rng, depth + 1))
                return me
        self.leaves += 1
        return -self.leaves

    def to_bytes(self) -> bytes:
        return pickle.dumps((self.margin, self.root, np.array(self.directions), self.borders, self.children))

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.margin, tree.root, tree.directions, tree.borders, tree.children = pickle.loads(data)
        return tree

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that each row goes to."""
        out, todo = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, np.full(len(rows), -node - 1, np.int64)))
                continue
            at = x[rows] @ self.directions[node]
            for child, side in zip(self.children[node], (at <= self.borders[node] + self.margin, at >= self.borders[node] - self.margin)):
                todo.append((child, rows[side]))
        return tuple(np.concatenate(c) for c in zip(*out))


class Forest:
    """Trees over a sample of a table; their leaves are numbered through."""

    def __init__(self, sample: np.ndarray, total: int, margin: float, trees: int = TREES, leaf: int = LEAF, seed: int = 5):
        self.trees = [Tree(sample, leaf * len(sample) / max(total, 1), margin, seed + k) for k in range(trees)]
        self.first = np.cumsum([0, *[t.leaves for t in self.trees]])

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [t.route(x) for t in self.trees]
        row, leaf = np.concatenate([r for r, _ in found]), np.concatenate([k + f for (_, k), f in zip(found, self.first)])
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def margin_of(least: float, dim: int, spill: float = SPILL) -> float:
    """Two unit vectors of cosine ``least`` are ``apart``; projected, their distance has about apart / sqrt(dim) as deviation."""
    return spill * math.sqrt(max(0.0, 2 - 2 * least)) / math.sqrt(dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _neighbours(x: np.ndarray, least: float) -> np.ndarray:
    """Whether rows a and b, a < b, have cosine at least ``least``; a byte a pair, made in blocks."""
    out = np.zeros((len(x), len(x)), bool)
    for i in range(0, len(x), 512):
        np.greater_equal(x[i : i + 512] @ x.T, least, out=out[i : i + 512])
    return np.triu(out, 1)


def _apart(lists: pa.ListArray, before: int) -> np.ndarray:
    """Whether each two lists share no number below ``before``, some numbers at a time."""
    where, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    owner = np.repeat(np.arange(len(lists)), size)[where < before]
    _, at, many = np.unique(where[where < before], return_inverse=True, return_counts=True)
    column = np.cumsum(many > 1) - 1
    owner, at = owner[many[at] > 1], column[at[many[at] > 1]]
    out = np.ones((len(lists), len(lists)), bool)
    for i in range(0, int((many > 1).sum()), 1024):
        here = (at >= i) & (at < i + 1024)
        member = np.zeros((len(lists), 1024), np.float32)
        member[owner[here], at[here] - i] = 1
        for k in range(0, len(lists), 512):
            out[k : k + 512] &= member[k : k + 512] @ member.T == 0
    return out


def compare(table: pa.Table, dim: int, least: float) -> pa.Table:
    """(rep, links, root) of the rows of one leaf, or of two blocks of it, that have links there.

    Pairs are bytes of square tables, so that memory follows the rows of two blocks
    and neither the number of links nor that of leaves.
    """
    empty = pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    table = table.take(pa.array(np.argsort(table.column("rep").to_numpy(), kind="stable")))
    link = _neighbours(_unit(V.matrix(table.column("v"), dim)), least)
    if table.column("pair")[0].as_py():
        sub = table.column("sub").to_numpy()
        link &= sub[:, None] != sub[None, :]
    rows = np.flatnonzero(link.any(axis=0) | link.any(axis=1))
    if not len(rows):
        return empty
    link = link[np.ix_(rows, rows)]
    rep, n = table.column("rep").to_numpy()[rows], table.column("n").to_numpy()[rows]
    # A pair that shares a leaf before this one is counted there.
    fresh = _apart(table.column("leaves").combine_chunks().take(pa.array(rows)), table.column("leaf")[0].as_py())
    fresh &= link
    links = np.zeros(len(rows), np.int64)
    for i in range(0, len(rows), 512):
        links[i : i + 512] += fresh[i : i + 512] @ n
        links += n[i : i + 512] @ fresh[i : i + 512]
    link |= link.T
    root = np.full(len(rows), -1)
    for i in range(len(rows)):  # smallest reachable row, from the smallest on
        front = np.array([i]) if root[i] < 0 else []
        while len(front):
            root[front] = i
            near = np.zeros(len(rows), bool)
            for k in range(0, len(front), 512):
                near |= link[front[k : k + 512]].any(axis=0)
            front = np.flatnonzero(near & (root < 0))
    return pa.table({"rep": rep, "links": links, "root": rep[root]})


def _leaf_of(leaf: np.ndarray | int, sub: np.ndarray) -> np.ndarray:
    """Number of a leaf's leaf: a 64-bit hash of both."""
    return C.mix64(C.mix64(np.asarray(leaf, np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + sub.astype(np.uint64)).view(np.int64)


def rounds_of(total: int, trees: int) -> int:
    """In how many rounds the leaves of ``total`` rows go, with about two leaves a tree and row."""
    return max(1, min(ROUNDS, -(-2 * trees * total // COPIES)))


def of_round(rows: DataFrame, k: int, rounds: int) -> DataFrame:
    """The rows whose leaf belongs to a round; each leaf is in one, with all its rows."""
    return rows if rounds == 1 else rows.where(F.pmod(F.xxhash64(F.lit(11), "leaf"), F.lit(rounds)) == k)


def split_leaves(members: DataFrame, dim: int, leaf: int, margin: float, seed: int, fit: int) -> DataFrame:
    """(leaf, rep, v) of ``members`` (leaf, size, rep, v) in leaves of their leaves.

    Each leaf gets a tree fitted on about ``fit`` of its own rows; its rows are
    dealt to tasks of PART rows, each of which has a copy of the tree.
    """
    h, kind = F.xxhash64("rep", "leaf"), members.schema["v"].dataType.simpleString()
    number = V.number_of(members, "v")
    low = F.when(F.col("size") > fit, (F.lit(fit) / F.col("size") * 2.0**64 - 2.0**63).cast("long")).otherwise(F.lit((1 << 63) - 1))

    def grow(t: pa.Table) -> pa.Table:
        x = _unit(V.matrix(t.column("v"), dim))
        size, k = t.column("size")[0].as_py(), t.column("leaf")[0].as_py()
        tree = Tree(x, leaf * len(x) / size, margin, seed + k % (1 << 32))
        return pa.table({"leaf": pa.array([k], pa.int64()), "parts": pa.array([-(-size // PART)], pa.int64()), "tree": pa.array([tree.to_bytes()], pa.binary())})

    trees = C.cut(members.where(h <= low).groupBy("leaf").applyInArrow(grow, "leaf long, parts long, tree binary"))
    trees = trees.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "tree")
    dealt = members.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "rep"), F.ceil(F.col("size") / PART)))

    def route(rows: pa.Table, tree: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"leaf": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "v": pa.array([], pa.list_(number))})
        if not tree.num_rows:  # none of its rows was picked to fit on: it stays as it is
            return rows.select(["leaf", "rep", "v"])
        x = V.matrix(rows.column("v"), dim)
        row, sub = Tree.from_bytes(tree.column("tree")[0].as_py()).route(_unit(x))
        return pa.table({"leaf": _leaf_of(rows.column("leaf")[0].as_py(), sub), "rep": rows.column("rep").to_numpy()[row], "v": V.lists(x[row], number)})

    return dealt.groupBy("leaf", "part").cogroup(trees.groupBy("leaf", "part")).applyInArrow(route, f"leaf long, rep long, v {kind}")


def _split_in_rounds(members: DataFrame, sizes: DataFrame, dim: int, leaf: int, margin: float, fit: int, rounds: int) -> DataFrame:
    """(leaf, rep) of ``members`` (leaf, rep, v) when leaves have been split as far as they can be."""
    closed, last = None, None
    for k in range(rounds):
        large = sizes.where(F.col("size") > LARGE * leaf)
        over = large.agg(F.count("*").alias("leaves"), F.sum("size").alias("rows")).first()
        stuck = last is not None and (over.rows or 0) >= 0.98 * last
        small = members if not over.leaves or stuck else members.join(large.select("leaf"), "leaf", "left_anti")
        small = small.select("leaf", "rep")
        closed = small if closed is None else closed.unionByName(small)
        if not over.leaves or stuck:
            return closed
        last = over.rows
        members = C.cut(split_leaves(members.join(large, "leaf"), dim, leaf, margin, 1000 * (k + 1), fit))
        sizes = C.cut(members.groupBy("leaf").agg(F.count("*").alias("size")))
    return closed.unionByName(members.select("leaf", "rep"))


def leaves_of(classes: DataFrame, dim: int, least: float, trees: int, leaf: int, sample: int, fit: int = FIT, rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """(rep, n, v, leaves) of all classes, the leaves of each sorted; and (leaf, size) of all leaves.

    Rounds of splitting go on while a leaf has over LARGE times ``leaf`` rows and the
    last round made it smaller.  What a round has split stands in the shared folder.
    Of a large table, one share of the leaves after the other is split.
    """
    margin = margin_of(least, dim)
    total = classes.count()
    some = C.smallest_hashes(classes.select("rep", "v"), "rep", sample).toArrow()
    shared = classes.sparkSession.sparkContext.broadcast(Forest(_unit(V.matrix(some.column("v"), dim)), total, margin, trees, leaf))  # SAMPLE and LEAST bound its nodes

    def route(batches):
        for batch in batches:
            x = V.matrix(batch.column("v"), dim)
            for a in range(0, len(x), 2048):
                row, at = shared.value.route(_unit(x[a : a + 2048]))
                ends = np.searchsorted(row, np.arange(min(2048, len(x) - a) + 1)).astype(np.int32)
                part = batch.slice(a, 2048)
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("n"), part.column("v"), pa.ListArray.from_arrays(pa.array(ends), pa.array(at))], names=["rep", "n", "v", "leaves"])

    routed = classes.select("rep", "n", "v").mapInArrow(route, f"rep long, n long, v {classes.schema['v'].dataType.simpleString()}, leaves array<long>")
    shares = rounds_of(total, trees)
    routed = C.cut(routed) if shares > 1 else routed
    sizes = C.cut(routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("size")))
    if sizes.where(F.col("size") > LARGE * leaf).isEmpty():
        return routed, sizes
    closed = None
    for k in range(shares):
        members = of_round(routed.select(F.explode("leaves").alias("leaf"), "rep", "v"), k, shares)
        done = C.cut(_split_in_rounds(C.cut(members), of_round(sizes, k, shares), dim, leaf, margin, fit, rounds))
        closed = done if closed is None else closed.unionByName(done)
        C.sweep(classes.sparkSession)
    lists = closed.groupBy("rep").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    return C.cut(classes.select("rep", "n", "v").join(lists, "rep")), closed.groupBy("leaf").agg(F.count("*").alias("size"))


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE, fit: int = FIT
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Equal vectors are one class, with its size as weight.  Vectors that are null,
    empty, zero, of an odd length or hold null or non-finite components, and rows
    without id, link with nothing (component_id is then vec_id).  Rows with one id
    are vectors of their own.
    """
    v = F.col(vector_col)  # 4 bytes a number stay 4 bytes on disk; arithmetic is in 8
    v = v if vectors.select(v).schema[0].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    everything = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = everything.where(V.usable(F.col("v")) & F.col("vec_id").isNotNull())
    fine, dim = V.of_one_length(fine, "v")
    shape = F.coalesce(V.usable(F.col("v")) & (F.size("v") == dim) & F.col("vec_id").isNotNull(), F.lit(False))
    h1, h2 = F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")
    members = everything.select("vec_id", F.when(shape, F.xxhash64("v")).alias("h1"), F.when(shape, F.xxhash64(F.lit(1), "v")).alias("h2"))
    alone = members.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not dim:
        return alone
    classes = C.cut(fine.select("vec_id", "v", h1, h2).groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    routed, sizes = leaves_of(classes, dim, least, trees, leaf, sample, fit)
    # A leaf above ``block`` rows, a clump, goes by pairs of blocks, so that no group is larger than two.
    cuts = sizes.where(F.col("size") > block).select(F.col("leaf").alias("cut_leaf"), F.ceil(F.col("size") / block).cast("long").alias("parts"))
    dealt = routed.select("rep", "n", "v", "leaves", F.explode("leaves").alias("leaf"))
    dealt = dealt.join(cuts, F.col("leaf") == F.col("cut_leaf"), "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("leaf", F.least("sub", "other").alias("low"), F.greatest("sub", "other").alias("high"), (F.col("sub") != F.col("other")).alias("pair"), "sub", "rep", "n", "leaves", "v")
    found, shares = None, rounds_of(classes.count(), trees)
    for k in range(shares):
        some = C.cut(of_round(dealt, k, shares).groupBy("leaf", "low", "high").applyInArrow(lambda t: compare(t, dim, least), "rep long, links long, root long"))
        found = some if found is None else found.unionByName(some)
        if shares > 1:
            C.sweep(classes.sparkSession)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = C.connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    marks = classes.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(component, F.col("rep") == F.col("node"), "left")
    marks = C.cut(marks.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = members.where("h1 is not null").join(marks, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    return linked.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).union(alone)
