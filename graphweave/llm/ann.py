"""Nearest neighbours over shifted Hilbert curves.

Several Hilbert orderings of projected, shifted vectors are range-partitioned.
A query meets the tile of its key and the tiles beside it in every ordering;
their best rows are merged and reranked.  Rows stay in the tile of their key and
only queries travel to neighbouring tiles, so that a wide window costs products
of matrices, no shuffle.

With ``exact`` a check follows: the distance of a query's k-th best so far bounds
which blocks of rows can hold a nearer one, from their centres and radii, a row a
block; only those are met.  On clustered rows they are few, on independent ones
nearly all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

CURVES, DIMS, CELL_BITS, TILE, BLOCK, QUERY_BLOCK = 8, 8, 7, 4096, 4096, 512
#: Queries of a group that meets the blocks' centres and radii in one task.
ASKS = 16384
#: The projections' ranges come from at most so many rows, those with the smallest hashes of their ids.
SAMPLE = 8192
_FOUND = "query_id long, vec_id long, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cells (n, dims), as unsigned 64-bit integers."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(dims):
            is_set = (x[i] & bit) != 0
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        bit = one << np.uint64(b)
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - one), turn)
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | (((x[i] ^ turn) >> np.uint64(b)) & one)
    return key


class Curves:
    """Projections, ranges and shifts of all orderings."""

    def __init__(self, sample: np.ndarray, n: int = CURVES, dims: int = DIMS, bits: int = CELL_BITS, seed: int = 11):
        d = sample.shape[1]
        rng = np.random.default_rng(seed)
        self.dims, self.bits = min(dims, d), bits
        self.axes = [np.linalg.qr(rng.normal(size=(d, d)))[0][:, : self.dims] for _ in range(n)]
        low, high = zip(*[np.quantile(sample @ a, [0.005, 0.995], axis=0) for a in self.axes])
        self.low, self.high = np.array(low), np.array(high)
        self.shift = np.arange(n) / n

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        """Cells are half as wide as the range allows, so that a shift by up to one range stays inside."""
        span = np.maximum(self.high[curve] - self.low[curve], 1e-12)
        at = np.clip((x @ self.axes[curve] - self.low[curve]) / span, 0, 1 - 1e-9)
        return hilbert(((at + self.shift[curve]) / 2 * (1 << self.bits)).astype(np.uint64), self.bits).astype(np.int64)


def _best(q_ids, q, x_ids, x, k: int, bound=None):
    """(query, row, distance) of the k nearest rows of each query, nearest first, ties to smaller ids; within bound if given."""
    square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :]
    rough = square - 2 * (q @ x.T)
    slack = 1e-9 * (1 + square)  # rounding of the matrix product
    rough[q_ids[:, None] == x_ids[None, :]] = np.inf
    if x.shape[0] > k:
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + 2 * slack
    else:
        limit = np.full((len(q), 1), np.finfo(float).max)
    if bound is not None:
        limit = np.minimum(limit, (bound * bound)[:, None] * (1 + 1e-9) + slack)
    a, b = np.nonzero((rough <= limit) & (rough < np.inf))
    score = V.distances(q[a], x[b])
    if bound is not None:
        fine = score <= bound[a]
        a, b, score = a[fine], b[fine], score[fine]
    order = np.lexsort((x_ids[b], score, a))
    a, b, score = a[order], b[order], score[order]
    start = np.searchsorted(a, np.arange(len(q)))
    keep = np.arange(len(a)) - start[a] < k
    return q_ids[a[keep]], x_ids[b[keep]], score[keep]


def _found(parts) -> pa.Table:
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2].astype(np.float64)})


def _split(table: pa.Table, dim: int):
    """Query rows and data rows of a group."""
    role, ids, x = table.column("role").to_numpy(), table.column("vec_id").to_numpy(), V.matrix(table.column("v"), dim)
    return ids[role == 1], x[role == 1], ids[role == 0], x[role == 0], role


def window_candidates(ranked: DataFrame, dim: int, k: int, tile: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each query's tile and the tiles beside it, in every ordering."""

    def deal(batches):
        for batch in batches:
            curve, place, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("curve", "place", "is_query"))
            at = place // tile
            rows = np.arange(len(at))
            asks = rows[q]
            take = np.concatenate([rows, asks, asks, asks])
            where = np.concatenate([at, at[asks] - 1, at[asks], at[asks] + 1])
            role = np.concatenate([np.zeros(len(rows), np.int32), np.ones(3 * len(asks), np.int32)])
            part = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(curve[take]), pa.array(where), pa.array(role), part.column("vec_id"), part.column("v")], names=["curve", "tile", "role", "vec_id", "v"])

    def best(table):
        q_ids, q, x_ids, x, _ = _split(table, dim)
        if not len(q_ids) or not len(x_ids):
            return _found([])
        return _found([_best(q_ids[i : i + QUERY_BLOCK], q[i : i + QUERY_BLOCK], x_ids, x, k) for i in range(0, len(q_ids), QUERY_BLOCK)])

    dealt = ranked.mapInArrow(deal, "curve int, tile long, role int, vec_id long, v array<double>")
    return dealt.groupBy("curve", "tile").applyInArrow(best, _FOUND).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def ranked_rows(rows: DataFrame, curves: Curves, dim: int) -> DataFrame:
    """(curve, place, vec_id, v, is_query): the rows in every ordering, and their places in it."""

    def spread(batches):
        for batch in batches:
            x = V.matrix(batch.column("v"), dim)
            for c in range(len(curves.axes)):
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(curves.keys(x, c)), *[batch.column(i) for i in ("vec_id", "v", "is_query")]], names=["curve", "key", "vec_id", "v", "is_query"])

    def count(batches):
        from pyspark import TaskContext

        total: dict[int, int] = {}
        for batch in batches:
            for c, n in zip(*np.unique(batch.column("curve").to_numpy(), return_counts=True)):
                total[int(c)] = total.get(int(c), 0) + int(n)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(total), pa.int32()), pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["part", "curve", "n"])

    order = ["curve", "key", "vec_id"]
    dealt = rows.mapInArrow(spread, "curve int, key long, vec_id long, v array<double>, is_query boolean")
    dealt = C.cut(dealt.repartitionByRange(*order).sortWithinPartitions(*order))
    offsets: dict[tuple[int, int], int] = {}
    total: dict[int, int] = {}
    for r in sorted(dealt.select("curve").mapInArrow(count, "part int, curve int, n long").collect()):  # a row or two a partition
        offsets[r.part, r.curve] = total.get(r.curve, 0)
        total[r.curve] = total.get(r.curve, 0) + r.n

    def place(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at = {c: n for (p, c), n in offsets.items() if p == part}
        for batch in batches:
            curve = batch.column("curve").to_numpy()
            out = np.zeros(len(curve), np.int64)
            for c in np.unique(curve):
                here = curve == c
                out[here] = at[int(c)] + np.arange(here.sum())
                at[int(c)] += int(here.sum())
            yield pa.RecordBatch.from_arrays([batch.column("curve"), pa.array(out), batch.column("vec_id"), batch.column("v"), batch.column("is_query")], names=["curve", "place", "vec_id", "v", "is_query"])

    return dealt.mapInArrow(place, "curve int, place long, vec_id long, v array<double>, is_query boolean")


def _prepare(vectors: DataFrame, is_query, id_col: str, vector_col: str):
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(V.usable(F.col("v")) & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "v"])
    rows, dim = V.of_one_length(C.cut(rows), "v")
    return rows, dim


def candidates(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", n_curves: int = CURVES, tile: int = TILE) -> DataFrame:
    """What the curves alone find, unchecked: (query_id, vec_id, score)."""
    rows, dim = _prepare(vectors, is_query, id_col, vector_col)
    if not dim:
        return rows.sparkSession.createDataFrame([], _FOUND)
    return _curve_stage(rows, dim, k, n_curves, tile)[1]


def _curve_stage(rows, dim, k, n_curves, tile):
    sample = C.smallest_hashes(rows.select("vec_id", "v"), "vec_id", SAMPLE).toArrow()
    curves = Curves(V.matrix(sample.column("v"), dim), n_curves)
    ranked = ranked_rows(rows, curves, dim)
    return ranked, C.cut(window_candidates(ranked, dim, k, tile))


def reachable(asks: DataFrame, blocks: DataFrame, total: int, dim: int) -> DataFrame:
    """(block, asks, vec_id): the blocks (block, centre, radius) that can hold a row within each query's bound.

    Queries go in groups of about ASKS; every group meets all blocks, a row a block.
    """
    groups = max(1, -(-total // ASKS))
    one = asks.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), F.lit(-1).cast("long").alias("block"), "asks", "vec_id", "v", "bound")
    two = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "block", F.lit(0).alias("asks"), F.lit(0).cast("long").alias("vec_id"), F.col("centre").alias("v"), F.col("radius").alias("bound"))

    def meet(t: pa.Table) -> pa.Table:
        block, x, far = t.column("block").to_numpy(), V.matrix(t.column("v"), dim), t.column("bound").to_numpy()
        q, c = np.flatnonzero(block < 0), np.flatnonzero(block >= 0)
        hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i in range(0, len(q), 1024):
            part = x[q[i : i + 1024]]
            apart = np.sqrt(np.maximum((part * part).sum(1)[:, None] + (x[c] * x[c]).sum(1)[None, :] - 2 * part @ x[c].T, 0))
            slack = 1e-6 * (1 + apart)  # rounding of the matrix product
            a, b = np.nonzero(apart - far[c][None, :] - slack <= far[q[i : i + 1024]][:, None])
            hits.append((q[i + a], c[b]))
        a, b = (np.concatenate(h) for h in zip(*hits))
        return pa.table({"block": block[b], "asks": t.column("asks").to_numpy()[a], "vec_id": t.column("vec_id").to_numpy()[a]})

    return one.unionByName(two).groupBy("g").applyInArrow(meet, "block long, asks int, vec_id long")


def check(rows: DataFrame, ranked: DataFrame, near: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of all rows no farther than a query's k-th best of ``near``; all rows, if it has fewer."""
    total = rows.where("is_query").count()
    nth = W.partitionBy("query_id").orderBy("score", "vec_id")
    bound = near.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") == k).select(F.col("query_id").alias("qid"), F.col("score").alias("bound"))
    asks = rows.where("is_query").select("vec_id", "v").join(bound, F.col("vec_id") == F.col("qid"), "left")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-total // QUERY_BLOCK)))).cast("int")
    asks = C.cut(asks.select("vec_id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), part.alias("asks")))
    # Blocks are runs of the first ordering, so that they are compact.
    data = ranked.where("curve = 0").select(F.floor(F.col("place") / BLOCK).cast("long").alias("block"), "vec_id", "v")

    def sphere(t: pa.Table) -> pa.Table:
        x = V.matrix(t.column("v"), dim)
        centre = x.mean(0)
        return pa.table({"block": t.column("block")[:1], "centre": V.lists(centre[None]), "radius": [float(np.sqrt(((x - centre) ** 2).sum(1).max()))]})

    blocks = data.groupBy("block").applyInArrow(sphere, "block long, centre array<double>, radius double")
    pairs = C.cut(reachable(asks, blocks, total, dim))
    met = pairs.join(asks.drop("asks"), "vec_id").select("block", "asks", F.lit(1).alias("role"), "vec_id", "v", "bound")
    held = pairs.select("block", "asks").distinct().join(data, "block").select("block", "asks", F.lit(0).alias("role"), "vec_id", "v", F.lit(0.0).alias("bound"))

    def best(t: pa.Table) -> pa.Table:
        q_ids, q, x_ids, x, role = _split(t, dim)
        if not len(q_ids) or not len(x_ids):
            return _found([])
        bounds = t.column("bound").to_numpy()[role == 1]
        return _found([_best(q_ids[i : i + 256], q[i : i + 256], x_ids, x, k, bounds[i : i + 256]) for i in range(0, len(q_ids), 256)])

    return met.unionByName(held).groupBy("block", "asks").applyInArrow(best, _FOUND)


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", n_curves: int = CURVES, tile: int = TILE, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found of each query, by Euclidean distance.

    Nearest first, ties to the smaller id; all rows, if there are fewer than k.
    What the curves find is nearest among the rows met; with ``exact`` a check over
    all rows follows.  Vectors that are null, empty, zero, of an odd length or hold
    null or non-finite components take no part, nor do rows without id.  Equal rows
    count once; a query never meets a row with its own id.
    """
    rows, dim = _prepare(vectors, is_query, id_col, vector_col)
    if not dim:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranked, near = _curve_stage(rows, dim, k, n_curves, tile)
    found = near.union(check(rows, ranked, near, dim, k)).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")) if exact else near
    nth = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
