"""Duplicate code: equal normalised hashes, and similar embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import cut, sweep

# What each scope compares.
SCOPES = {"methods": ["MethodDeclaration"], "functions": ["FunctionDeclaration"], "classes": ["ClassDeclaration"], "all": ["MethodDeclaration", "FunctionDeclaration", "ClassDeclaration"]}


def structural_items(nodes: DataFrame, scope: str | list[str] = "all", limit: int | None = None) -> DataFrame:
    """Nodes whose normalisedHash another one shares, in order of hash, file, line and id.

    ``limit`` cuts rows, as the original does, and so may split the last group.
    """
    types = SCOPES[scope] if isinstance(scope, str) else scope
    rows = nodes.where(F.col("coreType").isin(types) & (F.length("normalizedHash") > 0))
    shared = rows.groupBy("normalizedHash").agg(F.count("*").alias("group_size")).where("group_size >= 2")
    rows = rows.join(shared, "normalizedHash")
    return rows if limit is None else rows.orderBy("normalizedHash", "filePath", "startLine", "id").limit(limit)


def advice(kind: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row per group: items, names, category and recommendation."""
    app = T.app_name(F.col("filePath"))
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n_items"), F.countDistinct("filePath").alias("n_files"), F.array_sort(F.collect_set("name")).alias("names"),
        F.every(T.is_ui_component(F.col("filePath"))).alias("all_ui"), F.array_sort(F.collect_set(app)).alias("apps"), F.min("id").alias("first_id"),
    )
    category = F.when(F.col("all_ui"), "ui-component").when(F.size("apps") > 1, "cross-app").when(F.col("n_files") == 1, "same-file").otherwise("cross-file")
    names, apps = F.concat_ws(", ", F.slice("names", 1, 3)), F.concat_ws(", ", F.slice("apps", 1, 3))
    same = F.concat(F.lit("Move what "), names, F.lit(" share into one method")) if kind == "structural" else F.concat(F.lit("See whether "), names, F.lit(" can be one"))
    cross = F.concat(F.lit("Move "), names, F.lit(" into a shared function")) if kind == "structural" else F.concat(F.lit("Let "), names, F.lit(" take one approach"))
    told = F.when(F.col("category") == "ui-component", F.concat(F.lit("UI components "), names, F.lit(" look alike, probably on purpose")))
    told = told.when(F.col("category") == "cross-app", F.concat(F.lit("Duplicated across apps ("), apps, F.lit("): consider a shared package")))
    told = told.when(F.col("category") == "same-file", same).otherwise(cross)
    return g.withColumn("category", category).withColumn("recommendation", told).drop("all_ui")


def structural_groups(items: DataFrame) -> DataFrame:
    """Groups of at least two items, after any cut of rows; similarity 1, confidence HIGH."""
    g = advice("structural", items, ["normalizedHash"]).where("n_items >= 2")
    return g.select(F.lit("structural").alias("type"), "normalizedHash", F.lit(1.0).alias("similarity"), F.lit("HIGH").alias("confidence"), "category", "n_items", "n_files", "names", "recommendation")


def semantic_confidence(similarity, items=2):
    return F.when((similarity >= 0.9) & (F.lit(items) >= 2), "HIGH").when(similarity >= 0.85, "MEDIUM").otherwise("LOW")


def _unit(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def near_blocks(rows: DataFrame, dim: int, reach: float, block: int, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows with their block b, pairs (i, j) of blocks that can hold rows no farther than ``reach``).

    A block is a cell of random hyperplanes, cut by hash where it is too large;
    its centre and radius tell what it can reach.  Pairs of blocks are looked at
    in tasks, some blocks against all; rows follow only where a pair survives.
    """
    total = rows.count()
    bits = max(0, int(np.ceil(np.log2(max(total, 1) / block))))
    planes = np.random.default_rng(seed).normal(size=(dim, bits))

    def cell(batches):
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            code = ((x @ planes > 0) << np.arange(bits)).sum(1) if bits else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(np.int64))], names=[*batch.schema.names, "cell"])

    rows = cut(rows.select("id", "v").mapInArrow(cell, "id string, v array<double>, cell long"))
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
    rows = rows.join(parts, "cell").withColumn("b", F.xxhash64("cell", F.pmod(F.xxhash64("id"), F.col("parts")))).drop("cell", "parts")
    rows = cut(rows)

    def sphere(t: pa.Table) -> pa.Table:
        x = _unit(t.column("v"), dim)
        centre = x.mean(0)
        return pa.table({"b": t.column("b")[:1], "centre": pa.array([centre.tolist()]), "radius": [float(np.sqrt(((x - centre) ** 2).sum(1).max()))]})

    blocks = cut(rows.select("b", "v").groupBy("b").applyInArrow(sphere, "b long, centre array<double>, radius double"))
    groups = max(1, -(-blocks.count() // 1024))
    one = blocks.select(F.pmod("b", F.lit(groups)).alias("g"), F.lit(0).alias("side"), "b", "centre", "radius")
    two = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(1).alias("side"), "b", "centre", "radius")

    def meet(t: pa.Table) -> pa.Table:
        side, b, c, r = t.column("side").to_numpy(), t.column("b").to_numpy(), _unit(t.column("centre"), dim), t.column("radius").to_numpy()
        p, q, out = np.flatnonzero(side == 0), np.flatnonzero(side == 1), []
        for i in p:
            apart = np.sqrt(((c[q] - c[i]) ** 2).sum(1)) - r[q] - r[i]
            out.append(np.stack([np.full((apart <= reach + 1e-9).sum(), b[i]), b[q[apart <= reach + 1e-9]]]))
        i, j = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64())})

    return rows, cut(one.unionByName(two).groupBy("g").applyInArrow(meet, "i long, j long"))


#: Copies of vectors that pairs of blocks make at a time, about, and rows of a group of small blocks.
COPIES, GROUP = 3_000_000, 1024


def similar_pairs(nodes: DataFrame, least: float = 0.8, neighbours: int = 50, limit: int | None = None, scale: str = "unit", group_cols=("coreType",), block: int = 1024) -> DataFrame:
    """(id1, id2, similarity): of each node's ``neighbours`` nearest, the similar ones of its kind, from another file and with another hash.

    Nearest are taken among all vectors, before any filter, in exact arithmetic:
    vectors lie in compact blocks, and each pair of blocks that can hold similar
    ones is one matrix product, whose best rows a node are merged.  ``least``
    prunes blocks and rows, which can't change the result.  Where it hardly prunes,
    small blocks meet in groups.  Pairs go in rounds, each with all pairs of its
    blocks i, so that a node's nearest come from one round and copies of vectors,
    a share at a time, take bounded room on disk.
    """
    rows = nodes.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("v"), "filePath", "normalizedHash", F.concat_ws("|", *group_cols).alias("kind"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    some = rows.withColumn("size", size).where("size > 0").select("id", F.transform("v", lambda x: x / F.col("size")).alias("v"))
    dim = (some.agg(F.max(F.size("v"))).first()[0]) or 0
    if not dim:
        none = F.lit(None).cast("string")
        return rows.limit(0).select(F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(0.0).alias("similarity"), none.alias("file1"), none.alias("file2"))
    cosine = 2 * least - 1 if scale == "unit" else least
    some, pairs = near_blocks(some.where(F.size("v") == dim), dim, float(np.sqrt(max(0.0, 2 - 2 * cosine))), block)
    total, blocks, met = some.count(), some.select("b").distinct().count(), pairs.count()
    if 2 * met > blocks * blocks and 2 * total < GROUP * blocks:
        groups = F.lit(max(1, total // GROUP))
        some = some.withColumn("b", F.pmod("b", groups))
        pairs = cut(pairs.select(F.pmod("i", groups).alias("i"), F.pmod("j", groups).alias("j")).distinct())
        blocks, met = some.select("b").distinct().count(), pairs.count()
    rounds = max(1, min(blocks, -(-2 * met * total // (max(blocks, 1) * COPIES))))

    def best(t: pa.Table) -> pa.Table:
        side, ids, x = t.column("side").to_numpy(), np.array(t.column("id").to_pylist(), object), _unit(t.column("v"), dim)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        s = x[a] @ x[b].T
        s = (1 + s) / 2 if scale == "unit" else s
        s[ids[a][:, None] == ids[b][None, :]] = -9
        ok = s >= least
        if s.shape[1] > neighbours:
            ok &= s >= np.partition(s, -neighbours, axis=1)[:, -neighbours][:, None]
        p, q = np.nonzero(ok)
        return pa.table({"id1": pa.array(list(ids[a][p]), pa.string()), "id2": pa.array(list(ids[b][q]), pa.string()), "similarity": s[p, q]})

    nth = W.partitionBy("id1").orderBy(F.col("similarity").desc(), "id2")
    near = None
    for k in range(rounds):
        own = pairs.where(F.pmod(F.xxhash64("i"), F.lit(rounds)) == k)
        left = own.join(some, F.col("i") == F.col("b")).select("i", "j", F.lit(0).alias("side"), "id", "v")
        right = own.join(some, F.col("j") == F.col("b")).select("i", "j", F.lit(1).alias("side"), "id", "v")
        found = left.unionByName(right).groupBy("i", "j").applyInArrow(best, "id1 string, id2 string, similarity double")
        part = found.withColumn("k", F.row_number().over(nth)).where(F.col("k") <= neighbours).where("id1 < id2").drop("k")
        if rounds > 1:
            part = cut(part)
            sweep(nodes.sparkSession)
        near = part if near is None else near.unionByName(part)
    a, b = (rows.select(F.col("id").alias(f"id{i}"), F.col("filePath").alias(f"file{i}"), F.col("normalizedHash").alias(f"hash{i}"), F.col("kind").alias(f"kind{i}")) for i in (1, 2))
    met = near.join(a, "id1").join(b, "id2").where("kind1 = kind2 and file1 != file2 and (hash1 is null or hash2 is null or hash1 != hash2)")
    met = met.select("id1", "id2", "similarity", "file1", "file2")
    return met if limit is None else met.orderBy(F.col("similarity").desc(), "id1", "id2").limit(limit)


def greedy_pairs(pairs: DataFrame, structural: DataFrame | None = None) -> DataFrame:
    """Pairs by falling similarity whose nodes no earlier pair has used, ties by id.

    A pair that is the first one left at both its nodes would be chosen whatever
    comes before it, so all such pairs are chosen at once; rounds go on until none
    is left.  Pairs that share a structural group don't count.
    """
    rows = pairs.where("file1 != file2")
    if structural is not None:
        h = structural.select(F.col("id"), F.col("normalizedHash"))
        a, b = h.select(F.col("id").alias("id1"), F.col("normalizedHash").alias("h1")), h.select(F.col("id").alias("id2"), F.col("normalizedHash").alias("h2"))
        rows = rows.join(a, "id1", "left").join(b, "id2", "left").where("h1 is null or h2 is null or h1 != h2").drop("h1", "h2")
    rest, chosen = cut(rows.dropDuplicates(["id1", "id2"])), None
    place = F.struct((-F.col("similarity")).alias("s"), F.col("id1").alias("a"), F.col("id2").alias("b"))
    while not rest.isEmpty():
        ends = rest.select(F.explode(F.array("id1", "id2")).alias("x"), place.alias("p"))
        first = ends.groupBy("x").agg(F.min("p").alias("p"))
        both = first.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select(F.col("p.a").alias("id1"), F.col("p.b").alias("id2"))
        taken = cut(rest.join(both, ["id1", "id2"], "left_semi"))
        used = taken.select(F.explode(F.array("id1", "id2")).alias("x"))
        rest = cut(rest.join(used, F.col("id1") == F.col("x"), "left_anti").join(used, F.col("id2") == F.col("x"), "left_anti"))
        chosen = taken if chosen is None else chosen.unionByName(taken)
    chosen = rest if chosen is None else chosen
    return chosen.withColumn("confidence", semantic_confidence(F.col("similarity"))).withColumn("rounded", F.round("similarity", 3))


def stats(groups: DataFrame) -> DataFrame:
    """(type, groups, items): how much is duplicated, by type of group."""
    return groups.groupBy("type").agg(F.count("*").alias("groups"), F.sum("n_items").alias("items"))
