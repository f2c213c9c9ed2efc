"""A property graph as two DataFrames, its scans, discovery and traversals.

Operators push type filters into every hop, keep traversal state in arrays of
edge ids, and leave the choice of join to the optimizer.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..storage import cut, numbered

MAX_DEPTH = 5
DECAY, NO_WEIGHT = 0.85, 0.5

# Traversal weights of the core relationship types.
EDGE_WEIGHTS = {
    "CONTAINS": 0.4, "HAS_MEMBER": 0.6, "HAS_PARAMETER": 0.35, "DECORATED_WITH": 0.3, "IMPORTS": 0.55,
    "EXPORTS": 0.5, "EXTENDS": 0.85, "IMPLEMENTS": 0.75, "TYPED_AS": 0.5, "CALLS": 0.85,
}


@dataclass
class PropertyGraph:
    """nodes(id, projectId, name, coreType, semanticType, labels, filePath, ...), edges(edge_id, type, src, dst, projectId, relationshipWeight, ...)."""

    nodes: DataFrame
    edges: DataFrame

    def of_project(self, project: str) -> PropertyGraph:
        """Nodes of a project, and the edges with both ends in it."""
        nodes = self.nodes.where(F.col("projectId") == project)
        return PropertyGraph(nodes, with_both_ends(self.edges.where(F.col("projectId") == project), nodes))

    def with_label(self, label: str) -> DataFrame:
        return self.nodes.where(F.array_contains("labels", label))


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist; the others are dropped silently."""
    ids = nodes.select(F.col("id").alias("_id"))
    return edges.join(ids, edges.src == F.col("_id"), "left_semi").join(ids, edges.dst == F.col("_id"), "left_semi")


def display_type(nodes_have="semanticType"):
    """What a node is shown as: its semantic type, else its last label."""
    return F.coalesce(F.col(nodes_have), F.try_element_at("labels", F.lit(-1)), F.lit("Unknown"))


# ---------------------------------------------------------------- discovery


def count_by_label(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.get("labels", F.lit(0)).alias("label")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label")


def node_types(nodes: DataFrame, sample: int | None = 10) -> DataFrame:
    """(label, n, properties): node count and the non-null property keys of up to ``sample`` nodes a label (None: of all)."""
    keys = [c for c in nodes.columns if c != "labels"]
    flat = nodes.select(F.explode("labels").alias("label"), F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in keys])).alias("keys"), "id")
    total = flat.groupBy("label").agg(F.count("*").alias("n"))
    some = flat if sample is None else flat.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy("id"))).where(F.col("k") <= sample)
    found = some.groupBy("label").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))).alias("properties"))
    return total.join(found, "label")


def relationship_types(g: PropertyGraph) -> DataFrame:
    """(type, n, connections): edge count and the distinct pairs of node types that each type connects."""
    label = F.get("labels", F.lit(0))
    a = g.nodes.select(F.col("id").alias("src"), label.alias("from_label"))
    b = g.nodes.select(F.col("id").alias("dst"), label.alias("to_label"))
    met = g.edges.join(a, "src").join(b, "dst").groupBy("type", "from_label", "to_label").agg(F.count("*").alias("n"))
    return met.groupBy("type").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set(F.concat_ws("->", "from_label", "to_label"))).alias("connections"))


def semantic_types(nodes: DataFrame) -> DataFrame:
    return nodes.where("semanticType is not null").groupBy("semanticType", F.get("labels", F.lit(0)).alias("label")).agg(F.count("*").alias("n"))


def common_patterns(g: PropertyGraph, above: int = 2, most: int = 50) -> DataFrame:
    label = F.get("labels", F.lit(0))
    a = g.nodes.select(F.col("id").alias("src"), label.alias("from_label"))
    b = g.nodes.select(F.col("id").alias("dst"), label.alias("to_label"))
    n = g.edges.join(a, "src").join(b, "dst").groupBy("from_label", "type", "to_label").agg(F.count("*").alias("n"))
    return n.where(F.col("n") > above).orderBy(F.col("n").desc(), "from_label", "type", "to_label").limit(most)


# ---------------------------------------------------------------- traversal


def valid_types(types) -> list[str] | None:
    """Type names of capitals and underscores; None, which filters nothing, if none is left."""
    return [t for t in types or [] if re.fullmatch(r"[A-Z_]+", t)] or None


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b, edge_id, type, weight): edges as steps from a to b."""
    step = lambda a, b: edges.select(F.col(a).alias("a"), F.col(b).alias("b"), "edge_id", "type", F.col("relationshipWeight").alias("weight"))
    if direction == "OUTGOING":
        return step("src", "dst")
    if direction == "INCOMING":
        return step("dst", "src")
    if direction != "BOTH":
        raise ValueError(direction)
    return step("src", "dst").unionByName(step("dst", "src"))


def neighbours(g: PropertyGraph, start: DataFrame, direction: str = "BOTH") -> DataFrame:
    """(start, id, type, edge_id): one hop from the ids of ``start``."""
    met = start.select(F.col("id").alias("start")).join(oriented(g.edges, direction), F.col("start") == F.col("a"))
    return met.join(g.nodes.select(F.col("id").alias("b")), "b", "left_semi").select("start", F.col("b").alias("id"), "type", "edge_id")


def paths(edges: DataFrame, start: DataFrame, depth: int, direction: str = "BOTH", types=None, least: int = 1) -> DataFrame:
    """(start, id, depth, path_types, path_edges): a row per path of ``least`` to ``depth`` edges, none used twice.

    Nodes may recur.  The state of every level is written to the shared folder,
    so that deeper levels don't compute it again.
    """
    types = valid_types(types)
    steps = oriented(edges if types is None else edges.where(F.col("type").isin(types)), direction)
    empty = F.array().cast("array<string>")
    level = start.select(F.col("id").alias("start"), "id", empty.alias("path_types"), empty.alias("path_edges"))
    found = None
    for d in range(1, depth + 1):
        met = level.join(steps, level.id == steps.a).where(~F.array_contains("path_edges", F.col("edge_id")))
        level = met.select("start", F.col("b").alias("id"), F.concat("path_types", F.array("type")).alias("path_types"), F.concat("path_edges", F.array("edge_id")).alias("path_edges"))
        if d < depth:
            level = cut(level)
        if d >= least:
            row = level.select("start", "id", F.lit(d).alias("depth"), "path_types", "path_edges")
            found = row if found is None else found.unionByName(row)
    return found


def traverse(g: PropertyGraph, start_id: str, depth: int = 3, direction: str = "BOTH", types=None, skip: int = 0) -> DataFrame:
    """Exhaustive traversal: a row per path to another node of the graph; depth is held between 1 and MAX_DEPTH.

    Nodes on the way need not belong to the graph's nodes, only the last one.
    Rows are numbered by depth, node and path, and the first ``skip`` left out.
    """
    depth = max(1, min(MAX_DEPTH, depth))
    start = g.nodes.where(F.col("id") == start_id).select("id")
    found = paths(g.edges, start, depth, direction, types).where(F.col("id") != start_id)
    rows = found.join(g.nodes.select("id", "name", "coreType", "semanticType", "filePath", "labels"), "id")
    if skip:
        rows = rows.withColumn("_path", F.concat_ws("/", "path_edges"))
        rows = numbered(rows, ["depth", "id", "_path"], "_k").where(F.col("_k") >= skip).drop("_k", "_path")
    return rows


def beam(g: PropertyGraph, start_id: str, depth: int = 3, direction: str = "BOTH", per_chain: int = 5, query: list[float] | None = None, types=None, scale: str = "unit") -> DataFrame:
    """(depth, id, score, from_id, type, edge_id): the weighted traversal.

    Every level keeps the ceil(1.5 * per_chain) best steps to nodes not yet
    visited, by edge weight, similarity to ``query`` and decay by depth; ties go
    to the smaller node, then edge.  A node reached by several kept steps counts
    once, by its best.  ``types`` is a filter the original lacks, off by default.
    Levels are at most that wide, so their ids go into the next scan as literals,
    which reach the files as pushed filters.
    """
    width = math.ceil(1.5 * per_chain)
    spark = g.nodes.sparkSession
    schema = "depth int, id string, score double, from_id string, type string, edge_id string"
    types = valid_types(types)
    steps = oriented(g.edges if types is None else g.edges.where(F.col("type").isin(types)), direction)
    similar = F.lit(NO_WEIGHT)
    if query is not None and "embedding" in g.nodes.columns:
        similar = F.coalesce(vectors.similarity(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]), scale), similar)
    known = g.nodes.select(F.col("id").alias("b"), similar.alias("similar"))
    visited, frontier, out = {start_id}, [start_id], []
    for d in range(1, depth + 1):
        met = steps.where(F.col("a").isin(frontier) & ~F.col("b").isin(sorted(visited))).join(known, "b")
        score = F.coalesce("weight", F.lit(NO_WEIGHT)) * F.col("similar") * F.lit(DECAY ** (d - 1))
        best = met.withColumn("score", score).orderBy(F.col("score").desc(), "b", "edge_id").limit(width)
        frontier = []
        for r in best.select("a", "b", "type", "edge_id", "score").collect():  # at most ``width`` rows
            if r.b not in visited:
                visited.add(r.b)
                frontier.append(r.b)
                out.append((d, r.b, r.score, r.a, r.type, r.edge_id))
        if not frontier:
            break
    return spark.createDataFrame(out, schema)


def depth_summary(found: DataFrame, per_chain: int = 5) -> DataFrame:
    """(depth, n, chains, has_more): rows of each depth and its first chains, by node and path."""
    order = W.partitionBy("depth").orderBy("id", F.concat_ws("/", "path_edges"))
    rows = found.withColumn("k", F.row_number().over(order))
    chain = F.when(F.col("k") <= per_chain, F.struct("k", F.concat(F.concat_ws(">", "path_types"), F.lit(":"), "id").alias("c")))
    return rows.groupBy("depth").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(chain)), lambda x: x.c).alias("chains"), (F.count("*") > per_chain).alias("has_more"))


def file_summary(found: DataFrame, most: int = 30) -> DataFrame:
    """(filePath, n): distinct nodes of each file, the largest first."""
    return found.groupBy("filePath").agg(F.countDistinct("id").alias("n")).orderBy(F.col("n").desc(), "filePath").limit(most)


def response(found: DataFrame, most: int = 50) -> DataFrame:
    """One row: totals, and whether rows exceed ``most``, the cap on distinct nodes shown."""
    return found.agg(
        F.count("*").alias("total_connections"), F.countDistinct("id").alias("distinct_nodes"), F.least(F.countDistinct("id"), F.lit(most)).alias("nodes_shown"),
        (F.count("*") > most).alias("truncated"), F.countDistinct("filePath").alias("unique_files"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
    )


def shown_nodes(found: DataFrame, most: int = 50, code: bool = False, snippet: int = 500) -> DataFrame:
    """(id, name, type, filePath, depth[, sourceCode]): the distinct nodes of an answer in order of depth and path, ``most`` of them."""
    first = F.min(F.struct("depth", F.concat_ws("/", "path_edges").alias("p")))
    cols = ["name", "filePath", display_type().alias("type"), *(["sourceCode"] if code and "sourceCode" in found.columns else [])]
    rows = found.select("id", "depth", "path_edges", *cols)
    rest = [c for c in rows.columns if c not in ("id", "depth", "path_edges")]
    one = rows.groupBy("id").agg(first.alias("at"), F.any_value(F.struct(*rest)).alias("x")).orderBy("at", "id").limit(most)
    out = one.select("id", "x.*", F.col("at.depth").alias("depth"))
    return out.withColumn("sourceCode", F.substring("sourceCode", 1, snippet)) if "sourceCode" in out.columns else out


def shown_edges(found: DataFrame) -> DataFrame:
    """(depth, type, direction of travel by its last edge, id): what an answer's nodes were reached by, distinct."""
    return found.select("depth", F.element_at("path_types", -1).alias("type"), F.element_at("path_edges", -1).alias("edge_id"), "id").distinct()


def common_root(found: DataFrame) -> DataFrame:
    """One row (projectRoot): the folders that all files of an answer share.

    The smallest and the largest path share what all of them share.
    """
    ends = found.where("filePath is not null").agg(F.array(F.min("filePath"), F.max("filePath")).alias("p"))
    return ends.select(F.when(F.get("p", F.lit(0)).isNotNull(), text.common_root(F.col("p"))).alias("projectRoot"))


#: Fixed value: an answer with more characters is given as its summary.
MOST_CHARACTERS = 50_000


def answer(found: DataFrame, per_chain: int = 5, most: int = 50, summary_only: bool = False, characters: int = MOST_CHARACTERS, code: bool = False) -> dict[str, DataFrame]:
    """What a traversal returns: totals, nodes, chains by depth; or, above ``characters`` of JSON, totals and files instead.

    ``most`` and ``per_chain`` bound nodes and chains; the size is measured, not the rows fetched.
    """
    totals = response(found, most)
    summary = {"totals": totals, "depths": depth_summary(found, per_chain).drop("chains"), "files": file_summary(found)}
    if summary_only:
        return summary
    full = {"totals": totals, "nodes": shown_nodes(found, most, code), "edges": shown_edges(found), "depths": depth_summary(found, per_chain), "root": common_root(found)}
    size = sum(df.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()[0] for k, df in full.items() if k != "edges")
    if size <= characters:
        return full
    spark = found.sparkSession
    return summary | {"note": spark.createDataFrame([(True, int(size))], "autoSummarized boolean, originalSize long")}


def find_start(nodes: DataFrame, file_path: str) -> DataFrame:
    """The source file of a path; without an exact match, up to five whose path ends so or that have this name.

    More than one row means that the path is ambiguous.
    """
    files = nodes.where(F.array_contains("labels", "SourceFile"))
    exact = (F.col("filePath") == file_path).cast("int")
    near = F.col("filePath").endswith(file_path) | (F.col("name") == file_path)
    hits = files.where((exact == 1) | near).withColumn("_exact", exact)
    best = hits.withColumn("_any", F.max("_exact").over(W.partitionBy()))
    return best.where(F.col("_exact") == F.col("_any")).orderBy("filePath", "id").limit(5).drop("_exact", "_any")
