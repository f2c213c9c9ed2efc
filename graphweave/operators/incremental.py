"""Changes of files, and what they change in a stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .graph import PropertyGraph, with_both_ends


def changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(filePath, change) of files that are new, changed (time, size or hash) or deleted; columns filePath, mtime, size, contentHash."""
    a = stored.select("filePath", F.coalesce("mtime", F.lit(0)).alias("m0"), F.coalesce("size", F.lit(0)).alias("s0"), F.coalesce("contentHash", F.lit("")).alias("h0"), F.lit(True).alias("was"))
    b = current.select("filePath", F.col("mtime").alias("m1"), F.col("size").alias("s1"), F.col("contentHash").alias("h1"), F.lit(True).alias("is_now"))
    both = a.join(b, "filePath", "full_outer")
    differs = (F.col("m0") != F.col("m1")) | (F.col("s0") != F.col("s1")) | (F.col("h0") != F.col("h1"))
    kind = F.when(F.col("was").isNull(), "new").when(F.col("is_now").isNull(), "deleted").when(differs, "changed")
    return both.select("filePath", kind.alias("change")).where("change is not null")


def cross_file_edges(g: PropertyGraph, files: DataFrame) -> DataFrame:
    """Edges between a node of the given files (column filePath) and one of others, in either direction."""
    inside = cut(g.nodes.join(files.select("filePath").distinct(), "filePath", "left_semi").select(F.col("id").alias("n")))
    a = g.edges.join(inside, g.edges.src == inside.n, "left_semi").join(inside, g.edges.dst == inside.n, "left_anti")
    b = g.edges.join(inside, g.edges.dst == inside.n, "left_semi").join(inside, g.edges.src == inside.n, "left_anti")
    return a.unionByName(b).distinct()


def without_files(g: PropertyGraph, files: DataFrame) -> PropertyGraph:
    """The graph without the nodes of some files and the edges at them."""
    gone = cut(g.nodes.join(files.select("filePath").distinct(), "filePath", "left_semi").select(F.col("id").alias("n")))
    nodes = g.nodes.join(files.select("filePath").distinct(), "filePath", "left_anti")
    edges = g.edges.join(gone, g.edges.src == gone.n, "left_anti").join(gone, g.edges.dst == gone.n, "left_anti")
    return PropertyGraph(nodes, edges)


def known_nodes(g: PropertyGraph, files: DataFrame) -> DataFrame:
    """What edges of changed files may point to: nodes of other files, without their text."""
    slim = [c for c in ("id", "name", "coreType", "semanticType", "filePath", "labels") if c in g.nodes.columns]
    return g.nodes.join(files.select("filePath").distinct(), "filePath", "left_anti").select(*slim)


def recreated(saved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Saved edges both of whose ends exist again."""
    return with_both_ends(saved, nodes)


def apply(g: PropertyGraph, changed: DataFrame, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    """The graph after its changed files were parsed again into ``nodes`` and ``edges``.

    Edges over file borders come back if their ends do; found both ways, an edge
    counts once, by its id.  ``edges`` hold no edge between untouched nodes.
    """
    saved = cut(cross_file_edges(g, changed))
    rest = without_files(g, changed)
    all_nodes = rest.nodes.unionByName(nodes, allowMissingColumns=True)
    # Only what comes in is checked: edges between untouched nodes keep their ends.
    added = edges.unionByName(saved, allowMissingColumns=True).dropDuplicates(["edge_id"])
    fresh = cut(recreated(added, all_nodes))
    return PropertyGraph(all_nodes, rest.edges.unionByName(fresh, allowMissingColumns=True))


def upsert(stored: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """The latest row of each key; a new one wins ties."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "_new")]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), F.col("_new"))).alias("x")).select(*key, "x.*")


def project_status(projects: DataFrame, project: str, status: str, now, nodes: int | None = None, edges: int | None = None) -> DataFrame:
    """``projects`` with a new status, and counts where given; unknown projects change nothing."""
    hit = F.col("projectId") == project
    out = projects.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status"))).withColumn("updatedAt", F.when(hit, F.lit(now)).otherwise(F.col("updatedAt")))
    for name, n in (("nodeCount", nodes), ("edgeCount", edges)):
        if n is not None:
            out = out.withColumn(name, F.when(hit, F.lit(n).cast("long")).otherwise(F.col(name)))
    return out


def projects_by_age(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.col("updatedAt").desc(), "projectId")
