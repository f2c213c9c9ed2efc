"""What depends on a node, directly and over paths, and how risky a change is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import NO_WEIGHT, PropertyGraph, paths, with_both_ends

# Weights of relationship types in impact scores; they differ from those of traversal.
WEIGHTS = {
    "EXTENDS": 0.95, "IMPLEMENTS": 0.95, "CALLS": 0.75, "HAS_MEMBER": 0.65, "TYPED_AS": 0.6, "IMPORTS": 0.5,
    "EXPORTS": 0.5, "DECORATED_WITH": 0.4, "CONTAINS": 0.3, "HAS_PARAMETER": 0.3,
}


def direct(g: PropertyGraph, targets: DataFrame) -> DataFrame:
    """(target, id, type, weight, name, coreType, semanticType, filePath), distinct by the first four.

    Every edge into the target counts, containment and the same file included.
    """
    want = targets.select(F.col("id").alias("target"))
    met = g.edges.join(want, F.col("dst") == F.col("target")).where(F.col("src") != F.col("target"))
    rows = met.select("target", F.col("src").alias("id"), "type", F.coalesce("relationshipWeight", F.lit(NO_WEIGHT)).alias("weight")).distinct()
    return rows.join(g.nodes.select("id", "name", "coreType", "semanticType", "filePath"), "id")


def transitive(g: PropertyGraph, targets: DataFrame, max_depth: int = 4, types=None) -> DataFrame:
    """(target, id, depth, path_types, relationship), distinct: dependents over paths of 2 to ``max_depth`` edges (held at 6).

    All nodes of a path belong to the graph.  A cycle makes the target its own
    dependent.  ``relationship`` is the dependent's own first step.
    """
    edges = with_both_ends(g.edges, g.nodes)
    found = paths(edges, targets, max(1, min(6, max_depth)), "INCOMING", types, least=2)
    if found is None:
        found = paths(edges, targets, 1, "INCOMING", types).where(F.lit(False))
    rows = found.select(F.col("start").alias("target"), "id", "depth", F.reverse("path_types").alias("path_types")).distinct()
    return rows.withColumn("relationship", F.get("path_types", F.lit(0)))


def beyond_direct(found: DataFrame, direct_rows: DataFrame) -> DataFrame:
    """Transitive rows of nodes that are not direct dependents of the same target."""
    return found.join(direct_rows.select("target", "id").distinct(), ["target", "id"], "left_anti")


def weight_of(types_col="type", fallback="weight", overrides: dict | None = None):
    pairs = [x for k, v in (WEIGHTS | (overrides or {})).items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(types_col)), F.col(fallback))


def risk(targets: DataFrame, direct_rows: DataFrame, transitive_rows: DataFrame, high_risk: list[str] = (), overrides: dict | None = None) -> DataFrame:
    """(target, n_direct, n_transitive, score, level), a row per target; without dependents the score is 0."""
    high = F.col("semanticType").isin(list(high_risk)) | F.col("coreType").isin(list(high_risk)) if high_risk else F.lit(False)
    d = direct_rows.groupBy("target").agg(F.count("*").alias("d"), F.avg(weight_of(overrides=overrides)).alias("w"), F.count_if(F.coalesce(high, F.lit(False))).alias("h"))
    t = transitive_rows.groupBy("target").agg(F.count("*").alias("t"))
    rows = targets.select(F.col("id").alias("target")).join(d, "target", "left").join(t, "target", "left").na.fill(0, ["d", "t", "h"])
    of_high = F.lit(0.0) if not high_risk else F.least(F.col("h") / F.lit(float(max(len(high_risk), 3))), F.lit(1.0)) * 0.2
    score = F.least(F.log10(F.col("d") + F.lit(1.0)) / 2, F.lit(0.3)) + F.col("w") * 0.3 + of_high + F.least(F.log10(F.col("t") + F.lit(1.0)) / 3, F.lit(0.2))
    score = F.when(F.col("d") == 0, F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))
    return rows.withColumn("score", score).select("target", F.col("d").alias("n_direct"), F.col("t").alias("n_transitive"), "score", risk_level(F.col("score")).alias("level"))


def risk_level(score):
    return F.when(score >= 0.75, "CRITICAL").when(score >= 0.5, "HIGH").when(score >= 0.25, "MEDIUM").otherwise("LOW")


def critical_paths(direct_rows: DataFrame, overrides: dict | None = None, least: float = 0.6, most: int = 10, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """(target, id, type, line): strong direct dependents, the first ``most`` of each target; a type without a weight counts 0.5 here.

    Without ``by`` all rows are those of one analysis, as of a file.
    """
    w = F.coalesce(weight_of(fallback="_none", overrides=overrides), F.lit(NO_WEIGHT))
    rows = direct_rows.withColumn("_none", F.lit(None).cast("double")).withColumn("w", w).where(F.col("w") >= least)
    line = F.concat("name", F.lit(" -["), "type", F.lit("]-> target"))
    rows = rows.select("target", "id", "type", line.alias("line"))
    if not by:
        return rows.orderBy("target", "id", "type").limit(most)
    nth = F.row_number().over(W.partitionBy(*by).orderBy("target", "id", "type"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth").orderBy("target", "id", "type")


def file_targets(nodes: DataFrame, file_path: str, core_types=("ClassDeclaration", "FunctionDeclaration", "InterfaceDeclaration")) -> DataFrame:
    """Entities of the files whose path ends so; order, which decides the first, is by line and id."""
    at_end = F.col("filePath").endswith(file_path) | (F.col("filePath") == file_path)
    return nodes.where(at_end & F.col("coreType").isin(list(core_types))).orderBy("startLine", "id")


def of_file(direct_rows: DataFrame) -> DataFrame:
    """Direct rows of several entities of one file, one per dependent: that of the highest weight."""
    best = F.max_by(F.struct("target", "type", "weight", "name", "coreType", "semanticType", "filePath"), F.struct("weight", "type", "target")).alias("x")
    return direct_rows.groupBy("id").agg(best).select("id", "x.*")


def outside_file(direct_rows: DataFrame, target_nodes: DataFrame) -> DataFrame:
    """Direct rows from other files than the target's."""
    own = target_nodes.select(F.col("id").alias("target"), F.col("filePath").alias("own"))
    return direct_rows.join(own, "target").where(F.col("filePath") != F.col("own")).drop("own")


def by_type(direct_rows: DataFrame) -> DataFrame:
    return direct_rows.groupBy("target", F.coalesce("semanticType", "coreType").alias("kind")).agg(F.count("*").alias("n"))


def by_relationship(direct_rows: DataFrame) -> DataFrame:
    return direct_rows.groupBy("target", "type").agg(F.count("*").alias("n"))


def affected_files(direct_rows: DataFrame) -> DataFrame:
    return direct_rows.groupBy("target").agg(F.array_sort(F.collect_set("filePath")).alias("files"), F.countDistinct("filePath").alias("n_files"))
