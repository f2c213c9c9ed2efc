"""Deferred edges: which node an import, a call or a type name means.

Every rule is an equi-join on a key made beforehand; all rules' hits are tagged
with their priority, and the first wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids

# Endings that an import path may lack, in order.
EXTENSIONS = ["", ".ts", ".tsx", "/index.ts", "/index.tsx"]


def _best(hits: DataFrame, key: str = "deferred_id") -> DataFrame:
    k = F.row_number().over(W.partitionBy(key).orderBy("prio", "ext", "seq", "id"))
    return hits.withColumn("_k", k).where("_k = 1").drop("_k")


def resolve_names(deferred: DataFrame, nodes: DataFrame) -> DataFrame:
    """(deferred_id, id, prio): the node of each target name, by rules in order; no rule, no row.

    ``deferred``: deferred_id, targetName, targetType, targetFilePath (may be
    null).  ``nodes``: id, name, coreType, filePath, seq (order of insertion).
    Rules: 1 type, name and file; for source files 2 exact path, 3 path that ends
    so, with endings tried in order, 4 path inside a package "@scope/package/...",
    5 its index file, 6 any of its files; for others 7 type and name.
    """
    d = deferred.select("deferred_id", "targetName", "targetType", "targetFilePath")
    n = nodes.select("id", "name", "coreType", "filePath", "seq")
    hit = lambda df, prio, ext=F.lit(0): df.select("deferred_id", "id", F.lit(prio).alias("prio"), ext.alias("ext"), "seq")
    # One node a key: a name or a path ending that many nodes share must not multiply rows.
    one = lambda df, *by: df.groupBy(*by).agg(F.min(F.struct("seq", "id")).alias("x")).select(*by, "x.*")
    named, placed = one(n, "coreType", "name"), one(n, "coreType", "name", "filePath")
    exact = hit(d.join(placed, (d.targetType == placed.coreType) & (d.targetName == placed.name) & (d.targetFilePath == placed.filePath)), 1)
    by_name = hit(d.where("targetType != 'SourceFile'").join(named, (d.targetType == named.coreType) & (d.targetName == named.name)), 7)
    files = n.where("coreType = 'SourceFile'")
    want = d.where("targetType = 'SourceFile'").withColumn("spec", F.coalesce("targetFilePath", "targetName"))
    at = one(files, "filePath")
    same = hit(want.join(at, want.spec == at.filePath), 2)
    # Every ending of a path after a slash is a key; an import without its leading dots must be one of them.
    parts = F.split("filePath", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    keyed = one(files.select("id", "seq", F.explode(tails).alias("tail")), "tail")
    bare = F.regexp_replace("spec", r"^(\.{1,2}/)+", "")
    endings = F.array(*[F.lit(x) for x in EXTENSIONS])
    relative = want.where(F.col("spec").startswith(".") | F.col("spec").startswith("/")).select("deferred_id", F.posexplode(F.transform(endings, lambda e: F.concat(F.ltrim(bare, F.lit("/")), e))).alias("ext", "tail"))
    suffix = hit(relative.join(keyed, "tail"), 3, F.col("ext"))
    scoped = want.where(F.col("spec").rlike(r"^@[^/]+/[^/]+")).select(
        "deferred_id", F.regexp_extract("spec", r"^@[^/]+/([^/]+)", 1).alias("package"), F.regexp_extract("spec", r"^@[^/]+/[^/]+/(.+)$", 1).alias("sub"))
    subs = scoped.where(F.length("sub") > 0)
    below = F.transform(endings, lambda e: F.concat("package", F.lit("/src/"), "sub", e))
    plain = F.transform(endings, lambda e: F.concat("package", F.lit("/"), "sub", e))
    inside = hit(subs.select("deferred_id", F.posexplode(F.concat(below, plain)).alias("ext", "tail")).join(keyed, "tail"), 4, F.col("ext"))
    root = F.array(F.concat("package", F.lit("/src/index.ts")), F.concat("package", F.lit("/index.ts")))
    index = hit(scoped.select("deferred_id", F.posexplode(root).alias("ext", "tail")).join(keyed, "tail"), 5, F.col("ext"))
    folders = one(files.select("id", "seq", F.explode(F.array_distinct(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))).alias("package")), "package")
    any_file = hit(scoped.join(folders, "package"), 6)
    hits = exact.unionByName(same).unionByName(suffix).unionByName(inside).unionByName(index).unionByName(any_file).unionByName(by_name)
    return _best(hits).select("deferred_id", "id", "prio")


def resolve_calls(deferred: DataFrame, nodes: DataFrame) -> DataFrame:
    """(deferred_id, id, prio): the node that each call means.

    ``deferred``: deferred_id, sourceNodeId, targetName, targetType,
    receiverExpression, receiverType.  ``nodes``: id, name, coreType,
    parentClassName, seq.  Rules: 1 a call on "this" means a method of the
    caller's class, 2 the receiver's type is the class, 3 a constructor by class,
    4 a function by name, 5 type and name.  Among equal names the last written
    wins in 1 to 4, the first in 5.
    """
    d = deferred.select("deferred_id", "sourceNodeId", "targetName", "targetType", "receiverExpression", "receiverType")
    caller = nodes.select(F.col("id").alias("sourceNodeId"), F.col("parentClassName").alias("ownClass"))
    last = lambda df, *by: df.groupBy(*by).agg(F.max_by("id", F.struct("seq", "id")).alias("id"), F.max("seq").alias("seq"))
    methods = last(nodes.where("coreType = 'MethodDeclaration'").select(F.col("parentClassName").alias("cls"), F.col("name").alias("m"), "id", "seq"), "cls", "m")
    functions = last(nodes.where("coreType = 'FunctionDeclaration'").select(F.col("name").alias("m"), "id", "seq"), "m")
    constructors = last(nodes.where("coreType = 'ConstructorDeclaration'").select(F.col("parentClassName").alias("cls"), "id", "seq"), "cls")
    hit = lambda df, prio: df.select("deferred_id", "id", F.lit(prio).alias("prio"), F.lit(0).alias("ext"), "seq")
    own = d.join(caller, "sourceNodeId").where("receiverExpression = 'this'")
    hits = hit(own.join(methods, (F.col("ownClass") == F.col("cls")) & (F.col("targetName") == F.col("m"))), 1)
    hits = hits.unionByName(hit(d.join(methods, (F.col("receiverType") == F.col("cls")) & (F.col("targetName") == F.col("m"))), 2))
    hits = hits.unionByName(hit(d.where("targetType = 'ConstructorDeclaration'").join(constructors, F.col("targetName") == F.col("cls")), 3))
    hits = hits.unionByName(hit(d.where("targetType = 'FunctionDeclaration'").join(functions, F.col("targetName") == F.col("m")), 4))
    by_name = nodes.groupBy(F.col("name").alias("m"), F.col("coreType").alias("t")).agg(F.min(F.struct("seq", "id")).alias("x")).select("m", "t", "x.*")
    hits = hits.unionByName(hit(d.join(by_name, (F.col("targetName") == F.col("m")) & (F.col("targetType") == F.col("t"))), 5))
    return _best(hits).select("deferred_id", "id", "prio")


def property_types(calls: DataFrame, properties: DataFrame) -> DataFrame:
    """(deferred_id, receiverType): the type of a property by its name: names match if one holds the other, without service, repository and provider; the first property wins.

    ``calls``: deferred_id, classId, receiverPropertyName; ``properties``: classId, typeName, pos.
    """

    def bare(c):
        return F.regexp_replace(F.lower(F.col(c)), "service|repository|provider", "")

    met = calls.join(properties, "classId").withColumn("a", bare("receiverPropertyName")).withColumn("b", bare("typeName"))
    met = met.where((F.length("a") > 0) & (F.length("b") > 0) & (F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))))
    return met.groupBy("deferred_id").agg(F.min_by("typeName", "pos").alias("receiverType"))


def call_edges(deferred: DataFrame, resolved: DataFrame) -> DataFrame:
    """CALLS edges of resolved calls; a known receiver makes them surer."""
    rows = deferred.join(resolved.select("deferred_id", F.col("id").alias("dst")), "deferred_id")
    line = F.col("lineNumber") if "lineNumber" in deferred.columns else F.lit(0)
    return rows.select(
        ids.call_edge_id(F.col("sourceNodeId"), F.col("dst"), line).alias("edge_id"), F.lit("CALLS").alias("type"), F.col("sourceNodeId").alias("src"), "dst",
        F.lit(0.85).alias("relationshipWeight"), F.when(F.col("receiverType").isNotNull(), 0.9).otherwise(0.7).alias("confidence"), F.lit("ast").alias("source"), line.cast("int").alias("lineNumber"),
    )


def core_edges(pairs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Edges of the core types from (type, src, dst): id, weight, confidence 1."""
    pairs_of = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    return pairs.select(ids.edge_id(F.col("type"), F.col("src"), F.col("dst")).alias("edge_id"), "type", "src", "dst", F.try_element_at(pairs_of, F.col("type")).alias("relationshipWeight"), F.lit(1.0).alias("confidence"), F.lit("ast").alias("source"))


def new_only(rows: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows with keys not there yet, one of each; the last by seq where there is one."""
    fresh = rows.join(existing.select(key), key, "left_anti")
    if "seq" not in rows.columns:
        return fresh.dropDuplicates([key])
    rest = [c for c in rows.columns if c != key]
    return fresh.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("x")).select(key, "x.*")


def merged_context(parts: DataFrame) -> DataFrame:
    """(context_key, map_key, value): of equal keys the part that comes later (seq) wins."""
    return parts.groupBy("context_key", "map_key").agg(F.max_by("value", "seq").alias("value"))
