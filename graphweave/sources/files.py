"""Source files, config files, graphs in JSON: readers; and the writers of a graph."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import PropertyGraph, with_both_ends
from ..storage import cut, delete, exists

# Paths that are not parsed, as regular expressions or literals.
EXCLUDED = [
    "node_modules/", "dist/", "build/", "coverage/", r"\.d\.ts$", r"\.spec\.ts$", r"\.test\.ts$", r"jest\.config\.ts$", "-e2e/",
    r"test-setup\.ts$", r"global-setup\.ts$", r"global-teardown\.ts$",
]
# Config files that become nodes, and the most bytes of one.
CONFIG_FILES = [
    "package.json", "tsconfig.json", "tsconfig.*.json", "nest-cli.json", "turbo.json", "nx.json", "docker-compose*.yml", "Dockerfile", ".env.example",
    "*.config.js", "*.config.ts",
]
CONFIG_BYTES = 65536


def source_files(spark: SparkSession, root: str, excluded: list[str] = EXCLUDED) -> DataFrame:
    """(path, modificationTime, length, content) of all .ts and .tsx files below root that are not excluded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ts,tsx}").load(root)
    inside = F.substring("path", F.locate(root.rstrip("/").split(":")[-1] + "/", "path"), F.length("path"))
    return files.where(~T.skipped_file(inside, excluded))


def tracked(files: DataFrame) -> DataFrame:
    """(filePath, mtime, size, contentHash) of read files."""
    return files.select(plain_path(F.col("path")).alias("filePath"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("contentHash"))


def plain_path(path):
    return F.regexp_replace(path, r"^file:/*", "/")


def config_nodes(spark: SparkSession, root: str, project: str) -> DataFrame:
    """Small config files as nodes, their whole text as code, their path below root."""
    from ..functions import ids

    glob = "{" + ",".join(CONFIG_FILES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    files = files.where((F.col("length") <= CONFIG_BYTES) & ~T.skipped_file(F.col("path"), ["node_modules/", "/dist/", "/build/", "/coverage/", "/.git/"]))
    path = T.relative_to(plain_path(F.col("path")), F.lit(root.rstrip("/")))
    code = F.decode("content", "UTF-8")
    rows = files.select(path.alias("filePath"), code.alias("sourceCode"), F.lit(project).alias("projectId"))
    name = F.element_at(F.split("filePath", "/"), -1)
    return rows.select(
        ids.node_id(F.col("projectId"), F.lit("SourceFile"), F.col("filePath"), name).alias("id"), "projectId", name.alias("name"), F.lit("SourceFile").alias("coreType"), F.lit("ConfigFile").alias("semanticType"),
        "filePath", "sourceCode", F.size(F.split("sourceCode", "\n")).alias("lineCount"), F.array(F.lit("SourceFile"), F.lit("ConfigFile"), F.lit("GraphNode")).alias("labels"),
        T.hash_of(T.normalized_code(F.col("sourceCode"))).alias("normalizedHash"),
    )


def project_types(spark: SparkSession, root: str, markers: list[str] = ()) -> DataFrame:
    """(path, framework) of the package.json files below root."""
    from ..operators.rules import detect_framework

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "package.json").load(root)
    parsed = F.from_json(F.decode("content", "UTF-8"), "dependencies map<string,string>, devDependencies map<string,string>")
    rows = files.select(plain_path(F.col("path")).alias("path"), parsed.alias("p"))
    empty = F.create_map().cast("map<string,string>")
    entries = F.concat(F.map_entries(F.coalesce("p.dependencies", empty)), F.map_entries(F.coalesce("p.devDependencies", empty)))
    merged = F.map_from_arrays(F.array_distinct(F.transform(entries, lambda e: e["key"])), F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.lit("")))
    return rows.select("path", detect_framework(merged, list(markers)).alias("framework"))


#: Names that elements of a JSON graph have beside their properties, and the columns for them.
_NODE_FIELDS = {"id": "id", "labels": "labels"}
_EDGE_FIELDS = {"id": "edge_id", "type": "type", "startNodeId": "src", "endNodeId": "dst"}


def _spread(elements: DataFrame, named: dict[str, str]) -> DataFrame:
    """Fields and properties side by side; a property that repeats a field (a node's id) counts once."""
    props = elements.schema["properties"].dataType if "properties" in elements.columns else None
    inner = [p for p in getattr(props, "names", []) if p not in named.values()]
    fields = [F.col(k).alias(v) for k, v in named.items() if k in elements.columns]
    return flattened(elements.select(*fields, *[F.col("properties").getField(p).alias(p) for p in inner]))


def _packed(rows: DataFrame, named: dict[str, str]) -> DataFrame:
    """Columns as an element with properties, the id among those of a node."""
    inner = [c for c in rows.columns if c not in named.values() or c == "id"]
    return rows.select(*[F.col(v).alias(k) for k, v in named.items() if v in rows.columns], F.struct(*inner).alias("properties"))


def read_graph_json(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph of one JSON document {nodes, edges, metadata}, or of a folder with elements as JSON lines.

    Nested properties (``context``) become JSON text.
    """
    if exists(spark, f"{path}/nodes"):
        n, e = spark.read.json(f"{path}/nodes"), spark.read.json(f"{path}/edges")
    else:
        doc = spark.read.option("multiLine", True).json(path)
        n, e = (doc.select(F.explode(k).alias("x")).select("x.*") for k in ("nodes", "edges"))
    return PropertyGraph(_spread(n, _NODE_FIELDS), _spread(e, _EDGE_FIELDS))


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns (structs, maps, arrays of structs) as JSON text; scalars and arrays of scalars stay."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        nested = kind.startswith(("struct", "map")) or (kind.startswith("array") and ("struct" in kind or "map" in kind or kind.startswith("array<array")))
        out.append(F.to_json(f.name).alias(f.name) if nested else F.col(f.name))
    return df.select(*out)


def write_graph(g: PropertyGraph, path: str, mode: str = "append") -> tuple[int, int]:
    """Append (or overwrite by project) nodes and edges as Parquet; edges without both ends are left out.

    Returns how many edges were given and how many stored.
    """
    nodes, edges = cut(flattened(g.nodes)), cut(flattened(g.edges))
    kept = cut(with_both_ends(edges, nodes))

    def put(rows, kind, by):
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/{kind}")

    put(nodes, "nodes", ["projectId"])
    put(kept, "edges", ["projectId", "type"])
    return edges.count(), kept.count()


def import_chunks(chunks: Iterable[PropertyGraph], path: str) -> tuple[int, int, int]:
    """(chunks, edges given, edges stored) of a graph that comes in parts.

    All nodes go before the first edge, so that edges between parts keep both ends;
    each part is written as it comes and only its place in the shared folder is kept.
    """
    spark, parts, given, stored = None, [], 0, 0
    for g in chunks:
        spark = g.nodes.sparkSession
        flattened(g.nodes).write.mode("append").partitionBy("projectId").parquet(f"{path}/nodes")
        parts.append(cut(flattened(g.edges)))
    if not parts:
        return 0, 0, 0
    known = spark.read.parquet(f"{path}/nodes").select("id").distinct()
    for edges in parts:
        kept = cut(with_both_ends(edges, known))
        kept.write.mode("append").partitionBy("projectId", "type").parquet(f"{path}/edges")
        given, stored = given + edges.count(), stored + kept.count()
    return len(parts), given, stored


def read_graph(spark: SparkSession, path: str, project: str | None = None) -> PropertyGraph:
    """A stored graph; a project's filter reaches the partitions."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if project is not None:
        nodes, edges = nodes.where(F.col("projectId") == project), edges.where(F.col("projectId") == project)
    return PropertyGraph(nodes, edges)


def clear_project(spark: SparkSession, path: str, project: str) -> None:
    """Remove a project's partitions."""
    for kind in ("nodes", "edges"):
        delete(spark, f"{path}/{kind}/projectId={project}")


def clear_all(spark: SparkSession, path: str) -> None:
    """Remove a stored graph with all its projects."""
    for kind in ("nodes", "edges"):
        delete(spark, f"{path}/{kind}")


def write_json(g: PropertyGraph, path: str, mode: str = "errorifexists") -> None:
    """A dump that read_graph_json reads: nodes, edges and metadata as JSON lines, a folder each."""
    _packed(g.nodes, _NODE_FIELDS).write.mode(mode).json(f"{path}/nodes")
    _packed(g.edges, _EDGE_FIELDS).write.mode(mode).json(f"{path}/edges")
    metadata(g).write.mode(mode).json(f"{path}/metadata")


def write_json_document(g: PropertyGraph, path: str, mode: str = "errorifexists") -> None:
    """The same as one document {nodes, edges, metadata}; being one text, it is written by one task, as a stream."""
    spark = g.nodes.sparkSession
    lines = [(0, _packed(g.nodes, _NODE_FIELDS)), (1, _packed(g.edges, _EDGE_FIELDS)), (2, metadata(g))]
    rows = None
    for k, df in lines:
        one = df.select(F.lit(k).alias("k"), F.to_json(F.struct("*")).alias("x"))
        rows = one if rows is None else rows.unionByName(one)
    heads = spark.createDataFrame([(0, ""), (1, "")], "k int, x string")  # a line for each list, be it empty

    def join(batches):
        lists = ['{"nodes": [', '], "edges": [', '], "metadata": ']
        at, first = -1, True
        for batch in batches:
            out = []
            for k, x in zip(batch.column("k").to_pylist(), batch.column("x").to_pylist()):
                while at < k:
                    at, first = at + 1, True
                    out.append(lists[at])
                if x:
                    out.append(x if first else "," + x)
                    first = False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["}"])], names=["value"])

    ordered = heads.unionByName(rows).repartition(1).sortWithinPartitions("k", "x")
    ordered.mapInArrow(join, "value string").write.mode(mode).text(path)


def metadata(g: PropertyGraph) -> DataFrame:
    """One row: number of nodes and edges, and of files."""
    n = g.nodes.agg(F.count("*").alias("totalNodes"), F.countDistinct("filePath").alias("sourceFiles"))
    return n.join(g.edges.agg(F.count("*").alias("totalEdges")))
