"""More queries: stored graphs, parsed sources, rules one by one, state changes, answers with their payload.

They add themselves to those of ``queries``; names begin with the operator they show.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .operators import duplicates, graph, impact, markers, messages, resolve, rules, search, sessions, tasks
from .plans import nlquery
from .queries import _DECAYED, _GRAPH, _MARKERS, _MESSAGES, _OUT, _ROWS, _SIMILAR, _VECTORS, _WORK, NOW, _beam_sql, _bookmarks, _code_nodes, _first_vector, _ids, _paths_sql, query
from .sources import embedding, files, semantic, typescript, workspace
from .sources import fixtures as X
from .storage import cut, shared_dir, write_text
from .streaming import events as stream

# ---------------------------------------------------------------- stored graphs and generated queries


def _folder(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


@query(f"{_GRAPH} SELECT type AS label, count(*) AS n, CAST(sum(lineNumber) AS BIGINT) AS lines FROM edges GROUP BY 1 UNION ALL SELECT coreType, count(*), CAST(sum(startLine) AS BIGINT) FROM nodes GROUP BY 1")
def s9_graph_json(spark, sf_dir):
    """And w11: the whole graph written as JSON and read again."""
    path = _folder(spark, "json")
    files.write_json(X.graph(spark, sf_dir), path)
    g = files.read_graph_json(spark, path)
    return g.edges.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n"), F.sum("lineNumber").alias("lines")).union(g.nodes.groupBy("coreType").agg(F.count("*"), F.sum("startLine")))


@query(f"{_GRAPH}, kept AS (SELECT * FROM edges WHERE src NOT LIKE 'S:%' AND dst NOT LIKE 'S:%') SELECT (SELECT count(*) FROM edges) AS given, (SELECT count(*) FROM kept) AS stored, (SELECT count(*) FROM kept) AS read_back")
def w1_stored_graph(spark, sf_dir):
    """Without suppliers: edges that have lost an end are not stored."""
    g, path = X.graph(spark, sf_dir), _folder(spark, "graph")
    given, stored = files.write_graph(graph.PropertyGraph(g.nodes.where("coreType != 'Supplier'"), g.edges), path)
    return files.read_graph(spark, path, X.PROJECT).edges.agg(F.lit(given).cast("long").alias("given"), F.lit(stored).cast("long").alias("stored"), F.count("*").alias("read_back"))


@query(f"{_GRAPH} SELECT 'other' AS project, coreType AS label, count(*) AS n FROM nodes GROUP BY 2")
def w3_cleared_project(spark, sf_dir):
    """Two projects are stored, one is cleared."""
    n, path = X.graph(spark, sf_dir).nodes, _folder(spark, "graph")
    both = n.unionByName(n.withColumn("projectId", F.lit("other")))
    files.write_graph(graph.PropertyGraph(both, X.graph(spark, sf_dir).edges.limit(0)), path)
    files.clear_project(spark, path, X.PROJECT)
    return spark.read.parquet(f"{path}/nodes").groupBy(F.col("projectId").alias("project"), F.col("coreType").alias("label")).agg(F.count("*").alias("n"))


@query(f"{_GRAPH} SELECT 3 AS chunks, count(*) AS given, count(*) AS stored FROM edges")
def v6_chunked_import(spark, sf_dir):
    """The graph in three parts, each with the edges that begin there; those between parts are kept."""
    g = X.graph(spark, sf_dir)
    parts = [F.col("x").startswith("O:"), F.col("x").startswith("P:") | F.col("x").startswith("C:"), ~F.col("x").rlike("^[OPC]:")]
    of = lambda df, c, p: df.withColumn("x", F.col(c)).where(p).drop("x")
    chunks, given, stored = files.import_chunks((graph.PropertyGraph(of(g.nodes, "id", p), of(g.edges, "src", p)) for p in parts), _folder(spark, "graph"))
    return spark.range(1).select(F.lit(chunks).alias("chunks"), F.lit(given).cast("long").alias("given"), F.lit(stored).cast("long").alias("stored"))


@query(f"{_GRAPH} SELECT n.coreType AS label, count(*) AS n, count(DISTINCT m.id) AS ends FROM edges e JOIN nodes n ON n.id = e.src JOIN nodes m ON m.id = e.dst GROUP BY 1")
def ql5_guarded(spark, sf_dir):
    """A generated query with aliases and joins, on tables that hold another project, too; its own filter says nothing."""
    g = X.graph(spark, sf_dir)
    twice = lambda df: df.unionByName(df.withColumn("projectId", F.lit("other")))
    said = '{"sql": "SELECT n.coreType AS label, count(*) AS n, count(DISTINCT m.id) AS ends FROM edges AS e JOIN nodes n ON n.id = e.src JOIN nodes m ON m.id = e.dst WHERE :projectId = :projectId GROUP BY n.coreType"}'
    return nlquery.run(spark, said, X.PROJECT, [], {"nodes": twice(g.nodes), "edges": twice(g.edges)})


@query("SELECT '/src/' || doc_id || '.ts' AS \"filePath\", CAST(doc_id AS BIGINT) AS mtime, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS \"contentHash\" FROM documents")
def s11_tracked_files(spark, sf_dir):
    """Documents as the files that a reader of binary files would give."""
    d = X.table(spark, sf_dir, "documents")
    read = d.select(_text("file:/src/", F.col("doc_id"), ".ts").alias("path"), F.timestamp_millis("doc_id").alias("modificationTime"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return files.tracked(read.withColumn("length", F.octet_length("content").cast("long")))


_FOLDERS: dict = {}


def _files(spark, sf_dir):
    """A workspace of a package a nation, written to the shared folder once a session: sources, files that don't count, manifests."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOLDERS:
        root = _folder(spark, "workspace")
        write_text(spark, f"{root}/package.json", '{"name": "root", "workspaces": ["packages/*"]}')
        for r in X.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
            k, at = r.n_nationkey, f"{root}/packages/n{r.n_nationkey}"
            write_text(spark, f"{at}/src/f{k}.ts{'x' if k % 3 == 0 else ''}", f"export class {r.n_name.title().replace(' ', '')} {{}}\n")
            write_text(spark, f"{at}/src/f{k}.spec.ts", "x")
            write_text(spark, f"{at}/node_modules/m/i.ts", "x")
            name = f'"name": "@s/n{k}", ' if k % 2 == 0 else ""
            write_text(spark, f"{at}/package.json", f'{{{name}"dependencies": {{"{"@nestjs/core" if k % 5 == 0 else "x"}": "1"}}}}')
        _FOLDERS[key] = root
    return _FOLDERS[key]


@query("SELECT 'f' || n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '.tsx' ELSE '.ts' END AS file, sha256('export class ' || replace(n, ' ', '') || ' {}' || chr(10)) AS hash FROM (SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS n FROM nation)")
def s1_source_files(spark, sf_dir):
    """And s11: the source files of a folder, without tests and foreign modules."""
    read = files.tracked(files.source_files(spark, _files(spark, sf_dir)))
    return read.select(F.substring_index("filePath", "/", -1).alias("file"), F.col("contentHash").alias("hash"))


@query("SELECT CASE n_nationkey % 2 WHEN 0 THEN '@s/n' ELSE 'n' END || n_nationkey AS name, 'n' || n_nationkey AS folder FROM nation")
def s5_packages(spark, sf_dir):
    """And s3, s4: the packages that a workspace's globs name."""
    return workspace.packages(spark, _files(spark, sf_dir)).select("name", F.substring_index("path", "/", -1).alias("folder"))


@query("SELECT 'n' || n_nationkey AS folder, CASE n_nationkey % 5 WHEN 0 THEN 'nestjs' ELSE 'vanilla' END AS framework FROM nation UNION ALL SELECT 'root', 'vanilla'")
def s7_project_types(spark, sf_dir):
    """What each package's dependencies tell."""
    root = _files(spark, sf_dir)
    at = F.element_at(F.split("path", "/"), -2)
    return files.project_types(spark, root).select(F.when(at.startswith("workspace-"), "root").otherwise(at).alias("folder"), "framework")


@query("SELECT 'packages/n' || n_nationkey || '/package.json' AS file, 1 AS lines FROM nation UNION ALL SELECT 'package.json', 1")
def s8_config_files(spark, sf_dir):
    """Manifests as nodes, by their path below the root."""
    root = _files(spark, sf_dir).removeprefix("file:")
    return files.config_nodes(spark, root, "p").select(F.regexp_replace("filePath", "^.*/workspace-[0-9a-f]+/", "").alias("file"), F.col("lineCount").alias("lines"))


# ---------------------------------------------------------------- sources that are parsed


def _sources(spark, sf_dir):
    """A file a part: a class that extends the next one, and a function that it calls."""
    k, after = F.col("p_partkey"), F.col("p_partkey") + 1
    code = _text(
        "import { Base", after, " } from './f", after, "';\n@Injectable()\nexport class K", k, "<T = {}> extends K", after, " implements Able<{ a: string }> {\n  private kept: Map<string, number> = new Map();\n",
        "  constructor(private readonly store: Store", k, ", @Inject('T') other: Other) { super(); }\n  twice(a: string): { b: string };\n  private async run(a: string, b = 1): Promise<{ b: string }> {\n",
        "    return helper", k, "(a, 1, 2);\n  }\n}\nexport interface Able", k, " { a: string; }\ndeclare function outside", k, "(a: string): void;\nexport function helper", k,
        "(x: string): { b: string } {\n  return other", k, "(x + x);\n}\ntype Alias", k, " = { a: 1 };\nexport const Routes", k, ": string[] = [];\n",
    )
    return X.table(spark, sf_dir, "part").select(_text("/src/f", k, ".ts").alias("path"), code.cast("binary").alias("content"))


def _parsed(spark, sf_dir):
    return typescript.parse_files(_sources(spark, sf_dir), "p")


@query("""SELECT 'K' || p_partkey AS name, 'ClassDeclaration' AS core, 2 AS first, 10 AS last, true AS exported, 'Injectable' AS decorators, 'K' || (p_partkey + 1) AS base, 'Store' || p_partkey || ',Other' AS types FROM part
UNION ALL SELECT 'f' || p_partkey || '.ts', 'SourceFile', 1, 17, NULL, NULL, NULL, NULL FROM part
UNION ALL SELECT './f' || (p_partkey + 1), 'ImportDeclaration', 1, 1, NULL, NULL, NULL, NULL FROM part
UNION ALL SELECT 'Able' || p_partkey, 'InterfaceDeclaration', 11, 11, true, '', NULL, NULL FROM part
UNION ALL SELECT 'outside' || p_partkey, 'FunctionDeclaration', 12, 12, false, '', NULL, NULL FROM part
UNION ALL SELECT 'helper' || p_partkey, 'FunctionDeclaration', 13, 15, true, '', NULL, NULL FROM part
UNION ALL SELECT 'Alias' || p_partkey, 'TypeAlias', 16, 16, false, '', NULL, NULL FROM part
UNION ALL SELECT 'Routes' || p_partkey, 'VariableDeclaration', 17, 17, false, NULL, NULL, NULL FROM part""")
def p4_parsed_declarations(spark, sf_dir):
    """And p1, p2, p3, p6, p7: declarations of every file, with their lines, decorators, bases and constructor types."""
    rows = _parsed(spark, sf_dir).where("kind = 'node' and coreType in ('ClassDeclaration', 'SourceFile', 'ImportDeclaration', 'InterfaceDeclaration', 'FunctionDeclaration', 'TypeAlias', 'VariableDeclaration')")
    return rows.select("name", F.col("coreType").alias("core"), F.col("startLine").alias("first"), F.col("endLine").alias("last"), F.col("isExported").alias("exported"), F.array_join("decorators", ",").alias("decorators"), F.col("extendsName").alias("base"), F.array_join("constructorTypes", ",").alias("types"))


@query("""WITH k AS (SELECT p_partkey AS k FROM part), m(core, name, visibility, async, first, last, code) AS (VALUES ('ConstructorDeclaration', 'constructor', 'public', false, 5, 5, NULL), ('MethodDeclaration', 'twice', 'public', false, 6, 6, 'twice(a: string): { b: string };'),
('MethodDeclaration', 'run', 'private', true, 7, 9, NULL), ('PropertyDeclaration', 'kept', 'private', NULL, 4, 4, NULL))
SELECT 'K' || k AS class, m.* FROM k, m""")
def p4_parsed_members(spark, sf_dir):
    """Members of every class; the text of one that has no body."""
    rows = _parsed(spark, sf_dir).where("kind = 'node' and parentClassName is not null")
    return rows.select(F.col("parentClassName").alias("class"), F.col("coreType").alias("core"), "name", "visibility", F.col("isAsync").alias("async"), F.col("startLine").alias("first"), F.when(F.col("name") == "kept", F.col("startLine")).otherwise(F.col("endLine")).alias("last"), F.when(F.col("name") == "twice", F.trim("sourceCode")).alias("code"))


@query("""WITH k AS (SELECT p_partkey AS k FROM part), f AS (SELECT k, sha256('p::SourceFile::/src/f' || k || '.ts::f' || k || '.ts') AS h FROM k)
SELECT k, sha256('p::FunctionDeclaration::/src/f' || k || '.ts::p:SourceFile:' || substr(h, 1, 16) || '::helper' || k)[1:16] AS id, true AS skeleton FROM f""")
def p5_skeletons(spark, sf_dir):
    """And p9: a function stands in its file's text as signature and id."""
    rows = cut(_parsed(spark, sf_dir).where("kind = 'node' and (name like 'helper%' or coreType = 'SourceFile')").select("filePath", "id", "name", "coreType", "kind", "sourceCode"))
    own = rows.where("kind = 'node' and name like 'helper%'").select("filePath", F.substring_index("id", ":", -1).alias("id"), F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("k"))
    text = rows.where("kind = 'node' and coreType = 'SourceFile'").select("filePath", "sourceCode")
    there = F.col("sourceCode").contains(_text("(x: string): { /* NodeID: p:FunctionDeclaration:", F.col("id"), " */ }")) & ~F.col("sourceCode").contains("x + x")
    return own.join(text, "filePath").select("k", "id", there.alias("skeleton"))


@query("""WITH k AS (SELECT p_partkey AS k FROM part), e AS (SELECT * FROM k JOIN (SELECT k - 1 AS k, true AS b FROM k) b USING (k))
SELECT 'EXTENDS' AS type, 'K' || k AS a, 'K' || (k + 1) AS b, 0.85::DOUBLE AS w FROM e UNION ALL SELECT 'IMPORTS', 'f' || k || '.ts', 'f' || (k + 1) || '.ts', 0.55 FROM e
UNION ALL SELECT 'CALLS', 'run', 'helper' || k, 0.85 FROM k""")
def p15_built_edges(spark, sf_dir):
    """And p10 to p14: edges between declarations that names, paths and calls resolve to."""
    g = typescript.build_graph(_sources(spark, sf_dir), "p")
    a, b = g.nodes.select(F.col("id").alias("src"), F.col("name").alias("a")), g.nodes.select(F.col("id").alias("dst"), F.col("name").alias("b"))
    return g.edges.where("type in ('EXTENDS', 'IMPORTS', 'CALLS')").join(a, "src").join(b, "dst").select("type", "a", "b", F.col("relationshipWeight").alias("w"))


def _framework_sources(spark, sf_dir):
    """A controller and a service a part, of a web framework."""
    k = F.col("p_partkey")
    code = _text("@Controller('c", k, "')\n@UseGuards(Guard)\nexport class C", k, "Controller {\n  constructor(private readonly s: S", k, "Service) {}\n  @Get(':id')\n  @HttpCode(201)\n  @UseGuards(A, B)\n  async one(@Param('id') id: string): Promise<X> { return this.s.find(id); }\n  @MessagePattern('m", k, "')\n  handle(d: any) { return this.s.find(d); }\n}\n@Injectable({ scope: Scope.REQUEST })\nexport class S", k, "Service { find(id: string) { return load(id, 1, 2); } }\n")
    return X.table(spark, sf_dir, "part").select(_text("/src/c", k, ".controller.ts").alias("path"), code.cast("binary").alias("content"))


@query("""SELECT 'C' || p_partkey || 'Controller' AS a, CASE x WHEN 1 THEN 'S' || p_partkey || 'Service' WHEN 2 THEN 'one' ELSE 'handle' END AS b, CASE x WHEN 1 THEN 'INJECTS' ELSE 'EXPOSES' END AS type,
CASE x WHEN 2 THEN '/c' || p_partkey || '/:id' END AS path FROM part, range(1, 4) r(x)""")
def p20_semantic_edges(spark, sf_dir):
    """And p16 to p24: edges by rule of sources that are parsed and typed."""
    g = semantic.semantic_graph(_framework_sources(spark, sf_dir), "p")
    a, b = g.nodes.select(F.col("id").alias("src"), F.col("name").alias("a")), g.nodes.select(F.col("id").alias("dst"), F.col("name").alias("b"))
    return g.edges.where("edge_id like 'SEM:%'").join(a, "src").join(b, "dst").select("a", "b", "type", F.get_json_object("context", "$.fullPath").alias("path"))


@query("""SELECT 'C' || p_partkey || 'Controller' AS name, CAST(1 AS BIGINT) AS endpoints, true AS guarded, 1 AS dependencies, 'DEFAULT' AS scope, '/c' || p_partkey AS base FROM part
UNION ALL SELECT 'S' || p_partkey || 'Service', 0, false, 0, 'REQUEST', NULL FROM part""")
def p32_class_context(spark, sf_dir):
    """And p31: what decorators and members tell of classes."""
    n = semantic.with_context(typescript.build_graph(_framework_sources(spark, sf_dir), "p").nodes)
    n = cut(n.where("coreType = 'ClassDeclaration' or parentClassName is not null").drop("sourceCode", "normalizedHash"))
    base = n.where("coreType = 'ClassDeclaration'").select("id", F.col("basePath").alias("base"))
    return semantic.class_context(n).join(base, "id").select("name", F.col("endpointCount").alias("endpoints"), F.col("hasGlobalGuards").alias("guarded"), F.col("dependencyCount").alias("dependencies"), "scope", "base")


@query("""SELECT 'C' || p_partkey || 'Controller' AS class, m.* FROM part, (VALUES ('one', 'GET', ':id', 201, 'A,B', NULL), ('handle', NULL, NULL, NULL, '', 'message')) m(name, http, path, status, guards, pattern)
UNION ALL SELECT 'S' || p_partkey || 'Service', 'find', NULL, NULL, NULL, '', NULL FROM part""")
def p32_method_context(spark, sf_dir):
    n = semantic.with_context(typescript.build_graph(_framework_sources(spark, sf_dir), "p").nodes)
    return semantic.method_context(n).select(F.col("parentClassName").alias("class"), "name", F.col("httpMethod").alias("http"), "path", F.col("statusCode").alias("status"), F.array_join("guardNames", ",").alias("guards"), "pattern")


# ---------------------------------------------------------------- resolution, rule by rule

_R = "(p_partkey % 7)"


@query(f"SELECT 'd' || p_partkey AS deferred_id, CASE WHEN {_R} IN (0, 6) THEN 'C' WHEN {_R} = 4 THEN 'X' ELSE 'F' END || p_partkey AS id, {_R} + 1 AS prio FROM part")
def p12_each_rule(spark, sf_dir):
    """Imports that only one of the seven rules answers, by part."""
    k, r, none = F.col("p_partkey"), F.col("p_partkey") % 7, F.lit(None).cast("string")
    p = X.table(spark, sf_dir, "part")
    f = p.select(_text("F", k).alias("id"), _text("f", k, ".ts").alias("name"), F.lit("SourceFile").alias("coreType"), _text("/w/pkg", k, "/src/sub/f", k, ".ts").alias("filePath"), k.alias("seq"))
    x = p.where(r == 4).select(_text("X", k), F.lit("index.ts"), F.lit("SourceFile"), _text("/w/pkg", k, "/src/index.ts"), k + 1_000_000_000)
    c = p.select(_text("C", k), _text("K", k), F.lit("ClassDeclaration"), _text("/w/c", k, ".ts"), k)
    of_class = r.isin(0, 6)
    name = F.when(of_class, _text("K", k)).when(r == 2, _text("./sub/f", k)).when(r == 3, _text("@s/pkg", k, "/sub/f", k)).when(r == 4, _text("@s/pkg", k)).when(r == 5, _text("@s/pkg", k, "/none")).otherwise("unknown")
    place = F.when(r == 0, _text("/w/c", k, ".ts")).when(r == 1, _text("/w/pkg", k, "/src/sub/f", k, ".ts")).otherwise(none)
    d = p.select(_text("d", k).alias("deferred_id"), name.alias("targetName"), F.when(of_class, "ClassDeclaration").otherwise("SourceFile").alias("targetType"), place.alias("targetFilePath"))
    return resolve.resolve_names(d, f.union(x).union(c)).select("deferred_id", "id", F.col("prio").cast("long").alias("prio"))


_CALLED = "SELECT 'd' || p_partkey AS deferred_id, CASE p_partkey % 5 WHEN 2 THEN 'T' WHEN 3 THEN 'G' ELSE 'M' END || p_partkey AS id, p_partkey % 5 + 1 AS prio FROM part"


def _calls(spark, sf_dir):
    k, r, none = F.col("p_partkey"), F.col("p_partkey") % 5, F.lit(None).cast("string")
    p = X.table(spark, sf_dir, "part")
    node = lambda i, name, core, cls: p.select(_text(i, k).alias("id"), name.alias("name"), F.lit(core).alias("coreType"), cls.alias("parentClassName"), k.alias("seq"))
    own = _text("A", k)
    n = node("M", _text("m", k), "MethodDeclaration", own).union(node("G", _text("g", k), "FunctionDeclaration", none)).union(node("T", F.lit("constructor"), "ConstructorDeclaration", own)).union(node("S", _text("s", k), "MethodDeclaration", own))
    name = F.when(r == 2, own).when(r == 3, _text("g", k)).otherwise(_text("m", k))
    core = F.when(r == 2, "ConstructorDeclaration").when(r == 3, "FunctionDeclaration").otherwise("MethodDeclaration")
    d = p.select(_text("d", k).alias("deferred_id"), F.when(r == 0, _text("S", k)).otherwise("else").alias("sourceNodeId"), name.alias("targetName"), core.alias("targetType"), F.when(r == 0, "this").when(r == 1, "x").alias("receiverExpression"), F.when(r == 1, own).alias("receiverType"))
    return d, n


@query(_CALLED)
def p13_each_rule(spark, sf_dir):
    """Calls that only one of the five rules answers, by part."""
    return resolve.resolve_calls(*_calls(spark, sf_dir)).select("deferred_id", "id", F.col("prio").cast("long").alias("prio"))


@query(f"WITH c AS ({_CALLED}), e AS (SELECT CASE WHEN prio = 1 THEN 'S' || substr(deferred_id, 2) ELSE 'else' END AS src, id AS dst, CASE WHEN prio = 2 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM c) SELECT 'CALLS:' || substr(sha256('CALLS::' || src || '::' || dst || '::0'), 1, 16) AS edge_id, src, dst, confidence FROM e")
def p15_call_edges(spark, sf_dir):
    d, n = _calls(spark, sf_dir)
    return resolve.call_edges(d, resolve.resolve_calls(d, n)).select("edge_id", "src", "dst", "confidence")


@query("SELECT 'S' || p_partkey AS src, 'V' || p_partkey AS dst, 0.82::DOUBLE AS w FROM part WHERE p_partkey % 3 <> 2")
def p30_internal_api(spark, sf_dir):
    """A service with a client of a vendor, and the vendor's controller: by name, by path, or neither."""
    p = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    third, none = F.col("k") % 3, F.array().cast("array<string>")
    c = p.select(_text("V", F.col("k")).alias("id"), F.when(third == 0, _text("Q", F.col("k"), "VendorController")).otherwise(_text("Q", F.col("k"), "Controller")).alias("name"), F.lit("Controller").alias("semanticType"), F.when(third == 1, _text("/modules/vendor/", F.col("k"))).otherwise("/x").alias("filePath"), none.alias("propertyTypes"))
    s = p.select(_text("S", F.col("k")), F.lit("service"), F.lit("Service"), F.lit("/s"), F.array(_text("Q", F.col("k"), "Client"), F.lit("Map")))
    return rules.internal_api_call(c.union(s)).select("src", "dst", F.col("relationshipWeight").alias("w"))


# ---------------------------------------------------------------- normalisation, metrics, similarity

_TRIMMED = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
_MEASURED = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS c FROM documents), m AS (SELECT doc_id, length(regexp_replace(c, '\s+', '', 'g')) = 0 AS none,
coalesce(list_sum(list_transform(regexp_extract_all(c, '\([^)]*\)'), lambda g: len(list_filter(string_split(substr(g, 2, length(g) - 2), ','), lambda x: length({_TRIMMED}) > 0)))), 0) AS p,
floor((len(regexp_extract_all(c, '[;{{}}]')) + 1) / 2) AS s,
list_reduce(list_concat([0], list_transform(regexp_extract_all(c, '[{{}}]'), lambda b: CASE WHEN b = '{{' THEN 1 ELSE -1 END)), lambda a, b: CASE WHEN b = 1 THEN greatest(a // 1000000, a % 1000000 + 1) * 1000000 + a % 1000000 + 1 ELSE (a // 1000000) * 1000000 + greatest(0, a % 1000000 - 1) END) // 1000000 AS d,
len(list_filter(string_split(c, chr(10)), lambda x: length({_TRIMMED}) > 0)) AS l, len(list_filter(regexp_split_to_array(c, '\s+'), lambda x: length(x) > 0)) AS k FROM t),
f AS (SELECT doc_id, CAST(CASE WHEN none THEN 0 ELSE p END AS BIGINT) AS parameters, CAST(CASE WHEN none THEN 0 ELSE s END AS BIGINT) AS statements, CAST(CASE WHEN none THEN 0 ELSE d END AS BIGINT) AS depth,
CAST(CASE WHEN none THEN 0 ELSE l END AS BIGINT) AS lines, CAST(CASE WHEN none THEN 0 ELSE k END AS BIGINT) AS tokens FROM m)"""
_METRIC = {"parameters": "parameterCount", "statements": "statementCount", "depth": "controlFlowDepth", "lines": "lineCount", "tokens": "tokenCount"}


def _metrics(spark, sf_dir):
    m = T.code_metrics(F.col("text"))
    return X.table(spark, sf_dir, "documents").select("doc_id", *[m[v].alias(k) for k, v in _METRIC.items()])


@query(f"{_MEASURED} SELECT * FROM f")
def d7_metrics(spark, sf_dir):
    """All five metrics of whole texts."""
    return _metrics(spark, sf_dir)


@query(f"""{_MEASURED}, w(name, w) AS (VALUES ('parameters', 0.15), ('statements', 0.35), ('depth', 0.15), ('lines', 0.35))
SELECT a.doc_id, round(CAST(0.15 * (1 - abs(a.parameters - b.parameters) / greatest(a.parameters, b.parameters, 1)) + 0.35 * (1 - abs(a.statements - b.statements) / greatest(a.statements, b.statements, 1))
+ 0.15 * (1 - abs(a.depth - b.depth) / greatest(a.depth, b.depth, 1)) + 0.35 * (1 - abs(a.lines - b.lines) / greatest(a.lines, b.lines, 1)) AS DOUBLE), 6) AS similarity FROM f a JOIN f b ON b.doc_id = a.doc_id + 1""")
def d9_metric_similarity(spark, sf_dir):
    """Each document with the next one, by the metrics of their whole texts."""
    m = cut(_metrics(spark, sf_dir))
    a, b = {v: F.col(k).cast("double") for k, v in _METRIC.items()}, {v: F.col(f"{k}2").cast("double") for k, v in _METRIC.items()}
    other = m.select((F.col("doc_id") - 1).alias("doc_id"), *[F.col(k).alias(f"{k}2") for k in _METRIC])
    return m.join(other, "doc_id").select("doc_id", F.round(T.metric_similarity(a, b), 6).alias("similarity"))


@query(f"{_VECTORS}, v2 AS (SELECT vec_id, label, e FROM v), s AS (SELECT vec_id, round((1 + list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 0))) / 2, 6) AS score FROM v ORDER BY (1 + list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 0))) / 2 DESC, vec_id LIMIT 50) SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS id, score FROM s WHERE score >= 0.65 ORDER BY score DESC, vec_id LIMIT 5")
def b2_search_code(spark, sf_dir):
    """The hits of a code search; the traversal round the best one is c2's."""
    n = X.table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("id"), F.lit(X.PROJECT).alias("projectId"), "embedding")
    none = spark.createDataFrame([], "edge_id string, type string, src string, dst string, projectId string, relationshipWeight double")
    hits, _ = search.search_code(graph.PropertyGraph(n, none), _first_vector(spark, sf_dir), 5, project=X.PROJECT)
    return hits.select("id", F.round("score", 6).alias("score"))


@query(_beam_sql("O:1", 3, 8).replace("* 0.5 *", "* coalesce(vs.s, 0.5) *").replace("f.id = s.a\n", "f.id = s.a LEFT JOIN vs ON vs.id = s.b\n").replace(", v0 AS", ", vs AS (SELECT 'P:' || vec_id AS id, (1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))) / 2 AS s FROM embeddings), v0 AS").replace("SELECT * FROM k", "SELECT depth, id, round(score, 6) AS score, from_id, type, edge_id FROM k"))
def c2_beam_vectors(spark, sf_dir):
    """Parts have vectors: edge weight, similarity and decay together."""
    g, v = X.graph(spark, sf_dir), X.table(spark, sf_dir, "embeddings")
    n = g.nodes.join(v.select(_text("P:", F.col("vec_id")).alias("id"), "embedding"), "id", "left")
    return graph.beam(graph.PropertyGraph(n, g.edges), "O:1", 3, "BOTH", 5, _first_vector(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("""SELECT 'e' || doc_id AS id, CAST(CAST(v[1] / sqrt(v[1] * v[1] + v[2] * v[2]) AS FLOAT) AS DOUBLE) AS a, CAST(CAST(v[2] / sqrt(v[1] * v[1] + v[2] * v[2]) AS FLOAT) AS DOUBLE) AS b
FROM (SELECT doc_id, [CAST(length(text) AS DOUBLE), CAST(1 + len(string_split(text, ' ')) AS DOUBLE)] AS v FROM documents WHERE length(text) > 0)""")
def p39_embeddings(spark, sf_dir):
    """Vectors of whole texts from a model that counts characters and blanks, loaded once a worker."""

    def load():
        import numpy as np

        return lambda texts: np.array([[len(t), 2 + t.count(" ")] for t in texts], float)

    d = X.table(spark, sf_dir, "documents").select(_text("e", F.col("doc_id")).alias("id"), embedding.embedded(F.col("text"), load).alias("v"))
    return d.where("v is not null").select("id", F.col("v")[0].cast("double").alias("a"), F.col("v")[1].cast("double").alias("b"))


@query(f"{_SIMILAR}, p AS (SELECT a, b, s FROM k WHERE a < b AND la % 2 = lb % 2) SELECT count(*) AS n, count(DISTINCT a) AS left_nodes, count(DISTINCT b) AS right_nodes, round(max(s), 6) AS most FROM p WHERE s >= 0.75")
def d12_similar_pairs_high(spark, sf_dir):
    """At a threshold that lets blocks be passed over, in small blocks."""
    from .queries import _vector_nodes

    p = duplicates.similar_pairs(_vector_nodes(spark, sf_dir), 0.75, block=64)
    return p.agg(F.count("*").alias("n"), F.countDistinct("id1").alias("left_nodes"), F.countDistinct("id2").alias("right_nodes"), F.round(F.max("similarity"), 6).alias("most"))


@query(r"SELECT 'documents' AS what, count(*) FILTER (coalesce(length(text), 0) = 0) AS empty FROM documents")
def d1_empty_code(spark, sf_dir):
    """Whole texts normalised: those of which nothing is left have no hash."""
    h = T.hash_of(T.normalized_code(F.col("text")))
    d = X.table(spark, sf_dir, "documents").select(F.length(F.coalesce("text", F.lit(""))).alias("n"), h.alias("h"))
    return d.agg(F.lit("documents").alias("what"), F.count_if((F.col("h") == "") & (F.col("n") == 0)).alias("empty"))


# ---------------------------------------------------------------- answers of traversals

_FOUND = _paths_sql(_OUT, "O:1", 3)


@query(f"{_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY id, array_to_string(used, '/')) AS k FROM found WHERE id <> 'O:1') SELECT depth, count(*) AS n, count(*) > 5 AS has_more, string_agg(array_to_string(types, '>') || ':' || id, ',' ORDER BY k) FILTER (k <= 5) AS chains FROM r GROUP BY 1")
def c4_depth_chains(spark, sf_dir):
    s = graph.depth_summary(graph.traverse(X.graph(spark, sf_dir), "O:1", 3, "OUTGOING"))
    return s.select(F.col("depth").cast("int").alias("depth"), "n", "has_more", F.array_join("chains", ",").alias("chains"))


@query(f"{_FOUND} SELECT id, any_value(name) AS name, any_value(\"filePath\") AS \"filePath\", min(depth) AS depth FROM found WHERE id <> 'O:1' GROUP BY 1 ORDER BY min((depth, array_to_string(used, '/'))), id LIMIT 7")
def c5_shown_nodes(spark, sf_dir):
    """The first seven distinct nodes of an answer, in order of depth and path."""
    n = graph.shown_nodes(graph.traverse(X.graph(spark, sf_dir), "O:1", 3, "OUTGOING"), 7)
    return n.select("id", "name", "filePath", F.col("depth").cast("int").alias("depth"))


@query(f"{_FOUND} SELECT DISTINCT depth, types[-1] AS type, used[-1] AS edge_id, id FROM found WHERE id <> 'O:1'")
def c5_shown_edges(spark, sf_dir):
    e = graph.shown_edges(graph.traverse(X.graph(spark, sf_dir), "O:1", 3, "OUTGOING"))
    return e.withColumn("depth", F.col("depth").cast("int"))


@query(f"{_FOUND} SELECT true AS summarised, count(*) AS total, (SELECT count(*) FROM (SELECT DISTINCT \"filePath\" FROM found WHERE id <> 'O:1' ORDER BY 1 LIMIT 30)) AS files FROM found WHERE id <> 'O:1'")
def c7_summary_when_large(spark, sf_dir):
    """An answer above a limit of characters comes as its summary."""
    a = graph.answer(graph.traverse(X.graph(spark, sf_dir), "O:1", 3, "OUTGOING"), characters=200)
    return a["totals"].select(F.lit("nodes" not in a and "note" in a).alias("summarised"), F.col("total_connections").alias("total")).join(a["files"].agg(F.count("*").alias("files")))


@query(f"{_FOUND}, r AS (SELECT id, array_to_string(used, '/') AS path, row_number() OVER (ORDER BY depth, id, array_to_string(used, '/')) AS k FROM found WHERE id <> 'O:1') SELECT id, path FROM r WHERE k > 4")
def c1_paths_skipped(spark, sf_dir):
    """All but the first four rows of an answer."""
    return graph.traverse(X.graph(spark, sf_dir), "O:1", 3, "OUTGOING", skip=4).select("id", F.concat_ws("/", "path_edges").alias("path"))


@query("""WITH f AS (SELECT 'F' || page_id AS id, '/r/' || page_id || '/f' || page_id || '.ts' AS path FROM pages), a AS (SELECT id, path FROM f WHERE path = '/r/1/f1.ts'), b AS (SELECT id, path FROM f WHERE path LIKE '%1.ts' ORDER BY path, id LIMIT 5)
SELECT 'exact' AS what, id FROM a UNION ALL SELECT 'ending', id FROM b""")
def c3_find_start(spark, sf_dir):
    """A path that is there wins over those that end so; an ending finds up to five."""
    k = F.col("page_id").cast("string")
    n = X.table(spark, sf_dir, "pages").select(_text("F", k).alias("id"), _text("f", k, ".ts").alias("name"), _text("/r/", k, "/f", k, ".ts").alias("filePath"), F.array(F.lit("SourceFile")).alias("labels"))
    return graph.find_start(n, "/r/1/f1.ts").select(F.lit("exact").alias("what"), "id").union(graph.find_start(n, "1.ts").select(F.lit("ending"), "id"))


@query(f"""{_GRAPH}, flat AS (SELECT unnest([coreType, 'GraphNode']) AS label, * FROM nodes), tenth AS (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= 10),
keys AS (SELECT label, unnest(list_filter(['coreType', 'filePath', 'id', 'isExported', 'name', 'projectId', CASE WHEN semanticType IS NOT NULL THEN 'semanticType' END, 'startLine', 'visibility'], lambda x: x IS NOT NULL)) AS k FROM tenth)
SELECT f.label, n, properties FROM (SELECT label, count(*) AS n FROM flat GROUP BY 1) f JOIN (SELECT label, array_to_string(list_sort(list(DISTINCT k)), ',') AS properties FROM keys GROUP BY 1) k ON f.label = k.label""")
def n6_node_types_sampled(spark, sf_dir):
    """And a4 as it is by default: property keys of ten nodes a label, the first by id."""
    return graph.node_types(X.graph(spark, sf_dir).nodes).select("label", "n", F.concat_ws(",", "properties").alias("properties"))


@query(f"{_GRAPH} SELECT count(*) AS nodes, (SELECT count(*) FROM edges WHERE type = 'PLACED_BY') AS edges FROM nodes WHERE coreType IN ('Order', 'Customer')")
def f1_project(spark, sf_dir):
    """Orders and customers as a project of their own: edges that leave it are not its."""
    g = X.graph(spark, sf_dir)
    mine = F.when(F.col("coreType").isin("Order", "Customer"), "mine").otherwise("else")
    e = g.edges.withColumn("projectId", F.when(F.col("type").isin("PLACED_BY", "IN_NATION"), "mine").otherwise("else"))
    p = graph.PropertyGraph(g.nodes.withColumn("projectId", mine), e).of_project("mine")
    return p.nodes.agg(F.count("*").alias("nodes")).join(p.edges.agg(F.count("*").alias("edges")))


@query("SELECT p_brand AS brand, '/w/' || p_brand AS root, count(*) AS n, min(p_partkey || '/f.ts') AS first FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def f20_roots(spark, sf_dir):
    """The folders that the files of a brand share, and paths below them."""
    p = X.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), _text("/w/", F.col("p_brand"), "/", F.col("p_partkey"), "/f.ts").alias("path"))
    parts = F.split("path", "/")
    ends = p.groupBy("brand").agg(F.min(parts).alias("low"), F.max(parts).alias("high"), F.count("*").alias("n")).where("n > 1")
    root = ends.select("brand", T.common_root(F.array(F.array_join("low", "/"), F.array_join("high", "/"))).alias("root"), "n")
    return p.join(root, "brand").groupBy("brand", "root", "n").agg(F.min(T.relative_to(F.col("path"), F.col("root"))).alias("first"))


# ---------------------------------------------------------------- impact, duplicates

_TYPES = ["EXTENDS", "IMPLEMENTS", "CALLS", "HAS_MEMBER", "TYPED_AS", "IMPORTS", "EXPORTS", "OTHER"]


@query("""WITH e AS (SELECT ['EXTENDS', 'IMPLEMENTS', 'CALLS', 'HAS_MEMBER', 'TYPED_AS', 'IMPORTS', 'EXPORTS', 'OTHER'][l_orderkey % 8 + 1] AS type, l_discount AS w FROM lineitem)
SELECT type, round(avg(CASE type WHEN 'EXTENDS' THEN 0.95 WHEN 'IMPLEMENTS' THEN 0.95 WHEN 'CALLS' THEN 0.2 WHEN 'HAS_MEMBER' THEN 0.65 WHEN 'TYPED_AS' THEN 0.6 WHEN 'IMPORTS' THEN 0.5 WHEN 'EXPORTS' THEN 0.5 ELSE CAST(w AS DOUBLE) END), 6) AS weight FROM e GROUP BY 1""")
def i8_weights(spark, sf_dir):
    """Weights of the table, of an override, and of the edge where there is none."""
    e = X.table(spark, sf_dir, "lineitem").select(F.get(F.array(*[F.lit(t) for t in _TYPES]), (F.col("l_orderkey") % 8).cast("int")).alias("type"), F.col("l_discount").cast("double").alias("weight"))
    return e.groupBy("type").agg(F.round(F.avg(impact.weight_of(overrides={"CALLS": 0.2})), 6).alias("weight"))


@query("SELECT h AS hash, n, CASE WHEN n_sources > 1 THEN 'Duplicated across apps (' || array_to_string(apps[1:3], ', ') || '): consider a shared package' WHEN n = 1 THEN 'Move what ' || who || ' share into one method' ELSE 'Move ' || who || ' into a shared function' END AS recommendation FROM (SELECT sha256(t) AS h, count(*) AS n, count(DISTINCT source) AS n_sources, list_sort(list(DISTINCT source)) AS apps, array_to_string(list_sort(list(DISTINCT 'doc' || doc_id))[1:3], ', ') AS who FROM (SELECT doc_id, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) WHERE length(t) > 0 GROUP BY 1 HAVING count(*) >= 2)".replace("\\\\", "\\"))
def o8_recommendations(spark, sf_dir):
    """What a report says of each group, by its first three names and apps."""
    g = duplicates.structural_groups(duplicates.structural_items(_code_nodes(spark, sf_dir)))
    return g.select(F.col("normalizedHash").alias("hash"), F.col("n_items").alias("n"), "recommendation")


# ---------------------------------------------------------------- tasks

_STATES8 = "['available', 'claimed', 'in_progress', 'blocked', 'needs_review', 'completed', 'failed', 'cancelled']"
_WORKING = f"WITH w AS (SELECT 't' || o_orderkey AS id, {_STATES8}[o_orderkey % 8 + 1] AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'a1' ELSE 'a2' END AS who, o_orderkey % 5 <> 0 AS retryable, o_orderkey % 4 AS k, epoch_us(o_orderdate) AS seen FROM orders)"


def _working(spark, sf_dir):
    """Orders as tasks in every state, claimed by two agents."""
    o, k = X.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.get(F.array(*[F.lit(s) for s in tasks.STATUSES]), (k % 8).cast("int"))
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return o.select(_text("t", k).alias("id"), status.alias("status"), F.when(k % 3 == 0, "a1").otherwise("a2").alias("claimedBy"), (k % 5 != 0).alias("retryable"), (k % 4).alias("retryCount"), (k % 4).alias("abandonCount"), at.alias("updatedAt"))


def _steps():
    own = ("start", "release", "abandon", "complete", "fail", "request_review")
    rows = [f"('{a}', '{b}', '{after}', {a in own}, {a == 'retry'}, {a in ('retry', 'abandon')})" for a, (before, after) in tasks.TRANSITIONS.items() for b in before]
    return f"s(action, before, after, own, retries, counts) AS (VALUES {', '.join(rows)})"


@query(f"{_WORKING}, {_steps()} SELECT action, id, after AS status, CASE WHEN after = 'available' THEN NULL ELSE 'a1' END AS claimed, seen AS guard, CASE WHEN counts THEN k + 1 END AS n FROM w JOIN s ON w.status = s.before WHERE (NOT own OR who = 'a1') AND (NOT retries OR retryable)")
def t7_transitions(spark, sf_dir):
    """And t5: every step that the tasks may take, by an agent that holds a third of them."""
    w, out = cut(_working(spark, sf_dir)), None
    for action in tasks.TRANSITIONS:
        moved = tasks.advance(w, action, w, "a1", 7)
        n = F.col("abandonCount") if action == "abandon" else F.col("retryCount") if action == "retry" else F.lit(None)
        row = moved.select(F.lit(action).alias("action"), "id", "status", F.col("claimedBy").alias("claimed"), "guard", n.cast("long").alias("n"))
        out = row if out is None else out.union(row)
    return out


_POSTED = f"""{_GRAPH}, t AS (SELECT 't' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'available' END AS status FROM orders), new AS (SELECT p_partkey AS k FROM part),
near AS (SELECT '/' || n_nationkey || '/Customer' AS path, n.id, row_number() OVER (PARTITION BY n_nationkey ORDER BY n."startLine", n.id) AS r FROM nation JOIN nodes n ON n."filePath" = '/nation/' || n_nationkey || '/Customer'),
g AS (SELECT k, n.id AS target FROM new JOIN nodes n ON n.id = 'O:' || k WHERE k % 2 = 0 UNION ALL SELECT k, near.id FROM new JOIN near ON near.path = '/' || (k % 25) || '/Customer' AND r <= 20 WHERE k % 2 = 1)"""


def _posted(spark, sf_dir):
    """A new task a part: every second one names an order and a node that is not there, the others the customers of a nation by file."""
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    new = X.table(spark, sf_dir, "part").select(
        _text("n", k).alias("id"), F.lit("w").alias("swarmId"), F.lit("x").alias("title"), F.lit("x").alias("description"), F.lit("fix").alias("type"), F.when(k % 3 == 0, "high").otherwise("normal").alias("priority"),
        F.when(k % 2 == 0, F.array(_text("O:", k), F.lit("gone"))).otherwise(none).alias("targetNodeIds"), F.array(_text("/", k % 25, "/Customer")).alias("targetFilePaths"), F.array(_text("t", k), F.lit("t-1")).alias("dependencies"), F.lit("a").alias("createdBy"))
    o = X.table(spark, sf_dir, "orders").select(_text("t", F.col("o_orderkey")).alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("available").alias("status"))
    return tasks.post(o, new, X.graph(spark, sf_dir).nodes, 5)


@query(f"{_POSTED} SELECT 'n' || k AS id, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.id = 't' || k AND t.status <> 'completed') THEN 'blocked' ELSE 'available' END AS status, CAST(CASE WHEN k % 3 = 0 THEN 75 ELSE 50 END AS INT) AS score FROM new")
def t1_posted_tasks(spark, sf_dir):
    return _posted(spark, sf_dir)[0].select("id", "status", F.col("priorityScore").alias("score"))


@query(f"{_POSTED} SELECT 'n' || k AS task, target FROM g")
def t1_posted_targets(spark, sf_dir):
    return _posted(spark, sf_dir)[1].select(F.col("taskId").alias("task"), F.col("nodeId").alias("target"))


@query(f"{_WORK} SELECT t.id, (SELECT string_agg(o.id || ':' || o.status, ',' ORDER BY o.id) FROM depends d JOIN tasks o ON o.id = d.dependsOn WHERE d.taskId = t.id) AS waits, (SELECT string_agg(o.id || ':' || o.status, ',' ORDER BY o.id) FROM depends d JOIN tasks o ON o.id = d.taskId WHERE d.dependsOn = t.id) AS blocks FROM tasks t")
def t9_detail(spark, sf_dir):
    t = X.tasks(spark, sf_dir)
    shown = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["id"], x["status"])), ","))
    return tasks.detail(t, X.depends(spark, sf_dir), t).select("id", shown("dependencies").alias("waits"), shown("blockedTasks").alias("blocks"))


@query(f"{_WORK}, p AS (SELECT 1 FROM tasks WHERE status = 'available' ORDER BY \"priorityScore\" DESC, \"createdAt\", id LIMIT 20) SELECT count(*) AS returned, count(*) >= 20 AS \"hasMore\" FROM p")
def o7_has_more(spark, sf_dir):
    page = tasks.listing(X.tasks(spark, sf_dir), X.depends(spark, sf_dir), limit=20, status=["available"])
    return tasks.page_info(page, 20)


@query(f"{_WORK} SELECT id FROM tasks WHERE id IN ('t1', 't2', 't3') AND status IN ('available', 'blocked') AND NOT EXISTS (SELECT 1 FROM depends d JOIN tasks o ON o.id = d.dependsOn WHERE d.taskId = tasks.id AND o.status <> 'completed') ORDER BY \"priorityScore\" DESC, \"createdAt\", id LIMIT 1")
def t4_claim_by_id(spark, sf_dir):
    return tasks.claim_next(X.tasks(spark, sf_dir), X.depends(spark, sf_dir), id=["t1", "t2", "t3"]).select("id")


@query(f"{_WORK} SELECT d.taskId AS \"taskId\", d.dependsOn AS \"dependsOn\", o.status FROM depends d JOIN tasks o ON o.id = d.dependsOn")
def t11_dependency_graph(spark, sf_dir):
    return tasks.dependency_graph(X.tasks(spark, sf_dir), X.depends(spark, sf_dir))[1]


_LEVELS = "WITH l AS (SELECT 't' || o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS level FROM orders)"


@query(f"{_LEVELS} SELECT id, level, CAST(least(level, 1) AS BIGINT) AS n FROM l")
def t14_levels(spark, sf_dir):
    """Topological levels of all orders, each waiting for the customer's one before it."""
    every = X.table(spark, sf_dir, "orders").select(_text("t", F.col("o_orderkey")).alias("id"))
    return tasks.levels(every, X.depends(spark, sf_dir))


@query(f"{_LEVELS} SELECT id, level, CAST(CASE WHEN level = 0 THEN 0 WHEN level > 1 AND (level - 1) % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM l")
def t14_levels_joints(spark, sf_dir):
    """The same where every fifth order waits for the customer's first one, too: runs between joints."""
    o = X.table(spark, sf_dir, "orders")
    every, chain = o.select(_text("t", F.col("o_orderkey")).alias("id")), X.depends(spark, sf_dir)
    by = W.partitionBy("o_custkey").orderBy("o_orderkey")
    at = o.select(_text("t", F.col("o_orderkey")).alias("taskId"), _text("t", F.first("o_orderkey").over(by)).alias("dependsOn"), (F.row_number().over(by) - 1).alias("k"))
    return tasks.levels(every, chain.unionByName(at.where("k > 1 and (k - 1) % 5 = 0").drop("k")))


_PROGRESS = "WITH w AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'working' WHEN 1 THEN 'idle' ELSE 'completed' END AS s FROM customer WHERE c_custkey % 10 <> 0)"


@query(f"{_PROGRESS} SELECT count(*) FILTER (s = 'working') AS active, count(*) FILTER (s = 'idle') AS idle, CAST(sum(k % 7) AS BIGINT) AS completed, CAST(0 AS BIGINT) AS failed FROM w")
def t17_worker_progress(spark, sf_dir):
    """Workers of two swarms start, report once, and one swarm is cleaned up."""
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    mine, other = c.where("k % 10 != 0").select(_text("w", F.col("k")).alias("workerId")), c.where("k % 10 = 0").select(_text("w", F.col("k")).alias("workerId"))
    rows = tasks.started("s", mine, 1).unionByName(tasks.started("t", other, 1))
    state = F.when(F.col("k") % 3 == 0, "working").when(F.col("k") % 3 == 2, "completed")
    told = c.select(_text("w", F.col("k")).alias("workerId"), state.alias("state"), (F.col("k") % 7).alias("completed"))
    return tasks.swarm_stats(tasks.without_swarm(tasks.progressed(rows, told, 9), "t"), "s")


# ---------------------------------------------------------------- markers, messages, sessions, streams


@query(f"SELECT m.id, m.nodeId AS \"nodeId\", p.p_name AS target_name, p.p_brand AS target_file FROM (SELECT *, {_DECAYED} AS c FROM ({_MARKERS})) m LEFT JOIN part p ON 'k' || p.p_partkey = m.nodeId WHERE c >= 0.1 ORDER BY c DESC, ts DESC, id LIMIT 40")
def j8_sense_targets(spark, sf_dir):
    """Markers with their nodes by the markers' own ids; those of a node that is gone stay."""
    t = X.table(spark, sf_dir, "part").select(_text("k", F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("filePath"))
    return markers.sense(X.markers(spark, sf_dir), NOW, t, 0.1, 40).select("id", "nodeId", "target_name", "target_file")


@query(f"{_MESSAGES} SELECT id, expiresAt AS expires, len(list_filter([reader], lambda x: x IS NOT NULL)) AS readers FROM m UNION ALL SELECT 'x' || n_nationkey, 100 + 14400000, 0 FROM nation")
def m1_sent(spark, sf_dir):
    """A message a nation is sent, with the default time to live."""
    new = X.table(spark, sf_dir, "nation").select(_text("x", F.col("n_nationkey")).alias("id"), F.lit("w").alias("swarmId"), F.lit("u").alias("fromAgentId"), F.lit(None).cast("string").alias("toAgentId"), F.lit("alert").alias("category"))
    got = messages.send(X.messages(spark, sf_dir), new, 100)
    return got.select("id", F.col("expiresAt").cast("long").alias("expires"), F.size("readBy").cast("long").alias("readers"))


@query(f"{_MESSAGES}, d AS (SELECT id FROM m WHERE expiresAt > 5 AND (toAgentId IS NULL OR toAgentId = 'assistant') AND coalesce(reader <> 'assistant', true) ORDER BY list_position(['alert', 'conflict', 'blocked', 'request', 'finding', 'handoff'], category), timestamp DESC, id LIMIT 10) SELECT m.id, concat_ws(',', reader, CASE WHEN m.id IN (SELECT id FROM d) THEN 'assistant' END) AS readers FROM m")
def m4_delivered(spark, sf_dir):
    """What a claim delivers is read; nothing else changes."""
    _, after = messages.delivered(X.messages(spark, sf_dir), "assistant", 5)
    return after.select("id", F.concat_ws(",", "readBy").alias("readers"))


@query(f"{_GRAPH}, b AS (SELECT c_custkey AS k FROM customer) SELECT 'k' || k AS id, CASE WHEN k % 3 > 0 THEN 100 + (k % 3) * 3600000 END AS expires, (SELECT count(*) FROM nodes n WHERE n.id IN ('C:' || k, 'gone')) AS links FROM b")
def k1_saved_notes(spark, sf_dir):
    """A note a customer, about the customer and a node that is gone; a third of them never expires."""
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    new = c.select(_text("k", F.col("k")).alias("id"), F.lit("s").alias("sessionId"), F.lit("x").alias("topic"), F.array(_text("C:", F.col("k")), F.lit("gone")).alias("aboutNodeIds"), (F.col("k") % 3).alias("expiresInHours"))
    empty = spark.createDataFrame([], "id string, sessionId string, topic string, aboutNodeIds array<string>, createdAt long, expiresAt long")
    rows, links = sessions.saved(empty, new, X.graph(spark, sf_dir).nodes, "aboutNodeIds", 100)
    return rows.join(links.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.col("expiresAt").alias("expires"), F.coalesce("n", F.lit(0)).cast("long").alias("links"))


@query(f"{_ROWS} SELECT category, count(*) AS n, CAST(max(createdAt) AS BIGINT) AS latest FROM b WHERE expiresAt IS NULL OR expiresAt > 1 GROUP BY 1")
def k4_live_notes(spark, sf_dir):
    rows = sessions.live(_bookmarks(spark, sf_dir), 1)
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.max("createdAt").cast("long").alias("latest"))


@query("""SELECT count(*) AS n, CASE WHEN count(*) >= 1000 THEN 500 ELSE count(*) END AS kept, (SELECT min(e) FROM (SELECT event_id AS e FROM events ORDER BY ts DESC, lpad(CAST(event_id AS VARCHAR), 9, '0') DESC LIMIT (SELECT CASE WHEN count(*) >= 1000 THEN 500 ELSE count(*) END FROM events))) AS first FROM events""")
def v2_overflow(spark, sf_dir):
    """All events as one batch: of too many the newest are kept."""
    e = X.table(spark, sf_dir, "events").select(F.lit("p").alias("projectId"), F.lit("change").alias("type"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("filePath"), F.col("ts").cast("timestamp").alias("ts"))
    b = stream.debounced(e, "1000 days")
    return b.select("n", F.size("events").cast("long").alias("kept"), F.array_min(F.transform("events", lambda x: x["filePath"].cast("long"))).alias("first"))



# ---------------------------------------------------------------- on the driver: guards, numbers, projects, jobs


@query("""SELECT * FROM (VALUES ('modules', 'NestModule'), ('services', 'NestService'), ('data', 'DTOClass'), ('controllers', 'Controller'), ('repositories', 'DAL,Repository')) t(category, types)""")
def ql1_prompt_categories(spark, sf_dir):
    """The semantic types that a graph has, as a prompt for a model groups them."""
    from .queries import _classes

    found = rules.enhance_both(_classes(spark, sf_dir)).where("semanticType is not null").select("semanticType").distinct()
    types = sorted(r.semanticType for r in found.collect())
    said = nlquery.prompt("which?", [], [], types)
    rows = [(k, ",".join(v)) for k, v in nlquery.categorised(types).items() if f"- {k}: {', '.join(v)}" in said]
    return spark.createDataFrame(rows, "category string, types string")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE CAST(n_nationkey AS VARCHAR) END AS key FROM nation")
def ql2_json_of_replies(spark, sf_dir):
    """Replies that are JSON, hold it in a fence or among other words, or don't."""
    rows = []
    for r in X.table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect():
        text = f'{{"key": "{r.n_nationkey}", "x": "}}{{"}}'
        try:
            got = nlquery.extract_json([text, f"so:\n```json\n{text}\n```", f"see {{this}} {text} there", "none {"][r.n_nationkey % 4])["key"]
        except ValueError:
            got = None
        rows.append((r.n_name, got))
    return spark.createDataFrame(rows, "name string, key string")


@query("SELECT CASE n_nationkey % 2 WHEN 0 THEN 'Class' ELSE 'ClassDeclaration' END AS label, n_nationkey % 2 = 0 AS fine, n_nationkey % 3 <> 0 AS filtered, CAST(n_nationkey AS BIGINT) AS k FROM nation")
def ql4_guards(spark, sf_dir):
    """Texts of generated queries: labels that the graph doesn't have, and reads that don't name the project, are refused."""

    def passes(check, *args):
        try:
            check(*args)
        except ValueError:
            return False
        return True

    rows = []
    for r in X.table(spark, sf_dir, "nation").select("n_nationkey").collect():
        label = "ClassDeclaration" if r.n_nationkey % 2 else "Class"
        text = f"SELECT 1 FROM nodes WHERE array_contains(labels, '{label}')" + " AND projectId = :projectId" * (r.n_nationkey % 3 != 0)
        rows.append((label, passes(nlquery.label_guard, text, ["Class"]), passes(nlquery.project_guard, text), r.n_nationkey))
    return spark.createDataFrame(rows, "label string, fine boolean, filtered boolean, k long")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(CASE n_nationkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN least(n_nationkey, 10) WHEN 3 THEN 3 ELSE 4 END AS BIGINT) AS n FROM nation")
def f14_numbers(spark, sf_dir):
    """What callers give for a number: nothing, less than zero, too much, no number, a text."""
    rows = [(r.k, T.whole_number([None, -1, r.k, "nan", "4.7"][r.k % 5], 3, 10)) for r in X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).collect()]
    return spark.createDataFrame(rows, "k long, n long")


@query("SELECT 'name' AS given, 'proj_' || substr(sha256((SELECT n_name FROM nation WHERE n_nationkey = 6)), 1, 12) AS found UNION ALL SELECT 'path', 'proj_' || substr(sha256((SELECT n_name FROM nation WHERE n_nationkey = 7)), 1, 12) UNION ALL SELECT 'id', 'proj_0123456789ab' UNION ALL SELECT 'new path', 'proj_' || substr(sha256('/some/where'), 1, 12)")
def l5_projects(spark, sf_dir):
    """A project by its name, its path, its id, and by a path that is not known yet."""
    from .functions import ids
    from .plans.api import Tools

    p = X.table(spark, sf_dir, "nation").select(ids.project_id(F.col("n_name")).alias("projectId"), F.col("n_name").alias("name"), _text("/w/", F.col("n_name")).alias("path"))
    t = Tools(spark, X.graph(spark, sf_dir), projects=p)
    name = {r.n_nationkey: r.n_name for r in X.table(spark, sf_dir, "nation").where("n_nationkey in (6, 7)").collect()}
    given = {"name": name[6], "path": f"/w/{name[7]}", "id": "proj_0123456789ab", "new path": "/some/where"}
    return spark.createDataFrame([(k, t.resolve_project(v)) for k, v in given.items()], "given string, found string")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 100 ELSE floor(100.0 * n_nationkey / 30 + 0.5) END AS BIGINT) AS percent, CAST(25 - (SELECT count(*) FROM nation WHERE n_nationkey % 3 = 0) AS BIGINT) AS running FROM nation")
def l7_parse_jobs(spark, sf_dir):
    """And l6: how far a job a nation is; those that ended go an hour later."""
    from .plans.api import Jobs

    jobs, rows = Jobs(), []
    keys = [r.k for r in X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).collect()]
    for k in keys:
        j = jobs.create("p", "/x", 0)
        jobs.update(j, 1, filesTotal=30, filesProcessed=k, status="completed" if k % 3 == 0 else "running")
        rows.append((k, jobs.percent(j)))
    jobs.purge(4_000_000)
    return spark.createDataFrame([(k, n, len(jobs.rows)) for k, n in rows], "k long, percent long, running long")
