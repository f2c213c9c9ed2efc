"""Files, workspaces, TypeScript, stored graphs, streams, tools and guards."""

import json
import time

import pytest
from pyspark.sql import functions as F

from graphweave.operators import incremental
from graphweave.operators.graph import PropertyGraph
from graphweave.plans import nlquery
from graphweave.plans.api import Jobs, Tools
from graphweave.sources import files, typescript, workspace
from graphweave.streaming import events

SERVICE = """import { Repo } from './user.repository';
import { Injectable } from '@nestjs/common';
export interface Finder extends Base<string> { find(id: string): string; }
@Injectable()
export class UserService extends BaseService implements Finder, Other {
  private count = 0;
  constructor(private readonly repo: UserRepository, @Inject('X') x: Foo<Bar>) { super(); }
  // comment { not a brace
  async find(id: string): Promise<string> {
    const v = await this.repo.load(id);
    helper(v);
    this.touch();
    return new Thing(v).go();
  }
  private touch(): void { this.count++; console.log("x { y"); }
}
export const userRoutes: ModuleRoute[] = [{ a: 1 }];
const hidden = 1;
export function helper(v: string) { return v.trim() + otherHelper(v, 1); }
enum Color { Red }
type X = { a: string };
"""
REPOSITORY = """export class UserRepository { load(id: string) { return fetchAll(id).one; } }
export class BaseService {}
export class Thing { constructor(v: string) { this.init(v, 1, 2); } init(v: string) {} }
export function otherHelper(a: string, b: number) { return a + b + 1; }
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in {
        "src/user.service.ts": SERVICE, "src/user.repository.ts": REPOSITORY, "src/user.spec.ts": "x", "node_modules/a/b.ts": "x", "src/types.d.ts": "x", "src/view.tsx": "export function View() { return helper('a b c d'); }",
        "package.json": json.dumps({"name": "root", "dependencies": {"@nestjs/core": "1"}, "workspaces": ["packages/*", "!packages/no"]}), "packages/ui/package.json": json.dumps({"name": "@s/ui"}),
        "packages/ui-kit/project.json": "{}", "packages/empty/readme": "", "tsconfig.json": "{\n}",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def parsed(spark, tree):
    return typescript.build_graph(files.source_files(spark, tree), "proj_0123456789ab")


def test_source_files(spark, tree):
    got = files.source_files(spark, tree)
    assert sorted(r.path.rsplit("/", 1)[-1] for r in got.collect()) == ["user.repository.ts", "user.service.ts", "view.tsx"]
    t = files.tracked(got).orderBy("filePath").first()
    import hashlib

    assert t.contentHash == hashlib.sha256(REPOSITORY.encode()).hexdigest() and t.size == len(REPOSITORY)


def test_config_files(spark, tree):
    got = {r.filePath: (r.lineCount, r.semanticType) for r in files.config_nodes(spark, tree, "p").collect()}
    assert got["tsconfig.json"] == (2, "ConfigFile") and "packages/ui/package.json" in got
    kinds = {r.path.rsplit("/", 2)[-2]: r.framework for r in files.project_types(spark, tree).collect()}
    assert kinds["ui"] == "vanilla" and "nestjs" in kinds.values()


def test_workspace(spark, tree):
    assert workspace.kind(spark, tree) == "npm" and workspace.patterns(spark, tree, "npm") == ["packages/*", "!packages/no"]
    pk = workspace.packages(spark, tree)
    assert [(r.name, r.path.rsplit("/", 1)[-1]) for r in pk.orderBy("pos").collect()] == [("@s/ui", "ui"), ("ui-kit", "ui-kit")]
    assert [r.name for r in workspace.packages(spark, f"{tree}/packages/ui").collect()] == ["@s/ui"] and workspace.kind(spark, f"{tree}/packages/empty") == "single"
    f = spark.createDataFrame([(f"{tree}/packages/{x}",) for x in ("ui/a.ts", "ui-kit/b.ts", "zz/c.ts")], "filePath string")
    assert {r.filePath.rsplit("/", 1)[-1]: r.packageName for r in workspace.package_of(f, pk).collect()} == {"a.ts": "@s/ui", "b.ts": "ui-kit", "c.ts": None}


def test_typescript_nodes(parsed):
    got = {(r.coreType, r.name): r for r in parsed.nodes.collect()}
    assert got["ClassDeclaration", "UserService"].constructorTypes == ["UserRepository", "Foo"] and got["ClassDeclaration", "UserService"].decorators == ["Injectable"]
    assert got["MethodDeclaration", "find"].parentClassName == "UserService" and got["MethodDeclaration", "touch"].visibility == "private"
    assert (got["MethodDeclaration", "find"].startLine, got["MethodDeclaration", "find"].endLine) == (9, 14)
    assert {"Color", "X", "Finder", "helper", "userRoutes", "View"} <= {n for _, n in got} and ("VariableDeclaration", "hidden") not in got
    assert got["VariableDeclaration", "userRoutes"].isExported is False and got["VariableDeclaration", "userRoutes"].typeAnnotation == "ModuleRoute[]"
    assert got["MethodDeclaration", "find"].normalizedHash and not got["ClassDeclaration", "Thing"].normalizedHash
    import hashlib

    r = got["FunctionDeclaration", "helper"]
    root = next(x.id for (c, _), x in got.items() if c == "SourceFile" and x.name == "user.service.ts")
    assert r.id == "proj_0123456789ab:FunctionDeclaration:" + hashlib.sha256("::".join(["proj_0123456789ab", "FunctionDeclaration", r.filePath, root, "helper"]).encode()).hexdigest()[:16]


def test_typescript_edges(parsed):
    names = parsed.nodes.select("id", "name")
    a, b = names.withColumnsRenamed({"id": "src", "name": "a"}), names.withColumnsRenamed({"id": "dst", "name": "b"})
    got = {(r.type, r.a, r.b): r for r in parsed.edges.join(a, "src").join(b, "dst").collect()}
    for e in [("CALLS", "find", "load"), ("CALLS", "find", "helper"), ("CALLS", "find", "touch"), ("CALLS", "find", "constructor"), ("CALLS", "helper", "otherHelper"), ("CALLS", "View", "helper"), ("EXTENDS", "UserService", "BaseService"), ("IMPLEMENTS", "UserService", "Finder"), ("IMPORTS", "user.service.ts", "user.repository.ts"), ("HAS_PARAMETER", "helper", "v"), ("DECORATED_WITH", "UserService", "Injectable")]:
        assert e in got, e
    assert got["CALLS", "find", "load"].confidence == 0.9 and got["CALLS", "find", "helper"].confidence == 0.7
    assert not any(t == "CALLS" and y in ("log", "trim") for t, _, y in got)


SHAPES = """declare function outside(a: string): void;
function over(a: string): string;
function over(a: number): string
function over(a: any): string { return inner(a, 1, 2); }
export class Between<T = {}> extends Base<{ x: string }> implements Able<{ y: () => void }> {
  abstract nothing(): void;
  twice(a: string): { b: string };
  twice(a: any): { b: string } | undefined { return fromMethod(a, "{"); }
  arrow(cb: (x: number) => { y: 1 }): (z: string) => { w: 2 } { return later(cb, 22); }
  literal(): 'a' | "b" { return pickOne('a', 'b', 3); }
  check(x: unknown): x is { k: string } { return isThere(x, 'k') }
  generic<K extends { id: string }, V = Map<K, () => void>>(k: K): Promise<Array<{ v: V }>>
  {
    return made(k, 1, 2);
  }
}
function wrapped<T extends (a: string) => { c: T }>(v: T): { b: string /* } */ } { return afterType(v, 'it'); }
function last(): asserts x is string { return finalCall(1, 2, 3); }
"""


def test_declarations_end_where_they_end(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/shapes.ts").write_text(SHAPES)
    rows = typescript.File("/shapes.ts", SHAPES, "p").parse()
    made = [(r["coreType"], r["name"], r["sourceCode"]) for r in rows if r["kind"] == "node"]
    text = {}
    for core, name, code in made:
        text.setdefault((core, name), []).append(code)
    assert text["FunctionDeclaration", "outside"] == ["declare function outside(a: string): void;"]
    assert text["FunctionDeclaration", "over"] == ["function over(a: string): string;", "function over(a: number): string", "function over(a: any): string { return inner(a, 1, 2); }"]
    assert text["FunctionDeclaration", "wrapped"][0].endswith("return afterType(v, 'it'); }") and text["FunctionDeclaration", "last"][0].endswith("}")
    assert text["ClassDeclaration", "Between"][0].startswith("export class Between") and text["ClassDeclaration", "Between"][0].endswith(" }\n}")
    assert [(r["startLine"], r["endLine"]) for r in rows if r["kind"] == "node" and r["name"] == "Between"] == [(5, 16)]
    assert text["MethodDeclaration", "nothing"] == ["abstract nothing(): void;"] and text["MethodDeclaration", "twice"][0] == "twice(a: string): { b: string };"
    assert all(text["MethodDeclaration", m][-1].endswith("}") for m in ("twice", "arrow", "literal", "check", "generic"))
    names = {r["id"]: r["name"] for r in rows if r["kind"] == "node"}
    calls = sorted((names[r["src"]], r["targetName"]) for r in rows if r["kind"] == "deferred" and r["edgeType"] == "CALLS")
    assert calls == sorted([("over", "inner"), ("twice", "fromMethod"), ("arrow", "later"), ("literal", "pickOne"), ("check", "isThere"), ("generic", "made"), ("wrapped", "afterType"), ("last", "finalCall")])
    bases = {(r["edgeType"], r["targetName"]) for r in rows if r["kind"] == "deferred" and r["edgeType"] in ("EXTENDS", "IMPLEMENTS")}
    assert bases == {("EXTENDS", "Base"), ("IMPLEMENTS", "Able")}


def test_odd_sources_do_not_break_the_parser():
    for code in ("", "}", "class {", "class A {", "export class A { x(", "function f(", "`unclosed", "/* open", "class A { @D( } }", "export const a = {", "import 'x'", "\x00﻿" * 50, "class A { get [x]() {} #p = 1; *g() {} static { } }", "((((" * 2000):
        typescript.File("/x.ts", code, "p").parse()


def test_files_of_one_partition_are_parsed_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from graphweave.sources import typescript

    code = "@Injectable()\nexport class K {\n  constructor(@Inject('T') a: Other) {}\n}\n"
    files = spark.range(0, 300, 1, 1).select(F.concat(F.lit("/src/f"), "id", F.lit(".ts")).alias("path"), F.when(F.col("id") < 299, F.lit(code)).otherwise("").cast("binary").alias("content"))
    rows = typescript.parse_files(files, "p")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    assert rows.where("coreType = 'SourceFile'").select("filePath").distinct().count() == 300
    k = rows.where("coreType = 'ClassDeclaration'")
    assert k.count() == 299
    r = k.first()
    assert (r.decorators, r.decoratorArgs, r.injectTokens, r.constructorTypes, r.isExported, r.visibility) == (["Injectable"], {"Injectable": []}, {0: "T"}, ["Other"], True, None)
    assert typescript.parse_files(files.limit(0), "p").isEmpty()


def test_common_root_of_many_paths(spark):
    import time

    from pyspark.sql import functions as F

    from graphweave.functions import text as T

    cases = [(["/a/b/c", "/a/b/d"], "/a/b"), (["/a/b", "/a/bc"], "/a"), (["/a/b/c", "/a/b"], "/a/b"), (["a/b-c/d", "a/b/d", "a/b/e"], "a"), (["x", "y"], ""), (["/a", None], ""), ([None, "/a"], None), ([], None)]
    got = spark.createDataFrame(list(enumerate(cases)), "i int, c struct<p:array<string>,want:string>").select("c.want", T.common_root(F.col("c.p")).alias("root"))
    assert [r for r in got.collect() if r.want != r.root] == []
    paths = spark.range(20000).select(F.concat(F.lit("/w/x/"), "id", F.lit("/f.ts")).alias("p")).agg(F.collect_list("p").alias("p"))
    start = time.time()
    assert paths.select(T.common_root(F.col("p")).alias("r")).first().r == "/w/x"
    assert time.time() - start < 30  # paths against paths: minutes


def test_nodes_once_where_ids_repeat(spark):
    from graphweave.sources import typescript

    code = b"export class K {\n  run(a: string): void;\n  run(a: string): void { return helper(a, 1, 2); }\n}\n"
    files = [("/src/a.ts", bytearray(code)), ("/src/b.ts", bytearray(code))]
    for twice in (False, True):
        g = typescript.build_graph(spark.createDataFrame(files + files[:1] * twice, "path string, content binary"), "p")
        nodes = g.nodes.select("id", "name", "startLine").collect()
        assert len({n.id for n in nodes}) == len(nodes)
        assert sorted(n.startLine for n in nodes if n.name == "run") == [3, 3]
        assert "isLast" not in g.nodes.columns
        plan = g.nodes.select("id", "sourceCode")._jdf.queryExecution().optimizedPlan().toString()
        assert ("Aggregate" in plan) == twice


def test_stored_graph(spark, parsed, tmp_path):
    given, stored = files.write_graph(parsed, str(tmp_path / "g"))
    assert given == stored == parsed.edges.count()
    back = files.read_graph(spark, str(tmp_path / "g"), "proj_0123456789ab")
    assert back.nodes.count() == parsed.nodes.count() and back.edges.where("type = 'CALLS'").count() == parsed.edges.where("type = 'CALLS'").count()
    assert "PartitionFilters: [isnotnull(projectId" in back.nodes._jdf.queryExecution().toString()
    files.clear_project(spark, str(tmp_path / "g"), "proj_0123456789ab")
    assert not (tmp_path / "g/nodes/projectId=proj_0123456789ab").exists()
    with pytest.raises(Exception, match="nodes"):
        files.clear_all(spark, str(tmp_path / "g"))
        files.read_graph(spark, str(tmp_path / "g"))


def full_graph():
    """A document with every field that nodes and edges can have."""
    node = {"id": "p:Class:1", "projectId": "p", "name": "n", "coreType": "ClassDeclaration", "semanticType": "Service", "filePath": "/a.ts", "packageName": "@s/a", "isExported": True, "visibility": "public", "startLine": 1, "endLine": 2}
    node |= {"sourceCode": "class n {}", "createdAt": "2024-01-01", "contentHash": "c", "mtime": 1.5, "size": 10, "parentClassName": "x", "typeAnnotation": "T", "normalizedHash": "h", "context": {"routes": [{"path": "/x"}], "n": 1}}
    edge = {"coreType": "CALLS", "projectId": "p", "semanticType": "S", "source": "ast", "confidence": 0.9, "relationshipWeight": 0.85, "filePath": "/a.ts", "createdAt": "2024-01-01", "lineNumber": 3, "context": {"a": {"b": 1}}}
    nodes = [{"id": node["id"], "labels": ["Class"], "properties": node, "skipEmbedding": True}, {"id": "p:Class:2", "labels": ["Class", "TypeScript"], "properties": {k: node[k] for k in ("projectId", "name", "coreType", "filePath")} | {"id": "p:Class:2"}}]
    return {"nodes": nodes, "edges": [{"id": "e", "type": "CALLS", "startNodeId": "p:Class:1", "endNodeId": "p:Class:2", "properties": edge}], "metadata": {"totalNodes": 2}}


def test_json_graphs_round_trip(spark, tmp_path):
    from graphweave.operators import graph

    (tmp_path / "g.json").write_text(json.dumps(full_graph()))
    g = files.read_graph_json(spark, str(tmp_path / "g.json"))
    one = g.nodes.where("id = 'p:Class:1'").first()
    assert one.name == "n" and one.mtime == 1.5 and json.loads(one.context) == {"routes": [{"path": "/x"}], "n": 1} and g.nodes.columns.count("id") == 1
    e = g.edges.first()
    assert (e.edge_id, e.type, e.src, e.dst, e.relationshipWeight, e.lineNumber) == ("e", "CALLS", "p:Class:1", "p:Class:2", 0.85, 3)
    assert [r.id for r in graph.traverse(g, "p:Class:1", 2, "OUTGOING").collect()] == ["p:Class:2"]
    same = lambda a, b: sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))
    files.write_json(g, str(tmp_path / "lines"))
    files.write_json_document(g, str(tmp_path / "doc"))
    (text,) = [p for p in (tmp_path / "doc").iterdir() if p.name.startswith("part")]
    doc = json.loads(text.read_text())
    assert {n["properties"]["id"] for n in doc["nodes"]} == {"p:Class:1", "p:Class:2"} and doc["metadata"]["totalEdges"] == 1
    for back in (files.read_graph_json(spark, str(tmp_path / "lines")), files.read_graph_json(spark, str(text))):
        assert same(g.nodes.drop("skipEmbedding"), back.nodes) and same(g.edges, back.edges)
    files.write_json_document(PropertyGraph(g.nodes.limit(0), g.edges.limit(0)), str(tmp_path / "none"))
    (text,) = [p for p in (tmp_path / "none").iterdir() if p.name.startswith("part")]
    assert json.loads(text.read_text()) == {"nodes": [], "edges": [], "metadata": {"totalNodes": 0, "sourceFiles": 0, "totalEdges": 0}}


def test_chunks_keep_edges_between_them(spark, parsed, tmp_path):
    one, two = (PropertyGraph(parsed.nodes.where(x), parsed.edges.join(parsed.nodes.where(x).select("id"), F.col("src") == F.col("id"), "left_semi")) for x in ("filePath like '%service%'", "filePath not like '%service%'"))
    parts, given, stored = files.import_chunks([one, two], str(tmp_path / "g"))
    assert parts == 2 and given == stored == parsed.edges.count()
    assert files.read_graph(spark, str(tmp_path / "g")).edges.count() == stored and files.import_chunks([], str(tmp_path / "x")) == (0, 0, 0)


def test_incremental_after_a_change(spark, tree, parsed):
    stored = files.tracked(files.source_files(spark, tree))
    changed = stored.withColumn("contentHash", F.when(F.col("filePath").endswith("view.tsx"), "x").otherwise(F.col("contentHash")))
    assert [r.change for r in incremental.changes(stored, changed).collect()] == ["changed"]


def test_debounced_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [("p", "change", "/a.ts", "2024-01-01T00:00:00"), ("p", "unlink", "/a.ts", "2024-01-01T00:00:00.5"), ("p", "add", "/b.tsx", "2024-01-01T00:00:01"), ("p", "add", "/c.js", "2024-01-01T00:00:01"), ("p", "add", "/d.ts", "2024-01-01T00:00:09"), ("p", "add", "/e.ts", "2024-01-01T01:00:00")]
    (folder / "1.json").write_text("\n".join(json.dumps(dict(zip(("projectId", "type", "filePath", "ts"), r))) for r in rows))
    seen, w = [], events.Watchers(1)
    q = w.start(spark, "p", str(folder), str(tmp_path / "cp"), lambda df, i: seen.extend(map(tuple, df.collect())))
    for _ in range(60):
        q.processAllAvailable()
        if len(seen) >= 3:
            break
        time.sleep(0.5)
    with pytest.raises(RuntimeError):
        w.start(spark, "other", str(folder), str(tmp_path / "cp2"), print)
    assert w.list()[0]["status"] == "active" and w.stop("p") and not w.stop("p")
    assert sorted(seen) == [("p", "/a.ts", "deleted"), ("p", "/b.tsx", "changed"), ("p", "/d.ts", "changed")]


def test_overflowing_batch_keeps_the_newest(spark):
    df = spark.range(1200).select(F.lit("p").alias("projectId"), F.lit("change").alias("type"), F.format_string("/%d.ts", "id").alias("filePath"), F.timestamp_millis(F.col("id") * 10).alias("ts"))
    r = events.debounced(df).first()
    assert r.n == 1200 and len(r.events) == 500 and r.events[0].filePath == "/700.ts"


def test_json_out_of_a_reply():
    assert nlquery.extract_json('{"a": 1}') == {"a": 1}
    assert nlquery.extract_json('so:\n```json\n{"a": "}"}\n```') == {"a": "}"}
    assert nlquery.extract_json('see {not} and {"a": {"b": "\\"{"}} end') == {"a": {"b": '"{'}}
    with pytest.raises(ValueError):
        nlquery.extract_json("none")


def test_guards(spark, parsed):
    with pytest.raises(ValueError):
        nlquery.project_guard("SELECT * FROM nodes")
    assert nlquery.project_guard("SELECT * FROM nodes JOIN edges WHERE projectId = :projectId") == ["1 filters by project for 2 reads"]
    with pytest.raises(ValueError, match="use Class"):
        nlquery.label_guard("SELECT 1 FROM nodes WHERE array_contains(labels, 'ClassDeclaration')", ["Class"])
    reply = json.dumps({"sql": "SELECT name FROM nodes WHERE projectId = :projectId AND array_contains(labels, 'Class') ORDER BY name"})
    got = nlquery.ask("classes?", lambda p: reply, spark, "proj_0123456789ab", ["Class"], ["CALLS"], ["NestService", "odd"], {"nodes": parsed.nodes, "edges": parsed.edges})
    assert [r.name for r in got.collect()] == ["BaseService", "Thing", "UserRepository", "UserService"]
    with pytest.raises(ValueError):
        nlquery.run(spark, '{"sql": "DROP TABLE x"}', "p", [], {})


def test_generated_queries_see_one_project(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "p", "one"), ("b", "p", "two"), ("c", "other", "three")], "id string, projectId string, name string")
    edges = spark.createDataFrame([("a", "b", "p"), ("c", "c", "other")], "src string, dst string, projectId string")
    ask = lambda sql: nlquery.run(spark, json.dumps({"sql": sql}), "p", [], {"nodes": nodes, "edges": edges}).collect()
    mine = ":projectId = :projectId"
    assert ask(f"SELECT count(*) AS n FROM nodes WHERE {mine}")[0].n == 2
    assert ask(f"SELECT n.name FROM nodes n WHERE n.projectId = :projectId ORDER BY n.name")[1].name == "two"
    assert ask(f"SELECT m.name FROM nodes AS n JOIN edges AS e ON e.src = n.id JOIN nodes m ON m.id = e.dst WHERE {mine};")[0].name == "two"
    assert ask(f"SELECT count(*) AS n FROM nodes n, edges e WHERE {mine}")[0].n == 2
    assert ask(f"SELECT nodes.name FROM nodes WHERE nodes.id IN (SELECT dst FROM edges) AND {mine}")[0].name == "two"
    assert ask(f"WITH x AS (SELECT * FROM nodes n) SELECT count(*) AS n FROM x WHERE {mine}")[0].n == 2
    assert ask(f"SELECT (SELECT max(name) FROM nodes) AS m, '{{brace}}' AS b WHERE {mine}")[0].m == "two"
    nodes.write.parquet(str(tmp_path / "t"))
    nodes.createOrReplaceTempView("everything")
    for sql in (f"SELECT * FROM everything WHERE {mine}", f"SELECT * FROM parquet.`{tmp_path}/t` WHERE {mine}", f"SELECT * FROM nodes WHERE id IN (SELECT id FROM everything) AND {mine}", f"WITH everything AS (SELECT * FROM everything) SELECT * FROM everything WHERE {mine}", f"SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM nodes WHERE {mine}"):
        with pytest.raises(ValueError):
            ask(sql)


def test_tools(spark, parsed):
    projects = spark.createDataFrame([("proj_0123456789ab", "mine", "/w/mine", 1)], "projectId string, name string, path string, updatedAt long")
    t = Tools(spark, PropertyGraph(parsed.nodes, parsed.edges), projects=projects)
    assert t.resolve_project(None) == t.resolve_project("mine") == "proj_0123456789ab" and t.resolve_project("/new/path").startswith("proj_")
    with pytest.raises(ValueError):
        t.resolve_project("unknown")
    repo = parsed.nodes.where("name = 'UserRepository'").first().id
    assert t.traverse_from_node(repo, depth=1).count() >= 2 and t.traverse_from_node(repo, depth=2, weighted=True).count() >= 2
    assert t.impact_analysis(repo)["risk"].first().n_direct >= 1
    assert t.detect_dead_code()["stats"].first().total >= 1
    assert t.detect_duplicate_code(kind="structural")["structural"].count() >= 0
    jobs = Jobs(most=1)
    j = jobs.create("p", "/x", 0)
    jobs.update(j, 1, filesTotal=3, filesProcessed=1)
    assert jobs.percent(j) == 33
    with pytest.raises(RuntimeError):
        jobs.create("p", "/x", 2)
    jobs.update(j, 3, status="completed")
    assert jobs.percent(j) == 100 and jobs.create("p", "/x", 4_000_000)


def test_more_tools(spark, tree, tmp_path):
    projects = spark.createDataFrame([("proj_0123456789ab", "mine", tree, 1)], "projectId string, name string, path string, updatedAt long")
    work = spark.createDataFrame([("t1", "s", "available", 50, 1, 1, None), ("t2", "s", "completed", 50, 1, 1, "a")], "id string, swarmId string, status string, priorityScore int, createdAt long, updatedAt long, claimedBy string")
    told = spark.createDataFrame([("m1", "s", "b", None, "alert", 1, 99, [])], "id string, swarmId string, fromAgentId string, toAgentId string, category string, timestamp long, expiresAt long, readBy array<string>")
    none = PropertyGraph(spark.createDataFrame([], "id string, projectId string"), spark.createDataFrame([], "src string, dst string, projectId string"))
    notes = spark.createDataFrame([], "id string, sessionId string, agentId string, topic string, content string, category string, severity string, aboutNodeIds array<string>, createdAt long, expiresAt long")
    marks = spark.createDataFrame([], "id string, sessionId string, agentId string, summary string, taskContext string, workingSetNodeIds array<string>, findings string, nextSteps string, createdAt long")
    t = Tools(spark, none, projects=projects, tasks=work, depends=spark.createDataFrame([], "taskId string, dependsOn string"), messages=told, notes=notes, bookmarks=marks, store=str(tmp_path / "g"), clock=lambda: 50)
    job = t.parse_typescript_project(tree, "proj_0123456789ab")
    state = t.check_parse_status(job)
    assert state["status"] == "completed" and state["percent"] == 100 and state["filesTotal"] == 3 and state["edges"] == state["edgesGiven"]
    assert t.parse_typescript_project(tree, "proj_0123456789ab") != job and t.graph.nodes.where("coreType = 'SourceFile'").count() == 3
    with pytest.raises(ValueError):
        t.check_parse_status("job_x")
    with pytest.raises(Exception):
        t.parse_typescript_project(str(tmp_path / "missing"))
    assert [r["status"] for r in t.jobs.rows.values()][-1] == "failed"
    t.model = lambda prompt: json.dumps({"sql": "SELECT n.name FROM nodes n WHERE n.projectId = :projectId AND array_contains(n.labels, 'Enum')"}) if "Enum" in prompt else "{}"
    assert [r.name for r in t.natural_language_query("which enums?", "mine").collect()] == ["Color"]
    a = t.traversal_answer(file_path="user.service.ts", depth=2, direction="OUTGOING")
    assert a["nodes"].count() > 3 and a["edges"].count() >= a["nodes"].count() and a["root"].first().projectRoot.startswith("/")
    assert set(t.traversal_answer(file_path="user.service.ts", summary_only=True)) == {"totals", "depths", "files"}
    repo = t.graph.nodes.where("name = 'UserRepository'").first().id
    new = spark.createDataFrame([("t3", "s", "x", "x", "fix", "high", [repo, "gone"], [], ["t1", "no"], "a"), ("t4", "s", "x", "x", "fix", "odd", [], ["user.repository.ts"], ["t2"], "a")], "id string, swarmId string, title string, description string, type string, priority string, targetNodeIds array<string>, targetFilePaths array<string>, dependencies array<string>, createdBy string")
    rows, targets, depends = t.swarm_post_task(new)
    assert {r.id: (r.status, r.priorityScore) for r in rows.collect()} == {"t3": ("blocked", 75), "t4": ("available", 50)}
    assert [r.nodeId for r in targets.where("taskId = 't3'").collect()] == [repo] and 1 < targets.where("taskId = 't4'").count() <= 20 and depends.count() == 2
    got, told = t.swarm_claim_task("me", "s")
    assert got.first().id == "t1" and [r.id for r in told.collect()] == ["m1"] and t.swarm_claim_task("me", "s")[1].count() == 0
    assert t.swarm_task_detail("t3").first().dependencies[0].id == "t1" and t.swarm_release_task("t2", "a").count() == 0
    saved = t.session_save("s1", "me", summary="where we are now", taskContext="c", workingSetNodeIds=[repo, "gone"], topic="x", content="y", category="z", aboutNodeIds=[repo], expiresInHours=1)
    assert saved["bookmark_links"].count() == 1 and saved["note"].first().expiresAt == 50 + 3_600_000 and saved["note"].first().bookmarkId == saved["bookmark"].first().id
    for bad in ({}, {"topic": "x"}, {"workingSetNodeIds": ["a"], "summary": "short", "taskContext": "c"}, {"kind": "note", "topic": "x"}):
        with pytest.raises(ValueError):
            t.session_save("s1", "me", **bad)
    assert t.list_watchers() == [] and t.stop_watch_project("mine") is False


def test_embedded_texts(spark):
    from graphweave.sources.embedding import embedded

    def load():
        import numpy as np

        calls = []

        def model(texts):
            calls.append(len(texts))
            if len(texts) > 4:
                raise MemoryError
            if len(calls) == 3:
                raise ValueError("once")
            return np.array([[len(t), 0.0, float(t == "nan") and float("nan")] for t in texts]) * (texts[0] != "zero")

        return model

    rows = [(i, t) for i, t in enumerate(["a", "bb", None, "", *["c" * k for k in range(1, 9)], "nan"])]
    got = {r.i: r.v for r in spark.createDataFrame(rows, "i long, t string").coalesce(1).select("i", embedded(F.col("t"), load).alias("v")).collect()}
    assert got[2] is None and got[3] is None and got[12] is None and all(got[i] == [1.0, 0.0, 0.0] for i in (0, 1, *range(4, 12)))


def test_numbers_over_partitions(spark):
    from graphweave.storage import numbered

    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("x"), (F.col("id") % 3).alias("y")).repartition(5)
    got = [tuple(r) for r in numbered(rows, [F.col("y").desc(), F.col("x")]).select("y", "x", "index").orderBy("index").collect()]
    assert [g[2] for g in got] == list(range(500)) and [g[:2] for g in got] == sorted((g[:2] for g in got), key=lambda g: (-g[0], g[1]))
    assert numbered(rows.limit(0), ["x"]).columns == ["x", "y", "index"]


def test_graph_of_parsed_files_is_not_broadcast_by_a_guess(spark, sf):
    """Parsed rows take many times the bytes of the table that the sources are made of."""
    import __spark_entry__

    joins = __spark_entry__.queries()["p15_built_edges"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in joins and "SortMergeJoin" in joins
