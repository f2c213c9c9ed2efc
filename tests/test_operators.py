"""Micro-graphs with known answers, and behaviours that are easily got wrong."""

import math

import pytest
from pyspark.sql import functions as F

from graphweave.functions import ids
from graphweave.functions import text as T
from graphweave.operators import deadcode, duplicates, graph, impact, incremental, markers, messages, resolve, rules, search, sessions, tasks
from graphweave.operators.graph import PropertyGraph

NODE = "id string, projectId string, name string, coreType string, semanticType string, labels array<string>, filePath string, isExported boolean, visibility string, startLine int"
EDGE = "edge_id string, type string, src string, dst string, projectId string, relationshipWeight double, lineNumber int"


def node(i, core="ClassDeclaration", file="/a.ts", exported=False, semantic=None, project="p", visibility="public", labels=("Class",), line=1):
    return (i, project, i, core, semantic, list(labels), file, exported, visibility, line)


def make(spark, nodes, edges):
    rows = [(f"e{k}", t, a, b, "p", w, 0) for k, (t, a, b, w) in enumerate(edges)]
    return PropertyGraph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(rows, EDGE))


# ---------------------------------------------------------------- texts and ids


@pytest.mark.parametrize(
    "code, want",
    [
        ('const x = "s" + 1;', "const $VAR_1 = $$VAR_2 + $$VAR_3;"), ('f("a")', "$VAR_1($$VAR_2)"), ("f(1)", "$VAR_1($$VAR_2)"), ("", ""), (None, ""), (" \n\t", ""),
        ("/* x */ let a = 1; // y\n  a++;", "let $VAR_1 = $$VAR_2; $VAR_1++;"), ("x = 0xFF + 1_000n + a1 + $b", "$VAR_1 = $$VAR_2 + $$VAR_2 + $VAR_3 + $$VAR_4"),
        ("`a ${b} // c` + 'd // e'", "$$VAR_1 + $$VAR_1"), ("aäb", "$VAR_1ä$VAR_2"),
    ],
)
def test_normalise(spark, code, want):
    assert T.normalize(code) == want
    got = spark.createDataFrame([(code,)], "c string").select(T.normalized_code(F.col("c")).alias("n"), T.hash_of(T.normalized_code(F.col("c"))).alias("h")).first()
    assert got.n == want and (got.h == "") == (want == "")


def test_metrics(spark):
    code = "function f(a, b, ) {\n  if (x) { g(1); }\n\n}\n"
    m = spark.createDataFrame([(code,), ("",), (None,)], "c string").select(*[v.alias(k) for k, v in T.code_metrics(F.col("c")).items()]).collect()
    assert m[0].asDict() == {"parameterCount": 4, "statementCount": 3, "controlFlowDepth": 2, "lineCount": 3, "tokenCount": 11}
    assert set(m[1].asDict().values()) == {0} == set(m[2].asDict().values())


def test_paths_and_numbers(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    assert one(T.short_path(F.lit("/a/b/c.ts"))) == "b/c.ts" and one(T.short_path(F.lit("c.ts"))) == "c.ts"
    assert one(T.common_root(F.array(F.lit("/a/b/c"), F.lit("/a/b/d"), F.lit("/a/bc")))) == "/a"
    assert one(T.relative_to(F.lit("/a/b/c.ts"), F.lit("/a"))) == "b/c.ts"
    assert one(T.clean_type(F.lit('import("/x").Map<string, A[]>[]'))) == "Map"
    assert one(T.skipped_file(F.lit("/x/dist/a.ts"), ["dist/", "(["])) and not one(T.skipped_file(F.lit("/x/a.ts"), ["dist/", "(["]))
    assert one(T.head_and_tail(F.lit("abcdefghij"), 4, "..")) == "ab..ij"
    assert [T.whole_number(x, 3, 10) for x in (None, "nan", -1, 99, "4.7", float("inf"))] == [3, 3, 3, 10, 4, 3]


def test_identities(spark):
    import hashlib

    want = "p:T:" + hashlib.sha256(b"p::T::/f::parent::n").hexdigest()[:16]
    assert spark.range(1).select(ids.node_id(F.lit("p"), F.lit("T"), F.lit("/f"), F.lit("n"), F.lit("parent")).alias("x")).first().x == want
    assert ids.is_project_id("proj_0123456789ab") and not ids.is_project_id("proj_0123456789AB")
    a, b = (ids.IdFactory(lambda: 1000, 1).make("task") for _ in range(2))
    assert a == b and a.startswith("task_rs_")


# ---------------------------------------------------------------- traversal


def test_paths_use_an_edge_once_and_nodes_again(spark):
    g = make(spark, [node(x) for x in "ABC"], [("R", "A", "B", 1.0), ("R", "B", "C", 1.0), ("R", "C", "A", 1.0)])
    got = sorted((r.id, r.depth) for r in graph.traverse(g, "A", 3, "OUTGOING").collect())
    assert got == [("B", 1), ("C", 2)]  # the way back to the start is no row
    t = impact.transitive(g, g.nodes.where("id = 'A'").select("id"), 3).collect()
    assert sorted((r.id, r.depth) for r in t) == [("A", 3), ("B", 2)]  # but the target is its own dependent


def test_parallel_edges_are_paths_and_one_impact_row(spark):
    g = make(spark, [node("A"), node("B")], [("R", "A", "B", 0.5), ("R", "A", "B", 0.5), ("R", "A", "B", None)])
    assert graph.traverse(g, "A", 1, "OUTGOING").count() == 3
    assert impact.direct(g, g.nodes.where("id = 'B'").select("id")).count() == 1
    assert graph.traverse(g, "A", 1, "OUTGOING", skip=2).count() == 1


def test_nodes_between_may_be_foreign_in_paths_not_in_impact(spark):
    g = make(spark, [node("A"), node("X", project="q"), node("C")], [("R", "A", "X", 1.0), ("R", "X", "C", 1.0)])
    mine = PropertyGraph(g.nodes.where("projectId = 'p'"), g.edges)
    assert [r.id for r in graph.traverse(mine, "A", 2, "OUTGOING").collect()] == ["C"]
    assert impact.transitive(mine, g.nodes.where("id = 'C'").select("id"), 3).count() == 0


def test_beam_takes_the_best_and_breaks_ties_by_id(spark):
    many = [f"n{i:02d}" for i in range(12)]
    g = make(spark, [node("S"), *[node(x) for x in many]], [("R", "S", x, 0.5) for x in reversed(many)])
    got = graph.beam(g, "S", 1, "OUTGOING", 5).collect()
    assert [r.id for r in got] == many[:8] and {r.score for r in got} == {0.25}
    deep = make(spark, [node(x) for x in "SAB"], [("R", "S", "A", 0.5), ("R", "A", "B", None)])
    assert [(r.id, r.score) for r in graph.beam(deep, "S", 3, "BOTH").collect()] == [("A", 0.25), ("B", pytest.approx(0.25 * 0.85))]


def test_types_that_are_not_names_filter_nothing(spark):
    assert graph.valid_types(["bad-name", "x"]) is None and graph.valid_types(["OK", "no"]) == ["OK"]


def test_start_by_path(spark):
    f = ("SourceFile",)
    n = spark.createDataFrame([node("1", file="/x/a.ts", labels=f), node("2", file="/y/a.ts", labels=f), node("3", file="a.ts", labels=f)], NODE)
    assert [r.id for r in graph.find_start(n, "/x/a.ts").collect()] == ["1"]
    assert graph.find_start(n.where("id != '3'"), "a.ts").count() == 2


# ---------------------------------------------------------------- impact, dead code, duplicates


def test_risk_without_dependents_is_zero_and_levels(spark):
    g = make(spark, [node(x) for x in "ABC"], [("CALLS", "B", "A", 0.1), ("EXTENDS", "C", "A", 0.1)])
    t = g.nodes.select("id")
    d = impact.direct(g, t)
    got = {r.target: (r.n_direct, round(r.score, 9), r.level) for r in impact.risk(t, d, impact.transitive(g, t, 2).where("false")).collect()}
    score = min(math.log10(3) / 2, 0.3) + 0.3 * (0.75 + 0.95) / 2
    assert got["A"] == (2, round(score, 9), "MEDIUM") and got["B"] == (0, 0.0, "LOW")
    assert [r.id for r in impact.critical_paths(d).collect()] == ["B", "C"]


def test_dead_code_rules(spark):
    nodes = [
        node("I", "InterfaceDeclaration", "/i.ts", True), node("S", "ClassDeclaration", "/s.ts", True, "NestService"), node("U", "ClassDeclaration", "/u.ts", True), node("F", "FunctionDeclaration", "/f.ts", True),
        node("M", "MethodDeclaration", "/m.ts", visibility="private"), node("E", "ClassDeclaration", "/app.module.ts", True), node("P", "FunctionDeclaration", "/packages/core/src/p.ts", True),
    ]
    g = make(spark, nodes, [("IMPORTS", "F", "U", 1.0), ("CONTAINS", "M", "I", 1.0), ("CALLS", "F", "F", 1.0)])
    found = deadcode.report(deadcode.unreferenced_exports(g.nodes, g.edges), deadcode.uncalled_private_methods(g.nodes, g.edges), deadcode.unreferenced_interfaces(g.nodes, g.edges), deadcode.entry_points(g.nodes))
    got = sorted((r.id, r.confidence, r.category) for r in found.collect())
    # An interface comes up twice; a semantic type or an entry file exempts; a call from the same file is no reference.
    assert got == [("F", "HIGH", "internal-unused"), ("I", "HIGH", "internal-unused"), ("I", "LOW", "internal-unused"), ("M", "MEDIUM", "internal-unused"), ("P", "HIGH", "library-export")]
    s = deadcode.stats(found).first()
    assert (s.high, s.medium, s.low, s.total, s.risk_level) == (3, 1, 1, 5, "LOW")
    assert [r.id for r in deadcode.page(found, "HIGH", without_library=True).collect()] == ["F", "I"]


def test_row_limit_may_split_a_group(spark):
    n = spark.createDataFrame([(x, x, "MethodDeclaration", f"/{x}.ts", 1, "h") for x in "abc"], "id string, name string, coreType string, filePath string, startLine int, normalizedHash string")
    assert duplicates.structural_groups(duplicates.structural_items(n, "all", 2)).first().n_items == 2
    assert duplicates.structural_groups(duplicates.structural_items(n, "all", 1)).count() == 0
    assert duplicates.structural_items(n, "classes").count() == 0


def test_similar_pairs_and_greedy_choice(spark):
    rows = [("a", [1.0, 0.0], "/a", None), ("b", [1.0, 0.01], "/b", None), ("c", [1.0, 0.02], "/c", "h"), ("d", [0.0, 1.0], "/d", None), ("e", [1.0, 0.0], "/a", None), ("f", [1.0, 0.021], "/f", "h"), ("z", [0.0, 0.0], "/z", None)]
    n = spark.createDataFrame(rows, "id string, embedding array<double>, filePath string, normalizedHash string").withColumn("coreType", F.lit("K"))
    for block in (2, 100):
        pairs = duplicates.similar_pairs(n, 0.99, block=block)
        assert sorted((r.id1, r.id2) for r in pairs.collect()) == [("a", "b"), ("a", "c"), ("a", "f"), ("b", "c"), ("b", "e"), ("b", "f"), ("c", "e"), ("e", "f")]
    got = duplicates.greedy_pairs(pairs).collect()
    used = [x for r in got for x in (r.id1, r.id2)]
    assert len(used) == len(set(used)) and {r.confidence for r in got} == {"HIGH"}


# ---------------------------------------------------------------- coordination

MARK = "id string, nodeId string, agentId string, swarmId string, type string, intensity double, ts long, halfLife long"


def test_decay_uses_its_own_constant(spark):
    m = spark.createDataFrame([("1", "n", "a", "s", "modifying", 1.0, 0, 600_000), ("2", "n", "a", "s", "warning", 0.7, 0, -1), ("3", "n", "a", "s", "x", 0.7, 0, None)], MARK)
    got = [r.x for r in m.select(markers.decayed(600_000).alias("x")).collect()]
    assert got[0] == math.exp(-0.693147) != 0.5 and got[1:] == [0.7, 0.7]


def test_deposit_keeps_the_first_half_life_and_one_workflow_state(spark):
    old = spark.createDataFrame([("1", "n", "a", "s", "exploring", 0.5, 10, 111), ("2", "n", "a", "s", "warning", 1.0, 10, -1), ("3", "n", "b", "s", "exploring", 1.0, 10, 5)], MARK)
    new = spark.createDataFrame([("4", "n", "a", "s", "exploring", 0.9, 20, 222), ("5", "n", "a", "s", "modifying", 1.0, 30, 7), ("6", "gone", "a", "s", "claiming", 1.0, 30, 7)], MARK)
    nodes = spark.createDataFrame([("n",)], "id string")
    got = sorted((r.agentId, r.type, r.intensity, r.halfLife) for r in markers.deposit(old, new, nodes).collect())
    assert got == [("a", "modifying", 1.0, 7), ("a", "warning", 1.0, -1), ("b", "exploring", 1.0, 5)]
    again = markers.deposit(old.where("id = '1'"), new.where("id = '4'")).first()
    assert (again.intensity, again.ts, again.halfLife) == (0.9, 20, 111)
    told, left = markers.cleanup(old, agent="a")
    assert told.first().n == 1 and left.count() == 2


def test_completion_unblocks_only_who_waits_for_nothing_else(spark):
    t = spark.createDataFrame([("t1", "in_progress"), ("t2", "blocked"), ("t3", "blocked")], "id string, status string")
    d = spark.createDataFrame([("t2", "t1"), ("t3", "t2")], "taskId string, dependsOn string")
    assert [(r.done, r.id) for r in tasks.unblocked_by(t, d, t.where("id = 't1'").select("id")).collect()] == [("t1", "t2")]
    levels = {r.id: r.level for r in tasks.levels(t.select("id"), d.union(spark.createDataFrame([("x", "t1")], d.schema))).collect()}
    assert levels == {"t1": 0, "t2": 1, "t3": 2}
    ring = spark.createDataFrame([("t1", "t2"), ("t2", "t1")], d.schema)
    assert {r.id: r.level for r in tasks.levels(t.select("id"), ring).collect()} == {"t1": -1, "t2": -1, "t3": 0}


def test_levels_of_a_long_chain(spark):
    ids = spark.range(700).select(F.format_string("t%d", "id").alias("id"))
    chain = spark.range(1, 700).select(F.format_string("t%d", "id").alias("taskId"), F.format_string("t%d", F.col("id") - 1).alias("dependsOn"))
    assert {r.id: r.level for r in tasks.levels(ids, chain).collect()} == {f"t{i}": i for i in range(700)}


def test_critical_paths_of_each_target(spark):
    g = make(spark, [node(x) for x in ["A", "B", *(f"x{i:02}" for i in range(12))]], [("CALLS", f"x{i:02}", t, 0.1) for i in range(12) for t in "AB"])
    d = impact.direct(g, g.nodes.where("id in ('A', 'B')").select("id"))
    assert [(r.target, r.id) for r in impact.critical_paths(d).collect()] == [(t, f"x{i:02}") for t in "AB" for i in range(10)]
    assert [r.target for r in impact.critical_paths(d, by=()).collect()] == ["A"] * 10


def test_transitions_need_holder_and_state(spark):
    t = spark.createDataFrame([("1", "claimed", "a", 5, True, 1), ("2", "claimed", "b", 5, True, 1), ("3", "failed", "a", 5, False, 1), ("4", "failed", "b", 5, True, 1)], "id string, status string, claimedBy string, updatedAt long, retryable boolean, retryCount int")
    every = ["1", "2", "3", "4"]
    assert [(r.id, r.status, r.guard) for r in tasks.advance(t, "start", every, "a", 9).collect()] == [("1", "in_progress", 5)]
    assert [(r.id, r.status, r.claimedBy, r.retryCount) for r in tasks.advance(t, "retry", every, "a", 9).collect()] == [("4", "available", None, 2)]


def test_decompose_depend_and_complexity(spark):
    n = spark.createDataFrame([node("1", file="/a"), node("2", file="/a"), node("3", file="/b"), node("4", file="/c"), node("5", file="/d")], NODE)
    i = spark.createDataFrame([("1", "CRITICAL", ["/b"]), ("3", "HIGH", ["/a", "/zz"]), ("4", "LOW", []), ("5", "CRITICAL", [])], "id string, level string, files array<string>")
    parts = tasks.decompose(n, i)
    assert [(r.filePath, r.level, r.priority) for r in parts.orderBy("index").collect()] == [("/a", "CRITICAL", "critical"), ("/d", "CRITICAL", "critical"), ("/b", "HIGH", "high"), ("/c", "LOW", "normal")]
    deps = tasks.dependencies(parts)
    assert sorted(map(tuple, deps.select("filePath", "dependsOn").collect())) == [("/a", "/b"), ("/b", "/a")]
    assert tasks.complexity(parts, deps).first().complexity == "MEDIUM"
    assert sorted(r.filePath for r in tasks.parallelisable(parts, deps, ["/a"]).collect()) == ["/b", "/c", "/d"]


def test_message_without_time_to_live_is_never_seen(spark):
    empty = spark.createDataFrame([], "id string, swarmId string, fromAgentId string, toAgentId string, category string, timestamp long, expiresAt long, readBy array<string>")
    new = spark.createDataFrame([("1", "s", "a", None, "alert")], "id string, swarmId string, fromAgentId string, toAgentId string, category string")
    assert messages.inbox(messages.send(empty, new, 100, 0), "b", 100).count() == 0
    sent = messages.send(empty, new, 100)
    assert messages.inbox(sent, "b", 100).count() == 1
    assert messages.inbox(messages.acknowledged(sent, "b", ["1"]), "b", 100).count() == 0


def test_working_set_tells_what_is_missing(spark):
    b = spark.createDataFrame([(["x", "gone", "y"],)], "workingSetNodeIds array<string>")
    n = spark.createDataFrame([node("x", file="/b", line=2), node("y", file="/a", line=9)], NODE)
    assert [(r.id, r.found) for r in sessions.working_set(b, n).collect()] == [("y", True), ("x", True), ("gone", False)]


def test_vector_filter_comes_after_the_nearest(spark):
    n = spark.createDataFrame([(f"{i}", [1.0, i / 10], "p" if i > 3 else "q") for i in range(8)] + [("null", None, "p"), ("zero", [0.0, 0.0], "p")], "id string, embedding array<double>, projectId string")
    assert search.vector_search(n, [1.0, 0.0], 2, F.col("projectId") == "p", multiplier=2).count() == 0
    assert [r.id for r in search.vector_search(n, [1.0, 0.0], 2, F.col("projectId") == "p", multiplier=3).collect()] == ["4", "5"]


# ---------------------------------------------------------------- incremental, resolution, rules


def test_changes(spark):
    kind = "filePath string, mtime long, size long, contentHash string"
    old = spark.createDataFrame([("same", 1, 1, "a"), ("touched", 1, 1, "a"), ("gone", 1, 1, "a"), ("null", None, None, None)], kind)
    new = spark.createDataFrame([("same", 1, 1, "a"), ("touched", 2, 1, "a"), ("new", 1, 1, "a"), ("null", 0, 0, "")], kind)
    assert sorted(map(tuple, incremental.changes(old, new).collect())) == [("gone", "deleted"), ("new", "new"), ("touched", "changed")]


def test_incremental_apply_restores_cross_file_edges_once(spark):
    g = make(spark, [node("A", file="/a"), node("B", file="/b"), node("C", file="/a")], [("R", "A", "B", 1.0), ("R", "B", "A", 1.0), ("R", "B", "C", 1.0)])
    files = spark.createDataFrame([("/a",)], "filePath string")
    got = incremental.apply(g, files, g.nodes.where("id = 'A'"), g.edges.where("edge_id = 'e0'"))
    assert sorted(r.edge_id for r in got.edges.collect()) == ["e0", "e1"]
    assert sorted(r.id for r in got.nodes.collect()) == ["A", "B"]


def test_import_priorities(spark):
    f = lambda i, path, seq: (i, path.rsplit("/", 1)[-1], "SourceFile", path, seq)
    nodes = spark.createDataFrame([f("1", "/r/src/a.ts", 1), f("2", "/r/lib/src/a.ts", 2), f("3", "/r/packages/p/src/sub.ts", 3), f("4", "/r/packages/p/src/index.ts", 4), f("5", "/r/packages/q/src/x.ts", 5), ("6", "Base", "ClassDeclaration", "/r/src/a.ts", 6), ("7", "Base", "ClassDeclaration", "/r/b.ts", 7)], "id string, name string, coreType string, filePath string, seq long")
    d = [("exact", "./a", "SourceFile", "/r/src/a.ts"), ("suffix", "./src/a", "SourceFile", None), ("sub", "@s/p/sub", "SourceFile", "@s/p/sub"), ("index", "@s/p", "SourceFile", "@s/p"), ("any", "@s/q", "SourceFile", "@s/q"), ("none", "./zzz", "SourceFile", None), ("type", "Base", "ClassDeclaration", "/r/b.ts"), ("name", "Base", "ClassDeclaration", None)]
    got = {r.deferred_id: (r.id, r.prio) for r in resolve.resolve_names(spark.createDataFrame(d, "deferred_id string, targetName string, targetType string, targetFilePath string"), nodes).collect()}
    assert got == {"exact": ("1", 2), "suffix": ("1", 3), "sub": ("3", 4), "index": ("4", 5), "any": ("5", 6), "type": ("7", 1), "name": ("6", 7)}


def test_property_types_match_without_suffixes(spark):
    c = spark.createDataFrame([("1", "k", "userRepo"), ("2", "k", "mailService")], "deferred_id string, classId string, receiverPropertyName string")
    p = spark.createDataFrame([("k", "MailProvider", 0), ("k", "UserRepository", 1)], "classId string, typeName string, pos int")
    assert {r.deferred_id: r.receiverType for r in resolve.property_types(c, p).collect()} == {"1": "UserRepository", "2": "MailProvider"}


def rule_nodes(spark):
    kind = "id string, name string, coreType string, filePath string, decorators array<string>, parentClassName string, visibility string, permissionManager string, dependencies array<string>, dals array<string>, propertyTypes array<string>, constructorTypes array<string>, injectTokens map<int,string>, routes array<struct<method:string,path:string,controllerName:string,handler:string,authenticated:boolean>>, basePath string, httpMethod string, path string, statusCode int, typeAnnotation string"
    c, m, v = "ClassDeclaration", "MethodDeclaration", "VariableDeclaration"
    route = [("GET", "/x", "UserController", "list", True), ("POST", "/y", "UserController", "add", False)]
    r = lambda i, name, core, file="/f.ts", deco=(), parent=None, pm=None, deps=None, dals=None, props=None, ctor=None, tok=None, routes=None, base=None, http=None, path=None, ann=None: (i, name, core, file, list(deco), parent, "public", pm, deps, dals, props, ctor, tok, routes, base, http, path, None, ann)
    rows = [
        r("1", "UserController", c, pm="'UserPermissionManager'", deps=["'UserService'"], ctor=["UserService"]), r("2", "UserService", c, props=["PayClient"], deps=["UserRepository"]), r("3", "UserRepository", c, dals=['"UserDAL"']), r("4", "UserDAL", c),
        r("5", "UserPermissionManager", c), r("6", "userRoutes", v, ann="ModuleRoute[]", routes=route), r("7", "list", m, parent="UserController"), r("8", "PayVendorController", c, "/modules/vendor/pay.ts"),
        r("9", "NestThing", c, "/n.controller.ts", ["Controller"], ctor=["string", "UserService"], tok={0: "'UserDAL'"}, base="things/"), r("10", "get", m, "/n.controller.ts", ["Get"], "NestThing", http="GET", path="/:id"),
    ]
    df = spark.createDataFrame(rows, kind)
    return df.withColumn("semanticType", F.lit(None).cast("string")).withColumn("labels", F.array(F.lit("X"))).withColumn("extendsName", F.lit(None).cast("string"))


def test_rules(spark):
    nodes = rules.enhance_both(rule_nodes(spark))
    kinds = {r.id: r.semanticType for r in nodes.collect()}
    assert kinds == {"1": "Controller", "2": "NestService", "3": "Repository", "4": "DAL", "5": "PermissionManager", "6": "RouteDefinition", "7": None, "8": "Controller", "9": "NestController", "10": "HttpEndpoint"}
    own = rules.enhance(rule_nodes(spark), rules.custom_rules())
    got = {(r.type, r.src, r.dst) for r in rules.rule_edges(own, "custom").collect()}
    assert got == {("INJECTS", "1", "2"), ("INJECTS", "2", "3"), ("USES_DAL", "3", "4"), ("PROTECTED_BY", "1", "5"), ("ROUTES_TO", "6", "1"), ("ROUTES_TO_HANDLER", "6", "7"), ("INTERNAL_API_CALL", "2", "8"), ("USES_REPOSITORY", "2", "3")}
    nest = {(r.type, r.src, r.dst): r.context for r in rules.rule_edges(nodes, "nestjs").collect()}
    assert set(nest) == {("INJECTS", "1", "2"), ("INJECTS", "9", "2"), ("INJECTS", "9", "4"), ("EXPOSES", "9", "10")}
    assert '"fullPath":"/things/:id"' in nest["EXPOSES", "9", "10"] and '"statusCode":200' in nest["EXPOSES", "9", "10"]
    assert '"parameterIndex":1' in nest["INJECTS", "9", "2"] and '"injectionToken":"UserDAL"' in nest["INJECTS", "9", "4"]
    marked = rules.mark_endpoints(own, rules.routes_to_handler(own))
    assert [r.id for r in marked.where(F.array_contains("labels", "HttpEndpoint")).collect()] == ["7"]
