"""Queries over the fixture graph and entity tables, each with SQL for another engine.

Names begin with the operator they show.  Every query reads whole tables; a limit
stands only where it is the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import ids, vectors
from .functions import text as T
from .operators import deadcode, duplicates, graph, impact, incremental, markers, messages, resolve, rules, search, sessions, tasks
from .sources import fixtures as X
from .sources import workspace
from .storage import cut
from .streaming import events as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}

_NODES, _EDGES, _REVERSED = (X.oracle_text(t) for t in (X.NODES, X.EDGES, X.REVERSED))
_GRAPH = f"WITH nodes AS ({_NODES}), edges AS ({_EDGES})"
_MARKERS = X.oracle_text(X.MARKERS, micros="epoch_us(ts)", json="json_extract_string(props, '$.k')")
_TASKS = X.oracle_text(X.TASKS, micros="epoch_us(o_orderdate)")
_WORK = f"WITH tasks AS ({_TASKS}), depends AS ({X.oracle_text(X.DEPENDS)})"
_MESSAGES = f"WITH m AS ({X.oracle_text(X.MESSAGES)})"
#: 2024-01-31 in microseconds: the time at which markers are looked at.
NOW = 1_706_659_200_000_000
_DECAYED = f"CASE WHEN halfLife > 0 THEN intensity * exp(-0.693147 * CAST({NOW} - ts AS DOUBLE) / halfLife) ELSE intensity END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ids(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "id string")


def _n(name="n"):
    return F.count("*").cast("long").alias(name)


# ---------------------------------------------------------------- graph: scans, identity, discovery


@query(f"{_GRAPH} SELECT coreType AS label, count(*) AS n FROM nodes GROUP BY 1")
def a1_nodes_by_label(spark, sf_dir):
    return graph.count_by_label(X.graph(spark, sf_dir).nodes)


@query(f"{_GRAPH} SELECT semanticType, coreType AS label, count(*) AS n FROM nodes WHERE semanticType IS NOT NULL GROUP BY 1, 2")
def a2_semantic_types(spark, sf_dir):
    return graph.semantic_types(X.graph(spark, sf_dir).nodes)


@query(f"""{_GRAPH} SELECT a.coreType AS from_label, e.type, b.coreType AS to_label, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst
GROUP BY 1, 2, 3 HAVING count(*) > 2 ORDER BY n DESC, 1, 2, 3 LIMIT 50""")
def a3_common_patterns(spark, sf_dir):
    return graph.common_patterns(X.graph(spark, sf_dir))


@query(f"""{_GRAPH}, flat AS (SELECT unnest([coreType, 'GraphNode']) AS label, * FROM nodes),
keys AS (SELECT label, unnest(list_filter(['coreType', 'filePath', 'id', 'isExported', 'name', 'projectId', CASE WHEN semanticType IS NOT NULL THEN 'semanticType' END, 'startLine', 'visibility'], lambda x: x IS NOT NULL)) AS k FROM flat)
SELECT f.label, n, properties FROM (SELECT label, count(*) AS n FROM flat GROUP BY 1) f
JOIN (SELECT label, array_to_string(list_sort(list(DISTINCT k)), ',') AS properties FROM keys GROUP BY 1) k ON f.label = k.label""")
def a4_node_types(spark, sf_dir):
    """With the keys of all nodes instead of a sample's, which any order would change."""
    return graph.node_types(X.graph(spark, sf_dir).nodes, sample=None).select("label", "n", F.concat_ws(",", "properties").alias("properties"))


@query(f"""{_GRAPH} SELECT type, CAST(sum(n) AS BIGINT) AS n, string_agg(c, ',' ORDER BY c) AS connections FROM (
SELECT e.type, a.coreType || '->' || b.coreType AS c, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY 1, 2) GROUP BY 1""")
def a5_relationship_types(spark, sf_dir):
    return graph.relationship_types(X.graph(spark, sf_dir)).select("type", "n", F.concat_ws(",", "connections").alias("connections"))


@query(f"""{_GRAPH} SELECT id, projectId || ':' || coreType || ':' || substr(sha256(concat_ws('::', projectId, coreType, filePath, name)), 1, 16) AS hash_id,
projectId || ':' || coreType || ':' || substr(sha256(concat_ws('::', projectId, coreType, filePath, 'parent', name)), 1, 16) AS child_id FROM nodes""")
def id_nodes(spark, sf_dir):
    n = X.graph(spark, sf_dir).nodes
    args = (F.col("projectId"), F.col("coreType"), F.col("filePath"), F.col("name"))
    return n.select("id", ids.node_id(*args).alias("hash_id"), ids.node_id(*args, F.lit("parent")).alias("child_id"))


@query(f"""{_GRAPH} SELECT edge_id, type || ':' || substr(sha256(type || '::' || src || '::' || dst), 1, 16) AS core_id, 'SEM:' || substr(sha256(type || '::' || src || '::' || dst), 1, 16) AS rule_id,
'CALLS:' || substr(sha256('CALLS::' || src || '::' || dst || '::' || lineNumber), 1, 16) AS call_id FROM edges""")
def id_edges(spark, sf_dir):
    e = X.graph(spark, sf_dir).edges
    a, b, t = F.col("src"), F.col("dst"), F.col("type")
    return e.select("edge_id", ids.edge_id(t, a, b).alias("core_id"), ids.rule_edge_id(t, a, b).alias("rule_id"), ids.call_edge_id(a, b, F.col("lineNumber")).alias("call_id"))


@query("SELECT page_id, 'proj_' || substr(sha256(url), 1, 12) AS project_id FROM pages")
def id_projects(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", ids.project_id(F.col("url")).alias("project_id"))


@query(f"{_GRAPH} SELECT count(*) AS given, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS stored FROM edges e LEFT JOIN (SELECT id FROM nodes WHERE coreType <> 'Supplier') a ON a.id = e.src LEFT JOIN (SELECT id FROM nodes WHERE coreType <> 'Supplier') b ON b.id = e.dst")
def w2_edges_with_ends(spark, sf_dir):
    """Edges that an import would keep if suppliers were missing."""
    g = X.graph(spark, sf_dir)
    kept = graph.with_both_ends(g.edges, g.nodes.where("coreType != 'Supplier'"))
    return g.edges.agg(_n("given")).join(kept.agg(_n("stored")))


# ---------------------------------------------------------------- traversal


def _hops(direction, sql):
    def run(spark, sf_dir):
        return graph.neighbours(X.graph(spark, sf_dir), _ids(spark, "P:1", "N:3"), direction).select("start", "id", "type", "edge_id")

    run.__name__ = f"j1_{direction.lower()}"
    query(f"{_GRAPH}, steps AS ({sql}) SELECT a AS start, b AS id, type, edge_id FROM steps WHERE a IN ('P:1', 'N:3')")(run)


_OUT, _IN = "SELECT src AS a, dst AS b, type, edge_id, relationshipWeight AS w FROM edges", "SELECT dst AS a, src AS b, type, edge_id, relationshipWeight AS w FROM edges"
_hops("OUTGOING", _OUT)
_hops("INCOMING", _IN)
_hops("BOTH", f"{_OUT} UNION ALL {_IN}")


def _paths_sql(steps: str, start: str, depth: int, least: int = 1) -> str:
    return f"""{_GRAPH.replace('WITH', 'WITH RECURSIVE', 1)}, steps AS ({steps}),
p AS (SELECT '{start}' AS id, 0 AS depth, CAST([] AS VARCHAR[]) AS types, CAST([] AS VARCHAR[]) AS used
  UNION ALL SELECT s.b, p.depth + 1, list_append(p.types, s.type), list_append(p.used, s.edge_id) FROM p JOIN steps s ON s.a = p.id WHERE p.depth < {depth} AND NOT list_contains(p.used, s.edge_id)),
found AS (SELECT p.id, depth, types, used, n.coreType, n.filePath, n.name FROM p JOIN nodes n ON n.id = p.id WHERE depth >= {least})"""


@query(f"{_paths_sql(_OUT, 'O:1', 3)} SELECT id, depth, array_to_string(types, '>') AS chain, array_to_string(used, '/') AS edges FROM found WHERE id <> 'O:1'")
def c1_paths_out(spark, sf_dir):
    return graph.traverse(X.graph(spark, sf_dir), "O:1", 3, "OUTGOING").select("id", F.col("depth").cast("int").alias("depth"), F.concat_ws(">", "path_types").alias("chain"), F.concat_ws("/", "path_edges").alias("edges"))


@query(f"{_paths_sql(_IN + chr(32) + 'WHERE type IN (' + chr(39) + 'IN_NATION' + chr(39) + ', ' + chr(39) + 'PLACED_BY' + chr(39) + ')', 'N:0', 2)} SELECT id, depth, array_to_string(types, '>') AS chain, array_to_string(used, '/') AS edges FROM found WHERE id <> 'N:0'")
def c1_paths_in_typed(spark, sf_dir):
    found = graph.traverse(X.graph(spark, sf_dir), "N:0", 2, "INCOMING", ["IN_NATION", "PLACED_BY", "not valid"])
    return found.select("id", F.col("depth").cast("int").alias("depth"), F.concat_ws(">", "path_types").alias("chain"), F.concat_ws("/", "path_edges").alias("edges"))


@query(f"{_paths_sql(_OUT, 'O:1', 3)} SELECT depth, count(*) AS n, count(*) > 5 AS has_more FROM found WHERE id <> 'O:1' GROUP BY 1")
def c4_depth_summary(spark, sf_dir):
    return graph.depth_summary(graph.traverse(X.graph(spark, sf_dir), "O:1", 3, "OUTGOING")).select(F.col("depth").cast("int").alias("depth"), "n", "has_more")


@query(f"""{_paths_sql(_OUT, 'O:1', 3)} SELECT count(*) AS total_connections, count(DISTINCT id) AS distinct_nodes, least(count(DISTINCT id), 50) AS nodes_shown, count(*) > 50 AS truncated, count(DISTINCT filePath) AS unique_files, max(depth) AS max_depth FROM found WHERE id <> 'O:1'""")
def c5_response(spark, sf_dir):
    r = graph.response(graph.traverse(X.graph(spark, sf_dir), "O:1", 3, "OUTGOING"))
    return r.withColumn("max_depth", F.col("max_depth").cast("int"))


@query(f"{_paths_sql(_OUT, 'O:1', 3)} SELECT filePath, count(DISTINCT id) AS n FROM found WHERE id <> 'O:1' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 30")
def c6_file_summary(spark, sf_dir):
    return graph.file_summary(graph.traverse(X.graph(spark, sf_dir), "O:1", 3, "OUTGOING"))


def _beam_sql(start: str, depth: int, width: int) -> str:
    out = [f"{_GRAPH}, steps AS ({_OUT} UNION ALL {_IN}), v0 AS (SELECT '{start}' AS id), f0 AS (SELECT '{start}' AS id)"]
    for d in range(1, depth + 1):
        out.append(f"""r{d} AS (SELECT {d} AS depth, s.b AS id, coalesce(w, 0.5) * 0.5 * {0.85 ** (d - 1)!r} AS score, s.a AS from_id, s.type, s.edge_id FROM steps s JOIN f{d - 1} f ON f.id = s.a
  WHERE s.b NOT IN (SELECT id FROM v{d - 1}) ORDER BY score DESC, s.b, s.edge_id LIMIT {width}),
k{d} AS (SELECT * FROM r{d} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, edge_id) = 1),
f{d} AS (SELECT id FROM k{d}), v{d} AS (SELECT id FROM v{d - 1} UNION SELECT id FROM k{d})""")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT * FROM k{d}" for d in range(1, depth + 1))


@query(_beam_sql("O:1", 3, 8))
def c2_beam(spark, sf_dir):
    """Edge weights and decay only: the fixture graph has no vectors."""
    return graph.beam(X.graph(spark, sf_dir), "O:1", 3, "BOTH", 5)


@query(f"{_GRAPH} SELECT id, coalesce(semanticType, 'GraphNode') AS shown FROM nodes")
def c8_display_type(spark, sf_dir):
    return X.graph(spark, sf_dir).nodes.select("id", graph.display_type().alias("shown"))


# ---------------------------------------------------------------- impact

_DIRECT = f"""{_GRAPH}, targets AS (SELECT id AS target FROM nodes WHERE coreType = 'Nation'),
d AS (SELECT DISTINCT t.target, n.id, e.type, coalesce(e.relationshipWeight, 0.5) AS weight, n.coreType, n.semanticType, n.filePath, n.name
  FROM targets t JOIN edges e ON e.dst = t.target JOIN nodes n ON n.id = e.src WHERE e.src <> t.target)"""
_TRANSITIVE = f"""{_DIRECT}, t2 AS (SELECT a.dst AS target, b.src AS id, 2 AS depth, b.type || '>' || a.type AS chain, a.edge_id AS e1, b.edge_id AS e2 FROM targets t JOIN edges a ON a.dst = t.target JOIN edges b ON b.dst = a.src AND b.edge_id <> a.edge_id),
t3 AS (SELECT t2.target, c.src AS id, 3 AS depth, c.type || '>' || t2.chain AS chain FROM t2 JOIN edges c ON c.dst = t2.id AND c.edge_id NOT IN (t2.e1, t2.e2)),
t AS (SELECT DISTINCT * FROM (SELECT target, id, depth, chain FROM t2 UNION ALL SELECT * FROM t3))"""


def _nations(spark, sf_dir):
    g = X.graph(spark, sf_dir)
    return g, g.nodes.where("coreType = 'Nation'").select("id")


@query(f"{_DIRECT} SELECT target, id, type, weight FROM d")
def i2_direct(spark, sf_dir):
    return impact.direct(*_nations(spark, sf_dir)).select("target", "id", "type", "weight")


@query(f"{_DIRECT} SELECT target, type, count(*) AS n FROM d GROUP BY 1, 2")
def a13_direct_by_relationship(spark, sf_dir):
    return impact.by_relationship(impact.direct(*_nations(spark, sf_dir)))


@query(f"{_DIRECT} SELECT target, coalesce(semanticType, coreType) AS kind, count(*) AS n FROM d GROUP BY 1, 2")
def a13_direct_by_type(spark, sf_dir):
    return impact.by_type(impact.direct(*_nations(spark, sf_dir)))


@query(f"{_DIRECT} SELECT target, array_to_string(list_sort(list(DISTINCT filePath)), ',') AS files, count(DISTINCT filePath) AS n_files FROM d GROUP BY 1")
def a14_affected_files(spark, sf_dir):
    return impact.affected_files(impact.direct(*_nations(spark, sf_dir))).select("target", F.concat_ws(",", "files").alias("files"), "n_files")


@query(f"{_DIRECT} SELECT target, id, type FROM (SELECT d.*, n.filePath AS own FROM d JOIN nodes n ON n.id = d.target) WHERE filePath <> own")
def i3_outside_file(spark, sf_dir):
    g, t = _nations(spark, sf_dir)
    return impact.outside_file(impact.direct(g, t), g.nodes.join(t, "id", "left_semi")).select("target", "id", "type")


@query(f"""{_GRAPH}, targets AS (SELECT id AS target FROM nodes WHERE filePath LIKE '%/Brand#11' OR filePath = '/brand/Brand#11'),
d AS (SELECT DISTINCT t.target, n.id, e.type, e.relationshipWeight AS weight FROM targets t JOIN edges e ON e.dst = t.target JOIN nodes n ON n.id = e.src)
SELECT id, arg_max(target, (weight, type, target)) AS target, max(weight) AS weight FROM d GROUP BY 1""")
def i4_file_impact(spark, sf_dir):
    """All parts of a brand count as the entities of its file."""
    g = X.graph(spark, sf_dir)
    t = impact.file_targets(g.nodes, "/brand/Brand#11", ["Part"])
    return impact.of_file(impact.direct(g, t)).select("id", "target", "weight")


@query(f"{_TRANSITIVE} SELECT target, id, depth, chain, split_part(chain, '>', 1) AS relationship FROM t")
def i5_transitive(spark, sf_dir):
    return impact.transitive(*_nations(spark, sf_dir), 3).select("target", "id", F.col("depth").cast("int").alias("depth"), F.concat_ws(">", "path_types").alias("chain"), "relationship")


_RISK = f"""{_TRANSITIVE}, b AS (SELECT * FROM t WHERE (target, id) NOT IN (SELECT target, id FROM d)),
x AS (SELECT target, (SELECT count(*) FROM d WHERE d.target = o.target) AS n_direct, (SELECT count(*) FROM b WHERE b.target = o.target) AS n_transitive,
  (SELECT avg(weight) FROM d WHERE d.target = o.target) AS w, (SELECT count(*) FROM d WHERE d.target = o.target AND coreType IN ('Supplier')) AS h FROM targets o),
y AS (SELECT *, CASE WHEN n_direct = 0 THEN 0.0 ELSE least(1.0, least(log10(n_direct + 1) / 2, 0.3) + 0.3 * w + 0.2 * least(h / 3.0, 1.0) + least(log10(n_transitive + 1) / 3, 0.2)) END AS s FROM x)"""


@query(f"""{_RISK} SELECT target, n_direct, n_transitive, round(CAST(s AS DOUBLE), 6) AS score, CASE WHEN s >= 0.75 THEN 'CRITICAL' WHEN s >= 0.5 THEN 'HIGH' WHEN s >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM y""")
def i6_risk(spark, sf_dir):
    """Risk of a change of each nation, suppliers counting as high-risk."""
    g, t = _nations(spark, sf_dir)
    d = impact.direct(g, t)
    rows = impact.risk(t, d, impact.beyond_direct(impact.transitive(g, t, 3), d), ["Supplier"])
    return rows.withColumn("score", F.round("score", 6))


@query(f"{_DIRECT} SELECT target, id, type, name || ' -[' || type || ']-> target' AS line FROM d WHERE weight >= 0.6 AND false UNION ALL SELECT target, id, type, name || ' -[' || type || ']-> target' FROM (SELECT * FROM d WHERE type = 'IN_NATION' ORDER BY target, id, type LIMIT 10)")
def i9_critical_paths(spark, sf_dir):
    """All nations as one analysis, whose ten the SQL has; i10_critical_paths_each has those of each."""
    return impact.critical_paths(impact.direct(*_nations(spark, sf_dir)), {"IN_NATION": 0.7}, by=())


@query(f"{_DIRECT} SELECT target, id, type, name || ' -[' || type || ']-> target' AS line FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id, type) AS k FROM d WHERE type = 'IN_NATION') WHERE k <= 10")
def i10_critical_paths_each(spark, sf_dir):
    """Ten strong dependents of each nation."""
    return impact.critical_paths(impact.direct(*_nations(spark, sf_dir)), {"IN_NATION": 0.7})


# ---------------------------------------------------------------- dead code

_DEAD = f"""WITH nodes AS ({_NODES}), edges AS ({_REVERSED}),
x1 AS (SELECT n.*, 'Exported but never imported or referenced' AS reason FROM nodes n WHERE coreType = 'Order' AND isExported AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes s ON s.id = e.src WHERE e.dst = n.id AND s.filePath <> n.filePath)),
x2 AS (SELECT n.*, 'Private method never called' AS reason FROM nodes n WHERE coreType = 'Order' AND visibility = 'private' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = n.id AND flag = 'R')),
x3 AS (SELECT n.*, 'Interface never implemented or referenced' AS reason FROM nodes n WHERE coreType = 'Order' AND isExported AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = n.id)),
entries AS (SELECT id FROM nodes WHERE coreType = 'Order' AND filePath LIKE '%5'),
found AS (SELECT *, CASE WHEN isExported AND reason LIKE '%never imported%' THEN 'HIGH' WHEN visibility = 'private' THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3) WHERE id NOT IN (SELECT id FROM entries) AND filePath NOT LIKE '%9')"""


def _dead(spark, sf_dir):
    n, e = X.graph(spark, sf_dir).nodes, X.build(spark, sf_dir, X.REVERSED)
    x1 = deadcode.unreferenced_exports(n, e, ["Order"], ["ITEM_OF"])
    x2 = deadcode.uncalled_private_methods(n, e.where("flag = 'R'"), "Order", ["ITEM_OF"])
    x3 = deadcode.unreferenced_interfaces(n, e, "Order", ["ITEM_OF"])
    entries = deadcode.entry_points(n, [], ["5"], ["Order"])
    return x1, x2, x3, entries, deadcode.report(x1, x2, x3, entries, exclude_semantic=False, patterns=["*9"])


@query(f"{_DEAD} SELECT id FROM x1")
def x1_unreferenced_exports(spark, sf_dir):
    return _dead(spark, sf_dir)[0].select("id")


@query(f"{_DEAD} SELECT id FROM x2")
def x2_uncalled_private(spark, sf_dir):
    return _dead(spark, sf_dir)[1].select("id")


@query(f"{_DEAD} SELECT id FROM x3")
def x3_unreferenced_interfaces(spark, sf_dir):
    return _dead(spark, sf_dir)[2].select("id")


@query(f"{_GRAPH} SELECT DISTINCT semanticType FROM nodes WHERE semanticType IS NOT NULL")
def x4_semantic_types(spark, sf_dir):
    return deadcode.semantic_types(X.graph(spark, sf_dir).nodes)


@query(f"{_GRAPH} SELECT id FROM nodes WHERE coreType IN ('Order', 'Part') AND (coalesce(semanticType IN ('1-URGENT'), false) OR filePath LIKE '%3')")
def x5_entry_points(spark, sf_dir):
    return deadcode.entry_points(X.graph(spark, sf_dir).nodes, ["1-URGENT"], ["3"], ["Order", "Part"]).select("id")


@query(f"{_DEAD} SELECT id, reason, confidence, 'internal-unused' AS category, CASE confidence WHEN 'HIGH' THEN 'Exported but never imported anywhere' WHEN 'MEDIUM' THEN 'Private method with no internal callers' ELSE 'Could be used via dynamic references' END AS confidence_reason FROM found")
def x6_report(spark, sf_dir):
    return _dead(spark, sf_dir)[4].select("id", "reason", "confidence", "category", "confidence_reason")


@query(f"""{_DEAD} SELECT count(*) AS total_before_filter, count(*) FILTER (confidence = 'HIGH') AS high, count(*) FILTER (confidence = 'MEDIUM') AS medium, count(*) FILTER (confidence = 'LOW') AS low,
CAST(0 AS BIGINT) AS library_export, CAST(0 AS BIGINT) AS ui_component, count(*) AS internal_unused, count(*) AS total, count(DISTINCT filePath) AS affected_files,
CASE WHEN count(*) FILTER (confidence = 'HIGH') >= 20 OR count(*) >= 50 THEN 'CRITICAL' WHEN count(*) FILTER (confidence = 'HIGH') >= 10 OR count(*) >= 25 THEN 'HIGH' WHEN count(*) FILTER (confidence = 'HIGH') >= 5 OR count(*) >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM found""")
def x8_stats(spark, sf_dir):
    return deadcode.stats(_dead(spark, sf_dir)[4])


@query(f"{_DEAD} SELECT id, reason FROM found WHERE confidence IN ('MEDIUM', 'HIGH') ORDER BY filePath, startLine, id, reason LIMIT 20 OFFSET 5")
def x9_page(spark, sf_dir):
    return deadcode.page(_dead(spark, sf_dir)[4], "MEDIUM", offset=5, limit=20).select("id", "reason")


@query(f"{_DEAD} SELECT substr(filePath, 2) AS file, count(*) AS n FROM found GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def a16_top_files(spark, sf_dir):
    return deadcode.top_files(_dead(spark, sf_dir)[4])


# ---------------------------------------------------------------- normalisation and duplicates

_FLAT = r"trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0), ' '), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length({_FLAT}) = 0 THEN '' ELSE sha256({_FLAT}) END AS hash FROM documents")
def d4_whitespace_hash(spark, sf_dir):
    """White space of whole texts normalised, and the hash of what is left."""
    return X.table(spark, sf_dir, "documents").select("doc_id", T.hash_of(T.collapse_whitespace(F.col("text"))).alias("hash"))


@query()
def d6_normalized_code(spark, sf_dir):
    """Without SQL: the other engine's patterns know no look-behind.  Tests hold it against a plain model."""
    code = T.normalized_code(F.col("text"))
    return X.table(spark, sf_dir, "documents").select("doc_id", F.length(code).alias("length"), T.hash_of(code).alias("hash"))


_CODE = f"WITH n AS (SELECT concat('D:', doc_id) AS id, concat('doc', doc_id) AS name, concat('/apps/', source, '/', doc_id, '.ts') AS filePath, CAST(doc_id AS INT) AS startLine, source, CASE WHEN length({_FLAT}) = 0 THEN '' ELSE sha256({_FLAT}) END AS h FROM documents)"


def _code_nodes(spark, sf_dir):
    """Documents as functions of a stored graph, where hashes are columns."""
    d = X.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/apps/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".ts"))
    return cut(d.select(F.concat(F.lit("D:"), "doc_id").alias("id"), F.concat(F.lit("doc"), "doc_id").alias("name"), F.lit("FunctionDeclaration").alias("coreType"), path.alias("filePath"), F.col("doc_id").cast("int").alias("startLine"), T.hash_of(T.collapse_whitespace(F.col("text"))).alias("normalizedHash")))


@query(f"{_CODE} SELECT id, h AS normalizedHash, count(*) OVER (PARTITION BY h) AS group_size FROM n WHERE length(h) > 0 QUALIFY count(*) OVER (PARTITION BY h) >= 2")
def d10_structural_items(spark, sf_dir):
    return duplicates.structural_items(_code_nodes(spark, sf_dir)).select("id", "normalizedHash", "group_size")


@query(f"{_CODE} SELECT h AS normalizedHash, count(*) AS n_items, count(DISTINCT filePath) AS n_files, CASE WHEN count(DISTINCT source) > 1 THEN 'cross-app' WHEN count(DISTINCT filePath) = 1 THEN 'same-file' ELSE 'cross-file' END AS category, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM n WHERE length(h) > 0 GROUP BY 1 HAVING count(*) >= 2")
def d11_structural_groups(spark, sf_dir):
    g = duplicates.structural_groups(duplicates.structural_items(_code_nodes(spark, sf_dir)))
    return g.select("normalizedHash", "n_items", "n_files", "category", F.concat_ws(",", "names").alias("names"))


@query(f"{_CODE}, k AS (SELECT id, h AS normalizedHash FROM n WHERE length(h) > 0 QUALIFY count(*) OVER (PARTITION BY h) >= 2) SELECT k.id, k.normalizedHash FROM k JOIN n USING (id) ORDER BY k.normalizedHash, n.filePath, n.startLine, k.id LIMIT 15")
def d10_structural_limited(spark, sf_dir):
    return duplicates.structural_items(_code_nodes(spark, sf_dir), "functions", 15).select("id", "normalizedHash")


_VECTORS = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_SIMILAR = f"""{_VECTORS}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, (1 + list_cosine_similarity(a.e, b.e)) / 2 AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
k AS (SELECT * FROM s WHERE s >= 0.675 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, lpad(CAST(b AS VARCHAR), 8, '0')) <= 50)"""


def _vector_nodes(spark, sf_dir):
    v = X.table(spark, sf_dir, "embeddings")
    return v.select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("id"), "embedding", F.concat(F.lit("/v/"), F.col("vec_id").cast("string")).alias("filePath"), F.lit(None).cast("string").alias("normalizedHash"), F.concat(F.lit("k"), (F.col("label") % 2).cast("string")).alias("coreType"))


@query(f"{_SIMILAR} SELECT lpad(CAST(a AS VARCHAR), 8, '0') AS id1, lpad(CAST(b AS VARCHAR), 8, '0') AS id2, round(s, 6) AS similarity FROM k WHERE a < b AND la % 2 = lb % 2")
def d12_similar_pairs(spark, sf_dir):
    return duplicates.similar_pairs(_vector_nodes(spark, sf_dir), 0.675).select("id1", "id2", F.round("similarity", 6).alias("similarity"))


@query()
def d13_greedy_pairs(spark, sf_dir):
    """Without SQL: choosing is sequential.  Tests hold it against a plain loop."""
    pairs = duplicates.similar_pairs(_vector_nodes(spark, sf_dir), 0.675, limit=200)
    return duplicates.greedy_pairs(pairs).select("id1", "id2", "rounded", "confidence")


@query(f"{_SIMILAR} SELECT lpad(CAST(a AS VARCHAR), 8, '0') AS id1, lpad(CAST(b AS VARCHAR), 8, '0') AS id2, CASE WHEN s >= 0.9 THEN 'HIGH' WHEN s >= 0.85 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM k WHERE a < b AND la % 2 = lb % 2")
def d14_semantic_confidence(spark, sf_dir):
    p = duplicates.similar_pairs(_vector_nodes(spark, sf_dir), 0.675)
    return p.select("id1", "id2", duplicates.semantic_confidence(F.col("similarity")).alias("confidence"))


# ---------------------------------------------------------------- vector search


def _first_vector(spark, sf_dir):
    return X.table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


@query(f"{_VECTORS} SELECT vec_id, round((1 + list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 0))) / 2, 6) AS score FROM v ORDER BY (1 + list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 0))) / 2 DESC, vec_id LIMIT 10")
def b1_vector_search(spark, sf_dir):
    found = search.vector_search(X.table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10, id_col="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"{_VECTORS}, s AS (SELECT vec_id, label, (1 + list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 0))) / 2 AS s FROM v ORDER BY s DESC, vec_id LIMIT 20) SELECT vec_id, round(s, 6) AS score FROM s WHERE label % 2 = 0 AND s >= 0.3 ORDER BY s DESC, vec_id LIMIT 10")
def b1_filtered_after(spark, sf_dir):
    """The filter comes after the twenty nearest are taken."""
    found = search.vector_search(X.table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10, F.col("label") % 2 == 0, 2, id_col="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"{_VECTORS} SELECT vec_id, round(list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 1)), 6) AS raw, round((1 + list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 1))) / 2, 6) AS unit FROM v")
def s13_similarity_scales(spark, sf_dir):
    q = X.table(spark, sf_dir, "embeddings").where("vec_id = 1").first().embedding
    a, b = F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])
    return X.table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.similarity(a, b, "raw"), 6).alias("raw"), F.round(vectors.similarity(a, b), 6).alias("unit"))


# ---------------------------------------------------------------- markers


@query(f"SELECT id, round({_DECAYED}, 9) AS current FROM ({_MARKERS})")
def h1_decay(spark, sf_dir):
    return X.markers(spark, sf_dir).select("id", F.round(markers.decayed(NOW), 9).alias("current"))


@query(f"SELECT id, nodeId, type, round({_DECAYED}, 9) AS current FROM ({_MARKERS}) WHERE {_DECAYED} >= 0.1 AND type IN ('warning', 'completed') ORDER BY {_DECAYED} DESC, ts DESC, id LIMIT 50")
def h2_sense(spark, sf_dir):
    return markers.sense(X.markers(spark, sf_dir), NOW, least=0.1, type=["warning", "completed"]).select("id", "nodeId", "type", F.round("current", 9).alias("current"))


@query(f"SELECT type, count(*) AS n, round(avg({_DECAYED}), 6) AS avg_intensity, count(DISTINCT agentId) AS agents FROM ({_MARKERS}) WHERE {_DECAYED} >= 0.3 GROUP BY 1")
def h3_stats(spark, sf_dir):
    return markers.stats(X.markers(spark, sf_dir), NOW).withColumn("avg_intensity", F.round("avg_intensity", 6))


@query(f"SELECT id FROM ({_MARKERS}) WHERE {_DECAYED} >= 0.01")
def h4_purged(spark, sf_dir):
    return markers.purged(X.markers(spark, sf_dir), NOW).select("id")


@query(f"WITH m AS ({_MARKERS}) SELECT nodeId, agentId, swarmId, type, arg_max(intensity, (id % 2, ts, id)) AS intensity, arg_max(ts, (id % 2, ts, id)) AS ts FROM m GROUP BY 1, 2, 3, 4 QUALIFY type = 'warning' OR row_number() OVER (PARTITION BY nodeId, agentId, type = 'warning' ORDER BY max((id % 2, ts, id)) DESC) = 1")
def h6_deposit(spark, sf_dir):
    """Even events are stored, odd ones deposited."""
    m = X.markers(spark, sf_dir)
    got = markers.deposit(m.where("id % 2 = 0"), m.where("id % 2 = 1"))
    return got.select("nodeId", "agentId", "swarmId", "type", "intensity", "ts")


@query(f"SELECT id FROM ({_MARKERS}) QUALIFY type = 'warning' OR row_number() OVER (PARTITION BY nodeId, agentId, swarmId, type = 'warning' ORDER BY ts DESC, id DESC) = 1")
def h7_exclusive(spark, sf_dir):
    return markers.exclusive(X.markers(spark, sf_dir)).select("id")


@query(f"SELECT count(*) AS n, count(DISTINCT agentId) AS agents, array_to_string(list_sort(list(DISTINCT type)), ',') AS types, count(DISTINCT swarmId) AS swarms FROM ({_MARKERS}) WHERE type <> 'warning'")
def h9_cleanup(spark, sf_dir):
    return markers.cleanup(X.markers(spark, sf_dir), swarm="s1")[0].withColumn("types", F.concat_ws(",", "types"))


# ---------------------------------------------------------------- tasks


@query(f"{_WORK} SELECT t.id, count(*) FILTER (o.status <> 'completed') AS n_open, count(*) AS n FROM tasks t JOIN depends d ON d.taskId = t.id JOIN tasks o ON o.id = d.dependsOn GROUP BY 1 HAVING count(*) FILTER (o.status <> 'completed') > 0")
def t2_blocked(spark, sf_dir):
    return tasks.blocked_by_dependencies(X.tasks(spark, sf_dir), X.depends(spark, sf_dir)).select("id", "n_open", "n")


_FREE = f"{_WORK}, free AS (SELECT t.* FROM tasks t WHERE status IN ('available', 'blocked') AND NOT EXISTS (SELECT 1 FROM depends d JOIN tasks o ON o.id = d.dependsOn WHERE d.taskId = t.id AND o.status <> 'completed'))"


@query(f"{_FREE} SELECT id, swarmId, priority FROM free QUALIFY row_number() OVER (PARTITION BY swarmId ORDER BY priorityScore DESC, createdAt, id) = 1")
def t3_claim_next(spark, sf_dir):
    """The next task of every swarm."""
    return tasks.claim_next(X.tasks(spark, sf_dir), X.depends(spark, sf_dir), ["swarmId"]).select("id", "swarmId", "priority")


@query(f"{_FREE} SELECT id, priority FROM free WHERE priority IN ('high', 'critical') ORDER BY priorityScore DESC, createdAt, id LIMIT 1")
def t3_claim_one(spark, sf_dir):
    return tasks.claim_next(X.tasks(spark, sf_dir), X.depends(spark, sf_dir), priority=["high", "critical"]).select("id", "priority")


@query(f"{_WORK} SELECT id, 'in_progress' AS status, 'a1' AS claimedBy, CAST(5 AS INT) AS updatedAt FROM tasks WHERE status IN ('claimed', 'available', 'blocked') AND id IN ('t1', 't2', 't3', 't4', 't5')")
def t5_force_start(spark, sf_dir):
    return tasks.advance(X.tasks(spark, sf_dir), "force_start", ["t1", "t2", "t3", "t4", "t5"], "a1", 5).select("id", "status", "claimedBy", "updatedAt")


@query(f"""{_WORK} SELECT d.dependsOn AS done, t.id FROM depends d JOIN tasks t ON t.id = d.taskId AND t.status = 'blocked'
WHERE NOT EXISTS (SELECT 1 FROM depends o JOIN tasks x ON x.id = o.dependsOn WHERE o.taskId = d.taskId AND o.dependsOn <> d.dependsOn AND x.status <> 'completed')""")
def t6_unblocked(spark, sf_dir):
    """What the completion of each task would unblock."""
    t = X.tasks(spark, sf_dir)
    return tasks.unblocked_by(t, X.depends(spark, sf_dir), t.select("id"))


@query(f"""{_WORK}, p AS (SELECT * FROM tasks WHERE status = 'available' ORDER BY priorityScore DESC, createdAt, id LIMIT 20 OFFSET 10)
SELECT p.id, (SELECT string_agg(d.dependsOn || ':' || o.status, ',' ORDER BY d.dependsOn || ':' || o.status) FROM depends d JOIN tasks o ON o.id = d.dependsOn WHERE d.taskId = p.id) AS dependencies,
(SELECT string_agg(taskId, ',' ORDER BY taskId) FROM depends b WHERE b.dependsOn = p.id) AS blocks FROM p""")
def t8_listing(spark, sf_dir):
    page = tasks.listing(X.tasks(spark, sf_dir), X.depends(spark, sf_dir), skip=10, limit=20, status=["available"])
    return page.select("id", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("blocks", ",").alias("blocks"))


@query(f"{_WORK} SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(priority) = 0 THEN 'priority' WHEN grouping(owner) = 0 THEN 'owner' ELSE 'total' END AS dimension, coalesce(status, priority, owner, '') AS value, count(*) AS n FROM tasks GROUP BY GROUPING SETS ((status), (priority), (owner), ())")
def a9_task_stats(spark, sf_dir):
    return tasks.stats(X.tasks(spark, sf_dir))


@query(f"{_WORK} SELECT swarmId, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, CAST(0 AS BIGINT) AS failed, CAST(floor(100.0 * count(*) FILTER (status = 'completed') / count(*) + 0.5) AS BIGINT) AS percent, count(*) = count(*) FILTER (status = 'completed') AS is_complete FROM tasks GROUP BY 1")
def a10_progress(spark, sf_dir):
    return tasks.progress(X.tasks(spark, sf_dir), ["swarmId"])


@query(f"SELECT agentId, type, max(ts) AS last, count(*) AS n, CAST(floor(({NOW} - max(ts)) / 60000000) AS BIGINT) AS minutes FROM ({_MARKERS}) WHERE type IN ('modifying', 'claiming') GROUP BY 1, 2")
def t10_active_workers(spark, sf_dir):
    return tasks.active_workers(X.markers(spark, sf_dir), NOW)


@query("""SELECT page_id, CASE WHEN u LIKE '%rename%' THEN 'rename' WHEN u LIKE '%document%' OR u LIKE '%jsdoc%' THEN 'document' WHEN u LIKE '%migrate%' OR u LIKE '%convert%' OR u LIKE '%upgrade%' OR u LIKE '%modernize%' THEN 'migrate'
WHEN u LIKE '%deprecate%' THEN 'deprecate' WHEN u LIKE '%fix%' OR u LIKE '%repair%' OR u LIKE '%correct%' OR u LIKE '%resolve%' THEN 'fix' WHEN u LIKE '%test%' THEN 'test' END AS kind FROM (SELECT page_id, lower(CASE page_id % 7 WHEN 0 THEN 'Rename it' WHEN 1 THEN 'add JSDoc' WHEN 2 THEN 'Upgrade' WHEN 3 THEN 'deprecate' WHEN 4 THEN 'repair' WHEN 5 THEN 'unit test' ELSE 'other' END) AS u FROM pages)""")
def t12_infer_type(spark, sf_dir):
    words = F.array(*[F.lit(x) for x in ("Rename it", "add JSDoc", "Upgrade", "deprecate", "repair", "unit test", "other")])
    said = F.get(words, (F.col("page_id") % 7).cast("int"))
    return X.table(spark, sf_dir, "pages").select("page_id", tasks.infer_type(said)[0].alias("kind"))


_PARTS = f"""{_GRAPH}, g AS (SELECT filePath, count(*) AS n, max(CASE WHEN semanticType = '1-URGENT' THEN 4 WHEN semanticType = '2-HIGH' THEN 3 ELSE 1 END) AS rank FROM nodes WHERE coreType = 'Order' GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY rank DESC, filePath) - 1 AS k FROM g)"""


@query(f"{_PARTS} SELECT CAST(k AS INT) AS index, filePath, n, CASE rank WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' ELSE 'LOW' END AS level, CASE WHEN k >= 3 THEN 'normal' WHEN rank = 4 THEN 'critical' WHEN rank = 3 THEN 'high' ELSE 'normal' END AS priority FROM i")
def t12_decompose(spark, sf_dir):
    """A task per customer, urgent orders being critical."""
    n = X.graph(spark, sf_dir).nodes.where("coreType = 'Order'")
    level = F.when(F.col("semanticType") == "1-URGENT", "CRITICAL").when(F.col("semanticType") == "2-HIGH", "HIGH").otherwise("LOW")
    rows = n.select("id", level.alias("level"), F.array("filePath").alias("files"))
    return tasks.decompose(n, rows).select("index", "filePath", F.size("nodeIds").cast("long").alias("n"), "level", "priority")


# ---------------------------------------------------------------- messages and sessions


@query(f"{_MESSAGES} SELECT id, category FROM m WHERE expiresAt > 5 AND (toAgentId IS NULL OR toAgentId = 'assistant') AND coalesce(reader <> 'assistant', true) ORDER BY timestamp DESC, id LIMIT 20")
def m2_inbox(spark, sf_dir):
    return messages.inbox(X.messages(spark, sf_dir), "assistant", 5).select("id", "category")


@query(f"{_MESSAGES} SELECT id, array_to_string(list_sort(list_distinct(list_filter([reader, CASE WHEN (toAgentId IS NULL OR toAgentId = 'user') AND expiresAt > 5 THEN 'user' END], lambda x: x IS NOT NULL))), ',') AS readers FROM m")
def m3_acknowledged(spark, sf_dir):
    got = messages.acknowledged(X.messages(spark, sf_dir), "user", now=5)
    return got.select("id", F.concat_ws(",", F.array_sort("readBy")).alias("readers"))


@query(f"{_MESSAGES} SELECT id, CAST(list_position(['alert', 'conflict', 'blocked', 'request', 'finding', 'handoff'], category) - 1 AS INT) AS rank FROM m WHERE expiresAt > 5 AND (toAgentId IS NULL OR toAgentId = 'assistant') AND coalesce(reader <> 'assistant', true) ORDER BY 2, timestamp DESC, id LIMIT 10")
def m4_pending(spark, sf_dir):
    return messages.pending(X.messages(spark, sf_dir), "assistant", 5).select("id", F.col("rank").cast("int").alias("rank"))


@query(f"{_MESSAGES} SELECT id FROM m WHERE expiresAt > 7")
def m5_unexpired(spark, sf_dir):
    return messages.unexpired(X.messages(spark, sf_dir), 7).select("id")


def _bookmarks(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations")
    expires = F.when(F.col("turn") % 4 == 0, F.lit(0)).cast("long")
    return c.select(F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("sessionId"), F.col("turn").alias("createdAt"), F.col("role").alias("category"), expires.alias("expiresAt"))


_ROWS = "WITH b AS (SELECT concat(conv_id, '_', turn) AS id, conv_id AS sessionId, turn AS createdAt, role AS category, CASE WHEN turn % 4 = 0 THEN 0 END AS expiresAt FROM conversations)"


@query(f"{_ROWS} SELECT id FROM b QUALIFY row_number() OVER (PARTITION BY sessionId ORDER BY createdAt DESC, id DESC) > 3")
def n1_beyond_latest(spark, sf_dir):
    return sessions.beyond_latest(_bookmarks(spark, sf_dir)).select("id")


@query(f"{_ROWS} SELECT id, sessionId FROM b QUALIFY row_number() OVER (PARTITION BY sessionId ORDER BY createdAt DESC, id DESC) = 1")
def n2_latest(spark, sf_dir):
    return sessions.latest(_bookmarks(spark, sf_dir), ["sessionId"]).select("id", "sessionId")


@query(f"{_ROWS} SELECT b.id, l.id AS bookmarkId FROM b JOIN (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY sessionId ORDER BY createdAt DESC, id DESC) = 1) l USING (sessionId)")
def n3_linked_notes(spark, sf_dir):
    b = _bookmarks(spark, sf_dir)
    return sessions.link_notes(b, b).select("id", "bookmarkId")


@query(f"{_ROWS} SELECT id FROM b WHERE (expiresAt IS NULL OR expiresAt > 1) AND category = 'user' ORDER BY createdAt DESC, id LIMIT 25")
def k4_recall(spark, sf_dir):
    return sessions.recall(_bookmarks(spark, sf_dir), 1, 25, category="user").select("id")


@query(f"{_ROWS} SELECT (SELECT count(*) FROM b WHERE expiresAt <= 1) AS expired_notes, (SELECT count(*) FROM (SELECT 1 FROM b QUALIFY row_number() OVER (PARTITION BY sessionId ORDER BY createdAt DESC, id DESC) > 3)) AS old_bookmarks")
def k6_cleanup(spark, sf_dir):
    b = _bookmarks(spark, sf_dir)
    return sessions.cleanup(b, b, 1)[0]


@query(f"{_VECTORS}, s AS (SELECT vec_id, label, (1 + list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 0))) / 2 AS s FROM v ORDER BY s DESC, vec_id LIMIT 100) SELECT vec_id, round(s, 6) AS score FROM s WHERE label % 3 <> 0 AND s >= 0.3 ORDER BY s DESC, vec_id LIMIT 10")
def k3_vector_recall(spark, sf_dir):
    """Vectors as notes; those with a label divisible by three have expired."""
    v = X.table(spark, sf_dir, "embeddings")
    notes = v.select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("label") % 3 == 0, F.lit(0)).cast("long").alias("expiresAt"))
    return sessions.recall_by_vector(notes, _first_vector(spark, sf_dir), 1, 10).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- incremental, streaming


def _current(files: DataFrame) -> DataFrame:
    """One in ten files is gone, one in ten has another text, one in ten is copied to a new path."""
    k = F.col("doc_id") % 10
    kept = files.where(k != 0).withColumn("contentHash", F.when(k == 1, F.sha2(F.concat("contentHash", F.lit("!")), 256)).otherwise(F.col("contentHash")))
    return kept.unionByName(files.where(k == 2).withColumn("filePath", F.concat(F.lit("/src/"), (F.col("doc_id") + 1_000_000).cast("string"))))


@query("SELECT '/src/' || doc_id AS filePath, CASE doc_id % 10 WHEN 0 THEN 'deleted' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (0, 1) UNION ALL SELECT '/src/' || (doc_id + 1000000), 'new' FROM documents WHERE doc_id % 10 = 2")
def l1_changes(spark, sf_dir):
    files = X.files(spark, sf_dir)
    return incremental.changes(files, _current(files))


_CHANGED = f"{_GRAPH}, c AS (SELECT id FROM nodes WHERE filePath IN ('/nation/1/Customer', '/nation/2/Customer'))"


def _changed(spark):
    return spark.createDataFrame([("/nation/1/Customer",), ("/nation/2/Customer",)], "filePath string")


@query(f"{_CHANGED} SELECT edge_id FROM edges WHERE (src IN (SELECT id FROM c)) <> (dst IN (SELECT id FROM c))")
def l2_cross_file_edges(spark, sf_dir):
    return incremental.cross_file_edges(X.graph(spark, sf_dir), _changed(spark)).select("edge_id")


@query(f"{_CHANGED} SELECT id, coreType FROM nodes WHERE id NOT IN (SELECT id FROM c)")
def l3_known_nodes(spark, sf_dir):
    return incremental.known_nodes(X.graph(spark, sf_dir), _changed(spark)).select("id", "coreType")


@query(f"{_CHANGED}, gone AS (SELECT id FROM c WHERE CAST(substr(id, 3) AS INT) % 2 = 0) SELECT type, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY 1")
def l4_incremental_apply(spark, sf_dir):
    """Two files are parsed again; every second customer of them is gone then."""
    g, changed = X.graph(spark, sf_dir), _changed(spark)
    again = g.nodes.join(changed, "filePath", "left_semi").where(F.substring("id", 3, 20).cast("int") % 2 == 1)
    own = g.edges.join(again.select("id"), g.edges.src == F.col("id"), "left_semi").where("type = 'IN_NATION'")
    return incremental.apply(g, changed, again, own).edges.groupBy("type").agg(_n())


@query(f"{_CHANGED} SELECT count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM c) AND dst NOT IN (SELECT id FROM c)")
def w4_without_files(spark, sf_dir):
    return incremental.without_files(X.graph(spark, sf_dir), _changed(spark)).edges.agg(_n())


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey % 2)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate, o_orderkey % 2 ORDER BY o_orderkey) = 1) GROUP BY 1")
def w9_upsert(spark, sf_dir):
    """The latest order of each customer, even keys stored, odd ones new; a new one wins a tie."""
    o = X.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    k = F.row_number().over(W.partitionBy("o_custkey", "o_orderdate", F.col("o_orderkey") % 2).orderBy("o_orderkey"))
    o = o.withColumn("k", k).where("k = 1").drop("k")
    return incremental.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderdate")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e)
SELECT user_id, epoch_us(min(ts)) AS first, count(*) AS n FROM g GROUP BY user_id, g""")
def v1_debounce(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return stream.debounced(rows, "2 hours", ["user_id"], "at", detail=False).select("user_id", F.unix_micros("first").alias("first"), "n")


# ---------------------------------------------------------------- resolution and rules


@query(f"""{_GRAPH}, c AS (SELECT o.id AS src, p.id AS dst, p.name FROM edges e JOIN nodes o ON o.id = e.src JOIN nodes p ON p.id = e.dst WHERE e.type = 'HAS_ITEM')
SELECT src || '|' || name AS deferred_id, max(b.id) AS id FROM (SELECT DISTINCT src, name FROM c) d JOIN (SELECT id, name FROM nodes WHERE coreType = 'Part') b USING (name) GROUP BY 1""")
def p13_call_resolution(spark, sf_dir):
    """Orders call parts by name; of equal names the last written wins."""
    g = X.graph(spark, sf_dir)
    names = g.nodes.where("coreType = 'Part'").select(F.col("id").alias("dst"), "name")
    d = g.edges.where("type = 'HAS_ITEM'").join(names, "dst").select(F.concat_ws("|", "src", "name").alias("deferred_id"), F.col("src").alias("sourceNodeId"), F.col("name").alias("targetName")).distinct()
    none = F.lit(None).cast("string")
    d = d.select("*", F.lit("FunctionDeclaration").alias("targetType"), none.alias("receiverExpression"), none.alias("receiverType"))
    n = g.nodes.where("coreType = 'Part'").select("id", "name", F.lit("FunctionDeclaration").alias("coreType"), none.alias("parentClassName"), F.lit(0).alias("seq"))
    return resolve.resolve_calls(d, n).select("deferred_id", "id")


@query(f"{_GRAPH}, w AS (SELECT 'p' || page_id AS deferred_id, page_id, split_part(url, '/', -1) AS last FROM pages) SELECT w.deferred_id, 'F' || w.page_id AS id, CAST(3 AS INT) AS prio FROM w WHERE length(last) > 0 AND (SELECT count(*) FROM w x WHERE x.last = w.last) = 1 UNION ALL SELECT w.deferred_id, 'F' || (SELECT min(page_id) FROM w x WHERE x.last = w.last), 3 FROM w WHERE length(last) > 0 AND (SELECT count(*) FROM w x WHERE x.last = w.last) > 1")
def p12_import_resolution(spark, sf_dir):
    """Every page imports './<last part of its url>', pages being files src/<last part>.ts in order of id."""
    p = X.table(spark, sf_dir, "pages")
    last = F.substring_index("url", "/", -1)
    rows = p.select(F.col("page_id"), last.alias("last")).where("length(last) > 0")
    d = rows.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("deferred_id"), F.concat(F.lit("./"), "last").alias("targetName"), F.lit("SourceFile").alias("targetType"), F.lit(None).cast("string").alias("targetFilePath"))
    n = rows.select(F.concat(F.lit("F"), F.col("page_id").cast("string")).alias("id"), F.concat("last", F.lit(".ts")).alias("name"), F.lit("SourceFile").alias("coreType"), F.concat(F.lit("src/"), "last", F.lit(".ts")).alias("filePath"), F.col("page_id").alias("seq"))
    return resolve.resolve_names(d, n).select("deferred_id", "id", F.col("prio").cast("int").alias("prio"))


_TYPED = "WITH c AS (SELECT 'C' || p_partkey AS id, 'Part' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN 'Service' WHEN 1 THEN 'Repository' WHEN 2 THEN 'DAL' WHEN 3 THEN 'Controller' ELSE 'Dto' END AS name, '/src/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.module.ts' ELSE '.ts' END AS filePath FROM part)"


def _classes(spark, sf_dir):
    p = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    end = F.get(F.array(*[F.lit(x) for x in ("Service", "Repository", "DAL", "Controller", "Dto")]), (F.col("k") % 5).cast("int"))
    none = F.lit(None).cast("string")
    return p.select(
        "k", F.concat(F.lit("C"), "k").alias("id"), F.concat(F.lit("Part"), "k", end).alias("name"), F.concat(F.lit("/src/"), "k", F.when(F.col("k") % 3 == 0, ".module.ts").otherwise(".ts")).alias("filePath"),
        F.lit("ClassDeclaration").alias("coreType"), none.alias("semanticType"), F.array(F.lit("Class")).alias("labels"), F.array().cast("array<string>").alias("decorators"), none.alias("extendsName"), none.alias("typeAnnotation"),
    )


@query(f"{_TYPED} SELECT id, CASE WHEN filePath LIKE '%.module.ts' THEN 'NestModule' WHEN name LIKE '%Service' THEN 'NestService' WHEN name LIKE '%Dto' THEN 'DTOClass' WHEN name LIKE '%Controller' THEN 'Controller' WHEN name LIKE '%Repository' THEN 'Repository' WHEN name LIKE '%DAL' THEN 'DAL' END AS semanticType FROM c")
def p17_semantic_rules(spark, sf_dir):
    return rules.enhance_both(_classes(spark, sf_dir)).select("id", "semanticType")


@query("""WITH c AS (SELECT p_partkey AS k, 'C' || p_partkey AS id, p_partkey % 5 AS r FROM part), w AS (SELECT a.id AS src, b.id AS dst FROM c a JOIN c b ON b.k = a.k + 1 WHERE a.r = 1 AND b.r = 2)
SELECT 'SEM:' || substr(sha256('USES_DAL::' || src || '::' || dst), 1, 16) AS edge_id, src, dst, 0.85::DOUBLE AS relationshipWeight FROM w""")
def p26_uses_dal(spark, sf_dir):
    """Every repository names the class after it, which is a DAL."""
    n = rules.enhance(_classes(spark, sf_dir), rules.custom_rules())
    n = n.withColumn("dals", F.array(F.concat(F.lit("'Part"), F.col("k") + 1, F.lit("DAL'"))))
    return rules.uses_dal(n).select("edge_id", "src", "dst", "relationshipWeight")


@query("""SELECT 'SEM:' || substr(sha256('INJECTS::' || 'C' || a || '::' || 'C' || b), 1, 16) AS edge_id, 'C' || a AS src, 'C' || b AS dst FROM (SELECT p_partkey AS a, p_partkey + 5 AS b FROM part WHERE p_partkey + 5 IN (SELECT p_partkey FROM part))""")
def p22_nest_injects(spark, sf_dir):
    """Every class has the one five keys later as a parameter of its constructor."""
    n = _classes(spark, sf_dir)
    end = F.get(F.array(*[F.lit(x) for x in ("Service", "Repository", "DAL", "Controller", "Dto")]), (F.col("k") % 5).cast("int"))
    n = n.withColumn("constructorTypes", F.array(F.lit("string"), F.concat(F.lit("Part"), F.col("k") + 5, end))).withColumn("injectTokens", F.create_map().cast("map<int,string>"))
    return rules.nest_injects(n).select("edge_id", "src", "dst")


@query(f"{_GRAPH} SELECT 'coreType' AS dimension, coreType AS value, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'semanticType', semanticType, count(*) FROM nodes WHERE semanticType IS NOT NULL GROUP BY 2")
def p36_parse_stats(spark, sf_dir):
    return rules.parse_stats(X.graph(spark, sf_dir).nodes)


@query("""WITH f AS (SELECT page_id, '/w/pkg' || page_id % 7 || CASE WHEN page_id % 2 = 0 THEN '-kit' ELSE '' END || '/src/' || page_id || '.ts' AS filePath, page_id % 7 AS k, page_id % 2 AS odd FROM pages)
SELECT page_id, CASE WHEN odd = 1 AND k < 4 THEN 'p' || k END AS packageName FROM f""")
def s6_package_of(spark, sf_dir):
    p = X.table(spark, sf_dir, "pages")
    kit = F.when(F.col("page_id") % 2 == 0, "-kit").otherwise("")
    f = p.select("page_id", F.concat(F.lit("/w/pkg"), (F.col("page_id") % 7).cast("string"), kit, F.lit("/src/"), F.col("page_id").cast("string"), F.lit(".ts")).alias("filePath"))
    pk = spark.createDataFrame([(f"p{i}", f"/w/pkg{i}", i) for i in range(4)], "name string, path string, pos int")
    return workspace.package_of(f, pk).select("page_id", "packageName")


# ---------------------------------------------------------------- predicates and projections


@query(r"SELECT page_id, regexp_matches(url, '(main|app|index)\.ts$') OR url LIKE '%1' AS excluded, list_contains(string_split(url, '/'), 'a') AS has_a FROM pages")
def f16_suffix_excluded(spark, sf_dir):
    u = F.col("url")
    return X.table(spark, sf_dir, "pages").select("page_id", T.file_suffix_excluded(u, ["main.ts", "app.ts", "index.ts", "*1"]).alias("excluded"), F.array_contains(F.split(u, "/"), "a").alias("has_a"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/r/apps/shop/components/ui/' WHEN 1 THEN '/r/packages/core/' ELSE '/r/src/' END || page_id || '.tsx' AS p FROM pages)
SELECT page_id, page_id % 3 = 0 AS ui, page_id % 3 = 1 AS package, CASE page_id % 3 WHEN 0 THEN 'shop' WHEN 1 THEN 'core' END AS app FROM u""")
def f17_paths(spark, sf_dir):
    k = F.col("page_id") % 3
    path = F.concat(F.when(k == 0, "/r/apps/shop/components/ui/").when(k == 1, "/r/packages/core/").otherwise("/r/src/"), F.col("page_id").cast("string"), F.lit(".tsx"))
    return X.table(spark, sf_dir, "pages").select("page_id", T.is_ui_component(path).alias("ui"), T.is_package_export(path).alias("package"), T.app_name(path).alias("app"))


@query("SELECT page_id, CASE WHEN length(html) <= 100 THEN html ELSE substr(html, 1, 50) || ' ... ' || right(html, 50) END AS middle, CASE WHEN length(html) > 0 THEN substr(html, 1, 500) END AS head FROM pages")
def f18_truncate(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", T.head_and_tail(F.col("html"), 100, " ... ").alias("middle"), T.truncated(F.col("html")).alias("head"))


@query("SELECT page_id, array_to_string(list_slice(string_split(url, '/'), greatest(1, len(string_split(url, '/')) - 1), len(string_split(url, '/'))), '/') AS short FROM pages")
def f20_short_path(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", T.short_path(F.col("url")).alias("short"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace('import(\"x\").' || p_brand || '<' || p_type || '>[]', 'import\([^)]*\)\.', '', 'g'), '<.*>(\[\])*$', '')) AS clean FROM part".replace('\\"', '"'))
def p37_clean_type(spark, sf_dir):
    text = F.concat(F.lit('import("x").'), "p_brand", F.lit("<"), "p_type", F.lit(">[]"))
    return X.table(spark, sf_dir, "part").select("p_partkey", T.clean_type(text).alias("clean"))


@query("SELECT doc_id, concat_ws(' ', lang, source) || chr(10) || substr(text, 1, 24000) AS t FROM documents WHERE length(text) > 0")
def p38_embedding_text(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.embedding_text(F.col("lang"), F.col("source"), F.col("text")).alias("t")).where("t is not null")


# ---------------------------------------------------------------- more of sources, rules and coordination


@query(r"SELECT page_id, contains(url, '/1') OR regexp_matches(url, '2$') OR contains(url, '2$') OR contains(url, '([') AS skipped FROM pages")
def s2_skipped_files(spark, sf_dir):
    """Patterns as literals and as expressions; the last one is no expression."""
    return X.table(spark, sf_dir, "pages").select("page_id", T.skipped_file(F.col("url"), ["/1", "2$", "(["]).alias("skipped"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey = 7 THEN 'complete' ELSE 'parsing' END AS status, CAST(CASE WHEN n_nationkey = 7 THEN 9 ELSE 1 END AS BIGINT) AS updatedAt, CAST(CASE WHEN n_nationkey = 7 THEN 42 ELSE 0 END AS BIGINT) AS nodeCount FROM nation")
def w10_project_status(spark, sf_dir):
    p = X.table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), "n_nationkey").alias("projectId"), F.col("n_name").alias("name"), F.lit("parsing").alias("status"), F.lit(1).cast("long").alias("updatedAt"), F.lit(0).cast("long").alias("nodeCount"))
    done = incremental.project_status(p, "p7", "complete", 9, nodes=42)
    return incremental.project_status(done, "unknown", "failed", 10).select("name", "status", "updatedAt", "nodeCount")


@query("""SELECT event_id, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS who, event_type FROM events""")
def w12_flattened(spark, sf_dir):
    from .sources.files import flattened

    return flattened(X.table(spark, sf_dir, "events").select("event_id", F.struct("user_id", "event_type").alias("who"), "event_type"))


@query("""SELECT 'CONTAINS:' || substr(sha256('CONTAINS::' || concat('N:', n_nationkey) || '::' || concat('R:', n_regionkey)), 1, 16) AS edge_id, 0.4::DOUBLE AS relationshipWeight, 1.0::DOUBLE AS confidence FROM nation""")
def p15_core_edges(spark, sf_dir):
    pairs = X.table(spark, sf_dir, "nation").select(F.lit("CONTAINS").alias("type"), F.concat(F.lit("N:"), "n_nationkey").alias("src"), F.concat(F.lit("R:"), "n_regionkey").alias("dst"))
    return resolve.core_edges(pairs, graph.EDGE_WEIGHTS).select("edge_id", "relationshipWeight", "confidence")


@query("SELECT o_orderstatus AS context_key, CAST(o_custkey % 10 AS VARCHAR) AS map_key, CAST(max(o_orderkey) AS VARCHAR) AS value FROM orders GROUP BY 1, 2")
def p34_merged_context(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    return resolve.merged_context(o.select(F.col("o_orderstatus").alias("context_key"), (F.col("o_custkey") % 10).cast("string").alias("map_key"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderkey").alias("seq")))


@query("SELECT o_custkey AS id, max(o_orderkey) AS seq FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY 1")
def p35_new_only(spark, sf_dir):
    """Customers of stored nations are there already; of the others the last order counts."""
    there = X.table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("id"))
    return resolve.new_only(X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq")), there).select("id", "seq")


@query("SELECT CAST(p_partkey AS VARCHAR) AS deferred_id, CASE p_partkey % 2 WHEN 0 THEN 'MailProvider' ELSE 'UserRepository' END AS \"receiverType\" FROM part")
def p9_property_types(spark, sf_dir):
    p = X.table(spark, sf_dir, "part")
    calls = p.select(F.col("p_partkey").cast("string").alias("deferred_id"), F.lit("c").alias("classId"), F.when(F.col("p_partkey") % 2 == 0, "mailService").otherwise("userRepo").alias("receiverPropertyName"))
    types = spark.createDataFrame([("c", "MailProvider", 0), ("c", "UserRepository", 1), ("c", "MailerService", 2)], "classId string, typeName string, pos int")
    return resolve.property_types(calls, types)


def _framework(spark, sf_dir):
    """A controller, a method and a service for every part, one of five in another file."""
    p = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    none = F.lit(None).cast("string")
    word = lambda x: F.concat(F.lit(x), "k")
    c = p.select(word("C").alias("id"), word("K").alias("name"), F.lit("ClassDeclaration").alias("coreType"), F.lit("NestController").alias("semanticType"), word("/f").alias("filePath"), none.alias("parentClassName"), F.concat(F.lit("/b"), "k", F.lit("/")).alias("basePath"), none.alias("httpMethod"), none.alias("path"))
    m = p.select(word("M").alias("id"), word("m").alias("name"), F.lit("MethodDeclaration").alias("coreType"), F.when(F.col("k") % 2 == 0, "HttpEndpoint").otherwise("MessageHandler").alias("semanticType"), F.when(F.col("k") % 5 == 0, "/other").otherwise(word("/f")).alias("filePath"), word("K").alias("parentClassName"), none.alias("basePath"), F.lit("GET").alias("httpMethod"), F.lit("/:id").alias("path"))
    return c.unionByName(m).withColumn("statusCode", F.lit(None).cast("int"))


@query("""SELECT 'C' || p_partkey AS src, 'M' || p_partkey AS dst, CASE WHEN p_partkey % 2 = 0 THEN '/b' || p_partkey || '/:id' END AS "fullPath" FROM part WHERE p_partkey % 5 <> 0""")
def p23_exposes(spark, sf_dir):
    """And p24: message handlers and HTTP endpoints of the controller's class and file."""
    return rules.nest_exposes(_framework(spark, sf_dir)).select("src", "dst", F.get_json_object("context", "$.fullPath").alias("fullPath"))


def _custom(spark, sf_dir):
    """Parts as classes in turn: controller, permission manager, service, repository, routes."""
    p = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    kind = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("k") % 5).cast("int"))
    name = F.concat(F.lit("X"), "k")
    near = lambda d: F.concat(F.lit("'X"), F.col("k") + d, F.lit("'"))
    route = F.struct(F.lit("GET").alias("method"), F.concat(F.lit("/"), "k").alias("path"), F.concat(F.lit("X"), F.col("k") + 1).alias("controllerName"), F.lit("run").alias("handler"), F.lit(True).alias("authenticated"))
    classes = p.select(
        F.concat(F.lit("I"), "k").alias("id"), name.alias("name"), F.lit("ClassDeclaration").alias("coreType"), kind("Controller", "PermissionManager", "Service", "Repository", "RouteDefinition").alias("semanticType"), F.lit("/x.ts").alias("filePath"),
        F.lit(None).cast("string").alias("parentClassName"), F.when(F.col("k") % 5 == 0, near(1)).alias("permissionManager"), F.array(near(1)).alias("dependencies"), F.array().cast("array<string>").alias("propertyTypes"), F.array(route).alias("routes"), F.lit("public").alias("visibility"),
    )
    methods = p.where("k % 5 = 0").select(F.concat(F.lit("R"), "k").alias("id"), F.lit("run").alias("name"), F.lit("MethodDeclaration").alias("coreType"), F.lit("/x.ts").alias("filePath"), name.alias("parentClassName"), F.lit("public").alias("visibility"))
    return classes.unionByName(methods, allowMissingColumns=True)


_NEXT = "SELECT p_partkey AS k FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)"


@query(f"SELECT 'I' || k AS src, 'I' || (k + 1) AS dst FROM ({_NEXT})")
def p25_custom_injects(spark, sf_dir):
    return rules.custom_injects(_custom(spark, sf_dir)).select("src", "dst")


@query(f"SELECT 'I' || k AS src, 'I' || (k + 1) AS dst, 0.88::DOUBLE AS w FROM ({_NEXT}) WHERE k % 5 = 0")
def p27_protected_by(spark, sf_dir):
    return rules.protected_by(_custom(spark, sf_dir)).select("src", "dst", F.col("relationshipWeight").alias("w"))


@query(f"SELECT 'I' || k AS src, 'I' || (k + 1) AS dst, '/' || k AS path FROM ({_NEXT}) WHERE k % 5 = 4")
def p28_routes_to(spark, sf_dir):
    return rules.routes_to(_custom(spark, sf_dir)).select("src", "dst", F.get_json_object("context", "$.paths[0]").alias("path"))


@query(f"SELECT 'I' || k AS src, 'R' || (k + 1) AS dst FROM ({_NEXT}) WHERE k % 5 = 4")
def p29_routes_to_handler(spark, sf_dir):
    return rules.routes_to_handler(_custom(spark, sf_dir)).select("src", "dst")


@query(f"SELECT 'I' || k AS src, 'I' || (k + 1) AS dst FROM ({_NEXT}) WHERE k % 5 = 2")
def p30_uses_repository(spark, sf_dir):
    return rules.uses_repository(_custom(spark, sf_dir)).select("src", "dst")


@query(f"{_GRAPH} SELECT DISTINCT id FROM nodes WHERE filePath LIKE '%/1/Customer' OR filePath LIKE '%/cust/7' UNION SELECT '/1/Customer' UNION SELECT '/cust/7'")
def h5_nodes_of_files(spark, sf_dir):
    return markers.nodes_of_files(X.graph(spark, sf_dir).nodes, spark.createDataFrame([("/1/Customer",), ("/cust/7",)], "path string"))


@query(f"SELECT type, count(*) AS n FROM ({_MARKERS}) WHERE NOT (nodeId = 'k1' AND agentId = 'a1' AND type = 'exploring') GROUP BY 1")
def h8_removed(spark, sf_dir):
    return markers.removed(X.markers(spark, sf_dir), "k1", "a1", "s1", "exploring").groupBy("type").agg(_n())


_PARTS2 = "WITH p AS (SELECT c_custkey AS k, '/c/' || c_custkey AS f, '/c/' || (c_custkey * 2) AS t, CASE c_custkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS level FROM customer), d AS (SELECT f, t FROM p WHERE f <> t AND t IN (SELECT f FROM p))"


def _customer_parts(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    level = F.when(F.col("k") % 4 == 0, "CRITICAL").when(F.col("k") % 4 == 1, "HIGH").otherwise("LOW")
    file = lambda x: F.concat(F.lit("/c/"), x.cast("string"))
    return c.select(file(F.col("k")).alias("filePath"), level.alias("level"), F.array(file(F.col("k") * 2), file(F.col("k"))).alias("affected"))


@query(f'{_PARTS2} SELECT f AS "filePath", t AS "dependsOn" FROM d')
def t13_dependencies(spark, sf_dir):
    return tasks.dependencies(_customer_parts(spark, sf_dir)).select("filePath", "dependsOn")


@query(f"{_PARTS2} SELECT round(CAST(least(count(*) / 10.0, 3.0) + 1.5 * count(*) FILTER (level = 'CRITICAL') + 0.5 * count(*) FILTER (level = 'HIGH') + 0.3 * 1 AS DOUBLE), 6) AS score, 'HIGH' AS complexity FROM p")
def t15_complexity(spark, sf_dir):
    p = _customer_parts(spark, sf_dir)
    return tasks.complexity(p, tasks.dependencies(p)).select(F.round("score", 6).alias("score"), "complexity")


@query(f"""{_PARTS2} SELECT f AS "filePath" FROM p WHERE f NOT IN ('/c/2', '/c/4') AND f NOT IN (SELECT f FROM d WHERE t NOT IN ('/c/2', '/c/4'))""")
def t16_parallelisable(spark, sf_dir):
    p = _customer_parts(spark, sf_dir)
    return tasks.parallelisable(p, tasks.dependencies(p), ["/c/2", "/c/4"]).select("filePath")


_STATES = "CASE event_type WHEN 'click' THEN 'working' WHEN 'view' THEN 'claiming' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'idle' ELSE 'failed' END"


@query(f"""WITH l AS (SELECT user_id, arg_max({_STATES}, epoch_us(ts)) AS s, max(epoch_us(ts)) AS seen FROM events GROUP BY 1), w AS (SELECT CASE WHEN s IN ('claiming', 'working') AND {NOW} - seen > 86400000000 THEN 'timeout' ELSE s END AS s FROM l)
SELECT count(*) AS total, count(*) FILTER (s IN ('working', 'claiming')) AS active, count(*) FILTER (s = 'idle') AS idle, count(*) FILTER (s = 'timeout') AS timed_out FROM w""")
def a19_worker_stats(spark, sf_dir):
    """And t17: the latest state of each worker, a day of silence being too long."""
    state = F.expr(_STATES)
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("workerId"), state.alias("state"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return tasks.worker_stats(tasks.workers(e, NOW, 86_400_000_000))


@query(f"""{_GRAPH}, b AS (SELECT unnest(['P:1', 'C:2', 'gone', 'P:2']) AS id) SELECT b.id, n.id IS NOT NULL AS found, n.filePath AS "filePath" FROM b LEFT JOIN nodes n ON n.id = b.id""")
def k2_working_set(spark, sf_dir):
    b = spark.createDataFrame([(["P:1", "C:2", "gone", "P:2"],)], "workingSetNodeIds array<string>")
    return sessions.working_set(b, X.graph(spark, sf_dir).nodes).select("id", "found", "filePath")


@query(f"{_ROWS} SELECT id FROM b WHERE (expiresAt IS NULL OR expiresAt > 1) AND sessionId = 3 ORDER BY createdAt, id LIMIT 50")
def k5_session_notes(spark, sf_dir):
    return sessions.recall(_bookmarks(spark, sf_dir), 1, 50, oldest_first=True, sessionId=3).select("id")


@query(f"{_CODE}, g AS (SELECT h, count(*) AS k FROM n WHERE length(h) > 0 GROUP BY 1 HAVING count(*) >= 2) SELECT 'structural' AS type, count(*) AS groups, CAST(sum(k) AS BIGINT) AS items FROM g HAVING count(*) > 0")
def d15_duplicate_stats(spark, sf_dir):
    g = duplicates.structural_groups(duplicates.structural_items(_code_nodes(spark, sf_dir)))
    return duplicates.stats(g)


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e), l AS (SELECT user_id, g, event_id % 3 AS f, arg_max(event_type, ts) AS t FROM g GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS "projectId", '/' || f || '.ts' AS "filePath", CASE WHEN t = 'error' THEN 'deleted' ELSE 'changed' END AS change, count(*) AS n FROM l GROUP BY ALL""")
def v3_batch_changes(spark, sf_dir):
    """The last event of each file in every debounced batch; errors stand for unlinked files."""
    e = X.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "unlink").otherwise("change")
    rows = e.select(F.col("user_id").cast("string").alias("who"), kind.alias("type"), F.concat(F.lit("/"), (F.col("event_id") % 3).cast("string"), F.lit(".ts")).alias("filePath"), F.col("ts").cast("timestamp").alias("ts"))
    batches = stream.debounced(rows.withColumnRenamed("who", "projectId"), "2 hours")
    one = batches.withColumn("projectId", F.concat_ws("|", "projectId", F.unix_micros("first").cast("string")))
    last = stream.latest_changes(one)
    return last.groupBy(F.substring_index("projectId", "|", 1).alias("projectId"), "filePath", "change").agg(_n())


from . import queries_more  # noqa: E402,F401
