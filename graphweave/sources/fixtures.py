"""Graph and entity tables made from the driver's tables.

The texts are SQL that both engines run, so that oracles start from the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import PropertyGraph
from ..storage import exists, shared_dir

PROJECT = "proj_6b02d0f4a6f1"

NODES = f"""
SELECT id, '{PROJECT}' AS projectId, name, coreType, semanticType, filePath, isExported, visibility, CAST(k % 1000 AS INT) AS startLine FROM (
  SELECT concat('R:', r_regionkey) AS id, r_name AS name, 'Region' AS coreType, CAST(NULL AS VARCHAR(40)) AS semanticType, '/region' AS filePath, false AS isExported, 'public' AS visibility, r_regionkey AS k FROM {{region}}
  UNION ALL SELECT concat('N:', n_nationkey), n_name, 'Nation', NULL, concat('/nation/', n_nationkey, '/Nation'), false, 'public', n_nationkey FROM {{nation}}
  UNION ALL SELECT concat('C:', c_custkey), c_name, 'Customer', c_mktsegment, concat('/nation/', c_nationkey, '/Customer'), false, 'public', c_custkey FROM {{customer}}
  UNION ALL SELECT concat('S:', s_suppkey), s_name, 'Supplier', NULL, concat('/nation/', s_nationkey, '/Supplier'), false, 'public', s_suppkey FROM {{supplier}}
  UNION ALL SELECT concat('P:', p_partkey), p_name, 'Part', p_type, concat('/brand/', p_brand), true, 'public', p_partkey FROM {{part}}
  UNION ALL SELECT concat('O:', o_orderkey), concat('', o_orderkey), 'Order', o_orderpriority, concat('/cust/', o_custkey), true, CASE WHEN o_orderstatus = 'P' THEN 'private' ELSE 'public' END, o_orderkey FROM {{orders}}) t
"""

_LINE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"

EDGES = f"""
SELECT edge_id, type, src, dst, '{PROJECT}' AS projectId, CAST(weight AS DOUBLE) AS relationshipWeight, CAST(line AS INT) AS lineNumber FROM (
  SELECT concat('IN_REGION:', n_nationkey) AS edge_id, 'IN_REGION' AS type, concat('N:', n_nationkey) AS src, concat('R:', n_regionkey) AS dst, CAST(NULL AS DOUBLE) AS weight, 0 AS line FROM {{nation}}
  UNION ALL SELECT concat('IN_NATION:C', c_custkey), 'IN_NATION', concat('C:', c_custkey), concat('N:', c_nationkey), 0.60, 0 FROM {{customer}}
  UNION ALL SELECT concat('IN_NATION:S', s_suppkey), 'IN_NATION', concat('S:', s_suppkey), concat('N:', s_nationkey), 0.60, 0 FROM {{supplier}}
  UNION ALL SELECT concat('PLACED_BY:', o_orderkey), 'PLACED_BY', concat('O:', o_orderkey), concat('C:', o_custkey), 0.85, 0 FROM {{orders}}
  UNION ALL SELECT concat('HAS_ITEM:', l_orderkey, ':', {_LINE}), 'HAS_ITEM', concat('O:', l_orderkey), concat('P:', l_partkey), 0.55, l_linenumber FROM {{lineitem}}
  UNION ALL SELECT concat('SUPPLIES:', l_suppkey, ':', l_partkey), 'SUPPLIES', concat('S:', l_suppkey), concat('P:', l_partkey), 0.75, 0 FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {{lineitem}}) s) t
"""

#: Lineitems the other way round, for the fixtures of unreferenced code.
REVERSED = f"""
SELECT concat('ITEM_OF:', l_orderkey, ':', {_LINE}) AS edge_id, 'ITEM_OF' AS type, concat('P:', l_partkey) AS src, concat('O:', l_orderkey) AS dst,
  '{PROJECT}' AS projectId, CAST(0.50 AS DOUBLE) AS relationshipWeight, CAST(l_linenumber AS INT) AS lineNumber, l_returnflag AS flag FROM {{lineitem}}
"""

MARKERS = """
SELECT CAST(event_id AS BIGINT) AS id, concat('k', json_k) AS nodeId, concat('a', user_id) AS agentId, 's1' AS swarmId, type, least(value / 500, 1.0) AS intensity, ts, halfLife
FROM (SELECT event_id, user_id, value, {micros} AS ts, {json} AS json_k,
  CASE event_type WHEN 'click' THEN 'exploring' WHEN 'view' THEN 'claiming' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'warning' ELSE 'blocked' END AS type,
  CASE event_type WHEN 'click' THEN 120000 WHEN 'view' THEN 3600000 WHEN 'purchase' THEN 86400000 WHEN 'signup' THEN -1 ELSE 300000 END * CAST(1000000 AS BIGINT) AS halfLife
  FROM {events}) e
"""

TASKS = """
SELECT concat('t', o_orderkey) AS id, concat('w', o_custkey) AS swarmId, o_orderkey AS k, concat('', o_custkey) AS owner,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'normal' WHEN '4' THEN 'low' ELSE 'backlog' END AS priority,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 100 WHEN '2' THEN 75 WHEN '3' THEN 50 WHEN '4' THEN 25 ELSE 0 END AS priorityScore,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'available' ELSE 'blocked' END AS status, {micros} AS createdAt
FROM {orders}
"""

#: Every order waits for the one before it of the same customer.
DEPENDS = """
SELECT concat('t', o_orderkey) AS taskId, concat('t', before) AS dependsOn
FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM {orders}) o WHERE before IS NOT NULL
"""

MESSAGES = """
SELECT concat('m', conv_id, '_', turn) AS id, concat('w', conv_id) AS swarmId, role AS fromAgentId,
  CASE WHEN turn % 3 = 0 THEN NULL WHEN role = 'user' THEN 'assistant' ELSE 'user' END AS toAgentId,
  CASE turn % 6 WHEN 0 THEN 'blocked' WHEN 1 THEN 'conflict' WHEN 2 THEN 'finding' WHEN 3 THEN 'request' WHEN 4 THEN 'alert' ELSE 'handoff' END AS category,
  turn AS timestamp, turn + 4 AS expiresAt, CASE WHEN turn % 2 = 0 THEN role END AS reader
FROM {conversations}
"""

FILES = """SELECT concat('/src/', doc_id) AS filePath, doc_id AS mtime, n_chars AS size, {hash} AS contentHash, doc_id FROM {documents}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build(spark: SparkSession, sf_dir: str, text: str, **words: str) -> DataFrame:
    """A fixture's rows: table names in braces become tables, other names the given words."""
    import re

    for k, v in words.items():
        text = text.replace("{" + k + "}", v)
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def oracle_text(text: str, **words: str) -> str:
    import re

    for k, v in words.items():
        text = text.replace("{" + k + "}", v)
    return re.sub(r"\{(\w+)\}", r"\1", text)


_STORED: dict[tuple[str, str], str] = {}


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The fixture graph as a stored one, written to the shared folder at first use by a session.

    Edges are partitioned by type and sorted by source, so that filters by type and
    by a frontier of ids prune files and row groups.
    """
    from pyspark.sql import functions as F

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED or not exists(spark, f"{_STORED[key]}/edges/_SUCCESS"):
        path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
        nodes = build(spark, sf_dir, NODES).withColumn("labels", F.array("coreType", F.lit("GraphNode")))
        nodes.write.parquet(f"{path}/nodes")
        build(spark, sf_dir, EDGES).sortWithinPartitions("type", "src").write.partitionBy("type").parquet(f"{path}/edges")
        _STORED[key] = path
    return PropertyGraph(spark.read.parquet(f"{_STORED[key]}/nodes"), spark.read.parquet(f"{_STORED[key]}/edges"))


def markers(spark, sf_dir):
    return build(spark, sf_dir, MARKERS, micros="unix_micros(CAST(ts AS TIMESTAMP))", json="get_json_object(props, '$.k')")


def tasks(spark, sf_dir):
    return build(spark, sf_dir, TASKS, micros="unix_micros(CAST(o_orderdate AS TIMESTAMP))")


def depends(spark, sf_dir):
    return build(spark, sf_dir, DEPENDS)


def messages(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = build(spark, sf_dir, MESSAGES)
    return rows.withColumn("readBy", F.when(F.col("reader").isNotNull(), F.array("reader")).otherwise(F.array().cast("array<string>"))).drop("reader")


def files(spark, sf_dir):
    return build(spark, sf_dir, FILES, hash="sha2(text, 256)")
