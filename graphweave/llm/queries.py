"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, forest, lines, lm, mixing, quality, simhash, warc
from .common import table

#: Path of the vocabulary file; GRAPHWEAVE_VOCABULARY names another one.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    given = os.environ.get("GRAPHWEAVE_VOCABULARY")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_turns(rows.union(extra))).drop("expanded_tokens")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"), least_docs=10, least_chars=1)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict:
    found = [op1_quality_nbsvm, op2_bpe, op3_simhash, op4_chat, op5_lm, op6_mixing, op7_ann, op8_embedding_dedup, op9_line_dedup, op10_warc]
    return {f.__name__: f for f in found}


_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

_OP4 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
made AS (SELECT *, regexp_replace(text, '(\\|</?turn>|### |<\|(?:image|audio|document)\|>)', '\\\1', 'g') AS body FROM rows)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(body) + 20) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""

_OP6 = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key, md5(coalesce(text, '')) AS mark,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source),
ranked AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY source_size * 6 // weight, source NULLS LAST) AS k FROM sums),
steps AS (
  SELECT *, coalesce(sum(source_size * 3) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ranked),
marked AS (SELECT *, CAST(total - gone AS DOUBLE) * weight / rest > source_size * 3 AS capped FROM steps),
goals AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(source_size * 3 AS DOUBLE) ELSE
      least(CAST(total - coalesce(sum(CASE WHEN capped THEN source_size * 3 END) OVER (), 0) AS DOUBLE) * weight
        / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), CAST(source_size * 3 AS DOUBLE)) END AS target
  FROM marked),
placed AS (
  SELECT docs.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM docs),
met AS (
  SELECT doc_id, size, goals.source_size, target, before, CAST(round(target) AS BIGINT) AS budget
  FROM placed JOIN goals ON placed.source IS NOT DISTINCT FROM goals.source),
told AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM met)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM told
"""

_OP7 = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_USABLE}),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, 
    sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM d)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

_OP8 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_USABLE}),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(least(vec_id, coalesce(c.least, vec_id)) AS BIGINT) AS component_id,
  vec_id <= coalesce(c.least, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

_OP9 = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
pos AS (
  SELECT r, doc_id, i, lines[i] AS line, lower_key AS key
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM rows),
  LATERAL (SELECT translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key)),
often AS (SELECT key FROM pos WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (often.key IS NOT NULL) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often.key IS NULL), '')) AS kept_sha256
FROM pos LEFT JOIN often ON pos.key = often.key GROUP BY r, doc_id
"""

_OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT *, CAST(from_hex(sha1(html)) AS BIT)::VARCHAR AS bits FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
      + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


def oracle_sql() -> dict[str, str]:
    """None for op1, op2, op3 and op5: hinge-loss and neural training, BPE merges and XXH64 are not SQL's."""
    return {"op4_chat": _OP4, "op6_mixing": _OP6, "op7_ann": _OP7, "op8_embedding_dedup": _OP8, "op9_line_dedup": _OP9, "op10_warc": _OP10}
