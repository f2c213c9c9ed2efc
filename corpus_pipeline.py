"""A corpus pipeline of five of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the docs of the next one.  All but the last return the columns
of ``documents``; further columns of ``docs`` stay, whatever their names.

A null text counts as empty everywhere and is empty from line_dedup on; texts
without words end at the mix, which has no words to take from them.  Rows without
doc_id are judged and kept like others, near copies of rows with one go first.
Equal rows are near copies of each other.  Texts of any length go whole.  An empty
table stays empty, through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphweave.llm import bpe, common, lines, mixing, quality, queries, shingles
from graphweave.storage import delete


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels it rejects none."""
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten documents or more hold; a text can become empty."""
    return lines.drop_lines(docs, least_docs=10, least_chars=1)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of SimHash links and of five-word Jaccard similarities of 0.8 or more; all texts without words are one."""
    return shingles.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources, null among them, at their target weights, documents repeated by epoch; at most one a source is cut."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, repeats included, with digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, queries.vocabulary_path(), with_ids=True)


STAGES = [("quality", good_quality), ("line_dedup", without_common_lines), ("near_dedup", without_near_copies), ("mix", mixed), ("bpe", encoded)]

#: Classifier, SimHash and BPE are beyond SQL; tests hold run() against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole table of documents; a stage's table goes when the next one's is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
