"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row per source.

    Sources in order of code point, null last, weigh 1, 2, 3, 1, ...; they share
    the sum of all sizes.  No target exceeds ``most`` times its source's size:
    sources are taken by rising size per weight, and each gets its share of what
    the ones before it left, or its limit.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    by = W.orderBy(F.col("source_size") * F.lit(6) / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    everything = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select(
        "source", "source_size", "weight",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)).alias("gone"),
        F.sum("weight").over(after).alias("left"),
    )
    share = (F.col("total") - F.col("gone")).cast("double") * F.col("weight") / F.col("left")
    limit = (F.col("source_size") * most).cast("double")
    rows = rows.withColumn("capped", share > limit)
    # Those below their limit share what all capped sources left.
    rows = rows.withColumn("cut", F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size") * most)).over(everything), F.lit(0)))
    rows = rows.withColumn("weights", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
    free = (F.col("total") - F.col("cut")).cast("double") * F.col("weight") / F.col("weights")
    return rows.select("source", "source_size", F.when(F.col("capped"), limit).otherwise(F.least(free, limit)).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, ranges: int = 3) -> DataFrame:
    """A row per document: (doc_id, source, mark, size, source_size, target, taken).

    Keys are the MD5 of the id: hash-random, the same in every run.  Documents
    are range-sorted by key within their source; the ranges are the first
    ``ranges`` hex digits of the key, so a hot source is spread over 16 ** ranges
    groups.  Sums per range give each range's offset, a window inside it the rest
    of the prefix sum.  A source's budget is its target, rounded: whole epochs
    first, then documents in key order, of which the last counts in part, up to
    the exact budget.  Null texts and texts without words have size 0 and are
    never taken.  Rows with one id, or none, are ordered by size and by ``mark``,
    the MD5 of the text; equal rows are interchangeable.
    """
    source = F.col(source_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("group"),
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("mark"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"), C.n_words(F.col(text_col)).alias("size"),
    )
    rows = C.cut(rows.withColumn("range", F.substring("key", 1, ranges)))
    sums = C.cut(rows.groupBy("source", "group", "range").agg(F.sum("size").alias("range_size")))
    goal = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), most)
    goal = goal.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("group"), "source_size", "target")
    upto = W.partitionBy("group").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("group", "range", F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("offset"))
    offsets = C.cut(offsets.join(goal, "group"))
    inside = W.partitionBy("group", "range").orderBy("key", "size", "mark").rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["group", "range"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long")
    return out.select("doc_id", "source", "mark", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"))


def mix(docs: DataFrame, most: int = 3) -> DataFrame:
    """``docs`` as the mix holds them: rows repeated by epoch.

    ``docs`` has columns named doc_id, source and text; others stay as they are.

    Only the one document of a source at which the budget ends may come in part,
    cut after a word; its n_chars follows.  Documents without words are not part
    of a mix by words and go.
    """
    # Columns by position while internal ones are about, whatever their names are.
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = at["text"]

    def row_key(doc_id, source, mark):
        named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (doc_id, source)]
        return F.md5(F.concat_ws("\x00", *named, mark).cast("binary"))

    chosen = plan(docs, most=most).where("taken > 0").select(row_key("doc_id", "source", F.col("mark")).alias("_key"), "size", "taken")
    chosen = chosen.groupBy("_key").agg(F.max("size").alias("_size"), F.sort_array(F.collect_list("taken"), False).alias("_all"))
    mark = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    rows = docs.toDF(*at.values()).withColumn("_key", row_key(at["doc_id"], at["source"], mark))
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy("_key").orderBy(F.lit(0))))
    rows = rows.join(chosen, "_key").withColumn("_taken", F.get("_all", F.col("_nth") - 1)).where("_taken > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))))
    words = F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")
    rows = rows.withColumn("_words", words).withColumn("_cut", F.col("_words") < F.col("_size"))
    # The words up to the budget's end, with the blanks before each.
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    short = F.array_join(F.slice(parts, F.lit(1), F.col("_words").cast("int")), "")
    rows = rows.withColumn(text, F.when(F.col("_cut"), short).otherwise(F.col(text)))
    if "n_chars" in at:
        rows = rows.withColumn(at["n_chars"], F.when(F.col("_cut"), F.length(text).cast("long")).otherwise(F.col(at["n_chars"])))
    return rows.select(*at.values()).toDF(*docs.columns)
