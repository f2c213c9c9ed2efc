"""Bookmarks and notes of sessions: the latest, recall by filter or vector, and clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .search import vector_search

#: Bookmarks that stay per session.
KEEP = 3
# Labels of what agents keep among themselves.
HIDDEN = ("Pheromone", "SwarmTask", "SessionBookmark", "SessionNote")


# What a bookmark and a note can't be without, and the shortest summary.
BOOKMARK_NEEDS, NOTE_NEEDS, SHORTEST_SUMMARY = ["summary", "taskContext", "workingSetNodeIds"], ["topic", "content", "category"], 10


def kind_to_save(given: dict, kind: str = "auto") -> str:
    """bookmark, note or both; raises if what they need is missing.

    Left to itself a working set makes a bookmark, topic with content a note.
    """
    has = {k for k, v in given.items() if v}
    if kind == "auto":
        parts = [k for k, need in (("bookmark", {"workingSetNodeIds"}), ("note", {"topic", "content"})) if need <= has]
        if not parts:
            raise ValueError("a working set makes a bookmark, topic and content make a note; neither is given")
        kind = parts[0] if len(parts) == 1 else "both"
    needs = (BOOKMARK_NEEDS if kind != "note" else []) + (NOTE_NEEDS if kind != "bookmark" else [])
    missing = [k for k in needs if k not in has]
    if missing:
        raise ValueError(f"a {kind} needs {', '.join(missing)}")
    if kind != "note" and len(given["summary"]) < SHORTEST_SUMMARY:
        raise ValueError(f"a summary has at least {SHORTEST_SUMMARY} characters")
    return kind


def saved(rows: DataFrame, new: DataFrame, nodes: DataFrame, links_col: str, now: int, exclude=HIDDEN) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with the new bookmarks or notes, stamped now; their links (id, nodeId) to nodes that exist).

    Notes have ``expiresInHours``, which gives expiresAt; 0 or none never expires.
    """
    fine = nodes
    for label in exclude:
        fine = fine.where(~F.array_contains("labels", label)) if "labels" in nodes.columns else fine
    stamped = new.withColumn("createdAt", F.lit(now).cast("long"))
    if "expiresInHours" in new.columns:
        hours = F.col("expiresInHours")
        stamped = stamped.withColumn("expiresAt", F.when(hours != 0, F.lit(now) + (hours * 3_600_000)).cast("long")).drop("expiresInHours")
    links = new.select("id", F.explode(F.array_distinct(links_col)).alias("nodeId")).join(fine.select(F.col("id").alias("nodeId")), "nodeId", "left_semi").select("id", "nodeId")
    return rows.unionByName(stamped, allowMissingColumns=True), links


def latest(rows: DataFrame, by: list[str] = (), at: str = "createdAt", id_col: str = "id", **only) -> DataFrame:
    """The latest row, of all or of each group of ``by``; ties go to the larger id."""
    for name, value in only.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    order = [F.col(at).desc(), F.col(id_col).desc()]
    if not by:
        return rows.orderBy(*order).limit(1)
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def link_notes(notes: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """``notes`` with the id of the latest bookmark of their session, if any."""
    last = bookmarks.groupBy("sessionId").agg(F.max_by("id", F.struct("createdAt", "id")).alias("bookmarkId"))
    return notes.join(last, "sessionId", "left")


def working_set(bookmark: DataFrame, nodes: DataFrame, exclude=("Pheromone", "SwarmTask", "SessionBookmark", "SessionNote", "SwarmMessage")) -> DataFrame:
    """(id, found, filePath, startLine): nodes that the bookmark names, in order of file and line; the missing ones come last."""
    ids = bookmark.select(F.explode("workingSetNodeIds").alias("id")).distinct()
    fine = nodes
    for label in exclude:
        fine = fine.where(~F.array_contains("labels", label)) if "labels" in nodes.columns else fine
    met = ids.join(fine.select("id", "filePath", "startLine", F.lit(True).alias("found")), "id", "left")
    return met.select("id", F.coalesce("found", F.lit(False)).alias("found"), "filePath", "startLine").orderBy(F.col("filePath").asc_nulls_last(), "startLine", "id")


def live(notes: DataFrame, now: int) -> DataFrame:
    return notes.where(F.col("expiresAt").isNull() | (F.col("expiresAt") > now))


def recall(notes: DataFrame, now: int, limit: int = 10, oldest_first: bool = False, **only) -> DataFrame:
    rows = live(notes, now)
    for name, value in only.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.col("createdAt").asc() if oldest_first else F.col("createdAt").desc(), "id").limit(limit)


def recall_by_vector(notes: DataFrame, query: list[float], now: int, limit: int = 10, least: float = 0.3, scale: str = "unit", **only) -> DataFrame:
    """Of the limit * 10 nearest notes, the live ones that the filters let through."""
    keep = F.col("expiresAt").isNull() | (F.col("expiresAt") > now)
    for name, value in only.items():
        if value is not None:
            keep = keep & (F.col(name) == value)
    return vector_search(notes, query, limit, keep, least=least, scale=scale)


def beyond_latest(rows: DataFrame, keep: int = KEEP, by: str = "sessionId", at: str = "createdAt", id_col: str = "id") -> DataFrame:
    """Rows of each session older than its ``keep`` latest."""
    k = F.row_number().over(W.partitionBy(by).orderBy(F.col(at).desc(), F.col(id_col).desc()))
    return rows.withColumn("_k", k).where(F.col("_k") > keep).drop("_k")


def cleanup(notes: DataFrame, bookmarks: DataFrame, now: int, keep: int = KEEP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, notes left, bookmarks left)."""
    expired = notes.where(F.col("expiresAt") <= now)
    old = beyond_latest(bookmarks, keep)
    told = expired.agg(F.count("*").alias("expired_notes")).join(old.agg(F.count("*").alias("old_bookmarks")))
    return told, live(notes, now), bookmarks.join(old.select("id"), "id", "left_anti")
