"""File events: debounced batches, overflow, dispatch; markers as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Gap that ends a batch, and how many events are kept of a batch with too many.
DEBOUNCE, MOST, KEPT = "1 second", 1000, 500
EVENT_SCHEMA = "projectId string, type string, filePath string, ts timestamp"


def file_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """A stream of JSON-line events; only .ts and .tsx files count."""
    rows = spark.readStream.schema(schema).json(folder)
    return rows.where(F.col("filePath").rlike(r"\.tsx?$"))


def debounced(events: DataFrame, gap: str = DEBOUNCE, by: list[str] = ("projectId",), ts: str = "ts", late: str | None = None, detail: bool = True) -> DataFrame:
    """A row per batch of events no further than ``gap`` apart, of each group of ``by``.

    A timer that every event restarts is a session window.  Works on tables and,
    with ``late`` as watermark, on streams.  ``events`` holds the last KEPT events
    of a batch of MOST or more, else all.
    """
    rows = events.withWatermark(ts, late) if late else events
    g = rows.groupBy(*by, F.session_window(ts, gap).alias("w"))
    if not detail:
        return g.agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("first"), F.col("w.end").alias("closes"), "n")
    all_of = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), "filePath", "type")))
    out = g.agg(F.count("*").alias("n"), all_of.alias("all"))
    kept = F.when(F.size("all") >= MOST, F.slice("all", -KEPT, KEPT)).otherwise(F.col("all"))
    return out.select(*by, F.col("w.start").alias("first"), F.col("w.end").alias("closes"), "n", kept.alias("events"))


def latest_changes(batch: DataFrame) -> DataFrame:
    """(projectId, filePath, change): the last event of each file of a batch; unlink is deleted, all else changed."""
    e = batch.select("projectId", F.explode("events").alias("e"))
    last = e.groupBy("projectId", F.col("e.filePath").alias("filePath")).agg(F.max_by("e.type", "e.ts").alias("type"))
    return last.select("projectId", "filePath", F.when(F.col("type") == "unlink", "deleted").otherwise("changed").alias("change"))


class Watchers:
    """Running watchers, at most ``most``; each applies ``handle(changes, batch id)`` to debounced batches."""

    def __init__(self, most: int = 10):
        self.most, self.running = most, {}

    def start(self, spark: SparkSession, project: str, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], gap: str = DEBOUNCE, late: str = "2 seconds", catch_up: Callable[[], None] | None = None):
        """Changes missed while not watching are caught up with first."""
        if project in self.running and self.running[project].isActive:
            return self.running[project]
        if sum(q.isActive for q in self.running.values()) >= self.most:
            raise RuntimeError(f"{self.most} projects are being watched")
        if catch_up:
            catch_up()
        batches = debounced(file_events(spark, folder).where(F.col("projectId") == project), gap, late=late)
        query = batches.writeStream.foreachBatch(lambda df, i: handle(latest_changes(df), i)).option("checkpointLocation", checkpoint).outputMode("append").start()
        self.running[project] = query
        return query

    def stop(self, project: str, wait_s: int = 30) -> bool:
        query = self.running.pop(project, None)
        if query is None:
            return False
        query.stop()
        query.awaitTermination(wait_s)
        return True

    def list(self) -> list[dict]:
        return [{"projectId": p, "status": "active" if q.isActive else "error" if q.exception() else "paused", "lastProgress": q.lastProgress and q.lastProgress["timestamp"]} for p, q in sorted(self.running.items())]


def latest_markers(deposits: DataFrame) -> DataFrame:
    """The state of markers over a stream (or table) of deposits: latest strength and time, first half-life, by key."""
    return deposits.groupBy("nodeId", "agentId", "swarmId", "type").agg(
        F.max_by("intensity", "ts").alias("intensity"), F.max("ts").alias("ts"), F.min_by("halfLife", "ts").alias("halfLife"))
