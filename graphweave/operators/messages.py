"""Messages between agents that expire and remember who has read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

# Categories as declared, their order at delivery, and the time to live in milliseconds.
CATEGORIES = ["blocked", "conflict", "finding", "request", "alert", "handoff"]
DELIVERY = ["alert", "conflict", "blocked", "request", "finding", "handoff"]
TTL = 4 * 60 * 60 * 1000


def send(messages: DataFrame, new: DataFrame, now: int, ttl: int = TTL) -> DataFrame:
    """Appended, stamped now; a ttl of 0 expires at once."""
    stamped = new.withColumn("timestamp", F.lit(now).cast("long")).withColumn("expiresAt", F.lit(now + ttl).cast("long"))
    return messages.unionByName(stamped.withColumn("readBy", F.array().cast("array<string>")), allowMissingColumns=True)


def _for(messages: DataFrame, agent: str, now: int) -> DataFrame:
    return messages.where((F.col("expiresAt") > now) & (F.col("toAgentId").isNull() | (F.col("toAgentId") == agent)))


def inbox(messages: DataFrame, agent: str, now: int, unread: bool = True, categories=(), sender: str | None = None, swarm: str | None = None, limit: int = 20) -> DataFrame:
    """Unexpired messages to an agent or to all, newest first."""
    rows = _for(messages, agent, now)
    if unread:
        rows = rows.where(~F.array_contains("readBy", agent))
    if categories:
        rows = rows.where(F.col("category").isin(list(categories)))
    if sender is not None:
        rows = rows.where(F.col("fromAgentId") == sender)
    if swarm is not None:
        rows = rows.where(F.col("swarmId") == swarm)
    return rows.orderBy(F.col("timestamp").desc(), "id").limit(limit)


def acknowledged(messages: DataFrame, agent: str, ids: list[str] | None = None, now: int | None = None) -> DataFrame:
    """``messages`` with the agent among the readers of the given ones, or of all that it can see."""
    hit = F.col("toAgentId").isNull() | (F.col("toAgentId") == agent)
    hit = hit & (F.col("id").isin(list(ids)) if ids is not None else F.col("expiresAt") > now)
    return messages.withColumn("readBy", F.when(hit, F.array_union("readBy", F.array(F.lit(agent)))).otherwise(F.col("readBy")))


def pending(messages: DataFrame, agent: str, now: int, swarm: str | None = None, limit: int = 10) -> DataFrame:
    """What is delivered with a claim: unread, the most urgent category first, newest first."""
    rank = F.array_position(F.array(*[F.lit(x) for x in DELIVERY]), F.col("category"))
    rows = _for(messages, agent, now).where(~F.array_contains("readBy", agent))
    rows = rows if swarm is None else rows.where(F.col("swarmId") == swarm)
    return rows.withColumn("rank", F.when(rank > 0, rank - 1).otherwise(len(DELIVERY))).orderBy("rank", F.col("timestamp").desc(), "id").limit(limit)


def delivered(messages: DataFrame, agent: str, now: int, swarm: str | None = None, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(what is delivered with a claim, ``messages`` with that marked as read by the agent)."""
    got = cut(pending(messages, agent, now, swarm, limit))
    hit = messages.join(got.select(F.col("id").alias("_id"), F.lit(True).alias("_hit")), F.col("id") == F.col("_id"), "left").drop("_id")
    read = F.when(F.col("_hit") & ~F.array_contains("readBy", agent), F.concat("readBy", F.array(F.lit(agent)))).otherwise(F.col("readBy"))
    return got, hit.withColumn("readBy", read).drop("_hit")


def unexpired(messages: DataFrame, now: int) -> DataFrame:
    return messages.where(F.col("expiresAt") > now)
