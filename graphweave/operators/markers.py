"""Markers that fade with time, on nodes, by agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Half-lives in milliseconds; -1 never fades.
HALF_LIFE = {
    "exploring": 120_000, "modifying": 600_000, "claiming": 3_600_000, "completed": 86_400_000, "warning": -1,
    "blocked": 300_000, "proposal": 3_600_000, "needs_review": 1_800_000, "session_context": 28_800_000,
}
WORKFLOW = ["exploring", "claiming", "modifying", "completed", "blocked"]
FLAGS = ["warning", "proposal", "needs_review", "session_context"]
#: Fixed value: stands for the logarithm of two.
RATE = 0.693147
KEY = ["nodeId", "agentId", "swarmId", "type"]


def decayed(now: int, intensity="intensity", ts="ts", half_life="halfLife"):
    """Intensity after the time since ``ts``; no half-life, or none above zero, keeps it."""
    fades = F.col(half_life) > 0
    age = (F.lit(now) - F.col(ts)).cast("double")
    return F.when(fades, F.col(intensity) * F.exp(-F.lit(RATE) * age / F.col(half_life))).otherwise(F.col(intensity))


def sense(markers: DataFrame, now: int, targets: DataFrame | None = None, least: float = 0.3, limit: int = 50, **only) -> DataFrame:
    """Markers of decayed ``current`` strength, strongest first, then latest; ``only`` holds lists of wanted column values."""
    rows = markers.withColumn("current", decayed(now))
    for name, values in only.items():
        if values:
            rows = rows.where(F.col(name).isin(list(values)))
    rows = rows.where(F.col("current") >= least)
    if targets is not None:  # by the marker's own node id, so that it outlives a lost edge
        t = targets.select(F.col("id").alias("nodeId"), F.col("name").alias("target_name"), F.col("filePath").alias("target_file"))
        rows = rows.join(t, "nodeId", "left")
    return rows.orderBy(F.col("current").desc(), F.col("ts").desc(), "id").limit(limit)


def stats(markers: DataFrame, now: int, least: float = 0.3) -> DataFrame:
    """By type: count, mean strength and agents; no other filter applies."""
    rows = markers.withColumn("current", decayed(now)).where(F.col("current") >= least)
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.avg("current").alias("avg_intensity"), F.countDistinct("agentId").alias("agents"))


def purged(markers: DataFrame, now: int, below: float = 0.01) -> DataFrame:
    """What is left when faded markers go."""
    return markers.where(decayed(now) >= below)


def nodes_of_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Ids that mark a list of paths: nodes whose path ends so, and the paths themselves."""
    wanted = files.select(F.col("path"))
    hits = ending_in(nodes, wanted, "filePath", "path").select("id")
    return hits.union(wanted.select(F.col("path").alias("id"))).distinct()


def ending_in(rows: DataFrame, wanted: DataFrame, text_col: str, end_col: str) -> DataFrame:
    """Each of ``rows`` with each of ``wanted`` that its text ends in: an equi-join on the text's tails.

    Only tails as long as a wanted end are made; there are no more lengths than
    characters in a path.
    """
    ends = wanted.where(F.col(end_col).isNotNull()).distinct()
    lengths = [r.n for r in ends.select(F.length(end_col).alias("n")).distinct().collect()]
    sizes = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length(text_col))
    tails = rows.withColumn("_tail", F.explode(F.transform(sizes, lambda n: F.substring(F.col(text_col), F.length(text_col) - n + 1, n))))
    return tails.join(ends, F.col("_tail") == F.col(end_col)).drop("_tail")


def deposit(markers: DataFrame, new: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Upsert by node, agent, swarm and type: the latest strength, time and data, but the first half-life.

    New markers on unknown nodes are left out.  A new workflow state ends the other
    ones of the same agent on the node.
    """
    if nodes is not None:
        new = new.join(nodes.select(F.col("id").alias("nodeId")), "nodeId", "left_semi")
    both = markers.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in markers.columns if c not in (*KEY, "halfLife")]
    latest = F.max_by(F.struct(*others), F.struct("_new", "ts", "id"))
    first = F.min_by("halfLife", F.struct("_new", "ts", "id"))
    merged = both.groupBy(*KEY).agg(latest.alias("x"), first.alias("halfLife"), F.max(F.struct("_new", "ts", "id")).alias("at"))
    merged = merged.select(*KEY, "x.*", "halfLife", "at")
    return exclusive(merged, order="at").select(*markers.columns)


def exclusive(markers: DataFrame, order: str | None = None) -> DataFrame:
    """Of the workflow states of an agent on a node, only the latest; flags all stay."""
    latest = F.col(order).desc() if order else F.struct("ts", "id").desc()
    flow = F.col("type").isin(WORKFLOW)
    k = F.row_number().over(W.partitionBy("nodeId", "agentId", "swarmId", flow).orderBy(latest))
    return markers.withColumn("_k", k).where(~flow | (F.col("_k") == 1)).drop("_k")


def removed(markers: DataFrame, node: str, agent: str, swarm: str, kind: str) -> DataFrame:
    hit = (F.col("nodeId") == node) & (F.col("agentId") == agent) & (F.col("swarmId") == swarm) & (F.col("type") == kind)
    return markers.where(~F.coalesce(hit, F.lit(False)))


def cleanup(markers: DataFrame, swarm: str | None = None, agent: str | None = None, keep=("warning",)) -> tuple[DataFrame, DataFrame]:
    """(report, left): what goes for a swarm, an agent or all, and what is left; kept types stay."""
    goes = ~F.col("type").isin(list(keep)) if keep else F.lit(True)
    if swarm is not None:
        goes = goes & (F.col("swarmId") == swarm)
    if agent is not None:
        goes = goes & (F.col("agentId") == agent)
    goes = F.coalesce(goes, F.lit(False))
    told = markers.where(goes).agg(F.count("*").alias("n"), F.countDistinct("agentId").alias("agents"), F.array_sort(F.collect_set("type")).alias("types"), F.countDistinct("swarmId").alias("swarms"))
    return told, markers.where(~goes)
