"""A queue of tasks that wait for one another, and taking a change apart into tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut, numbered
from .markers import ending_in

# States, priorities and types.
STATUSES = ["available", "claimed", "in_progress", "blocked", "needs_review", "completed", "failed", "cancelled"]
PRIORITY = {"critical": 100, "high": 75, "normal": 50, "low": 25, "backlog": 0}
TYPES = ["implement", "refactor", "fix", "test", "review", "document", "investigate", "plan"]
# Words that tell a task's type, in order of precedence.
INFERENCE = [
    ("rename", ["rename", "change name", "refactor name"], "refactor"),
    ("document", ["jsdoc", "document", "add comments", "add documentation"], "document"),
    ("migrate", ["migrate", "convert", "upgrade", "modernize"], "refactor"),
    ("deprecate", ["deprecate", "deprecation warning", "mark deprecated"], "refactor"),
    ("fix", ["fix", "repair", "correct", "resolve"], "fix"),
    ("test", ["test", "add tests", "write tests", "unit test"], "test"),
]
# What may follow what: action -> (states before, state after).
TRANSITIONS = {
    "start": (["claimed"], "in_progress"), "force_start": (["claimed", "available", "blocked"], "in_progress"), "release": (["claimed", "in_progress"], "available"),
    "abandon": (["claimed", "in_progress"], "available"), "complete": (["in_progress", "claimed"], "completed"), "fail": (["in_progress", "claimed"], "failed"),
    "request_review": (["in_progress", "claimed"], "needs_review"), "approve": (["needs_review"], "completed"), "reject": (["needs_review"], "in_progress"), "retry": (["failed"], "available"),
}


def priority_score(col):
    pairs = [x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(PRIORITY["normal"]))


def open_dependencies(tasks: DataFrame, depends: DataFrame) -> DataFrame:
    """(taskId, n_open, n): dependencies of each task that are not completed; a dependency without a task is no dependency."""
    state = tasks.select(F.col("id").alias("dependsOn"), "status")
    met = depends.join(state, "dependsOn")
    return met.groupBy("taskId").agg(F.count_if(F.col("status") != "completed").alias("n_open"), F.count("*").alias("n"))


def blocked_by_dependencies(tasks: DataFrame, depends: DataFrame) -> DataFrame:
    """Tasks with an open dependency, and how many."""
    return tasks.join(open_dependencies(tasks, depends).where("n_open > 0"), F.col("id") == F.col("taskId")).drop("taskId")


def claimable(tasks: DataFrame, depends: DataFrame, **only) -> DataFrame:
    """Available or blocked tasks whose dependencies are all completed; ``only`` holds lists of wanted column values."""
    rows = tasks.where(F.col("status").isin("available", "blocked"))
    for name, values in only.items():
        if values:
            rows = rows.where(F.col(name).isin(list(values)))
    waits = open_dependencies(tasks, depends).where("n_open > 0").select(F.col("taskId").alias("id"))
    return rows.join(waits, "id", "left_anti")


def claim_next(tasks: DataFrame, depends: DataFrame, by: list[str] = (), **only) -> DataFrame:
    """The task to claim, of all or of each group of ``by``: highest priority, oldest, smallest id.

    This is the candidate; taking it needs a store that compares and sets
    (update rows carry updatedAt as guard).
    """
    rows = claimable(tasks, depends, **only)
    order = [F.col("priorityScore").desc(), "createdAt", "id"]
    if not by:
        return rows.orderBy(*order).limit(1)
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def advance(tasks: DataFrame, action: str, ids: list[str] | DataFrame, agent: str, now: int) -> DataFrame:
    """Update rows (id, status, claimedBy, updatedAt, guard) of the tasks that may take the step.

    ``ids`` names them, as a list or as a table with a column id.  Only the agent that holds a task may move it, but for approvals, rejections
    and retries; a retry needs a task that allows it, where the column exists.
    """
    before, after = TRANSITIONS[action]
    rows = tasks.where(F.col("status").isin(before))
    rows = rows.join(ids.select("id"), "id", "left_semi") if isinstance(ids, DataFrame) else rows.where(F.col("id").isin(list(ids)))
    if action in ("start", "release", "abandon", "complete", "fail", "request_review") and "claimedBy" in tasks.columns:
        rows = rows.where(F.col("claimedBy") == agent)
    if action == "retry" and "retryable" in tasks.columns:
        rows = rows.where(F.coalesce("retryable", F.lit(True)))
    holder = F.lit(None).cast("string") if after == "available" else F.lit(agent)
    extra = []
    if action == "abandon":
        extra = [(F.coalesce(F.col("abandonCount"), F.lit(0)) + 1).alias("abandonCount")] if "abandonCount" in tasks.columns else []
    if action == "retry":
        extra = [(F.coalesce(F.col("retryCount"), F.lit(0)) + 1).alias("retryCount")] if "retryCount" in tasks.columns else []
    guard = F.col("updatedAt") if "updatedAt" in tasks.columns else F.col("createdAt")
    return rows.select("id", F.lit(after).alias("status"), holder.alias("claimedBy"), F.lit(now).alias("updatedAt"), guard.alias("guard"), *extra)


def unblocked_by(tasks: DataFrame, depends: DataFrame, done: DataFrame) -> DataFrame:
    """(done, id): tasks that wait for a completed one of ``done`` (column id) and for no other open one."""
    finished = done.select(F.col("id").alias("done"))
    waiting = depends.join(finished, F.col("dependsOn") == F.col("done")).select("done", "taskId")
    state = tasks.select(F.col("id").alias("other"), F.col("status").alias("other_status"))
    others = waiting.join(depends.select("taskId", F.col("dependsOn").alias("other")), "taskId").where("other != done").join(state, "other").where("other_status != 'completed'")
    free = waiting.join(others.select("taskId", "done").distinct(), ["taskId", "done"], "left_anti")
    mine = tasks.where(F.col("status").isin("blocked", "available")).select(F.col("id").alias("taskId"), "status")
    return free.join(mine, "taskId").where("status = 'blocked'").select("done", F.col("taskId").alias("id"))


def listing(tasks: DataFrame, depends: DataFrame, targets: DataFrame | None = None, order: str = "priority", skip: int = 0, limit: int = 20, **only) -> DataFrame:
    """A page of tasks with what they wait for, what waits for them, and their target nodes."""
    rows = tasks
    for name, values in only.items():
        if values:
            rows = rows.where(F.col(name).isin(list(values)))
    keys = {"priority": [F.col("priorityScore").desc(), "createdAt"], "created": [F.col("createdAt").desc()], "updated": [F.col("updatedAt").desc_nulls_first()] if "updatedAt" in tasks.columns else [F.col("createdAt").desc()]}
    picked = rows.orderBy(*keys[order], "id").offset(skip).limit(limit)
    state = tasks.select(F.col("id").alias("_id"), F.col("status").alias("_status"))
    deps = depends.join(state, F.col("dependsOn") == F.col("_id")).groupBy("taskId").agg(F.array_sort(F.collect_set(F.concat_ws(":", "dependsOn", "_status"))).alias("dependencies"))
    blocks = depends.groupBy(F.col("dependsOn").alias("_b")).agg(F.array_sort(F.collect_set("taskId")).alias("blocks"))
    out = picked.join(deps, picked.id == deps.taskId, "left").drop("taskId").join(blocks, F.col("id") == F.col("_b"), "left").drop("_b")
    if targets is not None:
        t = targets.groupBy("taskId").agg(F.array_sort(F.collect_set("nodeId")).alias("targets"))
        out = out.join(t, out.id == t.taskId, "left").drop("taskId")
    return out


def post(tasks: DataFrame, new: DataFrame, nodes: DataFrame, now: int, per_file: int = 20, hidden=("Pheromone", "SwarmTask")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to append, targets (taskId, nodeId), dependencies (taskId, dependsOn)) of new tasks.

    ``new``: id, swarmId, title, description, type, priority, targetNodeIds,
    targetFilePaths, dependencies, createdBy.  A task that names no nodes targets
    the first ``per_file`` nodes, by line, of the files whose path ends in one of
    its paths.  Links are to nodes and tasks that exist; a task that waits for an
    open one is blocked.
    """
    fine = nodes
    for label in hidden:
        fine = fine.where(~F.array_contains("labels", label)) if "labels" in nodes.columns else fine
    given = F.filter(F.coalesce("targetNodeIds", F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.length(x) > 0))
    asked = new.withColumn("_ids", given)
    paths = asked.where(F.size("_ids") == 0).select(F.col("id").alias("taskId"), F.explode(F.array_distinct("targetFilePaths")).alias("path"))
    hits = ending_in(fine.select(F.col("id").alias("nodeId"), "filePath", "startLine"), paths.select("path").distinct(), "filePath", "path")
    nth = F.row_number().over(W.partitionBy("path").orderBy(F.col("startLine").asc_nulls_last(), "nodeId"))
    of_path = hits.withColumn("_k", nth).where(F.col("_k") <= per_file).select("path", "nodeId")
    by_file = paths.join(of_path, "path").select("taskId", "nodeId").distinct()
    named = asked.select(F.col("id").alias("taskId"), F.explode(F.array_distinct("_ids")).alias("nodeId"))
    targets = named.join(fine.select(F.col("id").alias("nodeId")), "nodeId", "left_semi").select("taskId", "nodeId").unionByName(by_file)
    state = tasks.select("id", "status").unionByName(new.select("id", F.lit("available").alias("status")))
    links = asked.select(F.col("id").alias("taskId"), F.explode(F.array_distinct("dependencies")).alias("dependsOn")).join(state.withColumnRenamed("id", "dependsOn"), "dependsOn")
    waits = links.groupBy("taskId").agg(F.count_if(F.col("status") != "completed").alias("_open"))
    ids = named.unionByName(by_file).groupBy("taskId").agg(F.array_sort(F.collect_list("nodeId")).alias("targets"))  # what it names, whether it is there or not
    rows = asked.join(waits, asked.id == waits.taskId, "left").drop("taskId").join(ids, asked.id == ids.taskId, "left").drop("taskId")
    status = F.when(F.coalesce("_open", F.lit(0)) > 0, "blocked").otherwise("available")
    rows = rows.select(*[c for c in new.columns if c != "targetNodeIds"], F.coalesce("targets", F.array().cast("array<string>")).alias("targetNodeIds"), priority_score(F.col("priority")).alias("priorityScore"), status.alias("status"), F.lit(now).cast("long").alias("createdAt"), F.lit(now).cast("long").alias("updatedAt"))
    return rows, targets, links.select("taskId", "dependsOn")


def detail(tasks: DataFrame, depends: DataFrame, ids: list[str] | DataFrame, targets: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Tasks with what they wait for, what waits for them and their target nodes, as arrays of structs in order of id."""
    mine = tasks.join(ids.select("id"), "id", "left_semi") if isinstance(ids, DataFrame) else tasks.where(F.col("id").isin(list(ids)))
    short = [c for c in ("title", "status", "claimedBy") if c in tasks.columns]
    other = tasks.select(F.col("id").alias("_o"), F.struct("id", *short).alias("_x"))

    def linked(key, far, name):
        return depends.select(F.col(key).alias("_t"), F.col(far).alias("_o")).join(other, "_o").groupBy("_t").agg(F.array_sort(F.collect_set("_x")).alias(name))

    out = mine.drop("dependencies", "blockedTasks", *(["targets"] if targets is not None else []))  # ids that a stored task may hold
    parts = [linked("taskId", "dependsOn", "dependencies"), linked("dependsOn", "taskId", "blockedTasks")]
    if targets is not None and nodes is not None:
        n = nodes.select(F.col("id").alias("nodeId"), F.struct("id", "name", "filePath", "coreType", "semanticType").alias("_x"))
        parts.append(targets.join(n, "nodeId").groupBy(F.col("taskId").alias("_t")).agg(F.array_sort(F.collect_set("_x")).alias("targets")))
    for p in parts:
        out = out.join(p, out.id == p["_t"], "left").drop("_t")
    return out


def dependency_graph(tasks: DataFrame, depends: DataFrame, swarm: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges (taskId, dependsOn, status)) of all tasks or of a swarm's; a dependency without a task is no edge."""
    mine = tasks if swarm is None else tasks.where(F.col("swarmId") == swarm)
    shown = [c for c in ("id", "title", "status", "priority", "type", "claimedBy") if c in tasks.columns]
    state = tasks.select(F.col("id").alias("dependsOn"), "status")
    edges = depends.join(mine.select(F.col("id").alias("taskId")), "taskId", "left_semi").join(state, "dependsOn")
    return mine.select(*shown).distinct(), edges.select("taskId", "dependsOn", "status").distinct()


def page_info(rows: DataFrame, limit: int) -> DataFrame:
    """One row (returned, hasMore) of a page: there may be more if it is full."""
    n = F.count("*")
    return rows.agg(n.alias("returned"), (n >= limit).alias("hasMore"))


def stats(tasks: DataFrame, by: list[str] = ("status", "priority", "owner")) -> DataFrame:
    """(dimension, value, n): one pass over grouping sets, with the total."""
    sets = ", ".join(f"({c})" for c in by)
    spark = tasks.sparkSession
    dim = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in by) + " ELSE 'total' END"
    value = "coalesce(" + ", ".join(by) + ", '')"
    return spark.sql(f"SELECT {dim} AS dimension, {value} AS value, count(*) AS n FROM {{t}} GROUP BY GROUPING SETS ({sets}, ())", t=tasks.select(*by))


def progress(tasks: DataFrame, by: list[str] = ()) -> DataFrame:
    """(total, completed, failed, percent, is_complete): failed tasks count as done."""
    done = F.count_if(F.col("status").isin("completed", "failed"))
    total = F.count("*")
    percent = F.when(total > 0, F.floor(F.lit(100.0) * done / total + 0.5)).otherwise(0).cast("long")
    cols = [total.alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), percent.alias("percent"), ((total > 0) & (done == total)).alias("is_complete")]
    return tasks.groupBy(*by).agg(*cols)


def active_workers(markers: DataFrame, now: int, types=("modifying", "claiming")) -> DataFrame:
    """(agentId, type, last, n, minutes): markers of work by agent; whole minutes since the last, of microseconds."""
    rows = markers.where(F.col("type").isin(list(types))).groupBy("agentId", "type").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    return rows.withColumn("minutes", F.floor((F.lit(now) - F.col("last")) / F.lit(60_000_000)))


def workers(progress_rows: DataFrame, now: int, timeout: int = 1_800_000) -> DataFrame:
    """Latest state of each worker; one that works but was silent longer than ``timeout`` has timed out."""
    latest = progress_rows.groupBy("workerId").agg(F.max_by(F.struct("state", "at"), "at").alias("x")).select("workerId", "x.*")
    late = F.col("state").isin("claiming", "working") & (F.lit(now) - F.col("at") > timeout)
    return latest.withColumn("state", F.when(late, "timeout").otherwise(F.col("state")))


def started(swarm: str, names: DataFrame, now: int) -> DataFrame:
    """Progress rows of new workers (column workerId) of a swarm: idle, nothing done."""
    return names.select("workerId", F.lit(swarm).alias("swarmId"), F.lit("idle").alias("state"), F.lit(0).cast("long").alias("completed"), F.lit(0).cast("long").alias("failed"), F.lit(now).cast("long").alias("at"))


def progressed(rows: DataFrame, updates: DataFrame, now: int) -> DataFrame:
    """Progress rows after updates (workerId and some of their columns; null leaves a value): active now; unknown workers stay unknown."""
    new = updates.select(F.col("workerId").alias("_w"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in ("state", "completed", "failed") if c in updates.columns])
    met = rows.join(new, rows.workerId == new["_w"], "left")
    value = lambda c: F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in new.columns else F.col(c)
    return met.select("workerId", "swarmId", value("state"), value("completed"), value("failed"), F.when(F.col("_hit"), F.lit(now).cast("long")).otherwise(F.col("at")).alias("at"))


def without_swarm(rows: DataFrame, swarm: str) -> DataFrame:
    return rows.where(F.col("swarmId") != swarm)


def swarm_stats(rows: DataFrame, swarm: str) -> DataFrame:
    """One row: workers at work and idle, tasks done and failed."""
    n = rows.where(F.col("swarmId") == swarm)
    return n.agg(F.count_if(F.col("state").isin("working", "claiming")).alias("active"), F.count_if(F.col("state") == "idle").alias("idle"), F.coalesce(F.sum("completed"), F.lit(0)).alias("completed"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))


def worker_stats(latest: DataFrame) -> DataFrame:
    return latest.agg(F.count("*").alias("total"), F.count_if(F.col("state").isin("working", "claiming")).alias("active"), F.count_if(F.col("state") == "idle").alias("idle"), F.count_if(F.col("state") == "timeout").alias("timed_out"))


# ---------------------------------------------------------------- decomposition


def infer_type(description):
    """(kind, type) of a description: the first kind with a word in it, else implement."""
    kind, task = F.lit(None).cast("string"), F.lit("implement")
    for name, words, result in reversed(INFERENCE):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(description).contains(w)
        kind, task = F.when(hit, name).otherwise(kind), F.when(hit, result).otherwise(task)
    return kind, task


def decompose(nodes: DataFrame, impact: DataFrame, priority: str = "normal") -> DataFrame:
    """A task per file: its nodes and the highest impact level among them; the first three files by impact get a bump.

    ``impact`` has (id, level, files).  CRITICAL raises the priority by two steps,
    HIGH by one.
    """
    order = F.array_position(F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]), F.col("level"))
    rows = nodes.join(impact.select(F.col("id").alias("_id"), "level", "files"), nodes.id == F.col("_id"), "left")
    g = rows.groupBy("filePath").agg(F.array_sort(F.collect_set("id")).alias("nodeIds"), F.coalesce(F.max(order), F.lit(1)).alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("files", F.array().cast("array<string>")))))).alias("affected"))
    g = numbered(g, [F.col("rank").desc(), F.col("filePath")])
    steps = list(reversed(PRIORITY))
    bump = F.when(F.col("index") >= 3, 0).when(F.col("rank") >= 4, 2).when(F.col("rank") == 3, 1).otherwise(0)
    at = F.least(F.lit(len(steps) - 1), F.lit(steps.index(priority)) + bump)
    level = F.get(F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]), F.col("rank").cast("int") - 1)
    return g.select(F.col("index").cast("int").alias("index"), "filePath", "nodeIds", level.alias("level"), F.get(F.array(*[F.lit(x) for x in steps]), at).alias("priority"), "affected")


def dependencies(parts: DataFrame) -> DataFrame:
    """(filePath, dependsOn): a task waits for those of the files that its nodes affect."""
    wants = parts.select("filePath", F.explode("affected").alias("dependsOn")).where("filePath != dependsOn")
    return wants.join(parts.select(F.col("filePath").alias("dependsOn")), "dependsOn", "left_semi").distinct()


def levels(ids: DataFrame, depends: DataFrame) -> DataFrame:
    """(id, level, n): a level above all that an id depends on (columns taskId, dependsOn); n is its number of dependencies.

    Ids on a cycle, and those behind one, get level -1.  Ordered by level, n and id
    this is a topological order.  Runs of ids with one dependency each are followed
    by doubling steps, so a chain takes the logarithm of its length in rounds; only
    ids with several dependencies on one path take a round each.
    """
    known = ids.select("id").distinct()
    edges = depends.join(known.select(F.col("id").alias("dependsOn")), "dependsOn", "left_semi").join(known.select(F.col("id").alias("taskId")), "taskId", "left_semi").select("taskId", "dependsOn").distinct()
    edges = cut(edges)
    counts = edges.groupBy("taskId").agg(F.count("*").alias("n"))
    every = cut(known.join(counts, F.col("id") == F.col("taskId"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n")))

    # (id, up, dist): where the run below an id begins, and how far that is; done if it has no single dependency itself.
    single = every.where("n = 1").select("id")
    runs = edges.join(single, F.col("taskId") == F.col("id"), "left_semi").select(F.col("taskId").alias("id"), F.col("dependsOn").alias("up"), F.lit(1).cast("long").alias("dist"))
    more = single.select(F.col("id").alias("up"), F.lit(False).alias("done"))
    runs = cut(runs.join(more, "up", "left").select("id", "up", "dist", F.coalesce("done", F.lit(True)).alias("done")))
    total, steps = runs.count(), 0
    while 1 << steps <= 2 * total and not runs.where("not done").isEmpty():
        far = runs.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        moved = runs.where("not done").join(far, "up").select("id", F.col("up2").alias("up"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"))
        runs, steps = cut(runs.where("done").unionByName(moved)), steps + 1
    runs = runs.where("done").select("id", "up", "dist")  # the others are on a cycle or behind one

    # Between ids with several dependencies, each edge is as long as the run that it leads to.
    joints = edges.join(every.where("n > 1").select(F.col("id").alias("taskId"), "n"), "taskId")
    loops = single.join(runs, "id", "left_anti").select(F.col("id").alias("dependsOn"), F.lit(True).alias("stuck"))
    joints = joints.join(runs.select(F.col("id").alias("dependsOn"), "up", "dist"), "dependsOn", "left").join(loops, "dependsOn", "left")
    rest = cut(joints.select(F.col("taskId").alias("id"), "n", F.when(F.col("stuck").isNull(), F.coalesce("up", "dependsOn")).alias("up"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist")))
    fresh = cut(every.where("n = 0").select("id", F.lit(0).cast("long").alias("level")))
    found, seen = fresh, rest.select("id", F.lit(0).cast("long").alias("k"), F.lit(-1).cast("long").alias("level")).limit(0)
    while not rest.isEmpty() and not fresh.isEmpty():
        met = rest.join(fresh.select(F.col("id").alias("up"), "level"), "up").groupBy("id").agg(F.count("*").alias("k"), F.max(F.col("level") + F.col("dist")).alias("level"))
        seen = cut(seen.unionByName(met).groupBy("id").agg(F.sum("k").alias("k"), F.max("level").alias("level")))
        rest = rest.join(fresh.select(F.col("id").alias("up")), "up", "left_anti").select("id", "n", "up", "dist")
        need = every.select(F.col("id"), F.col("n").alias("want"))
        fresh = cut(seen.join(need, "id").where("k = want").select("id", "level"))
        seen = cut(seen.join(fresh.select("id"), "id", "left_anti"))
        rest, found = cut(rest), found.unionByName(fresh)
    behind = runs.join(found.select(F.col("id").alias("up"), "level"), "up").select("id", (F.col("level") + F.col("dist")).alias("level"))
    done = found.unionByName(behind)
    return every.join(done, "id", "left").select("id", F.coalesce("level", F.lit(-1)).cast("int").alias("level"), F.col("n").cast("long").alias("n"))


def complexity(parts: DataFrame, depends: DataFrame) -> DataFrame:
    """One row (score, complexity) of a decomposition."""
    most = depends.groupBy("filePath").agg(F.count("*").alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).alias("most"))
    c = parts.agg(F.count("*").alias("n"), F.count_if(F.col("level") == "CRITICAL").alias("crit"), F.count_if(F.col("level") == "HIGH").alias("high")).join(most)
    score = F.least(F.col("n") / 10, F.lit(3.0)) + 1.5 * F.col("crit") + 0.5 * F.col("high") + 0.3 * F.col("most")
    return c.select(score.alias("score"), F.when(score >= 5, "HIGH").when(score >= 2, "MEDIUM").otherwise("LOW").alias("complexity"))


def parallelisable(parts: DataFrame, depends: DataFrame, completed: list[str]) -> DataFrame:
    """Tasks not completed all of whose dependencies are."""
    waits = depends.where(~F.col("dependsOn").isin(list(completed))).select("filePath")
    return parts.where(~F.col("filePath").isin(list(completed))).join(waits, "filePath", "left_anti")
