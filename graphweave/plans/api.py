"""Tool-shaped queries over one stored graph and its coordination tables.

Each method answers with DataFrames; state changes are returned as rows or
tables, for the caller's store to apply.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import whole_number
from ..operators import deadcode, duplicates, graph, impact, markers, messages, search, sessions, tasks
from ..operators.graph import PropertyGraph
from ..sources import files, typescript
from ..streaming.events import Watchers
from . import nlquery


@dataclass
class Jobs:
    """Parse jobs in memory: at most ``most``; finished ones older than an hour go first."""

    factory: ids.IdFactory = field(default_factory=ids.IdFactory)
    most: int = 100
    keep_ms: int = 3_600_000
    rows: dict = field(default_factory=dict)

    def create(self, project: str, path: str, now: int) -> str:
        self.purge(now)
        if len(self.rows) >= self.most:
            raise RuntimeError(f"{self.most} jobs are running")
        job = self.factory.job()
        self.rows[job] = {"id": job, "status": "pending", "projectId": project, "projectPath": path, "filesTotal": 0, "filesProcessed": 0, "createdAt": now, "updatedAt": now}
        return job

    def update(self, job: str, now: int, **values) -> None:
        self.rows[job] |= values | {"updatedAt": now}

    def purge(self, now: int) -> None:
        self.rows = {k: v for k, v in self.rows.items() if v["status"] not in ("completed", "failed") or now - v["updatedAt"] <= self.keep_ms}

    def percent(self, job: str) -> int:
        row = self.rows[job]
        if row["status"] == "completed":
            return 100
        return int(100 * row["filesProcessed"] / row["filesTotal"] + 0.5) if row["filesTotal"] else 0


@dataclass
class Tools:
    spark: SparkSession
    graph: PropertyGraph
    embed: object = None
    markers: DataFrame | None = None
    tasks: DataFrame | None = None
    depends: DataFrame | None = None
    messages: DataFrame | None = None
    bookmarks: DataFrame | None = None
    notes: DataFrame | None = None
    projects: DataFrame | None = None
    watchers: Watchers = field(default_factory=Watchers)
    jobs: Jobs = field(default_factory=Jobs)
    clock: object = lambda: int(time.time() * 1000)
    #: Folder of the stored graph, which parsing replaces a project of; and a model that turns a prompt into a reply.
    store: str | None = None
    model: object = None

    def hello(self) -> str:
        return "hello"

    def test_connection(self) -> DataFrame:
        return self.spark.range(1).select(F.lit("connected").alias("message"))

    def resolve_project(self, given: str | None) -> str:
        """An id as it is; else by name, path or id; a path that is not known by its hash; without anything, the only project."""
        if given and ids.is_project_id(given):
            return given
        rows = self.projects.select("projectId", "name", "path")
        if given:
            hit = rows.where((F.col("name") == given) | (F.col("path") == given) | (F.col("projectId") == given)).orderBy("projectId").first()
            if hit:
                return hit.projectId
            if "/" in given:
                return self.spark.range(1).select(ids.project_id(F.lit(given)).alias("p")).first().p
            raise ValueError(f"no project {given}")
        two = rows.limit(2).collect()
        if len(two) != 1:
            raise ValueError("name a project")
        return two[0].projectId

    def list_projects(self) -> DataFrame:
        return self.projects.orderBy(F.col("updatedAt").desc(), "projectId")

    def search_codebase(self, query: str, project: str | None = None, limit=3, min_similarity: float = 0.65, depth=3, per_chain=5):
        """``embed`` turns text into a vector."""
        limit, depth = whole_number(limit, 3, 10), whole_number(depth, 3, 10)
        return search.search_code(self.graph, self.embed(query), limit, min_similarity, depth, whole_number(per_chain, 5), project)

    def traverse_from_node(self, node: str | None = None, file_path: str | None = None, depth=3, direction="BOTH", types=None, skip=0, weighted=False) -> DataFrame:
        if node is None:
            found = graph.find_start(self.graph.nodes, file_path).limit(2).collect()
            if len(found) != 1:
                raise ValueError("no such file" if not found else "several files have this path")
            node = found[0].id
        depth = whole_number(depth, 3)
        return graph.beam(self.graph, node, depth, direction) if weighted else graph.traverse(self.graph, node, depth, direction, types, whole_number(skip, 0))

    def traversal_answer(self, node: str | None = None, file_path: str | None = None, summary_only: bool = False, most: int = 50, per_chain: int = 5, **how) -> dict[str, DataFrame]:
        """Nodes, edges and chains of a traversal with its totals; a summary where that is too long."""
        return graph.answer(self.traverse_from_node(node, file_path, **how), per_chain, most, summary_only)

    def impact_analysis(self, node: str | None = None, file_path: str | None = None, max_depth=4, high_risk=(), overrides=None) -> dict[str, DataFrame]:
        targets = self.graph.nodes.where(F.col("id") == node) if node else impact.file_targets(self.graph.nodes, file_path)
        d = impact.direct(self.graph, targets)
        first = targets if node else targets.limit(1)
        if not node:
            d = impact.of_file(d)
        t = impact.beyond_direct(impact.transitive(self.graph, first, whole_number(max_depth, 4, 6)), d)
        return {"direct": d, "transitive": t, "risk": impact.risk(first, d, t, list(high_risk), overrides), "critical": impact.critical_paths(d, overrides, by=("target",) if node else ())}

    def detect_dead_code(self, **page) -> dict[str, DataFrame]:
        n, e = self.graph.nodes, self.graph.edges
        found = deadcode.report(deadcode.unreferenced_exports(n, e), deadcode.uncalled_private_methods(n, e), deadcode.unreferenced_interfaces(n, e), deadcode.entry_points(n))
        return {"items": deadcode.page(found, **page), "stats": deadcode.stats(found), "top_files": deadcode.top_files(found)}

    def detect_duplicate_code(self, scope: str = "all", kind: str = "all", most: int = 20, least: float = 0.8) -> dict[str, DataFrame]:
        items = duplicates.structural_items(self.graph.nodes, scope, most * 10)
        out = {"structural": duplicates.structural_groups(items)}
        if kind in ("semantic", "all") and "embedding" in self.graph.nodes.columns:
            nodes = self.graph.nodes.where(F.col("coreType").isin(duplicates.SCOPES[scope]))
            out["semantic"] = duplicates.greedy_pairs(duplicates.similar_pairs(nodes, least, limit=most * 2), items)
        return out if kind != "structural" else {"structural": out["structural"]}

    def natural_language_query(self, question: str, project: str) -> DataFrame:
        """``model`` answers a prompt made of the graph's schema; its query runs on the project's rows."""
        g = self.graph.of_project(self.resolve_project(project))
        labels = [r.label for r in g.nodes.select(F.explode("labels").alias("label")).distinct().collect()]  # a row a label
        types = [r.type for r in g.edges.select("type").distinct().collect()]
        kinds = [r.semanticType for r in deadcode.semantic_types(g.nodes).collect()] if "semanticType" in g.nodes.columns else []
        return nlquery.ask(question, self.model, self.spark, self.resolve_project(project), sorted(labels), sorted(types), sorted(kinds), {"nodes": self.graph.nodes, "edges": self.graph.edges})

    def parse_typescript_project(self, path: str, project: str | None = None, clear: bool = True) -> str:
        """Parse a folder into the graph at ``store``; returns the job, whose state check_parse_status tells."""
        project = project if project and ids.is_project_id(project) else self.spark.range(1).select(ids.project_id(F.lit(path)).alias("p")).first().p
        job = self.jobs.create(project, path, self.clock())
        try:
            found = files.source_files(self.spark, path)
            self.jobs.update(job, self.clock(), status="running", filesTotal=found.count())
            g = typescript.build_graph(found, project)
            if clear:
                files.clear_project(self.spark, self.store, project)
            given, stored = files.write_graph(g, self.store)
            self.graph = files.read_graph(self.spark, self.store)
            self.jobs.update(job, self.clock(), status="completed", filesProcessed=self.jobs.rows[job]["filesTotal"], edges=stored, edgesGiven=given)
        except Exception as error:
            self.jobs.update(job, self.clock(), status="failed", error=str(error))
            raise
        return job

    def check_parse_status(self, job: str) -> dict:
        if job not in self.jobs.rows:
            raise ValueError(f"no job {job}")
        return self.jobs.rows[job] | {"percent": self.jobs.percent(job)}

    def start_watch_project(self, project: str, folder: str, checkpoint: str, handle, **how):
        return self.watchers.start(self.spark, self.resolve_project(project), folder, checkpoint, handle, **how)

    def stop_watch_project(self, project: str) -> bool:
        return self.watchers.stop(self.resolve_project(project))

    def list_watchers(self) -> list[dict]:
        return self.watchers.list()

    def swarm_sense(self, **how) -> DataFrame:
        return markers.sense(self.markers, self.clock(), self.graph.nodes, **how)

    def swarm_pheromone(self, new: DataFrame) -> DataFrame:
        return markers.deposit(self.markers, new, self.graph.nodes)

    def swarm_cleanup(self, **how):
        return markers.cleanup(self.markers, **how)

    def swarm_get_tasks(self, **how) -> DataFrame:
        return tasks.listing(self.tasks, self.depends, **how)

    def swarm_post_task(self, new: DataFrame):
        """New rows, which the tool's own tables have from now on, with their targets and dependencies."""
        rows, targets, depends = tasks.post(self.tasks, new, self.graph.nodes, self.clock())
        self.tasks = self.tasks.unionByName(rows, allowMissingColumns=True)
        self.depends = self.depends.unionByName(depends, allowMissingColumns=True)
        return rows, targets, depends

    def swarm_claim_task(self, agent: str, swarm: str | None = None, **only):
        """The candidate, and the messages that come with a claim; those are read then."""
        got = tasks.claim_next(self.tasks, self.depends, **only | ({"swarmId": [swarm]} if swarm else {}))
        told, self.messages = messages.delivered(self.messages, agent, self.clock(), swarm)
        return got, told

    def swarm_release_task(self, task: str, agent: str, abandon: bool = False) -> DataFrame:
        return tasks.advance(self.tasks, "abandon" if abandon else "release", [task], agent, self.clock())

    def swarm_task_detail(self, task: str) -> DataFrame:
        return tasks.detail(self.tasks, self.depends, [task])

    def swarm_advance_task(self, action: str, task: str, agent: str) -> DataFrame:
        return tasks.advance(self.tasks, action, [task], agent, self.clock())

    def swarm_complete_task(self, task: str, agent: str):
        done = self.tasks.where(F.col("id") == task)
        return tasks.advance(self.tasks, "complete", [task], agent, self.clock()), tasks.unblocked_by(self.tasks, self.depends, done)

    def swarm_message(self, agent: str, **how) -> DataFrame:
        return messages.inbox(self.messages, agent, self.clock(), **how)

    def session_save(self, session: str, agent: str, kind: str = "auto", **given) -> dict[str, DataFrame]:
        """A bookmark, a note or both, by what is given; the tool's own tables have them from now on."""
        kind, now, out = sessions.kind_to_save(given, kind), self.clock(), {}
        said = {"sessionId": session, "agentId": agent}
        if kind != "note":
            row = said | {"id": self.jobs.factory.make("bookmark"), **{k: given[k] for k in sessions.BOOKMARK_NEEDS}, **{k: given.get(k) for k in ("findings", "nextSteps")}}
            new = self.spark.createDataFrame([row], "id string, sessionId string, agentId string, summary string, taskContext string, workingSetNodeIds array<string>, findings string, nextSteps string")
            self.bookmarks, out["bookmark_links"] = sessions.saved(self.bookmarks, new, self.graph.nodes, "workingSetNodeIds", now)
            out["bookmark"] = self.bookmarks.where(F.col("id") == row["id"])
        if kind != "bookmark":
            row = said | {"id": self.jobs.factory.make("note"), **{k: given[k] for k in sessions.NOTE_NEEDS}, "severity": given.get("severity", "info"), "aboutNodeIds": list(given.get("aboutNodeIds") or []), "expiresInHours": float(given.get("expiresInHours") or 0)}
            new = self.spark.createDataFrame([row], "id string, sessionId string, agentId string, topic string, content string, category string, severity string, aboutNodeIds array<string>, expiresInHours double")
            self.notes, out["note_links"] = sessions.saved(self.notes, new, self.graph.nodes, "aboutNodeIds", now)
            note = self.notes.where(F.col("id") == row["id"])
            out["note"] = sessions.link_notes(note, self.bookmarks) if self.bookmarks is not None else note
        return out

    def session_recall(self, query: str | None = None, **only) -> DataFrame:
        if query is not None:
            return sessions.recall_by_vector(self.notes, self.embed(query), self.clock(), **only)
        return sessions.recall(self.notes, self.clock(), **only)

    def cleanup_session(self, keep: int = sessions.KEEP):
        return sessions.cleanup(self.notes, self.bookmarks, self.clock(), keep)
