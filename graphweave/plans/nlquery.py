"""Generated queries: prompt from a discovered schema, JSON out of a reply, and guards."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of syntax nodes, and the labels meant by them.
AST_LABELS = {
    "ClassDeclaration": "Class", "FunctionDeclaration": "Function", "MethodDeclaration": "Method", "InterfaceDeclaration": "Interface", "PropertyDeclaration": "Property",
    "ParameterDeclaration": "Parameter", "VariableDeclaration": "Variable", "ConstructorDeclaration": "Constructor", "ImportDeclaration": "Import",
    "ExportDeclaration": "Export", "EnumDeclaration": "Enum",
}
# Words that put a semantic type into a category of the prompt, in order.
CATEGORIES = [("controllers", r"controller"), ("services", r"service|provider"), ("repositories", r"repository|dal\b|entity"), ("endpoints", r"endpoint|handler|route"), ("modules", r"module"), ("data", r"dto|model")]


def categorised(types: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for t in types:
        name = next((c for c, p in CATEGORIES if re.search(p, t, re.I)), "other")
        out.setdefault(name, []).append(t)
    return out


def prompt(question: str, labels: list[str], relationships: list[str], semantic: list[str]) -> str:
    """Instructions for a model that answers {"sql": ..., "explanation": ...}."""
    kinds = "\n".join(f"- {c}: {', '.join(t)}" for c, t in categorised(semantic).items())
    return (
        "Answer with one JSON object {\"sql\", \"parameters\", \"explanation\"}. The SQL reads the tables nodes and edges and filters every use of them by projectId = :projectId.\n"
        f"Labels: {', '.join(labels)}\nRelationships: {', '.join(relationships)}\nSemantic types:\n{kinds}\nQuestion: {question}"
    )


def extract_json(reply: str) -> dict:
    """The reply itself, a fenced block of it, or its first balanced object."""
    for text in (reply, *re.findall(r"```(?:json)?\s*(.*?)```", reply, re.S)):
        try:
            got = json.loads(text.strip())
            if isinstance(got, dict):
                return got
        except ValueError:
            continue
    start = reply.find("{")
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(start, len(reply)):
            ch = reply[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"':
                quoted = True
            elif ch in "{}":
                depth += 1 if ch == "{" else -1
                if depth == 0:
                    try:
                        return json.loads(reply[start : i + 1])
                    except ValueError:
                        break
        start = reply.find("{", start + 1)
    raise ValueError("no JSON object in the reply")


def project_guard(query: str) -> list[str]:
    """Warnings; raises if a query reads the graph without naming the project.

    This is about the text only, as a hint to whoever wrote it: run() hands over
    tables of one project, whatever the text says.
    """
    reads = len(re.findall(r"\b(?:from|join)\s+(?:nodes|edges)\b", query, re.I)) + len(re.findall(r"\bMATCH\b", query, re.I))
    filters = len(re.findall(r"[:$]projectId\b", query))
    if reads and not filters:
        raise ValueError("the query has no filter by projectId")
    return [f"{filters} filters by project for {reads} reads"] if filters < reads else []


def table_guard(spark: SparkSession, query: str, tables) -> None:
    """Raises if a query, or a subquery of it, names a table, view or file that is not among ``tables``, or calls into the JVM."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query).toString()
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan):
        if name not in tables and ("," in name or "`" in name or spark.catalog.tableExists(name)):
            raise ValueError(f"the query may not read {name}")
    if re.search(r"\b(reflect|try_reflect|java_method)\s*\(", query, re.I):
        raise ValueError("the query may not call Java")


def label_guard(query: str, known: list[str]) -> None:
    """Raises on labels that are not in the schema, with a hint where a syntax name was used for a label."""
    used = set(re.findall(r"array_contains\(\s*(?:\w+\.)?labels\s*,\s*'([^']+)'\s*\)", query, re.I)) | set(re.findall(r"\(\s*\w*\s*:\s*([A-Za-z_]\w*)", query))
    bad = sorted(used - set(known))
    if bad:
        hints = [f"{b} (use {AST_LABELS[b]})" if b in AST_LABELS else b for b in bad]
        raise ValueError("unknown labels: " + ", ".join(hints))


def run(spark: SparkSession, reply: str, project: str, labels: list[str], tables: dict[str, DataFrame]) -> DataFrame:
    """Check a reply's query, let Spark analyse it, and return its DataFrame.

    The query sees the rows of ``project`` of the given tables, and nothing else.
    They are common table expressions around it, so it can use aliases, joins,
    subqueries and WITH as it likes.
    """
    query = extract_json(reply)["sql"].strip().rstrip(";")
    if not re.match(r"\s*(select|with)\b", query, re.I):
        raise ValueError("only queries that read are allowed")
    project_guard(query)
    label_guard(query, labels)
    table_guard(spark, query, tables)
    views = {k: f"nl_{k}_{uuid.uuid4().hex}" for k in tables}
    try:
        for k, df in tables.items():
            df.where(F.col("projectId") == project).createOrReplaceTempView(views[k])
        given = ", ".join(f"{k} AS (SELECT * FROM {v})" for k, v in views.items())
        return spark.sql(f"WITH {given} SELECT * FROM (\n{query}\n)", args={"projectId": project})
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)


def ask(question: str, model: Callable[[str], str], spark: SparkSession, project: str, labels, relationships, semantic, tables) -> DataFrame:
    """The whole way; ``model`` turns a prompt into a reply."""
    return run(spark, model(prompt(question, labels, relationships, semantic)), project, labels, tables)
