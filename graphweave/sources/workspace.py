"""Workspaces with several packages: their kind, their packages, and each file's package."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import exists, folders, read_text

# Where packages are if a workspace does not say.
DEFAULTS = {"turbo": ["apps/*", "packages/*"], "nx": ["apps/*", "libs/*", "packages/*"], "pnpm": ["packages/*"], "npm": ["packages/*"]}


def _json(spark: SparkSession, path: str) -> dict:
    try:
        got = json.loads(read_text(spark, path) or "{}")
        return got if isinstance(got, dict) else {}
    except ValueError:
        return {}


def kind(spark: SparkSession, root: str) -> str:
    """turbo, nx, pnpm, npm or single: the first whose marker is there."""
    there = lambda name: exists(spark, f"{root}/{name}")
    if there("turbo.json"):
        return "turbo"
    if there("nx.json"):
        return "nx"
    if there("pnpm-workspace.yaml"):
        return "pnpm"
    return "npm" if _json(spark, f"{root}/package.json").get("workspaces") else "single"


def patterns(spark: SparkSession, root: str, what: str) -> list[str]:
    """Globs of package folders: from pnpm-workspace.yaml or package.json, else the defaults of the kind."""
    text = read_text(spark, f"{root}/pnpm-workspace.yaml") or ""
    found = [m[1].strip().strip("'\"") for line in text.splitlines() if (m := re.match(r"\s*-\s*(.+?)\s*$", line))]
    if not found:
        spaces = _json(spark, f"{root}/package.json").get("workspaces") or []
        found = spaces.get("packages", []) if isinstance(spaces, dict) else list(spaces)
    if what == "nx" and not found:
        layout = _json(spark, f"{root}/nx.json").get("workspaceLayout") or {}
        found = [f"{d}/*" for d in (layout.get("appsDir"), layout.get("libsDir")) if d]
    return found or DEFAULTS.get(what, [])


def packages(spark: SparkSession, root: str) -> DataFrame:
    """(name, path, pos): packages of a workspace in order of path; patterns with ! are skipped.

    A package is a folder with package.json or project.json; without a name it has
    its folder's.  A workspace's folders are few, so the driver lists them, in
    whatever store they are.
    """
    root = root.rstrip("/")
    what, rows = kind(spark, root), {}
    base = lambda d: d.rsplit("/", 1)[-1]
    if what == "single":
        rows[root] = _json(spark, f"{root}/package.json").get("name") or base(root)
    for p in patterns(spark, root, what) if what != "single" else []:
        if p.startswith("!"):
            continue
        for d in folders(spark, f"{root}/{p.rstrip('/')}"):
            own = [f"{d}/{x}" for x in ("package.json", "project.json")]
            if any(exists(spark, x) for x in own):
                rows.setdefault(d, next((n for x in own if (n := _json(spark, x).get("name"))), base(d)))
    return spark.createDataFrame([(rows[d], d, i) for i, d in enumerate(sorted(rows))], "name string, path string, pos int")


def package_of(files: DataFrame, packages: DataFrame, path_col: str = "filePath") -> DataFrame:
    """``files`` with packageName: the first package, by path, that the file lies in.

    A folder's name must end where the package's does, so packages/ui does not
    take files of packages/ui-kit.  The join goes by every leading path of a file,
    an equi-join however many packages there are.
    """
    parts = F.split("_file", "/")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    paths = files.select(F.col(path_col).alias("_file")).distinct().withColumn("_head", F.explode(heads))
    met = paths.join(packages.select(F.col("path").alias("_head"), "name", "pos"), "_head")
    first = met.withColumn("_k", F.row_number().over(W.partitionBy("_file").orderBy("pos"))).where("_k = 1").select("_file", F.col("name").alias("packageName"))
    return files.join(first, files[path_col] == first["_file"], "left").drop("_file")
