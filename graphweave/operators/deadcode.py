"""Code that nothing refers to: anti-joins, rules for exclusion, confidence and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Relationships that count as a reference, for exports and for interfaces.
EXPORT_REFERENCES = ["IMPORTS", "EXTENDS", "IMPLEMENTS", "TYPED_AS", "INJECTS", "CALLS"]
INTERFACE_REFERENCES = ["IMPLEMENTS", "EXTENDS", "TYPED_AS", "IMPORTS"]

# Files that frameworks enter by themselves.
ENTRY_FILES = [
    "main.ts", "app.ts", "index.ts", "*.module.ts", "*.controller.ts", "*.routes.ts", "*.router.ts", "*.handler.ts", "server.ts", "page.tsx", "page.ts",
    "layout.tsx", "layout.ts", "route.tsx", "route.ts", "loading.tsx", "error.tsx", "not-found.tsx", "template.tsx", "default.tsx", "root.tsx",
    "*.astro",
]
# What reports say.
NEVER_IMPORTED, NEVER_CALLED, NEVER_IMPLEMENTED = "Exported but never imported or referenced", "Private method never called", "Interface never implemented or referenced"
CONFIDENCE_REASONS = {"HIGH": "Exported but never imported anywhere", "MEDIUM": "Private method with no internal callers", "LOW": "Could be used via dynamic references"}
ENTRY_SUFFIXES = ["main.ts", ".module.ts", ".controller.ts", "index.ts"]
EXPORTABLE = ["ClassDeclaration", "FunctionDeclaration", "InterfaceDeclaration"]


def _without(nodes: DataFrame, references: DataFrame) -> DataFrame:
    return nodes.join(references.select(F.col("dst").alias("_id")), nodes.id == F.col("_id"), "left_anti")


def unreferenced_exports(nodes: DataFrame, edges: DataFrame, core_types=EXPORTABLE, types=EXPORT_REFERENCES, other_file: bool = True) -> DataFrame:
    """Exported nodes without a reference from another file (or, without ``other_file``, from anywhere)."""
    wanted = nodes.where(F.col("isExported") & F.col("coreType").isin(list(core_types)))
    refs = edges.where(F.col("type").isin(list(types)))
    if other_file:
        a = nodes.select(F.col("id").alias("src"), F.col("filePath").alias("_from"))
        b = nodes.select(F.col("id").alias("dst"), F.col("filePath").alias("_to"))
        refs = refs.join(a, "src").join(b, "dst").where(F.col("_from") != F.col("_to"))
    return _without(wanted, refs).withColumn("reason", F.lit(NEVER_IMPORTED))


def uncalled_private_methods(nodes: DataFrame, edges: DataFrame, core_type: str = "MethodDeclaration", types=("CALLS",)) -> DataFrame:
    wanted = nodes.where((F.col("coreType") == core_type) & (F.col("visibility") == "private"))
    return _without(wanted, edges.where(F.col("type").isin(list(types)))).withColumn("reason", F.lit(NEVER_CALLED))


def unreferenced_interfaces(nodes: DataFrame, edges: DataFrame, core_type: str = "InterfaceDeclaration", types=INTERFACE_REFERENCES) -> DataFrame:
    """Exported interfaces without any reference; those from the same file count."""
    wanted = nodes.where((F.col("coreType") == core_type) & F.col("isExported"))
    return _without(wanted, edges.where(F.col("type").isin(list(types)))).withColumn("reason", F.lit(NEVER_IMPLEMENTED))


def semantic_types(nodes: DataFrame) -> DataFrame:
    return nodes.where("semanticType is not null").select("semanticType").distinct()


def entry_points(nodes: DataFrame, semantic=None, suffixes=ENTRY_SUFFIXES, core_types=EXPORTABLE) -> DataFrame:
    """Nodes of framework types (any semantic type, if ``semantic`` is None) or in files with such an ending."""
    framework = F.col("semanticType").isNotNull() if semantic is None else F.coalesce(F.col("semanticType").isin(list(semantic)), F.lit(False))
    at_end = F.lit(False)
    for s in suffixes:
        at_end = at_end | F.col("filePath").endswith(s)
    return nodes.where(F.col("coreType").isin(list(core_types)) & (framework | at_end))


def confidence(exported="isExported", visibility="visibility", reason="reason"):
    return F.when(F.coalesce(F.col(exported), F.lit(False)) & F.col(reason).contains("never imported"), "HIGH").when(F.col(visibility) == "private", "MEDIUM").otherwise("LOW")


def confidence_reason(level="confidence"):
    told = CONFIDENCE_REASONS
    return F.when(F.col(level) == "HIGH", told["HIGH"]).when(F.col(level) == "MEDIUM", told["MEDIUM"]).otherwise(told["LOW"])


def category(path="filePath"):
    return F.when(T.is_ui_component(F.col(path)), "ui-component").when(T.is_package_export(F.col(path)), "library-export").otherwise("internal-unused")


def risk_level(total, high):
    return F.when((high >= 20) | (total >= 50), "CRITICAL").when((high >= 10) | (total >= 25), "HIGH").when((high >= 5) | (total >= 10), "MEDIUM").otherwise("LOW")


def report(exports: DataFrame, methods: DataFrame, interfaces: DataFrame, entries: DataFrame, exclude_semantic: bool = True, patterns=()) -> DataFrame:
    """All findings with confidence and category.

    Entry points and files with an excluded ending go.  Any semantic type exempts
    exports and methods, not interfaces, which may come up twice.
    """
    first = exports.unionByName(methods)
    if exclude_semantic:
        first = first.where("semanticType is null")
    found = first.unionByName(interfaces)
    found = found.join(entries.select(F.col("id").alias("_entry")), found.id == F.col("_entry"), "left_anti")
    found = found.where(~T.file_suffix_excluded(F.col("filePath"), [*ENTRY_FILES, *patterns]))
    rows = found.withColumn("confidence", confidence()).withColumn("category", category())
    return rows.withColumn("confidence_reason", confidence_reason())


def page(found: DataFrame, least: str = "LOW", category_is: str = "all", without_library: bool = False, without_types=(), offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the findings in order of file, line and id."""
    levels = ["LOW", "MEDIUM", "HIGH"]
    rows = found.where(F.col("confidence").isin(levels[levels.index(least) :]))
    if without_library:
        rows = rows.where("category != 'library-export'")
    if without_types:
        rows = rows.where(~F.col("coreType").isin(list(without_types)))
    if category_is != "all":
        rows = rows.where(F.col("category") == category_is)
    return rows.orderBy("filePath", "startLine", "id", "reason").offset(offset).limit(limit)


def stats(found: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """One row: counts by confidence and category over all findings, and the risk, whose total is of the shown ones."""
    totals = [F.count("*").alias("total"), F.countDistinct("filePath").alias("affected_files")]
    counts = [
        F.count("*").alias("total_before_filter"),
        *[F.count_if(F.col("confidence") == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")],
        *[F.count_if(F.col("category") == x).alias(x.replace("-", "_")) for x in ("library-export", "ui-component", "internal-unused")],
    ]
    both = found.agg(*counts, *totals) if shown is None else found.agg(*counts).join(shown.agg(*totals))  # a row each
    return both.withColumn("risk_level", risk_level(F.col("total"), F.col("high")))


def top_files(found: DataFrame, most: int = 20) -> DataFrame:
    return found.groupBy(T.short_path(F.col("filePath")).alias("file")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "file").limit(most)
