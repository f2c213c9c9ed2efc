"""Semantic types by rule, and edges by rule: every pairwise condition is an equi-join.

Nodes carry what the rules look at: decorators (array), extendsName,
typeAnnotation, parentClassName, visibility, constructorTypes (array),
injectTokens (map from parameter position to token), dependencies, dals,
permissionManager, propertyTypes, routes (array of structs method, path,
controllerName, handler, authenticated), basePath, httpMethod, path, statusCode.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids


@dataclass
class NodeRule:
    """A semantic type for nodes of a core type that any of the patterns fits; the highest priority wins."""

    semantic_type: str
    core_type: str
    priority: int
    labels: list[str]
    decorators: list[str] = field(default_factory=list)
    file_pattern: str | None = None
    name_pattern: str | None = None
    extends: str | None = None
    condition: Column | None = None

    def fits(self) -> Column:
        any_of = F.lit(False)
        if self.decorators:
            any_of = any_of | F.coalesce(F.arrays_overlap("decorators", F.array(*[F.lit(d) for d in self.decorators])), F.lit(False))
        for column, pattern in (("filePath", self.file_pattern), ("name", self.name_pattern)):
            if pattern:
                any_of = any_of | F.coalesce(F.col(column).rlike(pattern), F.lit(False))
        if self.extends:
            any_of = any_of | F.coalesce(F.col("extendsName") == self.extends, F.lit(False))
        if self.condition is not None:
            any_of = any_of | F.coalesce(self.condition, F.lit(False))
        return (F.col("coreType") == self.core_type) & any_of


_CLASS, _METHOD, _VARIABLE = "ClassDeclaration", "MethodDeclaration", "VariableDeclaration"


def nest_rules() -> list[NodeRule]:
    """The semantic types of the Nest web framework."""
    return [
        NodeRule("NestModule", _CLASS, 95, ["Module", "NestJS"], ["Module"], r"\.module\.ts$"),
        NodeRule("NestController", _CLASS, 90, ["Controller", "NestJS"], ["Controller"], r"\.controller\.ts$"),
        NodeRule("MessageHandler", _METHOD, 88, ["MessageHandler", "NestJS", "Microservice"], ["MessagePattern", "EventPattern"]),
        NodeRule("HttpEndpoint", _METHOD, 85, ["HttpEndpoint", "NestJS"], ["Get", "Post", "Put", "Delete", "Patch", "Head", "Options"]),
        NodeRule("NestService", _CLASS, 80, ["Service", "NestJS"], [], r"\.service\.ts$", r"Service$"),
        NodeRule("EntityClass", _CLASS, 80, ["Entity", "NestJS"], ["Entity"], r"\.entity\.ts$"),
        NodeRule("DTOClass", _CLASS, 70, ["DTO", "NestJS"], [], r"\.dto\.ts$", r".*Dto$"),
    ]


def custom_rules() -> list[NodeRule]:
    """The semantic types of the second, custom framework."""
    route = F.col("name").endswith("Routes") & F.col("typeAnnotation").contains("ModuleRoute")
    vendor = F.col("filePath").contains("vendor-client") | F.col("filePath").contains("component-vendor")
    return [
        NodeRule("RouteDefinition", _VARIABLE, 110, [], condition=route),
        NodeRule("Controller", _CLASS, 100, ["BusinessLogic"], [], None, r"Controller$", "Controller"),
        NodeRule("Repository", _CLASS, 95, ["DataAccess"], [], None, r"Repository$", "Repository"),
        NodeRule("Service", _CLASS, 90, ["BusinessLogic"], ["Injectable"], None, r"Service$"),
        NodeRule("DAL", _CLASS, 85, ["DataAccess", "Database"], [], None, r"DAL$"),
        NodeRule("PermissionManager", _CLASS, 80, ["Security"], [], None, r"PermissionManager$"),
        NodeRule("VendorClient", _CLASS, 75, ["ExternalIntegration"], [], r"vendor-client", r"Client$", condition=vendor),
    ]


def enhance(nodes: DataFrame, rules: list[NodeRule]) -> DataFrame:
    """``nodes`` with the semantic type and labels of the first rule, by priority, that fits; others keep theirs."""
    kind, labels = F.col("semanticType"), F.col("labels")
    for r in sorted(rules, key=lambda r: r.priority):
        fits = r.fits()
        kind = F.when(fits, F.lit(r.semantic_type)).otherwise(kind)
        added = F.array(*[F.lit(x) for x in r.labels]) if r.labels else F.array().cast("array<string>")
        labels = F.when(fits, F.array_union(F.col("labels"), added)).otherwise(labels)
    return nodes.withColumns({"semanticType": kind, "labels": labels})


def enhance_both(nodes: DataFrame) -> DataFrame:
    """Custom types first, then Nest's, which win where both fit."""
    return enhance(enhance(nodes, custom_rules()), nest_rules())


def detect_framework(dependencies: Column, markers: list[str]) -> Column:
    """nestjs, custom, both or vanilla, of a map of package dependencies; ``markers`` are the custom framework's packages."""
    nest = F.map_contains_key(dependencies, "@nestjs/core") | F.map_contains_key(dependencies, "@nestjs/common")
    own = F.lit(False)
    for m in markers:
        own = own | F.map_contains_key(dependencies, m)
    nest, own = F.coalesce(nest, F.lit(False)), F.coalesce(own, F.lit(False))
    return F.when(nest & own, "both").when(nest, "nestjs").when(own, "custom").otherwise("vanilla")


# ---------------------------------------------------------------- edges


def _edges(rows: DataFrame, kind: str, weight: float, context: Column) -> DataFrame:
    return rows.select(
        ids.rule_edge_id(F.lit(kind), F.col("src"), F.col("dst")).alias("edge_id"), F.lit(kind).alias("type"), "src", "dst", F.lit(weight).alias("relationshipWeight"),
        F.lit(0.8).alias("confidence"), F.lit("pattern").alias("source"), F.to_json(context).alias("context"),
    )


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "['\"]", ""))


def _named(nodes: DataFrame, semantic: str | None = None, core: str | None = None) -> DataFrame:
    rows = nodes
    if semantic:
        rows = rows.where(F.col("semanticType") == semantic)
    if core:
        rows = rows.where(F.col("coreType") == core)
    return rows.select(F.col("id").alias("dst"), F.col("name").alias("target"))


def nest_injects(nodes: DataFrame) -> DataFrame:
    """INJECTS: a class, and the classes that its constructor's types or @Inject tokens name."""
    src = nodes.where(F.col("coreType") == _CLASS)
    types = F.coalesce("constructorTypes", F.array().cast("array<string>"))
    tokens = F.coalesce("injectTokens", F.create_map().cast("map<int,string>"))
    wants = src.select(F.col("id").alias("src"), types.alias("types"), tokens.alias("tokens"), F.explode(F.array_union(types, F.transform(F.map_values(tokens), _clean))).alias("target"))
    met = wants.join(_named(nodes, core=_CLASS), "target").where("src != dst")
    at = F.array_position("types", F.col("target")) - 1
    by_token = F.get(F.map_keys(F.map_filter("tokens", lambda k, v: _clean(v) == F.col("target"))), F.lit(0))
    position = F.when(at >= 0, at.cast("int")).otherwise(by_token)
    token = F.when(at < 0, F.col("target"))
    return _edges(met, "INJECTS", 0.95, F.struct(F.lit("constructor").alias("injectionType"), token.alias("injectionToken"), position.alias("parameterIndex")))


def full_path(base: Column, path: Column) -> Column:
    """/base/path with single slashes."""
    joined = F.concat(F.lit("/"), F.coalesce(base, F.lit("")), F.lit("/"), F.coalesce(path, F.lit("")))
    return F.regexp_replace(F.regexp_replace(joined, "/+", "/"), "(?<=.)/$", "")


def nest_exposes(nodes: DataFrame) -> DataFrame:
    """EXPOSES: a controller and the message handlers and HTTP endpoints of its class, in its file."""
    c = nodes.where("semanticType = 'NestController'").select(F.col("id").alias("src"), "filePath", F.col("name").alias("parentClassName"), F.col("basePath").alias("base"))
    m = nodes.where("semanticType in ('MessageHandler', 'HttpEndpoint')").select(F.col("id").alias("dst"), "filePath", "parentClassName", "semanticType", F.col("name").alias("method"), "httpMethod", "path", "statusCode")
    met = c.join(m, ["filePath", "parentClassName"])
    http = F.col("semanticType") == "HttpEndpoint"
    told = F.struct(
        F.when(http, "http").otherwise("message").alias("endpointType"), F.col("method").alias("methodName"), F.when(http, F.coalesce("httpMethod", F.lit(""))).alias("httpMethod"),
        F.when(http, full_path(F.col("base"), F.col("path"))).alias("fullPath"), F.when(http, F.coalesce("statusCode", F.lit(200))).alias("statusCode"),
    )
    return _edges(met, "EXPOSES", 0.9, told)


def _by_list(nodes: DataFrame, source: DataFrame, column: str, targets: DataFrame, kind: str, weight: float, exact: bool = True) -> DataFrame:
    wants = source.select(F.col("id").alias("src"), F.col("name").alias("source"), F.explode(F.array_distinct(F.transform(column, _clean))).alias("target"))
    met = wants.join(targets, "target").where("src != dst")
    return _edges(met, kind, weight, F.struct(F.col("source").alias("sourceName"), F.col("target").alias("targetName")))


def custom_injects(nodes: DataFrame) -> DataFrame:
    return _by_list(nodes, nodes.where(F.col("coreType") == _CLASS), "dependencies", _named(nodes, core=_CLASS), "INJECTS", 0.95)


def uses_dal(nodes: DataFrame) -> DataFrame:
    return _by_list(nodes, nodes.where("semanticType = 'Repository'"), "dals", _named(nodes, "DAL"), "USES_DAL", 0.85)


def protected_by(nodes: DataFrame) -> DataFrame:
    src = nodes.where("semanticType = 'Controller' and permissionManager is not null").withColumn("_one", F.array("permissionManager"))
    return _by_list(nodes, src, "_one", _named(nodes, "PermissionManager"), "PROTECTED_BY", 0.88)


def uses_repository(nodes: DataFrame) -> DataFrame:
    """USES_REPOSITORY: a service and the repositories among its dependencies and property types."""
    both = F.array_union(F.coalesce("dependencies", F.array().cast("array<string>")), F.coalesce("propertyTypes", F.array().cast("array<string>")))
    src = nodes.where("semanticType = 'Service'").withColumn("_all", both)
    return _by_list(nodes, src, "_all", _named(nodes, "Repository"), "USES_REPOSITORY", 0.8)


def routes_to(nodes: DataFrame) -> DataFrame:
    """ROUTES_TO: route definitions and controllers, with all routes between the two."""
    r = nodes.where("semanticType = 'RouteDefinition'").select(F.col("id").alias("src"), F.posexplode("routes").alias("pos", "r"))
    met = r.join(_named(nodes, "Controller"), F.col("r.controllerName") == F.col("target"))
    g = met.groupBy("src", "dst").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "r"))).alias("all"))
    told = F.struct(F.col("n").alias("routeCount"), F.transform("all", lambda x: x.r.method).alias("methods"), F.transform("all", lambda x: x.r.path).alias("paths"))
    return _edges(g, "ROUTES_TO", 0.92, told)


def routes_to_handler(nodes: DataFrame) -> DataFrame:
    """ROUTES_TO_HANDLER: route definitions and the methods that routes name, by class and method."""
    r = nodes.where("semanticType = 'RouteDefinition'").select(F.col("id").alias("src"), F.posexplode("routes").alias("pos", "r"))
    m = nodes.where(F.col("coreType") == _METHOD).select(F.col("id").alias("dst"), F.col("name").alias("method"), F.col("parentClassName").alias("cls"))
    met = r.join(m, (F.col("r.handler") == F.col("method")) & (F.col("r.controllerName") == F.col("cls")))
    first = met.groupBy("src", "dst").agg(F.min_by("r", "pos").alias("r"))
    told = F.struct(F.col("r.method").alias("method"), F.col("r.path").alias("path"), F.col("r.handler").alias("handler"), F.col("r.controllerName").alias("controllerName"), F.col("r.authenticated").alias("authenticated"))
    return _edges(first, "ROUTES_TO_HANDLER", 0.9, told)


def mark_endpoints(nodes: DataFrame, handlers: DataFrame) -> DataFrame:
    """Public methods that a route goes to get the label HttpEndpoint."""
    hit = handlers.select(F.col("dst").alias("id"), F.lit(True).alias("_routed")).distinct()
    rows = nodes.join(hit, "id", "left")
    public = F.coalesce(F.col("_routed"), F.lit(False)) & (F.col("visibility") == "public")
    return rows.withColumn("labels", F.when(public, F.array_union("labels", F.array(F.lit("HttpEndpoint")))).otherwise(F.col("labels"))).drop("_routed")


def internal_api_call(nodes: DataFrame) -> DataFrame:
    """INTERNAL_API_CALL: a service with a property of type <Vendor>Client, and that vendor's controller.

    A controller belongs to a vendor if Vendor is in its name or modules/vendor in
    its path; the vendor is its name without VendorController or Controller.
    """
    vendor = F.when(F.col("name").endswith("VendorController"), F.regexp_replace("name", "VendorController", "")).when(F.col("name").endswith("Controller"), F.regexp_replace("name", "Controller", ""))
    c = nodes.where("semanticType = 'Controller'").where(F.col("name").contains("Vendor") | F.col("filePath").contains("modules/vendor"))
    c = c.select(F.col("id").alias("dst"), F.lower(vendor).alias("vendor")).where("length(vendor) > 0")
    c = c.withColumn("target", F.concat(F.upper(F.substring("vendor", 1, 1)), F.expr("substring(vendor, 2)"), F.lit("Client")))
    s = nodes.where("semanticType = 'Service'").select(F.col("id").alias("src"), F.col("name").alias("service"), F.explode(F.array_distinct("propertyTypes")).alias("target"))
    met = s.join(c, "target")
    return _edges(met, "INTERNAL_API_CALL", 0.82, F.struct("service", "vendor", F.col("target").alias("client")))


def rule_edges(nodes: DataFrame, framework: str = "both") -> DataFrame:
    """All edges by rule of a framework (nestjs, custom or both); of equal ids one stays."""
    made = []
    if framework in ("nestjs", "both"):
        made += [nest_injects(nodes), nest_exposes(nodes)]
    if framework in ("custom", "both"):
        made += [custom_injects(nodes), uses_dal(nodes), protected_by(nodes), routes_to(nodes), routes_to_handler(nodes), internal_api_call(nodes), uses_repository(nodes)]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    k = F.row_number().over(W.partitionBy("edge_id").orderBy("type", "context"))
    return out.withColumn("_k", k).where("_k = 1").drop("_k")


def parse_stats(nodes: DataFrame) -> DataFrame:
    """(dimension, value, n): nodes by core type and by semantic type, in one pass."""
    counted = nodes.sparkSession.sql(
        "SELECT CASE WHEN grouping(coreType) = 0 THEN 'coreType' ELSE 'semanticType' END AS dimension, coalesce(coreType, semanticType) AS value, count(*) AS n "
        "FROM {n} GROUP BY GROUPING SETS ((coreType), (semanticType))", n=nodes.select("coreType", "semanticType"))  # fmt: skip
    return counted.where("value is not null")
