"""What frameworks mean by decorators and types, as columns; and source files to a graph with their meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rules
from ..operators.graph import PropertyGraph
from . import typescript

# Decorators of HTTP methods, of message handlers, of authorisation and of table columns and relations.
HTTP = ["Get", "Post", "Put", "Delete", "Patch", "Head", "Options"]
MESSAGE = ["EventPattern", "MessagePattern"]
AUTH = ["UseGuards", "Auth", "Roles", "Public"]
VALIDATION = ["UsePipes", "ValidationPipe"]
COLUMNS = ["Column", "PrimaryGeneratedColumn"]
RELATIONS = ["OneToOne", "OneToMany", "ManyToOne", "ManyToMany"]
VALIDATORS = [
    "IsString", "IsNumber", "IsEmail", "IsOptional", "IsNotEmpty", "MinLength", "MaxLength", "IsArray", "IsBoolean", "IsDate", "IsEnum", "IsUUID",
    "IsUrl", "Min", "Max", "Matches", "IsIn", "IsNotIn", "IsDefined", "ValidateNested",
]
DYNAMIC = ["forRoot", "forFeature", "forRootAsync", "forFeatureAsync"]


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(c, "['\"]", "")


def argument(decorator: str, at: int = 0) -> Column:
    """Text of a decorator's argument; null without it."""
    return F.get(F.try_element_at("decoratorArgs", F.lit(decorator)), F.lit(at))


def has_any(names: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap("decorators", F.array(*[F.lit(n) for n in names])), F.lit(False))


def listed(text: Column) -> Column:
    """Elements of an array literal."""
    inside = F.regexp_extract(text, r"^\s*\[([\s\S]*)\]\s*$", 1)
    return F.filter(F.transform(F.split(inside, ","), F.trim), lambda x: F.length(x) > 0)


def module_list(name: str) -> Column:
    inside = F.regexp_extract(argument("Module"), name + r"\s*:\s*\[([^\]]+)\]", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(_unquoted(x))), lambda x: F.length(x) > 0)


def project_of(path: Column) -> Column:
    """Folder of a workspace that a file belongs to."""
    got = F.regexp_extract(path, r"/(?:packages|apps|libs|components)/([^/]+)/", 1)
    return F.when(F.length(got) > 0, got)


def with_context(nodes: DataFrame) -> DataFrame:
    """Parsed nodes with the columns that the rules look at."""
    http = F.get(F.filter("decorators", lambda d: d.isin(HTTP)), F.lit(0))
    wanted = F.when(has_any(["Injectable"]), listed(argument("Injectable")))
    status = F.expr("try_cast(regexp_extract(decoratorArgs['HttpCode'][0], '^\\\\s*([0-9]+)', 1) AS int)")
    empty = F.array().cast("array<string>")
    rows = nodes.withColumns({
        "basePath": F.when(has_any(["Controller"]), F.concat(F.lit("/"), _unquoted(F.coalesce(argument("Controller"), F.lit(""))))),
        "httpMethod": F.upper(http), "path": F.when(http.isNotNull(), _unquoted(F.coalesce(F.get(F.try_element_at("decoratorArgs", http), F.lit(0)), F.lit("")))),
        "statusCode": status, "messagePattern": F.coalesce(argument("EventPattern"), argument("MessagePattern")), "dependencies": wanted,
    })
    lists = F.coalesce("dependencies", empty)
    return rows.withColumns({
        "dals": F.filter(lists, lambda d: F.lower(d).contains("dal")), "permissionManager": F.get(F.filter(lists, lambda d: F.lower(d).contains("permission")), F.lit(0)),
        "monorepoProject": project_of(F.col("filePath")),
    })


def class_context(nodes: DataFrame) -> DataFrame:
    """(id, ...) of classes: what their members and decorators tell."""
    m = nodes.where(F.col("parentClassName").isNotNull()).groupBy("filePath", F.col("parentClassName").alias("name")).agg(
        F.count_if(has_any(HTTP) & (F.col("coreType") == "MethodDeclaration")).alias("endpointCount"), F.coalesce(F.max(F.col("isAsync")), F.lit(False)).alias("hasAsyncMethods"),
        F.count_if(has_any(COLUMNS)).alias("columnCount"), F.coalesce(F.max(has_any(RELATIONS)), F.lit(False)).alias("hasRelations"),
        F.coalesce(F.max(F.col("isStatic") & F.col("name").isin(DYNAMIC)), F.lit(False)).alias("isDynamic"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: d.isin(VALIDATORS)))))).alias("validationDecorators"),
    )
    given = argument("Injectable")
    scope = F.when(given.contains("REQUEST"), "REQUEST").when(given.contains("TRANSIENT"), "TRANSIENT").otherwise("DEFAULT")
    c = nodes.where("coreType = 'ClassDeclaration'").select(
        "id", "filePath", "name", scope.alias("scope"), F.when(given.startswith("'"), _unquoted(given)).alias("injectionToken"), F.size("constructorTypes").alias("dependencyCount"),
        has_any(["Global"]).alias("isGlobal"), has_any(["UseGuards"]).alias("hasGlobalGuards"), has_any(["UsePipes"]).alias("hasGlobalPipes"), has_any(["UseInterceptors"]).alias("hasGlobalInterceptors"),
        _unquoted(argument("Version")).alias("version"), _unquoted(argument("Entity")).alias("tableName"), *[module_list(x).alias(x) for x in ("imports", "providers", "controllers", "exports")],
        F.lower("name").contains("request").alias("isRequestDto"), F.lower("name").contains("response").alias("isResponseDto"), F.coalesce(F.col("extendsName").contains("PartialType"), F.lit(False)).alias("isPartialDto"), F.col("extendsName").alias("baseClass"),
    )
    return c.join(m, ["filePath", "name"], "left")


def method_context(nodes: DataFrame) -> DataFrame:
    """(id, ...) of methods: authorisation, validation, guards, pipes, interceptors, message pattern."""
    named = lambda d: F.coalesce(F.transform(F.try_element_at("decoratorArgs", F.lit(d)), lambda x: F.trim(F.regexp_replace(x, "[(),]", ""))), F.array().cast("array<string>"))
    pattern = F.when(has_any(["EventPattern"]), "event").when(has_any(["MessagePattern"]), "message")
    return nodes.where("coreType = 'MethodDeclaration'").select(
        "id", "name", "parentClassName", "httpMethod", "path", "statusCode", "messagePattern", pattern.alias("pattern"), has_any(AUTH).alias("hasAuth"), has_any(VALIDATION).alias("hasValidation"),
        named("UseGuards").alias("guardNames"), named("UsePipes").alias("pipeNames"), named("UseInterceptors").alias("interceptorNames"),
    )


def semantic_graph(files: DataFrame, project: str, framework: str = "both", existing: PropertyGraph | None = None) -> PropertyGraph:
    """Source files to a graph with semantic types and the edges that rules find."""
    g = typescript.build_graph(files, project, existing)
    nodes = with_context(g.nodes)
    if framework in ("custom", "both"):
        nodes = rules.enhance(nodes, rules.custom_rules())
    if framework in ("nestjs", "both"):
        nodes = rules.enhance(nodes, rules.nest_rules())
    if framework == "vanilla":
        return PropertyGraph(nodes, g.edges)
    found = rules.rule_edges(nodes, framework)
    if framework in ("custom", "both"):
        nodes = rules.mark_endpoints(nodes, rules.routes_to_handler(nodes))
    return PropertyGraph(nodes, g.edges.unionByName(found.withColumn("projectId", F.lit(project)), allowMissingColumns=True))
