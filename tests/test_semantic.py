"""Sources of two frameworks, from files to edges by rule."""

import pytest

from graphweave.sources import files, semantic

SOURCES = {
    "src/cat.controller.ts": """@Controller('cats')
@UseGuards(Guard)
export class CatController {
  constructor(private readonly cats: CatService, @Inject('TOKEN') other: Thing) {}
  @Get(':id')
  @HttpCode(201)
  @UseGuards(AuthGuard, RoleGuard)
  async one(@Param('id') id: string): Promise<Cat> { return this.cats.find(id); }
  @MessagePattern('cat.created')
  handle(data: any) { return this.cats.store(data); }
}
""",
    "src/cat.service.ts": "@Injectable({ scope: Scope.REQUEST })\nexport class CatService { find(id: string) { return load(id, 1, 2); } store(x: any) { return save(x, 1, 2); } }\n",
    "src/cat.module.ts": "@Global()\n@Module({ imports: [A, B], providers: [CatService], controllers: [CatController] })\nexport class CatModule { static forRoot(x: any) { return x; } }\n",
    "src/cat.entity.ts": "@Entity('cats')\nexport class CatRow { @PrimaryGeneratedColumn() id: number; @Column() name: string; @OneToMany(() => X, (x) => x.y) xs: X[]; }\n",
    "src/cat.dto.ts": "export class CatRequestDto extends Base { @IsString() @MinLength(2) name: string; @IsString() b: string; }\n",
    "src/own.ts": """@Injectable(['DogService', 'DogPermissionManager'])
export class DogController { list() { return this.all(1, 2, 3); } }
@Injectable(['DogRepository'])
export class DogService { client = new PayClient(); private other: Map<string, X> = y; }
@Injectable(["DogDAL"])
export class DogRepository {}
export class DogDAL {}
export class DogPermissionManager {}
export const dogRoutes: ModuleRoute[] = [{ method: 'GET', path: '/dogs', controller: DogController, handler: 'list', authenticated: true }, { nothing: 1 }];
""",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("frameworks")
    (root / "src").mkdir()
    for path, text in SOURCES.items():
        (root / path).write_text(text)
    return semantic.semantic_graph(files.source_files(spark, str(root)), "proj_0123456789ab")


def test_types_and_labels(graph):
    got = {r.name: (r.semanticType, r.labels) for r in graph.nodes.where("semanticType is not null").collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "CatController": "NestController", "CatService": "NestService", "CatModule": "NestModule", "CatRow": "EntityClass", "CatRequestDto": "DTOClass", "one": "HttpEndpoint", "handle": "MessageHandler",
        "DogController": "Controller", "DogService": "NestService", "DogRepository": "Repository", "DogDAL": "DAL", "DogPermissionManager": "PermissionManager", "dogRoutes": "RouteDefinition",
    }
    assert "HttpEndpoint" in next(r.labels for r in graph.nodes.where("name = 'list'").collect())


def test_edges_by_rule(graph):
    names = graph.nodes.select("id", "name")
    got = {(r.type, r.a, r.b): r.context for r in graph.edges.where("edge_id like 'SEM:%'").join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").collect()}
    assert set(got) == {
        ("INJECTS", "CatController", "CatService"), ("EXPOSES", "CatController", "one"), ("EXPOSES", "CatController", "handle"), ("INJECTS", "DogController", "DogService"), ("INJECTS", "DogController", "DogPermissionManager"),
        ("INJECTS", "DogService", "DogRepository"), ("INJECTS", "DogRepository", "DogDAL"), ("USES_DAL", "DogRepository", "DogDAL"), ("PROTECTED_BY", "DogController", "DogPermissionManager"), ("ROUTES_TO", "dogRoutes", "DogController"),
        ("ROUTES_TO_HANDLER", "dogRoutes", "list"),
    }
    assert '"fullPath":"/cats/:id"' in got["EXPOSES", "CatController", "one"] and '"statusCode":201' in got["EXPOSES", "CatController", "one"]


def test_contexts(graph):
    c = {r.name: r for r in semantic.class_context(graph.nodes).collect()}
    assert (c["CatController"].endpointCount, c["CatController"].hasGlobalGuards, c["CatController"].dependencyCount, c["CatController"].hasAsyncMethods) == (1, True, 2, True)
    assert c["CatService"].scope == "REQUEST" and c["CatModule"].isGlobal and c["CatModule"].isDynamic and c["CatModule"].imports == ["A", "B"] and c["CatModule"].controllers == ["CatController"]
    assert (c["CatRow"].tableName, c["CatRow"].columnCount, c["CatRow"].hasRelations) == ("cats", 2, True)
    assert c["CatRequestDto"].validationDecorators == ["IsString", "MinLength"] and c["CatRequestDto"].isRequestDto and c["CatRequestDto"].baseClass == "Base"
    m = {r.name: r for r in semantic.method_context(graph.nodes).collect()}
    assert (m["one"].httpMethod, m["one"].path, m["one"].guardNames, m["one"].hasAuth) == ("GET", ":id", ["AuthGuard", "RoleGuard"], True)
    assert m["handle"].pattern == "message" and m["handle"].messagePattern == "'cat.created'"
    nodes = {r.name: r for r in graph.nodes.collect()}
    assert nodes["DogService"].propertyTypes == ["PayClient", "Map<string, X>"] and nodes["CatController"].injectTokens == {1: "TOKEN"}


def test_semantic_edges_are_not_broadcast_by_a_guess(spark, sf):
    import __spark_entry__

    joins = __spark_entry__.queries()["p20_semantic_edges"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in joins and "SortMergeJoin" in joins
