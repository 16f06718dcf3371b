"""Golden queries: the parser, rules, tracer and configuration over made-up sources, and their expected rows as SQL VALUES."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..operators import endpoints as E
from ..operators import extract as X
from ..operators import facts as A
from ..operators import graph as G
from ..operators import mutate as M
from ..operators.staging import staged
from ..sources import config as C
from ..sources import rules as R
from . import fixtures as D

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, columns: str, *rows: tuple):
    """Register a query and the rows it must give."""

    def text(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    def add(f):
        QUERIES[name] = lambda spark, d: f(spark)
        names = ", ".join(f'"{c}"' for c in columns.split())
        ORACLE[name] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(text(v) for v in r) + ')' for r in rows)}) t({names})"
        return f

    return add


def sources(spark):
    rows = [(p, "git://acme", "main", text) for p, text in D.SOURCES.items()]
    return spark.createDataFrame(rows, "projectFilePath string, gitRepoUrl string, gitBranch string, content string")


def config(spark):
    return C.entries(spark.createDataFrame(list(D.CONFIG.items()), "path string, content string"))


def facts(spark):
    return A.parse_sources(sources(spark), C.dictionary(config(spark)), R.load())


def typed(spark):
    return X.types(staged(A.resolved(staged(facts(spark), "facts")), "resolved"))


def graph(spark):
    return X.build(facts(spark), R.load())


def points(spark):
    t = typed(spark)
    return E.extract(t, X.methods(t), R.load())


ORDER, STOCK, BASE, WEB, ROUTES = "org.acme.shop.controller.OrderController", "org.acme.shop.client.StockClient", "org.acme.shop.client.BaseClient", "org.acme.stock.web.StockController", "org.acme.stock.Routes"
T = "java.lang.String"


@query(
    "packages", "id packagePath projectFilePath",
    ("org.acme.shop.controller", "org/acme/shop/controller", "shop/src/main/java/org/acme/shop/controller"),
    ("org.acme.shop.client", "org/acme/shop/client", "shop/src/main/java/org/acme/shop/client"),
    ("org.acme.stock.web", "org/acme/stock/web", "stock/src/main/java/org/acme/stock/web"),
    ("org.acme.stock", "org/acme/stock", "stock/src/main/java/org/acme/stock"),
)
def packages(spark):
    return X.packages(A.resolved(facts(spark))).select("id", "packagePath", "projectFilePath")


@query(
    "units", "id unitType modifiers isAbstract startLine endLine packageId",
    (ORDER, "class", "public", False, 6, 31, "org.acme.shop.controller"),
    (STOCK, "class", "public", False, 6, 35, "org.acme.shop.client"),
    (BASE, "class", "abstract", True, 3, 7, "org.acme.shop.client"),
    (WEB, "interface", "public", False, 3, 13, "org.acme.stock.web"),
    (ROUTES, "class", "", False, 3, 15, "org.acme.stock"),
)
def units(spark):
    return X.units(typed(spark)).select("id", "unitType", F.array_join("modifiers", ",").alias("modifiers"), "isAbstract", "startLine", "endLine", "packageId")


@query(
    "functions", "id signature returnType modifiers isStatic isConstructor startLine",
    (f"{ORDER}.place({T},int)", "place(String,int)", T, "public", False, False, 10),
    (f"{ORDER}.list(int[])", "list(int[])", "java.util.List", "", False, False, 20),
    (f"{ORDER}.audit(java.lang.Runnable)", "audit(Runnable)", "void", "private", False, False, 28),
    (f"{STOCK}.StockClient({T})", "StockClient(String)", "void", "public", False, True, 12),
    (f"{STOCK}.reserve({T},int)", "reserve(String,int)", "boolean", "public", False, False, 16),
    (f"{STOCK}.release({T})", "release(String)", "void", "public", False, False, 23),
    (f"{STOCK}.getName()", "getName()", T, "", False, False, 32),
    (f"{STOCK}.find({T})", "find(String)", T, "", False, False, 33),
    (f"{STOCK}.find(java.lang.Long)", "find(Long)", T, "", False, False, 34),
    (f"{BASE}.log(java.lang.Number)", "log(T)", BASE, "protected", False, False, 4),
    (f"{BASE}.log({T})", "log(String)", BASE, "protected", False, False, 5),
    (f"{BASE}.log({T},int)", "log(String,int)", BASE, "static", True, False, 6),
    (f"{WEB}.reserve({T})", "reserve(String)", "void", "", False, False, 5),
    (f"{WEB}.release({T})", "release(String)", "void", "", False, False, 8),
    (f"{WEB}.all(java.util.Map)", "all(Map)", "java.lang.Object[]", "", False, False, 11),
    (f"{ROUTES}.build(Router,Unknown)", "build(Router,Unknown)", "void", "", False, False, 6),
    (f"{ROUTES}.other()", "other()", "Thing", "", False, False, 12),
)
def functions(spark):
    t = X.functions(X.methods(typed(spark)))
    return t.select("id", "signature", "returnType", F.array_join("modifiers", ",").alias("modifiers"), "isStatic", "isConstructor", "startLine")


@query(
    "calls", "fromNodeId toNodeId lineNumber callType",
    (f"{ORDER}.place({T},int)", f"{STOCK}.reserve({T},int)", 15, "direct"),
    (f"{ORDER}.place({T},int)", f"{ORDER}.audit(java.lang.Runnable)", 16, "direct"),
    (f"{ORDER}.place({T},int)", f"{STOCK}.release({T})", 16, "direct"),
    (f"{STOCK}.reserve({T},int)", f"{BASE}.log({T})", 19, "direct"),
    (f"{STOCK}.reserve({T},int)", f"{BASE}.log({T},int)", 19, "direct"),
    (f"{STOCK}.release({T})", f"{STOCK}.find({T})", 24, "direct"),
    (f"{ROUTES}.build(Router,Unknown)", f"{ROUTES}.other()", 9, "direct"),
)
def calls(spark):
    known = staged(A.resolved(staged(facts(spark), "facts")), "resolved")
    return X.calls(X.call_targets(known, X.methods(X.types(known)))).select("fromNodeId", "toNodeId", "lineNumber", "callType")


def resolved_sites(spark):
    rows = spark.createDataFrame([(f"s/src/{n}.java", None, None, t) for n, t in D.TYPES.items()], "projectFilePath string, gitRepoUrl string, gitBranch string, content string")
    known, shapes = X.front(staged(A.parse_sources(rows), "facts"))
    return X.R.resolve_sites(staged(X.methods(X.types(known)), "methods"), shapes)


CHOSEN = [
    (5, "p.C0.foo()"), *[(6, "p.C0.foo()")] * 5, (7, "q.U.util()"), (8, f"p.B.va({T}[])"), (9, "p.B.lng(long)"), (10, "p.B.obj(java.lang.Integer)"), (11, "p.B.obj(java.lang.Object)"),
    (12, "p.C0.foo()"), (13, "p.C0.foo()"), (14, "p.C0.foo()"), (15, "p.B.over(p.C2)"), (16, "p.B.over(p.C0)"), (17, "p.B.bx(java.lang.Integer)"), (18, "p.Box.next()"), (18, "p.Box.get()"), (18, "p.B.lng(long)"),
    (19, "p.Color.paint()"), (20, "p.Outer.make()"), (20, "p.Outer.Inner.deep()"), (21, "p.C0.foo()"),
]


@query("calls_resolution", "line target", *CHOSEN)
def calls_resolution(spark):
    """Inheritance of any depth, chains, static imports, varargs, widening, boxing, arrays, inherited fields, overloads, generics, enums, nested types."""
    return X.targets(resolved_sites(spark)).where("callerId like 'p.B.main(%'").select("line", F.col("targetId").alias("target"))


@query("unresolved_calls", "line name reason", (22, "nothing", "member"), (22, "call", "receiver"), (22, "one", "several"))
def unresolved_calls(spark):
    """Sites without a target are rows with a reason."""
    return X.unresolved(resolved_sites(spark)).where("callerId like 'p.B.main(%'").select(F.col("lineNumber").alias("line"), "name", "reason")


BATCHES = {
    "s/src/C.java": "package p; public class C { C foo() { return this; } protected C up; }",
    "s/src/B.java": "package p; public class B extends C { }",
    "s/src/A.java": "package p; class A { void m(B b) { b.foo(); b.up.foo(); } }",
}


@query(
    "incremental_inherited", "step fromNodeId toNodeId lineNumber",
    *[(k, "p.A.m(p.B)", "p.C.foo()", 1) for k in (1, 1, 2, 2, 3)], (3, "p.A.m(p.B)", "p.B.foo()", 1),
)
def incremental_inherited(spark):
    """Calls after all files are added (1), after an unchanged file is modified (2), and after a type that others use gets an override (3)."""
    from ..engine import Engine
    from ..operators.staging import shared_dir

    files = dict(BATCHES)
    rows = lambda: spark.createDataFrame([(p, None, None, t) for p, t in files.items()], "projectFilePath string, gitRepoUrl string, gitBranch string, content string")
    engine = Engine(spark, f"{shared_dir(spark)}/inherited-{uuid.uuid4().hex}", rows, endpoints=False)
    seen = lambda k: staged(G.edges_of(engine.store.read()["edges"], "CALLS").select(F.lit(k).alias("step"), "fromNodeId", "toNodeId", "lineNumber"), "calls-seen")
    known = {"eventId": F.col("projectFilePath"), "newProjectFilePath": F.col("projectFilePath"), "changeType": F.lit("SOURCE_ADDED"), "timestamp": F.current_timestamp()}
    engine.apply(rows().select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.CHANGES]))
    out = [seen(1)]
    for path, text in (("s/src/A.java", files["s/src/A.java"]), ("s/src/B.java", "package p; public class B extends C { B foo() { return this; } }")):
        files[path] = text
        answer = engine.file_modified(path)
        if answer["code"] != 200:
            raise RuntimeError(answer["message"])
        out.append(seen(len(out) + 1))
    return reduce(DataFrame.unionByName, out)


def structure(spark, kind):
    t = typed(spark)
    return X.structure(X.units(t), X.methods(t)).where(F.col("relationshipType") == kind).select("fromNodeId", "toNodeId")


@query("package_to_unit", "fromNodeId toNodeId", *[(u.rpartition(".")[0], u) for u in (ORDER, STOCK, BASE, WEB, ROUTES)])
def package_to_unit(spark):
    return structure(spark, "PACKAGE_TO_UNIT")


@query("unit_to_function", "unit functions", (ORDER, 3), (STOCK, 6), (BASE, 3), (WEB, 3), (ROUTES, 2))
def unit_to_function(spark):
    return structure(spark, "UNIT_TO_FUNCTION").groupBy(F.col("fromNodeId").alias("unit")).agg(F.count("*").cast("int").alias("functions"))


POINT = "id path normalizedPath matchIdentity"


@query(
    "rule_mvc_inbound", POINT,
    ("inbound:HTTP:POST:/api/orders/{shop}/place", "/api/orders/{shop}/place", "/api/orders/{param}/place", "POST /api/orders/{param}/place"),
    ("inbound:HTTP:GET:/api/orderslist/{page}", "/api/orderslist/{page}", "/api/orderslist/{param}", "GET /api/orderslist/{param}"),
    ("inbound:HTTP:PUT:/v1/items{sku}", "/v1/items{sku}", "/v1/items{param}", "PUT /v1/items{param}"),
    ("inbound:HTTP:DELETE:/v1/items/{id}", "/v1/items/{id}", "/v1/items/{param}", "DELETE /v1/items/{param}"),
    ("inbound:HTTP:GET:/v1/items", "/v1/items", "/v1/items", "GET /v1/items"),
)
def rule_mvc_inbound(spark):
    t = typed(spark)
    rules = [r for r in R.load() if r["name"].startswith("Spring")]
    return E.extract(t, X.methods(t), rules).select(*POINT.split())


@query(
    "rule_resttemplate", POINT,
    ("outbound:HTTP:PUT:/v0/v1/items/{sku}", "/v0/v1/items/{sku}", "/v0/v1/items/{param}", "PUT /v0/v1/items/{param}"),
    ("outbound:HTTP:PUT:/v1/items/{sku}", "/v1/items/{sku}", "/v1/items/{param}", "PUT /v1/items/{param}"),
    ("outbound:HTTP:DELETE:/v1/items/{METHOD:find()}", "/v1/items/{METHOD:find()}", "/v1/items/{param}", "DELETE /v1/items/{param}"),
    ("outbound:HTTP:DELETE:/v1/items/{sku}", "/v1/items/{sku}", "/v1/items/{param}", "DELETE /v1/items/{param}"),
)
def rule_resttemplate(spark):
    t = typed(spark)
    rules = [r for r in R.load() if r["name"].startswith("RestTemplate")]
    return E.extract(t, X.methods(t), rules).select(*POINT.split())


@query(
    "rule_router", POINT,
    ("inbound:HTTP:GET:/v2/routes/all", "/v2/routes/all", "/v2/routes/all", "GET /v2/routes/all"),
    ("inbound:HTTP:ROUTE:/one/1{name}", "/one/1{name}", "/one/1{param}", "ROUTE /one/1{param}"),
    ("inbound:HTTP:POST:/never", "/never", "/never", "POST /never"),
)
def rule_router(spark):
    """The last receiver's type is not known, which satisfies the condition unless the engine is strict."""
    t = typed(spark)
    rules = [r for r in R.load() if r["name"].startswith("Vert.x")]
    return E.extract(t, X.methods(t), rules).select(*POINT.split())


@query("rule_router_strict", "id", ("inbound:HTTP:GET:/v2/routes/all",), ("inbound:HTTP:ROUTE:/one/1{name}",))
def rule_router_strict(spark):
    t = typed(spark)
    rules = [r for r in R.load() if r["name"].startswith("Vert.x")]
    return E.extract(t, X.methods(t), rules, strict=True).select("id")


@query(
    "endpoint_edges", "fromNodeId toNodeId relationshipType",
    ("inbound:HTTP:POST:/api/orders/{shop}/place", f"{ORDER}.place({T},int)", "ENDPOINT_TO_FUNCTION"),
    ("inbound:HTTP:GET:/api/orderslist/{page}", f"{ORDER}.list(int[])", "ENDPOINT_TO_FUNCTION"),
    ("inbound:HTTP:PUT:/v1/items{sku}", f"{WEB}.reserve({T})", "ENDPOINT_TO_FUNCTION"),
    ("inbound:HTTP:DELETE:/v1/items/{id}", f"{WEB}.release({T})", "ENDPOINT_TO_FUNCTION"),
    ("inbound:HTTP:GET:/v1/items", f"{WEB}.all(java.util.Map)", "ENDPOINT_TO_FUNCTION"),
    (f"{STOCK}.reserve({T},int)", "outbound:HTTP:PUT:/v0/v1/items/{sku}", "FUNCTION_TO_ENDPOINT"),
    (f"{STOCK}.reserve({T},int)", "outbound:HTTP:PUT:/v1/items/{sku}", "FUNCTION_TO_ENDPOINT"),
    (f"{STOCK}.release({T})", "outbound:HTTP:DELETE:/v1/items/{METHOD:find()}", "FUNCTION_TO_ENDPOINT"),
    (f"{STOCK}.release({T})", "outbound:HTTP:DELETE:/v1/items/{sku}", "FUNCTION_TO_ENDPOINT"),
    ("inbound:HTTP:GET:/v2/routes/all", f"{ROUTES}.build(Router,Unknown)", "ENDPOINT_TO_FUNCTION"),
    ("inbound:HTTP:ROUTE:/one/1{name}", f"{ROUTES}.build(Router,Unknown)", "ENDPOINT_TO_FUNCTION"),
    ("inbound:HTTP:POST:/never", f"{ROUTES}.build(Router,Unknown)", "ENDPOINT_TO_FUNCTION"),
)
def endpoint_edges(spark):
    t = typed(spark)
    m = X.methods(t)
    return E.links(E.extract(t, m, R.load()), X.functions(m))


@query(
    "source_matches", "fromNodeId toNodeId",
    ("outbound:HTTP:DELETE:/v1/items/{METHOD:find()}", "inbound:HTTP:DELETE:/v1/items/{id}"),
    ("outbound:HTTP:DELETE:/v1/items/{sku}", "inbound:HTTP:DELETE:/v1/items/{id}"),
)
def source_matches(spark):
    return G.endpoint_matches(E.distinct(points(spark)))


@query("parse_errors", "projectFilePath failed", *[(p, p == D.BROKEN) for p in D.SOURCES])
def parse_errors(spark):
    return facts(spark).select("projectFilePath", F.col("error").isNotNull().alias("failed"))


@query("source_summary", "part n", ("packages", 4), ("units", 5), ("functions", 17), ("endpoints", 12), ("edges", 41))
def source_summary(spark):
    g = graph(spark)
    return G.graph_summary(g).select("part", F.col("n").cast("int").alias("n"))


@query("source_placeholders", "id name signature", ("lib.inner.Log.write(java.lang.String)", "write", "write(java.lang.String)"))
def source_placeholders(spark):
    """A call into a listed library becomes an edge to a placeholder."""
    text = "package a; import lib.inner.Log; class U { void go(Log l) { l.write(\"x\"); l.flush(); } }"
    rows = spark.createDataFrame([("a/U.java", None, None, text)], "projectFilePath string, gitRepoUrl string, gitBranch string, content string")
    symbols = spark.createDataFrame(D.SYMBOLS, "owner string, name string, params array<string>, returnType string")
    g = X.build(A.parse_sources(rows), [], symbols, whitelist=("lib.inner.",))
    return M.add_placeholders(g["functions"], g["edges"]).where("isPlaceholder").select("id", "name", "signature")


# --- configuration -------------------------------------------------------------------------------


@query(
    "config_entries", "key value profile priority",
    ("stock.url", "http://stock:8/v0", "default", 1), ("stock.prefix", "/v1", "default", 1), ("stock.hosts[0]", "a", "default", 1), ("stock.hosts[1].name", "b", "default", 1),
    ("stock.on", "true", "default", 1), ("stock.none", "null", "default", 1), ("stock.prefix", "/v1", "prod", 10), ("stock.url", "${scheme:https}://prod", "prod", 10), ("stock.key", "x", "prod", 10), ("port", "80", "default", 1),
)
def config_entries(spark):
    return config(spark).select("key", "value", "profile", "priority")


@query(
    "config_values", "projectRoot key values",
    ("shop", "stock.url", "${scheme:https}://prod|http://stock:8/v0"), ("shop", "stock.prefix", "/v1"), ("shop", "stock.hosts[0]", "a"), ("shop", "stock.hosts[1].name", "b"),
    ("shop", "stock.on", "true"), ("shop", "stock.none", "null"), ("shop", "stock.key", "x"), ("shop", "port", "80"),
)
def config_values(spark):
    d = C.dictionary(config(spark))
    return d.select("projectRoot", F.explode("config").alias("key", "v")).select("projectRoot", "key", F.array_join("v", "|").alias("values"))


@query("config_sizes", "projectRoot keys", ("shop", 8))
def config_sizes(spark):
    return C.sizes(config(spark)).select("projectRoot", F.col("keys").cast("int").alias("keys"))


@query(
    "config_expand", "text value",
    ("${h}:${p:80}", "x:80"), ("${h}:${p:80}", "y:80"), ("${missing}", "${missing}"), ("${a}", "x!"), ("${a}", "y!"), ("plain", "plain"), ("${u:}", ""),
)
def config_expand(spark):
    known = {"h": ["x", "y"], "a": ["${h}!"]}
    texts = spark.createDataFrame([("${h}:${p:80}",), ("${missing}",), ("${a}",), ("plain",), ("${u:}",)], "text string")

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(t, v) for t in b.text for v in C.expand(t, known)], columns=["text", "value"])

    return texts.mapInPandas(run, "text string, value string")


# --- rules ---------------------------------------------------------------------------------------


@query("rules_loaded", "name priority enabled", ("Spring MVC Inbound", 100, True), ("Vert.x Router", 95, True), ("RestTemplate Outbound", 80, True), ("Router with Base Path", 95, False))
def rules_loaded(spark):
    return spark.createDataFrame([(r["name"], r["priority"], r["enabled"]) for r in R.all_rules()], "name string, priority int, enabled boolean")


@query(
    "scope_filter", "package file mvc",
    ("a.controller", "A.java", True), ("controller", "A.java", False), ("a.controller.b", "A.java", True), ("a.web", "A.java", True), ("a.service", "A.java", False), ("a.controller", "ATest.java", False),
)
def scope_filter(spark):
    rows = [("a.controller", "A.java"), ("controller", "A.java"), ("a.controller.b", "A.java"), ("a.web", "A.java"), ("a.service", "A.java"), ("a.controller", "ATest.java")]
    scope = {"packageIncludes": ["**.controller", "**.controller.**", "**.web"], "packageExcludes": ["**/src/test/**"], "fileNamePatterns": ["A.java"]}
    return spark.createDataFrame(rows, "package string, file string").withColumn("mvc", S.scope_matches("package", "file", scope))


@query(
    "path_expressions", "path value",
    ("argument[0]", "http://stock:9/v1/items/+find(sku)"), ("argument[1]", "HttpMethod.DELETE"), ("argument[2]", "null"), ("argument[3]", None), ("methodName", "exchange"), ("class.annotation[@Missing].attribute[value]", None),
)
def path_expressions(spark):
    t = typed(spark)
    site = E.sites(t, X.methods(t), "MethodInvocation").where("c.name = 'exchange'")
    paths = ["argument[0]", "argument[1]", "argument[2]", "argument[3]", "methodName", "class.annotation[@Missing].attribute[value]"]
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.replace(E.path_value(p, "MethodInvocation"), F.lit('"'), F.lit("")).alias("value")) for p in paths])
    return site.select(F.inline(rows))


@query(
    "annotation_paths", "id name value path base",
    (f"{WEB}.reserve({T})", "PutMapping", "{sku}", None, "v1/items"), (f"{WEB}.release({T})", "DeleteMapping", None, "/{id}", "v1/items"), (f"{WEB}.all(java.util.Map)", "GetMapping", None, None, "v1/items"),
)
def annotation_paths(spark):
    t = typed(spark)
    site = E.sites(t, X.methods(t), "MethodDeclaration").where(F.col("package") == "org.acme.stock.web")
    v = lambda p: E.path_value(p, "MethodDeclaration")
    return site.select(F.col("functionId").alias("id"), v("method.annotation[.*Mapping$].name").alias("name"), v("method.annotation[.*Mapping$].attribute[value]").alias("value"), v("method.annotation[.*Mapping$].attribute[path]").alias("path"), v("class.annotation[@RequestMapping].attribute[value]").alias("base"))


@query(
    "default_build", "type endpointType direction isExternal",
    ("http-inbound", "HTTP", "inbound", False), ("HTTP-Outbound", "HTTP", "outbound", True), ("kafka-producer", "MQ", "outbound", True), ("kafka-consumer", "MQ", "inbound", False), ("redis-access", "REDIS", "outbound", True), ("db-access", "DB", "outbound", True), ("ftp", None, None, None),
)
def default_build(spark):
    rows = []
    for kind in ("http-inbound", "HTTP-Outbound", "kafka-producer", "kafka-consumer", "redis-access", "db-access", "ftp"):
        b = R.build_of({"type": kind}) or {}
        rows.append((kind, b.get("endpointType"), b.get("direction"), b.get("isExternal")))
    return spark.createDataFrame(rows, "type string, endpointType string, direction string, isExternal boolean")


MESSAGES = """package a.b; class Q { private Kafka kafka; private Redis redis; private Jdbc jdbc; static final String T = "orders";
 void go(String id) { kafka.send(T + "-" + id, id); redis.opsGet("user:" + id); jdbc.query("select 1", "items"); kafka.send(); } }"""


@query(
    "build_endpoints", "id endpointType topic keyPattern tableName operation command dbOperation matchIdentity",
    ("outbound:MQ:orders-{id}", "MQ", "orders-{id}", None, None, "PRODUCE", None, None, "MQ:orders-{id}"),
    ("outbound:REDIS:user:{id}", "REDIS", None, "user:{id}", None, None, "opsGet", None, "REDIS:user:{id}"),
    ("outbound:DB:items", "DB", None, None, "items", None, None, "READ", "DB:items"),
)
def build_endpoints(spark):
    """Messages, keys and tables by rules of one's own; a call without the argument builds nothing."""
    where = lambda receiver, name: {"nodeType": "MethodInvocation", "where": [{"receiver": {"typeMatches": receiver}}, {"methodName": {"in": [name]}}]}
    first = {"from": "argument[0]", "trace": "auto"}
    rules = [
        {"name": "m", "priority": 1, "type": "kafka-producer", "scope": None, "locate": where(".*Kafka", "send"), "extract": {"topic": first}},
        {"name": "r", "priority": 1, "type": "redis-access", "scope": None, "locate": where(".*Redis", "opsGet"), "extract": {"keyPattern": first, "command": {"from": "methodName"}}},
        {"name": "d", "priority": 1, "type": "db-access", "scope": None, "locate": where(".*Jdbc", "query"), "extract": {"tableName": {"from": "argument[1]"}, "operation": {"mapping": {"query": "READ"}}}},
    ]
    rows = spark.createDataFrame([("a/b/Q.java", None, None, MESSAGES)], "projectFilePath string, gitRepoUrl string, gitBranch string, content string")
    t = X.types(A.resolved(A.parse_sources(rows, rules=rules)))
    return E.extract(t, X.methods(t), rules).select("id", "endpointType", "topic", "keyPattern", "tableName", "operation", "command", "dbOperation", "matchIdentity")


# --- tracer --------------------------------------------------------------------------------------

TRACED = """package a; class V extends W {
  @Value("${k.a}") private String a; private String b = "b" + 1; private String c; private String d; private static final String SELF = SELF2; static String SELF2 = SELF;
  V(@Value("${k.c:dc}") String cc, String dd) { this.c = cc; d = dd; }
  void go(String p, @Value("${k.q:9}") String q) {
    String x = "one"; x(x); String y = x + "/" + x;
    if (true) { String z = y; }
    t.f(a); t.f(b); t.f(c); t.f(d); t.f(p); t.f(q); t.f(x); t.f(y); t.f(z); t.f(("(" + p) + g(p)); t.f(this.b); t.f(this.c); t.f(A.B); t.f(p == null ? x : y); t.f('c'); t.f(7); t.f(SELF); t.f(true); t.f(late);
    String late = "l";
  }
}
"""


@query(
    "tracer_golden", "argument values level",
    ("a", "A1|A2", "FULL"), ("b", "b1", "FULL"), ("c", "dc", "FULL"), ("d", "{d}", "PARTIAL"), ("p", "{p}", "PARTIAL"), ("q", "9", "FULL"), ("x", "one", "FULL"), ("y", "one/one", "FULL"), ("z", "one/one", "FULL"),
    ('("("+p)+g(p)', "({p}{METHOD:g()}", "UNKNOWN"), ("this.b", "b1", "FULL"), ("this.c", "{FIELD:c}", "PARTIAL"), ("A.B", "{UNKNOWN}", "UNKNOWN"), ("p==null?x:y", "{UNKNOWN}", "UNKNOWN"), ("'c'", "{UNKNOWN}", "UNKNOWN"), ("7", "7", "FULL"),
    ("SELF", "{CIRCULAR}", "UNKNOWN"), ("true", "{UNKNOWN}", "UNKNOWN"), ("late", "{late}", "PARTIAL"),
)
def tracer_golden(spark):
    rows = spark.createDataFrame([("v/src/V.java", None, None, TRACED)], "projectFilePath string, gitRepoUrl string, gitBranch string, content string")
    known = spark.createDataFrame([("v", {"k.a": ["A1", "A2"]})], "projectRoot string, config map<string,array<string>>")
    rules = [{"name": "v", "priority": 1, "type": "db-access", "scope": None, "locate": {"nodeType": "MethodInvocation", "where": [{"methodName": {"in": ["f"]}}]}, "extract": {"tableName": {"from": "argument[0]", "trace": "auto"}}}]
    f = A.parse_sources(rows, known, rules).select(F.explode("types").alias("t")).select(F.explode("t.methods").alias("m")).select(F.explode("m.calls").alias("c")).where("c.name = 'f'")
    return f.select(F.col("c.args")[0].alias("argument"), F.array_join(F.col("c.values")[0], "|").alias("values"), F.col("c.levels")[0].alias("level"))
