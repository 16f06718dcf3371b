"""Queries of graph, mutation, incremental and scalar operators over the relational tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import scalars as S
from ..operators import graph as G
from ..operators import mutate as M
from ..streaming import incremental as I
from . import views as V
from .views import sql, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

FILE = "src/s7.java"


def query(name: str, oracle: str, plain: bool = False):
    """Register a query and its SQL; plain: the SQL stands alone, without the views."""

    def add(f):
        QUERIES[name] = f
        ORACLE[name] = oracle if plain else sql(oracle)
        return f

    return add


def fixed(spark, rows: list[tuple], names: str):
    return spark.createDataFrame(rows, names)


# --- look-ups ------------------------------------------------------------------------------------


@query("nodes_by_file", f"""SELECT id, name, "gitRepoUrl" FROM fn WHERE "projectFilePath" = '{FILE}'""")
def nodes_by_file(spark, d):
    return G.nodes_by_file(V.fn(spark, d), FILE).select("id", "name", "gitRepoUrl")


CALLERS = f"""FROM calls c JOIN fn callee ON c."toNodeId" = callee.id JOIN fn caller ON c."fromNodeId" = caller.id WHERE callee."projectFilePath" = '{FILE}'"""


@query("who_calls_me", f"""SELECT DISTINCT caller."projectFilePath" {CALLERS}""")
def who_calls_me(spark, d):
    return G.who_calls_me(V.calls(spark, d), V.fn(spark, d), FILE)


@query("who_calls_me_meta", f"""SELECT DISTINCT caller."projectFilePath", caller."gitRepoUrl", caller."gitBranch" {CALLERS}""")
def who_calls_me_meta(spark, d):
    return G.who_calls_me_meta(V.calls(spark, d), V.fn(spark, d), FILE)


@query("dependent_files", f"""SELECT DISTINCT caller."projectFilePath" {CALLERS} AND caller."projectFilePath" <> '{FILE}'""")
def dependent_files(spark, d):
    return G.dependent_files(V.calls(spark, d), V.fn(spark, d), FILE)


@query("who_calls_me_all", """SELECT callee."projectFilePath" AS "calleeFile", count(DISTINCT caller."projectFilePath")::BIGINT AS callers
  FROM calls c JOIN fn callee ON c."toNodeId" = callee.id JOIN fn caller ON c."fromNodeId" = caller.id GROUP BY 1""")
def who_calls_me_all(spark, d):
    f = V.fn(spark, d)
    return G.callers(V.calls(spark, d), f, f.select("projectFilePath")).groupBy("calleeFile").agg(F.countDistinct("projectFilePath").alias("callers"))


WANTED = """(SELECT 'u' || o_custkey AS id FROM orders UNION SELECT replace(s_name, '#', '.') FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT 'x' || o_orderkey FROM orders)"""


@query("existing_nodes", f"""SELECT id FROM {WANTED} w WHERE id IN (SELECT id FROM units) OR id IN (SELECT "qualifiedName" FROM units)""")
def existing_nodes(spark, d):
    o, s = table(spark, d, "orders"), table(spark, d, "supplier")
    wanted = o.select(F.concat(F.lit("u"), "o_custkey").alias("id")).union(s.where("s_suppkey % 2 = 0").select(F.replace("s_name", F.lit("#"), F.lit(".")))).union(o.select(F.concat(F.lit("x"), "o_orderkey")))
    return G.existing_nodes(V.units(spark, d), wanted)


@query("existing_endpoints", """SELECT DISTINCT 'inbound:HTTP:GET:/api/users/{u' || (o_custkey % 9) || '}/k/' || (o_orderkey % 120) AS id FROM orders WHERE 'inbound:HTTP:GET:/api/users/{u' || (o_custkey % 9) || '}/k/' || (o_orderkey % 120) IN (SELECT id FROM ep)""")
def existing_endpoints(spark, d):
    ids = table(spark, d, "orders").select(F.concat(F.lit("inbound:HTTP:GET:/api/users/{u"), F.col("o_custkey") % 9, F.lit("}/k/"), F.col("o_orderkey") % 120).alias("id"))
    return G.existing_ids(V.ep(spark, d), ids)


PAIRS = """(SELECT DISTINCT 'n' || (o_orderkey % 25) AS "fromNodeId", 'u' || o_custkey AS "toNodeId", 'PACKAGE_TO_UNIT' AS "relationshipType" FROM orders)"""


@query("existing_structure_edges", f"""SELECT p.* FROM {PAIRS} p SEMI JOIN structure s ON p."fromNodeId" = s."fromNodeId" AND p."toNodeId" = s."toNodeId" AND p."relationshipType" = s."relationshipType\"""")
def existing_structure_edges(spark, d):
    pairs = table(spark, d, "orders").select(F.concat(F.lit("n"), F.col("o_orderkey") % 25).alias("fromNodeId"), F.concat(F.lit("u"), "o_custkey").alias("toNodeId"), F.lit("PACKAGE_TO_UNIT").alias("relationshipType"))
    return G.existing_edges(V.structure(spark, d), pairs)


@query("structure_keys", """SELECT "fromNodeId" || ':' || "toNodeId" || ':' || "relationshipType" AS key FROM structure""")
def structure_keys(spark, d):
    return V.structure(spark, d).select(G.structure_key().alias("key"))


@query("endpoints_http", """SELECT id, direction, "projectFilePath", "matchIdentity", "httpMethod", path, "normalizedPath", "endpointType" FROM ep WHERE "endpointType" = 'HTTP'""")
def endpoints_http(spark, d):
    return G.endpoints_of(V.ep(spark, d), "HTTP")


IDENTITY = "GET /api/users/{param}/k/42"


@query("endpoints_by_identity", f"""SELECT id, direction, path FROM ep WHERE "matchIdentity" = '{IDENTITY}' AND direction = 'inbound'""")
def endpoints_by_identity(spark, d):
    return G.by_identity(V.ep(spark, d), IDENTITY, "inbound").select("id", "direction", "path")


@query("endpoints_by_identity_any", f"""SELECT id, direction, path FROM ep WHERE "matchIdentity" = '{IDENTITY}'""")
def endpoints_by_identity_any(spark, d):
    return G.by_identity(V.ep(spark, d), IDENTITY).select("id", "direction", "path")


@query("edges_by_type", """SELECT "fromNodeId", "toNodeId" FROM edges WHERE "relationshipType" IN ('PACKAGE_TO_UNIT', 'UNIT_TO_FUNCTION')""")
def edges_by_type(spark, d):
    return G.edges_of(V.edges(spark, d), *schema.STRUCTURE).select("fromNodeId", "toNodeId")


@query("edge_type_counts", """SELECT "relationshipType", count(*)::BIGINT AS n FROM edges GROUP BY 1""")
def edge_type_counts(spark, d):
    return G.edge_type_counts(V.edges(spark, d))


@query("edges_union", """SELECT * FROM calls UNION ALL SELECT * FROM structure""")
def edges_union(spark, d):
    return V.calls(spark, d).unionByName(V.structure(spark, d))


@query("endpoint_dedupe", """SELECT id, event_id, "projectFilePath" FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) AS n FROM ep_all) WHERE n = 1""")
def endpoint_dedupe(spark, d):
    return G.first_by(V.ep_all(spark, d), ["id"], ["event_id"]).select("id", "event_id", "projectFilePath")


@query("endpoint_matches", """SELECT DISTINCT o.id AS "fromNodeId", i.id AS "toNodeId" FROM ep o JOIN ep i ON o."matchIdentity" = i."matchIdentity" WHERE o.direction = 'outbound' AND i.direction = 'inbound'""")
def endpoint_matches(spark, d):
    return G.endpoint_matches(V.ep(spark, d))


@query("edge_referential_insert", """SELECT "fromNodeId", "toNodeId", "relationshipType", "lineNumber" FROM calls WHERE "fromNodeId" IN (SELECT id FROM fn) AND "toNodeId" IN (SELECT id FROM fn)
  UNION ALL SELECT * FROM structure WHERE "relationshipType" = 'PACKAGE_TO_UNIT' AND "fromNodeId" IN (SELECT id FROM packages) AND "toNodeId" IN (SELECT id FROM units)
  UNION ALL SELECT * FROM structure WHERE "relationshipType" = 'UNIT_TO_FUNCTION' AND "fromNodeId" IN (SELECT id FROM units) AND "toNodeId" IN (SELECT id FROM fn)""")
def edge_referential_insert(spark, d):
    tables = {"functions": V.fn(spark, d), "units": V.units(spark, d), "packages": V.packages(spark, d), "endpoints": V.ep(spark, d)}
    return G.referential(V.edges(spark, d), tables)


MISSING = """(SELECT "fromNodeId" AS id FROM calls UNION SELECT "toNodeId" FROM calls)"""


@query("placeholders", f"""SELECT id FROM {MISSING} m WHERE id NOT IN (SELECT id FROM fn)""")
def placeholders(spark, d):
    return G.missing_functions(V.calls(spark, d), V.fn(spark, d))


@query("call_ids", f"""SELECT id FROM {MISSING} m""")
def call_ids(spark, d):
    return G.call_ids(V.calls(spark, d))


@query(
    "position_range_join",
    """WITH spans AS (SELECT l_orderkey AS k, l_suppkey AS s, min(l_linenumber) AS "startLine", max(l_linenumber) AS "endLine" FROM lineitem GROUP BY 1, 2), points AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS line FROM lineitem)
    SELECT k, line, s FROM (SELECT p.k, p.line, s.s, row_number() OVER (PARTITION BY p.k, p.line ORDER BY s."startLine", s.s) AS n FROM points p JOIN spans s ON p.k = s.k AND p.line BETWEEN s."startLine" AND s."endLine") WHERE n = 1""",
    plain=True,
)
def position_range_join(spark, d):
    return first_spans(table(spark, d, "lineitem"))


def first_spans(l: DataFrame) -> DataFrame:
    spans = l.groupBy(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s")).agg(F.min("l_linenumber").alias("startLine"), F.max("l_linenumber").alias("endLine"))
    points = l.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line")).distinct()
    return G.position_join(points, spans, ["k"], ["startLine", "s"]).select("k", "line", "s")


@query("upsert_split", """SELECT k, CASE WHEN o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS action FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) ON k = o_orderkey""", plain=True)
def upsert_split(spark, d):
    base = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"))
    return G.upsert_split(base, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct(), ["k"])


@query("graph_node_count", """SELECT (SELECT count(*) FROM fn) + (SELECT count(*) FROM units) + (SELECT count(*) FROM packages) + (SELECT count(*) FROM ep) AS n""")
def graph_node_count(spark, d):
    return G.node_count({"functions": V.fn(spark, d), "units": V.units(spark, d), "packages": V.packages(spark, d), "endpoints": V.ep(spark, d)})


@query("graph_summary", """SELECT 'packages' AS part, count(*) AS n FROM packages UNION ALL SELECT 'units', count(*) FROM units UNION ALL SELECT 'functions', count(*) FROM fn UNION ALL SELECT 'endpoints', count(*) FROM ep UNION ALL SELECT 'edges', count(*) FROM edges""")
def graph_summary(spark, d):
    return G.graph_summary({"packages": V.packages(spark, d), "units": V.units(spark, d), "functions": V.fn(spark, d), "endpoints": V.ep(spark, d), "edges": V.edges(spark, d)})


# --- mutations -----------------------------------------------------------------------------------


@query("node_upsert", """SELECT id, name FROM fn WHERE id NOT IN (SELECT 'f' || s_suppkey || '/1' FROM supplier) UNION ALL SELECT 'f' || s_suppkey || '/1', 'new' || s_suppkey FROM supplier""")
def node_upsert(spark, d):
    new = table(spark, d, "supplier").select(F.concat(F.lit("f"), "s_suppkey", F.lit("/1")).alias("id"), F.concat(F.lit("new"), "s_suppkey").alias("name"))
    return M.upsert(V.fn(spark, d).select("id", "name"), new)


@query("node_update", """SELECT f.id, CASE WHEN s.s_suppkey IS NULL THEN f.name ELSE 'new' || s.s_suppkey END AS name FROM fn f LEFT JOIN supplier s ON f.id = 'f' || s.s_suppkey || '/1'""")
def node_update(spark, d):
    new = table(spark, d, "supplier").select(F.concat(F.lit("f"), "s_suppkey", F.lit("/1")).alias("id"), F.concat(F.lit("new"), "s_suppkey").alias("name"))
    return M.update(V.fn(spark, d).select("id", "name"), new)


@query("endpoint_insert_new", """SELECT id, direction FROM ep WHERE event_id % 3 = 0 UNION ALL SELECT id, direction FROM ep WHERE id NOT IN (SELECT id FROM ep WHERE event_id % 3 = 0)""")
def endpoint_insert_new(spark, d):
    e = V.ep(spark, d)
    base = e.where("event_id % 3 = 0").select("id", "direction")
    return M.insert_missing(base, V.ep_all(spark, d).select("id", "direction"), ["id"])


@query("structure_insert_new", """SELECT "fromNodeId", "toNodeId", "relationshipType" FROM structure""")
def structure_insert_new(spark, d):
    s = V.structure(spark, d).select(*G.EDGE_KEY)
    return M.insert_structure(s.where("relationshipType = 'PACKAGE_TO_UNIT'"), s.union(s))


@query("placeholder_rows", f"""SELECT id, id AS "qualifiedName", id AS name, NULL::VARCHAR AS signature, 'java' AS language, true AS "isPlaceholder" FROM {MISSING} m WHERE id NOT IN (SELECT id FROM fn)""")
def placeholder_rows(spark, d):
    rows = G.placeholder_rows(G.missing_functions(V.calls(spark, d), V.fn(spark, d)))
    return rows.select("id", "qualifiedName", "name", "signature", "language", "isPlaceholder")


GONE = f"""(SELECT id FROM fn WHERE "projectFilePath" = '{FILE}' UNION SELECT id FROM units WHERE "projectFilePath" = '{FILE}' UNION SELECT id FROM ep WHERE "projectFilePath" = '{FILE}')"""


def _tables(spark, d):
    return {"packages": V.packages(spark, d), "units": V.units(spark, d), "functions": V.fn(spark, d), "endpoints": V.ep(spark, d), "edges": V.edges(spark, d)}


def _left(tables):
    """What is left: ids of nodes and ends of edges, as rows."""
    out = tables["edges"].select(F.lit("edges").alias("part"), G.structure_key().alias("id"))
    for k in ("packages", "units", "functions", "endpoints"):
        out = out.unionByName(tables[k].select(F.lit(k).alias("part"), "id"))
    return out


LEFT = """SELECT 'edges' AS part, "fromNodeId" || ':' || "toNodeId" || ':' || "relationshipType" AS id FROM edges WHERE "fromNodeId" NOT IN (SELECT id FROM {0}) AND "toNodeId" NOT IN (SELECT id FROM {0})
  UNION ALL SELECT 'packages', id FROM packages WHERE id NOT IN (SELECT id FROM {0}) UNION ALL SELECT 'units', id FROM units WHERE id NOT IN (SELECT id FROM {0})
  UNION ALL SELECT 'functions', id FROM fn WHERE id NOT IN (SELECT id FROM {0}) UNION ALL SELECT 'endpoints', id FROM ep WHERE id NOT IN (SELECT id FROM {0})"""
SOME = """(SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey < 5 UNION SELECT 'u' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)"""


@query("detach_delete", LEFT.format(SOME))
def detach_delete(spark, d):
    ids = table(spark, d, "nation").where("n_nationkey < 5").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    ids = ids.union(table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.concat(F.lit("u"), "s_suppkey")))
    return _left(M.detach(_tables(spark, d), ids))


def _files(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "projectFilePath string")


@query("delete_file", LEFT.format(GONE))
def delete_file(spark, d):
    return _left(M.delete_files(_tables(spark, d), _files(spark, FILE)))


@query("delete_outgoing_calls", f"""SELECT * FROM edges WHERE "relationshipType" <> 'CALLS' OR "fromNodeId" NOT IN (SELECT id FROM fn WHERE "projectFilePath" = '{FILE}')""")
def delete_outgoing_calls(spark, d):
    return M.delete_outgoing(V.edges(spark, d), V.fn(spark, d), _files(spark, FILE))


# --- incremental ---------------------------------------------------------------------------------

KINDS = """CASE event_type WHEN 'signup' THEN 'SOURCE_ADDED' WHEN 'purchase' THEN 'SOURCE_MODIFIED' WHEN 'error' THEN 'SOURCE_DELETED' ELSE 'CASCADE_UPDATE' END"""
CHANGES = f"""(SELECT event_id AS "eventId", 'src/s' || (user_id % 200) || '.java' AS file, {KINDS} AS "changeType", ts AS "timestamp" FROM events)"""


def changes(spark, d):
    """A change log from events."""
    e = table(spark, d, "events")
    kinds = {"signup": "SOURCE_ADDED", "purchase": "SOURCE_MODIFIED", "error": "SOURCE_DELETED"}
    kind = F.coalesce(S.mapping_lookup("event_type", kinds), F.lit("CASCADE_UPDATE"))
    file = F.concat(F.lit("src/s"), F.col("user_id") % 200, F.lit(".java"))
    added, removed = kind != "SOURCE_DELETED", kind != "SOURCE_ADDED"
    return e.select(
        F.col("event_id").alias("eventId"),
        F.when(removed, file).alias("oldFileIdentifier"),
        F.when(added, file).alias("newProjectFilePath"),
        kind.alias("changeType"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit("main").alias("gitBranch"),
        F.lit("repo").alias("gitRepoUrl"),
    )


LATEST = f"""(SELECT file, "changeType", "eventId" FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY "timestamp" DESC, "eventId" DESC) AS n FROM {CHANGES} c) WHERE n = 1)"""


@query("latest_change_per_file", f"""SELECT file AS "projectFilePath", "changeType", "eventId" FROM {LATEST} x""")
def latest_change_per_file(spark, d):
    return I.latest(changes(spark, d)).select("projectFilePath", "changeType", "eventId")


@query("change_dispatch", f"""SELECT "changeType", CASE "changeType" WHEN 'SOURCE_ADDED' THEN 'add' WHEN 'SOURCE_MODIFIED' THEN 'modify' WHEN 'SOURCE_DELETED' THEN 'delete' ELSE 'cascade' END AS action, count(*)::BIGINT AS n FROM {CHANGES} c GROUP BY 1, 2""")
def change_dispatch(spark, d):
    return I.dispatch(changes(spark, d)).groupBy("changeType", "action").agg(F.count("*").alias("n"))


CHANGED = f"""(SELECT file FROM {LATEST} y WHERE "changeType" IN ('SOURCE_MODIFIED', 'SOURCE_DELETED'))"""


@query(
    "cascade_events",
    f"""SELECT DISTINCT caller."projectFilePath" AS "oldFileIdentifier", caller."gitRepoUrl", caller."gitBranch", 'CASCADE_UPDATE' AS "changeType"
  FROM calls c JOIN fn callee ON c."toNodeId" = callee.id JOIN fn caller ON c."fromNodeId" = caller.id
  WHERE callee."projectFilePath" IN (SELECT file FROM {CHANGED} z) AND caller."projectFilePath" NOT IN (SELECT file FROM {CHANGED} z)""",
)
def cascade_events(spark, d):
    out = I.cascade_events(changes(spark, d), V.calls(spark, d), V.fn(spark, d))
    return out.select("oldFileIdentifier", "gitRepoUrl", "gitBranch", "changeType")


@query("incremental_delete", f"""WITH RECURSIVE dummy AS (SELECT 1), x AS ({V.SQL["fn"]}), c AS ({V.SQL["calls"]}),
  kept AS (SELECT * FROM c WHERE "fromNodeId" NOT IN (SELECT id FROM x WHERE "projectFilePath" = '{FILE}'))
  SELECT id, false AS "isPlaceholder" FROM x WHERE "projectFilePath" <> '{FILE}'
  UNION ALL SELECT id, true FROM (SELECT DISTINCT "toNodeId" AS id FROM kept) WHERE id IN (SELECT id FROM x WHERE "projectFilePath" = '{FILE}')""", plain=True)
def incremental_delete(spark, d):
    """Functions after a file is deleted: those that others call stay as placeholders."""
    t = I.delete_keeping_callers({"functions": V.fn(spark, d).withColumn("isPlaceholder", F.lit(False)).select("id", "projectFilePath", "isPlaceholder"), "edges": V.calls(spark, d), "units": V.units(spark, d), "endpoints": V.ep(spark, d), "packages": V.packages(spark, d)}, _files(spark, FILE))
    return t["functions"].select("id", "isPlaceholder")


@query("incremental_modify", f"""SELECT "fromNodeId", "toNodeId", "lineNumber" FROM calls WHERE "fromNodeId" NOT IN (SELECT id FROM fn WHERE "projectFilePath" = '{FILE}')
  UNION ALL SELECT id, id, 1 FROM fn WHERE "projectFilePath" = '{FILE}'""")
def incremental_modify(spark, d):
    """Calls after a file is replaced by one whose functions each call themselves: incoming calls stay."""
    f, c = V.fn(spark, d), V.calls(spark, d)
    new = G.nodes_by_file(f, FILE).select(F.col("id").alias("fromNodeId"), F.col("id").alias("toNodeId"), F.lit("CALLS").alias("relationshipType"), F.lit(1).alias("lineNumber"))
    return I.replace_calls(c, f, new, _files(spark, FILE)).select("fromNodeId", "toNodeId", "lineNumber")


@query("incremental_cascade", f"""SELECT "fromNodeId", "toNodeId", "lineNumber" FROM calls WHERE "fromNodeId" NOT IN (SELECT f.id FROM fn f WHERE f."projectFilePath" IN (SELECT DISTINCT caller."projectFilePath" {CALLERS} AND caller."projectFilePath" <> '{FILE}'))
  UNION ALL SELECT DISTINCT "fromNodeId", "toNodeId", "lineNumber" + 100 FROM calls WHERE "fromNodeId" IN (SELECT f.id FROM fn f WHERE f."projectFilePath" IN (SELECT DISTINCT caller."projectFilePath" {CALLERS} AND caller."projectFilePath" <> '{FILE}'))""")
def incremental_cascade(spark, d):
    """Calls after the files that depend on one were read again and found their calls a hundred lines below."""
    f, c = V.fn(spark, d), V.calls(spark, d)
    files = G.dependent_files(c, f, FILE)
    again = c.join(f.join(files, "projectFilePath", "left_semi").select(F.col("id").alias("fromNodeId")), "fromNodeId", "left_semi").withColumn("lineNumber", F.col("lineNumber") + 100).distinct()
    return I.replace_calls(c, f, again.select(*c.columns), files).select("fromNodeId", "toNodeId", "lineNumber")


# --- scalars -------------------------------------------------------------------------------------


@query("package_path", """SELECT id, replace("qualifiedName", '.', '/') AS path FROM packages""")
def package_path(spark, d):
    return V.packages(spark, d).select("id", S.package_path("qualifiedName").alias("path"))


PATHS = """(SELECT id, "projectFilePath" AS p FROM units UNION ALL SELECT id, replace("projectFilePath", '/', chr(92)) FROM units UNION ALL SELECT id, id FROM units)"""


def paths(spark, d):
    u = V.units(spark, d)
    return u.select("id", F.col("projectFilePath").alias("p")).union(u.select("id", F.replace("projectFilePath", F.lit("/"), F.lit("\\")))).union(u.select("id", "id"))


@query("dirname", f"""SELECT id, p, CASE WHEN contains(replace(p, chr(92), '/'), '/') THEN regexp_replace(replace(p, chr(92), '/'), '/[^/]*$', '') ELSE '' END AS dir FROM {PATHS} x""")
def dirname(spark, d):
    return paths(spark, d).select("id", "p", S.dirname("p").alias("dir"))


@query("basename", f"""SELECT id, p, list_last(string_split(replace(p, chr(92), '/'), '/')) AS base FROM {PATHS} x""")
def basename(spark, d):
    return paths(spark, d).select("id", "p", S.basename("p").alias("base"))


@query("qualified_name", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_type || '()' ELSE p_brand || '.' || p_type || '(' || CASE WHEN p_size % 2 = 0 THEN 'int,' || p_name ELSE p_name END || ')' END AS name FROM part""", plain=True)
def qualified_name(spark, d):
    p = table(spark, d, "part")
    params = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("int"), "p_name")).otherwise(F.array("p_name"))
    return p.select("p_partkey", S.qualified_name(F.when(F.col("p_size") % 5 != 0, F.col("p_brand")), "p_type", params).alias("name"))


@query("simple_signature", """SELECT p_partkey, p_type || '(List,' || p_type || '[])' AS signature FROM part""", plain=True)
def simple_signature(spark, d):
    params = F.array(F.concat(F.lit("java.util.List<java.lang."), "p_brand", F.lit(">")), F.concat(F.lit("a.b."), "p_type", F.lit("[]")))
    return table(spark, d, "part").select("p_partkey", S.simple_signature("p_type", params).alias("signature"))


@query("erased_type", """SELECT p_partkey, 'a.' || p_type || CASE WHEN p_size % 3 > 0 THEN '[]' ELSE '' END AS erased FROM part""", plain=True)
def erased_type(spark, d):
    t = F.concat(F.lit("a."), "p_type", F.when(F.col("p_size") % 2 == 0, "<x.Y<Z>>").otherwise(""), F.when(F.col("p_size") % 3 == 2, "[][]").when(F.col("p_size") % 3 == 1, "[]").otherwise(""))
    return table(spark, d, "part").select("p_partkey", S.erased_type(t).alias("erased"))


@query("placeholder_names", """SELECT id, CASE k WHEN 0 THEN "gitRepoUrl" WHEN 1 THEN name ELSE name END AS name, CASE k WHEN 0 THEN "gitRepoUrl" || '(x.Y,int)' END AS signature
  FROM (SELECT *, length(id) % 3 AS k FROM fn)""")
def placeholder_names(spark, d):
    k = F.length("id") % 3
    q = F.when(k == 0, F.concat(F.lit("a.b."), "name", F.lit("."), "gitRepoUrl", F.lit("(x.Y,int)"))).when(k == 1, F.col("name")).otherwise(F.concat(F.lit("a.b."), "name"))
    return V.fn(spark, d).select("id", S.placeholder_name(q).alias("name"), S.placeholder_signature(q).alias("signature"))


@query("normalize_params", r"""SELECT event_id, regexp_replace(path, '\{[^}]+\}', '{param}', 'g') AS path FROM ep_all""")
def normalize_params(spark, d):
    return V.ep_all(spark, d).select("event_id", S.normalize_params("path").alias("path"))


@query("normalize_slashes", """SELECT page_id, '/' || regexp_replace(url, '/+', '/', 'g') AS path FROM pages UNION ALL SELECT page_id, '' FROM pages UNION ALL SELECT -page_id - 1, '/' || page_id || '/x' FROM pages""", plain=True)
def normalize_slashes(spark, d):
    p = table(spark, d, "pages")
    rows = p.select("page_id", "url").union(p.select("page_id", F.lit(""))).union(p.select(-F.col("page_id") - 1, F.concat(F.lit("//"), "page_id", F.lit("///x"))))
    return rows.select("page_id", S.normalize_slashes("url").alias("path"))


URLS = """(SELECT page_id, 0 AS kind, url AS u FROM pages UNION ALL SELECT page_id, 1, regexp_extract(url, '^https?://[^/]+') FROM pages UNION ALL SELECT page_id, 2, '${svc' || page_id || '.url}/a' FROM pages
  UNION ALL SELECT page_id, 3, '{id' || page_id || '}/a' FROM pages UNION ALL SELECT page_id, 4, '{baseHost}a' || page_id FROM pages UNION ALL SELECT page_id, 5, 'a/' || page_id FROM pages)"""


def urls(spark, d):
    p = table(spark, d, "pages")
    kinds = ["url", F.regexp_extract("url", "^https?://[^/]+", 0), F.concat(F.lit("${svc"), "page_id", F.lit(".url}/a")), F.concat(F.lit("{id"), "page_id", F.lit("}/a")), F.concat(F.lit("{baseHost}a"), "page_id"), F.concat(F.lit("a/"), "page_id")]
    out = None
    for i, k in enumerate(kinds):
        part = p.select("page_id", F.lit(i).alias("kind"), S.col(k).alias("u"))
        out = part if out is None else out.unionByName(part)
    return out


@query("extract_path", f"""SELECT page_id, kind, CASE kind WHEN 0 THEN regexp_extract(u, '^https?://[^/]+(/.*)$', 1) WHEN 2 THEN '/a' ELSE u END AS path FROM {URLS} x""", plain=True)
def extract_path(spark, d):
    return urls(spark, d).select("page_id", "kind", S.extract_path("u").alias("path"))


@query("url_path", f"""SELECT page_id, kind, CASE WHEN kind < 2 THEN regexp_extract(u, '^https?://[^/]+(.*)$', 1) ELSE u END AS path FROM {URLS} x""", plain=True)
def url_path(spark, d):
    return urls(spark, d).select("page_id", "kind", S.url_path("u").alias("path"))


@query("likely_base_url", f"""SELECT page_id, kind, regexp_matches(lower(u), 'url|base|host|domain|endpoint|server') AS base FROM {URLS} x""", plain=True)
def likely_base_url(spark, d):
    return urls(spark, d).select("page_id", "kind", S.likely_base_url("u").alias("base"))


@query("segment_normalize", r"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN regexp_replace(path, '\{[^}]+\}', '{param}', 'g') || CASE WHEN event_id % 2 = 0 THEN '' ELSE '{param}' END
  ELSE CASE WHEN event_id % 2 = 0 THEN '' ELSE '{param}' END || regexp_replace(path, '\{[^}]+\}', '{param}', 'g') || '{param}' END AS path FROM ep_all""")
def segment_normalize(spark, d):
    seg = lambda v, lit: F.struct(v.alias("value"), F.lit(lit).alias("literal"))
    var = F.when(F.col("event_id") % 2 == 0, "baseUrl").otherwise("item")
    first = F.col("event_id") % 3 == 0
    parts = F.when(first, F.array(seg(F.col("path"), True), seg(var, False))).otherwise(F.array(seg(var, False), seg(F.concat(F.lit("http://h"), "path"), True), seg(F.lit("serverId"), False)))
    return V.ep_all(spark, d).select("event_id", S.segment_normalize(parts).alias("path"))


@query("normalize_arbitrate", r"""SELECT event_id, CASE WHEN direction = 'outbound' AND k = 2 THEN '/s/' || event_id ELSE own END AS path FROM (SELECT *, event_id % 4 AS k, regexp_replace(path, '\{[^}]+\}', '{param}', 'g') AS own FROM ep_all)""")
def normalize_arbitrate(spark, d):
    k = F.col("event_id") % 4
    seg = F.when(k == 0, S.PARAM).when(k == 1, "{param}/k").when(k == 2, F.concat(F.lit("/s/"), "event_id")).otherwise(F.regexp_extract("path", "/k/.*$", 0))
    return V.ep_all(spark, d).select("event_id", S.normalize_arbitrate("path", seg, "direction").alias("path"))


@query("transforms", """SELECT page_id, upper(url) AS upper, lower(url) AS lower, regexp_extract(url, '^https?://[^/]+(/.*)$', 1) AS path, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', 'N', 'g') AS replaced, url AS same FROM pages""", plain=True)
def transforms(spark, d):
    kinds = {"upper": "toUpperCase", "lower": "toLowerCase", "path": "extractPath", "host": {"type": "extractPath", "regex": "^https?://([^/]+)"}, "replaced": {"type": "regexReplace", "pattern": "[0-9]+", "replacement": "N"}, "same": "unknown"}
    return table(spark, d, "pages").select("page_id", *[S.transform("url", how).alias(name) for name, how in kinds.items()])


@query("pattern_capture", """SELECT page_id, CASE WHEN regexp_matches(url, 'page=([0-9]+)') THEN regexp_extract(url, 'page=([0-9]+)', 1) END AS page, CASE WHEN regexp_matches(url, 'page=([0-9]+)') THEN regexp_extract(url, 'page=([0-9]+)', 0) END AS whole, NULL::VARCHAR AS none FROM pages""", plain=True)
def pattern_capture(spark, d):
    p = "page=([0-9]+)"
    return table(spark, d, "pages").select("page_id", S.pattern_capture("url", p).alias("page"), S.pattern_capture("url", p, 0).alias("whole"), S.pattern_capture("url", p, 2).alias("none"))


@query("mapping_lookup", """SELECT event_id, CASE event_type WHEN 'click' THEN 'GET' WHEN 'view' THEN 'POST' END AS method FROM events""", plain=True)
def mapping_lookup(spark, d):
    return table(spark, d, "events").select("event_id", S.mapping_lookup("event_type", {"click": "GET", "view": "POST"}).alias("method"))


@query("template_resolve", """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN event_type || '-' || user_id || '!' END AS value FROM events""", plain=True)
def template_resolve(spark, d):
    values = {"a": F.col("event_type"), "b": F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string"))}
    return table(spark, d, "events").select("event_id", S.template_resolve("${a}-${b}!", values).alias("value"))


@query("combine_paths", """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '/api/' || event_type ELSE '/' || event_type END AS path FROM events""", plain=True)
def combine_paths(spark, d):
    values = {"basePath": F.when(F.col("user_id") % 2 == 0, "api/"), "methodPath": F.concat(F.lit("/"), "event_type")}
    sources = [{"source": "${basePath}"}, {"source": "${methodPath}"}]
    return table(spark, d, "events").select("event_id", S.combine(sources, values, True).alias("path"))


@query("strategy_coalesce", """SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN 'c' END, CASE WHEN user_id % 2 = 0 THEN 'even' END, 'rest') AS value FROM events""", plain=True)
def strategy_coalesce(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", S.strategy(F.when(F.col("event_type") == "click", "c"), F.when(F.col("user_id") % 2 == 0, "even"), F.lit("rest")).alias("value"))


@query("cartesian_concat", """SELECT event_id, a || b || 'z' AS value FROM events, (VALUES ('x'), ('y')) t(a), (SELECT event_id AS i, unnest([event_type, user_id::VARCHAR]) AS b FROM events) u WHERE u.i = event_id""", plain=True)
def cartesian_concat(spark, d):
    parts = F.array(F.array(F.lit("x"), F.lit("y")), F.array("event_type", F.col("user_id").cast("string")), F.array(F.lit("z")))
    return table(spark, d, "events").select("event_id", F.explode(S.cartesian_concat(parts)).alias("value"))


@query("cartesian_fields", """SELECT event_id, method, path FROM (SELECT event_id, event_type AS method FROM events UNION SELECT event_id, 'click' FROM events), (VALUES ('/a'), ('/b')) t(path)""", plain=True)
def cartesian_fields(spark, d):
    e = table(spark, d, "events").select("event_id", F.array("event_type", F.lit("click")).alias("method"), F.array(F.lit("/a"), F.lit("/b"), F.lit("/a")).alias("path"))
    return e.withColumn("method", F.explode(F.array_distinct("method"))).withColumn("path", F.explode(F.array_distinct("path")))


@query("parse_level", """SELECT k AS l_orderkey, CASE max(r) WHEN 0 THEN 'FULL' WHEN 1 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS level FROM (SELECT l_orderkey AS k, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS r FROM lineitem) GROUP BY k""", plain=True)
def parse_level(spark, d):
    level = F.when(F.col("l_returnflag") == "A", "FULL").when(F.col("l_returnflag") == "N", "PARTIAL").otherwise("UNKNOWN")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(level).alias("levels")).select("l_orderkey", S.worst_level("levels").alias("level"))


TYPE_NAMES = ("http-inbound", "HTTP", "kafka-producer", "RocketMQ", "redis-access", "db", "ftp")


@query("endpoint_type", """SELECT event_id, t AS name, CASE t WHEN 'http-inbound' THEN 'HTTP' WHEN 'HTTP' THEN 'HTTP' WHEN 'kafka-producer' THEN 'MQ' WHEN 'RocketMQ' THEN 'MQ' WHEN 'redis-access' THEN 'REDIS' WHEN 'db' THEN 'DB' END AS type
  FROM (SELECT event_id, ['http-inbound', 'HTTP', 'kafka-producer', 'RocketMQ', 'redis-access', 'db', 'ftp'][(event_id % 7) + 1] AS t FROM events)""", plain=True)
def endpoint_type(spark, d):
    name = F.get(F.array(*[F.lit(t) for t in TYPE_NAMES]), (F.col("event_id") % 7).cast("int"))
    return table(spark, d, "events").select("event_id", name.alias("name"), S.endpoint_type(name).alias("type"))


@query("endpoint_ids", """SELECT event_id, CASE k WHEN 0 THEN 'outbound:HTTP:UNKNOWN:/x' || u WHEN 1 THEN 'outbound:MQ:t' || u WHEN 2 THEN 'outbound:REDIS:r' || u ELSE 'outbound:DB:d' || u END AS id,
  CASE k WHEN 0 THEN 'UNKNOWN /x' || u WHEN 1 THEN 'MQ:t' || u WHEN 2 THEN 'REDIS:r' || u ELSE 'DB:d' || u END AS identity FROM (SELECT event_id, event_id % 4 AS k, user_id AS u FROM events)""", plain=True)
def endpoint_ids(spark, d):
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    own = lambda i, c: F.when(k == i, F.concat(F.lit(c), u))
    rows = table(spark, d, "events").select(
        "event_id", F.lit("outbound").alias("direction"), F.get(F.array(*[F.lit(x) for x in schema.ENDPOINT_KINDS]), k.cast("int")).alias("endpointType"), F.lit(None).cast("string").alias("httpMethod"),
        own(0, "/x").alias("path"), F.lit(None).cast("string").alias("normalizedPath"), own(1, "t").alias("topic"), own(2, "r").alias("keyPattern"), own(3, "d").alias("tableName"), F.lit("f").alias("projectFilePath"), F.lit(1).alias("startLine"),
    )
    return rows.select("event_id", S.endpoint_id().alias("id"), S.match_identity().alias("identity"))


@query("glob_package", r"""SELECT id, regexp_matches("qualifiedName", '^org\.nation\.[0-9]+$') AS one, false AS none, true AS any FROM packages""")
def glob_package(spark, d):
    q = "qualifiedName"
    return V.packages(spark, d).select("id", S.glob_package(q, "org.*.*").alias("one"), S.glob_package(q, "org.*").alias("none"), S.glob_package(q, "**").alias("any"))


@query("glob_filename", """SELECT id, regexp_matches("projectFilePath", '^src/s1.*.java$') AS client FROM units""")
def glob_filename(spark, d):
    return V.units(spark, d).select("id", S.glob_file(S.basename("projectFilePath"), "s1*.java").alias("client"))


NAMES = """(SELECT o_orderkey, ['get', 'set', 'is', 'run', 'getA', 'isB', 'settle', 'issue'][(o_orderkey % 8) + 1] || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'X' END AS name FROM orders)"""


@query("getter_setter_filter", f"""SELECT o_orderkey, name FROM {NAMES} n WHERE NOT ((name LIKE 'get%' AND length(name) > 3) OR (name LIKE 'set%' AND length(name) > 3) OR (name LIKE 'is%' AND length(name) > 2))""", plain=True)
def getter_setter_filter(spark, d):
    names = F.array(*[F.lit(x) for x in ("get", "set", "is", "run", "getA", "isB", "settle", "issue")])
    name = F.concat(F.get(names, (F.col("o_orderkey") % 8).cast("int")), F.when(F.col("o_custkey") % 2 == 0, "").otherwise("X"))
    return table(spark, d, "orders").select("o_orderkey", name.alias("name")).where(S.keeps_call("name"))


@query("package_whitelist", """SELECT p_partkey FROM part WHERE p_size % 5 <> 0 AND (p_size % 2 = 0 OR p_brand LIKE 'Brand#1%')""", plain=True)
def package_whitelist(spark, d):
    owner = F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))
    return table(spark, d, "part").where(S.in_whitelist(owner, F.col("p_size") % 2 == 0, ["Brand#1"])).select("p_partkey")


@query("filter_pipeline", """SELECT p_partkey FROM part WHERE p_size > 10 AND p_type = 'ECONOMY' AND p_brand <> 'Brand#1'""", plain=True)
def filter_pipeline(spark, d):
    return table(spark, d, "part").where(S.all_of([F.col("p_size") > 10, F.col("p_type") == "ECONOMY", F.col("p_brand") != "Brand#1"])).select("p_partkey")


ANNOTATIONS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))]))


@query("annotation_match", """SELECT event_id, event_type IN ('click', 'view') AS matched, event_type = 'click' AS equal, event_type IN ('error', 'signup') AS listed FROM events""", plain=True)
def annotation_match(spark, d):
    names = {"click": "GetMapping", "view": "PostMapping", "error": "Bean", "signup": "Value", "purchase": "MappingX"}
    one = F.struct(S.mapping_lookup("event_type", names).alias("name"), F.create_map(F.lit("value"), F.col("event_type")).alias("attributes"))
    found = F.array(F.struct(F.lit("Override").alias("name"), F.create_map(F.lit("x"), F.lit("y")).alias("attributes")), one)
    conditions = {"matched": {"nameMatches": "@(Get|Post)Mapping"}, "equal": {"nameEquals": "@GetMapping"}, "listed": {"nameIn": ["@Bean", "Value"]}}
    return table(spark, d, "events").select("event_id", *[S.annotation_matches(found, c).alias(k) for k, c in conditions.items()])


@query("receiver_match", """SELECT event_id, user_id % 3 > 0 AND (event_type = 'click' OR event_type = 'view') AS loose, user_id % 3 > 0 AND event_type = 'click' AS strict FROM events""", plain=True)
def receiver_match(spark, d):
    kind = F.when(F.col("event_type") == "click", "a.b.RestTemplate").when(F.col("event_type") != "view", "a.b.RestTemplates")
    has = F.col("user_id") % 3 > 0
    return table(spark, d, "events").select("event_id", S.receiver_matches(has, kind, ".*RestTemplate$").alias("loose"), S.receiver_matches(has, kind, ".*RestTemplate$", True).alias("strict"))


@query("outbound_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""", plain=True)
def outbound_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))
