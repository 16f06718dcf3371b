"""Nodes and edges from resolved facts, and the call targets by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schema
from ..functions import scalars as S
from . import facts as A
from . import mutate as M
from . import resolve as R
from .staging import staged, together


def shaped(rows: DataFrame, table) -> DataFrame:
    """rows as a node table: missing columns are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table])


def packages(facts: DataFrame) -> DataFrame:
    rows = facts.where("package is not null").select(
        F.col("package").alias("id"),
        F.col("package").alias("qualifiedName"),
        F.substring_index("package", ".", -1).alias("name"),
        F.lit("java").alias("language"),
        S.dirname("projectFilePath").alias("projectFilePath"),
        "gitRepoUrl",
        "gitBranch",
        S.package_path("package").alias("packagePath"),
    )
    order = W.partitionBy("id").orderBy(F.desc("projectFilePath"))  # the last file's folder stays
    return shaped(rows.withColumn("n", F.row_number().over(order)).where("n = 1"), schema.PACKAGES)


def types(facts: DataFrame) -> DataFrame:
    """A row a type: its qualified name, the file's map, and what the parser found."""
    return facts.select("projectFilePath", "gitRepoUrl", "gitBranch", "package", "known", F.explode("types").alias("t")).withColumn("unit", F.concat_ws(".", "package", "t.name"))


def units(typed: DataFrame) -> DataFrame:
    rows = typed.select(
        F.col("unit").alias("id"),
        F.col("unit").alias("qualifiedName"),
        F.col("t.name").alias("name"),
        F.lit("java").alias("language"),
        "projectFilePath",
        "gitRepoUrl",
        "gitBranch",
        F.col("t.line").alias("startLine"),
        F.col("t.endLine").alias("endLine"),
        F.col("t.kind").alias("unitType"),
        F.col("t.modifiers").alias("modifiers"),
        F.array_contains("t.modifiers", "abstract").alias("isAbstract"),
        F.coalesce("package", F.lit("")).alias("packageId"),
    )
    return shaped(rows.dropDuplicates(["id"]), schema.UNITS)


def methods(typed: DataFrame) -> DataFrame:
    """A row a method with its id."""
    m = typed.select("projectFilePath", "gitRepoUrl", "gitBranch", "package", "known", "unit", F.col("t.annotations").alias("classAnnotations"), F.posexplode("t.methods").alias("at", "m"))
    params = F.transform("m.erased", lambda p: A.lookup(F.col("known"), p))
    name = F.when(F.col("m.isConstructor"), F.substring_index("unit", ".", -1)).otherwise(F.col("m.name"))
    return m.withColumn("params", params).withColumn("id", S.qualified_name("unit", name, "params"))


def functions(method: DataFrame) -> DataFrame:
    rows = method.select(
        "id",
        F.col("id").alias("qualifiedName"),
        F.col("m.name").alias("name"),
        F.lit("java").alias("language"),
        "projectFilePath",
        "gitRepoUrl",
        "gitBranch",
        F.col("m.line").alias("startLine"),
        F.col("m.endLine").alias("endLine"),
        S.simple_signature("m.name", "m.params").alias("signature"),
        A.lookup(F.col("known"), F.col("m.returnType")).alias("returnType"),
        F.col("m.modifiers").alias("modifiers"),
        F.array_contains("m.modifiers", "static").alias("isStatic"),
        F.lit(False).alias("isAsync"),
        F.col("m.isConstructor").alias("isConstructor"),
        F.lit(False).alias("isPlaceholder"),
    )
    return shaped(rows.dropDuplicates(["id"]), schema.FUNCTIONS)


def files(known: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """schema.FILES rows: the names of types that a file uses: written ones, its own, and those that its calls meet."""
    parts = lambda names: F.flatten(F.transform(names, lambda n: F.split(n, r"[.]")))
    rows = known.select(F.col("projectFilePath").alias("id"), "projectFilePath", "gitRepoUrl", "gitBranch", "package", parts(F.array_union("names", F.col("shapes.name"))).alias("names"), "error")
    if sites is not None:
        simple = lambda t: F.regexp_extract_all(t, F.lit(r"([\w$]+)(?![\w$.])"), F.lit(1))
        met = sites.select("projectFilePath", F.explode(F.concat(F.coalesce(simple(F.col("ownerType")), F.array()), F.coalesce(simple(F.col("returns")), F.array()))).alias("n"))
        met = met.groupBy("projectFilePath").agg(F.collect_set("n").alias("met"))
        rows = rows.join(met, "projectFilePath", "left").withColumn("names", F.concat("names", F.coalesce("met", F.array().cast("array<string>"))))
    return rows.withColumn("names", F.array_sort(F.array_distinct("names"))).select(*schema.FILES.names)


def call_targets(known: DataFrame, method: DataFrame, symbols: DataFrame | None = None, world: R.World | None = None) -> DataFrame:
    """Call sites with the function they reach: (callerId, at, name, line, targetId, owner, fromSource)."""
    return targets(R.resolve_sites(method, staged(R.shapes(known, world), "shapes"), world, symbols))


def targets(sites: DataFrame) -> DataFrame:
    return sites.where("not field and targetId is not null")


def unresolved(sites: DataFrame) -> DataFrame:
    """schema.UNRESOLVED rows: calls without a target, and why: no receiver type, no such member, or several."""
    open_ = sites.where("not field and targetId is null")
    return open_.select(F.col("projectFilePath").alias("id"), "callerId", F.col("at").alias("site"), "name", F.col("line").alias("lineNumber"), "ownerType", "reason")


def calls(found: DataFrame, whitelist=(), filters=()) -> DataFrame:
    """CALLS edges, a row a call site that the filters keep; a site's number makes its id unique.

    whitelist: prefixes of types outside the sources that count as targets too.
    """
    kept = found.where(S.all_of([S.keeps_call("name"), S.in_whitelist("owner", "fromSource", list(whitelist)), *[f(found) for f in filters]]))
    rows = kept.select(F.col("callerId").alias("fromNodeId"), F.col("targetId").alias("toNodeId"), F.lit(schema.CALLS).alias("relationshipType"), F.col("line").alias("lineNumber"), F.lit("direct").alias("callType"), F.lit("java").alias("language"), "at")
    return rows.withColumn("id", S.edge_id("fromNodeId", "toNodeId", "relationshipType", "lineNumber", "at")).select(*schema.EDGES.names)


def structure(units: DataFrame, method: DataFrame) -> DataFrame:
    """PACKAGE_TO_UNIT for units with a package, UNIT_TO_FUNCTION for each function."""
    a = units.where("packageId <> ''").select(F.col("packageId").alias("fromNodeId"), F.col("id").alias("toNodeId"), F.lit("PACKAGE_TO_UNIT").alias("relationshipType"))
    b = method.select(F.col("unit").alias("fromNodeId"), F.col("id").alias("toNodeId"), F.lit("UNIT_TO_FUNCTION").alias("relationshipType"))
    return M.edge_rows(a.unionByName(b).distinct())


def build(facts: DataFrame, rules: list[dict] = (), symbols: DataFrame | None = None, strict: bool = False, endpoints: bool = True, filters=(), whitelist=(), processors=()) -> dict[str, DataFrame]:
    """All five tables from parsed sources; edges may still lead to unknown functions (see mutate.add_placeholders)."""
    known, shapes = front(staged(facts, "facts"), symbols)
    out = tables(known, shapes, None, rules, symbols, strict, endpoints, filters, whitelist, processors)
    return {k: out[k] for k in schema.TABLES}


def front(facts: DataFrame, symbols: DataFrame | None = None, world: R.World | None = None) -> tuple[DataFrame, DataFrame]:
    """facts with their names resolved, and their shapes; world: the types of other files."""
    known = staged(A.resolved(facts, symbols, world), "resolved")
    return known, staged(R.shapes(known, world), "shapes")


def tables(known: DataFrame, shapes: DataFrame, world: R.World | None = None, rules: list[dict] = (), symbols: DataFrame | None = None, strict: bool = False, endpoints: bool = True, filters=(), whitelist=(), processors=()) -> dict[str, DataFrame]:
    """All five tables and the auxiliary ones.

    processors: functions from types (projectFilePath, package, known, t, unit) to more rows by table; run in the order of
    their attribute priority (100 without one), left out if their attribute enabled is false.
    """
    from . import endpoints as E

    typed = types(known)
    method = staged(methods(typed), "methods")
    unit, function = units(typed), functions(method)
    sites, points = together([
        lambda: R.resolve_sites(method, shapes, world, symbols),
        lambda: staged(E.extract(typed, method, list(rules) if endpoints else [], strict), "endpoints"),
    ])
    edges = structure(unit, method).unionByName(calls(targets(sites), whitelist, filters))
    links = E.links(points, function)
    nodes = shaped(E.distinct(points), schema.ENDPOINTS)
    out = {"packages": packages(known), "units": unit, "functions": function, "endpoints": nodes, "edges": edges.unionByName(M.edge_rows(links))}
    for processor in in_order(processors):
        for name, rows in processor(typed).items():
            out[name] = out[name].unionByName(shaped(rows, schema.TABLES[name]))
    return out | {"shapes": shapes, "files": files(known, sites), "unresolved": unresolved(sites)}


def in_order(hooks) -> list:
    """Enabled hooks by ascending priority; equal ones as given."""
    return sorted((h for h in hooks if getattr(h, "enabled", True)), key=lambda h: getattr(h, "priority", 100))
