"""Look-ups and set operators over node and edge tables. All are plans; only `few` runs a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schema
from ..functions import scalars as S
from .staging import in_memory, values


def nodes_by_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("projectFilePath") == path)


def by_identity(endpoints: DataFrame, identity: str, direction: str | None = None) -> DataFrame:
    out = endpoints.where(F.col("matchIdentity") == identity)
    return out.where(F.col("direction") == direction) if direction else out


def edges_of(edges: DataFrame, *types: str) -> DataFrame:
    return edges.where(F.col("relationshipType").isin(*types))


#: Rows of a side that is handed to every task, at most; a larger one is joined by shuffles.
FEW = 100_000


def is_few(side: DataFrame, most: int = FEW) -> bool:
    return side.limit(most + 1).count() <= most


def few(side: DataFrame, most: int = FEW) -> DataFrame:
    """side with a broadcast hint if it was counted and is small enough, so that the large table is only scanned; in a small batch it is bounded already."""
    return F.broadcast(side) if in_memory() or is_few(side, most) else side


#: Literals of a filter, at most; more are a join.
LITERALS = 20_000


def only(rows: DataFrame, key: str, side: DataFrame) -> DataFrame:
    """Rows whose key is in the only column of side: a filter that reaches the scan in a small batch, else a join with a counted side."""
    if in_memory() and len(some := values(side)) <= LITERALS:
        return rows.where(F.col(key).isin(some))
    return rows.join(few(side.toDF(key).distinct()), key, "left_semi").select(*rows.columns)


def without(rows: DataFrame, key: str, side: DataFrame) -> DataFrame:
    """Rows whose key is null or not in the only column of side."""
    if in_memory() and len(some := values(side)) <= LITERALS:
        return rows.where(F.col(key).isNull() | ~F.col(key).isin(some)) if some else rows
    return rows.join(few(side.toDF(key).distinct()), key, "left_anti").select(*rows.columns)


def callers(edges: DataFrame, functions: DataFrame, files: DataFrame | str) -> DataFrame:
    """(calleeFile, projectFilePath, gitRepoUrl, gitBranch), distinct: files with a call into the given file or files (projectFilePath).

    The callee side is cut to the given files first and counted: few callees are handed to every task, so that the
    edges are scanned without a shuffle. Callers without a file (placeholders) are left out.
    """
    if isinstance(files, str):
        callee = functions.where(F.col("projectFilePath") == files)
    else:
        callee = functions.join(files.select("projectFilePath").distinct(), "projectFilePath", "left_semi")
    callee = few(callee.select(F.col("id").alias("toNodeId"), F.col("projectFilePath").alias("calleeFile")).distinct())
    caller = functions.where("projectFilePath is not null").select(F.col("id").alias("fromNodeId"), "projectFilePath", "gitRepoUrl", "gitBranch")
    into = edges_of(edges, schema.CALLS).select("fromNodeId", "toNodeId").join(callee, "toNodeId").select("fromNodeId", "calleeFile").distinct()
    return into.join(caller, "fromNodeId").select("calleeFile", "projectFilePath", "gitRepoUrl", "gitBranch").distinct()


def who_calls_me(edges: DataFrame, functions: DataFrame, path: str) -> DataFrame:
    return callers(edges, functions, path).select("projectFilePath").distinct()


def who_calls_me_meta(edges: DataFrame, functions: DataFrame, path: str) -> DataFrame:
    return callers(edges, functions, path).select("projectFilePath", "gitRepoUrl", "gitBranch").distinct()


def dependent_files(edges: DataFrame, functions: DataFrame, path: str) -> DataFrame:
    return who_calls_me(edges, functions, path).where(F.col("projectFilePath") != path)


def existing_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids (id) that are some node's id or qualifiedName: two equi-joins, since an OR would loop over pairs."""
    wanted = ids.select("id").distinct()
    keys = nodes.select(F.col("id").alias("k")).unionByName(nodes.select(F.col("qualifiedName").alias("k")))
    return wanted.join(keys, wanted["id"] == keys["k"], "left_semi")


def existing_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(nodes, "id", "left_semi")


EDGE_KEY = ["fromNodeId", "toNodeId", "relationshipType"]


def existing_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return pairs.select(*EDGE_KEY).distinct().join(edges, EDGE_KEY, "left_semi")


def structure_key() -> Column:
    return F.concat_ws(":", *EDGE_KEY)


def endpoint_matches(endpoints: DataFrame) -> DataFrame:
    """(fromNodeId, toNodeId): outbound endpoints to inbound ones of the same identity, a pair once."""
    some = endpoints.where((F.col("matchIdentity") != "") & F.col("matchIdentity").isNotNull())
    out = some.where("direction = 'outbound'").select(F.col("id").alias("fromNodeId"), "matchIdentity").distinct()
    into = some.where("direction = 'inbound'").select(F.col("id").alias("toNodeId"), "matchIdentity").distinct()
    return out.join(into, "matchIdentity").select("fromNodeId", "toNodeId").distinct()


def referential(edges: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Edges whose both ends exist under the labels of their type; others are dropped."""
    out = None
    for kind, (a, b) in schema.EDGE_LABELS.items():
        part = edges.where(F.col("relationshipType") == kind)
        part = part.join(tables[a].select(F.col("id").alias("fromNodeId")), "fromNodeId", "left_semi").join(tables[b].select(F.col("id").alias("toNodeId")), "toNodeId", "left_semi")
        out = part if out is None else out.unionByName(part)
    return out.select(*edges.columns)


def call_ids(edges: DataFrame) -> DataFrame:
    """Distinct ids at either end of a call."""
    calls = edges_of(edges, schema.CALLS)
    return calls.select(F.col("fromNodeId").alias("id")).unionByName(calls.select(F.col("toNodeId").alias("id"))).distinct()


def missing_functions(edges: DataFrame, functions: DataFrame) -> DataFrame:
    return call_ids(edges).join(functions.select("id"), "id", "left_anti")


def placeholder_rows(ids: DataFrame, language: str = "java") -> DataFrame:
    """Function rows that stand for unknown ids."""
    known = {
        "id": F.col("id"),
        "qualifiedName": F.col("id"),
        "isPlaceholder": F.lit(True),
        "language": F.lit(language),
        "name": S.placeholder_name("id"),
        "signature": S.placeholder_signature("id"),
    }
    return ids.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.FUNCTIONS])


def position_join(points: DataFrame, spans: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """points (line) with the first span (startLine <= line <= endLine) of the same key, by order; without one, none.

    An equi-join on the key with a range, then the first: only as wide as one file.
    """
    at = W.partitionBy("__point").orderBy(*order)
    numbered = points.withColumn("__point", F.monotonically_increasing_id())
    met = numbered.join(spans, key).where(F.col("line").between(F.col("startLine"), F.col("endLine")))
    return met.withColumn("__n", F.row_number().over(at)).where("__n = 1").drop("__n", "__point")


def first_by(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationshipType").agg(F.count("*").alias("n"))


def graph_summary(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in tables.items():
        part = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def node_count(tables: dict[str, DataFrame]) -> DataFrame:
    return graph_summary({k: t for k, t in tables.items() if k != "edges"}).agg(F.sum("n").alias("n"))


def endpoints_of(endpoints: DataFrame, kind: str) -> DataFrame:
    """A subtype's rows with its own columns."""
    common = [f.name for f in schema.ENDPOINTS if not any(f.name in c for c in schema.ENDPOINT_KINDS.values())]
    return endpoints.where(F.col("endpointType") == kind).select(*[c for c in common if c in endpoints.columns], *schema.ENDPOINT_KINDS[kind])


def read_defaults(nodes: DataFrame) -> DataFrame:
    """Nulls as readers see them: lists empty, flags false, an endpoint's lines 0."""
    out = nodes
    for f in nodes.schema:
        if f.dataType == schema.STRINGS:
            out = out.withColumn(f.name, F.coalesce(f.name, F.array().cast(schema.STRINGS)))
        elif f.dataType == schema.B:
            out = out.withColumn(f.name, F.coalesce(f.name, F.lit(False)))
        elif f.name in ("startLine", "endLine") and "endpointType" in nodes.columns:
            out = out.withColumn(f.name, F.coalesce(f.name, F.lit(0)))
    return out


def upsert_split(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new with action: insert or update, by one left join on the distinct keys of base."""
    known = base.select(*key).distinct().withColumn("__known", F.lit(True))
    return new.join(known, key, "left").withColumn("action", F.when(F.col("__known"), "update").otherwise("insert")).drop("__known")
