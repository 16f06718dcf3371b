"""Mutations as functions of tables: (base, change) -> new base. The store decides how they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from . import graph as G


def upsert(base: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new replace those of base with the same key, whole: nulls overwrite."""
    return base.join(new.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def update(base: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Only keys that base has; others are no error."""
    return upsert(base, new.join(base.select(key).distinct(), key, "left_semi"), key)


def insert_missing(base: DataFrame, new: DataFrame, key: list[str], order: list | None = None) -> DataFrame:
    """base and the rows of new with keys that it lacks, the first of each; base is never changed."""
    fresh = new.join(base.select(*key).distinct(), key, "left_anti").select(*new.columns)
    fresh = G.first_by(fresh, key, order) if order else fresh.dropDuplicates(key)
    return base.unionByName(fresh.select(*base.columns))


def insert_structure(edges: DataFrame, new: DataFrame) -> DataFrame:
    return insert_missing(edges, new, G.EDGE_KEY)


def append_calls(edges: DataFrame, new: DataFrame) -> DataFrame:
    """One row a call site: the edge id names the site, so a batch applied twice adds nothing."""
    return insert_missing(edges, new, ["id"])


def add_placeholders(functions: DataFrame, edges: DataFrame) -> DataFrame:
    return functions.unionByName(G.placeholder_rows(G.missing_functions(edges, functions)).select(*functions.columns))


def detach(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Nodes of any label with these ids go, and every edge at either end."""
    gone = ids.select("id").distinct()
    out = {k: t.join(gone, "id", "left_anti").select(*t.columns) for k, t in tables.items() if k != "edges"}
    e = tables["edges"]
    for end in ("fromNodeId", "toNodeId"):
        e = e.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return out | {"edges": e.select(*tables["edges"].columns)}


def nodes_of_files(tables: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """Ids of units, functions and endpoints of files (projectFilePath); packages stay with their other files."""
    out = None
    for name in ("units", "functions", "endpoints"):
        part = G.only(tables[name], "projectFilePath", files.select("projectFilePath")).select("id")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def delete_files(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    return detach(tables, nodes_of_files(tables, files))


def delete_outgoing(edges: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """Calls whose caller lies in one of files go."""
    mine = functions.join(files.select("projectFilePath").distinct(), "projectFilePath", "left_semi").select(F.col("id").alias("fromNodeId")).distinct()
    calls = G.edges_of(edges, schema.CALLS).join(mine, "fromNodeId", "left_anti").select(*edges.columns)
    return edges.where(F.col("relationshipType") != schema.CALLS).unionByName(calls)


def with_matches(edges: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Merge MATCHES pairs: a pair once."""
    pairs = G.endpoint_matches(endpoints).withColumn("relationshipType", F.lit(schema.MATCHES))
    return insert_missing(edges, edge_rows(pairs), G.EDGE_KEY)


def edge_rows(pairs: DataFrame) -> DataFrame:
    """Full edge rows from (fromNodeId, toNodeId, relationshipType) and what else pairs has."""
    from ..functions.scalars import edge_id

    known = set(pairs.columns)
    own = lambda f: F.col(f.name) if f.name in known else F.lit("java") if f.name == "language" else F.lit(None)
    out = pairs.select(*[own(f).cast(f.dataType).alias(f.name) for f in schema.EDGES if f.name != "id"])
    return out.withColumn("id", edge_id(*G.EDGE_KEY, "lineNumber")).select(*schema.EDGES.names) if "id" not in known else pairs.select(*schema.EDGES.names)
