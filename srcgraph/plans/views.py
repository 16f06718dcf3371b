"""Graph-shaped views over the relational test tables, in Spark and, under the same names, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fn(spark, d) -> DataFrame:
    """Functions: what a supplier supplies, a file a supplier."""
    x = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    ident = F.concat(F.lit("f"), "l_suppkey", F.lit("/"), "l_partkey")
    return x.select(
        ident.alias("id"),
        ident.alias("qualifiedName"),
        F.concat(F.lit("p"), "l_partkey").alias("name"),
        F.concat(F.lit("src/s"), "l_suppkey", F.lit(".java")).alias("projectFilePath"),
        F.concat(F.lit("repo"), F.col("l_suppkey") % 3).alias("gitRepoUrl"),
        F.lit("main").alias("gitBranch"),
        (F.col("l_partkey") % 7 == 0).alias("isStatic"),
    )


def calls(spark, d) -> DataFrame:
    """Call edges: a line item calls the same part at another supplier."""
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("f"), "l_suppkey", F.lit("/"), "l_partkey").alias("fromNodeId"),
        F.concat(F.lit("f"), F.col("l_orderkey") % 100, F.lit("/"), "l_partkey").alias("toNodeId"),
        F.lit("CALLS").alias("relationshipType"),
        F.col("l_linenumber").alias("lineNumber"),
    )


def packages(spark, d) -> DataFrame:
    name = F.concat(F.lit("org."), F.lower(F.replace("n_name", F.lit("_"), F.lit("."))))
    return table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), name.alias("qualifiedName"), F.lit(None).cast("string").alias("projectFilePath"))


def units(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.concat(F.lit("u"), "s_suppkey").alias("id"),
        F.replace("s_name", F.lit("#"), F.lit(".")).alias("qualifiedName"),
        F.concat(F.lit("src/s"), "s_suppkey", F.lit(".java")).alias("projectFilePath"),
        F.concat(F.lit("n"), "s_nationkey").alias("packageId"),
    )


def structure(spark, d) -> DataFrame:
    """PACKAGE_TO_UNIT and UNIT_TO_FUNCTION edges."""
    a = units(spark, d).select(F.col("packageId").alias("fromNodeId"), F.col("id").alias("toNodeId"), F.lit("PACKAGE_TO_UNIT").alias("relationshipType"), F.lit(None).cast("int").alias("lineNumber"))
    f = fn(spark, d)
    b = f.select(F.regexp_replace(F.regexp_extract("id", "^f([0-9]+)/", 1), "^", "u").alias("fromNodeId"), F.col("id").alias("toNodeId"), F.lit("UNIT_TO_FUNCTION").alias("relationshipType"), F.lit(None).cast("int").alias("lineNumber"))
    return a.unionByName(b)


def edges(spark, d) -> DataFrame:
    return calls(spark, d).unionByName(structure(spark, d))


def ep_all(spark, d) -> DataFrame:
    """HTTP endpoints, one an event, repeated ids included."""
    e = table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type").isin("click", "view"), "outbound").otherwise("inbound").alias("direction"),
        F.lit("HTTP").alias("endpointType"),
        F.get(F.array(*[F.lit(m) for m in ("GET", "POST", "PUT", "DELETE")]), (F.col("user_id") % 4).cast("int")).alias("httpMethod"),
        F.concat(F.lit("/api/users/{u"), F.col("user_id") % 7, F.lit("}/k/"), F.get_json_object("props", "$.k")).alias("path"),
        F.concat(F.lit("src/s"), F.col("user_id") % 50, F.lit(".java")).alias("projectFilePath"),
    )
    e = e.withColumn("normalizedPath", S.normalize_params("path"))
    other = {c: F.lit(None).cast("string") for c in ("topic", "keyPattern", "tableName", "startLine")}
    return e.withColumns(other).withColumn("id", S.endpoint_id()).withColumn("matchIdentity", S.match_identity()).drop(*other)


def ep(spark, d) -> DataFrame:
    """The first endpoint of each id."""
    return ep_all(spark, d).withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("event_id"))).where("n = 1").drop("n")


#: The same as DuckDB SQL; each may use those before it.
SQL = {
    "fn": """SELECT DISTINCT 'f' || l_suppkey || '/' || l_partkey AS id, 'f' || l_suppkey || '/' || l_partkey AS "qualifiedName", 'p' || l_partkey AS name,
      'src/s' || l_suppkey || '.java' AS "projectFilePath", 'repo' || (l_suppkey % 3) AS "gitRepoUrl", 'main' AS "gitBranch", l_partkey % 7 = 0 AS "isStatic" FROM lineitem""",
    "calls": """SELECT 'f' || l_suppkey || '/' || l_partkey AS "fromNodeId", 'f' || (l_orderkey % 100) || '/' || l_partkey AS "toNodeId", 'CALLS' AS "relationshipType", l_linenumber AS "lineNumber" FROM lineitem""",
    "packages": """SELECT 'n' || n_nationkey AS id, 'org.' || lower(replace(n_name, '_', '.')) AS "qualifiedName", NULL::VARCHAR AS "projectFilePath" FROM nation""",
    "units": """SELECT 'u' || s_suppkey AS id, replace(s_name, '#', '.') AS "qualifiedName", 'src/s' || s_suppkey || '.java' AS "projectFilePath", 'n' || s_nationkey AS "packageId" FROM supplier""",
    "structure": """SELECT "packageId" AS "fromNodeId", id AS "toNodeId", 'PACKAGE_TO_UNIT' AS "relationshipType", NULL::INTEGER AS "lineNumber" FROM units
      UNION ALL SELECT 'u' || regexp_extract(id, '^f([0-9]+)/', 1), id, 'UNIT_TO_FUNCTION', NULL::INTEGER FROM fn""",
    "edges": """SELECT * FROM calls UNION ALL SELECT * FROM structure""",
    "ep_all": """SELECT *, regexp_replace(path, '\\{[^}]+\\}', '{param}', 'g') AS "normalizedPath", direction || ':HTTP:' || "httpMethod" || ':' || path AS id,
      "httpMethod" || ' ' || regexp_replace(path, '\\{[^}]+\\}', '{param}', 'g') AS "matchIdentity"
      FROM (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'outbound' ELSE 'inbound' END AS direction, 'HTTP' AS "endpointType", ['GET', 'POST', 'PUT', 'DELETE'][(user_id % 4) + 1] AS "httpMethod",
            '/api/users/{u' || (user_id % 7) || '}/k/' || json_extract_string(props, '$.k') AS path, 'src/s' || (user_id % 50) || '.java' AS "projectFilePath" FROM events)""",
    "ep": """SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) AS n FROM ep_all) WHERE n = 1""",
}


def sql(body: str) -> str:
    """body with the views defined before it."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in SQL.items()) + "\n" + body
