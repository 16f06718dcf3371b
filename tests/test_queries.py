"""Every query against the SQL that says what it must give."""

import pytest
from conftest import DATA, rows

from srcgraph.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert rows(got) == rows(duck.execute(ORACLE[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["projectFilePath", "gitRepoUrl", "gitBranch"] and out.count() >= 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["who_calls_me", "endpoint_matches", "placeholders", "delete_file", "upsert_split"])
def test_no_cartesian_product(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_file_filter_reaches_the_scan(spark, tmp_path):
    from srcgraph.operators import graph as G

    QUERIES["nodes_by_file"](spark, DATA)
    spark.createDataFrame([("a", "x")], "id string, projectFilePath string").write.parquet(str(tmp_path / "t"))
    plan = G.nodes_by_file(spark.read.parquet(str(tmp_path / "t")), "x")._jdf.queryExecution().toString()
    assert "EqualTo(projectFilePath,x)" in plan
