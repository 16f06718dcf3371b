from conftest import DATA

from srcgraph.plans.queries import QUERIES


def test_range_join_reads_every_order(spark):
    want = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    assert QUERIES["position_range_join"](spark, DATA).count() == want
