"""Batches of changes: incoming calls survive, deleted targets become placeholders, a batch twice changes nothing."""

import pytest
from conftest import rows

from srcgraph import schema
from srcgraph.operators import extract as X
from srcgraph.operators import facts as A
from srcgraph.operators import graph as G
from srcgraph.operators import mutate as M
from srcgraph.operators.store import GraphStore
from srcgraph.streaming import incremental as I

FILES = {
    "s/src/A.java": "package p; public class A { void f() { } }",
    "s/src/B.java": "package p; public class B { void g(A a) { a.f(); a.f(); } }",
    "s/src/C.java": "package p; class C { A a; void h() { a.f(); k(); } void k() { } }",
    "s/src/D.java": "package p; class D { void alone() { } }",
}
MORE = "package p; public class A { int z; void f() { n(); } void n() { } }"


def sources(spark, files):
    return spark.createDataFrame([(p, "git", "main", t) for p, t in files.items()], "projectFilePath string, gitRepoUrl string, gitBranch string, content string")


def builder(spark, every):
    """Read some files with the types of all of them known."""

    def build(some):
        g = X.build(A.parse_sources(sources(spark, every)))
        keep = some.select("projectFilePath")
        own = {k: g[k].join(keep, "projectFilePath", "left_semi").select(*g[k].columns) for k in ("units", "functions", "endpoints")}
        ids = own["functions"].select(G.F.col("id").alias("fromNodeId")).union(own["units"].select("packageId")).union(own["units"].select("id"))
        inner = own["functions"].select(G.F.col("id").alias("toNodeId")).union(own["units"].select("id"))
        edges = g["edges"].join(ids.distinct(), "fromNodeId", "left_semi")
        calls = G.edges_of(edges, "CALLS").join(own["functions"].select(G.F.col("id").alias("fromNodeId")), "fromNodeId", "left_semi")
        rest = edges.where("relationshipType <> 'CALLS'").join(inner, "toNodeId", "left_semi")
        return own | {"packages": g["packages"], "edges": calls.select(*edges.columns).unionByName(rest.select(*edges.columns))}

    return build


def changes(spark, *events):
    fields = schema.CHANGES
    from datetime import datetime

    out = []
    for n, (kind, path) in enumerate(events):
        row = dict.fromkeys(fields.names) | {"eventId": str(n), "changeType": kind, "timestamp": datetime(2024, 1, 1, 0, n)}
        row["oldFileIdentifier" if kind == "SOURCE_DELETED" else "newProjectFilePath"] = path
        out.append(tuple(row[f] for f in fields.names))
    return spark.createDataFrame(out, fields)


@pytest.fixture()
def store(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "graph"))
    build = builder(spark, FILES)
    s.commit(I.plan_changes(s.read(), changes(spark, *[("SOURCE_ADDED", p) for p in FILES]), sources(spark, FILES), build))
    return s


def call_pairs(tables):
    return sorted((r.fromNodeId, r.toNodeId) for r in G.edges_of(tables["edges"], "CALLS").collect())


def snapshot(tables):
    return {k: rows(t.toPandas()) for k, t in tables.items()}


ALL = [("p.B.g(p.A)", "p.A.f()"), ("p.B.g(p.A)", "p.A.f()"), ("p.C.h()", "p.A.f()"), ("p.C.h()", "p.C.k()")]


def test_build_and_dependents(spark, store):
    t = store.read()
    assert call_pairs(t) == ALL
    assert sorted(r[0] for r in G.dependent_files(t["edges"], t["functions"], "s/src/A.java").collect()) == ["s/src/B.java", "s/src/C.java"]
    assert t["functions"].where("isPlaceholder").count() == 0


def test_modify_keeps_incoming_calls(spark, store):
    every = FILES | {"s/src/A.java": MORE}
    deltas = I.plan_changes(store.read(), changes(spark, ("SOURCE_MODIFIED", "s/src/A.java")), sources(spark, every), builder(spark, every))
    merged = I.merge(store.read(), deltas)
    store.commit(deltas)
    t = store.read()
    assert snapshot(merged) == snapshot(t)
    store.compact()
    assert snapshot(store.read()) == snapshot(merged)
    t = store.read()
    assert call_pairs(t) == sorted([*ALL, ("p.A.f()", "p.A.n()")])
    assert {r.id for r in t["functions"].collect()} == {"p.A.f()", "p.A.n()", "p.B.g(p.A)", "p.C.h()", "p.C.k()", "p.D.alone()"}


def test_delete_leaves_placeholders_and_readding_promotes(spark, store):
    left = {k: v for k, v in FILES.items() if k != "s/src/A.java"}
    # callers of a deleted type are read with its symbols still listed
    build = builder(spark, FILES)
    store.commit(I.plan_changes(store.read(), changes(spark, ("SOURCE_DELETED", "s/src/A.java")), sources(spark, left), build))
    t = store.read()
    assert call_pairs(t) == ALL
    assert [(r.id, r.name, r.signature) for r in t["functions"].where("isPlaceholder").collect()] == [("p.A.f()", "f", "f()")]
    assert t["units"].where("id = 'p.A'").count() == 0 and t["packages"].count() == 1
    store.commit(I.plan_changes(t, changes(spark, ("SOURCE_ADDED", "s/src/A.java")), sources(spark, FILES), builder(spark, FILES)))
    t = store.read()
    assert call_pairs(t) == ALL and t["functions"].where("isPlaceholder").count() == 0


def test_twice_is_once(spark, store):
    again = changes(spark, *[("SOURCE_ADDED", p) for p in FILES])
    before = snapshot(store.read())
    store.commit(I.plan_changes(store.read(), again, sources(spark, FILES), builder(spark, FILES)))
    assert snapshot(store.read()) == before


def test_incremental_equals_rebuild(spark, store, tmp_path):
    every = FILES | {"s/src/A.java": MORE}
    store.commit(I.plan_changes(store.read(), changes(spark, ("SOURCE_MODIFIED", "s/src/A.java")), sources(spark, every), builder(spark, every)))
    other = GraphStore(spark, str(tmp_path / "other"))
    other.commit(I.plan_changes(other.read(), changes(spark, *[("SOURCE_ADDED", p) for p in every]), sources(spark, every), builder(spark, every)))
    assert snapshot(store.read()) == snapshot(other.read())


def test_unknown_change_type_stops(spark):
    with pytest.raises(Exception, match="no handler"):
        I.dispatch(changes(spark, ("SOURCE_ADDED", "x")).withColumn("changeType", G.F.lit("OTHER"))).collect()


def test_stream_hands_over_each_batch(spark, tmp_path):
    changes(spark, ("SOURCE_ADDED", "a"), ("SOURCE_DELETED", "b"), ("SOURCE_MODIFIED", "a")).coalesce(1).write.json(str(tmp_path / "log"))
    seen = []
    I.stream_changes(spark, str(tmp_path / "log"), lambda b: seen.append(sorted((r.projectFilePath, r.changeType) for r in I.latest(b).collect())), str(tmp_path / "state")).awaitTermination()
    assert seen == [[("a", "SOURCE_MODIFIED"), ("b", "SOURCE_DELETED")]]


def test_store_versions_and_truncate(spark, store):
    assert store.read()["functions"].count() == 5
    assert store.truncate() == 0 and store.read()["edges"].count() == 0


def test_update_of_unknown_id_does_nothing(spark):
    base = spark.createDataFrame([("a", "x")], "id string, name string")
    new = spark.createDataFrame([("a", None), ("b", "y")], "id string, name string")
    assert M.update(base, new).collect() == [("a", None)]


def test_read_defaults(spark):
    row = spark.createDataFrame([tuple([None] * len(schema.ENDPOINTS))], schema.ENDPOINTS)
    out = G.read_defaults(row).first()
    assert (out.startLine, out.endLine, out.isExternal) == (0, 0, False)
    unit = G.read_defaults(spark.createDataFrame([tuple([None] * len(schema.UNITS))], schema.UNITS)).first()
    assert (unit.modifiers, unit.isAbstract, unit.startLine) == ([], False, None)
