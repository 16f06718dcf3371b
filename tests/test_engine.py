"""The engine as a user meets it: requests, look-ups, filters, enrichers."""

import json

from test_incremental import ALL, FILES, MORE, call_pairs, changes, sources

from srcgraph import schema
from srcgraph.engine import Engine
from srcgraph.plans import fixtures
from srcgraph.sources import requests as Q
from srcgraph.sources import rules as R


def test_requests_change_the_graph(spark, tmp_path):
    files = dict(FILES)
    e = Engine(spark, str(tmp_path / "g"), lambda: sources(spark, files))
    e.apply(changes(spark, *[("SOURCE_ADDED", p) for p in files]))
    assert call_pairs(e.store.read()) == ALL
    files["s/src/A.java"] = MORE
    assert e.file_modified("s/src/A.java") == {"code": 200, "message": "success", "data": None}
    assert call_pairs(e.store.read()) == sorted([*ALL, ("p.A.f()", "p.A.n()")])
    assert sorted(r.projectFilePath for r in e.who_calls_me("s/src/A.java").collect()) == ["s/src/A.java", "s/src/B.java", "s/src/C.java"]
    assert e.nodes_by_file("functions", "s/src/D.java").first().id == "p.D.alone()"
    del files["s/src/A.java"]
    assert e.file_deleted("s/src/A.java")["code"] == 200
    t = e.store.read()
    assert call_pairs(t) == ALL and [r.id for r in t["functions"].where("isPlaceholder").collect()] == ["p.A.f()"]


def test_bad_requests(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "g"), lambda: sources(spark, FILES))
    assert e.file_modified("  ")["code"] == 400 and e.request("PATCH", {"projectFilePath": "x"})["code"] == 400
    e.sources = lambda: 1 / 0
    assert e.file_modified("x")["code"] == 500
    row = Q.change_of("PUT", {"projectFilePath": "a", "classpathEntries": ["", None, "x.jar"]})
    assert row["classpathEntries"] == ["x.jar"] and set(row) <= set(schema.CHANGES.names)


def test_filters_enrichers_and_endpoints(spark, tmp_path):
    files = fixtures.SOURCES
    tag = lambda t: t | {"functions": t["functions"].withColumn("name", schema_tag())}

    def schema_tag():
        from pyspark.sql import functions as F

        return F.concat(F.lit("x-"), "name")

    e = Engine(spark, str(tmp_path / "g"), lambda: sources(spark, files), config=lambda: spark.createDataFrame(list(fixtures.CONFIG.items()), "path string, content string"), filters=(lambda d: d["name"] != "log",), enrichers=(tag,))
    e.apply(changes(spark, *[("SOURCE_ADDED", p) for p in files]))
    t = e.store.read()
    assert not [p for p in call_pairs(t) if ".log(" in p[1]] and len(call_pairs(t)) == 5
    assert {r.name[:2] for r in t["functions"].collect()} == {"x-"}
    found = e.endpoints_by_identity("DELETE /v1/items/{param}", "inbound").first()
    assert found.id == "inbound:HTTP:DELETE:/v1/items/{id}" and found.isExternal is False
    assert t["edges"].where("relationshipType = 'MATCHES'").count() == 2
    plain = Engine(spark, str(tmp_path / "h"), lambda: sources(spark, files), endpoints=False)
    plain.apply(changes(spark, *[("SOURCE_ADDED", p) for p in files]))
    assert {r.part: r.n for r in plain.summary().collect()}["endpoints"] == 0


def test_processors_by_priority(spark, tmp_path):
    from pyspark.sql import functions as F

    order = []

    def late(types):
        order.append("late")
        return {"packages": types.select(F.concat(F.lit("extra."), "package").alias("id")).distinct()}

    def early(types):
        order.append("early")
        return {}

    def off(types):
        raise AssertionError

    early.priority, off.enabled = 1, False
    e = Engine(spark, str(tmp_path / "g"), lambda: sources(spark, FILES), processors=(late, off, early))
    e.apply(changes(spark, *[("SOURCE_ADDED", p) for p in FILES]))
    assert order == ["early", "late"] and {r.id for r in e.store.read()["packages"].collect()} == {"p", "extra.p"}


def test_stream_into_the_store(spark, tmp_path):
    changes(spark, *[("SOURCE_ADDED", p) for p in FILES]).coalesce(1).write.json(str(tmp_path / "log"))
    e = Engine(spark, str(tmp_path / "g"), lambda: sources(spark, FILES))
    e.follow(str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    assert call_pairs(e.store.read()) == ALL


def test_sources_and_configuration_from_folders(spark, tmp_path):
    from srcgraph.operators import facts
    from srcgraph.sources import config as C

    for path, text in {**fixtures.SOURCES, **fixtures.CONFIG}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    read = facts.read_sources(spark, str(tmp_path)).collect()
    assert {r.content for r in read} == set(fixtures.SOURCES.values())
    roots = {r.projectRoot.rsplit("/", 1)[-1] for r in C.scan(spark, str(tmp_path)).collect()}
    assert roots == {"shop"}


def test_rules_are_arranged(tmp_path):
    a, b = {"name": "a", "priority": 1, "enabled": True}, {"name": "a", "priority": 9, "enabled": True}
    assert R.arrange([a, b, None, {"name": "b", "priority": 1, "enabled": True}, {"name": "c", "priority": 5, "enabled": False}]) == [a, {"name": "b", "priority": 1, "enabled": True}]
    assert R.load_file(tmp_path / "none.yaml") is None and R.parse("a: [") is None and R.parse("just text") is None
    rule = R.parse(json.dumps({"name": "n", "extract": {}}))
    assert (rule["priority"], rule["enabled"], rule["version"]) == (100, True, "1.0")
