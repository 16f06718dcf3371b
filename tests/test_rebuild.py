"""Batches through the engine alone give what reading all files anew gives."""

import random

import pytest
from test_incremental import call_pairs, changes, snapshot, sources

from srcgraph import engine as N
from srcgraph.engine import Engine


def engine(spark, root, files, **more):
    return Engine(spark, str(root), lambda: sources(spark, files), **more)


def rebuilt(spark, root, files, deleted=(), **more):
    """An engine that read everything at once; deleted: files that were read and then deleted in one batch."""
    every = files | dict(deleted) if deleted else files
    e = engine(spark, root, every, **more)
    e.apply(changes(spark, *[("SOURCE_ADDED", p) for p in every]))
    if deleted:
        e.apply(changes(spark, *[("SOURCE_DELETED", p) for p in deleted]))
    return e


def same(a, b):
    x, y = snapshot(a.store.read()), snapshot(b.store.read())
    for k in x:
        assert x[k] == y[k], k


TREE = {
    "s/src/C.java": "package p; public class C { C foo() { return this; } protected C up; }",
    "s/src/B.java": "package p; public class B extends C { }",
    "s/src/A.java": "package p; class A { void m(B b, G<B> g) { b.foo(); b.foo().foo(); b.up.foo(); g.get().foo(); } }",
    "s/src/G.java": "package p; class G<T> { T get() { return null; } }",
}


def test_an_unchanged_file_keeps_inherited_calls(spark, tmp_path):
    files = dict(TREE)
    e = rebuilt(spark, tmp_path / "a", files)
    before = snapshot(e.store.read())
    assert len(call_pairs(e.store.read())) == 6
    assert e.file_modified("s/src/A.java")["code"] == 200
    assert snapshot(e.store.read()) == before


def test_a_changed_type_reaches_its_users(spark, tmp_path):
    """An override, a type that comes, a method that goes and a parameter's type: files that were not changed follow."""
    files = dict(TREE)
    e = rebuilt(spark, tmp_path / "a", files)
    files["s/src/B.java"] = "package p; public class B extends C { B foo() { return this; } }"
    e.file_modified("s/src/B.java")
    assert ("p.A.m(p.B,p.G)", "p.B.foo()") in call_pairs(e.store.read())
    same(e, rebuilt(spark, tmp_path / "b", files))
    files["s/src/D.java"] = "package p; class D { void d(New n) { n.x(); } }"
    e.file_added("s/src/D.java")
    assert e.unresolved_calls().first().name == "x"
    files["s/src/New.java"] = "package p; class New { void x() { } }"
    e.file_added("s/src/New.java")
    assert ("p.D.d(p.New)", "p.New.x()") in call_pairs(e.store.read()) and e.unresolved_calls().count() == 0
    files["s/src/C.java"] = "package p; public class C { void other() { } protected C up; }"
    e.file_modified("s/src/C.java")
    same(e, rebuilt(spark, tmp_path / "c", files))


def variant(r, n, types):
    """A random type Tn with a random super type, methods and calls."""
    others = [t for t in types if t != n]
    above = r.choice([f" extends T{r.choice(others)}", "", ""]) if others else ""
    methods = [f"{r.choice(['void', 'int', f'T{r.choice(types)}'])} m{k}({r.choice(['', 'long a', f'T{r.choice(types)} a'])}) {{ return; }}" for k in r.sample(range(4), 2)]
    calls = " ".join(f"{r.choice(['a', 'f', 'this', 'f.f'])}.m{r.randrange(4)}({r.choice(['', '1', 'a', 'a.m1()'])}).m{r.randrange(4)}();" for _ in range(2))
    return f"package p; class T{n}{above} {{ T{r.choice(types)} f; {' '.join(methods)} void use{n}(T{r.choice(types)} a) {{ {calls} }} }}"


@pytest.mark.parametrize("seed, most", [(1, N.SMALL_FILES), (3, 0)])
def test_random_batches_equal_a_rebuild(spark, tmp_path, monkeypatch, seed, most):
    """Small batches on the driver, and (most 0) all batches through staged tables."""
    monkeypatch.setattr(N, "SMALL_FILES", most)
    r = random.Random(seed)
    types = list(range(5))
    path = lambda n: f"s/src/T{n}.java"
    files = {path(n): variant(r, n, types) for n in types[:4]}
    e = rebuilt(spark, tmp_path / "e", files)
    for step in range(2):
        events = []
        for n in r.sample(types, r.choice([1, 2])):
            new = path(n) not in files
            files[path(n)] = variant(r, n, types)
            events.append(("SOURCE_ADDED" if new else "SOURCE_MODIFIED", path(n)))
        e.apply(changes(spark, *events))
        same(e, rebuilt(spark, tmp_path / f"r{step}", files))
    gone = r.choice([p for p in files])
    deleted = {gone: files.pop(gone)}
    e.file_deleted(gone)
    same(e, rebuilt(spark, tmp_path / "d", files, deleted))
