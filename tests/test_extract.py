"""Ancestors and chained calls of any depth."""

from test_incremental import sources

from srcgraph.operators import extract as X
from srcgraph.operators import facts as A
from srcgraph.operators import graph as G


def called(spark, files):
    g = X.build(A.parse_sources(sources(spark, {f"s/src/{n}.java": f"package p; {t}" for n, t in files.items()})))
    return {(r.fromNodeId, r.toNodeId) for r in G.edges_of(g["edges"], "CALLS").collect()}


def test_deep_class_tree_and_a_cycle(spark):
    tree = {"A0": "public class A0 { void f() { } }"} | {f"A{i}": f"public class A{i} extends A{i - 1} {{ }}" for i in range(1, 6)}
    loop = {"L": "class L extends M { }", "M": "class M extends L { void m() { } }"}
    user = {"U": "class U { void u(A5 a, L l) { a.f(); l.m(); } }"}
    assert called(spark, tree | loop | user) == {("p.U.u(p.A5,p.L)", "p.A0.f()"), ("p.U.u(p.A5,p.L)", "p.M.m()")}


def test_long_chain_of_calls(spark):
    links = {f"B{i}": f"public class B{i} {{ B{i + 1} m{i}() {{ return null; }} }}" for i in range(6)} | {"B6": "public class B6 { }"}
    user = {"U": "class U { void u(B0 b) { b.m0().m1().m2().m3().m4().m5(); } }"}
    assert called(spark, links | user) == {("p.U.u(p.B0)", f"p.B{i}.m{i}()") for i in range(6)}
