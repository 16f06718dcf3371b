"""Calls to the function that Java's rules choose: inheritance, scopes, overloads, chains, generics."""

from test_incremental import sources

from srcgraph.operators import extract as X
from srcgraph.operators import facts as A

TYPES = {
    "C0": "package p; public class C0 { C0 foo() { return this; } public C0 own; protected C0 self; }",
    "C1": "package p; public class C1 extends C0 { }",
    "C2": "package p; public class C2 extends C1 { }",
    "C3": "package p; public class C3 extends C2 { }",
    "D": "package p; public class D extends C3 { }",
    "U": "package q; public class U { public static void util() { } public static int two(int a) { return a; } public static final p.C0 K = null; }",
    "Box": "package p; public class Box<T> { T v; T get() { return v; } Box<T> next() { return this; } void use() { v.toString(); } }",
    "FooBox": "package p; public class FooBox extends Box<C2> { }",
    "Color": "package p; public enum Color { RED, GREEN; public void paint() { } }",
    "Rec": "package p; public record Rec(String name, int count) { public int count() { return 1; } }",
    "Outer": "package p; public class Outer { Inner make() { return null; } static class Inner { void deep() { } } }",
}
HEAD = """package p; import java.util.*; import static q.U.util; import static q.U.*; import q.U;
public class B extends C1 {
 void lng(long x) { } void obj(Object o) { } void obj(Integer i) { } void va(String... s) { } void va2(int a, Object... r) { } void over(C0 a) { } void over(C2 a) { }
 void bx(Integer i) { } void un(int i) { } void ch(char c) { } void ch(int c) { } void two(C0 a, C0 b) { } void one(String s) { } void one(List<String> s) { }
 <T> T id(T t) { return t; } <T> T of(Class<T> c) { return null; }
 void main(D d, B c, int i, B[] bs, Box<B> box, FooBox fb, Color col, Rec r, List<B> list, Object any) {
"""
#: (statement, the targets in the order of the calls, with - for none)
SITES = [
    ("d.foo();", "p.C0.foo()"),
    ("c.foo().foo().foo().foo().foo();", "p.C0.foo() p.C0.foo() p.C0.foo() p.C0.foo() p.C0.foo()"),
    ("util();", "q.U.util()"),
    ("two(3);", "-"),  # the class has a method of that name, which hides the import
    ('c.va("a", "b"); c.va(); c.va2(1, "x", 2);', "p.B.va(java.lang.String[]) p.B.va(java.lang.String[]) p.B.va2(int,java.lang.Object[])"),
    ("c.lng(i); c.lng(i + 1L); c.lng('c');", "p.B.lng(long) p.B.lng(long) p.B.lng(long)"),
    ('c.obj(5); c.obj("s"); c.obj(any);', "p.B.obj(java.lang.Integer) p.B.obj(java.lang.Object) p.B.obj(java.lang.Object)"),
    ("bs[0].foo(); self.foo(); this.self.foo(); self.own.own.foo();", "p.C0.foo() p.C0.foo() p.C0.foo() p.C0.foo()"),
    ("c.over(new C3()); c.over(new C1());", "p.B.over(p.C2) p.B.over(p.C0)"),
    ("c.bx(i); c.un(c.id(new Integer(1)));", "p.B.bx(java.lang.Integer) p.B.un(int) p.B.id(java.lang.Object)"),
    ("c.ch('a'); c.ch(1);", "p.B.ch(char) p.B.ch(int)"),
    ("box.get().lng(3); fb.get().foo(); box.next().next().get().lng(1);", "p.Box.get() p.B.lng(long) p.Box.get() p.C0.foo() p.Box.next() p.Box.next() p.Box.get() p.B.lng(long)"),
    ("id(c).lng(1); of(B.class).lng(2);", "p.B.id(java.lang.Object) p.B.lng(long) p.B.of(java.lang.Class) p.B.lng(long)"),
    ('Color.RED.paint(); col.paint(); Color.valueOf("x").paint(); Color.values()[0].paint();', "p.Color.paint() p.Color.paint() p.Color.valueOf(java.lang.String) p.Color.paint() p.Color.values() p.Color.paint()"),
    ("r.name(); r.count();", "p.Rec.name() p.Rec.count()"),
    ("Outer.Inner in = null; in.deep(); new Outer().make().deep();", "p.Outer.Inner.deep() p.Outer.make() p.Outer.Inner.deep()"),
    ("for (var x : list) x.lng(1); for (B y : bs) y.lng(2); for (var z : bs) z.lng(3);", "p.B.lng(long) p.B.lng(long) p.B.lng(long)"),
    ("var z = box.get(); z.lng(3);", "p.Box.get() p.B.lng(long)"),
    ("U.K.foo(); q.U.util(); U.util();", "p.C0.foo() q.U.util() q.U.util()"),
    ('c.one("a" + i); c.one(i > 0 ? "a" : null);', "p.B.one(java.lang.String) p.B.one(java.lang.String)"),
    ("((C0) any).foo(); (c).foo(); super.foo();", "p.C0.foo() p.C0.foo() p.C0.foo()"),
    ("list.forEach(l -> l.lng(3)); Runnable run = () -> util();", "- - q.U.util()"),
    ("unknown.call(); c.nothing(); c.one(null);", "- - -"),
]


def resolved(spark, files):
    known, shapes = X.front(X.staged(A.parse_sources(sources(spark, {f"s/src/{n}.java": t for n, t in files.items()})), "facts"))
    method = X.staged(X.methods(X.types(known)), "methods")
    return X.staged(X.R.resolve_sites(method, shapes), "sites")


def test_sites_of_every_kind(spark):
    """Each statement stands on a line of its own."""
    text = HEAD + "\n".join(s for s, _ in SITES) + "\n} }"
    sites = resolved(spark, TYPES | {"B": text})
    first = HEAD.count("\n") + 1
    got: dict = {}
    for r in sites.where("not field and callerId like 'p.B.main(%'").orderBy("at").collect():
        got.setdefault(r.line - first, []).append(r.targetId or "-")
    for k, (statement, want) in enumerate(SITES):
        assert " ".join(got[k]) == want, statement
    why = {(r.name, r.reason) for r in X.unresolved(sites).collect()}
    assert {("call", "receiver"), ("nothing", "member"), ("one", "several")} <= why


def test_the_same_type_twice_stops_nothing(spark):
    files = {"a": "package p; class A { void f() { g(); } void g() { } }", "b": "package p; class A { void f() { g(); } void g() { } }"}
    found = resolved(spark, files).where("targetId = 'p.A.g()'").select("projectFilePath").distinct().count()
    assert found == 2
