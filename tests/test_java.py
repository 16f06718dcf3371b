"""The front end on Java that is easy to get wrong."""

import pytest

from srcgraph.functions import tracer as V
from srcgraph.operators.facts import facts_of
from srcgraph.sources.java import ParseError, parse


SOURCE = r'''
package a.b; // trailing
import static java.util.Map.*;
import java.util.*;

@Mark(value = "v", list = {"a", "b"}, of = @Other(1))
public final class T<K extends Comparable<K>, V> extends Base<K> implements I<Map<K, List<V>>>, J {
    int[][] grid[] = {{1}, {2, 3}}, other;
    Runnable r = () -> call0();
    static { call1(); }
    { call2(); }
    public <X> T(K key, X... rest) { super(key); this.run(key < 3 ? key : rest[0]); }
    @Override public synchronized Map<K, V>[] go(final int a, @Mark("m") List<? extends V> b) throws Exception, Error {
        for (int i = 0, j = 1; i < j; i++, j--) one(i);
        for (Map.Entry<K, V> e : m.entrySet()) { two(e); }
        label: while (true) { if (a > b) break label; else continue; }
        try (Reader in = open(); Writer out = in.w()) { three(); } catch (A | B x) { four(x); } finally { five(); }
        switch (a) { case 1: case 2: six(); break; default: seven(); }
        int k = switch (a) { case 1, 2 -> eight(); case 3 -> { yield nine(); } default -> throw new E(); };
        List<String>[] l = (List<String>[]) ten((int) a, (K) b, (x, y) -> eleven(x), String[]::new, T::twelve, -(a) + (b));
        Object o = new Thing<>(a) { void inner() { thirteen(); } int f = fourteen(); };
        if (o instanceof String s && s.length() > 0 || !(o instanceof final Integer n)) fifteen();
        char c = '\'', d = '"'; long h = 0xFFL >>> 2 >> 1; double e = 1e-3, f = .5f; boolean g = a < b & b > c;
        String q = """
            text "block" \
            joined""";
        assert a > 0 : sixteen();
        do { a -= seventeen(); } while (a >= 0);
        synchronized (this) { eighteen(); }
        class Local { void m() { nineteen(); } }
        int[] arr = new int[twenty()], brr = new int[]{1, 2};
        return arr[0] == 1 ? x.<String>generic().chain("a" + 1).end() : null;
    }
    abstract void none(T<K, V>.Inner p, int q[]);
    record Point(int x, @Mark("y") int y) { Point { check(x); } }
    enum E implements I { A(1) { void z() { } }, B; E(int... n) { } void m() { } }
    interface I2 { default void m() { body(); } int X = 1; }
}
'''


def type_named(unit, name):
    return next(t for t in unit["types"] if t["name"] == name)


def test_members_and_calls():
    unit = parse(SOURCE)
    t = type_named(unit, "T")
    assert unit["package"] == "a.b" and [i["isStar"] for i in unit["imports"]] == [True, True]
    assert t["modifiers"] == ["public", "final"] and t["annotations"][0] == {"name": "Mark", "attributes": {"value": "v"}}
    assert t["supers"] == ["Base<K>", "I<Map<K,List<V>>>", "J"] and [f["type"] for f in t["fields"]] == ["int[][][]", "int[][]", "Runnable"]
    assert [m["name"] for m in t["methods"]] == ["T", "go", "none"]
    go = t["methods"][1]
    names = {c.name for c in go["calls"]}
    words = "one two three four five six seven eight nine ten eleven thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty entrySet open w length generic chain end".split()
    assert names == set(words)
    assert {c.name for c in go["calls"] if c.nested} == {"thirteen", "nineteen"}
    assert go["returnType"] == "Map<K,V>[]" and [p["type"] for p in go["params"]] == ["int", "List<V>"]
    assert [c.name for c in t["methods"][0]["calls"]] == ["run"] and t["methods"][2]["params"][1]["type"] == "int[]"
    assert next(x for x in go["locals"] if x["name"] == "q")["init"].value == 'text "block" joined'
    assert [n["name"] for n in t["types"]] == ["Point", "E", "I2"]


def test_nested_types_only_on_demand():
    plain, more = (facts_of(SOURCE, None, None, [], nested_types=n) for n in (False, True))
    assert [t["name"] for t in plain["types"]] == ["T"]
    assert [t["name"] for t in more["types"]] == ["T", "T.Point", "T.E", "T.I2"]


@pytest.mark.parametrize("text", ["class A { void f( {", "class A { int x = ; }", "clazz A {}", "class A { #", 'class A { String s = "open; }'])
def test_errors_are_told(text):
    with pytest.raises(ParseError):
        parse(text)


def test_empty_and_comment_only():
    assert parse("")["types"] == [] and parse("/* x */ // y")["package"] is None


def test_erased_types():
    bounds = {"T": "java.lang.Number", "U": "T"}
    assert V.erased("Map<String,List<T>>[][]", bounds) == "Map[]" and V.erased("T[]", bounds) == "java.lang.Number[]"
    assert V.erased("U", bounds) == "java.lang.Number" and V.erased(None, {}) is None


def test_deep_expressions_end():
    chain = " + ".join(["x"] * 60)
    t = type_named(parse(f"class A {{ void f(String p) {{ String x = p; g({chain}); }} }}"), "A")
    values, level = V.Tracer(t, t["methods"][0], None).trace(t["methods"][0]["calls"][0].args[0])
    assert level == "UNKNOWN" and "{MAX_DEPTH}" in values[0]


def test_doc_comment_starts_a_declaration():
    t = type_named(parse("class A {\n/** d\n */\n@X\nvoid f() {}\n// c\nvoid g() {}\n}"), "A")
    assert [(m["line"], m["endLine"]) for m in t["methods"]] == [(2, 5), (7, 7)]
