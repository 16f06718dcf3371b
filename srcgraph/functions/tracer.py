"""Symbolic values of string expressions: what an argument may be, and how sure that is."""

from __future__ import annotations

import re

from ..sources.config import expand

FULL, PARTIAL, UNKNOWN = "FULL", "PARTIAL", "UNKNOWN"
RANK = {FULL: 0, PARTIAL: 1, UNKNOWN: 2}
DEPTH = 10


class Tracer:
    """For one method of one type. config: key -> values, or None without a project."""

    def __init__(self, type_: dict, method: dict | None, config: dict[str, list[str]] | None):
        self.type, self.method, self.config = type_, method, config

    def trace(self, e, depth: int = 0, seen: frozenset = frozenset()) -> tuple[list[str], str]:
        """(possible values, level)."""
        if depth > DEPTH:
            return ["{MAX_DEPTH}"], UNKNOWN
        if id(e) in seen:
            return ["{CIRCULAR}"], UNKNOWN
        seen = seen | {id(e)}
        if e.kind in ("str", "num"):
            return [e.value], FULL
        if e.kind == "paren":
            return self.trace(e.left, depth, seen)
        if e.kind == "name":
            return self.name(e.name, e.line, depth + 1, seen)
        if e.kind == "field" and not self.qualified(e):
            found = self.field(e.name)
            if found and found["init"] is not None:
                return self.trace(found["init"], depth + 1, seen)
            return ["{FIELD:" + e.name + "}"], PARTIAL
        if e.kind == "plus":
            left, a = self.trace(e.left, depth + 1, seen)
            right, b = self.trace(e.right, depth + 1, seen)
            return [x + y for x in left for y in right], max(a, b, key=RANK.get)
        if e.kind == "call":
            return ["{METHOD:" + e.name + "()}"], UNKNOWN
        return ["{UNKNOWN}"], UNKNOWN

    @staticmethod
    def qualified(e) -> bool:
        """a.b.c of plain names: a constant of another type, not a field at hand."""
        while e.kind == "field":
            e = e.target
        return e.kind == "name"

    def field(self, name: str) -> dict | None:
        return next((f for f in self.type["fields"] if f["name"] == name), None)

    def name(self, name: str, line: int, depth: int, seen) -> tuple[list[str], str]:
        method = self.method or {"locals": [], "params": []}
        local = [x for x in method["locals"] if x["name"] == name and x["line"] <= line]
        if local and local[-1]["init"] is not None:
            return self.trace(local[-1]["init"], depth, seen)
        param = next((p for p in method["params"] if p["name"] == name), None)
        if param and (got := self.configured(param["annotations"])):
            return got
        field = self.field(name)
        if field:
            if got := self.configured(field["annotations"]):
                return got
            if field["init"] is not None:
                return self.trace(field["init"], depth, seen)
            if got := self.constructed(name):
                return got
        return ["{" + name + "}"], PARTIAL

    def configured(self, annotations: list[dict]) -> tuple[list[str], str] | None:
        for a in annotations:
            raw = a["attributes"].get("value") if a["name"] == "Value" else None
            if raw is not None:
                return ([raw] if self.config is None else expand(raw, self.config)), FULL
        return None

    def constructed(self, name: str) -> tuple[list[str], str] | None:
        """A constructor's assignment to the field from a configured parameter."""
        for m in self.type["methods"]:
            if not m["isConstructor"]:
                continue
            for a in m["assigns"]:
                to = a.left
                mine = to.kind == "field" and to.target.kind == "this" and to.name == name or to.kind == "name" and to.name == name
                if mine and a.right.kind == "name":
                    param = next((p for p in m["params"] if p["name"] == a.right.name), None)
                    if param and (got := self.configured(param["annotations"])):
                        return got
        return None


# --- a path by its segments ----------------------------------------------------------------------


def segments(e) -> list[tuple[str, bool]]:
    """(text, literal) of the operands of a concatenation, left to right."""
    if e.kind == "plus":
        return segments(e.left) + segments(e.right)
    if e.kind == "paren":
        return segments(e.left)
    return [(e.value, True)] if e.kind == "str" else [(e.text, False)]


def path_segments(e, method: dict | None) -> list[tuple[str, bool]] | None:
    """Segments of a path argument; a name stands for its first declaration at the top of the method. None where it is neither
    a literal nor a concatenation."""
    if e.kind == "name" and method is not None:
        found = next((x for x in method["locals"] if x["name"] == e.name and x["top"]), None)
        if found and found["init"] is not None:
            e = found["init"]
    return segments(e) if e.kind in ("plus", "str") else None


# --- static types, as written --------------------------------------------------------------------


def erased(text: str | None, variables: dict[str, str]) -> str | None:
    """Without type arguments, type variables by their bounds, any array dimensions as one []."""
    if text is None:
        return None
    bare, n = text, 1
    while n:
        bare, n = re.subn(r"<[^<>]*>", "", bare)
    array = "[]" if "[]" in bare else ""
    bare = bare.replace("[]", "")
    return (erased(variables[bare], {k: v for k, v in variables.items() if k != bare}) if bare in variables else bare) + array


def static_type(e, type_: dict, method: dict | None) -> str | None:
    """The declared type of an expression as written, where it shows; a type's own name for a static receiver."""
    kind = e.kind
    if kind == "str":
        return "java.lang.String"
    if kind == "chr":
        return "char"
    if kind == "num":
        t = e.value.lower()
        return "long" if t[-1] == "l" else "float" if t[-1] == "f" and "x" not in t else "double" if ("." in t or t[-1] == "d") and "x" not in t else "int"
    if kind == "const":
        return None if e.value == "null" else "boolean"
    if kind == "paren":
        return static_type(e.left, type_, method)
    if kind in ("new", "cast"):
        return e.type
    if kind == "this":
        return type_["name"]
    if kind == "plus":
        sides = [static_type(x, type_, method) for x in (e.left, e.right)]
        return "java.lang.String" if "java.lang.String" in sides or "String" in sides else None
    if kind == "field" and e.target.kind == "this":
        return next((f["type"] for f in type_["fields"] if f["name"] == e.name), None)
    if kind == "field":
        # Outer.Inner or a package's type, by the habit of capitals
        return e.text if e.name[:1].isupper() and not e.name.isupper() and Tracer.qualified(e) else None
    if kind == "name":
        for scope in ((method or {}).get("locals", ()), (method or {}).get("params", ()), type_["fields"]):
            found = [x for x in scope if x["name"] == e.name and x["line"] <= e.line or x["name"] == e.name and scope is type_["fields"]]
            if found:
                t = found[-1]["type"]
                init = found[-1].get("init")
                return static_type(init, type_, None) if t == "var" and init is not None else None if t == "var" else t
        return e.name if e.name[:1].isupper() else None
    return None
