"""Where the types of receivers and arguments come from, a file at a time: written in the file, or the result of another site.

A site is a call or the access of a field that the file does not declare. A term is a written type, or the number of the site whose
result has the type, and how often an element of it is taken. A site's level is one above those of the sites it needs, so all sites of a
level are resolved together, by joins (operators.resolve). Type variables stand as their bounds; in the templates of members as #k (the
type's k-th variable) and @k (the type of the k-th argument; @k! its first type argument).
"""

from __future__ import annotations

import re

from .tracer import Tracer

#: Primitive types that widen to the right.
NUMBERS = ("byte", "short", "char", "int", "long", "float", "double")
STRING, NULL, LAMBDA, CLASS = "java.lang.String", "(null)", "(lambda)", "java.lang.Class"
STATIC_IMPORTS = 100
NAME = re.compile(r"[^\W\d][\w$]*(?:\.[^\W\d][\w$]*)*")
TEXT = ("java.lang.String", "String")


def shown(text: str, variables: dict[str, str], depth: int = 0) -> str:
    """A written type with wildcards as Object and variables by what they stand for."""
    text = text.replace("?", "java.lang.Object")

    def one(m):
        if m[0] not in variables or depth > 5:
            return m[0]
        return shown(variables[m[0]], {k: v for k, v in variables.items() if k != m[0]}, depth + 1)

    return NAME.sub(one, text)


def names_in(text: str) -> list[str]:
    return NAME.findall(text)


def promoted(a: str | None, b: str | None) -> str | None:
    """The type of an arithmetic expression, where both sides are primitive."""
    if a in NUMBERS and b in NUMBERS:
        return max(a, b, "int", key=NUMBERS.index)
    return None


def number(text: str) -> str:
    t = text.lower()
    hexadecimal = t.startswith("0x")
    if t[-1] == "l":
        return "long"
    if hexadecimal:
        return "int"
    return "float" if t[-1] == "f" else "double" if "." in t or "e" in t or t[-1] == "d" else "int"


class Sites:
    """The sites of one method. chain: (qualified name, type) of its type and those around it, from the inside."""

    def __init__(self, chain: list[tuple[str, dict]], method: dict, imports: list[dict], variables: dict[str, str], saw):
        self.chain, self.method, self.imports, self.variables, self.saw = chain, method, imports, variables, saw
        calls = method["calls"]
        self.number = {id(c): i for i, c in enumerate(calls)}
        self.rows: list = [None] * len(calls)
        self.fields: dict = {}
        for i, c in enumerate(calls):
            self.call(i, c)

    # --- sites

    def call(self, i: int, c) -> int:
        if self.rows[i] is None:
            self.rows[i] = {}  # no expression holds itself
            target = c.target
            while target is not None and target.kind == "paren":
                target = target.left
            up = target is not None and target.kind == "super"
            receiver = self.term(target) if target is not None and not up else None
            scopes = self.scopes(c.name) if target is None else [{"rank": 0, "type": self.chain[0][0]}] if up else []
            self.fill(i, c.name, c.line, False, receiver, scopes, up, [self.argument(a) for a in c.args], None)
        return i

    def field(self, name: str, line: int, receiver: dict | None, or_type: str | None = None) -> dict:
        key = (name, None if receiver is None else tuple(receiver.values()), or_type)
        if key not in self.fields:
            self.fields[key] = len(self.rows)
            self.rows.append({})
            self.fill(self.fields[key], name, line, True, receiver, [] if receiver else self.scopes(name), False, [], or_type)
        return {"type": None, "site": self.fields[key], "deref": 0}

    def fill(self, i, name, line, field, receiver, scopes, up, args, or_type):
        needs = [t["site"] for t in (receiver, *args) if t and t["site"] is not None]
        level = max((self.rows[n].get("level", 0) for n in needs), default=-1) + 1
        self.rows[i] = {
            "at": i, "field": field, "name": name, "line": line, "level": level, "receiver": receiver, "scopes": scopes, "viaSuper": up, "args": args, "orType": or_type,
        }

    def scopes(self, name: str) -> list[dict]:
        """Types whose members a bare name may be, the nearest first: those around it, then static imports."""
        out = [{"rank": i, "type": q} for i, (q, _) in enumerate(self.chain)]
        for i in self.imports:
            if i["isStatic"] and i["isStar"]:
                out.append({"rank": STATIC_IMPORTS + 1, "type": self.written(i["name"], {})})
            elif i["isStatic"] and i["name"].rpartition(".")[2] == name:
                out.append({"rank": STATIC_IMPORTS, "type": self.written(i["name"].rpartition(".")[0], {})})
        return out

    # --- terms

    def written(self, text: str, variables: dict[str, str] | None = None) -> str:
        out = shown(text, self.variables if variables is None else variables)
        self.saw(names_in(out))
        return out

    def known(self, text: str) -> dict:
        return {"type": text, "site": None, "deref": 0}

    def of_type(self, text: str | None) -> dict | None:
        return None if text in (None, "var") else self.known(self.written(text))

    def argument(self, e) -> dict:
        return self.term(e) or {"type": None, "site": None, "deref": 0}

    def element(self, t: dict | None) -> dict | None:
        if t is None:
            return None
        if t["type"] is not None and t["type"].endswith("[]"):
            return self.known(t["type"][:-2])
        return t | {"deref": t["deref"] + 1}

    def plain(self, e) -> str | None:
        """The type of an operand where it is written."""
        t = self.term(e)
        return t["type"] if t is not None and not t["deref"] else None

    def term(self, e) -> dict | None:
        how = getattr(self, "of_" + e.kind, None)
        return how(e) if how else None

    def of_str(self, e):
        return self.known(STRING)

    def of_chr(self, e):
        return self.known("char")

    def of_num(self, e):
        return self.known(number(e.value))

    def of_const(self, e):
        return self.known(NULL if e.value == "null" else "boolean")

    def of_paren(self, e):
        return self.term(e.left)

    def of_new(self, e):
        return self.of_type(e.type)

    def of_cast(self, e):
        return self.of_type(e.type)

    def of_lambda(self, e):
        return self.known(LAMBDA)

    of_reference = of_lambda

    def of_assign(self, e):
        return self.term(e.left)

    def of_class(self, e):
        return self.known(f"{CLASS}<{self.written(e.target.text, {})}>") if e.target is not None and NAME.fullmatch(e.target.text) else self.known(CLASS)

    def of_this(self, e):
        return self.known(self.chain[0][0]) if e.target is None else self.of_type(e.target.text)

    def of_plus(self, e):
        a, b = self.plain(e.left), self.plain(e.right)
        return self.known(STRING) if a in TEXT or b in TEXT else self.known(promoted(a, b)) if promoted(a, b) else None

    def of_other(self, e):
        if e.name in ("==", "!=", "<", ">", "<=", ">=", "&&", "||", "!", "instanceof"):
            return self.known("boolean")
        if e.name in ("-", "*", "/", "%", "&", "|", "^"):
            a, b = self.plain(e.left), self.plain(e.right)
            both = "boolean" if a == b == "boolean" else promoted(a, b)
            return self.known(both) if both else None
        if e.name in ("<<", ">>", "unary"):
            a = self.plain(e.left or e.children[0])
            return self.known(a if e.name == "unary" and a else promoted(a, "int")) if a in NUMBERS else None
        return None

    def of_ternary(self, e):
        a, b = self.term(e.children[1]), self.term(e.children[2])
        if a is not None and b is not None and b["type"] == NULL:
            return a
        if a is not None and a["type"] == NULL:
            return b
        if a is None or b is None or a == b:
            return a if a == b else None
        both = promoted(a["type"], b["type"])
        return self.known(both) if both else None

    def of_index(self, e):
        return self.element(self.term(e.left))

    def of_call(self, e):
        i = self.number.get(id(e))
        return None if i is None else {"type": None, "site": self.call(i, e), "deref": 0}

    def variable(self, name: str, line: int) -> tuple[bool, dict | None]:
        """Whether the name is a local variable, a parameter or a field at hand, and its term."""
        for scope in (self.method["locals"], self.method["params"]):
            found = [x for x in scope if x["name"] == name and x["line"] <= line]
            if found:
                return True, self.declared(found[-1])
        for _, t in self.chain:
            found = [x for x in t["fields"] if x["name"] == name]
            if found:
                own = self.variables if t is self.chain[0][1] else t["variables"]
                return True, self.known(self.written(found[-1]["type"], own))
        return False, None

    def declared(self, x: dict) -> dict | None:
        if x["type"] != "var":
            return self.of_type(x["type"])
        if x.get("each") is not None:
            return self.element(self.term(x["each"]))
        return self.term(x["init"]) if x.get("init") is not None else None

    def of_name(self, e):
        here, t = self.variable(e.name, e.line)
        if here:
            return t
        if not e.name[:1].isupper():
            return self.field(e.name, e.line, None)
        # a constant by its capitals, unless it is a type after all
        if len(e.name) > 1 and e.name.isupper():
            return self.field(e.name, e.line, None, self.written(e.name, {}))
        return self.known(self.written(e.name, {}))

    def of_field(self, e):
        target = e.target
        if target.kind == "this" and target.target is None:
            found = [f for f in self.chain[0][1]["fields"] if f["name"] == e.name]
            return self.of_type(found[-1]["type"]) if found else self.field(e.name, e.line, self.known(self.chain[0][0]))
        if target.kind == "super":
            return self.field(e.name, e.line, self.known(self.chain[0][0]))
        root = e
        while root.kind == "field":
            root = root.target
        if Tracer.qualified(e) and not self.variable(root.name, e.line)[0]:
            if e.name[:1].isupper() and not e.name.isupper():
                return self.known(self.written(e.text, {}))  # Outer.Inner or a package's type, by the habit of capitals
            if e.name.isupper():
                return self.field(e.name, e.line, self.term(target), self.written(e.text, {}))
        t = self.term(target)
        if t is None:
            return None
        if e.name == "length" and t["type"] is not None and t["type"].endswith("[]"):
            return self.known("int")
        return self.field(e.name, e.line, t)


# --- members of types -----------------------------------------------------------------------------


def shape(name: str, t: dict, outer: dict[str, str], saw) -> dict:
    """What other files need to know of a type. Names are as written; methods of enums and records that no one writes are there too."""
    from .tracer import erased

    own = {v: f"#{k}" for k, v in enumerate(t["variables"])}
    bounds = outer | t["variables"]

    def template(text: str) -> str:
        out = shown(text, {k: v for k, v in outer.items() if k not in own} | own)
        saw([n for n in names_in(out)])
        return out

    def plain(text: str, variables: dict[str, str]) -> str:
        out = erased(text, variables)
        saw([out.replace("[]", "")])
        return out

    def method(m: dict) -> dict:
        variables = bounds | m["variables"]
        params = m["params"]
        bound = {}
        for v in m["variables"]:
            for i, p in enumerate(params):
                if p["type"] in (v, f"Class<{v}>"):
                    bound[v] = f"@{i}" if p["type"] == v else f"@{i}!"
                    break
        returns = shown(m["returnType"], {k: x for k, x in bounds.items() if k not in own} | own | m["variables"] | bound)
        saw([n for n in names_in(returns)])
        return {
            "name": m["name"], "params": [plain(p["type"], variables) for p in params], "returns": returns, "erased": plain(m["returnType"], variables),
            "varargs": bool(params) and bool(params[-1].get("varargs")),
        }

    methods = [method(m) for m in t["methods"] if not m["isConstructor"]]
    made = lambda name, params, returns: {"name": name, "params": params, "returns": returns, "erased": returns, "varargs": False}
    if t["kind"] == "enum":
        methods += [made("values", [], t["name"] + "[]"), made("valueOf", [STRING], t["name"])]
        saw([t["name"]])
    if t["kind"] == "record":
        written = {(m["name"], len(m["params"])) for m in methods}
        components = [f for f in t["fields"] if f.get("annotations") is not None and "varargs" in f]
        methods += [method({"name": f["name"], "params": [], "returnType": f["type"], "variables": {}}) for f in components if (f["name"], 0) not in written]
    return {
        "name": name, "kind": t["kind"], "supers": [template(s) for s in t["supers"]],
        "fields": [{"name": f["name"], "type": template(f["type"])} for f in t["fields"]], "methods": methods,
    }
