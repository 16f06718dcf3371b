"""Java sources to facts: a tolerant parser that runs a file at a time in Python workers.

One row a file comes out, nested: package, imports, types with fields, methods and call sites. Values that rules ask for
(what an argument may be, its path by segments) are traced here too, since they need the syntax tree; names of types stay
as written and are resolved by joins (operators.resolve).
"""

from __future__ import annotations

import re

TOKEN = re.compile(
    r'(?P<ws>\s+)|(?P<doc>/\*\*(?!/).*?\*/)|(?P<com>//[^\n]*|/\*.*?\*/)|(?P<str>"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*")|(?P<chr>\'(?:\\.|[^\'\\\n])+\')'
    r"|(?P<num>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?)[lLfFdD]?)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)"
    r"|(?P<op>->|::|\.\.\.|\+\+|--|&&|\|\||[<>=!+\-*/&|^%]=|<<=?|[-+*/%&|^!~<>=?:;,.(){}\[\]@])",
    re.S,
)
MODIFIERS = ("public", "private", "protected", "static", "final", "abstract", "synchronized", "volatile", "transient", "native")
OTHER_MODIFIERS = {"default", "strictfp", "sealed"}
PRIMITIVES = {"boolean", "byte", "short", "int", "long", "char", "float", "double", "void"}
BINARY = {
    "=": 1, "+=": 1, "-=": 1, "*=": 1, "/=": 1, "&=": 1, "|=": 1, "^=": 1, "%=": 1, "<<=": 1, "?": 2, "||": 3, "&&": 4, "|": 5, "^": 6, "&": 7,
    "==": 8, "!=": 8, "<": 9, ">": 9, "<=": 9, ">=": 9, "instanceof": 9, "<<": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12,
}
ESCAPES = {"\n": "", "n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "s": " ", "0": "\0", '"': '"', "'": "'", "\\": "\\"}


class ParseError(Exception):
    pass


class Node:
    """An expression: kind, line, last line, text, and parts by kind."""

    __slots__ = ("kind", "line", "end", "text", "value", "target", "name", "args", "left", "right", "type", "nested", "children", "method")

    def __init__(self, kind, line, **parts):
        self.kind, self.line, self.end, self.text, self.nested, self.method = kind, line, line, "", False, None
        self.value = self.target = self.name = self.left = self.right = self.type = None
        self.args, self.children = [], []
        for k, v in parts.items():
            setattr(self, k, v)

    def below(self):
        return [x for x in (self.target, self.left, self.right, *self.args, *self.children) if isinstance(x, Node)]


def unescape(text: str) -> str:
    return re.sub(r"\\(u+[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1].lstrip("u"), 16)) if m[1][0] == "u" else ESCAPES.get(m[1], m[1]), text, flags=re.S)


def tokenize(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, line, first line of a doc comment before it or 0)."""
    out, at, line, doc = [], 0, 1, 0
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise ParseError(f"line {line}: unexpected {source[at]!r}")
        kind, text = m.lastgroup, m[0]
        if kind == "doc":
            doc = line
        elif kind not in ("ws", "com"):
            out.append((kind, text, line, doc))
            doc = 0
        line += text.count("\n")
        at = m.end()
    out.append(("end", "", line, 0))
    return out


class Parser:
    def __init__(self, source: str):
        self.t, self.i, self.frames, self.depth = tokenize(source), 0, [], 0

    # --- tokens

    def peek(self, k: int = 0) -> str:
        j = self.i + k
        return self.t[j][1] if j < len(self.t) and self.t[j][0] not in ("str", "chr") else ""

    def kind(self, k: int = 0) -> str:
        return self.t[min(self.i + k, len(self.t) - 1)][0]

    @property
    def line(self) -> int:
        return self.t[self.i][2]

    def next(self):
        tok = self.t[self.i]
        if tok[0] == "end":
            raise ParseError(f"line {tok[2]}: unexpected end")
        self.i += 1
        return tok

    def take(self, text: str) -> bool:
        if self.peek() == text and self.kind() != "end":
            self.i += 1
            return True
        return False

    def need(self, text: str):
        if not self.take(text):
            raise ParseError(f"line {self.line}: {text} expected before {self.t[self.i][1]!r}")

    def ident(self) -> str:
        if self.kind() != "id":
            raise ParseError(f"line {self.line}: name expected before {self.t[self.i][1]!r}")
        return self.next()[1]

    def dotted(self) -> str:
        out = self.ident()
        while self.peek() == "." and self.kind(1) == "id":
            self.i += 1
            out += "." + self.ident()
        return out

    def skip_to_close(self, opening: str, closing: str):
        """Past the bracket that closes the one at hand."""
        depth = 0
        while True:
            x = self.peek()
            self.next()
            depth += (x == opening) - (x == closing)
            if not depth:
                return

    # --- types and annotations

    def type(self) -> str:
        while self.peek() == "@" and self.peek(1) != "interface":
            self.annotation()
        if self.take("?"):
            if self.peek() in ("extends", "super"):
                self.i += 1
                return self.type()
            return "?"
        out = self.ident()
        if out in ("new", "return", "this", "super", "instanceof", "throw", "else", "case"):
            raise ParseError(f"line {self.line}: no type")
        out += self.type_args()
        while self.peek() == "." and self.kind(1) == "id":
            self.i += 1
            out += "." + self.ident() + self.type_args()
        while self.peek() == "[" and self.peek(1) == "]":
            self.i += 2
            out += "[]"
        return out

    def type_args(self) -> str:
        if self.peek() != "<":
            return ""
        self.i += 1
        parts = []
        while self.peek() != ">":
            parts.append(self.type())
            while self.take("&"):
                self.type()
            if not self.take(",") and self.peek() != ">":
                raise ParseError(f"line {self.line}: no type arguments")
        self.i += 1
        return "<" + ",".join(parts) + ">"

    def type_params(self) -> dict[str, str]:
        """Type variable -> its first bound as written, else Object."""
        out = {}
        if self.take("<"):
            while not self.take(">"):
                while self.peek() == "@":
                    self.annotation()
                name, bound = self.ident(), "java.lang.Object"
                if self.take("extends"):
                    bound = self.type()
                    while self.take("&"):
                        self.type()
                out[name] = bound
                self.take(",")
        return out

    def annotation(self) -> dict:
        """Name without package, and its attributes that are string literals."""
        self.need("@")
        name, attributes = self.dotted().rpartition(".")[2], {}
        if self.take("("):
            while not self.take(")"):
                key = "value"
                if self.kind() == "id" and self.peek(1) == "=":
                    key = self.ident()
                    self.i += 1
                if self.peek() == "{":
                    self.skip_to_close("{", "}")
                elif self.peek() == "@":
                    self.annotation()
                else:
                    e = self.expression(2)
                    if e.kind == "str":
                        attributes[key] = e.value
                self.take(",")
        return {"name": name, "attributes": attributes}

    def modifiers(self):
        """(modifiers in fixed order, annotations, first line with doc comment)."""
        found, notes, first = set(), [], None
        while True:
            if first is None:
                first = self.t[self.i][3] or self.line
            x = self.peek()
            if x == "@" and self.peek(1) != "interface":
                notes.append(self.annotation())
            elif x in MODIFIERS or x in OTHER_MODIFIERS and self.peek(1) not in (":", "->", "("):
                found.add(x)
                self.i += 1
            elif x == "non" and self.peek(1) == "-":
                self.i += 3
            else:
                return [m for m in MODIFIERS if m in found], notes, first

    # --- declarations

    def unit(self) -> dict:
        out = {"package": None, "imports": [], "types": []}
        start = self.i
        self.modifiers()
        if self.take("package"):
            out["package"] = self.dotted()
            self.need(";")
        else:
            self.i = start
        while self.peek() == "import":
            self.i += 1
            static, name = self.take("static"), self.dotted()
            star = False
            if self.take("."):
                self.need("*")
                star = True
            self.need(";")
            out["imports"].append({"name": name, "isStatic": static, "isStar": star})
        while self.kind() != "end":
            if self.take(";"):
                continue
            out["types"].append(self.type_declaration())
        return out

    def starts_type(self) -> bool:
        return self.peek() in ("class", "interface", "enum") or self.peek() == "@" and self.peek(1) == "interface" or self.peek() == "record" and self.kind(1) == "id" and self.peek(2) in ("(", "<")

    def type_declaration(self, head=None) -> dict:
        modifiers, notes, first = head or self.modifiers()
        if not self.starts_type():
            raise ParseError(f"line {self.line}: declaration expected before {self.t[self.i][1]!r}")
        if self.take("@"):
            self.need("interface")
            kind = "annotation"
        else:
            kind = self.next()[1]
        t = {"name": self.ident(), "kind": kind, "modifiers": modifiers, "annotations": notes, "line": first, "supers": [], "fields": [], "methods": [], "types": []}
        t["variables"] = self.type_params()
        if kind == "record":
            t["fields"] = [p | {"init": None} for p in self.parameters()]
        while self.peek() in ("extends", "implements", "permits"):
            word = self.next()[1]
            while True:
                name = self.type()
                if word != "permits":
                    t["supers"].append(name)
                if not self.take(","):
                    break
        self.body(t, kind == "enum")
        t["endLine"] = self.t[self.i - 1][2]
        return t

    def body(self, t: dict, enum: bool = False):
        self.need("{")
        if enum:
            while self.kind() == "id" or self.peek() == "@":
                while self.peek() == "@":
                    self.annotation()
                t["fields"].append({"name": self.ident(), "type": t["name"], "annotations": [], "line": self.line, "init": None})
                if self.peek() == "(":
                    self.arguments()
                if self.peek() == "{":
                    self.skip_to_close("{", "}")
                if not self.take(","):
                    break
            self.take(";")
        while not self.take("}"):
            if self.take(";"):
                continue
            self.member(t)

    def parameters(self) -> list[dict]:
        out = []
        self.need("(")
        while not self.take(")"):
            _, notes, _ = self.modifiers()
            line, kind = self.line, self.type()
            varargs = self.take("...")
            if varargs:
                kind += "[]"
            name = "this" if self.take("this") else self.dotted()
            while self.take("["):
                self.need("]")
                kind += "[]"
            out.append({"name": name, "type": kind, "annotations": notes, "line": line, "varargs": varargs})
            self.take(",")
        return out

    def member(self, t: dict):
        modifiers, notes, first = self.modifiers()
        if self.starts_type():
            t["types"].append(self.type_declaration((modifiers, notes, first)))
            return
        if self.peek() == "{":  # an initializer: its calls belong to no method
            self.scoped(None, self.block)
            return
        variables = self.type_params()
        if self.kind() == "id" and self.peek(1) in ("(", "{") and self.peek() == t["name"]:
            name, kind = self.ident(), "void"
            method = self.method(name, kind, modifiers, notes, first, variables, True, compact=self.peek() == "{")
            t["methods"].append(method)
            return
        kind, name = self.type(), self.ident()
        if self.peek() == "(":
            t["methods"].append(self.method(name, kind, modifiers, notes, first, variables, False))
            return
        while True:
            own = kind
            line = self.line
            while self.take("["):
                self.need("]")
                own += "[]"
            init = None
            if self.take("="):
                init = self.scoped(None, self.initializer)
            t["fields"].append({"name": name, "type": own, "annotations": notes, "line": line, "init": init})
            if not self.take(","):
                break
            name = self.ident()
        self.need(";")

    def method(self, name, kind, modifiers, notes, first, variables, constructor, compact=False) -> dict:
        m = {"name": name, "returnType": kind, "modifiers": modifiers, "annotations": notes, "line": first, "isConstructor": constructor, "variables": variables}
        m["params"] = [] if compact else self.parameters()
        m["params"] = [p for p in m["params"] if p["name"] != "this"]
        if self.current is not None:  # a method of an anonymous or local type: its calls are the outer one's
            self.current["locals"] += [{"name": p["name"], "type": p["type"], "line": p["line"], "init": None, "top": False} for p in m["params"]]
        while self.take("["):
            self.need("]")
            m["returnType"] += "[]"
        if self.take("throws"):
            self.type()
            while self.take(","):
                self.type()
        m["calls"], m["locals"], m["assigns"] = [], [], []
        if self.take("default"):
            self.scoped(None, lambda: self.skip_to_close("{", "}") if self.peek() == "{" else self.annotation() if self.peek() == "@" else self.expression())
        if self.peek() == "{":
            self.scoped(m, self.block)
        else:
            self.need(";")
        m["endLine"] = self.t[self.i - 1][2]
        return m

    def scoped(self, method, run):
        """Run with a method that collects calls, or none."""
        self.frames.append((method, self.depth))
        self.depth = 0
        try:
            return run()
        finally:
            self.depth = self.frames.pop()[1]

    @property
    def current(self):
        """The method that calls here belong to: the outer one, also inside anonymous and local types."""
        for m, _ in self.frames:
            if m is not None:
                return m
        return None

    @property
    def nested(self) -> bool:
        return sum(m is not None for m, _ in self.frames) > 1

    # --- statements

    def block(self):
        self.need("{")
        self.depth += 1
        while not self.take("}"):
            self.statement()
        self.depth -= 1

    def declaration(self, ends=("=", ";", ",", ":")) -> bool:
        """A local variable declaration, if one stands here."""
        start = self.i
        try:
            self.modifiers()
            kind = self.type()
            if self.kind() != "id" or self.peek() == "instanceof" or self.peek(1) not in (*ends, "["):
                raise ParseError("")
        except ParseError:
            self.i = start
            return False
        while True:
            line, name, own = self.line, self.ident(), kind
            while self.take("["):
                self.need("]")
                own += "[]"
            init = self.initializer() if self.take("=") else None
            if self.current is not None:
                self.current["locals"].append({"name": name, "type": own, "line": line, "init": init, "top": self.depth == 1 and not self.nested})
            if not self.take(","):
                return True

    def initializer(self) -> Node:
        if self.peek() == "{":
            return self.array()
        return self.expression()

    def array(self) -> Node:
        n = Node("other", self.line)
        self.need("{")
        while not self.take("}"):
            n.children.append(self.initializer())
            self.take(",")
        return n

    def statement(self):
        x = self.peek()
        if x == "{":
            self.block()
        elif x == ";":
            self.i += 1
        elif x in ("if", "while"):
            self.i += 1
            self.condition()
            self.statement()
            if x == "if" and self.take("else"):
                self.statement()
        elif x == "for":
            self.i += 1
            self.need("(")
            self.depth += 1
            if not self.take(";"):
                if self.declaration():
                    if self.take(":"):
                        each = self.expression()
                        if self.current is not None:
                            self.current["locals"][-1]["each"] = each
                        self.need(")")
                        self.statement()
                        self.depth -= 1
                        return
                else:
                    self.expressions()
                self.need(";")
            if not self.take(";"):
                self.expression()
                self.need(";")
            if self.peek() != ")":
                self.expressions()
            self.need(")")
            self.statement()
            self.depth -= 1
        elif x == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif x == "try":
            self.i += 1
            self.depth += 1
            if self.take("("):
                while not self.take(")"):
                    if not self.declaration():
                        self.expression()
                    self.take(";")
            self.block()
            while self.take("catch"):
                self.need("(")
                self.modifiers()
                kind = self.type()
                while self.take("|"):
                    self.type()
                name = self.ident()
                if self.current is not None:
                    self.current["locals"].append({"name": name, "type": kind, "line": self.line, "init": None, "top": False})
                self.need(")")
                self.block()
            if self.take("finally"):
                self.block()
            self.depth -= 1
        elif x == "switch":
            self.switch()
            self.take(";")
        elif x == "synchronized" and self.peek(1) == "(":
            self.i += 1
            self.condition()
            self.block()
        elif x in ("return", "throw", "yield") and not (x == "yield" and self.peek(1) in ("=", ".", "(")):
            self.i += 1
            if self.peek() != ";":
                self.expression()
            self.need(";")
        elif x in ("break", "continue"):
            self.i += 1
            if self.kind() == "id":
                self.i += 1
            self.need(";")
        elif x == "assert":
            self.i += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.need(";")
        elif self.kind() == "id" and self.peek(1) == ":" and self.peek(2) != ":":
            self.i += 2
            self.statement()
        else:
            start = self.i
            if x == "@" or x in MODIFIERS or self.starts_type():
                head = self.modifiers()
                if self.starts_type():
                    self.type_declaration(head)
                    return
                self.i = start
            if not self.declaration(("=", ";", ",")):
                self.expression()
            self.need(";")

    def condition(self):
        self.need("(")
        self.expression()
        self.need(")")

    def expressions(self):
        self.expression()
        while self.take(","):
            self.expression()

    def switch(self) -> Node:
        n = Node("other", self.line)
        self.need("switch")
        self.condition()
        self.need("{")
        self.depth += 1
        while not self.take("}"):
            if self.take("case"):
                while self.peek() not in (":", "->"):
                    if self.take("default") or self.take(","):
                        continue
                    if not self.pattern():
                        self.expression(3)
                    if self.take("when"):
                        self.expression(3)
            else:
                self.need("default")
            if self.take("->"):
                if self.peek() == "{":
                    self.block()
                elif self.peek() == "throw":
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while self.peek() not in ("case", "default", "}"):
                    self.statement()
        self.depth -= 1
        return n

    def pattern(self) -> bool:
        start = self.i
        try:
            self.modifiers()
            kind = self.type()
            if self.kind() == "id" and self.peek(1) in ("->", ":", "when", ")", "&&", "||", "?", ",", ";"):
                name = self.ident()
                if self.current is not None:
                    self.current["locals"].append({"name": name, "type": kind, "line": self.line, "init": None, "top": False})
                return True
        except ParseError:
            pass
        self.i = start
        return False

    # --- expressions

    def expression(self, least: int = 1) -> Node:
        start = self.i
        left = self.unary()
        while True:
            op = self.peek()
            if op == ">" and self.peek(1) == ">" and least <= 10 and self.t[self.i][2] == self.t[self.i + 1][2]:
                self.i += 2
                self.take(">")
                self.take("=")
                left = Node("other", left.line, name=">>", children=[left, self.expression(11)])
            elif op not in BINARY or BINARY[op] < least or self.kind() not in ("op", "id"):
                break
            elif op == "?":
                self.i += 1
                a = self.expression()
                self.need(":")
                left = Node("ternary", left.line, children=[left, a, self.expression(2)])
            elif op == "instanceof":
                self.i += 1
                if not self.pattern():
                    self.take("final")
                    self.type()
                    if self.kind() == "id" and self.peek() not in BINARY:
                        self.ident()
                left = Node("other", left.line, name=op, children=[left])
            elif BINARY[op] == 1:
                self.i += 1
                right = self.expression()
                node = Node("assign", left.line, left=left, right=right, name=op)
                if op == "=" and self.current is not None and not self.nested:
                    self.current["assigns"].append(node)
                left = node
            else:
                self.i += 1
                left = Node("plus" if op == "+" else "other", left.line, name=op, left=left, right=self.expression(BINARY[op] + 1))
            self.finish(left, start)
        self.finish(left, start)
        return left

    def finish(self, node: Node, start: int):
        if not node.text:
            node.text = "".join(x[1] + (" " if x[1] in ("new", "instanceof") else "") for x in self.t[start : self.i])
            node.end = self.t[self.i - 1][2]

    def unary(self) -> Node:
        start, line, x = self.i, self.line, self.peek()
        if x in ("+", "-", "!", "~", "++", "--"):
            self.i += 1
            n = Node("other", line, name="!" if x == "!" else "unary", children=[self.unary()])
            self.finish(n, start)
            return n
        if x == "(":
            if self.closes_before_arrow():
                return self.lambda_()
            if (kind := self.cast()) is not None:
                e = self.lambda_() if self.peek() == "(" and self.closes_before_arrow() or self.kind() == "id" and self.peek(1) == "->" else self.unary()
                n = Node("cast", line, type=kind, children=[e])
                self.finish(n, start)
                return n
        return self.postfix(self.primary(), start)

    def closes_before_arrow(self) -> bool:
        depth, j = 0, self.i
        while j < len(self.t):
            x = self.t[j][1] if self.t[j][0] == "op" else ""
            depth += (x == "(") - (x == ")")
            if not depth:
                return self.t[j + 1][1] == "->" if j + 1 < len(self.t) else False
            j += 1
        return False

    def cast(self) -> str | None:
        start = self.i
        try:
            self.need("(")
            kind = self.type()
            while self.take("&"):
                self.type()
            self.need(")")
            simple = kind.split("[")[0] in PRIMITIVES
            if simple or self.kind() in ("id", "str", "chr", "num") and self.peek() != "instanceof" or self.peek() in ("(", "!", "~"):
                return kind
        except ParseError:
            pass
        self.i = start
        return None

    def lambda_(self) -> Node:
        n = Node("lambda", self.line)
        start = self.i
        for p in self.lambda_parameters():
            if self.current is not None:
                self.current["locals"].append(p | {"init": None, "top": False})
        self.need("->")
        if self.peek() == "{":
            self.depth += 1
            self.block()
            self.depth -= 1
        else:
            n.children.append(self.expression())
        self.finish(n, start)
        return n

    def lambda_parameters(self) -> list[dict]:
        line = self.line
        if self.peek() != "(":
            return [{"name": self.ident(), "type": "var", "line": line}]
        start, names = self.i, []
        self.i += 1
        while self.kind() == "id" and self.peek(1) in (",", ")"):
            names.append({"name": self.ident(), "type": "var", "line": line})
            self.take(",")
        if self.take(")"):
            return names
        self.i = start
        try:
            return [{"name": p["name"], "type": p["type"], "line": line} for p in self.parameters()]
        except ParseError:
            self.i = start
            self.skip_to_close("(", ")")
            return []

    def arguments(self) -> list[Node]:
        out = []
        self.need("(")
        while not self.take(")"):
            out.append(self.expression())
            if not self.take(",") and self.peek() != ")":
                raise ParseError(f"line {self.line}: , or ) expected before {self.t[self.i][1]!r}")
        return out

    def call(self, target: Node | None, name: str, line: int, start: int) -> Node:
        n = Node("call", line, target=target, name=name, nested=self.nested)
        if self.current is not None:
            self.current["calls"].append(n)
        n.args = self.arguments()
        self.finish(n, start)
        return n

    def primary(self) -> Node:
        start, kind, line = self.i, self.kind(), self.line
        text = self.t[self.i][1]
        if kind in ("str", "chr", "num"):
            self.i += 1
            if kind == "str" and text.startswith('"""'):
                body = text[3:-3].partition("\n")[2]
                lines = body.split("\n")
                margin = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
                margin = min(margin, len(lines[-1]) - len(lines[-1].lstrip())) if not lines[-1].strip() else margin
                value = unescape("\n".join(x[margin:].rstrip() for x in lines))
            else:
                value = unescape(text[1:-1]) if kind == "str" else text
            n = Node(kind, line, value=value)
        elif text == "(":
            self.i += 1
            n = Node("paren", line, left=self.expression())
            self.need(")")
        elif text == "new":
            self.i += 1
            while self.peek() == "@":
                self.annotation()
            name = self.dotted() + (self.type_args() if self.peek(1) != ">" else "")
            if self.peek() == "<":
                self.skip_to_close("<", ">")
            n = Node("new", line, type=name)
            if self.peek() == "(":
                n.args = self.arguments()
                if self.peek() == "{":
                    self.body({"name": "", "fields": [], "methods": [], "types": []})
            else:
                while self.take("["):
                    n.type += "[]"
                    if self.peek() != "]":
                        n.children.append(self.expression())
                    self.need("]")
                if self.peek() == "{":
                    n.children.append(self.array())
        elif text == "switch":
            n = self.switch()
        elif text in ("this", "super"):
            self.i += 1
            n = Node(text, line)
            if self.peek() == "(":  # a constructor's own call of another: not a method invocation
                n = Node("other", line, children=self.arguments())
        elif text in ("true", "false", "null"):
            self.i += 1
            n = Node("const", line, value=text)
        elif kind == "id":
            if self.peek(1) == "->":
                return self.lambda_()
            self.i += 1
            if self.peek() == "(":
                return self.call(None, text, line, start)
            if text in PRIMITIVES or self.peek() == "[" and self.peek(1) == "]":
                while self.take("["):
                    self.need("]")
                n = Node("other", line)
            else:
                n = Node("name", line, name=text)
                mark = self.i
                if self.peek() == "<":  # a generic type before ::
                    try:
                        self.type_args()
                        if self.peek() != "::":
                            raise ParseError("")
                    except ParseError:
                        self.i = mark
        else:
            raise ParseError(f"line {line}: expression expected before {text!r}")
        self.finish(n, start)
        return n

    def postfix(self, n: Node, start: int) -> Node:
        while True:
            if self.peek() == "." and self.kind() == "op":
                self.i += 1
                if self.peek() == "<":
                    self.type_args()
                if self.peek() == "new":
                    n = Node("other", n.line, children=[n, self.primary()])
                elif self.peek() in ("this", "class", "super") and self.kind() == "id":
                    word = self.next()[1]
                    n = Node(word, n.line, target=n)
                else:
                    name = self.ident()
                    n = self.call(n, name, n.line, start) if self.peek() == "(" else Node("field", n.line, target=n, name=name)
            elif self.peek() == "[":
                self.i += 1
                n = Node("index", n.line, left=n, children=[self.expression()])
                self.need("]")
            elif self.peek() in ("++", "--"):
                self.i += 1
                n = Node("other", n.line, name="unary", children=[n])
            elif self.peek() == "::":
                self.i += 1
                if self.peek() == "<":
                    self.type_args()
                self.next()
                n = Node("reference", n.line, children=[n])
            else:
                return n
            self.finish(n, start)


def parse(source: str) -> dict:
    return Parser(source).unit()
