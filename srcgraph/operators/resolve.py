"""Types as other files see them, and the member that each call or field access reaches: joins, a level of nested expressions at a time.

Expressions are SQL text: a large Column tree costs more to build from Python than a small batch costs to run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.terms import CLASS, LAMBDA, NULL, STRING
from . import facts as A
from . import graph as G
from .staging import staged, values

OBJECT = "java.lang.Object"
#: Type variables of a type, at most.
VARIABLES = 10
#: Boxes of primitive types, what every text and box is, and the order of widening.
BOXES = {
    "boolean": "java.lang.Boolean", "byte": "java.lang.Byte", "short": "java.lang.Short", "char": "java.lang.Character", "int": "java.lang.Integer",
    "long": "java.lang.Long", "float": "java.lang.Float", "double": "java.lang.Double",
}
FINAL = (STRING, *BOXES.values())
SUPERS = ("java.lang.CharSequence", "java.lang.Number", "java.lang.Comparable", "java.io.Serializable", "java.lang.constant.Constable")
WIDENING = {"byte": 0, "short": 1, "char": 1, "int": 2, "long": 3, "float": 4, "double": 5}
#: Costs: an argument of unknown type, one that may fit, boxing, a variable number of arguments.
UNSEEN, MAYBE, BOXED, SPREAD = 40, 50, 100_000, 100_000_000

ARGUMENT = r"[^<>,]+(?:<[^<>]*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>[^<>]*)*>)?(?:\\[\\])*"


# --- types as text: SQL of SQL --------------------------------------------------------------------


def texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def mapped(pairs: dict) -> str:
    return "map(" + ", ".join(f"'{k}', {v}" if isinstance(v, int) else f"'{k}', '{v}'" for k, v in pairs.items()) + ")"


def head(t: str) -> str:
    """A type without its arguments; any dimensions of an array as one []."""
    return rf"regexp_replace(regexp_replace({t}, '<.*>', ''), '(?:\\[\\])+', '[]')"


def type_arguments(t: str) -> str:
    return f"regexp_extract_all(regexp_extract({t}, '^[^<]*<(.*)>$', 1), '{ARGUMENT}', 0)"


def element(t: str) -> str:
    """What an array or a collection holds."""
    return rf"if(endswith({t}, '[]'), regexp_replace({t}, '\\[\\]$', ''), get({type_arguments(t)}, 0))"


def replaced(text: str, marks: str, by: str) -> str:
    """text with each of the marks by the value at its place."""
    return f"aggregate(zip_with({marks}, {by}, (m, v) -> struct(m, coalesce(v, '{OBJECT}') AS v)), {text}, (t, x) -> replace(t, x.m, x.v))"


def filled(template: str, args: str) -> str:
    """A template with args for its variables; without args as it is."""
    places = f"sequence(0, {VARIABLES - 1})"
    full = replaced(f"replace({template}, '#', '~')", f"transform({places}, k -> concat('~', k))", f"transform({places}, k -> get({args}, k))")
    return f"if({args} IS NULL OR instr({template}, '#') = 0, {template}, {full})"


def written(t: str) -> str:
    """A type with its arguments, each name qualified by the file's map."""
    return rf"array_join(transform(split({t}, '(?<=[<>,\\[\\]])|(?=[<>,\\[\\]])'), p -> coalesce(try_element_at(known, p), p)), '')"


def looked_up(t: str) -> str:
    """A plain type qualified by the file's map; arrays keep one []."""
    return f"concat(coalesce(try_element_at(known, replace({t}, '[]', '')), replace({t}, '[]', '')), if(endswith({t}, '[]'), '[]', ''))"


def member_id(owner: str, name: str, params: str) -> str:
    return f"concat({owner}, '.', {name}, '(', array_join({params}, ','), ')')"


# --- shapes ---------------------------------------------------------------------------------------


def shapes(known: DataFrame, world: World | None = None) -> DataFrame:
    """schema.SHAPES rows of the files read; world: the types of other files, which may be ancestors."""
    s = known.select("projectFilePath", "package", "known", F.explode("shapes").alias("s"))
    rows = s.selectExpr(
        "concat_ws('.', package, s.name) AS id",
        "projectFilePath",
        "s.kind AS kind",
        f"transform(s.supers, t -> {written('t')}) AS supers",
        f"transform(s.fields, f -> named_struct('name', f.name, 'type', {written('f.type')})) AS fields",
        f"transform(s.methods, m -> named_struct('name', m.name, 'params', transform(m.params, t -> {looked_up('t')}), 'returns', {written('m.returns')}, 'erased', {looked_up('m.erased')}, 'varargs', m.varargs)) AS methods",
    )
    rows = staged(G.first_by(rows, ["id"], ["projectFilePath"]), "shapes-own")
    up = ancestors(rows, world).groupBy("id").agg(F.expr("sort_array(collect_list(struct(depth, name, args)))").alias("a"))
    return rows.join(up, "id").withColumn("ancestors", F.expr("transform(a, x -> named_struct('name', x.name, 'depth', x.depth, 'args', x.args))")).select(*schema.SHAPES.names)


def ancestors(own: DataFrame, world: World | None = None) -> DataFrame:
    """(id, name, depth, args): each type itself and all that it extends or implements, with the fewest steps to it and its type arguments."""
    direct = own.select("id", F.explode("supers").alias("s")).selectExpr("id", f"{head('s')} AS name", f"{type_arguments('s')} AS args")
    out = own.selectExpr("id", "id AS name", "0 AS depth", "CAST(NULL AS array<string>) AS args")
    last, i = direct.selectExpr("id", "name", "args", "1 AS depth"), 1
    up = direct.selectExpr("id AS name", "name AS above", "args AS more")
    while True:  # pairs that were met before go no further, so cycles end
        fresh = last.groupBy("id", "name").agg(F.expr("min(struct(depth, args))").alias("b")).selectExpr("id", "name", "b.depth", "b.args")
        last = staged(fresh.join(out, ["id", "name"], "left_anti"), f"ancestors-{i}")
        if last.isEmpty():
            break
        out, i = out.unionByName(last), i + 1
        last = last.join(up, "name").selectExpr("id", "above AS name", f"transform(more, t -> {filled('t', 'args')}) AS args", "depth + 1 AS depth")
    if world is None:
        return out
    above = world.of(out.select("name")).select(F.col("id").alias("name"), F.explode("ancestors").alias("a")).where("a.depth > 0")
    far = out.join(above, "name").selectExpr("id", "a.name AS name", "depth + a.depth AS depth", f"transform(a.args, t -> {filled('t', 'args')}) AS args")
    return out.unionByName(far).groupBy("id", "name").agg(F.expr("min(struct(depth, args))").alias("b")).selectExpr("id", "name", "b.depth", "b.args")


class World:
    """Shapes of the types that a batch leaves alone. few: the batch is small, so what it asks for is collected by literal ids
    that reach the scan; otherwise everything is joined."""

    def __init__(self, rows: DataFrame, few: bool = False):
        self.rows, self.few = rows, few

    def of(self, ids: DataFrame) -> DataFrame:
        """At least the shapes of ids (one column) and of their ancestors."""
        if not self.few:
            return self.rows
        wanted = values(ids)
        first = staged(self.rows.where(F.col("id").isin(wanted)), "world")
        above = [x for x in values(first.select(F.explode("ancestors.name"))) if x not in set(wanted)]
        return first.unionByName(staged(self.rows.where(F.col("id").isin(above)), "world-above")) if above else first

    def named(self, simple: DataFrame) -> DataFrame:
        """At least the ids of the types with a simple name (one column), as (id)."""
        rows = self.rows.select("id")
        return rows if not self.few else staged(rows.where(F.substring_index("id", ".", -1).isin(values(simple))), "world-named")


def members_of(shapes: DataFrame, symbols: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(owner, ancestor, depth, upArgs), and the members (ancestor, name, field, params, returns, erased, varargs, targetId, fromSource)."""
    up = shapes.select(F.col("id").alias("owner"), F.explode("ancestors").alias("a")).selectExpr("owner", "a.name AS ancestor", "a.depth", "a.args AS upArgs")
    every = f"concat(transform(methods, m -> named_struct('name', m.name, 'field', false, 'params', m.params, 'returns', m.returns, 'erased', m.erased, 'varargs', m.varargs, 'targetId', {member_id('id', 'm.name', 'm.params')})),"
    every += f" transform(fields, f -> named_struct('name', f.name, 'field', true, 'params', CAST(NULL AS array<string>), 'returns', f.type, 'erased', {head('f.type')}, 'varargs', false, 'targetId', concat(id, '.', f.name))))"
    rows = shapes.selectExpr("id AS ancestor", f"inline({every})").withColumn("fromSource", F.lit(True))
    if symbols is not None:
        has = set(symbols.columns)
        more = symbols.selectExpr(
            "owner AS ancestor", "name", "false AS field", "params", "returnType AS returns", "returnType AS erased", "varargs" if "varargs" in has else "false AS varargs",
            f"{member_id('owner', 'name', 'params')} AS targetId", "coalesce(fromSource, false) AS fromSource" if "fromSource" in has else "false AS fromSource",
        )
        rows = rows.unionByName(more.dropDuplicates(["targetId"]).join(rows.select("targetId"), "targetId", "left_anti").select(*rows.columns))
        outside = symbols.select("owner").distinct().join(shapes.select(F.col("id").alias("owner")), "owner", "left_anti")
        up = up.unionByName(outside.selectExpr("owner", "owner AS ancestor", "0 AS depth", "CAST(NULL AS array<string>) AS upArgs"))
    return up, rows


# --- fit of arguments -----------------------------------------------------------------------------


def fit(a: str, p: str) -> str:
    """How far an argument's type is from a parameter's; null where it cannot be passed. The column above holds (type, ancestor -> steps), with ?
    where some ancestors are not known."""
    plain = lambda t: f"{t} IN ({texts(A.PRIMITIVES)})"
    array = lambda t: f"endswith({t}, '[]')"
    bare = lambda t: f"substring_index({t}, '[', 1)"
    order = lambda t: f"try_element_at({mapped(WIDENING)}, {t})"
    widened = lambda x: f"CASE WHEN {order(x)} < {order(p)} AND {p} <> 'char' THEN {order(p)} - {order(x)} END"
    unboxed = f"try_element_at({mapped({v: k for k, v in BOXES.items()})}, {a})"
    mine = f"get(filter(above, u -> u.id = {a}), 0).up"
    final, supers = texts(FINAL), texts(SUPERS)
    return f"""CASE
      WHEN {a} IS NULL THEN {UNSEEN}
      WHEN {a} = {p} THEN 0
      WHEN {a} = '{NULL}' THEN CASE WHEN {plain(p)} THEN NULL WHEN {p} = '{OBJECT}' THEN 100 ELSE {UNSEEN} END
      WHEN {a} = '{LAMBDA}' THEN CASE WHEN {plain(p)} OR {array(p)} OR {p} IN ('{OBJECT}', '{CLASS}', {final}) THEN NULL ELSE {UNSEEN} END
      WHEN {plain(a)} AND {plain(p)} THEN {widened(a)}
      WHEN {plain(a)} THEN CASE WHEN try_element_at({mapped(BOXES)}, {a}) = {p} THEN {BOXED} WHEN {p} = '{OBJECT}' THEN {BOXED + 100} WHEN {p} IN ({supers}) THEN {BOXED + 10} END
      WHEN {plain(p)} THEN CASE WHEN {unboxed} = {p} THEN {BOXED} WHEN {unboxed} IS NOT NULL THEN {BOXED} + {widened(unboxed)} WHEN {a} = '{OBJECT}' THEN {BOXED + 200} END
      WHEN {p} = '{OBJECT}' THEN 100
      WHEN {array(a)} <> {array(p)} THEN CASE WHEN {a} = '{OBJECT}' THEN {MAYBE + 20} WHEN {array(a)} AND {p} IN ('java.lang.Cloneable', 'java.io.Serializable') THEN 10 END
      WHEN {array(a)} THEN CASE WHEN NOT {plain(bare(a))} AND NOT {plain(bare(p))} THEN 30 END
      WHEN {a} IN ({final}) THEN CASE WHEN {p} IN ({supers}) THEN 10 END
      WHEN {p} IN ({final}) THEN CASE WHEN {a} = '{OBJECT}' THEN {MAYBE + 20} END
      WHEN try_element_at({mine}, {p}) IS NOT NULL THEN try_element_at({mine}, {p})
      WHEN {mine} IS NOT NULL AND try_element_at({mine}, '?') IS NULL THEN NULL
      ELSE {MAYBE} END"""


def distance() -> str:
    """How far argHeads are from params, by the phases of Java: as they are, boxed, as a variable number; null: not applicable."""
    n, k = "size(argHeads)", "size(params)"
    last = rf"regexp_replace(get(params, {k} - 1), '\\[\\]$', '')"
    spread = f"concat(slice(params, 1, greatest({k} - 1, 0)), array_repeat({last}, greatest({n} - {k} + 1, 0)))"
    ways = f"array(named_struct('open', {n} = {k}, 'more', 0L, 'p', params), named_struct('open', varargs AND {k} > 0 AND {n} >= {k} - 1, 'more', {SPREAD}L, 'p', {spread}))"
    return f"array_min(transform(filter({ways}, w -> w.open), w -> aggregate(zip_with(argHeads, w.p, (x, y) -> CAST({fit('x', 'y')} AS bigint)), w.more, (s, x) -> s + x)))"


# --- sites ----------------------------------------------------------------------------------------

KEY = ["projectFilePath", "callerId", "at"]


def sites_of(method: DataFrame) -> DataFrame:
    """A row a site, with its types qualified."""
    term = lambda t: f"named_struct('type', {written(f'{t}.type')}, 'site', {t}.site, 'deref', {t}.deref)"
    return method.select("projectFilePath", "known", F.col("id").alias("callerId"), F.explode("m.sites").alias("s")).selectExpr(
        *KEY[:2], "s.at", "s.field", "s.name", "s.line", "s.level", "s.viaSuper", f"if(s.receiver IS NULL, NULL, {term('s.receiver')}) AS receiver",
        f"transform(s.scopes, x -> named_struct('rank', x.rank, 'type', {written('x.type')})) AS scopes", f"transform(s.args, x -> {term('x')}) AS args", f"{written('s.orType')} AS orType",
    )


def resolve_sites(method: DataFrame, own: DataFrame, world: World | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """A row a site: (projectFilePath, callerId, at, field, name, line, ownerType, targetId, owner, fromSource, returns, reason).

    own: shapes of the files read. Owners are the receiver's type or the types around the call; candidates come by (owner, its ancestors) and
    (ancestor, name). The scope that has the name counts; then the nearest fit of arguments, then the nearest ancestor. Two left, of
    different parameters, are no target. reason says why a site has none: no receiver type, no member, or several.
    """
    sites = staged(sites_of(method), "sites")
    levels = sites.agg(F.max("level")).first()[0]
    done: list[DataFrame] = []
    for level in range(1 + (levels or 0)):
        s = sites.where(F.col("level") == level)
        if done:
            types = reduce(DataFrame.unionByName, done).where("returns IS NOT NULL").groupBy(*KEY[:2]).agg(F.expr("collect_list(struct(at, returns))").alias("types"))
            s = s.join(types, KEY[:2], "left")
        else:
            s = s.withColumn("types", F.expr("CAST(NULL AS array<struct<at:int,returns:string>>)"))
        # one element at a time: most terms have none
        value = lambda t: f"aggregate(array_repeat(0, {t}.deref), coalesce({t}.type, get(filter(types, y -> y.at = {t}.site), 0).returns), (e, i) -> {element('e')})"
        s = s.selectExpr(*KEY, "field", "name", "line", "viaSuper", "receiver IS NOT NULL AS hasReceiver", "scopes", "orType", f"{value('receiver')} AS ownerType", f"transform(args, x -> {value('x')}) AS argTypes")
        done.append(staged(_level(s, own, world, symbols), f"sites-{level}"))
    return reduce(DataFrame.unionByName, done)


def _level(s: DataFrame, own: DataFrame, world: World | None, symbols: DataFrame | None) -> DataFrame:
    s = s.withColumn("argHeads", F.expr(f"transform(argTypes, t -> {head('t')})"))
    s = s.withColumn("owners", F.expr(f"transform(if(hasReceiver, array(struct(0 AS rank, ownerType AS type)), scopes), o -> struct(o.rank, {head('o.type')} AS owner, {type_arguments('o.type')} AS ownArgs))"))
    shapes = own
    if world is not None:
        # what the batch's own types inherit is asked for as well
        asked = s.selectExpr("explode(concat(owners.owner, argHeads)) AS id").unionByName(own.selectExpr("explode(ancestors.name) AS id"))
        shapes = own.unionByName(world.of(asked))
    up, members = members_of(shapes, symbols)
    # ancestors of the arguments that are types of the sources
    seen = s.selectExpr(*KEY, "explode(array_distinct(argHeads)) AS id").where("id IS NOT NULL AND instr(id, '.') > 0 AND NOT startswith(id, 'java.')")
    above = shapes.selectExpr("id", "explode(ancestors) AS a").selectExpr("id", "a.name", "a.depth").join(seen.select("id").distinct(), "id", "left_semi")
    above = above.join(shapes.selectExpr("id AS name", "true AS here"), "name", "left").groupBy("id").agg(F.expr("collect_list(struct(name, depth))").alias("a"), F.expr("min(coalesce(here, false))").alias("closed"))
    above = above.selectExpr("id", "map_from_entries(concat(a, if(closed, array(), array(struct('?' AS name, 0 AS depth))))) AS up")
    above = seen.join(above, "id").groupBy(*KEY).agg(F.expr("collect_list(struct(id, up))").alias("above"))
    s = s.join(above, KEY, "left").withColumn("above", F.expr("coalesce(above, CAST(array() AS array<struct<id:string,up:map<string,int>>>))"))

    tried = s.selectExpr(*KEY, "name", "field", "viaSuper", "argHeads", "above", "inline(owners)")
    met = tried.join(up, "owner").where("NOT viaSuper OR depth > 0").join(members, ["ancestor", "name", "field"])
    met = met.selectExpr(*KEY, f"struct(rank, if(field, 0L, {distance()}) AS cost, depth, targetId, ancestor, params, fromSource, returns, erased, upArgs, ownArgs) AS x")
    best = met.groupBy(*KEY).agg(F.expr("collect_list(x)").alias("every"))
    best = best.withColumn("every", F.expr("array_sort(filter(every, x -> x.cost IS NOT NULL AND x.rank = array_min(every.rank)))"))
    best = best.selectExpr(*KEY, "get(every, 0) AS b", "exists(every, x -> x.cost = every[0].cost AND x.depth = every[0].depth AND NOT x.params <=> every[0].params) AS tied")
    out = s.join(best, KEY, "left").withColumn("found", F.expr("b IS NOT NULL AND NOT coalesce(tied, false)"))
    # the result's type: through the ancestor's arguments, the receiver's, and the call's
    out = out.withColumn("result", F.expr(filled("b.returns", "b.upArgs")))
    out = out.withColumn("result", F.expr(f"if(instr(result, '#') > 0 AND size(b.ownArgs) = 0, b.erased, {filled('result', 'b.ownArgs')})"))
    given = f"transform(argTypes, t -> coalesce(try_element_at({mapped(BOXES)}, t), if(t IN ('{NULL}', '{LAMBDA}'), NULL, t)))"
    places = "transform(argTypes, (t, i) -> concat('@', i{}))"
    first = replaced("result", places.format(", '!'"), f"transform(argTypes, t -> get({type_arguments('t')}, 0))")
    out = out.withColumn("result", F.expr(f"if(instr(result, '@') > 0, {replaced(first, places.format(''), given)}, result)"))
    return out.selectExpr(
        *KEY, "field", "name", "line", "coalesce(ownerType, if(hasReceiver, NULL, get(scopes, 0).type)) AS ownerType",
        *[f"if(found, b.{c}, NULL) AS {alias}" for c, alias in (("targetId", "targetId"), ("ancestor", "owner"), ("fromSource", "fromSource"))],
        "coalesce(if(found, result, NULL), if(field, orType, NULL)) AS returns",
        "CASE WHEN found THEN NULL WHEN tied THEN 'several' WHEN hasReceiver AND ownerType IS NULL THEN 'receiver' ELSE 'member' END AS reason",
    )
