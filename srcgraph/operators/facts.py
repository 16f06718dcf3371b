"""Facts: one nested row a source file, from the parser, with names of types resolved by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

NOTE = "struct<name:string,attributes:map<string,string>>"
CALL = (
    "struct<line:int,endLine:int,name:string,nested:boolean,hasReceiver:boolean,receiverType:string,"
    "args:array<string>,values:array<array<string>>,levels:array<string>,segments:array<struct<value:string,literal:boolean>>>"
)
TERM = "struct<type:string,site:int,deref:int>"
SITE = (
    f"struct<at:int,field:boolean,name:string,line:int,level:int,receiver:{TERM},scopes:array<struct<rank:int,type:string>>,"
    f"viaSuper:boolean,args:array<{TERM}>,orType:string>"
)
METHOD = (
    f"struct<name:string,params:array<string>,erased:array<string>,returnType:string,modifiers:array<string>,annotations:array<{NOTE}>,"
    f"line:int,endLine:int,isConstructor:boolean,calls:array<{CALL}>,sites:array<{SITE}>>"
)
TYPE = f"struct<name:string,kind:string,modifiers:array<string>,annotations:array<{NOTE}>,line:int,endLine:int,methods:array<{METHOD}>>"
SHAPE = (
    "struct<name:string,kind:string,supers:array<string>,fields:array<struct<name:string,type:string>>,"
    "methods:array<struct<name:string,params:array<string>,returns:string,erased:string,varargs:boolean>>>"
)
SCHEMA = (
    "projectFilePath string, gitRepoUrl string, gitBranch string, package string, "
    f"imports array<struct<name:string,isStatic:boolean,isStar:boolean>>, types array<{TYPE}>, shapes array<{SHAPE}>, names array<string>, error string"
)

#: Types that every file sees without an import.
JAVA_LANG = (
    "Appendable AutoCloseable Boolean Byte Character CharSequence Class ClassLoader Cloneable Comparable Deprecated Double Enum Error Exception "
    "Float FunctionalInterface IllegalArgumentException IllegalStateException Integer InterruptedException Iterable Long Math NullPointerException Number "
    "Object Override Process Readable Record Runnable Runtime RuntimeException Short StackTraceElement String StringBuffer StringBuilder SuppressWarnings "
    "System Thread ThreadLocal Throwable UnsupportedOperationException Void"
).split()
PRIMITIVES = ("boolean", "byte", "short", "int", "long", "char", "float", "double", "void")


def facts_of(source: str, config: dict | None, names: list[str] | None, numbers: list[int], nested_types: bool = False) -> dict:
    """A file's facts. names and numbers: calls and arguments whose values rules ask for."""
    from ..functions import terms as Y
    from ..functions import tracer as V
    from ..sources.java import parse

    unit, seen = parse(source), set()
    shapes: list[dict] = []
    qualified = lambda name: f"{unit['package']}.{name}" if unit["package"] else name

    def kind(text, variables):
        e = V.erased(text, variables)
        if e is not None:
            seen.add(e.replace("[]", ""))
        return e

    def call(c, t, m, variables):
        target = c.target
        asked = (names is None or c.name in names) and target is not None
        traced = [V.Tracer(t, m, config).trace(c.args[i]) if i in numbers and i < len(c.args) and asked else ([], None) for i in range(max(numbers, default=-1) + 1)]
        parts = V.path_segments(c.args[0], m) if asked and c.args and numbers else None
        while target is not None and target.kind == "paren":
            target = target.left
        return {
            "line": c.line, "endLine": c.end, "name": c.name, "nested": c.nested, "hasReceiver": target is not None,
            "receiverType": kind(V.static_type(target, t, m), variables) if target is not None else None,
            "args": [a.value if a.kind == "str" else a.text for a in c.args],
            "values": [v for v, _ in traced], "levels": [x for _, x in traced], "segments": [{"value": v, "literal": lit} for v, lit in parts] if parts is not None else None,
        }

    def method(m, t, variables, chain):
        own = variables | m["variables"]
        return {
            "name": m["name"], "params": [p["type"] for p in m["params"]], "erased": [kind(p["type"], own) for p in m["params"]], "returnType": kind(m["returnType"], own),
            "modifiers": m["modifiers"], "annotations": m["annotations"], "line": m["line"], "endLine": m["endLine"], "isConstructor": m["isConstructor"],
            "calls": [call(c, t, m, own) for c in m["calls"]], "sites": Y.Sites(chain, m, unit["imports"], own, seen.update).rows,
        }

    def type_(t, name="", chain=(), variables=None, listed=True):
        """Its shape, and its row and those of types in it where they are asked for."""
        name = f"{name}.{t['name']}" if name else t["name"]
        shapes.append(Y.shape(name, t, variables or {}, seen.update))
        chain, variables = [(qualified(name), t), *chain], (variables or {}) | t["variables"]
        out = []
        if listed and (nested_types or t["kind"] in ("class", "interface")):
            out.append({
                "name": name, "kind": t["kind"], "modifiers": t["modifiers"], "annotations": t["annotations"], "line": t["line"], "endLine": t["endLine"],
                "methods": [method(m, t, variables, chain) for m in t["methods"]],
            })
        return out + [x for n in t["types"] for x in type_(n, name, chain, variables, nested_types)]

    types = [x for t in unit["types"] for x in type_(t)]
    return {"package": unit["package"], "imports": unit["imports"], "types": types, "shapes": shapes, "names": sorted(seen), "error": None}


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(projectFilePath, gitRepoUrl, gitBranch, content) of the .java files below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("projectFilePath"), F.lit(None).cast("string").alias("gitRepoUrl"), F.lit(None).cast("string").alias("gitBranch"), F.col("value").alias("content"))


def project_root(path) -> Column:
    """The part of a path before src/, by the last such folder; without one, the first folder."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(p.rlike("(^|/)src/"), F.regexp_replace(F.regexp_extract(p, "^(.*?)(?:/|^)src/", 0), "/?src/$", "")).otherwise(F.substring_index(p, "/", 1))


def parse_sources(sources: DataFrame, dictionary: DataFrame | None = None, rules: list[dict] = (), nested_types: bool = False) -> DataFrame:
    """SCHEMA rows from (projectFilePath, gitRepoUrl, gitBranch, content). A file that cannot be read gives a row with its error and no types.

    dictionary: (projectRoot, config), joined to the files by their project; one row a project.
    """
    from ..sources.rules import traced_arguments

    names, numbers = traced_arguments(list(rules))
    rows = sources.select("projectFilePath", "gitRepoUrl", "gitBranch", "content")
    none = F.lit(None).cast("map<string,array<string>>")
    if dictionary is None:
        rows = rows.withColumn("config", none)
    else:
        rows = rows.withColumn("projectRoot", project_root("projectFilePath")).join(dictionary, "projectRoot", "left").drop("projectRoot")
    rows = rows.select("projectFilePath", "gitRepoUrl", "gitBranch", "content", "config")

    schema = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def run(batches):
        import sys

        import pyarrow as pa

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # long chains and sums are deep trees
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                config = None if r["config"] is None else dict(r["config"])
                row = {k: r[k] for k in ("projectFilePath", "gitRepoUrl", "gitBranch")}
                try:
                    got = facts_of(r["content"] or "", config, names, numbers, nested_types)
                except Exception as e:
                    got = {"package": None, "imports": [], "types": [], "shapes": [], "names": [], "error": f"{type(e).__name__}: {e}"}
                out.append(row | got)
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist([arrow(x) for x in out], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist([arrow(x) for x in out], schema=schema)

    def arrow(x):
        """Maps as lists of pairs, as Arrow wants them."""
        if isinstance(x, dict):
            return {k: list(v.items()) if k == "attributes" else arrow(v) for k, v in x.items()}
        return [arrow(v) for v in x] if isinstance(x, list) else x

    return rows.mapInArrow(run, SCHEMA)


def known_types(facts: DataFrame, symbols: DataFrame | None = None, world=None) -> DataFrame:
    """(qualified, simple, package): types of the sources read, of those known before (resolve.World) and of optional symbols (owner).

    The package of a nested type is the type around it, so that it can be imported by name and by star.
    """
    own = facts.select("package", F.explode("shapes.name").alias("name")).select(F.concat_ws(".", "package", "name").alias("qualified"))
    heads = facts.select(F.explode("names").alias("name")).select(F.substring_index("name", ".", 1))
    for more in (None if world is None else world.named(heads).select(F.col("id").alias("qualified")), None if symbols is None else symbols.select(F.col("owner").alias("qualified"))):
        own = own if more is None else own.unionByName(more)
    package = F.when(F.instr("qualified", ".") > 0, F.expr("left(qualified, length(qualified) - length(substring_index(qualified, '.', -1)) - 1)")).otherwise("")
    return own.distinct().select("qualified", F.substring_index("qualified", ".", -1).alias("simple"), package.alias("package"))


def resolved_names(facts: DataFrame, types: DataFrame) -> DataFrame:
    """(projectFilePath, known): a map from the type names a file uses to qualified ones.

    By the first part of a name: a type nested in the file, an import, the same package, an import of all, java.lang; others keep their name.
    Equi-joins on (package, simple); the map is one row a file.
    """
    used = facts.select("projectFilePath", F.coalesce("package", F.lit("")).alias("package"), "imports", F.col("shapes.name").alias("own"), F.explode("names").alias("name")).where(~F.col("name").isin(*PRIMITIVES))
    base = used.select("projectFilePath", "package", "name", F.substring_index("name", ".", 1).alias("head"), "imports", "own")
    inner = F.get(F.filter("own", lambda n: (F.instr(n, ".") > 0) & (F.substring_index(n, ".", -1) == F.col("head"))), F.lit(0))
    exact = F.filter("imports", lambda i: ~i["isStar"] & ~i["isStatic"] & (F.substring_index(i["name"], ".", -1) == F.col("head")))
    direct = F.coalesce(F.when(inner.isNotNull(), F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), inner)), F.get(F.transform(exact, lambda i: i["name"]), F.lit(0)))
    base = base.withColumn("direct", direct)
    stars = F.transform(F.filter("imports", lambda i: i["isStar"] & ~i["isStatic"]), lambda i: i["name"])
    where = F.concat(F.array(F.struct(F.lit(1).alias("rank"), F.col("package").alias("p"))), F.transform(stars, lambda s: F.struct(F.lit(2).alias("rank"), s.alias("p"))))
    tried = base.where("direct is null").select("projectFilePath", "head", F.explode(where).alias("w")).select("projectFilePath", "head", "w.rank", F.col("w.p").alias("package")).distinct()
    found = tried.join(types.select("package", F.col("simple").alias("head"), "qualified"), ["package", "head"]).groupBy("projectFilePath", "head").agg(F.min(F.struct("rank", "qualified")).alias("best"))
    lang = F.when(F.col("head").isin(*JAVA_LANG), F.concat(F.lit("java.lang."), "head"))
    rest = F.substr("name", F.length("head") + 1)
    full = F.coalesce(F.concat(F.coalesce("direct", "best.qualified", lang), rest), F.col("name"))
    pairs = base.select("projectFilePath", "name", "head", "direct").join(found, ["projectFilePath", "head"], "left").select("projectFilePath", F.struct("name", full.alias("full")).alias("pair"))
    return pairs.groupBy("projectFilePath").agg(F.map_from_entries(F.collect_set("pair")).alias("known"))


def lookup(known: Column, name: Column) -> Column:
    """A type's qualified name: arrays keep one []."""
    bare = F.replace(name, F.lit("[]"), F.lit(""))
    return F.concat(F.coalesce(F.try_element_at(known, bare), bare), F.when(F.endswith(name, F.lit("[]")), "[]").otherwise(""))


def resolved(facts: DataFrame, symbols: DataFrame | None = None, world=None) -> DataFrame:
    """facts with `known`, the map of its type names."""
    names = resolved_names(facts, known_types(facts, symbols, world))
    empty = F.create_map().cast("map<string,string>")
    return facts.join(names, "projectFilePath", "left").withColumn("known", F.coalesce("known", empty))
