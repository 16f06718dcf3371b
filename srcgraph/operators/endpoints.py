"""The rule engine: rules become Column expressions over methods and call sites.

For each rule: scope and conditions filter, each field becomes an array of values, fields without values stay out, an explode a
field is the cartesian product, combined fields and the build's templates are concatenations.
"""

from __future__ import annotations

import json
import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..sources import rules as R
from . import facts as A
from . import graph as G



def null() -> Column:
    return F.lit(None).cast("string")


def sites(typed: DataFrame, method: DataFrame, node_type: str) -> DataFrame:
    """Candidates of a node type, with the same columns for both."""
    common = ["projectFilePath", "gitRepoUrl", "gitBranch", "package", "classAnnotations"]
    if node_type == "MethodDeclaration":
        return method.select(*common, F.col("id").alias("functionId"), F.col("m.line").alias("startLine"), F.col("m.endLine").alias("endLine"), F.col("m.annotations").alias("annotations"), F.lit(None).cast(A.CALL).alias("c"), null().alias("receiverType"))
    if node_type == "MethodInvocation":
        c = method.select(*common, "known", "id", F.explode("m.calls").alias("c"))
        return c.select(
            *common,
            # inside an anonymous type the nearest method is not one of the file's functions
            F.when(~F.col("c.nested"), F.col("id")).alias("functionId"),
            F.col("c.line").alias("startLine"),
            F.col("c.endLine").alias("endLine"),
            F.array().cast(f"array<{A.NOTE}>").alias("annotations"),
            "c",
            A.lookup(F.col("known"), F.col("c.receiverType")).alias("receiverType"),
        )
    raise ValueError(f"unknown node type {node_type}")


def condition(where: dict, strict: bool = False) -> Column:
    """One entry of a rule's where list: all its parts must hold."""
    out = F.lit(True)
    if where.get("hasAnnotation"):
        out = out & S.annotation_matches("annotations", where["hasAnnotation"])
    if where.get("methodName"):
        n, name = where["methodName"], F.col("c.name")
        if n.get("in"):
            out = out & F.coalesce(name.isin(list(n["in"])), F.lit(False))
        if n.get("equals"):
            out = out & F.coalesce(name == n["equals"], F.lit(False))
        if n.get("matches"):
            out = out & F.coalesce(name.rlike("^(?:" + n["matches"] + ")$"), F.lit(False))
    if (where.get("receiver") or {}).get("typeMatches"):
        out = out & S.receiver_matches(F.coalesce(F.col("c.hasReceiver"), F.lit(False)), "receiverType", where["receiver"]["typeMatches"], strict)
    return out


def annotation_named(notes: Column, name: str) -> Column:
    """The first annotation of a name, or of a pattern where the name holds one of its signs."""
    bare = name.lstrip("@")
    test = (lambda a: a["name"].rlike("^(?:" + bare + ")$")) if re.search(r"[*+?\[(^$]", bare) else (lambda a: a["name"] == bare)
    return F.get(F.filter(notes, test), F.lit(0))


def path_value(path: str, node_type: str) -> Column:
    """A path expression: argument[i], methodName, method. and class.annotation[x].attribute[y], method.annotation[x].name."""
    call = node_type == "MethodInvocation"
    if (m := re.fullmatch(r"argument\[(\d+)\]", path)) and call:
        return F.get("c.args", F.lit(int(m[1])))
    if path == "methodName" and call:
        return F.col("c.name")
    if (m := re.fullmatch(r"method\.annotation\[(.+)\]\.name", path)) and not call:
        return annotation_named(F.col("annotations"), m[1])["name"]
    if m := re.fullmatch(r"(method|class)\.annotation\[(.+)\]\.attribute\[(.+)\]", path):
        if m[1] == "method" and call:
            return null()
        notes = F.col("annotations" if m[1] == "method" else "classAnnotations")
        return F.try_element_at(annotation_named(notes, m[2])["attributes"], F.lit(m[3]))
    return null()


def single_value(config: dict, node_type: str) -> Column:
    """from (then pattern, mapping, default), else mapping, else strategies; then the transform."""
    mapped = S.mapping_lookup("c.name", config.get("mapping") or {}) if node_type == "MethodInvocation" else null()
    if config.get("from") is not None:
        value = path_value(config["from"], node_type)
        if config.get("pattern"):
            value = S.pattern_capture(value, config["pattern"], config.get("captureGroup"), 1)
        value = F.coalesce(value, mapped, F.lit(config.get("defaultValue")).cast("string"))
    elif config.get("mapping"):
        value = mapped
    else:
        value = F.coalesce(null(), *[strategy_value(s["tryConfig"], node_type) for s in config.get("strategies") or [] if s.get("tryConfig")])
    return S.transform(value, config.get("transform"))


def strategy_value(t: dict, node_type: str) -> Column:
    value = path_value(t["from"], node_type) if t.get("from") is not None else null()
    if t.get("mapping") and node_type == "MethodInvocation":
        value = F.coalesce(value, S.mapping_lookup("c.name", t["mapping"]))
    if t.get("pattern"):
        value = S.pattern_capture(value, t["pattern"], t.get("captureGroup"), 0)
    if t.get("transform") in ("toUpperCase", "toLowerCase"):
        value = S.transform(value, t["transform"])
    return F.coalesce(value, F.lit(t.get("defaultValue")).cast("string"))


def field_values(config: dict, node_type: str) -> Column:
    """An array of a field's values; only traced arguments have more than one."""
    m = re.fullmatch(r"argument\[(\d+)\]", str(config.get("from", "")))
    if config.get("trace") == "auto" and m and node_type == "MethodInvocation":
        values = F.coalesce(F.get("c.values", F.lit(int(m[1]))), F.array().cast("array<string>"))
        return F.array_distinct(F.transform(values, lambda v: S.transform(v, config.get("transform"))))
    if config.get("trace") == "auto" and config.get("from") is not None:
        one = S.transform(path_value(config["from"], node_type), config.get("transform"))
    else:
        one = single_value(config, node_type)
    return F.filter(F.array(one), lambda v: v.isNotNull())


@cache
def compiled(text: str, node_type: str, strict: bool):
    """A rule's (JSON) condition, fields and columns, or None if it builds nothing. Columns name what they read, so they serve every batch of a session."""
    rule = json.loads(text)
    build = R.build_of(rule)
    if build is None:
        return None
    where = S.scope_matches(F.coalesce("package", F.lit("")), S.basename("projectFilePath"), rule["scope"]) & S.all_of([condition(w, strict) for w in rule["locate"].get("where") or []])
    fields, values = {}, {}
    for name, config in rule["extract"].items():
        if config.get("combine") is None:
            # an absent field leaves the other combinations
            fields[f"v_{name}"] = F.explode_outer(F.array_distinct(field_values(config, node_type)))
            values[name] = F.col(f"v_{name}")
    for name, config in rule["extract"].items():
        if config.get("combine") is not None:
            c = config["combine"]
            values[name] = S.combine(c.get("sources") or [], values, bool(c.get("normalize")))
    of = lambda key: S.template_resolve(build.get(key), values)
    columns = {"endpointType": S.endpoint_type(of("endpointType")), "direction": of("direction"), "isExternal": F.lit(build.get("isExternal")).cast("boolean"), "serviceName": of("serviceName"), "parseLevel": of("parseLevel"), "targetService": null(), "language": null(), "qualifiedName": null()}
    columns |= {c: of(c) for c in ("path", "topic", "operation", "keyPattern", "dataStructure", "tableName")}
    columns["httpMethod"] = F.coalesce(of("httpMethod"), F.lit("UNKNOWN"))
    columns["brokerType"] = S.broker_type(of("endpointType"))
    columns["command"] = values.get("command", null())
    columns["dbOperation"] = F.coalesce(values.get("dbOperation", null()), values.get("operation", null()))
    segments = [S.segment_normalize(F.coalesce("c.segments", F.array().cast("array<struct<value:string,literal:boolean>>"))).alias("segmented"), F.col("c.segments").isNotNull().alias("hasSegments")]
    first = ["projectFilePath", "gitRepoUrl", "gitBranch", "startLine", "endLine", "functionId", *[v.alias(k) for k, v in columns.items()], *segments]
    kind = F.col("endpointType")
    own = {c: F.when(kind == k, F.col(c)) for k, some in schema.ENDPOINT_KINDS.items() for c in some if c != "normalizedPath"}
    own["normalizedPath"] = F.when(kind == "HTTP", S.normalize_arbitrate("path", F.when(F.col("hasSegments"), F.col("segmented")), "direction"))
    key = F.when(kind == "HTTP", F.col("path")).when(kind == "MQ", F.col("topic")).when(kind == "REDIS", F.col("keyPattern")).when(kind == "DB", F.col("tableName"))
    whole = kind.isNotNull() & F.col("direction").isNotNull() & key.isNotNull()
    last = {"id": S.endpoint_id(), "matchIdentity": S.match_identity()}
    return where, fields, first, own, whole, last, F.lit(-rule["priority"]).alias("ruleOrder")


def apply_rule(rule: dict, candidates: DataFrame, node_type: str, strict: bool = False) -> DataFrame | None:
    """Endpoint rows of one rule, or none if it builds nothing."""
    parts = compiled(json.dumps(rule), node_type, strict)
    if parts is None:
        return None
    where, fields, first, own, whole, last, order = parts
    rows = candidates.where(where)
    for name, values in fields.items():
        rows = rows.withColumn(name, values)
    out = rows.select(*first).withColumns({k: v for k, v in own.items() if k != "normalizedPath"}).withColumn("normalizedPath", own["normalizedPath"]).where(whole)
    out = out.withColumns(last).withColumn("name", F.col("matchIdentity"))
    return out.select(*[c for c in out.columns if c not in ("segmented", "hasSegments")], order)


def extract(typed: DataFrame, method: DataFrame, rules: list[dict], strict: bool = False) -> DataFrame:
    """Endpoint rows of all rules, repeated ids included, with functionId and ruleOrder."""
    out = None
    for rule in rules:
        node_type = rule["locate"].get("nodeType")
        if node_type not in ("MethodDeclaration", "MethodInvocation"):
            continue
        part = apply_rule(rule, sites(typed, method, node_type), node_type, strict)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.ENDPOINTS]
        out = method.where("false").select(*empty, null().alias("functionId"), F.lit(0).alias("ruleOrder"))
    return out


ORDER = ["ruleOrder", "projectFilePath", "startLine", "endLine"]


def distinct(points: DataFrame) -> DataFrame:
    """The first endpoint of each id."""
    return G.first_by(points, ["id"], ORDER)


def links(points: DataFrame, functions: DataFrame) -> DataFrame:
    """(fromNodeId, toNodeId, relationshipType): each endpoint's functions, by functionId or else by the lines around it."""
    p = points.select("id", "direction", "functionId", "projectFilePath", F.col("startLine").alias("line")).distinct()
    by_id = p.join(functions.select(F.col("id").alias("functionId")).distinct(), "functionId", "left_semi")
    rest = p.join(functions.select(F.col("id").alias("functionId")).distinct(), "functionId", "left_anti").drop("functionId")
    spans = functions.select(F.col("id").alias("functionId"), "projectFilePath", "startLine", "endLine")
    by_place = G.position_join(rest, spans, ["projectFilePath"], ["startLine", "functionId"])
    both = by_id.select("id", "direction", "functionId").unionByName(by_place.select("id", "direction", "functionId")).distinct()
    inward = F.col("direction") == "inbound"
    return both.select(F.when(inward, F.col("id")).otherwise(F.col("functionId")).alias("fromNodeId"), F.when(inward, F.col("functionId")).otherwise(F.col("id")).alias("toNodeId"), F.when(inward, "ENDPOINT_TO_FUNCTION").otherwise("FUNCTION_TO_ENDPOINT").alias("relationshipType"))
