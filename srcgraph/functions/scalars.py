"""Scalar operators as Column expressions: names, paths, signatures, patterns and predicates."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of a base address in a name, in the order they are tried.
BASE_MARKS = ("url", "base", "host", "domain", "endpoint", "server")
PARAM = "{param}"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- names and paths -----------------------------------------------------------------------------


def package_path(name) -> Column:
    return F.replace(col(name), F.lit("."), F.lit("/"))


def dirname(path) -> Column:
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def basename(path) -> Column:
    return F.regexp_extract(col(path), r"[^/\\]*$", 0)


def qualified_name(owner, name, params) -> Column:
    """Owner.name(T1,T2); without an owner only name()."""
    full = F.concat(col(owner), F.lit("."), col(name), F.lit("("), F.array_join(col(params), ","), F.lit(")"))
    return F.when(col(owner).isNull(), F.concat(col(name), F.lit("()"))).otherwise(full)


def simple_type(t: Column) -> Column:
    """Without generics (where something stands before them) and without the package."""
    bare = F.when(F.instr(t, "<") > 1, F.substring_index(t, "<", 1)).otherwise(t)
    return F.substring_index(bare, ".", -1)


def simple_signature(name, params) -> Column:
    return F.concat(col(name), F.lit("("), F.array_join(F.transform(col(params), simple_type), ","), F.lit(")"))


def erased_type(t) -> Column:
    """Generics dropped; an array of any dimension ends in one []."""
    c = col(t)
    bare = F.regexp_replace(F.regexp_replace(c, r"\[\]", ""), "<.*>", "")
    return F.when(F.instr(c, "[]") > 0, F.concat(bare, F.lit("[]"))).otherwise(bare)


def name_and_signature(qualified) -> Column:
    """The text after the last dot that stands before the parameters."""
    q = col(qualified)
    head = F.when(F.instr(q, "(") > 1, F.substring_index(q, "(", 1)).otherwise(q)
    tail = F.substring_index(head, ".", -1)
    # a dot at the very end names nothing: the whole text stays
    return F.when((q == "") | q.isNull(), F.lit(None).cast("string")).when(tail == "", q).otherwise(F.substr(q, F.length(head) - F.length(tail) + 1))


def placeholder_name(qualified) -> Column:
    n = name_and_signature(qualified)
    return F.when(F.instr(n, "(") > 1, F.substring_index(n, "(", 1)).otherwise(n)


def placeholder_signature(qualified) -> Column:
    n = name_and_signature(qualified)
    return F.when(F.instr(n, "(") > 1, n)


# --- addresses -----------------------------------------------------------------------------------


def normalize_params(path) -> Column:
    return F.regexp_replace(col(path), r"\{[^}]+\}", PARAM)


def normalize_slashes(path) -> Column:
    one = F.regexp_replace(F.coalesce(col(path), F.lit("")), "/+", "/")
    return F.when((one == "") | F.startswith(one, F.lit("/")), one).otherwise(F.concat(F.lit("/"), one))


def marks_base(name: Column) -> Column:
    return F.lower(name).rlike("|".join(BASE_MARKS))


def likely_base_url(name) -> Column:
    return F.coalesce(marks_base(col(name)), F.lit(False))


def extract_path(url, regex: str | None = None) -> Column:
    """A user's pattern first (its first group, if any); else the path after http(s)://host; else the text
    after a leading placeholder that names a base address and is followed by a slash; else unchanged."""
    u = col(url)
    rest = F.regexp_extract(u, r"^https?://[^/]*(/.*)$", 1)
    holder, after = F.regexp_extract(u, r"^(\$?\{[^}]*\})(?s:(.*))$", 1), F.regexp_extract(u, r"^(\$?\{[^}]*\})(?s:(.*))$", 2)
    out = F.when((u.rlike("^https?://")) & (rest != ""), rest).when((holder != "") & marks_base(holder) & F.startswith(after, F.lit("/")), after).otherwise(u)
    if regex is not None:
        out = F.when(u.rlike(regex), F.regexp_extract(u, regex, 1 if re.compile(regex).groups else 0)).otherwise(out)
    return out


def url_path(url) -> Column:
    """The text after http(s)://host, also where it is empty; other texts unchanged."""
    u = col(url)
    return F.when(u.rlike("^https?://[^/]+"), F.regexp_extract(u, "^https?://[^/]+(.*)$", 1)).otherwise(u)


def segment_normalize(segments) -> Column:
    """segments: array<struct<value, literal>>. Literals lose host and parameter names; the first variable is left
    out if it names a base address and no variable was seen before; other variables become {param}."""
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("first"))

    def add(acc, s):
        skip = acc["first"] & marks_base(s["value"])
        text = F.when(s["literal"], normalize_params(url_path(s["value"]))).when(skip, F.lit("")).otherwise(F.lit(PARAM))
        return F.struct(F.concat(acc["text"], text).alias("text"), (acc["first"] & s["literal"]).alias("first"))

    return F.aggregate(col(segments), start, add, lambda acc: acc["text"])


def normalize_arbitrate(path, segmented, direction) -> Column:
    """Inbound paths by their own parameters; outbound ones by segments unless those lost structure that the path has."""
    p, s, own = col(path), col(segmented), normalize_params(path)
    lost = ((s == PARAM) & (F.length(p) > 7)) | (F.startswith(s, F.lit(PARAM + "/")) & F.startswith(p, F.lit("/")))
    lost = lost | ((F.length(own) > F.length(s)) & F.endswith(own, s))
    return F.when(p.isNull() | (p == ""), p).when((col(direction) == "outbound") & s.isNotNull() & ~lost, s).otherwise(own)


# --- values of rules -----------------------------------------------------------------------------


def transform(value, how) -> Column:
    """toUpperCase, toLowerCase, extractPath, {type: extractPath, regex}, {type: regexReplace, pattern, replacement}; others: identity."""
    v = col(value)
    kind, more = (how, {}) if isinstance(how, str) else ((how or {}).get("type"), how or {})
    if kind == "toUpperCase":
        return F.upper(v)
    if kind == "toLowerCase":
        return F.lower(v)
    if kind == "extractPath":
        return extract_path(v, more.get("regex"))
    if kind == "regexReplace" and more.get("pattern") is not None and more.get("replacement") is not None:
        return F.regexp_replace(v, more["pattern"], more["replacement"])
    return v


def pattern_capture(value, pattern: str, group: int | None = None, default: int = 1) -> Column:
    """The group of the first match; null without a match or such a group."""
    v, g = col(value), default if group is None else group
    if g > re.compile(pattern).groups:
        return F.lit(None).cast("string")
    return F.when(v.rlike(pattern), F.regexp_extract(v, pattern, g))


def mapping_lookup(key, mapping: dict) -> Column:
    if not mapping:
        return F.lit(None).cast("string")
    pairs = F.create_map(*[F.lit(str(x)) for kv in mapping.items() for x in kv])
    return F.try_element_at(pairs, col(key))


def template_resolve(template: str | None, values: dict[str, Column]) -> Column:
    """${v} by value; null if any is missing."""
    if template is None:
        return F.lit(None).cast("string")
    parts = [p for p in re.split(r"(\$\{[^}]+\})", template) if p]
    out = [values.get(p[2:-1], F.lit(None).cast("string")) if p.startswith("${") and p.endswith("}") else F.lit(p) for p in parts]
    return F.concat(*out) if out else F.lit("")


def combine(sources: list[dict], values: dict[str, Column], normalize: bool = False) -> Column:
    """Sources in order: ${v} by value or nothing, other texts as they are."""
    out = []
    for s in sources:
        ref = s.get("source")
        if ref is None:
            out.append(F.lit(s.get("literal") or ""))
        elif ref.startswith("${") and ref.endswith("}"):
            out.append(F.coalesce(values.get(ref[2:-1], F.lit(None).cast("string")), F.lit("")))
        else:
            out.append(F.lit(ref))
    joined = F.concat(*out) if out else F.lit("")
    return normalize_slashes(joined) if normalize else joined


def strategy(*tries: Column) -> Column:
    return F.coalesce(*tries)


def cartesian_concat(parts) -> Column:
    """parts: array<array<string>>: each prefix before each suffix, in order."""
    return F.aggregate(col(parts), F.array(F.lit("")), lambda acc, p: F.flatten(F.transform(acc, lambda a: F.transform(p, lambda b: F.concat(a, b)))))


LEVELS = ("FULL", "PARTIAL", "UNKNOWN")


def worst_level(levels) -> Column:
    """The worst of an array of levels; FULL for none."""
    rank = F.array_max(F.transform(col(levels), lambda x: F.array_position(F.array(*[F.lit(v) for v in LEVELS]), x)))
    return F.get(F.array(*[F.lit(v) for v in LEVELS]), (F.coalesce(rank, F.lit(1)) - 1).cast("int"))


# --- endpoints -----------------------------------------------------------------------------------

#: Names of endpoint types in rules.
ENDPOINT_TYPES = {
    "HTTP": "HTTP", "HTTP-INBOUND": "HTTP", "HTTP-OUTBOUND": "HTTP",
    "MQ": "MQ", "KAFKA": "MQ", "KAFKA-PRODUCER": "MQ", "KAFKA-CONSUMER": "MQ", "ROCKETMQ": "MQ",
    "REDIS": "REDIS", "REDIS-ACCESS": "REDIS",
    "DB": "DB", "DB-ACCESS": "DB",
}


def endpoint_type(name) -> Column:
    return mapping_lookup(F.upper(col(name)), ENDPOINT_TYPES)


def broker_type(name) -> Column:
    n = F.upper(col(name))
    return F.when(F.contains(n, F.lit("KAFKA")), "KAFKA").when(F.contains(n, F.lit("ROCKETMQ")), "ROCKETMQ")


def _by_kind(http, mq, redis, db) -> Column:
    kind = F.col("endpointType")
    return F.when(kind == "HTTP", http).when(kind == "MQ", mq).when(kind == "REDIS", redis).when(kind == "DB", db)


def match_identity() -> Column:
    unknown = F.lit("UNKNOWN")
    key = lambda name, c: F.concat(F.lit(name + ":"), F.coalesce(F.col(c), unknown))
    http = F.concat(F.coalesce(F.col("httpMethod"), unknown), F.lit(" "), F.coalesce("normalizedPath", "path", F.lit("")))
    return _by_kind(http, key("MQ", "topic"), key("REDIS", "keyPattern"), key("DB", "tableName"))


def endpoint_id() -> Column:
    head = F.concat_ws(":", "direction", "endpointType")
    http = F.concat(head, F.lit(":"), F.coalesce(F.col("httpMethod"), F.lit("UNKNOWN")), F.lit(":"), F.col("path"))
    other = lambda c: F.concat(head, F.lit(":"), F.col(c))
    own = _by_kind(http, other("topic"), other("keyPattern"), other("tableName"))
    # no key at all: an id of the place, equal whenever the row is computed again
    return F.coalesce(own, F.sha2(F.concat_ws("|", "direction", "endpointType", "projectFilePath", "startLine"), 256))


def edge_id(*parts) -> Column:
    """An id from what the edge is, so that a repeated batch writes the same row."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


# --- predicates ----------------------------------------------------------------------------------


def keeps_call(name) -> Column:
    """Not a getter or setter by its prefix alone."""
    n = col(name)
    drop = ((F.startswith(n, F.lit("set")) | F.startswith(n, F.lit("get"))) & (F.length(n) > 3)) | (F.startswith(n, F.lit("is")) & (F.length(n) > 2))
    return ~F.coalesce(drop, F.lit(False))


def in_whitelist(owner, from_source, prefixes: list[str]) -> Column:
    o = col(owner)
    any_prefix = reduce(lambda a, b: a | b, [F.startswith(o, F.lit(p)) for p in prefixes], F.lit(False))
    return F.coalesce(o.isNotNull() & (col(from_source) | any_prefix), F.lit(False))


def all_of(conditions) -> Column:
    return reduce(and_, conditions, F.lit(True))


def glob_package_regex(glob: str) -> str:
    """** any text, * any text without a dot, . itself."""
    return "^(?:" + "".join({"**": ".*", "*": "[^.]*", ".": r"\."}.get(p, p) for p in re.findall(r"\*\*|\*|\.|[^*.]+", glob)) + ")$"


def glob_file_regex(glob: str) -> str:
    """* any text; a dot stays a pattern's dot."""
    return "^(?:" + glob.replace("*", ".*") + ")$"


def glob_package(package, glob: str) -> Column:
    return col(package).rlike(glob_package_regex(glob))


def glob_file(name, glob: str) -> Column:
    return col(name).rlike(glob_file_regex(glob))


def scope_matches(package, file_name, scope: dict | None) -> Column:
    scope = scope or {}
    includes, excludes, files = (scope.get(k) or [] for k in ("packageIncludes", "packageExcludes", "fileNamePatterns"))
    some = lambda c, globs, match: reduce(lambda a, b: a | b, [match(c, g) for g in globs])
    out = F.lit(True)
    if includes:
        out = out & some(package, includes, glob_package)
    if excludes:
        out = out & ~some(package, excludes, glob_package)
    if files:
        out = out & some(file_name, files, glob_file)
    return F.coalesce(out, F.lit(False))


def annotation_matches(annotations, condition: dict) -> Column:
    """annotations: array<struct<name, attributes>>; any of them may satisfy equals, a whole-name pattern or a list."""
    names = F.transform(col(annotations), lambda a: a["name"])
    bare = lambda s: s.lstrip("@").removeprefix("@")
    tests = []
    if condition.get("nameEquals"):
        tests.append(lambda n, v=bare(condition["nameEquals"]): n == v)
    if condition.get("nameMatches"):
        tests.append(lambda n, v="^(?:" + condition["nameMatches"].replace("@", "") + ")$": n.rlike(v))
    if condition.get("nameIn"):
        tests.append(lambda n, v=[bare(x) for x in condition["nameIn"]]: n.isin(v))
    if not tests:
        return F.lit(False)
    return F.coalesce(F.exists(names, lambda n: reduce(lambda a, b: a | b, [t(n) for t in tests])), F.lit(False))


def receiver_matches(has_receiver, receiver_type, pattern: str, strict: bool = False) -> Column:
    """A receiver whose whole type name fits; one of unknown type fits unless strict."""
    fits = F.coalesce(col(receiver_type).rlike("^(?:" + pattern + ")$"), F.lit(not strict))
    return col(has_receiver) & fits
