"""Record types of the graph: four node tables, one edge table, and the change log."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()
STRINGS = T.ArrayType(S)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


#: Columns that every node has.
NODE = (("id", S), ("name", S), ("qualifiedName", S), ("language", S), ("projectFilePath", S), ("gitRepoUrl", S), ("gitBranch", S))
LINES = (("startLine", I), ("endLine", I))

PACKAGES = _struct(*NODE, ("packagePath", S))
UNITS = _struct(*NODE, *LINES, ("unitType", S), ("modifiers", STRINGS), ("isAbstract", B), ("packageId", S))
FUNCTIONS = _struct(*NODE, *LINES, ("signature", S), ("returnType", S), ("modifiers", STRINGS), ("isStatic", B), ("isAsync", B), ("isConstructor", B), ("isPlaceholder", B))
ENDPOINT_KINDS = {
    "HTTP": ("httpMethod", "path", "normalizedPath"),
    "MQ": ("topic", "operation", "brokerType"),
    "REDIS": ("keyPattern", "command", "dataStructure"),
    "DB": ("tableName", "dbOperation"),
}
ENDPOINTS = _struct(
    *NODE,
    *LINES,
    ("endpointType", S),
    ("direction", S),
    ("isExternal", B),
    *[(c, S) for columns in ENDPOINT_KINDS.values() for c in columns],
    ("serviceName", S),
    ("parseLevel", S),
    ("targetService", S),
    ("matchIdentity", S),
)
EDGES = _struct(("id", S), ("fromNodeId", S), ("toNodeId", S), ("relationshipType", S), ("lineNumber", I), ("callType", S), ("language", S))
FILE_META = _struct(("projectFilePath", S), ("gitRepoUrl", S), ("gitBranch", S))
CHANGES = _struct(
    ("eventId", S),
    ("projectName", S),
    ("absoluteFilePath", S),
    ("gitRepoUrl", S),
    ("gitBranch", S),
    ("classpathEntries", STRINGS),
    ("sourcepathEntries", STRINGS),
    ("oldFileIdentifier", S),
    ("newProjectFilePath", S),
    ("changeType", S),
    ("language", S),
    ("timestamp", T.TimestampType()),
    ("reason", S),
)
CHANGE_TYPES = ("SOURCE_ADDED", "SOURCE_DELETED", "SOURCE_MODIFIED", "CASCADE_UPDATE")

CALLS, MATCHES = "CALLS", "MATCHES"
#: Edge type -> (from label, to label).
EDGE_LABELS = {
    "CALLS": ("functions", "functions"),
    "PACKAGE_TO_UNIT": ("packages", "units"),
    "UNIT_TO_FUNCTION": ("units", "functions"),
    "ENDPOINT_TO_FUNCTION": ("endpoints", "functions"),
    "FUNCTION_TO_ENDPOINT": ("functions", "endpoints"),
    "MATCHES": ("endpoints", "endpoints"),
}
STRUCTURE = ("PACKAGE_TO_UNIT", "UNIT_TO_FUNCTION", "ENDPOINT_TO_FUNCTION", "FUNCTION_TO_ENDPOINT")
#: What later batches need to know of sources that they do not read again. A type of a deleted file stays, without its file.
def _list(*fields: tuple[str, T.DataType]) -> T.ArrayType:
    return T.ArrayType(_struct(*fields))


SHAPES = _struct(
    ("id", S), ("projectFilePath", S), ("kind", S), ("supers", STRINGS), ("fields", _list(("name", S), ("type", S))),
    ("methods", _list(("name", S), ("params", STRINGS), ("returns", S), ("erased", S), ("varargs", B))), ("ancestors", _list(("name", S), ("depth", I), ("args", STRINGS))),
)
FILES = _struct(("id", S), ("projectFilePath", S), ("gitRepoUrl", S), ("gitBranch", S), ("package", S), ("names", STRINGS), ("error", S))
UNRESOLVED = _struct(("id", S), ("callerId", S), ("site", I), ("name", S), ("lineNumber", I), ("ownerType", S), ("reason", S))
TABLES = {"packages": PACKAGES, "units": UNITS, "functions": FUNCTIONS, "endpoints": ENDPOINTS, "edges": EDGES}
AUXILIARY = {"shapes": SHAPES, "files": FILES, "unresolved": UNRESOLVED}
