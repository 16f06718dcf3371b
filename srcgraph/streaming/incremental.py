"""Incremental maintenance: what a batch of file changes does to the graph, as plans over tables.

Order of a batch: dependents of all changed files first, then delete, then insert, then calls and
placeholders, so incoming calls survive a change. One batch gives one new version of the tables, so applying it twice gives the
same graph, and the same as reading all files anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..operators import graph as G
from ..operators import mutate as M
from ..operators.staging import all_staged, in_memory, staged, together, values

#: Change type -> action.
ACTIONS = {"SOURCE_ADDED": "add", "SOURCE_MODIFIED": "modify", "SOURCE_DELETED": "delete", "CASCADE_UPDATE": "cascade"}


def dispatch(changes: DataFrame) -> DataFrame:
    """changes with the action of their type; an unknown type stops the batch."""
    action = S.mapping_lookup("changeType", ACTIONS)
    unknown = F.concat(F.lit("no handler for change type "), F.coalesce("changeType", F.lit("null")))
    return changes.withColumn("action", F.coalesce(action, F.raise_error(unknown).cast("string")))


def with_file(changes: DataFrame) -> DataFrame:
    return changes.withColumn("projectFilePath", F.coalesce("newProjectFilePath", "oldFileIdentifier"))


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each file."""
    return G.first_by(with_file(changes), ["projectFilePath"], [F.desc("timestamp"), F.desc("eventId")])


def cascade_events(changes: DataFrame, edges: DataFrame, functions: DataFrame) -> DataFrame:
    """One CASCADE_UPDATE a file that calls into a modified or deleted one and is not itself among those."""
    moved = latest(changes).where(F.col("changeType").isin("SOURCE_MODIFIED", "SOURCE_DELETED")).select("projectFilePath")
    found = G.callers(edges, functions, moved).select("projectFilePath", "gitRepoUrl", "gitBranch").distinct().join(moved, "projectFilePath", "left_anti")
    known = {
        "eventId": S.edge_id(F.lit("cascade"), "projectFilePath"),
        "oldFileIdentifier": F.col("projectFilePath"),
        "gitRepoUrl": F.col("gitRepoUrl"),
        "gitBranch": F.col("gitBranch"),
        "changeType": F.lit("CASCADE_UPDATE"),
        "language": F.lit("java"),
        "timestamp": F.current_timestamp(),
        "reason": F.lit("a called file changed"),
    }
    return found.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.CHANGES])


def replace_calls(edges: DataFrame, functions: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Calls out of files are new; all other edges stay."""
    return M.delete_outgoing(edges, functions, files).unionByName(new.select(*edges.columns))


def delete_keeping_callers(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """Delete files' nodes and outgoing calls; functions that other files still call stay as placeholders."""
    f, e = tables["functions"], tables["edges"]
    gone = M.nodes_of_files(tables, files)
    kept = M.delete_outgoing(e, f, files)
    called = G.edges_of(kept, schema.CALLS).select(F.col("toNodeId").alias("id")).distinct()
    held = f.join(files.select("projectFilePath").distinct(), "projectFilePath", "left_semi").join(called, "id", "left_semi")
    ghost = G.placeholder_rows(held.select("id"))
    lost = gone.join(held.select("id"), "id", "left_anti")
    out = M.detach(tables | {"edges": kept}, lost)
    others = f.join(gone, "id", "left_anti").select(*f.columns)
    return out | {"functions": others.unionByName(ghost.select(*[c for c in f.columns]))}


#: What a batch does to one table: ids that go (column id) and rows that come.
Delta = tuple[DataFrame, DataFrame]


def plan_changes(tables: dict[str, DataFrame], changes: DataFrame, sources: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, Delta]:
    """What a batch of changes does to each table, in the size of the batch: big tables are only scanned, against small sides.

    sources: current files (projectFilePath, content, git columns); build: sources -> node and edge tables with unresolved
    ends allowed. Read again are the files added or modified, and, one hop, those that call into
    a modified or deleted one. Dependents are found before anything goes.
    """
    last = staged(dispatch(latest(changes)).select("projectFilePath", "action"), "changes")
    moved, asked = parts_of(last)
    dependents = G.callers(tables["edges"], tables["functions"], moved).select("projectFilePath").unionByName(asked).distinct().join(moved, "projectFilePath", "left_anti")
    affected = staged(last.where("action in ('add', 'modify')").select("projectFilePath").unionByName(dependents).distinct(), "affected")
    return replace_files(tables, last, all_staged(build(sources.join(affected, "projectFilePath", "left_semi")), "fresh"))


def parts_of(last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that changed themselves, files to be read again) of (projectFilePath, action)."""
    return last.where("action in ('modify', 'delete', 'add')").select("projectFilePath"), last.where("action = 'cascade'").select("projectFilePath")


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id): types whose shape differs between two versions of the same files."""
    print_ = F.xxhash64("kind", "supers", "fields", "methods", "ancestors")
    a, b = before.select("id", print_.alias("a")), after.select("id", print_.alias("b"))
    return a.join(b, "id", "full").where("not a <=> b").select("id")


def users(touched_ids: DataFrame, shapes: DataFrame, files: DataFrame) -> DataFrame:
    """(projectFilePath): files that use a touched type or one below it, by simple names."""
    below = G.only(shapes.select("id", F.explode("ancestors.name").alias("up")), "up", touched_ids)
    names = staged(touched_ids.select("id").unionByName(below.select("id")).select(F.substring_index("id", ".", -1).alias("name")).distinct(), "touched-names")
    return G.only(files.select("projectFilePath", F.explode("names").alias("name")), "name", names).select("projectFilePath").distinct()


def replace_files(tables: dict[str, DataFrame], last: DataFrame, fresh: dict[str, DataFrame]) -> dict[str, Delta]:
    """What it does to each table that the files of last (projectFilePath, action) are as fresh says.

    A file that was read again is replaced whole; calls into it from other files stay, and lead to placeholders where their target is
    gone. Placeholders that no call is left for go. With the auxiliary tables (files, shapes) packages follow their files, and types of
    deleted files stay known without a file.
    """
    edges, functions = tables["edges"], tables["functions"]
    ids = lambda t: t.select("id").distinct()
    moved, _ = parts_of(last)
    whole = "files" in fresh
    read, own = together([
        lambda: staged((fresh["files"] if whole else fresh["units"]).select("projectFilePath").unionByName(moved).distinct(), "read"),
        lambda: staged(ids(fresh["functions"]), "own"),
    ])
    rest = lambda: _of_files(tables, last, fresh, read) if whole else {"packages": (ids(fresh["packages"]), fresh["packages"].dropDuplicates(["id"]))}
    gone, rest = together([lambda: staged(M.nodes_of_files(tables, read), "gone"), rest])
    call = F.col("relationshipType") == schema.CALLS

    def meetings() -> DataFrame:
        """One pass over the edges: those that go, and what they and the calls that stay lead to."""
        if in_memory() and len(some := values(gone)) <= G.LITERALS:
            ends = edges.withColumn("out", F.col("fromNodeId").isin(some)).withColumn("into", F.col("toNodeId").isin(some))
        else:
            side = lambda end, flag: G.few(gone.select(F.col("id").alias(end), F.lit(True).alias(flag)))
            ends = edges.join(side("fromNodeId", "out"), "fromNodeId", "left").join(side("toNodeId", "into"), "toNodeId", "left")
        ends = ends.where("out or into").withColumn("stays", call & ~F.coalesce("out", F.lit(False)))
        return staged(ends.select(F.expr("if(stays, null, id)").alias("id"), F.when(call, F.col("toNodeId")).alias("target"), "stays", F.coalesce("into", F.lit(False)).alias("inner")).distinct(), "ends")

    def points_and_edges() -> tuple[DataFrame, DataFrame]:
        old = G.without(tables["endpoints"], "id", gone)
        points = fresh["endpoints"].dropDuplicates(["id"])
        points = staged(points.join(ids(G.only(old, "id", points.select("id"))), "id", "left_anti"), "points")
        near = points.select("id", "direction", "matchIdentity").unionByName(G.only(old, "matchIdentity", points.select("matchIdentity")).select("id", "direction", "matchIdentity"))
        matches = M.edge_rows(G.endpoint_matches(near).withColumn("relationshipType", F.lit(schema.MATCHES)))
        return points, staged(fresh["edges"].select(*schema.EDGES.names).unionByName(matches.select(*schema.EDGES.names)).dropDuplicates(["id"]), "new-edges")

    ends, (points, new_edges) = together([meetings, points_and_edges])
    gone_edges = ends.where("id is not null").select("id")
    held = ends.where("stays").select(F.col("target").alias("id"))  # still called by other files
    left = ends.where("not stays and target is not null and not inner").select(F.col("target").alias("id")).distinct()
    called = G.call_ids(new_edges)

    def ghosts() -> DataFrame:
        wanted = staged(held.unionByName(called).distinct().join(own, "id", "left_anti"), "wanted")
        there = G.without(G.only(functions.select("id"), "id", wanted), "id", gone)
        made = G.placeholder_rows(wanted.join(there, "id", "left_anti"))
        return staged(fresh["functions"].dropDuplicates(["id"]).unionByName(made.select(*schema.FUNCTIONS.names)), "new-functions")

    def lonely() -> DataFrame:
        """Placeholders that lost their last call."""
        some = staged(G.only(functions.where("isPlaceholder").select("id"), "id", left).join(called, "id", "left_anti"), "lonely")
        if some.isEmpty():
            return some
        still = G.without(G.only(G.edges_of(edges, schema.CALLS).select("fromNodeId", "toNodeId"), "toNodeId", some), "fromNodeId", gone)
        return some.join(still.select(F.col("toNodeId").alias("id")).distinct(), "id", "left_anti")

    new_functions, lost = together([ghosts, lonely])
    fresh_units = fresh["units"].dropDuplicates(["id"])
    return rest | {
        "units": (gone.unionByName(ids(fresh_units)).distinct(), fresh_units),
        "functions": (gone.unionByName(ids(new_functions)).unionByName(lost).distinct(), new_functions),
        "endpoints": (gone, points),
        "edges": (gone_edges.unionByName(ids(new_edges)).distinct(), new_edges),
    }


def _of_files(tables: dict[str, DataFrame], last: DataFrame, fresh: dict[str, DataFrame], read: DataFrame) -> dict[str, Delta]:
    """Packages by the files that are left in them, and the auxiliary tables."""
    from ..operators import extract as X

    ids = lambda t: t.select("id").distinct()
    files = tables["files"]
    before = G.only(files, "projectFilePath", read)
    names = staged(before.select("package").unionByName(fresh["files"].select("package")).where("package is not null").distinct(), "packages")
    others = G.without(G.only(files, "package", names), "projectFilePath", read)
    packages = X.packages(others.unionByName(fresh["files"].select(*files.columns)).join(names, "package", "left_semi"))
    extra = fresh["packages"].join(names.withColumnRenamed("package", "id"), "id", "left_anti")  # of processors
    deleted = last.where("action = 'delete'").select("projectFilePath")
    shapes = G.without(G.only(tables["shapes"], "projectFilePath", read), "id", fresh["shapes"].select("id"))
    kept = shapes.join(deleted, "projectFilePath", "left_semi").withColumn("projectFilePath", F.lit(None).cast("string"))
    paths = read.select(F.col("projectFilePath").alias("id"))
    return {
        "packages": (names.select(F.col("package").alias("id")).unionByName(ids(extra)), packages.unionByName(extra.select(*packages.columns))),
        "shapes": (ids(shapes).unionByName(ids(fresh["shapes"])), fresh["shapes"].unionByName(kept.select(*fresh["shapes"].columns))),
        "files": (paths, fresh["files"]),
        "unresolved": (paths, fresh["unresolved"]),
    }


def merge(tables: dict[str, DataFrame], deltas: dict[str, Delta]) -> dict[str, DataFrame]:
    """The tables after a batch."""
    return {k: t if k not in deltas else t.join(deltas[k][0], "id", "left_anti").select(*t.columns).unionByName(deltas[k][1].select(*t.columns)) for k, t in tables.items()}


def apply_changes(tables: dict[str, DataFrame], changes: DataFrame, sources: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    return merge(tables, plan_changes(tables, changes, sources, build))


def stream_changes(spark, source: str, handle: Callable[[DataFrame], None], checkpoint: str):
    """Read a folder of JSON change files as a stream and hand each micro-batch over; ends when the folder is read."""
    stream = spark.readStream.schema(schema.CHANGES).json(source)
    return stream.writeStream.foreachBatch(lambda batch, _: handle(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
