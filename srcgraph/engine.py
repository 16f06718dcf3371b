"""The engine: a store, the sources behind it, and the calls a user makes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .operators import extract as X
from .operators import facts
from .operators import graph as G
from .operators.staging import all_staged, in_memory, local, scratch, small, staged, together, values
from .operators.store import GraphStore
from .sources import config as C
from .sources import requests as Q
from .sources import rules as R
from .streaming import incremental as I

#: Files and bytes of a batch that is planned on the driver, at most.
SMALL_FILES, SMALL_BYTES = 200, 8_000_000


class Engine:
    """
    sources: the current files, (projectFilePath, gitRepoUrl, gitBranch, content), asked for at each batch.
    config: (path, content) of configuration files. symbols: (owner, name, params, returnType) of types outside the sources;
    calls into those under a prefix of whitelist are kept.
    rules: endpoint rules; endpoints=False leaves them out. filters: DataFrame of call targets -> Column, which calls to keep besides the
    built-in ones. processors: types -> more rows by table (extract.build). enrichers: tables -> tables, applied to what was read before it
    is stored; both by ascending priority. strict: a
    receiver of unknown type fits no rule. nested_types: enums, annotations, records and nested types too.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        sources: Callable[[], DataFrame],
        config: Callable[[], DataFrame] | None = None,
        symbols: DataFrame | None = None,
        rules: list[dict] | None = None,
        endpoints: bool = True,
        filters: tuple[Callable[[DataFrame], Column], ...] = (),
        enrichers: tuple[Callable[[dict], dict], ...] = (),
        strict: bool = False,
        nested_types: bool = False,
        whitelist: tuple[str, ...] = (),
        processors: tuple[Callable[[DataFrame], dict], ...] = (),
    ):
        self.spark, self.store, self.sources, self.config, self.symbols = spark, GraphStore(spark, root), sources, config, symbols
        self.rules = R.load() if rules is None else R.arrange(rules)
        self.endpoints, self.filters, self.enrichers, self.strict, self.nested_types = endpoints, filters, enrichers, strict, nested_types
        self.whitelist, self.processors = whitelist, processors

    # --- reading sources

    def parse(self, some: DataFrame) -> DataFrame:
        """Facts of some files, in the types of nothing else."""
        dictionary = C.dictionary(C.entries(self.config())) if self.config else None
        return facts.parse_sources(some, dictionary, self.rules if self.endpoints else [], self.nested_types)

    def build(self, some: DataFrame) -> dict[str, DataFrame]:
        """All tables of some files. Types that the batch leaves alone are known from the store."""
        stored = self.store.read_all() if self.store.versions() else None
        return self._tables(*self._front(staged(self.parse(some), "facts"), stored, some))

    def _front(self, parsed: DataFrame, stored: dict | None, files: DataFrame):
        """(facts with names resolved, shapes, the types of other files)."""
        world = None
        if stored is not None:
            ids = parsed.select("package", F.explode("shapes.name").alias("name")).select(F.concat_ws(".", "package", "name").alias("id"))
            others = G.without(G.without(stored["shapes"], "projectFilePath", files.select("projectFilePath")), "id", ids)
            world = X.R.World(others, in_memory())
        return (*X.front(parsed, self.symbols, world), world)

    def _tables(self, known: DataFrame, shapes: DataFrame, world) -> dict[str, DataFrame]:
        tables = X.tables(known, shapes, world, self.rules, self.symbols, self.strict, self.endpoints, self.filters, self.whitelist, self.processors)
        own = {k: tables[k] for k in schema.TABLES}
        for enrich in X.in_order(self.enrichers):
            own = enrich(own)
        return tables | own

    # --- changes

    def apply(self, changes: DataFrame) -> None:
        """Take a batch of schema.CHANGES rows into the store, whole or not at all.

        Read again are the changed files and all that use, by name, a type whose members or supertypes changed, or one below it, until
        no more types change; so a batch gives what reading everything gives. Small batches (SMALL_FILES, SMALL_BYTES) are planned
        on the driver: what is in the size of the batch is collected, and the store is scanned with literal filters.
        """
        with scratch(self.spark):
            last = I.dispatch(I.latest(changes)).select("projectFilePath", "action")
            few = local(last) if last.limit(SMALL_FILES + 1).count() <= SMALL_FILES else None
            if few is not None:
                with small():
                    deltas = self._plan(few, SMALL_FILES)
                    if deltas is not None:
                        self.store.commit(deltas)
                        return
            self.store.commit(self._plan(staged(last, "changes")))

    def _sources(self, files: DataFrame, most: int | None) -> DataFrame | None:
        """The current text of files; none if they are too many for a small batch."""
        sources = self.sources()
        if most is None:
            return sources.join(files, "projectFilePath", "left_semi")
        paths = values(files)
        if len(paths) > most:
            return None
        some = sources.where(F.col("projectFilePath").isin(paths))
        size = some.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first() if len(paths) > 1 else (1, 0)
        return None if size[0] > most or size[1] > SMALL_BYTES else local(some)

    def _plan(self, last: DataFrame, most: int | None = None) -> dict | None:
        """What the batch does to each table; most: files that a small batch may read, None is returned beyond."""
        stored = self.store.read_all() if self.store.versions() else None
        files = staged(last.where("action <> 'delete'").select("projectFilePath"), "files")
        texts = self._sources(files, most)
        if texts is None:
            return None
        parsed = staged(self.parse(texts), "facts")
        while True:
            affected = staged(files.unionByName(last.select("projectFilePath")).distinct(), "affected")
            known, shapes, world = self._front(parsed, stored, files)
            if stored is None:
                break
            more = self._dependents(stored, files, affected, shapes)
            if more is None:
                break
            texts = self._sources(more, most if most is None else most - len(values(files)))
            if texts is None:
                return None
            parsed, files = parsed.unionByName(staged(self.parse(texts), "facts")), staged(files.unionByName(more).distinct(), "files")
        fresh = all_staged(self._tables(known, shapes, world), "fresh")
        return I.replace_files(stored or self.store.read_all(), last, fresh)

    def _dependents(self, stored: dict, files: DataFrame, affected: DataFrame, shapes: DataFrame) -> DataFrame | None:
        """(projectFilePath): files besides the affected ones that use what changed, or whose functions share an endpoint with a file read again; None without any."""
        def by_type() -> DataFrame | None:
            changed = staged(I.touched(G.only(stored["shapes"], "projectFilePath", files), shapes), "touched")
            return None if changed.isEmpty() else I.users(changed, stored["shapes"], stored["files"])

        def by_endpoint() -> DataFrame | None:
            points = staged(G.only(stored["endpoints"], "projectFilePath", affected).select("id"), "old-points")
            if points.isEmpty():
                return None
            by = G.edges_of(stored["edges"], "ENDPOINT_TO_FUNCTION", "FUNCTION_TO_ENDPOINT")
            ends = [G.only(by, a, points).select(F.col(b).alias("id")) for a, b in (("fromNodeId", "toNodeId"), ("toNodeId", "fromNodeId"))]
            return G.only(stored["functions"], "id", staged(ends[0].unionByName(ends[1]).distinct(), "linked")).select("projectFilePath")

        found = [x for x in together([by_type, by_endpoint]) if x is not None]
        if not found:
            return None
        more = staged(reduce(DataFrame.unionByName, found).distinct().join(affected, "projectFilePath", "left_anti").where("projectFilePath is not null"), "dependents")
        return None if more.isEmpty() else more

    def request(self, method: str, body: dict) -> dict:
        """A PUT (changed) or DELETE (deleted) of one file, answered like the service: code, message, data."""
        try:
            row = Q.change_of(method, body)
        except ValueError as e:
            return Q.answer(400, str(e))
        try:
            self.apply(self.spark.createDataFrame([tuple(row.get(f.name) for f in schema.CHANGES)], schema.CHANGES))
        except Exception as e:
            return Q.answer(500, str(e).splitlines()[0] if str(e) else type(e).__name__)
        return Q.answer(200, "success")

    def file_added(self, path: str) -> dict:
        return self.request("POST", {"projectFilePath": path})

    def file_modified(self, path: str) -> dict:
        return self.request("PUT", {"projectFilePath": path})

    def file_deleted(self, path: str) -> dict:
        return self.request("DELETE", {"projectFilePath": path})

    def follow(self, folder: str, checkpoint: str):
        """Read a folder of change files as a stream, batch by batch, to its end."""
        return I.stream_changes(self.spark, folder, self.apply, checkpoint)

    # --- look-ups

    def who_calls_me(self, path: str) -> DataFrame:
        t = self.store.read()
        return G.who_calls_me_meta(t["edges"], t["functions"], path)

    def nodes_by_file(self, table: str, path: str) -> DataFrame:
        return G.read_defaults(G.nodes_by_file(self.store.read()[table], path))

    def endpoints_by_identity(self, identity: str, direction: str | None = None) -> DataFrame:
        return G.read_defaults(G.by_identity(self.store.read()["endpoints"], identity, direction))

    def unresolved_calls(self) -> DataFrame:
        """Call sites without a target, and why."""
        return self.store.read_all()["unresolved"].withColumnRenamed("id", "projectFilePath")

    def summary(self) -> DataFrame:
        return G.graph_summary(self.store.read())
