"""The graph on disk: Parquet versions and a list of those that count.

A version is a base (whole tables) or a delta (ids that go and rows that come), so a batch writes in its own size. A version
counts once its entry is in the list, which one writer alone can create, so readers see all of a batch or nothing of it. Reading joins the rows of
the last base and the deltas after it with the last version that dropped their id: one join, however many deltas. compact() writes a new base.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from .staging import together

ALL = schema.TABLES | schema.AUXILIARY


class Version(dict):
    __getattr__ = dict.__getitem__


class Tables(dict):
    """Tables by name, each read when it is asked for."""

    def __init__(self, names, read):
        super().__init__(dict.fromkeys(names))
        self._read = read

    def __getitem__(self, name):
        if super().__getitem__(name) is None:
            self[name] = self._read(name)
        return super().__getitem__(name)

    def items(self):
        return [(k, self[k]) for k in self]

    def values(self):
        return [self[k] for k in self]

    def __or__(self, other):
        return dict(self.items()) | other


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[Version]:
        """(n, kind, name, tables) of the last base and the deltas after it; tables: those with anything in them."""
        fs, at = self._files()
        if not fs.exists(at):
            return []
        out: list[Version] = []
        for name in sorted((s.getPath().getName() for s in fs.listStatus(at)), reverse=True):
            if name.startswith((".", "_")):
                continue
            stream = fs.open(self._path(f"versions/{name}"))
            try:
                out.append(Version(json.loads(bytes(stream.readAllBytes()).decode())))
            finally:
                stream.close()
            if out[-1].kind == "base":
                return out[::-1]
        if out:
            raise ValueError(f"{self.root}: deltas without a base")
        return []

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        at = self._path("versions")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _publish(self, n: int, kind: str, name: str, tables: list[str]) -> None:
        """Add a version; fails if another writer has taken its number."""
        fs, at = self._files()
        fs.mkdirs(at)
        stream = fs.create(self._path(f"versions/{n:012d}"), False)
        try:
            stream.write(bytearray(json.dumps({"n": n, "kind": kind, "name": name, "tables": sorted(tables)}).encode()))
        finally:
            stream.close()

    def _rows(self, rows: DataFrame, table: str, at: str) -> None:
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in ALL[table]]).write
        # the base's edges are parted by type; deltas are read together, so theirs are not
        (out.partitionBy("relationshipType") if table == "edges" and at.startswith("base") else out).parquet(f"{self.root}/{at}/{table}")

    def read(self) -> dict[str, DataFrame]:
        """The current tables; empty ones before the first write."""
        return self._read(schema.TABLES)

    def read_all(self) -> dict[str, DataFrame]:
        """The auxiliary tables too."""
        return self._read(ALL)

    def _read(self, tables) -> dict[str, DataFrame]:
        versions = self.versions()
        return Tables(tables, lambda k: self._table(k, tables[k], versions) if versions else self.spark.createDataFrame([], tables[k]))

    def _table(self, name: str, struct, versions: list) -> DataFrame:
        """The base, and all deltas in one scan; a row's version is that of its folder."""
        here = lambda what, some: self.spark.read.schema(struct if what == name else "id string").parquet(*[f"{self.root}/{v.name}/{what}" for v in some])
        base = [v for v in versions[:1] if name in v.tables]
        came = [v for v in versions[1:] if name in v.tables]
        gone = [v for v in versions[1:] if f"{name}-gone" in v.tables]
        names = struct.names
        if not gone:
            parts = [here(name, some).select(*names) for some in (base, came) if some]
            return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], struct)
        number = F.create_map(*[F.lit(x) for v in versions for x in (v.name, v.n)])
        of = lambda df: df.withColumn("__n", F.try_element_at(number, F.regexp_extract("_metadata.file_path", r"((?:base|delta)-[0-9a-f]{32})", 1)))
        rows = [here(name, base).select(*names, F.lit(versions[0].n).alias("__n"))] if base else []
        rows += [of(here(name, came)).select(*names, "__n")] if came else []
        last = of(here(f"{name}-gone", gone)).groupBy("id").agg(F.max("__n").alias("__gone"))
        return reduce(DataFrame.unionByName, rows).join(last, "id", "left").where("__gone is null or __n >= __gone").select(*names)

    def write(self, tables: dict[str, DataFrame]) -> str:
        """A new base. Parts may be read from the versions before."""
        at, known = f"base-{uuid.uuid4().hex}", self.versions()
        together([lambda k=k: self._rows(tables[k], k, at) for k in ALL if k in tables])
        self._publish(known[-1].n + 1 if known else 1, "base", at, [k for k in ALL if k in tables])
        return at

    def commit(self, deltas: dict[str, tuple[DataFrame | None, DataFrame | None]], compact_after: int = 20) -> str:
        """A delta (ids that go, rows that come; None: nothing); after many of them, a new base."""
        versions = self.versions()
        if not versions:
            return self.write({k: rows for k, (_, rows) in deltas.items() if rows is not None})
        at = f"delta-{uuid.uuid4().hex}"
        drop = lambda k, ids: ids.select(F.col("id").cast("string")).write.parquet(f"{self.root}/{at}/{k}-gone")
        gone = {k: ids for k, (ids, _) in deltas.items() if ids is not None}
        come = {k: rows for k, (_, rows) in deltas.items() if rows is not None}
        together([lambda k=k: drop(k, gone[k]) for k in gone] + [lambda k=k: self._rows(come[k], k, at) for k in come])
        self._publish(versions[-1].n + 1, "delta", at, [*come, *[f"{k}-gone" for k in gone]])
        return self.compact() if len(versions) >= compact_after else at

    def compact(self) -> str:
        return self.write(self.read_all())

    def truncate(self) -> int:
        """Empty all tables; returns the nodes left (none)."""
        self.write({k: self.spark.createDataFrame([], s) for k, s in ALL.items()})
        return sum(t.count() for k, t in self.read().items() if k != "edges")
