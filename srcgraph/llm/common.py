"""Shared pieces: tables, staged results, byte-level words, rolling hashes, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and all runs on one machine, as in tests, one that goes with this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="srcgraph-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors. The step's shuffle files go with it."""
    spark, at = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out.staged_at = at
    return out


def let_go(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches of whole texts that Python workers hold."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_name(name: str, columns) -> str:
    """name, or one like it that no column has."""
    while name in columns:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


# --- words of UTF-8 buffers, vectorised over many documents at once -----------------------------

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_pow[0]) < n:
        size = 1 << (n - 1).bit_length()
        inv = np.uint64(pow(int(_B), -1, 1 << 64))
        for i, base in enumerate((_B, inv)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[i] = np.multiply.accumulate(a)
    return _pow[0], _pow[1]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def class_table(pattern: str) -> np.ndarray:
    """256 flags: bytes that belong to words. "space": all but ASCII white space; "alnum": ASCII letters, digits and all non-ASCII bytes."""
    t = np.zeros(256, bool)
    if pattern == "space":
        t[:] = True
        t[[ord(c) for c in WS]] = False
    else:
        t[128:] = True
        t[48:58] = t[65:91] = t[97:123] = True
    return t


LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32


def text_blocks(column, ids, max_bytes: int = 1 << 20):
    """From an Arrow string column: (ids, buffer, offsets) for runs of documents of about max_bytes; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield ids[i:j], buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray, flags: np.ndarray):
    """(starts, ends, first): byte spans of words, none across documents, and the index of each document's first word."""
    m = flags[buf]
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    inner = offsets[:-1]
    inner = inner[inner < n]
    before[inner] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes that word_hashes takes at a time: its sums are eight times as wide.
HASHED = 1 << 20


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int | None = None) -> np.ndarray:
    """64-bit hashes of byte spans (ascending, apart) by prefix sums of a polynomial, position-free and mixed; memory is that of a block of bytes."""
    block = block or HASHED
    up, down = _powers(block + 1)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + block, "right"))
        if j <= i:  # a word longer than a block
            out[i] = _long_hash(buf[a : int(ends[i])], up, block)
            i += 1
            continue
        part = buf[a : int(ends[j - 1])]
        s, e = starts[i:j] - a, ends[i:j] - a
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix64(out)


def _long_hash(word: np.ndarray, up: np.ndarray, block: int) -> int:
    h, scale, mask = 0, 1, (1 << 64) - 1
    for k in range(0, len(word), block):
        part = word[k : k + block]
        h = (h + int(((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)]).sum()) * scale) & mask
        scale = scale * int(up[block]) & mask
    return (h + len(word)) & mask


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; fewer words than k: none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix64(h)


# --- connected components -------------------------------------------------------------------------


def local_components(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each of n nodes' component, by hooking and pointer jumping."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not ((up := label[label]) == label).all():
            label = up


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for all nodes of edges (u, v): alternating large-star and small-star steps.

    Each step groups edges by one end and links the others to the least; it ends when the edges
    stop changing, after about log(nodes) squared steps at most. Every step is written to the shared folder. Nodes' component is the smallest id.
    A star's centre may be an end of a third of all edges: minima are taken on the map side first, and the joins' other side has one
    row a node, so that a partition of such a centre is split by Spark where it is measured to be large.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = staged(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    last, i = None, 0
    while True:
        g = both(e)
        least = g.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = g.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-{i + 1}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last, i = tuple(now), i + 1
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
