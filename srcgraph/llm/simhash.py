"""SimHash near-duplicates by exact tiled comparison.

Fingerprints are compared as whole tiles: numpy exclusive-or and bit counts over blocks, skipping
block pairs whose population counts differ beyond the radius (no pair within the radius is lost,
since |popcount(a) - popcount(b)| <= popcount(a ^ b), for the whole word and for each part of it).
Equal fingerprints are one class from the start, so copies never meet in pairs; a tile pair returns
a spanning forest of its links, not the links, so thousands of near copies stay linear.

Cases: null or empty text has fingerprint 0 and is linked like any other; a null doc_id keeps its
row and takes its group's component; repeated rows keep their rows; long texts are hashed a block at a time; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

RADIUS = 4
#: Fingerprints in a tile, at most; a tile pair is one task's memory (16 bytes each).
TILE = 1 << 18
TILE_LEAST = 1024
SEED = 42


#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20
SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def words_in_blocks(raw: bytes):
    """Lists of words, in order, of about BLOCK bytes of text each."""
    at = 0
    while at < len(raw):
        cut = SPACE.search(raw, at + BLOCK) if at + BLOCK < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end


def fingerprint(raw: bytes, shingle: int) -> int:
    """The SimHash of a lower-cased text; without a word 0."""
    import xxhash

    xx = xxhash.xxh64_intdigest
    total, n, carry = np.zeros(64, np.int64), 0, []
    for words in words_in_blocks(raw):
        words = carry + words
        if len(words) >= shingle:
            s = b" ".join(words)
            ends = np.append(np.flatnonzero(np.frombuffer(s, np.uint8) == 32), len(s))
            at = [0, *(ends[:-1] + 1).tolist()]
            h = np.fromiter((xx(s[a:b], SEED) for a, b in zip(at, ends[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1)
            for j in range(0, len(h), 1 << 14):
                part = h[j : j + (1 << 14)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
                total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
            n += len(h)
            words = words[len(words) - shingle + 1 :]
        carry = words
    if not n:
        return xx(b" ".join(carry), SEED) if carry else 0
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, keep: str | None = None) -> DataFrame:
    """(doc_id, fp): one 64-bit SimHash per document, from XXH64 of its word shingles. keep: all columns, and fp under this name."""
    lower = C.LOWER_BYTES.tobytes()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            out = np.array([fingerprint((t.as_py() or "").encode().translate(lower), shingle) for t in texts], np.uint64)
            fp = pa.array(out.view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], [*batch.schema.names, keep]) if keep else pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], ["doc_id", "fp"])

    C.small_batches(docs.sparkSession)
    if keep:
        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(keep, T.LongType())]))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def block_links(a: np.ndarray, b: np.ndarray | None, radius: int):
    """Yield index pairs (i in a, j in b) within radius; b None: within a. Blocks share the bit counts of the parts."""

    def blocks(x):
        parts = np.bitwise_count(x.astype("<u8").view("<u2").reshape(-1, 4)).astype(np.int64)
        key = ((parts[:, 0] * 17 + parts[:, 1]) * 17 + parts[:, 2]) * 17 + parts[:, 3]
        order = np.argsort(key, kind="stable")
        key = key[order]
        cuts = np.flatnonzero(np.diff(key, prepend=-1))
        # long runs are cut, so that a comparison is at most 1024 x 4096
        cuts = np.unique(np.concatenate([cuts, np.arange(0, len(x), 1024)]))
        return x[order], order, cuts, np.append(cuts[1:], len(x)), parts[order][cuts]

    xa, oa, sa, ea, pa_ = blocks(a)
    xb, ob, sb, eb, pb = (xa, oa, sa, ea, pa_) if b is None else blocks(b)
    for k in range(len(sa)):
        near = np.abs(pb - pa_[k]).sum(1) <= radius
        if b is None:
            near[:k] = False
        hit = np.flatnonzero(near)
        if not len(hit):
            continue
        left = xa[sa[k] : ea[k]]
        index = np.concatenate([np.arange(sb[j], eb[j]) for j in hit])
        for c in range(0, len(index), 4096):
            right = index[c : c + 4096]
            i, j = np.nonzero(np.bitwise_count(left[:, None] ^ xb[right][None, :]) <= radius)
            if len(i):
                yield oa[sa[k] + i], ob[right[j]]


def tile_links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) between class representatives whose fingerprints differ in at most radius bits: a spanning forest of each tile pair.

    classes: (fp, rep), one row a fingerprint. A tile holds fingerprints of one population count; a count
    with more than a tile's worth is dealt to several by hash. Only tiles whose counts differ by at most
    the radius meet, as an equi-join on the pair of tiles.
    """
    spark = classes.sparkSession
    counts = {r["p"]: r["n"] for r in classes.groupBy(F.bit_count("fp").alias("p")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    if not counts:
        return spark.createDataFrame([], "u long, v long")
    size = min(tile, max(TILE_LEAST, -(-sum(counts.values()) // 16)))
    tiles = F.array(*[F.lit(max(1, -(-counts.get(p, 0) // size))) for p in range(65)])
    here = F.array(*[F.lit(p in counts) for p in range(65)])
    rows = (
        classes.select("fp", "rep", F.bit_count("fp").cast("int").alias("p"))
        .withColumn("b", F.pmod(F.xxhash64("fp"), F.get(tiles, F.col("p"))).cast("int"))
        .withColumn("q", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - radius), F.least(F.lit(64), F.col("p") + radius))))
        .where(F.get(here, F.col("q")))
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.get(tiles, F.col("q")) - 1)))
        .withColumn("first", F.struct("p", "b") <= F.struct(F.col("q").alias("p"), F.col("c").alias("b")))
        .select(
            F.when(F.col("first"), F.concat_ws("/", "p", "b", "q", "c")).otherwise(F.concat_ws("/", "q", "c", "p", "b")).alias("pair"),
            (~F.col("first")).alias("right"),
            "fp",
            "rep",
        )
    )

    def compare(t):
        import pyarrow as pa

        fp = t.column("fp").to_numpy().view(np.uint64)
        rep, right = t.column("rep").to_numpy(), t.column("right").to_numpy(zero_copy_only=False)
        first, second = np.flatnonzero(~right), np.flatnonzero(right)
        p1, b1, p2, b2 = t.column("pair")[0].as_py().split("/")
        own = (p1, b1) == (p2, b2)
        label, us, vs, held = np.arange(len(fp)), [], [], 0
        if own or len(second):
            for i, j in block_links(fp[first], None if own else fp[second], radius):
                us.append(first[i])
                vs.append(first[j] if own else second[j])
                held += len(i)
                if held > 2_000_000:
                    label = C.local_components(len(fp), np.concatenate(us), np.concatenate(vs), label)
                    us, vs, held = [], [], 0
            if us:
                label = C.local_components(len(fp), np.concatenate(us), np.concatenate(vs), label)
        out = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"u": rep[out], "v": rep[label[out]]})

    return rows.groupBy("pair").applyInArrow(compare, "u long, v long")


def groups(docs: DataFrame, radius: int = RADIUS, shingle: int = 4, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, group, component_id): fingerprints linked to each other, and the smallest doc_id among them."""
    fp = C.staged(fingerprints(docs, shingle), "simhash-fp")
    classes = C.staged(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    parts = C.components(tile_links(classes.select("fp", F.col("fp").alias("rep")), radius, tile), "simhash")
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    return fp, C.staged(named.join(least, "group").select("fp", "group", "component_id"), "simhash-groups")


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = 4, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    fp, named = groups(docs, radius, shingle, tile)
    return fp.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(C.table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: that of the smallest doc_id.

    Rows that repeat a doc_id are rows like any other, so of equal ones a single one stays, that of the text that sorts first; a group without any
    doc_id keeps one row too; texts without words are one group; an empty table gives no rows.
    """
    fp, named = groups(docs)
    rows = C.staged(fp.join(named, "fp"), "simhash-rows")
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    plain = rows.where("doc_id = component_id").join(ids.where("n = 1 and doc_id is not null"), "doc_id", "left_semi").select("doc_id")
    id_, odd_, fp_, group_, row_ = (C.free_name(x, docs.columns) for x in ("__id", "__odd", "__fp", "__group", "__row"))
    key = F.col("doc_id").cast("long")
    kept = docs.join(plain.withColumnRenamed("doc_id", id_), key == F.col(id_), "left_semi")
    odd = C.staged(ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias(odd_)), "simhash-odd")
    if odd.isEmpty():
        return kept
    some = fingerprints(docs.join(odd, key.eqNullSafe(F.col(odd_)), "left_semi"), keep=fp_)
    met = some.join(named.select(F.col("fp").alias(fp_), F.col("group").alias(group_), F.col("component_id").alias(id_)), fp_).where(key.eqNullSafe(F.col(id_)))
    best = met.groupBy(group_).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(row_))
    return kept.unionByName(best.select(f"{row_}.*"))
