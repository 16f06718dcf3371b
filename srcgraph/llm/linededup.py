"""Line dedup with two Bloom filters.

Scan 1 builds, a partition at a time, a filter of hashes seen once and one of hashes seen twice
(a bit set again moves to the second). Partitions' filters are merged a segment at a time:
once = a | b, twice = a2 | b2 | (a & b), so no key held by two documents can be missed. Scan 2 shuffles only
keys whose bits are all in the second filter, for an exact count of documents and the document that
keeps the line. Scan 3 drops the others' lines.

The filter has BITS_A_LINE bits a line, at most BITS_MOST (64 MB): past that more keys are suspected
and shuffled, with the same result. Confirmed keys travel to scan 3 as a table of CONFIRMED_MOST
entries at most; a larger table is joined by document instead.

Cases: null or empty text is one empty line; a null doc_id counts as no document and never keeps a
confirmed line; rows that repeat a doc_id are one document when counting and each is cleaned; lines
under min_chars are never dropped; extra columns pass through, but n_lines and n_dropped of the
input are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BITS_A_LINE, BITS_LEAST, BITS_MOST = 16, 1 << 20, 1 << 29
SEGMENT = 1 << 20
CONFIRMED_MOST = 200_000
WS_BYTES = C.WS.encode()
LOWER = C.LOWER_BYTES.tobytes()


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space, A-Z lower-cased (line is already), if it has min_chars code points."""
    key = line.strip(WS_BYTES)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key


def _digests(text: str | None, min_chars: int) -> dict[bytes, bytes]:
    """Digest -> key of a text's distinct keys."""
    import xxhash

    out = {}
    for line in (text or "").encode().translate(LOWER).split(b"\n"):
        if (key := line_key(line, min_chars)) is not None:
            out[xxhash.xxh3_128_digest(key)] = key
    return out


def _positions(digests, bits: int) -> np.ndarray:
    """Two bit positions for each digest: a row each."""
    return (np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2) & np.uint64(bits - 1)).astype(np.int64)


def twice_filter(docs: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """(segment, bitmap): the bits of the twice-seen filter, merged over all partitions."""

    def build(batches):
        import pyarrow as pa

        held, n = [], 0
        once, twice = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def fold(once, twice, held):
            found, count = np.unique(np.concatenate([p.ravel() for p in held]), return_counts=True)
            twice = np.union1d(twice, np.concatenate([found[count > 1], np.intersect1d(found, once, assume_unique=True)]))
            return np.union1d(once, found), twice

        for batch in batches:
            for text in batch.column(0):
                if d := _digests(text.as_py(), min_chars):
                    held.append(_positions(d, bits))
                    n += len(d)
            if n > 500_000:
                once, twice = fold(once, twice, held)
                held, n = [], 0
        if held:
            once, twice = fold(once, twice, held)
        seg = np.unique(once // SEGMENT)
        rows = {"segment": [], "once": [], "twice": []}
        for s in seg.tolist():
            rows["segment"].append(s)
            for name, a in (("once", once), ("twice", twice)):
                i, j = np.searchsorted(a, (s * SEGMENT, (s + 1) * SEGMENT))
                rows[name].append(np.diff(a[i:j] - s * SEGMENT, prepend=0).astype("<u4").tobytes())
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    def merge(batches):
        import pyarrow as pa

        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = held.setdefault(s, (np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)))
                at = np.cumsum(np.frombuffer(a, "<u4"), dtype=np.int64)
                twice[at[once[at]]] = True
                once[at] = True
                twice[np.cumsum(np.frombuffer(b, "<u4"), dtype=np.int64)] = True
        for s, (_, twice) in held.items():
            yield pa.RecordBatch.from_pydict({"segment": [s], "bitmap": [np.packbits(twice).tobytes()]}, schema=pa.schema([("segment", pa.int32()), ("bitmap", pa.binary())]))

    parts = docs.select("text").mapInArrow(build, "segment int, once binary, twice binary")
    return parts.repartition(max(1, bits // SEGMENT // 8), "segment").mapInArrow(merge, "segment int, bitmap binary")


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(digest, keep): keys held by at least min_docs documents, and the largest doc_id that holds each."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    bits = min(BITS_MOST, max(BITS_LEAST, 1 << (BITS_A_LINE * lines - 1).bit_length()))
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in twice_filter(docs, min_chars, bits).toLocalIterator():
        bitmap[row.segment * (SEGMENT // 8) : (row.segment + 1) * (SEGMENT // 8)] = np.frombuffer(row.bitmap, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def suspects(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("key", pa.binary())])
        for batch in batches:
            bitmap, rows = shared.value, ([], [], [])
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not (d := _digests(text.as_py(), min_chars)):
                    continue
                at = _positions(d, bits)
                hit = ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)
                for (digest, key), h in zip(d.items(), hit.tolist()):
                    if h:
                        rows[0].append(i)
                        rows[1].append(digest)
                        rows[2].append(key)
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema)], schema=schema)

    found = docs.mapInArrow(suspects, "doc_id long, digest binary, key binary")
    each = found.groupBy("key", "doc_id").agg(F.first("digest").alias("digest"))
    exact = each.groupBy("key").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keep"), F.first("digest").alias("digest")).where(F.col("n") >= min_docs)
    return C.staged(exact.select("digest", "keep"), "line-dedup")


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, confirmed_most: int = CONFIRMED_MOST, counts: bool = True) -> DataFrame:
    """docs with repeated lines dropped from text, and n_lines and n_dropped (long); without counts just the columns of docs."""
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.drop("n_lines", "n_dropped") if counts else docs
    drop = C.free_name("__drop", docs.columns)
    confirmed = repeated_lines(docs, min_chars, min_docs)
    n = confirmed.count()
    told = ["n_lines", "n_dropped"] if counts else []
    schema = T.StructType([*docs.schema.fields, *[T.StructField(x, T.LongType()) for x in told]])
    if n <= confirmed_most:
        keep = {bytes(r.digest): r.keep for r in confirmed.collect()}
        table = spark.sparkContext.broadcast(keep)
        source = docs
    else:  # too many to hand out: each document gets its own, by joins
        table = None
        id_, sha_, own_ = (C.free_name(x, docs.columns) for x in ("__id", "__sha", "__own"))

        def own(batches):
            import pyarrow as pa

            for batch in batches:
                ids, shas, digests = [], [], []
                for i, text, sha in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    d = list(_digests(text.as_py(), min_chars))
                    ids += [i] * len(d)
                    shas += [sha] * len(d)
                    digests += d
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.string()), pa.array(digests, pa.binary())], ["doc_id", "sha", "digest"])

        # rows without doc_id are known by their text
        sha = F.when(F.col("doc_id").isNull(), F.sha2(F.col("text").cast("string"), 256))
        holds = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), sha.alias("sha")).mapInArrow(own, "doc_id long, sha string, digest binary")
        lost = holds.join(confirmed, "digest").where("doc_id is null or doc_id < keep")
        drops = lost.groupBy(F.col("doc_id").alias(id_), F.col("sha").alias(sha_)).agg(F.collect_set("digest").alias(drop))
        source = docs.withColumn(own_, sha)
        source = source.join(drops, source["doc_id"].cast("long").eqNullSafe(drops[id_]) & source[own_].eqNullSafe(drops[sha_]), "left").drop(id_, sha_, own_)

    def clean(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            names = batch.schema.names
            gone = None
            if table is None:
                gone = batch.column(names.index(drop))
                batch = batch.select([x for x in names if x != drop])
            keep = table.value if table is not None else {}
            at = batch.schema.names.index("text")
            ids, texts, n_lines, n_dropped = batch.column("doc_id").to_pylist(), [], [], []
            for row, text in enumerate(batch.column(at)):
                text = text.as_py()
                lines = (text or "").encode().split(b"\n")
                own = set(gone[row].as_py() or ()) if gone is not None else ()
                kept = []
                for line in lines:
                    key = line_key(line.translate(LOWER), min_chars)
                    if key is not None and (own or keep):
                        digest = xxhash.xxh3_128_digest(key)
                        if digest in own or (k := keep.get(digest)) is not None and (ids[row] is None or ids[row] != k):
                            continue
                    kept.append(line)
                texts.append(text if len(kept) == len(lines) else b"\n".join(kept).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            more = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())] if told else []
            yield pa.RecordBatch.from_arrays([*columns, *more], [*batch.schema.names, *told])

    return source.mapInArrow(clean, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, i AS pos, parts[i] AS line,
         translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
rep AS (
  SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id <> r.keep AS gone FROM lines l LEFT JOIN rep r ON l.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows where there is such a column.

    Every row stays: null and empty texts are one empty line and stay as they are; rows without doc_id never keep a repeated line; rows that
    repeat a doc_id are one document and are cleaned alike; an empty table gives no rows.
    """
    out = line_dedup(docs, counts=False)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
