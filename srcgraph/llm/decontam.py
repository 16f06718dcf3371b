"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are the queries, all documents the domains. An item of n shingles belongs to the size class of
the power of two b >= n; for that class documents are cut into windows of 2b shingles every b, so that a
run of n shingles lies whole in one window and short items meet sets of about their own size however
long the document is (Jaccard at least 0.19 where containment is 0.8). Windows' MinHash values come
from minima of blocks, shared by all classes. One equal value of PERMUTATIONS makes a candidate (missed
with probability under 5e-5); each is verified by exact containment of the item's shingles in the whole document.

Words: A-Z lower-cased, runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. Shingles: five words; an item of fewer
words is one shingle of all its words. Items are handed out in blocks of ITEMS_A_BLOCK items and
TEXT_A_BLOCK bytes at most, with one scan of the documents a block.

Cases: items or documents that are null, empty or without words match nothing; repeated items or
documents give one row per (doc_id, item_id); null ids are carried as null; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PERMUTATIONS = 48
THRESHOLD = 0.8
SHINGLE = 5
ITEMS_A_BLOCK, TEXT_A_BLOCK = 50_000, 64 << 20
MULTIPLIERS = C.mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
LOWER = C.LOWER_BYTES.tobytes()
#: Bytes outside words become spaces, A-Z lower case.
WORDS = bytes(int(C.LOWER_BYTES[i]) if C.class_table("alnum")[i] else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b" ".join(words), np.uint8)
    s, e, _ = C.word_spans(buf, np.array([0, len(buf)]), C.class_table("alnum"))
    return C.word_hashes(buf, s, e)


def index_items(rows: list[tuple[int | None, str | None]]) -> dict:
    """{shingle length: (block sizes used, values, item numbers and block sizes of the values, bitmap)} and the items' shingles."""
    items, by = [], {}
    for item_id, text in rows:
        words = words_of(text)
        if not words:
            continue
        k = min(SHINGLE, len(words))
        shingles = sorted({b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})
        h = np.unique(C.shingle_hashes(hashes_of(words), k))
        block = 1 << max(0, len(shingles) - 1).bit_length()
        by.setdefault(k, []).append((block, len(items), (h[:, None] * MULTIPLIERS).min(0)))
        items.append((item_id, k, shingles))
    index = {}
    for k, found in by.items():
        values = np.concatenate([m for _, _, m in found])
        owner = np.repeat([j for _, j, _ in found], PERMUTATIONS)
        block = np.repeat([b for b, _, _ in found], PERMUTATIONS)
        order = np.argsort(values, kind="stable")
        bits = 1 << min(28, max(16, (32 * len(values)).bit_length()))
        bitmap = np.zeros(bits, bool)
        bitmap[(values & np.uint64(bits - 1)).astype(np.int64)] = True
        index[k] = (sorted({b for b, _, _ in found}), values[order], owner[order], block[order], bitmap)
    return {"items": items, "index": index}


def candidates(words: np.ndarray, first: np.ndarray, k: int, index) -> set[tuple[int, int]]:
    """(document number, item number) with an equal MinHash value in a window of the item's class."""
    blocks, values, owner, block_of, bitmap = index
    count = np.diff(first)
    have = np.maximum(count - k + 1, 0)
    if not have.sum():
        return set()
    h = C.shingle_hashes(words, k)
    at = np.arange(len(words))
    doc_of_word = np.repeat(np.arange(len(count)), count)
    h = h[(at < first[doc_of_word] + have[doc_of_word])[: len(h)]]  # none across documents
    size = blocks[0]
    n = -(-have // size)
    doc = np.repeat(np.arange(len(count)), n)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(np.cumsum(have) - have, n) + inner * size
    low = np.empty((len(starts), PERMUTATIONS), np.uint64)
    for j in range(PERMUTATIONS):
        low[:, j] = np.minimum.reduceat(h * MULTIPLIERS[j], starts)
    found = set()
    for want in blocks:
        while size < want:
            even = np.flatnonzero(inner % 2 == 0)
            low = np.minimum.reduceat(low, even, axis=0)
            doc, inner, size = doc[even], inner[even] // 2, size * 2
        window = low.copy()
        same = np.flatnonzero(doc[:-1] == doc[1:])
        window[same] = np.minimum(low[same], low[same + 1])
        row, col = np.nonzero(bitmap[(window & np.uint64(len(bitmap) - 1)).astype(np.int64)])
        if not len(row):
            continue
        v = window[row, col]
        a, b = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
        for r, x, y in zip(row[a < b].tolist(), a[a < b].tolist(), b[a < b].tolist()):
            for z in range(x, y):
                if block_of[z] == want:
                    found.add((int(doc[r]), int(owner[z])))
    return found


def blocks_of(benchmark: DataFrame):
    """Indexes of the items, block by block."""
    benchmark = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS_A_BLOCK), -(-size // TEXT_A_BLOCK))
    for b in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield index_items([(r.item_id, r.text) for r in part.collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment): items of whose distinct shingles at least threshold stand in the document."""
    C.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for built in blocks_of(benchmark):
        found = _scan(docs, built, threshold)
        out = found if out is None else out.unionByName(found)
    return out.distinct().withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def hits(texts, built: dict, threshold: float):
    """(row, item_id, n_shared, n_shingles) of an Arrow column of texts."""
    items, index = built["items"], built["index"]
    flags = C.class_table("alnum")
    for rows, buf, offsets in C.text_blocks(texts, range(len(texts))):
        low = C.LOWER_BYTES[buf]
        s, e, first = C.word_spans(low, offsets, flags)
        words = C.word_hashes(low, s, e)
        near = set()
        for k, part in index.items():
            near |= candidates(words, first, k, part)
        held, padded = None, b""
        for d, j in sorted(near):
            if d != held:
                held = d
                padded = b" " + b" ".join(buf[offsets[d] : offsets[d + 1]].tobytes().translate(WORDS).split()) + b" "
            item_id, _, shingles = items[j]
            got = sum(b" " + x + b" " in padded for x in shingles)
            if got >= threshold * len(shingles) - 1e-9:
                yield rows[d], item_id, got, len(shingles)


def _scan(docs: DataFrame, built: dict, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(built)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [])
            for row, *rest in hits(batch.column(1), shared.value, threshold):
                for column, x in zip(out, (ids[row], *rest)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "item_id", "n_shared", "n_shingles"])

    return docs.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_shingles long")


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs whose text holds no item: a filter in one pass over the texts, which all blocks of items share."""
    C.small_batches(docs.sparkSession)
    out = docs
    for built in blocks_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(built)

        def clean(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in hits(batch.column("text"), shared.value, threshold):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(5, len(w)) AS k FROM b WHERE len(w) > 0))),
s AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
x AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM q)))
SELECT x.doc_id, q.item_id, count(*)::BIGINT AS n_shared, any_value(s.n)::BIGINT AS n_shingles, count(*)::DOUBLE / any_value(s.n) AS containment
FROM x JOIN q ON x.k = q.k AND x.g = q.g JOIN s ON s.item_id = q.item_id
GROUP BY x.doc_id, q.item_id HAVING count(*) >= 0.8 * any_value(s.n) - 1e-9
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go.

    Each row is judged by its own text, so rows without doc_id and rows that repeat one are judged like any other; null and empty texts
    hold nothing and stay; an empty table gives no rows.
    """
    return without_leaks(docs, C.table(spark, sf_dir, "benchmark"))
