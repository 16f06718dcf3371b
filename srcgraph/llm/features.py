"""Vectorised features of whole texts: dense statistics, word hashes with prefixes, and bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Byte classes counted a document.
CLASSES = ("upper", "lower", "digit", "symbol", "bang", "stop", "comma", "other", "newline", "space", "high")
_SETS = {"symbol": b"#*$%&|<>", "bang": b"!?", "stop": b".", "comma": b",;:", "newline": b"\n", "space": b" \t\x0b\x0c\r"}
CLASS_OF = np.full(256, CLASSES.index("other"), np.int64)
for _name, _chars in _SETS.items():
    CLASS_OF[list(_chars)] = CLASSES.index(_name)
CLASS_OF[65:91], CLASS_OF[97:123], CLASS_OF[48:58], CLASS_OF[128:] = (CLASSES.index(x) for x in ("upper", "lower", "digit", "high"))

DENSE = (
    "log_words", "word_length", "upper", "digit", "symbol", "bang", "stop", "comma", "other", "high",
    "capital_words", "symbol_words", "types", "top_word", "twins", "runs", "line_words", "repeated_lines", "capital_share", "long_words",
)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between the bounds first[i] and first[i + 1]."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: whether its key stood earlier in its document, and how often it stands there."""
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    group = np.cumsum(new) - 1
    again, often = np.empty(len(k), bool), np.empty(len(k), np.int64)
    again[order] = ~new
    often[order] = np.bincount(group)[group] if len(k) else 0
    return again, often


def dense(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of DENSE for each document of a block."""
    docs = len(offsets) - 1
    kind = CLASS_OF[buf]
    byte_doc = np.repeat(np.arange(docs), np.diff(offsets))
    count = np.bincount(byte_doc * len(CLASSES) + kind, minlength=docs * len(CLASSES)).reshape(docs, len(CLASSES)).astype(float)
    by = dict(zip(CLASSES, count.T))
    chars = np.maximum(1, count.sum(1) - by["newline"] - by["space"])
    low = C.LOWER_BYTES[buf]
    s, e, first = C.word_spans(low, offsets, C.class_table("space"))
    n = np.diff(first).astype(float)
    n1 = np.maximum(1, n)
    doc = np.repeat(np.arange(docs), np.diff(first))
    h = C.word_hashes(low, s, e)
    upper = np.concatenate([[0], np.cumsum(kind == CLASSES.index("upper"))])
    lower = np.concatenate([[0], np.cumsum(kind == CLASSES.index("lower"))])
    symbol = np.concatenate([[0], np.cumsum(kind == CLASSES.index("symbol"))])
    capital = (upper[e] - upper[s] > 1) & (lower[e] == lower[s])
    again, often = repeated(h, doc)
    twin = np.zeros(len(h), bool)
    twin[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    g = C.shingle_hashes(h, 5)
    gram_again = repeated(g, doc[: len(g)])[0] & (doc[: len(g)] == doc[4:]) if len(g) else np.zeros(0, bool)
    gram_again = np.concatenate([gram_again, np.zeros(len(h) - len(gram_again), bool)])
    top = np.zeros(docs)
    np.maximum.at(top, doc, often)
    line = np.ones(256, bool)
    line[10] = False
    ls, le, lfirst = C.word_spans(buf, offsets, line)
    ldoc = np.repeat(np.arange(docs), np.diff(lfirst))
    lagain = repeated(C.word_hashes(buf, ls, le), ldoc)[0]
    lines = np.maximum(1, np.diff(lfirst))
    share = lambda flags: per_doc(flags, first) / n1
    words = np.column_stack([
        np.log1p(n), np.log((chars + 10) / (n1 + 2)),
        *[np.sqrt(by[x] / chars) for x in ("upper", "digit", "symbol", "bang", "stop", "comma", "other", "high")],
        share(capital), share(symbol[e] > symbol[s]), (n - per_doc(again, first)) / n1, top / n1, share(twin), share(gram_again),
        np.log1p(n1 / lines), per_doc(lagain, lfirst) / lines, np.sqrt(per_doc(upper[e] > upper[s], first) / n1), share(e - s > 14),
    ])
    return words


def tokens(buf: np.ndarray, offsets: np.ndarray):
    """(word, prefix of 4 bytes, prefix of 5) hashes and first: lower-cased alnum words; a short word's prefix hash is 0."""
    low = C.LOWER_BYTES[buf]
    s, e, first = C.word_spans(low, offsets, C.class_table("alnum"))
    out = [C.word_hashes(low, s, e)]
    for k in (4, 5):
        h = C.word_hashes(low, s, np.minimum(e, s + k)) ^ np.uint64(k)
        out.append(np.where(e - s > k, h, np.uint64(0)))
    return out, first


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo modulus."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def sample_ids(rows: DataFrame, most: int) -> list[int]:
    """At most `most` distinct doc_ids, the least by hash: a bounded, repeatable sample."""
    picked = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return [r.doc_id for r in picked.collect()]


def only(docs: DataFrame, ids: list[int]) -> DataFrame:
    """docs with one of ids, a list of proven bound."""
    spark = docs.sparkSession
    import pandas as pd

    wanted = spark.createDataFrame(pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64")}), "doc_id long")
    return docs.join(F.broadcast(wanted), "doc_id", "left_semi")


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
