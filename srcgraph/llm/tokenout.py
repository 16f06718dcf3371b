"""Token ids in binary files with Elias-Fano document boundaries.

Documents are tokenized where they lie, dealt to shards by ranges of doc_id, and written a shard a
file, ids in ascending doc_id order. A file is

    ids (2 bytes each if the vocabulary allows, else 4, little-endian) | boundaries | doc ids | footer

Boundaries 0 = x0 <= ... <= xn are an Elias-Fano sequence: low bits packed, high bits as unary gaps in a
bitmap, with the position of every SAMPLE-th one kept so that select(i) reads a few bytes. doc ids,
ascending too, are a second such sequence (less the least), after a count of null ids.
Files are written by whichever attempt ran under a name of its own; only names that successful tasks
return reach the manifest, so lost executors and repeated attempts leave no half file in use.

Cases: null or empty text is the end id alone; null doc_ids come first; rows that repeat a doc_id are
ordered by their ids and each kept; other columns are ignored; an empty table writes no file.
"""

from __future__ import annotations

import json
import re
import struct
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHARD_BYTES = 64 << 20
SAMPLE = 256
CACHE = 1_000_000
MAGIC = b"EFTOKEN1"
FOOTER = "<8sBQQQQQQQ"


class EliasFano:
    """A monotone sequence of n unsigned integers up to its last value, in about 2 + log2(last / n) bits each."""

    HEAD = "<QBQQ"

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        last = int(values[-1]) if n else 0
        l = max(0, (last // max(n, 1)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if l and n:
            low = np.packbits(((values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) if n else 0) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, l, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def to_bytes(self) -> bytes:
        return struct.pack(self.HEAD, self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        n, l, a, b = struct.unpack_from(cls.HEAD, data)
        at = struct.calcsize(cls.HEAD)
        return cls(n, l, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u8", -(-n // SAMPLE), at + a + b))

    def select(self, i: int) -> int:
        """The i-th value: the i-th one of the bitmap, found from the nearest sample, and its low bits."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        first = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (held := first.bit_count()) <= left:
            left -= held
            byte += 1
            first = int(self.high[byte])
        for _ in range(left):
            first &= first - 1
        one = byte * 8 + (first & -first).bit_length() - 1
        a = i * self.low_bits
        chunk = int.from_bytes(self.low[a >> 3 : (a + self.low_bits + 7) >> 3].tobytes(), "little") >> (a & 7)
        return (one - i) << self.low_bits | chunk & ((1 << self.low_bits) - 1)

    def some(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, as select gives them: from the sample before i, through the bitmap up to the sample after j."""
        if i >= j:
            return np.zeros(0, np.uint64)
        base = i // SAMPLE * SAMPLE
        at = int(self.samples[i // SAMPLE])
        after = -(-j // SAMPLE)
        end = (int(self.samples[after]) >> 3) + 1 if after < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[at >> 3 : end], bitorder="little")
        bits[: at & 7] = 0
        ones = np.flatnonzero(bits)[i - base : j - base] + (at >> 3 << 3)
        out = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            a = i * self.low_bits
            held = np.unpackbits(self.low[a >> 3 : (j * self.low_bits + 7) >> 3], bitorder="little")[a & 7 :][: (j - i) * self.low_bits].reshape(j - i, self.low_bits)
            out |= (held.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class TokenFile:
    """A written shard: document offsets by select, ids by ranges of the file."""

    def __init__(self, path: str):
        store, at = _open(path)
        self.file = store.open_input_file(at)
        size = self.file.size()
        magic, self.width, self.n_docs, self.n_ids, bounds, doc_ids, end, self.n_null, least = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.bounds = EliasFano.from_bytes(self.file.read_at(doc_ids - bounds, bounds))
        self.ids_index = EliasFano.from_bytes(self.file.read_at(end - doc_ids, doc_ids))
        self.least = least - (1 << 63)

    def __len__(self) -> int:
        return self.n_docs

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((stop - start) * self.width, start * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.ids_index.select(i - self.n_null) + self.least


def write_file(path: str, rows, width: int) -> dict:
    """rows: (doc_id, id bytes) in order. Returns counts."""
    store, at = _open(path)
    bounds, doc_ids, n_null = [0], [], 0
    with store.open_output_stream(at) as out:
        for doc_id, ids in rows:
            out.write(ids)
            bounds.append(bounds[-1] + len(ids) // width)
            if doc_id is None:
                n_null += 1
            else:
                doc_ids.append(doc_id)
        a = bounds[-1] * width
        x = EliasFano.of(np.array(bounds)).to_bytes()
        least = doc_ids[0] if doc_ids else 0
        y = EliasFano.of(np.array([d - least for d in doc_ids], np.uint64)).to_bytes()
        out.write(x)
        out.write(y)
        out.write(struct.pack(FOOTER, MAGIC, width, len(bounds) - 1, bounds[-1], a, a + len(x), a + len(x) + len(y), n_null, least + (1 << 63)))
    return {"n_docs": len(bounds) - 1, "n_ids": bounds[-1]}


def byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def plain_words(spec: str) -> bool:
    """Whether a lower-case word in normal form, of letters alone, goes to the merges as its bytes."""
    rules = json.loads(spec)
    steps = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
    cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return False
    letters = cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and "[\\p{L}]+" in cuts[0]["pattern"].get("Regex", "").split("|")
    # words are cut off added tokens only by this sign
    marked = all("<|" in t["content"] for t in rules.get("added_tokens") or [])
    return bool(letters) and marked and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]


def encoder(spec: str, end_id: int, width: int, by_word: bool):
    """text -> id bytes. by_word: white-space separated pieces are encoded alone and remembered, which gives the
    same ids only for a tokenizer that drops white space before it merges; others encode whole texts. Words that
    no other step of the tokenizer changes go to the library's merges at once."""
    import os
    from array import array
    from unicodedata import is_normalized

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    held = sys.__dict__.setdefault("_srcgraph_tokens", {})  # a worker serves many tasks
    key = (hash(spec), width, by_word)
    if key not in held:
        held.clear()
        held[key] = (Tokenizer.from_str(spec), {})
    tokenizer, known = held[key]
    direct, merge, characters, code = plain_words(spec), tokenizer.model.tokenize, byte_characters(), "H" if width == 2 else "I"
    stops = re.compile(rb"(?<=[a-z])([.,])(?=\s|$)")
    kind, end = f"<u{width}", np.array([end_id], f"<u{width}").tobytes()

    def whole(texts):
        return [np.array(e.ids, kind).tobytes() + end for e in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]

    def split(text):
        raw = (text or "").encode()
        # case and a full stop or comma after a word are set apart first, which changes no id unless the
        # text has special tokens' strings or marks that would join with a lower-case letter alone
        if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
            raw = stops.sub(rb" \1", raw.lower())
        return raw.split()

    def words(texts):
        pieces = [split(t) for t in texts]
        if len(known) > CACHE:
            known.clear()
        new = list(set().union(*pieces).difference(known))
        odd = [p for p in new if b"<|" in p]
        for p in odd:
            known[p] = np.array(tokenizer.encode(p.decode(), add_special_tokens=False).ids, kind).tobytes()
        new = [p for p in new if b"<|" not in p] if odd else new
        if direct:
            rest = []
            for p in new:
                w = p.decode()
                if not w.isalpha() or not w.isascii() and (w != w.lower() or not is_normalized("NFC", w)) or w.isascii() and not w.islower():
                    rest.append(p)
                    continue
                known[p] = array(code, [t.id for t in merge(w if w.isascii() else p.decode("latin-1").translate(characters))]).tobytes()
            new = rest
        for i in range(0, len(new), 2048):
            part = new[i : i + 2048]
            e = tokenizer.encode([p.decode() for p in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, kind).tobytes()
            cuts = (np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1)) * width).tolist()
            for p, x, y in zip(part, cuts, cuts[1:]):
                known[p] = ids[x:y]
        return [b"".join(map(known.__getitem__, p)) + end for p in pieces]

    return words if by_word else whole


def shard_cuts(docs: DataFrame, shard_bytes: int, least: int, fine: int = 1024) -> np.ndarray:
    """doc_ids that end the shards: about shard_bytes of text each, and `least` of them at least. Ranges of equal numbers of documents are
    measured, more of them the larger the table, and joined until they hold enough."""
    n_docs = docs.agg(F.count("doc_id")).first()[0]
    fine = max(fine, n_docs // 50_000)
    edges = docs.agg(F.percentile_approx("doc_id", [i / fine for i in range(1, fine)], 20 * fine)).first()[0]
    edges = np.unique(np.array(edges or [], np.int64))

    def sums(batches):
        import pyarrow as pa

        total = np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            total += np.bincount(np.searchsorted(edges, batch.column(0).to_numpy()), batch.column(1).to_numpy(), len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["part", "size"])

    sized = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).mapInArrow(sums, "part long, size long")
    size = np.zeros(len(edges) + 1, np.int64)
    for r in sized.groupBy("part").agg(F.sum("size").alias("size")).collect():  # a row a range
        size[r.part] = r.size
    most = min(shard_bytes, max(1, int(size.sum()) // least))
    cuts, held = [], 0
    for edge, n in zip(edges.tolist(), size.tolist()):
        held += n
        if held >= most:
            cuts.append(edge)
            held = 0
    return np.array(cuts, np.int64)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, by_word: bool = False, shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Write docs' ids below folder; returns the manifest: shards in order with path, n_docs, n_ids and start."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    C.small_batches(spark)
    spec = open(tokenizer_path, encoding="utf-8").read()
    width = 2 if max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cuts = shard_cuts(docs, shard_bytes, spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast((spec, cuts))

    def encode(batches):
        import pyarrow as pa

        spec, cuts = shared.value
        run = encoder(spec, end_id, width, by_word)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            shard = np.where(np.isnan(ids), 0, np.searchsorted(cuts, np.nan_to_num(ids))) if ids.dtype.kind == "f" else np.searchsorted(cuts, ids)
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), 64):
                yield pa.RecordBatch.from_arrays([pa.array(shard[i : i + 64].astype(np.int32)), batch.column(0).slice(i, 64), pa.array(run(texts[i : i + 64]), pa.binary())], ["shard", "doc_id", "ids"])

    def write(batches):
        import uuid
        from itertools import chain, groupby

        import pyarrow as pa

        rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        for shard, group in groupby(rows, key=lambda r: r[0]):
            path = f"{folder}/ids-{shard:08d}-{uuid.uuid4().hex[:8]}.bin"
            counts = write_file(path, ((i, x) for _, i, x in group), width)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [counts["n_docs"]], "n_ids": [counts["n_ids"]]})

    store, at = _open(folder)
    store.create_dir(at, recursive=True)
    coded = docs.mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    shards = sorted(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_ids long").collect())  # a row a shard
    manifest, start = [], 0
    for r in shards:
        manifest.append(r.asDict() | {"start": start})
        start += r.n_ids
    with store.open_output_stream(f"{at}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_tokens(spark: SparkSession, manifest: list[dict], block: int = 1 << 20, some: int = 4096) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: offsets and doc ids by select, `some` documents at a time, and
    about `block` ids at a time, so that no table of a file's offsets is held."""

    def read(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(path)
                for first in range(0, len(f), some):
                    last = min(first + some, len(f))
                    at = f.bounds.some(first, last + 1).astype(np.int64)
                    null = max(0, min(last, f.n_null) - first)
                    doc_ids = [None] * null + (f.ids_index.some(first + null - f.n_null, last - f.n_null).astype(np.int64) + f.least).tolist()
                    i = 0
                    while i < last - first:
                        j = max(i + 1, int(np.searchsorted(at, at[i] + block, "right")) - 1)
                        ids, own = f.ids(int(at[i]), int(at[j])).astype("<u4"), at[i : j + 1] - at[i]
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(own[:-1].tolist(), own[1:].tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[i:j], pa.int64()), pa.array(start + at[i:j]), pa.array(np.diff(own)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        i = j

    rows = [(m["path"], m["start"]) for m in manifest]
    files = spark.createDataFrame(rows, "path string, start long")
    return files.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = C.fresh_path(spark, "token-ids")
    manifest = write_tokens(C.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_word=True)
    return read_tokens(spark, manifest)
