"""Best-fit packing under conflicts.

Documents become pieces of at most `capacity` tokens (words): a longer one gives full bins of its own and a rest. Pieces are dealt
by hash to shards of about SHARD tokens and packed in each shard in decreasing length. Open bins stand in order of residual capacity; a
piece starts at the successor of its length and goes on to the next residual until a bin is compatible, so it gets the
tightest compatible bin. A bin carries a bitmap of duplicate clusters and of the sources it is full of: it takes one piece of a
cluster, and at most `per_source` pieces of a source. No token is dropped: pieces cover every document.

The order is a binary tree over (residual, bin) whose nodes hold the bits that all bins below them have, so a search passes over a whole
subtree that a hot source or cluster fills, and stays logarithmic however hot it is. Only sources and clusters with more than HOT pieces in
the shard have bits; those of fewer pieces can block that many bins at most, and are looked up a bin at a time.

A shard holds SHARD tokens and so bounded rows (pieces have a token at least); the dealing ignores source and cluster, so a hot
one spreads over all shards.

Clusters are near-duplicate components where they are given (doc_id, cluster), else equal texts but for white space and case.

Cases: null or empty texts have no token and form no piece (no output row); null sources share one source; null doc_ids are packed as a
document of their own, in the cluster of their text; repeated rows are one duplicate cluster and never share a bin; long texts are pieces
like others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import simhash

CAPACITY, PER_SOURCE, SHARD = 2048, 2, 4_000_000
HOT = 64


class Order:
    """Bins by a number, smallest first, with bitmaps; a node of each level holds the bits that all below it have."""

    def __init__(self, bits: int):
        self.levels: list[dict[int, int]] = [{} for _ in range(bits + 1)]

    def put(self, code: int, mask: int | None) -> None:
        """Set a bin's bitmap; None takes it out."""
        for nodes in self.levels:
            if mask is None:
                if nodes.pop(code, None) is None:
                    return
            else:
                if nodes.get(code, -1) == mask:
                    return
                nodes[code] = mask
            beside = nodes.get(code ^ 1)
            if beside is not None:
                mask = beside if mask is None else mask & beside
            code >>= 1

    def first(self, code: int, bits: list[int], fits) -> int | None:
        """The first bin from code on that has none of the bits and fits."""
        levels, top, level = self.levels, len(self.levels) - 1, 0
        while True:
            mask = levels[level].get(code)
            if mask is not None and not any(mask & b for b in bits):
                if level:
                    level, code = level - 1, code << 1
                    continue
                if fits(code):
                    return code
            while code & 1:
                level, code = level + 1, code >> 1
            if level >= top:
                return None
            code += 1


def best_fit(pieces, capacity: int, per_source: int, hot: int = HOT):
    """pieces: (length, source, cluster) in packing order. Returns each one's bin number."""
    pieces = list(pieces)
    width = max(1, len(pieces).bit_length())
    order = Order(width + capacity.bit_length() + 1)
    sources, clusters = Counter(p[1] for p in pieces), Counter(p[2] for p in pieces)
    named = [*[("s", k) for k, n in sources.items() if n > hot], *[("c", k) for k, n in clusters.items() if n > hot]]
    bit_of = {k: 1 << i for i, k in enumerate(named)}
    masks: list[int] = []
    held: Counter = Counter()
    taken: set = set()
    out = []
    low = (1 << width) - 1
    for length, source, cluster in pieces:
        s, c = bit_of.get(("s", source), 0), bit_of.get(("c", cluster), 0)

        def fits(code):
            b = code & low
            return (s or held[b, source] < per_source) and (c or (b, cluster) not in taken)

        code = order.first(length << width, [x for x in (s, c) if x], fits)
        if code is None:
            residual, b = capacity, len(masks)
            masks.append(0)
        else:
            residual, b = code >> width, code & low
            order.put(code, None)
        held[b, source] += 1
        taken.add((b, cluster))
        masks[b] |= c | (s if held[b, source] >= per_source else 0)
        if residual > length:
            order.put((residual - length) << width | b, masks[b])
        out.append(b)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_tokens: int = SHARD, clusters: DataFrame | None = None) -> DataFrame:
    """(doc_id, piece, start, length, source, cluster, bin_id, position): where tokens start .. start + length - 1 of each document went.

    clusters: (doc_id, cluster) of near-duplicates.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(C.WS))
    words = F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[ \t\n\x0B\f\r]+")))
    measured = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.xxhash64(F.lower(F.regexp_replace(trimmed, r"[ \t\n\x0B\f\r]+", " "))).alias("cluster"),
        words.cast("long").alias("n"),
        F.monotonically_increasing_id().alias("row"),
    )
    measured = measured.where("n > 0")
    if clusters is not None:
        near = clusters.where("doc_id is not null").groupBy("doc_id").agg(F.min("cluster").alias("near"))
        measured = measured.join(near, "doc_id", "left").withColumn("cluster", F.when(F.col("near").isNotNull(), F.xxhash64(F.lit("near"), "near")).otherwise(F.col("cluster"))).drop("near")
    measured = C.staged(measured, "packing")
    total = measured.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_tokens))
    pieces = measured.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("length"), "source", "cluster", "row")
    # full pieces fill a bin alone: no search, no shuffle
    alone = pieces.where(F.col("length") == capacity).withColumn("bin_id", F.concat_ws("-", F.lit("full"), "row", "piece")).withColumn("position", F.lit(0))
    rest = pieces.drop("row").where(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards)).cast("int"))

    def run(t):
        import pyarrow as pa

        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        shard = t.column("shard")[0].as_py()
        bins = best_fit(zip(*(t.column(c).to_pylist() for c in ("length", "source", "cluster"))), capacity, per_source)
        count: dict[int, int] = {}
        position = []
        for b in bins:
            position.append(count.get(b, 0))
            count[b] = position[-1] + 1
        t = t.drop_columns(["shard"])
        return t.append_column("bin_id", pa.array([f"{shard}-{b}" for b in bins], pa.string())).append_column("position", pa.array(position, pa.int32()))

    schema = "doc_id long, piece long, start long, length long, source string, cluster long, bin_id string, position int"
    packed = rest.groupBy("shard").applyInArrow(run, schema)
    return alone.select(*packed.columns).unionByName(packed)


def fill(packed: DataFrame) -> DataFrame:
    """(source, bins, tokens, share): bins that hold each source, its tokens in them, and how full those bins are."""
    bins = packed.groupBy("bin_id").agg(F.sum("length").alias("held"))
    each = packed.groupBy("source", "bin_id").agg(F.sum("length").alias("own")).join(bins, "bin_id")
    return each.groupBy("source").agg(F.count("*").alias("bins"), F.sum("own").alias("tokens"), (F.avg("held") / CAPACITY).alias("share"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    near = simhash.simhash_components(docs).select("doc_id", F.col("component_id").alias("cluster"))
    return pack(docs, clusters=near)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: training sequences as pieces of documents in bins.

    Null and empty texts give no piece; rows without doc_id are documents of their own; rows that are equal never share a bin; an empty
    table gives no rows. Near-duplicates went in a stage before, so clusters are equal texts.
    """
    return pack(docs)
