"""Toxicity by weak supervision.

Voters (lexicons by kind, words and word stems mined from the learning folds, phrase and density patterns) each say
"toxic" or abstain. The counts of vote patterns over all documents (2 ** VOTERS patterns at most) are all that the
generative label model needs: expectation-maximisation fits the class balance and each voter's rates in both classes;
voters whose joint votes the fitted model leaves correlated are merged into one voter with a table of their joint votes, and
the model is fitted again, until no pair stays correlated. A linear classifier over hashed words, stems and
vote strengths is then trained on the posterior labels and scores every whole text.

Bounds: mining reads at most MINED labelled documents of each class, the classifier's fit at most FIT documents likelier
toxic and FIT others (least by hash of doc_id). Pattern counts and scores cover all documents.

Cases: null or empty text has no votes and gets the score of the bias; null doc_ids are scored, held out false; without any
toxic label the mined voters abstain; a doc_id listed twice is toxic if any label is; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import features as X

MINED, FIT, FOLDS, HELD_OUT = 3000, 4000, 4, 2
BUCKETS = 1 << 18
STRENGTHS = 12
VOTERS = 12

#: Insults and phrases by kind.
NOUNS = "idiot idiots moron morons loser losers clown scum trash garbage jerk fool imbecile dumbass bastard bitch asshole pig freak creep coward".split()
QUALITIES = "stupid dumb pathetic worthless disgusting useless ugly vile filthy retarded brainless despicable repulsive".split()
OTHERS = "connard imbécile crétin salope débile abruti arschloch dummkopf trottel idiotin schlampe widerlich idiota estúpido imbécil basura gilipollas asqueroso".split()
PHRASES = ["shut up", "hate you", "kill yourself", "go die", "you idiot", "you moron", "screw you", "drop dead", "get lost", "you disgust"]


def hashes(words: list[str]) -> np.ndarray:
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = C.word_spans(buf, np.array([0, len(buf)]), C.class_table("alnum"))
    return C.word_hashes(buf, s, e)


def phrase_hashes(phrases: list[str]) -> np.ndarray:
    return np.array([C.shingle_hashes(hashes(p.split()), 2)[0] for p in phrases])


class Voters:
    """Sets of hashes a voter, of words, stems or word pairs, and the votes and strengths of documents."""

    def __init__(self, words: np.ndarray, stems: np.ndarray):
        third = words % np.uint64(3)
        half = stems % np.uint64(2)
        self.words = [hashes(NOUNS), hashes(QUALITIES), hashes(OTHERS), *[words[third == np.uint64(i)] for i in range(3)]]
        self.stems = [stems[half == np.uint64(i)] for i in range(2)]
        self.pairs = phrase_hashes(PHRASES)

    @staticmethod
    def member(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        wanted = np.sort(wanted)
        if not len(wanted) or not len(h):
            return np.zeros(len(h), bool)
        return wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h

    def strengths(self, parts, first) -> np.ndarray:
        """A row a document: hits of each set (6 of words, 2 of stems, 1 of pairs), distinct sets hit, hits in all, share of words."""
        word, four, five = parts
        n = np.diff(first)
        all_words = np.concatenate(self.words)
        near = np.flatnonzero(self.member(word, all_words))
        out = np.zeros((len(n), STRENGTHS))
        doc = np.repeat(np.arange(len(n)), n)
        any_hit = np.zeros(len(word), bool)
        for i, own in enumerate(self.words):
            at = near[self.member(word[near], own)]
            any_hit[at] = True
            out[:, i] = np.bincount(doc[at], minlength=len(n))
        for i, own in enumerate(self.stems):
            at = np.flatnonzero(self.member(four, own) | self.member(five, own))
            any_hit[at] = True
            out[:, 6 + i] = np.bincount(doc[at], minlength=len(n))
        if len(word) > 1:
            pair = C.shingle_hashes(word, 2)
            at = np.flatnonzero(self.member(pair, self.pairs) & (doc[:-1] == doc[1:]))
            out[:, 8] = np.bincount(doc[at], minlength=len(n))
        out[:, 9] = (out[:, :9] > 0).sum(1)
        out[:, 10] = np.bincount(doc[any_hit], minlength=len(n))
        out[:, 11] = out[:, 10] / np.maximum(n, 20)
        return out

    @staticmethod
    def votes(strength: np.ndarray) -> np.ndarray:
        """A bit a voter: a set hit by one word in 250 at least, two hits in all and two kinds of hits at that rate, one word in a hundred."""
        each = strength[:, 11] / np.maximum(strength[:, 10], 1)  # share of one hit
        dense = (strength[:, :9] > 0) & (strength[:, :9] * each[:, None] >= 0.004)
        some = strength[:, 11] >= 0.004
        on = np.column_stack([dense, (strength[:, 10] >= 2) & some, (dense.sum(1) >= 2) & some, strength[:, 11] >= 0.01])
        return on @ (1 << np.arange(VOTERS))


class LabelModel:
    """Two classes; groups of voters, each with the rates of its joint votes in both classes."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 6, limit: float = 0.1):
        self.votes = (patterns[:, None] >> np.arange(VOTERS)) & 1
        self.counts = counts.astype(float)
        self.groups = [[i] for i in range(VOTERS)]
        for _ in range(rounds):
            self.fit()
            pair = self.worst(limit)
            if pair is None:
                break
            a, b = pair
            self.groups = [g for i, g in enumerate(self.groups) if i not in pair] + [self.groups[a] + self.groups[b]]

    def codes(self, group):
        return self.votes[:, group] @ (1 << np.arange(len(group)))

    def fit(self, steps: int = 200):
        some = self.votes.sum(1)
        post = X.logistic(1.5 * (some - 1.5))  # more votes, likelier toxic
        for _ in range(steps):
            w1, w0 = self.counts * post, self.counts * (1 - post)
            self.balance = float(np.clip(w1.sum() / self.counts.sum(), 1e-4, 0.5))
            self.rates = []
            for g in self.groups:
                code, size = self.codes(g), 1 << len(g)
                smooth = np.full(size, 0.5 / size)
                # silence is the rule in the clean class, which keeps the classes from changing places
                quiet = np.where(np.arange(size) == 0, 1.0, 0.02 / size)
                one = np.bincount(code, w1, size) + smooth
                none = np.bincount(code, w0, size) + quiet
                self.rates.append((np.log(none / none.sum()), np.log(one / one.sum())))
            new = X.logistic(self.odds())
            if np.abs(new - post).max() < 1e-6:
                break
            post = new
        self.posterior = post

    def odds(self):
        z = np.log(self.balance) - np.log1p(-self.balance)
        for g, (none, one) in zip(self.groups, self.rates):
            code = self.codes(g)
            z = z + one[code] - none[code]
        return z

    def worst(self, limit: float):
        """The pair of groups whose votes stay most correlated within the classes, if over the limit (and of 6 voters at most together)."""
        best, found = limit, None
        for post in (self.posterior, 1 - self.posterior):
            w = self.counts * post
            if w.sum() < 1:
                continue
            on = np.column_stack([self.votes[:, g].any(1) for g in self.groups]).astype(float)
            mean = w @ on / w.sum()
            dev = on - mean
            cov = (dev * w[:, None]).T @ dev / w.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.abs(cov / np.outer(sd, sd)) * (mean[:, None] > 0.005) * (mean > 0.005)
            for a in range(len(self.groups)):
                for b in range(a):
                    if corr[a, b] > best and len(self.groups[a]) + len(self.groups[b]) <= 6:
                        best, found = corr[a, b], (a, b)
        return found


def buckets(parts) -> list[np.ndarray]:
    return [((h >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int64) for h in parts]


def tokenized(docs: DataFrame, make, schema: str) -> DataFrame:
    """Run make(ids, parts, first) -> RecordBatch over blocks of documents."""

    def run(batches):
        for batch in batches:
            for ids, buf, offsets in C.text_blocks(batch.column(1), batch.column(0)):
                parts, first = X.tokens(buf, offsets)
                yield make(ids, parts, first)

    C.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def distinct_hashes(docs: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """doc_id -> distinct word and stem hashes, of a bounded sample."""

    def make(ids, parts, first):
        import pyarrow as pa

        word, four, five = parts
        pack = lambda *hs: [np.unique(np.concatenate([h[a:b] for h in hs])).tobytes() for a, b in zip(first[:-1], first[1:])]
        return pa.RecordBatch.from_arrays([ids, pa.array(pack(word), pa.binary()), pa.array(pack(four, five), pa.binary())], ["doc_id", "words", "stems"])

    found = tokenized(docs, make, "doc_id long, words binary, stems binary")
    return {r.doc_id: (np.frombuffer(r.words, np.uint64), np.frombuffer(r.stems, np.uint64)) for r in found.toLocalIterator()}


def mine(toxic: list[np.ndarray], clean: list[np.ndarray], most: int = 100) -> np.ndarray:
    """Hashes far commoner in toxic documents than in clean ones; equal documents count once."""
    once = lambda docs: list({d.tobytes(): d for d in docs}.values())
    toxic, clean = once(toxic), once(clean)
    if not toxic or not clean:
        return np.zeros(0, np.uint64)
    h, n1 = np.unique(np.concatenate(toxic), return_counts=True)
    other, n0 = np.unique(np.concatenate(clean), return_counts=True)
    at = np.minimum(np.searchsorted(other, h), len(other) - 1)
    n0 = np.where(other[at] == h, n0[at], 0)
    odds = ((n1 + 0.1) / len(toxic)) / ((n0 + 0.5) / len(clean))
    keep = (n1 >= max(3, 0.01 * len(toxic))) & (odds >= 20) & (h != 0)
    order = np.argsort(-np.log(odds) * np.sqrt(n1) * keep, kind="stable")[:most]
    return np.sort(h[order[keep[order]]])


def train_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, decay: float = 1e-3, steps: int = 150, rate: float = 0.05):
    """Logistic regression by Adam on (bucket numbers, strengths) rows: weights of buckets, of strengths, and the bias."""
    used, where = np.unique(np.concatenate([b for b, _ in rows]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(rows))))
    dense = np.array([s for _, s in rows])
    w = [np.zeros(len(used)), np.zeros(dense.shape[1]), np.array([-1.0])]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, steps + 1):
        z = np.bincount(row, w[0][where], len(rows)) * scale + dense @ w[1] + w[2]
        g = (X.logistic(z) - target) / len(rows)
        grads = (np.bincount(where, (g * scale)[row], len(used)) + decay * w[0] / len(rows), dense.T @ g + decay * w[1] / len(rows), np.array([g.sum()]))
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w[0]
    return weights, w[1], float(w[2][0])


def squashed(strength: np.ndarray) -> np.ndarray:
    """Strengths as the classifier reads them: log counts, and the share of words in hundredths up to 5."""
    return np.column_stack([np.log1p(strength[:, :11]), np.minimum(strength[:, 11] * 100, 5)])


def fitted(docs: DataFrame, labels: DataFrame):
    """A function (parts, first) -> scores of documents, and broadcasts it needs; None where there is nothing to learn from."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = labels.where(X.fold(FOLDS) != HELD_OUT).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    bad, good = (X.sample_ids(known.where(F.col("toxic") == t), MINED) for t in (1, 0))
    sample = distinct_hashes(X.only(docs, bad + good)) if bad and good else {}
    of = lambda ids, k: [sample[i][k] for i in ids if i in sample]
    voters = Voters(*[mine(of(bad, k), of(good, k)) for k in (0, 1)])
    del sample
    shared = spark.sparkContext.broadcast(voters)

    def vote(ids, parts, first):
        import pyarrow as pa

        v = shared.value
        return pa.RecordBatch.from_arrays([ids, pa.array(v.votes(v.strengths(parts, first)).astype(np.int32))], ["doc_id", "pattern"])

    votes = C.staged(tokenized(docs, vote, "doc_id long, pattern int"), "toxicity-votes")
    counts = sorted((r.pattern, r.n) for r in votes.groupBy("pattern").agg(F.count("*").alias("n")).collect())  # 2 ** VOTERS rows at most
    if not counts:
        return None
    model = LabelModel(np.array([p for p, _ in counts]), np.array([n for _, n in counts]))
    posterior = {p: float(x) for (p, _), x in zip(counts, model.posterior)}
    likely = [p for p, x in posterior.items() if x >= 0.5]
    ids = X.sample_ids(votes.where(F.col("pattern").isin(likely)), FIT) + X.sample_ids(votes.where(~F.col("pattern").isin(likely)), FIT)

    def rows(ids, parts, first):
        import pyarrow as pa

        v = shared.value
        strength = v.strengths(parts, first)
        b = buckets(parts)
        own = [np.unique(np.concatenate([x[a:z] for x in b])).astype("<i4").tobytes() for a, z in zip(first[:-1], first[1:])]
        return pa.RecordBatch.from_arrays([ids, pa.array(own, pa.binary()), pa.array([s.tobytes() for s in squashed(strength)], pa.binary()), pa.array(v.votes(strength).astype(np.int32))], ["doc_id", "buckets", "strengths", "pattern"])

    taken = tokenized(X.only(docs, ids), rows, "doc_id long, buckets binary, strengths binary, pattern int")
    data = sorted(((r.doc_id, bytes(r.buckets), bytes(r.strengths), r.pattern) for r in taken.toLocalIterator()))
    if not data:
        return None
    weights = spark.sparkContext.broadcast(train_linear([(np.frombuffer(b, "<i4"), np.frombuffer(s)) for _, b, s, _ in data], np.array([posterior[p] for *_, p in data])))

    def score(parts, first):
        w, own, bias = weights.value
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        # distinct buckets of each document, as in training
        keys = np.unique(np.concatenate([doc * BUCKETS + b for b in buckets(parts)]))
        at = keys // BUCKETS
        z = np.bincount(at, w[keys % BUCKETS], len(n)) / np.sqrt(np.maximum(1, np.bincount(at, minlength=len(n))))
        return X.logistic(z + squashed(shared.value.strengths(parts, first)) @ own + bias)

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every document; labels (doc_id, toxic) are read outside the held-out fold."""
    score = fitted(docs, labels)
    if score is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("score"))

    def run(ids, parts, first):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([ids, pa.array(score(parts, first))], ["doc_id", "score"])

    return tokenized(docs, run, "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that score under THRESHOLD: a filter in one pass over the texts."""
    score = fitted(docs, labels)
    if score is None:
        return docs

    def clean(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [score(*X.tokens(buf, offsets)) < THRESHOLD for _, buf, offsets in C.text_blocks(batch.column("text"), range(batch.num_rows))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    C.small_batches(docs.sparkSession)
    return docs.mapInArrow(clean, docs.schema)


THRESHOLD = 0.3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return scores.select("doc_id", F.coalesce(X.fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored toxic go.

    Each row is scored by its own text, so rows without doc_id and rows that repeat one are judged like any other; null and empty
    texts have the score of the bias and stay; an empty table gives no rows.
    """
    return without_toxic(docs, C.table(spark, sf_dir, "labels"))
