"""Quality classifier by positive-unlabelled learning.

Trusted positives (labels.quality = 1 in the learning folds) and unlabelled web text (any document) train a small
network by the non-negative unbiased risk of Kiryo and others: pi R+(positives) + max(0, R-(unlabelled) - pi R-(positives)).
Negative labels are never read. The class prior pi is estimated from a first classifier of positives against unlabelled text: over
score thresholds, the least upper bound of the ratio of the shares of unlabelled texts and positives above it (best bin
estimation); those shares are histograms over all documents.

Bounds: the fits read at most POSITIVES positives and UNLABELLED documents (least by hash of doc_id); prior, features and
scores cover every document and whole texts.

Cases: null or empty texts are scored like any other; null doc_ids are scored, held out false; without a trusted positive every score is 1;
a doc_id listed twice is positive if any of its labels is; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import features as X

POSITIVES, UNLABELLED, BINS, FOLDS = 10_000, 20_000, 1000, 5
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 512, 0.01, 1e-4
NAMES = [f"f{i}" for i in range(len(X.DENSE))]


def dense_features(docs: DataFrame) -> DataFrame:
    """(doc_id, f0, f1, ...) of every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, buf, offsets in C.text_blocks(batch.column(1), batch.column(0)):
                x = X.dense(buf, offsets).astype(np.float32)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.ascontiguousarray(c)) for c in x.T]], ["doc_id", *NAMES])

    C.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} float" for n in NAMES))


class Network:
    """One hidden layer, trained on rows of positives and unlabelled by a risk's gradient."""

    def __init__(self, width: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def forward(self, x):
        a = np.tanh(x @ self.w[0] + self.w[1])
        return a, a @ self.w[2] + self.w[3]

    def score(self, x):
        return X.logistic(self.forward(x)[1])

    def fit(self, p: np.ndarray, u: np.ndarray, slope, seed: int = 11) -> "Network":
        """slope(z of positives, z of unlabelled): the risk's derivatives by z."""
        r = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        steps = EPOCHS * max(1, min(len(u) // BATCH, 40))
        for _ in range(steps):
            xp, xu = p[r.integers(0, len(p), BATCH)], u[r.integers(0, len(u), BATCH)]
            x = np.concatenate([xp, xu])
            a, z = self.forward(x)
            dz = np.concatenate(slope(z[:BATCH], z[BATCH:]))
            da = dz[:, None] * self.w[2] * (1 - a * a)
            t += 1
            for i, g in enumerate((x.T @ da + DECAY * self.w[0], da.sum(0), a.T @ dz + DECAY * self.w[2], np.array([dz.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.w[i] = self.w[i] - RATE * (1 - t / (steps + 1)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self


def against_unlabelled(zp, zu):
    """Logistic loss of positives against unlabelled."""
    return -X.logistic(-zp) / len(zp), X.logistic(zu) / len(zu)


def non_negative(pi: float):
    """Derivatives of the non-negative risk under logistic loss; where the negative part falls below 0, only it is raised again."""

    def slope(zp, zu):
        loss_u, loss_p = np.logaddexp(0, zu).mean(), np.logaddexp(0, zp).mean()
        if loss_u - pi * loss_p >= 0:
            return pi * (-X.logistic(-zp) - X.logistic(zp)) / len(zp), X.logistic(zu) / len(zu)
        return pi * X.logistic(zp) / len(zp), -X.logistic(zu) / len(zu)

    return slope


def class_prior(positives: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """From histograms over score bins: the least upper bound of the unlabelled share over the positives' share above a threshold."""
    n_p, n_u = positives.sum(), unlabelled.sum()
    above_p, above_u = positives[::-1].cumsum() / n_p, unlabelled[::-1].cumsum() / n_u
    some = above_p > 0.01
    slack = np.sqrt(np.log(4 / confidence) / (2 * n_u)) + np.sqrt(np.log(4 / confidence) / (2 * n_p))
    bound = (above_u[some] + 1.01 * slack) / above_p[some]
    best = int(np.argmin(bound))
    return float(np.clip(above_u[some][best] / above_p[some][best], 0.05, 0.98))


def scorer(network: Network, middle: np.ndarray, scale: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy() for n in NAMES]).astype(float)
            score = network.score(np.clip((x - middle) / scale, -8, 8)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def histogram(scores: DataFrame) -> np.ndarray:
    out = np.zeros(BINS)
    for r in scores.groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("b")).agg(F.count("*").alias("n")).collect():  # BINS rows
        out[r.b] = r.n
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(doc_id, score) of every document; labels (doc_id, quality) are read for positives outside the held-out fold."""
    rows = C.staged(dense_features(docs), "quality-features")
    trusted = labels.where((F.col("quality") == 1) & (X.fold(folds) != 0)).select(F.col("doc_id").cast("long")).distinct()
    take = lambda frame, most: X.only(rows, X.sample_ids(frame, most)).select(*NAMES).toPandas().to_numpy(float)
    p, u = take(trusted, POSITIVES), take(rows, UNLABELLED)
    if not len(p) or not len(u):
        return rows.select("doc_id", F.lit(1.0).alias("score"))
    middle, scale = np.median(u, 0), np.maximum(u.std(0), 0.02)
    p, u = (np.clip((x - middle) / scale, -8, 8) for x in (p, u))
    first = Network(len(NAMES)).fit(p, u, against_unlabelled)
    scored = C.staged(rows.mapInArrow(scorer(first, middle, scale), "doc_id long, score double"), "quality-first")
    pi = class_prior(histogram(scored.join(trusted, "doc_id", "left_semi")), histogram(scored))
    final = Network(len(NAMES)).fit(p, u, non_negative(pi))
    return rows.mapInArrow(scorer(final, middle, scale), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return scores.select("doc_id", F.coalesce(X.fold(FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
