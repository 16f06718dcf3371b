r"""Quality rules: base counts, and robust multivariate outliers by minimum covariance determinant.

All DataFrame expressions. Each text gives counts; documents that pass the base rule give a vector of five
transformed statistics, and each (lang, source) its own location and scatter by concentration steps
(Rousseeuw and Van Driessen's C-steps from a deterministic start at medians and interquartile ranges): distances, the
SUPPORT share of least distance, its mean and covariance, until the determinant stops falling. Scatter is scaled so that
the SUPPORT quantile of squared distances is at most the chi-square one (never shrunk, as FLOORS bound it below). FLOORS are added to the scatter's
diagonal (as squares), since most clean texts have no symbol or repeat at all and the plain determinant would
be zero. A document is rejected if its squared Mahalanobis distance is over the chi-square CUTOFF quantile.

Groups under LEAST documents share one estimate a language, languages under it one for the rest; if that is
under LEAST too, only the base rule judges. Shares of a group with a third of all rows are
pre-aggregated by Spark's partial aggregates; estimates go back as a table of one row a group (see FEW).

Cases: null or empty text has no words and fails the base rule; null lang or source is a group of its own; repeated rows
count each; columns of other names are ignored (doc_id, text, lang, source are read); an empty table gives none.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SUPPORT, CUTOFF, LEAST, STEPS = 0.75, 0.9999, 60, 12
#: Groups whose estimates (a row of about 200 bytes each) are handed to every task, at most; beyond, joins salted SALTS ways.
FEW, SALTS = 10_000, 16
#: Scale added to each statistic: word length, symbols, repeated lines, repeated words, capitals.
FLOORS = (0.08, 0.05, 0.12, 0.12, 0.05)
STATS = ("x0", "x1", "x2", "x3", "x4")
SPLIT = r"[ \t\n\x0B\f\r]+"
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeat_words(words: Column, k: int = 5) -> Column:
    """Words that stand in a k-word window found twice or more in the text."""

    def spread(places):  # ascending starts of such windows: each adds what the next does not cover
        n = F.size(places)
        gaps = F.transform(places, lambda p, i: F.when(i == n - 1, F.lit(k)).otherwise(F.least(F.lit(k), F.get(places, i + 1) - p)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def found(grams):
        def twice(s):
            here = F.filter(s, lambda x, i: (x["g"] == F.get(s, i + 1)["g"]) | (F.when(i > 0, F.get(s, F.greatest(i - 1, F.lit(0)))["g"] == x["g"]).otherwise(F.lit(False))))
            return let(F.sort_array(F.transform(here, lambda x: x["i"])), spread)

        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.cast("long").alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(ordered, twice))

    def gather(h):
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(F.size(h) <= k, F.lit(0).cast("long")).otherwise(let(grams, found))

    return let(F.transform(words, lambda w: F.xxhash64(w)), gather)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, the four base counts, base_failed, and the statistics x0 to x4."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.length(F.btrim(x, F.lit(C.WS))) > 0)
    d = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), text.alias("t"))
    d = d.select(
        "doc_id",
        "lang",
        "source",
        F.length(without(F.col("t"), C.WS)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(without(F.col("t"), "#*$%&|<>"))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        let(
            F.split(F.btrim(F.col("t"), F.lit(C.WS)), SPLIT),
            lambda w: F.struct(F.when(F.get(w, F.lit(0)) == "", F.lit(0)).otherwise(F.size(w)).cast("long").alias("n"), repeat_words(w).alias("rep")),
        ).alias("words"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).alias("capitals"),
    )
    d = d.select("doc_id", "lang", "source", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), F.col("words.rep").alias("n_repeat_words"), F.col("lines.n").alias("n_lines"), "capitals")
    n, chars = F.col("n_words"), F.col("word_chars")
    x = (
        F.log((chars + 250) / (n + 50)),
        F.sqrt(F.col("n_symbols") / (chars + 50)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10)),
        F.sqrt(F.col("n_repeat_words") / (n + 50)),
        F.sqrt(F.col("capitals") / (chars + 50)),
    )
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    return d.select("doc_id", "lang", "source", "n_words", *BASE, failed.alias("base_failed"), *[e.alias(s) for e, s in zip(x, STATS)])


def chi_square(p: float, d: int) -> float:
    """Quantile by Wilson and Hilferty."""
    a = 2 / (9 * d)
    return d * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def distance() -> Column:
    """Squared distance from columns m* and the inverse Cholesky factor w*."""
    return sum((sum(F.col(f"w{i}{j}") * (F.col(STATS[j]) - F.col(f"m{j}")) for j in range(i + 1)) ** 2 for i in range(1, len(STATS))), (F.col("w00") * (F.col("x0") - F.col("m0"))) ** 2)


def factored(groups: DataFrame) -> DataFrame:
    """From g, n, m* and covariances c*: the inverse Cholesky factor and the log determinant."""
    d = len(STATS)
    out = groups
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(d):
        for j in range(i, -1, -1):
            if i == j:
                out = out.withColumn(f"w{i}{i}", 1 / F.col(f"l{i}{i}"))
            else:
                out = out.withColumn(f"w{i}{j}", -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}"))
    return out.select("g", "n", *[f"m{i}" for i in range(d)], *[f"w{i}{j}" for i, j in PAIRS], (2 * sum((F.log(f"l{i}{i}") for i in range(d)), F.lit(0.0))).alias("logdet"))


def with_group(x: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """x with its group's row: handed to every task where there are few groups, else by a join salted so that a hot group is split."""
    if few:
        return x.join(F.broadcast(groups), "g")
    salted = x.withColumn("__salt", F.pmod(F.xxhash64(*STATS), F.lit(SALTS)).cast("int"))
    return salted.join(groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "__salt"]).drop("__salt")


def estimates(x: DataFrame, support: float, least: int, steps: int, few: bool = True) -> DataFrame:
    """(g, m*, w*, scale) by concentration steps over rows (g, x0..x4)."""
    d = len(STATS)
    quart = [F.percentile_approx(s, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i, s in enumerate(STATS)]
    start = x.groupBy("g").agg(F.count("*").alias("n"), *quart).where(F.col("n") >= least)
    start = start.select("g", "n", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(d)], *[(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])
    now = C.staged(factored(start), "mcd-start")
    before = None
    for step in range(steps):
        far = with_group(x, now, few).withColumn("d2", distance())
        cut = C.staged(now.join(far.groupBy("g").agg(F.percentile_approx("d2", support, 10_000).alias("cut")), "g"), f"mcd-cut-{step}")
        near = with_group(x, cut, few).where(distance() <= F.col("cut"))
        moments = near.groupBy("g").agg(F.first("n").alias("n"), *[F.avg(s).alias(f"m{i}") for i, s in enumerate(STATS)], *[F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i, j in PAIRS])
        moments = moments.select("g", "n", *[f"m{i}" for i in range(d)], *[(F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS])
        now = C.staged(factored(moments), f"mcd-{step}")
        total = now.agg(F.sum("logdet")).first()[0]
        if total is None or before is not None and total > before - 1e-3:
            break
        before = total
    far = with_group(x, now, few).withColumn("d2", distance())
    scale = far.groupBy("g").agg((F.percentile_approx("d2", support, 10_000) / chi_square(support, d)).alias("scale"))
    return C.staged(now.join(scale, "g").drop("n", "logdet"), "mcd")


def quality_rules(docs: DataFrame, support: float = SUPPORT, cutoff: float = CUTOFF, least: int = LEAST, steps: int = STEPS, few_groups: int = FEW) -> DataFrame:
    """base_counts with kept, distance (null where the base rule alone judged) and estimate: what the row was held against, its source and
    language, its language's small groups, the rest of small groups, or none (the base rule alone)."""
    counts = C.staged(base_counts(docs), "quality-counts")
    fit = counts.where("not base_failed")
    # by group, then by language over what small groups leave
    by_source = fit.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = by_source.where(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("n"))
    name = lambda *parts: F.concat_ws("\x1f", *[F.coalesce(p, F.lit("\x00")) for p in parts])
    keys = by_source.alias("s").join(by_lang.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")), "left")
    keys = keys.select(
        F.col("s.lang").alias("k_lang"),
        F.col("s.source").alias("k_source"),
        F.when(F.col("s.n") >= least, name(F.col("s.lang"), F.col("s.source"))).when(F.col("l.n") >= least, name(F.col("s.lang"))).otherwise(F.lit("\x02")).alias("g"),
    )
    keys = C.staged(keys, "quality-groups")
    few = keys.count() <= few_groups
    # beyond, both joins on groups are salted too: a group may hold a third of all rows
    salts = 1 if few else SALTS
    hand = lambda t: F.broadcast(t) if few else t.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    counts = counts if few else counts.withColumn("salt", F.pmod(F.xxhash64("doc_id", *STATS), F.lit(salts)).cast("int"))
    same = F.lit(True) if few else F.col("salt") == F.col("__salt")
    placed = counts.join(hand(keys), counts["lang"].eqNullSafe(F.col("k_lang")) & counts["source"].eqNullSafe(F.col("k_source")) & same, "left").drop("k_lang", "k_source", "__salt")
    fit = C.staged(placed.where("not base_failed").select("g", *STATS), "quality-fit")
    model = estimates(fit, support, least, steps, few)
    judged = placed.join(hand(model.withColumnRenamed("g", "own")), (F.col("g") == F.col("own")) & same, "left").withColumn("distance", F.when(~F.col("base_failed"), distance() / F.greatest(F.col("scale"), F.lit(1.0))))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square(cutoff, len(STATS)), F.lit(True))
    level = F.when(F.col("base_failed") | F.col("own").isNull(), "none").when(F.col("g") == "\x02", "rest").when(F.instr("g", "\x1f") > 0, "source").otherwise("language")
    return judged.withColumn("kept", kept).withColumn("estimate", level).select("doc_id", "n_words", *BASE, "base_failed", "kept", "distance", "estimate")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(C.table(spark, sf_dir, "documents"))
