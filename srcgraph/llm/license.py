r"""License scans by diagonal voting.

Every rolling hash of K consecutive words of every text is joined to the positions of the same words in
the templates. A match at word i of the text and position p of a template votes for the diagonal i - p. Votes are counted a
diagonal; diagonals at most MERGE apart (a word added or left out moves the rest by one) become one span; a span is
verified if it covers at least COVER of the template's word runs within a length of at most STRETCH times
the template's (all of them for templates under SHORT words, which differ in a word or two). Hash matches count only if the words are equal. The phrases of the base rule are templates too: an occurrence is a
diagonal with a vote of every run of the phrase.

All DataFrame expressions; the templates are a constant table of a few hundred rows and broadcast.

Cases: null or empty text has no words, no places, no labels and score 0; repeated rows with one doc_id and text give
equal rows; null doc_ids stay; gaps of any length are read in one pass; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C
from .quality import let

K, MERGE, COVER, STRETCH, SHORT = 3, 3, 0.8, 1.5, 12
GAPS = r"[\x00-/:-@\[-`{-\x7F]+"

#: The base rule's phrases.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Opening or naming passages of public licenses, in lower-case words.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl-2": "licensed under the gnu general public license version 2",
    "gpl-3": "licensed under the gnu general public license version 3",
    "lgpl-3": "licensed under the gnu lesser general public license version 3",
    "agpl-3": "licensed under the gnu affero general public license version 3",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "licensed under a creative commons attribution noncommercial 4 0 international license",
    "proprietary": "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means",
}


def run_hash(words: list[Column]) -> Column:
    return F.xxhash64(*[F.xxhash64(w) for w in words])


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, is_phrase, length, runs, p, run, h): a row for each position of each template."""
    rows = []
    for is_phrase, table in ((True, PHRASES), (False, NOTICES)):
        for label, text in table.items():
            words = text.split()
            for p in range(len(words) - K + 1):
                own = words[p : p + K]
                values = (len(rows), label, is_phrase, len(words), len(words) - K + 1, p, " ".join(own))
                names = ("row", "label", "is_phrase", "length", "runs", "p", "run")
                rows.append(F.struct(*[F.lit(v).alias(n) for v, n in zip(values, names)], run_hash([F.lit(w) for w in own]).alias("h")))
    out = spark.range(1).select(F.inline(F.array(*rows))).drop("row")
    return out.withColumn("template", F.concat_ws("/", F.when(F.col("is_phrase"), "phrase").otherwise("notice"), "label"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans: verified (label, first, last, cover)."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a gap at either end leaves an empty part there
    inner = lambda w: F.slice(w, F.when(F.get(w, F.lit(0)) == "", 2).otherwise(1), F.greatest(F.size(w) - F.when(F.get(w, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (F.get(w, F.size(w) - 1) == ""), 1).otherwise(0), F.lit(0)))
    d = d.select("doc_id", F.xxhash64("text").alias("th"), let(F.split("text", GAPS, -1), inner).alias("w"))
    runs = let(
        F.transform("w", lambda w: F.xxhash64(F.lower(w))),
        # the first stands for the text itself, with no hash; F.when alone would leave short texts without it
        lambda h: F.concat(F.array(F.lit(None).cast("long")), F.when(F.size(h) >= K, F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)]))).otherwise(F.array().cast("array<long>"))),
    )
    # the outer form: for the inner one the optimizer adds a filter that computes the runs a second time
    rolling = d.select("doc_id", "th", "w", runs.alias("runs")).select("doc_id", "th", "w", F.posexplode_outer("runs").alias("at", "h"))
    t = F.broadcast(templates(spark).withColumnRenamed("runs", "n_runs"))
    # one pass over the texts: what matches, and a row a text with its number of words
    met = rolling.join(t, "h", "left").where((F.col("at") == 0) | F.col("template").isNotNull())
    own = F.when(F.col("at") > 0, C.ascii_lower(F.array_join(F.slice("w", "at", K), " ")))
    met = met.withColumn("own", own).where((F.col("at") == 0) | (F.col("own") == F.col("run")))
    met = met.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), "at", "template", "label", "is_phrase", "length", F.col("n_runs").alias("runs"), "p", (F.col("at") - 1).alias("i"))
    met = C.staged(met, "license-votes")
    d = met.where("at = 0").select("doc_id", "th", "n_words")
    votes = met.where("at > 0").drop("at", "n_words").distinct()

    key = ["doc_id", "th", "template"]
    about = [F.first(c).alias(c) for c in ("label", "is_phrase", "length", "runs")]
    diagonals = votes.withColumn("diag", F.col("i") - F.col("p")).groupBy(*key, "diag").agg(*about, F.count("*").alias("votes"), F.collect_set("p").alias("ps"), F.min("i").alias("first"), (F.max("i") + K - 1).alias("last"))
    exact = diagonals.where(F.col("is_phrase") & (F.col("votes") == F.col("runs"))).groupBy("doc_id", "th").agg(
        F.count("*").alias("n_base"), F.min("diag").cast("long").alias("first_word"), F.max("diag").cast("long").alias("last_word"), F.collect_set("label").alias("base")
    )
    order = W.partitionBy(*key).orderBy("diag")
    merged = diagonals.withColumn("new", (F.col("diag") - F.lag("diag", 1).over(order) > MERGE).cast("int")).withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(order))
    spans = merged.groupBy(*key, "span").agg(*about, F.flatten(F.collect_list("ps")).alias("ps"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("votes").alias("votes"))
    whole = F.size(F.array_distinct("ps")) / F.col("runs")
    fits = F.col("last") - F.col("first") + 1 <= STRETCH * F.col("length")
    spans = spans.withColumn("cover", F.greatest(F.when(fits, whole).otherwise(F.lit(0.0)), F.least(F.lit(1.0), F.col("votes") / F.col("runs"))))
    verified = F.col("cover") >= F.when(F.col("length") < SHORT, 1.0).otherwise(COVER)
    found = spans.groupBy("doc_id", "th").agg(
        F.max("cover").alias("score"),
        F.collect_set(F.when(verified & ~F.col("is_phrase"), F.col("label"))).alias("more"),
        F.collect_list(F.when(verified, F.struct("label", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "cover"))).alias("spans"),
    )
    found = found.alias("f").join(exact.alias("e"), F.col("f.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("f.th") == F.col("e.th")), "left").select("f.*", "n_base", "first_word", "last_word", "base")

    none = F.array().cast("array<string>")
    out = d.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.th") == F.col("f.th")), "left")
    return out.select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.coalesce("base", none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("more", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<label:string,first:bigint,last:bigint,cover:double>>")).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(C.table(spark, sf_dir, "documents")).drop("spans")
