"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from srcgraph.llm import decontam, license, linededup, packing, passages, puquality, quality, simhash, tokenout, toxicity
from srcgraph.llm import common as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t \x0b\x0c\r", "en", "a", 6),
    (4, "one", "en", None, 3),
    (5, LONG, "en", "a", len(LONG)),
    (6, "same words in this very text here", None, "a", 1),
    (6, "same words in this very text here", None, "a", 1),
    (7, "same words in this very text here", "fr", "b", 1),
    (None, "a text without any number at all", "en", "a", 1),
    (8, "É́l \U0001f600 ünï ÇODE x\x85y \x1cz <|endoftext|> #*$%&|<>", "fr", "b", 1),
    (9, "\n\n\n", "en", "a", 3),
    (10, "idiot idiot scum you moron", "en", "a", 1),
]
#: Columns of inner names, of other types.
EXTRA = ("n_words", "key", "g", "kept", "fp", "rep", "score", "start", "length", "cluster", "shard", "n", "digest", "pattern", "words", "row", "p", "c", "i", "h", "w", "distance", "__drop", "__id", "__salt", "__own", "__fp", "k_lang", "n_lines", "n_dropped", "salt", "own", "group")


def odd(spark, rows=ODD, extra=True):
    docs = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        docs = docs.select("*", *[F.lit("clash").alias(c) for c in EXTRA])
    return docs


def labels(spark, rows=((10, 0, 1), (6, 1, 0), (5, 1, 0), (4, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def bench(spark, rows=((1, "same words in this very text here"), (2, None), (3, ""), (4, "one"), (5, "never seen in any of them at all"), (1, "same words in this very text here"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def tokens(docs):
    import public_tokenizers

    spark = docs.sparkSession
    return tokenout.read_tokens(spark, tokenout.write_tokens(docs, C.fresh_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), 2, by_word=True))


RUNS = {
    "packing": lambda s, d: packing.pack(d),
    "decontam": lambda s, d: decontam.leaks(d, bench(s)),
    "quality": lambda s, d: quality.quality_rules(d),
    "puquality": lambda s, d: puquality.quality_scores(d, labels(s)),
    "linededup": lambda s, d: linededup.line_dedup(d),
    "passages": lambda s, d: passages.near_passages(d),
    "simhash": lambda s, d: simhash.simhash_components(d),
    "tokens": lambda s, d: tokens(d),
    "license": lambda s, d: license.license_scan(d),
    "toxicity": lambda s, d: toxicity.toxicity_scores(d, labels(s)),
}
#: One row out for each row in.
EACH = ("quality", "puquality", "linededup", "simhash", "tokens", "license", "toxicity")


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, name):
    out = RUNS[name](spark, odd(spark)).collect()
    if name in EACH:
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ODD)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, odd(spark, [])).collect() == []


@pytest.mark.parametrize("name", RUNS)
def test_only_null_texts(spark, name):
    out = RUNS[name](spark, odd(spark, [(i, None, None, None, None) for i in range(3)], False)).collect()
    assert len(out) == (3 if name in EACH else 0)


@pytest.mark.parametrize("empty", ["puquality", "toxicity", "decontam"])
def test_empty_second_table(spark, empty):
    docs = odd(spark)
    if empty == "decontam":
        assert decontam.leaks(docs, bench(spark, [])).collect() == []
    elif empty == "puquality":
        assert {r.score for r in puquality.quality_scores(docs, labels(spark, [])).collect()} == {1.0}
    else:
        assert len(toxicity.toxicity_scores(docs, labels(spark, [])).collect()) == len(ODD)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    odd(spark).write.parquet(str(at / "documents.parquet"))
    labels(spark).write.parquet(str(at / "labels.parquet"))
    bench(spark).write.parquet(str(at / "benchmark.parquet"))
    return str(at)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, sf, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = odd(spark)
    out = stage(spark, docs, sf)
    rows = out.collect()
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert len(rows) <= len(ODD)
    assert stage(spark, odd(spark, []), sf).collect() == []


def test_stages_judge_rows_without_id(spark, tmp_path):
    """A toxic row, one with a benchmark item and one with a repeated line go or lose it, whatever their doc_id."""
    from srcgraph.llm import toxicity as X

    bad = "you stupid idiot shut up you worthless moron and scum go die "
    rows = [(i, f"{bad * 3} {i}") for i in range(40)] + [(100 + i, f"calm words about rivers and hills number {i} in the morning light") for i in range(200)] + [(None, bad * 3), (None, "calm words about rivers")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, 0, 1) for i in range(40)] + [(100 + i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    left = X.without_toxic(docs, known).where("doc_id is null").collect()
    assert [r.text for r in left] == ["calm words about rivers"]
    scores = {(r.doc_id, round(r.score, 9)) for r in X.toxicity_scores(docs, known).collect()}
    assert {r.doc_id for r in X.without_toxic(docs, known).collect()} - {None} == {i for i, x in scores if i is not None and x < X.THRESHOLD}
    item = "same words in this very text here"
    held = spark.createDataFrame([(None, f"before {item} after"), (None, "clean"), (1, item), (1, "clean too"), (2, None)], "doc_id long, text string")
    clean = decontam.without_leaks(held, bench(spark)).collect()
    assert sorted(str(r.text) for r in clean) == ["None", "clean", "clean too"]


def test_pipeline_runs(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id for r in out.collect()}
    assert 5 in kept and not kept & {6, 7}  # 6 and 7 hold a benchmark item


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
