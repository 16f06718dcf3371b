"""The pipeline's stages, one by one, against plain versions on their own inputs."""

import hashlib
import re

import pandas as pd
from conftest import DATA
from test_ops import LOWER, plain_line_dedup, plain_simhash, union_find

import corpus_pipeline
from srcgraph.llm import common as C
from srcgraph.llm import toxicity

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def grams(text, k):
    w = re.findall(WORDS, (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, w


def plain_leaks(text, items):
    for item in items:
        own, w = grams(item, 5)
        k = min(5, len(w))
        own = own if k == 5 else {tuple(w)}
        if k and len(own & grams(text, k)[0]) >= 0.8 * len(own):
            return True
    return False


def test_stages_against_plain_versions(spark):
    docs = C.table(spark, DATA, "documents")
    columns = docs.columns
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        steps.append(docs.toPandas())
        docs = C.staged(stage(spark, docs, DATA), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    steps.append(docs.toPandas())
    start, clean, deduped, unique, free, packed = steps

    # toxicity: as scored
    scores = toxicity.toxicity_scores(C.table(spark, DATA, "documents"), C.table(spark, DATA, "labels")).toPandas().set_index("doc_id").score
    assert set(clean.doc_id) == {i for i in start.doc_id if scores[i] < toxicity.THRESHOLD}
    assert clean.merge(start, on=columns).shape[0] == len(clean)

    # line dedup: the same rows, texts cleaned, counts followed
    want = plain_line_dedup(dict(zip(clean.doc_id, clean.text)))
    got = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in deduped.itertuples()}
    assert got == {i: v[2] for i, v in want.items()} and (deduped.n_chars == deduped.text.str.len()).all()

    # near-duplicates: the least of each group
    fp = {r.doc_id: plain_simhash(r.text or "") for r in deduped.itertuples()}
    ids = sorted(fp)
    group = union_find([(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fp[a] ^ fp[b]).bit_count() <= 4], ids)
    assert set(unique.doc_id) == set(group.values())

    # benchmark: every document that holds an item goes
    items = pd.read_parquet(f"{DATA}/benchmark.parquet").text.tolist()
    assert set(free.doc_id) == {r.doc_id for r in unique.itertuples() if not plain_leaks(r.text, items)}

    # packing: every token of what is left, once
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in free.itertuples()}
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: n for i, n in size.items() if n}
    assert packed.groupby("bin_id").length.sum().max() <= 2048
