"""Each operator against a plain version of its result."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import DATA, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from srcgraph.llm import common as C
from srcgraph.llm import decontam, license, linededup, packing, passages, puquality, quality, queries, simhash, tokenout, toxicity

MID = "/root/testdata/sf0.01"
WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = {r.doc_id: r.text or "" for r in pd.read_parquet(f"{DATA}/documents.parquet").itertuples()}


def space_words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def run(spark, name, at=DATA):
    return queries.QUERIES[name](spark, at).toPandas()


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- shared pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab B\n\té."), max_size=12), max_size=8))
def test_words_and_hashes_of_blocks(texts):
    import pyarrow as pa

    seen = []
    for ids, buf, offsets in C.text_blocks(pa.array(texts, pa.string()), list(range(len(texts))), 16):
        s, e, first = C.word_spans(buf, offsets, C.class_table("space"))
        h = C.word_hashes(buf, s, e)
        for j, i in enumerate(ids):
            words = [buf[a:b].tobytes().decode() for a, b in zip(s[first[j] : first[j + 1]], e[first[j] : first[j + 1]])]
            assert words == space_words(texts[i], False)
            seen += zip(words, h[first[j] : first[j + 1]].tolist())
    assert len(set(seen)) == len({w for w, _ in seen}) == len({x for _, x in seen})


def test_components(spark):
    r = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = union_find(pairs, {x for p in pairs for x in p})
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in pairs)}


# --- 1


def plain_best_fit(pieces, capacity, per_source):
    bins, out = [], []
    for length, source, cluster in pieces:
        fit = [(capacity - sum(p[0] for p in b), i) for i, b in enumerate(bins) if cluster not in [p[2] for p in b] and [p[1] for p in b].count(source) < per_source]
        fit = [x for x in fit if x[0] >= length]
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([])
        bins[i].append((length, source, cluster))
        out.append(i)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10), st.integers(0, 2), st.integers(0, 5)), max_size=40), st.integers(1, 2))
def test_best_fit_is_tightest(pieces, per_source):
    pieces.sort(key=lambda p: -p[0])
    for hot in (0, 2, packing.HOT):
        assert packing.best_fit(pieces, 10, per_source, hot) == plain_best_fit(pieces, 10, per_source)


def test_a_hot_source_stays_fast():
    import time

    r = np.random.default_rng(0)
    lengths = sorted(r.integers(10, 200, 50_000).tolist(), reverse=True)
    at = time.perf_counter()
    bins = packing.best_fit([(n, "one" if i % 3 else f"s{i}", i if i % 4 else 0) for i, n in enumerate(lengths)], 2048, 2)
    assert time.perf_counter() - at < 30 and len(bins) == len(lengths)
    assert len(packing.best_fit([(20, "one", i) for i in range(20_000)], 2048, 2)) == 20_000


def test_near_duplicates_never_share_a_bin(spark):
    docs = docs_of(spark, [f"text number {i}" for i in range(8)])
    near = spark.createDataFrame([(i, 0 if i < 4 else i) for i in range(8)] + [(None, 3)], "doc_id long, cluster long")
    got = packing.pack(docs, 100, 9, clusters=near).toPandas()
    assert got[got.doc_id < 4].bin_id.nunique() == 4 and got.bin_id.nunique() == 4
    filled = packing.fill(packing.pack(docs, 100, 9, clusters=near)).toPandas()
    assert filled.tokens.sum() == 24


@pytest.mark.parametrize("shard", [1500, 4_000_000])
def test_packing_keeps_every_token_and_the_conflicts(spark, shard):
    got = packing.pack(C.table(spark, DATA, "documents"), 512, 2, shard).toPandas()
    want = {i: len(space_words(t)) for i, t in DOCS.items()}
    assert got.groupby("doc_id").length.sum().to_dict() == {i: n for i, n in want.items() if n}
    for i, part in got.sort_values("start").groupby("doc_id"):
        assert (part.start.to_numpy() == np.concatenate([[0], part.length.cumsum().to_numpy()[:-1]])).all()
    assert got.groupby("bin_id").length.sum().max() <= 512
    assert got.groupby(["bin_id", "cluster"]).size().max() == 1 and got.groupby(["bin_id", "source"]).size().max() <= 2
    assert not got.duplicated(["bin_id", "position"]).any()


def test_repeated_rows_never_share_a_bin(spark):
    got = packing.pack(docs_of(spark, ["a b c"] * 20 + ["A  b\nC"] * 5), 100).toPandas()
    assert got.bin_id.nunique() == 25


# --- 2


def test_decontamination_equals_sql(spark, duck):
    assert rows(run(spark, "op2_decontamination")) == rows(duck.execute(decontam.ORACLE).df())


def test_short_items_in_long_documents(spark):
    r = np.random.default_rng(5)
    word = lambda n: [f"x{i}" for i in r.integers(0, 10**9, n)]
    items = [word(n) for n in (1, 2, 3, 4, 5, 6, 7, 9, 13, 14, 20, 37, 70, 150, 600) for _ in range(4)]
    texts, want = [], set()
    for j, item in enumerate(items):
        hurt = list(item)
        if len(hurt) > 30:  # one word changed: five shingles of many
            hurt[len(hurt) // 2] = "changed"
        at = int(r.integers(0, 8000))
        body = word(8000)
        texts.append(" ".join(body[:at] + hurt + body[at:]).upper())
        want.add((j, j))
    texts += [" ".join(word(3000)) for _ in range(5)]
    bench = spark.createDataFrame([(j, "; ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs_of(spark, texts), bench).collect()}
    assert got == want


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, bench = C.table(spark, DATA, "documents"), C.table(spark, DATA, "benchmark")
    want = rows(decontam.leaks(docs, bench).toPandas())
    monkeypatch.setattr(decontam, "ITEMS_A_BLOCK", 7)
    assert rows(decontam.leaks(docs, bench).toPandas()) == want


# --- 3


def plain_counts(text):
    w = space_words(text, False)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, mark = Counter(grams), [False] * len(w)
    for i, g in enumerate(grams):
        if often[g] > 1:
            mark[i : i + 5] = [True] * 5
    lines = [x for x in text.split("\n") if space_words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(mark)


def test_base_counts(spark):
    texts = [*DOCS.values(), "a b c d e " * 3, "a b c d e a b c d e", "x x x x x", "x x x x x x", "1 2 3 4 5 6 1 2 3 4 5 7", "", "é\n é\né\n\n"]
    got = quality.base_counts(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(r) for r in got[names].to_numpy()] == [plain_counts(t) for t in texts]
    assert got.base_failed.tolist() == [n < 10 or 100 * rep > 20 * n for n, *_, rep in map(plain_counts, texts)]


def test_covariance_steps_against_numpy(spark):
    r = np.random.default_rng(11)
    clean = r.multivariate_normal([1, 2, 3, 4, 5], np.diag([1, 0.5, 0.25, 1, 2]) + 0.2, 900)
    x = np.concatenate([clean, r.normal(25, 1, (100, 5))])
    frame = spark.createDataFrame([("g", *map(float, v)) for v in x], "g string, " + ", ".join(f"{s} double" for s in quality.STATS))
    model = quality.estimates(frame, 0.75, 60, 12).first()
    floor = np.diag(np.array(quality.FLOORS) ** 2)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    mean, cov = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floor
    for _ in range(30):
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        near = x[d2 <= np.quantile(d2, 0.75)]
        mean, cov = near.mean(0), np.cov(near.T, bias=True) + floor
    assert np.allclose([model[f"m{i}"] for i in range(5)], mean, atol=0.05)
    w = np.array([[model[f"w{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
    assert np.allclose(np.linalg.inv(w.T @ w), cov, atol=0.1)
    far = frame.join(spark.createDataFrame([model]), "g").withColumn("d2", quality.distance() / quality.F.col("scale")).select("d2", "x0", "x1").toPandas()
    out = far.x0 + far.x1 > 30
    cut = quality.chi_square(0.9999, 5)
    assert out.sum() == 100 and (far.d2[out] > cut).all() and (far.d2[~out] > cut).mean() < 0.005


def test_many_groups_give_the_same(spark):
    docs = C.table(spark, MID, "documents")
    a, b = (quality.quality_rules(docs, few_groups=n).select("doc_id", "kept", "base_failed").toPandas() for n in (quality.FEW, 0))
    assert rows(a) == rows(b)


def test_chi_square():
    assert abs(quality.chi_square(0.95, 5) - 11.07) < 0.1 and abs(quality.chi_square(0.75, 5) - 6.626) < 0.05


def test_quality_rules_keep_clean_and_reject_junk(spark):
    got = run(spark, "op3_quality_rules", MID).merge(pd.read_parquet(f"{MID}/labels.parquet"), on="doc_id")
    good, bad = got[(got.quality == 1) & ~got.base_failed], got[got.quality == 0]
    assert good.kept.mean() >= 0.99 and bad.kept.mean() <= 0.1


def test_native_operators_run_no_python(spark):
    for out in (quality.base_counts(C.table(spark, DATA, "documents")), license.license_scan(C.table(spark, DATA, "documents"))):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


# --- 4


def held_out_auc(got, label):
    got = got[got.held_out].merge(pd.read_parquet(f"{MID}/labels.parquet"), on="doc_id")
    rank, y = got.score.rank(), got[label]
    n1 = int(y.sum())
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)), got


def test_quality_classifier_on_held_out(spark):
    got = run(spark, "op4_quality_classifier", MID)
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    auc, part = held_out_auc(got, "quality")
    assert auc > 0.95 and (part.predicted == part.quality).mean() > 0.93


def test_negative_labels_are_not_read(spark):
    docs, labels = C.table(spark, DATA, "documents"), C.table(spark, DATA, "labels")
    a, b = (rows(puquality.quality_scores(docs, x).toPandas()) for x in (labels, labels.where("quality = 1")))
    assert a == b


def test_class_prior():
    r = np.random.default_rng(1)
    p, n = r.beta(8, 2, 20000), r.beta(1, 8, 20000)
    hist = lambda x: np.histogram(x, 1000, (0, 1))[0].astype(float)
    assert abs(puquality.class_prior(hist(p), hist(np.concatenate([p[:14000], n[:6000]]))) - 0.7) < 0.05


# --- 5


def plain_line_dedup(docs, min_chars=20, min_docs=3):
    key = lambda line: line.strip(WS).translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("most", [linededup.CONFIRMED_MOST, 0])
def test_line_dedup_both_ways(spark, most):
    long = "A line of more than twenty characters"
    texts = {i: t for i, t in enumerate([*DOCS.values(), *[f"{long}\n  {long.upper()}\t\nown {i}" for i in range(5)], *["Ünïcode lines of twé", "Ünïcode lines of tw"] * 4, None, ""])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = linededup.line_dedup(docs, confirmed_most=most).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert {r.doc_id: (r.n_lines, r.n_dropped, sha(r.text)) for r in got} == plain_line_dedup(texts)


@pytest.mark.parametrize("most", [linededup.CONFIRMED_MOST, 0])
def test_line_dedup_without_doc_id(spark, most):
    """A null doc_id never keeps a repeated line, whichever way the lines are handed out."""
    long = "A line of more than twenty characters"
    docs = [(i, f"{long}\nown {i}") for i in range(4)] + [(None, f"{long}\nfirst"), (None, f"{long}\nfirst"), (None, "second"), (None, None)]
    got = linededup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), confirmed_most=most).collect()
    want = [(None, None, 0), (None, "first", 1), (None, "first", 1), (None, "second", 0), (0, "own 0", 1), (1, "own 1", 1), (2, "own 2", 1), (3, f"{long}\nown 3", 0)]
    assert sorted(((r.doc_id, r.text, r.n_dropped) for r in got), key=str) == sorted(want, key=str)


def test_line_dedup_equals_sql(spark, duck):
    assert rows(run(spark, "op5_line_dedup")) == rows(duck.execute(linededup.ORACLE).df())


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    docs = C.table(spark, DATA, "documents")
    want = rows(linededup.line_dedup(docs).toPandas())
    for name in ("SEGMENT", "BITS_LEAST", "BITS_MOST"):
        monkeypatch.setattr(linededup, name, 256)
    assert rows(linededup.line_dedup(docs).toPandas()) == want


# --- 6


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=60), st.integers(1, 6))
def test_compact_windows_cover_every_run_once(values, least):
    h = np.array(values, np.uint64)
    found = Counter()
    for l, c, r in zip(*(x.tolist() for x in passages.compact_windows(h, least))):
        assert 0 not in values[l : r + 1] and r - l + 1 >= least
        for i in range(l, c + 1):
            for j in range(c, r + 1):
                assert min(values[i : j + 1]) == values[c]
                if j - i + 1 >= least:
                    found[i, j] += 1
    want = {(i, j) for i in range(len(values)) for j in range(i + least - 1, len(values)) if 0 not in values[i : j + 1]}
    assert set(found) == want and set(found.values()) <= {1}


def test_passages_against_brute_force(spark):
    got = run(spark, "op6_substring_dedup")
    words = {i: space_words(t) for i, t in DOCS.items()}
    holders = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    shared = [s for s in holders.values() if len(s) > 1]
    want = union_find([(min(s), x) for s in shared for x in s], set().union(*shared))
    mine = union_find(list(zip(got.doc_id, got.peer_id)), set(got.doc_id) | set(got.peer_id))
    assert set(want) <= set(mine) and all(mine[x] == mine[c] for x, c in want.items())
    for r in got.itertuples():
        a, b = words[r.doc_id][r.start_word : r.end_word], words[r.peer_id][r.peer_start : r.peer_end]
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        assert r.end_word - r.start_word >= 50 and len(a & b) == r.n_shared and abs(len(a & b) / len(a | b) - r.similarity) < 1e-9 and r.similarity >= 0.8


def test_planted_passages(spark):
    r = np.random.default_rng(2)
    word = lambda n: [f"v{i}" for i in r.integers(0, 10**9, n)]
    passage = {n: word(n) for n in (51, 60, 120)}
    near = list(passage[120])
    near[60] = "other"
    texts = []
    for n, p in passage.items():
        texts += [" ".join(word(200) + p + word(int(r.integers(0, 300)))) for _ in range(6)]
    texts += [" ".join(word(70) + near + word(10)), " ".join(word(500)), " ".join(word(30) + passage[60][:40] + word(30))]
    got = passages.near_passages(docs_of(spark, texts)).collect()
    group = union_find([(x.doc_id, x.peer_id) for x in got], range(len(texts)))
    assert [group[i] for i in range(len(texts))] == [0] * 6 + [6] * 6 + [12] * 6 + [12, 19, 20]


def test_a_part_of_a_passage_hides_no_link(spark):
    """The least document has most of each passage, which is not enough; the others have all of it."""
    r = np.random.default_rng(9)
    word = lambda n: [f"u{i}" for i in r.integers(0, 10**9, n)]
    passage = [word(56) for _ in range(60)]
    texts = [" ".join(w for p in passage for w in word(20) + p[:45] + word(20))]
    for p in passage:
        texts += [" ".join(word(90) + p + word(60)) for _ in range(2)]
    got = passages.near_passages(docs_of(spark, texts)).collect()
    assert {(x.doc_id, x.peer_id) for x in got} == {(2 * i + 2, 2 * i + 1) for i in range(60)}


def test_edited_passages_meet_in_the_middle(spark):
    """Variants of one passage are like it and unlike each other; the passage itself is in a document amid them."""
    r = np.random.default_rng(5)
    word = lambda n: [f"w{i}" for i in r.integers(0, 10**9, n)]
    base, n = word(60), 60
    held = [list(base) for _ in range(n)]
    for i in range(n):
        if i != n // 2:
            held[i][6 + i * 7 % 48] = f"edit{i}"
    texts = [" ".join(word(40) + p + word(40)) for p in held]
    got = passages.near_passages(docs_of(spark, texts).repartition(4)).collect()
    shingles = [{tuple(p[k : k + 5]) for k in range(56)} for p in held]
    pairs = [(a, b) for a in range(n) for b in range(a) if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    assert union_find([(x.doc_id, x.peer_id) for x in got], range(n)) == union_find(pairs, range(n))


def family(r, words, copies, changes, where):
    """A passage and copies of it, each with some words changed in places of its own."""
    base = [f"f{where}x{i}" for i in r.integers(0, 10**9, words)]
    out = [base]
    for k in range(copies):
        held = list(base)
        for j in r.choice(words, changes, replace=False):
            held[j] = f"e{where}x{k}x{j}"
        out.append(held)
    return out


@pytest.mark.parametrize("words, copies, changes, families", [(60, 24, 1, 6), (100, 24, 2, 8), (100, 5, 2, 8), (200, 60, 4, 1), (400, 24, 8, 2)])
def test_families_of_edited_copies(spark, words, copies, changes, families):
    """Links of an original that is not the least document with its copies, by membership."""
    r = np.random.default_rng(words + copies)
    filler = lambda n: [f"g{i}" for i in r.integers(0, 10**9, n)]
    held = []
    for k in range(families):
        some = family(r, words, copies, changes, k)
        r.shuffle(some)
        held += [(k, p) for p in some]
    texts = [" ".join(filler(40) + p + filler(40)) for _, p in held]
    got = passages.near_passages(docs_of(spark, texts).repartition(4)).collect()
    grams = [{tuple(p[i : i + 5]) for i in range(len(p) - 4)} for _, p in held]
    want = [(a, b) for a in range(len(held)) for b in range(a) if held[a][0] == held[b][0] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    group = union_find([(x.doc_id, x.peer_id) for x in got], range(len(held)))
    assert want and sum(group[a] == group[b] for a, b in want) >= 0.9 * len(want)
    assert all(held[x.doc_id][0] == held[x.peer_id][0] for x in got)


@pytest.mark.parametrize("direct", [passages.DIRECT, 2])
def test_links_that_no_representative_shows(spark, monkeypatch, direct):
    """Texts of one origin that are unlike each other and unlike the origin, each with a near copy: all pairs of a key meet, be it by their flanks."""
    monkeypatch.setattr(passages, "DIRECT", direct)
    r = np.random.default_rng(31)
    filler = lambda n: [f"h{i}" for i in r.integers(0, 10**9, n)]
    base = filler(90)
    held = []
    for k in range(240):
        one = list(base)
        for j in r.choice(90, 4, replace=False):
            one[j] = f"k{k}x{j}"
        near = list(one)
        near[int(r.integers(90))] = f"n{k}"
        held += [one, near]
    r.shuffle(held)
    texts = [" ".join(filler(40) + p + filler(40)) for p in held]
    got = passages.near_passages(docs_of(spark, texts).repartition(4)).collect()
    grams = [{tuple(p[i : i + 5]) for i in range(len(p) - 4)} for p in held]
    want = [(a, b) for a in range(len(held)) for b in range(a) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    group = union_find([(x.doc_id, x.peer_id) for x in got], range(len(held)))
    assert len(want) >= 50 and sum(group[a] == group[b] for a, b in want) >= 0.98 * len(want)


def test_open_pairs_are_all_pairs(monkeypatch):
    """All windows of a key that differ in label and document meet once, whatever is made at a time."""
    monkeypatch.setattr(passages, "BLOCK", 7)
    r = np.random.default_rng(8)
    key, label, doc, c = (r.integers(0, n, 80) for n in (3, 6, 9, 1000))
    rows = set(zip(key.tolist(), label.tolist(), doc.tolist(), c.tolist()))
    key, label, doc, c = (np.array(x) for x in zip(*rows))
    want = {(a[0], *max(x, y), *min(x, y)) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] != b[2] for x, y in [(a[2:], b[2:])]}
    got = [x for part in passages.opened(key, doc, c, c, label) for x in zip(*(v.tolist() for v in (part[0], part[1], part[2], part[4], part[5])))]
    assert set(got) == want


def test_copies_of_a_label_meet_once():
    key, doc, c, label, copy = (np.array(x) for x in ([1] * 5, [1, 2, 3, 4, 5], [7] * 5, [9, 9, 9, 8, 6], [50, 50, 51, 52, 50]))
    got = {(int(a), int(b)) for part in passages.opened(key, doc, c, c, label, copy) for a, b in zip(part[1], part[4])}
    assert got == {(4, 1), (5, 1), (4, 3), (5, 3), (5, 4)}


def test_flanks_against_all_pairs(monkeypatch):
    r = np.random.default_rng(4)
    least, n = 46, 120
    reach = len(passages.flank_columns(least))
    beside = np.where(r.random((n, 2 * reach)) < 0.3, r.integers(1, 900, (n, 2 * reach)), 0).astype(np.uint32)
    key, label, doc, c = r.integers(0, 3, n), r.integers(0, 30, n), r.integers(0, 60, n), np.arange(n)
    core = [set(x[11:23].tolist()) - {0} for half in (beside[:, :reach], beside[:, reach:]) for x in half]
    every = [set(x.tolist()) - {0} for half in (beside[:, :reach], beside[:, reach:]) for x in half]
    near = lambda i, j: any(core[i + k] & every[j + k] or core[j + k] & every[i + k] for k in (0, n))
    want = {frozenset((i, j)) for i in range(n) for j in range(i) if key[i] == key[j] and label[i] != label[j] and doc[i] != doc[j] and near(i, j)}
    got = [frozenset((int(a), int(b))) for part in passages.flanked(least)(key, doc, c, c, label, *np.ascontiguousarray(beside).view(np.int64).T) for a, b in zip(part[2], part[5])]
    assert want and set(got) == want and len(got) == len(want)


def test_spans_are_deleted(spark):
    """The texts of the spans, more than all else that is written, go with the step."""
    from pathlib import Path

    r = np.random.default_rng(3)
    word = lambda n: " ".join(f"z{i}" for i in r.integers(0, 10**9, n))
    passage = word(80)
    docs = docs_of(spark, [f"{word(20)} {passage} {word(20)}" for _ in range(3)]).select("doc_id", "text")
    found = spark.createDataFrame([(k, 0, 128, 0, 0, 128) for k in (1, 2)], "doc long, s long, e long, peer long, ps long, pe long")
    at = Path(C.shared_dir(spark).removeprefix("file://"))
    before = set(at.glob("passage-spans-*"))
    got = passages.verified(docs, found, 46, 0.8, 2).collect()
    assert sorted((x.doc_id, x.peer_id, x.start_word, x.end_word) for x in got) == [(1, 0, 20, 100), (2, 0, 20, 100)]
    assert set(at.glob("passage-spans-*")) == before


def test_runs_keep_their_ends():
    key, doc = np.ones(6, np.uint64), np.zeros(6, np.int64)
    c = np.array([10, 12, 14, 16, 18, 40])
    extent = (np.array([3, 1, 1, 1, 1, 9]) << 32) | 50
    key, doc, c, extent = passages.inner_gone(key, doc, c, extent)
    assert c.tolist() == [10, 18, 40] and (extent >> 32).tolist() == [3, 11, 9]


# --- 7


def plain_simhash(text):
    import xxhash

    w = space_words(text)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


@pytest.mark.parametrize("tile", [simhash.TILE, 4])
def test_simhash_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_LEAST", 4)
    texts = {i: t for i, t in DOCS.items() if len(t) < 3000}
    base = next(t for t in texts.values() if len(t) > 1500)
    texts |= {10_000 + i: base + f" tail {i}" for i in range(30)}
    got = simhash.simhash_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tile=tile).toPandas().set_index("doc_id")
    fp = {i: plain_simhash(t) for i, t in texts.items()}
    assert {i: int(x) & (1 << 64) - 1 for i, x in got.fp.items()} == fp
    ids = sorted(fp)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fp[a] ^ fp[b]).bit_count() <= 4]
    assert got.component_id.to_dict() == union_find(pairs, ids)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 9))
def test_tiles_lose_no_link(seed, radius):
    r = np.random.default_rng(seed)
    a = r.integers(0, 2**64, 60, np.uint64)
    b = a[r.integers(0, 60, 60)] ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64))
    got = {(int(x), int(y)) for i, j in simhash.block_links(a, b, radius) for x, y in zip(i, j)}
    assert got == {(i, j) for i in range(60) for j in range(60) if (int(a[i]) ^ int(b[j])).bit_count() <= radius}


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_hashes_in_blocks(block, monkeypatch):
    text = ("some words and " + "a" * 300 + " long one\n\t more of them, und ünïcode ") * 5
    buf = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = C.word_spans(buf, np.array([0, len(buf)]), C.class_table("space"))
    assert (C.word_hashes(buf, s, e, block) == C.word_hashes(buf, s, e)).all()
    monkeypatch.setattr(simhash, "BLOCK", block)
    assert simhash.fingerprint(text.lower().encode(), 4) == plain_simhash(text.lower())


def test_repeated_rows_and_rows_without_id(spark):
    text = "a text of some words that stands here more than once"
    rows_ = [(1, text), (1, text), (2, text), (3, "another text altogether and quite unlike the one"), (3, "a third text that shares the number of the other one"), (None, "a text without any number at all and long enough"), (None, "a text without any number at all and long enough"), (None, text)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.stage(spark, docs, "").collect()), key=str)
    assert got == sorted([rows_[0], rows_[3], rows_[4], rows_[5]], key=str)


def test_simhash_stage_keeps_one_of_each_group(spark):
    docs = docs_of(spark, ["the same text of more than four words"] * 5 + ["another text altogether and quite unlike it"] + [None, ""])
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == [0, 5, 6]


# --- 8


def test_token_files_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, "op8_token_ids").set_index("doc_id")
    start = 0
    for i in sorted(DOCS):
        ids = [*t.encode(DOCS[i], add_special_tokens=False).ids, 2]
        assert tuple(got.loc[i, ["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano(values):
    v = np.sort(np.array(values, np.uint64))
    e = tokenout.EliasFano.from_bytes(tokenout.EliasFano.of(v).to_bytes())
    assert (e.decode() == v).all() and [e.select(i) for i in range(len(v))] == v.tolist()
    for i in range(0, len(v), 97):
        for j in (i, i + 1, min(i + 300, len(v))):
            assert e.some(i, j).tolist() == v[i:j].tolist()


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert len(tokenout.EliasFano.of(v).to_bytes()) * 8 / len(v) < 2 + np.log2(1000) + 1.5


def test_token_file_by_document(tmp_path):
    rows_ = [(None, [7]), (-3, [1, 2, 3]), (5, []), (5, [9] * 1000), (1 << 40, [4])]
    path = str(tmp_path / "x.bin")
    tokenout.write_file(path, [(i, np.array(x, "<u4").tobytes()) for i, x in rows_], 4)
    f = tokenout.TokenFile(path)
    assert [(f.doc_id(k), f.document(k).tolist()) for k in range(len(f))] == rows_


def test_shards_hold_about_equal_bytes(spark):
    """One document in a hundred is a hundred times as long as the rest, and they stand together."""
    docs = spark.createDataFrame([(i, "x" * (10_000 if i < 20 else 100)) for i in range(2000)] + [(None, "y")], "doc_id long, text string")
    cuts = tokenout.shard_cuts(docs, 20_000, 1)
    size = np.bincount(np.searchsorted(cuts, np.arange(2000)), [10_000 if i < 20 else 100 for i in range(2000)])
    assert size.max() <= 40_000 and size[:-1].min() >= 20_000


PIECES = st.lists(st.sampled_from(["the", "The", "a.", "A,", "can't", "é", "É", "J̌", "\x85", "\x1c", "…", "<|endoftext|>", "<|ENDOFTEXT|>", "ß", "İ", "中文", "...", "x9", " ", "\n", "\t", ""]), max_size=14)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_pieces_alone_give_the_same_ids(parts):
    import public_tokenizers
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    text = "".join(parts)
    got = np.frombuffer(tokenout.encoder(spec, 2, 2, True)([text])[0], "<u2").tolist()
    global TOKENIZER
    TOKENIZER = globals().get("TOKENIZER") or Tokenizer.from_str(spec)
    assert got == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 2]


# --- 9


def plain_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    hits = [(k, label) for label, p in license.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))


def test_license_base_counts(spark):
    texts = [*DOCS.values(), "Under the MIT License under the mit license", "cc by-nc CC/BY/NC by nc", "apache license, version 2.0 and under the mit. license", "the K mit under the mit licensé", "", "cc by"]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license.license_scan(docs_of(spark, texts)).collect()}
    assert got == {i: plain_license(t) for i, t in enumerate(texts)}


def test_license_texts_with_changes(spark):
    mit = license.NOTICES["mit"].split()
    texts = [" ".join(["x"] * 9 + mit[:14] + ["really"] + mit[14:]), " ".join(mit[:9] + mit[10:]), " ".join(mit[:12]), "Licensed under the GNU General Public License, version 3.", "licensed under the gnu general public license version 4", " ".join(reversed(mit))]
    got = [(r.labels, [(s.label, s.first) for s in r.spans]) for r in license.license_scan(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [("mit", [("mit", 9)]), ("mit", [("mit", 0)]), ("", []), ("gpl-3", [("gpl-3", 0)]), ("", []), ("", [])]


def plain_scan(text):
    """All diagonals of all templates by comparing every word run with every position."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    k, labels, best = license.K, set(), 0.0
    for is_phrase, table in ((True, license.PHRASES), (False, license.NOTICES)):
        for label, template in table.items():
            t = template.split()
            runs = len(t) - k + 1
            diagonals = defaultdict(list)
            for i in range(len(w) - k + 1):
                for p in range(runs):
                    if w[i : i + k] == t[p : p + k]:
                        diagonals[i - p].append((i, p))
            merged, last = [], None
            for d in sorted(diagonals):
                if last is None or d - last > license.MERGE:
                    merged.append([])
                merged[-1].append(d)
                last = d
            for some in merged:
                hits = [x for d in some for x in diagonals[d]]
                first, end = min(i for i, _ in hits), max(i for i, _ in hits) + k - 1
                whole = len({p for _, p in hits}) / runs if end - first + 1 <= license.STRETCH * len(t) else 0.0
                cover = max(whole, min(1.0, max(len(diagonals[d]) for d in some) / runs))
                best = max(best, cover)
                if not is_phrase and cover >= (1.0 if len(t) < license.SHORT else license.COVER):
                    labels.add(label)
    return labels, best


def test_license_scan_against_all_diagonals(spark):
    r = np.random.default_rng(6)
    texts = []
    for template in [*license.NOTICES.values(), *license.PHRASES.values()]:
        t = template.split()
        for _ in range(6):
            held = [x for x in t if r.random() > 0.06]
            for j in np.flatnonzero(r.random(len(held)) < 0.06)[::-1]:
                held.insert(j, "word")
            texts.append(" ".join(["start"] * int(r.integers(0, 4)) + held + ["end", *t[: int(r.integers(0, len(t)))]]))
    texts += [" ".join(r.permutation(sum((x.split() for x in license.NOTICES.values()), []))) for _ in range(5)]
    for row in license.license_scan(docs_of(spark, texts)).collect():
        labels, best = plain_scan(texts[row.doc_id])
        base = {x for x in row.base_labels.split(",") if x}
        assert set(row.labels.split(",")) - {""} == labels | base and abs(row.score - best) < 1e-12, texts[row.doc_id]


def test_license_gaps_of_any_length(spark):
    import time

    texts = ["under the mit" + " " * 1_000_000 + "license", "-" * 1_000_000, "|" + "-+" * 400_000 + "cc by nc" + " " * 300_000]
    at = time.perf_counter()
    got = [(r.n_words, r.n_base) for r in license.license_scan(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [(4, 1), (0, 0), (3, 1)] and time.perf_counter() - at < 60


# --- 10


def test_toxicity_on_held_out(spark):
    got = run(spark, "op10_toxicity", MID)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    _, part = held_out_auc(got, "toxic")
    assert (part.predicted == part.toxic).mean() > 0.9 and (part[part.toxic == 0].predicted == 0).mean() > 0.97


def test_label_model_finds_accurate_and_correlated_voters():
    r = np.random.default_rng(4)
    n = 40_000
    y = r.random(n) < 0.1
    votes = np.zeros((n, toxicity.VOTERS), bool)
    for k in range(6):
        votes[:, k] = np.where(y, r.random(n) < 0.7, r.random(n) < 0.01)
    votes[:, 6] = votes[:, 0] ^ (r.random(n) < 0.02)  # a copy
    votes[:, 7] = r.random(n) < 0.2  # noise
    patterns, counts = np.unique(votes @ (1 << np.arange(toxicity.VOTERS)), return_counts=True)
    model = toxicity.LabelModel(patterns, counts)
    assert abs(model.balance - 0.1) < 0.01 and any({0, 6} <= set(g) for g in model.groups)
    post = dict(zip(patterns.tolist(), model.posterior))
    guess = np.array([post[p] for p in (votes @ (1 << np.arange(toxicity.VOTERS))).tolist()]) > 0.5
    assert (guess == y).mean() > 0.99
