"""Operators for training data against brute force, round trips and held-out accuracy, and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexforge.llm import bpe, graph, html, language, mixing, near_vectors, ngram_join, quality, top_products, toxicity
from lexforge.llm.textops import word_hashes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_documents(spark):
    """Null, empty, blank, short, long and repeated texts, null ids and sources, and columns whose names clash."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = " ".join(rng.choice(words) for _ in range(60))
    near = base.replace(base.split()[30], "zzzzz", 1)
    long_text = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n"), (7, "two words"), (8, "Two  Words"), (9, long_text), (10, "x" * 300_000),
        (10, "x" * 300_000), (11, "日本語 のテキスト é"), (12, base.upper()), (None, base), (None, None), (13, "12 !!"), (14, " ".join(reversed(base.split()))),
    ]
    full = [(i, t, None if i == 7 else "en", [None, "a", "b", "c"][k % 4], len(t or ""), 0.5, "q", True, 9) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS + ", score double, _id string, _held boolean, copies int"), rows


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# --- hashing -----------------------------------------------------------------------------------------------------------


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    from lexforge.llm import textops

    rng = random.Random(2)
    texts = ["", None, "a b", " x ", *(" ".join(rng.choice(["aa", "b", "ccc", "É", "x" * 40]) for _ in range(rng.randint(0, 60))) for _ in range(50)), "y" * 500]
    found = {}
    for size in (1 << 20, 64):
        monkeypatch.setattr(textops, "SEGMENT", size)
        out = {}
        for first, hashes, bounds, (head,) in word_hashes(pa.array(texts), (2,)):
            for k in range(len(bounds) - 1):
                assert first + k not in out
                out[first + k] = (hashes[bounds[k] : bounds[k + 1]].tolist(), head[bounds[k] : bounds[k + 1]].tolist())
        found[size] = out
    assert found[64] == found[1 << 20]
    assert [len(found[64][k][0]) for k in range(len(texts))] == [len(WORD.findall(t or "")) for t in texts]
    by_word = {}
    for k, t in enumerate(texts):
        for w, h in zip(WORD.findall(t or ""), found[64][k][0], strict=True):
            assert by_word.setdefault(w.lower() if w.isascii() else w, h) == h
    assert len(set(by_word.values())) == len(by_word)


# --- 1: n-gram join ----------------------------------------------------------------------------------------------------


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else root(i)) for i, s in sets)


def test_join_on_odd_rows(spark):
    docs, rows = odd_documents(spark)
    got = Counter(tuple(r) for r in ngram_join.jaccard_join(docs).collect())
    assert got == brute_components(rows)
    assert ngram_join.jaccard_join(empty(spark)).count() == 0


@pytest.mark.parametrize("small", [None, 0, 40])
def test_join_against_all_pairs(spark, small):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    rows, at = [], 0
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 4, 5, 8, 9, 12, 20, 40, 90]))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 2) if copy else 0):
                k = rng.randrange(max(len(copy), 1))
                copy[k : k + 1] = rng.choice([[], [rng.choice(words)], [*copy[k : k + 1], rng.choice(words)]])
            rows.append((at, " ".join(copy)))
            at += 1
    got = Counter(tuple(r) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), small=small, buckets=3).collect())
    assert got == brute_components(rows)


def test_long_lists_in_blocks(spark, monkeypatch):
    """Groups of near copies beyond what a short list holds, dealt in parts and blocks, with the light side in use."""
    for name, value in (("LONG", 3), ("PART", 7), ("POSTINGS", 400), ("FLUSH", 100), ("WANTED", 1 << 15)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(9)
    rows, at = [], 0
    shared = [f"s{k}" for k in range(40)]
    for group in range(6):  # copies of one text, and texts that share a long passage with all of them
        base = [f"g{group}w{k}" for k in range(30)] + shared
        for _ in range(40 if group < 2 else 6):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((at, " ".join(copy)))
            at += 1
    for k in range(60):
        rows.append((at, " ".join(shared[: rng.randint(5, 40)] + [f"y{k}"] * rng.randint(0, 3))))
        at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows)
    for small in (None, 0, 60):
        assert Counter(tuple(r) for r in ngram_join.jaccard_join(docs, small=small, buckets=2).collect()) == expected
    assert max(Counter(c for _, _, c in expected.elements()).values()) > 3 * ngram_join.PART


def test_boundary_by_cost():
    """Short lists are scanned; the longer they are, the larger the sets that enumerate pairs."""
    sets = np.full(256, 100.0)
    postings = sets * (np.arange(256) - ngram_join.least_overlap(np.arange(256)) + 1)
    sizes = [ngram_join.boundary(sets, postings * others) for others in (0.0, 1.0, 3.0, 10.0)]
    assert sizes[0] == 0 and sizes == sorted(sizes) and sizes[1] >= 9 and sizes[-1] > 40


def test_light_sets_find_links_by_pairs(spark):
    """Short texts that share frequent shingles: the measured boundary makes them light, and pairs of shingles alone,
    without single postings of theirs, give every link."""
    rng = random.Random(10)
    parts = [" ".join(f"p{k}q{j}" for j in range(6)) for k in range(12)]
    rows = [(k, " ".join(rng.sample(parts, 2))) for k in range(300)] + [(300 + k, f"{rows_k} end{k}") for k, rows_k in enumerate(" ".join(rng.sample(parts, 2)) for _ in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketch, _ = ngram_join.profile(docs, "text")
    base = ngram_join.profiles(docs, sketch, ngram_join.frequent(sketch), "doc_id", "text").dropDuplicates(["node"]).cache()
    counts = ngram_join.list_lengths(base)
    small = ngram_join.boundary(*ngram_join.scan_costs(base, counts))
    assert small >= 9  # 8 and 9 shingles a text
    long = np.zeros(ngram_join.COUNTERS, bool)
    keys = {r.node: ngram_join.keys_of(np.frombuffer(r.prefix, np.uint64), r.n, 12, long) for r in base.collect()}
    sizes = {r.node: r.n for r in base.collect()}
    assert all((k.place == ngram_join._NOWHERE).all() for node, k in keys.items() if 5 * sizes[node] < 48)
    found = Counter(tuple(r) for r in ngram_join.jaccard_join(docs, small=12).collect())
    assert found == brute_components(rows) and len({c for _, _, c in found}) < len(found)


def test_keys_meet_only_in_first_common_list(spark):
    """Short lists give each pair that can link, and long lists those of different clusters, in chunks of pairs."""
    rng = np.random.default_rng(11)
    key = np.repeat(np.arange(3, dtype=np.int64), 40)
    node = rng.integers(0, 60, 120)
    n = np.full(120, 10)
    zero = np.zeros((120, 2), np.uint64)
    label = node % 4
    rows = pa.Table.from_batches(ngram_join._crossed(key, node, n, label, np.zeros(120, np.uint32), zero, np.zeros(120, np.int8)))
    expected = {(min(a, b), max(a, b)) for k in range(3) for a in node[key == k] for b in node[key == k] if a % 4 != b % 4}
    assert {(r["a"], r["b"]) for r in rows.to_pylist()} == expected


def test_keep_one(spark):
    docs, _ = odd_documents(spark)
    docs = docs.withColumns({"_gone": F.lit(1), "_many": F.lit("m"), "_turn": F.lit(None).cast("int"), "n": F.lit(5), "node": F.lit(1), "component_id": F.lit(0)})
    kept = ngram_join.keep_one(docs)
    assert kept.schema == docs.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 9, 10, 11, 13, 14, None, None])


def test_look_up(spark):
    rng = random.Random(24)
    rows = [(k, rng.choice([1, 1, 1, 2, 3, 4, 5, None])) for k in range(4000)]
    weights = Counter(x for _, x in rows)
    table = spark.createDataFrame([(x, f"t{x}", weights[x]) for x in (1, 2, 3, 4, 9)], "k long, t string, w long")
    got = graph.look_up(spark.createDataFrame(rows, "i long, k long"), table, "k", "w", 4_000_000)
    assert Counter((r.i, r.t) for r in got.collect()) == Counter((i, f"t{x}") for i, x in rows if x in (1, 2, 3, 4))
    assert got.columns == ["k", "i", "t"] and graph.look_up(spark.createDataFrame(rows, "i long, k long"), table, "k", "w", 4000).count() == got.count()


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(k in p and p[0] != p[1] for p in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 2, 5: tokens ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_library(reference_coder):
    coder, rng = bpe.bpe(), random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "é", "ß", "漢", "😀", "'s", "1", "22", "!", "...", "the", "ing", "A", "\x00", "\t", "zz", "x" * 30]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = coder.encode(text)
        assert ids == reference_coder.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
        assert coder.count(text) == len(ids)
        i = rng.randint(0, len(text))
        j = rng.randint(i, min(len(text), i + 4))
        new, again = coder.reencode(text, i, j, rng.choice(parts))
        assert again == reference_coder.encode_ordinary(new)
    whole = coder.encoded("The quick  brown fox's tail, 12 times; " * 40)
    for _ in range(200):  # edits of edits
        i = rng.randint(0, len(whole.text))
        whole = coder.edited(whole, i, min(len(whole.text), i + rng.randint(0, 9)), rng.choice(parts))
        assert whole.ids() == reference_coder.encode_ordinary(whole.text)
    table = bpe.PrefixTable(coder, b"interna")
    table.append(b"tionalisation")
    assert table.ids() == reference_coder._core_bpe.encode_single_piece(b"internationalisation")
    table.truncate(7)
    assert table.ids() == reference_coder._core_bpe.encode_single_piece(b"interna")


def test_bpe_remembers_a_bounded_number_of_pieces(monkeypatch, reference_coder):
    for name, value in (("REMEMBERED", 50), ("MARKS", 64), ("PAIRS", 40)):
        monkeypatch.setattr(bpe, name, value)
    coder, rng = bpe.Bpe(), random.Random(12)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12))) for _ in range(8))
        assert coder.encode(text) == reference_coder.encode_ordinary(text)
        assert max(len(coder._memory), len(coder._older)) <= 50 and len(coder.known_fits) <= 40


def test_workers_give_up_what_others_remember():
    from lexforge.llm import textops

    bpe.bpe.cache_clear()
    for _ in range(3):
        bpe.bpe()
    assert bpe.bpe.cache_info().misses == 1
    assert list(textops.tidied(lambda batches: batches, "bpe")(iter([1]))) == [1] and bpe.bpe.cache_info().currsize == 1
    assert list(textops.tidied(lambda batches: batches)(iter([1]))) == [1] and bpe.bpe.cache_info().currsize == 0


def test_tables_grow_as_if_made_whole(reference_coder):
    coder, rng = bpe.bpe(), random.Random(25)
    for _ in range(200):
        data = "".join(rng.choice(["the", "in", "g", " ", "é", "x", "tion", "\n", "a" * 9]) for _ in range(rng.randint(1, 30))).encode()
        table, at = bpe.PrefixTable(coder), 0
        while at < len(data):
            step = rng.randint(1, 12)
            table.append(data[at : at + step])
            at += step
        whole = bpe.PrefixTable(coder, data)
        assert (table.last, table.width, table.data) == (whole.last, whole.width, whole.data)
        cut = rng.randrange(len(data))
        table.truncate(cut)
        assert table.last == whole.last[: cut + 1] and -1 not in whole.last[1:]


def test_encode_texts(spark, reference_coder):
    docs, rows = odd_documents(spark)
    got = bpe.encode_texts(docs, keep_ids=True)
    expected = Counter()
    for i, t in rows:
        ids = reference_coder.encode_ordinary(t or "")
        expected[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:4] for r in got.collect()) == expected
    assert sorted(r.text for r in bpe.decode_ids(got).collect()) == sorted(t or "" for _, t in rows)
    assert bpe.encode_texts(empty(spark)).count() == 0


def test_token_counts(spark, reference_coder):
    docs, rows = odd_documents(spark)
    sizes = [len(reference_coder.encode_ordinary(t or "")) for _, t in rows]
    histogram = bpe.length_histogram(docs)
    assert {r.n_tokens: r.n_docs for r in histogram.collect()} == Counter(sizes)
    for r in bpe.suffix_sums(histogram, span=4).collect():
        n = r.n_tokens
        assert r.docs_at_least == sum(s >= n for s in sizes) and r.tokens_at_least == sum(s for s in sizes if s >= n)
        assert r.tokens_if_cut == sum(min(s, n) for s in sizes) and r.quantile == pytest.approx(sum(s <= n for s in sizes) / len(sizes))
    for r in bpe.context_totals(bpe.suffix_sums(histogram), [0, 1, 50, 10**6]).collect():
        assert (r.docs_over, r.tokens_kept, r.docs) == (sum(s > r.context for s in sizes), sum(min(s, r.context) for s in sizes), len(sizes))
    assert bpe.suffix_sums(bpe.length_histogram(empty(spark))).count() == 0


# --- 3, 7, 8: classifiers ----------------------------------------------------------------------------------------------


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def accuracy(spark, query, label):
    truth = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in query(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in truth]
    assert all(held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    good = [r for r in rows if truth[r.doc_id]]
    bad = [r for r in rows if not truth[r.doc_id]]
    return sum(r.predicted for r in good) / len(good), 1 - sum(r.predicted for r in bad) / len(bad)


def test_quality_on_held_out(spark):
    good, bad = accuracy(spark, quality.op3_quality, "quality")
    assert good > 0.93 and bad > 0.85


def test_toxicity_on_held_out(spark):
    hits, clean = accuracy(spark, toxicity.op8_toxicity, "toxic")
    assert hits > 0.85 and clean > 0.98


def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    rows = language.op7_language(spark, "/root/testdata/sf0.1").filter("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.99


def test_quality_features_by_hand():
    """Each feature once a document: words, ends, capitals and pairs, counted plainly."""
    rng = random.Random(16)
    texts = [" ".join(rng.choice(["the", "The", "cat", "CAT", "sat", "dog", "dogs", "Mat"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    found = {}
    for first, n, owner, cell in quality.features(pa.array(texts)):
        for k in range(n):
            found[first + k] = cell[owner == k]
    for k, t in enumerate(texts):
        w = [x.lower() for x in t.split()]
        plain = {("w", x) for x in w} | {("e", x[-1]) for x in w} | {("t", x[-3:]) for x in w}
        plain |= {("c", min(3, sum(c.isupper() for c in x))) for x in t.split()}
        plain |= {("p", a, b) if a != b else ("twice",) for a, b in zip(w, w[1:])}
        assert len(found[k]) == len(set(found[k].tolist())) == len(plain)
    assert set(found[texts.index(texts[5])].tolist()) == set(found[5].tolist())


def test_dual_descent_against_plain_steps():
    """The same steps on whole vectors, one row at a time, and the conditions that hold at the optimum."""
    rng = np.random.default_rng(17)
    width, rows, y = 30, [], []
    for _ in range(40):
        cells = np.sort(rng.choice(width, rng.integers(1, 8), replace=False))
        rows.append((cells, 1 / np.sqrt(len(cells))))
        y.append(1.0 if cells.min() < 5 else -1.0)
    y, ratio, cost = np.array(y), rng.normal(size=width), np.full(40, 0.7)
    w, bias = quality.dual_descent(rows, y, ratio, cost=cost, rounds=3, seed=1)
    order = np.random.default_rng(1)
    x = np.zeros((40, width + 1))
    for k, (cells, scale) in enumerate(rows):
        for c in cells:
            x[k, c] = ratio[c] * scale
        x[k, width] = 1
    alpha = [0.0] * 40
    for _ in range(3):
        for i in order.permutation(40):
            v = [sum(alpha[k] * y[k] * x[k, c] for k in range(40)) for c in range(width + 1)]
            slope = y[i] * sum(v[c] * x[i, c] for c in range(width + 1)) - 1
            alpha[i] = min(max(alpha[i] - slope / sum(z * z for z in x[i]), 0.0), cost[i])
    plain = [sum(alpha[k] * y[k] * x[k, c] for k in range(40)) for c in range(width + 1)]
    assert w == pytest.approx(plain[:-1], abs=1e-9) and bias == pytest.approx(plain[-1], abs=1e-9)
    w, bias = quality.dual_descent(rows, y, ratio, cost=cost, rounds=400, seed=1)
    primal = 0.5 * (w @ w + bias * bias) + sum(c * max(0, 1 - t * (x[k, :-1] @ w + bias)) for k, (t, c) in enumerate(zip(y, cost)))
    for _ in range(50):  # no step away is better
        dw, db = 0.01 * rng.normal(size=width), 0.01 * rng.normal()
        assert primal <= 1e-9 + 0.5 * ((w + dw) @ (w + dw) + (bias + db) ** 2) + sum(c * max(0, 1 - t * (x[k, :-1] @ (w + dw) + bias + db)) for k, (t, c) in enumerate(zip(y, cost)))


def test_ratios_of_the_fitted_model(spark):
    """Weights carry the log-count ratio of each feature: a word of one class only pulls to that class."""
    rows = [(k, f"same words {'good' if k % 2 else 'bad'} end") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scores = model.scores(pa.array(["good", "bad", "same words"]))
    assert scores[0] > 0.5 > scores[1] and scores[1] < scores[2] < scores[0]


def plain_pooled(model, words):
    """Convolution and max pooling word by word: each filter's best window, which may reach over the text's end."""
    gap, rows = max(toxicity.WIDTHS), max(len(words), 1)
    x = [sum(model.table[c] for c in w) for w in words] + [np.zeros(toxicity.DIM)] * (gap + 1)
    out = []
    for width, kernel, offset in zip(toxicity.WIDTHS, model.kernels, model.offsets, strict=True):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(x[at + k] @ kernel[k][:, f]) for k in range(width)) for at in range(rows))
            out.append(max(best + offset[f], 0.0))
    return out


def test_convolution_against_plain_loops():
    rng = np.random.default_rng(18)
    table = rng.normal(size=(toxicity._PAD + 1, toxicity.DIM)).astype(np.float32)
    table[toxicity._PAD] = 0
    model = toxicity.Model(table, [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32), 0.1, np.zeros((toxicity._PAD, 1), np.float32), np.array([0.25]))
    words = random.Random(18)
    texts = ["", "one", "one two", None, *(" ".join(words.choice(["aa", "bbbbb", "ccccccc", "dd", "e"]) for _ in range(k)) for k in (3, 4, 9, 30))]
    got = model.scores(pa.array(texts))
    for first, cells, bounds in toxicity.words_of(pa.array(texts)):
        pooled = model.pooled(*toxicity.padded(cells, bounds))
        for k in range(len(bounds) - 1):
            plain = plain_pooled(model, cells[bounds[k] : bounds[k + 1]].tolist())
            assert pooled[k] == pytest.approx(plain, abs=1e-4)
            assert got[first + k] == pytest.approx(1 / (1 + math.exp(-(float(np.dot(plain, model.dense)) + 0.1 + 0.25))), abs=1e-4)


def test_training_follows_the_slope_of_the_loss():
    """One pass over one batch moves every weight against the numerical slope of the weighted logistic loss."""
    rng = np.random.default_rng(19)
    cells = [rng.integers(0, 40, (k, 4)).astype(np.int32) for k in (3, 5, 8, 2, 6, 4, 7, 9)]
    y = np.array([1, 0, 1, 0, 0, 1, 0, 0], np.float32)

    def loss(model):
        share = y.mean()
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        logit = model.pooled(*toxicity.joined(cells)) @ model.dense.astype(float) + model.bias
        return float((weight * np.log1p(np.exp(np.where(y > 0, -logit, logit)))).mean())

    losses = [loss(toxicity.train(cells, y, rounds=k, batch=8)) for k in (0, 1, 4, 30)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.5 * losses[0]


def test_best_cut_against_all_cuts():
    rng = np.random.default_rng(20)
    for _ in range(30):
        logit, y = np.round(rng.normal(size=25), 1), (rng.random(25) < 0.4).astype(np.float32)
        if not y.sum():
            continue

        def f1(cut, logit=logit, y=y):
            hits = float(y[logit >= cut].sum())
            return 2 * hits / (float((logit >= cut).sum()) + float(y.sum()))

        assert f1(toxicity.best_cut(logit, y)) == pytest.approx(max(f1(c) for c in logit))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_odd_rows(spark, module):
    docs, rows = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (7, None, None), (None, 1, 1), (9, 1, 1), (11, 0, 0), (1, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.score(docs, module.fit(docs, labels)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) and r.held_out == held(r.doc_id) and r.predicted == (r.score >= module.THRESHOLD) for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5, 6)}) == 1 and len({r.score for r in got if r.doc_id == 10}) == 1
    none = module.fit(docs, labels.filter("false"))
    assert {r.score for r in module.score(docs, none).collect()} == {0.5}
    assert module.score(empty(spark), none).count() == 0


def test_labels_are_not_inputs(spark):
    docs, _ = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, 1), (11, 0), (14, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    assert sorted(r.score for r in toxicity.score(docs, model).collect()) == sorted(r.score for r in toxicity.score(other, model).collect())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema and kept.count() == toxicity.score(docs, model).filter("predicted = 0").count()


def plain_phrases(known, text):
    """Phrases of a greedy parse, character by character."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in known:
            size += 1
        at += size
        n += 1
    return n


def counted(model, texts):
    chars, bounds, _ = model.normal(*language.text_buffer(pa.array(texts)))
    return model.phrases(chars, bounds)


@pytest.mark.parametrize("cells", [language.CELLS, 0])
def test_phrases_against_plain_parsing(monkeypatch, cells):
    """Short and long texts, alone and side by side, from dense and sparse tables: no block begins a phrase."""
    monkeypatch.setattr(language, "CELLS", cells)
    known = {"aa": "the cat sat on the mat and the dog", "bb": "der hund und die katze auf der matte"}
    model = language.build(known)
    rng = random.Random(14)
    words = [*known["aa"].split(), *known["bb"].split(), "xyz", "q"]
    texts = ["the katze sat", "cat", "xyz the", "a b c d", "der der der", "", *(" ".join(rng.choice(words) for _ in range(rng.choice([3, 90, 200, 700]))) for _ in range(130))]
    expected = [[plain_phrases(known[k], x) for k in model.names] for x in texts]
    assert max(map(len, texts)) > 2000
    assert counted(model, texts).tolist() == expected
    assert [counted(model, [x])[0].tolist() for x in texts[-20:]] == expected[-20:]


@pytest.mark.parametrize("piece", [language.PIECE, 1000])
def test_phrases_of_very_long_texts(monkeypatch, piece):
    """Phrases, and runs of what is no letter, go on over the ends of pieces."""
    monkeypatch.setattr(language, "PIECE", piece)
    known = {"aa": "the cat sat on the mat é and the dog", "bb": "der hund und die katze auf der matte"}
    model = language.build(known)
    rng = random.Random(15)
    words = [*known["aa"].split(), *known["bb"].split(), "éé", "..", "12"]
    text = " ".join(rng.choice(words) for _ in range((3 * piece if piece == 1000 else piece // 3)))
    plain = re.sub("[^a-zé]+", " ", text)
    raw = np.frombuffer(text.encode(), np.uint8)
    assert len(raw) > piece
    count, size, letters = model.piecewise(raw)
    assert count.tolist() == [plain_phrases(known[k], plain) for k in model.names]
    assert size == len(plain) and letters == len(plain.replace(" ", ""))
    best, score = model.predict(pa.array([text, "the cat", text[: piece // 2]]))
    rate = count * model.bits
    assert best[0] == rate.argmin() and best[1] == 0 and 0 < score[0] <= 1


def test_learned_length_does_not_depend_on_alphabets(monkeypatch):
    rng = random.Random(3)
    texts = {f"l{k}": "".join(rng.choice("abcdefghijklmnop   ") for _ in range(3000)) for k in range(9)}
    texts["zh"] = "".join(chr(0x4E00 + rng.randrange(3500)) for _ in range(5000))
    model = language.build(texts)
    assert min(model.bits) > math.log2(2500) and isinstance(model.tables[-1], language.Sparse)
    monkeypatch.setattr(language, "CELLS", 0)
    other = language.build(texts)
    chars, bounds, _ = model.normal(np.frombuffer((texts["l0"][50:900] + texts["zh"][:99] + "xyz").encode(), np.uint8), np.array([0, 850 + 3 * 99 + 3]))
    assert model.phrases(chars, bounds).tolist() == other.phrases(chars, bounds).tolist()


def test_language_learns_beyond_headers(spark):
    docs = spark.createDataFrame([(k, "header " * 200 + chr(0x4E00 + k) * 400, "en") for k in range(40)], "doc_id long, text string, lang string")
    model = language.fit(docs, rows=64)
    known = [model.local[0][model.classes[0x4E00 + k]] < model.local[0].max() for k in range(40) if 0 < model.classes[0x4E00 + k] < model.width - 1]
    assert sum(known) >= 15  # one document for each value of the hash


def test_language_learns_whole_texts_of_bounded_rows(spark):
    """At most rows documents of a language, each whole; longer ones only where a language has no other."""
    rows = [(k, "".join(chr(0x4E00 + 40 * k + j) for j in range(40)), "zh") for k in range(60)] + [(100 + k, "ab" * 5000 + "z" * k, "en") for k in range(1, 9)] + [(200, None, "fr"), (None, "xy", "fr"), (201, "xy", None)]
    rows = [r for r in rows if not held(r[0])]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")
    model = language.fit(docs, rows=8, longest=1000)
    assert model.names == ["en", "zh"]
    en, zh = ((int(2**b) - 2) for b in model.bits)
    shortest = min(len(t) for _, t, lang in rows if lang == "en" and t)
    assert abs(en - shortest) <= 1  # the shortest, whole
    assert zh % 41 in (39, 40, 0) and 5 * 40 <= zh <= 8 * 41  # whole texts of 40 letters with a space between


def test_language_of_odd_rows(spark):
    docs, rows = odd_documents(spark)
    got = language.predict(docs, language.fit(docs)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by_id = {r.doc_id: r for r in got}
    assert {by_id[i].lang_pred for i in (4, 5, 6, 13)} == {"und"} and by_id[11].lang_pred == by_id[9].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    assert language.drop_unknown(docs, language.fit(docs)).schema == docs.schema
    assert language.drop_unknown(docs, language.fit(docs)).count() == 12
    nothing = language.fit(empty(spark))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(empty(spark), nothing).count() == 0


# --- 4, 6: vectors -----------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(spark, n=600):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 8))
    x[n // 2 :] = x[: n - n // 2] + 0.2 * rng.normal(size=(n - n // 2, 8))
    rows = [(k, [float(v) for v in np.float32(r)], 1) for k, r in enumerate(x)]
    rows += [(n, rows[0][1], 1), (n + 1, rows[0][1], 2), (n + 2, None, 1), (n + 3, [0.0] * 8, 1), (n + 4, [float("nan")] * 8, 1), (n + 5, [float("inf")] * 8, 1), (n + 6, [1.0, None] * 4, 1), (n + 7, [], 1), (n + 8, [1.0, 2.0], 1), (n + 9, [2.0, 4.0], 1), (n + 10, [-v for v in rows[1][1]], 1)]
    return spark.createDataFrame(rows, VECTORS), rows


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


@pytest.mark.parametrize("cells", [1, 12])
def test_near_vectors(spark, cells):
    table, rows = odd_vectors(spark)
    live = [(i, np.array(v, float)) for i, v, _ in rows if usable(v) and any(v)]
    links = {i: set() for i, _, _ in rows}
    for i, v in live:
        for j, w in live:
            if i != j and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.9:
                links[i].add(j)
    got = {r.vec_id: r for r in near_vectors.near_duplicates(table, cells=cells).collect()}
    assert len(got) == len(rows)
    found, there = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert found >= 0.9 * there and all(r.n_links <= len(links[i]) for i, r in got.items())
    if cells == 1:
        assert found == there
        for i, r in got.items():
            group, todo = {i}, [i]
            while todo:
                new = links[todo.pop()] - group
                group |= new
                todo += new
            assert r.component_id == min(group) and r.kept == (i == min(group))
    assert near_vectors.near_duplicates(empty(spark, VECTORS)).count() == 0
    assert near_vectors.keep_representatives(table).schema == table.schema


def test_near_vectors_of_repeated_ids_and_odd_columns(spark):
    """Rows that share an id have the most links of any of them and the smallest component; many equal vectors; clashes."""
    rng = np.random.default_rng(23)
    base = rng.normal(size=(6, 8))
    rows = [(int(rng.integers(0, 40)), [float(x) for x in base[rng.integers(0, 6)] + 0.02 * rng.normal(size=8)]) for _ in range(120)]
    rows += [(100 + k, [1.0] * 8) for k in range(60)] + [(7, [float(x) for x in rng.normal(size=8)]), (7, None), (None, [1.0] * 8), (200, [0.0] * 8), (201, [-0.0, 1.0]), (202, [0.0, 2.0])]
    live = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and any(v)]
    count, joined = Counter(), {i: i for i, _ in rows if i is not None}

    def root(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, (i, v) in enumerate(live):
        links = [j for b, (j, w) in enumerate(live) if a != b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.9]
        count[i] = max(count[i], len(links))
        for j in links:
            x, y = root(i), root(j)
            joined[max(x, y)] = min(x, y)
    table = spark.createDataFrame([(*r, "x", 1, True, 2.0) for r in rows], "vec_id long, embedding array<double>, node string, _gone int, kept boolean, v double").repartition(4)
    for cells in (1, 5):
        got = near_vectors.near_duplicates(table, cells=cells).collect()
        assert Counter(r.vec_id for r in got) == Counter(i for i, _ in rows)
        for r in got:
            i = r.vec_id
            assert (r.n_links, r.component_id, r.kept) == ((0, None, True) if i is None else (count[i], root(i), root(i) == i))
    kept = near_vectors.keep_representatives(table)
    assert kept.schema == table.schema and {r.vec_id for r in kept.collect()} == {i for i, _ in rows if i is None or root(i) == i}


def test_cells_visited_lose_no_link():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(2, 20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    v = np.concatenate([x, 0.91 * x + (1 - 0.91**2) ** 0.5 * y / np.linalg.norm(y, axis=1)[:, None]])
    home, visits = near_vectors.place(v, near_vectors.spherical_kmeans(v[rng.choice(len(v), 8192, replace=False)], 200))
    assert all(home[k + len(x)] in visits[k] or home[k] in visits[k + len(x)] for k in range(len(x)))


def test_near_vectors_in_many_cells(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    v = np.float32(np.concatenate([x, 0.91 * x + (1 - 0.91**2) ** 0.5 * y]))
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert links.sum() == 6000
    table = spark.createDataFrame([(k, r.tolist(), 1) for k, r in enumerate(v)], VECTORS)
    got = {r.vec_id: r for r in near_vectors.near_duplicates(table, cells=200).collect()}
    assert [got[k].n_links for k in range(6000)] == links.tolist()
    assert [got[k].component_id for k in range(6000)] == [k % 3000 for k in range(6000)]


def test_top_products(spark):
    table, rows = odd_vectors(spark)
    live = [(i, np.floor(256 * np.array(v, float))) for i, v, _ in rows if usable(v)]
    expected = set()
    for q, v in live:
        if q % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in live if j != q and len(w) == len(v))[:5]
            expected |= {(q, k, j, -s) for k, (s, j) in enumerate(best, 1)}
    assert {tuple(r) for r in top_products.top_products(table).collect()} == expected
    assert top_products.top_products(empty(spark, VECTORS)).count() == 0


def plain_top(rows, every, k=5):
    """Each query row's ranking by brute force."""
    live = [(n, i, np.floor(256 * np.array(v, float))) for n, (i, v) in enumerate(rows) if i is not None and usable(v)]
    out = Counter()
    for n, i, v in live:
        if i % every == 0:
            best = sorted((-int(v @ w), j) for m, j, w in live if m != n and len(w) == len(v))[:k]
            out.update((i, rank, j, -s) for rank, (s, j) in enumerate(best, 1))
    return out


def test_top_products_in_many_blocks(spark, monkeypatch):
    table, rows = odd_vectors(spark, 400)
    for name, value in (("STRIPE", 64), ("QUERIES", 8), ("STEP", 16), ("TURNS", 2), ("LEAST", 50)):
        monkeypatch.setattr(top_products, name, value)
    assert Counter(tuple(r) for r in top_products.top_products(table, every=5).collect()) == plain_top([(i, v) for i, v, _ in rows], 5)


def test_top_products_of_repeated_ids_and_ties(spark, monkeypatch):
    """Rows are told apart by themselves: repeated ids, repeated vectors and equal scores, in one block and in many."""
    rng = np.random.default_rng(22)
    rows = [(int(rng.integers(0, 30)) if k % 9 else None, [float(x) for x in rng.integers(-2, 3, 6)]) for k in range(150)]
    rows += [(50, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0])] * 3 + [(50, [0.5] * 6), (100, [0.0] * 6), (7, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, embedding array<double>, block string, row int, length double").repartition(5)
    expected = plain_top(rows, 10)
    assert Counter(tuple(r) for r in top_products.top_products(table, every=10).collect()) == expected
    for name, value in (("STRIPE", 20), ("QUERIES", 3), ("STEP", 4), ("TURNS", 2)):
        monkeypatch.setattr(top_products, name, value)
    assert Counter(tuple(r) for r in top_products.top_products(table, every=10).collect()) == expected


# --- 9: mixing ---------------------------------------------------------------------------------------------------------


def test_targets_by_resharing(spark):
    rng = random.Random(7)
    for _ in range(3):
        sizes = {f"s{k}": rng.choice([0, 1, 5, 100, 10_000]) for k in range(7)} | {None: 50}
        names = sorted(k for k in sizes if k is not None) + [None]
        weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
        target, total = dict.fromkeys(names, 0.0), float(sum(sizes.values()))
        while total > 1e-9:
            free = [n for n in names if target[n] < 3 * sizes[n]]
            share = total / sum(weight[n] for n in free)
            total = 0.0
            for n in free:
                target[n] += share * weight[n]
                if target[n] > 3 * sizes[n]:
                    total += target[n] - 3 * sizes[n]
                    target[n] = 3.0 * sizes[n]
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert all(got[n] == pytest.approx(target[n], abs=1e-6) for n in names)


def test_mixing(spark):
    docs, rows = odd_documents(spark)
    got = mixing.copies(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t in rows)
    assert all(0 <= r.copies <= 3 for r in got) and Counter(got) == Counter(mixing.copies(docs).collect())
    mixed = mixing.mix(docs)
    assert mixed.schema == docs.schema and mixed.count() == sum(r.copies for r in got)
    assert mixing.copies(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    """Null, repeated and tied ids: the same mix from any order of the rows, and with any number of digits."""
    rng = random.Random(13)
    rows = [(None if k % 3 == 0 else k % 5, " ".join(["w"] * (16 + k % 4)) + f" {k % 6}", None if k % 7 == 0 else "en", rng.choice([None, "a", "b"])) for k in range(120)]
    rows += [(8, "same words here", lang, "a") for lang in ("en", "de", None, "en", "fr")] + [(None, None, "x", "b"), (None, "", "y", "b")]
    mixes, places = [], []
    for k in range(4):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(k + 1)
        places.append(Counter(tuple(r) for r in mixing.copies(docs, digits=k + 1).collect()))
        mixes.append(Counter(tuple(r) for r in mixing.mix(docs).collect()))
    assert all(m == mixes[0] for m in mixes) and all(p == places[0] for p in places)


def test_mix_carries_any_columns(spark):
    docs, _ = odd_documents(spark)
    docs = docs.withColumns({"_key": F.lit("k"), "_tie": F.lit(1), "_at": F.lit(None).cast("string"), "n": F.lit(1), "s": F.lit("s"), "before": F.lit(2), "target": F.lit(0.5), "m": F.create_map(F.lit("a"), F.lit(1)), "dot.ted": F.lit(1)})
    assert mixing.mix(docs).schema == docs.schema and mixing.mix(docs).count() == mixing.mix(docs.select("doc_id", "text", "source")).count()


def test_mix_comes_near_targets(spark):
    rows = mixing.op9_mixing(spark, "/root/testdata/sf0.1").groupBy(F.col("source_size"), F.col("target")).agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 0.05 * r.target + 20_000 for r in rows)


# --- 10: HTML ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>just text", "just text"),
        ("plain &lt; &#233; text", "plain < é text"),
        ("<nav>menu</nav><footer>x</footer>", ""),
        ("<![foo[ bar", "<![foo[ bar"),
        ("<body><nav><ul><li>a</ul><article><p class=ad>buy<p>Text  one.<br>more</p><p>b</p><section class='comments'><p>c</p></section></article></body>", "Text one. more\n\nb"),
        ("<body><header>top</header><div class='cookie-notice'>We use</div><div id=content><h2>Hi &amp; <i>you</i></h2><p>Long text here with many words in one line, really long text.<p>ok<form>name</form><aside>s</aside></div><footer>x</footer>", "Hi & you\n\nLong text here with many words in one line, really long text.\n\nok"),
        ("<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><article><header><h1>H</h1></header><p>Body text that is long enough.</p><div class='advert'>buy</div><p>s</p></article></body></html>", "H\n\nBody text that is long enough.\n\ns"),
        ("<body class='has-sidebar'><div class='content-with-sidebar'><div class='mainMenu'>menu</div><p>The text of this page is here.</p><p>b</p></div><div id='sidebar'>side</div></body>", "The text of this page is here.\n\nb"),
        ("<main><div class='article-header'><h1>T</h1></div><p>Enough text for a line of content.</p><div class='comments-container'><div class='comment'>no</div></div></main>", "T\n\nEnough text for a line of content."),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


LONG = "A sentence with enough words in it to be the content of a page. " * 5


@pytest.mark.parametrize(
    "inner",
    [
        "<h2 id='related-work'>Related work</h2>",
        "<h2 class='reviews'>Reviews</h2>",
        "<section id='discussion'><h3>Discussion</h3><p>We discuss what was found in the trial.</p></section>",
        "<section id='side-effects'><ul><li>Nausea</li><li>Fever</li></ul></section>",
        "<div itemprop='reviewBody'><p>The book reads well from start to end.</p></div>",
        "<div class='notice'><p>Read this before the first use of the device.</p></div>",
        "<pre>x = 1 <span class='comment'># one</span></pre>",
    ],
)
def test_names_drop_no_article_text(inner):
    plain = html.main_text(f"<article><p>{LONG}</p>{re.sub(r' (id|class|itemprop)=.*?>', '>', inner)}<p>{LONG}</p></article>")
    assert plain.count("\n\n") >= 2 and html.main_text(f"<article><p>{LONG}</p>{inner}<p>{LONG}</p></article>") == plain


def test_names_drop_boilerplate():
    assert html.main_text(f"<body><article class='post category-reviews tag-discussion'><p>{LONG}</p></article></body>") == LONG.strip()
    links = "<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>"
    for named in ("<div class='post-comments'><p>I agree with all that has been said here.</p></div>", f"<div id='related-posts'>{links}</div>", f"<div class='share'>{links}</div>", "<article class='comment'><p>I agree with all that has been said here.</p></article>"):
        assert html.main_text(f"<body><article><p>{LONG}</p>{named}</article></body>") == LONG.strip()


@pytest.mark.parametrize("page", ["<div id=content><section><p>{}</p></section><section><p>{}</p></section></div>", "<body><p>{}</p><div><p>{}</p></div></body>", "<body><div><p>{}</p></div><p>{}</p></body>"])
@pytest.mark.parametrize("sizes", [(7, 3), (3, 7), (9, 1)])
def test_regions_with_little_of_the_content(page, sizes):
    parts = [" ".join(["Sentences of some seventy characters make up the paragraphs of pages."] * k) for k in sizes]
    assert html.main_text(page.format(*parts)) == "\n\n".join(parts)


def test_main_around_articles():
    links = "<div><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li><li><a href=c>Three</a></li></ul></div>"
    short = [f"{k}:0" for k in range(6)]
    page = f"<main><h1>Title</h1><p class=lead>{LONG}</p><article><p>{LONG}</p></article><article>{''.join(f'<p>{x}</p>' for x in short)}</article>{links}</main>"
    assert html.main_text(page) == "\n\n".join(["Title", LONG.strip(), LONG.strip(), *short])


def test_short_articles_between_long_ones():
    short = [f"<article><h2>Goal</h2><p>{k}:0</p><p>{k}'</p></article>" for k in range(5)]
    page = f"<body><article><p>{LONG}</p></article>{''.join(short)}<article><p>{LONG}</p></article></body>"
    assert html.main_text(page) == "\n\n".join([LONG.strip(), *(x for k in range(5) for x in ("Goal", f"{k}:0", f"{k}'")), LONG.strip()])


def test_content_outside_of_articles():
    body = f"<div id=content><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
    teaser = "<div>" + "<p><a href=a>More</a></p>" * 4 + "<article><a href=b>Next</a></article></div>"
    assert html.main_text(f"<body>{body}{teaser}</body>").count(LONG.strip()) == 3


def plain_main(divs):
    """The method on pages of divs of lines (text, whether it is a link), by the formulas: the ratio of each line, the
    Gaussian mean of its neighbours, the cut, the div or the run of lines that holds all content, and no lists of links."""
    lines = [(k, text, 3 if link else 1, link) for k, div in enumerate(divs) for text, link in div]
    ratio = [len(text) / tags for _, text, tags, _ in lines]
    flat = []
    for i in range(len(lines)):
        near = [j for j in range(len(lines)) if abs(i - j) <= 3]
        weights = [math.exp(-((i - j) ** 2) / 2) for j in near]
        flat.append(sum(w * ratio[j] for w, j in zip(weights, near)) / sum(weights))
    mean = sum(flat) / len(flat)
    cut = max(0.5 * math.sqrt(sum((v - mean) ** 2 for v in flat) / len(flat)), 0.25 * mean)
    good = [i for i, v in enumerate(flat) if v >= cut]
    holding = {lines[i][0] for i in good}
    kept = [i for i, x in enumerate(lines) if x[0] in holding] if len(holding) == 1 else range(good[0], good[-1] + 1)

    def links(k):
        own = [x for x in lines if x[0] == k]
        size = sum(len(x[1]) for x in own)
        return max(len(x[1]) / x[2] for x in own) < cut and size < 20 * sum(x[2] for x in own) and 3 * sum(len(x[1]) for x in own if x[3]) >= 2 * size

    return "\n\n".join(lines[i][1] for i in kept if not links(lines[i][0]))


def test_pages_without_articles_against_the_formulas(monkeypatch):
    rng = random.Random(21)

    def line(low, high):
        return " ".join("w" * rng.randint(2, 9) for _ in range(rng.randint(low, high)))

    pages = []
    for _ in range(200):
        divs = [[(line(1, 2), True) for _ in range(rng.randint(3, 9))]]
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["text", "text", "menu", "short"])
            divs.append([(line(1, 3), True) if kind == "menu" else (line(1, 4) if kind == "short" else line(2, 60), False) for _ in range(rng.randint(1, 8))])
        pages.append(divs)
    html_of = ["".join("<div>" + "".join(f"<p><a href=x>{x}</a></p>" if link else f"<p>{x}</p>" for x, link in div) + "</div>" for div in divs) for divs in pages]
    got = [html.main_text(f"<body>{p}</body>") for p in html_of]
    assert got == [plain_main(d) for d in pages]
    monkeypatch.setattr(html, "smoothed", lambda values, sigma=1.0: [1.0] * len(values))  # the ratio decides
    assert sum(html.main_text(f"<body>{p}</body>") != x for p, x in zip(html_of, got)) > 150


def test_lists_of_links_in_articles(monkeypatch):
    """Inside an article, too, the ratio decides on a region of links; lists of text and links in text stay."""
    links = "<ul>" + "".join(f"<li><a href=/{k}>Story {k}</a></li>" for k in range(6)) + "</ul>"
    short = "<ul><li>Nausea</li><li>Fever</li></ul>"
    page = f"<article><p>{LONG}</p>{short}<p>{LONG} <a href=x>see</a></p><p><a href=y>One more link</a></p><div>{links}</div><p>{LONG}</p></article>"
    kept = "\n\n".join([LONG.strip(), "Nausea", "Fever", f"{LONG.strip()} see", "One more link", LONG.strip()])
    assert html.main_text(page) == kept
    monkeypatch.setattr(html, "smoothed", lambda values, sigma=1.0: [1.0] * len(values))
    assert html.main_text(page) != kept


@pytest.mark.parametrize("inner", ["<div class='review-body'><p>The book reads well from start to end, and more.</p></div>", "<div class='search-results alert'><p>Doctors warn of the new strain in the north.</p></div>"])
def test_named_paragraphs_stay(inner):
    """In an article; outside of one an element that is named alert and nothing else is a notice."""
    for page in (f"<article><p>{LONG}</p>{inner}</article>", f"<body><div><p>{LONG}</p>{inner.replace(' alert', '')}<p>{LONG}</p></div></body>"):
        assert re.sub("<[^>]+>", "", inner) in html.main_text(page)


@pytest.mark.parametrize("page", ["<div>x" * 8000, "<section>" * 20_000 + "x" + "</section>" * 20_000, "<ul><li>" * 5000 + "</b></div>" * 5000, "<article>y" * 4000, "<p>" * 20_000 + "z", "<div class=menu>" * 5000 + "q"])
def test_deep_pages_take_time_by_length(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 2


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b</p>", "t"), (1, None, None, "t"), (None, "v", "<p>é", "t")], "page_id long, url string, html string, text string")
    assert Counter(tuple(r) for r in html.extract(pages).collect()) == Counter([(1, "u", "a b", 3), (1, None, "", 0), (None, "v", "é", 1)])
    assert html.extract(empty(spark, "page_id long, url string, html string")).count() == 0
    assert len(html.main_text("<p>" + "word " * 200_000)) == 999_999


def test_articles_of_test_pages(spark):
    import html as references

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(references.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert html.main_text(r.html) == "\n\n".join(p for p in parts if p)


# --- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_against_its_stages(spark, reference_coder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near duplicates", "mixing", "tokens"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.schema == docs.schema and kept.count() <= before.count()
    ids = {r.doc_id for r in kept.collect()}
    groups = brute_components([(r.doc_id, r.text) for r in kept.collect()])
    assert len({g for _, _, g in groups}) == len(ids)  # no near duplicates are left
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= ids
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())
    assert all(r.n_tokens == len(reference_coder.encode_ordinary(texts[r.doc_id])) for r in out)


def test_stages_on_odd_rows(spark, reference_coder):
    """Null, empty, blank, very long and repeated texts, null and repeated ids, clashing columns, and an empty table."""
    import corpus_pipeline

    docs, rows = odd_documents(spark)
    docs = docs.withColumns({"_all": F.lit(1), "_gone": F.lit("g"), "component_id": F.lit(2), "size": F.lit(None).cast("string"), "predicted": F.lit(0.5), "node": F.lit(True), "_tie": F.lit(3)})
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, SF)
    letters = Counter(i for i, t in rows if t and any(c.isalpha() for c in t))
    assert known.schema == docs.schema and Counter(r.doc_id for r in known.collect()) == letters
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.schema == docs.schema and Counter(r.doc_id for r in clean.collect()) <= Counter(i for i, _ in rows)
    single = stages["near duplicates"](spark, docs, SF)
    least = {i: c for i, _, c in brute_components(rows).elements()}
    assert single.schema == docs.schema
    assert Counter(r.doc_id for r in single.collect()) == Counter({i for i in least if i is not None and least[i] == i}) + Counter(i for i, _ in rows if i is None)
    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.schema == docs.schema and {r.doc_id for r in mixed.collect()} <= {i for i, _ in rows}
    coded = stages["tokens"](spark, docs, SF).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in coded) == Counter((i, len(reference_coder.encode_ordinary(t or ""))) for i, t in rows)
    none = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "tokens" or out.schema == docs.schema)


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from lexforge import session
    from lexforge.llm import textops

    class Context:
        master = "spark://host:7077"

    class Cluster:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    for folder in (textops.shared_dir, session.shared_folder):
        with pytest.raises(RuntimeError, match="checkpoint"):
            folder(Cluster())
