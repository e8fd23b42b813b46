from __future__ import annotations

import random
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexforge.functions.lexicons import CATEGORIES
from lexforge.functions.patterns import TOKEN_ORDER
from lexforge.operators import generation, ngram_stats, relational, routing, semantic, social
from lexforge.plans import pipelines
from lexforge.sources import io


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the tests


def ids(rows, col="idx"):
    return sorted(r[col] for r in rows.collect())


def test_keywords(spark):
    rows = spark.createDataFrame([(1, "Shelters are full"), (2, "the housing crisis"), (3, "a shelter, a TENT"), (4, "éshelter"), (5, None)], "idx int, text string")
    hits = rows.select("idx", relational.keyword_hits("text", ["shelter", "housing", "housing crisis", "tent"]).alias("n")).collect()
    assert [r.n for r in hits] == [0, 1, 2, 0, 0]
    assert ids(relational.keyword_filter(rows, ["shelter", "housing", "tent"])) == [2, 3]
    assert ids(relational.keyword_filter(rows, ["shelter", "tent"], least=2)) == [3]


def test_known_and_processed(spark):
    rows = spark.createDataFrame([(1, " A b\n"), (2, "c")], "idx int, text string")
    assert ids(relational.without_known(rows, spark.createDataFrame([("a B",)], "text string"))) == [2]
    state = spark.createDataFrame([("k_2",)], "key string")
    assert ids(relational.without_processed(rows, state, F.concat(F.lit("k_"), F.col("idx")))) == [1]


def test_token_sets(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "c b a a"), (3, "a b")], "idx long, text string")
    assert ids(relational.token_set_dedup(rows, order="idx")) == [1, 3]
    assert ids(relational.fuzzy_dedup(rows, 1.0, order="idx")) == [1, 3]


def test_keep_first_is_greedy(spark):
    nodes = spark.createDataFrame([(k,) for k in range(6)], "idx long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (4, 5), (3, 5)], "earlier long, later long")
    assert ids(relational.keep_first_independent(nodes, edges)) == [0, 2, 3]
    rng = random.Random(1)
    pairs = sorted({(a, b) for a, b in ((rng.randint(0, 40), rng.randint(0, 40)) for _ in range(90)) if a < b})
    kept: list[int] = []
    for k in range(41):
        if not any((j, k) in pairs for j in kept):
            kept.append(k)
    got = relational.keep_first_independent(spark.createDataFrame([(k,) for k in range(41)], "idx long"), spark.createDataFrame(pairs, "earlier long, later long"))
    assert ids(got) == kept


def test_keep_first_never_stops_short(spark):
    nodes = spark.createDataFrame([(k,) for k in range(7)], "idx long")
    chain = spark.createDataFrame([(k, k + 1) for k in range(6)], "earlier long, later long")
    with pytest.raises(RuntimeError, match="settle"):
        relational.keep_first_independent(nodes, chain, rounds=2)
    assert ids(relational.keep_first_independent(nodes, chain)) == [0, 2, 4, 6]


def test_fuzzy_dedup(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-2], "zz", "yy"])), (3, " ".join(rng.choice(words) for _ in range(100))), (4, " ".join(reversed(base)))]
    assert ids(relational.fuzzy_dedup(spark.createDataFrame(rows, "idx long, text string"), 0.8, order="idx")) == [1, 3]


def test_ratio_dedup(spark):
    rows = spark.createDataFrame([(1, "the quick brown fox"), (2, "the quick brown foxes"), (3, "a very different text"), (4, "The Quick Brown Fox")], "idx long, text string")
    assert ids(relational.ratio_dedup(rows, order="idx")) == [1, 3]


def test_samples(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"), F.when(F.col("id") % 4 < 2, "x").otherwise("y").alias("source"))
    taken = relational.balanced_sample(rows, label="label", per_class=300, weight=F.when(F.col("source") == "x", 2.0).otherwise(1.0))
    counts = {(r.label, r.source): r["count"] for r in taken.groupBy("label", "source").count().collect()}
    assert counts[0, "x"] + counts[0, "y"] == counts[1, "x"] + counts[1, "y"] == 300
    assert all(1.4 < counts[k, "x"] / counts[k, "y"] < 2.8 for k in (0, 1))
    shots = relational.few_shot(rows.withColumn("s", F.concat(F.lit("L"), "label")), label="s", labels=["l0", "l1"], n=3).collect()
    assert len(shots) == 3 and {"L0", "L1"} <= {r.s for r in shots}


def test_distribution_and_gate(spark):
    rows = spark.createDataFrame([("HATE", CATEGORIES[0], "x"), ("hate", CATEGORIES[0], "x"), ("HATE", "odd", "x"), ("HATE", CATEGORIES[1], " ")], "stance string, aspect_category string, opinion_span string")
    assert relational.quality_gate(rows, ["stance", "aspect_category", "opinion_span"]).count() == 1
    counts = relational.gate_counts(rows, ["stance", "aspect_category", "opinion_span"]).first()
    assert tuple(counts) == (4, 3, 2, 1)
    shares = {(r.dimension, r.value): (r.n, r.percent) for r in relational.distribution(rows, ["stance", "opinion_span"]).collect()}
    assert shares["stance", "HATE"] == (3, 75.0) and shares["opinion_span", " "] == (1, 25.0)


def test_running_total(spark):
    """Dense and sparse orders, text as an order, labels, null labels, and columns whose names clash."""
    rng = random.Random(5)
    for order in (list(range(1000)), sorted({rng.randrange(-(2**62), 2**62) for _ in range(1000)})):
        rows = [(o, o % 7, rng.choice(["a", "b", None]), "x") for o in order]
        table = spark.createDataFrame(rows, "o long, v long, l string, _span string").repartition(7)
        got = {r.o: (r.t, r._span) for r in relational.running_total(table, F.col("v"), "o", "t").collect()}
        by = {r.o: r.t for r in relational.running_total(table, F.col("v"), "o", "t", by="l").collect()}
        counts = {r.o: r.so_far for r in routing.running_counts(table, "l", "o").collect()}
        total, each, many = 0, Counter(), Counter()
        for o, v, label, _ in rows:
            total += v
            each[label] += v
            many[label] += 1
            assert got[o] == (total, "x") and by[o] == each[label] and counts[o] == many[label]
    words = spark.createDataFrame([(w,) for w in "delta alpha charlie bravo".split()], "w string")
    assert {r.w: r.t for r in relational.running_total(words, F.lit(1), "w", "t").collect()} == {"alpha": 1, "bravo": 2, "charlie": 3, "delta": 4}


def test_names_of_the_caller_stay(spark):
    """Operators make no column that the caller's rows have already, and drop none of theirs."""
    names = "_k _first _key _done _known _kept _score _rank _u _late _taken _p _m _lo _c _q _before".split()
    rows = spark.createDataFrame([(k, f"text {k % 3}", "ab"[k % 2], *[k] * len(names)) for k in range(12)], "doc_id long, text string, label string, " + ", ".join(f"{n} long" for n in names))
    for made in (
        relational.exact_dedup(rows), relational.token_set_dedup(rows), relational.fuzzy_dedup(rows, 0.8), relational.without_known(rows, rows.filter("doc_id = 1")), relational.ratio_dedup(rows, order="doc_id", least=99.0),
        relational.without_processed(rows, rows.limit(0).select(F.col("text").alias("key")), F.col("text")), relational.balanced_sample(rows, label="label", per_class=3, weight=F.lit(1.0)), relational.few_shot(rows, label="label", labels=["a", "b"]),
    ):
        assert made.columns == rows.columns and made.count() > 0
    assert routing.number(rows, ["doc_id"], "n").orderBy("n").select("doc_id", "n", "_p").collect()[5] == (5, 6, 5)


def test_buckets_of_many_near_copies(spark):
    """A group of near copies is one bucket, not all its pairs; text ids keep their order."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    rows = [(f"d{k:04}", " ".join([*base[:58], f"x{k}", "y"])) for k in range(300)] + [(f"e{k:04}", " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(900)) for _ in range(40))) for k in range(40)]
    kept = relational.fuzzy_dedup(spark.createDataFrame(rows, "doc_id string, text string"), 0.8)
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == ["d0000", *(f"e{k:04}" for k in range(40))]


def test_buckets_against_a_pass_in_order(spark):
    rng = random.Random(7)
    for _ in range(3):
        rows = [(k, rng.randrange(30)) for k in range(60) for _ in range(rng.randint(1, 3))]
        taken, expected = set(), []
        for k in range(60):
            own = {b for i, b in rows if i == k}
            if not own & taken:
                taken |= own
                expected.append(k)
        assert ids(relational.keep_first_of_buckets(spark.createDataFrame(rows, "idx long, bucket long"))) == expected


def test_signatures_by_hand():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(8)
    a, b = (rng.integers(0, 1 << 63, 9).astype(np.uint64) for _ in range(2))
    sets = [rng.integers(-(2**62), 2**62, k).tolist() for k in (3, 0, 1, 50, 25_000, 2)]
    got = relational.signatures(pa.array([[], *sets], pa.list_(pa.int64())).slice(1), a, b)
    for row, s in zip(got, sets, strict=True):
        assert row.tolist() == [min((((x % 2**64) * int(p) + int(q)) % 2**64 >> 31 for x in s), default=2**64 - 1) for p, q in zip(a, b, strict=True)]


def test_ratio_dedup_needs_a_block(spark, monkeypatch):
    monkeypatch.setattr(relational, "UNBLOCKED", 3)
    rows = spark.createDataFrame([(k, f"the quick brown fox number {k}") for k in range(5)], "idx long, text string")
    with pytest.raises(ValueError, match="block"):
        relational.ratio_dedup(rows, order="idx")
    assert ids(relational.ratio_dedup(rows, order="idx", block=F.col("idx") % 2)) == [0, 1]


def folded(rows, quotas, budget):
    """Plain processing in order."""
    count, seen, spent, number, out = dict.fromkeys(quotas, 0), set(), 0.0, 1, []
    for o, status, label, key, cost in rows:
        if all(count[n] >= q for n, q in quotas.items()) or spent >= budget:
            break
        spent += cost
        if status in ("accepted", "repaired"):
            if label in quotas and count[label] < quotas[label] and key not in seen:
                seen.add(key)
                count[label] += 1
                out.append((o, number))
                number += 1
        elif status == "review":
            out.append((o, number))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_quota_route(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["accepted", "repaired", "review", "failed", "filtered"]), rng.choice("abcx"), rng.choice("klmnopqrstuv"), rng.choice([0.0, 1.0, 2.0])) for k in range(150)]
    quotas, budget = {"a": 2, "b": 3, "c": rng.choice([1, 9])}, rng.choice([40.0, 1000.0])
    table = spark.createDataFrame(rows, "o long, status string, label string, k string, cost double")
    got = routing.quota_route(table, order="o", status="status", label="label", key="k", cost="cost", quotas=quotas, budget=budget)
    assert sorted((r.o, r.sample_id) for r in got.collect()) == folded(rows, quotas, budget)


def test_status(spark):
    rows = spark.createDataFrame([(1, 1, False, False), (2, 1, False, False), (1, 1, True, False)], "a int, b int, c boolean, d boolean")
    assert [r[0] for r in rows.select(routing.status_of("a", "b", "c", "d")).collect()] == ["accepted", "repaired", "repaired"]


def result(k, stance="HATE", target="t", text="text"):
    return (k, text, target, CATEGORIES[0], "o", stance, "e", "accepted", "x")


RESULT = "sample_id int, cleaned_text string, aspect_target string, aspect_category string, opinion_span string, stance string, explanation string, status string, errors string"


def test_review(spark):
    queue = spark.createDataFrame([result(k) for k in range(1, 7)], RESULT)
    decisions = spark.createDataFrame([(1, "a", None), (2, "e", "NEUTRAL"), (3, "r", None), (4, "s", None), (5, "q", None), (6, "a", None)], "sample_id int, action string, stance string")
    got = {r.sample_id: (r.status, r.stance, r.errors) for r in routing.review(queue, decisions).collect()}
    assert got == {1: ("reviewed_accepted", "HATE", ""), 2: ("reviewed_edited", "NEUTRAL", "")}


def test_merge(spark):
    parts = [spark.createDataFrame(rows, RESULT) for rows in ([result(5, text="b b b"), result(2, text="a a a")], [result(1, stance="hate")], [result(9, target=" "), result(7, text="c c c")])]
    assert [tuple(r)[:2] for r in routing.merge(parts).orderBy("sample_id").collect()] == [(1, "a a a"), (2, "b b b"), (3, "c c c")]
    assert routing.merge([p.filter("false") for p in parts]).count() == 0
    assert {r.value: r.n for r in routing.summary(routing.merge(parts)).filter("dimension = 'stance'").collect()} == {"HATE": 3}


def test_ngrams(spark, tmp_path):
    rows = spark.createDataFrame([("a b a\n#no @no https://x.yz/q b",)], "text string")
    counts = ngram_stats.count_ngrams(rows, most=3)
    got = {(r.n, r.gram): r.cnt for r in counts.collect()}
    assert got[1, "a"] == 2 and got[2, "<S>_a"] == 1 and got[3, "<S>_<S>_a"] == 1 and got[2, "a_b"] == 1 and (1, "no") not in got
    io.write_ngrams(counts, str(tmp_path / "s"))
    assert {(r.n, r.gram): r.cnt for r in io.read_ngrams(spark, str(tmp_path / "s")).collect()} == got
    assert ngram_stats.frequent_ngrams(counts, {1: 2, 2: 2}).filter("n < 3").count() == 2
    assert sum(r.p for r in ngram_stats.probabilities(counts).collect()) == pytest.approx(1)


STATS = social.Statistics({"small": 50, "and": 100, "insignificant": 5, "correct": 9, "good": 30, "god": 5, "cool": 10, "the": 90}, {"small_and": 20})


def test_segment_and_spell():
    assert STATS.segment("smallandinsignificant") == "small and insignificant"
    assert STATS.segment("camelCased") == "camel cased"
    assert STATS.correct("korrect") == "correct" and STATS.correct("zzzzzz") == "zzzzzz"
    assert STATS.correct_cased("KORRECT") == "CORRECT" and STATS.correct_text("The korrect Thhe") == "The correct The"
    assert STATS.shorten("coool") == "cool" and STATS.shorten("GOOD") == "GOOD"


def test_tokenizer(spark):
    text = "So #cool! :) call 555-123-4567 a@b.co U.S.A. $5 10% *wow* f**k <3 @me &amp; 5pm"
    tokens = social.tokenize(text)
    for t in ("#cool", ":)", "555-123-4567", "a@b.co", "U.S.A.", "$5", "10%", "*wow*", "f**k", "<3", "@me", "&", "5pm"):
        assert t in tokens
    assert "#" in social.tokenize(text, terms=social.terms_for(hashtags=False)) and len(TOKEN_ORDER) == 21
    rows = spark.createDataFrame([(text,), (None,)], "x string").select(social.tokens("x").alias("t")).collect()
    assert rows[0].t == tokens and rows[1].t is None


def test_preprocessor(spark):
    steps = social.Preprocessor(normalize=("url", "user"), annotate=frozenset(["hashtag", "allcaps", "elongated", "repeated", "emphasis", "censored"]), statistics=STATS, unpack_hashtags=True, unpack_contractions=True, dictionaries=({":)": "<happy>"},))
    out = " ".join(steps("@me I'm sooo HAPPY TODAY!!! #smallandinsignificant #CoolOne *very* f**k :) see www.a.bc"))
    assert out == "<user> I am soo <elongated> <allcaps> HAPPY TODAY </allcaps> ! <repeated> <hashtag> small and insignificant </hashtag> <hashtag> Cool One </hashtag> very <emphasis> f**k <censored> <happy> see <url>"
    bare = social.Preprocessor(normalize=("url",), remove_tags=True)
    assert bare("a www.b.cd <3 c") == ["a", "c"]
    got = spark.createDataFrame([("a www.b.cd",), (None,)], "x string").select(bare.udf()(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == ["a", None]
    assert social.without_caps_in_hashtags(["<hashtag>", "<allcaps>", "A", "</allcaps>", "</hashtag>", "<allcaps>"]) == ["<hashtag>", "A", "</hashtag>", "<allcaps>"]


def test_negation_and_polarity(spark):
    assert social.negated("i do not like this . but fine".split()) == [3, 4]
    assert social.negated(["never", "(", "a", ")", "b"]) == [4]
    assert social.negated(["not", "a", ",", "b", ".", "c"], commas=False) == [1, 2, 3, 4, 5]
    assert social.negated(["not", "a"], modals=False) == []
    lexicon = spark.createDataFrame([("good", 0.8, 0.1, 0.1), ("bad", 0.0, 0.9, 0.1)], "word string, pos double, neg double, obj double")
    rows = spark.createDataFrame([(1, ["good", "bad"]), (2, ["not", "good"])], "doc_id int, words array<string>")
    got = {r.doc_id: round(r.polarity, 6) for r in social.polarity(rows, lexicon).collect()}
    assert got == {1: -0.1, 2: -0.7}


def test_emotions(spark):
    long = spark.createDataFrame([("joyful", "joy", 1.0), ("joyful", "positive", 1.0), ("grim", "fear", 1.0), ("grim", "negative", 1.0)], "word string, emotion string, score double")
    got = {r.word: (r.polarity, list(r.emotions)) for r in social.emotion_lexicon(long).collect()}
    assert got == {"joyful": (1, [0, 0, 0, 0, 0, 0, 1, 0]), "grim": (-1, [1, 0, 0, 0, 0, 0, 0, 0])}
    rows = spark.createDataFrame([(1, ["grim", "x"])], "doc_id int, words array<string>")
    assert [r.word for r in social.emotions(rows, social.emotion_lexicon(long)).collect()] == ["grim"]
    words = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "w string")
    assert sorted(str(r.f) for r in social.map_words(words, "w", "f", str.upper).collect()) == ["A", "A", "B", "None"]


def test_semantic(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.2])], "idx int, embedding array<float>")
    assert ids(semantic.semantic_filter(rows, [[1.0, 0.1]], least=0.35)) == [1]
    assert semantic.semantic_filter(rows, None).count() == 3
    assert [round(r[0], 3) for r in rows.select(semantic.cosine_to("embedding", [1.0, 0.0])).collect()] == [1.0, 0.0, -0.981]


class Stubborn:
    """Answers badly until asked to repair."""

    def complete(self, messages):
        if "Answer so far" in messages[-1]["content"]:
            return generation.RuleBackend().complete(messages)
        return generation.Reply('{"aspect_target": "nowhere at all", "aspect_category": "none such", "opinion_span": "zzzzz"}', 10, 5)


class Broken:
    def complete(self, messages):
        raise RuntimeError("no")


def test_generation(spark):
    rows = spark.createDataFrame([(1, "The city shelter needs support and more housing for people"), (2, "tiny"), (3, "Public safety downtown is ruining everything here")], "row_idx long, text string")
    done = {r.row_idx: r for r in generation.process(rows, generation.RuleBackend()).collect()}
    assert done[1].status == "accepted" and done[1].stance == "HOPEFUL" and done[2].status == "filtered" and float(done[1].cost_usd) > 0
    again = {r.row_idx: r for r in generation.process(rows, Stubborn(), repairer=Stubborn()).collect()}
    assert again[1].s1_attempts == 2
    dead = {r.row_idx: r for r in generation.process(rows, Broken()).collect()}
    assert dead[1].status == "failed" and dead[1].errors == "Stage 1 generation returned None" and float(dead[1].cost_usd) == 0
    predicted = generation.predict(rows.select("text"), generation.RuleBackend()).collect()
    assert len(predicted) == 3 and all(r.error is None and r.stance for r in predicted)
    assert {r.error for r in generation.predict(rows, Broken()).collect()} == {"stage1 failed"}


def test_http_backend(spark):
    """Stages through a service: its answers, its token counts, and its failures."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            post = asked["messages"][-1]["content"]
            if "broken" in post or self.headers["X-Caller"] != "tests":
                self.send_error(500)
                return
            said = {"choices": [{"message": {"content": generation.RuleBackend().complete(asked["messages"]).text}}], "usage": {"prompt_tokens": 1000, "completion_tokens": 500}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    backend = generation.HttpBackend(f"http://127.0.0.1:{server.server_port}/", "any", (("X-Caller", "tests"),), seconds=5.0)
    rows = spark.createDataFrame([(1, "The city shelter needs support and more housing"), (2, "This line is broken and nobody answers it")], "row_idx long, text string")
    got = {r.row_idx: r for r in generation.process(rows, backend).collect()}
    server.shutdown()
    assert got[1].status == "accepted" and got[1].cost_usd == "0.002400" and got[2].status == "failed"


def test_fetching(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "url string")
    got = {r.url: r.html for r in io.fetched(keys, "url", "html", {"a": "<p>x"}.__getitem__).collect()}
    assert got == {"a": "<p>x", "b": None}
    assert {r.html for r in io.fetched(keys.filter("url = 'b'"), "url", "html").collect()} == {None}


def test_settings():
    from lexforge.plans.pipelines import settings

    assert settings([]).quotas == {"HATE": 1000, "NEUTRAL": 1000, "HOPEFUL": 1000} and settings(["--budget", "2.5", "--samples-per-class", "3"]).budget == 2.5
    with pytest.raises(SystemExit):
        settings(["--log-level", "LOUD"])


def test_prompts(spark):
    rows = spark.createDataFrame([("a post", "t", "c")], "text string, aspect_target string, aspect_category string")
    asked = rows.select(generation.prompt("text", stage=2, shots=[{"text": "s", "stance": "HATE", "explanation": "e"}], given={"aspect_target": "aspect_target"}).alias("m")).first().m
    assert [m.role for m in asked] == ["system", "user", "assistant", "user"] and '"stance": "HATE"' in asked[2].content and '  "aspect_target": "t"' in asked[3].content
    assert generation.inventory(["a"], {"a": "x"}) == "1. a: x" and generation.inventory(["a"], {"a": "x"}, numbered=False) == "   - a: x"
    costs = spark.createDataFrame([("s1", 1000, 500), ("s2", 100, 0)], "stage string, tokens_in long, tokens_out long")
    assert {r.stage: round(r.cost_usd, 6) for r in generation.cost_summary(costs).collect()} == {"s1": 0.0012, "s2": 0.00004, None: 0.00124}


def test_links_and_mentions(spark):
    pages = spark.createDataFrame([("https://a.b/c", "<title>T</title><p>short</p><p>" + "long " * 10 + "</p>")], "url string, html string")
    rows = spark.createDataFrame([(1, "housing shelter https://a.b/c end"), (2, "nothing https://a.b/c end"), (3, None)], "row_idx long, text string")
    got = {r.row_idx: r.text for r in io.resolve_links(rows, pages).collect()}
    assert got[1] == f"housing shelter [T {('long ' * 10).strip()}] end" and got[2] == "nothing  end" and got[3] is None
    people = spark.createDataFrame([("me", "Me Myself")], "handle string, name string")
    named = io.resolve_mentions(spark.createDataFrame([(1, "hi @me and @you")], "row_idx long, text string"), people)
    assert named.first().text == "hi Me Myself and @you"


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 'say "x"\nline', None)], "id string, text string, n string")
    path = str(tmp_path / "x.csv")
    rows.write.option("header", True).option("escape", '"').csv(path)
    assert [tuple(r) for r in io.read_csv(spark, path, ["id", "text", "n"]).collect()] == [("a,b", 'say "x"\nline', "")]
    assert io.read_results(spark, str(tmp_path / "none.csv")).columns == routing.RESULT_COLUMNS
    routed = spark.createDataFrame([(1, "accepted"), (2, "failed"), (3, "review")], "k int, status string")
    io.write_routed(routed, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["_route=accepted", "_route=review"]
    made = io.cached(spark, str(tmp_path / "c"), lambda: routed)
    assert made.count() == 3 and io.cached(spark, str(tmp_path / "c"), lambda: 1 / 0).count() == 3
    io.save_state(routed.withColumn("stance", F.lit("HATE")).withColumn("cost_usd", F.lit("0.5")), str(tmp_path / "s"), key=F.col("k").cast("string"), text_key=F.lit("h"))
    state = io.state_summary(io.load_state(spark, str(tmp_path / "s"))).first()
    assert (state.emitted, state.cost) == (1, 1.5)


def test_construct_and_finish(spark):
    posts = ["The city shelter needs support and more housing", "Public safety downtown is ruining everything here", "A report about the park and the budget of it", "Homeless people deserve dignity and support now"]
    rows = spark.createDataFrame([(k, "VAST", str(k), p, ["FAVOR", "AGAINST", "NONE", "FAVOR"][k]) for k, p in enumerate(posts)], "row_idx long, dataset string, id string, text string, stance string")
    pool = pipelines.candidates(rows, rows.filter("row_idx = 2"), pipelines.Selection(per_class=5))
    assert ids(pool, "row_idx") == [0, 1, 3] and {r.mapped_stance for r in pool.collect()} == {"HOPEFUL", "HATE"}
    results = pipelines.construct(pool.drop("stance"), generation.RuleBackend(), quotas={"HATE": 1, "NEUTRAL": 1, "HOPEFUL": 1})
    assert results.columns == routing.RESULT_COLUMNS
    final, shares = pipelines.finish(results.filter("status = 'accepted'"), results.filter("status = 'repaired'"), results.filter("false"))
    assert final.columns == routing.FINAL_COLUMNS and {r.stance for r in final.collect()} <= {"HATE", "HOPEFUL", "NEUTRAL"} and shares.count() >= 2


def test_streams(spark, tmp_path):
    from lexforge.streaming import stateful

    rows = spark.createDataFrame([(1, "a", "k1", "2024-01-01 00:00:00"), (2, "a", "k1", "2024-01-01 00:01:00"), (3, "a", "k2", "2024-01-01 00:02:00"), (4, "b", "k3", "2024-01-01 00:03:00"), (5, "a", "k4", "2024-01-01 00:04:00")], "n int, label string, text string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))

    def run(f, name, mode="append"):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.text for r in run(stateful.unique, "u")) == ["k1", "k2", "k3", "k4"]
    assert {(r.label, r.n) for r in run(lambda s: stateful.windowed_counts(s, "label"), "w", "complete")} == {("a", 4), ("b", 1)}
    assert len(run(lambda s: stateful.first_by_quota(s, label="label", key="text", quotas={"a": 2, "b": 5}), "q")) == 3


def test_queries_are_registered():
    from lexforge import queries

    assert set(queries.SQL) <= set(queries.QUERIES) and len(queries.QUERIES) > 45
