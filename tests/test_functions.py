from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.functions import cleaning, judgment, lexicons, patterns, validation
from lexforge.functions.similarity import best_partial, closest_window, common_length, indel_ratio, plainly_grounded, token_f1
from lexforge.functions.strings import mark, ngrams, squeeze, strip, text_key


def one(spark, make, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in rows.select(make(F.col("x"))).collect()]


def test_strip_key_and_spaces(spark):
    assert one(spark, strip, " a b \n", "", "x") == ["a b", "", "x"]
    a, b = one(spark, text_key, " A b\n", "a B")
    assert a == b
    assert one(spark, squeeze, " a \t b\n") == ["a b"]


def test_empty_or_deleted(spark):
    assert one(spark, cleaning.empty_or_deleted, " [Removed] ", "", "  ", "[removed] x", None) == [True, True, True, False, True]


@pytest.mark.parametrize(
    ("step", "given", "expected"),
    [
        (cleaning.expand_abbreviations, "Idk, govt ppl!", "I do not know government people"),
        (cleaning.squeeze_chars, "sooooo", "soo"),
        (cleaning.squeeze_words, "the The the cat", "the cat"),
        (cleaning.squeeze_punctuation, "wow!?!?", "wow?"),
        (cleaning.unique_sentences, "Go now. go now. Stop.", "Go now. Stop."),
        (cleaning.drop_numbers, "a 12 b3 4", "a  b3 "),
        (cleaning.drop_mentions, "hi @été_1 x", "hi  x"),
        (cleaning.drop_links, "see https://a.b/c?d WWW.x.y now", "see   now"),
        (cleaning.drop_hash_signs, "#one #two", "one two"),
        (cleaning.drop_controls, "a​b\x07c\td\n", "abc\td\n"),
        (cleaning.unescape_html, "a &amp; b &lt;3", "a & b <3"),
        (patterns.expand_contractions, "can't won't I'm y'all he'd", "can not will not I am you all he'd"),
        (patterns.expand_contractions, "They’ve shan't don't Let's", "They have shall not do not Let us"),
        (patterns.sort_punctuation, "!?.!! a? b...", "?.! a? b."),
        (patterns.drop_tagged_words, "a <url> b <3", "a b"),
        (patterns.split_camel, "camelCased", "camel Cased"),
        (patterns.unpack_camel_hashtags, "see #TwinPeaks and #lower", "see Twin Peaks and #lower"),
        (lambda c: patterns.tag_entities(c, ("email", "user")), "x a@b.com @me", "x  <email>   <user> "),
        (lambda c: patterns.annotate_caps(c, "single"), "so HUGE it", "so  HUGE <allcaps>  it"),
    ],
)
def test_steps(spark, step, given, expected):
    assert one(spark, step, given) == [expected]


def test_clean_text(spark):
    out = one(spark, cleaning.clean_text, "Idk what &amp; why!!! @you http://a.b/c is here here now 12", "short", None, "[deleted]")
    assert out == ["I do not know what & why! is here now", None, None, None]
    rows = spark.createDataFrame([(1, "a text that is long enough"), (2, "short"), (3, None)], "k int, text string")
    assert [tuple(r) for r in cleaning.cleaned_rows(rows).collect()] == [(1, "a text that is long enough", "a text that is long enough")]


@pytest.mark.parametrize("name", [n for n in patterns.PATTERNS if n not in ("emoji", "ltr_face", "rtl_face", "eastern_emoticons")])
def test_patterns_agree_with_python(spark, name):
    texts = ["call 555-123-4567 or mail a.b@c.org at 5pm, 10:30 am", "Paid $5.50 or 10% on Jan 3rd, 2020 and 12/12/2012", "#TagOne @user U.S.A. f**k *so* sooooo HEY YOU", "see https://x.y/z www.a.bc $ABC <tag> wow!!?", 'say "hello there" été naïve <3 ^5']
    mine = one(spark, lambda c: patterns.entities(c, name), *texts)
    assert mine == [[m[0] for m in re.finditer(patterns.PATTERNS[name], t)] for t in texts]


def test_emoticons():
    faces = lexicons.emoticons()
    assert faces[":)"] == "<happy>" and faces["(:"] == "<happy>" and faces[":(((((((("] == "<sad>"
    assert faces["):"] == "<sad>" and faces[":-d"] == "<laugh>"


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcd é", max_size=25), st.text("abcd é", max_size=25))
@settings(max_examples=150, deadline=None)
def test_common_length(a, b):
    assert common_length(a, b) == lcs(a, b)


@given(st.text("ab c", min_size=1, max_size=8), st.text("ab cd", max_size=16))
@settings(max_examples=150, deadline=None)
def test_best_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a:
        windows = [b[max(0, s) : s + len(a)] for s in range(1 - len(a), len(b))]
        assert abs(best_partial(a, b) - max(indel_ratio(a, w) for w in windows)) < 1e-9


def test_closest_window():
    assert closest_window("big shelterz", "A Big shelter is here") == "Big shelter"
    assert closest_window("zzzz qqqq", "A Big shelter is here") is None
    assert closest_window("", "x") is None and closest_window("x", None) is None


def test_token_f1_and_grounding(spark):
    rows = spark.createDataFrame([("a b", "a b c d"), ("A B", "x a b"), ("", "a"), ("zz", "a b")], "s string, t string")
    got = rows.select(token_f1("s", "t").alias("f"), plainly_grounded("s", "t", 0.6).alias("g")).collect()
    assert [round(r.f, 3) for r in got] == [0.667, 0.8, 0.0, 0.0]
    assert [r.g for r in got] == [True, True, False, False]


def test_labels(spark):
    assert one(spark, validation.source_stance, " favor", "Against", "none", "??", None) == ["HOPEFUL", "HATE", "NEUTRAL", "NEUTRAL", "NEUTRAL"]
    assert one(spark, validation.normal_stance, "Positive", "hate", "Neutral", "Haoe", " HOPEFUL ") == ["HOPEFUL", "HATE", "NEUTRAL", None, "HOPEFUL"]
    rows = spark.createDataFrame([(" Shelter & Housing",), ("Addicton and Health",), ("public safety",), ("xyz",), ("Employment and Econmy",), (None,)], "c string")
    got = {r.c: r.n for r in validation.normal_category(rows, "c", "n").collect()}
    assert got == {" Shelter & Housing": "Shelter & Housing", "Addicton and Health": "Addiction & Health", "public safety": "Public Safety", "xyz": None, "Employment and Econmy": "Employment & Economy", None: None}


def test_consistency(spark):
    rows = spark.createDataFrame([("HATE", "need more"), ("HATE", "remove the support"), ("HOPEFUL", "trash"), ("NEUTRAL", "trash"), ("HATE", None)], "s string, o string")
    assert [r[0] for r in rows.select(validation.consistent("s", "o")).collect()] == [False, True, False, True, True]


def test_parse_object(spark):
    raw = ['```json\n{"a": 1}\n```', 'so: {"a": 2} ok', '{"a":{"b":1}} trailing', "[1, 2]", "garbage", None, '{"a": 1, "a": 3}']
    rows = spark.createDataFrame([(r,) for r in raw], "x string").select(validation.parse_object("x").alias("o")).collect()
    assert [r.o.json for r in rows] == ['{"a": 1}', '{"a": 2}', '{"b": 1}', None, None, None, '{"a": 3}']
    assert rows[4].o.error.startswith("Could not parse JSON from output: garbage")


def test_validate(spark):
    rows = spark.createDataFrame(
        [(1, "The big shelter is full tonight", "big shelter", "shelter and housing ", "is full"), (2, "The big shelter is full tonight", "big sheltr", "Public Space", "qqqq zzzz wwww"), (3, "x y", "", "Public Space", "x")],
        "id int, text string, aspect_target string, aspect_category string, opinion_span string",
    )
    got = {r.id: r for r in validation.validate_first(rows).collect()}
    assert got[1].valid and got[1].auto_fixed and got[1].aspect_category == "Shelter & Housing"
    assert not got[2].valid and [e.error_type for e in got[2].errors] == ["unsupported_span"]
    assert [(e.error_type, e.field) for e in got[3].errors] == [("missing_field", "aspect_target")]
    second = spark.createDataFrame([(1, "we need more beds", "need more", "hopeful", "need more beds"), (2, "we need more beds", "need more", "HATE", "we need"), (3, "a b", "a", "odd", "qqq")], "id int, text string, opinion_span string, stance string, explanation string")
    got = {r.id: r for r in validation.validate_second(second).collect()}
    assert got[1].valid and got[1].stance == "HOPEFUL" and not got[1].auto_fixed
    assert [e.error_type for e in got[2].errors] == ["label_inconsistency"]
    assert [e.error_type for e in got[3].errors] == ["invalid_label", "ungrounded_rationale"]


def test_ngrams_and_marks(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    assert rows.select(ngrams("t", 1, 2)).first()[0] == [["a"], ["b"], ["c"], ["a", "b"], ["b", "c"]]
    assert rows.select(mark("t", F.array(F.lit(1)))).first()[0] == ["a", "b_NEG", "c"]


def judged(spark, make, *rows):
    return [r[0] for r in spark.createDataFrame(list(rows), "p array<double>, q array<double>").select(make()).collect()]


def test_judgment(spark):
    p = ([0.4, 0.4, 0.2], [0.1, 0.2, 0.7])
    assert judged(spark, lambda: judgment.mode("p", split_ties=True), p) == [0.25]
    assert judged(spark, lambda: judgment.mode("p"), p) == [0.0]
    assert judged(spark, lambda: judgment.rounded_mean("p"), ([0.5, 0.5, 0.0], p[1])) == [0.0]
    assert judged(spark, lambda: judgment.median("p"), p) == [0.5]
    assert round(judged(spark, lambda: judgment.superiority("p", "q"), p)[0], 9) == round(1 - 2 * (0.4 * 0.1 + 0.8 * 0.2 + 1.0 * 0.7) + (0.04 + 0.08 + 0.14), 9)
    assert judged(spark, lambda: judgment.compare_medians("p", "q"), p) == [-1.0]
    assert judged(spark, lambda: judgment.compare_means("p", "p"), ([1.0, 0.0, 0.0], [1.0, 0.0, 0.0])) == [0.0]
    # the second leads on all quantiles above 0.3
    assert round(judged(spark, lambda: judgment.compare_quantiles("p", "q"), p)[0], 9) == -0.7
    assert judged(spark, lambda: judgment.ranking_distribution("p"), ([0.5, 0.5 + 1e-9], []), ([float("nan")] * 3, []), ([0.7, 0.3], [])) == [[0, 1, 0], [0, 1, 0], [0.7, 0, 0.3]]
    assert judged(spark, lambda: judgment.score_difference("p", "q"), p) == [[0.0, 0.0, 0.1, 0.2, 0.7]]


@given(st.lists(st.lists(st.floats(0.01, 1), min_size=5, max_size=5), min_size=2, max_size=2))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_pairwise_in_range(spark, raw):
    rows = spark.createDataFrame([tuple([x / sum(r) for x in r] for r in raw)], "p array<double>, q array<double>")
    made = rows.select(*[c.alias(n) for n, c in judgment.pairwise_predictions("p", "q").items()]).first()
    assert all(-1 <= v <= 1 for v in made)


def test_language_test(spark):
    texts = ["The cat is on the mat with a hat", "Der Hund und die Katze auf der Matte", "ja nein", None]
    assert one(spark, lambda c: F.coalesce(cleaning.in_common_words()(c), F.lit(False)), *texts) == [True, False, True, False]


def test_review_checks(spark):
    rows = spark.createDataFrame([("the big shelter", "big shelter", "qqqq", "odd", "HATE", "")], "text string, aspect_target string, opinion_span string, aspect_category string, stance string, explanation string")
    assert validation.review_checks(rows).first().checks == ["✓ aspect_target", "✗ opinion_span", "✗ aspect_category", "✓ stance"]
    fixed = validation.repair_plainly(rows, spans=("aspect_target", "opinion_span")).first()
    assert not fixed.repaired and fixed.opinion_span == "qqqq"
    near = validation.repair_plainly(rows.withColumn("aspect_target", F.lit("big sheltr")).withColumn("aspect_category", F.lit("public safety"))).first()
    assert near.repaired and near.aspect_target == "big shelter" and near.aspect_category == "Public Safety"


def test_sql_functions(spark):
    from lexforge.functions import similarity

    similarity.register(spark)
    assert spark.sql("SELECT indel_ratio('abc', 'abd') AS r, partial_ratio('abc', 'xxabcxx') AS p").first() == (pytest.approx(200 * 2 / 6), 100.0)
