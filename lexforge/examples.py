"""Registered queries on stated rows, for operators whose inputs the driver's tables do not hold (posts with hashtags,
annotations, review decisions, broken JSON), and round trips of the sources and sinks over whole tables.

A case is a tuple of inputs and the result that is expected; the SQL of such a query lists the results.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from math import log10

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cleaning, judgment, lexicons, patterns, similarity, strings, validation
from .operators import generation, ngram_stats, relational, routing, semantic, social
from .plans import pipelines
from .queries import _GRAMS, _MEAN, _judged, query, table
from .queries import _P as _JUDGED
from .session import scratch
from .sources import io
from .streaming import stateful

C = lexicons.CATEGORIES


def value(x: object) -> str:
    """A value as DuckDB SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def listed(rows: list[tuple], columns: str) -> str:
    """Rows as DuckDB SQL; columns is a DDL string, whose types are DuckDB's, too."""
    named = [c.split() for c in columns.split(", ")]
    cast = ", ".join(f'"{n}"::{ {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER"}.get(t, t.upper()) } AS "{n}"' for n, t in named)
    values = ", ".join("(" + ", ".join(value(x) for x in row) + ")" for row in rows)
    return f"SELECT {cast} FROM (VALUES {values}) AS v({', '.join(chr(34) + n + chr(34) for n, _ in named)})"


def expected(rows: list[tuple], columns: str) -> Callable:
    """Registers a query of exactly these rows."""
    return query(listed(rows, columns))


def cases(name: str, inputs: str, rows: list[tuple], make: Callable[..., Column], kind: str = "string") -> None:
    """Registers make(columns of inputs) over the inputs of the cases; doubles are rounded to six places."""
    width = len(inputs.split(", "))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = spark.createDataFrame([(k, *r[:width]) for k, r in enumerate(rows)], f"case_id int, {inputs}")
        made = make(*[F.col(c.split()[0]) for c in inputs.split(", ")])
        return data.select("case_id", (F.round(made, 6) if kind == "double" else made).cast(kind).alias("result"))

    run.__name__ = name
    results = [round(r[width], 6) if kind == "double" and r[width] is not None else r[width] for r in rows]
    query(listed(list(enumerate(results)), f"case_id int, result {kind}"))(run)


def plain(f: Callable, kind: str = "string") -> Callable[..., Column]:
    """An Arrow function of one text."""
    return lambda x: F.pandas_udf(lambda s: s.map(lambda v: None if v is None else f(v)), kind)(x)


# --- cleaning -----------------------------------------------------------------------------------------------------------

cases("clean_encodings", "x string", [("donâ€™t", "don't"), ("cafÃ© “so”", 'cafÃ© "so"'.replace("Ã©", "é")), ("ﬁne ﬂow", "fine flow"), ("plain", "plain"), (None, None)], cleaning.repair_plainly)
cases("clean_references", "x string", [("a &amp; b &lt;3", "a & b <3"), ("&#233;t&eacute;", "été"), ("no ref", "no ref"), (None, None)], cleaning.unescape_html)
cases("clean_emoji", "x string", [("ok 😀", "ok  grinning_face "), ("é ☀", "é  black_sun_with_rays "), ("plain", "plain"), (None, None)], cleaning.name_emoji)
cases("link_importance", "link string, x string", [("https://a.b/c", "nothing", 0.0), ("https://a.b/c", "homeless shelter", 0.3), ("https://a.b/housing", "Policy", 0.3), ("http://x.y", "homeless shelter housing encampment policy addiction mental health welfare", 1.0)], lambda u, x: F.least(cleaning.link_importance(u, x), F.lit(1.0)), "double")
cases("english_texts", "x string", [("The cat is on the mat with a hat", True), ("Der Hund und die Katze auf der Matte", False), ("le chat est dans la maison avec les enfants", False), ("ok", True)], cleaning.in_common_words(), "boolean")
cases("clean_posts", "x string", [("Idk what &amp; why!!! @you http://a.b/c is here here now 12", "I do not know what & why! is here now"), ("short", None), ("[deleted]", None), ("  ", None), ("Go now. go now. Stop right there, all of you.", "Go now. Stop right there, all of you.")], cleaning.clean_text)

_PARTS = "string_split({0}, '')"
# a run of three or more becomes two: what equals the two characters before it goes; line feeds are no characters here
_SQUEEZED = "array_to_string(list_filter(string_split({0}, ''), lambda c, i: i < 3 OR c = chr(10) OR NOT (c = string_split({0}, '')[i - 1] AND c = string_split({0}, '')[i - 2])), '')"


def _digest(name: str, f: Callable, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", F.md5(f("text")).alias("digest"))

    run.__name__ = name
    query(sql)(run)


# numbers stand between characters that are no parts of words
_NUMBERS = "regexp_replace(regexp_replace({0}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])\\p{{Nd}}+($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1\\2', 'g'), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])\\p{{Nd}}+($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1\\2', 'g')"
_digest("clean_numbers", cleaning.drop_numbers, f"SELECT doc_id, md5({_NUMBERS.format('text')}) AS digest FROM documents")
_CHARS = "WITH c AS (SELECT doc_id, string_split({0}, '') AS c FROM {1}) SELECT doc_id, array_to_string(list_filter(c, lambda x, i: i < 3 OR x = chr(10) OR NOT (x = c[i - 1] AND x = c[i - 2])), '') AS t FROM c"
_digest("squeeze_chars", cleaning.squeeze_chars, f"SELECT doc_id, md5(t) AS digest FROM ({_CHARS.format('text', 'documents')})")
# words and what stands between them in turn; a word after white space that equals the word before goes with that space
_WORDS = """WITH p AS (SELECT doc_id, regexp_extract_all({0}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS p FROM {1}), k AS (SELECT doc_id, p, list_transform(p, lambda x, i: i > 2 AND regexp_full_match(p[i - 1], '\\s+') AND lower(x) = lower(p[i - 2])) AS again FROM p)
  SELECT doc_id, coalesce(array_to_string(list_filter(p, lambda x, i: NOT again[i] AND NOT coalesce(again[i + 1], FALSE)), ''), '') AS t FROM k"""
_digest("squeeze_words", cleaning.squeeze_words, f"SELECT doc_id, md5(t) AS digest FROM ({_WORDS.format('text', 'documents')})")


def _clean_sql() -> str:
    """The whole chain over texts without references, step by step."""
    word = "[^\\s]+"
    pairs = lexicons.ACRONYMS | lexicons.SLANG
    known = "MAP {" + ", ".join(f"{value(k)}: {value(v)}" for k, v in pairs.items()) + "}"
    link = "https?://[^\\s<>\"'']+|www\\.[^\\s<>\"'']+"
    steps = [
        ("a", "SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\p{Cf}\\p{Co}]', '', 'g'), '" + link + "', '', 'gi'), '@[\\p{L}\\p{M}\\p{N}_]+', '', 'g'), '#([\\p{L}\\p{M}\\p{N}_]+)', '\\1', 'g') AS t FROM documents"),
        ("b", f"SELECT doc_id, text, array_to_string(list_transform(regexp_extract_all(t, '{word}'), lambda w: coalesce({known}[regexp_replace(lower(w), '^[.,!?;:()]+|[.,!?;:()]+$', '', 'g')], w)), ' ') AS t FROM a"),
        ("c", f"SELECT doc_id, text, {_NUMBERS.format('t')} AS t FROM b"),
        ("d", _CHARS.format("t", "c")),
        ("e", _WORDS.format("t", "d")),
        ("f", "SELECT doc_id, regexp_replace(t, '([!?.]){2,}', '\\1', 'g') AS t FROM e"),
        ("g", "SELECT doc_id, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM f"),
        ("h", "SELECT doc_id, p, list_transform(p, lambda s: lower(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))) AS k FROM g"),
        ("i", "SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_filter(p, lambda s, i: list_position(k, k[i]) = i), ' '), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM h"),
    ]
    kept = "NOT regexp_matches(d.text, '^\\s*(\\[([dD][eE][lL][eE][tT][eE][dD]|[rR][eE][mM][oO][vV][eE][dD])\\]\\s*)?$')"
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in steps) + f" SELECT i.doc_id, md5(i.t) AS digest FROM i JOIN documents d ON d.doc_id = i.doc_id WHERE length(i.t) >= 20 AND {kept}"


@query(_clean_sql())
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.cleaned_rows(table(spark, sf_dir, "documents")).select("doc_id", F.md5("cleaned_text").alias("digest"))


# --- entities, tags, hashtags --------------------------------------------------------------------------------------------

cases("tag_entities", "x string", [("see https://x.y/z or www.a.bc", "see  <url>  or  <url> "), ("mail a.b@c.org @me", "mail  <email>   <user> "), ("10% of $5.50 on 12/12/2012 at 10:30 am", " <percent>  of  <money>  on  <date>  at  <time> "), ("call 555-123-4567 now 12", "call  <phone>  now  <number> "), (None, None)], lambda x: patterns.tag_entities(x, ("url", "email", "percent", "money", "phone", "user", "time", "date", "number")))
cases("omit_tags", "x string", [("a <url> b <user>", "a  b "), ("<url><email>", "<email>"), ("none", "none")], lambda x: patterns.omit_tags(x, ("url", "user")))
cases("unpack_hashtags", "x string", [("see #TwinPeaks", "see Twin Peaks"), ("#lower stays", "#lower stays"), ("#NewYork2020", "New York 2020"), ("#Snake_Case", "Snake  Case")], lambda x: patterns.unpack_camel_hashtags(x))
cases("annotate_caps", "x string", [("so HUGE it", "so  <allcaps> HUGE </allcaps>   it"), ("HEY YOU there", " <allcaps> HEY YOU </allcaps>   there"), ("#TAG I am", "#TAG I am")], patterns.annotate_caps)
cases("annotate_caps_single", "x string", [("so HUGE it", "so  HUGE <allcaps>  it")], lambda x: patterns.annotate_caps(x, "single"))
cases("annotate_caps_every", "x string", [("HEY YOU", "  HEY <allcaps>   YOU <allcaps>  "), ("no", "no")], lambda x: patterns.annotate_caps(x, "every"))
cases("annotate_emphasis", "x string", [("a *very* big", "a  very <emphasis>  big"), ("2 * 3 * 4", "2 * 3 * 4")], patterns.annotate_emphasis)
cases("annotate_censored", "x string", [("oh f**k no", "oh   f**k <censored>   no"), ("**", "**")], patterns.annotate_censored)
cases("sorted_punctuation", "x string", [("!?.!! a? b...", "?.! a? b."), ("what?!", "what?!"), ("no", "no")], patterns.sort_punctuation)
cases("sorted_punctuation_tagged", "x string", [("wow!!!", "wow ! <repeated> "), ("a?!?", "a ?! <repeated> ")], lambda x: patterns.sort_punctuation(x, tag=True))
cases("contractions", "x string", [("can't won't I'm y'all he'd", "can not will not I am you all he'd"), ("They’ve shan't don't Let's", "They have shall not do not Let us"), ("we'll they're you've isn't", "we will they are you have is not"), (None, None)], patterns.expand_contractions)
cases("drop_tagged_words", "x string", [("a <url> b <3", "a b"), ("<user>", "")], patterns.drop_tagged_words)
cases("split_camel", "x string", [("camelCased", "camel Cased"), ("PascalCased", "Pascal Cased"), ("lower", "lower")], patterns.split_camel)

WORDS = {
    "twin": 50, "peaks": 40, "david": 60, "lynch": 30, "tv": 80, "series": 70, "john": 60, "doe": 20, "bad": 90, "movies": 60, "sentiment": 30, "sucks": 40, "yay": 30, "the": 500, "new": 200, "season": 50,
    "small": 50, "and": 100, "insignificant": 5, "correct": 9, "good": 30, "god": 5, "cool": 10,
}
STATISTICS = social.Statistics(WORDS, {"small_and": 20})
PREPROCESSOR = social.Preprocessor(
    normalize=("url", "email", "percent", "money", "phone", "user", "time", "date", "number"), annotate=frozenset(["hashtag", "allcaps", "elongated", "repeated", "emphasis", "censored"]), statistics=STATISTICS,
    unpack_hashtags=True, unpack_contractions=True, caps="every", lowercase=True, dictionaries=(lexicons.emoticons(),),
)
cases("preprocess_posts", "x string", [
    ("CANT WAIT for the new season of #TwinPeaks ＼(^o^)／!!! #davidlynch #tvseries :)))", "cant <allcaps> wait <allcaps> for the new season of <hashtag> twin peaks </hashtag> ＼(^o^)／ ! <repeated> <hashtag> david lynch </hashtag> <hashtag> tv series </hashtag> <happy>"),
    ("I saw the new #johndoe movie and it suuuuucks!!! WAISTED $10... #badmovies :/", "i saw the new <hashtag> john doe </hashtag> movie and it sucks <elongated> ! <repeated> waisted <allcaps> <money> . <repeated> <hashtag> bad movies </hashtag> <annoyed>"),
    ("@SentimentSymp:  can't wait for the Nov 9 #Sentiment talks!  YAAAAAAY !!! :-D http://sentimentsymposium.com/.", "<user> : can not wait for the <date> <hashtag> sentiment </hashtag> talks ! yay <elongated> <allcaps> ! <repeated> <laugh> <url>"),
    (None, None),
], lambda x: PREPROCESSOR.udf()(x))
cases("preprocess_without_tags", "x string", [("a www.b.cd <3 c", "a c"), ("@me hi", "hi")], lambda x: social.Preprocessor(normalize=("url", "user"), remove_tags=True).udf()(x))
cases("segment_words", "x string", [("smallandinsignificant", "small and insignificant"), ("twinpeaks", "twin peaks"), ("camelCased", "camel cased"), ("PascalCased", "pascal cased")], plain(STATISTICS.segment))
cases("spell_words", "x string", [("korrect", "correct"), ("KORRECT", "CORRECT"), ("zzzzzz", "zzzzzz"), ("Thhe", "The"), ("good", "good")], plain(STATISTICS.correct_cased))
cases("spell_texts", "x string", [("The korrect Thhe", "The correct The")], plain(STATISTICS.correct_text))
cases("shorten_words", "x string", [("coool", "cool"), ("GOOD", "GOOD"), ("suucks", "sucks"), ("qqq", "qqq")], plain(STATISTICS.shorten))
cases("word_likelihood", "x string", [("the", log10(500 / sum(WORDS.values()))), ("unseen", log10(10.0 / sum(WORDS.values())) - 6)], plain(lambda w: log10(STATISTICS.probability(w)), "double"), "double")
cases("sequence_similarity", "a string, b string", [("abcd", "bcde", 0.75), ("same", "same", 1.0), ("ab", "cd", 0.0), (None, "x", None)], similarity.sequence_similarity, "double")
_POSTS = [("CANT WAIT for the new season of #TwinPeaks ＼(^o^)／ yaaaay!!! #davidlynch #tvseries :)))", "CANT|WAIT|for|the|new|season|of|#TwinPeaks|＼(^o^)／|yaaaay|!|!|!|#davidlynch|#tvseries|:)))"), ("I saw the new #johndoe movie and it suuuuucks!!! WAISTED $10... #badmovies >3:/", "I|saw|the|new|#johndoe|movie|and|it|suuuuucks|!|!|!|WAISTED|$10|.|.|.|#badmovies|>|3:/"), ("f**k *wow* &amp; a@b.co U.S.A. 10% 5pm", "f**k|*wow*|&|a@b.co|U.S.A.|10%|5pm")]
cases("social_tokens", "x string", _POSTS, lambda x: F.array_join(social.tokens(x), "|"))
cases("chosen_tokens", "x string", [("#cool @Me 10%", "#|cool|@|me|10%"), ("A.B. x", "a|.|b|.|x")], lambda x: F.array_join(social.tokens(x, lowercase=True, hashtags=False, users=False, acronyms=False), "|"))
cases("emoticon_tags", "x string", [(":)", "<happy>"), ("(:", "<happy>"), (":((((((((", "<sad>"), ("):", "<sad>"), (":-d", "<laugh>"), ("<3", "<heart>"), (":/", "<annoyed>"), ("word", "word")], lambda x: F.get(strings.replace_tokens(F.array(x), lexicons.emoticons()), F.lit(0)))
cases("slang_words", "x string", [("brb lol now", "be right back laughing out loud now"), ("thru b4", "through before")], lambda x: F.array_join(strings.replace_tokens(F.split(x, " "), lexicons.SLANG), " "))
cases("caps_in_hashtags", "x string", [("<hashtag> <allcaps> A </allcaps> </hashtag> <allcaps>", "<hashtag> A </hashtag> <allcaps>"), ("<allcaps> B </allcaps>", "<allcaps> B </allcaps>")], plain(lambda x: " ".join(social.without_caps_in_hashtags(x.split()))))
cases("token_ngrams", "x string", [("a b c", "a|b|c|a b|b c"), ("a", "a"), ("a b", "a|b|a b")], lambda x: F.array_join(F.transform(strings.ngrams(F.split(x, " "), 1, 2), lambda g: F.array_join(g, " ")), "|"))
cases("marked_tokens", "x string", [("a b c", "a b_NEG c_NEG")], lambda x: F.array_join(strings.mark(F.split(x, " "), F.array(F.lit(1), F.lit(2))), " "))
cases("marked_tokens_before", "x string", [("a b c", "NOT_a b c")], lambda x: F.array_join(strings.mark(F.split(x, " "), F.array(F.lit(0)), "NOT", "prefix"), " "))
cases("negated_words", "x string", [("i do not like this . but fine", "3 4"), ("never ( a ) b", "4"), ("couldn't see it , fine", "1 2"), ("all is well", "")], lambda x: F.array_join(social.negation_positions(F.split(x, " ")).cast("array<string>"), " "))
cases("negated_words_widely", "x string", [("not a , b . c", "1 2 3 4 5"), ("not a but b", "1")], lambda x: F.array_join(social.negation_positions(F.split(x, " "), commas=False).cast("array<string>"), " "))


@expected([(1, 0.4, 0.5, 0.1, -0.1), (2, 0.1, 0.8, 0.1, -0.7)], "doc_id int, pos double, neg double, obj double, polarity double")
def sentence_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame([("good", 0.8, 0.1, 0.1), ("bad", 0.0, 0.9, 0.1)], "word string, pos double, neg double, obj double")
    rows = spark.createDataFrame([(1, ["good", "bad"]), (2, ["not", "good"]), (3, ["unknown"])], "doc_id int, words array<string>")
    return social.polarity(rows, lexicon).select("doc_id", *[F.round(c, 6).alias(c) for c in ("pos", "neg", "obj", "polarity")])


@expected([(1, 0.3, 0.2, 0.5, 0.1)], "doc_id int, pos double, neg double, obj double, polarity double")
def mean_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, [(0.5, 0.0, 0.5), (0.1, 0.4, 0.5)]), (2, [])], "doc_id int, scores array<struct<pos:double,neg:double,obj:double>>")
    return relational.mean_sentiment(rows).select("doc_id", *[F.round(c, 6).alias(c) for c in ("pos", "neg", "obj", "polarity")])


@expected([(1, "grim", -1, "1 0 0 0 0 0 0 0"), (1, "joyful", 1, "0 0 0 0 0 0 1 0")], "doc_id int, word string, polarity int, emotions string")
def word_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon is written as three tab-parted columns and read again."""
    long = spark.createDataFrame([("joyful", "joy", 1.0), ("joyful", "positive", 1.0), ("grim", "fear", 1.0), ("grim", "negative", 1.0), ("dull", "anger", 0.0)], "word string, emotion string, score double")
    path = scratch(spark, "emotions")
    long.write.option("sep", "\t").csv(path)
    rows = spark.createDataFrame([(1, ["grim", "x", "joyful"])], "doc_id int, words array<string>")
    found = social.emotions(rows, social.emotion_lexicon(io.read_emotions(spark, path)))
    return found.select("doc_id", "word", "polarity", F.array_join(F.transform("emotions", lambda e: e.cast("int").cast("string")), " ").alias("emotions"))


# --- spans, validation, review ------------------------------------------------------------------------------------------

cases("indel_ratios", "a string, b string", [("abc", "abd", 200 * 2 / 6), ("same", "same", 100.0), ("", "", 100.0), ("abc", "xyz", 0.0), ("kitten", "sitting", 200 * 4 / 13), (None, "a", None)], similarity.ratio, "double")
cases("partial_ratios", "a string, b string", [("abc", "xxabcxx", 100.0), ("xxabcxx", "abc", 100.0), ("abcd", "xxabxd", 75.0), ("ab", "cd", 0.0)], similarity.partial_ratio, "double")
cases("closest_spans", "span string, x string", [("big shelterz", "A Big shelter is here", "Big shelter"), ("zzzz qqqq", "A Big shelter is here", None), ("", "x", None)], similarity.closest_span)
cases("object_of_output", "x string", [('```json\n{"a": 1}\n```', "1"), ('so: {"a": 2} ok', "2"), ('{"a":{"b":1}} trailing', None), ("[1, 2]", None), ("garbage", None), (None, None), ('{"a": 5}', "5"), ('{"a": 1, "a": 3}', "3")], lambda x: F.get_json_object(validation.parse_object(x)["json"], "$.a"))
cases("error_of_output", "x string", [("garbage", "Could not parse JSON from output: garbage"), ('{"a": 5}', None), (None, "Could not parse JSON from output: ")], lambda x: validation.parse_object(x)["error"])
cases("missing_fields", "a string, b string", [("x", "y", ""), (" ", "y", "missing_field:a"), (None, "", "missing_field:a; missing_field:b")], lambda a, b: validation.error_text(validation.missing_fields({"a": a, "b": b})))
cases("stance_labels", "x string", [("Positive", "HOPEFUL"), ("hate", "HATE"), ("Neutral", "NEUTRAL"), ("Haoe", None), (" HOPEFUL ", "HOPEFUL"), ("hostile", "HATE")], validation.normal_stance)
cases("rationale_score", "a string, x string", [("a b", "a b c d", 2 / 3), ("", "a", 0.0), ("need beds", "we need more beds", 2 / 3)], similarity.token_f1, "double")
cases("token_cost", "i long, o long", [(1000, 500, 0.0012), (0, 0, 0.0), (100, 100, 0.0002)], relational.token_cost, "double")
cases("rewrite_cost", "i long, o long", [(1_000_000, 0, 0.15), (0, 500_000, 0.3)], relational.rewrite_cost, "double")
cases("attempt_status", "a int, b int, c boolean, d boolean", [(1, 1, False, False, "accepted"), (2, 1, False, False, "repaired"), (1, 1, True, False, "repaired"), (1, 3, None, None, "repaired"), (1, 1, None, None, "accepted")], routing.status_of)


def _frame(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(n if " " in n else f"{n} string" for n in names.split(", ")))


@expected([(" Shelter & Housing", C[0]), ("Addicton and Health", C[3]), ("public safety", C[2]), ("xyz", None), ("Employment and Econmy", C[5])], "raw string, category string")
def fuzzy_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, [(" Shelter & Housing",), ("Addicton and Health",), ("public safety",), ("xyz",), ("Employment and Econmy",)], "raw")
    return validation.normal_category(rows, "raw", "category")


@expected([(1, True, None), (2, True, None), (3, True, None), (4, False, "shelter is full"), (5, False, None)], "id int, grounded boolean, closest string")
def grounded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "The big shelter is full tonight"
    rows = _frame(spark, [(1, "BIG shelter", text), (2, "tonight full is shelter big", text), (3, "big sheltr", text), (4, "shaltar iz fulls", text), (5, "qqqq zzzz wwww", text)], "id int, span, text")
    return validation.grounding(rows, "span", "text", "g").select("id", "g.grounded", "g.closest")


@expected([(1, True, True, C[0], "big shelter", ""), (2, False, False, C[1], "big sheltr", "unsupported_span:opinion_span"), (3, False, False, C[1], "", "missing_field:aspect_target"), (4, False, False, "odd", "x", "invalid_category:aspect_category")], "id int, valid boolean, fixed boolean, category string, target string, errors string")
def validated_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, [(1, "The big shelter is full tonight", "big shelter", "shelter and housing ", "is full"), (2, "The big shelter is full tonight", "big sheltr", "Public Space", "qqqq zzzz wwww"), (3, "x y", "", "Public Space", "x"), (4, "x y", "x", "odd", "y")], "id int, text, aspect_target, aspect_category, opinion_span")
    done = validation.validate_first(rows)
    return done.select("id", "valid", F.col("auto_fixed").alias("fixed"), F.col("aspect_category").alias("category"), F.col("aspect_target").alias("target"), validation.error_text("errors").alias("errors"))


@expected([(1, True, False, "HOPEFUL", ""), (2, False, False, "HATE", "label_inconsistency:stance"), (3, False, False, "odd", "invalid_label:stance; ungrounded_rationale:explanation"), (4, True, True, "HATE", ""), (5, False, False, "HATE", "missing_field:explanation")], "id int, valid boolean, fixed boolean, stance string, errors string")
def validated_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = "we need more beds"
    rows = _frame(spark, [(1, post, "need more", "hopeful", "need more beds"), (2, post, "need more", "HATE", "we need"), (3, "a b", "a", "odd", "qqq"), (4, "they ruin it", "ruin it", "negative", "they ruin it"), (5, post, "x", "HATE", " ")], "id int, text, opinion_span, stance, explanation")
    done = validation.validate_second(rows)
    return done.select("id", "valid", F.col("auto_fixed").alias("fixed"), "stance", validation.error_text("errors").alias("errors"))


@expected([(1, False, "qqqq", "odd"), (2, True, "is full", C[2])], "id int, repaired boolean, opinion string, category string")
def repaired_plainly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, [(1, "the big shelter", "big shelter", "qqqq", "odd"), (2, "the big shelter is full", "big sheltr", "iz full", "public safety")], "id int, text, aspect_target, opinion_span, aspect_category")
    return validation.repair_plainly(rows).select("id", "repaired", F.col("opinion_span").alias("opinion"), F.col("aspect_category").alias("category"))


@expected([(1, True, "HOPEFUL", "need more beds"), (2, False, "HATE", "we need")], "id int, repaired boolean, stance string, explanation string")
def repaired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, [(1, "we need more beds", "positive", "need moar beds"), (2, "we need more beds", "HATE", "we need")], "id int, text, stance, explanation")
    return validation.repair_plainly(rows, spans=("explanation",), category=None, stance="stance").select("id", "repaired", "stance", "explanation")


@expected([(1, "✓ aspect_target; ✗ opinion_span; ✗ aspect_category; ✓ stance"), (2, "✓ opinion_span; ✓ explanation")], "id int, checks string")
def review_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, [(1, "the big shelter", "big shelter", "qqqq", "odd", "HATE", ""), (2, "the big shelter", "", "the big", None, " ", "big shelter")], "id int, text, aspect_target, opinion_span, aspect_category, stance, explanation")
    return validation.review_checks(rows).select("id", F.array_join("checks", "; ").alias("checks"))


# --- prompts, generation, routing ----------------------------------------------------------------------------------------

cases("inventories", "x string", [("a", "1. a: first"), ("b", "1. b: ")], plain(lambda x: generation.inventory([x], {"a": "first"})))
cases("inventories_marked", "x string", [("a", "   - a: first")], plain(lambda x: generation.inventory([x], {"a": "first"}, numbered=False)))
cases("error_messages", "kind string, field string, why string", [("missing_field", "stance", "x", "Field 'stance' is missing or empty."), ("invalid_category", "c", "odd", "Category 'odd' is not in the list."), ("parse_error", "output", "x", "The output is not JSON: answer with JSON only."), ("label_inconsistency", "stance", "no", "label_inconsistency: no")], lambda k, f, w: F.get(generation.error_messages(F.array(F.struct(k.alias("error_type"), f.alias("field"), w.alias("message")))), F.lit(0)))
_W = generation.Wording(first="One.", second="Two.", repair="Mend.")


def _said(*messages: tuple[str, str]) -> str:
    return "\n---\n".join(f"{r}: {c}" for r, c in messages)


def _shown(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n---\n")


cases("prompts_first", "x string", [("a post", _said(("system", "One.\n1. A: \n2. B: "), ("user", "Post: s\nFields: aspect_target, aspect_category, opinion_span"), ("assistant", '{\n  "aspect_target": "t",\n  "aspect_category": "A",\n  "opinion_span": ""\n}'), ("user", "Post: a post\nFields: aspect_target, aspect_category, opinion_span"))), (None, _said(("system", "One.\n1. A: \n2. B: "), ("user", "Post: s\nFields: aspect_target, aspect_category, opinion_span"), ("assistant", '{\n  "aspect_target": "t",\n  "aspect_category": "A",\n  "opinion_span": ""\n}'), ("user", "Post: \nFields: aspect_target, aspect_category, opinion_span")))], lambda x: _shown(generation.prompt(x, stage=1, shots=[{"text": "s", "aspect_target": "t", "aspect_category": "A"}], wording=_W, categories=["A", "B"])))
cases("prompts_second", "x string, t string", [("a post", 'say "x"', _said(("system", "Two.\n   - HATE: \n   - NEUTRAL: \n   - HOPEFUL: "), ("user", 'Post: a post\nAnnotation: {\n  "aspect_target": "say \\"x\\""\n}\nFields: stance, explanation')))], lambda x, t: _shown(generation.prompt(x, stage=2, wording=_W, given={"aspect_target": t})))
cases("prompts_of_repair", "x string, s string", [("a post", "odd", _said(("system", "Mend.\n- Stance is odd"), ("user", 'Post: a post\nAnswer so far: {\n  "stance": "odd"\n}\nFields: stance, explanation')))], lambda x, s: _shown(generation.repair_prompt(x, {"stance": s}, F.array(F.struct(F.lit("invalid_label").alias("error_type"), F.lit("stance").alias("field"), F.lit("is odd").alias("message"))), stage=2, wording=_W)))


@dataclass(frozen=True)
class Stubborn:
    """Answers badly until it is asked to repair; never where the post says hopeless; no JSON where it says silent."""

    def complete(self, messages: list[dict[str, str]]) -> generation.Reply:
        asked = messages[-1]["content"]
        if "silent" in asked:
            return generation.Reply("no idea", 7, 2)
        if "Answer so far" in asked and "hopeless" not in asked:
            return generation.RuleBackend().complete(messages)
        if "Fields: stance" in asked:
            return generation.RuleBackend().complete(messages)
        return generation.Reply('{"aspect_target": "nowhere at all", "aspect_category": "none such", "opinion_span": "zzzzz"}', 10, 5)


@dataclass(frozen=True)
class Failing:
    """Fails whenever a post says broken."""

    def complete(self, messages: list[dict[str, str]]) -> generation.Reply:
        if "broken" in messages[-1]["content"]:
            raise RuntimeError("no")
        return generation.RuleBackend().complete(messages)


_TEXTS = [(1, "The city shelter needs support and more housing for people"), (2, "tiny"), (3, "Public safety downtown is ruining everything here"), (4, "The line is broken and nobody answers at all"), (5, "A report about the park and the budget of it")]


@expected([(1, "shelter needs", 11), (3, "downtown", 0)], "row_idx long, has string, n int")
def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a backend; what fails in all tries is null and costs nothing."""
    rows = _frame(spark, [(1, "Post: The shelter needs beds\nFields: aspect_target"), (3, "Post: broken downtown\nFields: aspect_target")], "row_idx long, asked").withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("asked").alias("content"))))
    made = generation.generate(rows, Failing(), tries=2)
    return made.select("row_idx", F.when(F.contains("s1_raw", F.lit("shelter needs")), "shelter needs").otherwise("downtown").alias("has"), F.when(F.col("s1_raw").isNull(), F.col("s1_tokens_out").cast("int")).otherwise(F.lit(11)).alias("n"))


@expected([(1, "accepted", "HOPEFUL", 1, ""), (2, "filtered", None, None, None), (3, "accepted", "HATE", 1, ""), (4, "failed", None, 1, "Stage 1 generation returned None"), (5, "accepted", "NEUTRAL", 1, "")], "row_idx long, status string, stance string, attempts int, errors string")
def processed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = generation.process(_frame(spark, _TEXTS, "row_idx long, text"), Failing())
    return done.select("row_idx", "status", "stance", F.col("s1_attempts").alias("attempts"), "errors")


@expected([(1, "repaired", 2, ""), (2, "review", 4, "Stage 1 repair failed: invalid_category:aspect_category; unsupported_span:aspect_target; unsupported_span:opinion_span"), (3, "failed", 1, "Stage 1 generation returned None")], "row_idx long, status string, attempts int, errors string")
def repaired_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad answers are repaired in bounded rounds, go to review, or fail."""
    rows = _frame(spark, [(1, "The city shelter needs support and more housing"), (2, "This is a hopeless case of a post that no one mends"), (3, "The backend is silent when it is asked about this")], "row_idx long, text")
    return generation.process(rows, Stubborn(), repairer=Stubborn()).select("row_idx", "status", F.col("s1_attempts").alias("attempts"), "errors")


@expected([(1, "HOPEFUL", None), (4, None, "stage1 failed")], "row_idx long, stance string, error string")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read from CSV, predicted, written as CSV and read again."""
    path, out = scratch(spark, "asked"), scratch(spark, "predicted")
    _frame(spark, [(str(k), t) for k, t in _TEXTS if k in (1, 4)], "row_idx, text").write.option("header", True).option("escape", '"').csv(path)
    rows = io.read_predictions_input(spark, path).withColumn("row_idx", F.col("row_idx").cast("long"))
    generation.predict(rows, Failing()).write.option("header", True).option("escape", '"').csv(out)
    done = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out)
    return done.select(F.col("row_idx").cast("long").alias("row_idx"), "stance", "error")


@dataclass(frozen=True)
class Rewriter:
    """Finds related what names a shelter, and rewrites it in capitals; fails for lists that say broken."""

    def complete(self, messages: list[dict[str, str]]) -> generation.Reply:
        posts = messages[-1]["content"].split("\n")[1:]
        if any("broken" in p for p in posts):
            raise RuntimeError("no")
        found = [{"id": k, "related": "shelter" in p, "confidence": 0.9 if "sure" in p else 0.4, "rewrite": p.split(". ", 1)[1].upper()} for k, p in enumerate(posts, 1)]
        return generation.Reply(json.dumps({"results": found}), 1, 1)


@expected([(1, True, 0.9, "SURE SHELTER"), (2, False, 0.9, None), (3, True, 0.4, None)], "id int, related boolean, confidence double, rewrite string")
def rewritten_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewriting in batches, and the gate that keeps what is related and sure enough, cut to a number of words."""
    rows = _frame(spark, [(1, "sure shelter news"), (2, "sure park"), (3, "a shelter")], "id int, cleaned_text").coalesce(1)
    return relational.relevance_gate(generation.rewrite_batches(rows, Rewriter()), words=2).select("id", "related", "confidence", "rewrite")


_RESULT = "sample_id int, cleaned_text, aspect_target, aspect_category, opinion_span, stance, explanation, status, errors"


def _result(k: int, text: str = "text", target: str = "t", stance: str = "HATE") -> tuple:
    return (k, text, target, C[0], "o", stance, "e", "accepted", "x")


@expected([(1, "reviewed_accepted", "HATE", ""), (2, "reviewed_edited", "NEUTRAL", "")], "sample_id int, status string, stance string, errors string")
def reviewed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = _frame(spark, [(1, "a", None), (2, "e", "NEUTRAL"), (3, "r", None), (4, "s", None), (5, "q", None), (6, "a", None)], "sample_id int, action, stance")
    return routing.review(_frame(spark, [_result(k) for k in range(1, 8)], _RESULT), decisions).select("sample_id", "status", "stance", "errors")


@expected([(1, "a a a"), (2, "b b b"), (3, "c c c")], "sample_id long, text string")
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts in order, without blank targets and lower-case stances; near copies of earlier rows go."""
    parts = [[_result(5, "b b b"), _result(2, "a a a")], [_result(1, stance="hate"), _result(3, "B b b")], [_result(9, target=" "), _result(7, "c c c")]]
    return routing.merge([_frame(spark, p, _RESULT) for p in parts], least_ratio=85.0).select(F.col("sample_id").cast("long").alias("sample_id"), "text")


@expected([(1, "0.500000", 2, "", "VAST")], "sample_id int, cost string, attempts int, errors string, source string")
def assembled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, [("1", 0.5, "2", None, "VAST")], "id, cost double, tried, errors, source")
    made = routing.assemble(rows, {"sample_id": F.col("id"), "cost_usd": F.format_string("%.6f", "cost"), "s1_attempts": F.col("tried"), "errors": F.col("errors"), "source_dataset": F.col("source")})
    return made.select("sample_id", F.col("cost_usd").alias("cost"), F.col("s1_attempts").alias("attempts"), "errors", F.col("source_dataset").alias("source"))


cases("error_texts", "a string, b string", [("missing_field", "stance", "Stage 1: missing_field:stance"), ("odd", "x", "Stage 1: odd:x")], lambda a, b: validation.error_text(F.array(F.struct(a.alias("error_type"), b.alias("field"), F.lit("m").alias("message"))), "Stage 1: "))
cases("error_free", "a string", [("x", True), ("", False), (None, False)], lambda a: F.size(validation.missing_fields({"a": a})) == 0, "boolean")


@expected([(0,), (2,), (4,), (6,)], "idx long")
def first_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of neighbours: every second one is kept, where components would keep only the first."""
    nodes = spark.createDataFrame([(k,) for k in range(7)], "idx long")
    return relational.keep_first_independent(nodes, spark.createDataFrame([(k, k + 1) for k in range(6)], "earlier long, later long"))


_LINES = " ".join(f"word{k}" for k in range(100))


@expected([(1,), (3,), (6,)], "doc_id long")
def fuzzy_dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies, reordered copies and copies of what went; other texts stay."""
    other = " ".join(f"else{k}" for k in range(100))
    rows = [(1, _LINES), (2, _LINES.replace("word99", "zz")), (3, other), (4, " ".join(reversed(_LINES.split()))), (5, other.upper()), (6, "short")]
    return relational.fuzzy_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).select("doc_id")


@expected([(1,), (3,)], "doc_id long")
def ratio_dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "the quick brown fox"), (2, "the quick brown foxes"), (3, "a very different text"), (4, "The Quick Brown Fox")]
    return relational.ratio_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id")


@expected([(1, "The city shelter needs support and more housing", "HOPEFUL"), (2, "Public safety downtown is ruining everything here", "HATE"), (3, "A report about the park and the budget of it", "NEUTRAL")], "sample_id int, text string, stance string")
def constructed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, both stages, quotas, and results as CSV by status; settings as they come from a command line."""
    settings = pipelines.settings(["--samples-per-class", "1", "--budget", "5"])
    posts = [(k, "VAST", str(k), p, s) for k, (p, s) in enumerate([("The city shelter needs support and more housing", "FAVOR"), ("Public safety downtown is ruining everything here", "AGAINST"), ("A report about the park and the budget of it", "NONE"), ("Homeless people deserve dignity and support now", "FAVOR")])]
    rows = _frame(spark, posts, "row_idx long, dataset, id, text, stance")
    pool = pipelines.candidates(rows, None, pipelines.Selection(keywords=())).drop("stance")
    out = scratch(spark, "routed")
    io.write_routed(pipelines.construct(pool, generation.RuleBackend(), quotas=settings.quotas, budget=settings.budget), out)
    done = io.read_results(spark, f"{out}/_route=accepted")
    return done.select(F.col("sample_id").cast("int").alias("sample_id"), F.col("original_text").alias("text"), "stance")


# --- sources and sinks over whole tables ----------------------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS doc_id, md5(text) AS digest, lang FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang").write.option("header", True).option("escape", '"').csv(path)
    return io.read_csv(spark, path, ["doc_id", "text", "lang"]).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("SELECT 0::BIGINT AS n")
def missing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result file that is not there is a table without rows."""
    return io.read_results(spark, scratch(spark, "none")).agg(F.count("*").alias("n"))


_ROUTED = "SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'repaired' WHEN 2 THEN 'review' ELSE 'failed' END AS status FROM events"


@query(f"SELECT status, count(*) AS n, sum(event_id)::BIGINT AS ids FROM ({_ROUTED}) WHERE status <> 'failed' GROUP BY status")
def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by status in files that grow by appending."""
    path = scratch(spark, "routed")
    status = F.element_at(F.array(*map(F.lit, ("accepted", "repaired", "review", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", status.alias("status"))
    io.write_routed(rows.filter("event_id % 8 < 4"), path)
    io.write_routed(rows.filter("event_id % 8 >= 4"), path)
    back = spark.read.option("header", True).csv(path).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("event_id").cast("long")).alias("ids"))
    return back


@query(f"SELECT event_type AS label, count_if(status IN ('accepted', 'repaired'))::BIGINT AS emitted, round(count(*) * 0.25, 6)::DOUBLE AS cost FROM ({_ROUTED}) GROUP BY event_type")
def state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, labels and costs of processed rows, written and read by a later run."""
    path = scratch(spark, "state")
    status = F.element_at(F.array(*map(F.lit, ("accepted", "repaired", "review", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("stance"), status.alias("status"), F.lit("0.25").alias("cost_usd"))
    io.save_state(rows, path, key=F.col("event_id").cast("string"), text_key=strings.text_key(F.col("event_id").cast("string")))
    return io.state_summary(io.load_state(spark, path)).withColumn("cost", F.round("cost", 6))


@query("SELECT lang AS stance, count(*) AS n FROM documents GROUP BY lang")
def final_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "final")
    io.write_final(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("stance")), path)
    return io.read_csv(spark, path, ["doc_id", "stance"], line_ends=False).groupBy("stance").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en'")
def cached_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made and written once; the second reading makes nothing."""
    path = scratch(spark, "cache")
    io.cached(spark, path, lambda: table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "source"))
    return io.cached(spark, path, lambda: table(spark, sf_dir, "nothing"))


@query("SELECT text_hash, n FROM (SELECT DISTINCT sha256(text) AS text_hash, length(text)::FLOAT AS n FROM documents) WHERE text_hash NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de')")
def embedding_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a store of embeddings does not have yet, each embedded once by its content; here, by its length."""
    docs = table(spark, sf_dir, "documents")
    store = docs.filter("lang = 'de'").select(F.sha2("text", 256).alias("text_hash")).distinct()
    made = semantic.embed(semantic.missing_embeddings(docs, store), lambda texts: np.array([[len(t)] for t in texts]))
    return made.select("text_hash", F.get("embedding", F.lit(0)).alias("n"))


@query(f"{_GRAMS} SELECT n, gram, cnt FROM c WHERE cnt >= 3")
def ngram_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts without the rare ones, as lines of words and a count, and back."""
    path = scratch(spark, "ngrams")
    io.write_ngrams(ngram_stats.pruned(ngram_stats.count_ngrams(table(spark, sf_dir, "documents"))), path)
    return io.read_ngrams(spark, path)


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) GROUP BY line")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    table(spark, sf_dir, "conversations").select("text").write.text(path)
    return io.read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def json_line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "json")
    table(spark, sf_dir, "conversations").write.json(path)
    return io.read_json_lines(spark, path, "conv_id long, turn long, text string").select("conv_id", "turn", F.md5("text").alias("digest"))


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 200")
def judge_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.seeded_subset(table(spark, sf_dir, "documents"), 200, key="doc_id", seed=7).select("doc_id")


_LONG = "long " * 10
cases("page_gists", "x string", [("<title>T</title><p>short</p><p>" + _LONG + "</p>", "T " + _LONG.strip()), ("<p>" + _LONG + "</p>", _LONG.strip()), ("<title> only </title>", "only"), ("", ""), (None, "")], io.page_gist)


@expected([(1, f"housing shelter [T {_LONG.strip()}] end"), (2, "nothing  end"), (3, None)], "row_idx int, text string")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are fetched once for each link that matters; what cannot be had is deleted with the others."""
    pages = {"https://a.b/c": f"<title>T</title><p>short</p><p>{_LONG}</p>"}
    rows = _frame(spark, [(1, "housing shelter https://a.b/c end"), (2, "nothing https://a.b/c end"), (3, None)], "row_idx int, text")
    wanted = _frame(spark, [("https://a.b/c",), ("https://gone.example/x",)], "url")
    return io.resolve_links(rows, io.fetched(wanted, "url", "html", pages.__getitem__))


@expected([(1, "hi Me Myself and @you")], "row_idx int, text string")
def resolved_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = io.fetched(_frame(spark, [("me",), ("you",)], "handle"), "handle", "name", {"me": "Me Myself"}.__getitem__).filter("name is not null")
    return io.resolve_mentions(_frame(spark, [(1, "hi @me and @you")], "row_idx int, text"), profiles)


@expected([("rn", "right now"), ("w/", "with")], "word string, meaning string")
def slang_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slang dictionary as tab-parted lines, used for whatever it holds."""
    path = scratch(spark, "slang")
    _frame(spark, [("rn\tright now",), ("w/\twith",), ("no meaning",)], "value").write.text(path)
    known = io.read_dictionary(spark, path)
    words = _frame(spark, [("rn",), ("w/",)], "word")
    return words.select("word", F.get(strings.replace_tokens(F.array("word"), known), F.lit(0)).alias("meaning"))


# --- judgment distributions -----------------------------------------------------------------------------------------------

_TWO = "p array<double>, q array<double>"


def judged(name: str, rows: list[tuple], make: Callable[[], Column], kind: str = "double") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(rows)], f"case_id int, {_TWO}")
        made = make()
        return data.select("case_id", (F.round(made, 6) if kind == "double" else F.array_join(F.transform(made, lambda x: F.format_string("%.3f", x)), " ")).alias("result"))

    run.__name__ = name
    query(listed([(k, r[2]) for k, r in enumerate(rows)], f"case_id int, result {kind}"))(run)


_A, _B = [0.4, 0.4, 0.2], [0.1, 0.2, 0.7]
_SURE, _EVEN, _NAN = [1.0, 0.0, 0.0], [0.25, 0.5, 0.25], [float("nan")] * 3
judged("judge_mode_lead", [(_A, _B, -1.0), (_B, _A, 1.0), (_A, _A, 0.0)], lambda: judgment.compare_modes("p", "q"))
judged("judge_split_mode", [(_A, _B, 0.25), (_B, _A, 1.0)], lambda: judgment.mode("p", split_ties=True))
judged("judge_rounded_mean", [([0.5, 0.5, 0.0], _B, 0.0), (_B, _A, 1.0), ([0.0, 0.5, 0.5], _A, 1.0)], lambda: judgment.rounded_mean("p"))
judged("judge_median_lead", [(_A, _B, -1.0), (_B, _A, 1.0)], lambda: judgment.compare_medians("p", "q"))
judged("judge_low_lead", [(_A, _B, 0.0), ([0.0, 0.5, 0.5], _A, 1.0)], lambda: judgment.compare_lower_percentiles("p", "q"))
judged("judge_quantile_lead", [(_A, _B, -0.7), (_A, _A, 0.0), (_SURE, [0.0, 0.0, 1.0], -1.0)], lambda: judgment.compare_quantiles("p", "q"))
# two coins: the mean of even is 0.5, squares from it 0.25 * 0.25 on each side
judged("judge_deviation", [(_EVEN, _B, round(0.125**0.5, 6)), (_SURE, _B, 0.0)], lambda: judgment.deviation("p"))
judged("judge_semi_deviation", [(_EVEN, _B, round(0.0625**0.5, 6)), (_SURE, _B, 0.0)], lambda: judgment.semi_deviation("p"))
# sure 0 against sure 1: the difference is -1 always; against itself there is nothing to divide by
judged("judge_risk_averse", [(_SURE, [0.0, 0.0, 1.0], -1.0), (_SURE, _SURE, 0.0)], lambda: judgment.compare_risk_averse("p", "q"))
judged("judge_ranking", [([0.5, 0.5 + 1e-9], _B, "0.000 1.000 0.000"), (_NAN, _B, "0.000 1.000 0.000"), ([0.7, 0.3], _B, "0.700 0.000 0.300")], lambda: judgment.ranking_distribution("p"), "string")
judged("judge_scores", [(_A, _B, "0.000 0.000 0.100 0.200 0.700"), (_B, _A, "0.400 0.400 0.200 0.000 0.000"), (_NAN, _A, "0.000 0.000 1.000 0.000 0.000")], lambda: judgment.score_difference("p", "q"), "string")
# the first order is sure of the first option, the second order of its own second one: the same option both times
_FIRST, _LAST, _TIE = [1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 1.0, 0.0]
for _name, _values in {"mode_s1": (1.0, 0.0, 0.0), "mode_s2": (1.0, 0.0, 0.0), "medi_s1": (1.0, 0.0, 0.0), "medi_s2": (1.0, 0.0, 0.0), "mean_s1": (1.0, 0.0, 0.0), "mean_s2": (1.0, 0.0, 0.0)}.items():
    judged(f"judge_pairwise_{_name}", [(_FIRST, _LAST, _values[0]), (_FIRST, _FIRST, _values[1]), (_TIE, _TIE, _values[2])], lambda n=_name: judgment.pairwise_predictions("p", "q")[n])


@query(f"""WITH d AS ({_JUDGED}), m AS (SELECT vec_id, p, q, {_MEAN.format("p")} AS m, {_MEAN.format("q")} AS w FROM d)
  SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 6), lambda i: p[i] * power(m - (i - 1) / 4.0, 2)))), 6)::DOUBLE AS spread, round(sqrt(list_sum(list_transform(range(1, 6), lambda i: p[i] * power(greatest(m - (i - 1) / 4.0, 0), 2)))), 6)::DOUBLE AS below FROM m""")
def judge_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("vec_id", F.round(judgment.deviation("p"), 6).alias("spread"), F.round(judgment.semi_deviation("p"), 6).alias("below"))


@query(f"WITH d AS ({_JUDGED}) SELECT vec_id, sign(list_position(p, list_max(p)) - list_position(q, list_max(q)))::DOUBLE AS lead FROM d")
def judge_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("vec_id", judgment.compare_modes("p", "q").alias("lead"))


@query(f"""WITH d AS ({_JUDGED}), x AS (SELECT vec_id, unnest(range(1, 6)) AS i, p, q FROM d), y AS (SELECT vec_id, i, unnest(range(1, 6)) AS j, p, q FROM x), m AS (SELECT vec_id, p, q, {_MEAN.format("p")} AS a, {_MEAN.format("q")} AS b FROM d),
  s AS (SELECT vec_id, a, b, sqrt(list_sum(list_transform(range(1, 6), lambda i: p[i] * power(greatest(a - (i - 1) / 4.0, 0), 2)))) - sqrt(list_sum(list_transform(range(1, 6), lambda i: q[i] * power(greatest(b - (i - 1) / 4.0, 0), 2)))) AS off FROM m),
  z AS (SELECT y.vec_id, p[i] * q[j] AS w, (i - j) / 4.0::DOUBLE AS g, s.off, s.a - s.b AS gap FROM y JOIN s USING (vec_id)), e AS (SELECT vec_id, any_value(off) AS off, any_value(gap) AS gap, sum(w * abs(g - off)) AS n, sum(w * g * g) AS sq FROM z GROUP BY vec_id)
  SELECT vec_id, round(CASE WHEN n + sqrt(greatest(sq - gap * gap, 0)) > 1e-3 THEN (gap - off) / (n + sqrt(greatest(sq - gap * gap, 0))) ELSE 0 END, 6)::DOUBLE AS lead FROM e""")
def judge_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("vec_id", F.round(judgment.compare_risk_averse("p", "q"), 6).alias("lead"))


@query(f"""WITH d AS ({_JUDGED}), s AS (SELECT vec_id, unnest(list_transform(range(1, 5), lambda i: list_sum(p[1:i]))) AS x, 1 AS d FROM d UNION ALL SELECT vec_id, unnest(list_transform(range(1, 5), lambda i: list_sum(q[1:i]))), -1 FROM d),
  w AS (SELECT vec_id, x - (lag(x) OVER o) AS gap, (sum(d) OVER o) - d AS lead FROM s WINDOW o AS (PARTITION BY vec_id ORDER BY x, d ROWS UNBOUNDED PRECEDING)) SELECT vec_id, round(sum(sign(lead) * coalesce(gap, 0)), 6)::DOUBLE AS lead FROM w GROUP BY vec_id""")
def judge_quantile_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("vec_id", F.round(judgment.compare_quantiles("p", "q"), 6).alias("lead"))


# --- streams and SQL ---------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = table(spark, sf_dir, name)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch(spark, "stream")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _run(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """What a stream gives until its input ends, as a table."""
    out, checkpoint = scratch(spark, "streamed"), scratch(spark, "offsets")
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT event_type, strftime(make_timestamp((floor(epoch(ts::TIMESTAMP) / 300)::BIGINT * 300) * 1000000), '%Y-%m-%d %H:%M') AS starts, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _run(stateful.windowed_counts(_stream(spark, sf_dir, "events"), "event_type"), spark, "complete")
    return counted.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("starts"), "n")


@query("SELECT count(DISTINCT lower(trim(props))) AS n FROM events")
def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text comes once, whichever of its rows is first, if the delay is longer than the table."""
    return _run(stateful.unique(_stream(spark, sf_dir, "events"), text="props", delay="36500 days"), spark, "append").agg(F.count("*").alias("n"))


@query("SELECT event_type, least(count(DISTINCT user_id), 25)::BIGINT AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def stream_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = _run(stateful.first_by_quota(_stream(spark, sf_dir, "events"), label="event_type", key="user_id", quotas={"click": 25, "view": 25}), spark, "append")
    return taken.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))


@expected([(round(200 * 2 / 6, 6), 100.0, "Big shelter", 0.75)], "ratio double, part double, span string, sequence double")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    similarity.register(spark)
    return spark.sql("SELECT round(indel_ratio('abc', 'abd'), 6) AS ratio, partial_ratio('abc', 'xxabcxx') AS part, closest_span('big shelterz', 'A Big shelter is here') AS span, sequence_similarity('abcd', 'bcde') AS sequence")
