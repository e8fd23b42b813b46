"""The cleaning chain for social posts, step by step; every step is a column of text to a column of text.

Everything but HTML references and emoji names stays in the JVM.  The order of clean_text() matters.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicons
from .strings import blank, column, literal_map, squeeze, strip, words

# What counts as a deleted post, a link, a mention and repeated content.
DELETED = r"(?iU)^\s*\[(deleted|removed)\]\s*$"
LINK = r"""(?iU)https?://[^\s<>"']+|www\.[^\s<>"']+"""
MENTION = r"(?U)@[\w]+"
REPEATED_CHARS = r"(?d)(.)\1{2,}"
REPEATED_WORDS = r"(?iuU)\b(\w+)(\s+\1){1,}\b"
REPEATED_PUNCTUATION = r"([!?.]){2,}"
NUMBER = r"(?U)\b\d+\b"
LEAST_LENGTH = 20


def empty_or_deleted(text: Column | str) -> Column:
    """True for blank text and for posts that say only [deleted] or [removed]."""
    t = column(text)
    return blank(t) | F.coalesce(t.rlike(DELETED), F.lit(False))


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x))


def unescape_html(text: Column | str) -> Column:
    """Character references become characters; texts without an & stay in the JVM."""
    t = column(text)
    some = F.contains(t, F.lit("&"))
    return F.when(some, _unescaped(F.when(some, t))).otherwise(t)


# What the bytes of UTF-8 quotes, dashes and dots look like when they are read as Windows-1252, and ligatures.
MISREAD = {"â€™": "’", "â€˜": "‘", "â€œ": "“", "â€\x9d": "”", "â€“": "–", "â€”": "—", "â€¦": "…", "Ã©": "é", "Ã¨": "è", "Ã¼": "ü", "Ã¶": "ö", "Ã¤": "ä", "Ã±": "ñ", "Â\xa0": " "}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"'}


def repair_plainly(text: Column | str) -> Column:
    """A repair for clean_text(repair=...) where no library for encodings is at hand: common misread sequences, then
    ligatures and curly quotes, become what they stand for."""
    out = column(text)
    for wrong, right in (MISREAD | LIGATURES).items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return F.translate(out, "".join(QUOTES), "".join(QUOTES.values()))


@F.pandas_udf(T.StringType())
def name_emoji(text: pd.Series) -> pd.Series:
    """Symbols outside the letters become ` name `, from their Unicode names."""

    def named(x: str | None) -> str | None:
        if x is None or x.isascii():
            return x
        return "".join(f" {unicodedata.name(c, 'symbol').lower().replace(' ', '_')} " if unicodedata.category(c) == "So" else c for c in x)

    return text.map(named)


def drop_controls(text: Column | str) -> Column:
    """Without characters of the categories C, but for line feeds and tabs."""
    return F.regexp_replace(column(text), r"[\p{C}&&[^\n\t]]", "")


def drop_links(text: Column | str) -> Column:
    return F.regexp_replace(column(text), LINK, "")


def links(text: Column | str) -> Column:
    return F.regexp_extract_all(column(text), F.lit(LINK), F.lit(0))


def link_importance(link: Column | str, text: Column | str, keywords: list[str] | None = None) -> Column:
    """0.15 for each keyword that is in the text or the link, 1 at most."""
    both = F.lower(F.concat(column(text), F.lit(" "), column(link)))
    found = [F.when(F.contains(both, F.lit(k.lower())), F.lit(1)).otherwise(F.lit(0)) for k in keywords or lexicons.URL_KEYWORDS]
    return F.least(sum(found, F.lit(0)) * F.lit(0.15), F.lit(1.0))


def drop_mentions(text: Column | str) -> Column:
    """Whole mentions go, also where one begins another."""
    return F.regexp_replace(column(text), MENTION, "")


def drop_hash_signs(text: Column | str) -> Column:
    return F.regexp_replace(column(text), r"(?U)#(\w+)", "$1")


def expand_abbreviations(text: Column | str, slang: dict[str, str] | None = None, acronyms: dict[str, str] | None = None) -> Column:
    """Words that are abbreviations but for outer punctuation become what they stand for, slang before acronyms."""
    pairs = (acronyms if acronyms is not None else lexicons.ACRONYMS) | (slang if slang is not None else lexicons.SLANG)

    def expanded(token: Column) -> Column:
        # a map is searched from end to end, so only words that are in it are looked up
        return F.get(F.transform(F.array(F.btrim(F.lower(token), F.lit(".,!?;:()"))), lambda w: F.when(w.isin(*pairs), F.try_element_at(literal_map(pairs), w)).otherwise(token)), F.lit(0))

    return F.array_join(F.transform(words(text), expanded), " ")


def drop_numbers(text: Column | str) -> Column:
    return F.regexp_replace(column(text), NUMBER, "")


def squeeze_chars(text: Column | str) -> Column:
    return F.regexp_replace(column(text), REPEATED_CHARS, "$1$1")


def squeeze_words(text: Column | str) -> Column:
    return F.regexp_replace(column(text), REPEATED_WORDS, "$1")


def squeeze_punctuation(text: Column | str) -> Column:
    """A run of ! ? . becomes its last character."""
    return F.regexp_replace(column(text), REPEATED_PUNCTUATION, "$1")


def unique_sentences(text: Column | str) -> Column:
    """Each sentence once, by its text without case and outer white space; joined by single spaces."""
    # sorted by key and place, the first of each run of equal keys stays; the lambdas see their arguments only, so that
    # the text may come from an Arrow function
    parts = F.split(column(text), r"(?U)(?<=[.!?])\s+")
    keyed = F.array_sort(F.transform(parts, lambda s, i: F.struct(F.lower(strip(s)).alias("key"), i.alias("at"), s.alias("sentence"))))
    firsts = F.get(F.transform(F.array(keyed), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["key"] != x["key"]))), F.lit(0))
    return F.array_join(F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["at"].alias("at"), x["sentence"].alias("sentence")))), lambda x: x["sentence"]), " ")


def squeeze_repeats(text: Column | str) -> Column:
    return unique_sentences(squeeze_punctuation(squeeze_words(squeeze_chars(text))))


def long_enough(text: Column | str, least: int = LEAST_LENGTH) -> Column:
    return F.char_length(column(text)) >= least


#: Words that are common in one language and in none of the others here.
COMMON = {
    "en": ("the", "of", "and", "to", "is", "it", "that", "for", "on", "with", "are", "be", "this", "you", "not", "have", "they", "from", "we", "my"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "mit", "auf", "für", "ich", "sie", "von", "dem", "auch", "wir", "sich"),
    "fr": ("le", "les", "et", "est", "une", "dans", "pour", "pas", "sur", "avec", "qui", "ce", "au", "je", "vous", "nous", "mais", "sont", "il", "elle"),
    "es": ("el", "los", "las", "y", "una", "por", "con", "para", "está", "pero", "como", "más", "muy", "lo", "del", "al", "sus", "yo", "ella", "hay"),
    "it": ("il", "gli", "di", "che", "per", "sono", "della", "nel", "anche", "più", "questo", "ma", "alla", "dei", "ho", "è", "ci", "mi", "ti", "lei"),
    "pt": ("o", "os", "um", "uma", "não", "em", "do", "da", "com", "mais", "mas", "ao", "isso", "ele", "ela", "eu", "você", "são", "também", "foi"),
    "nl": ("het", "een", "van", "ik", "je", "niet", "dat", "zijn", "op", "te", "met", "voor", "ook", "maar", "wij", "hij", "zij", "naar", "bij", "wat"),
}


def common_words(text: Column | str, language: str) -> Column:
    """How many words of a text are common ones of a language."""
    tokens = F.transform(words(text), lambda w: F.regexp_replace(F.lower(w), r"(?U)^\W+|\W+$", ""))
    return F.size(F.filter(tokens, lambda w: w.isin(*COMMON[language])))


def in_common_words(language: str = "en", share: float = 0.1) -> Callable[[Column], Column]:
    """A test for clean_text(in_language=...): keeps texts with enough common words of the language, and no more of any
    other, and those too short to tell."""

    def test(text: Column) -> Column:
        own = common_words(text, language)
        others = [common_words(text, k) for k in COMMON if k != language]
        return (F.size(words(text)) < 4) | (own >= share * F.size(words(text))) & (own >= F.greatest(*others))

    return test


def clean_text(text: Column | str, *, unescape: bool = True, emoji: bool = False, social: Callable[[Column], Column] | None = None, repair: Callable[[Column], Column] | None = None, numbers: bool = True, repeats: bool = True, abbreviations: bool = True, least: int = LEAST_LENGTH, in_language: Callable[[Column], Column] | None = None) -> Column:
    """The cleaned text, or null where nothing usable is left.

    repair mends broken encodings, social is the social preprocessor, in_language a test of the cleaned text; each is
    left out where none is given.
    """
    t = column(text)
    out = repair(t) if repair else t
    if unescape:
        out = unescape_html(out)
    out = drop_mentions(drop_links(drop_controls(out)))
    if emoji:
        out = name_emoji(out)
    if social:
        out = social(out)
    out = drop_hash_signs(out)
    if abbreviations:
        out = expand_abbreviations(out)
    if numbers:
        out = drop_numbers(out)
    if repeats:
        out = squeeze_repeats(out)
    out = squeeze(out)
    # bound to a lambda's argument, the cleaned text is computed once for the test and the result
    out = F.get(F.transform(F.array(out), lambda o: F.when(long_enough(o, least), o)), F.lit(0))
    keep = ~empty_or_deleted(t)
    if in_language:
        keep &= in_language(out)
    return F.when(keep, out)


def cleaned_rows(rows: DataFrame, text: str = "text", out: str = "cleaned_text", **options: object) -> DataFrame:
    """rows with their cleaned text, without those that cleaning drops.  A generator holds the text, so that it is
    computed once for the test and the result."""
    return rows.select("*", F.explode(F.array_compact(F.array(clean_text(text, **options)))).alias(out))
