"""Social text: tokenizer, hashtag segmentation, spelling, negation, sentiment and emotion.

Language statistics come from ngram_stats; they are bounded tables that are sent to the workers.  Segmentation and
correction work on distinct words, each once, and are joined back.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log10

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.patterns import CONTRACTIONS, TOKEN_ORDER, compiled
from ..functions.strings import column

#: Terms that each switch of the tokenizer turns on.
SWITCHES = {
    "urls": ("url",), "tags": ("tag",), "emails": ("email",), "users": ("user",), "hashtags": ("hashtag",), "cashtags": ("cashtag",), "phones": ("phone",), "percents": ("percent",), "money": ("money",),
    "date": ("date",), "time": ("time",), "acronyms": ("acronym",), "emoticons": ("ltr_face", "rtl_face", "rest_emoticons", "eastern_emoticons"), "censored": ("censored",), "emphasis": ("emphasis",), "numbers": ("number",), "emojis": ("emoji",),
}


@lru_cache(maxsize=32)
def token_pattern(terms: tuple[str, ...]) -> re.Pattern[str]:
    """Any of the terms, tried in order, or else any character that is no white space."""
    return re.compile("|".join([f"(?:{compiled(t).pattern})" for t in terms] + [r"\S"]))


def terms_for(**switches: bool) -> tuple[str, ...]:
    off = {t for name, terms in SWITCHES.items() if not switches.get(name, True) for t in terms}
    return tuple(t for t in TOKEN_ORDER if t not in off)


def tokenize(text: str, *, lowercase: bool = False, terms: tuple[str, ...] = TOKEN_ORDER) -> list[str]:
    found = [m[0] for m in token_pattern(terms).finditer(html.unescape(text))]
    return [t.lower() for t in found] if lowercase else found


def tokens(text: Column | str, *, lowercase: bool = False, terms: tuple[str, ...] | None = None, **switches: bool) -> Column:
    """The tokens of a text; terms gives an order of one's own, switches leave terms out."""
    chosen = terms or terms_for(**switches)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else tokenize(x, lowercase=lowercase, terms=chosen))

    return cut(column(text))


def cased(model: str) -> Callable[[str], str]:
    """The function that gives a word the case of the model."""
    return str.upper if model.isupper() else str.lower if model.islower() else str.title if model.istitle() else str


@dataclass
class Statistics:
    """Counts of words and of pairs (joined by _), and what is read from them."""

    unigrams: dict[str, int]
    bigrams: dict[str, int] = field(default_factory=dict)
    longest: int = 20
    unknown: Callable[[str, int], float] | None = None
    _memo: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.total = max(sum(self.unigrams.values()), 1)

    def probability(self, word: str) -> float:
        count = self.unigrams.get(word)
        if count is not None:
            return count / self.total
        return self.unknown(word, self.total) if self.unknown else 10.0 / self.total / 10.0 ** len(word)

    def after(self, word: str, before: str) -> float:
        """Probability of a word after another; of the word alone where the pair is not known."""
        pair = self.bigrams.get(f"{before}_{word}")
        if pair is None or before not in self.unigrams:
            return self.probability(word)
        return pair / self.unigrams[before]

    def segment(self, word: str) -> str:
        """The likeliest split of a lower-case word; words of mixed case are split at capitals and lower-cased."""
        if not word.islower():
            return compiled("camel_split").sub(r" \1", word).lower()
        done = self._memo.get(word)
        if done is None:
            if len(self._memo) > 65_536:
                self._memo.clear()
            done = self._memo[word] = " ".join(self._split(word))
        return done

    def _split(self, word: str) -> list[str]:
        # best[i][p]: the likeliest words of word[i:] when p is the word before; from the end, so no recursion
        n = len(word)
        best: list[dict[str, tuple[float, list[str]]]] = [{} for _ in range(n + 1)]
        for i in range(n, -1, -1):
            befores = ["<S>"] if i == 0 else [word[j:i] for j in range(max(0, i - self.longest), i)]
            for before in befores:
                if i == n:
                    best[i][before] = (0.0, [])
                    continue
                options = []
                for k in range(i + 1, min(n, i + self.longest) + 1):
                    head, (score, rest) = word[i:k], best[k][word[i:k]]
                    options.append((log10(self.after(head, before)) + score, [head, *rest]))
                best[i][before] = max(options)
        return best[0]["<S>"][1]

    @staticmethod
    def edits(word: str) -> set[str]:
        """What one deletion, transposition, replacement or insertion of a-z makes of a word."""
        cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
        letters = [chr(c) for c in range(97, 123)]
        out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        return out | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}

    def known(self, words: set[str]) -> set[str]:
        return {w for w in words if w in self.unigrams}

    def correct(self, word: str, *, assume_wrong: bool = False, fast: bool = False) -> str:
        """The likeliest known word: the word itself, one edit away, two edits away; the first that there is."""
        found: set[str] = set() if assume_wrong else self.known({word})
        near = self.edits(word) if not found else set()
        found = found or self.known(near)
        if not found and not fast:
            found = self.known({e for w in near for e in self.edits(w)})
        return max(sorted(found or {word}), key=self.probability)

    def correct_cased(self, word: str, **options: bool) -> str:
        return cased(word)(self.correct(word.lower(), **options))

    def correct_text(self, text: str) -> str:
        return re.sub("[a-zA-Z]+", lambda m: self.correct_cased(m[0]), text)

    def shorten(self, word: str) -> str:
        """A word with long runs of letters, with doubled letters made single where that makes the likeliest known word."""
        low, seen, todo = word.lower(), set(), [word.lower()]
        while todo:
            w = todo.pop()
            for c in sorted({c for c in w if w.count(c) > 1}):
                shorter = w.replace(c + c, c)
                if shorter not in seen:
                    seen.add(shorter)
                    todo.append(shorter)
        found = self.known(seen | {low})
        return cased(word)(max(sorted(found), key=self.probability) if found else low)


@dataclass
class Preprocessor:
    """Normalises, annotates and tokenizes social text; the steps come in a fixed order."""

    normalize: tuple[str, ...] = ()
    omit: tuple[str, ...] = ()
    annotate: frozenset[str] = frozenset()
    statistics: Statistics | None = None
    unpack_hashtags: bool = False
    unpack_contractions: bool = False
    correct_elongated: bool = False
    caps: str = "wrap"
    fast: bool = False
    remove_tags: bool = False
    terms: tuple[str, ...] | None = TOKEN_ORDER
    lowercase: bool = False
    dictionaries: tuple[dict[str, str], ...] = ()
    repair: Callable[[str], str] | None = None

    def _tagged(self, text: str, name: str, mode: str = "single") -> str:
        if mode == "wrap":
            return f" <{name}> {text} </{name}>  "
        if mode == "every":
            return " " + " ".join(f" {t} <{name}> " for t in text.split()) + " "
        return f" {text} <{name}> "

    def _hashtag(self, m: re.Match[str]) -> str:
        body = m[0][1:]
        if body.islower():
            words = (self.statistics.segment(body) if self.statistics else body).replace("-", " ").replace("_", " ")
        else:
            words = compiled("camel_split").sub(r" \1", body).replace("-", "").replace("_", "")
        return self._tagged(words, "hashtag", "wrap") if "hashtag" in self.annotate else words

    def _elongated(self, m: re.Match[str]) -> str:
        word = compiled("normalize_elong").sub(r"\1\1", m[0])
        if self.statistics:
            word = self.statistics.shorten(word)
            if self.correct_elongated:
                word = self.statistics.correct_cased(word, assume_wrong=True, fast=True)
        return self._tagged(word, "elongated")

    def text(self, doc: str) -> str:
        """The steps on the whole string."""
        doc = re.sub(" +", " ", doc)
        if self.repair:
            doc = self.repair(doc)
        for name in self.normalize:
            doc = compiled(name).sub(f" <{name}> ", doc)
        for name in self.omit:
            doc = doc.replace(f"<{name}>", "")
        if self.unpack_hashtags and "hashtag" not in (*self.omit, *self.normalize):
            doc = compiled("hashtag").sub(self._hashtag, doc)
        if not self.fast:
            steps = {
                "allcaps": lambda m: self._tagged(m[0], "allcaps", self.caps),
                "elongated": self._elongated,
                "repeated": lambda m: self._tagged("".join(sorted(set(m[0]), reverse=True)), "repeated"),
                "emphasis": lambda m: self._tagged(m[0].replace("*", ""), "emphasis"),
                "censored": lambda m: self._tagged(m[0], "censored", "every"),
            }
            for name, step in steps.items():
                if name in self.annotate:
                    doc = compiled("repeat_puncts" if name == "repeated" else name).sub(step, doc)
        if self.unpack_contractions:
            for pattern, full in CONTRACTIONS:
                doc = re.sub(pattern, rf"\g<1>{full}", doc)
        if self.remove_tags:
            doc = " ".join(w for w in doc.split() if not w.startswith("<"))
        return doc

    def __call__(self, doc: str) -> list[str] | str:
        words = without_caps_in_hashtags(self.text(doc).split())
        if self.terms is None:
            return " ".join(words)
        found = tokenize(" ".join(words), lowercase=self.lowercase, terms=self.terms)
        for table in self.dictionaries:
            found = [table.get(t, t) for t in found]
        return found

    def udf(self) -> Callable[[Column], Column]:
        """A function of a text column to the tokens, joined by single spaces."""

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            def one(x: str | None) -> str | None:
                if x is None:
                    return None
                out = self(x)
                return out if isinstance(out, str) else " ".join(out)

            return texts.map(one)

        return run


def without_caps_in_hashtags(words: list[str]) -> list[str]:
    """Tags of capitals go where a hashtag is open."""
    inside, out = False, []
    for w in words:
        inside = w == "<hashtag>" or inside and w != "</hashtag>"
        if not (inside and w in ("<allcaps>", "</allcaps>")):
            out.append(w)
    return out


def map_words(rows: DataFrame, col: str, out: str, f: Callable[[str], str]) -> DataFrame:
    """rows with f of a column of words; f runs once for each distinct word."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_w": batch["_w"], "_f": batch["_w"].map(f)})

    each = rows.select(F.col(col).alias("_w")).filter("_w is not null").distinct().mapInPandas(apply, "_w string, _f string")
    return rows.join(each, F.col(col) == F.col("_w"), "left").withColumnRenamed("_f", out).drop("_w")


def negated(words: list[str], *, commas: bool = True, modals: bool = True) -> list[int]:
    """Positions inside a negation.  Without commas nothing but contrasts closes a negation, and without modals nothing
    opens one; brackets have a state of their own."""
    stops = (lexicons.NEGATION_STOPS | {","} if commas else frozenset()) | lexicons.CONTRASTS
    starts = lexicons.NEGATIONS | lexicons.NEGATED_MODALS if modals else frozenset()
    state, place, out = [False, False], 0, []
    for i, w in enumerate(words):
        if w in starts:
            state[place] = True
        elif w in stops:
            state[place] = False
        elif w == "(":
            place = 1
        elif w == ")":
            state[1], place = False, 0
        elif state[place]:
            out.append(i)
    return out


def negation_positions(words: Column | str, *, commas: bool = True, modals: bool = True) -> Column:
    @F.pandas_udf("array<int>")
    def find(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else negated(list(x), commas=commas, modals=modals))

    return find(column(words))


def polarity(rows: DataFrame, lexicon: DataFrame, *, words: str = "words", key: str = "doc_id") -> DataFrame:
    """key, pos, neg, obj and polarity: means of a lexicon's scores (word, pos, neg, obj) over the words it has;
    positive and negative change places inside a negation."""
    flat = rows.select(key, negation_positions(words).alias("_n"), F.posexplode(words).alias("_i", "_w"))
    scored = flat.join(lexicon, F.col("_w") == F.col("word")).withColumn("_turned", F.array_contains("_n", F.col("_i")))
    pos, neg = F.when(F.col("_turned"), F.col("neg")).otherwise(F.col("pos")), F.when(F.col("_turned"), F.col("pos")).otherwise(F.col("neg"))
    return scored.groupBy(key).agg(F.avg(pos).alias("pos"), F.avg(neg).alias("neg"), F.avg("obj").alias("obj")).withColumn("polarity", F.col("pos") - F.col("neg"))


# The emotions of the lexicon, in the order of its vectors.
EMOTIONS = ["fear", "sadness", "trust", "disgust", "surprise", "anger", "joy", "anticipation"]


def emotion_lexicon(long: DataFrame) -> DataFrame:
    """word, each emotion, polarity and the vector of emotions, from rows (word, emotion, score)."""
    wide = long.groupBy("word").pivot("emotion", [*EMOTIONS, "positive", "negative"]).agg(F.first("score"))
    filled = wide.na.fill(0.0)
    sign = F.when(F.col("positive") > 0, 1).when(F.col("negative") > 0, -1).otherwise(0)
    return filled.withColumn("polarity", sign).withColumn("emotions", F.array(*EMOTIONS))


def emotions(rows: DataFrame, lexicon: DataFrame, *, words: str = "words", key: str = "doc_id") -> DataFrame:
    """key, word and the lexicon's entry for every word that it has."""
    return rows.select(key, F.explode(words).alias("_w")).join(lexicon, F.col("_w") == F.col("word")).drop("_w")
