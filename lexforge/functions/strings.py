"""String helpers with the white space and letters of Unicode; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(column(x), r"(?U)^\s+|\s+$", "")


def words(x: Column | str) -> Column:
    """Runs between white space, without empty ones."""
    return F.filter(F.split(column(x), r"(?U)\s+"), lambda w: w != "")


def squeeze(x: Column | str) -> Column:
    """White space made single spaces, none at the ends."""
    return strip(F.regexp_replace(column(x), r"(?U)\s+", " "))


def blank(x: Column | str) -> Column:
    """True for null, empty, and white space only."""
    return F.coalesce(strip(x) == "", F.lit(True))


def text_key(x: Column | str) -> Column:
    """SHA-256 of the lower-cased text without outer white space: the key of exact duplicates."""
    return F.sha2(F.lower(strip(F.coalesce(column(x), F.lit("")))), 256)


def token_set(x: Column | str) -> Column:
    """Sorted distinct lower-cased words."""
    return F.array_sort(F.array_distinct(words(F.lower(column(x)))))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def replace_tokens(tokens: Column | str, pairs: dict[str, str]) -> Column:
    """Each token's value in pairs, or the token itself."""
    table = literal_map(pairs)
    return F.transform(column(tokens), lambda t: F.coalesce(F.try_element_at(table, t), t))


def any_of(phrases: list[str]) -> str:
    """A pattern for any of the phrases as whole words, the first that fits; no case."""
    return r"(?iu)\b(?:" + "|".join(re.escape(p.lower()).replace(r"\ ", " ") for p in phrases) + r")\b"


def ngrams(tokens: Column | str, low: int = 1, high: int = 2) -> Column:
    """All runs of low to high tokens, shorter ones first."""
    t = column(tokens)

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(t) - (n - 1))
        return F.when(F.size(t) >= n, F.transform(starts, lambda i: F.slice(t, i, n))).otherwise(F.array().cast("array<array<string>>"))

    parts = [runs(n) for n in range(low, high + 1)]
    return F.concat(*parts)


def mark(tokens: Column | str, positions: Column | str, label: str = "NEG", where: str = "suffix") -> Column:
    """The label joined to the tokens at the positions, counted from 0."""
    p = column(positions)
    joined = (lambda t: F.concat(F.lit(f"{label}_"), t)) if where == "prefix" else (lambda t: F.concat(t, F.lit(f"_{label}")))
    return F.transform(column(tokens), lambda t, i: F.when(F.array_contains(p, i), joined(t)).otherwise(t))
