"""Similarity of strings: token overlap in the JVM, indel ratios in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .strings import column, token_set


def token_f1(span: Column | str, text: Column | str) -> Column:
    """F1 of the distinct lower-cased words; 0 without common words."""
    a, b = token_set(span), token_set(text)
    common = F.size(F.array_intersect(a, b))
    precision, recall = common / F.size(a), common / F.size(b)
    return F.when(common > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by whole rows of bits."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / both lengths); 100 for two empty strings."""
    total = len(a) + len(b)
    return 200.0 * common_length(a, b) / total if total else 100.0


def best_partial(a: str, b: str, enough: float = 100.0) -> float:
    """The best ratio of the shorter string against windows of the longer, those cut at its ends included; ends early
    at enough."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best, letters = len(a), 0.0, set(a)
    for start in range(1 - n, len(b)):
        lo, hi = max(0, start), min(len(b), start + n)
        # a window that does not end on a letter of the shorter string is no better than the one before it, and one
        # that the end of the longer string cuts must begin on one
        if (b[hi - 1] if start + n <= len(b) else b[lo]) not in letters:
            continue
        best = max(best, indel_ratio(a, b[lo:hi]))
        if best >= enough:
            break
    return best


def closest_window(span: str | None, text: str | None, least: float = 70.0) -> str | None:
    """The run of words of the text most like the span, of its number of words or one or two fewer or more; the first
    of equals in that order; null below least."""
    if not span or not text:
        return None
    wanted, there = span.lower().strip(), text.split()
    size = len(wanted.split())
    low = [w.lower() for w in there]
    best, found = 0.0, None
    for n in (size, size - 1, size + 1, size - 2, size + 2):
        if n < 1 and n != size:
            continue
        for k in range(len(there) - n + 1):
            candidate = " ".join(low[k : k + n])
            total = len(wanted) + len(candidate)
            if total and 200.0 * min(len(wanted), len(candidate)) / total <= best:
                continue
            score = indel_ratio(wanted, candidate)
            if score > best:
                best, found = score, " ".join(there[k : k + n])
    return found if best >= least else None


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else best_partial(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def closest_span(span: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([closest_window(s, t) for s, t in zip(span, text, strict=True)], dtype="object")


@F.pandas_udf(T.DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def plainly_grounded(span: Column | str, text: Column | str, threshold: float) -> Column:
    """True where the span is in the text without case, or overlaps its words enough; no fuzzy match."""
    s, t = column(span), column(text)
    some = (F.coalesce(s, F.lit("")) != "") & (F.coalesce(t, F.lit("")) != "")
    from .strings import strip

    return F.coalesce(some & (F.contains(F.lower(strip(t)), F.lower(strip(s))) | (token_f1(s, t) >= threshold)), F.lit(False))


def register(spark) -> None:  # noqa: ANN001
    """Makes the functions known to SQL."""
    for name, f in (("indel_ratio", ratio), ("partial_ratio", partial_ratio), ("closest_span", closest_span), ("sequence_similarity", sequence_similarity)):
        spark.udf.register(name, f)
