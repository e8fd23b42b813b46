"""N-gram statistics of corpora: counting, thresholds, and probabilities from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import java
from ..functions.strings import column

START = "<S>"


def words_of(text: Column | str, *, unescape: bool = False) -> Column:
    """Lower-case ASCII words of 1 to 15 letters that no # or @ stands before; links are left out."""
    from ..functions.cleaning import unescape_html

    t = F.regexp_replace(column(text), java("url"), " ")
    if unescape:
        t = unescape_html(t)
    return F.regexp_extract_all(F.lower(t), F.lit(r"(?U)(?<![#@])\b[a-z]{1,15}\b"), F.lit(0))


def count_ngrams(rows: DataFrame, *, text: str = "text", most: int = 2, unescape: bool = False) -> DataFrame:
    """(n, gram, cnt): runs of 1 to most words of each line, joined by _; a run of n > 1 may reach n - 1 starts back."""
    words = words_of("line", unescape=unescape)
    lines = rows.select(F.explode(F.split(F.col(text), "\n")).alias("line")).select(words.alias("w"))

    def before(k: int) -> Column:
        """The word k places before each word, or a start; arrays are zipped, so each is made once a line."""
        return F.slice(F.concat(F.array(*[F.lit(START)] * k), F.col("w")), F.lit(1), F.size("w")) if k else F.col("w")

    def grams(n: int) -> Column:
        found = before(0)
        for k in range(1, n):
            found = F.zip_with(before(k), found, lambda a, b: F.concat(a, F.lit("_"), b))
        return F.transform(found, lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    parts = [grams(n) for n in range(1, most + 1)]
    return lines.select(F.explode(F.concat(*parts)).alias("g")).groupBy("g.n", "g.gram").agg(F.count("*").alias("cnt"))


def frequent_ngrams(counts: DataFrame, least: dict[int, int] | None = None, percentile: float = 0.0) -> DataFrame:
    """The n-grams with at least the given count, or the count at a percentile of all n-grams of their length."""
    least = least or {1: 60, 2: 25}
    bound = F.coalesce(*[F.when(F.col("n") == n, F.lit(c)) for n, c in least.items()], F.lit(0))
    if percentile <= 0:
        return counts.filter(F.col("cnt") >= bound)
    cuts = counts.groupBy(F.col("n").alias("_n")).agg(F.percentile("cnt", percentile / 100).alias("_cut"))
    return counts.join(F.broadcast(cuts), F.col("n") == F.col("_n")).filter(F.col("cnt") >= F.greatest(bound, F.col("_cut"))).drop("_n", "_cut")


def pruned(counts: DataFrame, least: int = 3) -> DataFrame:
    return counts.filter(F.col("cnt") >= least)


def probabilities(counts: DataFrame, n: int = 1) -> DataFrame:
    """(gram, p): relative frequencies of the n-grams of one length."""
    own = counts.filter(F.col("n") == n)
    total = own.agg(F.sum("cnt").alias("_t")).withColumn("_one", F.lit(1))
    return own.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select("gram", (F.col("cnt") / F.col("_t")).alias("p"))


def as_maps(counts: DataFrame, most: int = 2_000_000) -> tuple[dict[str, int], dict[str, int]]:
    """Unigrams and bigrams for the segmenter and the speller, on the driver; the table must be bounded first."""
    rows = counts.filter("n <= 2").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} n-grams: apply a threshold first")
    return {r["gram"]: r["cnt"] for r in rows if r["n"] == 1}, {r["gram"]: r["cnt"] for r in rows if r["n"] == 2}
