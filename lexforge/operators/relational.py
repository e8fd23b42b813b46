"""Filters, duplicates, samples and summaries of corpora: DataFrame to DataFrame.

Rows have no order of their own: what depends on order takes the name of an order column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.strings import any_of, blank, text_key, token_set
from ..session import cut_lineage, unused


def source_filter(rows: DataFrame, names: list[str], col: str = "source") -> DataFrame:
    return rows.filter(F.col(col).isin(names))


def keyword_hits(text: Column | str, keywords: list[str]) -> Column:
    """Non-overlapping whole-word matches; the keyword that stands first in the list wins at each place."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(F.lower(t), F.lit(any_of(keywords))), F.lit(0))


def keyword_filter(rows: DataFrame, keywords: list[str] | None = None, *, least: int = 1, text: str = "text") -> DataFrame:
    words = keywords or [*lexicons.PRIMARY_KEYWORDS, *lexicons.SECONDARY_KEYWORDS, *lexicons.IMMIGRATION_KEYWORDS]
    if least == 1:
        return rows.filter(F.lower(F.col(text)).rlike(any_of(words)))
    return rows.filter(keyword_hits(text, words) >= least)


def without_known(rows: DataFrame, known: DataFrame, *, text: str = "text", known_text: str = "text") -> DataFrame:
    """rows whose text, without case and outer white space, is none of the known ones.  The join is planned from the
    sizes of both sides, so a large known side is shuffled."""
    return without_processed(rows, known.select(text_key(known_text).alias("key")), text_key(text))


def without_processed(rows: DataFrame, state: DataFrame, key: Column, state_key: str = "key") -> DataFrame:
    own, done = unused(rows, "_key", "_done")
    return rows.withColumn(own, key).join(state.select(F.col(state_key).alias(done)).distinct(), F.col(own) == F.col(done), "left_anti").drop(own)


def first_of(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row, in order, of each key.  The order's minimum is taken by partial aggregation and joined back, so
    that no task sorts all rows of a frequent key; the order column must be unique."""
    own, first = unused(rows, "_k", "_first")
    least = rows.groupBy(key.alias(own)).agg(F.min(order).alias(first)).select(first)
    return rows.join(least, F.col(order) == F.col(first), "left_semi")


def exact_dedup(rows: DataFrame, *, text: str = "text", order: str = "doc_id") -> DataFrame:
    return first_of(rows, text_key(text), order)


def set_key(text: Column | str) -> Column:
    """One value for a set of lower-cased words, which hold no spaces."""
    return F.sha2(F.array_join(token_set(text), " "), 256)


def token_set_dedup(rows: DataFrame, *, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The first row of each set of lower-cased words: fuzzy duplicates at threshold 1."""
    return first_of(rows, set_key(text), order)


def signatures(tokens: pa.ListArray | pa.LargeListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each set of hashed tokens, the least value under each multiply-shift function; all ones for an empty set."""
    out = np.full((len(tokens), len(a)), np.iinfo(np.uint64).max, np.uint64)
    ends = tokens.offsets.to_numpy().astype(np.int64) - tokens.offsets[0].as_py()
    hashes = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    some = np.flatnonzero(np.diff(ends) > 0)
    at = 0
    while at < len(some):  # some tens of thousands of tokens at a time, to bound memory
        to = max(at + 1, int(np.searchsorted(ends[some + 1], ends[some[at]] + 20_000, side="right")))
        first, last = ends[some[at]], ends[some[to - 1] + 1]
        part = hashes[first:last]
        for k in range(len(a)):
            out[some[at:to], k] = np.minimum.reduceat((part * a[k] + b[k]) >> np.uint64(31), ends[some[at:to]] - first)
        at = to
    return out


def lsh_bands(threshold: float, permutations: int) -> tuple[int, int]:
    """Bands and rows that make false positives and false negatives together least likely, both counted half."""
    xs = np.linspace(0, 1, 501)
    best = (2.0, permutations, 1)
    for bands in range(1, permutations + 1):
        for size in range(1, permutations // bands + 1):
            hit = 1 - (1 - xs**size) ** bands
            wrong = 0.5 * np.trapezoid(np.where(xs < threshold, hit, 0), xs) + 0.5 * np.trapezoid(np.where(xs >= threshold, 1 - hit, 0), xs)
            best = min(best, (float(wrong), bands, size))
    return best[1], best[2]


def minhash_buckets(rows: DataFrame, threshold: float, *, text: str = "text", order: str = "doc_id", permutations: int = 128, seed: int = 1) -> DataFrame:
    """(idx, bucket): rows that share a bucket have a band of their signatures in common.  Equal sets of words have one
    signature, made for the first row, and one bucket more, which all of them share."""
    bands, size = lsh_bands(threshold, permutations)
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, permutations).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, permutations).astype(np.uint64)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = signatures(batch.column(1), a, b)
            keys = np.empty((len(found), bands), np.uint64)
            for k in range(bands):
                key = np.full(len(found), k + 1, np.uint64)
                for x in found[:, k * size : (k + 1) * size].T:
                    key = (key ^ x) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                keys[:, k] = key
            owner = pa.array(np.repeat(np.arange(len(found)), bands))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(keys.ravel().view(np.int64))], names=["idx", "bucket"])

    kind = rows.schema[order].dataType.simpleString()
    sets = rows.select(F.col(order).alias("idx"), set_key(text).alias("same"), F.transform(token_set(text), lambda w: F.xxhash64(w)).alias("tokens"))
    leaders = sets.groupBy("same").agg(F.min(F.struct("idx", "tokens")).alias("m")).select("m.idx", "m.tokens")
    equal = sets.select("idx", F.xxhash64("same").alias("bucket"))
    return leaders.mapInArrow(banded, f"idx {kind}, bucket long").unionByName(equal)


def keep_first_of_buckets(buckets: DataFrame) -> DataFrame:
    """The rows (one column idx) that a pass in order keeps: a row goes if, and only if, an earlier row that is kept
    shares a bucket with it.  A row is kept once it is the first undecided one of all its buckets, and then the others in
    these go.  No pairs are made, so a bucket costs its size; rounds follow until every row is decided."""
    todo, kept = cut_lineage(buckets.select("idx", "bucket").distinct()), None
    while not todo.isEmpty():
        firsts = todo.groupBy("bucket").agg(F.min("idx").alias("first"))
        stands = todo.join(firsts, "bucket").groupBy("idx").agg(F.bool_and(F.col("idx") == F.col("first")).alias("good")).filter("good").select("idx")
        stands = cut_lineage(stands)
        kept = stands if kept is None else cut_lineage(kept.unionByName(stands))
        taken = todo.join(stands, "idx", "left_semi").select("bucket").distinct()
        gone = todo.join(taken, "bucket", "left_semi").select("idx").distinct()
        todo = cut_lineage(todo.join(gone, "idx", "left_anti"))
    return buckets.select("idx").distinct() if kept is None else kept


def keep_first_independent(ids: DataFrame, edges: DataFrame, *, rounds: int | None = None) -> DataFrame:
    """ids (one column idx) that a pass in order keeps: a row goes if, and only if, an earlier row that is kept is its
    neighbour (edges: earlier, later).  Each round decides rows all of whose earlier neighbours are decided, until all
    are; with a bound on the rounds it raises if that is not enough."""
    open_edges = cut_lineage(edges.select("earlier", "later").distinct())
    gone: DataFrame | None = None
    done = 0
    while not open_edges.isEmpty():
        if done == rounds:
            raise RuntimeError("keep_first_independent did not settle")
        done += 1
        # rows without an open earlier neighbour are kept; their later neighbours go
        waiting = open_edges.select(F.col("later").alias("idx")).distinct()
        kept = open_edges.select(F.col("earlier").alias("idx")).distinct().join(waiting, "idx", "left_anti")
        dropped = cut_lineage(open_edges.join(kept.withColumnRenamed("idx", "earlier"), "earlier", "left_semi").select(F.col("later").alias("idx")).distinct())
        gone = cut_lineage(dropped if gone is None else gone.unionByName(dropped))
        left = open_edges.join(dropped.withColumnRenamed("idx", "earlier"), "earlier", "left_anti").join(dropped.withColumnRenamed("idx", "later"), "later", "left_anti")
        open_edges = cut_lineage(left.join(kept.withColumnRenamed("idx", "earlier"), "earlier", "left_anti"))
    return ids if gone is None else ids.join(gone, "idx", "left_anti")


def fuzzy_dedup(rows: DataFrame, threshold: float = 1.0, *, text: str = "text", order: str = "doc_id", permutations: int = 128) -> DataFrame:
    """Greedy in order: a row stays unless an earlier row that stayed is alike; at 1 that is equality of word sets."""
    if threshold >= 1:
        return token_set_dedup(rows, text=text, order=order)
    buckets = minhash_buckets(rows, threshold, text=text, order=order, permutations=permutations)
    (name,) = unused(rows, "_kept")
    return rows.join(keep_first_of_buckets(buckets).withColumnRenamed("idx", name), F.col(order) == F.col(name), "left_semi")


#: Rows that ratio_dedup() compares without a block, at most, and tasks that a block's rows are dealt to.
UNBLOCKED = 20_000
SPREAD = 16


def ratio_dedup(rows: DataFrame, *, least: float = 85.0, text: str = "text", order: str = "doc_id", block: Column | None = None) -> DataFrame:
    """Greedy in order by the indel ratio of lower-cased texts.  Pairs are looked for within blocks and neighbouring
    length classes: a ratio of 85 needs lengths within a factor of (200 - 85) / 85.  It is meant for final data, which
    quotas bound; more than UNBLOCKED rows need a block."""
    from ..functions.similarity import ratio

    if block is None and rows.count() > UNBLOCKED:
        raise ValueError(f"more than {UNBLOCKED} rows need a block, so that not all pairs are compared")
    step = float(np.log((200 - least) / least))
    texts = rows.select(F.col(order).alias("idx"), F.lower(text).alias("t"), (block if block is not None else F.lit(0)).alias("b"))
    texts = texts.withColumn("c", F.floor(F.log(F.greatest(F.char_length("t"), F.lit(1)).cast("double")) / step))
    # a row meets the rows of its length class and the two beside it, in the part of them that falls to each task
    own = texts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    near = texts.withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1))).withColumn("part", F.pmod(F.xxhash64("idx"), F.lit(SPREAD)).cast("int"))
    pairs = own.alias("x").join(near.alias("y"), (F.col("x.b") == F.col("y.b")) & (F.col("x.c") == F.col("y.c")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.idx") < F.col("y.idx")))
    pairs = pairs.filter(F.least(F.char_length("x.t"), F.char_length("y.t")) * 200 >= least * (F.char_length("x.t") + F.char_length("y.t")))
    edges = pairs.filter(ratio(F.col("x.t"), F.col("y.t")) >= least).select(F.col("x.idx").alias("earlier"), F.col("y.idx").alias("later"))
    kept = keep_first_independent(texts.select("idx"), edges)
    (name,) = unused(rows, "_kept")
    return rows.join(kept.withColumnRenamed("idx", name), F.col(order) == F.col(name), "left_semi")


def unit_hash(key: Column, seed: int = 42) -> Column:
    """A number in (0, 1] from the md5 of the seed and a key."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967296.0)


def balanced_sample(rows: DataFrame, *, label: str, per_class: int, weight: Column, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """At most per_class rows of each label, without replacement, by weight: the smallest -ln(u) / weight.  The rank
    limit is applied before the shuffle as well, so a frequent label sends per_class rows from each task."""
    points, rank = unused(rows, "_score", "_rank")
    score = -F.log(unit_hash(F.col(key), seed)) / weight
    order = Window.partitionBy(label).orderBy(points, key)
    return rows.withColumn(points, score).withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= per_class).drop(points, rank)


def few_shot(rows: DataFrame, *, label: str, labels: list[str], n: int = 3, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """One row for each label, then others, n in all, in the order of a seeded hash."""
    u, rank, late, taken = unused(rows, "_u", "_rank", "_late", "_taken")
    name = F.lower(F.trim(F.col(label)))
    scored = rows.withColumn(u, unit_hash(F.col(key), seed))
    known = scored.filter(name.isin([x.lower() for x in labels]))
    firsts = known.withColumn(rank, F.row_number().over(Window.partitionBy(name).orderBy(u, key))).filter(F.col(rank) == 1).withColumn(late, F.lit(0)).drop(rank)
    others = scored.join(firsts.select(F.col(key).alias(taken)), F.col(key) == F.col(taken), "left_anti").orderBy(u, key).limit(n).withColumn(late, F.lit(1))
    return firsts.unionByName(others).orderBy(late, u, key).limit(n).drop(u, late)


def distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, n and percent of each value of each column, in one pass over the rows."""
    sets = rows.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id(*columns).alias("_g"), F.count("*").alias("n"))
    masks = {c: (2 ** len(columns) - 1) ^ (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, mask in masks.items():
        name, value = F.when(F.col("_g") == mask, F.lit(c)).otherwise(name), F.when(F.col("_g") == mask, F.col(c).cast("string")).otherwise(value)
    flat = sets.select(name.alias("dimension"), value.alias("value"), "n")
    return flat.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("dimension")), 6))


def quality_gate(rows: DataFrame, required: list[str], *, category: str = "aspect_category", stance: str = "stance", categories: list[str] | None = None, stances: list[str] | None = None) -> DataFrame:
    """Rows with all required fields, a known category and a known stance."""
    full = rows.filter(~F.exists(F.array(*[F.col(c).cast("string") for c in required]), blank))
    return full.filter(F.col(category).isin(categories or lexicons.CATEGORIES)).filter(F.col(stance).isin(stances or lexicons.STANCES))


def gate_counts(rows: DataFrame, required: list[str], *, category: str = "aspect_category", stance: str = "stance", categories: list[str] | None = None, stances: list[str] | None = None) -> DataFrame:
    """How many rows each step of quality_gate() leaves, from one pass."""
    full = ~F.exists(F.array(*[F.col(c).cast("string") for c in required]), blank)
    placed = F.coalesce(full & F.col(category).isin(categories or lexicons.CATEGORIES), F.lit(False))
    good = F.coalesce(placed & F.col(stance).isin(stances or lexicons.STANCES), F.lit(False))
    return rows.agg(F.count("*").alias("rows"), F.count_if(full).alias("complete"), F.count_if(placed).alias("in_category"), F.count_if(good).alias("in_stance"))


def running_total(rows: DataFrame, value: Column, order: str, out: str = "running", *, by: str | None = None) -> DataFrame:
    """rows with the sum of value up to and including the row, in order, of all rows or of those with the same value of a
    column.  The rows are dealt to tasks by ranges of the order, whatever its values; sums run within the ranges and over
    the ranges' totals, so no task sorts all rows, nor all of one label."""
    v, span, inside, before, other, label = unused(rows, "_v", "_span", "_inside", "_before", "_other", "_label")
    placed = rows.withColumn(v, value).repartitionByRange(F.col(order)).withColumn(span, F.spark_partition_id())
    placed = cut_lineage(placed)  # ranges must not change between the two uses
    keys = [by] if by else []
    along = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(span, *keys).agg(F.sum(v).alias(inside)).withColumn(before, F.coalesce(F.sum(inside).over(along), F.lit(0)))
    totals = totals.select(F.col(span).alias(other), *[F.col(c).alias(label) for c in keys], before)
    match = F.col(span) == F.col(other)
    if by:
        match &= F.col(by).eqNullSafe(F.col(label))
    upto = Window.partitionBy(span, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.withColumn(inside, F.sum(v).over(upto)).join(totals, match)
    return counted.withColumn(out, F.col(before) + F.col(inside)).drop(v, span, inside, before, other, label)


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float = 0.0004, price_out: float = 0.0016, unit: float = 1000.0) -> Column:
    return tokens_in / unit * price_in + tokens_out / unit * price_out


def rewrite_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """The rewriter's price, by the million."""
    return token_cost(tokens_in, tokens_out, 0.15, 0.60, 1_000_000.0)


def relevance_gate(rows: DataFrame, *, related: str = "related", confidence: str = "confidence", rewrite: str = "rewrite", least: float = 0.5, words: int = 30) -> DataFrame:
    """rows with the rewrite cut to a number of words, or null where it is unrelated or not sure enough."""
    from ..functions.strings import words as split

    cut = F.array_join(F.slice(split(rewrite), 1, words), " ")
    return rows.withColumn(rewrite, F.when(F.col(related) & (F.col(confidence) >= least), cut))


def mean_sentiment(rows: DataFrame, scores: str = "scores", key: str = "doc_id") -> DataFrame:
    """key, polarity and the mean positive, negative and objective scores of arrays of structs (pos, neg, obj)."""
    flat = rows.select(key, F.explode(scores).alias("s"))
    out = flat.groupBy(key).agg(F.avg("s.pos").alias("pos"), F.avg("s.neg").alias("neg"), F.avg("s.obj").alias("obj"))
    return out.withColumn("polarity", F.col("pos") - F.col("neg"))
