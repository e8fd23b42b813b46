"""Routing of processed rows: status, quotas and budget, review decisions, merge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import blank, column
from ..session import cut_lineage, unused
from .relational import distribution, quality_gate, running_total

# The columns of results and of the final data.
RESULT_COLUMNS = ["sample_id", "source_dataset", "source_id", "original_text", "cleaned_text", "aspect_target", "aspect_category", "opinion_span", "stance", "explanation", "mapped_stance", "cost_usd", "s1_attempts", "s2_attempts", "status", "errors", "timestamp"]
FINAL_COLUMNS = ["sample_id", "text", "aspect_target", "aspect_category", "opinion_span", "stance", "explanation"]
REQUIRED = ["aspect_target", "aspect_category", "opinion_span", "stance", "explanation"]


def status_of(first_attempts: Column | str, second_attempts: Column | str, first_fixed: Column | str, second_fixed: Column | str) -> Column:
    """repaired where a stage took more than one attempt or was mended, else accepted."""
    a, b, c, d = (column(x) for x in (first_attempts, second_attempts, first_fixed, second_fixed))
    return F.when((a > 1) | (b > 1) | F.coalesce(c, F.lit(False)) | F.coalesce(d, F.lit(False)), "repaired").otherwise("accepted")


def running_counts(rows: DataFrame, label: str, order: str, out: str = "so_far") -> DataFrame:
    """rows with how many rows of their label have come so far, in order."""
    return running_total(rows, F.lit(1).cast("long"), order, out, by=label)


def quota_route(rows: DataFrame, *, order: str, status: str, label: str, key: str, cost: str, quotas: dict[str, int], budget: float) -> DataFrame:
    """The rows that are emitted when rows are processed in order, with sample_id.

    Processing stops when all quotas are met, or before a row if the cost so far has reached the budget.  accepted and
    repaired rows are emitted if their label's quota is open and their key has not been emitted; review rows always;
    others never.  sample_id counts the rows emitted for a quota before the row, from 1.

    Only the first row of each label and key can matter, and a label is full after as many of those as all quotas
    together, since others can take no more keys from it.  So the fold, which must see rows one by one, gets at most
    labels * sum(quotas) rows, whatever the input; everything else is set-based.
    """
    names, total = list(quotas), sum(quotas.values())
    price = F.coalesce(F.col(cost).cast("double"), F.lit(0.0))
    spent = running_total(rows.select(F.col(order).cast("long").alias("o"), F.col(status).alias("s"), F.col(label).alias("l"), F.col(key).alias("k"), price.alias("c")), F.col("c"), "o", "spent")
    reached = spent.filter(F.col("spent") - F.col("c") < budget)
    good = reached.filter(F.col("s").isin("accepted", "repaired") & F.col("l").isin(names))
    firsts = good.groupBy("l", "k").agg(F.min("o").alias("o"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("o"))
    needed = firsts.withColumn("r", rank).filter(F.col("r") <= total).select(F.lit(0).alias("one"), "o", "l", "k")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        count, seen, out, stop = dict.fromkeys(names, 0), set(), [], -1
        for o, lab, k in frame.sort_values("o")[["o", "l", "k"]].itertuples(index=False):
            if count[lab] < quotas[lab] and k not in seen:
                seen.add(k)
                count[lab] += 1
                out.append(o)
                if all(count[n] >= quotas[n] for n in names):
                    stop = o
                    break
        return pd.DataFrame({"eo": out, "stop": stop if stop >= 0 else None, "n": range(1, len(out) + 1)}).astype({"eo": "int64", "stop": "Int64", "n": "int64"})

    taken = needed.groupBy("one").applyInPandas(fold, "eo long, stop long, n long")
    # everything up to the row that fills the last quota was processed
    last = taken.agg(F.max("stop").alias("last")).select(F.coalesce("last", F.lit(2**62)).alias("last"))
    decided = reached.join(taken.select("eo", "n"), F.col("o") == F.col("eo"), "left").filter(F.col("n").isNotNull() | (F.col("s") == "review"))
    counted = decided.withColumn("one", F.lit(1)).join(last.withColumn("one", F.lit(1)), "one").filter(F.col("o") <= F.col("last"))
    # rows emitted for a quota before a row: the fold's numbers, carried forward over review rows
    numbered = running_total(counted.select("o", F.when(F.col("n").isNotNull(), 1).otherwise(0).alias("q")), F.col("q"), "o", "upto").select(F.col("o").alias("eo"), (F.col("upto") - F.col("q") + 1).alias("sample_id"))
    return rows.join(numbered, F.col(order) == F.col("eo")).drop("eo")


def assemble(rows: DataFrame, sources: dict[str, Column]) -> DataFrame:
    """The result columns from expressions; what is null or has none becomes empty text."""
    whole = {"sample_id": "int", "s1_attempts": "int", "s2_attempts": "int"}
    return rows.select(*[F.coalesce(sources.get(c, F.lit(None)).cast(whole.get(c, "string")), F.lit(0 if c in whole else "")).alias(c) for c in RESULT_COLUMNS])


def review(queue: DataFrame, decisions: DataFrame, *, key: str = "sample_id", order: str | None = None) -> DataFrame:
    """The reviewed rows of a queue.

    decisions: key, action (a accept, e edit, r reject, s skip, q quit) and new values of the five fields, blank to
    keep the old.  Accepted and edited rows get their status and lose their errors; rows from the first quit on, and
    rows without a decision, are not reviewed.
    """
    order = order or key
    fields = [c for c in REQUIRED if c in decisions.columns]
    own, action, first_quit, one, *new = unused(queue, "_key", "_action", "_quit", "_one", *(f"_new_{c}" for c in fields))
    given = dict(zip(fields, new, strict=True))
    d = decisions.select(F.col(key).alias(own), F.lower(F.substring("action", 1, 1)).alias(action), *[F.col(c).alias(n) for c, n in given.items()])
    joined = queue.join(d, F.col(key) == F.col(own)).drop(own)
    quits = joined.filter(F.col(action) == "q").agg(F.min(order).alias(first_quit)).withColumn(one, F.lit(1))
    kept = joined.filter(F.col(action).isin("a", "e")).withColumn(one, F.lit(1)).join(quits, one).filter(F.col(first_quit).isNull() | (F.col(order) < F.col(first_quit)))
    for c, n in given.items():
        kept = kept.withColumn(c, F.when((F.col(action) == "e") & ~blank(n), F.col(n)).otherwise(F.col(c)))
    done = F.when(F.col(action) == "e", "reviewed_edited").otherwise("reviewed_accepted")
    return kept.withColumn("status", done).withColumn("errors", F.lit("")).select(*queue.columns)


def merge(parts: list[DataFrame], *, order: str = "sample_id", least_ratio: float | None = None) -> DataFrame:
    """The final rows of result tables, in the order of the tables and of order within them: those of sufficient
    quality, numbered from 1.  least_ratio also drops near copies of earlier rows."""
    from functools import reduce

    shown = [c for c in (*REQUIRED, "cleaned_text", "original_text", order) if any(c in p.columns for p in parts)]
    ranked = [p.select(*dict.fromkeys(c for c in shown if c in p.columns), F.lit(k).alias("_rank")) for k, p in enumerate(parts)]
    rows = quality_gate(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked), REQUIRED)
    text = F.col("cleaned_text") if "cleaned_text" in rows.columns else F.col("original_text")
    numbered = number(rows, ["_rank", order], "_n")
    final = numbered.select(F.col("_n").alias("sample_id"), text.alias("text"), *REQUIRED)
    if least_ratio is not None:
        from .relational import ratio_dedup

        kept = ratio_dedup(final, least=least_ratio, order="sample_id")
        final = number(kept.withColumnRenamed("sample_id", "_old"), ["_old"], "sample_id").drop("_old")
    return final.select(*FINAL_COLUMNS)


def number(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """rows numbered from 1 in an order, by sorted partitions and the counts of those before: the rows are sorted
    across all tasks, only one count for each partition is put in order."""
    part, at, low, count, other, before = unused(rows, "_p", "_m", "_lo", "_c", "_q", "_before")
    placed = rows.orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id())
    placed = cut_lineage(placed)  # partition numbers must not change between the two uses
    counts = placed.groupBy(part).agg(F.count("*").alias(count), F.min(at).alias(low))
    sums = counts.select(F.col(part).alias(other), low, F.coalesce(F.sum(count).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return placed.join(F.broadcast(sums), F.col(part) == F.col(other)).withColumn(out, F.col(at) - F.col(low) + F.col(before) + 1).drop(part, other, at, low, before)


def summary(final: DataFrame, columns: tuple[str, ...] = ("stance", "aspect_category")) -> DataFrame:
    """Counts and percentages of stances and categories."""
    return distribution(final, list(columns))
