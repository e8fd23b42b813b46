"""Operator 9: mixing sources to target weights by systematic sampling, with DataFrame functions alone.

Sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ...; targets share all words by weight, none above
LIMIT times its source's size.  Every document of a source expects target / source size copies.  The documents of a
source stand in one order (size class, then md5 of the id and the text), their expected copies are summed along it from
one random offset, and a document is emitted once for each integer that the sum crosses in it.  Since neighbours have
like sizes, the words taken follow the target.

The order is cut into cells of (source, size class, first md5 digits): positions are counted within cells and the
cells' counts are summed over the small table of cells, so a source with a third of all rows has no task of its own.
The number of digits follows the number of rows; the order, and so the result, is the same for any.

Null text counts 0 words; a null source is a source; null and repeated ids are told apart by their texts, so rows that
tie are alike in id, text and source (mix() goes on to a hash of all their columns) and reruns agree in whatever order
rows come; repeated rows are rows of their own; sources without words have target 0 and nothing taken from them; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textops import written

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix-1"
#: Rows for each value of the first digits of the md5, about, over all sources and size classes.
ROWS = 1 << 24


def word_count(text: Column) -> Column:
    """Number of runs outside 0x20 and 0x09-0x0D; 0 for null.  Each run becomes one x and the white space goes, so no
    array of words is made."""
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.char_length(marks), F.lit(0)).cast("long")


def unit(text: Column) -> Column:
    """A number in [0, 1) from the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target for a table (source, source_size) of one row per source.

    Handing the excess of capped sources on by weight ends at min(limit * size, level * weight) for one level; the
    capped sources are a prefix of the order by limit * size / weight, so running sums find the level.  The windows
    run over one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    turn = (rank - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    size = F.col("source_size")
    table = sizes.select("source", "source_size", rank.alias("rank"), weight.alias("weight")).withColumn("edge", size * F.lit(limit) / F.col("weight"))
    order = Window.orderBy("edge", "rank")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum(size).over(whole) - F.lit(limit) * F.coalesce(F.sum(size).over(before), F.lit(0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    table = table.withColumn("level", left / weights_left)
    level = F.min(F.when(F.col("level") <= F.col("edge"), F.struct("edge", "rank", "level"))).over(whole)["level"]
    return table.select("source", "source_size", F.least(F.lit(float(limit)) * size, level * F.col("weight")).alias("target"))


def copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), tie: str | None = None, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = SEED, digits: int | None = None) -> DataFrame:
    """id, source, size, source_size, target, copies and the columns of carry, for every row; rows alike in id, text and
    source come in the order of the column tie."""
    if digits is None:
        count, digits = docs.count(), 1
        while count >= ROWS * 16**digits and digits < 8:
            digits += 1
    name = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit(""))
    key = F.md5(F.concat(name, F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    size = word_count(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("_key"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    # the size's number of binary digits and the two after the first: quarters of an octave, without rounding
    digits_of = F.bin("size")
    octave = F.length(digits_of) * 4 + F.coalesce(F.conv(F.substring(F.concat(digits_of, F.lit("00")), 2, 2), 2, 10).cast("int"), F.lit(0))
    rows = rows.withColumn("_class", octave).withColumn("_part", F.substring("_key", 1, digits))
    # a small table, written so that its two uses read the texts once
    cells = written(rows.groupBy("source", "_class", "_part").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "cells")
    along = Window.partitionBy("source").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    wanted = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights=weights, limit=limit)
    cells = cells.select(F.col("source").alias("s"), F.col("_class").alias("c"), F.col("_part").alias("p"), "before")
    cells = cells.join(wanted.withColumnRenamed("source", "ws"), F.col("s").eqNullSafe(F.col("ws"))).drop("ws")
    inside = Window.partitionBy("source", "_class", "_part").orderBy("_key", "_tie")
    rows = rows.withColumn("_at", F.row_number().over(inside) - 1)
    placed = rows.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("_class") == F.col("c")) & (F.col("_part") == F.col("p")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))))
    at = F.col("before") + F.col("_at")
    crossed = F.floor(each * (at + 1) + offset) - F.floor(each * at + offset)
    return placed.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", crossed.alias("copies"), *[F.col(f"_c_{c}").alias(c) for c in carry])


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.to_json(c) if "map<" in docs.schema[n].dataType.simpleString() else c for n, c in zip(docs.columns, every, strict=True)]
    tie = F.xxhash64(*[x for c in hashed for x in (c.isNull(), c)])
    named = [F.col(options.pop(f"{n}_col", d)).alias(f"_{n}") for n, d in (("id", "doc_id"), ("text", "text"), ("source", "source"))]
    placed = copies(docs.select(F.struct(*every).alias("_all"), tie.alias("_tie"), *named), id_col="_id", text_col="_text", source_col="_source", carry=("_all",), tie="_tie", **options)
    repeated = placed.filter(F.col("copies") > 0).select("_all", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("_all.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


#: DuckDB SQL for op9_mixing.
OP9_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce('i' || doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents
), sizes AS (SELECT DISTINCT size, bin(size) || '00' AS b FROM d
), classes AS (SELECT size, (length(b) - 2) * 4 + substr(b, 2, 1)::INT * 2 + substr(b, 3, 1)::INT AS c FROM sizes
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (SELECT source, source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s
), e AS (SELECT *, source_size * 3 / weight AS edge FROM w
), l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY edge, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY edge, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM e
), v AS (SELECT level FROM l WHERE level <= edge ORDER BY edge, rank LIMIT 1
), t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT level FROM v) * weight) AS target FROM e
), r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
           row_number() OVER (PARTITION BY d.source ORDER BY c, k) - 1 AS pos,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS per,
           CAST('0x' || substr(md5('mix-1:' || coalesce('s' || d.source, 'n')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
         FROM d JOIN classes USING (size) JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(per * (pos + 1) + u) - floor(per * pos + u)) * size AS BIGINT) AS taken FROM r
"""
