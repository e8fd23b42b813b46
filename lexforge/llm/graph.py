"""Connected components of a table of links, without the driver holding any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import forget, written


def _settled(edges: DataFrame) -> bool:
    """Whether every larger node has one smaller neighbour, which has none itself."""
    twice = edges.groupBy("u").agg(F.count("*").alias("k")).filter("k > 1").select("u")
    chained = edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return twice.unionByName(chained).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    moved = down.join(least, F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", *, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link to another; component is the smallest node of its group.

    Large and small stars in turn until all that is left are stars; minima are taken with partial aggregation and the
    joins are inner equi-joins, which adaptive execution splits where a node has very many neighbours.  Each round is a
    table in the shared folder.  Loops, repeated and reversed links are allowed; without links the result is empty.
    """
    links = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(rounds):
        if _settled(links):
            break
        moved = written(_small_star(_large_star(links)), "links")
        forget(links)
        links = moved
    else:
        raise RuntimeError("components did not settle")
    tops = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def look_up(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows with the columns of the table (one row for each key, with how many of all rows have it), but for the weight.
    Keys that a thousandth of the rows or more have, a thousand at most, are sent to all tasks, so that none gets all rows
    of such a key; the others are joined by shuffle.  Rows without a match go."""
    heavy = F.col(weight) * 1000 >= total
    often, seldom = table.filter(heavy).drop(weight), table.filter(~heavy).drop(weight)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti")
    return rows.join(F.broadcast(often), key).unionByName(rest.join(seldom, key))
