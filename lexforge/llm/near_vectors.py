"""Operator 4: near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Centroids are fitted on a bounded sample; every vector is indexed.  A vector lives in the cell of its nearest centroid
and visits every other cell that the angle between its vector and the plane halfway to that cell's centroid cannot
exclude, so no pair is lost, whatever the number of cells; of two cells one visits the other.  Each cell compares its
visitors with its residents, block against block, in double precision.  Equal vectors are one node with a count first, so
a vector that a third of all rows share costs one comparison.  Groups are joined through a spanning forest of each block,
not through all their pairs, and the smallest id of a group is kept.

Vectors that are null, empty, zero or not finite link with nothing, and so do vectors of different lengths with one
another.  Each row is a vector of its own; rows that share an id are named by it, with the most links that one of them
has and the smallest component.  A null id is a row with null component that links with nothing.  An empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, look_up
from .textops import forget, free_name, mix, tidied, written
from .vectors import bounded_sample, matrix, usable

THRESHOLD = 0.9
#: Vectors that the centroids are fitted on, at most.
SAMPLE = 16_384
#: Vectors that a cell should hold, about; there are at most MOST_CELLS cells.
CELL = 1_500
MOST_CELLS = 4_096
#: Rows of a block.
BLOCK = 2_048
#: Blocks of visitors that meet a block of residents in one task, so that residents are sent less often.
TURNS = 8
#: The sine of the angle that linked vectors have at most.
SINE = (1 - THRESHOLD**2) ** 0.5


def spherical_kmeans(x: np.ndarray, k: int, *, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors; empty cells are seeded anew from the vectors farthest from theirs."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = x @ c.T
        home = near.argmax(axis=1)
        best = near[np.arange(len(x)), home]
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        empty = np.flatnonzero(size < 1e-12)
        if len(empty):
            total[empty] = x[np.argsort(best)[: len(empty)]]
            size = np.linalg.norm(total, axis=1)
        c = total / np.maximum(size, 1e-12)[:, None]
    return c


def place(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The home of each unit vector, and the cells it visits.

    A vector at home in another cell lies beyond the plane halfway between the centroids; where the angle to that plane
    is above that of linked vectors there is no link.  Of two cells the one that the parity of their numbers tells
    visits the other, so that all cells have about as many visitors.
    """
    number = np.arange(len(centroids))
    homes, visits = [np.zeros(0, np.int64)], []
    for at in range(0, len(x), 512):
        near = x[at : at + 512] @ centroids.T
        home = near.argmax(axis=1)
        ahead = near[np.arange(len(home)), home][:, None] - near
        apart = np.sqrt(np.maximum(0, 2 - 2 * (centroids[home] @ centroids.T)))
        turn = ((number + home[:, None]) % 2 == 1) == (home[:, None] > number)
        met = (ahead <= SINE * apart + 1e-6) & turn
        met[np.arange(len(home)), home] = True
        homes.append(home)
        visits += [np.flatnonzero(m) for m in met]
    return np.concatenate(homes), visits


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the links that a union-find over n nodes needs."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            kept.append(k)
    return np.array(kept, np.int64)


def cosine_links(u: np.ndarray, v: np.ndarray, lu: np.ndarray, lv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of u, row of v) with cosine at the threshold or above; what lies on it is computed as a quotient."""
    s = (u / lu[:, None]) @ (v / lv[:, None]).T
    i, j = np.nonzero(s >= THRESHOLD - 1e-9)
    close = np.abs(s[i, j] - THRESHOLD) <= 1e-9
    good = np.ones(len(i), bool)
    if close.any():
        exact = np.einsum("ij,ij->i", u[i[close]], v[j[close]]) / (lu[i[close]] * lv[j[close]])
        good[close] = exact >= THRESHOLD
    return i[good], j[good]


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    value = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    kind = np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64  # sent without loss
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable(F.col(vector_col)), value).alias("v"))
    live = rows.filter(F.col("id").isNotNull() & F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are one value
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    sent = live.select("id", plain.alias("v"))
    # equal vectors are one node with a number of its own, named by their smallest id
    equal = sent.groupBy("v").agg(F.min("id").alias("name"), F.count("*").alias("copies"))
    nodes = written(equal.withColumn("node", F.monotonically_increasing_id()), "vectors")
    count = nodes.count()
    sample = bounded_sample(nodes, "name", "v", SAMPLE)
    k = cells or int(min(MOST_CELLS, max(1, round(count / CELL))))
    if len(sample):
        unit = sample / np.linalg.norm(sample, axis=1)[:, None]
        centroids = spherical_kmeans(unit, min(k, len(unit)))
    else:
        centroids = np.zeros((0, 0))
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_CELLS rows

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for width in np.unique(sizes):
                part = batch.filter(pa.array(sizes == width))
                x = matrix(part.column(2))
                length = np.linalg.norm(x, axis=1)
                if width == c.shape[1]:
                    home, visits = place(x / length[:, None], c)
                else:  # vectors of another length have a cell of their own
                    home = np.full(len(x), -2 - int(width))
                    visits = list(home[:, None])
                node = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(home, pa.int64()), pa.array(visits, pa.list_(pa.int64())), pa.array((mix(node.astype(np.int64).view(np.uint64)) % np.uint64(1 << 20)).astype(np.int64))], names=["node", "copies", "x", "home", "visits", "deal"])

    cellular = written(nodes.select("node", "copies", "v").mapInArrow(tidied(placed), "node long, copies long, x binary, home long, visits array<long>, deal long"), "cells")
    # each cell's residents and visitors are dealt into blocks by a hash, as many as its size asks for
    full = cellular.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("r")).select(F.col("home").alias("cell"), "r")
    guests = cellular.select("node", F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / (TURNS * BLOCK)).alias("g"))
    plan = full.join(guests, "cell")
    residents = cellular.withColumn("cell", F.col("home")).join(plan, "cell").select("cell", "node", "copies", "x", "home", F.lit(0).alias("side"), (F.col("deal") % F.col("r")).alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("gb"))
    visitors = cellular.withColumn("cell", F.explode("visits")).join(plan, "cell").select("cell", "node", "copies", "x", "home", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("r") - 1)).alias("rb"), (F.col("deal") % F.col("g")).alias("gb"))

    def compared(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        own, guest = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        credit: list[tuple[np.ndarray, np.ndarray]] = []
        edges = [np.zeros((0, 2), np.int64)]
        if own.num_rows and guest.num_rows:
            xs = [np.frombuffer(b"".join(t.column("x").to_pylist()), kind).astype(np.float64).reshape(t.num_rows, -1) for t in (own, guest)]
            ls = [np.linalg.norm(x, axis=1) for x in xs]
            names = [t.column("node").to_numpy() for t in (own, guest)]
            copies = [t.column("copies").to_numpy() for t in (own, guest)]
            homes = guest.column("home").to_numpy()
            cell = int(table.column("cell")[0].as_py())
            for at in range(0, guest.num_rows, 1024):
                g, o = cosine_links(xs[1][at : at + 1024], xs[0], ls[1][at : at + 1024], ls[0])
                g += at
                other = names[1][g] != names[0][o]
                g, o = g[other], o[other]
                credit.append((names[1][g], copies[0][o]))
                # a resident learns here of guests from other cells, which it does not visit
                away = homes[g] != cell
                credit.append((names[0][o[away]], copies[1][g[away]]))
                if len(g):
                    every, local = np.unique(np.concatenate([names[1][g], names[0][o]]), return_inverse=True)
                    a, b = local[: len(g)], local[len(g) :]
                    need = _forest(a, b, len(every))
                    edges.append(np.stack([every[a[need]], every[b[need]]], axis=1))
        ids = np.concatenate([c[0] for c in credit]) if credit else np.zeros(0, np.int64)
        weights = np.concatenate([c[1] for c in credit]) if credit else np.zeros(0, np.int64)
        named, where = np.unique(ids, return_inverse=True)
        total = np.bincount(where, weights=weights, minlength=len(named)).astype(np.int64)
        pairs = np.concatenate(edges)
        return pa.table({"a": pa.array(np.concatenate([named, pairs[:, 0]])), "b": pa.array([None] * len(named) + pairs[:, 1].tolist(), pa.int64()), "links": pa.array(total.tolist() + [None] * len(pairs), pa.int64())})

    met = written(residents.unionByName(visitors).groupBy("cell", "rb", "gb").applyInArrow(compared, "a long, b long, links long"), "met")
    degree = met.filter("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    total = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    known = written(nodes.join(degree, "node", "left").select("v", "copies", "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "known")
    vector_of = written(look_up(sent, known, "v", "copies", total).select("id", "node", "n_links"), "owners")
    # an id with several vectors joins them
    several = vector_of.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("id", "a")
    twice = vector_of.join(several, "id").select("a", F.col("node").alias("b"))
    groups = components(met.filter("b is not null").select("a", "b").unionByName(twice))
    grouped = nodes.join(groups, "node", "left").select("node", "copies", "name", F.coalesce("component", "node").alias("group"))
    least = grouped.groupBy("group").agg(F.min("name").alias("component_id"), F.count("*").alias("weight"))
    placed_in = written(look_up(grouped.drop("name"), least, "group", "weight", nodes.count()).drop("group"), "groups")
    forget(cellular), forget(met), forget(known)
    named = look_up(vector_of, placed_in, "node", "copies", total).groupBy(F.col("id").alias("kid")).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("id").join(named, F.col("id") == F.col("kid"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_representatives(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The rows of vectors that near_duplicates() keeps, with all their columns."""
    name = free_name(vectors.columns, "_gone")
    gone = near_duplicates(vectors, id_col=id_col, vector_col=vector_col).filter("not kept").select(F.col(id_col).alias(name)).distinct()
    return vectors.join(gone, F.col(id_col) == F.col(name), "left_anti")


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: DuckDB SQL for op4_near_vectors, by brute force.
OP4_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS len FROM e
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.len * b.len) >= 0.9
), reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id)::BIGINT AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
