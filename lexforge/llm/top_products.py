"""Operator 6: exact top-k inner products by length order and rotated partial sums.

Vectors become whole numbers, floor(256 x) of every component.  A rotation, from the singular vectors of a bounded
sample, gathers most of the length in the first coordinates.  A query meets the candidates in blocks by descending
length: once the product of the lengths cannot reach its k-th best score, no later block can; within a block, a product
over the first coordinates plus the product of the remaining lengths (Cauchy-Schwarz) bounds every score, and only
candidates above the k-th best so far get their whole score, in exact integers.  The rotation decides only what is
skipped, with room for rounding, never a score.

Queries are a stated set and come in blocks.  A tile is a stripe of candidates, of like lengths, and some blocks of
queries: it is one task, which holds the stripe and lets the blocks pass one by one, so a stripe is sent once for all
the queries of a tile.  Each query's k-th best in the stripe of the longest candidates comes first and lets whole
stripes be left out.

Vectors that are null, empty or hold null or not finite components, and rows with null ids, take no part; a zero vector
does.  Vectors of different lengths do not meet.  Ties go to the smaller id.  Rows are told apart by a number of their
own, not by id: each row whose id is divisible by `every` is a query, so an id with several such rows has several
rankings, and its candidates are all other rows, those with its id included.  An empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textops import tidied, written
from .vectors import blocks, bounded_sample, matrix, usable

SCALE = 256
K = 5
EVERY = 50
#: Vectors that the rotation is computed from, at most.
SAMPLE = 8_192
#: Rotated coordinates of the first partial sum.
HEAD = 24
#: Candidates of a stripe, at most; queries of a block; candidates scored at once; blocks of a tile.
STRIPE = 65_536
QUERIES = 512
STEP = 2_048
TURNS = 64
#: Stripes that even a small table has, if each gets LEAST candidates.
SPREAD = 64
LEAST = 4_096


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors of the sample, strongest first."""
    if not len(sample):
        return np.zeros((0, 0))
    return np.linalg.svd(sample.T @ sample)[0]


class Prepared:
    """A block of vectors: ids, row numbers, whole numbers, lengths, first rotated coordinates, the lengths of the rest."""

    def __init__(self, names: np.ndarray, rows: np.ndarray, x: np.ndarray, turn: np.ndarray) -> None:
        self.names, self.rows, self.x = names, rows, x
        self.length = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        turn = turn[:, :HEAD] if turn.shape[0] == x.shape[1] else np.eye(x.shape[1])[:, :HEAD]
        self.head = np.concatenate([x[at : at + STEP].astype(np.float64) @ turn for at in range(0, len(x), STEP)])
        self.rest = np.sqrt(np.maximum(self.length**2 - (self.head * self.head).sum(axis=1), 0)) + 1e-6 * self.length

    def products(self, own: np.ndarray, other: Prepared, at: np.ndarray) -> np.ndarray:
        """Exact inner products of pairs of rows."""
        return np.concatenate([np.einsum("ij,ij->i", self.x[own[s : s + 100_000]].astype(np.float64), other.x[at[s : s + 100_000]].astype(np.float64)) for s in range(0, len(own), 100_000)])


def best_of(queries: Prepared, candidates: Prepared, k: int, floor: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(query, its row, candidate, score) of each query's k best among the candidates, which stand by descending length; what
    scores below the query's floor may be missing."""
    n = len(queries.names)
    scores = np.full((n, k), -np.inf)
    names = np.full((n, k), np.iinfo(np.int64).max)
    bar = floor.astype(float).copy()
    for at in range(0, len(candidates.names), STEP):
        part = slice(at, at + STEP)
        live = np.flatnonzero(queries.length * candidates.length[at] * (1 + 1e-9) + 1e-3 >= bar)
        if not len(live):
            break
        bound = queries.head[live] @ candidates.head[part].T + np.outer(queries.rest[live], candidates.rest[part])
        q, c = np.nonzero(bound * 1 + 1e-3 + 1e-9 * queries.length[live][:, None] * candidates.length[at] >= bar[live][:, None])
        q = live[q]
        keep = queries.rows[q] != candidates.rows[at + c]
        q, c = q[keep], at + c[keep]
        if not len(q):
            continue
        exact = queries.products(q, candidates, c)
        order = np.lexsort((candidates.names[c], -exact, q))
        q, c, exact = q[order], c[order], exact[order]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        top = rank < k
        fresh_s, fresh_n = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        fresh_s[q[top], rank[top]], fresh_n[q[top], rank[top]] = exact[top], candidates.names[c[top]]
        hit = np.unique(q)
        both_s, both_n = np.concatenate([scores[hit], fresh_s[hit]], axis=1), np.concatenate([names[hit], fresh_n[hit]], axis=1)
        order = np.lexsort((both_n, -both_s), axis=1)[:, :k]
        scores[hit], names[hit] = np.take_along_axis(both_s, order, axis=1), np.take_along_axis(both_n, order, axis=1)
        bar[hit] = np.maximum(bar[hit], scores[hit, k - 1])
    r, col = np.nonzero(np.isfinite(scores))
    return [(int(queries.names[i]), int(queries.rows[i]), int(names[i, j]), int(scores[i, j])) for i, j in zip(r, col, strict=True)]


def top_products(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of every query: the rows whose id is divisible by every."""
    live = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    live = live.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"), F.size("v").alias("dim"))
    live = live.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    live = written(live.withColumn("row", F.monotonically_increasing_id()), "vectors")  # written, so that rows keep their numbers
    shared = vectors.sparkSession.sparkContext.broadcast(rotation(bounded_sample(live, "id", "v", SAMPLE)))
    count, asked = live.count(), live.filter(F.col("id") % every == 0)
    stripes = max(1, -(-count // STRIPE), min(SPREAD, -(-count // LEAST)))
    groups = max(1, -(-asked.count() // QUERIES))
    parts = -(-groups // TURNS)

    def packed(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Rows of one partition, in their order, as blocks of one dimension."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in blocks(batches, size):
                dims = table.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = table.filter(pa.array(dims == dim))
                    x = matrix(part.column("v"))
                    x = x.astype(np.float32 if np.abs(x).max(initial=0) < 1 << 24 else np.float64)
                    names, rows = (part.column(c).to_numpy().tobytes() for c in ("id", "row"))
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([float(part.column("length").to_numpy().max())]), *(pa.array([b], pa.binary()) for b in (names, rows, x.tobytes()))], names=["dim", "longest", "names", "rows", "x"])

        return tidied(run)

    form = "dim int, longest double, names binary, rows binary, x binary"
    by_length = live.repartitionByRange(stripes, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    stripe = written(by_length.select("id", "row", "dim", "length", "v").mapInArrow(packed(STRIPE), form).withColumn("stripe", F.monotonically_increasing_id()), "stripes")
    asking = written(asked.repartition(groups, "row").select("id", "row", "dim", "length", "v").mapInArrow(packed(QUERIES), form).withColumn("block", F.monotonically_increasing_id()), "queries")

    def read(row: dict) -> Prepared:
        names, rows = (np.frombuffer(row[c], np.int64) for c in ("names", "rows"))
        x = np.frombuffer(row["x"], np.float32 if len(row["x"]) == 4 * len(names) * row["dim"] else np.float64)
        return Prepared(names, rows, x.reshape(len(names), row["dim"]), shared.value)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles: a row with a stripe, then those with its blocks of queries."""
        candidates = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["block"] < 0:
                    candidates = read(row)
                    continue
                queries = read(row)
                floor = np.frombuffer(row["floor"], np.float64) if row["floor"] else np.full(len(queries.names), -np.inf)
                found = best_of(queries, candidates, k, floor)
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(4)] + [pa.array([row["block"]] * len(found), pa.int64())], names=["query_id", "query_row", "vec_id", "score", "block"])

    def tiles(todo: DataFrame) -> DataFrame:
        """The best of the blocks and stripes of todo (block, stripe, floor)."""
        todo = todo.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
        held = todo.select("stripe", "part").distinct().join(stripe, "stripe").select("stripe", "part", F.lit(-1).cast("long").alias("block"), "dim", "names", "rows", "x", F.lit(None).cast("binary").alias("floor"))
        passing = todo.join(asking, "block").select("stripe", "part", "block", "dim", "names", "rows", "x", "floor")
        dealt = held.unionByName(passing).repartition(min(4 * stripes * parts, 4096), "stripe", "part").sortWithinPartitions("stripe", "part", "block")
        return dealt.select("block", "dim", "names", "rows", "x", "floor").mapInArrow(tidied(met), "query_id long, query_row long, vec_id long, score long, block long")

    lead = stripe.groupBy("dim").agg(F.min_by("stripe", F.struct(-F.col("longest"), F.col("stripe"))).alias("lead"))
    start = written(tiles(asking.select("block", "dim").join(lead, "dim").select("block", F.col("lead").alias("stripe"), F.lit(None).cast("binary").alias("floor"))), "leading")

    # each query's k-th best so far, in the block's order of queries
    kth = start.groupBy("block", "query_row").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query_row", "s"))).alias("kth"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = dict(row["kth"] or [])
                floor = np.array([float(known.get(int(x), -np.inf)) for x in np.frombuffer(row["rows"], np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["dim"]], pa.int32()), pa.array([row["longest"]]), pa.array([floor.tobytes()], pa.binary()), pa.array([float(floor.min(initial=np.inf))])], names=["block", "dim", "ql", "floor", "least"])

    bars = asking.select("block", "dim", "longest", "rows").join(kth, "block", "left").mapInArrow(floors, "block long, dim int, ql double, floor binary, least double")
    # blocks of the stated queries against stripes of all rows, by equal dimension; stripes too short to matter go
    others = stripe.select("dim", "stripe", F.col("longest").alias("pl")).join(lead, "dim").filter("stripe <> lead").select("dim", "stripe", "pl")
    todo = bars.join(others, "dim").filter(F.col("pl") * F.col("ql") * (1 + 1e-9) + 1e-3 >= F.col("least")).select("block", "stripe", "floor")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return start.unionByName(tiles(written(todo, "todo"))).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: DuckDB SQL for op6_top_products, by brute force.
OP6_SQL = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), p AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
