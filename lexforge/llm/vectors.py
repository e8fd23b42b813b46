"""What the operators on vectors share: valid vectors, and blocks of them as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null or empty and hold finite components only."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls, of one length, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def bounded_sample(vectors: DataFrame, id_col: str, vector_col: str, bound: int) -> np.ndarray:
    """At most bound vectors, those with the smallest hash of the id, on the driver; the longest form only."""
    rows = vectors.select(id_col, vector_col).orderBy(F.xxhash64(id_col), id_col).limit(bound)
    table = rows.select(F.transform(vector_col, lambda x: x.cast("double")).alias("v")).toArrow()
    kept = [v for v in table.column("v").to_pylist() if v]
    if not kept:
        return np.zeros((0, 0))
    lengths = [len(v) for v in kept]
    width = max(set(lengths), key=lengths.count)
    return np.array([v for v in kept if len(v) == width], np.float64)


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a partition in tables of about so many rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - count)
            held.append(part)
            at, count = at + part.num_rows, count + part.num_rows
            if count >= rows:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)
