"""Operator 3: quality by naive Bayes support vectors.

Indicators of hashed n-grams are scaled by the classes' log-count ratios and, so that long texts do not weigh more, by
one over the root of their number; a linear model with hinge loss is fitted to them by dual coordinate descent, and a
sigmoid fitted on rows kept apart turns its margin into a score.  The n-grams are words and pairs of neighbours, where a
word next to itself is one feature whatever the word, and of each word its last character, its last three and how many
of its letters are capitals (0 to 3).  Every word of every text counts; labels, languages, sources and ids are no inputs
of a score.

Null and empty texts have no features and get the score of the bias alone.  With no labels at all every score is 0.5,
with one class only it is that class's smoothed share.  Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import sample
from .textops import held_out, mix, relieved, tidied, word_hashes

BITS = 18
#: Most labelled rows that a model is fitted on.
BOUND = 6000
THRESHOLD = 0.7
_PARTS = (-1, -3, 0)


def features(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, number of documents, document of each feature, feature), each feature once a document."""
    mask = np.uint64((1 << BITS) - 1)
    for first, words, bounds, (end1, end3, capitals) in word_hashes(column, _PARTS):
        n = len(bounds) - 1
        owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
        cells, owners = [words, mix(end1 + np.uint64(11)), mix(end3 + np.uint64(12)), mix(np.minimum(capitals, np.uint64(3)) + np.uint64(13))], [owner] * 4
        if len(words) > 1:
            same = owner[1:] == owner[:-1]
            pairs = mix(words[:-1] * np.uint64(3) + words[1:])
            pairs[words[:-1] == words[1:]] = mix(np.array([31], np.uint64))[0]  # a word twice is one n-gram, whatever the word
            cells.append(pairs[same])
            owners.append(owner[1:][same])
        keys = np.unique(np.concatenate([(o << BITS) | (c & mask).astype(np.int64) for c, o in zip(cells, owners, strict=True)]))
        yield first, n, keys >> BITS, keys & int(mask)


@dataclass
class Model:
    """weight of each feature with the ratios multiplied in, bias, and the sigmoid's slope and shift."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for first, n, owner, cell in features(column):
            total = np.bincount(owner, weights=self.weight[cell], minlength=n)
            size = np.maximum(np.bincount(owner, minlength=n), 1)
            out[first : first + n] = total / np.sqrt(size) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.shift, -40, 40)))


def dual_descent(rows: list[tuple[np.ndarray, float]], y: np.ndarray, ratio: np.ndarray, *, cost: np.ndarray, rounds: int = 8, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model with hinge loss; each step solves the dual for one row exactly."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros_like(ratio), 0.0, np.zeros(len(rows))
    square = np.array([float((ratio[c] ** 2).sum()) * s * s + 1 for c, s in rows])
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            cells, scale = rows[i]
            x = ratio[cells] * scale
            slope = y[i] * (float(w[cells] @ x) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[cells] += step * x
                bias += step
    return w, bias


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with smoothed targets."""
    positive, negative = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, shift = 1.0, float(np.log((positive + 1) / (negative + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * slope, (p - target).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(slope), 0.0), float(shift)


@relieved
def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", *, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the label from at most bound labelled rows that are not held out."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, owner, cell in features(batch.column(1)):
                ends = np.searchsorted(owner, np.arange(n + 1))
                packed = [cell[ends[k] : ends[k + 1]].astype(np.int32).tobytes() for k in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(packed, pa.binary())], names=["doc_id", "label", "cells"])

    rows = sample(docs, labels, label, bound=bound, id_col=id_col, text_col=text_col).select("doc_id", "text", "label")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("cells", T.BinaryType())])
    table = rows.mapInArrow(tidied(cells), schema).toArrow().sort_by([("doc_id", "ascending")])
    y = np.array(table.column("label").to_pylist(), dtype=float)
    x = [np.frombuffer(b, np.int32) for b in table.column("cells").to_pylist()]
    width = 1 << BITS
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model(np.zeros(width), 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = np.ones((2, width))
    for c, k in zip(x, y, strict=True):
        counts[int(k), c] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows_x = [(c, 1 / np.sqrt(max(len(c), 1))) for c in x]
    sign = np.where(y > 0, 1.0, -1.0)
    share = y.mean()
    cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    apart = np.arange(len(y)) % 4 == 3
    margins = np.zeros(len(y))
    if min(y[apart].sum(), (1 - y[apart]).sum()) < 2 or min(y[~apart].sum(), (1 - y[~apart]).sum()) < 2:
        apart = np.ones(len(y), dtype=bool)
        w, bias = dual_descent(rows_x, sign, ratio, cost=cost)
    else:
        keep = np.flatnonzero(~apart)
        held = np.ones((2, width))
        for k in keep:
            held[int(y[k]), x[k]] += 1
        ratio_kept = np.log(held[1] / held[1].sum()) - np.log(held[0] / held[0].sum())
        w, bias = dual_descent([rows_x[k] for k in keep], sign[keep], ratio_kept, cost=cost[keep])
        for k in np.flatnonzero(apart):
            margins[k] = float((w[x[k]] * ratio_kept[x[k]]).sum()) * rows_x[k][1] + bias
        slope, shift = sigmoid_fit(margins[apart], y[apart])
        w, bias = dual_descent(rows_x, sign, ratio, cost=cost)
        return Model(w * ratio, bias, slope, shift)
    for k in range(len(y)):
        margins[k] = float((w[x[k]] * ratio[x[k]]).sum()) * rows_x[k][1] + bias
    slope, shift = sigmoid_fit(margins, y)
    return Model(w * ratio, bias, slope, shift)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array(s >= threshold).cast(pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("_held"), F.col(text_col)).mapInArrow(tidied(scored), schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
