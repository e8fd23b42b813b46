"""Operator 8: toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its first bytes, so that new words with a
known stem are known too.  Filters of several widths run over all words of the whole text, the largest response of
each filter is kept, and a linear layer gives the logit.  On labelled rows kept apart, a threshold is chosen for each
language and the logits are shifted so that every threshold lies at THRESHOLD.  The language used here is read from
the text's words by a hashed table; labels, lang, source and doc_id are no inputs of a score.

Null and empty texts are scored as a text without words.  Without labels, or with one class only, every score is the
smoothed share of class 1.  Repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import sample
from .textops import held_out, mix, relieved, tidied, word_hashes

BITS = 15
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Most labelled rows that a model is fitted on.
BOUND = 6000
THRESHOLD = 0.3
#: Languages that may have a threshold of their own: those with most labelled rows; a text is taken to be in one of them.
LANGUAGES = 64
_PARTS = (4, 5, 7)
_PAD = 1 << BITS  # row of zeros after the last word of each document


def words_of(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, rows of the embedding table for each word, offsets by document)."""
    mask = np.uint64((1 << BITS) - 1)
    for first, words, bounds, heads in word_hashes(column, _PARTS):
        yield first, np.stack([(h & mask).astype(np.int32) for h in (words, *(mix(x + np.uint64(21)) for x in heads))], axis=1), bounds


def padded(cells: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of documents one after another with as many pads after each as the widest filter, where each begins, and
    which rows a filter may start on: the words, or the first pad of a document without any."""
    gap, count = max(WIDTHS), np.diff(bounds)
    n = len(count)
    starts = bounds[:-1] - bounds[0] + gap * np.arange(n)
    whole = np.full((int(bounds[-1] - bounds[0]) + gap * n + gap, cells.shape[1]), _PAD, np.int32)
    at = np.arange(int(bounds[-1] - bounds[0])) + gap * np.repeat(np.arange(n), count)
    whole[at] = cells[bounds[0] : bounds[-1]]
    live = np.zeros(len(whole), bool)
    live[at] = True
    live[starts] = True
    return whole, starts, live


def joined(cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return padded(np.concatenate(cells), np.concatenate([[0], np.cumsum([len(c) for c in cells])]))


@dataclass
class Model:
    table: np.ndarray
    kernels: list[np.ndarray]
    offsets: list[np.ndarray]
    dense: np.ndarray
    bias: float
    langs: np.ndarray
    shifts: np.ndarray

    def pooled(self, cells: np.ndarray, starts: np.ndarray, live: np.ndarray) -> np.ndarray:
        """The largest response of every filter in every document."""
        out, size = [], len(cells) - max(WIDTHS) + 1
        x = self.table[cells[:, 0]]
        for k in range(1, cells.shape[1]):
            x += self.table[cells[:, k]]
        for width, kernel, offset in zip(WIDTHS, self.kernels, self.offsets, strict=True):
            response = x[:size] @ kernel[0]
            for k in range(1, width):
                response += x[k : size + k] @ kernel[k]
            response[~live[:size]] = -np.inf
            out.append(np.maximum(np.maximum.reduceat(response, starts, axis=0) + offset, 0))
        return np.concatenate(out, axis=1)

    def language(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The number of the likeliest language of each document; 0 where nothing was learned."""
        n = len(bounds) - 1
        if self.langs.shape[1] < 2 or not len(words):
            return np.zeros(n, np.int64)
        total = np.zeros((len(words) + 1, self.langs.shape[1]), np.float64)
        np.cumsum(self.langs[words], axis=0, out=total[1:])
        return np.argmax(total[bounds[1:]] - total[bounds[:-1]], axis=1)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for first, cells, bounds in words_of(column):
            n = len(bounds) - 1
            logit = self.pooled(*padded(cells, bounds)) @ self.dense + self.bias
            out[first : first + n] = logit + self.shifts[self.language(cells[:, 0], bounds)]
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def evidence(cells: list[np.ndarray], y: np.ndarray, *, least: int = 3, prior: float = 3.0) -> np.ndarray:
    """For each row of the table, the shrunk log odds of class 1 among documents with it; 0 below least documents."""
    counts = np.zeros((2, _PAD + 1))
    for c, k in zip(cells, y, strict=True):
        counts[int(k), np.unique(c)] += 1
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    total = counts.sum(axis=0)
    p = (counts[1] + prior * share) / (total + prior)
    return np.where(total >= least, np.log(p / (1 - p)) - np.log(share / (1 - share)), 0.0)


def train(cells: list[np.ndarray], y: np.ndarray, *, rounds: int = 4, batch: int = 32, rate: float = 0.05, seed: int = 5) -> Model:
    """Filters, embeddings and the linear layer by Adagrad on the logistic loss, classes weighted to balance.

    The first component of an embedding starts from evidence() and every filter starts open to it: from noise alone,
    the largest response among hundreds of words rarely is the telling word's, and only the largest is learned from.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (_PAD + 1, DIM)).astype(np.float32)
    table[:, 0] = 0.3 * evidence(cells, y)
    table[_PAD] = 0
    kernels = [rng.normal(0, 1 / np.sqrt(DIM * w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for kernel in kernels:
        kernel[:, 0, :] = np.abs(kernel[:, 0, :]) + 0.2
    offsets = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    dense = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
    model = Model(table, kernels, offsets, dense, 0.0, np.zeros((_PAD, 1), np.float32), np.zeros(1))
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    seen = {"table": np.full(table.shape, 1e-2, np.float32), "dense": np.full(dense.shape, 1e-1), "bias": 1e-1, "k": [np.full(k.shape, 1e-1, np.float32) for k in kernels], "o": [np.full(FILTERS, 1e-1, np.float32) for _ in WIDTHS]}
    order = np.argsort([len(c) for c in cells], kind="stable")
    for _ in range(rounds):
        for at in rng.permutation(range(0, len(order), batch)):
            rows = order[at : at + batch]
            ids, starts, _ = joined([cells[r] for r in rows])
            size = len(ids) - max(WIDTHS) + 1
            x = table[ids].sum(axis=1)
            ends = starts + np.maximum([len(cells[r]) for r in rows], 1)
            peaks, pooled = [], []
            for width, kernel, offset in zip(WIDTHS, kernels, offsets, strict=True):
                response = x[:size] @ kernel[0]
                for k in range(1, width):
                    response += x[k : size + k] @ kernel[k]
                peak = np.stack([a + response[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
                peaks.append(peak)
                pooled.append(np.take_along_axis(response, peak, axis=0) + offset)
            before = np.concatenate(pooled, axis=1)
            hidden = np.maximum(before, 0)
            logit = hidden @ dense + model.bias
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            back = (error[:, None] * dense[None, :] * (before > 0)).astype(np.float32)
            g = hidden.T @ error + 1e-5 * dense
            seen["dense"] += g * g
            dense -= (rate * g / np.sqrt(seen["dense"])).astype(np.float32)
            seen["bias"] += float(error.sum()) ** 2
            model.bias -= rate * float(error.sum()) / np.sqrt(seen["bias"])
            touched, slopes = [], []
            for w, (width, kernel) in enumerate(zip(WIDTHS, kernels, strict=True)):
                b, peak = back[:, w * FILTERS : (w + 1) * FILTERS], peaks[w]
                g = np.zeros_like(kernel)
                for k in range(width):
                    g[k] = np.einsum("nfd,nf->df", x[peak + k], b)
                    touched.append(ids[peak + k].reshape(-1, ids.shape[1]))
                    slopes.append((b[:, :, None] * kernel[k].T[None]).reshape(-1, DIM))
                seen["k"][w] += g * g
                kernel -= rate * g / np.sqrt(seen["k"][w])
                g = b.sum(axis=0)
                seen["o"][w] += g * g
                offsets[w] -= rate * g / np.sqrt(seen["o"][w])
            slope = np.concatenate(slopes)
            live = np.abs(slope).max(axis=1) > 0
            at_rows, slope = np.concatenate(touched)[live], slope[live]
            for k in range(at_rows.shape[1]):
                rows_k, where = np.unique(at_rows[:, k], return_inverse=True)
                g = np.zeros((len(rows_k), DIM), np.float32)
                np.add.at(g, where, slope)
                g[rows_k == _PAD] = 0
                seen["table"][rows_k] += g * g
                table[rows_k] -= rate * g / np.sqrt(seen["table"][rows_k])
    return model


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, in the middle between the logits beside it."""
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    s = logit[order]
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1)


@relieved
def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> Model:
    """A model of the label from at most bound labelled rows that are not held out; languages serve to fit only."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, found, bounds in words_of(batch.column(1)):
                n = len(bounds) - 1
                packed = [found[bounds[k] : bounds[k + 1]].tobytes() for k in range(n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, n) for k in (0, 2, 3)), pa.array(packed, pa.binary())], names=["doc_id", "label", "lang", "cells"])

    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else None
    rows = sample(docs, labels, label, bound=bound, id_col=id_col, text_col=text_col, lang=lang).select("doc_id", "text", "label", "lang")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("cells", T.BinaryType())])
    table = rows.mapInArrow(tidied(cells), schema).toArrow().sort_by([("doc_id", "ascending")])
    y = np.array(table.column("label").to_pylist(), dtype=np.float32)
    x = [np.frombuffer(b, np.int32).reshape(-1, len(_PARTS) + 1) for b in table.column("cells").to_pylist()]
    spoken = table.column("lang").to_pylist()
    del table
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2) if len(y) else 0.5
        none = Model(np.zeros((_PAD + 1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), float(np.log(share / (1 - share))), np.zeros((_PAD, 1), np.float32), np.zeros(1))
        return none
    apart = np.arange(len(y)) % 4 == 3
    if min(y[apart].sum(), y[~apart].sum()) < 2:
        apart = np.zeros(len(y), bool)
    keep = np.flatnonzero(~apart)
    model = train([x[k] for k in keep], y[keep])
    often = Counter(s for s in spoken if s is not None)
    names = sorted(sorted(often, key=lambda s: (-often[s], s))[:LANGUAGES])
    if len(names) > 1:
        counts = np.full((_PAD, len(names)), 0.05)
        for c, s in zip(x, spoken, strict=True):
            if s in names:
                np.add.at(counts[:, names.index(s)], np.unique(c[:, 0]), 1)
        model.langs = (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32)
        model.langs -= model.langs.mean(axis=1, keepdims=True)
    check = np.flatnonzero(apart) if apart.any() else keep
    logit, guess = np.zeros(len(check)), np.zeros(len(check), np.int64)
    for at in range(0, len(check), 64):
        part = [x[k] for k in check[at : at + 64]]
        logit[at : at + 64] = model.pooled(*joined(part)) @ model.dense + model.bias
        guess[at : at + 64] = [int(model.language(c[:, 0], np.array([0, len(c)]))[0]) for c in part]
    known = y[check]
    shared = best_cut(logit, known)
    at = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    model.shifts = np.full(max(len(names), 1), at - shared)
    for k in range(len(names) if len(names) > 1 else 0):
        own = guess == k
        if known[own].sum() >= 10 and (1 - known[own]).sum() >= 10:
            model.shifts[k] = at - best_cut(logit[own], known[own])
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, and 128 KB for each of at most LANGUAGES languages

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array(s >= threshold).cast(pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("_held"), F.col(text_col)).mapInArrow(tidied(scored), schema)


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array(sent.value.scores(batch.column(at)) < threshold)
            for k in range(0, batch.num_rows, 1024):  # in parts, which do not copy the whole batch at a time
                yield batch.slice(k, 1024).filter(good.slice(k, 1024))

    return docs.mapInArrow(tidied(clean), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
