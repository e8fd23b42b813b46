"""Filters by the meaning of texts: cosine similarity to reference vectors, and a store of embeddings by content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import column


def cosine_to(vector: Column | str, reference: list[float], epsilon: float = 1e-8) -> Column:
    """Cosine with one reference vector; a small number is added to the divisor."""
    v = F.transform(column(vector), lambda x: x.cast("double"))
    ref = F.array(*[F.lit(float(x)) for x in reference])
    dot = F.aggregate(F.zip_with(v, ref, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (size * F.lit(float(np.linalg.norm(reference))) + F.lit(epsilon))


def best_similarity(rows: DataFrame, references: list[list[float]], *, vector: str = "embedding", out: str = "similarity", epsilon: float = 1e-8) -> DataFrame:
    """rows with the largest cosine to any reference; the references, a stated list, go to the workers as one matrix."""
    matrix = np.array(references, dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1)

    @F.pandas_udf("double")
    def best(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="float64")
        x = np.stack(vectors.map(lambda v: np.asarray(v, dtype=np.float64)))
        return pd.Series((x @ matrix.T / (np.outer(np.linalg.norm(x, axis=1), norms) + epsilon)).max(axis=1))

    return rows.withColumn(out, best(F.col(vector)))


def semantic_filter(rows: DataFrame, references: list[list[float]] | None, *, vector: str = "embedding", least: float = 0.35) -> DataFrame:
    """Rows at least so similar to a reference; all rows where there are no references or no vectors."""
    if not references or vector not in rows.columns:
        return rows
    return best_similarity(rows, references, vector=vector, out="_similarity").filter(F.col("_similarity") >= least).drop("_similarity")


def missing_embeddings(rows: DataFrame, store: DataFrame, *, text: str = "text") -> DataFrame:
    """text_hash and text of the distinct texts that the store (text_hash, embedding) does not have."""
    return rows.select(F.sha2(text, 256).alias("text_hash"), text).dropDuplicates(["text_hash"]).join(store.select("text_hash"), "text_hash", "left_anti")


def embed(rows: DataFrame, model: Callable[[list[str]], np.ndarray], *, text: str = "text", batch: int = 256) -> DataFrame:
    """text_hash and embedding of each row of missing_embeddings(); the model sees batches of texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"text_hash": part["text_hash"], "embedding": list(np.asarray(model(part[text].tolist()), dtype=np.float32))})

    return rows.mapInPandas(run, "text_hash string, embedding array<float>")
