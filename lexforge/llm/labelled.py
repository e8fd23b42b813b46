"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import held_out


def sample(docs: DataFrame, labels: DataFrame, label: str, *, bound: int, id_col: str = "doc_id", text_col: str = "text", lang: Column | None = None) -> DataFrame:
    """doc_id, text, label and lang of at most bound labelled documents that are not held out.

    The rows are those with the smallest hash of the id, so they are a uniform sample and the same on every run.
    Ids are chosen from the narrow table of labels first; only theirs, at most bound, are sent to the documents.
    Of several labels of a document the largest holds; null labels, ids and texts are left out.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marked = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(bound)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (lang if lang is not None else F.lit(None)).cast("string").alias("lang")).filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")
