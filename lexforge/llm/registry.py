"""Queries and SQL of the operators in this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html, language, mixing, near_vectors, ngram_join, quality, top_products, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [ngram_join.op1_ngram_join, bpe.op2_bpe, quality.op3_quality, near_vectors.op4_near_vectors, bpe.op5_token_counts, top_products.op6_top_products, language.op7_language, toxicity.op8_toxicity, mixing.op9_mixing, html.op10_html]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": ngram_join.OP1_SQL, "op4_near_vectors": near_vectors.OP4_SQL, "op6_top_products": top_products.OP6_SQL, "op9_mixing": mixing.OP9_SQL}
