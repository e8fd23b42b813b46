"""A corpus pipeline: language, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents.  Between the stages the driver writes the rows and reads them again, as run() does in the shared
folder.  Labels come from sf_dir.

Null and empty texts, and those without letters, have no language and go in the first stage; so do all texts where no
document names a language.  Very long texts go through every stage whole.  Rows with null ids stay where ids decide; of
rows that repeat an id one stays among near duplicates.  Extra columns, whatever their names, are carried to the last
stage.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import bpe, language, mixing, ngram_join, toxicity
from lexforge.llm.textops import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text has no letter."""
    return language.drop_unknown(docs, language.fit(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources asks for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digests of the tokens of every row of the mix."""
    return bpe.encode_texts(docs)


STAGES = [("language", known_language), ("toxicity", not_toxic), ("near duplicates", one_of_each_group), ("mixing", mixed), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
