"""A corpus from raw documents to token ids: clean, remove near copies, protect, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
`documents`.  Null, empty and repeated rows and empty tables have the results that the stages'
operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm.byte_bpe import encode_texts
from riskloom.llm.chosen_path import one_of_each
from riskloom.llm.mixing import mixed_documents
from riskloom.llm.pii_disclosure import sanitised
from riskloom.llm.quality_lines import cleaned_documents
from riskloom.llm.shared import stored, table


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail the base rules or lose too much text go."""
    return _recounted(cleaned_documents(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced or removed."""
    return _recounted(sanitised(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every document of the mix."""
    encoded = encode_texts(docs.select("doc_id", "source", "text"))
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality),
    ("near copies", near_copies),
    ("personal data", personal_data),
    ("mixture", mixture),
    ("token ids", token_ids),
]
#: Merges of byte pairs are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
