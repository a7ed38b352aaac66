"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Language identification drops what it rejects, near-duplicate removal keeps one document of
each group, personal data is replaced by its kind, the sources are mixed to their targets
(a row for each pass over a document), and the result is packed into windows of 1024 tokens.
A piece names its document, start and length, which with the text define its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import language_id, mixing, packing, pii, simhash_dedup
from tidemark.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose language is identified."""
    return language_id.screened(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group with Jaccard 0.8 over 5-word shingles."""
    return simhash_dedup.one_of_alike(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: texts with personal data replaced."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents as often as the mix takes them."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of the documents in sequences."""
    return packing.packed(stored(packing.pieces(docs)))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained models and vocabularies are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
