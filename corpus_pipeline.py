"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``docs``, extra ones with any names
included. Texts of any length are read whole, and an empty table gives an empty result, in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm.exact_dedup import drop_exact_copies
from strandmill.llm.jaccard import drop_near_copies
from strandmill.llm.language import documents_with_language
from strandmill.llm.mixing import mixed_documents
from strandmill.llm.packing import pack_documents
from strandmill.llm.queries import tokenizer_file
from strandmill.sources.shared import fresh_path
from strandmill.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: null texts and those without letters go, and those of which the languages found explain less than 40 %.

    Rows are judged one by one, whatever their ids, and equal rows alike; null languages and sources have no say.
    """
    return documents_with_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the largest id, of those with equal texts; null texts equal empty ones, null ids count as smallest, and of equal rows one stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group linked by a Jaccard similarity of 0.8 on five-word shingles.

    Rows are dropped, not ids: rows with null or repeated ids are judged by their own texts, and of
    equal rows one stays. Documents without words all stay.
    """
    return drop_near_copies(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1, repeating; documents of scarce sources up to three times. Null sources are one source, last in order; documents without words go."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens; null texts are empty, repeated rows are packed each."""
    return pack_documents(docs, tokenizer_file(), 1024)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the language model nor tokenisation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
