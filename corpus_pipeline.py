"""A training corpus from the documents table: language ID, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. ``run`` writes every stage's
result as Parquet in the shared folder, reads it again for the next and removes it once that is written.

Defined results: rows with null or empty text have no language and go at the first stage; a null doc_id stays, as no group can name it; of repeated
rows one stays; null sources are a source of their own; texts of any length pass whole; columns beyond those of documents are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import langid, mixing, pieces, pii, simhash
from quillgraph.llm.common import DOC_COLUMNS, removed, shared_dir, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the others go."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    return simhash.keep_first(docs.select(*DOC_COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs.select(*DOC_COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws, in shuffled order."""
    return mixing.mix(docs).select(*DOC_COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces and whether decoding gives the text back."""
    return pieces.encoded_documents(docs)


STAGES = [("language_id", known_language), ("simhash_dedup", near_duplicates), ("pii", personal_data), ("mixing", mixed), ("sentencepiece", encoded)]

#: The stages are not SQL-expressible; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's rows."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
        if before:
            removed(spark, before)
        before = f"{folder}/{k}_{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
