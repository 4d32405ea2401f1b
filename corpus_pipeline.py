"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselake.llm import bagminhash, decontamination, langid, packing, substring_dedup
from caselake.llm.common import Scratch, read_documents
from caselake.llm.tokens import default_path

#: A document stays if its language has at least this share of the letters.
MIN_LANGUAGE_SHARE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter, texts in which no language has MIN_LANGUAGE_SHARE of the letters, and long enough texts that fit no language.

    Each row is judged by its own text: rows with a null id stay or go like others, and so do rows that share an id.
    """
    return langid.keep_clear(docs, langid.fit(langid.training_rows(docs)), MIN_LANGUAGE_SHARE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each near-duplicate class, with all rows of that id.

    A document is a doc_id: rows that repeat the kept id stay, exact copies of each other too. Rows with a null id are in no class and
    stay; null or wordless texts are classes of their own.
    """
    return bagminhash.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out what windows of 50 words repeat from documents with a smaller id; every document stays.

    Rows with a null id or text stay as they are; rows that share an id are no sources for each other.
    """
    return substring_dedup.remove_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which tiles cover half of a benchmark item or more; a tie at the share drops.

    All rows of such a doc_id go; rows with a null id or text stay; null, empty and very short items drop nothing.
    """
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place; null texts are one token, rows that repeat an id or have none are packed like others."""
    return packing.pack(docs, default_path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]

#: The stages are not expressible in SQL; tests/llm compares them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents under ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs, before = read_documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
