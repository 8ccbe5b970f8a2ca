"""Five stages over documents; each is written as Parquet and read again as the next one's input.

All stages but the last return the columns of documents, whatever further ones there are and whatever their
names. A row goes by its own id and text: rows that share an id, null ids among them, are judged apart. Null
texts are read as empty. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelake.llm import decontam, linededup, pieces, quality, simhash
from sitelake.llm.common import settled
from sitelake.llm.queries import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go (null and empty texts among them); the others lose the lines that
    too many documents of their source repeat, but for the first of these."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the one with the smallest id. Documents stay, if without text."""
    return linededup.keep_unique_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id; of ties that with the
    smallest text hash, of rows equal in both one. Texts without words are a group."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go. Texts without words stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with the digest of their decoding; a row for each document, without ids for an empty text."""
    return pieces.encoding_digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SQL can't express the last stages; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
    return docs
