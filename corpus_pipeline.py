"""The corpus pipeline: documents in, packed training sequences out.

Each stage reads all that the stage before it kept and writes what it keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symweave.llm import decontaminate, language, packing, pii, simhash
from symweave.llm.common import id_bucket, materialise, table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found; the network learns from the labelled rows of three of four ids."""
    return language.keep_identified(docs, language.train(docs.where(id_bucket("doc_id", 4) != 2)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of copies."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts; drop documents that are mostly benchmark."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data with surrogates."""
    return pii.anonymise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise, concatenate and cut into windows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_copies),
    ("decontaminate", remove_benchmark),
    ("surrogates", replace_personal_data),
    ("pack", pack_sequences),
]

#: Networks and tokenizers are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
