"""From raw documents to packed sequences, one operator a stage.

Every stage takes what its predecessor kept, as a table read back from Parquet,
and returns the columns of documents; the last returns the packed pieces.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packledger.llm import langid, mixing, near_copies, packing, secret_scan
from packledger.llm.common import prepare, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in their text, languages that are null predicted; null texts go."""
    prepare(spark)
    return langid.identified(docs, langid.fit(docs.where(langid.learnable())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies, edited ones included: five-word shingles, 0.8 of them shared."""
    prepare(spark)
    return near_copies.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets blanked out of their texts."""
    prepare(spark)
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; a source that has run dry leaves the rest to the others."""
    prepare(spark)
    return mixing.in_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and places in sequences, which follow the order of the mix."""
    prepare(spark)
    return packing.pack_in_order(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets),
          ("mix", mix), ("pack", pack)]

#: Learned models and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
