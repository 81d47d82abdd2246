"""A corpus pipeline of operators from tessera.llm: each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, language, mixing, packing, simhash
from tessera.llm.common import stored
from tessera.llm.queries import TOKENIZER


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, as language.accepted_only defines it: a null or empty text is judged by what its row
    declares, repeated rows stay or go together, other columns pass whatever their names; an empty table stays empty."""
    return language.accepted_only(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null equals empty) the row with the largest doc_id, null being the smallest; of equal rows one. Columns pass."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked fingerprints; texts without words are one group. Columns pass."""
    return simhash.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each pass over it; documents without words are in none. Null sources
    are one source; columns pass."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. A null text would be empty, its end id alone; equal ids are packed each by itself."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a written table in the shared folder between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
