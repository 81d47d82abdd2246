"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_totals


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, shard and slot (its place in the shard).

    Documents are put in order of id. Global prefix sums of their sizes come from per-partition totals; a document goes to
    the shard in whose equal share of all bytes its middle byte lies, so a shard misses the target by less than one
    document on either side. Slots run in the same order, gapless from 0.

    A null text has no bytes and CRC-32 of the empty string; null ids come first; equal ids are ordered by CRC, size and
    row. A document larger than a target fills its shard alone and may leave neighbours empty. An empty table gives an
    empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sized = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = running_totals(sized, ["id", "text_crc32", "size"], ["size"])
    total = sized.agg(F.sum("size")).first()[0] or 1
    cut = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((2 * size_before + size) * {shards}) div {2 * total}")).cast("int"))
    first = cut.groupBy("shard").agg(F.min("index").alias("first"))  # a row for each shard
    return cut.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"))
