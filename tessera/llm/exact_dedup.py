"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, ascii_lower, kept_numbers, numbered, stored


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 1000) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256 and RID.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest id stays.

    Misra-Gries counters (Spark's approx_top_k keeps such a table per partition and merges them) name the digests that may
    hold over 1/share of the rows; they are counted exactly, and those that do (fewer than `share` by arithmetic) are
    broadcast with their winners, so their rows are decided where they are read. All other digests are shuffled.
    With m counters any digest over 3.5/m of the rows is found, and at most 1.75 * share can look as frequent.

    Null texts count as empty. A null id is smaller than any other; of rows with equal text and id exactly one stays. An
    empty table gives an empty result. Columns other than id and text are ignored. RID is that of docs, if it has one, as
    kept_numbers() gives it; a result can be joined with no other docs.
    """
    text = ascii_lower(F.col(text_col))
    keyed = stored(numbered(docs).select(F.col(id_col).alias("id"), F.sha2(text.cast("binary"), 256).alias("digest"), RID), "digests")
    n = keyed.count()
    found = keyed.agg(F.expr(f"approx_top_k(digest, {2 * share}, {8 * share})").alias("top")).select(F.explode("top.item").alias("digest"))
    groups = lambda df: df.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", RID)).alias("winner"))
    heavy = stored(groups(keyed.join(F.broadcast(found), "digest")).filter(F.col("group_size") > max(1, n // share)), "heavy")
    light = keyed.join(F.broadcast(heavy), "digest", "left_anti")
    decided = keyed.join(F.broadcast(heavy), "digest").unionByName(light.join(groups(light), "digest"))
    return decided.select(
        F.col("id").alias(id_col), F.col("winner.id").alias("keep_id"), "group_size", (F.col(RID) == F.col(f"winner.{RID}")).alias("kept"), F.col("digest").alias("text_sha256"), RID
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops; all columns stay, whatever their names. Null and empty texts are equal, so one of
    them stays; of rows with equal text and id one stays. Empty table, empty result."""
    docs = kept_numbers(docs)
    gone = exact_groups(docs, id_col, text_col).filter(~F.col("kept")).select(RID)
    return docs.join(gone, RID, "left_anti").drop(RID)
