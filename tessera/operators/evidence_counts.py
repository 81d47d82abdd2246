"""Counts of evidence that stand side by side and are never summed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a council wrote, and states of ingested documents.
COUNCIL = "council."
STATES = {"extracted": "documents_extracted", "metadata_only": "documents_metadata_only", "extraction_failed": "documents_failed"}
CHANNELS = ["issuer_documents", "regulator_facts", "regulator_filings", "issuer_newsroom", "stored_citations"]


def reconciliation(evidence: DataFrame, citations: DataFrame, links: DataFrame, run: str) -> DataFrame:
    """For each run of evidence (is_fact, is_metadata, excerpt, is_reference), citations (source_id, field_path) and links from council
    claims to evidence (content_hash): references, extracted evidence (with an excerpt, neither fact nor metadata), facts, distinct
    sources (ids and hashes), citations and links. A citation that the council wrote counts as a link alone. Three counts, joined."""
    e = evidence.groupBy(run).agg(F.count_if("is_reference").alias("references"), F.count_if(~F.col("is_fact") & ~F.col("is_metadata") & (F.trim(F.coalesce("excerpt", F.lit(""))) != "")).alias("extracted"), F.count_if("is_fact").alias("facts"))
    own = citations.filter(~F.coalesce(F.col("field_path").startswith(COUNCIL), F.lit(False)))
    c = own.groupBy(run).agg(F.countDistinct("source_id").alias("__ids"), F.count(F.lit(1)).alias("__rows"))
    k = links.groupBy(run).agg(F.countDistinct("content_hash").alias("__hashes"), F.count(F.lit(1)).alias("links"))
    x = e.join(c, run, "full").join(k, run, "full").na.fill(0)
    return x.select(run, "references", "extracted", "facts", (F.col("__ids") + F.col("__hashes")).alias("sources"), (F.col("__rows") + F.col("links")).alias("citations"), "links")


def document_states(documents: DataFrame, run: str, status: str) -> DataFrame:
    """For each run how many documents gave text, metadata alone, or nothing; other states count nowhere."""
    return documents.groupBy(run).agg(*[F.count_if(F.col(status) == s).alias(name) for s, name in STATES.items()])


def channels(counts: DataFrame, run: str) -> DataFrame:
    """A row for each run and channel: whether it is available, and its own count, from documents_extracted, fact_fields (of regulators),
    filing_events, press_events, citations and links. One channel's absence says nothing of another."""
    own = ["documents_extracted", "fact_fields", "filing_events", "press_events"]
    n = [F.coalesce(F.col(c), F.lit(0)).cast("long") for c in own] + [(F.coalesce(F.col("citations"), F.lit(0)) + F.coalesce(F.col("links"), F.lit(0))).cast("long")]
    rows = F.array(*[F.struct(F.lit(name).alias("channel"), (count > 0).alias("available"), count.alias("n")) for name, count in zip(CHANNELS, n)])
    return counts.select(run, F.inline(rows))
