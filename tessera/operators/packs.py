"""Evidence packs and company records: parsing a thesis, matching sectors, composing snapshots, choosing excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Phrases of theses, by what they name, and aliases of sectors.
THESIS = {"theme": {"the ": "trade", "tion": "motion", "und ": "union"}, "region": {" les ": "europe", " los ": "south", " der ": "north"}, "exclusion": {"without ": "without", "sans ": "sans"}}
SECTORS = {"economy": "consumer", "standard": "consumer", "promo": "consumer", "small": "industrial", "medium": "industrial", "large": "energy"}


def parse_thesis(text: Column) -> dict[str, Column]:
    """Values that the text's phrases name, by kind; confidence grows with the signals up to one at eight; under two themes it needs narrowing."""
    low = F.lower(text)
    found = {kind: F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), v) for p, v in table.items()]))) for kind, table in THESIS.items()}
    signals = sum((F.size(v) for v in found.values()), F.lit(0))
    out = {k: F.array_join(v, ",") for k, v in found.items()}
    return out | {"confidence": F.least(F.lit(1.0), signals / 8.0), "needs_narrowing": F.size(found["theme"]) != 1}


def canonical_sector(value: Column) -> Column:
    """Canonical name of an alias, null if there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in SECTORS.items() for x in kv]), F.lower(F.trim(value)))


def sector_matches(wanted: Column, value: Column) -> Column:
    """An empty request matches all; else canonical names are equal, or without them the texts."""
    a, b = canonical_sector(wanted), canonical_sector(value)
    return F.coalesce(F.trim(wanted) == "", F.lit(True)) | F.coalesce(a == b, F.lower(wanted) == F.lower(value), F.lit(False))


def qualifying(facts: DataFrame, keys: list[str], field: str, ordinal: str, fields: list[str]) -> DataFrame:
    """Financial fields with a value, high confidence and group scope or none; the first of each field."""
    ok = facts.filter(F.col(field).isin(fields) & F.col("value").isNotNull() & (F.col("confidence") == "high") & (F.coalesce("scope", F.lit("")).isin("", "group")))
    return ok.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, field).orderBy(ordinal))).filter("__n = 1").drop("__n")


def comparable(candidates: DataFrame, keys: list[str], reasons: dict[str, Column], order: list[Column], cap: int) -> DataFrame:
    """The first reason to leave a candidate out; the others up to the cap are comparable, what lies beyond is capped."""
    reason = None
    for name, condition in reasons.items():
        reason = F.when(condition, name) if reason is None else reason.when(condition, name)
    rows = candidates.withColumn("reason", reason)
    w = Window.partitionBy(*keys, F.col("reason").isNull()).orderBy(*order)
    return rows.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.row_number().over(w) > cap, "over_cap").otherwise("comparable"))


def price_provenance(available: Column, own: Column, snapshot: Column, currency: Column, as_of: Column) -> dict[str, Column]:
    """Nothing unless prices are available; the price's own provider, else the snapshot's; `not_sourced` is no currency; the tier is always T5."""
    when = lambda x: F.when(available, x)
    return {"provider": when(F.coalesce(own, snapshot)), "tier": when(F.lit("T5")), "currency": when(F.nullif(currency, F.lit("not_sourced"))), "as_of": when(as_of), "status": F.when(available, "available").otherwise("unavailable")}


def excerpts(blocks: DataFrame, key: str, order: str, text: str, relevance: str, kind: str, most: int = 8, prefix: int = 160) -> DataFrame:
    """The first block leads; the rest by relevance, kinds in turn; of equal beginnings the first; at most `most`."""
    begin = F.substring(T.normalize_title(F.col(text)), 1, prefix)
    w = Window.partitionBy(key)
    rows = blocks.withColumn("lead", F.row_number().over(w.orderBy(order)) == 1)
    rows = rows.withColumn("__same", F.row_number().over(Window.partitionBy(key, begin).orderBy(F.desc("lead"), F.desc(relevance), order))).filter("__same = 1")
    rows = rows.withColumn("__round", F.row_number().over(Window.partitionBy(key, "lead", kind).orderBy(F.desc(relevance), order)))
    return rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("lead"), "__round", F.desc(relevance), order))).filter(F.col("place") <= most).drop("__same", "__round")


def evidence_pack(channels: DataFrame, key: str, priority: str, order: list[Column], cap: int) -> DataFrame:
    """Items of all channels by priority until the cap, numbered E1 on."""
    rows = channels.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(priority, *order))).filter(F.col("__n") <= cap)
    return rows.withColumn("label", F.concat(F.lit("E"), F.col("__n"))).drop("__n")


def snapshot(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """one record with what is there and the names of what isn't."""
    lack = F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in fields]))
    return df.select(key, *fields, F.array_join(lack, ",").alias("missing"))


def weak_datapoints(points: DataFrame, keys: list[str], critical: list[str], strong: list[str]) -> DataFrame:
    """Datapoints without a source, and decision-critical ones from weak tiers only."""
    note = F.when(F.col("tier").isNull(), "unsourced").when(F.col("field").isin(critical) & ~F.col("tier").isin(strong), "weak_source")
    return points.withColumn("warning", note).filter("warning IS NOT NULL").select(*keys, "field", "tier", "warning")


def grid_facts(cells: DataFrame, keys: list[str], labels: dict[str, str]) -> DataFrame:
    """V1: rows whose first cell names a known label; each further number belongs to the period of its column's header; without one it stays an excerpt."""
    known = None
    for pattern, name in labels.items():
        test = F.lower(F.col("cells")[0]).rlike(pattern)
        known = F.when(test, name) if known is None else known.when(test, name)
    rows = cells.withColumn("label", known).filter("label IS NOT NULL").select(*keys, "label", "header", F.posexplode("cells").alias("column", "raw")).filter("column > 0")
    period = F.regexp_extract(F.get("header", F.col("column")), r"\b(199\d|20\d\d)\b", 1)
    return rows.select(*keys, "label", "column", F.nullif(period, F.lit("")).cast("int").alias("period"), T.number(F.col("raw")).alias("value")).filter("value IS NOT NULL").withColumn("status", F.when(F.col("period").isNull(), "excerpt_only").otherwise("candidate"))
