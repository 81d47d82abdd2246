"""Event feeds: summaries, coverage, multi-source detection, news deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_histogram(df: DataFrame, status: str, keys: list[str] | None = None) -> DataFrame:
    """Rows per status, and all of them under the status `total`."""
    keys = keys or []
    counted = df.groupBy(*keys, F.coalesce(F.col(status), F.lit("unscored")).alias(status)).agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy(*keys).agg(F.sum("n").alias("n")).select(*keys, F.lit("total").alias(status), "n")
    return counted.unionByName(total)


def event_summary(events: DataFrame, key: str = "entity") -> DataFrame:
    """Counts by class in one pass, newest date, number of distinct days, sum of values."""
    count = lambda c: F.count_if(F.col("event_class") == c).alias(f"n_{c}")
    return events.groupBy(key).agg(*[count(c) for c in CLASSES], F.count(F.lit(1)).alias("n_events"), F.max("date").alias("last_date"), F.countDistinct("date").alias("days"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 2).alias("value"))


#: The event classes of the feed, as (class, tier) with 1 the strongest.
TIERS = {"purchase": 1, "signup": 2, "click": 3, "view": 4, "error": 5}
CLASSES = list(TIERS)


def tier(cls: str = "event_class") -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), F.col(cls)), F.lit(6))


def coverage(events: DataFrame, as_of: str, lookback: int, key: str = "entity") -> DataFrame:
    """A status from boolean aggregates, tested in this order: stale, filings_only, strong, adequate, limited."""
    t = tier()
    rows = events.groupBy(key).agg(F.max("date").alias("last_date"), F.bool_or(t == 1).alias("first_tier"), F.bool_or(t == 2).alias("second_tier"), F.count_if(t.between(3, 4)).alias("reputable"), F.bool_and(t <= 2).alias("only_filings"), F.count(F.lit(1)).alias("n"))
    status = (
        F.when(F.datediff(F.lit(as_of).cast("date"), F.col("last_date")) > lookback, "stale").when(F.col("only_filings"), "filings_only")
        .when(F.col("first_tier") & F.col("second_tier") & (F.col("reputable") >= 2), "strong").when((F.col("reputable") >= 1) & (F.col("first_tier") | F.col("second_tier")), "adequate").otherwise("limited")
    )
    return rows.select(key, "n", "last_date", status.alias("coverage_status"))


def multi_source(df: DataFrame, title: Column, provider: str, least: int = 2) -> DataFrame:
    """Normalised titles with at least `least` distinct providers."""
    return df.groupBy(title.alias("title_key")).agg(F.countDistinct(provider).alias("providers"), F.count(F.lit(1)).alias("items")).filter(F.col("providers") >= least)


def dedupe_ranked(df: DataFrame, keys: list[Column], rank: list[Column], ordinal: str) -> DataFrame:
    """Of each key the best row by rank, then ordinal; `position` is the key's first ordinal."""
    named = df.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))])
    rows = named.withColumn("__n", F.row_number().over(w.orderBy(*rank, F.asc(ordinal)))).withColumn("position", F.min(ordinal).over(w))
    return rows.filter("__n = 1").drop("__n", *[f"__k{i}" for i in range(len(keys))])


def within(date: Column, as_of: str, low: int, high: int, undated: bool | None) -> Column:
    """Age in days between low and high; `undated` is the answer for missing dates (None: unknown)."""
    inside = F.datediff(F.lit(as_of).cast("date"), date).between(low, high)
    return inside if undated is None else F.coalesce(inside, F.lit(undated))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], ordinal: str, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Last incoming row of each key replaces the current one; rows with a value outside `allowed` are skipped."""
    for c, values in (allowed or {}).items():
        incoming = incoming.filter(F.col(c).isin(values))
    both = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc(ordinal))
    rows = both.withColumn("__n", F.row_number().over(w)).withColumn("is_new", F.min("__new").over(Window.partitionBy(*keys)) == 1)
    return rows.filter("__n = 1").withColumn("action", F.when(F.col("__new") == 0, "kept").when(F.col("is_new"), "inserted").otherwise("updated")).drop("__n", "__new", "is_new")


def supersede(old: DataFrame, new: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """Compares the key sets of a group; equal: old rows stay active and nothing is written; else old rows go inactive and
    the distinct new ones come in. A group only on one side keeps, or gets, its rows."""
    side = lambda df, a, b: df.select(*group, F.to_json(F.struct(*key)).alias("__mark"), F.lit(a).alias("__a"), F.lit(b).alias("__b"))
    marks = side(old, True, False).unionByName(side(new, False, True)).groupBy(*group, "__mark").agg(F.bool_or("__a").alias("__a"), F.bool_or("__b").alias("__b"))
    sets = marks.groupBy(*group).agg(F.bool_or("__a").alias("a"), F.bool_or("__b").alias("b"), F.bool_or(F.col("__a") != F.col("__b")).alias("differ"))
    changed = sets.select(*group, (F.col("b") & (~F.col("a") | F.col("differ"))).alias("changed"))  # no set is gathered: keys are compared one by one
    stay = old.join(changed, group).select(*old.columns, (~F.col("changed")).alias("is_active"), F.lit("old").alias("origin"))
    come = new.dropDuplicates([*group, *key]).join(changed.filter("changed").drop("changed"), group).select(*old.columns, F.lit(True).alias("is_active"), F.lit("new").alias("origin"))
    return stay.unionByName(come)


def backfill(df: DataFrame, column: str, value: Column, when: Column) -> DataFrame:
    """Sets a column where it is null and the condition holds; doing it again changes nothing."""
    return df.withColumn(column, F.when(F.col(column).isNull() & when, value).otherwise(F.col(column)))
