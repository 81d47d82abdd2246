"""Screens: composed filters, exclusion reasons, presence of fields, coverage of required claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conjunction(df: DataFrame, **wanted) -> DataFrame:
    """Adds a conjunct for each argument that is given: column, column__min, column__max, column__contains, column__in; nulls drop out."""
    tests = []
    for name, value in wanted.items():
        if value is None:
            continue
        column, _, kind = name.partition("__")
        c = F.col(column)
        tests.append({"": lambda: c == value, "min": lambda: c >= value, "max": lambda: c <= value, "contains": lambda: F.contains(F.lower(c), F.lit(value.lower())), "in": lambda: c.isin(list(value))}[kind]())
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def first_reason(reasons: dict[str, Column], other: str = "included") -> Column:
    """The first reason whose condition holds."""
    out = None
    for name, condition in reasons.items():
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(other) if out is None else out.otherwise(other)


def presence(df: DataFrame, fields: list[str]) -> DataFrame:
    """Names of the fields that have a value (not null, not blank), of those that haven't, and the share in per cent."""
    there = lambda f: F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")
    have, lack = (F.array_compact(F.array(*[F.when(there(f) if yes else ~there(f), f) for f in fields])) for yes in (True, False))
    out = df.withColumn("available", F.array_join(have, ",")).withColumn("missing", F.array_join(lack, ","))
    return out.withColumn("n_missing", F.size(lack)).withColumn("completeness", F.floor(F.size(have) * 100 / len(fields)).cast("int"))


def cap_band(df: DataFrame, value: str, low: float | None, high: float | None) -> DataFrame:
    """A missing value passes; outside the band the row stays with another status."""
    outside = F.lit(False)
    if low is not None:
        outside = outside | F.coalesce(F.col(value) < low, F.lit(False))
    if high is not None:
        outside = outside | F.coalesce(F.col(value) > high, F.lit(False))
    return df.withColumn("screen_status", F.when(outside, "rejected_by_screen").otherwise("candidate_found"))


def semi(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """J3."""
    return df.join(wanted, keys, "left_semi")


def anti(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """J17, U5."""
    return df.join(seen, keys, "left_anti")


def resolve_channels(channels: DataFrame, keys: list[str], tier: str, tie: str) -> DataFrame:
    """The strongest tier's value of each key, with all channels that had one."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    rows = channels.filter(F.col("value").isNotNull()).withColumn("__n", F.row_number().over(w.orderBy(F.asc(tier), F.asc(tie)))).withColumn("channels", F.array_join(F.array_sort(F.collect_set(tie).over(w)), ","))
    return rows.filter("__n = 1").drop("__n")


def alias_tree(aliases: DataFrame, canonical: str, alias: str) -> DataFrame:
    """Of each canonical name the sorted distinct aliases and their number."""
    return aliases.groupBy(canonical).agg(F.array_join(F.array_sort(F.collect_set(alias)), ",").alias("aliases"), F.countDistinct(alias).alias("n_aliases"))


def overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Sorted intersection, sorted union, and whether they overlap."""
    return F.array_sort(F.array_intersect(a, b)), F.array_sort(F.array_union(a, b)), F.arrays_overlap(a, b)
