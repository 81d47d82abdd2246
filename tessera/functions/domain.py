"""Column functions of the domain: symbols, legal names, scopes, document kinds, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Symbol suffixes by venue, legal suffixes of names, categories of financial fields.
SUFFIXES = {"AFRICA": "af", "AMERICA": "us", "ASIA": "as", "EUROPE": "eu"}
LEGAL = ["inc", "corp", "ltd", "plc", "holding", "group", "company", "customer", "supplier"]
CATEGORIES = {"revenue": "topline", "gross": "earnings", "taxes": "earnings", "cash": "cash", "debt": "position"}


def symbol(ticker: Column, venue: Column, default: str = "us") -> Column:
    """Ticker in lower case with the venue's suffix, the default's for unknown venues."""
    suffix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), venue), F.lit(default))
    return F.concat_ws(".", F.lower(F.trim(ticker)), suffix)


def is_lei(value: Column) -> Column:
    """18 capitals or digits and two digits."""
    return F.coalesce(value.rlike("^[A-Z0-9]{18}[0-9]{2}$"), F.lit(False))


def brand_tokens(name: Column) -> Column:
    """K8, K9: tokens of a name without legal suffixes."""
    return F.array_except(T.tokens(name), F.array(*map(F.lit, LEGAL)))


def document_kind(text: Column) -> Column:
    """Annual before interim before results before presentation before other."""
    low = F.lower(text)
    return F.when(low.rlike("annual|10-k"), "annual_report").when(low.rlike("interim|half-year|10-q"), "interim_report").when(low.rlike("results|earnings"), "results_release").when(low.rlike("presentation|slides"), "presentation").otherwise("other")


def scope(heading: Column, parent: Column) -> Column:
    """A segment marker gives the heading, a group marker `group`, a marker on the parent the heading; else nothing."""
    marks = lambda c: F.coalesce(F.lower(c).rlike("segment|division"), F.lit(False))
    return F.when(marks(heading), F.substring(heading, 1, 80)).when(F.coalesce(F.lower(heading).rlike("group|consolidated"), F.lit(False)), "group").when(marks(parent), F.substring(heading, 1, 80))


def fact_category(field: Column, scope_: Column) -> Column:
    """Other scopes than the group's are segments; fields have their category, others `other`."""
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), field), F.lit("other"))
    return F.when(F.coalesce(scope_, F.lit("group")) != "group", "segment").otherwise(known)


def period_rank(period: Column) -> Column:
    """Minus the year in the text, 10000 without one."""
    year = F.regexp_extract(F.coalesce(period, F.lit("")), r"\b(199\d|20\d\d)\b", 1)
    return F.when(year == "", 10000).otherwise(-F.nullif(year, F.lit("")).cast("int"))


def primary_credit(base: Column, facts: Column) -> Column:
    """15 for each primary fact up to 45, at most a primary filing's own score, 95; without such facts the score as it was."""
    return F.when(facts > 0, F.least(base + F.least(facts * 15, F.lit(45)), F.lit(95))).otherwise(base)
