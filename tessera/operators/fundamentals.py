"""Fundamental facts: freshest values, growth, margins, derived metrics. Missing values stay missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio_pct(num: str, den: str) -> Column:
    """num / den * 100 to two places, null on a zero or missing denominator."""
    return F.round(F.col(num) / F.nullif(F.col(den), F.lit(0.0)) * 100, 2)


def freshest(facts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """of each key the first fact in the given order; pass a full order, ties would be undefined."""
    return facts.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def freshest_fact(facts: DataFrame, keys: list[str]) -> DataFrame:
    """F1 on columns form_annual, days (null for instants), fy, filed, period_end, alias: annual forms first, then periods of 300 days or more, then
    the largest (fy, filed, period_end), then the first alias."""
    full = F.coalesce(F.col("days") >= 300, F.lit(True))
    return freshest(facts, keys, [F.desc("form_annual"), full.desc(), F.desc("fy"), F.desc("filed"), F.desc("period_end"), F.asc("alias"), F.desc("value")])


def yoy_growth(facts: DataFrame, values: list[str], entity: str = "entity") -> DataFrame:
    """Change to the fiscal year before, over its absolute value, in per cent; null without that very year or if it is zero."""
    w = Window.partitionBy(entity).orderBy("fy")
    out = facts.withColumn("__gap", F.col("fy") - F.lag("fy").over(w))
    for v in values:
        prior = F.when(F.col("__gap") == 1, F.lag(v).over(w))
        out = out.withColumn(f"{v}_yoy", F.round((F.col(v) - prior) / F.nullif(F.abs(prior), F.lit(0.0)) * 100, 2))
    return out.select(entity, "fy", *[f"{v}_yoy" for v in values])


def margins(facts: DataFrame) -> DataFrame:
    return facts.select("entity", "fy", ratio_pct("gross", "revenue").alias("gross_margin"), ratio_pct("discounts", "gross").alias("discount_rate"), ratio_pct("taxes", "gross").alias("tax_rate"))


def total_of(parts: list[str]) -> Column:
    """the sum of the parts that are there, null if none is."""
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0))))


def free_cash_flow(facts: DataFrame) -> DataFrame:
    """cash flow less capital expenditure, debt from its parts with a warning if one is missing, debt to equity."""
    debt = total_of(["short_debt", "long_debt"])
    partial = F.coalesce("short_debt", "long_debt").isNotNull() & (F.col("short_debt").isNull() | F.col("long_debt").isNull())
    return facts.select("entity", "fy", F.round(F.col("cash_flow") - F.col("capex"), 2).alias("free_cash_flow"), F.round(debt, 2).alias("total_debt"), F.round(debt / F.nullif("equity", F.lit(0.0)), 3).alias("debt_to_equity"), partial.alias("partial_debt"))


def datapoints(facts: DataFrame, keys: list[str], units: dict[str, str]) -> DataFrame:
    """one row per value that is there, with its unit."""
    names = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit")) for c, u in units.items()])
    return facts.select(*keys, F.inline(names)).filter(F.col("value").isNotNull())


def market_metrics(rows: DataFrame) -> DataFrame:
    """F6 on close, shares, debt, cash, net_income, eps: capitalisation, enterprise value, P/E by income, else by earnings per share."""
    cap = F.round(F.col("close") * F.col("shares"), 2)
    pe = F.when(F.col("net_income") > 0, F.round(cap / F.col("net_income"), 2)).when(F.col("eps") > 0, F.round(F.col("close") / F.col("eps"), 2))
    return rows.select("instrument", cap.alias("market_cap"), F.round(cap + F.coalesce("debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0)), 2).alias("enterprise_value"), pe.alias("pe_ratio"))


def stale(fy: str, as_of_year: int, signal: bool = True) -> Column:
    """The signal calls a year stale when over one year old, the normaliser when over two."""
    return F.col(fy) < as_of_year - (1 if signal else 2)
