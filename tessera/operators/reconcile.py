"""Facts from several methods: agreement, resolution, subtotals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(candidates: DataFrame, keys: list[str], method: str, value: str, confidence: str, tie: str, share: float = 0.01, least: float = 0.5, floor: float = 0.6) -> DataFrame:
    """V3, V4: values of a group agree if they differ by at most max(share * larger, least). All pairs agree exactly when the smallest and
    largest do, so one aggregation decides: a conflict between methods is rejected, within one method the group stays an excerpt; else the
    best candidate wins, its confidence raised by 0.1 if methods agree, and must reach the floor.
    """
    best = F.max(F.struct(F.col(confidence), (-F.col(tie)).alias("t"), F.col(value), F.col(method)))
    rows = candidates.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.countDistinct(method).alias("methods"), F.count(F.lit(1)).alias("n"), best.alias("best"))
    agree = F.col("high") - F.col("low") <= F.greatest(F.greatest(F.abs("high"), F.abs("low")) * share, F.lit(least))
    boosted = F.least(F.lit(1.0), F.col(f"best.{confidence}") + F.when(F.col("methods") > 1, 0.1).otherwise(0.0))
    status = F.when(~agree & (F.col("methods") > 1), "rejected").when(~agree, "excerpt_only").when(boosted < floor, "excerpt_only").otherwise("validated")
    return rows.select(*keys, "n", "methods", status.alias("validation"), F.when(agree, F.col(f"best.{value}")).alias("value"), F.when(agree, F.round(boosted, 4)).alias("confidence"))


def subtotals(rows: DataFrame, keys: list[str], total: str, parts: list[str], share: float = 0.01, least: float = 0.5) -> DataFrame:
    """V5: the sum of the parts against the reported total, within a share of the sum; a total whose parts are incomplete isn't judged."""
    expected = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    off = F.abs(expected - F.col(total)) > F.greatest(F.abs(expected) * share, F.lit(least))
    return rows.select(*keys, F.round(expected, 2).alias("expected"), F.col(total).alias("reported"), F.when(expected.isNull() | F.col(total).isNull(), "not_checked").when(off, "demoted").otherwise("consistent").alias("check"))


def balance_identity(rows: DataFrame, keys: list[str], assets: str, liabilities: str, equity: str, share: float = 0.01, least: float = 0.5) -> DataFrame:
    """V5: assets against liabilities and equity. With all three there, a difference beyond the tolerance makes all of them excerpts, since
    it can't be told which is wrong; with one missing nothing is judged."""
    total = F.col(liabilities) + F.col(equity)
    off = F.abs(F.col(assets) - total) > F.greatest(F.abs(assets) * share, F.lit(least))
    return rows.select(*keys, F.when(off.isNull(), "not_checked").when(off, "excerpt_only").otherwise("consistent").alias("identity"))


def semantic_key(*parts: str, value: str):
    """D3: parts in lower case and the value to four places, so that equal facts have equal keys."""
    return F.concat_ws("|", *[F.lower(F.coalesce(F.col(p).cast("string"), F.lit(""))) for p in parts], F.format_number(F.col(value), 4))
