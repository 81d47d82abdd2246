"""Pages, top-k and quota selections. Every order ends with a key that decides ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """An ordered page."""
    return df.orderBy(*order).offset(offset).limit(limit)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def capped(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """T5: top k of each key with `cut`, whether more were there. Only k + 1 rows of a key are ranked to the end."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k + 1)
    return out.withColumn("cut", F.max("rank").over(Window.partitionBy(*keys)) > k).filter(F.col("rank") <= k)


def class_floor(df: DataFrame, key: str, cls: str, newest: list[Column], floor: int, most: int) -> DataFrame:
    """Each class of a key keeps its `floor` newest; the rest up to `most` goes to the newest others; order is by recency."""
    in_class = F.row_number().over(Window.partitionBy(key, cls).orderBy(*newest))
    marked = df.withColumn("reserved", in_class <= floor)
    picked = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("reserved"), *newest))
    kept = marked.withColumn("__p", picked).filter(F.col("__p") <= most).drop("__p")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*newest)))


def round_robin(df: DataFrame, key: str, kind: str, order: list[Column], most: int) -> DataFrame:
    """Round r takes the r-th row of every kind, kinds in order of their first row, until `most` are taken."""
    w = Window.partitionBy(key, kind).orderBy(*order)
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = df.withColumn("ordinal", ordinal).withColumn("round", F.row_number().over(w)).withColumn("first", F.min("ordinal").over(Window.partitionBy(key, kind)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("round", "first"))).filter(F.col("place") <= most).drop("first")


def category_cap(df: DataFrame, key: str, category: str, order: list[Column], each: int, most: int) -> DataFrame:
    """T8 without the shared cap: at most `each` of a category and `most` of a key, in order."""
    rows = df.withColumn("in_category", F.row_number().over(Window.partitionBy(key, category).orderBy(*order))).filter(F.col("in_category") <= each)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= most)


def budget(df: DataFrame, key: str, order: str, size: str, most: int, items: int | None = None) -> DataFrame:
    """Rows of a key in `order` while their sizes fit in `most`; a row that doesn't fit is skipped, not the end;
    the first always stays. Survivors are numbered E1, E2, .... Whether a row fits depends on the earlier ones, so one key's
    (order, size) pairs are folded. What is used only grows, so of equal sizes the first rows are taken: more of a size than
    fit, or than `items`, needn't be gathered, nor those over the budget but the first row of all, which bounds a key's list by the
    budget, whatever the key's rows.
    """
    of_size = F.row_number().over(Window.partitionBy(key, size).orderBy(order))
    fits_at_most = F.when(F.col(size) > 0, F.lit(most) / F.col(size)).otherwise(float("inf"))
    pairs = df.withColumn("__n", of_size)
    if items is not None:
        pairs = pairs.filter(F.col("__n") <= items)
    firsts = df.groupBy(key).agg(F.min(order).alias("__first"))
    pairs = pairs.join(firsts, key).filter((F.col("__n") <= fits_at_most) | (F.col(order) == F.col("__first")))
    lists = pairs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))

    def step(acc, x):
        fits = (F.size(acc.kept) == 0) | (acc.used + x.s <= most)
        if items is not None:
            fits = fits & (F.size(acc.kept) < items)
        return F.struct(F.when(fits, acc.used + x.s).otherwise(acc.used).alias("used"), F.when(fits, F.concat(acc.kept, F.array(x.o.cast("long")))).otherwise(acc.kept).alias("kept"))

    kept = lists.select(key, F.posexplode(F.aggregate("all", start, step, lambda acc: acc.kept)).alias("n", order)).withColumn("label", F.concat(F.lit("E"), F.col("n") + 1))
    return df.join(kept.drop("n"), [key, order])


def rank_nulls_last(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """1..n by score descending, missing scores last (a zero comes before them), ties by `tie`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), F.asc(tie))))


def identifiers(df: DataFrame, key: str, confidence: str, tie: str, gap: float = 0.1) -> DataFrame:
    """The best candidate of each key and whether the second is closer than `gap`."""
    w = Window.partitionBy(key).orderBy(F.desc(confidence), F.asc(tie))
    rows = df.withColumn("__n", F.row_number().over(w)).withColumn("second", F.lead(confidence).over(w))
    return rows.filter("__n = 1").drop("__n").withColumn("ambiguous", F.coalesce(F.round(F.col(confidence) - F.col("second"), 6) < gap, F.lit(False)))
