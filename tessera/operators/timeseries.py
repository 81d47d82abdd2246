"""Price-series signals. Frames have instrument, date, close; every window is partitioned by instrument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAGS = {"return_1m": 21, "return_3m": 63, "return_6m": 126}
LEAST_POINTS = 30


def from_latest(prices: DataFrame, key: str = "instrument") -> DataFrame:
    """Non-null closes with `back`, 0 at the latest date."""
    w = Window.partitionBy(key).orderBy(F.desc("date"), F.desc("close"))
    return prices.filter(F.col("close").isNotNull()).withColumn("back", F.row_number().over(w) - 1)


def pct(a: Column, b: Column) -> Column:
    """(a / b - 1) * 100 to two places; null if b is zero or null."""
    return F.round((a / F.nullif(b, F.lit(0.0)) - 1) * 100, 2)


def at(back: int) -> Column:
    return F.max(F.when(F.col("back") == back, F.col("close")))


def trailing_mean(n: int) -> Column:
    """Mean of the last n closes, null if there are fewer."""
    return F.when(F.count(F.lit(1)) >= n, F.avg(F.when(F.col("back") < n, F.col("close"))))


def period_returns(prices: DataFrame, key: str = "instrument") -> DataFrame:
    """Returns over 21, 63 and 126 points up to the latest; null with fewer than n + 1 points."""
    return from_latest(prices, key).groupBy(key).agg(*[pct(at(0), at(n)).alias(name) for name, n in LAGS.items()])


def moving_averages(prices: DataFrame, key: str = "instrument") -> DataFrame:
    """Trailing means over 50 and 200 points and the latest close's deviation from them."""
    rows = from_latest(prices, key).groupBy(key).agg(at(0).alias("last_close"), trailing_mean(50).alias("ma50"), trailing_mean(200).alias("ma200"))
    return rows.select(key, "last_close", "ma50", "ma200", pct(F.col("last_close"), F.col("ma50")).alias("pct_above_ma50"), pct(F.col("last_close"), F.col("ma200")).alias("pct_above_ma200"))


def vote(returns: list[str], deviations: list[str]) -> Column:
    """Returns vote beyond two per cent, deviations by sign; null signals don't vote."""
    votes = [F.when(F.col(c) > 2, 1).when(F.col(c) < -2, -1).otherwise(0) for c in returns] + [F.when(F.col(c) > 0, 1).when(F.col(c) < 0, -1).otherwise(0) for c in deviations]
    total, some = sum(votes[1:], votes[0]), F.coalesce(*[F.col(c) for c in returns + deviations]).isNotNull()
    return F.when(~some, "insufficient").when(total > 0, "positive").when(total < 0, "negative").otherwise("neutral")


def trend_signals(prices: DataFrame, key: str = "instrument") -> DataFrame:
    """Returns, deviations and the momentum label in one pass; under LEAST_POINTS closes all metrics are null."""
    rows = from_latest(prices, key).groupBy(key).agg(F.count(F.lit(1)).alias("points"), at(0).alias("last_close"), *[at(n).alias(f"c{n}") for n in LAGS.values()], trailing_mean(50).alias("ma50"), trailing_mean(200).alias("ma200"))
    enough = F.col("points") >= LEAST_POINTS
    rows = rows.select(
        key, "points", "last_close", *[F.when(enough, pct(F.col("last_close"), F.col(f"c{n}"))).alias(name) for name, n in LAGS.items()],
        F.when(enough, pct(F.col("last_close"), F.col("ma50"))).alias("pct_above_ma50"), F.when(enough, pct(F.col("last_close"), F.col("ma200"))).alias("pct_above_ma200"),
    )
    return rows.withColumn("momentum_label", vote(list(LAGS), ["pct_above_ma50", "pct_above_ma200"]))


def relative_strength(prices: DataFrame, benchmark: DataFrame, key: str = "instrument", span: int = 63) -> DataFrame:
    """Ratio of growth over the last min(span, points - 1) steps of both, if over 5; the two are aligned from the end."""
    own = from_latest(prices, key)
    n = own.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("__all", F.lit(1))
    ref = from_latest(benchmark.withColumn("__all", F.lit(1)), "__all").select("back", F.col("close").alias("ref")).filter(F.col("back") <= span)
    m = ref.agg(F.max("back").alias("m")).withColumn("__all", F.lit(1))  # one row
    steps = n.join(F.broadcast(m), "__all").withColumn("steps", F.least(F.lit(span), F.col("n") - 1, F.col("m"))).filter("steps > 5").select(key, "steps")
    ends = own.filter(F.col("back") <= span).join(steps, key).filter("back = 0 OR back = steps").join(F.broadcast(ref), "back")
    rows = ends.groupBy(key, "steps").agg(*[F.max(F.when(F.col("back") == b, F.col(c))).alias(a) for a, b, c in (("p1", 0, "close"), ("p0", F.col("steps"), "close"), ("r1", 0, "ref"), ("r0", F.col("steps"), "ref"))])
    return rows.select(key, "steps", F.round((F.col("p1") / F.nullif("p0", F.lit(0.0))) / (F.col("r1") / F.nullif("r0", F.lit(0.0))), 3).alias("relative_strength"))


def week52_extremes(prices: DataFrame, key: str = "instrument", days: int = 365) -> DataFrame:
    """High and low of the last `days` days with the earliest date of each, and whether the span is under 300 days."""
    latest = prices.filter(F.col("close").isNotNull()).groupBy(key).agg(F.max("date").alias("last"))
    rows = prices.filter(F.col("close").isNotNull()).join(latest, key).filter(F.col("date") >= F.date_sub("last", days))
    out = rows.groupBy(key).agg(F.min(F.struct((-F.col("close")).alias("c"), "date")).alias("hi"), F.min(F.struct(F.col("close").alias("c"), "date")).alias("lo"), F.min("date").alias("first"), F.max("date").alias("last"))
    return out.select(key, (-F.col("hi.c")).alias("week52_high"), F.col("hi.date").alias("high_date"), F.col("lo.c").alias("week52_low"), F.col("lo.date").alias("low_date"), (F.datediff("last", "first") < 300).alias("short_span"))


def latest_close(prices: DataFrame, key: str = "instrument") -> DataFrame:
    """First and last date, number of points, last close and its volume."""
    rows = prices.filter(F.col("close").isNotNull())
    return rows.groupBy(key).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("points"), F.max(F.struct("date", "close", "volume")).alias("x")).select(key, "first_date", "last_date", "points", F.col("x.close").alias("last_close"), F.col("x.volume").alias("last_volume"))


def horizon_return(starts: DataFrame, prices: DataFrame, benchmark: DataFrame, days: int, key: str = "instrument") -> DataFrame:
    """For (key, start) the return of asset and benchmark from the last close by start to the last by start + days.

    As-of by one window over a series and the dates asked of it, both ends of a span at once: one for the assets, and one for the
    benchmark, which has a row for each day asked at most."""

    def as_of(series: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
        both = marks.withColumns({"ask": F.lit(1), "close": F.lit(None).cast("double")}).unionByName(series.withColumn("ask", F.lit(0)), allowMissingColumns=True)
        w = Window.partitionBy(*by).orderBy("date", "ask").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn("value", F.last("close", ignorenulls=True).over(w)).filter("ask = 1").drop("ask", "close")

    spans = starts.select(key, "start", F.date_add("start", days).alias("end")).distinct()
    ends = F.explode(F.array(F.struct(F.lit(0).alias("at"), F.col("start").alias("date")), F.struct(F.lit(1).alias("at"), F.col("end").alias("date"))))
    marks = spans.select(key, "start", "end", ends.alias("m")).select(key, "start", "end", "m.*")
    own = as_of(prices.select(key, "date", "close"), marks, [key]).groupBy(key, "start", "end").agg(*[F.max(F.when(F.col("at") == i, F.col("value"))).alias(f"p{i}") for i in (0, 1)])
    one = F.lit(0).alias("__all")
    ref = as_of(benchmark.select(one, "date", "close"), marks.select(one, "date").distinct(), ["__all"]).drop("__all")
    out = own.join(ref.toDF("start", "r0"), "start", "left").join(ref.toDF("end", "r1"), "end", "left")
    a, b = pct(F.col("p1"), F.col("p0")), pct(F.col("r1"), F.col("r0"))
    return out.select(key, "start", "end", a.alias("asset_return"), b.alias("benchmark_return"), F.round(a - b, 2).alias("relative_return"))
