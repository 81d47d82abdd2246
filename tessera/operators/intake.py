"""Universe and evidence intake: vendor rows, geography and keyword screens, curated context, ranks, freshest aliases, validated facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import trees
from tessera.operators.events import dedupe_ranked

#: Instrument types that count as shares, document kinds from the most to the least wanted, method qualities and confidence limits.
SHARE_TYPES = ["common stock", "equity", "stock", ""]
KINDS = ["annual_report", "results_release", "interim_report", "presentation", "other"]
METHODS = {"html": 0, "native_pdf": 1, "ocr": 2}
BOOST, MOST_CONFIDENT, OCR_CEILING, LEAST_CONFIDENT = 0.1, 0.95, 0.72, 0.6
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
FULL_YEAR = 300  # days


def vendor_rows(df: DataFrame, kind: str, exchange: str, code: str, wanted: str | None = None) -> DataFrame:
    """Rows of shares, of one exchange if it is given (case aside); `symbol` is code.exchange."""
    out = df.filter(F.lower(F.coalesce(F.col(kind), F.lit(""))).isin(SHARE_TYPES))
    if wanted:
        out = out.filter(F.upper(F.coalesce(F.col(exchange), F.lit(""))) == wanted.upper())
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return out.withColumn("symbol", F.concat(text(code), F.lit("."), text(exchange)))


def screened_universe(df: DataFrame, countries: list[str], regions: list[str], keywords: list[str], country: str, region: str, haystack: list[str]) -> DataFrame:
    """Adds `reason`, null for rows that stay. Countries asked for are strict, regions hold only if none is; then the first
    keyword that name, industry or theme contain excludes."""
    asked = sorted(countries or regions)
    inside = F.coalesce(F.col(country if countries else region).isin(asked), F.lit(False)) if asked else F.lit(True)
    text = F.lower(F.concat_ws(" ", *haystack))
    words = [k.lower() for k in keywords if k]
    hit = F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), 0) if words else F.lit(None).cast("string")
    off = F.concat(F.lit("region mismatch: "), F.coalesce(F.col(country), F.lit("")), F.lit(f" not in requested {', '.join(asked)}"))
    return df.withColumn("reason", F.when(~inside, off).when(hit.isNotNull(), F.concat(F.lit("excluded by keyword "), hit)))


def with_context(candidates: DataFrame, items: DataFrame, ticker: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Candidates with the columns of the first curated item of their ticker (case and outer spaces aside), null without one."""
    key = F.upper(F.trim(F.col(ticker)))
    first = items.withColumn("__key", key).withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(*order))).filter("__n = 1").select("__key", *columns)
    return candidates.withColumn("__key", key).join(first, "__key", "left").drop("__key")


def ranked(df: DataFrame, keys: list[str], rank: str, tie: str) -> DataFrame:
    """Place by rank, rows without one last."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(rank), F.asc(tie))))


def rank_documents(df: DataFrame, keys: list[str], kind: str, downloadable: str, ordinal: str) -> DataFrame:
    """Place by kind (unknown ones last), downloadable ones first, then in the order found."""
    known = F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind))
    precedence = F.when(F.coalesce(known, F.lit(0)) == 0, len(KINDS) + 1).otherwise(known)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(precedence, F.desc(downloadable), F.asc(ordinal))))


def dedupe_evidence(df: DataFrame, url: str, ident: str, source_type: str, excerpt: str, ordinal: str) -> DataFrame:
    """Of items with equal address (or id, without one), source type and first 60 characters the first stays."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return dedupe_ranked(df, [F.coalesce(F.nullif(empty(url), F.lit("")), empty(ident)), empty(source_type), F.substring(empty(excerpt), 1, 60)], [], ordinal)


def freshest_alias(entries: DataFrame, keys: list[str], scale: float | None = None) -> DataFrame:
    """S7 on columns alias, alias_order, fy, filed, annual, value, and perhaps start and end: over all aliases annual entries before quarterly
    ones, then those that span a full year (FULL_YEAR days, or no span stated: a fourth quarter in an annual form is none), then
    the latest fiscal year, filing and end, the first alias. `prior` is the same alias's freshest full annual value of the year
    before. scale divides both, to two places."""
    spans = {"start", "end"} <= set(entries.columns)
    days = F.datediff(F.col("end").cast("date"), F.col("start").cast("date")) if spans else F.lit(None).cast("int")
    x = entries.filter("value IS NOT NULL").withColumns({"__full": F.coalesce(days >= FULL_YEAR, F.lit(True)), "__end": F.col("end").cast("string") if spans else F.lit(None).cast("string")})
    best = Window.partitionBy(*keys).orderBy(F.desc("annual"), F.desc("__full"), F.desc("fy"), F.desc("filed"), F.desc("__end"), F.asc("alias_order"), F.desc("value"))
    latest = x.withColumn("__n", F.row_number().over(best)).filter("__n = 1").withColumn("__before", F.when(F.col("annual"), F.col("fy") - 1))
    before = x.filter("annual AND __full").groupBy(*keys, "alias", F.col("fy").alias("__before")).agg(F.max_by("value", F.struct("filed", "__end", "value")).alias("prior"))
    out = latest.join(before, [*keys, "alias", "__before"], "left")
    in_scale = lambda c: F.round(F.col(c) / scale, 2).alias(c) if scale else F.col(c)
    return out.select(*keys, "alias", "fy", F.when(F.col("annual"), "annual").otherwise("quarterly").alias("period_type"), in_scale("value"), in_scale("prior"))


def tree_leaves(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, path, value) of every scalar in a JSON text, however nested."""
    return trees.tree_leaves(df, [key], payload).drop("kind")


def validated_facts(candidates: DataFrame, keys: list[str], known: str, order: list[str]) -> DataFrame:
    """V3, V4, V6 on columns value, scale, method, confidence, base_status and tie. One verdict a group of label, period and scope.

    Two scaled values are compared in full, others digit by digit; they agree within the larger of 1 % and 0.5. All pairs agree
    exactly when the extremes do, so one aggregation decides. A conflict between methods is rejected, within one method it
    stays an excerpt. Else the best candidate stands (method, then confidence, then tie); several methods raise its confidence by
    BOOST up to MOST_CONFIDENT, OCR alone is held under OCR_CEILING, and under LEAST_CONFIDENT or without a known issuer it
    stays an excerpt. `place` orders validated facts first, then by `order`.
    """
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), F.col("scale")), F.lit(1.0))
    quality = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv]), F.col("method")), F.lit(9))
    x = candidates.withColumn("__full", F.when(F.col("scale").isNotNull(), F.col("value") * factor)).withColumn("__raw", F.when(F.col("scale").isNull(), F.col("value")))
    best = F.min(F.struct(quality.alias("q"), (-F.col("confidence")).alias("c"), F.col("tie"), F.col("value"), F.col("scale"), F.col("method"), F.col("base_status")))
    g = x.groupBy(*keys).agg(
        F.min("__full").alias("low"), F.max("__full").alias("high"), F.min("__raw").alias("raw_low"), F.max("__raw").alias("raw_high"), F.min("value").alias("all_low"), F.max("value").alias("all_high"),
        F.countDistinct("method").alias("methods"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("method") == "ocr").alias("ocr"), F.bool_and(known).alias("known"), best.alias("best"),
    )
    apart = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > F.greatest(F.greatest(F.abs(a), F.abs(b)) * 0.01, F.lit(0.5)), F.lit(False))
    g = g.withColumn("conflict", apart("low", "high") | apart("raw_low", "all_high") | apart("raw_high", "all_low"))
    confidence = F.when(F.col("methods") > 1, F.least(-F.col("best.c") + BOOST, F.lit(MOST_CONFIDENT))).otherwise(-F.col("best.c"))
    confidence = F.round(F.when(F.col("ocr"), F.least(confidence, F.lit(OCR_CEILING))).otherwise(confidence), 4)
    status = F.when(F.col("conflict") & (F.col("methods") > 1), "rejected").when(F.col("conflict") | (confidence < LEAST_CONFIDENT) | ~F.col("known"), "excerpt_only").otherwise(F.col("best.base_status"))
    out = g.select(*keys, "n", "methods", status.alias("validation"), F.when(~F.col("conflict"), F.col("best.value")).alias("value"), F.when(~F.col("conflict"), F.col("best.scale")).alias("scale"), F.col("best.method").alias("method"), F.when(~F.col("conflict"), confidence).alias("confidence"))
    first = [k for k in keys if k not in order]
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*first).orderBy(F.when(F.col("validation") == "validated", 0).otherwise(1), *[F.asc_nulls_first(c) for c in order])))
