"""Relevance, classification and grounding rules over news, companies and claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.scoring import clamp, points, tenth

#: Qualities of references without content, and the source types and fields of evidence.
BARE_QUALITIES = ["metadata_only", "link_metadata_only"]
FACT_TYPES = ["sec_financial_statement", "company_filing", "company_ir_financial_fact"]
TREND_TYPES = ["derived_financial_metric", "market_metric", "price_metric", "trend_signal", "financial_snapshot"]
TREND_FIELDS = ["latest_close", "market_cap_usd_m", "market_cap_mln", "enterprise_value_usd_m", "enterprise_value_mln", "ebitda_ttm_usd_m", "revenue_ttm_usd_m", "pe_ratio"]
DOCUMENT_TYPES = ["company_ir_annual_report_text", "company_ir_annual_report_excerpt", "company_ir_business_description", "company_ir_risk_excerpt", "sec_filing_financial_fact"]


def thesis_relevance(themes: Column, keywords: Column, sector: Column, industry: Column, region: Column, catalyst: Column, confidence: Column, unsourced: Column) -> Column:
    """45 for the theme, 5 for each keyword up to 15, 10 sector, 10 industry, 12 region, 4 catalyst, 4 times the confidence, less 15 if unsourced."""
    score = points(themes, 45) + F.least(keywords * 5.0, F.lit(15.0)) + points(sector, 10) + points(industry, 10) + points(region, 12) + points(catalyst, 4) + confidence * 4.0 - points(unsourced, 15)
    return tenth(clamp(score, 0.0, 100.0))


def news_relevance(ticker: Column, full_name: Column, part_name: Column, tier: Column, recent: Column, catalyst: Column, social: Column, banned: Column) -> Column:
    """Nothing for banned items; .40 ticker, .40 or .25 name, .15 or .10 for the first and second tier, .10 for or against recency (unknown: neither), .05 catalyst, less .10 on social media."""
    score = points(ticker, 0.40) + F.when(full_name, 0.40).when(part_name, 0.25).otherwise(0.0) + F.when(tier == 1, 0.15).when(tier == 2, 0.10).otherwise(0.0) + F.when(recent, 0.10).when(~recent, -0.10).otherwise(0.0) + points(catalyst, 0.05) - points(social, 0.10)
    return F.when(banned, 0.0).otherwise(F.round(clamp(F.round(score, 6), 0.0, 1.0), 2))


def relevance_level(score: Column) -> Column:
    return F.when(score >= 0.6, "high").when(score >= 0.4, "medium").when(score >= 0.2, "low").otherwise("irrelevant")


def evidence_category(quality: Column, source_type: Column, tier: Column, fields: Column) -> Column:
    """The first rule that holds: references without content, statement facts, price and trend figures, summaries, statement tables,
    document excerpts, then events by source and tier (1 the strongest), press, and references."""
    kind = F.lower(F.trim(F.coalesce(source_type, F.lit(""))))
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(kind, F.lit(w)) for w in words))
    event = F.array_contains(fields, "catalyst") | has("event", "news")
    by_tier = F.when((tier == 1) | has("press"), "company_press").when(tier <= 2, "regulator_event").when(tier.isin(3, 4), "material_news").otherwise("low_tier_news")
    return (
        F.when(F.lower(F.trim(F.coalesce(quality, F.lit("")))).isin(BARE_QUALITIES), "source_reference").when(kind.isin(FACT_TYPES), "financial_fact")
        .when(kind.isin(TREND_TYPES) | F.arrays_overlap(fields, F.array(*map(F.lit, TREND_FIELDS))), "price_trend_metric").when(kind == "financial_data_summary", "financial_summary")
        .when(kind == "company_ir_statement_excerpt", "statement_table_content").when(kind.isin(DOCUMENT_TYPES) | has("excerpt", "annual_report"), "primary_document")
        .when(F.coalesce(event, F.lit(False)), by_tier).when(has("press"), "company_press").otherwise("source_reference")
    )


def catalyst_class(item_code: Column, form: Column, text: Column) -> tuple[Column, Column]:
    """Category by item code, else by form, else by keyword; direction from keywords, negative ones first."""
    by_item = F.when(item_code == "2.02", "results").when(item_code == "5.02", "management").when(item_code == "1.01", "agreement")
    by_form = F.when(form.isin("10-K", "20-F"), "annual_report").when(form == "10-Q", "interim_report")
    low = F.lower(text)
    by_word = F.when(low.rlike("order|contract"), "contract").when(low.rlike("result|revenue"), "results").when(low.rlike("the|and"), "general")
    direction = F.when(low.rlike("worthless|threat|loss"), "negative").when(low.rlike("growth|rising|gain"), "positive").otherwise("neutral")
    return F.coalesce(by_item, by_form, by_word, F.lit("other")), direction


def section_gaps(df: DataFrame, keys: list[str], have: str, sections: dict[str, tuple[list[str], bool]]) -> DataFrame:
    """Fields of each section that are absent; required sections block."""
    rules = F.array(*[F.struct(F.lit(name).alias("section"), F.array(*map(F.lit, fields)).alias("fields"), F.lit(required).alias("blocking")) for name, (fields, required) in sections.items()])
    rows = df.select(*keys, have, F.inline(rules)).withColumn("missing", F.array_except("fields", have))
    return rows.filter(F.size("missing") > 0).select(*keys, "section", "blocking", F.array_join("missing", ",").alias("missing"))


def chair(df: DataFrame) -> DataFrame:
    """Gates passed and the status they lead to: mock, weak tier, failed citations, gaps, then gates and balance."""
    gates = sum((F.col(g).cast("int") for g in ("source_ok", "citations_ok", "schema_ok", "valuation_ok", "no_gap")), F.lit(0))
    balance = F.when(F.col("bull") > F.col("bear") + 1, "bullish").when(F.col("bear") > F.col("bull") + 1, "bearish").when(F.col("bull") + F.col("bear") == 0, "unknown").otherwise("balanced")
    out = df.withColumn("gates", gates).withColumn("balance", balance)
    status = F.when(F.col("mock"), "incomplete").when(F.col("tier") >= 5, "needs_primary_sources").when(~F.col("citations_ok"), "rejected").when(~F.col("no_gap"), "incomplete").when((F.col("gates") >= 3) & (F.col("balance") != "unknown"), "candidate_for_review").otherwise("deeper_analysis")
    return out.withColumn("committee_status", status)


def grounded_gap(text: Column, gaps: Column, classes: dict[str, str], fallback: str) -> Column:
    """A text that claims a class of cause stays only if a known gap has the class's marker; else the fallback."""
    out = None
    for marker, pattern in classes.items():
        value = F.when(F.exists(gaps, lambda g: g == marker), text).otherwise(fallback)  # noqa: B023
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out.otherwise(text)


def mixed_scopes(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with two numbers or more whose cited evidence spans several scopes or periods."""
    numbers = F.size(F.regexp_extract_all("text", F.lit(r"\d[\d.,]*"), F.lit(0)))
    rows = claims.select("claim_id", numbers.alias("numbers"), F.explode("cited").alias("doc_id")).join(evidence, "doc_id")
    agg = rows.groupBy("claim_id", "numbers").agg(F.countDistinct("scope").alias("scopes"), F.countDistinct("period").alias("periods"))
    return agg.withColumn("violation", (F.col("numbers") >= 2) & ((F.col("scopes") > 1) | (F.col("periods") > 1)))


def category_budget(df: DataFrame, key: str, order: str, category: str, caps: dict[str, int], shared: list[tuple[list[str], int]], floors: dict[str, int], most: int) -> DataFrame:
    """In order, first the floor of every category, then the rest, under caps of categories, caps that several categories share
    (pairs of members and cap; a category may be in several) and a total.

    A shared cap makes choices depend on earlier ones, so one key's (order, category) pairs are folded; everything else is windows.
    """
    w = Window.partitionBy(key, category).orderBy(order)
    lookup = lambda table, c, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(other))
    rows = df.withColumn("__n", F.row_number().over(w)).withColumn("reserved", F.col("__n") <= lookup(floors, F.col(category), 0)).filter(F.col("__n") <= lookup(caps, F.col(category), most))
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((~F.col("reserved")).alias("later"), F.col(order).cast("long").alias("o"), F.col(category).alias("c")))).alias("all"))
    count = lambda acc, i: F.get(acc.shared, F.lit(i))
    start = F.struct(F.array(*[F.lit(0) for _ in shared]).cast("array<int>").alias("shared"), F.array().cast("array<long>").alias("kept"))

    def step(acc, x):
        inside = [x.c.isin(list(members)) for members, _ in shared]
        fits = F.size(acc.kept) < most
        for i, (_, cap) in enumerate(shared):
            fits = fits & (~inside[i] | (count(acc, i) < cap))
        counts = F.array(*[count(acc, i) + F.when(fits & inside[i], 1).otherwise(0) for i in range(len(shared))]).cast("array<int>")
        return F.struct(counts.alias("shared"), F.when(fits, F.concat(acc.kept, F.array(x.o))).otherwise(acc.kept).alias("kept"))

    kept = lists.select(key, F.posexplode(F.aggregate("all", start, step, lambda acc: acc.kept)).alias("place", order))
    return df.join(kept, [key, order])


def query_plan(df: DataFrame, keys: list[str], name: str, place: str, templates: list[str], banned: str, most: int) -> DataFrame:
    """Templates filled in, banned phrases dropped, distinct in order, at most `most`."""
    filled = F.array(*[F.replace(F.replace(F.lit(t), F.lit("{name}"), F.col(name)), F.lit("{place}"), F.col(place)) for t in templates])
    return df.select(*keys, F.posexplode(F.slice(F.array_distinct(F.filter(filled, lambda q: ~q.rlike(banned))), 1, most)).alias("n", "query"))


def brand_match(host: Column, tokens: Column) -> Column:
    """A token of three letters or more in the host's root, the root in a token, or a token in the host without hyphens."""
    root = F.split_part(host, F.lit("."), F.lit(1))
    bare = F.replace(host, F.lit("-"), F.lit(""))
    return F.exists(tokens, lambda t: (F.length(t) >= 3) & (F.contains(root, t) | F.contains(t, root) | F.contains(bare, t)))


def placeholder_name(name: Column, ticker: Column) -> Column:
    """Missing, blank, the ticker itself, or the ticker with a venue."""
    n, t = F.upper(F.trim(name)), F.upper(F.trim(ticker))
    return F.coalesce((n == "") | (n == t) | n.startswith(F.concat(t, F.lit("."))), F.lit(True))


def names_match(a: Column, b: Column, suffixes: str = r"\b(inc|corp|ltd|plc|sa|ag|holding|group)\b") -> Column:
    """F8: equal without legal suffixes, or one the other's beginning."""
    x, y = (T.normalize_title(F.regexp_replace(F.lower(c), suffixes, " ")) for c in (a, b))
    return (x == y) | ((F.length(x) > 0) & y.startswith(x)) | ((F.length(y) > 0) & x.startswith(y))


def json_from_text(text: Column) -> Column:
    """A fenced block's object, else what lies from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))
