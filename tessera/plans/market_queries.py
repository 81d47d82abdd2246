"""Queries on market texts: theses, catalysts and news over whole documents, with a sentence added that the key decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import discovery as D
from tessera.operators import evidence_counts as E
from tessera.operators import grounding as G
from tessera.operators import market_texts as MT
from tessera.plans.catalogue import query
from tessera.plans.fact_queries import filled
from tessera.sources import submissions as SB
from tessera.sources.tables import table

THESES = [
    "European watch producers, small cap, excluding handbags",
    "US semiconductor equipment with a strong backlog  and order growth",
    "best stocks in Japan",
    "Nuclear fission and uranium in canada without coal, avoid Banks",
    "nothing of the kind",
    "swiss Watches & Jewelry",
    "data center gpu demand in china and Korea",
]


@query
def market_theses(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, each with a thesis before it."""
    d = table(spark, sf, "documents")
    d = d.select("doc_id", F.concat_ws(" \t", filled(THESES, F.col("doc_id"), {}), "text").alias("text"))
    return MT.parsed_theses(d, ["doc_id"], "text")


HEADLINES = [
    "Firm acquires rival in merger", "Firm misses estimate and cuts guidance", "Firm named to list of best employers; dividend", "Firm sets conference call for webcast", "Firm unveils new model", "Regulator opens investigation", "Quiet day",
    "Firm launches partnership despite recall", "Facility layoff and fraud",
]
FORMS = [None, "10-K", "def 14a", "S-3", "8-K"]
ITEMS = ["", "2.02", "9.01,4.01", "5.02", "9.99"]


@query
def market_catalysts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as summaries of headlines; keys choose form, items, tier and the rest."""
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select(
        "doc_id", filled(HEADLINES, k, {}).alias("headline"), F.col("text").alias("summary"), (k % 6 + 1).cast("int").alias("tier"), F.element_at(F.array(*[F.lit(f).cast("string") for f in FORMS]), (k % 5 + 1).cast("int")).alias("form"),
        F.split(F.element_at(F.array(*map(F.lit, ITEMS)), (F.floor(k / 5) % 5 + 1).cast("int")), ",").alias("items"), (k % 11 == 0).alias("is_filing"), (k % 13 == 0).alias("multi_source"), F.lit(False).alias("has_source"),
    )
    return MT.classified_catalysts(d, "doc_id")


ADDED = ["{name} has news", "the {ticker}", "{name} and {TICKER}", "an apple pie recipe", "apple shares fall", "", "solar"]


def letters(key: Column) -> Column:
    return F.translate(key.cast("string"), "0123456789", "bcdfghjklm")


@query
def market_news(spark: SparkSession, sf: str) -> DataFrame:
    """All suppliers, by names made of their keys, against all documents as news; two of seven documents name none."""
    s = table(spark, sf, "supplier")
    plain = F.col("s_suppkey") != 1
    companies = s.select("s_suppkey", F.when(plain, F.concat(F.lit("Quorv"), letters(F.col("s_suppkey")), F.lit(" Holdings, Inc."))).otherwise("Apple Inc").alias("name"), F.when(plain, F.concat(F.lit("QX"), F.upper(letters(F.col("s_suppkey"))))).otherwise("AAPL").alias("ticker"), F.when(F.col("s_suppkey") % 2 == 1, "energy").otherwise("retail").alias("sector"))
    k = F.col("doc_id")
    of = letters(k % 9 + 2)
    said = filled(ADDED, k, {"name": F.concat(F.lit("QUORV"), of), "ticker": F.concat(F.lit("qx"), of), "TICKER": F.concat(F.lit("QX"), of)})
    host = F.element_at(F.array(*map(F.lit, ["news.example.com", "m.social.example", "stock-predictions.example"])), (k % 11 % 3 + 1).cast("int"))
    published = F.when(k % 4 > 0, F.date_format(F.date_sub(F.lit("2025-06-30").cast("date"), (k % 200).cast("int")), "yyyy-MM-dd")).otherwise("unknown")
    news = table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", said, "text").alias("text"), F.concat(F.lit("https://"), host, F.lit("/a")).alias("url"), (k % 6 + 1).cast("int").alias("tier"), published.alias("published"))
    scored = MT.matched_news(news, companies, "doc_id", "s_suppkey", "2025-06-30", 90, ["social.example"], ["predictions"])
    industry = MT.industry_news(news, spark.createDataFrame([("energy", "Solar & wind"), ("retail", "shoppers")], "sector string, phrase string"), "doc_id", "sector")
    return MT.with_industry_floor(scored, industry, companies, "doc_id", "s_suppkey", "sector").select("doc_id", "s_suppkey", "sector", "score", "level", "specific", "named_by", "filtered", "is_industry_context")


LINKS = [
    '<a href="/files/annual-report-{n}.pdf?token=a&amp;v=1">Annual report</a><a href="/files/ANNUAL-report-{n}.pdf">again</a><a href="/about">About</a>',
    '<script type="application/ld+json">{"name": "Press release {n}", "url": "/news/{n}.pdf", "more": [{"x": {"y": "https://elsewhere.test/annual-report.pdf"}}]}</script>',
    '<script id="__NEXT_DATA__" type="application/json">{"docs": [{"title": "Interim report", "file": "/i-{n}.pdf"}, {"file": "/i-{n}.PDF"}]}</script>',
    '<script>window.__INITIAL_STATE__ = {"label": "Webcast deck", "u": "./deck-{n}.pdf"};</script><script>var d = [{"href": "/e-{n}.pdf"}];</script>',
    "<script>var q = {a: '/g-{n}.pdf'}; var broken = {\"a\": [</script><script type=\"application/ld+json\">{oops</script>",
]


@query
def page_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages, each with links put in by every strategy in turn, and a feed for every fourth page."""
    p, n = table(spark, sf, "pages"), F.col("page_id").cast("string")
    url = F.regexp_replace("url", "^http:", "https:")
    pages = p.select("page_id", url.alias("url"), F.concat(filled(LINKS, F.col("page_id"), {"n": n}), F.coalesce("html", F.lit(""))).alias("html"))
    origin = F.regexp_extract(url, "^https://[^/?#]+", 0)
    xml = F.concat(F.lit("<rss><channel><item><title>Full-year results</title><link>"), origin, F.lit("/fy-"), n, F.lit(".pdf</link></item><item><title>Other news</title><link>"), origin, F.lit("/other</link></item></channel></rss>"))
    feeds = p.filter("page_id % 4 = 0").select("page_id", url.alias("url"), xml.alias("xml"))
    return D.discovered(pages, "page_id", "url", "html", 12, feeds)


CLAIMS = ["Group sales of {x} million and 12%.", "Watches grew to {x} thousand", "inflation hit the business by 3%", "nothing to count", "peer group of {x}m"]


@query
def claim_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as claims, each citing three documents, one of which doesn't exist."""
    t, c = table(spark, sf, "conversations").filter("role = 'assistant'"), F.col("conv_id")
    text = F.concat_ws(" ", F.coalesce("text", F.lit("")), filled(CLAIMS, c + F.col("turn"), {"x": (c % 97 + 10).cast("string")}))
    claims = t.select(F.concat(c.cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("claim"), (c % 2).alias("run"), text.alias("text"), F.array(c % 97, c % 89, F.lit(-1).cast("long")).alias("cited"))
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    evidence = d.select(
        k.alias("id"), F.lit(0).cast("long").alias("run"), F.concat_ws(" ", "text", F.lit("It was"), (k + 10).cast("string"), F.lit("million."), F.when(k % 5 == 0, "Inflation.")).alias("text"),
        F.when(k % 4 == 0, "group").when(k % 4 == 1, "Watches").alias("scope"), F.when(k % 3 == 0, "2024").when(k % 3 == 1, "2023").alias("period"),
    )
    return G.grounded_claims(claims, evidence)


@query
def submission_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """A submissions document for each customer; some have no ticker, odd year ends, blank fields, or are no JSON."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    doc = F.struct(
        k.alias("cik"), F.col("c_name").alias("name"), F.when(k % 3 > 0, F.array(F.concat(F.lit("T"), k.cast("string")), F.lit("X"))).otherwise(F.array().cast("array<string>")).alias("tickers"), F.when(k % 2 == 0, F.array(F.lit("NYSE"))).alias("exchanges"), F.col("c_mktsegment").alias("sicDescription"),
        F.element_at(F.array(*map(F.lit, ["1231", "0630", "1331", "9", ""])), (k % 5 + 1).cast("int")).alias("fiscalYearEnd"), F.when(k % 4 == 0, " ").otherwise("Delaware").alias("stateOfIncorporationDescription"), F.lit("").alias("website"),
    )
    payload = F.when(k % 7 == 6, F.lit("[]")).otherwise(F.to_json(doc))
    return SB.profiles(c.select("c_custkey", payload.alias("payload")), ["c_custkey"], "payload").select("c_custkey", "cik", "legal_name", "ticker", "exchange", "industry", "fiscal_year_end", "website", "description", "n_tickers")


@query
def evidence_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Per source of documents as runs; labels tell facts and states, conversations stand for citations and links."""
    d, k = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left"), F.col("doc_id")
    evidence = d.select("source", (k % 5 == 0).alias("is_fact"), (k % 5 == 1).alias("is_metadata"), F.when(k % 3 > 0, F.col("text")).alias("excerpt"), (k % 2 == 0).alias("is_reference"))
    states = E.document_states(d.select("source", F.when(F.col("quality") == 1, "extracted").when(F.col("quality") == 0, "metadata_only").when(k % 9 == 0, "extraction_failed").otherwise("queued").alias("status")), "source", "status")
    t = table(spark, sf, "conversations").withColumn("source", F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")))
    citations = t.select("source", (F.col("conv_id") % 11).alias("source_id"), F.when(F.col("role") == "assistant", "council.claim").when(F.col("role") == "user", "facts.revenue").alias("field_path"))
    links = t.filter("role = 'assistant'").select("source", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("content_hash"))
    counts = E.reconciliation(evidence, citations, links, "source").join(states, "source", "left").withColumns({"fact_fields": F.col("facts"), "filing_events": F.col("documents_failed"), "press_events": F.lit(0)})
    return E.channels(counts, "source").join(counts.select("source", "references", "extracted", "facts", "sources", "citations", "links", "documents_metadata_only"), "source")


EXCHANGE_SEARCHES = ["{company} exchange announcement", "{ticker} regulatory news", "{ticker} strong buy list", "{TICKER}", "{company} EXCHANGE announcement"]
FILING_SEARCHES = ["{company} 10-K", "{company} annual report {industry}", "{ticker} 8-K"]


@query
def search_plans(spark: SparkSession, sf: str) -> DataFrame:
    """K31 over parts as companies; some have no sector, industry or name."""
    p, k = table(spark, sf, "part").repartition("p_partkey"), F.col("p_partkey")  # few files of narrow rows, each with much work
    x = p.select("p_partkey", F.concat(F.lit("t"), k.cast("string")).alias("ticker"), F.when(k % 5 > 0, F.col("p_name")).alias("name"), F.when(k % 3 > 0, F.col("p_brand")).otherwise("").alias("sector"), F.when(k % 2 == 0, F.col("p_type")).alias("industry"))
    return MT.search_plans(x, ["p_partkey"], EXCHANGE_SEARCHES, FILING_SEARCHES, ["strong buy", "price target"], 10)
