"""Queries for parsers and research rules, over the given tables or payloads that Spark makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import domain as DM
from tessera.functions import text as T
from tessera.operators import events as E
from tessera.operators import documents as D
from tessera.operators import packs as PK
from tessera.operators import reconcile as RC
from tessera.operators import research as RS
from tessera.operators import scoring as R
from tessera.operators import screening as P
from tessera.operators import selection as S
from tessera.operators import timeseries as W
from tessera.plans.catalogue import query
from tessera.sources import parsers as SP
from tessera.sources.tables import event_feed, facts, prices, table


# --- sources


@query
def price_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """S1 on CSV lines of orders: every 7th has a bad date, every 11th a bad close, every 5th no volume."""
    o = table(spark, sf, "orders")
    date = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    close = F.when(F.col("o_orderkey") % 11 == 0, "-").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    line = F.concat_ws(",", date, F.lit("1.5"), F.lit(""), F.lit("x"), close, F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))))
    return SP.price_csv(o.select("o_orderkey", line.alias("line")), ["o_orderkey"], "line")


@query
def price_json_scan(spark: SparkSession, sf: str) -> DataFrame:
    """S3 on one JSON array per instrument and month."""
    p = prices(spark, sf).withColumn("month", F.trunc("date", "month"))
    row = F.struct(F.when(F.col("volume") % 9 > 0, F.col("date").cast("string")).alias("date"), F.when(F.col("volume") % 7 > 0, F.col("volume").cast("string")).otherwise("bad").alias("close"), F.col("volume").cast("string").alias("volume"))
    return SP.price_json(p.groupBy("instrument", "month").agg(F.to_json(F.collect_list(row)).alias("payload")), ["instrument"], "payload")


@query
def concept_facts_scan(spark: SparkSession, sf: str) -> DataFrame:
    """S6 on nested JSON per nation: revenue under two aliases, of which even nations lack the first."""
    f = facts(spark, sf)
    fact = lambda v: F.struct("fy", F.when(F.col("fy") % 3 == 0, "10-Q").otherwise("10-K").alias("form"), F.concat("fy", F.lit("-12-31")).alias("end"), v.alias("val"), F.col("filed").cast("string").alias("filed"))
    both = f.groupBy("entity").agg(F.collect_list(fact(F.col("revenue"))).alias("a"), F.collect_list(fact(F.col("gross"))).alias("b"))
    name = F.when(F.col("entity") % 2 == 0, "SalesNet").otherwise("Revenues")
    payload = F.to_json(F.create_map(name, F.create_map(F.lit("USD"), F.col("a")), F.lit("GrossProfit"), F.create_map(F.lit("USD"), F.col("b"))))
    return SP.concept_facts(both.select("entity", payload.alias("payload")), ["entity"], "payload", {"revenue": ["Revenues", "SalesNet"], "gross": ["GrossProfit"]}, ["10-K"])


def _filings(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    form = F.element_at(F.create_map(*[F.lit(x) for kv in (("1-URGENT", "10-K"), ("2-HIGH", "10-Q"), ("3-MEDIUM", "8-K"), ("4-NOT SPECIFIED", "S-1"), ("5-LOW", "4")) for x in kv]), F.col("o_orderpriority"))
    date = F.when(F.col("o_orderkey") % 13 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = o.select("o_custkey", F.struct("o_orderkey", form.alias("form"), date.alias("filing_date")).alias("x")).groupBy("o_custkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select("o_custkey", F.col("x.o_orderkey").alias("accession"), F.col("x.form").alias("form"), F.col("x.filing_date").alias("filing_date"))


@query
def filings_scan(spark: SparkSession, sf: str) -> DataFrame:
    """S8, T13 on parallel arrays per customer."""
    rows = SP.parallel_arrays(_filings(spark, sf), ["o_custkey"], ["accession", "form", "filing_date"])
    return SP.recent_filings(rows, ["o_custkey"], ["10-K", "10-Q", "8-K"], "2001-12-31", 1500, 4)


@query
def item_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes, padded identifiers and accession numbers made of orders."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Item "), F.col("o_custkey") % 9 + 1, F.lit(".0"), F.col("o_orderkey") % 5, F.lit(", item 9.01, ")).alias("items"), F.concat(F.lit("CIK"), F.col("o_custkey").cast("string")).alias("cik"), F.lpad(F.col("o_orderkey").cast("string"), 18, "0").alias("acc"))
    acc = T.accession(F.col("acc"))
    return o.select("o_orderkey", F.array_join(T.item_codes(F.col("items")), "|").alias("codes"), T.cik(F.col("cik")).alias("cik"), acc.alias("accession"), F.concat_ws("/", F.lit("data"), T.cik(F.col("cik")), F.replace(acc, F.lit("-"), F.lit(""))).alias("path"))


@query
def feed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """S14, S15 on an RSS document per page, every fourth an Atom one: every third link is a media file, so the guid is the canonical link."""
    p = table(spark, sf, "pages").select("page_id", F.replace("url", F.lit("&"), F.lit("&amp;")).alias("url"))
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://cdn.example.com/media/"), F.col("page_id").cast("string"), F.lit(".mp3"))).otherwise(F.col("url"))
    xml = F.concat(F.lit("<rss><channel><item><title>t"), F.col("page_id").cast("string"), F.lit("</title><link>"), link, F.lit("</link><guid>"), F.col("url"), F.lit("</guid></item></channel></rss>"))
    atom = F.concat(F.lit('<feed><entry><title>t'), F.col("page_id").cast("string"), F.lit('</title><link rel="self" href="x"/><link href="'), link, F.lit('"/><id>'), F.col("url"), F.lit("</id></entry></feed>"))
    xml = F.when(F.col("page_id") % 4 == 0, atom).otherwise(xml)
    items = SP.feed_items(p.select("page_id", xml.alias("xml")), "page_id", "xml")
    return items.select("page_id", "n", "title", SP.canonical_link(F.col("link"), F.col("guid")).alias("link"))


@query
def primary_document_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as a filing's files."""
    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "EX-99").when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), "10-K").otherwise("GRAPHIC")
    name = F.concat(F.lit("d"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linestatus") == "O", ".htm").otherwise(".txt"))
    e = li.select("l_orderkey", kind.alias("kind"), name.alias("name"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("size"), ((F.col("l_linenumber") == 7) & (F.col("l_tax") == 0)).alias("is_hint")).distinct()
    return SP.primary_document(e, ["l_orderkey"], F.lit("10-K")).select("l_orderkey", "rule", "name", "size")


@query
def synthetic_prices(spark: SparkSession, sf: str) -> DataFrame:
    return SP.synthetic_prices(table(spark, sf, "part"), "p_partkey", "p_retailprice", [0, 30, 365]).withColumn("price", F.round("price", 2))


@query
def provider_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's value from large lines, else from small ones, else a gap."""
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", (F.col("l_quantity") >= 50).alias("large")).agg(F.max("l_extendedprice").alias("v"))
    one = lambda large: li.filter(F.col("large") == large).select(F.col("l_suppkey").alias("s_suppkey"), "v").filter((F.col("s_suppkey") % 10 > 2) if large else (F.col("s_suppkey") % 10 > 0))
    return SP.with_fallback(table(spark, sf, "supplier").select("s_suppkey"), one(True), one(False), "s_suppkey", "v")


@query
def bounded_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """S34 on documents: the longest tokens first; the envelope's hash."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.regexp_replace("text", r"[^A-Za-z0-9 ]", "").alias("text"))
    d = d.withColumn("items", F.array_sort(T.tokens(F.col("text"), 6)))
    return SP.envelope(d, ["doc_id"], "text", "items", 200, 5).select("doc_id", F.md5(F.col("envelope").cast("binary")).alias("envelope_md5"))


@query
def ticker_index(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON object of objects exploded to a lookup; suppliers in nations under 20 are eligible."""
    m = table(spark, sf, "supplier").select("s_nationkey", F.to_json(F.create_map(F.col("s_suppkey").cast("string"), F.struct(F.col("s_suppkey").alias("cik_str"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("title")))).alias("payload"))
    rows = m.select("s_nationkey", F.explode(F.from_json("payload", "map<string,struct<cik_str:bigint,ticker:string,title:string>>")).alias("k", "v"))
    return rows.filter("s_nationkey < 20").select("v.ticker", T.cik(F.col("v.cik_str").cast("string")).alias("cik"), "v.title")


# --- rules


@query
def thesis_relevance(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    words = F.size(F.array_intersect(F.split("p_name", " "), F.array(*map(F.lit, ["small", "red", "ring", "widget"]))))
    s = RS.thesis_relevance(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), words.cast("double"), F.col("p_type") == "ECONOMY", F.col("p_size") > 25, F.col("p_partkey") % 4 == 0, F.col("p_partkey") % 5 == 0, (F.col("p_size") % 10) / 10, F.col("p_partkey") % 7 == 0)
    return p.select("p_partkey", s.alias("relevance"))


@query
def news_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """R18 on documents: their language's commonest words stand for names and tickers."""
    d = table(spark, sf, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"), "source")
    has = lambda w: F.contains(F.col("t"), F.lit(w))
    age = F.col("doc_id") % 40
    s = RS.news_relevance(has("thereness") | has(" les "), has(" the "), has(" und "), F.col("doc_id") % 3 + 1, F.when(age < 30, age <= 14), has("tion"), F.col("source") == "src1", has("worthless"))
    return d.select("doc_id", s.alias("score")).withColumn("level", RS.relevance_level(F.col("score")))


@query
def evidence_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as evidence; their texts' lengths choose among source types, role and turn give quality and tier."""
    c = table(spark, sf, "conversations")
    kinds = [*RS.FACT_TYPES, *RS.TREND_TYPES[:2], "financial_data_summary", "company_ir_statement_excerpt", RS.DOCUMENT_TYPES[0], "own_excerpt", "catalyst_event", "Market_News ", "press_release", "website", None]
    kind = F.element_at(F.array(*[F.lit(k).cast("string") for k in kinds]), (F.length(F.coalesce("text", F.lit(""))) % len(kinds) + 1).cast("int"))
    fields = F.array_compact(F.array(F.when(F.col("turn") % 7 == 0, "pe_ratio"), F.when(F.col("turn") % 5 == 0, "catalyst"), F.lit("revenue")))
    x = c.select("role", RS.evidence_category(F.when(F.col("role") == "system", "Metadata_only"), kind, F.col("conv_id") % 6 + 1, fields).alias("category"))
    return x.groupBy("role", "category").agg(F.count(F.lit(1)).alias("n"))


@query
def catalyst_classify(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    item = F.when(F.col("doc_id") % 5 == 0, "2.02").when(F.col("doc_id") % 7 == 0, "5.02")
    form = F.when(F.col("doc_id") % 4 == 0, "10-K").when(F.col("doc_id") % 9 == 0, "10-Q")
    category, direction = RS.catalyst_class(item, form, F.coalesce("text", F.lit("")))
    return d.select("doc_id", category.alias("category"), direction.alias("direction"))


@query
def section_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """R21 over suppliers: fields by their number."""
    names = ["name", "price", "revenue", "debt", "risk"]
    have = F.array_compact(F.array(*[F.when(F.col("s_suppkey") % (i + 2) > 0, n) for i, n in enumerate(names)]))
    s = table(spark, sf, "supplier").select("s_suppkey", have.alias("have"))
    return RS.section_gaps(s, ["s_suppkey"], "have", {"identity": (["name"], True), "financials": (["price", "revenue", "debt"], True), "risks": (["risk"], False)})


@query
def committee_chair(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    flag = lambda k, m: (F.col("p_partkey") % k != m)
    x = p.select("p_partkey", flag(3, 0).alias("source_ok"), flag(5, 1).alias("citations_ok"), flag(4, 2).alias("schema_ok"), flag(7, 3).alias("valuation_ok"), flag(6, 5).alias("no_gap"), (F.col("p_size") % 7).alias("bull"), (F.col("p_size") % 5).alias("bear"), (F.col("p_partkey") % 19 == 0).alias("mock"), (F.col("p_size") % 6 + 1).alias("tier"))
    return RS.chair(x).select("p_partkey", "gates", "balance", "committee_status")


@query
def gap_attribution(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    gaps = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "colour"), F.when(F.col("p_size") % 3 == 0, "size")))
    return p.select("p_partkey", RS.grounded_gap(F.col("p_name"), gaps, {"colour": "red|blue|green", "size": "small|large"}, "not available").alias("gap_text"))


@query
def claim_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as claims, documents as scoped evidence."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("claim_id"), F.concat_ws(" ", F.coalesce("text", F.lit("")), F.col("turn").cast("string"), F.col("conv_id").cast("string")).alias("text"), F.array(F.col("conv_id"), F.col("conv_id") + F.col("turn")).alias("cited"))
    e = table(spark, sf, "documents").select("doc_id", F.col("source").alias("scope"), F.col("lang").alias("period"))
    return RS.mixed_scopes(c, e)


@query
def category_budget(spark: SparkSession, sf: str) -> DataFrame:
    """T8 over events of a user: views and clicks share a cap, clicks and purchases another."""
    e = event_feed(spark, sf).select("entity", "event_class", "event_id")
    return RS.category_budget(e, "entity", "event_id", "event_class", {"error": 2, "signup": 3}, [(["view", "click"], 5), (["click", "purchase"], 4)], {"purchase": 2, "signup": 1}, 10)


@query
def news_query_plan(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return RS.query_plan(s, ["s_suppkey"], "s_name", "n_name", ["{name} results", "{name} {place}", "{name} buy rating", "{place} industry", "{name} results", "{place} regulation", "{name} orders"], "(?i)buy rating", 4)


@query
def brand_domains(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    host = T.domain(F.col("url"))
    return p.select("page_id", host.alias("host"), RS.brand_match(host, F.array(F.lit("blog"), F.lit("ther"), F.lit("an"))).alias("brand"), host.endswith("example.org").alias("trusted"), host.contains("spam").alias("low_quality"))


@query
def identity_checks(spark: SparkSession, sf: str) -> DataFrame:
    """P14, F8, K34 on suppliers."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("t"), F.col("s_suppkey").cast("string"), F.lit(".US"))).when(F.col("s_suppkey") % 7 == 0, " ").otherwise(F.col("s_name")).alias("name"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"), "s_name")
    return s.select("s_suppkey", RS.placeholder_name(F.col("name"), F.col("ticker")).alias("placeholder"), RS.names_match(F.concat("s_name", F.lit(" Holding AG")), F.concat(F.col("s_name"), F.lit(" Inc"))).alias("same"), T.slug(F.concat_ws(" ", "name", "ticker")).alias("slug"))


@query
def json_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Properties wrapped in prose or a code fence."""
    e = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```\nend"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("x "), F.col("props"), F.lit(" y"))).otherwise("none")
    return e.select("event_id", F.get_json_object(RS.json_from_text(text), "$.k").cast("int").alias("k"))


@query
def lineage_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's record from the newest urgent order, else the newest of high priority, else the newest of all."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    newest = lambda df, n: S.latest(df, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", F.struct(F.lit(n).alias("rule"), "o_orderkey").alias(f"r{n}"))
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    for n, df in ((1, o.filter("o_orderpriority = '1-URGENT'")), (2, o.filter("o_orderpriority = '2-HIGH'")), (3, o)):
        base = base.join(newest(df, n), "o_custkey", "left")
    return base.select("o_custkey", F.coalesce("r1", "r2", "r3").alias("r")).select("o_custkey", "r.rule", "r.o_orderkey")


@query
def provenance_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders (attempts) of a customer to their lines (documents), counted once per distinct part. Each count has rows of its own:
    several distinct counts in one aggregate would hold every line once for each of them, with all keys, in a task's memory."""
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    li = table(spark, sf, "lineitem").filter("l_returnflag <> 'N'")
    once = lambda c: o.join(li.filter(F.col(c).isNotNull()).select("l_orderkey", c), "l_orderkey").groupBy("o_custkey", c).agg(F.count(F.lit(1)).alias("n")).groupBy("o_custkey")
    parts, suppliers = once("l_partkey").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("links")), once("l_suppkey").agg(F.count(F.lit(1)).alias("issuers"))
    attempts = o.groupBy("o_custkey").agg(F.countDistinct("l_orderkey").alias("attempts"))
    same = lambda n: attempts["o_custkey"].eqNullSafe(F.col(n))
    x = attempts.join(parts.withColumnRenamed("o_custkey", "__p"), same("__p"), "left").join(suppliers.withColumnRenamed("o_custkey", "__s"), same("__s"), "left")
    return x.select("o_custkey", "attempts", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("documents", "links", "issuers")])


@query
def country_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The first region of each segment in registry order, and the sorted names of all its nations."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("c_mktsegment").agg(F.min(F.struct("c_custkey", "n_regionkey")).alias("x"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations")).select("c_mktsegment", F.col("x.n_regionkey").alias("first_region"), "nations")


@query
def chair_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates gathered by action, in order."""
    s = table(spark, sf, "supplier").withColumn("action", F.when(F.col("s_acctbal") < 0, "drop").when(F.col("s_acctbal") < 5000, "watch").otherwise("advance"))
    return s.groupBy("s_nationkey", "action").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("s_suppkey")), ",").alias("suppliers"))


@query
def evidence_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Side-by-side counts of evidence per source of documents."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("references"), F.count("quality").alias("extracted"), F.count_if(F.col("quality") == 1).alias("validated"), F.count_if(F.col("quality").isNull()).alias("metadata_only"), F.count_if(F.col("toxic") == 1).alias("failed"), F.countDistinct("lang").alias("languages"))


@query
def fact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a part with equal flag, status and quantity are one fact; the first order keeps it."""
    key = RC.semantic_key("l_partkey", "l_returnflag", "l_linestatus", value="l_quantity")
    return table(spark, sf, "lineitem").groupBy(key.alias("fact_key")).agg(F.min("l_orderkey").alias("first_order"), F.count(F.lit(1)).alias("copies"))


@query
def document_get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of odd number come in; those whose text an even one has are reused, the others inserted once per text."""
    d = table(spark, sf, "documents").select("doc_id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
    old = d.filter("doc_id % 2 = 0").groupBy("hash").agg(F.min("doc_id").alias("old_id"))
    new = d.filter("doc_id % 2 = 1").groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("requests"))
    return new.join(old, "hash", "left").select("hash", F.coalesce("old_id", "doc_id").alias("doc_id"), "requests", F.when(F.col("old_id").isNull(), "inserted").otherwise("reused").alias("action"))


@query
def event_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Days from ISO and RFC 822 stamps, none from others."""
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss Z")).otherwise("soon")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", T.date_of(raw).alias("day"))


@query
def exchange_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of a customer's venue from its nation and region, missing evidence told apart."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    c = table(spark, sf, "customer").join(n, "c_nationkey", "left")
    quote = F.when(F.col("r_name") == "EUROPE", "EUR").when(F.col("r_name") == "AMERICA", "USD").otherwise("LOCAL")
    return c.select("c_custkey", F.col("r_name").alias("region"), quote.alias("quote_currency"), T.provenance(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") > 0).alias("provenance"), T.http_class(F.col("c_custkey") % 700).alias("http_class"))


# --- packs and records


@query
def thesis_parse(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", *[c.alias(n) for n, c in PK.parse_thesis(F.coalesce("text", F.lit(""))).items()])


@query
def sector_match(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    wanted = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, "Promo").when(F.col("p_partkey") % 4 == 2, "small").otherwise("BURNISHED")
    return p.select("p_partkey", PK.canonical_sector(F.col("p_type")).alias("sector"), PK.sector_matches(wanted, F.col("p_type")).alias("matches"))


@query
def qualifying_facts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    field = F.element_at(F.array(*map(F.lit, ["revenue", "income", "employees"])), (F.col("l_linenumber") % 3 + 1).cast("int"))
    f = li.select("l_partkey", field.alias("field"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("value"), F.when(F.col("l_discount") > 0.05, "high").otherwise("low").alias("confidence"), F.when(F.col("l_returnflag") == "A", "group").when(F.col("l_returnflag") == "R", "segment").alias("scope"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("o"))
    return PK.qualifying(f, ["l_partkey"], "field", "o", ["revenue", "income"]).select("l_partkey", "field", "value", F.col("o.l_orderkey").alias("order_key"))


@query
def comparable_cascade(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    reasons = {"no_analysis": F.col("orders").isNull(), "draft_only": F.col("done") == 0, "not_valid": F.col("c_acctbal") < 500}
    return PK.comparable(c.join(n, "c_custkey", "left"), ["c_nationkey"], reasons, [F.desc("c_acctbal"), F.asc("c_custkey")], 10).select("c_custkey", "reason")


@query
def price_provenance(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").join(prices(spark, sf).groupBy(F.col("instrument").alias("s_suppkey")).agg(F.max("date").alias("last")), "s_suppkey", "left")
    key = F.col("s_suppkey")
    out = PK.price_provenance(key % 4 > 0, F.when(key % 3 == 0, "own"), F.lit("snapshot"), F.when(key % 5 == 0, "not_sourced").otherwise("USD"), F.col("last"))
    return s.select("s_suppkey", *[c.alias(n) for n, c in out.items()])


@query
def excerpt_ranking(spark: SparkSession, sf: str) -> DataFrame:
    b = D.paragraphs(table(spark, sf, "documents"), "doc_id", "text").withColumn("relevance", D.relevance(F.col("block"))).withColumn("kind", T.classify(F.col("block"), **D.CLASSES))
    return PK.excerpts(b, "doc_id", "block_no", "block", "relevance", "kind").select("doc_id", "block_no", "relevance", "kind", "lead", "place")


@query
def evidence_pack(spark: SparkSession, sf: str) -> DataFrame:
    """A nation's suppliers, then customers, as channels."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("priority"), F.col("s_name").alias("item"), F.col("s_acctbal").alias("weight"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit(2).alias("priority"), F.col("c_name").alias("item"), F.col("c_acctbal").alias("weight"))
    return PK.evidence_pack(s.unionByName(c), "k", "priority", [F.desc("weight"), F.asc("item")], 12)


@query
def snapshot_compose(spark: SparkSession, sf: str) -> DataFrame:
    """identity, price and trend of a supplier."""
    t = W.trend_signals(prices(spark, sf)).select(F.col("instrument").alias("s_suppkey"), "last_close", "return_6m", "momentum_label")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_acctbal") > 3000, F.col("s_acctbal")).alias("balance"))
    return PK.snapshot(s.join(t.filter("s_suppkey % 6 > 0"), "s_suppkey", "left"), "s_suppkey", ["s_name", "balance", "last_close", "return_6m", "momentum_label"])


@query
def weak_datapoints(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    tier = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("T"), (F.col("p_size") % 6 + 1).cast("string")))
    d = p.select("p_partkey", F.explode(F.array(*map(F.lit, ["revenue", "name", "debt"]))).alias("field"), tier.alias("tier"))
    return PK.weak_datapoints(d, ["p_partkey"], ["revenue", "debt"], ["T1", "T2"])


@query
def grid_facts(spark: SparkSession, sf: str) -> DataFrame:
    """V1 on tables made of a nation's facts: revenue and gross of up to three years under a header that lacks the second year."""
    f = facts(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy("fy"))).filter("n <= 3 AND gross IS NOT NULL")
    at = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("fy", F.col(c).alias("v")))), lambda x: F.format_number(x.v, 2))
    header = F.concat(F.array(F.lit("Item")), F.transform(F.sort_array(F.collect_list(F.struct("fy", "n"))), lambda x: F.when(x.n == 2, "restated").otherwise(F.concat(F.lit("FY "), x.fy))))
    g = f.groupBy("entity").agg(header.alias("header"), at("revenue").alias("a"), at("gross").alias("b"), at("orders").alias("c"))
    rows = g.select("entity", "header", F.explode(F.array(F.concat(F.array(F.lit("Total Revenue")), "a"), F.concat(F.array(F.lit("Gross amount")), "b"), F.concat(F.array(F.lit("Something")), "c"))).alias("cells"))
    return PK.grid_facts(rows, ["entity"], {"revenue": "revenue", "gross": "gross"})


@query
def report_join(spark: SparkSession, sf: str) -> DataFrame:
    """A nation's newest completed order whose customer has a balance."""
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").join(table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return S.latest(o, ["c_nationkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("c_nationkey", "o_orderkey", "o_totalprice")


@query
def flat_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct blocks of documents of a source, ranked by relevance, within a budget of characters."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("source", "doc_id", F.length("text").alias("size"), T.short_hash(F.col("text")).alias("h"), D.relevance(F.col("text")).alias("relevance"))
    one = S.latest(d, ["source", "h"], [F.asc("doc_id")])
    ranked = one.withColumn("order", F.shiftleft(F.lit(1 << 20) - F.col("relevance").cast("long"), 40) + F.col("doc_id"))  # one number for both, so that no source is ranked whole
    return S.budget(ranked.drop("h"), "source", "order", "size", 20_000, 10).drop("order")


# --- names, scopes, kinds


@query
def symbol_builder(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "r_name")
    s = table(spark, sf, "supplier").join(n, "s_nationkey", "left")
    return s.select("s_suppkey", DM.symbol(F.concat(F.lit(" T"), F.col("s_suppkey").cast("string")), F.col("r_name")).alias("symbol"))


@query
def lei_records(spark: SparkSession, sf: str) -> DataFrame:
    """S12 on JSON records of customers, of which every fourth has a malformed identifier."""
    c = table(spark, sf, "customer")
    lei = F.concat(F.lit("LEI0"), F.lpad(F.col("c_custkey").cast("string"), 14, "0"), F.when(F.col("c_custkey") % 4 == 0, "XX").otherwise("42"))
    j = c.select("c_custkey", F.to_json(F.struct(F.struct(lei.alias("lei"), F.struct(F.col("c_name").alias("legalName"), F.col("c_nationkey").alias("country")).alias("entity")).alias("attributes"))).alias("record"))
    r = j.select("c_custkey", F.from_json("record", "attributes struct<lei:string,entity:struct<legalName:string,country:int>>").alias("r"))
    return r.select("c_custkey", F.col("r.attributes.lei").alias("lei"), DM.is_lei(F.col("r.attributes.lei")).alias("valid"), F.col("r.attributes.entity.legalName").alias("name"), F.col("r.attributes.entity.country").alias("country"))


@query
def source_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Regions are sources; a nation's customers without any order of a priority leave a gap row for it."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    have = table(spark, sf, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("source")).distinct()
    wanted = c.select("c_custkey", "c_nationkey", F.explode(F.array(*map(F.lit, ["1-URGENT", "5-LOW"]))).alias("source"))
    return P.anti(wanted, have, ["c_custkey", "source"]).groupBy("c_nationkey", "source").agg(F.count(F.lit(1)).alias("gaps"))


@query
def brand_tokens(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(DM.brand_tokens(F.concat_ws(" ", "p_name", F.lit("Holding Inc."), "p_name", "p_type")), " ").alias("tokens"))


@query
def document_kinds(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("title", F.element_at(F.array(*map(F.lit, ["Annual report", "half-year figures", "Results 2001", "Slides", "Home"])), (F.col("page_id") % 5 + 1).cast("int")))
    x = p.select(DM.document_kind(F.concat_ws(" ", "title", "url")).alias("kind"), DM.period_rank(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("FY "), F.col("page_id") % 30 + 1990))).alias("rank"))
    return x.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("newest"))


@query
def fact_scopes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    heading = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_type"), F.lit(" Segment"))).when(F.col("p_size") % 3 == 1, "Consolidated").otherwise(F.col("p_type"))
    s = DM.scope(heading, F.when(F.col("p_partkey") % 2 == 0, "Divisions"))
    field = F.element_at(F.array(*map(F.lit, [*DM.CATEGORIES, "people"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select("p_partkey", s.alias("scope"), DM.fact_category(field, s).alias("category"), DM.primary_credit(F.col("p_size"), F.col("p_partkey") % 5).alias("credit"))


@query
def gap_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct labels of a customer's orders in order of first appearance, and a map under both spellings."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    labels = F.array_distinct(F.transform("x", lambda y: y.o_orderpriority))
    both = F.map_concat(F.create_map(F.lit("labels"), F.size(labels)), F.create_map(F.lit("label_list"), F.size("x")))
    return o.select("o_custkey", F.array_join(labels, "|").alias("labels"), F.element_at(both, "labels").alias("n_labels"), F.element_at(both, "label_list").alias("n_all"))


@query
def narration(spark: SparkSession, sf: str) -> DataFrame:
    """A sentence on what a nation's year has."""
    f = facts(spark, sf)
    text = F.when(F.col("gross").isNull(), F.format_string("%d: no lines", "fy")).otherwise(F.format_string("%d: revenue %s over %d orders", F.col("fy"), T.money(F.round(F.col("revenue") / 1e6, 6)), F.col("orders").cast("int")))
    return f.select("entity", "fy", text.alias("summary"))
