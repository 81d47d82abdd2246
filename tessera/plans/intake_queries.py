"""Queries for intake, dimension and fact operators, over the given tables or payloads that Spark makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import documents as D
from tessera.operators import intake as I
from tessera.operators import markup as M
from tessera.operators import scoring as R
from tessera.plans.catalogue import query
from tessera.sources import parsers as SP
from tessera.sources import vendor as V
from tessera.sources.tables import facts, table


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index % len(values) + 1).cast("int"))


def _people(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


@query
def vendor_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as a vendor's rows."""
    rows = _people(spark, sf).select("c_custkey", F.col("c_name").alias("code"), F.lower("r_name").alias("exchange"), pick(["Common Stock", "ETF", "", None, "equity"], F.col("c_custkey")).alias("kind"))
    return I.vendor_rows(rows, "kind", "exchange", "code", "Europe").select("c_custkey", "symbol")


@query
def universe_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Two searches, one by country and one by region, with excluded rows and their reasons."""
    p = _people(spark, sf)
    columns = ["c_mktsegment", "c_name", "r_name"]
    a = I.screened_universe(p, ["FRANCE", "JAPAN", "NATION_3", "NATION_7"], ["EUROPE"], ["furniture", "00007"], "n_name", "r_name", columns).withColumn("search", F.lit("country"))
    b = I.screened_universe(p, [], ["ASIA", "EUROPE"], ["", "Machinery"], "n_name", "r_name", columns).withColumn("search", F.lit("region"))
    return a.unionByName(b).select("search", "c_custkey", "reason")


@query
def thesis_context(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as candidates, parts as curated items; a ticker may have several items or none."""
    candidates = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit(" s"), F.col("s_suppkey").cast("string")).alias("ticker"))
    items = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("S"), (F.col("p_partkey") % 40 * 2).cast("string")).alias("ticker"), F.col("p_type").alias("theme"))
    return I.with_context(candidates, items, "ticker", [F.asc("p_partkey")], ["p_partkey", "theme"]).select("s_suppkey", "p_partkey", "theme")


@query
def rank_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of a nation by balance in hundreds; those in debt have no rank."""
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100)).alias("rank"))
    return I.ranked(c, ["c_nationkey"], "rank", "c_custkey")


@query
def document_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a brand as documents."""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", pick([*I.KINDS, "brochure", None], F.col("p_size")).alias("kind"), (F.col("p_partkey") % 2 == 0).alias("downloadable"))
    return I.rank_documents(p, ["p_brand"], "kind", "downloadable", "p_partkey").select("p_brand", "p_partkey", "place")


@query
def evidence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as evidence; even ones have an address."""
    d = table(spark, sf, "documents").withColumn("url", F.when(F.col("doc_id") % 2 == 0, F.col("source"))).withColumn("ident", F.col("doc_id") % 50)
    return I.dedupe_evidence(d, "url", "ident", "lang", "text", "doc_id").select("doc_id")


@query
def freshest_alias(spark: SparkSession, sf: str) -> DataFrame:
    """Two tags for revenue that overlap for some years; a fifth of the nations files quarterly reports alone."""
    f = facts(spark, sf).withColumn("annual", F.col("entity") % 5 > 0)
    old = f.filter("fy < 1999 OR entity % 2 = 0").select("entity", F.lit("Revenues").alias("alias"), F.lit(0).alias("alias_order"), "fy", "filed", "annual", F.col("revenue").alias("value"))
    new = f.filter("fy >= 1998 AND entity % 3 > 0").select("entity", F.lit("SalesNet").alias("alias"), F.lit(1).alias("alias_order"), "fy", "filed", "annual", F.col("gross").alias("value"))
    return I.freshest_alias(old.unionByName(new), ["entity"])


@query
def vendor_statements(spark: SparkSession, sf: str) -> DataFrame:
    """A nested document for each nation, with a year that has no revenue and a market value that is no number."""
    f = facts(spark, sf)
    year = F.struct(F.concat(F.col("fy").cast("string"), F.lit("-12-31")).alias("date"), F.when(F.col("fy") % 3 > 0, F.col("revenue").cast("decimal(18,2)").cast("string")).alias("totalRevenue"), F.col("gross").cast("decimal(18,2)").cast("string").alias("grossProfit"))
    years = f.groupBy("entity").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("fy").cast("string").alias("k"), year.alias("v"))))).alias("yearly"))  # a nation has some ten years
    cap = F.when(F.col("entity") % 4 == 0, F.lit("n/a")).otherwise((F.col("entity") * 1_500_000).cast("string"))
    payload = F.to_json(F.struct(F.struct(F.col("entity").cast("string").alias("Code")).alias("General"), F.struct(cap.alias("MarketCapitalization"), F.when(F.col("entity") % 3 == 0, F.lit("12.5")).alias("PERatio")).alias("Highlights"), F.struct(F.struct("yearly").alias("Income_Statement")).alias("Financials")))
    return SP.vendor_statements(years.select("entity", payload.alias("payload")), ["entity"], "payload")


@query
def news_json(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as payloads of three shapes."""
    title = F.concat(F.lit("t"), F.col("page_id").cast("string"))
    one = F.to_json(F.struct(title.alias("title"), "url", F.lit("2024-01-02").alias("publishedAt"), F.struct(F.lit("Wire").alias("name")).alias("source")))
    first = F.concat(F.lit('{"articles": ['), one, F.lit(', {"title": "", "headline": "x", "link": "http://www.example.com/a", "source": "own"}]}'))
    second = F.to_json(F.array(F.struct(title.alias("headline"), F.col("url").alias("link"), F.lit("2024").alias("seendate"), F.lit("House").alias("publisher"))))
    third = F.concat(F.lit('{"articles": "none", "results": [{"nothing": 1, "title": null}, '), F.to_json(F.struct(title.alias("name"))), F.lit("]}"))
    payload = F.when(F.col("page_id") % 3 == 0, first).when(F.col("page_id") % 3 == 1, second).otherwise(third)
    return SP.news_json(table(spark, sf, "pages").select("page_id", payload.alias("payload")), ["page_id"], "payload", {"example.com": 3, "example.org": 4}).drop("summary")


@query
def heading_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with sections added under their own heading."""
    tail = F.concat(F.lit("<h2 class='x'>Part <b>"), F.col("page_id").cast("string"), F.lit("</b></h2><p>x</p><h4>Deep</h4><h3>Less</h3><h2></h2><h2>Next</h2>"))
    return M.headings(M.structure(table(spark, sf, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), tail).alias("html")), "page_id", "html"), "page_id")


@query
def html_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables for each order line count."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("<TABLE a=1><tr><th>Key<th></th></tr><tr class=r><td>"), F.col("o_orderkey").cast("string"), F.lit("</td><td><i>"), F.col("o_orderpriority"), F.lit("</i>\n x</td></tr><tr></tr></TABLE>text<table><tr><td>"), F.col("o_orderstatus"), F.lit("</td></tr></table>")).alias("html"))
    return M.table_rows(M.structure(o, "o_orderkey", "html"), "o_orderkey").select("o_orderkey", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


@query
def json_slice(spark: SparkSession, sf: str) -> DataFrame:
    """An event's properties amid prose, with brackets in strings."""
    e = table(spark, sf, "events")
    payload = F.concat(F.lit('{"note": "a } in \\" text [", "rows": [1, {"p": '), F.col("props"), F.lit("}]}"))
    text = F.when(F.col("event_id") % 5 == 0, F.lit("no brackets here")).when(F.col("event_id") % 5 == 1, F.concat(F.lit("cut {"), F.col("props"))).otherwise(F.concat(F.lit("Result: "), payload, F.lit(" } and [more]")))
    return e.select("event_id", SP.balanced_slice(text).alias("slice"))


@query
def tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Events as nested documents; every ninth text is no JSON."""
    e = table(spark, sf, "events")
    payload = F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", "ids": ['), F.col("event_id").cast("string"), F.lit(", ["), F.col("user_id").cast("string"), F.lit(']], "more": {"props": '), F.col("props"), F.lit(', "none": null}}'))
    return I.tree_leaves(e.select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit("{oops")).otherwise(payload).alias("payload")), "event_id", "payload")


THEMES = {"grid": ["grid", "power", "solar"], "fastening": ["bolt", "gear", "ring"]}
REASONS = ["demand for solar power is in transition", "contract award for bolt and gear supply", "product launch event", "adoption at scale", "regulator approval milestone"]


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as candidates: the name, type and brand identify; size, price and key choose fields, tiers and reasons."""
    p, k, size = table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    field = lambda keep: F.array_compact(F.array(*[F.when((size % (i + 2) > 0) == keep, F.lit(f)) for i, f in enumerate(R.FINANCIAL_FIELDS)]))
    reasons = F.array_compact(F.array(*[F.when((k + i) % 4 == 0, F.lit(r)) for i, r in enumerate(REASONS)]))
    x = p.select(
        "p_partkey", F.concat(F.lit("T"), (size % 6 + 1).cast("string")).alias("source_tier"), (k % 11 == 0).alias("is_mock"), (k % 6).cast("int").alias("warnings"), (k % 4).cast("int").alias("primary_facts"), field(True).alias("available"), field(False).alias("missing"), reasons.alias("reasons"),
        F.substring("p_brand", 7, 2).alias("ticker"), F.col("p_name").alias("name"), pick(["Energy", "Utilities", "it", None], size).alias("sector"), pick(["DE", "F", None], k).alias("country"), pick(["not_ready", "partial", "basic", "deeper", "odd"], size).alias("valuation_readiness"),
    )
    return R.candidate_dimensions(x, THEMES)


@query
def candidate_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """R12 over parts."""
    return _candidates(spark, sf).select("p_partkey", "source_quality", "completeness", "theme", "business", "financial", "valuation", "growth", "catalyst", "risk")


@query
def candidate_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Overall score and status of candidates from their dimensions."""
    x = R.overall(_candidates(spark, sf))
    return x.select("p_partkey", "overall_score", R.candidate_status(F.col("overall_score"), F.col("source_tier"), F.col("is_mock"), F.col("completeness")).alias("status"))


def _analysed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as analysed companies: lines give the counts."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_quantity") > 40).alias("large"))
    x, k = table(spark, sf, "orders").join(lines, "o_orderkey", "left").na.fill(0, ["n", "returned", "large"]), F.col("o_orderkey")
    some = lambda c, words: F.slice(F.array(*map(F.lit, words)), F.lit(1), c.cast("int"))
    x = x.select(
        "o_orderkey", pick(["strong", "adequate", "weak", "insufficient", None], k).alias("overall_quality"), (F.col("o_orderstatus") == "P").alias("is_mock"), pick(["T1", "T3", "T5", "T6"], k).alias("source_tier"), F.col("n").alias("n_available"), F.col("returned").alias("n_missing"),
        some(F.col("returned"), REASONS).alias("bull"), some(F.col("large"), REASONS).alias("tailwinds"), some(F.col("n"), REASONS).alias("headwinds"), some(k % 3, ["await a trigger", "sign the deal"]).alias("next_steps"), F.col("o_orderpriority").alias("sector"),
        pick(["not_ready", "ready", "partial", "deeper"], k).alias("valuation_readiness"), F.col("returned").alias("blocking_gaps"), F.col("large").alias("valuation_blockers"),
        F.when(k % 6 > 1, k % 6 - 2).otherwise(0).cast("int").alias("primary_facts"), F.col("o_orderstatus").alias("ticker"), F.when(k % 2 == 0, "Firm").alias("name"), pick(["failed", "passed", None], k).alias("citations"),
    )
    return R.analysis_dimensions(x, THEMES)


@query
def analysis_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """R13 over orders."""
    return _analysed(spark, sf).select("o_orderkey", "source_quality", "completeness", "business", "financial", "theme", "growth", "catalyst", "valuation", "risk")


@query
def council_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Overall score and status of analysed companies from their dimensions."""
    x, c = R.overall(_analysed(spark, sf)), F.col
    return x.select("o_orderkey", "overall_score", R.council_status(c("overall_score"), c("source_tier"), c("is_mock"), c("citations"), c("overall_quality"), c("blocking_gaps")).alias("status"))




def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    """A nation's year in prose, with revenue in millions to one place (missing words and other scales in some years) and a margin."""
    f = facts(spark, sf)
    whole = lambda c: F.floor(F.col(c) / 1000).cast("string")
    text = (
        F.when(F.col("fy") % 4 == 0, F.concat(F.lit("Revenue was up 12% but costs reached "), whole("gross"), F.lit(" thousand. Margin stood at 4.5%.")))
        .when(F.col("fy") % 4 == 1, F.concat(F.lit("In short: revenue for fiscal "), F.col("fy").cast("string"), F.lit(" rose by 7% to €"), whole("revenue"), F.lit(" thousand; gross sales of "), whole("gross"), F.lit(" thousand were higher")))
        .otherwise(F.concat(F.lit("Revenue of "), whole("revenue"), F.lit(" thousand. Gross sales grew 3% to "), whole("gross"), F.lit(". Margin in "), F.col("fy").cast("string"), F.lit(" was 12%")))
    )
    return f.select("entity", "fy", text.alias("text"))


LABELS, PERCENTS = {"revenue": ["revenue"], "gross": ["gross sales"]}, {"margin": ["margin"]}


@query
def labelled_facts(spark: SparkSession, sf: str) -> DataFrame:
    return D.labelled_facts(_sentences(spark, sf), ["entity", "fy"], "text", LABELS, PERCENTS)


@query
def validated_facts(spark: SparkSession, sf: str) -> DataFrame:
    """V6: facts of tables (exact, from HTML) and of prose (in thousands), and a scan that misreads every fifth year; every sixth nation's issuer is unknown."""
    f = facts(spark, sf)
    made = lambda df, method, confidence, scale: df.select("entity", "label", "fy", "value", scale.alias("scale"), F.lit(method).alias("method"), confidence.cast("double").alias("confidence"), F.lit("validated").alias("base_status"), F.lit(0).alias("tie"))
    one = F.lit(None).cast("string")
    tables = f.select("entity", "fy", F.explode(F.create_map(F.lit("revenue"), "revenue", F.lit("gross"), "gross")).alias("label", "value")).filter("value IS NOT NULL AND fy % 3 > 0")
    prose = D.labelled_facts(_sentences(spark, sf), ["entity", "fy"], "text", LABELS, {})
    scans = f.filter("fy % 2 = 0").select("entity", "fy", F.lit("revenue").alias("label"), (F.floor(F.col("revenue") / 1000) * F.when(F.col("fy") % 5 == 0, 10).otherwise(1)).cast("double").alias("value"))
    exact = made(tables.withColumn("value", F.col("value") / 1e6), "html", F.lit(0.9), F.lit("million"))
    c = exact.unionByName(made(prose, "native_pdf", F.when(F.col("label") == "gross", 0.5).otherwise(0.7), F.col("scale"))).unionByName(made(scans, "ocr", F.lit(0.8), F.lit("thousand")))
    out = I.validated_facts(c, ["entity", "label", "fy"], F.col("entity") % 6 > 0, ["label", "fy"])
    return out.select("entity", "label", "fy", "n", "methods", "validation", F.round("value", 6).alias("value"), "scale", "method", "confidence", "place")


@query
def text_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """A word and a phrase in every document, and the scale of a word."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    word = pick(["Million", "bn", "k", "thousands", "tn", "m", "dozen"], F.col("doc_id"))
    return d.select("doc_id", T.contains_word(F.col("text"), "THE").alias("word"), T.contains_phrase(F.lower("text"), "of the").alias("phrase"), T.scale(word).alias("scale"))


@query
def vendor_fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """A whole document for each customer, with two yearly income statements, one balance sheet, and values that are no numbers."""
    c, k, bal = table(spark, sf, "customer").repartition("c_custkey"), F.col("c_custkey"), F.col("c_acctbal").cast("decimal(12,2)").cast("string")  # few files of narrow rows, each with much work
    year = lambda y: F.struct(F.when(k % 2 == 0, f"{y}-12-31").alias("date"), (k * 1_000_000 + y).cast("string").alias("totalRevenue"), bal.alias("eps"), F.lit("n/a").alias("netIncome"))
    doc = F.struct(
        F.struct(F.col("c_mktsegment").alias("GicSector"), F.lit(" ").alias("CurrencyCode")).alias("General"), F.struct(F.when(k % 3 > 0, k * 1_000_000).alias("MarketCapitalization"), F.when(k % 3 == 1, k * 2).alias("MarketCapitalizationMln"), F.lit("12.5").alias("PERatio"), F.lit("NaN").alias("PEGRatio")).alias("Highlights"),
        F.struct((k * 10_000).alias("SharesFloat")).alias("SharesStats"), F.struct(bal.alias("52WeekHigh")).alias("Technicals"),
        F.struct(F.struct(F.struct(year(2023).alias("2023-12-31"), year(2024).alias("2024-12-31")).alias("yearly")).alias("Income_Statement"), F.struct(F.struct(F.struct((k * 3_000_000).alias("totalAssets")).alias("2022")).alias("yearly")).alias("Balance_Sheet")).alias("Financials"),
    )
    payload = F.when(k % 10 == 9, F.lit("{oops")).otherwise(F.to_json(doc))
    out = V.vendor_fundamentals(c.select("c_custkey", payload.alias("payload")), ["c_custkey"], "payload", every_year=True)
    return out.filter("field_name <> '_meta.raw_payload_hash'")
