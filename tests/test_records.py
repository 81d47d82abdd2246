"""Vendor documents, submissions, scorecard ladders and side-by-side counts at their edges."""

import json

import pytest
from pyspark.sql import functions as F
from tessera.operators import evidence_counts as E
from tessera.operators import scoring as R
from tessera.sources import submissions as SB
from tessera.sources import vendor as V
from tessera.sources.staged import staged


def fields(spark, doc, **options):
    rows = spark.createDataFrame([(1, doc if doc is None or isinstance(doc, str) else json.dumps(doc))], "id long, t string")
    return {r.field_name: (r.text if r.text is not None else r.value, r.unit) for r in V.vendor_fundamentals(rows, ["id"], "t", **options).collect() if not r.field_name.startswith("_meta")}


def test_vendor_documents(spark):
    doc = {
        "General": {"CurrencyCode": " EUR ", "CountryISO": "", "GicSector": None}, "Highlights": {"MarketCapitalization": "2500000000", "PERatio": 12.5, "PEGRatio": "NaN", "ProfitMargin": "n/a", "RevenueTTM": 1234567},
        "Technicals": {"52WeekHigh": "9.5"},
        "Financials": {
            "Income_Statement": {"yearly": {"2023": {"date": "2023-12-31", "totalRevenue": "5000000"}, "2024": {"totalRevenue": 7000000, "eps": "1.5"}}}, "Balance_Sheet": {"yearly": {}}, "Cash_Flow": {"yearly": {"2022": {"capitalExpenditures": "-3000000", "freeCashFlow": None}}},
        },
    }
    latest = {
        "general.currency_code": ("EUR", None), "highlights.market_cap_mln": (2500.0, "USD_m"), "highlights.pe_ratio": (12.5, "x"), "highlights.revenue_ttm_mln": (1.2346, "USD_m"), "technicals.52_week_high": (9.5, None),
        "income_statement.2024.total_revenue_mln": (7.0, "USD_m"), "income_statement.2024.eps": (1.5, "USD"), "cash_flow.2022.capex_mln": (-3.0, "USD_m"),
    }
    assert fields(spark, doc) == latest
    assert fields(spark, doc, every_year=True) == latest | {"income_statement.2023-12-31.total_revenue_mln": (5.0, "USD_m")}
    assert fields(spark, {"Highlights": {"MarketCapitalization": 1e9, "MarketCapitalizationMln": "7"}}) == {"highlights.market_cap_mln": (7.0, "USD_m")}
    for empty in ("{oops", "[]", "{}", "", None, "null"):
        assert fields(spark, empty) == {}


def test_submissions(spark):
    docs = [{"cik": 320193, "name": "Firm", "tickers": ["F", "G"], "exchanges": ["Q"], "fiscalYearEnd": "0930", "entityType": "operating", "sicDescription": " "}, {"name": "Bare", "fiscalYearEnd": "9999"}, {"cik": "7"}, {}, [], None]
    rows = spark.createDataFrame([(i, json.dumps(d) if d is not None else None) for i, d in enumerate(docs)], "id long, t string")
    got = {r.id: (r.cik, r.legal_name, r.ticker, r.exchange, r.fiscal_year_end, r.industry, r.description, r.n_tickers) for r in SB.profiles(rows, ["id"], "t").collect()}
    assert got == {0: ("0000320193", "Firm", "F", "Q", "September", None, "Entity type: operating", 2), 1: (None, "Bare", None, None, "9999", None, None, 0), 2: ("0000000007", "", "0000000007", None, None, None, None, 0)}


def test_counts_stand_side_by_side(spark):
    e = spark.createDataFrame([("a", True, False, "x", True), ("a", False, False, " ", False), ("a", False, False, "text", True), ("a", False, True, "text", True)], "run string, is_fact boolean, is_metadata boolean, excerpt string, is_reference boolean")
    c = spark.createDataFrame([("a", 1, "facts.x"), ("a", 1, None), ("a", 2, "council.bull"), ("b", 3, "")], "run string, source_id long, field_path string")
    k = spark.createDataFrame([("a", "h"), ("a", "h"), ("a", "i")], "run string, content_hash string")
    counts = E.reconciliation(e, c, k, "run")
    assert {tuple(r) for r in counts.collect()} == {("a", 3, 1, 1, 3, 5, 3), ("b", 0, 0, 0, 1, 1, 0)}
    states = E.document_states(spark.createDataFrame([("a", "extracted"), ("a", "extraction_failed"), ("a", "queued"), ("a", None)], "run string, s string"), "run", "s")
    assert [tuple(r) for r in states.collect()] == [("a", 1, 0, 1)]
    x = counts.join(states, "run", "left").withColumns({"fact_fields": F.lit(0), "filing_events": F.lit(None).cast("long"), "press_events": F.lit(2)})
    got = {(r.run, r.channel): (r.available, r.n) for r in E.channels(x, "run").collect()}
    assert got["a", "issuer_documents"] == (True, 1) and got["b", "issuer_documents"] == (False, 0) and got["a", "regulator_filings"] == (False, 0) and got["a", "issuer_newsroom"] == (True, 2) and got["a", "stored_citations"] == (True, 8) and len(got) == 10


@pytest.mark.parametrize(
    "row,want",
    [
        ((90, "T1", False, 90), "high_priority_for_human_review"), ((90, "T1", True, 90), "not_enough_data"), ((50, "T5", False, 90), "needs_primary_sources"), ((49, "T6", False, 90), "not_enough_data"), ((69, "T2", False, 19), "not_enough_data"),
        ((19, "T2", False, 90), "not_enough_data"), ((34, "T2", False, 20), "low_priority_research"), ((54, "T2", False, 20), "needs_primary_sources"), ((69, "T2", False, 20), "ready_for_deeper_analysis"),
    ],
)
def test_candidate_ladder(spark, row, want):
    x = spark.createDataFrame([row], "s int, t string, m boolean, c int")
    assert x.select(R.candidate_status(F.col("s"), F.col("t"), F.col("m"), F.col("c"))).first()[0] == want


@pytest.mark.parametrize(
    "row,want",
    [
        ((90, "T1", False, "passed", "strong", 0), "high_priority_for_human_review"), ((90, "T1", True, None, "strong", 0), "not_enough_data"), ((90, "T1", False, "failed", "strong", 0), "reject_due_to_data_quality"), ((90, "T1", False, None, None, 0), "reject_due_to_data_quality"),
        ((90, "T5", False, None, "strong", 9), "needs_primary_sources"), ((90, "T1", False, None, "strong", 6), "low_priority_research"), ((90, "T1", False, None, "weak", 5), "ready_for_deeper_analysis"), ((54, "T1", False, None, "weak", 5), "needs_primary_sources"),
        ((34, "T1", False, None, "weak", 0), "low_priority_research"), ((19, "T1", False, None, "weak", 0), "not_enough_data"),
    ],
)
def test_council_ladder(spark, row, want):
    x = spark.createDataFrame([row], "s int, t string, m boolean, c string, q string, g int")
    assert x.select(R.council_status(*[F.col(c) for c in "stmcqg"])).first()[0] == want


def test_overall_score_and_caps(spark):
    names = [*R.SCORECARD_WEIGHTS]
    rows = [(100, 0, "T1", False), (100, 100, "T1", False), (100, 0, "T4", False), (100, 0, "T6", True), (100, 0, "T1", True), (0, 100, "T1", False), (100, 0, "odd", False)]
    x = spark.createDataFrame(rows, "s int, risk int, source_tier string, is_mock boolean").withColumns({n: F.col("s") for n in names})
    assert [r.overall_score for r in R.overall(x).collect()] == [100, 80, 75, 25, 100, 0, 25]


def test_staged_tables_are_not_made_again(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x

    df = staged(spark.range(10).select(counted("id").alias("id")), "once")
    assert df.count() == 10 and df.agg(F.sum("id")).first()[0] == 45 and calls.value == 10
