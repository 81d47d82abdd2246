"""What a query carries with its rows, and how it spreads its work, so that it grows with its input."""

import re

from tessera.operators import keywords as K
from tessera.operators import market_texts as MT
from tessera.plans.registry import QUERIES
from tessera.sources import vendor as V


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_travel_without_their_text(spark, sf):
    """the words of claims that look for labels keep the claim and its run alone."""
    lines = [line for line in plan_of(QUERIES["claim_grounding"](spark, sf)).splitlines() if re.search(r"Generate explode.*\[word#\d+\]", line)]
    kept = [re.findall(r"([a-z_]+)#", line.split("), [")[-1].split("], ")[0]) for line in lines]
    assert kept and all(set(k) <= {"claim", "run"} for k in kept)


def test_few_narrow_files_are_spread_before_much_work(spark, sf):
    """one small file of customers makes more than one task of documents, whose rows are the names that they state."""
    plan = plan_of(QUERIES["vendor_fundamentals"](spark, sf))
    assert plan.index("Generate inline") < plan.index("Exchange hashpartitioning(c_custkey") and "BroadcastHashJoin" in plan[: plan.index("Generate inline")]


def test_names_that_stand_twice_or_beside_the_table(spark):
    doc = '{"Highlights": {"PERatio": "1", "PERatio": "2", "Unknown": 3, "MarketCapitalization": 2500000}, "Financials": {"Cash_Flow": {"yearly": {"2023": {"capitalExpenditures": 1}, "2024": {"date": " ", "capitalExpenditures": "4000000"}}}}}'
    rows = V.vendor_fundamentals(spark.createDataFrame([("k", doc), ("n", None), ("e", "")], "key string, raw string"), ["key"], "raw").collect()
    got = {(r.key, r.field_name): (r.value, r.unit) for r in rows if r.field_name != "_meta.raw_payload_hash"}
    assert got == {("k", "highlights.pe_ratio"): (1.0, "x"), ("k", "highlights.market_cap_mln"): (2.5, "USD_m"), ("k", "cash_flow.2024.capex_mln"): (4.0, "USD_m")}
    assert sorted(r.key for r in rows if r.field_name == "_meta.raw_payload_hash") == ["e", "k"]


def test_parts_are_spread_and_each_query_folded_once(spark, sf):
    """the plan fills a template once, instead of anew for every query that it is compared with."""
    plan = plan_of(QUERIES["search_plans"](spark, sf))
    assert plan.index("Generate inline") < plan.index("Exchange hashpartitioning(p_partkey")
    assert plan.count(" exchange announcement") <= 1 and plan.count("array_position") == 0


def test_plans_of_small_budgets(spark):
    df = spark.createDataFrame([(1, "t", "N", None, None)], "id long, ticker string, name string, sector string, industry string")
    for most, want in ((0, ["company"]), (1, ["company"]), (4, ["company", "primary_source", "primary_source", "primary_source"])):
        assert [r.kind for r in MT.search_plans(df, ["id"], [], ["{ticker} A", "{TICKER} a", "{ticker} a"], ["zz"], most).collect()] == want
    rows = MT.search_plans(df, ["id"], [], ["{ticker} A", "{TICKER} a", "{ticker} a"], ["zz"], 10).filter("kind = 'regulatory'").collect()
    assert [(r.n, r.query) for r in rows] == [(0, "T A"), (1, "{TICKER} a")]


def test_distinct_counts_stand_apart(spark, sf):
    """no line is repeated for each distinct count."""
    plan = plan_of(QUERIES["provenance_counts"](spark, sf))
    assert "Expand" not in plan and "HashAggregate" in plan


def test_finds_are_handed_on_in_slices(spark, monkeypatch):
    """slices of a batch lose and repeat nothing."""
    rows = spark.createDataFrame([(i, "b aa " * (i % 3)) for i in range(7)], "id long, t string").coalesce(1)
    found = lambda: sorted(tuple(r) for r in K.matches(rows, ["id"], "t", [("aa", "word"), ("b", "anywhere")]).collect())
    whole = found()
    monkeypatch.setattr(K, "ROWS", 2)
    assert found() == whole and len(whole) == 8
