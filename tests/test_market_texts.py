"""Phrases against a plain search, and cells of the tables of catalysts and news."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tessera.functions import market as V
from tessera.operators import documents as D
from tessera.operators import keywords as K
from tessera.operators import market_texts as MT


def plain(text, phrases):
    low, out = (text or "").lower(), {}
    for phrase, mode in phrases:
        places = [i for i in range(len(low)) if low.startswith(phrase, i)]
        bound = {"anywhere": lambda c: True, "word": lambda c: not (c.isalnum() or c == "_"), "spaced": lambda c: c in " \t\n\r\x0b\x0c"}[mode]
        kept = [i for i in places if bound(low[i - 1] if i else " ") and bound(low[i + len(phrase)] if i + len(phrase) < len(low) else " ")]
        if kept:
            out[mode, phrase] = (len(kept), kept[0])
    return out


@pytest.mark.parametrize("most", [3, 100_000])
def test_matches_against_a_plain_search(spark, most):
    rng = random.Random(4)
    phrases = sorted({("".join(rng.choice("abé .") for _ in range(rng.randint(1, 4))), rng.choice(K.MODES)) for _ in range(60)})[: 12 if most == 3 else 60]
    texts = ["".join(rng.choice("ABabéÉ .\n\t") for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "a" * 5000]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, t string, phrase int")
    got = {}
    for r in K.matches(rows, ["id"], "t", phrases, most).collect():
        got.setdefault(r.id, {})[r.mode, r.phrase] = (r.n, r.first)
    assert got == {i: w for i, t in enumerate(texts) if (w := plain(t, phrases))}


def test_many_phrases_and_bad_ones(spark):
    phrases = [(f"w{i}", "word") for i in range(20_000)]
    rows = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(0, 20_000, 7)))], "id long, t string")
    assert K.matches(rows, ["id"], "t", phrases).count() == len(range(0, 20_000, 7))
    for bad in ([], [("", "word")], [("A", "word")], [("a", "else")]):
        with pytest.raises((ValueError, AssertionError)):
            K.matches(rows, ["id"], "t", bad)


def test_theses(spark):
    rows = [(1, "European watch producers, small cap, excluding  Handbags"), (2, "US data center gpu demand\n in Japan"), (3, "best stocks"), (4, None), (5, "exceptional buses"), (6, "avoid banks except fintech")]
    got = {r.id: r for r in MT.parsed_theses(spark.createDataFrame(rows, "id long, t string"), ["id"], "t").collect()}
    assert (got[1].themes, got[1].keywords, got[1].region, got[1].excluded) == ("luxury_goods", "handbags,watch", "Europe", "handbags")
    assert (got[2].theme, got[2].country, got[2].region, got[2].regions, got[2].intents) == ("ai_infrastructure", "Japan", "Japan", "North America,Japan", "catalyst")
    assert got[3].vague and got[6].excluded == "banks,fintech" and 4 not in got and 5 not in got


def catalysts(spark, *rows):
    schema = "id long, headline string, summary string, tier int, form string, items array<string>, is_filing boolean, multi_source boolean, has_source boolean"
    base = {"headline": "", "summary": None, "tier": 1, "form": None, "items": None, "is_filing": False, "multi_source": False, "has_source": False}
    x = spark.createDataFrame([tuple({"id": i, **base, **r}.values()) for i, r in enumerate(rows)], schema)
    return {r.id: (r.category, r.direction, r.strength, r.evidence, r.materiality, r.confidence, r.basis) for r in MT.classified_catalysts(x, "id").collect()}


def test_catalyst_tables(spark):
    got = catalysts(
        spark,
        {"items": ["9.01", " 4.01 "]},
        {"items": ["2.02", "9.01"], "headline": "Firm misses estimates"},
        {"items": ["9.99"], "form": "10-k"},
        {"headline": "Firm acquires rival", "tier": 5, "summary": "a summary of over twenty characters"},
        {"headline": "Firm acquires rival", "tier": 5},
        {"headline": "Firm named to list of best; dividend"},
        {"headline": "Firm sets conference call", "is_filing": True},
        {"headline": "quiet", "tier": 6},
        {"headline": "Launches product despite recall", "tier": 3},
        {"headline": "fraud", "multi_source": True, "tier": 6},
        {"form": "DEF 14A", "tier": 2},
        {"items": ["5.02"]},
    )
    assert got == {
        0: ("risk_event", "negative", "high", "primary_confirmed", "decision_relevant", 0.8, "items"),
        1: ("earnings", "negative", "medium", "primary_confirmed", "decision_relevant", 0.7, "items"),
        2: ("filing_event", "neutral", "medium", "primary_confirmed", "contextual", 0.7, "form"),
        3: ("mna", "neutral", "low", "aggregator_only", "decision_relevant", 0.35, "words"),
        4: ("mna", "neutral", "unknown", "aggregator_only", "decision_relevant", 0.25, "words"),
        5: ("capital_return", "neutral", "low", "primary_confirmed", "low_signal", 0.7, "words"),
        6: ("other", "unknown", "medium", "primary_confirmed", "contextual", 0.6, "words"),
        7: ("other", "unknown", "unknown", "model_inferred", "contextual", 0.0, "words"),
        8: ("product", "mixed", "medium", "single_source_reported", "contextual", 0.5, "words"),
        9: ("risk_event", "negative", "high", "multi_source_confirmed", "decision_relevant", 0.9, "words"),
        10: ("management", "neutral", "high", "regulator_confirmed", "contextual", 0.8, "form"),
        11: ("management", "unknown", "medium", "primary_confirmed", "contextual", 0.6, "items"),
    }


NEWS = "item long, text string, url string, tier int, published string"


def test_news_about_companies(spark):
    news = [
        (1, "Shell shares rise", "https://a.example/", 1, "2025-06-01"), (2, "a shell on the beach and a fruit pie", "https://a.example/", 5, None), (3, "a shell on the beach", "https://a.example/", 5, "2020-01-01"), (4, "SHEL at noon", "https://m.social.example/", 3, "2025-06-30"),
        (5, "Blue Ocean Energy to launch", "https://x.predictions.example/", 1, "2025-06-01"), (6, "blue sky", "https://a.example/", 2, "bad"), (7, "nothing", None, 6, None), (8, None, None, 6, None), (9, "the energy of shell", "https://a.example/", 6, None),
    ]
    companies = [("S", "Shell plc", "SHEL", "energy"), ("B", "Blue Ocean Energy Holdings, Inc.", "B", "energy"), ("N", None, None, None)]
    n, c = spark.createDataFrame(news, NEWS), spark.createDataFrame(companies, "company string, name string, ticker string, sector string")
    scored = MT.matched_news(n, c, "item", "company", "2025-06-30", 90, ["social.example"], ["predictions"])
    got = {(r.item, r.company): (r.score, r.level, r.specific, r.named_by) for r in scored.collect()}
    assert got == {
        (1, "S"): (0.5, "medium", True, "name"), (2, "S"): (0.0, "irrelevant", False, "name"), (3, "S"): (0.15, "irrelevant", False, "name"), (4, "S"): (0.5, "medium", True, "ticker"),
        (5, "B"): (0.05, "irrelevant", False, "name"), (6, "B"): (0.55, "medium", True, "name"), (9, "S"): (0.25, "low", False, "name"), (9, "B"): (0.4, "medium", True, "name"),
    }
    industry = MT.industry_news(n, spark.createDataFrame([("energy", "Energy & power")], "sector string, phrase string"), "item", "sector")
    assert {r["item"] for r in industry.collect()} == {5, 9}
    floor = {(r.item, r.company): (r.score, r.is_industry_context) for r in MT.with_industry_floor(scored, industry, c, "item", "company", "sector").collect()}
    assert floor[9, "S"] == (0.45, True) and floor[9, "B"] == (0.4, False) and floor[5, "B"] == (0.05, False) and len(floor) == len(got)


def test_relevance_of_blocks(spark):
    toc = "\n".join(f"Chapter {i} on things {i}" for i in range(6))
    texts = ["Revenue was strong; costs of €5 million", "Revenue of €5 million by segment", "Net income 5%. Total assets of 7 bn", toc, "In 2024 the balance sheet", "x" * 80 + " 5\n" + "y\nz\nw", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(D.relevance(F.col("t")).alias("r")).collect()
    assert [r.r for r in rows] == [1, 10, 13, 0, 3, 0, 0]
    assert re.search(D.CLAUSE_END, "a. b") and not re.search(D.CLAUSE_END, "8.7")
    assert len(V.THEMES) == 10 and len(V.ITEMS) == 14


def test_search_plans(spark):
    rows = [(1, "abc", "Firm", "Tech", "Chips"), (2, "x", None, None, ""), (3, None, "", "Tech", None)]
    df = spark.createDataFrame(rows, "id long, ticker string, name string, sector string, industry string")
    plan = lambda most: {(r.id, r.kind): r.queries for r in MT.search_plans(df, ["id"], ["{ticker} price target", "{company} listing", "{COMPANY} Listing", "{company} LISTING"], ["{ticker} filing"], ["price target"], most).groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "query"))).query.alias("queries")).collect()}
    ten = plan(10)
    assert ten[1, "company"] == ['"Firm" ABC latest news', '"Firm" earnings guidance product regulatory management'] and ten[1, "industry"] == ['"Tech" sector recent news', '"Chips" industry recent news', '"Chips" supply chain regulation trends']
    assert ten[1, "exchange"] == ["Firm listing", "{COMPANY} Listing"] and (1, "regulatory") not in ten
    assert ten[2, "company"][0] == '"X" X latest news' and ten[2, "industry"] == ["X industry peers recent news"] and ten[2, "regulatory"] == ["X filing"]
    assert ten[3, "industry"] == ['"Tech" sector recent news']
    assert plan(1)[1, "company"] == ['"Firm" ABC latest news'] and len(plan(1)) == 3
    assert {k[1]: len(v) for k, v in plan(4).items() if k[0] == 1} == {"company": 1, "primary_source": 3}
