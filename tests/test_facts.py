"""Figures in prose, markup and tables: single sentences and pages by hand, and the verdicts on them."""

import random

import pytest
from pyspark.sql import functions as F
from tessera.functions import reporting as R
from tessera.functions import text as T
from tessera.operators import facts as FA
from tessera.operators import markup as M
from tessera.operators import prose as P

SCAN = P.Scanner()


@pytest.mark.parametrize(
    "text,want",
    [
        ("Revenue for the first half of 2026 came to €8.7 billion", [("revenue", 8.7, "billion", "EUR", "2026", None)]),
        ("Revenue in 2024 was €5bn", [("revenue", 5.0, "billion", "EUR", "2024", None)]),
        ("Sales increased by 5% at actual exchange rates to €22,420 million", [("revenue", 22420.0, "million", "EUR", None, None)]),
        ("Operating profit for the year grew by 1% to €4,492 million", [("operating_profit", 4492.0, "million", "EUR", None, None)]),
        ("net cash rose by 3% to €8,496 million", [("net_cash", 8496.0, "million", "EUR", None, None)]),
        ("net cash flow was €3 million", []),
        ("Revenue of operating profit was €5 million", [("operating_profit", 5.0, "million", "EUR", None, None)]),
        ("operating profit was up by 23% in Europe.", []),
        ("Recurring operating profit: €7.5 million", [("recurring_operating_profit", 7.5, "million", "EUR", None, None)]),
        ("EBITDA was €9 million, EBIT was €7 million", [("operating_profit", 7.0, "million", "EUR", None, None)]),
        ("Recurring operating margin rose 120 basis points to 20.0%", [("recurring_operating_margin", 20.0, None, None, None, None)]),
        ("Operating margin improved and revenue was €3 million", [("revenue", 3.0, "million", "EUR", None, None)]),
        ("cost of sales €64 million", []),
        ("Revenue was weak; costs of €4 million", []),
        ("Revenue was weak.\nAssets of €4 million", []),
        ("Revenue fell while costs of €4 million rose", []),
        ("Revenue in 2024 was strong.", []),
        ("Revenue 31. Then sales of €5 million.", [("revenue", 5.0, "million", "EUR", None, None)]),
        ("Revenue of €5 million. Revenue of €6 million.", []),
        ("Revenue of €5 million. Revenue of €5 million.", [("revenue", 5.0, "million", "EUR", None, None)]),
        ("Revenue was 31", []),
        ("The Group's Specialist Watchmakers reported sales of €3.1 billion", [("revenue", 3.1, "billion", "EUR", None, "Specialist Watchmakers")]),
        ("The Group reported sales of €3.1 billion", [("revenue", 3.1, "billion", "EUR", None, "group")]),
        ("Led by strong momentum, the Jewellery Maisons were again able to grow their operating profit to €4,492 million", [("operating_profit", 4492.0, "million", "EUR", None, "Jewellery Maisons")]),
        ("Compared with its peer group, revenue of €1 million", [("revenue", 1.0, "million", "EUR", None, None)]),
        ("In 2019 it was otherwise. " + "x " * 100 + "Revenue in 2024 was €5bn", [("revenue", 5.0, "billion", "EUR", "2024", None)]),
        ("Net cash generated from operating activities reached $12 million", [("operating_cash_flow", 12.0, "million", "USD", None, None)]),
        ("", []),
    ],
)
def test_sentences(spark, text, want):
    found = P.settled(P.mentions(spark.createDataFrame([(1, text)], "id long, t string"), ["id"], "t"), ["id"]).filter("unit IN ('currency_amount', 'percent')")
    assert sorted((r.label, r.value, r.scale, r.currency, r.period, r.scope) for r in found.collect()) == sorted(want)


def test_mentions_give_their_place():
    text = "First, revenue was €5 million. Then net debt of CHF 2.5bn in 2021."
    found = SCAN.mentions(text)
    assert [text[m.start : m.end] for m in found] == ["revenue was €5 million", "net debt of CHF 2.5bn"] == [m.raw for m in found]


def test_staff_year_and_currency_of_a_report():
    found = {m.label: m.raw for m in SCAN.mentions("All figures in millions of euros. In fiscal year 2025 the firm had 1,250 employees.")}
    assert found == {"reporting_currency": "EUR", "fiscal_year": "2025", "employees": "1,250"}
    assert SCAN.mentions("In Europe we pay in dollars; 5 staff") == []


def test_numbers_and_currencies_as_the_column_functions_have_them(spark):
    rng = random.Random(1)
    raws = ["".join(rng.choice("0123456789.,") for _ in range(rng.randint(1, 8))) for _ in range(800)]
    texts = ["".join(rng.choice(["eur", "euro", "usd", " ", "€", "$", "x", "swiss francs", "pound", "dkk", "1"]) for _ in range(rng.randint(0, 5))) for _ in range(800)]
    rows = spark.createDataFrame(list(zip(raws, texts)), "raw string, t string").select("raw", "t", T.number(F.col("raw")).alias("n"), R.currency(F.col("t")).alias("c")).collect()
    assert all(r.n == P.number(r.raw) for r in rows)
    assert all(r.c == R.currency_of(r.t) for r in rows)


def test_long_text_without_end(spark):
    text = "revenue " * 50_000
    assert P.mentions(spark.createDataFrame([(1, text), (2, None), (None, "sales of €1 million")], "id long, t string"), ["id"], "t").count() == 1


def test_nested_tables_keep_the_outer_cells():
    page = "<h1>A</h1><table><tr><td>1<table><tr><td>in</td><td>ner</td></tr></table> after</td><td>2</td></tr></table><nav><h2>no</h2></nav><h2>B</h2><table><tr><td>x"
    got = M.read(page)
    assert [(t["table_no"], t["parent"], t["path"], t["rows"]) for t in got["tables"]] == [(0, None, ["A"], [["1 after", "2"]]), (1, 0, ["A"], [["in", "ner"]]), (2, None, ["A", "B"], [["x"]])]
    assert [h["title"] for h in got["headings"]] == ["A", "B"]


@pytest.mark.parametrize("inner", [1, 5, 40])
def test_tables_nested_deep(inner):
    page = "<table><tr><td>a" * inner + "</td><td>b</td></tr></table>" * inner
    got = M.read(page)["tables"]
    assert len(got) == inner and all(t["rows"] == [["a", "b"]] for t in got) and [t["parent"] for t in got] == [None, *range(inner - 1)]


def test_spans_and_missing_ends():
    spans = M.read("<table><tr><td rowspan=2>r<td colspan=2>w<tr><td>a<td>b &amp; c</table>")["tables"][0]["rows"]
    assert spans == [["r", "w", "w"], ["r", "a", "b & c"]]
    assert M.read("<table><tr><td rowspan='x' colspan=0>1</td></tr></table>")["tables"][0]["rows"] == [["1"]]


def test_boilerplate_and_odd_markup():
    keep = "a sentence that is long enough to be a block of text"
    page = f"<title>T &lt;1&gt;</title><div class='Cookie-Bar'><p>{keep} not this</p></div><p>{keep}<!-- no <p> --><script>var x = '<h1>no</h1>';</script></div></span><p>{keep} too<h2></h2><form><h2>no</h2></form><aside><p>{keep}</p></aside>"
    got = M.read(page)
    assert got["title"] == "T <1>" and [b["text"] for b in got["blocks"]] == [keep, keep + " too"] and not got["headings"]
    for odd in ("", "<", "<p", "<!--", "</table></td>", "<td>x", "<table></p></table>", "<h2>open", "<script>", "<a '" * 50):
        M.read(odd)


def test_structure_of_awkward_pages(spark):
    rows = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "<h1>x</h1>", 3), (3, "<h2>é</h2>" * 500, 3)], "page_id long, html string, title int")
    got = {r.page_id: (len(r.headings), len(r.tables), len(r.blocks)) for r in M.structure(rows, "page_id", "html").collect()}
    assert got == {1: (0, 0, 0), 2: (0, 0, 0), None: (1, 0, 0), 3: (500, 0, 0)}
    assert M.structure(rows.limit(0), "page_id", "html").count() == 0


def tables(spark, rows, path=("Consolidated",), currency=None, scale=None, period=None):
    return spark.createDataFrame([(1, 0, rows, list(path), currency, scale, period)], "d long, table_no int, rows array<array<string>>, path array<string>, currency string, scale string, period string")


def test_table_rules(spark):
    run = lambda *a, **k: sorted((r.label, r.value, r.period, r.scope, r.status) for r in FA.table_candidates(tables(spark, *a, **k), "d").collect())
    head = ["EUR million", "2024", "2023"]
    assert run([head, ["Revenue", "1,000", "-"]]) == [("revenue", 1000.0, "2024", "group", "validated")]
    assert run([["", "2024"], ["Revenue", "5"]]) == [("revenue", 5.0, "2024", "group", "excerpt_only")]
    assert run([["", "2024"], ["Revenue", "5"]], currency="EUR", scale="million") == [("revenue", 5.0, "2024", "group", "validated")]
    assert run([["€ million"], ["Net income", "5", "6"]], period="2024") == [("net_income", 5.0, "2024", "group", "excerpt_only")]
    assert run([["€ million"], ["Net income", "5", "5.0"]], period="2024") == [("net_income", 5.0, "2024", "group", "validated")]
    assert run([["€ million"], ["Net income", "5"]]) == [("net_income", 5.0, None, "group", "excerpt_only")]
    assert run([head, ["Operating margin", "12", "9%"]]) == [("operating_margin", 9.0, "2023", "group", "validated")]
    assert run([head, ["Operating profit for the year", "1", "2"], ["Sales", "1", "2"], ["", "1", "2"]]) == []
    assert run([head, ["Operating free cash flow", "7", ""]], path=["Segment information", "Watches"]) == [("operating_free_cash_flow", 7.0, "2024", "Watches", "validated")]


def test_subtotals_by_the_expected_sum(spark):
    """Tolerance is 1 % of the sum of the parts, not of the reported total."""
    run = lambda *rows: {r.label: r.status for r in FA.reconciled(FA.table_candidates(tables(spark, [["EUR million", "2024"], *rows]), "d"), "d").collect()}
    parts = lambda total: run(["Short-term debt", "50"], ["Long-term debt", "51.005"], ["Total debt", total])["total_debt"]
    assert (parts("100"), parts("99.9")) == ("validated", "excerpt_only")
    assert run(["Short-term debt", "50"], ["Total debt", "9"])["total_debt"] == "validated"
    off = run(["Total assets", "100"], ["Total liabilities", "60"], ["Total equity", "30"])
    assert set(off.values()) == {"excerpt_only"}
    assert set(run(["Total assets", "100"], ["Total liabilities", "60"], ["Total equity", "39.5"]).values()) == {"validated"}


def verdict(spark, rows, known=True):
    c = spark.createDataFrame([(1, "revenue", v, "currency_amount", "EUR", s, "2024", None, q, st, m, c, [i]) for i, (v, s, q, st, m, c) in enumerate(rows)], "d long, label string, value double, unit string, currency string, scale string, period string, scope string, qualified boolean, status string, method string, sure double, place array<int>")
    (r,) = FA.judged(c, "d", F.lit(known)).collect()
    return r.validation, r.value, r.scale, r.method, r.confidence


def test_verdicts(spark):
    ok = "validated"
    assert verdict(spark, [(22.4, "billion", True, ok, "html", 0.9), (22420.0, "million", True, ok, "html", 0.7)]) == (ok, 22420.0, "million", "html", 0.8)
    assert verdict(spark, [(20616.0, "million", True, ok, "html", 0.7), (20616.0, None, False, "excerpt_only", "native_pdf", 0.9)]) == (ok, 20616.0, "million", "html", 0.9)
    assert verdict(spark, [(100.0, "million", True, ok, "html", 0.7), (150.0, "million", True, ok, "ocr", 0.8)]) == ("rejected", None, "million", "html", 0.7)
    assert verdict(spark, [(100.0, "million", True, ok, "html", 0.7), (150.0, "million", True, ok, "html", 0.8)]) == ("excerpt_only", 100.0, "million", "html", 0.7)
    assert verdict(spark, [(100.0, "million", True, ok, "ocr", 0.9)]) == (ok, 100.0, "million", "ocr", 0.72)
    assert verdict(spark, [(100.0, "million", True, ok, "ocr", 0.6)]) == ("excerpt_only", 100.0, "million", "ocr", 0.51)
    assert verdict(spark, [(100.0, "million", True, ok, "html", 0.7)], known=False) == ("excerpt_only", 100.0, "million", "html", 0.8)
    assert verdict(spark, [(100.0, "million", False, ok, "html", 0.5)]) == ("excerpt_only", 100.0, "million", "html", 0.5)


def test_periods_of_a_document(spark):
    """A fact without a year takes the commonest one, unless a dated fact of the same label and scope says otherwise."""
    row = lambda n, label, value, period, scope: (1, n, label, value, "currency_amount", "EUR", "million", period, scope, 0)
    rows = [row(0, "revenue", 100.0, "2024", "group"), row(1, "cash", 7.0, "2024", None), row(2, "cash", 9.0, "2023", "Watches"), row(3, "revenue", 100.4, None, "group"), row(4, "revenue", 150.0, None, "group"), row(5, "net_debt", 5.0, None, "group"), row(6, "net_debt", 5.0, None, None)]
    c = spark.createDataFrame(rows, "d long, block_no int, label string, value double, unit string, currency string, scale string, period string, scope string, start int")
    got = {r.block_no: (r.period, r.inferred, r.status) for r in FA.prose_candidates(c, "d", ["block_no", "start"]).collect()}
    assert got == {0: ("2024", False, "validated"), 1: ("2024", False, "validated"), 2: ("2023", False, "validated"), 3: ("2024", True, "validated"), 4: (None, False, "excerpt_only"), 5: ("2024", True, "validated"), 6: (None, False, "excerpt_only")}
