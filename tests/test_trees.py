"""Trees in JSON, feeds by item, full years, media domains, subtotals: edges by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F
from tessera.functions import domain as DM
from tessera.functions import text as T
from tessera.operators import documents as D
from tessera.operators import intake as I
from tessera.operators import reconcile as RC
from tessera.operators import trees as TR
from tessera.sources import parsers as SP


def walk(v, path="$"):
    if isinstance(v, dict):
        return [x for k, u in v.items() for x in walk(u, f"{path}.{k}")]
    if isinstance(v, list):
        return [x for i, u in enumerate(v) for x in walk(u, f"{path}[{i}]")]
    return [(path, v if isinstance(v, str) or v is None else json.dumps(v))]


def grown(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, -2.5, True, None, "", "a\"\\/\n é ", {}, []])
    return {rng.choice("abcé .["): grown(rng, depth - 1) for _ in range(rng.randint(0, 4))} if rng.random() < 0.5 else [grown(rng, depth - 1) for _ in range(rng.randint(0, 4))]


def test_leaves_against_a_recursive_walk():
    rng = random.Random(2)
    for _ in range(500):
        v = grown(rng, 6)
        for text in (json.dumps(v), json.dumps(v, ensure_ascii=False, indent=2)):
            assert [(p, x) for p, _, x in TR.leaves(text)] == walk(v)


@pytest.mark.parametrize("text", ["", "{", "}", "[1,]", '{"a":}', '{"a" 1}', "[1 2]", '{"a":1,}', "1 2", "nul", "[01]", '"a', "'a'", "{1:2}", "[1}", "tru", "[1]]", '"\\x"', "1.", "-", "Infinity", "[,1]"])
def test_no_json(text):
    assert TR.leaves(text) is None
    with pytest.raises(ValueError):
        json.loads(text.replace("Infinity", "Infinit"))


def test_depth_has_no_bound(spark):
    deep = "[" * 5000 + '{"x": 7}' + "]" * 5000
    ((path, kind, value),) = TR.leaves(deep)
    assert path.count("[0]") == 5000 and path.endswith(".x") and (kind, value) == ("number", "7")
    keyed = '{"a":' * 50 + '"BUY"' + "}" * 50
    rows = spark.createDataFrame([(1, keyed), (2, None), (3, "{oops"), (None, "[1, null]")], "id long, t string")
    got = I.tree_leaves(rows, "id", "t").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "$" + ".a" * 50, "BUY"), (None, "$[0]", "1"), (None, "$[1]", None)], key=str)


def test_exempt_names_hide_what_they_hold(spark):
    text = '{"note": "We rated it a buy.", "disallowed_outputs": ["BUY", {"x": ["SELL"]}], "rows": [{"disallowed_outputs": "HOLD", "text": "SELL"}, "fine"]}'
    rows = spark.createDataFrame([(1, text)], "id long, t string")
    tree = TR.tree_leaves(rows, ["id"], "t", ["disallowed_outputs"])
    hits = D.safety_hits(tree.filter("kind = 'string'"), ["id", "path"], "value").collect()
    assert sorted((r.path, r.tier, r.matched_text) for r in hits) == [("$.note", "rating_in_context", "rated it a buy"), ("$.rows[0].text", "rating", "SELL")]


def test_numbers_without_a_citation(spark):
    text = '{"a": {"value": 5, "citations": ["e1"]}, "b": {"value": 5, "share": 2.5, "citations": []}, "c": [{"n": 1}, {"n": 1, "source_id": "s"}, {"n": 1, "source_id": ""}], "d": {"text": "no number"}, "e": [1, 2]}'
    tree = TR.tree_leaves(spark.createDataFrame([(1, text)], "id long, t string"), ["id"], "t")
    assert sorted((r.path, r.numbers, r.names) for r in TR.bare_numbers(tree, ["id"]).collect()) == [("$", 2, "e"), ("$.b", 2, "share,value"), ("$.c[0]", 1, "n"), ("$.c[2]", 1, "n")]


def items(spark, *feeds):
    rows = spark.createDataFrame(list(enumerate(feeds)), "id int, x string")
    return {r.id: [] for r in rows.collect()} | {k: [tuple(r)[1:] for r in v] for k, v in _grouped(SP.feed_items(rows, "id", "x").select("id", "n", "title", "link", "guid", "canonical").collect()).items()}


def _grouped(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r.id, []).append(r)
    return out


def test_feed_items_stand_alone(spark):
    rss = lambda body: f"<rss><channel><title>C</title>{body}</channel></rss>"
    got = items(
        spark,
        rss("<item><title>A</title></item><item><title>B</title><link>https://x/b</link><guid>g</guid></item>"),
        rss("<item><title> </title><link>https://x/e</link></item><item><link>https://x/n</link></item><item><title>C</title><link>https://x/c.mp3</link><guid>https://x/c</guid></item>"),
        "<rss><channel><item><title>cut",
        None,
        "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title type='html'>E &amp; F</title><link rel='enclosure' href='https://x/e.mp4'/><link href='https://x/e'/><id>i</id></entry></feed>",
        "<!DOCTYPE x [<!ENTITY a 'b'>]><rss><channel><item><title>&a;</title></item></channel></rss>",
        rss(""),
        "<rdf:RDF xmlns:rdf='r'><item><title>one</title><link>http://x/1</link></item></rdf:RDF>",
    )
    assert got[0] == [(0, "A", None, None, None), (1, "B", "https://x/b", "g", "https://x/b")]
    assert got[1] == [(2, "C", "https://x/c.mp3", "https://x/c", "https://x/c")]
    assert got[4] == [(0, "E & F", "https://x/e", "i", "https://x/e")]
    assert got[7] == [(0, "one", "http://x/1", None, "http://x/1")]
    assert got[2] == got[3] == got[5] == got[6] == []


def test_full_years_come_first(spark):
    """A fourth quarter in an annual form is passed over for the value and for the prior one; without any full year the freshest stands."""
    rows = [
        (1, "R", 0, 2024, "2025-02-01", True, 25.0, "2024-10-01", "2024-12-31"), (1, "R", 0, 2024, "2025-01-01", True, 100.0, "2024-01-01", "2024-12-31"), (1, "R", 0, 2023, "2024-02-01", True, 20.0, "2023-10-01", "2023-12-31"),
        (1, "R", 0, 2023, "2024-01-01", True, 90.0, "2023-01-01", "2023-12-31"), (1, "S", 1, 2024, "2025-01-01", True, 101.0, "2024-01-01", "2025-01-31"), (2, "R", 0, 2024, "2025-01-01", True, 7.0, "2024-10-01", "2024-12-31"),
        (3, "R", 0, 2024, "2025-01-01", False, 3.0, "2024-10-01", "2024-12-31"), (4, "R", 0, 2024, "2025-01-01", True, 4e6, None, "2024-12-31"), (4, "R", 0, 2025, "2025-01-01", False, 9.0, None, None),
    ]
    e = spark.createDataFrame(rows, "k long, alias string, alias_order int, fy int, filed string, annual boolean, value double, start string, end string")
    got = {r.k: (r.alias, r.fy, r.period_type, r.value, r.prior) for r in I.freshest_alias(e, ["k"]).collect()}
    assert got == {1: ("S", 2024, "annual", 101.0, None), 2: ("R", 2024, "annual", 7.0, None), 3: ("R", 2024, "quarterly", 3.0, None), 4: ("R", 2024, "annual", 4e6, None)}
    only = {r.k: (r.value, r.prior) for r in I.freshest_alias(e.filter("alias = 'R'"), ["k"]).collect()}
    assert only[1] == (100.0, 90.0)
    assert {r.k: r.value for r in I.freshest_alias(e, ["k"], 1e6).collect()}[4] == 4.0


def test_domains_below_a_known_one(spark):
    hosts = ["reuters.com", "www.reuters.com", "uk.news.reuters.com", "notreuters.com", "reuters.com.evil.org", "", None, "COM"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", T.by_domain(F.col("h"), {"reuters.com": 3, "news.reuters.com": 4}).alias("t")).collect()
    assert [r.t for r in rows] == [3, 3, 4, None, None, None, None, None]


def test_subtotal_tolerance_and_credit_ceiling(spark):
    rows = spark.createDataFrame([(1, 100.0, 50.0, 51.005), (2, 100.0, 50.0, 51.5), (3, 100.0, None, 1.0)], "k long, total double, a double, b double")
    assert [r.check for r in RC.subtotals(rows, ["k"], "total", ["a", "b"]).orderBy("k").collect()] == ["consistent", "demoted", "not_checked"]
    x = spark.createDataFrame([(90, 3), (90, 0), (97, 0), (40, 9)], "b int, n int").select(DM.primary_credit(F.col("b"), F.col("n")).alias("c")).collect()
    assert [r.c for r in x] == [95, 90, 97, 85]


def test_neutral_texts_have_no_hit(spark):
    texts = ["recommend buy, buy, buy and hold", "We recommend: buy. hold", "rating " + "buy " * 60, "BUY SELL HOLD", "a rated price target: hold the guaranteed returns", "uphold the seller", "recommend " + "x" * 36 + " buy hold sell"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.neutralize(F.col("t")).alias("n")).withColumn("hits", D.forbidden(F.col("n"))).collect()
    assert all(r.hits == "" for r in rows)
    assert rows[0].n == "recommend [removed], [removed], [removed] and [removed]" and rows[5].n == rows[5].t
