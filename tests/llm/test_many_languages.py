"""Language ID with thousands of declared values, and on awkward pages."""

import random

import pytest
from tessera.llm import language
from tessera.llm.common import RID

WORDS = {"aa": "kala mina tolo vesi puu", "bb": "zwerk brauch stromt felgen", "cc": "quo vadis lumen astra terra", "dd": "shimo gawa yama sora hana"}
SCHEMA = "doc_id long, text string, lang string, source string, declared string, n_declared int"


def corpus(n, rare, seed=1):
    rng = random.Random(seed)
    langs = list(WORDS)
    rows = []
    for i in range(n):
        lang = langs[i % 4]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(40)), lang, f"h{i % 3}.example.{lang}", "x", 1))
    rows += [(n + i, " ".join(rng.choice("xylo phobe gneis thwack".split()) for _ in range(40)), f"r{i}", "h.example.zz", "x", 1) for i in range(rare)]
    return rows


def test_rare_values_share_a_profile(spark):
    docs = spark.createDataFrame(corpus(400, 60), SCHEMA)
    label, kept = language.label(docs, "lang", 4)
    assert sorted(kept) == list(WORDS)
    assert {r[0] for r in docs.select(label).distinct().collect()} == {*WORDS, language.FOLDED}
    got = {r.doc_id: r for r in language.of_documents(docs, fitted=4).collect()}
    assert all(got[i].language == list(WORDS)[i % 4] and got[i].accepted for i in range(400))
    assert all(got[400 + i].language == f"r{i}" and got[400 + i].accepted for i in range(60))


def test_nothing_is_folded_while_all_have_room(spark):
    docs = spark.createDataFrame(corpus(120, 3), SCHEMA)
    assert language.label(docs, "lang", 7)[1] is None
    plain = sorted(map(tuple, language.of_documents(docs, fitted=7).drop(RID).collect()))
    assert plain == sorted(map(tuple, language.of_documents(docs).drop(RID).collect()))


def test_thousands_of_declared_values(spark):
    docs = spark.createDataFrame(corpus(600, 5000), SCHEMA)
    out = language.of_documents(docs, fitted=16).collect()
    assert len(out) == 5600 and sum(r.language == r.text_language for r in out) > 5000
    assert all(r.language in WORDS for r in out if r.doc_id < 600)


@pytest.mark.parametrize("url", [None, "", "nonsense", "https://", "https://a", "https://a.b.example.de:8/x?lang=fr#y"])
def test_awkward_pages(spark, url):
    html = [None, "", "<html lang=''>", "<html lang=DE><body>Die Wörter der Sprache</body>", "<html><script>var x = '", "<p>" * 3000]
    rows = [(i, url, h) for i, h in enumerate(html)] + [(None, url, "<html lang='de'>und und und"), (3, url, html[3])]
    out = language.of_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(str(r.page_id) for r in out) == sorted(str(r[0]) for r in rows) and all(0 <= r.posterior <= 1 for r in out)
    assert language.of_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_page_languages_against_the_definition(spark, sf):
    """The registered query on the whole table, against posteriors computed a page at a time."""
    import re

    import numpy as np
    from llm.test_text_operators import brute_posteriors
    from tessera.llm.queries import QUERIES

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    rows = []
    for p in pages:
        html = p.html or ""
        found = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", html)
        host = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", p.url or "")
        host = host.group(1).lower() if host else None
        suffix = re.search(r"\.([^.]+)$", host) if host else None
        rows.append((re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ", html), found.group(1).lower() if found else None, suffix.group(1) if suffix else None, host))
    names, want = brute_posteriors(rows)
    got = {r.page_id: r for r in QUERIES["page_languages"](spark, sf).collect()}
    assert len(got) == len(pages) and len({r[1] for r in rows}) > 2 and len({r[3] for r in rows}) > 2
    for p, w in zip(pages, want):
        assert abs(got[p.page_id].posterior - w.max()) < 1e-5 and (got[p.page_id].language == names[w.argmax()] or np.sort(w)[-2] > w.max() - 1e-5)
