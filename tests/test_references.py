"""heading_sections and its SQL on references that end without a semicolon, as cut titles do, and on numbers."""

import html

import duckdb
from tessera.plans.registry import QUERIES, SQL

TITLES = ["cut&amp", "a&ampb &ltcc;&lt&quot", "&am &AMPx &notit; &zz;", "&#38;&#x26;&#128;&#0;&#xD800;&#99999999999999999999;", "&nbsp;x&nbspy&#160;z", "&amp;lt; & b", "a<i>b</i><br>c"]


def test_headings_with_cut_references(spark, tmp_path):
    spark.createDataFrame([(i, f"<h1>{t}</h1>") for i, t in enumerate(TITLES)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["heading_sections"](spark, str(tmp_path))
    rows = sorted(tuple(r) for r in got.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert rows == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL['heading_sections']})").fetchall())
    assert [r[3] for r in rows if r[1] == 0][:6] == [" ".join(html.unescape(t).split()) for t in TITLES[:6]] and rows[-5][3] == "ab c"
