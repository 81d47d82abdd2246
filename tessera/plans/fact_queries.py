"""Queries on figures in prose, tables and markup, over whole documents and pages. The given texts name no figures, so each has a passage added that its key decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import reporting as R
from tessera.operators import facts as FA
from tessera.operators import markup as M
from tessera.operators import prose as P
from tessera.plans.catalogue import query
from tessera.sources.staged import staged
from tessera.sources.tables import table

#: 130 characters without a digit, so that no year of the text before is near.
APART = "\n" + "So much for what came before, and now a few more words of the usual kind that tell nothing at all, to go on with the next thing.. \n"
STATEMENTS = [
    "Revenue for the first half of 2026 came to €{x} million.",
    "Sales increased by 5% at actual exchange rates to EUR{x} million in 2025.",
    "Operating profit for the year grew by 1% to €{x} thousand.",
    "Operating profit was up by 23% in Europe, revenue in 2024 was $ {x}bn.",
    "Revenue of operating profit was £{x} million.",
    "Revenue was €{x} million. Later revenue reached €1 million.",
    "Revenue 31. The Group's Watch Makers reported sales of CHF {x} million in 2023.",
    "Operating margin rose 120 basis points to {x}% but net cash was strong.",
    "Free cash flow fell by 3% to {x} million; operating free cash flow reached {x} million.",
    "The company employs approximately {x} people. Annual report 2022.",
    "Led by demand, the Fine Goods were able to grow their operating profit to €{x} million in 2021.",
    "Revenue was strong but costs were €{x} million.",
]


def filled(templates: list[str], index: Column, values: dict[str, Column]) -> Column:
    """The template at an index, with its places filled."""
    text = F.element_at(F.array(*map(F.lit, templates)), (index % len(templates) + 1).cast("int"))
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


@query
def prose_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Every label with its value in whole documents, one fact a label."""
    d, x = table(spark, sf, "documents"), F.format_number(F.col("doc_id") * 7 % 9000 + 1000, 0)
    d = d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(APART), filled(STATEMENTS, F.col("doc_id"), {"x": x})).alias("text"))
    out = P.settled(P.mentions(d, ["doc_id"], "text"), ["doc_id"])
    return out.select("doc_id", "label", "raw", "value", "unit", "scale", "currency", "period", "scope", "confidence")


HEADS = ["EUR million", "EUR million", "", "EUR million", "EUR million", ""]
ROWS = [
    "<tr><td>Revenue</td><td>{v}</td><td>{w}</td></tr>",
    "<tr><td>Revenue</td><td>{v}</td><td>{w}</td></tr>",
    "<tr><td>Short-term debt</td><td>{v}</td><td>10</td></tr><tr><td>Long-term debt<td>{v}<td>20<tr><td>Total debt</td><td>99,000</td><td>30.3</td></tr>",
    "<tr><td>Total assets</td><td>{v}</td><td>{v}</td></tr><tr><td>Total liabilities</td><td>500</td><td>400</td></tr><tr><td>Total equity</td><td>{w}</td><td>{w}</td></tr>",
    "<tr><td>Operating margin</td><td>12.5%</td><td>11</td></tr><tr><td>Employees</td><td>{v}</td><td>12,000</td></tr><tr><td>Operating profit and revenue</td><td>5</td><td>6</td></tr>",
    "<tr><td>Other</td><td>1</td><td>2</td></tr>",
]
PROSE = [
    "Revenue for fiscal year 2024 was €{v} million as the consolidated accounts show.",
    "Revenue for fiscal year 2024 was €{u} million as the consolidated accounts show.",
    "All that is said here is in € million, as the accounts of every year before.",
    "Nothing is said here about any figure, only that the tables follow below.",
    "Nothing is said here about any figure, only that the tables follow below.",
    "Group revenue reached €{v} million in 2024 as planned and as told before.</p><p>Operating profit for the Group reached €{w} million after a calm second half.",
]


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a report before their own content: a paragraph, and a table within a table for layout."""
    p, v = table(spark, sf, "pages"), F.col("page_id") * 37 % 9000 + 1000
    shown = {"u": F.format_number(v + 500, 0), "v": F.format_number(v, 0), "w": F.format_number(v - 500, 0)}
    report = "<h2>Consolidated results</h2><p>{prose}</p><nav><h3>Segment menu</h3></nav><table class='layout'><tr><td>left<table><tr><th>{head}<th>2024</th><th>2023</th></tr>{rows}</table> of it</td><td>right</td></tr></table>"
    html = F.lit(report)
    for name, templates in (("prose", PROSE), ("head", HEADS), ("rows", ROWS)):
        html = F.replace(html, F.lit("{" + name + "}"), filled(templates, F.col("page_id"), shown))
    return p.select("page_id", F.concat(html, F.coalesce("html", F.lit(""))).alias("html"))


@query
def page_facts(spark: SparkSession, sf: str) -> DataFrame:
    """V1-V6 over whole pages: facts of nested tables and of paragraphs, in every other group of six pages told apart by method; every tenth page's issuer isn't known."""
    tree = staged(M.structure(_reports(spark, sf), "page_id", "html").filter("size(tables) > 0 OR size(blocks) > 0").select("page_id", "tables", "blocks"), "tree")
    tables = tree.select("page_id", R.first_currency(F.col("blocks.text")).alias("currency"), R.first_scale(F.col("blocks.text")).alias("scale"), F.lit(None).cast("string").alias("period"), F.inline("tables"))
    from_tables = FA.reconciled(FA.table_candidates(tables, "page_id"), "page_id")
    blocks = tree.select("page_id", F.posexplode("blocks").alias("block_no", "b")).select("page_id", "block_no", F.get("b.path", F.size("b.path") - 1).alias("heading"), F.get("b.path", F.size("b.path") - 2).alias("above"), "b.text")
    keys = ["page_id", "block_no", "heading", "above"]
    stated = P.settled(P.mentions(blocks, keys, "text"), keys).withColumn("scope", F.coalesce("scope", R.heading_scope(F.col("heading"), F.col("above"))))
    stated = staged(stated, "stated")
    from_prose = FA.prose_candidates(stated, "page_id", ["block_no", "start"])
    columns = ["page_id", "label", "value", "unit", "currency", "scale", "period", "scope", "qualified", "status"]
    place = lambda *c: F.array(*[x.cast("int") for x in c]).alias("place")
    other = F.when(F.floor(F.col("page_id") / 6) % 2 == 1, "native_pdf").otherwise("html")
    c = from_tables.select(*columns, F.lit("html").alias("method"), F.lit(0.7).alias("sure"), place(F.lit(0), F.col("table_no"), F.col("row_no"), F.col("col")))
    c = c.unionByName(from_prose.select(*columns, other.alias("method"), F.lit(0.9).alias("sure"), place(F.lit(1), F.col("block_no"), F.col("start"), F.lit(0))))
    return FA.judged(c, "page_id", F.col("page_id") % 10 != 7).withColumn("methods", F.array_join("methods", "|"))


@query
def page_structure(spark: SparkSession, sf: str) -> DataFrame:
    """S18 over whole pages with their reports: rows of tables, the inner one with the outer as parent, and headings outside menus."""
    tree = staged(M.structure(_reports(spark, sf), "page_id", "html").select("page_id", "tables", "headings"), "tree")
    rows = M.table_rows(tree, "page_id").select("page_id", F.lit("row").alias("kind"), "table_no", F.col("row_no").alias("n"), "parent", "path", F.array_join("cells", "|").alias("text"))
    heads = M.headings(tree, "page_id").filter("n = 0").select("page_id", F.lit("heading").alias("kind"), F.lit(None).cast("int").alias("table_no"), "n", F.lit(None).cast("int").alias("parent"), "path", F.col("title").alias("text"))
    return rows.filter("table_no < 2").unionByName(heads)
