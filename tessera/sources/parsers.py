"""Parsers of raw payloads as column expressions: CSV prices, JSON prices and facts, parallel arrays, feeds, filing indexes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

CSV_SCHEMA = "Date string, Open string, High string, Low string, Close string, Volume string"
PRICE_JSON = "array<struct<date:string,open:string,high:string,low:string,close:string,volume:string>>"
_ELEMENTS = ["title", "guid", "id", "origLink", "originalLink", "pubDate", "published", "updated", "date", "description", "summary"]
_ITEM = f"array<struct<{','.join(f'{e}:array<string>' for e in _ELEMENTS)},link:array<struct<_VALUE:string,_href:string,_rel:string,_type:string>>,enclosure:array<struct<_url:string,_type:string>>,content:array<struct<_url:string>>,thumbnail:array<struct<_url:string>>>>"
FEED_XML = f"struct<channel:struct<item:{_ITEM}>,item:{_ITEM},entry:{_ITEM},malformed:string>"
CONCEPT_JSON = "map<string,map<string,array<struct<fy:int,form:string,end:string,val:double,filed:string>>>>"


def safe_number(c: Column) -> Column:
    """Null for blank or invalid text."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("double")


def price_csv(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Rows whose date is yyyy-MM-dd and whose close is a number; other bad numbers are null; volume goes through a float."""
    row = lines.select(*keys, F.from_csv(F.col(line), CSV_SCHEMA).alias("r"))
    out = row.select(*keys, F.when(F.col("r.Date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("r.Date").try_cast("date")).alias("date"), *[safe_number(F.col(f"r.{c}")).alias(c.lower()) for c in ("Open", "High", "Low", "Close")], safe_number(F.col("r.Volume")).cast("long").alias("volume"))
    return out.filter("date IS NOT NULL AND close IS NOT NULL")


def price_json(payloads: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """S3: objects of an array that have a date and a close."""
    rows = payloads.select(*keys, F.inline(F.from_json(F.col(payload), PRICE_JSON)))
    return rows.select(*keys, F.col("date").try_cast("date").alias("date"), safe_number(F.col("close")).alias("close"), safe_number(F.col("volume")).cast("long").alias("volume")).filter("date IS NOT NULL AND close IS NOT NULL")


def concept_facts(payloads: DataFrame, keys: list[str], payload: str, aliases: dict[str, list[str]], forms: list[str]) -> DataFrame:
    """Of each item the first alias that has annual facts, and of these the latest end; values in millions to two places."""
    order = [(item, alias, i) for item, names in aliases.items() for i, alias in enumerate(names)]
    table = F.array(*[F.struct(F.lit(a).alias("concept"), F.lit(i).alias("item"), F.lit(n).alias("place")) for i, a, n in order])
    parsed = payloads.select(*keys, F.explode(F.from_json(F.col(payload), CONCEPT_JSON)).alias("concept", "units")).select(*keys, "concept", F.explode("units").alias("unit", "facts")).select(*keys, "concept", "unit", F.inline("facts"))
    named = parsed.withColumn("a", F.explode(F.filter(table, lambda t: t.concept == F.col("concept")))).filter(F.col("form").isin(forms))
    w = Window.partitionBy(*keys, "a.item").orderBy("a.place", F.desc("end"), F.desc("filed"), F.desc("val"))
    return named.withColumn("n", F.row_number().over(w)).filter("n = 1").select(*keys, F.col("a.item").alias("item"), "concept", "unit", "fy", F.round(F.col("val") / 1e6, 2).alias("value_mln"))


def parallel_arrays(rows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """One row per index of arrays of equal meaning; shorter ones give nulls."""
    return rows.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("n", "z")).select(*keys, "n", "z.*")


def recent_filings(rows: DataFrame, keys: list[str], forms: list[str], as_of: str, days: int, most: int) -> DataFrame:
    """Forms of the list, filed within `days` (an unreadable date stays), newest first, undated last, at most `most` of a key."""
    day = F.col("filing_date").try_cast("date")
    kept = rows.filter(F.col("form").isin(forms)).withColumn("day", day).filter(F.coalesce(F.datediff(F.lit(as_of).cast("date"), "day") <= days, F.lit(True)))
    rank = F.array_position(F.array(*map(F.lit, forms)), F.col("form"))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("day"), rank, "n")
    return kept.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def feed_items(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """Items of RSS and entries of Atom documents that have a title, each read by itself: n (its place among all), title, link (an
    RSS link's text, or the first Atom link that is an alternate or has no relation), guid, orig_link, published, summary, media (the
    first enclosure, content or thumbnail that is one) and canonical (the first of link, guid and orig_link that is an address and no
    media file). A document that is no XML, or that defines entities, has no items."""
    parsed = feeds.select(key, F.from_xml(F.col(xml), FEED_XML, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed", "ignoreNamespace": "true"}).alias("f"))
    none = F.array().cast(_ITEM)
    items = F.concat(*[F.coalesce(c, none) for c in ("f.channel.item", "f.item", "f.entry")])
    rows = parsed.select(key, F.posexplode(items).alias("n", "i"))
    text = lambda *names: F.coalesce(*[F.nullif(F.trim(F.get(f"i.{c}", 0)), F.lit("")) for c in names])
    told = F.filter("i.link", lambda x: F.nullif(F.trim(x["_VALUE"]), F.lit("")).isNotNull() & x["_href"].isNull())
    alternate = F.filter("i.link", lambda x: x["_href"].isNotNull() & F.coalesce(F.lower(x["_rel"]).isin("", "alternate"), F.lit(True)))
    links = F.coalesce(F.trim(F.get(told, 0)["_VALUE"]), F.get(alternate, 0)["_href"])
    shown = F.coalesce(F.col("i.enclosure"), F.array().cast("array<struct<_url:string,_type:string>>"))
    enclosed = F.filter(shown, lambda x: x["_url"].isNotNull() & (F.coalesce(F.lower(x["_type"]).rlike("^(image|video|audio)/"), F.lit(False)) | is_media(x["_url"])))
    media = F.coalesce(F.get(enclosed, 0)["_url"], F.get("i.content", 0)["_url"], F.get("i.thumbnail", 0)["_url"])
    out = rows.select(key, "n", text("title").alias("title"), links.alias("link"), text("guid", "id").alias("guid"), text("origLink", "originalLink").alias("orig_link"), text("pubDate", "published", "updated", "date").alias("published"), text("description", "summary").alias("summary"), media.alias("media"))
    return out.filter("title IS NOT NULL").withColumn("canonical", canonical_link(F.col("link"), F.col("guid"), F.col("orig_link")))


def is_media(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(mp3|mp4|jpe?g|png|gif|webm)(\?|$)|/(media|image|video)s?/")


def canonical_link(*choices: Column) -> Column:
    """The first choice that is an address and no media file."""
    return F.coalesce(*[F.when(c.rlike("^https?://") & ~is_media(c), c) for c in choices])


def primary_document(entries: DataFrame, keys: list[str], form: Column) -> DataFrame:
    """The exact hint, else a document typed as the form, else the largest page that is no exhibit, else the first non-exhibit by name."""
    exhibit = F.col("kind").startswith("EX")
    rank = F.when(F.col("is_hint"), 0).when(F.col("kind") == form, 1).when(~exhibit & F.col("name").endswith(".htm"), 2).when(~exhibit, 3)
    rows = entries.withColumn("rule", rank).filter("rule IS NOT NULL")
    w = Window.partitionBy(*keys).orderBy("rule", F.when(F.col("rule") == 2, -F.col("size")), "name")
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def synthetic_prices(seeds: DataFrame, key: str, seed: str, days: list[int], annual: float = 0.08) -> DataFrame:
    """The seed price compounded daily."""
    return seeds.select(key, F.explode(F.array(*map(F.lit, days))).alias("day"), F.col(seed).alias("seed")).withColumn("price", F.round(F.col("seed") * F.pow(F.lit(1 + annual / 365), F.col("day")), 4)).drop("seed")


def with_fallback(base: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """The first source's value, else the second's with a warning, else a gap."""
    a, b = first.select(key, F.col(value).alias("a")), second.select(key, F.col(value).alias("b"))
    rows = base.join(a, key, "left").join(b, key, "left")
    note = F.when(F.col("a").isNotNull(), "").when(F.col("b").isNotNull(), "fallback used").otherwise("not sourced")
    return rows.select(key, F.coalesce("a", "b").alias(value), note.alias("warning"))


def envelope(df: DataFrame, keys: list[str], text: str, items: str, chars: int, most: int) -> DataFrame:
    """Text cut to `chars`, lists to `most` with the number left out, as JSON."""
    s = F.struct(F.substring(text, 1, chars).alias("text"), F.slice(items, 1, most).alias("items"), F.greatest(F.size(items) - most, F.lit(0)).alias("omitted"))
    return df.select(*keys, F.to_json(s).alias("envelope"))


STATEMENT_JSON = "struct<General:struct<Code:string,Sector:string>,Highlights:struct<MarketCapitalization:string,PERatio:string>,Financials:struct<Income_Statement:struct<yearly:map<string,struct<date:string,totalRevenue:string,grossProfit:string>>>>>"


def vendor_statements(payloads: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """field_name, value, unit of a nested fundamentals document: highlights, and the latest yearly statement; money in millions."""
    d = payloads.select(*keys, F.from_json(F.col(payload), STATEMENT_JSON).alias("d"))
    years = F.col("d.Financials.Income_Statement.yearly")
    d = d.withColumn("last", F.array_max(F.map_keys(years))).withColumn("s", F.element_at(years, F.col("last")))
    date = F.coalesce(F.col("s.date"), F.col("last"))
    mln = lambda c: F.round(safe_number(F.col(c)) / 1e6, 4)
    points = [
        (F.lit("market_cap_mln"), mln("d.Highlights.MarketCapitalization"), "USD_m"), (F.lit("pe_ratio"), safe_number(F.col("d.Highlights.PERatio")), "ratio"),
        (F.concat(F.lit("income_statement."), date, F.lit(".total_revenue_mln")), mln("s.totalRevenue"), "USD_m"), (F.concat(F.lit("income_statement."), date, F.lit(".gross_profit_mln")), mln("s.grossProfit"), "USD_m"),
    ]
    return d.select(*keys, F.inline(F.array(*[F.struct(n.alias("field_name"), v.alias("value"), F.lit(u).alias("unit")) for n, v, u in points]))).filter("value IS NOT NULL AND field_name IS NOT NULL")


def news_json(payloads: DataFrame, keys: list[str], payload: str, tiers: dict[str, int], other: int = 5) -> DataFrame:
    """Articles of a payload, a list or an object that holds one under any of the usual names; items without a headline are left out.
    A known media domain, or one below it, gives its tier, everything else is an aggregator's."""
    raw = F.col(payload)
    lists = [F.get_json_object(raw, f"$.{k}") for k in ("articles", "results", "data", "items", "news")]
    found = F.coalesce(F.when(F.ltrim(raw).startswith("["), raw), *[F.when(F.ltrim(x).startswith("["), x) for x in lists])
    rows = payloads.select(*keys, F.posexplode(F.from_json(found, "array<string>")).alias("n", "a"))
    get = lambda *names: F.coalesce(*[F.nullif(F.get_json_object("a", f"$.{k}"), F.lit("")) for k in names])
    source = F.coalesce(F.get_json_object("a", "$.source.name"), F.when(~F.get_json_object("a", "$.source").startswith("{"), F.get_json_object("a", "$.source")), F.get_json_object("a", "$.publisher"))
    rows = rows.select(*keys, "n", get("title", "headline", "name").alias("headline"), get("url", "link").alias("url"), get("publishedAt", "published_at", "date", "seendate").alias("published_at"), source.alias("source_name"), get("description", "summary").alias("summary"))
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")
    known = T.by_domain(host, tiers)
    return rows.filter("headline IS NOT NULL").withColumn("source_tier", F.coalesce(known, F.lit(other)))


def balanced_slice(text: Column) -> Column:
    """From the first { or [ to its match, strings and escapes aside; null without one. A helper over Arrow batches: brackets nest."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            start = min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=-1) if t else -1
            depth, quoted, escaped = 0, False, False
            for i in range(start, len(t)) if start >= 0 else ():
                c = t[i]
                if quoted:
                    quoted, escaped = escaped or c != '"', not escaped and c == "\\"
                elif c == '"':
                    quoted = True
                elif c in "{[":
                    depth += 1
                elif c in "}]":
                    depth -= 1
                    if not depth:
                        return t[start : i + 1]
            return None

        return texts.map(one)

    return cut(text)
