"""Documents that a page leads to: links in anchors, JSON-LD, hydration state, other embedded JSON and feeds, resolved, told apart and ranked."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.markup import ATTRIBUTE, MARK
from tessera.sources import parsers as SP

#: The order of strategies, kinds from the most to the least wanted with the words that tell them, where state is kept.
STRATEGIES = ["anchors", "json_ld", "hydration", "embedded_json", "feed"]
KINDS = ["annual_report", "results_release", "interim_report", "presentation", "other"]
WANTED = ["annual_report", "results_release"]
ANNUAL = ["annual report", "universal registration document", "registration document", "integrated report", "annual financial report", "annual results", "full-year results", "full year results"]
INTERIM = ["half-year", "half year", "interim", "first-half", "first half", "quarterly"]
RESULTS = ["results release", "results announcement", "press release", "trading update", "earnings release"]
PRESENTED = ["presentation", "slides", "deck", "webcast"]
KEYWORDS = [*ANNUAL, "financial report", "results presentation", "half-year report", "half year report", "interim report", "half-year results"]
STATE_IDS = {"__next_data__", "__nuxt_data__", "__nuxt__"}
STATE_NAMES = ["__initial_state__", "__preloaded_state__", "__initial_data__", "__nuxt__", "__apollo_state__"]
TITLES = ["name", "headline", "title", "label", "description"]

EXTENSION, LONGEST_URL, LONGEST_TITLE = ".pdf", 2000, 200
SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)(?:</script\s*>|\Z)", re.S | re.I)
BRACKET = re.compile(r'"(?:[^"\\]|\\.)*+"|[{}\[\]]', re.S)
SWEEP = re.compile(r"(https://[^\s\"'<>()\\]{1,400}?\.pdf)|[\"'](/[^\s\"'<>()\\]{1,400}?\.pdf)[\"']", re.I)
NOT_LINKS = ("#", "mailto:", "tel:", "javascript:", "data:")


def balanced(text: str, start: int) -> str | None:
    """From a bracket to the one that closes it, brackets in strings aside; None if it isn't closed."""
    depth = 0
    for m in BRACKET.finditer(text, start):
        c = m.group()
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return text[start : m.end()]
    return None


def _parsed(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _link_shape(s: str) -> bool:
    s = s.strip()
    low = s.lower()
    return bool(s) and len(s) <= LONGEST_URL and not any(c.isspace() for c in s) and not low.startswith(NOT_LINKS) and (low.startswith(("http://", "https://", "/", "./", "../")) or "/" in s and low.split("?")[0].split("#")[0].endswith(EXTENSION))


def _walked(value) -> Iterator[tuple[str, str]]:
    """(string, title) of every string in a value that has the shape of a link, the shallow ones first; the title is that of the nearest object around it."""
    queue = deque([(value, "")])
    while queue:
        now, title = queue.popleft()
        if isinstance(now, str):
            if _link_shape(now):
                yield now.strip(), title
        elif isinstance(now, dict):
            own = next((v.strip() for k in TITLES if isinstance(v := now.get(k), str) and v.strip()), title)
            queue.extend((v, own) for v in now.values())
        elif isinstance(now, list):
            queue.extend((v, title) for v in now)


def _states(body: str) -> Iterator:
    low = body.lower()
    for name in STATE_NAMES:
        at = low.find(name)
        equals = body.find("=", at + len(name)) if at >= 0 else -1
        start = re.compile(r"[{\[]").search(body, equals + 1, equals + 201) if equals >= 0 else None
        value = _parsed(part) if start and (part := balanced(body, start.start())) else None
        if value is not None:
            yield value


def _literals(body: str) -> Iterator:
    """The outermost objects and arrays of a script that are JSON. Brackets are paired in one pass; one that isn't closed is passed over."""
    open_at: list[int] = []
    pairs: list[tuple[int, int]] = []
    for m in BRACKET.finditer(body):
        c = m.group()
        if c in "{[":
            open_at.append(m.start())
        elif c in "}]" and open_at:
            pairs.append((open_at.pop(), m.end()))
    done = 0
    for start, end in sorted(pairs):
        if start >= done:
            value = _parsed(body[start:end])
            if value is not None:
                yield value
                done = end


def candidates(page: str) -> list[tuple[int, str, str]]:
    """(strategy, link as it stands, title) of all links of a page that may be documents, by strategy and place."""
    found: list[tuple[int, str, str]] = []
    href, words, at = None, [], 0
    for m in MARK.finditer(page):
        if href is not None:
            words.append(page[at : m.start()])
        at, tag = m.end(), (m.group("tag") or "").lower()
        if tag == "a":
            if href is not None:
                found.append((0, href, " ".join("".join(words).split())))
                href = None
            if not m.group("end"):
                given = {a.group(1).lower(): a.group(2) or a.group(3) or a.group(4) or "" for a in ATTRIBUTE.finditer(m.group("attrs"))}
                href, words = given.get("href", "").replace("&amp;", "&").strip(), []
                href = None if not href or href.lower().startswith(NOT_LINKS) else href
        elif href is not None and tag:
            words.append(" ")
    if href is not None:  # an anchor that isn't closed goes to the end
        found.append((0, href, " ".join("".join([*words, page[at:]]).split())))
    for m in SCRIPT.finditer(page):
        given = {a.group(1).lower(): (a.group(2) or a.group(3) or a.group(4) or "").lower() for a in ATTRIBUTE.finditer(m.group(1))}
        body = m.group(2)
        if "ld+json" in given.get("type", ""):
            value = _parsed(body)
            found += [(1, u, t) for u, t in _walked(value)] if value is not None else []
            continue
        state = given.get("id", "") in STATE_IDS
        whole = _parsed(body) if state else None
        values = [whole] if whole is not None else list(_states(body))
        found += [(2, u, t) for v in values for u, t in _walked(v)]
        if state:
            found += [(2, a or b, "") for a, b in SWEEP.findall(body)] if not values else []
        elif EXTENSION in body.lower():
            more = [(3, u, t) for v in _literals(body) for u, t in _walked(v)]
            found += more or [(3, a or b, "") for a, b in SWEEP.findall(body)]
    return found


def document_kind(words: Column) -> Column:
    """The kind that a title and address speak of: annual before interim before results before presentations."""
    low = F.lower(words)
    loose = F.regexp_replace(F.replace(low, F.lit("%20"), F.lit(" ")), r"[-_+]", " ")
    says = lambda phrases: reduce(lambda x, y: x | y, (F.contains(low, F.lit(p)) | F.contains(loose, F.lit(p)) for p in phrases))
    return F.when(says(ANNUAL), "annual_report").when(says(INTERIM) | loose.rlike(r"\b(?:h1|q1|q2|q3)\b"), "interim_report").when(says(RESULTS), "results_release").when(says(PRESENTED), "presentation").otherwise("other")


def speaks_of(words: Column, phrases: list[str]) -> Column:
    low = F.lower(words)
    loose = F.regexp_replace(F.replace(low, F.lit("%20"), F.lit(" ")), r"[-_+]", " ")
    return reduce(lambda x, y: x | y, (F.contains(low, F.lit(p)) | F.contains(loose, F.lit(p)) for p in phrases))


_LINK = pa.struct([("strategy", pa.int32()), ("url", pa.string()), ("title", pa.string())])


def discovered(pages: DataFrame, key: str, url_col: str, html_col: str, most: int = 12, feeds: DataFrame | None = None, feed_col: str = "xml") -> DataFrame:
    """Key, place, url, title, kind, strategy and is_document of the at most `most` best documents that each page leads to.

    Links are taken by strategies in order: anchors that speak of documents, then JSON-LD, hydration state, other embedded JSON
    (of those, links to a PDF or that speak of documents), then the feeds of `feeds` (key, url, xml). A link is resolved against the
    page's address, loses credentials, and counts only as HTTPS below the page's own domain (its last two labels). Of links
    with one identity (no query, no case) the first stays, within its strategy, of which `most` are taken, and over all. Once
    `most` annual reports or results releases are found, later strategies don't run. What is left is ranked by kind, then
    PDFs first, then as found. The windows hold a page's links. A null, empty or malformed page has none; keys must tell pages apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def resolved(base: str, link: str) -> str | None:
            try:
                return urljoin(base, link)
            except ValueError:
                return None

        for batch in batches:
            rows = []
            for base, page in zip(batch.column("base").to_pylist(), batch.column("page")):
                links = ((s, resolved(base or "", u), t[:LONGEST_TITLE]) for s, u, t in candidates(page.as_py() or ""))
                rows.append([{"strategy": s, "url": u, "title": t} for s, u, t in links if u and len(u) <= LONGEST_URL and u.lower().startswith("https://")])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("base"), pa.array(rows, pa.list_(_LINK))], names=["key", "base", "links"])

    kind = pages.schema[key].dataType.simpleString()
    read = pages.select(F.col(key).alias("key"), F.col(url_col).alias("base"), F.col(html_col).alias("page")).mapInArrow(run, f"key {kind}, base string, links array<struct<strategy:int,url:string,title:string>>")
    links = read.select("key", "base", F.posexplode("links").alias("n", "l")).select("key", "base", F.col("l.strategy").alias("strategy"), "n", "l.url", "l.title")
    if feeds is not None:
        base = feeds.select(F.col(key).alias("key"), F.col(url_col).alias("base"))
        items = SP.feed_items(feeds, key, feed_col).withColumnRenamed(key, "key").select("key", "n", "title", F.explode(F.array_compact(F.array_distinct(F.array("link", "guid", "media")))).alias("url"))
        links = links.unionByName(items.join(base, "key").filter("url LIKE 'https://%'").select("key", "base", F.lit(4).alias("strategy"), "n", "url", F.substring("title", 1, LONGEST_TITLE).alias("title")))
    host = lambda c: T.domain(F.col(c))
    own = F.array_join(F.slice(F.split(host("base"), r"\."), -2, 2), ".")
    own = F.when(F.size(F.split(host("base"), r"\.")) < 2, host("base")).otherwise(own)
    x = links.withColumn("url", T.strip_secrets(F.col("url"))).withColumns({"__host": host("url"), "__own": own}).filter("__own <> '' AND (__host = __own OR endswith(__host, concat('.', __own)))")
    path = F.regexp_extract(F.lower("url"), r"^[^?#]*", 0)
    file = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(F.regexp_extract("url", r"^[^?#]*", 0), r"([^/]*)$", 1), r"(?i)\.pdf$", ""), r"[-_]|%20", " "))
    x = x.withColumns({"is_document": path.endswith(EXTENSION), "title": F.when(F.coalesce(F.trim("title"), F.lit("")) == "", F.substring(file, 1, LONGEST_TITLE)).otherwise(F.trim("title")), "__said": F.coalesce("title", F.lit(""))})
    words = F.concat_ws(" ", "title", "url")
    said = speaks_of(F.concat_ws(" ", "__said", "url"), KEYWORDS)
    x = x.filter(said | ((F.col("strategy") > 0) & F.col("is_document"))).withColumns({"kind": document_kind(words), "identity": T.document_identity(F.col("url"))})
    within = x.groupBy("key", "strategy", "identity").agg(F.min_by(F.struct("url", "title", "kind", "is_document"), "n").alias("d"), F.min("n").alias("n"))
    taken = within.withColumn("__i", F.row_number().over(Window.partitionBy("key", "strategy").orderBy("n"))).filter(F.col("__i") <= most)
    once = taken.withColumn("__i", F.row_number().over(Window.partitionBy("key", "identity").orderBy("strategy"))).filter("__i = 1").select("key", "strategy", "n", "d.*")
    before = Window.partitionBy("key").orderBy("strategy").rangeBetween(Window.unboundedPreceding, -1)
    ran = once.withColumn("__have", F.coalesce(F.sum(F.col("kind").isin(WANTED).cast("int")).over(before), F.lit(0))).filter(F.col("__have") < most)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(rank, F.desc("is_document"), "strategy", "n"))
    out = ran.withColumn("place", place).filter(F.col("place") <= most)
    return out.select(F.col("key").alias(key), "place", "url", "title", "kind", F.element_at(F.array(*map(F.lit, STRATEGIES)), F.col("strategy") + 1).alias("strategy"), "is_document")
