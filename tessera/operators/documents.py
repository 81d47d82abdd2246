"""Documents and pages: blocks, classification, numbers, forbidden language, deduplication by text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.reporting import SEGMENT_MARKS
from tessera.operators import prose as P

#: Our own small vocabularies for the corpus.
THEMES = {"energy": ["energy", "grid", "solar"], "defence": ["defence", "shield", "guard"], "growth": ["growth", "expand", "rising"], "trade": ["the", "and", "for"]}
CLASSES = {"financial": ["revenue", "profit", "margin", "income"], "risk": ["risk", "worthless", "threat"], "business": ["market", "product", "blend"]}
HINTS = {"en": ["the", "and", "of", "to", "in", "is"], "fr": ["le", "la", "les", "des", "et", "que"], "de": ["der", "die", "und", "den", "von", "mit"], "es": ["el", "los", "las", "que", "por", "una"]}
#: Fixed values of relevance: headings of statements, words of a reporting period; the amounts and lines are our own shapes.
STATEMENTS = ["financial highlights", "income statement", "cash flow statement", "balance sheet", "financial review"]
REPORTED = ["year ended", "months ended", "month ended", "for the year"]
FIGURES = {"revenue": ["revenue"], "operating profit": ["operating profit"], "net income": ["net income"], "margin": ["margin"], "cash flow": ["cash flow"], "total assets": ["total assets"]}
AMOUNT = r"[€£$]\s?\d|\d\s?%|\d\s?(?:million|billion|thousand|bn|mn|m)\b"
CLAUSE_END = r"[;!?\n]|\.\s"
WIDTH = 75  # characters of a line that may end in a page number
FORBIDDEN = {"rating": r"\b(?:BUY|SELL|HOLD)\b", "rating_in_context": r"(?i)\b(?:recommend|rated|rating)\b[^.!?]{0,40}\b(?:buy|sell|hold)\b", "phrase": r"(?i)price target|guaranteed return|worthless"}
NEUTRAL = [(r"(?i)price targets?", "valuation reference"), (r"(?i)guaranteed returns?", "expected outcome"), (r"(?i)worthless", "low value"), (r"\b(?:BUY|SELL|HOLD)\b", "[removed]"), (r"(?i)(?<=\b(?:recommend|rated|rating)\b[^.!?]{0,40})\b(?:buy|sell|hold)\b", "[removed]")]


def paragraphs(docs: DataFrame, id_col: str, text_col: str, least: int = 40) -> DataFrame:
    """Blocks between line ends, white space collapsed, of at least `least` characters, numbered from 0 as they stand."""
    blocks = F.posexplode(F.split(text_col, r"\n+"))
    rows = docs.select(id_col, blocks.alias("block_no", "raw")).select(id_col, "block_no", F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("block"))
    return rows.filter(F.length("block") >= least)


def html_blocks(pages: DataFrame, least: int = 40) -> DataFrame:
    """Text of p, li, h1-h6 and td elements outside script, style, nav, header and footer, entities resolved, at least `least` characters."""
    body = F.regexp_replace("html", r"(?is)<(script|style|nav|header|footer)\b[^>]*>.*?</\1>", " ")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(?:p|li|h[1-6]|td)\b[^>]*>(.*?)</(?:p|li|h[1-6]|td)>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("block_no", "raw"))
    plain = F.regexp_replace("raw", "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return rows.select("page_id", "block_no", F.trim(F.regexp_replace(plain, r"\s+", " ")).alias("block")).filter(F.length("block") >= least)


def links(pages: DataFrame) -> DataFrame:
    """Anchors with their targets resolved against the page's origin, https and http only, distinct by identity, in order."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"'#]+)"), F.lit(1))
    origin = F.regexp_extract("url", r"^https?://[^/?#]+", 0)
    rows = pages.select("page_id", origin.alias("origin"), F.posexplode(found).alias("n", "href"))
    target = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("origin", "href"))
    rows = rows.withColumn("target", target).filter("target IS NOT NULL").withColumn("identity", T.document_identity(F.col("target")))
    return rows.groupBy("page_id", "identity").agg(F.min("n").alias("first"))


def themes(text: Column) -> Column:
    """Names of the themes with a keyword in the text, in table order, comma-joined."""
    low = F.lower(text)
    return F.array_join(F.array_compact(F.array(*[F.when(T.hits(low, words) > 0, name) for name, words in THEMES.items()])), ",")


def _holds(text: Column, words: list[str]) -> Column:
    return F.coalesce(reduce(lambda x, y: x | y, (F.contains(text, F.lit(w)) for w in words)), F.lit(False))


def _holder(words: list[str]):
    return lambda text: _holds(text, words)


def metric_values(text: Column) -> Column:
    """How many figures are named in a clause that states an amount. Texts without a figure's name aren't cut into clauses."""
    low = F.lower(text)
    clauses = F.filter(F.split(low, CLAUSE_END), lambda c: c.rlike(AMOUNT))
    counted = F.aggregate(F.array(*[F.exists(clauses, _holder(ps)) for ps in FIGURES.values()]), F.lit(0), lambda n, x: n + x.cast("int"))
    return F.when(_holds(low, [p for ps in FIGURES.values() for p in ps]), counted).otherwise(0)


def contents_line(line: Column) -> Column:
    """Whether a line has the shape of a table of contents: short and ending in a number of at most four digits, or numbered."""
    return ((F.length(line) <= WIDTH) & line.rlike(r"(?:^|\s)\d{1,4}$")) | line.rlike(r"^\d{1,3}\.(?:\s|$)")


def relevance(text: Column) -> Column:
    """A point for each keyword, six for each figure with its amount, three if a segment is named beside one, two for a statement's
    heading, one for a period; less eight, but not under zero, if most of four lines or more look like a table of contents."""
    low = F.lower(text)
    found = metric_values(text)
    score = T.hits(F.concat(F.lit(" "), low, F.lit(" ")), [w for ws in CLASSES.values() for w in ws]) + 6 * found + F.when((found > 0) & _holds(low, SEGMENT_MARKS), 3).otherwise(0)
    score = score + F.when(_holds(low, STATEMENTS), 2).otherwise(0) + F.when(text.rlike(r"(?<!\d)(?:19|20)\d\d(?!\d)") | _holds(low, REPORTED), 1).otherwise(0)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.size(F.filter(lines, contents_line))
    boiler = text.contains("\n") & (F.size(lines) >= 4) & (listed >= 0.6 * F.size(lines))
    return F.when(boiler, F.greatest(score - 8, F.lit(0))).otherwise(score)


def forbidden(text: Column) -> Column:
    """Tiers with a hit, comma-joined: rating tokens by case, ratings within 40 characters of intent in a sentence, phrases."""
    return F.array_join(F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in FORBIDDEN.items()])), ",")


def safety(text: Column) -> dict[str, Column]:
    """Hits, and hits_after neutralising. One pass finds the texts that have any; only those are scanned by tier and rewritten, once."""
    any_hit = text.rlike("|".join(f"(?:{p})" for p in FORBIDDEN.values()))
    after = F.get(F.transform(F.array(neutralize(text)), forbidden), 0)  # a lambda's variable holds the rewritten text
    return {"hits": F.when(any_hit, forbidden(text)).otherwise(""), "hits_after": F.when(any_hit, after).otherwise("")}


def safety_hits(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Tier, term and matched text of every hit, one for each rating token and phrase, and the first rating in context."""
    terms = [("rating", t, rf"\b({t})\b") for t in ("BUY", "SELL", "HOLD")] + [("rating_in_context", None, f"({FORBIDDEN['rating_in_context']})")] + [("phrase", t, rf"(?i)({t})") for t in ("price target", "guaranteed return", "worthless")]
    hit = lambda p: F.nullif(F.regexp_extract(text_col, p, 1), F.lit(""))
    found = F.array(*[F.struct(F.lit(tier).alias("tier"), (F.lit(term) if term else F.trim(hit(p))).alias("term"), hit(p).alias("matched_text")) for tier, term, p in terms])
    rows = df.filter(F.col(text_col).rlike("|".join(f"(?:{p})" for p in FORBIDDEN.values())))
    return rows.select(*keys, F.inline(found)).filter("matched_text IS NOT NULL")


def neutralize(text: Column) -> Column:
    """Ordered replacements, so that the scan finds nothing. Every rating word in reach of an intent goes at once; what stands in its
    place is longer and holds no intent, so no other word comes into reach."""
    for pattern, other in NEUTRAL:
        text = F.regexp_replace(text, pattern, other)
    return text


def prefix_dedup(docs: DataFrame, id_col: str, text_col: str, n: int = 160) -> DataFrame:
    """Of texts with the same normalised first n characters the row with the smallest id, and how many there are."""
    key = F.substring(T.normalize_title(F.col(text_col)), 1, n)
    return docs.select(id_col, key.alias("prefix")).groupBy("prefix").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies")).select(id_col, F.md5(F.col("prefix").cast("binary")).alias("prefix_md5"), "copies")


def exact_sha1(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by hash of the text: first id, number of copies."""
    return docs.filter(F.col(text_col).isNotNull()).groupBy(T.short_hash(F.col(text_col)).alias("hash16")).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


def number_facts(blocks: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Numbers with a grouping or decimal mark or a sign of per cent, with kind and value; more than one magnitude of a kind: ambiguous."""
    found = F.regexp_extract_all(text_col, F.lit(r"(?:^|[^\w.,])(\d[\d.,]*\d%?|\d%?)"), F.lit(1))
    rows = blocks.select(*keys, F.posexplode(found).alias("n", "raw"))
    rows = rows.withColumn("kind", F.when(F.col("raw").endswith("%"), "percent").when(F.col("raw").rlike(r"^(199\d|20\d\d)$"), "year").otherwise("number")).withColumn("value", T.number(F.regexp_replace("raw", "%$", "")))
    w = Window.partitionBy(*keys, "kind")
    return rows.filter("value IS NOT NULL").withColumn("ambiguous", F.min("value").over(w) != F.max("value").over(w))


def claim_coverage(claims: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Of each claim's cited ids how many exist, and whether any is missing."""
    cited = claims.select("claim_id", F.explode("cited").alias(key)).distinct()
    known = evidence.select(key).distinct().withColumn("known", F.lit(1))
    joined = cited.join(known, key, "left").groupBy("claim_id").agg(F.count("known").alias("valid"), F.count_if(F.col("known").isNull()).alias("invalid"))
    return joined.withColumn("status", F.when(F.col("valid") == 0, "unsupported").when(F.col("invalid") > 0, "partly_supported").otherwise("supported"))


def labelled_facts(df: DataFrame, keys: list[str], text_col: str, labels: dict[str, list[str]], percents: dict[str, list[str]]) -> DataFrame:
    """K15, K16 with labels of one's own: of each label the one money amount or percentage that its clause states, with its scale."""
    found = P.mentions(df, keys, text_col, P.Scanner(labels, percents, {}))
    strong = F.coalesce(F.col("currency").isNotNull() | F.col("scale").isNotNull(), F.lit(False)) | (F.col("unit") == "percent")
    g = found.groupBy(*keys, "label").agg(F.min(F.when(strong, F.col("value"))).alias("low"), F.max(F.when(strong, F.col("value"))).alias("high"), F.min_by(F.struct("unit", "value", "scale"), F.struct(~F.col("strong"), F.col("start"))).alias("best"))
    return g.filter("low IS NULL OR low = high").select(*keys, "label", F.when(F.col("best.unit") == "percent", "percent").otherwise("money").alias("kind"), "best.value", "best.scale")
