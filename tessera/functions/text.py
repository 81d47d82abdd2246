"""Column functions on URLs, titles, words, numbers and dates. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, and those that carry credentials.
TRACKING = "utm_|fbclid|gclid|mc_|ref"
SECRETS = "token|key|apikey|api_key|password|secret|signature|sig|auth"


def _query_without(url: Column, names: str, whole: bool) -> Column:
    """The URL (without fragment) with the query parameters left whose names don't match, in order."""
    base, query = F.split_part(url, F.lit("?"), F.lit(1)), F.regexp_extract(url, r"\?(.*)$", 1)
    pattern = f"(?i)^({names})" + ("=" if whole else "")
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(pattern)), "&")
    return F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def _lower_origin(url: Column) -> Column:
    origin = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    return F.concat(F.lower(origin), F.substring(url, F.length(origin) + 1, F.length(url)))


def normalize_url(url: Column) -> Column:
    """K1: no fragment, tracking parameters or trailing slash; scheme and host in lower case."""
    bare = _query_without(F.split_part(F.trim(url), F.lit("#"), F.lit(1)), TRACKING, False)
    return F.regexp_replace(_lower_origin(bare), "/+$", "")


def strip_secrets(url: Column) -> Column:
    """K3: no credential parameters, user information or fragment."""
    bare = _query_without(F.split_part(url, F.lit("#"), F.lit(1)), SECRETS, True)
    return F.regexp_replace(bare, "^([A-Za-z][A-Za-z0-9+.-]*://)[^/?@]*@", "$1")


def domain(url: Column) -> Column:
    """K4: host in lower case without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def document_identity(url: Column) -> Column:
    """Lower case, neither query nor fragment nor trailing slash."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[^?#]*", 0)), "/+$", "")


def normalize_title(title: Column) -> Column:
    """K2: lower case, anything but ASCII letters and digits a space, single spaces."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def tokens(text: Column, longer_than: int = 2) -> Column:
    """K8: distinct tokens of ASCII letters and digits, in order of first appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) > longer_than))


def contains_word(text: Column, word: str) -> Column:
    """K6: the word between boundaries, in any case."""
    quoted = "".join(c if c.isalnum() else "\\" + c for c in word)
    return F.coalesce(text.rlike(rf"(?i)\b{quoted}\b"), F.lit(False))


def contains_phrase(text: Column, phrase: str) -> Column:
    """K7: the phrase as whole words of a normalised text."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {phrase} "))


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the (lower-cased) text."""
    return sum((F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words[1:]), F.when(F.contains(text, F.lit(words[0])), 1).otherwise(0))


def classify(text: Column, financial: list[str], risk: list[str], business: list[str]) -> Column:
    """Financial if it has as many keywords as risk or more, else risk if any, else business; general without any."""
    low = F.lower(text)
    f, r, b = hits(low, financial), hits(low, risk), hits(low, business)
    return F.when((f >= 1) & (f >= r), "financial").when(r >= 1, "risk").when(b >= 1, "business").otherwise("general")


def language(text: Column, hints: dict[str, list[str]], least: int = 3, scan: int = 4000, shortest: int = 40) -> Column:
    """K10, the content's part: the language with the most distinct hint words between spaces in the first `scan` characters, in table
    order on ties; null (inconclusive) with fewer than `least`, or for a short text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    low = F.concat(F.lit(" "), F.lower(F.substring(bare, 1, scan)), F.lit(" "))
    counts = {lang: hits(low, [f" {w} " for w in ws]) for lang, ws in hints.items()}
    most = F.greatest(*counts.values())
    out = F.when((F.length(bare) < shortest) | (most < least), F.lit(None).cast("string"))
    for lang, n in counts.items():
        out = out.when(n == most, lang)
    return out


def language_or_hint(content: Column, hint: Column, supported: list[str]) -> tuple[Column, Column]:
    """(language, whether the content told it): the content's language, else the hint's first two letters if supported, else English."""
    code = F.substring(F.lower(F.trim(hint)), 1, 2)
    return F.coalesce(content, F.when(code.isin(supported), code), F.lit("en")), content.isNotNull()


def number(raw: Column) -> Column:
    """The last of comma and dot is the decimal point; one comma with three digits after it groups; null if not a number."""
    s = F.regexp_replace(F.trim(raw), r"[\s ']", "")
    comma, dot = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))), F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    european = F.regexp_replace(F.replace(s, F.lit("."), F.lit("")), ",", ".")
    plain = F.replace(s, F.lit(","), F.lit(""))
    both = F.when(F.locate(",", F.reverse(s)) < F.locate(".", F.reverse(s)), european).otherwise(plain)
    one = F.when(s.rlike(r"^[+-]?\d{1,3},\d{3}$") | (comma > 1), plain).otherwise(F.regexp_replace(s, ",", "."))
    return F.when((comma > 0) & (dot > 0), both).when(comma > 0, one).when(dot > 1, F.replace(s, F.lit("."), F.lit(""))).otherwise(s).try_cast("double")


def years(text: Column) -> Column:
    """All years from 1990 to 2099 in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(?:199\d|20\d\d)\b"), F.lit(0)), lambda y: y.cast("int"))


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-1 of the trimmed text in lower case."""
    return F.substring(F.sha1(F.lower(F.trim(text)).cast("binary")), 1, 16)


def cik(raw: Column) -> Column:
    """Ten digits; an optional prefix goes; null unless 1 to 9,999,999,999."""
    digits = F.regexp_replace(F.upper(F.trim(raw)), "^CIK", "")
    value = F.when(digits.rlike(r"^\d{1,10}$"), digits.cast("long"))
    return F.when(value >= 1, F.lpad(value.cast("string"), 10, "0"))


def accession(raw: Column) -> Column:
    """18 digits written 10-2-6, else null."""
    d = F.regexp_replace(raw, r"\D", "")
    return F.when(F.length(d) == 18, F.concat_ws("-", F.substring(d, 1, 10), F.substring(d, 11, 2), F.substring(d, 13, 6)))


def item_codes(raw: Column) -> Column:
    """The codes of a list without the word Item."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?i)\bitem\b", ""), ","), lambda x: F.trim(x)), lambda x: x != "")


def date_of(raw: Column) -> Column:
    """A date from ISO text or an RFC 822 stamp, null otherwise."""
    rfc = F.try_to_timestamp(F.regexp_extract(raw, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), F.lit("d MMM yyyy")).cast("date")
    return F.coalesce(F.substring(raw, 1, 10).try_cast("date"), rfc)


def http_class(code: Column) -> Column:
    """K35."""
    return F.when(code.between(100, 599), F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))).otherwise("unknown")


def slug(text: Column) -> Column:
    """K34."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def money(value: Column) -> Column:
    """Millions with two places and grouping."""
    return F.when(value.isNotNull(), F.concat(F.format_number(value, 2), F.lit("m")))


def scale(word: Column) -> Column:
    """K14."""
    w = F.lower(word)
    return F.when(w.rlike("^(tn|trillion)"), 1e12).when(w.rlike("^(bn|billion)"), 1e9).when(w.rlike("^(mn|m$|million)"), 1e6).when(w.rlike("^(k$|thousand)"), 1e3)


def provenance(is_mock: Column, real_evidence: Column) -> Column:
    """K36."""
    return F.when(is_mock, "mock").when(real_evidence, "real").otherwise("unknown")


def redact(text: Column) -> Column:
    """K5: credentials in free text become ***."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?i)\b({SECRETS})\s*[=:]\s*[^\s&]+", "$1=***"), r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]+=*", "bearer ***")


def by_domain(host: Column, table: dict) -> Column:
    """What a table has for a host or for the nearest domain above it; null for none. Labels are compared whole."""
    labels = F.split(F.lower(host), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.get(F.filter(F.transform(above, lambda d: F.element_at(known, d)), lambda v: v.isNotNull()), 0)
