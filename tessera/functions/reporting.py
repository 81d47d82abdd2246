"""The vocabulary of financial reports, and column functions on it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What results depend on. Phrases of each figure in running text, in lower case.
MONEY_LABELS = {
    "revenue": ["revenue", "net sales", "total sales", "sales", "turnover"],
    "recurring_operating_profit": ["recurring operating profit", "recurring operating income", "recurring operating result", "profit from recurring operations"],
    "operating_profit": ["operating profit", "operating income", "operating result", "ebit"],
    "net_income": ["net income", "net profit", "profit attributable", "net result", "profit for the year"],
    "operating_free_cash_flow": ["operating free cash flow"],
    "free_cash_flow": ["free cash flow"],
    "operating_cash_flow": ["cash flow from operations", "operating cash flow", "cash flows from operating activities", "net cash flows from operating activities"]
    + [f"{net}cash {flow}{made}from operating activities" for net in ("", "net ") for flow in ("", "flow ") for made in ("", "generated ", "provided ")],
    "total_assets": ["total assets"],
    "total_debt": ["total debt", "gross debt", "total borrowings", "gross borrowings"],
    "net_debt": ["net debt", "net financial debt"],
    "cash": ["cash and cash equivalents"],
    "net_cash": ["net cash position", "net cash"],
    "total_equity": [f"{owners}{mark} equity" for owners in ("total shareholders", "total stockholders", "shareholders") for mark in ("", "'", "’")] + ["total equity"],
}
PERCENT_LABELS = {"recurring_operating_margin": ["recurring operating margin"], "operating_margin": ["operating margin"]}
#: Phrases that begin like a label and mean something else.
NOT_LABELS = ["ebitda"] + [f"net cash {w}" for w in ("flow", "inflow", "outflow", "generated", "provided", "from", "and")]
#: Figures that only tables have.
TABLE_LABELS = {
    "short_term_debt": ["short-term debt", "short term debt", "short-term borrowings", "short term borrowings"],
    "long_term_debt": ["long-term debt", "long term debt", "long-term borrowings", "long term borrowings"],
    "total_current_assets": ["total current assets", "current assets"],
    "total_non_current_assets": ["total non-current assets", "non-current assets", "total non current assets", "non current assets"],
    "total_liabilities": ["total liabilities"],
    "employees": ["employees", "headcount", "full-time equivalents", "full time equivalents"],
}
#: A phrase right after one of these is another figure's.
GUARDS = {"revenue": ["of "], "operating_profit": ["recurring "], "free_cash_flow": ["operating "], "operating_margin": ["recurring "], "total_current_assets": ["non-", "non "]}
CURRENCIES = {
    "euro": "EUR", "euros": "EUR", "eur": "EUR", "€": "EUR", "swiss franc": "CHF", "swiss francs": "CHF", "chf": "CHF", "sterling": "GBP", "pound": "GBP", "pounds": "GBP", "gbp": "GBP", "£": "GBP",
    "danish krone": "DKK", "kroner": "DKK", "dkk": "DKK", "us dollar": "USD", "us dollars": "USD", "usd": "USD", "dollars": "USD", "$": "USD",
}
SCALES = {"thousand": "thousand", "million": "million", "mn": "million", "m": "million", "billion": "billion", "bn": "billion"}
FACTORS = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
SEGMENT_MARKS = ["segment", "by business", "by division", "by region", "reportable segment", "operating segment", "business area", "business group", "business unit"]
GROUP_MARKS = ["consolidated", "group"]

_SYMBOLS = [c for c in CURRENCIES if not c.isalpha() and " " not in c]
_CURRENCY = re.compile("|".join([re.escape(c) for c in _SYMBOLS] + [rf"(?<![a-z]){c}(?![a-z])" for c in sorted(set(CURRENCIES) - set(_SYMBOLS), key=len, reverse=True)]))
_RANK = {c: i for i, c in enumerate(CURRENCIES)}


def currency_of(text: str) -> str | None:
    """The currency that a text names: of several, the first in the table."""
    found = {m.group() for m in _CURRENCY.finditer(text.lower())}
    return CURRENCIES[min(found, key=_RANK.__getitem__)] if found else None


def _some_currency(low: Column) -> Column:
    """Whether a text in lower case has one of the words, perhaps as part of another: plain searches."""
    stems = [c for c in CURRENCIES if not any(o != c and o in c for o in CURRENCIES)]
    return reduce(lambda x, y: x | y, (F.contains(low, F.lit(c)) for c in stems))


def _some_scale(low: Column) -> Column:
    return reduce(lambda x, y: x | y, (F.contains(low, F.lit(w)) for w in SCALES if w != "m")) | low.rlike("(?<![a-z])m(?![a-z0-9_])")


def first_currency(texts: Column) -> Column:
    """The currency of the first text of an array that names one."""
    return _first(texts, _some_currency, currency)


def first_scale(texts: Column) -> Column:
    """The scale of the first text of an array that states one."""
    return _first(texts, _some_scale, scale)


def _first(texts: Column, some, of) -> Column:
    low = F.filter(F.transform(texts, lambda t: F.lower(t)), some)  # functions in lambdas share nothing, so each text is lower-cased once
    return F.get(F.filter(F.transform(low, of), lambda x: x.isNotNull()), 0)


def currency(text: Column) -> Column:
    """currency_of() as a column function."""
    low = F.lower(text)
    out = F.when(~_some_currency(low), F.lit(None).cast("string"))
    for word, code in CURRENCIES.items():
        out = out.when(text.contains(word) if word in _SYMBOLS else low.rlike(rf"(?<![a-z]){word}(?![a-z])"), code)
    return out


def scale(text: Column) -> Column:
    """The first scale word of a text, as thousand, million or billion."""
    low = F.lower(text)
    word = F.regexp_extract(low, rf"(?<![a-z])({'|'.join(sorted(SCALES, key=len, reverse=True))})s?(?![a-z0-9_])", 1)
    return F.when(_some_scale(low), F.element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), F.nullif(word, F.lit(""))))


def row_label(cell: Column) -> Column:
    """The one figure that a table row's first cell names; null for none and for several."""
    low, found = F.lower(cell), []
    for name, phrases in (MONEY_LABELS | PERCENT_LABELS | TABLE_LABELS).items():
        words = [p for p in phrases if p != "sales"]
        guard = "".join(f"(?<!{g})" for g in GUARDS.get(name, []) if name != "revenue")
        tail = "(?![a-z])" if "ebit" in words else rf"(?!\s*(?:{'|'.join(x.removeprefix('net cash ') for x in NOT_LABELS if x.startswith('net cash'))}))" if name == "net_cash" else ""
        hit = low.rlike(guard + "(?:" + "|".join(re.escape(p) for p in sorted(words, key=len, reverse=True)) + ")" + tail)
        if name == "total_equity":
            hit = hit | low.rlike(r"^\s*equity\s*$")
        if name == "net_cash":
            hit = low.contains("net cash position") | hit
        found.append(F.when(hit, name))
    labels = F.array_compact(F.array(*found))
    return F.when(F.size(labels) == 1, F.get(labels, 0))


def heading_scope(heading: Column, above: Column) -> Column:
    """A heading that marks segments is the scope itself, one that marks the whole company is `group`; below a heading that marks
    segments any heading is the scope. A scope has at most 80 characters, a longer one ends in an ellipsis."""
    marked = lambda c, marks: F.coalesce(F.lower(c).rlike("|".join(marks)), F.lit(False))
    plain = F.trim(heading)
    label = F.when(F.length(plain) > 80, F.concat(F.rtrim(F.substring(plain, 1, 79)), F.lit("…"))).otherwise(plain)
    return F.when(F.coalesce(heading, F.lit("")) == "", F.lit(None)).when(marked(heading, SEGMENT_MARKS), label).when(marked(heading, GROUP_MARKS), "group").when(marked(above, SEGMENT_MARKS), label)
