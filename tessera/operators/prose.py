"""Figures that running text states: a label, and in the same clause its value, read token by token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import reporting as R

#: Words between a label and its value.
RISES = ["rose", "grew", "grow", "increased", "increase", "fell", "fall", "declined", "decline", "decreased", "decrease", "dropped", "drop", "climbed", "slipped", "improved", "improve", "was up", "were up", "was down", "were down"]
CONNECTORS = ["of", "was", "were", "to", "at", "amounted to", "reached", "totalled", "totaled", "stood at", ":"]
BREAKS = {".", "!", "?", ";", "\n", "but", "while", "whereas", "however", "although", "yet", "whilst"}
PERIODS = ["fiscal year", "financial year", "fiscal", "year", "period", "half-year", "half year", "h1", "h2"]
ORDINALS, PARTS = ["first", "second", "third", "fourth"], ["half", "quarter"]
REPORT_VERBS = ["reported", "generated", "posted", "recorded", "delivered", "achieved", "announced"]
STATE_VERBS = ["were", "was", "have", "has", "remained", "continued"]
NO_SCOPES = {
    "revenue", "sales", "net sales", "total sales", "turnover", "operating profit", "operating income", "operating result", "recurring operating profit", "net income", "net profit", "profit", "margin", "operating margin",
    "cash flow", "free cash flow", "operating free cash flow", "operating cash flow", "total assets", "total debt", "net debt", "net cash", "cash and cash equivalents", "total equity", "management", "the board", "results", "performance",
    "the company", "company",
}
YEAR_CUES = ["fiscal year", "financial year", "year ended", "for the year", "as at 31", "as of 31", "annual report"]
CURRENCY_CUES = ["in millions", "reporting currency", "in thousands", "in eur", "in chf"]
STAFF_AFTER, STAFF_BEFORE = ["employees", "people employed", "staff", "full-time equivalents"], ["employs", "employed", "employ", "workforce of", "headcount of"]

GAP, AROUND, CUE = 25, 120, 40  # characters between label and value, around a label where its year stands, after a cue of the fiscal year
DIGITS = "\\d(?:[\\d.,   ]*\\d)?"
TOKEN = re.compile(rf"\n|{DIGITS}|[hH][12](?!\w)|[^\W\d_]+|[^\w\s]|_")
YEAR = re.compile(r"(?<!\w)(?:19|20)\d\d(?!\w)")
SENTENCE = re.compile(r"[.!?\n]")
_either = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
_REPORTED = re.compile(rf"(?<!\w)(?:{_either(REPORT_VERBS)})(?!\w)")
_STATED = re.compile(rf"(?<!\w)[Tt]he\s+([A-Z][A-Za-z0-9&,.\-\s]{{1,60}}?)\s+(?:{_either(STATE_VERBS)})(?!\w)")
_NAME = re.compile(r"[A-Z][A-Za-z0-9&,.\-\s]{1,60}")
_MONEY_CUE = re.compile(f"(?i)(?:{_either(CURRENCY_CUES)})(?!\\w)")
_CUE, _STAFF = re.compile(f"(?i)(?:{_either(YEAR_CUES)})"), re.compile(f"(?i)({DIGITS})\\s+(?:{_either(STAFF_AFTER)})|(?<!\\w)(?:{_either(STAFF_BEFORE)})\\s+(?:approximately\\s+)?({DIGITS})")


class Mention(NamedTuple):
    label: str
    start: int
    end: int
    raw: str
    value: float | None
    unit: str
    scale: str | None
    currency: str | None
    strong: bool  # has a scale or a currency of its own
    period: str | None
    scope: str | None


def number(raw: str) -> float | None:
    """K13, as functions.text.number has it."""
    s = "".join(c for c in raw if not c.isspace())
    comma, dot = s.rfind(","), s.rfind(".")
    if comma >= 0 and dot >= 0:
        s = s.replace(".", "").replace(",", ".") if comma > dot else s.replace(",", "")
    elif comma >= 0:
        s = s.replace(",", "") if s.count(",") > 1 or re.fullmatch(r"\d{1,3},\d{3}", s) else s.replace(",", ".")
    elif s.count(".") > 1:
        s = s.replace(".", "")
    try:
        return float(s)
    except ValueError:
        return None


def sentence_around(text: str, at: int) -> str:
    """The sentence that holds a place."""
    start = max(text.rfind(c, 0, at) for c in ".!?\n") + 1
    end = SENTENCE.search(text, at)
    return text[start : end.end() if end else len(text)]


def scope_of(sentence: str) -> str | None:
    """Whose figure a sentence states, by its subject: what reports ("The Group's Watches reported"), or the named subject of
    "their"; `group` for the group itself and where a sentence only speaks of it; None where nothing is said."""

    def named(subject: str) -> str | None:
        name = " ".join(subject.split()).strip(" .,")
        low = name.lower()
        if low in ("group", "the group") or "consolidated" in low:
            return "group"
        return None if not name or low in NO_SCOPES else name if len(name) <= 80 else name[:79].rstrip() + "…"

    verb = _REPORTED.search(sentence)
    if verb:
        subject = sentence[: verb.start()].strip()
        owner = max(subject.rfind("Group's "), subject.rfind("Group’s "))
        own = subject[owner + 8 :].strip() if owner >= 0 and (owner == 0 or not subject[owner - 1].isalnum()) else ""
        if _NAME.fullmatch(own):
            name = named(own)
            if name and name != "group":
                return name
        if subject.startswith("The "):
            subject = subject[4:].strip()
        if _NAME.fullmatch(subject):
            name = named(subject)
            if name:
                return name
    state = _STATED.search(sentence)
    if state and re.search(r"(?<!\w)their(?!\w)", sentence[state.end() : state.end() + 66]):
        name = named(state.group(1))
        if name:
            return name
    low = re.sub(r"\bpeer[\s-]groups?\b", " ", sentence.lower())
    if not any(m in low for m in R.SEGMENT_MARKS) and any(m in low for m in R.GROUP_MARKS):
        return "group"
    return None


class Scanner:
    """Reads a text once. Labels are found longest first, so that one that holds another stands for itself; from each the tokens are
    followed: perhaps a period, a change ("rose by 3% at constant exchange rates"), a connector, then at most GAP characters
    of the same clause without another label up to a number. What a period or a change has taken is never the value."""

    def __init__(self, money: dict[str, list[str]] | None = None, percent: dict[str, list[str]] | None = None, guards: dict[str, list[str]] | None = None):
        default = money is None and percent is None
        self.money, self.percent = (R.MONEY_LABELS, R.PERCENT_LABELS) if default else (money or {}, percent or {})
        self.guards = R.GUARDS if guards is None else guards
        self.name = {p: n for labels in (self.money, self.percent) for n, ps in labels.items() for p in ps} | ({p: "" for p in R.NOT_LABELS} if default else {})
        self.label = re.compile(rf"(?i)(?<!\w)({_either(self.name)})s?(?!\w)")
        self.words = sorted({max(p.split(), key=len) for p in self.name})  # a text with a label has one of them
        self.other = default  # also the fiscal year, the currency of the report and the staff

    @staticmethod
    def _phrase(tokens: list[re.Match], i: int, phrases: list[str]) -> int:
        """The place after the longest of the phrases that stands at i, else i."""
        for phrase in sorted(phrases, key=len, reverse=True):
            words = re.findall(r"\w+|\S", phrase)
            if [t.group().lower() for t in tokens[i : i + len(words)]] == words:
                return i + len(words)
        return i

    def _period(self, tokens: list[re.Match], i: int) -> int:
        word = lambda j: tokens[j].group().lower() if j < len(tokens) else ""
        year = lambda j: bool(YEAR.fullmatch(word(j)))
        if word(i) not in ("for", "in", "during"):
            return i
        j = i + 2 if word(i + 1) == "the" else i + 1
        if word(j) in ORDINALS and word(j + 1) in PARTS and word(j + 2) == "of" and year(j + 3):
            return j + 4
        if year(j):
            return j + 1
        k = self._phrase(tokens, j, PERIODS)
        if k == j:
            return i
        k += word(k) == "ended"
        return k + year(k)

    def _change(self, tokens: list[re.Match], i: int, units: tuple[str, ...]) -> int:
        j = self._phrase(tokens, i, RISES)
        if j == i or j >= len(tokens):
            return i
        j += tokens[j].group().lower() == "by"
        if j >= len(tokens) or not tokens[j].group()[0].isdigit():
            return i
        k = self._phrase(tokens, j + 1, list(units))
        if k == j + 1:
            return i
        return self._phrase(tokens, k, ["at constant exchange rates", "at actual exchange rates"])

    def _value(self, text: str, m: re.Match, name: str, labels: list[int]) -> tuple[int, str, str | None] | None:
        """(end, digits, scale word) of the value of the label that m found."""
        money, tokens = name in self.money, []
        for t in TOKEN.finditer(text, m.end()):  # as far as anything can reach
            if t.group() == "\n":
                break
            tokens.append(t)
            if len(tokens) >= 60:
                break
        i = self._period(tokens, 0)
        i = self._change(tokens, i, ("%",) if money else ("%", "percentage points", "percentage point", "basis points", "basis point"))
        i = self._phrase(tokens, i, CONNECTORS)
        begin = tokens[i - 1].end() if i else m.end()
        for j in range(i, len(tokens)):
            t = tokens[j]
            word = t.group().lower()
            if word[0].isdigit():
                gap = text[begin : t.start()].rstrip()
                after = text[t.end() : t.end() + 8].lstrip(" \t")
                if len(gap.rstrip("€£$" if money else "")) > GAP:
                    return None
                if not money:
                    return (text.index("%", t.end()) + 1, t.group(), None) if after.startswith("%") else None
                k = tokens[j + 1] if j + 1 < len(tokens) else None
                word = R.SCALES.get(k.group().lower()) if k else None
                if word and not text[t.end() : k.start()].strip():
                    return (k.end(), t.group(), word) if not text[k.end() : k.end() + 8].lstrip(" \t").startswith("%") else None
                return (t.end(), t.group(), None) if not after.startswith("%") else None
            if word in BREAKS or t.start() in labels or t.start() - begin > GAP or (not money and word == "%"):
                return None
        return None

    def mentions(self, text: str) -> list[Mention]:
        """Every label with a value in its clause, by place."""
        low = text.lower()
        found = [m for m in self.label.finditer(text)] if any(w in low for w in self.words) else []
        out: list[Mention] = []
        years = [y.start() for y in YEAR.finditer(text)] if found else []
        whole: list[str | None] = []  # the currency of the text, once it is asked for

        def around() -> str | None:
            if not whole:
                whole.append(R.currency_of(text))
            return whole[0]

        def period(at: int) -> str | None:
            near = [y for y in years if at - AROUND <= y and y + 4 <= at + AROUND]
            y = min(near, key=lambda y: (abs(y - at), y)) if near else years[0] if years else None
            return None if y is None else text[y : y + 4]

        starts = [m.start() for m in found if self.name[m.group(1).lower()]]
        for m in found:
            name = self.name[m.group(1).lower()]
            if not name or any(text[: m.start()][-len(g) :].lower() == g for g in self.guards.get(name, [])):
                continue
            value = self._value(text, m, name, starts)
            if value is None or number(value[1]) is None:
                continue
            end, digits, scale = value
            raw = text[m.start() : end]
            unit = "currency_amount" if name in self.money else "percent"
            own = R.currency_of(raw) if unit == "currency_amount" else None
            money = (own or around()) if unit == "currency_amount" else None
            out.append(Mention(name, m.start(), end, raw, number(digits), unit, scale, money, unit == "percent" or bool(scale or own), period(m.start()), scope_of(sentence_around(text, m.start()))))
        if self.other:
            out += self._others(text, low, around)
        return sorted(out, key=lambda x: (x.start, x.label))

    def _others(self, text: str, low: str, around) -> Iterator[Mention]:
        cue = _MONEY_CUE.search(text) if any(c in low for c in CURRENCY_CUES) else None
        if cue and around():
            yield Mention("reporting_currency", cue.start(), cue.end(), around(), None, "code", None, around(), True, None, None)
        for m in _CUE.finditer(text) if any(c in low for c in YEAR_CUES) else ():
            y = YEAR.search(text, m.end(), m.end() + CUE + 5)
            if y and "\n" not in text[m.end() : y.start()] and y.start() - m.end() <= CUE:
                yield Mention("fiscal_year", m.start(), y.end(), y.group(), float(y.group()), "year", None, None, True, y.group(), None)
                break
        for m in _STAFF.finditer(text) if any(c in low for c in (*STAFF_AFTER, *STAFF_BEFORE)) else ():
            n = number(m.group(1) or m.group(2))
            if n is not None and n >= 10:
                yield Mention("employees", m.start(), m.end(), m.group(1) or m.group(2), n, "people", None, None, True, None, None)
                break


_KINDS = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("raw", pa.string()), ("value", pa.float64()), ("unit", pa.string()), ("scale", pa.string()), ("currency", pa.string()), ("strong", pa.bool_()), ("period", pa.string()), ("scope", pa.string())])
_DDL = "array<struct<label:string,start:int,end:int,raw:string,value:double,unit:string,scale:string,currency:string,strong:boolean,period:string,scope:string>>"


def mentions(df: DataFrame, keys: list[str], text_col: str, scanner: Scanner | None = None) -> DataFrame:
    """Keys and each label with a value in its clause: start, end (characters), raw, value, unit, scale, currency, strong
    (a scale or a currency of its own; else the currency is the text's), period (the nearest year within AROUND characters,
    else the text's first) and scope (of its sentence). A null or empty text has none; keys may repeat and be null.
    """
    scan = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[m._asdict() for m in scan.mentions(t.as_py() or "")] for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__k{i}") for i in range(len(keys))), pa.array(found, pa.list_(_KINDS))], names=[*(f"__k{i}" for i in range(len(keys))), "__found"])

    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    schema = ", ".join(f"__k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    rows = df.select(*named, F.col(text_col).alias("__text")).mapInArrow(run, f"{schema}, __found {_DDL}").filter(F.size("__found") > 0)
    return rows.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], F.inline("__found"))


def settled(found: DataFrame, keys: list[str]) -> DataFrame:
    """One fact of each label in a text (keys), or none: refused are two values (of money, two that have a scale or a currency of
    their own), and money without any scale and currency. A mention with its own scale or currency comes before one without,
    then the first. confidence is high with scale and currency, and for what has no currency."""
    w = [c for c in ("label", "start", "end", "raw", "value", "unit", "scale", "currency", "strong", "period", "scope") if c not in keys]
    counted = F.when(F.col("strong"), F.col("value"))
    best = F.min_by(F.struct(*[c for c in w if c != "label"]), F.struct(~F.col("strong"), F.col("start")))
    g = found.groupBy(*keys, "label").agg(F.min(counted).alias("__low"), F.max(counted).alias("__high"), best.alias("__best"))
    g = g.filter("__low IS NULL OR __low = __high").select(*keys, "label", "__best.*").filter("unit <> 'currency_amount' OR scale IS NOT NULL OR currency IS NOT NULL")
    return g.withColumn("confidence", F.when((F.col("unit") != "currency_amount") | (F.col("scale").isNotNull() & F.col("currency").isNotNull()), F.when(F.col("unit") == "people", "medium").otherwise("high")).otherwise("medium"))
