"""Personal data: base patterns, and terms that give the persons away by their co-occurrence in the corpus."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, kept_numbers, numbered, stored

KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # starts at the first digit only: no other start can match earlier
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
FILTER_BITS, FLUSH = 22, 300_000


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; of each kind the leftmost matches that don't overlap, less those that fail its test."""
    found, free = [], 0
    for m in DOMAIN.finditer(text):  # an address ends with this; its local part is the run before it
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            free = m.end()
    for m in IP.finditer(text):
        if all(int(x) <= 255 for x in (p.lstrip("0")[:4] or "0" for p in m.group().split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def contexts(text: str, spans: list[tuple[int, int, int]], near: int, reach: int) -> list[tuple[str, str]]:
    """(entity, term) of the `near` whole words on either side of each span, within `reach` characters; (entity, "") for the span."""
    out, taken = [], [(s, e) for s, _, e in spans]
    for start, kind, end in spans:
        entity = f"{KINDS[kind]}:{text[start:end].lower()}"
        out.append((entity, ""))
        low, high = max(0, start - reach), min(len(text), end + reach)
        before = [m for m in TERM.finditer(text, low, start) if m.start() > low or low == 0][-near:]
        after = [m for m in TERM.finditer(text, end, high) if m.end() < high or high == len(text)][:near]
        close = [(s, e) for s, e in taken if s < high and e > low]
        out += [(entity, m.group().lower()) for m in before + after if all(m.end() <= s or m.start() >= e for s, e in close)]
    return out


def _detected(docs: DataFrame, id_col: str, text_col: str, near: int, reach: int) -> DataFrame:
    """RID, id, base spans, pairs (entity, term) near them, and the text of documents that have any."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    pair = pa.struct([("entity", pa.string()), ("term", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, around, texts = [], [], []
            for text in batch.column("text"):
                t = text.as_py() or ""
                spans = base_spans(t)
                found.append([dict(zip(("start", "kind", "end"), s)) for s in spans])
                around.append([dict(zip(("entity", "term"), c)) for c in dict.fromkeys(contexts(t, spans, near, reach))] if spans else [])
                texts.append(t if spans else None)
            yield pa.RecordBatch.from_arrays([batch.column(RID), batch.column("id"), pa.array(found, pa.list_(span)), pa.array(around, pa.list_(pair)), pa.array(texts, pa.string())], names=[RID, "id", "base", "near", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return numbered(docs).select(RID, F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"{RID} long, id {kind}, base array<struct<start:int,kind:int,end:int>>, near array<struct<entity:string,term:string>>, text string")


def _filter(terms: DataFrame):
    """A broadcast bit filter of fixed size (2**FILTER_BITS bits) of the terms: false positives cost rows and nothing else."""
    bit = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = terms.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).collect()
    bits = np.zeros(1 << FILTER_BITS >> 6, np.int64)
    for w, b in words:
        bits[w] = b
    return terms.sparkSession.sparkContext.broadcast(bits.tobytes())


def _passes(bits: bytes, term: str) -> int:
    h = zlib.crc32(term.encode()) & ((1 << FILTER_BITS) - 1)
    return bits[h >> 3] >> (h & 7) & 1


def _frequencies(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(term, n_t): documents of all docs with the term. Python sends only terms that pass the filter; the join makes the counts exact."""
    held = _filter(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts = held.value, Counter()

        def flush() -> pa.RecordBatch:
            kept = [(t, n) for t, n in counts.items() if _passes(bits, t)]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column("text"):
                counts.update(set(TERM.findall((text.as_py() or "").lower())))
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term string, n long")
    return counted.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_t"))


def _occurrences(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(RID, term, start, end): every occurrence, outside the base spans, of terms that pass the filter in documents that have spans."""
    held = _filter(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = held.value, {}
        for batch in batches:
            rows, out = batch.column(RID).to_pylist(), []
            for row, spans, text in zip(rows, batch.column("base"), batch.column("text")):
                taken, at = sorted((s["start"], s["end"]) for s in spans.as_py()), 0
                for m in TERM.finditer(text.as_py()):
                    while at < len(taken) and taken[at][1] <= m.start():
                        at += 1
                    term = m.group().lower()
                    if term not in known:
                        if len(known) > FLUSH:
                            known.clear()
                        known[term] = _passes(bits, term)
                    if known[term] and all(m.end() <= s or m.start() >= e for s, e in taken[at : at + 4]):
                        out.append((row, term, m.start(), m.end()))
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=[RID, "term", "start", "end"])

    return found.filter("text is not null").select(RID, "base", "text").mapInArrow(run, f"{RID} long, term string, start int, end int").join(terms, "term", "left_semi")


def detect(docs: DataFrame, support: int = 3, threshold: float = 0.8, certain: float = 0.99, near: int = 8, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: RID, id, base and spans, arrays of (start, kind, end) with kind an index of KINDS.

    base has the patterns' matches. A protected entity is a value matched; the terms within `near` words of it (and `reach`
    characters, which bounds what a page of digits costs) are candidates. With n_c, n_t and n_ct the documents having the
    entity, the term, and the term near the entity, of D: PMI = log2(n_ct D / (n_c n_t)), information of the entity =
    log2(D / n_c). A term with n_ct >= support and PMI >= threshold * information discloses the entity, so an entity in under
    `support` documents has no such terms. In every document that holds the entity all occurrences of the term, near or far, are
    spans to generalise, from `certain` on to remove. All counts are over all documents. Documents without base spans get none.

    Null texts are empty. Ids may be null or repeat. Empty table, empty result. RID is as in exact_groups.
    """
    found = stored(_detected(docs, id_col, text_col, near, reach), "detected", "zstd")
    pairs_of = found.select(RID, F.inline("near"))
    holds = pairs_of.filter("term = ''").select(RID, "entity")
    pairs = stored(pairs_of.filter("term <> ''").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct")).filter(F.col("n_ct") >= support), "pairs")
    plain = found.select(RID, F.col("id").alias(id_col), "base", F.col("base").alias("spans"))
    if pairs.isEmpty():
        return plain
    size = found.count()
    n_c = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    information = F.log2(F.lit(float(size)) / F.col("n_c"))
    pmi = F.log2(F.col("n_ct") * float(size) / (F.col("n_c") * F.col("n_t")))
    told = pairs.join(_frequencies(docs, stored(pairs.select("term").distinct(), "terms"), text_col), "term").join(n_c, "entity").filter(information > 0).withColumn("share", pmi / information).filter(F.col("share") >= threshold)
    told = stored(told.select("entity", "term", F.when(F.col("share") >= certain, KINDS.index("remove")).otherwise(KINDS.index("generalise")).alias("kind")), "told")
    if told.isEmpty():
        return plain
    at = _occurrences(found, stored(told.select("term").distinct(), "terms"))
    gives = holds.join(told, "entity").groupBy(RID, "term").agg(F.max("kind").alias("kind"))  # a row for each document and term, however many entities
    more = at.join(gives, [RID, "term"]).groupBy(RID).agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return found.drop("text", "near").join(more, RID, "left").select(RID, F.col("id").alias(id_col), "base", spans.alias("spans"))


def written(spans: str):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans."""
    name = options.get("id_col", "doc_id")
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{KINDS[k]}")
    return detect(docs, **options).select(name, *[count(k) for k in range(4)], F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """docs with base spans replaced by [KIND]; disclosing terms are generalised to all words with their initial ("W…"), which many
    documents share, or removed where the disclosure is certain.

    Other columns stay, whatever their names; null texts stay null. Repeated rows and ids each keep their row."""
    text = options.get("text_col", "text")
    columns, docs = docs.columns, kept_numbers(docs)
    spans = detect(docs, **options).filter(F.size("spans") > 0).select(RID, F.col("spans").alias("__spans"))

    def step(acc, s):
        # overlapping spans: what an earlier one has covered isn't written again
        skip = F.greatest(s.start, acc.at)
        tag = F.when(s.kind == KINDS.index("remove"), F.lit("")).when(s.kind == KINDS.index("generalise"), F.concat(F.substring(F.col(text), s.start + 1, F.lit(1)), F.lit("\u2026"))).otherwise(F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)), F.lit("]")))
        return F.struct(
            F.when(s.end <= acc.at, acc.out).otherwise(F.concat(acc.out, F.substring(F.col(text), acc.at + 1, skip - acc.at), F.when(s.start >= acc.at, tag).otherwise(F.lit("")))).alias("out"), F.greatest(s.end, acc.at).alias("at")
        )

    joined = docs.join(spans, RID, "left")
    done = F.aggregate("__spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc.out, F.substring(F.col(text), acc.at + 1, F.length(text))))
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(done)).select(columns)
