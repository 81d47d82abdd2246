"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RID, kept_numbers, numbered, stored

BUCKETS, PIECE = 1 << 16, 1 << 20
HELD = 32  # languages whose counts a task holds at a time
NO_LANGUAGE, FOLDED = "und", "other"
FITTED = 128  # declared values with a profile of their own: 64 MB of numbers in the driver, half of that in a task


def trigrams(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of the text, A-Z lower-cased, a piece of it at a time; bucket BUCKETS if one is a digit or NUL."""
    data = data.lower()
    for at in range(0, max(0, len(data) - 2), PIECE):
        a = np.frombuffer(data, np.uint8, min(PIECE + 2, len(data) - at), at).astype(np.uint32)
        h = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16)
        digit = ((a >= 48) & (a < 58)) | (a == 0)
        h[digit[:-2] | digit[1:-1] | digit[2:]] = BUCKETS
        yield h


def batches_of(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of rows of together at most `most` bytes, or one longer text."""
    held, first, size = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py() or b""
        if held and size + len(t) > most:
            yield first, held
            held, first, size = [], i, 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def label(docs: DataFrame, declared: str, fitted: int) -> tuple[Column, list[str] | None]:
    """(the label that a row's text is counted under, the values that have their own): the declared value, or FOLDED for all but the
    `fitted` values with most rows; None instead of the values if nothing is folded. Markup of a crawl declares thousands of values,
    most of them mistakes; the fit is bounded by this number, while every row's text is counted and every row judged."""
    value = F.col(declared)
    named = docs.filter(value.isNotNull() & ~value.isin("", NO_LANGUAGE)).groupBy(declared).count()
    most = [r[0] for r in named.orderBy(F.desc("count"), declared).limit(fitted + 1).collect()]
    if len(most) <= fitted:
        return value, None
    kept = [v for v in most[:fitted] if v != FOLDED]
    return F.when(value.isin("", NO_LANGUAGE, *kept), value).when(value.isNotNull(), FOLDED), kept


def profiles(docs: DataFrame, declared: str, text: str) -> tuple[list[str], np.ndarray]:
    """Every label whose rows have trigrams ('' and NO_LANGUAGE are none), and log probabilities of the trigram
    buckets in each, from all rows that have one. A bucket gets half a pseudo-count, less in a language with fewer than
    BUCKETS trigrams: all together at most half of these, so that a small profile isn't nearly uniform and draws no junk.

    A partition sends counts by language and bucket, and holds those of HELD languages at a time; the driver and the scoring
    tasks hold a row of BUCKETS numbers a label, of which label() leaves few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, row in counts.items():
                used = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(row[used])], names=["lang", "bucket", "n"])
            counts.clear()

        for batch in batches:
            labels = batch.column("l").to_pylist()
            for first, texts in batches_of(batch.column("t")):
                for lang in set(labels[first : first + len(texts)]):
                    mine = b"\0\0\0".join(t for t, x in zip(texts, labels[first:]) if x == lang)
                    for h in trigrams(mine):
                        if lang not in counts:
                            if len(counts) == HELD:
                                yield from flush()
                            counts[lang] = np.zeros(BUCKETS, np.int64)
                        counts[lang] += np.bincount(h, minlength=BUCKETS + 1)[:BUCKETS]
        yield from flush()

    rows = docs.select(F.col(declared).cast("string").alias("l"), F.col(text).cast("binary").alias("t")).filter(F.col("l").isNotNull() & ~F.col("l").isin("", NO_LANGUAGE) & F.col("t").isNotNull())
    table = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = table.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns")).orderBy("lang").toArrow()  # at most BUCKETS entries a language
    langs, out = table.column("lang").to_pylist(), np.zeros((len(table), BUCKETS), np.float64)
    for row, buckets, ns in zip(out, table.column("buckets"), table.column("ns")):
        row[buckets.values.to_numpy()] = ns.values.to_numpy()
    total = out.sum(axis=1, keepdims=True)
    out += np.minimum(0.5, 0.5 * total / BUCKETS)
    return langs, np.log(out / out.sum(axis=1, keepdims=True))


def evidence(docs: DataFrame, langs: list[str], logs: np.ndarray, text: str, columns: list[Column], temper: float) -> DataFrame:
    """RID, the given columns, and `told`: for each language, then for no language (uniform trigrams), the log likelihood of the
    text, tempered because trigrams overlap, less the largest. Trigrams with digits or NUL say nothing."""
    uniform = np.full((1, BUCKETS), -np.log(BUCKETS))
    held = docs.sparkSession.sparkContext.broadcast(np.pad(np.concatenate([logs, uniform]), ((0, 0), (0, 1))).astype(np.float32))
    names = [RID, *[f"c{i}" for i in range(len(columns))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(held.value)
        for batch in batches:
            told = np.zeros((batch.num_rows, len(table)), np.float64)
            for first, texts in batches_of(batch.column("t")):
                long = [i for i, t in enumerate(texts) if len(t) > 2]
                if len(texts) == 1:
                    for h in trigrams(texts[0]):
                        told[first] += table[:, h].sum(axis=1, dtype=np.float64)
                elif long:
                    h = np.concatenate(list(trigrams(b"".join(texts[i] for i in long))))
                    ends = np.cumsum([len(texts[i]) for i in long])
                    cuts = np.stack([np.r_[0, ends[:-1]], ends - 2], axis=1).ravel()  # every other run spans two texts
                    cuts = cuts[:-1] if cuts[-1] >= len(h) else cuts
                    for k, row in enumerate(table):
                        told[np.array(long) + first, k] = np.add.reduceat(row[h], cuts, dtype=np.float64)[::2]
            told *= temper
            told -= told.max(axis=1, keepdims=True)
            flat = pa.array(told.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, told.size + 1, told.shape[1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], lists], names=[*names, "told"])

    rows = numbered(docs).select(RID, *[c.alias(n) for c, n in zip(columns, names[1:])], F.col(text).cast("binary").alias("t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, told array<double>")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def markup_language(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute, null if there is none."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    return F.when(found != "", found)


def identify(
    docs: DataFrame, declared: Column, suffix: Column, host: Column, id_col: str = "doc_id", text_col: str = "text", temper: float = 0.3, strength: float = 20.0, unknown: float = 1e-3, least: float = 0.5, fitted: int = FITTED
) -> DataFrame:
    """One row per document: RID, id, language, posterior, text_language, accepted.

    Text: naive Bayes over hashed byte trigrams, trained on all rows by their declared language, those of the rarest values
    together once there are over `fitted`; a row that is best explained by that profile has the language it declares, if that is one of
    these values, else FOLDED. From the texts' own posteriors,
    grouped aggregation gives, without a row's own part in it: how often each declared value and suffix goes with each
    language (likelihoods, smoothed towards independence), and a host's prior, smoothed towards its parent's (the host less its
    first label), that towards all documents' (strength pseudo-counts each). The posterior multiplies text, declared,
    suffix and host evidence; a text that no language explains better than uniform trigrams is NO_LANGUAGE. A row is accepted if
    its language isn't NO_LANGUAGE and has a posterior of at least `least`.

    Null or empty texts, and null declared, suffix and host values, say nothing. With no labelled row at all every
    document is NO_LANGUAGE. Ties go to the first language in order. Ids may be null or repeat. Empty table, empty result.
    """
    labelled = docs.withColumn("__declared", declared.cast("string"))
    of, kept = label(labelled, "__declared", fitted)
    langs, logs = profiles(labelled.withColumn("__declared", of) if kept is not None else labelled, "__declared", text_col)
    k = len(langs)
    parent = F.regexp_extract(host, r"^[^.]+\.(.+)$", 1)
    columns = [F.col(id_col), declared.cast("string"), suffix.cast("string"), host.cast("string"), F.when(parent != "", parent)]
    told = evidence(docs, langs, logs, text_col, columns, temper).toDF(RID, "id", "declared", "suffix", "host", "parent", "told")
    prior = np.log([*[(1 - unknown) / max(1, k)] * k, unknown]).tolist()
    raw = F.transform("told", lambda x, i: F.exp(x + F.element_at(F.array(*map(F.lit, prior)), i + 1)))
    share = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    rows = stored(told.withColumn("raw", raw).withColumn("own", share(F.col("raw"))).drop("raw"), "evidence")

    sums = lambda: F.array(*[F.sum(F.col("own")[i]) for i in range(k + 1)])
    overall = rows.agg(sums().alias("n")).first()[0] or [0.0]
    overall = [x or 0.0 for x in overall] if k or overall else [0.0]
    total = sum(overall)
    base = F.array(*[F.lit((x + 1.0) / (total + k + 1)) for x in overall])
    out = rows
    for name in ("declared", "suffix", "host", "parent"):
        counts = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(sums().alias(f"n_{name}"))
        out = out.join(counts, name, "left")
    others = lambda name: F.when(F.col(f"n_{name}").isNotNull(), F.zip_with(f"n_{name}", "own", lambda n, o: F.greatest(n - o, F.lit(0.0))))
    added = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)

    def smoothed(n: Column, towards: Column) -> Column:
        """Counts n, null for none, as shares with `strength` pseudo-counts in the given shares."""
        return F.coalesce(F.transform(F.zip_with(n, towards, lambda x, p: x + strength * p), lambda x: x / (added(n) + strength)), towards)

    out = out.withColumn("p0", base)
    for name in ("declared", "suffix"):  # a value's likelihood under each language, but for a factor: share given the value / share
        out = out.withColumn(f"l_{name}", F.zip_with(smoothed(others(name), F.col("p0")), "p0", lambda p, q: F.log(p / q)))
    out = out.withColumn("p1", smoothed(others("parent"), F.col("p0"))).withColumn("p2", smoothed(others("host"), F.col("p1")))
    logs_of = F.transform("p2", lambda p: F.log(p))
    for part in ("told", "l_declared", "l_suffix"):
        logs_of = F.zip_with(logs_of, part, lambda a, b: a + b)
    out = out.withColumn("sum", logs_of).withColumn("sum", F.transform("sum", lambda x: F.exp(x - F.array_max("sum")))).withColumn("post", F.transform("sum", lambda x: x / added(F.col("sum"))))
    name_at = lambda a: F.element_at(F.array(*map(F.lit, [*langs, NO_LANGUAGE])), F.array_position(a, F.array_max(a)).cast("int"))
    out = out.select(RID, F.col("id").alias(id_col), name_at(F.col("post")).alias("language"), F.array_max("post").alias("posterior"), name_at(F.col("told")).alias("text_language"), "declared")
    if kept is not None:  # what the rarest values share is named by what the row declares
        rare = F.when(F.col("declared").isNotNull() & ~F.col("declared").isin("", NO_LANGUAGE, *kept), F.col("declared"))
        out = out.withColumns({c: F.when(F.col(c) == FOLDED, F.coalesce(rare, F.lit(FOLDED))).otherwise(F.col(c)) for c in ("language", "text_language")})
    out = out.drop("declared")
    return out.withColumn("accepted", (F.col("language") != NO_LANGUAGE) & (F.col("posterior") >= least))


def of_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents declare `lang`; their `source` stands for the host and has no address suffix unless it has a dot.

    Null text, lang and source say nothing; rows with equal doc_id each have their row. Empty table, empty result.
    """
    source = F.col("source").cast("string")
    return identify(docs, F.lower("lang"), F.when(source.contains("."), F.regexp_extract(source, r"([^.]+)$", 1)), source, **options)


def of_pages(pages: DataFrame, **options) -> DataFrame:
    """Web pages declare a language in their markup; host and suffix come from the address, the text is what tags leave.

    Null html is an empty text, a null or odd url has no host; rows with equal page_id each have their row. Empty table, empty result.
    """
    host = url_host(F.col("url"))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    suffix = F.regexp_extract(host, r"\.([^.]+)$", 1)
    return identify(pages.withColumn("text", text), markup_language(F.col("html")), F.when(suffix != "", suffix), F.when(host != "", host), id_col="page_id", **options)


def accepted_only(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that of_documents rejects; all columns stay, whatever their names. Rows without a text are judged
    by what they declare and by their source; repeated rows stay or go together. Empty table, empty result."""
    docs = kept_numbers(docs)
    decided = stored(of_documents(docs, **options).select(RID, "accepted"), "decided")  # a filter on the plan itself would repeat its expressions
    gone = decided.filter(~F.col("accepted")).select(RID)
    return docs.join(gone, RID, "left_anti").drop(RID)
