"""Figures of a document from its tables and its prose, brought together and judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import reporting as R
from tessera.functions import text as T

#: How far values may differ, which parts make a subtotal, how sure a method is.
SHARE, LEAST = 0.01, 0.5
SUBTOTALS = {"total_debt": ["short_term_debt", "long_term_debt"], "total_assets": ["total_current_assets", "total_non_current_assets"]}
METHODS = {"html": 0, "native_pdf": 1, "ocr": 2}
PRECISION = {"thousand": 0, "million": 1, "billion": 2}
QUALIFIED, BOOST, MOST, OCR_SHARE, OCR_MOST, LEAST_SURE = 0.8, 0.1, 0.95, 0.85, 0.72, 0.6
YEAR = r"(?:19|20)\d{2}"


def _lookup(table: dict, key: Column, otherwise) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(otherwise))


def apart(a: Column, b: Column, of: Column | None = None) -> Column:
    """Whether two values differ by more than SHARE of the larger one, or of `of`, and more than LEAST; unknown is not apart."""
    base = F.greatest(F.abs(a), F.abs(b)) if of is None else F.abs(of)
    return F.coalesce(F.abs(a - b) > F.greatest(base * SHARE, F.lit(LEAST)), F.lit(False))


def table_candidates(tables: DataFrame, key: str, currency: str = "currency", scale: str = "scale", period: str = "period") -> DataFrame:
    """V1: facts of tables (columns key, table_no, rows, path, and the document's own currency, scale and period where the table states none).

    The first row that holds a year gives the columns' periods. A row is a figure's if its first cell names exactly one. Of
    its numbers those under a period count, each for itself; without such a column several different numbers are ambiguous, and
    the first one stays an excerpt. Margins need a sign of per cent. Without a period, or for money without currency and
    scale, a fact stays an excerpt. Everything comes from one table's arrays; nothing is shuffled.
    """
    flat = F.array_join(F.flatten("rows"), " ")
    dated = F.get(F.filter("rows", lambda r: F.exists(r, lambda c: c.rlike(YEAR))), 0)
    x = tables.select(
        key, "table_no", F.get("path", F.size("path") - 1).alias("heading"), F.get("path", F.size("path") - 2).alias("above"), F.coalesce(R.currency(flat), F.col(currency)).alias("currency"), F.coalesce(R.scale(flat), F.col(scale)).alias("scale"),
        F.col(period).alias("__period"), F.transform(dated, lambda c: F.nullif(F.regexp_extract(c, YEAR, 0), F.lit(""))).alias("__years"), F.posexplode("rows").alias("row_no", "cells"),
    )
    x = x.withColumn("label", R.row_label(F.get("cells", 0))).filter("label IS NOT NULL")
    percent, counted = F.col("label").isin(*R.PERCENT_LABELS), F.col("label") == "employees"
    cell = lambda c, i: F.struct(
        i.alias("col"), F.trim(c).alias("raw"), F.when(~F.col("__percent"), T.number(c)).when(F.trim(c).endswith("%"), T.number(F.regexp_replace(c, r"%\s*$", ""))).alias("value"), F.get(F.coalesce("__years", F.array().cast("array<string>")), i).alias("year")
    )
    x = x.withColumn("__percent", percent).withColumn("__cells", F.filter(F.transform("cells", cell), lambda c: (c.col > 0) & c.value.isNotNull())).filter(F.size("__cells") > 0)
    under = F.filter("__cells", lambda c: c.year.isNotNull())
    first = F.slice("__cells", F.lit(1), F.lit(1))
    x = x.withColumn("__under", under).withColumn("__several", (F.size("__under") == 0) & (F.size(F.array_distinct(F.transform("__cells", lambda c: F.round(c.value, 6)))) > 1))
    x = x.select("*", F.inline(F.when(F.size("__under") > 0, F.col("__under")).otherwise(first)))
    money = ~percent & ~counted
    known = F.coalesce("year", "__period")
    out = x.select(
        key, "table_no", "row_no", "col", "label", F.col("value"), "raw", F.when(percent, "percent").when(counted, "people").otherwise("currency_amount").alias("unit"), F.when(money, F.col("currency")).alias("currency"), F.when(money, F.col("scale")).alias("scale"),
        known.alias("period"), R.heading_scope(F.col("heading"), F.col("above")).alias("scope"), "__several",
    )
    whole = F.col("period").isNotNull() & ((F.col("unit") != "currency_amount") | (F.col("currency").isNotNull() & F.col("scale").isNotNull()))
    return out.select(*[c for c in out.columns if c != "__several"], (whole & ((F.col("unit") != "people") | (F.col("value") >= 1))).alias("qualified"), F.when(~F.col("__several") & whole, "validated").otherwise("excerpt_only").alias("status"))


def reconciled(candidates: DataFrame, key: str) -> DataFrame:
    """V5: within a table and period, a subtotal whose parts are all there and don't make it within the tolerance of their sum stays an
    excerpt; so do assets, liabilities and equity if assets are not the sum of the other two, since it can't be told which is
    wrong. Of a figure that stands there twice the first row counts. The windows hold one table's rows of a period."""
    w = Window.partitionBy(key, "table_no", "period")
    at = F.struct("row_no", "col")
    labels = sorted({*SUBTOTALS, *(p for ps in SUBTOTALS.values() for p in ps), "total_liabilities", "total_equity"})
    first = candidates.select("*", *[F.min(F.when(F.col("label") == n, F.struct(at.alias("at"), "value"))).over(w).alias(f"__{n}") for n in labels])
    value = lambda n: F.col(f"__{n}.value")
    wrong = F.lit(False)
    for total, parts in SUBTOTALS.items():
        expected = sum((value(p) for p in parts[1:]), value(parts[0]))
        wrong = wrong | ((F.col("label") == total) & (at == F.col(f"__{total}.at")) & apart(value(total), expected, expected))
    identity = apart(value("total_assets"), value("total_liabilities") + value("total_equity"), value("total_assets"))
    for n in ("total_assets", "total_liabilities", "total_equity"):
        wrong = wrong | ((F.col("label") == n) & (at == F.col(f"__{n}.at")) & identity)
    return first.withColumn("status", F.when(F.coalesce(wrong, F.lit(False)) & F.col("period").isNotNull(), "excerpt_only").otherwise(F.col("status"))).drop(*[f"__{n}" for n in labels])


def prose_candidates(facts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """V2: settled facts of a document's texts (with the text's place in `order`). A fact whose text states no year but whose scope is known
    gets the document's commonest year, unless a fact of the same label and scope that states that year has another value."""
    place = F.struct(*order)
    years = facts.filter("period IS NOT NULL").groupBy(key, "period").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    commonest = years.groupBy(key).agg(F.max_by("period", F.struct("n", *[(-F.col(f"first.{c}")).alias(c) for c in order])).alias("__year"))
    full = F.when((F.col("unit") == "currency_amount") & F.col("scale").isNotNull(), F.col("value") * _lookup(R.FACTORS, F.col("scale"), 1.0))
    x = facts.withColumn("__full", full)
    ends = lambda c, name: (F.min(c).alias(f"__{name}_low"), F.max(c).alias(f"__{name}_high"))
    anchors = x.filter("period IS NOT NULL AND scope IS NOT NULL").groupBy(key, "label", "scope", F.col("period").alias("__year"))
    anchors = anchors.agg(*ends("__full", "full"), *ends("value", "all"), *ends(F.when(F.col("__full").isNull(), F.col("value")), "raw"))
    x = x.join(commonest, key, "left").join(anchors, [key, "label", "scope", "__year"], "left")
    off = lambda v, name: apart(v, F.col(f"__{name}_low")) | apart(v, F.col(f"__{name}_high"))
    conflict = F.when(F.col("__full").isNotNull(), off(F.col("__full"), "full") | off(F.col("value"), "raw")).otherwise(off(F.col("value"), "all"))
    inferred = F.col("period").isNull() & F.col("scope").isNotNull() & ~conflict
    x = x.withColumn("inferred", inferred & F.col("__year").isNotNull()).withColumn("period", F.when(inferred, F.col("__year")).otherwise(F.col("period")))
    qualified = F.col("period").isNotNull() & ((F.col("unit") != "currency_amount") | (F.col("currency").isNotNull() & F.col("scale").isNotNull()))
    return x.withColumns({"qualified": qualified, "status": F.when(qualified, "validated").otherwise("excerpt_only")}).drop("__year", "__full", *[f"__{n}_{e}" for n in ("full", "all", "raw") for e in ("low", "high")])


def judged(candidates: DataFrame, key: str, known: Column) -> DataFrame:
    """V3, V4, V6: one verdict for each label, period and scope of a document, from candidates of any method (value, unit, currency, scale,
    method, sure, qualified, status, place).

    Two values with a scale are compared in full, others digit by digit; all pairs agree exactly when the extremes do. A conflict
    between methods is rejected, within one it stays an excerpt with the best method's first value. Else the best candidate stands:
    a validated one, then the finest scale, then the surest, then the best method, then place. Confidence starts from its own, at
    least QUALIFIED if any is qualified; OCR is held down; several methods raise it. Under LEAST_SURE, or with an issuer that
    isn't known, it stays an excerpt.
    """
    quality = _lookup(METHODS, F.col("method"), 9)
    full = F.when((F.col("unit") == "currency_amount") & F.col("scale").isNotNull(), F.col("value") * _lookup(R.FACTORS, F.col("scale"), 1.0))
    x = candidates.withColumns({"__q": quality, "__full": full, "__raw": F.when(full.isNull(), F.col("value")), "__known": known})
    shown = F.struct("value", "unit", "currency", "scale", "status", "sure", "method")
    best = F.min_by(shown, F.struct(F.col("status") != "validated", _lookup(PRECISION, F.col("scale"), 3), -F.col("sure"), "__q", "place"))
    g = x.groupBy(key, "label", "period", "scope").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.struct("__q", "method"))).alias("__methods"), F.min("__full").alias("__fl"), F.max("__full").alias("__fh"), F.min("__raw").alias("__rl"), F.max("__raw").alias("__rh"),
        F.min("value").alias("__al"), F.max("value").alias("__ah"), F.bool_or("qualified").alias("__qualified"), F.bool_and("__known").alias("__known"), F.min("sure").alias("__least"), best.alias("__best"), F.min_by(shown, F.struct("__q", "place")).alias("__rep"),
    )
    g = g.withColumn("methods", F.transform("__methods", lambda m: m.method)).withColumn("__conflict", apart(F.col("__fl"), F.col("__fh")) | apart(F.col("__rl"), F.col("__ah")) | apart(F.col("__rh"), F.col("__al")))
    several = F.size("methods") > 1
    first = F.get("methods", 0)
    sure = F.when(first == "ocr", F.least(F.col("__best.sure") * OCR_SHARE, F.lit(OCR_MOST))).otherwise(F.least(F.when(F.col("__qualified"), F.greatest(F.col("__best.sure"), F.lit(QUALIFIED))).otherwise(F.col("__best.sure")), F.lit(MOST)))
    sure = F.round(F.when(several, F.least(F.round(sure, 4) + BOOST, F.lit(MOST))).otherwise(sure), 4)
    g = g.withColumn("__sure", sure)
    verdict = F.when(F.col("__conflict") & several, "rejected").when(F.col("__conflict"), "excerpt_only").when((F.col("__best.status") == "validated") & ((F.col("__sure") < LEAST_SURE) | ~F.col("__known")), "excerpt_only").otherwise(F.col("__best.status"))
    of = lambda c: F.when(~F.col("__conflict"), F.col(f"__best.{c}")).when(~several if c == "value" else F.lit(True), F.col(f"__rep.{c}"))
    confidence = F.when(F.col("__conflict") & several, F.round("__least", 4)).when(F.col("__conflict"), F.round("__rep.sure", 4)).otherwise(F.col("__sure"))
    return g.select(key, "label", "period", "scope", "n", "methods", verdict.alias("validation"), of("value").alias("value"), of("unit").alias("unit"), of("currency").alias("currency"), of("scale").alias("scale"), first.alias("method"), confidence.alias("confidence"))
