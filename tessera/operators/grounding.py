"""Claims against the evidence they cite: numbers, scopes, periods and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.reporting import GROUP_MARKS, SEGMENT_MARKS

#: Words of macroeconomic topics.
MACRO = ["macroeconomic", "macro-economic", "currency headwind", "fx headwind", "inflation", "geopolitical", "consumer demand headwind", "interest rate headwind"]
#: A number is taken whole or not at all, and not where a letter goes on (1.5x, d48fd8).
NUMBER = r"((?>\d[\d.,]*\d|\d))\s*(%|billion|bn|million|mn|m|thousand|k)?(?![\p{L}\d])"
FACTORS = {"billion": 1e9, "bn": 1e9, "million": 1e6, "mn": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}
SHARE = 0.01


def numbers(text: Column) -> Column:
    """The numbers of a text in order: value (in full, by its scale word; none that no double holds) and whether it is a percentage."""
    low = F.lower(F.coalesce(text, F.lit("")))
    factor = F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv])
    both = F.arrays_zip(F.regexp_extract_all(low, F.lit(NUMBER), F.lit(1)).alias("raw"), F.regexp_extract_all(low, F.lit(NUMBER), F.lit(2)).alias("word"))
    full = F.transform(both, lambda x: F.struct((T.number(x.raw) * F.coalesce(F.element_at(factor, x.word), F.lit(1.0))).alias("value"), (x.word == "%").alias("percent")))
    return F.filter(full, lambda x: x.value < float("inf"))


def _bucket(value: Column) -> Column:
    """Values within SHARE of each other are in one bucket or in neighbours."""
    return F.when(value <= 0, F.lit(-1_000_000)).otherwise(F.floor(F.log(value) / F.log(F.lit(1 + 2 * SHARE))).cast("int"))


def says_group(text: Column) -> Column:
    low = F.regexp_replace(F.lower(text), r"(?<![\p{L}\p{N}_])peer[\s-]groups?(?![\p{L}\p{N}_])", " ")
    return F.lower(text).rlike("|".join(GROUP_MARKS)) & low.rlike("|".join(GROUP_MARKS)) & ~F.lower(text).rlike("|".join(SEGMENT_MARKS))


def grounded_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """R25, J12 on claims (claim, run, text, cited: array of ids) and evidence (id, run, text, scope, period): a row for each claim.

    valid and invalid count its distinct citations that exist, and don't. numbers counts the numbers it states, grounded those that
    a cited text states too, percentages apart, within SHARE of the larger. mixed: two numbers or more, and the cited evidence has
    several known scopes, or periods. unscoped: all cited evidence is without a scope, while the claim speaks of the group or of a
    scope that evidence of its run has (the label is in it, its first word as a whole word). macro: it speaks of a macroeconomic
    topic, while all it cites has a known scope other than the group's and no text of that speaks of one.

    Numbers meet by evidence and bucket, labels by run and first word: no text is compared with all others, and the words that look
    for labels travel without their text, which comes once to those that have found one. Equal rows of evidence
    count once; claims must be told apart by `claim`.
    """
    c = claims.withColumn("__numbers", numbers(F.col("text")))
    cited = c.select("claim", F.explode(F.array_distinct("cited")).alias("id"))
    known = evidence.groupBy("id").agg(F.max("scope").alias("scope"), F.max("period").alias("period"), F.bool_or(F.lower(F.coalesce("text", F.lit(""))).rlike("|".join(MACRO))).alias("macro"))
    joined = cited.join(known.withColumn("__there", F.lit(True)), "id", "left").groupBy("claim").agg(
        F.count("__there").alias("valid"), F.count_if(F.col("__there").isNull()).alias("invalid"), F.countDistinct("scope").alias("__scopes"), F.countDistinct("period").alias("__periods"),
        F.count_if(F.col("__there") & F.col("scope").isNotNull() & ~F.col("scope").isin("", "group")).alias("__segments"), F.bool_or("macro").alias("__macro_said"),
    )
    asked = c.select("claim", F.array_distinct("cited").alias("__ids"), F.posexplode("__numbers").alias("n", "x")).select("claim", "n", F.explode("__ids").alias("id"), "x.*").withColumn("bucket", F.explode(F.array(*[_bucket(F.col("value")) + i for i in (-1, 0, 1)])))
    told = evidence.select("id", F.explode(numbers(F.col("text"))).alias("e")).select("id", F.col("e.value").alias("__value"), F.col("e.percent").alias("percent")).withColumn("bucket", _bucket(F.col("__value"))).distinct()
    near = F.abs(F.col("value") - F.col("__value")) <= F.greatest("value", "__value") * SHARE
    hit = asked.join(told, ["id", "percent", "bucket"]).filter(near).select("claim", "n").distinct().groupBy("claim").agg(F.count(F.lit(1)).alias("grounded"))
    words = lambda t: F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    labels = evidence.filter("scope IS NOT NULL AND scope <> '' AND lower(scope) <> 'group'").select("run", F.lower("scope").alias("label")).distinct().withColumn("word", F.get(words(F.col("label")), 0))
    spoken = claims.select("claim", "run", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(labels, ["run", "word"]).select("claim", "label")
    named = spoken.join(claims.select("claim", F.lower("text").alias("low")), "claim").filter("contains(low, label)").select("claim").distinct().withColumn("__named", F.lit(True))
    x = c.select("claim", F.size("__numbers").alias("numbers"), says_group(F.col("text")).alias("__group"), F.lower("text").rlike("|".join(MACRO)).alias("__topic"))
    x = x.join(joined, "claim", "left").join(hit, "claim", "left").join(named, "claim", "left").na.fill(0, ["valid", "invalid", "grounded", "__scopes", "__periods", "__segments"]).na.fill(False, ["__named", "__macro_said", "__group", "__topic"])
    mixed = (F.col("numbers") >= 2) & ((F.col("__scopes") > 1) | (F.col("__periods") > 1))
    unscoped = (F.col("valid") > 0) & (F.col("__scopes") == 0) & (F.col("__group") | F.col("__named"))
    macro = F.col("__topic") & (F.col("valid") > 0) & (F.col("__segments") == F.col("valid")) & ~F.col("__macro_said")
    return x.select("claim", "valid", "invalid", "numbers", "grounded", mixed.alias("mixed"), unscoped.alias("unscoped"), macro.alias("macro"))
