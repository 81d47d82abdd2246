"""Mixing sources to target weights: fixed-length blocks, multinomial draws, index permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RID, WORD, kept_numbers, numbered, partitions, running_totals, stored

ROUNDS = 12


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """sizes (source, source_size) with `rank` (sources by code point, null last, from 0) and `target`.

    Weights repeat in order of rank. target = least(cap * source_size, level * weight); the level at which the targets add
    up to share * all sizes is the largest over k of (that sum - the k smallest caps per weight) / the other weights.
    """
    ranked = running_totals(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"], ["source_size"]).withColumnRenamed("index", "rank")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    weighed = ranked.select(
        "source", "source_size", "rank", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long").alias("weight"), (F.col("source_size") * cap).alias("most")
    ).withColumn("ratio", F.col("most") / F.col("weight"))
    filled = stored(running_totals(weighed, ["ratio", "rank"], ["most", "weight"]), "targets")
    all_weights = filled.agg(F.sum("weight")).first()[0] or 1
    level = filled.agg(F.max((F.lit(share * total) - F.col("most_before")) / (all_weights - F.col("weight_before")))).first()[0] or 0.0
    return filled.select("source", "source_size", "rank", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def round_keys(seed: int, rank: Column, turn: Column, n: Column) -> Column:
    """A pseudorandom number below n for each round of the permutation that a source uses in one pass."""
    number = lambda r: F.conv(F.substring(_digest(F.lit(seed), rank, turn, r), 1, 12), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.pmod(number(r), n))


def permuted(x: Column, seed: int, rank: Column, turn: Column, n: Column, keys: Column, back: bool = False) -> Column:
    """Swap-or-not permutation of 0 .. n-1: in each round x may change places with (key - x) mod n; back: its inverse."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.element_at(keys, r + 1) - x, n)
        return F.when(F.substring(_digest(F.lit(seed), rank, turn, r, F.greatest(x, other)), 1, 1) >= "8", other).otherwise(x)

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, x.cast("long"), swap)


def mix(
    docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), block: int = 128, shard_slots: int = 4096, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """(documents, placements). documents: RID, id, size, rank, source_size, target, words_before. placements: one row per piece of a
    document in the mix: output_shard, position (of its block in the shard), rank, turn (the pass over the source), block,
    RID, first_word and n_words.

    Each source's words (maximal runs without ASCII white space) in order of id are packed into blocks of `block`; the
    source takes round(target) words: whole passes over its blocks, then blocks of one more permutation, the last one
    cut to fit. Every such slot draws a lot; in order of lots, each output shard has the next shard_slots (the last shard
    may have fewer). The counts of sources per shard are thus multinomial draws conditioned on both margins: shards of equal
    size, and totals that meet the targets (free draws would miss them by chance and could exceed the cap). Shards
    number a source's slots one after the other; the pass's permutation maps a number to a block, and placements join
    blocks by (source, block).

    A null text has no words; null sources form one source, after the others; ids may be null or repeat: ties go by size and row.
    Documents without words appear in no placement. Empty tables give empty results. RID is as in exact_groups.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = stored(numbered(docs).select(RID, F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size")), "sizes")
    goal = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights), "goal")
    ranked = sized.join(goal, sized.source.eqNullSafe(goal.source)).select(F.col(RID).alias("row"), "id", "size", "rank", "source_size", "target")
    documents = stored(running_totals(ranked, ["id", "size", "row"], ["size"], ["rank"]).withColumnRenamed("row", RID).withColumnRenamed("size_before", "words_before"), "ordered")

    blocks = F.ceil(F.col("source_size") / block)
    plan = goal.filter("source_size > 0").select("rank", "source_size", F.round("target").cast("long").alias("words"), blocks.alias("blocks"))
    plan = plan.withColumn("whole", F.expr("words div source_size")).withColumn("rest", F.expr("words % source_size")).withColumn("tail", F.expr(f"source_size - (blocks - 1) * {block}"))
    plan = plan.withColumn("keys", F.transform(F.sequence(F.lit(0).cast("long"), F.col("whole")), lambda t: round_keys(seed, F.col("rank"), t, F.col("blocks"))))
    plan = plan.withColumn("tail_at", permuted(F.col("blocks") - 1, seed, F.col("rank"), F.col("whole"), F.col("blocks"), F.element_at("keys", (F.col("whole") + 1).cast("int")), back=True))
    some = F.ceil(F.col("rest") / block)
    more = F.when(F.col("tail_at") < some, F.ceil((F.col("rest") + block - F.col("tail")) / block)).otherwise(some)
    plan = stored(plan.withColumn("slots", F.col("whole") * F.col("blocks") + more), "plan")

    step = 65536  # slots that one row is spread to at once
    runs = plan.filter("slots > 0").select("rank", "slots", F.explode(F.expr(f"sequence(0, (slots - 1) div {step})")).alias("run")).repartition(n, "rank", "run")
    draws = runs.select("rank", F.explode(F.expr(f"sequence(run * {step}, least(slots, (run + 1) * {step}) - 1)")).alias("draw"))
    drawn = running_totals(draws.withColumn("lot", F.xxhash64(F.lit(seed), "rank", "draw")).withColumn("one", F.lit(1).cast("long")), ["lot", "rank", "draw"], ["one"])
    counts = stored(drawn.groupBy(F.expr(f"index div {shard_slots}").alias("output_shard"), "rank").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = running_totals(counts, ["output_shard"], ["n"], ["rank"]).withColumnRenamed("n_before", "first").drop("index")
    counts = running_totals(counts, ["rank"], ["n"], ["output_shard"]).withColumnRenamed("n_before", "place").drop("index").repartition(n, "output_shard", "rank")
    slots = counts.join(plan.drop("slots"), "rank").withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    slots = slots.withColumn("number", F.col("first") + F.col("i")).withColumn("turn", F.expr("number div blocks")).withColumn("j", F.expr("number % blocks"))
    slots = slots.withColumn("block", permuted(F.col("j"), seed, F.col("rank"), F.col("turn"), F.col("blocks"), F.element_at("keys", (F.col("turn") + 1).cast("int"))))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(block)
    left = F.col("rest") - F.col("j") * block + F.when(F.col("tail_at") < F.col("j"), block - F.col("tail")).otherwise(0)
    slots = slots.select("output_shard", (F.col("place") + F.col("i")).alias("position"), "rank", "turn", "block", F.when(F.col("turn") < F.col("whole"), length).otherwise(F.least(length, left)).alias("take"))

    pieces = documents.filter("size > 0").select(RID, "rank", "words_before", "size", F.explode(F.expr(f"sequence(words_before div {block}, (words_before + size - 1) div {block})")).alias("block"))
    at = F.greatest(F.col("block") * block, F.col("words_before"))
    pieces = pieces.select(RID, "rank", "block", (at - F.col("words_before")).alias("first_word"), (at - F.col("block") * block).alias("offset"), (F.least((F.col("block") + 1) * block, F.col("words_before") + F.col("size")) - at).alias("length"))
    placed = slots.join(pieces, ["rank", "block"]).withColumn("n_words", F.least("length", F.col("take") - F.col("offset"))).filter("n_words > 0")
    return documents, placed.select("output_shard", "position", "rank", "turn", "block", RID, "first_word", "n_words")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each pass that takes words of a document, one row with docs' columns and, as text, the words
    taken with the white space after them (n_chars, if there, follows).

    Documents without words, null texts too, are in no mix. Repeated rows and ids are mixed each by itself, null sources as
    one source. Other columns stay as they are, whatever their names. Empty table, empty result."""
    text = options.get("text_col", "text")
    columns, docs = docs.columns, kept_numbers(docs)
    documents, placed = mix(docs, **options)
    parts = placed.groupBy(RID, "turn").agg(F.sum("n_words").alias("__taken"), F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("__parts"))
    parts = parts.join(documents.select(RID, F.col("size").alias("__size")), RID).drop("turn")
    spaced = F.regexp_extract_all(F.col(text), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("__parts", lambda p: F.slice("__words", (p.first_word + 1).cast("int"), p.n_words.cast("int")))), "")
    out = docs.join(parts, RID).withColumn("__words", F.when(F.col("__taken") < F.col("__size"), spaced))
    out = out.withColumn(text, F.when(F.col("__taken") < F.col("__size"), cut).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(columns)
