"""Mixture-controlled packing of token sequences by deficit round-robin."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import partitions, running_totals, stored

END_ID = 1
CACHE, LONGEST = 400_000, 64  # chunks and words whose ids are kept, and the characters of the longest: 150 MB at the very most
MOST_BASES = 200_000
_coders: dict = {}


class Known(dict):
    """What `make` gives for a key. Keeps the first `most` keys of at most LONGEST characters, which hold the common ones, and starts anew
    after four times as many others, in case the texts have changed."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.missed = make, most, 0

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) > LONGEST:
            return value
        if len(self) < self.most:
            self[key] = value
        else:
            self.missed += 1
            if self.missed > 4 * self.most:
                self.clear()
                self.missed = 0
        return value


class Coder:
    """Packed ids (little-endian unsigned 32-bit) of texts. Keeps the ids of chunks between white space and of their words.

    Texts with characters beyond Latin Extended-A, whose normalisation isn't plain lower(), or with what may be a special token
    go to the library whole, with its default settings.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        letters, digits, space = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\x09-\\x0D \x85\xa0"
        split = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+").findall
        self.odd = re.compile("[^\x00-\x1b\x20-įı-ſ]").search
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        letter_of = dict(zip(shown, shown)) | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        tokenize = self.whole.model.tokenize

        packed = [i.to_bytes(4, "little") for i in range(max(self.whole.get_vocab().values()) + 1)]

        def ids(chunk: str) -> bytes:
            words = (chunk,)
            if not chunk.isalpha():
                words = (chunk[:-1], chunk[-1]) if chunk[:-1].isalpha() and chunk[-1] in ",.;:!?" else split(chunk)
                if len(words) > 1:
                    return b"".join(map(self.chunk, words))
            return b"".join([packed[t.id] for w in words for t in tokenize(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letter_of))])

        self.chunk = Known(ids, CACHE).__getitem__

    def encode(self, text: str) -> bytes:
        if self.odd(text) or "<|" in text:
            return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.chunk, text.lower().split()))


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def cut(docs: DataFrame, tokenizer: str, block: int, id_col: str, text_col: str, source_col: str, keep_ids: bool) -> DataFrame:
    """The documents' tokens, cut into blocks of the queue that each source has in each input partition: a row per piece with id, key
    (the source as text that is never null), part, block and offset in that queue, start, length, doc_tokens and crc.
    ids are null but in the last, unfilled block of a queue (block is -1 there), or if asked for.

    A task holds a batch and one unfilled block for each of its sources.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end, part = coder(tokenizer).encode, END_ID.to_bytes(4, "little"), TaskContext.get().partitionId()
        queues: dict[str, list] = {}  # tokens so far and the pieces of the unfilled block
        out: list[tuple] = []
        id_type = None

        def flush() -> pa.RecordBatch:
            columns = zip(*out) if out else [()] * 9
            kinds = [id_type, pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays([*arrays[:2], pa.array([part] * len(arrays[0]), pa.int32()), *arrays[2:]], names=["id", "key", "part", "block", "offset", "start", "length", "doc_tokens", "crc", "ids"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for row, (key, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text"))):
                ids = encode(text.as_py()) + end
                number, n, at = batch.column("id")[row].as_py(), len(ids) // 4, 0
                queue = queues.setdefault(key, [0, []])
                before, open_ = queue
                while at < n:
                    offset = (before + at) % block
                    take = min(block - offset, n - at)
                    data = ids[4 * at : 4 * (at + take)]
                    open_.append((number, key, (before + at) // block, offset, at, take, n, zlib.crc32(data), data))
                    at += take
                    if offset + take == block:
                        out.extend(open_ if keep_ids else [(*p[:8], None) for p in open_])
                        open_.clear()
                queue[0] = before + n
                if len(out) >= 10_000:
                    yield flush()
        if id_type is not None:
            out.extend((*p[:2], -1, *p[3:]) for _, open_ in queues.values() for p in open_)
            yield flush()

    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    return docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, f"id {kind}, key string, part int, block long, offset int, start long, length long, doc_tokens long, crc long, ids binary"
    )


def pack(
    docs: DataFrame, tokenizer: str, window: int = 2048, block: int = 128, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_ids: bool = False
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Every document's tokens and an end id join its source's queue, which is cut into blocks; a window takes window/block
    of them. `weights` gives each source its share of every window; without them a source's weight is its number of
    blocks, so that all queues last to the end. Deficit round-robin: in each round a source's deficit counter grows by its
    quantum, window/block times its share of the weights, and it sends blocks, in order of source, while the counter holds one.
    Block i is thus sent in round ceil((i + 1) / quantum), which carries every deficit over windows and partitions exactly. A queue
    that has run dry takes part no more: the others fill the windows in proportion to their weights. Sources without a
    positive weight have no target: their blocks follow all others. Windows are filled in the order in which blocks are
    sent; what is left of each queue (under one block) follows in order of source. So all sequences but the last are full.

    Input partitions cut local queues into blocks. A source's queue is those blocks in order of partition, then blocks cut from
    what the partitions had left. Prefix sums of the partitions' totals number them, whatever a queue's size.
    A null text is empty (its end id alone); a null source is a source; ids may be null or repeat. Empty table, empty result.
    """
    spark, n, per = docs.sparkSession, partitions(docs.sparkSession), window // block
    pieces = stored(cut(docs, tokenizer, block, id_col, text_col, source_col, keep_ids), "pieces")
    left = F.when(F.col("block") < 0, F.col("length")).otherwise(0)
    sums = pieces.groupBy("key", "part").agg(F.sum(F.when((F.col("block") >= 0) & (F.col("offset") == 0), 1).otherwise(0)).alias("blocks"), F.sum(left).alias("left"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("key")
    bases = sums.select(
        "key", "part", "blocks", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.sum("left").over(earlier), F.lit(0)).alias("left_base"),
        F.sum("blocks").over(every).alias("cut"), F.sum("left").over(every).alias("left"),
    )
    bases = stored(bases, "bases")  # a row for each source and part that has it: broadcast only while these are few
    few = F.broadcast(bases) if bases.count() <= MOST_BASES else bases
    queues = stored(bases.groupBy("key").agg(F.first("cut").alias("cut"), F.first("left").alias("left")).withColumn("full", F.expr(f"cut + left div {block}")), "queues")

    # what the partitions have left, in order of partition, cut again
    rest = pieces.filter("block < 0").join(few.select("key", "part", "left_base", "cut", "left"), ["key", "part"]).withColumn("s", F.col("left_base") + F.col("offset"))
    rest = rest.withColumn("b", F.explode(F.expr(f"sequence(s div {block}, (s + length - 1) div {block})"))).withColumn("skip", F.greatest(F.lit(0), F.col("b") * block - F.col("s")))
    rest = rest.withColumn("size", F.least((F.col("b") + 1) * block, F.col("s") + F.col("length")) - F.col("s") - F.col("skip"))
    rest = rest.withColumn("ids", F.substring("ids", (F.col("skip") * 4 + 1).cast("int"), (F.col("size") * 4).cast("int")))
    rest = stored(rest.select("id", "key", F.expr(f"b < left div {block}").alias("whole"), (F.col("cut") + F.col("b")).alias("block"), (F.col("s") + F.col("skip") - F.col("b") * block).cast("int").alias("offset"), (F.col("start") + F.col("skip")).alias("start"), F.col("size").alias("length"), "doc_tokens", F.crc32("ids").alias("crc"), "ids"), "rest")

    if weights is None:
        weighed = queues.withColumn("weight", F.col("full").cast("double"))
    else:
        given = spark.createDataFrame([("-" if k is None else f"={k}", float(w)) for k, w in weights.items()], "key string, weight double")
        weighed = queues.join(given.filter("weight > 0"), "key", "left")
    all_weights = float(weighed.agg(F.sum("weight")).first()[0] or 0)
    last_round = F.lit(float("inf"))
    quantum = weighed.select("key", "cut", "left", (F.col("weight") * float(per)).alias("share"))
    sends = lambda df: df.withColumn("round", F.coalesce(F.ceil((F.col("block") + 1) * all_weights / F.nullif("share", F.lit(0.0))).cast("double"), last_round)).select("round", "key", "block", F.lit(1).cast("long").alias("one"))
    local = bases.filter("blocks > 0").repartition(n, "key", "part").withColumn("block", F.explode(F.expr("sequence(base, base + blocks - 1)"))).select("key", "block")
    late = queues.filter("full > cut").withColumn("block", F.explode(F.expr("sequence(cut, full - 1)"))).select("key", "block")
    sent = sends(local.unionByName(late).join(quantum, "key"))
    order = running_totals(sent, ["round", "key", "block"], ["one"]).select("key", "block", F.col("index").alias("place"))
    columns = ["id", "key", "block", "offset", "start", "length", "doc_tokens", "crc", "ids"]
    whole = pieces.filter("block >= 0").join(few.select("key", "part", "base"), ["key", "part"]).withColumn("block", F.col("base") + F.col("block")).select(columns)
    whole = whole.unionByName(rest.filter("whole").select(columns)).join(order, ["key", "block"]).withColumn("at", F.col("place") * block + F.col("offset"))

    number = queues.agg(F.sum("full")).first()[0] or 0
    ends = running_totals(queues.select("key", F.expr(f"left % {block}").alias("size")).filter("size > 0"), ["key"], ["size"]).select("key", "size_before")
    last = rest.filter("not whole").join(ends, "key").withColumn("at", number * block + F.col("size_before") + F.col("offset"))
    last = last.withColumn("w", F.explode(F.expr(f"sequence(at div {window}, (at + length - 1) div {window})"))).withColumn("skip", F.greatest(F.lit(0), F.col("w") * window - F.col("at")))
    last = last.withColumn("length", F.least((F.col("w") + 1) * window, F.col("at") + F.col("length")) - F.col("at") - F.col("skip"))
    last = last.withColumn("ids", F.substring("ids", (F.col("skip") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))).withColumn("crc", F.crc32("ids"))
    last = last.withColumn("start", F.col("start") + F.col("skip")).withColumn("at", F.col("at") + F.col("skip"))
    out = [F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", F.expr(f"at div {window}").alias("sequence_id"), (F.col("at") % window).alias("offset"), *["ids"] * keep_ids]
    return whole.select(out).unionByName(last.select(out))
