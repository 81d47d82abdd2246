"""Language-model scoring with a hashed maximum-entropy model."""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, numbered, stored

CLASSES, SLOTS = 16, 128  # output units: CLASSES * SLOTS; class and slot of unit u are u // SLOTS and u % SLOTS
UNITS, OWN = CLASSES * SLOTS, CLASSES * SLOTS // 2  # the OWN most frequent words have units of their own, others share hashed ones
PREVIOUS = 1 << 12  # values of the feature "word before": half are the most frequent words' own, others are hashed
SKIPS, PAIRS = 16, 4  # values of the skip feature, the word two back; hashed ones of it that are joined with the word before
START, FLUSH, TOKENS = PREVIOUS, 300_000, 4_000_000  # START: the word before a text; SKIPS stands two places before a text
CONTEXTS = (PREVIOUS + 1) * (SKIPS + 1)  # word before x skip
CELLS = UNITS + (SKIPS + 1) * CLASSES  # of a word before: units, then skip x class
SPREAD = 24  # blocks of weights
COMMON = 1_000_000  # a word with over 1/COMMON of the tokens is scored where it is read: fewer than COMMON words
END = b""


def words_of(text: bytes | None) -> list[bytes]:
    """Words after lower-casing A-Z, then the end token."""
    return [*(text or b"").lower().split(), END]


def pair(context: np.ndarray) -> np.ndarray:
    """The hashed feature of both words: PAIRS values for each word before."""
    one, two = np.divmod(context, SKIPS + 1)
    return one * PAIRS + (two * 11 >> 2) % PAIRS


class Codes:
    """Codes of words, previous * UNITS + unit: `own` ranks the most frequent; keeps up to FLUSH others."""

    def __init__(self, own: dict[bytes, int]):
        self.own = {w: self.code(w, r) for w, r in own.items()}
        self.seen = dict(self.own)

    @staticmethod
    def code(word: bytes, rank: int = PREVIOUS) -> int:
        h = zlib.crc32(word)
        unit = rank if rank < OWN else OWN + h % (UNITS - OWN)
        previous = rank if rank < PREVIOUS // 2 else PREVIOUS // 2 + (h >> 12) % (PREVIOUS - PREVIOUS // 2)
        return previous * UNITS + unit

    def of(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > FLUSH + len(self.own):
            seen = self.seen = dict(self.own)
        for w in set(words).difference(seen):
            seen[w] = self.code(w)
        return np.fromiter(map(seen.__getitem__, words), np.int32, len(words))


def contexts_of(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The context of each token; first has the places where texts begin."""
    one, two = np.r_[START, codes // UNITS][: len(codes)], np.r_[SKIPS, SKIPS, codes % UNITS * SKIPS // UNITS][: len(codes)]
    one[first], two[first] = START, SKIPS
    second = first + 1
    two[second[second < len(codes)]] = SKIPS  # in a text of one token this is the next one's start, set already
    return (one * (SKIPS + 1) + two).astype(np.int32)


def _flat(texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All tokens, where each text begins, and each text's number of tokens."""
    lists = [words_of(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    return [w for x in lists for w in x], np.cumsum(sizes) - sizes, sizes


def _pieces(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with texts of about `most` bytes."""
    at, size = 0, 0
    for i, t in enumerate(batch.column("t")):
        n = len(t.as_buffer() or b"") if t.is_valid else 0
        if i > at and size + n > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def vocabulary(train: DataFrame) -> DataFrame:
    """(word, c) over all tokens of train's column t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("t"):
                counts.update(words_of(text.as_py()))
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return train.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def transitions(train: DataFrame, own: dict[bytes, int]) -> DataFrame:
    """(previous, cell, n): how often each unit, and each class with each skip, follows each word before in train."""
    held = train.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, keys, size = Codes(held.value), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            key = np.concatenate(keys)
            keys.clear()
            key.sort()
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, n = key[start], np.diff(np.r_[start, len(key)])
            for at in range(0, len(key), FLUSH):
                part = key[at : at + FLUSH]
                yield pa.RecordBatch.from_arrays([pa.array(part // CELLS), pa.array(part % CELLS), pa.array(n[at : at + FLUSH])], names=["previous", "cell", "n"])

        for batch in batches:
            for part in _pieces(batch):
                words, first, _ = _flat(part.column("t").to_pylist())
                code = codes.of(words)
                one, two = np.divmod(contexts_of(code, first), SKIPS + 1)
                unit = code % UNITS
                keys += [one * CELLS + unit, one * CELLS + UNITS + two * CLASSES + unit // SLOTS]
                size += len(words)
                if size > TOKENS:
                    yield from out()
                    size = 0
        yield from out()

    return train.mapInArrow(run, "previous int, cell int, n long").groupBy("previous", "cell").agg(F.sum("n").alias("n"))


class Model:
    """Weights of the classes' features (bias, word before, skip, hashed pair of both) and of the slots' (bias, word before)."""

    def __init__(self, unit_counts: np.ndarray):
        share = np.log(unit_counts + 0.5)
        self.class_w = {"bias": np.log(np.exp(share).reshape(CLASSES, SLOTS).sum(axis=1))[None], "previous": np.zeros((PREVIOUS + 1, CLASSES)), "skip": np.zeros((SKIPS + 1, CLASSES)), "pair": np.zeros(((PREVIOUS + 1) * PAIRS, CLASSES))}
        self.slot_bias = share.reshape(CLASSES, SLOTS)
        self.slot_w = np.zeros((PREVIOUS + 1, UNITS), np.float16)

    def classes(self, context: np.ndarray) -> np.ndarray:
        w = self.class_w
        return _log_softmax(w["bias"] + w["previous"][context // (SKIPS + 1)] + w["skip"][context % (SKIPS + 1)] + w["pair"][pair(context)])

    def only_classes(self) -> Model:
        """The same classes' weights in single precision, without the slots'."""
        out = copy.copy(self)
        out.class_w, out.slot_w = {k: v.astype(np.float32) for k, v in self.class_w.items()}, None
        return out

    def norms(self, step: int = 512) -> np.ndarray:
        """Log normalisers of the slots by word before and class, of the weights as they are held."""
        out = np.empty((PREVIOUS + 1, CLASSES), np.float32)
        for at in range(0, PREVIOUS + 1, step):
            out[at : at + step] = _log_sum(self.slot_bias + self.slot_w[at : at + step].astype(np.float64).reshape(-1, CLASSES, SLOTS))[..., 0]
        return out

    def step(self, sums: dict[str, np.ndarray], prior: float) -> None:
        """Moves each class weight by its gradient over the expected count, by one at most."""
        for name, s in sums.items():
            w = self.class_w[name]
            step = (s[:, :CLASSES] - prior * w * (name != "bias")) / (len(self.class_w) * s[:, CLASSES:] + prior)
            w += np.clip(step, -1, 1)


def class_sums(model: Model, context: np.ndarray, cls: np.ndarray, n: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(feature, values, sums): for each value of a feature the gradient of the classes' log likelihood (observed less expected
    counts) and the expected counts."""
    rows, where = np.unique(context, return_inverse=True)
    seen = np.zeros((len(rows), CLASSES))
    np.add.at(seen, (where, cls), n)
    expected = np.exp(model.classes(rows)) * seen.sum(axis=1, keepdims=True)
    both = np.concatenate([seen - expected, expected], axis=1)
    for name, value in {"bias": np.zeros(len(rows), np.int64), "previous": rows // (SKIPS + 1), "skip": rows % (SKIPS + 1), "pair": pair(rows)}.items():
        order = np.argsort(value, kind="stable")
        ids, start = np.unique(value[order], return_index=True)
        yield name, ids, np.add.reduceat(both[order], start, axis=0)


def slot_gradient(seen: np.ndarray, bias: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed less expected counts, and expected counts, of slots within classes, for each word before."""
    expected = np.exp(_log_softmax(bias + w)) * seen.sum(axis=-1, keepdims=True)
    return seen - expected, expected


def fit_slots(seen: np.ndarray, bias: np.ndarray, rounds: int, prior: float) -> np.ndarray:
    """Slot weights of words before whose counts are seen[i, class, slot]."""
    w = np.zeros(seen.shape)
    for _ in range(rounds):
        gradient, expected = slot_gradient(seen, bias, w)
        w += np.clip((gradient - prior * w) / (expected + prior), -1, 1)
    return w


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    return x - _log_sum(x)


def train(cells: DataFrame, unit_counts: np.ndarray, rounds: int, prior: float) -> Model:
    """Full gradient steps on counts of all transitions.

    The slots' weights of one word before depend on its own counts only, so each task holds a block of them, steps there and
    puts them out. For the classes every task sums observed less expected counts of the features over its contexts (and the
    expected counts, which scale the step); the driver adds up these sums, whose size the model fixes, and updates the weights.
    """
    spark, model = cells.sparkSession, Model(unit_counts)
    bias = model.slot_bias

    def columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        held = [b for b in batches if b.num_rows]
        return [np.concatenate([b.column(c).to_numpy() for b in held]) if held else np.zeros(0, np.int64) for c in ("previous", "cell", "n")]

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, unit, n = columns(batches)
        order = np.argsort(previous, kind="stable")
        previous, unit, n = previous[order], unit[order], n[order]
        ids, where = np.unique(previous, return_inverse=True)
        for at in range(0, len(ids), 64):
            a, b = np.searchsorted(where, [at, at + 64])
            seen = np.zeros((min(64, len(ids) - at), UNITS))
            seen[where[a:b] - at, unit[a:b]] = n[a:b]
            w = fit_slots(seen.reshape(-1, CLASSES, SLOTS), bias, rounds, prior).astype("<f2")
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 64]), pa.array([x.tobytes() for x in w], pa.binary())], names=["previous", "weights"])

    followed = cells.filter(F.col("cell") < UNITS).repartition(SPREAD, "previous").mapInArrow(slots, "previous int, weights binary")
    for previous, weights in followed.toLocalIterator():
        model.slot_w[previous] = np.frombuffer(weights, "<f2")

    contexts = stored(cells.filter(F.col("cell") >= UNITS).repartition(SPREAD, "previous"), "contexts")
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(model.only_classes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            previous, cell, n = columns(batches)
            if not len(n):
                return
            two, cls = np.divmod(cell - UNITS, CLASSES)
            for name, ids, sums in class_sums(held.value, previous * (SKIPS + 1) + two, cls, n):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([sums.astype("<f8").tobytes()], pa.binary())], names=["name", "ids", "sums"])

        sums: dict[str, np.ndarray] = {}
        for name, ids, data in contexts.mapInArrow(run, "name string, ids binary, sums binary").toLocalIterator():
            total = sums.setdefault(name, np.zeros((len(model.class_w[name]), 2 * CLASSES)))
            np.add.at(total, np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(-1, 2 * CLASSES))
        held.unpersist()
        model.step(sums, prior)
    return model


def score(docs: DataFrame, fold: int = 2, folds: int = 7, rounds: int = 8, prior: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id as text) mod folds is `fold` are held out, all others train. base_score is the unigram model that adds one.
    The maximum-entropy model predicts a word's unit (own or hashed) as class, then slot in the class, from the features of
    Model, and a word within a hashed unit by its count plus one over the unit's plus one for each word and for the
    unknown. It is trained by gradient steps on counts of all training transitions. Texts are scored in batches that look
    up rows of the weights for the words at hand; slot weights are held in half precision, and normalised as held.

    Only words with over 1/COMMON of the training tokens are broadcast; a document's other words are joined with the
    vocabulary by shuffling. Null texts are empty: one end token. A null id counts as the empty string for the fold.
    Ids may repeat. With nothing to train on each token has probability one in base_score. Empty table, empty result.
    """
    spark = docs.sparkSession
    rest = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    rows = numbered(docs).select(RID, F.col(id_col).alias("id"), (rest == fold).alias("held_out"), F.col(text_col).cast("binary").alias("t"))
    learn = rows.filter(~F.col("held_out")).select("t")
    known = stored(vocabulary(learn), "vocabulary")
    total, distinct = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    common = known.filter(F.col("c") * COMMON > total)
    head = common.orderBy(F.desc("c"), "word").limit(PREVIOUS // 2).select("word").collect()
    own = {bytes(r[0]): i for i, r in enumerate(head)}
    table = common.toArrow()
    counted = dict(zip(table.column("word").to_pylist(), table.column("c").to_pylist()))
    shared = known.withColumn("unit", OWN + F.crc32("word") % (UNITS - OWN)).filter(~F.col("word").isin([bytearray(w) for w, i in own.items() if i < OWN]) if own else F.lit(True))
    unit_n, unit_v = np.zeros(UNITS), np.zeros(UNITS)
    for w, i in own.items():
        if i < OWN:
            unit_n[i] = counted[w]
    for u, n, v in shared.groupBy("unit").agg(F.sum("c"), F.count(F.lit(1))).collect():
        unit_n[u], unit_v[u] = n, v
    model = train(stored(transitions(learn, own), "transitions"), unit_n, rounds, prior)
    held = spark.sparkContext.broadcast((own, counted, model.only_classes(), model.slot_w, model.norms(), np.r_[np.zeros(OWN), np.log10(unit_n[OWN:] + unit_v[OWN:] + 1)]))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counted, classes, slot_w, norm, unit_log = held.value
        codes, logs, bias = Codes(own), {w: np.log10(c + 1) for w, c in counted.items()}, classes.slot_bias.ravel()
        place = np.zeros(CONTEXTS, np.int32)
        for batch in batches:
            for part in _pieces(batch):
                texts = part.column("t").to_pylist()
                words, first, sizes = _flat(texts)
                code = codes.of(words)
                context, u = contexts_of(code, first), code % UNITS
                cls, one = u // SLOTS, context // (SKIPS + 1)
                place[context] = 1
                here = np.flatnonzero(place)
                place[here] = np.arange(len(here))
                p = classes.classes(here)[place[context], cls] + bias[u] + slot_w[one, u] - norm[one, cls]
                place[here] = 0
                base = np.fromiter((logs.get(w, -1.0) for w in words), np.float64, len(words))
                rare = base < 0
                base[rare] = 0.0
                inner = np.where(u < OWN, 0.0, base - unit_log[u])
                score = p.astype(np.float64) / np.log(10) + inner
                left = []
                where = np.flatnonzero(rare)
                for a, b in zip(np.searchsorted(where, first).tolist(), np.searchsorted(where, first + sizes).tolist()):
                    left.append([{"word": w, "n": n} for w, n in Counter(words[i] for i in where[a:b].tolist()).items()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(RID), part.column("id"), part.column("held_out"), pa.array(sizes), pa.array(np.add.reduceat((~rare).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(score, first)), pa.array(left, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])))],
                    names=[RID, "id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
                )

    part = stored(rows.mapInArrow(run, f"{RID} long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:int>>"), "scores")
    rare = part.select(RID, F.inline("rare")).join(known, "word").groupBy(RID).agg(F.sum("n").cast("long").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    return part.drop("rare").join(rare, RID, "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + gain - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), (F.col("score") + gain).alias("score"),
    )
