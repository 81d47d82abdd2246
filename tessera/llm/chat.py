"""Chat formatting: conversations as token ids with a mask of what is trained on, assembled from segments and read back exactly."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, running_totals

START, HEAD, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PIECE = 1 << 16  # characters that the tokenizer gets at once
BREAK = re.compile(r"(?s).*\S(?=\s)")
_coders: dict = {}


def escaped(text: Column) -> Column:
    """One backslash more between < and |, however many there are: no control string is left in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


class Coder:
    """Byte-level token ids of text, and the bytes of ids. Three ids beyond the vocabulary are reserved for the control strings."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        free = max(ranks.values()) + 1
        self.start, self.head, self.end = free, free + 1, free + 2
        self.bytes = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> list[int]:
        """A text over PIECE characters is cut where words end, which gives the same ids; a longer stretch without white space is cut anywhere."""
        if len(text) <= PIECE:
            return self._encode(text)
        out, at = [], 0
        while at < len(text):
            m = BREAK.match(text, at, at + PIECE + 1) if len(text) - at > PIECE else None
            to = m.end() if m else at + PIECE
            out += self._encode(text[at:to])
            at = to
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def assembled(code: Coder, roles: list[str], texts: list[str], trained: set[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all turns, their loss mask, the number of ids of each turn). Reserved ids are spliced in between the segments, and
    the mask is the running sum of +1 where a trained text begins and -1 where it ends."""
    segments = []
    for role, text in zip(roles, texts):
        segments += [[code.start], code.encode(role), [code.head], code.encode(text), [code.end]]
    sizes = np.array([len(s) for s in segments], np.int64).reshape(-1, 5)
    ends = np.cumsum(sizes).reshape(-1, 5)
    ids = np.fromiter((i for s in segments for i in s), np.int32, int(ends[-1, -1]) if len(ends) else 0)
    marks = np.zeros(len(ids) + 1, np.int32)
    own = np.array([r in trained for r in roles], bool)
    np.add.at(marks, ends[own, 2], 1)
    np.add.at(marks, ends[own, 3], -1)
    return ids, np.cumsum(marks[:-1]).astype(bool), sizes.sum(axis=1)


def format_turns(turns: DataFrame, vocabulary: str, pattern: str, trained: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conversation, turn, position (from 0), offset (ids before it in its conversation), ids, loss (a mask over ids).

    The ids of a conversation are those of its turns by position. A turn is START, its role, HEAD, its text, END; control
    strings are single reserved ids, and text can't make one: segments are encoded apart, and escaped besides, so that even
    the text form, control strings written out, is read back exactly. The mask holds the texts of trained roles alone.

    Turns are ordered by turn, null first, then role and text, so ties have one order but for rows that are equal. Null roles
    and texts are empty, a null conversation is one of its own, other columns don't pass. Positions and offsets are
    global prefix sums: a conversation may span many tasks. Empty table, empty result.
    """
    path = vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            ids, loss, sizes = assembled(code, batch.column("role").to_pylist(), batch.column("text").to_pylist(), set(trained))
            offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, loss)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), batch.column("tie"), pa.array(sizes, pa.int64()), *lists], names=["conv", "turn", "tie", "n_ids", "ids", "loss"])

    kinds = {c: turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col)}
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.sha2(F.concat(role, F.lit("\n"), text), 256).alias("tie"), escaped(role).alias("role"), escaped(text).alias("text"))
    rows = rows.withColumn("tie", F.concat("role", F.lit("\n"), "tie"))
    coded = rows.mapInArrow(run, f"conv {kinds[conv_col]}, turn {kinds[turn_col]}, tie string, n_ids long, ids array<int>, loss array<boolean>")
    keyed = coded.withColumns({"__null": F.col("conv").isNull(), "__conv": F.coalesce(F.col("conv").cast("string"), F.lit(""))})
    placed = running_totals(keyed, ["turn", "tie"], ["n_ids"], ["__null", "__conv"])
    return placed.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("index").alias("position"), F.col("n_ids_before").alias("offset"), "ids", "loss")


def read_turns(formatted: DataFrame, vocabulary: str, pattern: str, conv_col: str = "conv_id") -> DataFrame:
    """What format_turns' rows say: conversation, position, role, text, loss_text (what the mask holds) and chars (code points of the
    text form). Ids that aren't a whole turn, or a mask that cuts a character, are an error."""
    path = vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        fixed = len(START) + len(HEAD) + len(END)
        for batch in batches:
            out: list[tuple[str, str, str, int]] = []
            for ids, loss in zip(batch.column("ids"), batch.column("loss")):
                ids, loss = ids.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False)
                heads = np.flatnonzero(ids == code.head)
                if len(heads) != 1 or ids[0] != code.start or ids[-1] != code.end:
                    raise ValueError("not the ids of one turn")
                role, text = code.decode(ids[1 : heads[0]]), code.decode(ids[heads[0] + 1 : -1])
                out.append((unescaped(role), unescaped(text), unescaped(code.decode(ids[loss])), fixed + len(role) + len(text)))
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("position"), *columns], names=["conv", "position", "role", "text", "loss_text", "chars"])

    kind = formatted.schema[conv_col].dataType.simpleString()
    rows = formatted.select(F.col(conv_col).alias("conv"), "position", "ids", "loss")
    return rows.mapInArrow(run, f"conv {kind}, position long, role string, text string, loss_text string, chars long").withColumnRenamed("conv", conv_col)


def digests(read: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation: n_turns, turns_sha256 (of role, LF, text, LF per turn), loss_chars and loss_sha256 (of what the mask
    holds), formatted_chars.

    SHA-256 goes from the first byte to the last, so a conversation's turns pass through one task in order; the task holds a
    batch and the state of two hashes, however long the conversation is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        state: list = []

        def row() -> pa.RecordBatch:
            conv, n, turns, chars, loss, written = state
            values = [[n], [turns.hexdigest()], [chars], [loss.hexdigest()], [written]]
            return pa.RecordBatch.from_arrays([conv, *map(pa.array, values)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        done: list[pa.RecordBatch] = []
        for batch in batches:
            convs = batch.column("conv").to_pylist()
            for i, (conv, role, text, loss, chars) in enumerate(zip(convs, *(batch.column(c).to_pylist() for c in ("role", "text", "loss_text", "chars")))):
                if not state or conv != now:
                    if state:
                        done.append(row())
                    now, state = conv, [batch.column("conv").slice(i, 1), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += chars
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if state:
            yield row()

    kind = read.schema[conv_col].dataType.simpleString()
    rows = read.withColumnRenamed(conv_col, "conv").repartition(partitions(read.sparkSession), "conv").sortWithinPartitions("conv", "position")
    return rows.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv_col)
