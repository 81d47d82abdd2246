"""Many phrases in many texts: one pass of an automaton over each text, whatever the number of phrases."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 100_000  # phrases of one automaton, some 100 MB in a task; more phrases take several passes
ROWS = 256  # texts whose finds a task holds in Python before it hands them on
MODES = ("anywhere", "word", "spaced")
SPACE = frozenset(" \t\n\r\x0b\x0c")


def _passes(phrases: Iterable[tuple[str, str]], most: int) -> Iterator[list[tuple[str, str]]]:
    part: list[tuple[str, str]] = []
    for p in phrases:
        part.append(p)
        if len(part) == most:
            yield part
            part = []
    if part:
        yield part


def matches(df: DataFrame, keys: list[str], text_col: str, phrases: Iterable[tuple[str, str]], most: int = MOST) -> DataFrame:
    """keys, mode, phrase, n (occurrences) and first (place in the text in lower case) of each phrase that a text holds.

    phrases are (phrase in lower case, mode): `anywhere` as a part of words too, `word` between characters that aren't letters, digits or
    underscores, `spaced` between white space or ends. Case doesn't count. Occurrences may overlap. A text is read once, by an
    Aho-Corasick automaton, for every `most` phrases. Null and empty texts have none; empty phrases are an error; nothing is shuffled.
    """
    out = None
    for part in _passes(dict.fromkeys(phrases), most):
        assert all(p and p == p.lower() and m in MODES for p, m in part), "a phrase is empty, not in lower case, or of an unknown mode"
        found = _one_pass(df, keys, text_col, part)
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no phrases")
    return out


def _one_pass(df: DataFrame, keys: list[str], text_col: str, part: list[tuple[str, str]]) -> DataFrame:
    hit = pa.struct([("mode", pa.string()), ("phrase", pa.string()), ("n", pa.int32()), ("first", pa.int32())])
    held = df.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        modes: dict[str, list[str]] = {}
        for phrase, mode in held.value:
            modes.setdefault(phrase, []).append(mode)
        for phrase in modes:
            automaton.add_word(phrase, phrase)
        automaton.make_automaton()
        inner = lambda c: c.isalnum() or c == "_"
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            rows = []
            for t in batch.column("__text"):
                text, found = (t.as_py() or "").lower(), {}
                for end, phrase in automaton.iter(text):
                    start = end - len(phrase) + 1
                    before, after = text[start - 1] if start else " ", text[end + 1] if end + 1 < len(text) else " "
                    for mode in modes[phrase]:
                        if mode == "word" and (inner(before) or inner(after)) or mode == "spaced" and not (before in SPACE and after in SPACE):
                            continue
                        at = found.setdefault((mode, phrase), [0, start])
                        at[0] += 1
                rows.append([{"mode": m, "phrase": p, "n": n, "first": first} for (m, p), (n, first) in found.items()])
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__k{i}") for i in range(len(keys))), pa.array(rows, pa.list_(hit))], names=[*(f"__k{i}" for i in range(len(keys))), "__hits"])

    schema = ", ".join(f"__k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    rows = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(text_col).alias("__text"))
    out = rows.mapInArrow(run, f"{schema}, __hits array<struct<mode:string,phrase:string,n:int,first:int>>").filter(F.size("__hits") > 0)
    return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], F.inline("__hits"))
