"""Periodic runs: stretches of words that repeat at a fixed distance, caught online as the words come."""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE, HELD = 1 << 16, 1 << 18  # words appended at once at first; words of whole documents after which a catcher starts afresh


class SquareCatcher:
    """Finds the runs of a growing sequence of integers.

    Level k has a catcher over each completed block of L = 2**k words whose start is a multiple of L. It waits for the block
    to come again at a distance q of 2L-1 to 4L-2 words: the first half of every square of such a period holds a whole block, so
    none is missed, and at any time two catchers of a level wait. An appended word ends one suffix of L words at each level;
    the suffix is compared, by its name, with the two blocks. Names of 2L words are made of the names of their halves;
    equal words have equal names, and the converse is checked word by word. A run of `exponent` periods is caught by
    several neighbouring catchers at one distance, which is waited for. The squares caught so merge into one stretch,
    which grows to the left at once, and to the right as words are appended while they agree.
    """

    def __init__(self, exponent: int = 4, shortest: int = 6, widest: int | None = None):
        """widest: no run is longer, which spares levels."""
        assert exponent >= 2
        self.exponent, self.shortest, self.widest, self.n = exponent, shortest, widest, 0
        self.words = np.empty(0, np.int64)
        self.names: list[tuple[int, np.ndarray]] = []  # of each level: place of the first name kept, names of the suffixes that end there and later
        self.cover = np.empty(0, np.int32)  # the longest run over a word, as place in found
        self.found, self.count = np.empty((16, 3), np.int64), 0  # start, end, period
        self.open: dict[int, list[int]] = {}  # period: first and last place (not included) that agrees with the word a period before; place in found or -1

    @staticmethod
    def _room(old: np.ndarray, n: int) -> np.ndarray:
        if len(old) >= n:
            return old
        new = np.full((max(n, 2 * len(old)), *old.shape[1:]), -1, old.dtype)
        new[: len(old)] = old
        return new

    def _agree(self, at: int, q: int, step: int, size: int = 32) -> int:
        """The number of words from `at` on, forwards or backwards, that equal the word q before."""
        w, done = self.words, 0
        while True:
            most = min(size, self.n - at - done if step > 0 else at - done - q + 1)
            if most <= 0:
                return done
            lo = at + done if step > 0 else at - done - most + 1
            same = w[lo : lo + most] == w[lo - q : lo - q + most]
            if not same.all():
                return done + int(np.argmin(same if step > 0 else same[::-1]))
            done, size = done + most, 2 * size

    def _settle(self, q: int, span: list[int]) -> None:
        """Notes a stretch that is long enough as a run, or that the run has grown."""
        first, last, at = span
        start = first - q
        if last - start < max(self.shortest, self.exponent * q):
            return
        if at < 0:
            span[2] = at = self.count
            self.found, self.count = self._room(self.found, at + 1), at + 1
            self.found[at] = start, last, q
            part = self.cover[start:last]
            part[(part < 0) | (self.found[part, 1] - self.found[part, 0] < last - start)] = at
        else:
            self.cover[self.found[at, 1] : last] = at
            self.found[at, 1] = last

    def append(self, words: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(words)
        self.words, self.cover = self._room(self.words, self.n), self._room(self.cover, self.n)
        self.words[old : self.n] = words
        for q in sorted(self.open):  # stretches that reached the end go on, while the words agree
            span = self.open[q]
            span[1] += self._agree(old, q, 1)
            self._settle(q, span)
            if span[1] < self.n:
                del self.open[q]
        level, most = 0, min(self.n, self.widest or self.n)
        while self.exponent * ((2 << level) - 1) <= most:
            self._level(level, old)
            level += 1
        for k, (first, names) in enumerate(self.names[:-1]):  # kept is what later words, and the next level, look back to
            keep = self.n - 12 * (1 << k)
            if keep > first:
                self.names[k] = (keep, names[keep - first :].copy())

    def _level(self, k: int, old: int) -> None:
        size, n = 1 << k, self.n
        least = 2 * size - 1
        need = max(1, ((self.exponent - 1) * least - size + 1) // size)  # whole blocks in what agrees, of a run of the least length
        if k == len(self.names):  # until now no run was long enough
            self.names.append((size - 1, np.empty(0, np.uint64)))
            old = 0
        first, names = self.names[k]
        done = first + len(names)
        if k == 0:
            new = self.words[done:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        else:  # the halves' names, of the level below, which has kept what is needed
            half, (below, named) = size >> 1, self.names[k - 1]
            a, b = named[done - half - below : n - half - below], named[done - below : n - below]
            new = (a * np.uint64(0xBF58476D1CE4E5B9) + b) * np.uint64(0x94D049BB133111EB)
            new ^= new >> np.uint64(29)
        names = np.concatenate([names, new])
        self.names[k] = (first, names)
        at = np.arange(max(old - (need - 1) * size, 3 * size - 2), n)  # the ends of suffixes that have a block to meet
        if len(at):
            suffix, block = names[at - first], ((at - least + 1) >> k << k) - 1
            caught = []
            for _ in range(2):
                there = block >= size - 1
                same = np.zeros(len(at), bool)
                same[there] = suffix[there] == names[block[there] - first]
                for _ in range(need - 1):  # the blocks before were caught at the same distance
                    same[size:] &= same[:-size] if len(same) > size else False
                    same[:size] = False
                    if not same.any():
                        break
                hit = at[same]
                caught.append(np.stack([hit - block[same], hit], axis=1)[hit >= old])
                block = block - size
            caught = np.concatenate(caught)
            if len(caught):
                self._merge(caught[np.lexsort((caught[:, 1], caught[:, 0]))], size)

    def _fresh(self, caught: np.ndarray, size: int) -> np.ndarray:
        """Without catches inside a run whose period divides the distance: they are squares of that run."""
        q, end = caught[:, 0], caught[:, 1]
        start = end - q - size + 1
        run = self.cover[(start + end) >> 1]
        inside = run >= 0
        s, e, p = self.found[run[inside]].T
        inside[inside] = (start[inside] >= s) & (end[inside] < e) & (q[inside] % p == 0)
        return caught[~inside]

    def _merge(self, caught: np.ndarray, size: int) -> None:
        """caught: distance and end of suffixes caught, ascending."""
        caught = self._fresh(caught, size)
        cuts = np.flatnonzero(np.diff(caught[:, 0])) + 1
        for group in np.split(caught, cuts) if len(caught) else []:
            q = int(group[0, 0])
            ends = self._fresh(group, size)[:, 1]
            at = len(ends) if q in self.open else 0  # what is open holds all of them
            while at < len(ends):
                end = int(ends[at])
                back = self._agree(end, q, -1)
                if back < size:  # equal names of different words
                    at += 1
                    continue
                span = [end - back + 1, end + 1 + self._agree(end + 1, q, 1), -1]
                self._settle(q, span)
                if span[1] == self.n:
                    self.open[q] = span
                at = int(np.searchsorted(ends, span[1]))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs so far, by start and period; a run found by several distances has the smallest."""
        least: dict[tuple[int, int], int] = {}
        for s, e, q in self.found[: self.count].tolist():
            least[s, e] = min(q, least.get((s, e), q))
        return sorted((s, e - s, q) for (s, e), q in least.items())


def _runs_of(documents: list[list[bytes]], exponent: int, shortest: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each document. One catcher takes all: a mark of its own stands after each, so no run goes on."""
    catcher, numbers = SquareCatcher(exponent, shortest, max(map(len, documents), default=0)), defaultdict(itertools.count().__next__)
    starts, at = [], 0
    waiting: list[np.ndarray] = []
    for k, words in enumerate(documents):
        starts.append(at)
        waiting.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        waiting.append(np.array([-1 - k]))
        at += len(words) + 1
    whole = np.concatenate(waiting) if waiting else np.empty(0, np.int64)
    at = 0
    while at < len(whole):
        size = max(PIECE, at)
        catcher.append(whole[at : at + size])
        at += size
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for s, length, q in catcher.runs():
        k = int(np.searchsorted(starts, s, "right")) - 1
        out[k].append((s - starts[k], length, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Of each run only the first period stays."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return words if kept.all() else list(itertools.compress(words, kept.tolist()))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length over period; of equal ones the first, then that of the smallest period."""
    return min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None)


def planted(key: str, words: list[bytes]) -> list[bytes]:
    """The words of a document, of which one in ten gets a run at a place that its key decides: a known share to be found."""
    h = zlib.crc32(key.encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def find(docs: DataFrame, exponent: int = 4, shortest: int = 6, before: Callable[[str, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, runs (array of start, length, period, by start and period), strongest (one of them
    or null) and collapsed (the words that stay when each run keeps its first period, joined by a space).

    Words are maximal runs without ASCII white space, numbered from 0, compared byte by byte. A run is a stretch with
    smallest period q, of at least max(shortest, exponent * q) words, that can't be extended at either end. before(id as
    text, words) may change the words first.

    A null text has no words, a null id counts as empty text for `before`; equal rows give equal rows; other columns don't
    pass. Nothing is shuffled; a task holds HELD words, or those of one document, with some ten numbers for each. Empty table, empty result.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = run.names

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(ids: list[pa.Array], documents: list[list[bytes]]) -> pa.RecordBatch:
            found = _runs_of(documents, exponent, shortest)
            best = [strongest(r) for r in found]
            texts = [b" ".join(collapse(w, r)) for w, r in zip(documents, found)]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array(map(len, documents), pa.int64()), pa.array([[dict(zip(names, x)) for x in r] for r in found], pa.list_(run)), pa.array([x and dict(zip(names, x)) for x in best], run), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "runs", "strongest", "collapsed"],
            )

        ids, documents, held = [], [], 0
        for batch in batches:
            keys = batch.column("key").to_pylist() if before else itertools.repeat("")
            for i, (key, text) in enumerate(zip(keys, batch.column("text"))):
                words = (text.as_py() or b"").split()
                documents.append(before(key, words) if before else words)
                ids.append(batch.column("id").slice(i, 1))
                held += len(words)
                if held >= HELD:
                    yield solve(ids, documents)
                    ids, documents, held = [], [], 0
        if ids:
            yield solve(ids, documents)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).cast("binary").alias("text"))
    struct = "struct<start:long,length:long,period:long>"
    return rows.mapInArrow(search, f"id {kind}, n_words long, runs array<{struct}>, strongest {struct}, collapsed string").withColumnRenamed("id", id_col)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of find()'s rows: number of runs, the strongest one with its exponent in thousandths, hashes of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = [F.col("strongest")[c].alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli")
    return found.select(id_col, F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
