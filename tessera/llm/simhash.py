"""SimHash near-duplicates, linked through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, components, kept_numbers, numbered, partitions, stored

BITS, BLOCKS, FANOUT = 64, 4, 8


def fingerprint(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the XXH64 of the text's shingles; 0 for no words."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """RID, id, fp (the 64 bits as a signed long). A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint((text.as_py() or b"").lower().split(), width) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(RID), batch.column("id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=[RID, "id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return numbered(docs).select(RID, F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"{RID} long, id {kind}, fp long")


def split_mask(mask: int) -> list[int]:
    """mask plus each of BLOCKS nearly equal runs of the bits that it lacks: bits two fingerprints may share when they differ in fewer."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(free), BLOCKS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: str):
    """The place of a word in the reflected Gray sequence: the XOR of all its right shifts."""
    x = F.col(fp)
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x


class GrayIndex:
    """Index over fingerprints that are sorted by group and Gray rank.

    Nodes of a level cover FANOUT nodes of the level below within a group, up to one root per group. A node keeps the
    bits that all its fingerprints share but its parent's don't. A search goes down from the root and adds up the
    differences in those bits: over `most` the whole node goes; if even all bits not shared can't exceed it, the whole
    node is linked.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray, most: int):
        self.fps, self.most = fps, most
        n = len(fps)
        self.shared, self.pattern, self.first, self.last = [np.full(n, ~np.uint64(0))], [fps], [np.arange(n)], [np.arange(1, n + 1)]
        self.child: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(n), np.arange(1, n + 1))]
        ones, zeros, of = fps, fps, group
        while len(of) > len(np.unique(of)) if len(of) else False:
            new = np.r_[True, of[1:] != of[:-1]]
            start = np.flatnonzero(new)
            within = np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))
            head = np.flatnonzero(within % FANOUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, head), np.bitwise_or.reduceat(zeros, head)
            tail = np.r_[head[1:], len(of)]
            self.first.append(self.first[-1][head])
            self.last.append(self.last[-1][tail - 1])
            self.child.append((head, tail))
            self.shared.append(~(ones ^ zeros))
            self.pattern.append(ones)
            of = of[head]
        self.new: list[np.ndarray] = []  # per level: shared bits that the parent's lack
        for level, shared in enumerate(self.shared):
            parent = np.zeros(len(shared), np.uint64)
            if level + 1 < len(self.shared):
                head, tail = self.child[level + 1]
                parent = np.repeat(self.shared[level + 1], tail - head)
            self.new.append(shared & ~parent)
        self.roots = of

    def links(self, limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(q, first, last): fingerprint q is within `most` of all fingerprints from first to before last; q < last."""
        top = len(self.shared) - 1
        if not len(self.fps):
            return
        size = self.last[top] - self.first[top]
        todo = [(top, np.arange(len(self.fps)), np.repeat(np.arange(len(size)), size), np.zeros(len(self.fps), np.uint8))]
        while todo:
            level, q, node, was = todo.pop()
            if len(q) > limit:
                half = len(q) // 2
                todo += [(level, q[half:], node[half:], was[half:]), (level, q[:half], node[:half], was[:half])]
                continue
            far = was + np.bitwise_count((self.fps[q] ^ self.pattern[level][node]) & self.new[level][node])
            keep = (far <= self.most) & (self.last[level][node] > q + 1)
            q, node, far = q[keep], node[keep], far[keep]
            near = far + np.bitwise_count(~self.shared[level][node]) <= self.most
            if near.any():
                yield q[near], self.first[level][node[near]], self.last[level][node[near]]
            if level and not near.all():
                q, node, far = q[~near], node[~near], far[~near]
                head, tail = self.child[level]
                n = tail[node] - head[node]
                at = np.repeat(head[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                todo.append((level - 1, np.repeat(q, n), at, np.repeat(far, n)))


def local_roots(fps: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """For each fingerprint the index of the first one that it reaches within its group."""
    root = np.arange(len(fps))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up

    for q, first, last in GrayIndex(fps, group, most).links():
        one = last - first == 1
        join(q[one], first[one])
        if not one.all():  # a whole node: join q to its ends and each node, once, along itself
            q, spans = q[~one], np.unique(np.stack([first[~one], last[~one]]), axis=1)
            join(q, first[~one])
            for a, b in spans.T.tolist():
                join(np.arange(a, b - 1), np.full(b - 1 - a, b - 1))
    return root


def link(distinct: DataFrame, most: int = 3, limit: int = 16384) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that have the components of all links of at most `most` bits.

    Two fingerprints that differ in under BLOCKS bits agree in one of BLOCKS runs of any bits that are still free, so all
    links lie within groups of equal masked bits. Groups over `limit` are split by a further run of their free bits,
    again and again: after at most six splits under 12 bits are free, which bounds a group. Within a group, in Gray order,
    GrayIndex finds the links; what leaves a task is one edge per fingerprint at most, not all pairs.
    """
    if most >= BLOCKS:
        raise ValueError(f"links of {most} bits need more than {BLOCKS} runs of bits")
    spark, n = distinct.sparkSession, partitions(distinct.sparkSession)
    masks = {0: split_mask(0)}
    todo = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    edges = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            mask, value, fp = (table.column(c).to_numpy() for c in ("mask", "value", "fp"))
            group = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]) if len(fp) else fp
            root = local_roots(fp.view(np.uint64), group, most)
            own = root != np.arange(len(fp))
            return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], names=["a", "b"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:  # all groups but the last, which may go on, are complete
                table = pa.Table.from_batches(held).combine_chunks()
                mask, value = table.column("mask").to_numpy(), table.column("value").to_numpy()
                same = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
                if len(same):
                    yield solve(table.slice(0, same[-1] + 1).combine_chunks())
                    table = table.slice(same[-1] + 1)
                held, rows = table.to_batches(), table.num_rows
        if rows:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    for depth in range(7):
        if not depth:
            parts = F.array(*[F.lit(signed(p)) for p in split_mask(0)])
        else:  # a row for each mask, at most BLOCKS ** depth
            table = spark.createDataFrame([(signed(mask), list(map(signed, parts))) for mask, parts in masks.items()], "mask long, parts array<long>")
            todo, parts = todo.join(F.broadcast(table), "mask"), F.col("parts")
        keyed = todo.select("fp", F.explode(parts).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        masks = {p: split_mask(p) for parts in masks.values() for p in parts}
        if depth < 6:
            keyed = stored(keyed, "keyed")
            hot = stored(keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("mask", "value"), "hot")
            split = not hot.isEmpty()
        else:
            split = False
        calm = keyed.join(hot, ["mask", "value"], "left_anti") if split else keyed
        found = calm.select("fp", "mask", "value", gray_rank("fp").alias("rank")).repartition(n, "mask", "value").sortWithinPartitions("mask", "value", "rank").mapInArrow(run, "a long, b long")
        edges = found if edges is None else edges.union(found)
        if not split:
            break
        todo = keyed.join(hot, ["mask", "value"], "left_semi").select("fp", "mask")
    return edges


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3, width: int = 3) -> DataFrame:
    """One row per document: RID, id, fingerprint (16 hex digits), component_id (smallest id reachable over links of at most
    `most` bits) and kept (true for one document of each component, of that id).

    Words are maximal runs without ASCII white space after lower-casing A-Z; a text under `width` words is one shingle;
    null texts and texts without words have fingerprint zero. Null ids count as largest; a component of null ids alone
    has a null component_id. Of rows with equal id the first read is kept. Empty table, empty result.
    """
    fps = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", RID)).alias("best")), "distinct")
    roots = components(link(distinct, most))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "best")
    best = rooted.groupBy("root").agg(F.min("best").alias("best"))
    of = rooted.select("fp", "root").join(best, "root").select("fp", "best")
    return fps.join(of, "fp").select(RID, F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.id").alias("component_id"), (F.col(RID) == F.col(f"best.{RID}")).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of its smallest id; all columns stay, whatever their names.

    Shingles of three words and at most three bits, as in near_groups: the rule of op9's contract. Texts without words are one
    component, null ones too; of rows with equal text and id one stays. Empty table, empty result.
    """
    docs = kept_numbers(docs)
    gone = near_groups(docs, id_col, text_col).filter(~F.col("kept")).select(RID)
    return docs.join(gone, RID, "left_anti").drop(RID)
