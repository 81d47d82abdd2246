"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

SAMPLE = 8192  # vectors that the codebooks are fitted on
TRIAL = 256  # queries whose true neighbours are found by brute force, to choose the number of candidates
CODE_BLOCK, SLICES, SLICE_ROWS = 65536, 4, 16  # codes in a row of the index; parts of the index from which each query's best are gathered, at least, and rows in one


def unit(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def fit(sample: np.ndarray, books: int, words: int, rounds: int, seed: int) -> np.ndarray:
    """Codebooks (books, words, dimensions), each by k-means on the residuals that the earlier ones leave."""
    rng, rest, out = np.random.default_rng(seed), sample.astype(np.float32).copy(), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for turn in range(rounds + 1):
            near = (2 * rest @ c.T - (c * c).sum(axis=1)).argmax(axis=1)
            if turn == rounds:
                break
            n = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            used = np.flatnonzero(n)
            c[used] = np.add.reduceat(rest[order], (np.cumsum(n) - n)[used]) / n[used, None]
        rest -= c[near]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and norms of the sums of codewords; of each vector the `beam` best partial sums go on to the next book."""
    n, (m, k, _) = len(x), books.shape
    rest, codes, row = x.astype(np.float32)[:, None, :], np.zeros((n, 1, 0), np.uint8), np.arange(n)[:, None]
    for c in books:
        score = ((rest**2).sum(axis=2)[:, :, None] - 2 * (rest @ c.T) + (c * c).sum(axis=1)).reshape(n, -1)
        keep = min(beam, score.shape[1])
        best = np.argpartition(score, keep - 1, axis=1)[:, :keep] if keep < score.shape[1] else np.tile(np.arange(keep), (n, 1))
        old, word = best // k, best % k
        rest, codes = rest[row, old] - c[word], np.concatenate([codes[row, old], word[:, :, None].astype(np.uint8)], axis=2)
    best = (rest**2).sum(axis=2).argmin(axis=1)
    return codes[np.arange(n), best], np.linalg.norm(x - rest[np.arange(n), best], axis=1).astype(np.float32)


def tables_of(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Products by book, word, query."""
    return np.ascontiguousarray(books @ x.T)


def scores_of(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Approximate cosines, a row for each code and a column for each query of tables."""
    total = np.zeros((len(codes), tables.shape[2]), np.float32)
    for m in range(len(tables)):
        total += tables[m][codes[:, m]]
    return total / np.maximum(norms, 1e-12)[:, None]


def candidates_needed(usable: DataFrame, asked: DataFrame, codes: DataFrame, books: np.ndarray, beam: int, width: int, k: int, recall: float) -> int:
    """As many candidates as hold the share `recall` of the true k nearest of TRIAL queries: those are found by brute force over
    all vectors, and their places among all codes are counted. The driver holds TRIAL x k rows."""
    spark = usable.sparkSession
    trial = asked.orderBy(F.xxhash64("id"), "id").limit(TRIAL).toArrow().combine_chunks()
    ids, x = trial.column("id").to_numpy(), unit(trial.column("v").combine_chunks(), width)
    held = spark.sparkContext.broadcast((ids, x))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = held.value
        best, of = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                mine = part.column("id").to_numpy()
                s = x @ unit(part.column("v"), width).T
                s[ids[:, None] == mine] = -np.inf
                s, v = np.concatenate([best, s], axis=1), np.concatenate([of, np.broadcast_to(mine, s.shape)], axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best, of = np.take_along_axis(s, top, 1), np.take_along_axis(v, top, 1)
        real = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(real)[0]), pa.array(of[real]), pa.array(best[real])], names=["query", "id", "score"])

    found = usable.mapInArrow(nearest, "query long, id long, score double")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= k)
    true = stored(found.select("query", "id"), "nearest").join(usable, "id").select("query", "v").toArrow().combine_chunks()
    if not len(true):
        return 0
    query = true.column("query").to_numpy()
    mine, norms = encode(unit(true.column("v").combine_chunks(), width), books, beam)
    tables = tables_of(x.astype(np.float32), books)
    least = np.concatenate([scores_of(tables[:, :, query[i : i + 1]], mine[i : i + 1], norms[i : i + 1])[0] for i in range(len(query))])
    bounds = spark.sparkContext.broadcast((tables, query, least))

    def better(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, query, least = bounds.value
        n = np.zeros(len(query), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                codes, norms = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("codes", np.uint8), ("norms", np.float32)))
                codes = codes.reshape(len(norms), -1)
                for c in range(0, len(norms), 4096):
                    n += (scores_of(tables, codes[c : c + 4096], norms[c : c + 4096])[:, query] >= least).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["pair", "n"])

    places = codes.mapInArrow(better, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow().column("n").to_numpy()
    return int(np.sort(places)[max(0, int(np.ceil(recall * len(places))) - 1)])


def neighbours(
    table: DataFrame, every: int = 50, k: int = 5, books: int = 16, words: int = 256, beam: int = 4, rerank: int = 256, query_block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 3, recall: float = 0.95
) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every` its k nearest others by cosine.

    Unit vectors are written as sums of one codeword from each full-dimensional book, fitted to residuals on SAMPLE
    vectors and encoded by beam search; the norm of the sum is stored. Queries, in blocks of query_block, score all codes
    through tables of query-codeword products, block by block; the best candidates of each query over all blocks are scored
    exactly, in double precision, on the original vectors. They are `rerank`, or more where the share `recall` of the true
    neighbours of TRIAL queries needs more in this table (candidates_needed). Ties go to the smaller id.

    Vectors null, zero or holding null or non-finite components take no part, nor do null ids and vectors of another length
    than the most frequent of the table (of equally frequent ones the longest). Of rows with equal id the one with the smallest vector counts. Fewer candidates than k:
    all. Empty table, empty result.
    """
    if not 0 < words <= 256:
        raise ValueError("a code is one byte: a book has at most 256 words")
    spark, n = table.sparkSession, partitions(table.sparkSession)
    good = F.col("v").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    usable = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(good).groupBy("id").agg(F.min("v").alias("v"))
    usable = stored(usable, "vectors")  # read again and again, shuffled once
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = usable.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if length is None:
        return empty
    width = length["width"]
    usable = usable.filter(F.size("v") == width)
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    codebooks = spark.sparkContext.broadcast(fit(unit(sample, width), books, words, 6, seed))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            ids, codes, norms = (np.concatenate(x).tobytes() for x in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([codes], pa.binary()), pa.array([norms], pa.binary())], names=["ids", "codes", "norms"])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                held.append((part.column("id").to_numpy().astype("<i8"), *encode(unit(part.column("v"), width), codebooks.value, beam)))
                if sum(len(h[0]) for h in held) >= CODE_BLOCK:
                    yield out()
        if held:
            yield out()

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, part = batch.column("id").to_numpy(), unit(batch.column("v"), width).astype(np.float32), batch.column("part").to_numpy()
            for run in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(part)) + 1):
                for at in range(0, len(run), query_block):
                    some = run[at : at + query_block]
                    yield pa.RecordBatch.from_arrays([pa.array(part[some[:1]], pa.int64()), pa.array([ids[some].astype("<i8").tobytes()], pa.binary()), pa.array([x[some].tobytes()], pa.binary())], names=["part", "queries", "vectors"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of query block and slice; the best of a slice's codes are kept for each query, and put out at its end."""
        cb, now, qs, x, near, vec = codebooks.value, None, None, None, None, None

        def out() -> pa.RecordBatch:
            real = np.isfinite(near)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, near.shape[1]).reshape(near.shape)[real]), pa.array(vec[real]), pa.array(near[real])], names=["query_id", "vec_id", "near"])

        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[r].as_py(), t)  # noqa: B023, E731
                mark = (batch.column("block")[r].as_py(), batch.column("slice")[r].as_py())
                if mark != now:
                    if now is not None:
                        yield out()
                    now, qs = mark, get("queries", "<i8")
                    x = get("vectors", np.float32).reshape(len(qs), -1)
                    near, vec = np.full((len(qs), rerank + 1), -np.inf, np.float32), np.zeros((len(qs), rerank + 1), np.int64)
                ids, norms = get("ids", "<i8"), get("norms", np.float32)
                codes = get("codes", np.uint8).reshape(len(ids), -1)
                for q in range(0, len(qs), 256):
                    tables = tables_of(x[q : q + 256], cb)
                    for c in range(0, len(ids), 8192):
                        total = scores_of(tables, codes[c : c + 8192], norms[c : c + 8192])
                        s = np.concatenate([near[q : q + 256], total.T], axis=1)
                        v = np.concatenate([vec[q : q + 256], np.broadcast_to(ids[c : c + 8192], total.T.shape)], axis=1)
                        best = np.argpartition(-s, rerank, axis=1)[:, : rerank + 1]
                        near[q : q + 256], vec[q : q + 256] = np.take_along_axis(s, best, 1), np.take_along_axis(v, best, 1)
        if now is not None:
            yield out()

    codes = stored(usable.mapInArrow(code, "ids binary, codes binary, norms binary"), "codes")
    asked = usable.filter(F.pmod("id", F.lit(every)) == 0)
    total = asked.count()
    if not total:
        return empty
    rerank = max(rerank, candidates_needed(usable, asked, codes, codebooks.value, beam, width, k, recall))
    query_block = max(1, min(query_block, (1 << 22) // rerank))  # bounds what a task holds of a block's candidates
    parts = -(-total // query_block)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).repartition(n, "part").sortWithinPartitions("part")
    queries = stored(asked.mapInArrow(block, "part long, queries binary, vectors binary").withColumn("block", F.monotonically_increasing_id()), "queries")
    slices = max(SLICES, -(-codes.count() // SLICE_ROWS))  # tasks grow with the index as well as with the queries
    pairs = codes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(queries, "part")
    sliced = pairs.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int")).repartition(n, "block", "slice").sortWithinPartitions("block", "slice")
    found = sliced.mapInArrow(score, "query_id long, vec_id long, near float").filter("query_id <> vec_id")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))).filter(F.col("place") <= rerank).select("query_id", "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    held = usable.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    q, v = held.select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.col("norm").alias("qn")), held.select(F.col("id").alias("vec_id"), "v", "norm")
    exact = best.join(q.filter(F.pmod("query_id", F.lit(every)) == 0), "query_id").join(v, "vec_id").withColumn("score", dot(F.col("qv"), F.col("v")) / (F.col("qn") * F.col("norm")))
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return exact.select("query_id", top.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
