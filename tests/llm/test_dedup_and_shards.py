import collections
import hashlib
import zlib

import pytest
from llm.awkward import AWKWARD
from tessera.llm import exact_dedup, mixing, sharding
from tessera.llm.common import RID, components


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def least(x):
    return float("-inf") if x is None else x


def test_exact_groups_against_dict(spark, make, sf):
    real = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for rows, share in ((AWKWARD, 1000), (AWKWARD * 3, 4), (real, 20)):
        groups = collections.defaultdict(list)
        for d, t, _ in rows:
            groups[hashlib.sha256(lower(t).encode()).hexdigest()].append(d)
        got = exact_dedup.exact_groups(make(rows), share=share).collect()
        assert len(got) == len(rows)
        kept = collections.Counter()
        for r in got:
            ids = groups[r.text_sha256]
            assert r.group_size == len(ids) and least(r.keep_id) == max(map(least, ids)) and (not r.kept or r.doc_id == r.keep_id)
            kept[r.text_sha256] += r.kept
        assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_dedup_keeps_columns_and_one_row(make):
    docs = make(AWKWARD)
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert out.count() == len({lower(t) for _, t, _ in AWKWARD})
    assert exact_dedup.dedup(make([])).count() == 0


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shards(make, shards):
    rows = AWKWARD * 4
    got = sharding.shard(make(rows), shards).collect()
    want = collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    total, biggest = sum(r.size for r in got), max(r.size for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for s, rs in by.items():
        assert 0 <= s < shards and sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - total / shards) <= biggest
    order = [least(r.doc_id) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)  # contiguous
    assert sharding.shard(make([]), shards).count() == 0


def test_components(spark):
    import random

    random.seed(5)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(120)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def fill(sizes, weights, total, cap):
    out, open_ = {}, dict(weights)
    left = total
    while open_:
        w = sum(open_.values())
        over = {s for s in open_ if left * open_[s] / w > cap * sizes[s]}
        if not over:
            return out | {s: left * open_[s] / w for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            del open_[s]
    return out


@pytest.mark.parametrize("block", [2, 7, 128])
def test_mix_meets_targets(spark, make, sf, block):
    real = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60").collect()]
    for rows in (AWKWARD, real):
        docs = make(rows)
        documents, placed = mixing.mix(docs, block=block, shard_slots=50)
        documents, placed = documents.collect(), placed.collect()
        words = collections.Counter()
        for _, t, s in rows:
            words[s] += len((t or "").encode().split())
        assert sum(r["size"] for r in documents) == sum(words.values()) and len(documents) == len(rows)
        ranks = {s: i for i, s in enumerate(sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [None] * (None in words))}
        want = fill(words, {s: (5, 2, 1)[ranks[s] % 3] for s in words}, 1.5 * sum(words.values()), 2)
        size = {r[RID]: r["size"] for r in documents}
        for s in words:
            mine = {r[RID] for r in documents if r["rank"] == ranks[s]}
            target = next(r.target for r in documents if r["rank"] == ranks[s])
            assert abs(target - want[s]) < 1e-6 * (1 + want[s])
            assert sum(r.n_words for r in placed if r[RID] in mine) == int(target + 0.5)
        taken = collections.defaultdict(list)
        for r in placed:
            taken[r[RID]] += range(r.first_word, r.first_word + r.n_words)
        for row, at in taken.items():
            assert max(collections.Counter(at).values()) <= 2 and max(at) < size[row] and len(at) <= 2 * size[row]
        at = collections.defaultdict(set)
        for r in placed:
            at[r.output_shard].add(r.position)
        last = max(at, default=0)  # shards of equal size, with positions gapless from 0 (a block without words has none)
        assert set(at) == set(range(last + 1)) and all(max(p) < 50 and (s == last or len(p) >= 40) for s, p in at.items())
        every = {(r.output_shard, r.position) for r in placed}
        assert len({(r.rank, r.turn, r.block, r.output_shard, r.position) for r in placed}) == len(every)
        assert sorted(map(tuple, mixing.mix(docs, block=block, shard_slots=50)[1].collect())) == sorted(map(tuple, placed))
    assert mixing.mix(make([]))[1].count() == 0 and mixing.mix(make([]))[0].count() == 0


def test_shards_draw_sources_in_proportion(make):
    """Counts of sources per shard vary as draws without replacement do."""
    rows = [(i, "w " * 64, "a" if i % 3 else "b") for i in range(1800)]
    _, placed = mixing.mix(make(rows), block=8, shard_slots=200)
    counts = collections.defaultdict(collections.Counter)
    for r in placed.select("output_shard", "position", "rank").distinct().collect():
        counts[r.output_shard][r["rank"]] += 1
    full = [c for s, c in counts.items() if s < max(counts)]
    assert all(sum(c.values()) == 200 for c in full) and len(full) > 80
    total = sum((c for c in full), collections.Counter())
    p = total[0] / sum(total.values())
    mean, variance = 200 * p, sum((c[0] - 200 * p) ** 2 for c in full) / len(full)
    assert 0.6 * mean * (1 - p) < variance < 1.5 * mean * (1 - p)


def test_permutation_is_one_and_has_its_inverse(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 5, 64, 999):
        df = spark.range(n).select(F.col("id").alias("x"), F.lit(n).cast("long").alias("n")).withColumn("keys", mixing.round_keys(1, F.lit(3), F.lit(0), F.col("n")))
        go = lambda c, back: mixing.permuted(F.col(c), 1, F.lit(3), F.lit(0), F.col("n"), F.col("keys"), back)
        rows = df.withColumn("y", go("x", False)).withColumn("z", go("y", True)).collect()
        assert sorted(r.y for r in rows) == list(range(n)) and all(r.z == r.x for r in rows)
        assert n < 60 or sum(r.x == r.y for r in rows) < 12


def test_mixed_documents_hold_the_words(make):
    docs = make(AWKWARD)
    out = mixing.mixed_documents(docs, block=4)
    assert out.columns == docs.columns
    _, placed = mixing.mix(docs, block=4)
    assert sum(len(r.text.encode().split()) for r in out.collect()) == sum(r.n_words for r in placed.collect())
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert mixing.mixed_documents(make([])).count() == 0
