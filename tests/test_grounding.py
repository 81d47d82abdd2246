"""Claims against evidence: numbers, scopes and topics by hand, and numbers against a plain comparison."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from tessera.operators import grounding as G
from tessera.plans.registry import QUERIES, SQL

CLAIM, EVIDENCE = "claim long, run long, text string, cited array<long>", "id long, run long, text string, scope string, period string"


def checked(spark, claims, evidence):
    out = G.grounded_claims(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(evidence, EVIDENCE))
    return {r.claim: tuple(r)[1:] for r in out.collect()}


def test_rules(spark):
    evidence = [(1, 0, "Sales were €5.02 million, a margin of 12%.", "group", "2024"), (2, 0, "It sold 3 bn.", "Watches", "2024"), (3, 0, "Plain words", None, None), (4, 0, "Inflation rose", "Watches", "2023"), (5, 1, "other run", "Shoes", None)]
    claims = [
        (10, 0, "Sales of 5,000 thousand and a margin of 12%", [1, 1, 99]), (11, 0, "12 shops and 3.0bn sold", [1, 2]), (12, 0, "Group profit was 7", [3]), (13, 0, "Peer group view", [3]), (14, 0, "The watches division sold", [3]), (15, 0, "Shoes sold", [3]),
        (16, 0, "Inflation hits", [2]), (17, 0, "Inflation hits", [4]), (18, 0, "Inflation hits", [2, 3]), (19, 0, None, None), (20, 0, "5.1 million", [1]), (21, 0, "6 million", [98]),
    ]
    no = (False, False, False)
    assert checked(spark, claims, evidence) == {
        10: (1, 1, 2, 2, *no), 11: (2, 0, 2, 1, True, False, False), 12: (1, 0, 1, 0, False, True, False), 13: (1, 0, 0, 0, *no), 14: (1, 0, 0, 0, False, True, False), 15: (1, 0, 0, 0, *no),
        16: (1, 0, 0, 0, False, False, True), 17: (1, 0, 0, 0, *no), 18: (2, 0, 0, 0, *no), 19: (0, 0, 0, 0, *no), 20: (1, 0, 1, 0, *no), 21: (0, 1, 1, 0, *no),
    }


def test_buckets_lose_no_number(spark):
    """Every pair of values within a hundredth is found, whatever bucket it falls into."""
    rng = random.Random(3)
    values = [round(10 ** rng.uniform(-1, 7), 2) for _ in range(300)]
    near = [round(v * rng.uniform(0.985, 1.015), 2) for v in values]
    text = lambda v: f"{v:.2f}"
    got = checked(spark, [(i, 0, text(v), [i]) for i, v in enumerate(values)], [(i, 0, text(v), None, None) for i, v in enumerate(near)])
    assert {i for i, r in got.items() if r[3]} == {i for i, (a, b) in enumerate(zip(values, near)) if abs(a - b) <= max(a, b) * 0.01}


def test_numbers_of_a_text(spark):
    rows = spark.createDataFrame([("1,234.5 k, 12 % and 7m in 2024; 5 meters, 3x",), (None,), ("0",)], "t string").select(G.numbers(F.col("t")).alias("n")).collect()
    assert [[(x.value, x.percent) for x in r.n] for r in rows] == [[(1234500.0, False), (12.0, True), (7e6, False), (2024.0, False), (5.0, False)], [], [(0.0, False)]]


def test_numbers_are_whole_and_finite(spark):
    """none is cut where a word goes on, or is one that no double holds."""
    texts = ["1.5x, 15.25x and 1,000x", "d48fd8e940a", "9" * 400, "8" * 305 + " billion", "1.234,5,6"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(G.numbers(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [[]] * len(texts)
    assert checked(spark, [(1, 0, "9" * 400 + " and 5", [1])], [(1, 0, "5 and " + "9" * 400, None, None)])[1][2:4] == (1, 1)


ODD = {
    "codes": ["token d48fd8e940a86f41832370bc4dd81bc9", "AKIA45000YT55JDR", "45000fd", "12mnx 3bnx 7m5", "3%x"],
    "cut": ["1.5x", "45.000x 45,000x", "12.5%3"],
    "commas": ["1.234,5,6", "1,234.5 and 1.234,5"],
    "long": ["9" * 400, "8" * 305 + " billion", "0" * 400 + "7"],
    "edges": ["12\x0bm", "45 mé", "5 \u212a", "45 m\u0130llion"],
    "words": ["Stopwatches", "the watches.", "épeer group", "peer group peer-groups peer\x0bgroup", "peer groupings", "INFLAT\u0130ON", None],
}


@pytest.mark.parametrize("kind", ODD)
def test_query_and_sql_have_one_rule(spark, tmp_path, kind):
    """on texts that the given tables have few of, and on conversations of over a thousand turns."""
    texts = ODD[kind]
    spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(97)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(i, t, "assistant", texts[(i + t) % len(texts)]) for i in range(100) for t in (0, 1, 2, 3, 4, 1000, 2003)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = QUERIES["claim_grounding"](spark, str(tmp_path))
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL['claim_grounding']})").fetchall())
    assert len({r[0] for r in rows}) == len(turns)
