"""Streams over the feed give what the same rows give in a batch."""

import pytest
from pyspark.sql import functions as F
from tessera.streaming import events as ST


@pytest.fixture
def run(spark, tmp_path):
    def go(df, mode):
        out = str(tmp_path / "out")
        q = df.writeStream.format("memory").queryName("streamed").outputMode(mode).option("checkpointLocation", out).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [tuple(r) for r in spark.table("streamed").collect()]

    return go


@pytest.fixture
def feed(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_tumbling(spark, sf, run, feed):
    got = run(ST.tumbling_counts(ST.event_stream(spark, sf)), "complete")
    want = feed.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count(F.lit(1)), F.sum("value")).collect()
    assert {(a, b, n, round(v, 4)) for a, b, n, v in got} == {(r[0], r[1], r[2], round(r[3], 4)) for r in want}


def test_sessions(spark, sf, run, feed):
    got = run(ST.sessions(ST.event_stream(spark, sf), "6 hours"), "complete")
    assert sum(n for *_, n in got) == feed.count()
    by_user = {}
    for u, a, b, _ in got:
        by_user.setdefault(u, []).append((a, b))
    assert all(x[1] <= y[0] for s in by_user.values() for x, y in zip(sorted(s), sorted(s)[1:]))


def test_distinct(spark, sf, run, feed):
    assert len(run(ST.distinct_events(ST.event_stream(spark, sf)).select("event_id"), "append")) == feed.select("event_id").distinct().count()
