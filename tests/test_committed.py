"""Atomic commits: replayed batches, late rows, crashed and competing writers; streams into a table."""

import threading

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from tessera.operators import discovery as D
from tessera.operators import events as E
from tessera.sources.committed import CommittedTable
from tessera.sources.sinks import insert_rows
from tessera.streaming import events as ST

SCHEMA = "id long, v string, n long"


@pytest.fixture
def table(spark, tmp_path):
    return CommittedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], "n")


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


def test_upserts_in_any_order(spark, table):
    assert held(table) == []
    assert table.upsert(rows(spark, (1, "a", 1), (2, "b", 5), (1, "c", 3)))
    assert table.upsert(rows(spark, (1, "late", 2), (2, "new", 6), (3, None, None), (None, "x", 1)))
    assert held(table) == sorted([(1, "c", 3), (2, "new", 6), (3, None, None), (None, "x", 1)], key=str)
    assert table.upsert(rows(spark, (1, "same", 3)))
    assert (1, "same", 3) in held(table) and (1, "c", 3) in held(table, 2)
    before = held(table)
    assert table.compact() and held(table) == before and len(table.manifest()["parts"]) == 1
    assert table.clear_unnamed() == 0 and held(table, 1) == [(1, "c", 3), (2, "b", 5)]


def test_replayed_batches_add_nothing(spark, table):
    plain = CommittedTable(spark, table.path + "2", SCHEMA, ["id"])
    assert plain.insert(rows(spark, (1, "a", 1), (1, "a", 1), (2, "b", 2)), ("s", 0))
    assert not plain.insert(rows(spark, (9, "again", 1)), ("s", 0))
    assert plain.insert(rows(spark, (2, "held", 9), (3, "c", 3)), ("s", 1))
    assert plain.insert(rows(spark, (4, "other", 1)), ("z", 0))
    assert [r[0] for r in held(plain)] == [1, 2, 3, 4] and (2, "b", 2) in held(plain)
    with pytest.raises(ValueError):
        plain.upsert(rows(spark, (1, "a", 1)))
    with pytest.raises(ValueError):
        CommittedTable(spark, table.path, SCHEMA, ["nothing"])


def test_a_crashed_write_is_not_seen(spark, table, monkeypatch):
    table.upsert(rows(spark, (1, "a", 1)))
    monkeypatch.setattr(table, "_publish", lambda manifest: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError, match="crash"):
        table.upsert(rows(spark, (1, "b", 2)), ("s", 0))
    again = CommittedTable(spark, table.path, SCHEMA, ["id"], "n")
    assert held(again) == [(1, "a", 1)]
    assert again.upsert(rows(spark, (1, "b", 2)), ("s", 0)) and held(again) == [(1, "b", 2)]
    assert again.clear_unnamed() == 1 and held(again) == [(1, "b", 2)]


def test_a_beaten_writer_builds_on_the_other(spark, table):
    """Between reading the manifest and publishing, another writer inserts the same key."""
    one = CommittedTable(spark, table.path + "3", SCHEMA, ["id"])
    two = CommittedTable(spark, one.path, SCHEMA, ["id"])
    seen = []

    def make(now):
        seen.append(now["version"])
        if len(seen) == 1:
            two.insert(rows(spark, (1, "two", 0)))
        new = rows(spark, (1, "one", 0), (2, "one", 0))
        return new.join(one._rows(now).select("id"), ["id"], "left_anti")

    assert one.commit(make) and seen == [0, 1]
    assert held(one) == [(1, "two", 0), (2, "one", 0)]


def test_writers_at_once_lose_nothing(spark, table):
    one = CommittedTable(spark, table.path + "4", SCHEMA, ["id"])
    failed = []

    def work(k):
        try:
            CommittedTable(spark, one.path, SCHEMA, ["id"]).insert(rows(spark, (k, "w", 0), (100, "shared", 0)))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and [r[0] for r in held(one)] == [0, 1, 100, 2, 3] and one.manifest()["version"] == 4


def streamed(spark, folder, *batches, schema=SCHEMA):
    """A stream that gives one file after another."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_a_stream_upserts_once(spark, table, tmp_path):
    source = tmp_path / "in"
    stream = streamed(spark, source, [(1, "a", 1), (2, "b", 1)], [(1, "late", 0), (2, "c", 2)])
    for checkpoint in ("c1", "c2"):  # the second run has lost its checkpoint and replays both batches
        q = ST.upserts(stream, table, "feed").option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert held(table) == [(1, "a", 1), (2, "c", 2)] and table.manifest()["batches"] == {"feed": 1} and table.manifest()["version"] == 2


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    rows_of = lambda *ts: [(t, "a", 1.0) for t in ts]
    day = lambda s: __import__("datetime").datetime.fromisoformat(f"2025-01-{s}")
    stream = streamed(spark, tmp_path / "in", rows_of(day("01T10:00"), day("01T11:00")), rows_of(day("05T00:00")), rows_of(day("05T00:10")), rows_of(day("01T12:00"), day("04T23:30"), day("05T01:00")), rows_of(day("09T00:00")), rows_of(day("09T00:01")), schema=schema)
    q = ST.tumbling_counts(stream, "1 day", "1 hour").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.start.day: r.n for r in spark.table("late").collect()}
    assert got == {1: 2, 4: 1, 5: 3}


def test_late_rows_of_upserts_are_dropped(spark, tmp_path):
    schema = "id long, ts timestamp, v string"
    day = lambda s: __import__("datetime").datetime.fromisoformat(f"2025-01-{s}")
    t = CommittedTable(spark, str(tmp_path / "t"), schema, ["id"], "ts")
    stream = streamed(spark, tmp_path / "in", [(1, day("01T10:00"), "a")], [(2, day("05T00:00"), "b")], [(5, day("05T00:10"), "c")], [(3, day("01T00:00"), "late"), (4, day("05T01:00"), "in time")], schema=schema)
    q = ST.upserts(stream, t, "s", "1 hour").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.v for r in t.read().collect()) == ["a", "b", "c", "in time"]


def test_insert_rows_needs_its_keys(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(1,)], "other long").write.parquet(path)
    with pytest.raises(AnalysisException):
        insert_rows(spark.createDataFrame([(1, 1)], "id long, other long"), path, ["id"])
    assert spark.read.parquet(path).count() == 1


def test_sets_are_compared_key_by_key(spark):
    old = spark.createDataFrame([("same", "a"), ("same", "b"), ("less", "a"), ("less", "b"), ("gone", "a"), ("null", None)], "g string, k string")
    new = spark.createDataFrame([("same", "b"), ("same", "a"), ("same", "a"), ("less", "a"), ("fresh", "z"), ("null", None)], "g string, k string")
    got = sorted((r.g, r.k, r.is_active, r.origin) for r in E.supersede(old, new, ["g"], ["k"]).na.fill("-").collect())
    assert got == [("fresh", "z", True, "new"), ("gone", "a", True, "old"), ("less", "a", False, "old"), ("less", "a", True, "new"), ("less", "b", False, "old"), ("null", "-", True, "old"), ("same", "a", True, "old"), ("same", "b", True, "old")]


# --- discovery of documents


def found(spark, page, most=12, url="https://www.example.com/ir/index.html", feed=None):
    pages = spark.createDataFrame([(1, url, page)], "k long, url string, html string")
    feeds = spark.createDataFrame([(1, url, feed)], "k long, url string, xml string") if feed else None
    return [(r.url.replace("https://www.example.com", ""), r.title, r.kind, r.strategy) for r in D.discovered(pages, "k", "url", "html", most, feeds).orderBy("place").collect()]


def test_each_strategy(spark):
    assert found(spark, "<a href='ar-2024.pdf?token=s'>Annual <b>report</b></a><a href='/x.pdf'>nothing said</a><a href='https://evil.org/annual-report.pdf'>x</a><a href='http://www.example.com/annual-report.pdf'>x</a>") == [("/ir/ar-2024.pdf", "Annual report", "annual_report", "anchors")]
    assert found(spark, '<script type="application/ld+json">{"name":"Q3 update","url":"/d.pdf","sub":{"url":"https://cdn.example.com/e.pdf"}}</script>') == [("/d.pdf", "Q3 update", "interim_report", "json_ld"), ("https://cdn.example.com/e.pdf", "Q3 update", "interim_report", "json_ld")]
    assert found(spark, '<script id="__NEXT_DATA__">{"a":[{"label":"Slides","f":"/s.pdf"}]}</script>') == [("/s.pdf", "Slides", "presentation", "hydration")]
    assert found(spark, '<script id="__NUXT__">{broken "/t.pdf"</script>') == [("/t.pdf", "t", "other", "hydration")]
    assert found(spark, '<script>window.__APOLLO_STATE__={"t":[1,{"u":"/press-release.pdf"}]};</script>') == [("/press-release.pdf", "press release", "results_release", "hydration")]
    assert found(spark, "<script>f([{\"u\":\"/one.pdf\"}]); g({bad: 'x'})</script>") == [("/one.pdf", "one", "other", "embedded_json")]
    assert found(spark, "<script>load('/two.pdf', \"https://www.example.com/three.pdf\")</script>") == [("/two.pdf", "two", "other", "embedded_json"), ("/three.pdf", "three", "other", "embedded_json")]
    assert found(spark, "", feed="<rss><channel><item><title>Half year</title><link>https://www.example.com/h.pdf</link></item></channel></rss>") == [("/h.pdf", "Half year", "interim_report", "feed")]


def test_identity_rank_and_stop(spark):
    page = (
        "<a href='/annual-results'>annual results</a><a href='/a.pdf?v=1'>interim report</a><a href='/A.pdf'>annual report</a>"
        '<script type="application/ld+json">{"u": ["/a.pdf", "/slides.pdf", "/annual-report-2023.pdf"]}</script><script>x = "/z.pdf"</script>'
    )
    every = [("/annual-report-2023.pdf", "annual report 2023", "annual_report", "json_ld"), ("/annual-results", "annual results", "annual_report", "anchors"), ("/a.pdf?v=1", "interim report", "interim_report", "anchors"), ("/slides.pdf", "slides", "presentation", "json_ld"), ("/z.pdf", "z", "other", "embedded_json")]
    assert found(spark, page) == every
    assert found(spark, page, most=3) == every[:3]
    assert found(spark, page, most=2) == every[1:3]  # each strategy takes two: the annual report of 2023 is its third
    assert found(spark, page, most=1) == [every[1]]  # one wanted document after the first strategy: no other runs


@pytest.mark.parametrize("page", [None, "", "<a href='", "<script type='application/ld+json'>[[[", "<script>" + "[" * 3000 + ".pdf", "<a href='//['>annual report</a>", "<a href='/x.pdf'>annual report"])
def test_awkward_pages_lead_somewhere_or_nowhere(spark, page):
    assert len(found(spark, page)) == (1 if page and page.endswith("annual report") else 0)
    assert found(spark, page, url=None) == []
