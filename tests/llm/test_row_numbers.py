"""Decisions meet their rows, also when the input's splits change between two scans, as they do when executors come and go."""

import pytest
from tessera.llm import common, exact_dedup, language, mixing, pii, simhash, warc

OPEN_COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 100").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs] + [(1000 + i, docs[i].text, "en", "s") for i in range(20)] + [(2000 + i, "~^|#!?%& " * (40 + i), None, "s") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(8).write.parquet(f"{tmp_path}/docs")
    yield f"{tmp_path}/docs"
    spark.conf.unset(OPEN_COST)


STEPS = {"exact": exact_dedup.dedup, "near": simhash.dedup, "language": language.accepted_only, "mix": mixing.mixed_documents, "private": pii.sanitised}


@pytest.mark.parametrize("step", STEPS)
def test_other_splits_for_the_rows_than_for_the_decision(spark, files, step):
    held = lambda df: sorted(map(repr, df.collect()))
    want = held(STEPS[step](spark.read.parquet(files)))
    decided = STEPS[step](spark.read.parquet(files))
    docs = spark.read.parquet(files)
    before = docs.rdd.getNumPartitions()
    spark.conf.set(OPEN_COST, "128m")
    assert spark.read.parquet(files).rdd.getNumPartitions() > before
    assert held(decided) == want


def test_other_splits_while_archives_are_written(spark, files, monkeypatch):
    pages = lambda: spark.read.parquet(files).selectExpr("doc_id AS page_id", "concat('https://a.example/', doc_id) AS url", "text AS html")
    want = sorted(map(repr, warc.round_trip(pages()).collect()))
    put = warc.stored

    def stored(df, name, *more):
        out = put(df, name, *more)
        spark.conf.set(OPEN_COST, "128m")
        return out

    monkeypatch.setattr(warc, "stored", stored)
    assert sorted(map(repr, warc.round_trip(pages()).collect())) == want


def test_scans_of_files_are_numbered_without_a_copy(spark, files):
    def held(df):
        return sorted((r.doc_id, r.text or "", r[common.RID]) for r in df.collect())

    docs = common.kept_numbers(spark.read.parquet(files))
    want = held(docs)
    assert len({r[2] for r in want}) == len(want) and docs.columns[:-1] == spark.read.parquet(files).columns
    assert {f.rsplit("/", 1)[0] for f in docs.inputFiles()} != {f.rsplit("/", 1)[0] for f in common.kept_numbers(spark.range(3).toDF("doc_id")).inputFiles()}
    assert any("/docs/" in f for f in docs.inputFiles())
    spark.conf.set(OPEN_COST, "128m")
    assert held(common.kept_numbers(spark.read.parquet(files))) == want


def test_a_cluster_needs_the_shared_folder(spark, monkeypatch):
    import types

    fake = lambda master: types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *a: None), sparkContext=types.SimpleNamespace(master=master, applicationId="app"), _jvm=spark._jvm, _jsc=spark._jsc)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(fake("spark://host:7077"))
    assert common.shared_folder(fake("local[2]")) == common.shared_folder(fake("local[2]")) and "tessera-" in common.shared_folder(fake("local[2]"))
