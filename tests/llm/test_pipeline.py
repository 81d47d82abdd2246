"""The pipeline's stages, each against a plain version on its own input."""

import collections

import corpus_pipeline
import numpy as np
import pytest
from llm.test_text_operators import brute_components, brute_fp, lower, tokens
from tessera.llm import language, packing
from tessera.llm.common import stored
from tessera.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 120")
    out = [stored(docs, "input")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf), name))
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_each_stage_against_the_plain_rule(stages):
    start, known, exact, near, mixed, packed = (s.collect() for s in stages)
    accepted = {r.doc_id for r in language.of_documents(stages[0]).filter("accepted").collect()}
    assert {r.doc_id for r in known} == accepted and len(known) >= 0.97 * len(start)
    last = {}
    for r in known:
        last[lower(r.text)] = max(last.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(last.values())
    exact = sorted(exact, key=lambda r: r.doc_id)
    comp = brute_components([brute_fp(r.text) for r in exact])
    assert sorted(r.doc_id for r in near) == [exact[i].doc_id for i in sorted(set(comp))]
    words = collections.Counter()
    sources = collections.defaultdict(int)
    for r in near:
        sources[r.source] += len(r.text.encode().split())
    for r in mixed:
        words[r.doc_id] += len(r.text.encode().split())
    assert all(words[r.doc_id] <= 2 * len(r.text.encode().split()) for r in near)
    assert abs(sum(words.values()) - 1.5 * sum(sources.values())) <= len(sources)
    whole = {r.doc_id: r.text for r in near}
    assert all(r.text.strip() in whole[r.doc_id] or len(r.text) < len(whole[r.doc_id]) for r in mixed)
    assert sum(r.length for r in packed) == sum(len(tokens(r.text)) for r in mixed)
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}


def test_run_is_the_chain(spark, stages, tmp_path):
    stages[0].write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("doc_id", "length", "ids_crc32").collect())) == sorted(map(tuple, stages[-1].select("doc_id", "length", "ids_crc32").collect()))


def test_pieces_are_the_tokens(stages):
    mixed = stages[4].collect()
    want = collections.Counter(x for r in mixed for x in tokens(r.text))
    got = collections.Counter(x for r in packing.pack(stages[4], TOKENIZER, keep_ids=True).collect() for x in np.frombuffer(r.ids, "<u4").tolist())
    assert got == want
