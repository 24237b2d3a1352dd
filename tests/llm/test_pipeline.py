from collections import Counter

import corpus_pipeline
import pytest

from test_entry import _entry_module
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from test_ngram_join import brute as near_brute
from vigil.llm.mixing import mix
from vigil.llm.queries import ORACLE, QUERIES

SF0001 = "/root/testdata/sf0.001"


def test_queries_are_registered():
    q = _entry_module().queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in q) == 1
    assert "pipeline" in q and set(ORACLE) <= set(QUERIES) <= set(q)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    from oracle import compare

    assert not compare(spark, QUERIES[name], ORACLE[name], "/root/testdata/sf0.01")


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF0001}/labels.parquet").collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF0001)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert set(map(tuple, rows)) <= set(map(tuple, docs.collect())), name
        if name == "quality":
            kept = {r.doc_id for r in rows}
            assert sum(d in kept for d, q in labels.items() if q == 1) >= 0.97 * sum(labels.values())
            assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.2 * sum(1 - q for q in labels.values())
        before = docs.collect()
        if name == "exact_dedup":
            last = {}
            for r in before:
                last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
            assert sorted(r.doc_id for r in rows) == sorted(last.values())
        if name == "ngram_join":
            groups = near_brute([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in rows) == sorted(d for d, _, component in groups if d == component)
        if name == "mixing":
            want = Counter({r.doc_id: r.taken // r.size for r in mix(docs).collect() if r.taken})
            assert Counter(r.doc_id for r in rows) == want and max(want.values()) <= 2
        counts.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.packing(spark, docs, SF0001).collect()
    whole = Counter()
    for r in packed:
        whole[r.doc_id] += r.piece == 0
    assert whole == Counter(r.doc_id for r in docs.collect())
    assert counts[0] < 200 and counts[1] < counts[0]


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF0001)
            assert out.count() >= (1 if docs is odd_docs else 0)
            if docs is no_docs:
                assert out.count() == 0
