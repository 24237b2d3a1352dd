import math
import zlib
from collections import Counter

import numpy as np
import pytest

from llm_fixtures import no_docs, odd_docs  # noqa: F401
from vigil.llm import interpolated_lm as lm


def brute(rows):
    """Base scores as the contract writes them."""
    tokens = [(d, [*(t or "").encode().lower().split(), None], zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0) for d, t in rows]
    c = Counter(w for _, ws, held in tokens if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((str(d), held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for d, ws, held in tokens)


@pytest.mark.parametrize("block", [50, 1_000_000])
def test_base_scores(spark, odd_docs, block, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm, "RANGE_KEYS", 700)
    docs = odd_docs.filter("doc_id is null or doc_id not in (10, 11, 12)") if block == 50 else odd_docs
    got = lm.lm_scores(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute(rows)


def test_model_equals_plain_interpolation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = lm.blocks(docs)
    sums, totals = lm.exchange(packed)
    w = lm.learn_weights(packed, sums, totals)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all()
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs.collect()}
    learns = [d for d in texts if zlib.crc32(str(d).encode()) % 10]
    one = Counter(x for d in learns for x in texts[d])
    two = Counter(p for d in learns for p in zip([None, *texts[d][:-1]], texts[d]))
    n, v = sum(one.values()), len(one)
    for r in lm.lm_scores(docs).collect()[:40]:
        total = 0.0
        for h, x in zip([None, *texts[r.doc_id][:-1]], texts[r.doc_id]):
            b = min(int(math.log2(one[h])) + 1, lm.BUCKETS - 1) if one[h] else 0
            total += math.log10(w[b, 0] / (v + 1) + w[b, 1] * one[x] / n + (w[b, 2] * two[h, x] / one[h] if one[h] else 0))
        assert abs(total - r.score) < 1e-6 * abs(total)


def test_held_out_text_is_likelier_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in lm.lm_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_no_rows_and_no_training_rows(spark, no_docs):
    assert lm.lm_scores(no_docs).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = lm.lm_scores(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)


def test_keys_survive_packing():
    k = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (lm._unzip_keys(lm._zip_keys(k)) == k).all()
    at = lm._ranges(k, 7)
    assert at[0] == 0 and at[-1] == len(k) and all(int(k[i]) * 7 >> 64 >= r for r, i in enumerate(at[1:-1], 1) if i < len(k))


def test_blocks_keep_every_document_with_its_kind(spark):
    rows = [(i, f"word{i} and word{i % 7}") for i in range(60)] + [(None, None)]
    packed = lm.blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    folds = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 for i, _ in rows}
    got = [(d.doc_id, d.held_out, d.n, b.held) for b in packed for d in b.rows]
    assert sorted(map(str, got)) == sorted(str((i, folds[i] == 0, len((t or "").split()) + 1, folds[i] == 1)) for i, t in rows)
