import itertools

import numpy as np

from llm_fixtures import no_docs, no_labels, odd_docs, odd_labels  # noqa: F401
from vigil.llm.q_quality import op2_quality
from vigil.llm.quality_crf import accepted, marginals, predict, score, train


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    counts = np.array([3, 1, 5])
    e, t = rng.normal(size=9), rng.normal(size=(2, 2))
    got, _, log_z = marginals(e, counts, t)
    at = 0
    for d, n in enumerate(counts):
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(e[at + i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            good += p * np.array(y)
        assert np.allclose(got[at:at + n], good / total) and np.isclose(log_z[d], np.log(total))
        at += n


def test_held_out_accuracy(spark):
    got = op2_quality(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 500 and np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_odd_documents(spark, odd_docs, no_docs, odd_labels, no_labels):
    model = train(odd_docs, odd_labels)
    got = score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    assert train(odd_docs, no_labels) is None and train(no_docs, odd_labels) is None
    assert {r.score for r in score(odd_docs, None).collect()} == {0.5}
    assert score(no_docs, model).count() == 0
    kept = accepted(odd_docs, None, 0.3)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert len(predict(model, [])) == 0


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    from pyspark.sql import functions as F

    from vigil.llm.common import fold

    turned = labels.withColumn("quality", F.when(fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = train(docs, labels), train(docs, turned)
    assert np.allclose(a["w"], b["w"]) and a["curve"] == b["curve"]
