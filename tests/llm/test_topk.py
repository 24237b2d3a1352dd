import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import topk
from vigil.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, v string, norm2 double, query_id long"


def brute(rows, every, k):
    good = sorted({(i, tuple(math.floor(1024 * float(x)) for x in e)) for i, e in rows
                   if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)})
    out = []
    for q, a in good:
        if q % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("longest", [16, 4096])
def test_top_k_equals_brute_force(spark, longest):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12) * rng.choice([0.1, 1, 4])]) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(30)]  # ties
    rows += [(500, None), (510, [1.0, None]), (520, [float("nan")] * 12), (530, [float("inf")] * 12), (540, []), (550, [1.0, 2.0]), (560, [0.0] * 12),
             (None, [1.0] * 12), rows[10], rows[10]]
    df = spark.createDataFrame([(i, e, 0, "x", 1.0, 1) for i, e in rows], SCHEMA).repartition(3)
    got = top_k(df, F.col("vec_id") % 10 == 0, longest=longest)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 10, 10)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0, "", 0.0, 0), (1, [0.5], 0, "", 0.0, 0)], SCHEMA)
    assert [tuple(r) for r in top_k(df, F.col("vec_id") == 0).select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 1, 512 * 1024)]
    assert top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_tasks_that_read_short_vectors_before_long_ones(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(6)
    # the long vectors' files are smaller than the short ones', so that they are read after them
    rows = [(i, [float(x) for x in rng.choice([-100, 100], 32)]) for i in range(180)]
    rows += [(180 + i, [float(np.float32(x)) for x in rng.normal(size=32)]) for i in range(460)]
    df = spark.createDataFrame([(i, e, 0, "x", 1.0, 1) for i, e in rows], SCHEMA)
    # many range files, all read by one task
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = top_k(df, F.col("vec_id") % 20 == 0, longest=16).select("query_id", "rank", "vec_id", "score").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == brute(rows, 20, 10)
