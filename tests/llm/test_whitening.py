import math
from collections import Counter

import numpy as np
import pytest

from vigil.llm import whitening
from vigil.llm.whitening import multiplicities, whiten, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, x string, weight double, z int, deviation int, i int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x", 1.0, 1, 2, 3, 4) for i, e in rows], SCHEMA).repartition(3)


def whole(e):
    return [math.floor(1024 * float(np.float32(c))) + 100000 for c in e]


def checked(spark, rows, fit_rows=None, weights="count", components=8):
    good = [(i, whole(e)) for i, e in rows]
    x = np.array([v for _, v in good])
    fit = x if weights == "count" else np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = np.cov(fit.T.astype(float), bias=True)
    e, vec = np.linalg.eigh(v)
    e, vec = e[::-1], vec[:, ::-1]
    got = whiten(frame(spark, rows), weights=weights).collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c) for i, _ in good for c in range(1, 1 + min(components, x.shape[1])))
    want_dev = Counter((i, sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))) for i, row in good)
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == want_dev
    z = {}
    for r in got:
        z.setdefault((r.vec_id, r.component), []).append(r.whitened)
        assert r.n == n and abs(r.explained - e[r.component - 1] / np.trace(v)) <= 1e-9 and r.identity_error <= 1e-9
    for c in range(1, 1 + min(components, x.shape[1])):
        mine = np.array([sorted(z[i, c])[0] for i, _ in good])
        other = (x - s / n) @ vec[:, c - 1] / np.sqrt(e[c - 1])
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-8
    return got


def many(seed=3, n=400, dim=12):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=dim) * np.linspace(0.1, 2, dim)]) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(n // 2)]  # a third of all rows share one vector


@pytest.mark.parametrize("weights", ["count", "one"])
def test_equals_brute_force(spark, weights):
    checked(spark, many(), weights=weights)


def test_odd_rows(spark):
    rows = many(4, 60)
    odd = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [1.0, 2.0])]
    got = {(r.vec_id, r.component) for r in whiten(frame(spark, rows + odd + [(None, rows[1][1])])).collect()}
    assert {i for i, _ in got} == {i for i, _ in rows} | {None}
    assert whiten(frame(spark, []) if False else frame(spark, rows).limit(0)).count() == 0
    assert whiten(frame(spark, odd[:4])).count() == 0


def test_no_variance(spark):
    got = whiten(frame(spark, [(i, [1.0, 2.0, float(i % 2)]) for i in range(6)])).collect()
    assert len(got) == 18
    for r in got:
        assert (abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12) if r.component == 1 else (r.whitened, r.explained) == (0, 0)
    one = whiten(frame(spark, [(5, [1.0, 2.0])])).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(0, 0, 0, 0)] * 2


def test_large_values_are_exact(spark):
    rows = [(i, [1e9 * (i % 3), 1.0, float(i)]) for i in range(20)]
    x = [whole(e) for _, e in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((20 * a - b) ** 2 for a, b in zip(v, s)) for (i, _), v in zip(rows, x)}
    got = {r.vec_id: r.deviation for r in whiten(frame(spark, rows)).collect()}
    assert got == {i: v if v < 1 << 63 else None for i, v in want.items()}


def test_distinct_vectors(spark):
    assert {tuple(r.x): r.times for r in multiplicities(whole_vectors(frame(spark, many()))).collect() if r.times > 1} == {tuple(whole(many()[0][1])): 201}
    with pytest.raises(ValueError):
        whiten(frame(spark, many()), weights="two")
