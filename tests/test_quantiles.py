"""Exact quantiles per group: equal to numpy's, however values are spread and repeated."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions.quantiles import grouped_quantiles

PROBS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("last", [4, 1000])
def test_equal_to_numpy(spark, last):
    rng = np.random.default_rng(7)
    groups = {
        "normal": rng.normal(size=9000), "tied": rng.integers(0, 3, 5000).astype(float), "one": np.array([4.5]), "two": np.array([1.0, 2.0]),
        "mostly one value": np.concatenate([np.full(4000, 2.5), rng.normal(size=900)]), "wide": rng.lognormal(0, 20, 4000), None: rng.normal(size=50),
        "steps": np.repeat(rng.normal(size=40), 60),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "feature string, v double").repartition(4)
    got = {r.feature: r for r in grouped_quantiles(df, "feature", "v", PROBS, last_values=last).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g].n == len(xs)
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-12), (g, name)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert grouped_quantiles(df, "g", "v", PROBS).collect() == []


def test_many_rows_of_one_group(spark):
    df = spark.range(400_000).select(F.lit("a").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 7.0).alias("v"))
    r = grouped_quantiles(df, "g", "v", {"q": 0.37}).first()
    assert r.q == pytest.approx(df.agg(F.percentile("v", F.lit(0.37))).first()[0], rel=1e-12)
