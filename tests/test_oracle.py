"""Every registered query with oracle SQL must match DuckDB at sf0.01."""

import math

import pytest
from conftest import SF001
from oracle import compare, duck

from vigil.plans import load_all

REG = load_all()
WITH_SQL = sorted(n for n, q in REG.items() if q.oracle() is not None)


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_oracle(spark, con, name):
    q = REG[name]
    problems = compare(spark, q.spark, q.oracle(), SF001, con)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(n for n in REG if REG[n].oracle() is None))
def test_query_without_oracle_gives_whole_rows(spark, name):
    """Their values are checked by the facts queries; here: rows there are, keys are set, numbers are finite."""
    df = REG[name].spark(spark, SF001)
    rows = df.collect()
    assert rows
    for c, t in df.dtypes:
        if t == "double" and c not in ("threshold", "value"):
            assert all(r[c] is not None and math.isfinite(r[c]) for r in rows), c
        if c in ("reading_id", "sensor_id", "tree_id", "model", "metric"):
            assert all(r[c] is not None for r in rows), c
