"""Oracle SQL result types equal the Spark schema (the driver compares schemas too)."""

import pytest
from conftest import SF0001
from oracle import duck

from vigil.plans import load_all

REG = load_all()
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
NAMES = sorted(n for n, q in REG.items() if q.oracle() is not None)


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", NAMES)
def test_types_match(spark, con, name):
    q = REG[name]
    s = dict(q.spark(spark, SF0001).dtypes)
    rel = con.sql(q.oracle())
    d = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert set(s) == set(d)
    bad = [(c, s[c], d[c]) for c in s if SPARK_TO_DUCK.get(s[c], s[c]) != d[c]]
    assert not bad, bad
