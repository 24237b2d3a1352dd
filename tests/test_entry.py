"""Driver contract: entry(), queries(), oracle_sql() and package shipping."""

import importlib.util
import os
import zipfile

from conftest import ROOT


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_and_registry(spark):
    m = _entry_module()
    df = m.entry(spark)
    assert df.count() == 1000 and len(df.columns) == 86
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70
    assert all(callable(f) for f in q.values())


def test_package_zip_is_shipped(spark):
    from vigil.session import ensure_checkpoint_dir, ship_package

    ship_package(spark)
    d = ensure_checkpoint_dir(spark)
    zips = [f for f in os.listdir(d) if f.startswith("vigil-") and f.endswith(".zip")]
    assert zips
    names = zipfile.ZipFile(os.path.join(d, zips[0])).namelist()
    assert "vigil/__init__.py" in names and "vigil/operators/explain.py" in names
