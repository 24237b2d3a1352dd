"""Stored tables: alerts that can be appended again and retained by date, clustered readings with a file index, Bloom filters."""

import glob
import os

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from vigil.operators import alerts as al
from vigil.operators.alert_store import AlertStore
from vigil.plans import q_rules
from vigil.session import folder, stored
from vigil.sources import bloom, layout
from vigil.sources import readings as rd
from vigil.sources import views as v


@pytest.fixture(scope="module")
def some_alerts(spark):
    return stored(q_rules.alerts(spark, SF001).select("reading_id", "timestamp", "sensor_id", "alert_level", "risk_score"), "alerts")


def _files(store, date):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{store.rows_path.removeprefix('file:')}/alert_date={date}/*/*.parquet")}


def test_a_failed_append_is_run_again(spark, some_alerts):
    store = AlertStore(spark, folder(spark, "store"))
    half = some_alerts.filter("reading_id % 2 = 0")
    # a run that wrote its rows and died before its commit
    store.append(half, "x")
    store._delete(f"{store.commits_path}/batch_id=x")
    assert store.read().count() == store.total() == 0
    assert store.append(half, "x") and not store.append(half, "x")
    assert store.append(some_alerts.filter("reading_id % 2 = 1"), "007")
    assert store.read().count() == store.total() == some_alerts.count()
    assert store.read().exceptAll(some_alerts.withColumn("alert_date", F.to_date("timestamp"))).isEmpty()
    assert store.append(some_alerts.limit(0), "nothing") and not store.append(some_alerts, "nothing")
    nowhere = some_alerts.limit(3).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    assert store.append(nowhere, "no time") and store.total() == some_alerts.count() + 3 == store.read().count()


def test_retention_frees_old_dates_and_leaves_later_files(spark, some_alerts):
    store = AlertStore(spark, folder(spark, "store"))
    for b in range(2):
        store.append(some_alerts.filter(F.col("reading_id") % 2 == b), str(b))
    later = _files(store, "2024-01-20")
    assert later
    done = store.retain("2024-01-16 12:00:00")
    assert len(done["dropped"]) == 15 and done["rewritten"] == "2024-01-16"
    assert _files(store, "2024-01-20") == later and not _files(store, "2024-01-15")
    want = al.retain(some_alerts, "2024-01-16 12:00:00")
    assert store.read().count() == store.total() == want.count()
    assert store.read().agg(F.min("timestamp")).first()[0] >= want.agg(F.min("timestamp")).first()[0]
    # again, from where a run would have died: the date's old content gone, the new one not yet in its place
    staged = f"{store.path}/staged/alert_date=2024-01-16"
    fs, at = store._fs(f"{store.rows_path}/alert_date=2024-01-16")
    fs.mkdirs(store._fs(staged)[1].getParent())
    fs.rename(at, store._fs(staged)[1])
    store.retain("2024-01-16 12:00:00")
    assert store.read().count() == store.total() == want.count()
    assert not store.append(some_alerts, "0")  # its rows were retained away, its commit was not
    assert store.retain("2030-01-01 00:00:00")["rewritten"] is None
    assert store.read().count() == store.total() == 0


def test_a_lookup_opens_few_files(spark):
    path = folder(spark, "clustered")
    r = v.readings(spark, SF001)
    layout.write_clustered(r, path, rows_per_file=50)
    files = layout.clustered_index(spark, path).count()
    opened = layout.files_for(spark, path, "sensor_001", "2024-01-10 00:00:00", "2024-01-10 23:59:59")
    assert files >= 150 and len(opened) < 0.05 * files, (len(opened), files)
    got = layout.read_clustered(spark, path, "sensor_001", "2024-01-10 00:00:00", "2024-01-17 23:59:59")
    want = r.filter("sensor_id = 'sensor_001' and timestamp between timestamp_ntz'2024-01-10' and timestamp_ntz'2024-01-17 23:59:59'")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(sensor_id), IsNotNull(timestamp), EqualTo(sensor_id,sensor_001)" in plan
    newest = layout.newest(spark, path, 10)
    assert len(newest.inputFiles()) < files / 2
    assert [x.reading_id for x in newest.collect()] == [x.reading_id for x in r.orderBy(F.desc("timestamp"), F.desc("reading_id")).limit(10).collect()]
    assert layout.read_clustered(spark, path, "nobody").count() == 0


def test_clustered_tables_with_nulls_and_without_rows(spark):
    path = folder(spark, "clustered")
    r = v.readings(spark, SF001)
    odd = r.limit(0).unionByName(r.limit(4).withColumn("sensor_id", F.lit(None).cast("string"))).unionByName(
        r.limit(4).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))).unionByName(r.limit(4))
    layout.write_clustered(odd, path, rows_per_file=2)
    assert layout.read_clustered(spark, path).count() == 12
    layout.write_clustered(r.limit(0), path)
    assert layout.read_clustered(spark, path).count() == 0


@pytest.mark.parametrize("keys", [0, 1, 300, 200_000])
def test_bloom_filter(spark, keys):
    df = spark.range(keys).select(F.format_string("s%d", "id").alias("k"))
    f = bloom.build(df.unionByName(spark.createDataFrame([(None,)], "k string")), "k", 0.01)
    assert bloom.passing(df, "k", f).count() == keys and bloom.passing(df, "k", f, keep=False).count() == 0
    others = spark.range(100_000).select(F.format_string("other%d", "id").alias("k"))
    assert bloom.passing(others, "k", f).count() <= 0.012 * 100_000
    assert bloom.passing(spark.createDataFrame([(None,)], "k string"), "k", f).count() == 0


def test_unknown_rows_go_before_the_shuffle(spark):
    r, known = v.readings(spark, SF001), v.known_sensors(spark, SF001)
    for a, b in ((rd.accept_known, 0), (rd.reject_unknown, 0)):
        x, y = a(r, known).select(*r.columns), a(r, known, broadcast_rows=b).select(*r.columns)
        assert x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
    plan = rd.accept_known(r, known, broadcast_rows=0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and plan.index("SortMergeJoin") < plan.index("BroadcastNestedLoopJoin") if "SortMergeJoin" in plan else "BroadcastNestedLoopJoin" in plan
