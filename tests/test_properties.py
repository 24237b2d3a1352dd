"""Property tests (hypothesis) and plan-shape checks."""

import math

from conftest import SF001
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.operators import clean as cl
from vigil.operators import features as feat
from vigil.operators import rules as ru
from vigil.sources import views as v

VAL = st.one_of(st.none(), st.floats(min_value=-1e3, max_value=1e3, allow_nan=False))
SERIES = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), VAL, VAL, VAL), min_size=1, max_size=40)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _frame(spark, rows):
    data = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", s, t, vb, p) for i, (s, t, vb, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "reading_id long, ts string, sensor_id string, temperature double, "
                                     "vibration double, pressure double")
    return df.select("reading_id", F.col("ts").cast("timestamp_ntz").alias("timestamp"), "sensor_id",
                     "temperature", "vibration", "pressure")


@SETTINGS
@given(SERIES)
def test_fill_leaves_no_null_unless_all_null(spark, rows):
    df = _frame(spark, rows)
    out = cl.fill_missing(df).collect()
    for c in ("temperature", "vibration", "pressure"):
        all_null = all(r[c] is None for r in df.collect())
        assert all(r[c] is None for r in out) if all_null else all(r[c] is not None for r in out)


@SETTINGS
@given(SERIES)
def test_clip_within_bounds_and_idempotent(spark, rows):
    df = _frame(spark, rows)
    b = cl.iqr_bounds(df)
    once = cl.clip_outliers(df, b)
    twice = cl.clip_outliers(once, b)
    bb = b.first()
    for r1, r2 in zip(once.orderBy("reading_id").collect(), twice.orderBy("reading_id").collect()):
        for c in ("temperature", "vibration", "pressure"):
            assert r1[c] == r2[c]
            if r1[c] is not None:
                assert bb[f"lower_{c}"] - 1e-9 <= r1[c] <= bb[f"upper_{c}"] + 1e-9


@SETTINGS
@given(SERIES)
def test_range_spike_bound_and_scaling(spark, rows):
    df = _frame(spark, rows)
    f = feat.all_features(df).collect()
    for r in f:
        for w in (5, 10, 20):
            x = r[f"temperature_rolling_range_{w}"]
            assert x is None or x >= 0
        z = r["temperature_z_score"]
        if z is not None:
            assert abs(z) < (10 - 1) / math.sqrt(10) + 1e-6  # |z| <= (n-1)/sqrt(n), n <= 10
    s = cl.normalize(df).agg(F.avg("temperature").alias("m"), F.stddev_pop("temperature").alias("s")).first()
    if s["m"] is not None:
        assert abs(s["m"]) < 1e-6
        assert s["s"] < 1e-9 or abs(s["s"] - 1) < 1e-6


@SETTINGS
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1), st.floats(-1, 1)), min_size=1, max_size=30))
def test_risk_in_unit_interval(spark, rows):
    df = spark.createDataFrame(rows, "failure_probability double, online_probability double, anomaly_score double")
    r = ru.combine_risk(df).agg(F.min("risk_score"), F.max("risk_score")).first()
    assert -1e-9 <= r[0] <= r[1] <= 1 + 1e-9


def test_partition_count_invariance(spark):
    r = v.readings(spark, SF001)
    a = feat.all_features(r.repartition(3)).select("reading_id", "temperature_rolling_std_20", "pressure_lag_5")
    b = feat.all_features(r.repartition(17)).select("reading_id", "temperature_rolling_std_20", "pressure_lag_5")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_feature_plan_has_one_shuffle_and_pruned_scan(spark):
    r = v.readings(spark, SF001)
    plan = feat.all_features(r, chunk_rows=None)._jdf.queryExecution().executedPlan().toString()
    # one hash exchange for the windows (the min/max aggregate's single-partition
    # exchange feeds the one-row broadcast)
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    w = feat.all_features(r, chunk_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert w.count("Window [") + w.count("Window[") >= 1
    scan = v.readings(spark, SF001).select("sensor_id", "temperature").filter(F.col("temperature") > 100) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,value:double>" in scan
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,100.0)]" in scan
