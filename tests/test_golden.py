"""Golden rows (FIXTURES.md sections 3 and 4) and boundary values."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vigil.config import AlertConfig
from vigil.operators import alerts as al
from vigil.operators.alert_store import AlertStore
from vigil.operators import clean as cl
from vigil.operators import features as feat
from vigil.operators import rules as ru

VALUES = [10, 12, 11, 13, 40, 12, 11]
# i: mean_5, std_5, min_5, max_5, range_5, diff, pct, accel, lag_2, z, spike
GOLDEN = [
    (10.0, None, 10, 10, 0, None, None, None, None, None, 0),
    (11.0, 1.414214, 10, 12, 2, 2, 0.2, None, None, 0.707107, 0),
    (11.0, 1.0, 10, 12, 2, -1, -0.083333, -3, 10, 0.0, 0),
    (11.5, 1.290994, 10, 13, 3, 2, 0.181818, 3, 12, 1.161895, 0),
    (17.2, 12.79453, 10, 40, 30, 27, 2.076923, 25, 11, 1.782012, 0),
    (17.6, 12.54193, 11, 40, 29, -28, -0.7, -55, 13, -0.372311, 0),
    (17.4, 12.660964, 11, 40, 29, -1, -0.083333, 27, 40, -0.422715, 0),
]


def _series(spark, values, col="temperature"):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "sensor_001", None if x is None else float(x)) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, f"reading_id long, ts string, sensor_id string, {col} double")
    return df.select("reading_id", F.col("ts").cast("timestamp_ntz").alias("timestamp"), "sensor_id", col)


def _close(a, b, tol=1e-6):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol


def test_golden_features(spark):
    df = _series(spark, VALUES)
    f = feat.all_features(df).orderBy("reading_id").collect()
    for r, g in zip(f, GOLDEN):
        c = "temperature"
        got = (r[f"{c}_rolling_mean_5"], r[f"{c}_rolling_std_5"], r[f"{c}_rolling_min_5"], r[f"{c}_rolling_max_5"],
               r[f"{c}_rolling_range_5"], r[f"{c}_rate_of_change"], r[f"{c}_rate_of_change_pct"],
               r[f"{c}_acceleration"], r[f"{c}_lag_2"], r[f"{c}_z_score"], r[f"{c}_spike"])
        for a, b in zip(got, g):
            assert _close(a, b), (r["reading_id"], got, g)


def test_pct_change_with_gaps(spark):
    df = _series(spark, [1, None, 2, 0, 5, 0, 0])
    out = [r["temperature_rate_of_change_pct"] for r in feat.change_features(df).orderBy("reading_id").collect()]
    assert out == [None, 0.0, 1.0, -1.0, None, -1.0, None]


def test_iqr_clip(spark):
    df = _series(spark, VALUES)
    b = cl.iqr_bounds(df, ["temperature"]).first()
    assert (b["q1_temperature"], b["q3_temperature"], b["lower_temperature"], b["upper_temperature"]) == \
        (11.0, 12.5, 8.75, 14.75)
    c = cl.clip_outliers(df, cl.iqr_bounds(df, ["temperature"]), ["temperature"])
    assert max(r[0] for r in c.select("temperature").collect()) == 14.75
    assert cl.count_outliers(df, cl.iqr_bounds(df, ["temperature"]), ["temperature"]).first()[0] == 1
    r = cl.iqr_bounds(df, ["temperature"], method="percentile").first()
    assert (r["q1_temperature"], r["q3_temperature"]) == (11.0, 12.5)


def test_fill_chain_and_spike_bound(spark):
    df = _series(spark, [None, None, 3, None, 5])
    got = [r["temperature"] for r in cl.fill_missing(df, ["temperature"]).orderBy("reading_id").collect()]
    assert got == [3.0, 3.0, 3.0, 3.0, 5.0]


@pytest.mark.parametrize("risk,prob,fail,anom,level", [
    (0.3, 0.2, False, False, "INFO"),
    (0.8, 0.75, False, True, "CRITICAL"),
    (0.95, 0.9, True, True, "EMERGENCY"),
    (0.1, 0.1, False, True, "WARNING"),
    (None, None, None, None, "INFO"),
    (0.7, 0.0, False, False, "WARNING"),
    (0.69999, 0.0, False, False, "INFO"),
    (0.0, 0.9, False, False, "EMERGENCY"),
])
def test_alert_levels(spark, risk, prob, fail, anom, level):
    df = spark.createDataFrame([("s", risk, prob, fail, anom)],
                               "sensor_id string, risk_score double, failure_probability double, "
                               "is_failure boolean, is_anomaly boolean")
    assert df.select(al.alert_level(df, AlertConfig()).alias("l")).first()["l"] == level


@pytest.mark.parametrize("t,v,p,risk,level", [
    (75.5, 4.2, 2.1, 0.659444, "NORMAL"),
    (90.0, 6.0, 0.0, 1.0, "EMERGENCY"),
    (20.0, 0.5, 8.0, 0.0, "NORMAL"),
])
def test_rule_risk(spark, t, v, p, risk, level):
    df = spark.createDataFrame([(t, v, p)], "temperature double, vibration double, pressure double")
    r = ru.rule_risk(df).first()
    assert _close(r["risk_score"], risk) and r["status"] == level


def test_combined_risk(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.5), (0.0, 0.5, 0.5)],
                               "anomaly_score double, failure_probability double, online_probability double")
    r = ru.combine_risk(df, scope="fixed", fixed=(0.0, 1.0)).orderBy("anomaly_score").collect()
    # anomaly score 0 -> anomaly risk 1 -> 0.3 + 0.25 + 0.1
    assert _close(r[0]["risk_score"], 0.65)


def test_process_predictions_appends(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="vigil-alerts-"), "alerts")
    df = spark.createDataFrame([("s1", "2024-01-01 00:00:00", 0.95, 0.9, True, True)],
                               "sensor_id string, ts string, risk_score double, failure_probability double, "
                               "is_failure boolean, is_anomaly boolean").withColumn(
        "timestamp", F.col("ts").cast("timestamp_ntz")).drop("ts")
    store = AlertStore(spark, path)
    assert store.process(df, "1") == 1
    assert store.process(df, "1") == 1  # a rerun adds nothing
    assert store.process(df, "2") == 2
    a = store.read().first()
    assert a["alert_level"] == "EMERGENCY"
    assert a["message"] == "🚨 EMERGENCY: Equipment s1 at CRITICAL risk of failure!"
    assert a["raw_data"]["risk_score"] == 0.95


def test_exact_quantile_refinement_matches_percentile(spark, monkeypatch):
    from conftest import SF001

    from vigil.functions import stats
    from vigil.sources import views as v

    monkeypatch.setattr(stats, "_LAST_VALUES", 50)
    r = v.lineitem_series(spark, SF001)
    q = stats.exact_quantiles(r, {"vibration": [0.1, 0.25, 0.5, 0.75, 0.97], "temperature": [0.25, 0.75]}, accuracy=100)
    want = r.agg(*[F.percentile("vibration", p).alias(f"v{p}") for p in (0.1, 0.25, 0.5, 0.75, 0.97)],
                 *[F.percentile("temperature", p).alias(f"t{p}") for p in (0.25, 0.75)]).first()
    for p in (0.1, 0.25, 0.5, 0.75, 0.97):
        assert abs(q[("vibration", p)] - want[f"v{p}"]) < 1e-9
    for p in (0.25, 0.75):
        assert abs(q[("temperature", p)] - want[f"t{p}"]) < 1e-9


def test_one_hot_vector_matches_dummies(spark):
    from conftest import SF001

    from vigil.sources import views as v

    r = v.readings(spark, SF001)
    new = r.limit(2).withColumn("sensor_id", F.lit("unseen")).unionByName(r.limit(1).withColumn("sensor_id", F.lit(None).cast("string")))
    out = feat.one_hot_vector(r.unionByName(new), feat.sensor_slots(r))
    sensors = sorted(x[0] for x in r.select("sensor_id").distinct().collect())
    rows = out.select("sensor_id", "sensor_onehot", "sensor_onehot_slot").collect()
    assert len(rows) == r.count() + 3
    for row in rows:
        vec = row["sensor_onehot"]
        if row["sensor_id"] in sensors:
            assert vec.size == len(sensors) and list(vec.indices) == [sensors.index(row["sensor_id"])] == [row["sensor_onehot_slot"]]
        else:
            assert vec.size == len(sensors) and not len(vec.indices) and row["sensor_onehot_slot"] is None


@pytest.mark.parametrize("distinct", [1, 2, 4, 1500])
def test_quantiles_with_many_ties_stay_off_the_driver(spark, distinct):
    """Two million rows of few values: no job returns more than one row of statistics."""
    from vigil.functions import stats

    df = spark.range(2_000_000).select(((F.col("id") * 7919) % distinct).cast("double").alias("x"))
    got = stats.exact_quantiles(df, {"x": [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]})
    want = df.agg(*[F.percentile("x", F.lit(p)).alias(str(p)) for p in (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)]).first().asDict()
    assert {str(p): v for (_, p), v in got.items()} == want


def test_exact_bounds_by_group_are_refused(spark):
    from vigil.operators.clean import iqr_bounds

    with pytest.raises(ValueError, match="exact"):
        iqr_bounds(spark.range(3).select("id", F.col("id").cast("double").alias("pressure")), ["pressure"], by=["id"])
