"""Streaming: micro-batches with carry-over equal the batch result (fixed statistics)."""

import datetime
import os
import tempfile

from conftest import SF001
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.models.split import stable_unit
from vigil.operators import clean as cl
from vigil.operators import features as feat
from vigil.plans.q_sources import envelopes
from vigil.session import folder
from vigil.sources import readings as rd
from vigil.streaming import monitor as mon
from vigil.streaming.replay import replay


def _envelope_files(spark, root):
    """Envelopes from events, written as three files in time order."""
    env = envelopes(spark, SF001)
    bounds = ["2024-01-11", "2024-01-21"]
    parts = [
        F.col("t") < F.lit(bounds[0]),
        (F.col("t") >= F.lit(bounds[0])) & (F.col("t") < F.lit(bounds[1])),
        F.col("t") >= F.lit(bounds[1]),
    ]
    e = env.withColumn("t", F.get_json_object("body", "$.readings[0].timestamp"))
    for i, cond in enumerate(parts):
        e.filter(cond).select(F.col("body").alias("value")).coalesce(1).write.mode("overwrite").text(
            os.path.join(root, f"tmp{i}"))
        f = [x for x in os.listdir(os.path.join(root, f"tmp{i}")) if x.endswith(".txt")][0]
        os.rename(os.path.join(root, f"tmp{i}", f), os.path.join(root, "src", f"part{i}.json"))


def test_stream_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="vigil-stream-")
    os.makedirs(os.path.join(root, "src"))
    _envelope_files(spark, root)
    src = os.path.join(root, "src")
    allr = rd.type_readings(rd.read_envelopes(spark, src))
    # envelopes are cut by the first reading's time, so keep batches time-ordered per sensor
    stats = mon.StreamStats.fit(allr)
    carry = mon.FeatureCarry(stats, os.path.join(root, "late"))
    q = mon.monitor_stream(mon.envelope_stream(spark, src, max_files=1), carry, os.path.join(root, "out"),
                           os.path.join(root, "ckpt"))
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(root, "out", "features"))
    late = spark.read.parquet(os.path.join(root, "late")).count() if os.path.exists(os.path.join(root, "late")) else 0
    want = feat.all_features(cl.clean_fixed(allr, stats.cleaning), min_max=stats.min_max)
    assert got.count() + late == allr.count()
    names = [c for c in want.columns if c != "batch"]
    g = {r["reading_id"]: r for r in got.select(*names).collect()}
    w = {r["reading_id"]: r for r in want.select(*names).collect()}
    bad = 0
    for k, row in g.items():
        for n in names:
            a, b = row[n], w[k][n]
            if isinstance(a, float) and b is not None and a is not None:
                if abs(a - b) > 1e-6 * max(1.0, abs(b)):
                    bad += 1
            elif a != b:
                bad += 1
    assert bad == 0
    # restart from the checkpoint: nothing new, no duplicates
    q2 = mon.monitor_stream(mon.envelope_stream(spark, src, max_files=1), carry, os.path.join(root, "out"),
                            os.path.join(root, "ckpt"))
    q2.awaitTermination()
    assert spark.read.parquet(os.path.join(root, "out", "features")).count() == got.count()


def test_sgd_step_reduces_loss(spark):
    from vigil.sources import views as v

    r = v.readings(spark, SF001).withColumn("y", feat.encode_label("label")) \
        .withColumn("x1", stable_unit("reading_id")).withColumn("x2", F.col("temperature") / 500)
    feats = ["x1", "x2"]

    def loss(w):
        z = F.lit(w["bias"]) + sum(F.lit(w[f]) * F.col(f) for f in feats)
        p = 1 / (1 + F.exp(-z))
        return r.agg(F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p)))).first()[0]

    w0 = {"bias": 0.0, "x1": 0.0, "x2": 0.0}
    w1 = mon.sgd_step(r, w0, feats, lr=0.5)
    assert loss(w1) < loss(w0)


def test_ingest_and_alert_stats_streams(spark):
    from vigil.operators import alerts as al
    from vigil.operators import rules as ru
    from vigil.sources import views as v

    root = tempfile.mkdtemp(prefix="vigil-ingest-")
    os.makedirs(os.path.join(root, "src"))
    _envelope_files(spark, root)
    known = v.known_sensors(spark, SF001)
    q = mon.ingest_stream(spark, os.path.join(root, "src"), os.path.join(root, "table"), os.path.join(root, "ck1"),
                          sensors=known)
    q.awaitTermination()
    stored = spark.read.parquet(os.path.join(root, "table")).count()
    allr = rd.type_readings(rd.read_envelopes(spark, os.path.join(root, "src")))
    assert stored == rd.accept_known(allr, known).count()

    alerts = al.build_alerts(ru.combine_risk(v.scores(spark, SF001))).drop("raw_data")
    apath = os.path.join(root, "alerts")
    alerts.write.parquet(apath)
    q2 = mon.alert_stats_stream(spark, apath, alerts.schema, os.path.join(root, "stats"), os.path.join(root, "ck2"))
    q2.awaitTermination()
    st = spark.read.parquet(os.path.join(root, "stats"))
    # append mode emits windows closed by the watermark: all but the newest hour
    closed = alerts.filter(F.col("timestamp") < F.date_trunc("hour", F.lit(
        alerts.agg(F.max("timestamp")).first()[0]).cast("timestamp_ntz")) - F.expr("INTERVAL 1 HOUR"))
    assert st.agg(F.sum("n")).first()[0] >= closed.count()


def test_monitoring_cycle_scores_and_alerts(spark):
    from vigil.models import pipeline as pl

    root = tempfile.mkdtemp(prefix="vigil-monitor-")
    os.makedirs(os.path.join(root, "src"))
    _envelope_files(spark, root)
    src = os.path.join(root, "src")
    hist = rd.type_readings(rd.read_envelopes(spark, src))
    models, _ = pl.train_all(hist, pl.feature_set("basic6"), n_trees=10, forest_kw={"numTrees": 5, "maxDepth": 4})
    stats = mon.StreamStats.fit(hist)
    carry = mon.FeatureCarry(stats, os.path.join(root, "late"))
    q = mon.monitor_stream(
        mon.envelope_stream(spark, src, max_files=1), carry, os.path.join(root, "out"), os.path.join(root, "ckpt"),
        score=lambda f: pl.score_all(f, models, scope="fixed", features_ready=True))
    q.awaitTermination()
    scored = spark.read.parquet(os.path.join(root, "out", "scored"))
    alerts = spark.read.parquet(os.path.join(root, "out", "alerts"))
    assert scored.count() == hist.count() == alerts.count()
    r = scored.agg(F.min("risk_score"), F.max("risk_score"), F.countDistinct("batch")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 + 1e-9 and r[2] == 3


def test_late_rows_are_kept_and_recomputed(spark):
    from vigil.sources import views as v

    root = tempfile.mkdtemp(prefix="vigil-late-")
    r = v.readings_gaps(spark, SF001).filter("sensor_id in ('sensor_001', 'sensor_002', 'sensor_003')")
    r = r.withColumn("_part", F.ntile(2).over(Window.partitionBy("sensor_id").orderBy("timestamp", "reading_id")))
    late_ids = [x[0] for x in r.filter("_part = 1 and sensor_id = 'sensor_002'").select("reading_id").limit(3).collect()]
    first = r.filter((F.col("_part") == 1) & ~F.col("reading_id").isin(late_ids)).drop("_part")
    second = r.filter((F.col("_part") == 2) | F.col("reading_id").isin(late_ids)).drop("_part")
    r = r.drop("_part")
    stats = mon.StreamStats.fit(r)
    carry = mon.FeatureCarry(stats, f"{root}/late")
    replay([first, second], lambda part, path: part.write.parquet(path), f"{root}/src", lambda src: mon.monitor_stream(
        spark.readStream.schema(r.schema).parquet(src), carry, f"{root}/out", f"{root}/ckpt"))
    out = {x["reading_id"]: x for x in spark.read.parquet(f"{root}/out/features").drop("batch").collect()}
    late = spark.read.parquet(f"{root}/late").drop("batch")
    assert sorted(x["reading_id"] for x in late.collect()) == sorted(late_ids) and not set(late_ids) & set(out)
    on_time = r.filter(~F.col("reading_id").isin(late_ids))
    out |= {x["reading_id"]: x for x in mon.recompute_late(on_time, late, stats).collect()}
    want = feat.all_features(cl.clean_fixed(r, stats.cleaning), min_max=stats.min_max).collect()
    assert len(want) == len(out)
    for x in want:
        for n, b in x.asDict().items():
            a = out[x["reading_id"]][n]
            assert a == b or abs(a - b) <= 1e-9 * max(1.0, abs(b)), (x["reading_id"], n, a, b)


def test_state_of_touched_sensors_only(spark):
    """A batch of two sensors updates two keys of the state; a later batch finds the others as they were."""
    from vigil.sources import views as v

    root = tempfile.mkdtemp(prefix="vigil-keyed-")
    r = v.readings_gaps(spark, SF001)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    two = F.col("sensor_id").isin("sensor_001", "sensor_002")
    parts = [r.filter(F.col("timestamp") < cut), r.filter((F.col("timestamp") >= cut) & two), r.filter((F.col("timestamp") >= cut) & ~two)]
    stats = mon.StreamStats.fit(r)
    progress = replay(parts, lambda part, path: part.write.parquet(path), f"{root}/src", lambda src: mon.monitor_stream(
        spark.readStream.schema(r.schema).parquet(src), mon.FeatureCarry(stats, f"{root}/late"), f"{root}/out", f"{root}/ckpt"))
    sensors = r.select("sensor_id").distinct().count()
    state = [p["stateOperators"][0] for p in progress if p["numInputRows"]]
    assert len(state) == 3 and state[0]["numRowsTotal"] >= sensors * 0.9
    first, second = (s["customMetrics"] for s in state[:2])
    for what in ("rocksdbPutCount", "rocksdbGetCount", "rocksdbTotalBytesWritten"):  # two of 150 sensors
        assert 0 < second[what] * 40 < first[what], (what, first[what], second[what])
    changed = spark.read.format("statestore").option("readChangeFeed", "true").option("changeStartBatchId", 1).option("changeEndBatchId", 1)
    assert {r[0] for r in changed.option("stateVarName", "known").load(f"{root}/ckpt").select("key.sensor_id").collect()} == {"sensor_001", "sensor_002"}
    got = spark.read.parquet(f"{root}/out/features")
    want = feat.all_features(cl.clean_fixed(r, stats.cleaning), min_max=stats.min_max)
    assert got.count() == want.count() == r.count()
    names = ["reading_id", "temperature_rolling_mean_20", "vibration_pct_change", "pressure_lag_5", "health_score"]
    names = [n for n in names if n in want.columns]
    a, b = ({x["reading_id"]: x for x in df.select(*names).collect()} for df in (got, want))
    for k, x in b.items():
        for n in names[1:]:
            assert (x[n] is None) == (a[k][n] is None) and (x[n] is None or abs(a[k][n] - x[n]) <= 1e-9 * max(1.0, abs(x[n]))), (k, n)


def test_values_older_than_the_tail_fill_gaps(spark):
    """A channel silent for longer than the kept rows goes on from its last known value."""
    root = tempfile.mkdtemp(prefix="vigil-known-")
    schema = "reading_id long, timestamp timestamp_ntz, sensor_id string, temperature double, vibration double, pressure double, label string"
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=i), "s", 5.0 if i == 0 else None, float(i % 7), 1.0 + i, "normal") for i in range(90)]
    rows += [(900, None, "s", 1.0, 1.0, 1.0, "normal"), (901, t0, None, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, schema)
    stats = mon.StreamStats.fit(df)
    parts = [df.filter("reading_id < 30 or reading_id >= 900"), df.filter("reading_id between 30 and 31"), df.filter("reading_id between 32 and 89")]
    replay(parts, lambda part, path: part.write.parquet(path), f"{root}/src", lambda src: mon.monitor_stream(
        spark.readStream.schema(schema).parquet(src), mon.FeatureCarry(stats, f"{root}/late"), f"{root}/out", f"{root}/ckpt"))
    got = spark.read.parquet(f"{root}/out/features")
    assert got.count() == 90 and {r[0] for r in got.select("temperature").collect()} == {5.0}
    assert sorted(r[0] for r in spark.read.parquet(f"{root}/late").select("reading_id").collect()) == [900, 901]


def test_late_alerts_are_dropped_and_counted(spark):
    from vigil.plans import q_streaming as qs
    from vigil.streaming import replay as rp

    parts = qs._late_alerts(spark, SF001)
    root = folder(spark, "late-alerts")
    progress = rp.replay(parts, lambda part, path: part.write.parquet(path), f"{root}/src", lambda src: mon.alert_stats_stream(
        spark, src, parts[0].schema, f"{root}/table", f"{root}/ckpt"))
    dropped = sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
    late = parts[-1].select(F.window(F.col("timestamp").cast("timestamp"), "1 hour"), "alert_level").distinct().count()
    assert 0 < late <= dropped  # rows of the late part, counted after their own partial sums


def test_a_broken_state_is_an_error(spark):
    import pytest

    root = tempfile.mkdtemp(prefix="vigil-state-")
    os.makedirs(f"{root}/state/v=0")
    with open(f"{root}/state/v=0/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        mon._read_if_any(spark, f"{root}/state").count()
    assert mon._read_if_any(spark, f"{root}/none") is None


def test_online_weights_start_from_the_fitted_model(spark):
    from vigil.models import classifiers as cls
    from vigil.sources import views as v

    feats = ["temperature", "vibration", "pressure"]
    r = v.readings(spark, SF001).withColumn("y", feat.encode_label("label")).fillna(0.0, feats)
    model = cls.fit_logistic(r, feats)
    w, scaler = cls.logistic_weights(model, feats)
    a = {x["reading_id"]: x["online_probability"] for x in cls.predict_online(model, r).collect()}
    b = {x["reading_id"]: x["online_probability"] for x in mon.predict_with_newest(r, "/nowhere/weights", feats, scaler, w).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_nan_text_is_rejected(spark):
    raw = spark.createDataFrame([("2024-01-01 00:00:00", "s", "NaN", "1.0", "2.0", "normal"), ("2024-01-01 00:01:00", "s", "3.0", "1.0", "2.0", "normal")],
                                "timestamp string, sensor_id string, temperature string, vibration string, pressure string, label string")
    assert tuple(rd.validation_counts(rd.type_readings(raw)).first()) == (1, 1)


class _Cell:
    """A state variable in memory that counts its calls."""

    def __init__(self, value):
        self.value, self.calls = value, 0

    def get(self):
        self.calls += 1
        return self.value

    def put(self, value):
        self.calls += 1
        self.value = value

    update = put


def test_carry_rows_asks_the_store_little_and_gives_one_frame_per_chunk():
    import pandas as pd

    from vigil.streaming.keyed_state import KIND, CarryRows

    op = CarryRows(["reading_id", "timestamp", "sensor_id", "temperature", "label"], ["temperature"], 2)
    op.tail, op.known = _Cell([]), _Cell(None)
    chunk = pd.DataFrame({"reading_id": [3, 1, 2, 4], "at_us": [30, 10, 20, None], "temperature": [None, 1.5, None, 9.0], "label": ["a", None, "b", "c"]})
    frames = list(op.handleInputRows(("s",), iter([chunk]), None))
    assert [list(f[KIND]) for f in frames] == [["new", "new", "new", "late"]]
    assert op.tail.value == [(2, 20, None, "b"), (3, 30, None, "a")] and op.known.value == (10, 1, 1.5)
    assert (op.tail.calls, op.known.calls) == (2, 1)
    frames = list(op.handleInputRows(("s",), iter([pd.DataFrame({"reading_id": [9, 5], "at_us": [20, 40], "temperature": [7.0, 8.0], "label": ["x", "y"]})]), None))
    assert [list(f[KIND]) for f in frames] == [["carry", "carry", "late", "new"]]
    assert frames[0]["temperature"].tolist()[0] == 1.5 and str(frames[0]["timestamp"].iloc[3]) == "1970-01-01 00:00:00.000040"
    assert op.tail.value == [(3, 30, None, "a"), (5, 40, 8.0, "y")]
    op.tail, op.known = _Cell([]), _Cell(None)
    assert list(op.handleInputRows((None,), iter([chunk.iloc[:1]]), None))[0][KIND].tolist() == ["late"]
