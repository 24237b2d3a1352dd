"""The skew-safe chunk plan must give exactly the plain per-sensor result."""

from conftest import SF001
from pyspark.sql import functions as F

from vigil.config import FeatureConfig
from vigil.operators import clean as cl
from vigil.operators import features as feat
from vigil.sources import views as v


def _same(a, b, key="reading_id"):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    ra = sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r)
                 for r in a.select(*cols).collect()), key=repr)
    rb = sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r)
                 for r in b.select(*cols).collect()), key=repr)
    assert len(ra) == len(rb)
    assert ra == rb


def test_hot_sensor_chunks_equal_plain(spark):
    # one artificial hot sensor: a third of the rows renamed to one id
    r = v.readings_gaps(spark, SF001).withColumn(
        "sensor_id", F.when(F.col("reading_id") % 3 == 0, F.lit("hot")).otherwise(F.col("sensor_id"))
    )
    plain = feat.all_features(r, FeatureConfig(), chunk_rows=None)
    chunked = feat.all_features(r, FeatureConfig(), chunk_rows=150)
    _same(plain, chunked)


def test_chunk_plan_has_one_row_per_input(spark):
    r = v.readings(spark, SF001)
    out = feat.all_features(r, chunk_rows=40)
    assert out.count() == r.count()
    assert out.select("reading_id").distinct().count() == r.count()


def test_fill_chunked_equals_plain(spark):
    r = v.readings_gaps(spark, SF001).withColumn(
        "sensor_id", F.when(F.col("reading_id") % 2 == 0, F.lit("hot")).otherwise(F.col("sensor_id"))
    )
    _same(cl.fill_missing(r, chunk_rows=None), cl.fill_missing(r, chunk_rows=97))


def test_latest_features_equal_full_history(spark):
    r = v.readings_gaps(spark, SF001)
    want = feat.latest_per_key(feat.all_features(r, chunk_rows=None))
    got = feat.latest_features(r)
    _same(want, got)


def test_latest_features_carry_over_long_gap(spark):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "s1", float(i + 1) if i < 5 else None, 1.0, 2.0) for i in range(30)]
    df = spark.createDataFrame(rows, "reading_id long, ts string, sensor_id string, temperature double, "
                                     "vibration double, pressure double") \
        .select("reading_id", F.col("ts").cast("timestamp_ntz").alias("timestamp"), "sensor_id",
                "temperature", "vibration", "pressure")
    want = feat.latest_per_key(feat.all_features(df, chunk_rows=None))
    got = feat.latest_features(df)
    assert got.first()["temperature_rate_of_change_pct"] == 0.0
    _same(want, got)


def test_burst_inside_one_time_bucket_is_split(spark):
    from vigil.functions.series import Series
    from vigil.plans.chunking import CHUNK, HALO, plan_chunks

    # a hot sensor whose rows mostly arrive in a burst of a few milliseconds
    r = v.readings_gaps(spark, SF001).withColumn(
        "sensor_id", F.when(F.col("reading_id") % 3 == 0, F.lit("hot")).otherwise(F.col("sensor_id"))
    ).withColumn(
        "timestamp",
        F.when((F.col("sensor_id") == "hot") & (F.col("reading_id") % 2 == 0),
               F.lit("2024-01-15 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
                   F.lit(0), F.lit(0), F.lit(0), F.col("reading_id") / F.lit(1e6))).otherwise(F.col("timestamp")),
    )
    x, s = plan_chunks(r, Series(), 19, 150, carry_channels=["temperature"])
    sizes = x.filter(~F.col(HALO) & (F.col("sensor_id") == "hot")).groupBy(CHUNK).count().collect()
    assert len(sizes) > 5 and max(row["count"] for row in sizes) <= 2 * 150
    _same(feat.all_features(r, chunk_rows=None), feat.all_features(r, chunk_rows=150))


def test_chunk_plan_leaves_nothing_persisted(spark):
    r = spark.range(2000).select(
        F.col("id").alias("reading_id"), F.when(F.col("id") % 11 != 0, F.timestamp_seconds(F.col("id") * 60)).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 2 == 0, F.lit("a")).otherwise(F.format_string("s%d", F.col("id") % 7)).alias("sensor_id"),
        F.when(F.col("id") % 3 != 0, F.rand(1)).alias("temperature"), F.rand(2).alias("vibration"), F.rand(3).alias("pressure"))
    r = r.cache()
    r.count()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    plain = {x["reading_id"]: x.asDict() for x in feat.all_features(r, chunk_rows=None).collect()}
    cut = {x["reading_id"]: x.asDict() for x in feat.all_features(r, chunk_rows=100).collect()}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert plain.keys() == cut.keys()
    for k, row in plain.items():
        for n, a in row.items():
            b = cut[k][n]
            assert a == b or (a is not None and b is not None and abs(a - b) <= 1e-9 * max(1.0, abs(a))), (k, n, a, b)
    r.unpersist()
