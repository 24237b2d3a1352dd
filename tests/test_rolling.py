"""Rolling statistics in Arrow batches equal Spark's sliding frames."""

import pytest
from pyspark.sql import functions as F

from vigil.config import FeatureConfig
from vigil.functions import series as fs
from vigil.functions.series import Series
from vigil.operators import features as feat

CFG = FeatureConfig()


def _windows(df, channels=CFG.channels):
    return df.select("*", *[c for w in CFG.windows for x in channels for c in fs.rolling(x, [w], Series())])


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def rows(spark):
    """Long, short and single-row sensors, one without a name, rows without a time; missing values, constants, NaN."""
    return spark.sql("""SELECT id AS reading_id, IF(id % 41 = 0, NULL, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 7919 % 1500)) AS timestamp,
        CASE WHEN id < 900 THEN 'long' WHEN id < 1200 THEN concat('s', id % 60) WHEN id < 1230 THEN concat('one', id) ELSE NULL END AS sensor_id,
        IF(id % 5 < 2, NULL, sin(id) * 1e4) AS temperature, CASE WHEN id % 97 = 5 THEN double('NaN') WHEN id BETWEEN 300 AND 420 THEN NULL ELSE cos(id) END AS vibration,
        IF(id % 300 < 150, 0.07D, id / 3D) AS pressure, 'normal' AS label FROM range(1500)""")


@pytest.mark.parametrize("batch,chunk_rows", [(10_000, None), (7, None), (7, 100)])
def test_equal_to_sliding_frames(spark, rows, batch, chunk_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = feat.rolling_features(rows, CFG, chunk_rows=chunk_rows)
        want = _windows(rows)
        assert got.dtypes == want.dtypes
        a, b = _rows(got), _rows(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(a) == len(b) == 1500
    assert repr(a) == repr(b)  # bit for bit, NaN too


def test_no_frame_is_aggregated_again_for_every_row(rows):
    plan = feat.rolling_features(rows, CFG, chunk_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "row_number" in plan
    assert "stddev_samp" not in plan and "ROWS BETWEEN" not in plan.upper()


def test_other_types_keep_their_frames(rows):
    ints = rows.withColumn("temperature", F.col("temperature").cast("int"))
    got = feat.rolling_features(ints, CFG)
    assert dict(got.dtypes)["temperature_rolling_min_5"] == "int"
    assert repr(_rows(got)) == repr(_rows(_windows(ints)))
