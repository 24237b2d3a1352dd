"""A readings table clustered for its two lookups, by sensor and by time.

Rows are ordered along a Z-curve over (sensor rank, time): the bits of both are
interleaved, the curve is cut into files of about ``rows_per_file`` rows, and a
file then spans a narrow range of both. An index beside the files has every
file's smallest and largest sensor and time; a lookup reads the index first and
opens only files that can hold its rows. Inside them Parquet's own statistics
go on skipping row groups, as the filters stay on the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.schema import READING
from vigil.session import stored

BITS = 16
ROWS_PER_FILE = 4_000_000


def interleaved(a: Column, b: Column, bits: int = BITS) -> Column:
    """The bits of two numbers below 2 ** bits, taken in turns; b has the lowest."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(a, i).bitwiseAND(1), 2 * i + 1)).bitwiseOR(F.shiftleft(F.shiftright(b, i).bitwiseAND(1), 2 * i))
    return out


def ranks(df: DataFrame, column: str) -> DataFrame:
    """``column``, rank (from 0) and n: the distinct values in order, NULL first, ranked by many tasks."""
    values = df.select(column).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(values.repartitionByRange(parts, F.col(column).asc_nulls_first()).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = {r[0]: r[1] for r in ranged.groupBy("_part").count().collect()}  # one row per range
    total, before = 0, []
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    starts = df.sparkSession.createDataFrame(before, "_p int, _before long")
    from pyspark.sql import Window

    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(column).asc_nulls_first())) - 1
    out = ranged.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return stored(out.select(column, (F.col("_before") + inside).alias("rank"), F.lit(total).cast("long").alias("n")), "ranks")


def write_clustered(readings: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Readings to ``path/rows`` along the Z-curve, their files' ranges to ``path/index``; replaces what is there."""
    spark, names = readings.sparkSession, READING.fieldNames()
    sensor = ranks(readings, "sensor_id").select(F.col("sensor_id").alias("_sensor"), F.expr(f"cast(rank * {1 << BITS} div n as long)").alias("_s"))
    edge = readings.agg(F.min("timestamp"), F.max("timestamp"), F.count("*")).first()
    x = readings.select(*names).join(sensor, F.col("sensor_id").eqNullSafe(F.col("_sensor"))).drop("_sensor")
    if edge[0] is None:
        t = F.lit(0).cast("long")
    else:
        lo = F.lit(edge[0]).cast("timestamp_ntz")
        span = max(1, int((edge[1] - edge[0]).total_seconds()) + 1)
        t = F.coalesce(F.floor(F.timestamp_diff("SECOND", lo, F.col("timestamp")) * F.lit(1 << BITS) / F.lit(span)), F.lit(0)).cast("long")
    files = max(1, -(-edge[2] // rows_per_file))
    x = x.withColumn("_z", interleaved(F.col("_s"), t))
    # rows of one sensor and moment need not share a file
    x = x.repartitionByRange(files, "_z", "reading_id").sortWithinPartitions("sensor_id", "timestamp").drop("_s", "_z")
    x.write.mode("overwrite").parquet(f"{path}/rows")
    ranges = spark.read.schema(READING).parquet(f"{path}/rows").groupBy(F.input_file_name().alias("file")).agg(
        F.count("timestamp").alias("n"), F.min("sensor_id").alias("sensor_lo"), F.max("sensor_id").alias("sensor_hi"),
        F.min("timestamp").alias("time_lo"), F.max("timestamp").alias("time_hi"))
    ranges.write.mode("overwrite").parquet(f"{path}/index")


def clustered_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def files_for(spark: SparkSession, path: str, sensor: str | None = None, since: str | None = None, until: str | None = None) -> list[str]:
    """Files that can hold rows of the sensor between the two times (timestamp texts, inclusive)."""
    at = clustered_index(spark, path)
    if sensor is not None:
        at = at.filter((F.col("sensor_lo") <= sensor) & (F.col("sensor_hi") >= sensor))
    if since is not None:
        at = at.filter(F.col("time_hi") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        at = at.filter(F.col("time_lo") <= F.lit(until).cast("timestamp_ntz"))
    return sorted(r[0] for r in at.select("file").collect())  # what the lookup opens


def read_clustered(spark: SparkSession, path: str, sensor: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """The readings of a sensor and/or time range, from the files that can hold them."""
    files = files_for(spark, path, sensor, since, until)
    x = spark.read.schema(READING).parquet(*files) if files else spark.createDataFrame([], READING)
    if sensor is not None:
        x = x.filter(F.col("sensor_id") == sensor)
    if since is not None:
        x = x.filter(F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        x = x.filter(F.col("timestamp") <= F.lit(until).cast("timestamp_ntz"))
    return x


def newest(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The newest ``n`` readings: files whose rows are all older than n others' are not opened."""
    from pyspark.sql import Window

    at = clustered_index(spark, path).filter("time_hi is not null")
    # files by their oldest row, newest first: where n rows are reached, that oldest row is a floor for the answer
    run = F.sum("n").over(Window.orderBy(F.desc("time_lo")).rowsBetween(Window.unboundedPreceding, -1))
    floor = at.withColumn("_before", F.coalesce(run, F.lit(0))).filter(F.col("_before") < n).agg(F.min("time_lo")).first()[0]
    x = read_clustered(spark, path, since=None if floor is None else str(floor))
    return x.orderBy(F.desc("timestamp"), F.desc("reading_id")).limit(n)
