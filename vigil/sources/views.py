"""Readings derived from the driver's tables (FIXTURES.md section 2).

Each view is a projection over a parquet scan, so Catalyst prunes columns and
pushes filters into the reader; every row of the source becomes one reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor_name(user_id) -> F.Column:
    return F.format_string("sensor_%03d", F.col(user_id) if isinstance(user_id, str) else user_id)


def _reading_cols(e: DataFrame) -> dict:
    return {
        "reading_id": F.col("event_id"),
        "timestamp": F.col("ts"),
        "sensor_id": sensor_name("user_id"),
        "temperature": F.col("value"),
        "vibration": F.get_json_object("props", "$.k").try_cast("double"),
        "pressure": F.minute("ts").cast("double"),
        "label": F.when(F.col("event_type") == "error", "failure").otherwise("normal"),
    }


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(*[c.alias(n) for n, c in _reading_cols(e).items()])


def readings_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with holes: temperature, vibration and whole-sensor pressure gaps."""
    e = table(spark, sf_dir, "events")
    c = _reading_cols(e)
    c["temperature"] = F.when(F.col("event_id") % 17 != 0, c["temperature"])
    c["vibration"] = F.when(F.col("event_id") % 23 >= 2, c["vibration"])
    c["pressure"] = F.when(F.col("user_id") % 50 != 7, c["pressure"])
    return e.select(*[v.alias(n) for n, v in c.items()])


def readings_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return r.withColumn(
        "temperature",
        F.when(F.col("reading_id") % 29 == 0, F.lit("bad")).otherwise(F.col("temperature").cast("string")),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in model outputs for alerting / risk / report operators."""
    r = readings(spark, sf_dir)
    fp = F.col("temperature") / F.lit(500.0)
    an = (F.col("vibration") - F.lit(50.0)) / F.lit(100.0)
    return r.select(
        *r.columns,
        fp.alias("failure_probability"),
        an.alias("anomaly_score"),
        ((F.col("reading_id") % 101) / F.lit(100.0)).alias("online_probability"),
        (fp >= F.lit(0.95)).alias("is_failure"),
        (an < F.lit(0.0)).alias("is_anomaly"),
    )


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in explanation rows (reading_id, feature, shap_value) from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_orderkey").alias("reading_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature")
    ).agg(_round6(F.sum(F.col("l_discount") - F.col("l_tax"))).alias("shap_value"), F.sum("l_quantity").alias("value"))


def _round6(c):
    # contributions are rounded at the source so that ties in |shap| are exact on every engine
    return F.signum(c) * F.floor(F.abs(c) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def lineitem_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second, larger series: supplier = sensor, three numeric channels."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("sensor_id"),
        F.col("l_shipdate").alias("timestamp"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").alias("temperature"),
        F.col("l_extendedprice").alias("vibration"),
        F.col("l_discount").alias("pressure"),
    )


def known_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor dimension: customers whose key mod 10 is not 3."""
    c = table(spark, sf_dir, "customer")
    return c.filter(F.col("c_custkey") % 10 != 3).select(sensor_name("c_custkey").alias("sensor_id"))


# DuckDB text of the same views, used by oracle SQL (kept next to the Spark form).
READINGS_SQL = """
SELECT event_id AS reading_id, ts AS "timestamp",
       printf('sensor_%03d', user_id) AS sensor_id,
       value AS temperature,
       TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS vibration,
       CAST(minute(ts) AS DOUBLE) AS pressure,
       CASE WHEN event_type = 'error' THEN 'failure' ELSE 'normal' END AS label
FROM events
"""

READINGS_GAPS_SQL = """
SELECT event_id AS reading_id, ts AS "timestamp",
       printf('sensor_%03d', user_id) AS sensor_id,
       CASE WHEN event_id % 17 <> 0 THEN value END AS temperature,
       CASE WHEN event_id % 23 >= 2 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS vibration,
       CASE WHEN user_id % 50 <> 7 THEN CAST(minute(ts) AS DOUBLE) END AS pressure,
       CASE WHEN event_type = 'error' THEN 'failure' ELSE 'normal' END AS label
FROM events
"""

READINGS_TEXT_SQL = """
SELECT reading_id, "timestamp", sensor_id,
       CASE WHEN reading_id % 29 = 0 THEN 'bad' ELSE CAST(temperature AS VARCHAR) END AS temperature,
       vibration, pressure, label
FROM readings
"""

SCORES_SQL = """
SELECT r.*, temperature / 500.0 AS failure_probability,
       (vibration - 50.0) / 100.0 AS anomaly_score,
       (reading_id % 101) / 100.0 AS online_probability,
       temperature / 500.0 >= 0.95 AS is_failure,
       (vibration - 50.0) / 100.0 < 0 AS is_anomaly
FROM readings r
"""

CONTRIBUTIONS_SQL = """
SELECT l_orderkey AS reading_id, 'f' || CAST(l_linenumber AS VARCHAR) AS feature,
       sign(sum(l_discount - l_tax)) * floor(abs(sum(l_discount - l_tax)) * 1000000.0 + 0.5) / 1000000.0 AS shap_value,
       sum(l_quantity) AS value
FROM lineitem GROUP BY 1, 2
"""

LINEITEM_SERIES_SQL = """
SELECT l_suppkey AS sensor_id, l_shipdate AS "timestamp", l_orderkey, l_linenumber, l_partkey,
       l_quantity AS temperature, l_extendedprice AS vibration, l_discount AS pressure
FROM lineitem
"""

KNOWN_SENSORS_SQL = """
SELECT printf('sensor_%03d', c_custkey) AS sensor_id FROM customer WHERE c_custkey % 10 <> 3
"""


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs it needs (readings first)."""
    defs = {
        "readings": READINGS_SQL,
        "readings_gaps": READINGS_GAPS_SQL,
        "readings_text": READINGS_TEXT_SQL,
        "scores": SCORES_SQL,
        "contributions": CONTRIBUTIONS_SQL,
        "lineitem_series": LINEITEM_SERIES_SQL,
        "known_sensors": KNOWN_SENSORS_SQL,
    }
    need = list(names)
    if any(n in ("readings_text", "scores") for n in need) and "readings" not in need:
        need.insert(0, "readings")
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in need)
    return f"WITH {ctes}\n{sql}"
