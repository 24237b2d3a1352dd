"""Registered source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.core import iso_ts
from vigil.plans.registry import register
from vigil.schema import ENVELOPE
from vigil.sources import readings as rd
from vigil.sources import views as v

ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"


def envelopes(spark, sf_dir):
    """JSON envelopes of three readings each, built from events (the wire format)."""
    r = v.readings(spark, sf_dir)
    item = F.struct(
        iso_ts("timestamp").alias("timestamp"), "sensor_id", "temperature", "vibration", "pressure", "label",
    )
    env = r.groupBy(F.floor(F.col("reading_id") / 3).alias("env_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("reading_id").alias("k"), item.alias("r")))).alias("items"))
    return env.select(
        "env_id",
        F.to_json(F.struct(F.transform("items", lambda x: x["r"]).alias("readings"),
                           F.size("items").alias("count"))).alias("body"),
    )


@register("i2_read_envelopes", f"""SELECT {ISO} AS "timestamp", printf('sensor_%03d', user_id) AS sensor_id,
  value AS temperature, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS vibration,
  CAST(minute(ts) AS DOUBLE) AS pressure,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'normal' END AS label FROM events""")
def i2_read_envelopes(spark, sf_dir):
    """JSON envelopes parsed with the fixed schema and flattened with inline."""
    body = envelopes(spark, sf_dir).select(F.from_json("body", ENVELOPE).alias("e")).select("e.*")
    return rd.flatten_envelopes(body)


@register("i3_validation_counts", f"""WITH readings_gaps AS ({v.READINGS_GAPS_SQL})
SELECT count_if(temperature IS NOT NULL AND vibration IS NOT NULL AND pressure IS NOT NULL) AS stored,
       count_if(NOT (temperature IS NOT NULL AND vibration IS NOT NULL AND pressure IS NOT NULL)) AS rejected
FROM readings_gaps""")
def i3_validation_counts(spark, sf_dir):
    """Rows meeting the NOT NULL contract vs rejects."""
    return rd.validation_counts(v.readings_gaps(spark, sf_dir))


@register("i4_accept_known", f"""WITH readings AS ({v.READINGS_SQL}), known_sensors AS ({v.KNOWN_SENSORS_SQL})
SELECT * FROM readings r WHERE EXISTS (SELECT 1 FROM known_sensors k WHERE k.sensor_id = r.sensor_id)""")
def i4_accept_known(spark, sf_dir):
    """Readings of sensors in the sensor dimension (semi join)."""
    return rd.accept_known(v.readings(spark, sf_dir), v.known_sensors(spark, sf_dir))


@register("i4_reject_unknown", f"""WITH readings AS ({v.READINGS_SQL}), known_sensors AS ({v.KNOWN_SENSORS_SQL})
SELECT * FROM readings r WHERE NOT EXISTS (SELECT 1 FROM known_sensors k WHERE k.sensor_id = r.sensor_id)""")
def i4_reject_unknown(spark, sf_dir):
    """Readings of unknown sensors (anti join)."""
    return rd.reject_unknown(v.readings(spark, sf_dir), v.known_sensors(spark, sf_dir))


@register("i4_bloom_known", f"""WITH readings AS ({v.READINGS_SQL}), known_sensors AS ({v.KNOWN_SENSORS_SQL})
SELECT * FROM readings r WHERE EXISTS (SELECT 1 FROM known_sensors k WHERE k.sensor_id = r.sensor_id)""")
def i4_bloom_known(spark, sf_dir):
    """Known sensors' readings where the dimension counts as too large to broadcast: Bloom filter, then semi join."""
    return rd.accept_known(v.readings(spark, sf_dir), v.known_sensors(spark, sf_dir), broadcast_rows=0)


@register("i4_bloom_unknown", f"""WITH readings AS ({v.READINGS_SQL}), known_sensors AS ({v.KNOWN_SENSORS_SQL})
SELECT * FROM readings r WHERE NOT EXISTS (SELECT 1 FROM known_sensors k WHERE k.sensor_id = r.sensor_id)""")
def i4_bloom_unknown(spark, sf_dir):
    """Unknown sensors' readings by the same filter: those that fail it, and of the others the anti join."""
    return rd.reject_unknown(v.readings(spark, sf_dir), v.known_sensors(spark, sf_dir), broadcast_rows=0)
