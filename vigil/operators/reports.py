"""Report operators D1-D5, T4, G1-G3, G9, I6, I7, P12, P14.

All of these read one scored/readings frame (score once, derive every report);
per-sensor "latest" rows use ``max_by`` aggregation, which keeps one candidate
per key in each map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.config import CHANNELS
from vigil.operators.features import latest_per_key

# Equipment status icons and gauge bands (0-50, 50-70, 70-100, reference 70).
STATUS_ICONS = {"CRITICAL": "🚨", "WARNING": "⚠️", "ANOMALY": "⚠️", "NORMAL": "✅"}
GAUGE_REFERENCE = 70.0


# ------------------------------------------------------------------ G1-G3, P12
def label_distribution(df: DataFrame) -> DataFrame:
    """G1: rows per label."""
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def sensor_count(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct sensors (exact, or HyperLogLog++ when ``approx``)."""
    c = F.approx_count_distinct("sensor_id") if approx else F.count_distinct("sensor_id")
    return df.agg(c.alias("sensors"))


def reading_count(df: DataFrame) -> DataFrame:
    """Number of readings."""
    return df.agg(F.count(F.lit(1)).alias("readings"))


def for_sensor(df: DataFrame, sensor_id: str) -> DataFrame:
    """Rows of one sensor (pushed into the parquet scan as a filter)."""
    return df.filter(F.col("sensor_id") == F.lit(sensor_id))


def fmt(c: str | Column, digits: int) -> Column:
    """Fixed-point text, as f-string ``:.{digits}f``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.format_string(f"%.{digits}f", col)


# ------------------------------------------------------------------ I6, I7, T4
def latest_readings(df: DataFrame, n: int = 100) -> DataFrame:
    """Newest ``n`` readings (TakeOrderedAndProject: n rows per task, bounded)."""
    return df.orderBy(F.desc("timestamp"), F.desc("reading_id")).limit(n)


def sensor_history(df: DataFrame, sensor_id: str, as_of, hours: int = 24) -> DataFrame:
    """One sensor's readings in (as_of - hours, as_of], ascending; ``as_of`` is a parameter."""
    ref = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    lo = ref - F.make_dt_interval(F.lit(0), F.lit(hours))
    return (
        df.filter((F.col("sensor_id") == F.lit(sensor_id)) & (F.col("timestamp") >= lo) & (F.col("timestamp") <= ref))
        .orderBy("timestamp", "reading_id")
    )


def trends(df: DataFrame, n: int = 100, channels=CHANNELS) -> DataFrame:
    """T4: last ``n`` readings as an ascending long series (timestamp, channel, value)."""
    last = latest_readings(df, n).select("reading_id", "timestamp", "sensor_id", *channels)
    return last.unpivot(["reading_id", "timestamp", "sensor_id"], list(channels), "channel", "value")


# ------------------------------------------------------------------ G9, D1-D5
def latest_scores(scored: DataFrame) -> DataFrame:
    return latest_per_key(scored, ("sensor_id",), ("timestamp", "reading_id"))


def overall_risk(scored: DataFrame) -> DataFrame:
    """Mean risk over each sensor's latest prediction; empty -> 0."""
    return latest_scores(scored).agg(F.coalesce(F.avg("risk_score"), F.lit(0.0)).alias("overall_risk"))


def kpis(scored: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Sensors, readings, mean latest risk and total alerts in one row."""
    a = scored.agg(F.count_distinct("sensor_id").alias("sensors"), F.count(F.lit(1)).alias("readings"))
    r = overall_risk(scored).withColumnRenamed("overall_risk", "average_risk")
    out = a.crossJoin(r)
    if alerts is not None:
        out = out.crossJoin(alerts.agg(F.count(F.lit(1)).alias("total_alerts")))
    return out


def gauge(risk: DataFrame, col: str = "overall_risk") -> DataFrame:
    """Gauge value (percent), band and delta to the 70 reference."""
    val = F.col(col) * 100
    band = F.when(val < 50, "low").when(val < GAUGE_REFERENCE, "elevated").otherwise("high")
    color = F.when(val < 50, "lightgray").when(val < GAUGE_REFERENCE, "yellow").otherwise("red")
    return risk.select(val.alias("gauge_value"), band.alias("band"), color.alias("band_color"),
                       (val - F.lit(GAUGE_REFERENCE)).alias("delta"))


def freshness(df: DataFrame, as_of: Column | None = None, stale_after_s: int = 3600) -> DataFrame:
    """D3 (re-aimed pipeline status): last reading time and lag per sensor, stale flag.

    ``as_of`` defaults to the newest reading of the table (data-derived, replayable).
    """
    per = df.groupBy("sensor_id").agg(F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("readings"))
    if as_of is None:
        ref = df.agg(F.max("timestamp").alias("_as_of"))
        per = per.crossJoin(F.broadcast(ref))
        as_of = F.col("_as_of")
    lag = F.timestamp_diff("SECOND", F.col("last_seen"), as_of)
    return per.select("sensor_id", "last_seen", "readings", lag.alias("lag_seconds"),
                      (lag > F.lit(stale_after_s)).alias("stale"))


def equipment_status(scored: DataFrame) -> DataFrame:
    """Status per sensor at its latest prediction (CRITICAL/WARNING/ANOMALY/NORMAL)."""
    last = latest_scores(scored)
    risk = F.coalesce(F.col("risk_score"), F.lit(0.0))
    fail = F.coalesce(F.col("is_failure"), F.lit(False))
    anom = F.coalesce(F.col("is_anomaly"), F.lit(False))
    status = F.when(fail | (risk >= 0.9), "CRITICAL").when(risk >= 0.7, "WARNING").when(anom, "ANOMALY") \
        .otherwise("NORMAL")
    icon = None
    for k, v in STATUS_ICONS.items():
        icon = F.when(F.col("status") == k, F.lit(f"{v} {k}")) if icon is None else icon.when(F.col("status") == k,
                                                                                               F.lit(f"{v} {k}"))
    s = last.select("sensor_id", "timestamp", "risk_score", "failure_probability", "is_failure", "is_anomaly",
                    "temperature", "vibration", "pressure", status.alias("status"))
    return s.select(
        *s.columns, icon.alias("status_display"),
        fmt("risk_score", 3).alias("risk_text"), fmt("failure_probability", 3).alias("failure_text"),
        fmt("temperature", 1).alias("temperature_text"), fmt("vibration", 2).alias("vibration_text"),
        fmt("pressure", 2).alias("pressure_text"),
    )


def feature_details(top: DataFrame) -> DataFrame:
    """Feature, value, shap_value of the top contributions, sign colour."""
    return top.select(
        *[c for c in ("reading_id", "rank") if c in top.columns], "feature", "value", "shap_value",
        F.when(F.col("shap_value") > 0, "red").otherwise("blue").alias("color"),
    )
