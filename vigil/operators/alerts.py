"""Alert operators A1, A2, A4-A8, G10, G11, T3; the stored table (I10, A3, A8) is in ``alert_store``.

Alerts are rows, built by column expressions from scored rows; delivery
payloads are JSON/text columns written to an outbox table (no HTTP here).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.config import AlertConfig
from vigil.functions.core import iso_ts

# Alert messages, log severity, attachment colours and icons per level.
MESSAGES = {
    "EMERGENCY": "🚨 EMERGENCY: Equipment %s at CRITICAL risk of failure!",
    "CRITICAL": "⚠️ CRITICAL: Equipment %s showing high failure risk!",
    "WARNING": "⚠️ WARNING: Equipment %s showing elevated risk!",
    "INFO": "ℹ️ INFO: Equipment %s status update",
}
LOG_SEVERITY = {"EMERGENCY": "CRITICAL", "CRITICAL": "ERROR", "WARNING": "WARNING", "INFO": "INFO"}
COLORS = {"EMERGENCY": "#FF0000", "CRITICAL": "#FF6600", "WARNING": "#FFAA00", "INFO": "#00AA00"}
DEFAULT_COLOR = "#000000"
ICONS = {"EMERGENCY": "🚨", "CRITICAL": "⚠️", "WARNING": "⚠️", "INFO": "ℹ️"}
DEFAULT_ICON = "📊"
LEVEL_ORDER = {"INFO": 0, "WARNING": 1, "CRITICAL": 2, "EMERGENCY": 3}
# Our own footer for outbox payloads (not a reference value).
FOOTER = "vigil alerts"

PREDICTION_FIELDS = (
    "risk_score", "failure_probability", "anomaly_score", "online_probability", "is_failure", "is_anomaly",
)


def _num(c: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)


def _flag(c: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in df.columns else F.lit(False)


def _lookup(level: Column, table: dict, default=None) -> Column:
    out = None
    for k, val in table.items():
        out = (F.when(level == k, F.lit(val)) if out is None else out.when(level == k, F.lit(val)))
    return out.otherwise(F.lit(default)) if default is not None else out


def alert_level(df: DataFrame, cfg: AlertConfig = AlertConfig()) -> Column:
    """A1: EMERGENCY / CRITICAL / WARNING / INFO, NULL-safe (Q20)."""
    risk, prob = _num("risk_score", df), _num("failure_probability", df)
    fail, anom = _flag("is_failure", df), _flag("is_anomaly", df)
    thr = F.lit(cfg.failure_threshold)
    if "failure_threshold" in df.columns:  # per-sensor override (P4), default where absent
        thr = F.coalesce(F.col("failure_threshold"), thr)
    return (
        F.when((risk >= cfg.emergency) | (prob >= cfg.emergency) | fail, "EMERGENCY")
        .when((risk >= cfg.critical) | (prob >= cfg.critical), "CRITICAL")
        .when((risk >= thr) | (prob >= thr) | anom, "WARNING")
        .otherwise("INFO")
    )


def with_thresholds(df: DataFrame, thresholds: DataFrame, key: str = "sensor_id",
                    broadcast_rows: int = 5_000_000) -> DataFrame:
    """Attach per-sensor ``failure_threshold`` (left join; broadcast after a size check)."""
    t = thresholds.select(key, "failure_threshold")
    n = t.count()
    return df.join(F.broadcast(t) if n <= broadcast_rows else t, key, "left")


def level_rank(level: Column) -> Column:
    return _lookup(level, LEVEL_ORDER).cast("int")


def build_alerts(df: DataFrame, cfg: AlertConfig = AlertConfig(), min_level: str = "INFO",
                 ts: str = "timestamp") -> DataFrame:
    """A1 + A2: one alert row per prediction row at or above ``min_level``.

    The alert time is the reading's event time (deterministic and replayable);
    ``raw_data`` keeps the prediction fields as a struct.
    """
    lvl = alert_level(df, cfg)
    sensor = F.coalesce(F.col("sensor_id"), F.lit("unknown")) if "sensor_id" in df.columns else F.lit("unknown")
    msg = F.replace(_lookup(F.col("alert_level"), MESSAGES), F.lit("%s"), F.col("sensor_id"))
    raw = F.struct(
        *[F.col(c) for c in ("reading_id", ts, "sensor_id") if c in df.columns],
        *[F.col(c) for c in PREDICTION_FIELDS if c in df.columns],
    )
    keep = [c for c in ("reading_id",) if c in df.columns]
    a = df.select(
        *keep,
        F.col(ts).alias("timestamp"),
        sensor.alias("sensor_id"),
        lvl.alias("alert_level"),
        _num("risk_score", df).alias("risk_score"),
        _num("failure_probability", df).alias("failure_probability"),
        _num("anomaly_score", df).alias("anomaly_score"),
        _flag("is_failure", df).alias("is_failure"),
        _flag("is_anomaly", df).alias("is_anomaly"),
        raw.alias("raw_data"),
    )
    a = a.select(*keep, "timestamp", "sensor_id", "alert_level", msg.alias("message"),
                 *[c for c in a.columns if c not in (*keep, "timestamp", "sensor_id", "alert_level")])
    if min_level != "INFO":
        a = a.filter(level_rank(F.col("alert_level")) >= F.lit(LEVEL_ORDER[min_level]))
    return a


# ------------------------------------------------------------------ payloads
def _f4(c: str) -> Column:
    return F.format_string("%.4f", F.col(c))


def console_text(alerts: DataFrame) -> DataFrame:
    """Console block and log severity per alert."""
    sep = "=" * 60
    text = F.format_string(
        f"\n{sep}\nALERT: %s\nTime: %s\nEquipment: %s\nMessage: %s\nRisk Score: %.4f\n"
        f"Failure Probability: %.4f\nAnomaly Score: %.4f\n{sep}\n",
        F.col("alert_level"), iso_ts("timestamp"), F.col("sensor_id"), F.col("message"),
        F.col("risk_score"), F.col("failure_probability"), F.col("anomaly_score"),
    )
    keep = [c for c in ("reading_id",) if c in alerts.columns]
    return alerts.select(*keep, "sensor_id", "alert_level",
                         _lookup(F.col("alert_level"), LOG_SEVERITY).alias("log_severity"), text.alias("text"))


def chat_payload(alerts: DataFrame) -> DataFrame:
    """A4: attachment-style chat payload as a JSON column."""
    fields = F.array(
        F.struct(F.lit("Risk Score").alias("title"), _f4("risk_score").alias("value"), F.lit(True).alias("short")),
        F.struct(F.lit("Failure Probability").alias("title"), _f4("failure_probability").alias("value"),
                 F.lit(True).alias("short")),
        F.struct(F.lit("Timestamp").alias("title"), iso_ts("timestamp").alias("value"),
                 F.lit(False).alias("short")),
    )
    att = F.struct(
        _lookup(F.col("alert_level"), COLORS, DEFAULT_COLOR).alias("color"),
        F.concat(F.lit("Equipment Alert: "), F.col("sensor_id")).alias("title"),
        F.col("message").alias("text"),
        fields.alias("fields"),
        F.lit(FOOTER).alias("footer"),
        # epoch seconds of the local event time, independent of the session time zone
        F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("timestamp")).alias("ts"),
    )
    keep = [c for c in ("reading_id",) if c in alerts.columns]
    return alerts.select(*keep, "sensor_id", "alert_level", F.to_json(F.struct(F.array(att).alias("attachments")))
                         .alias("payload"))


def markdown_payload(alerts: DataFrame) -> DataFrame:
    """A5: markdown text payload with an icon per level."""
    text = F.format_string(
        "\n%s *Equipment Alert*\n\n*Equipment:* %s\n*Level:* %s\n*Message:* %s\n\n*Risk Score:* %.4f\n"
        "*Failure Probability:* %.4f\n*Anomaly Score:* %.4f\n\n*Time:* %s\n",
        _lookup(F.col("alert_level"), ICONS, DEFAULT_ICON), F.col("sensor_id"), F.col("alert_level"),
        F.col("message"), F.col("risk_score"), F.col("failure_probability"), F.col("anomaly_score"),
        iso_ts("timestamp"),
    )
    keep = [c for c in ("reading_id",) if c in alerts.columns]
    return alerts.select(*keep, "sensor_id", "alert_level",
                         F.to_json(F.struct(text.alias("text"), F.lit("Markdown").alias("parse_mode"))).alias("payload"))


def route(alerts: DataFrame, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """One row per (alert, enabled channel)."""
    ch = cfg.enabled_channels()
    arr = F.array(*[F.lit(c) for c in ch]) if ch else F.array().cast("array<string>")
    return alerts.select(*alerts.columns, F.explode(arr).alias("channel"))


def retain(alerts: DataFrame, cutoff) -> DataFrame:
    """Keep alerts at or after ``cutoff`` (a Column or literal); clear = retain(now)."""
    c = cutoff if isinstance(cutoff, Column) else F.lit(cutoff).cast("timestamp_ntz")
    return alerts.filter(F.col("timestamp") >= c)


# ------------------------------------------------------------------ stats
def alert_stats(alerts: DataFrame) -> DataFrame:
    """Count per level plus the total (rollup row with level 'TOTAL')."""
    r = alerts.rollup("alert_level").agg(F.count(F.lit(1)).alias("n"))
    return r.select(F.coalesce(F.col("alert_level"), F.lit("TOTAL")).alias("alert_level"), "n")


def alert_stats_by_window(alerts: DataFrame, window: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """S5 (batch form): alerts per level per tumbling event-time window (partial aggregate)."""
    w = F.window(F.col(ts), window)
    g = alerts.groupBy(w.alias("w"), "alert_level").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "alert_level", "n")


def recent_alert_count(alerts: DataFrame, as_of: Column | None = None, hours: int = 1) -> DataFrame:
    """Alerts newer than ``as_of - hours``; as_of defaults to the newest alert."""
    if as_of is None:
        ref = alerts.agg(F.max("timestamp").alias("_as_of"))
        j = alerts.crossJoin(F.broadcast(ref))
        as_of = F.col("_as_of")
    else:
        j = alerts
    return j.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("timestamp") > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))).alias("recent_alerts"),
    )


def recent_alerts(alerts: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` alerts, report columns (a top-k: limit is the feature)."""
    order = [F.desc("timestamp")] + ([F.desc("reading_id")] if "reading_id" in alerts.columns else [])
    cols = [c for c in ("reading_id",) if c in alerts.columns]
    return alerts.orderBy(*order).limit(n).select(*cols, "timestamp", "sensor_id", "alert_level", "message", "risk_score")
