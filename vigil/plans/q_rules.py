"""Registered rule, risk, alert and report queries (R1-R3, M11, A1-A7, G1-G3,
G9-G11, T3, T4, D1-D5, I6, I7, P12, P14) over stand-in scores."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from vigil.config import AlertConfig
from vigil.operators import alerts as al
from vigil.operators import reports as rp
from vigil.operators import rules as ru
from vigil.operators.alert_store import AlertStore
from vigil.plans.registry import register
from vigil.session import folder, stored
from vigil.sources import layout
from vigil.sources import views as v

ROUTE_CFG = AlertConfig(webhook_enabled=True, chat_enabled=True, markdown_enabled=True)
ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"


def R(x: str, d: int) -> str:
    """Half-up rounding of the shortest decimal text, as Java's %.nf formats a double."""
    return f"round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 24)), {d})::DOUBLE"


def scored(spark, sf_dir):
    """Stand-in scores with the combined risk (batch scope)."""
    return ru.combine_risk(v.scores(spark, sf_dir))


def alerts(spark, sf_dir):
    return al.build_alerts(scored(spark, sf_dir))


# ----------------------------------------------------------------- SQL pieces
BASE = f"WITH readings AS ({v.READINGS_SQL}), scores AS ({v.SCORES_SQL}),\n"
SCORED = """scored AS (
  SELECT s.*, 1 - (anomaly_score - mm.lo) / (mm.hi - mm.lo + 1e-08) AS anomaly_risk,
         0.3 * (1 - (anomaly_score - mm.lo) / (mm.hi - mm.lo + 1e-08)) + 0.5 * failure_probability
           + 0.2 * online_probability AS risk_score,
         'batch' AS risk_scope
  FROM scores s CROSS JOIN (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM scores) mm)"""
LEVEL = """CASE WHEN coalesce(risk_score, 0) >= 0.9 OR coalesce(failure_probability, 0) >= 0.9
               OR coalesce(is_failure, false) THEN 'EMERGENCY'
          WHEN coalesce(risk_score, 0) >= 0.8 OR coalesce(failure_probability, 0) >= 0.8 THEN 'CRITICAL'
          WHEN coalesce(risk_score, 0) >= 0.7 OR coalesce(failure_probability, 0) >= 0.7
               OR coalesce(is_anomaly, false) THEN 'WARNING'
          ELSE 'INFO' END"""
MSG = "CASE alert_level " + " ".join(
    f"WHEN '{k}' THEN replace('{m}', '%s', sensor_id)" for k, m in al.MESSAGES.items()
) + " END"
ALERTS = f""",
lv AS (SELECT *, {LEVEL} AS alert_level FROM scored),
alerts AS (
  SELECT reading_id, "timestamp", coalesce(sensor_id, 'unknown') AS sensor_id, alert_level, {MSG} AS message,
         coalesce(risk_score, 0) AS risk_score, coalesce(failure_probability, 0) AS failure_probability,
         coalesce(anomaly_score, 0) AS anomaly_score, coalesce(is_failure, false) AS is_failure,
         coalesce(is_anomaly, false) AS is_anomaly
  FROM lv)"""
A_DBL = ("risk_score", "failure_probability", "anomaly_score")
LATEST = """latest AS (SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY "timestamp" DESC, reading_id DESC) = 1)"""


def _case(col, table, default=None):
    s = "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in table.items())
    return s + (f" ELSE '{default}'" if default is not None else "") + " END"


# ----------------------------------------------------------------- rules
RULE = """greatest(0.0, (temperature - 30) / 60) AS temperature_risk,
  greatest(0.0, (vibration - 1) / 5) AS vibration_risk,
  greatest(0.0, (5.0 - pressure) / 5) AS pressure_risk"""
RISK = "least(1.0, (greatest(0.0, (temperature - 30) / 60) + greatest(0.0, (vibration - 1) / 5) " \
       "+ greatest(0.0, (5.0 - pressure) / 5)) / 3)"
RULE_SQL = f"""WITH readings AS ({v.READINGS_SQL})
SELECT r.*, {RULE}, {RISK} AS risk_score,
  CASE WHEN {RISK} >= 0.9 THEN 'EMERGENCY' WHEN {RISK} >= 0.8 THEN 'CRITICAL'
       WHEN {RISK} >= 0.7 THEN 'WARNING' ELSE 'NORMAL' END AS status
FROM readings r"""


@register("r1_r2_rule_risk", RULE_SQL,
          rounded=("temperature_risk", "vibration_risk", "pressure_risk", "risk_score"))
def r1_r2_rule_risk(spark, sf_dir):
    """Rule risk components, capped mean and rule level per reading."""
    return ru.rule_risk(v.readings(spark, sf_dir))


_ICON = _case("status", {k: f"{i} {k}" for k, i in ru.RULE_LEVEL_ICONS.items()})
R3_SQL = f"""WITH rr AS ({RULE_SQL}), ic AS (SELECT *, {_ICON} AS status_display FROM rr)
SELECT *, printf('SENSOR STATUS UPDATE | Timestamp: %s | Equipment: %s | Status: %s | Risk Score: %.4f | '
  || 'Temperature: %s | Vibration: %s | Pressure: %s | Label: %s | '
  || 'Temperature Risk: %.3f | Vibration Risk: %.3f | Pressure Risk: %.3f',
  {ISO.format(c='"timestamp"')}, sensor_id, status_display, {R('risk_score', 4)}, CAST(temperature AS VARCHAR),
  CAST(vibration AS VARCHAR), CAST(pressure AS VARCHAR), label, {R('temperature_risk', 3)}, {R('vibration_risk', 3)},
  {R('pressure_risk', 3)})
  AS report
FROM ic"""


@register("r3_status_report", R3_SQL, rounded=("temperature_risk", "vibration_risk", "pressure_risk", "risk_score"))
def r3_status_report(spark, sf_dir):
    """Status row with icon and formatted text per reading."""
    return ru.status_report(v.readings(spark, sf_dir))


@register("m11_combined_risk", BASE + SCORED + "\nSELECT * FROM scored",
          rounded=("failure_probability", "anomaly_score", "online_probability", "anomaly_risk", "risk_score"))
def m11_combined_risk(spark, sf_dir):
    """0.3 anomaly risk (batch min-max) + 0.5 failure + 0.2 online probability."""
    return scored(spark, sf_dir)


# ----------------------------------------------------------------- alerts
@register("a1_a2_build_alerts", BASE + SCORED + ALERTS + "\nSELECT * FROM alerts", rounded=A_DBL)
def a1_a2_build_alerts(spark, sf_dir):
    """Alert level, message and fields for every prediction."""
    return alerts(spark, sf_dir).drop("raw_data")


@register("a1_alerts_min_warning", BASE + SCORED + ALERTS + "\nSELECT * FROM alerts WHERE alert_level <> 'INFO'",
          rounded=A_DBL)
def a1_alerts_min_warning(spark, sf_dir):
    """Alerts at WARNING or above only."""
    return al.build_alerts(scored(spark, sf_dir), min_level="WARNING").drop("raw_data")


A6_SQL = BASE + SCORED + ALERTS + f"""
SELECT reading_id, sensor_id, alert_level, {_case('alert_level', al.LOG_SEVERITY)} AS log_severity,
  printf(chr(10) || repeat('=', 60) || chr(10) || 'ALERT: %s' || chr(10) || 'Time: %s' || chr(10) || 'Equipment: %s'
    || chr(10) || 'Message: %s' || chr(10) || 'Risk Score: %.4f' || chr(10) || 'Failure Probability: %.4f' || chr(10)
    || 'Anomaly Score: %.4f' || chr(10) || repeat('=', 60) || chr(10),
    alert_level, {ISO.format(c='"timestamp"')}, sensor_id, message, {R('risk_score', 4)}, {R('failure_probability', 4)},
    {R('anomaly_score', 4)})
  AS text
FROM alerts"""


@register("a6_console_text", A6_SQL)
def a6_console_text(spark, sf_dir):
    """Console block and log severity per alert."""
    return al.console_text(alerts(spark, sf_dir))


_F4 = "printf('%.4f', " + "{x}" + ")"
A4_SQL = BASE + SCORED + ALERTS + f"""
SELECT reading_id, sensor_id, alert_level,
  CAST(json_object('attachments', json_array(json_object(
    'color', {_case('alert_level', al.COLORS, al.DEFAULT_COLOR)},
    'title', 'Equipment Alert: ' || sensor_id,
    'text', message,
    'fields', json_array(
      json_object('title', 'Risk Score', 'value', printf('%.4f', {R('risk_score', 4)}), 'short', true),
      json_object('title', 'Failure Probability', 'value', printf('%.4f', {R('failure_probability', 4)}), 'short', true),
      json_object('title', 'Timestamp', 'value', {ISO.format(c='"timestamp"')}, 'short', false)),
    'footer', '{al.FOOTER}',
    'ts', (epoch_us("timestamp") // 1000000)))) AS VARCHAR) AS payload
FROM alerts"""
A5_SQL = BASE + SCORED + ALERTS + f"""
SELECT reading_id, sensor_id, alert_level,
  CAST(json_object('text', printf(chr(10) || '%s *Equipment Alert*' || chr(10) || chr(10) || '*Equipment:* %s' || chr(10)
    || '*Level:* %s' || chr(10) || '*Message:* %s' || chr(10) || chr(10) || '*Risk Score:* %.4f' || chr(10)
    || '*Failure Probability:* %.4f' || chr(10) || '*Anomaly Score:* %.4f' || chr(10) || chr(10) || '*Time:* %s'
    || chr(10), {_case('alert_level', al.ICONS, al.DEFAULT_ICON)}, sensor_id, alert_level, message,
    {R('risk_score', 4)}, {R('failure_probability', 4)}, {R('anomaly_score', 4)}, {ISO.format(c='"timestamp"')}),
    'parse_mode', 'Markdown') AS VARCHAR) AS payload
FROM alerts"""


@register("a4_chat_payload", A4_SQL)
def a4_chat_payload(spark, sf_dir):
    """Attachment-style chat payload JSON per alert (outbox rows)."""
    return al.chat_payload(alerts(spark, sf_dir))


@register("a5_markdown_payload", A5_SQL)
def a5_markdown_payload(spark, sf_dir):
    """Markdown text payload JSON per alert (outbox rows)."""
    return al.markdown_payload(alerts(spark, sf_dir))


A7_SQL = BASE + SCORED + ALERTS + """
SELECT a.*, c.channel FROM alerts a CROSS JOIN (VALUES ('console'), ('chat'), ('markdown')) c(channel)"""


@register("a7_route_channels", A7_SQL, rounded=A_DBL)
def a7_route_channels(spark, sf_dir):
    """One outbox row per alert and enabled channel."""
    return al.route(alerts(spark, sf_dir), ROUTE_CFG).drop("raw_data")


@register("g10_alert_stats", BASE + SCORED + ALERTS + """
SELECT coalesce(alert_level, 'TOTAL') AS alert_level, count(*) AS n FROM alerts GROUP BY ROLLUP (alert_level)""")
def g10_alert_stats(spark, sf_dir):
    """Alert count per level and in total."""
    return al.alert_stats(alerts(spark, sf_dir))


@register("g11_recent_alerts_count", BASE + SCORED + ALERTS + """
SELECT count(*) AS total_alerts,
  count_if("timestamp" > (SELECT max("timestamp") FROM alerts) - INTERVAL 1 HOUR) AS recent_alerts FROM alerts""")
def g11_recent_alerts_count(spark, sf_dir):
    """Alerts within the last hour before the newest alert."""
    return al.recent_alert_count(alerts(spark, sf_dir))


@register("t3_recent_alerts", BASE + SCORED + ALERTS + """
SELECT reading_id, "timestamp", sensor_id, alert_level, message, risk_score FROM alerts
ORDER BY "timestamp" DESC, reading_id DESC LIMIT 50""", rounded=("risk_score",))
def t3_recent_alerts(spark, sf_dir):
    """Last 50 alerts, report columns."""
    return al.recent_alerts(alerts(spark, sf_dir), 50)


@register("a8_retain_alerts", BASE + SCORED + ALERTS + """
SELECT * FROM alerts WHERE "timestamp" >= (SELECT max("timestamp") FROM alerts) - INTERVAL 7 DAY""", rounded=A_DBL)
def a8_retain_alerts(spark, sf_dir):
    """Alert history retained for the last 7 days before the newest alert."""
    a = alerts(spark, sf_dir).drop("raw_data")
    cut = a.agg((F.max("timestamp") - F.make_dt_interval(F.lit(7))).alias("_cut"))
    return al.retain(a.crossJoin(F.broadcast(cut)), F.col("_cut")).drop("_cut")


# ----------------------------------------------------------------- reports
@register("g1_label_distribution", f"WITH readings AS ({v.READINGS_SQL}) SELECT label, count(*) AS n FROM readings GROUP BY label")
def g1_label_distribution(spark, sf_dir):
    """Readings per label."""
    return rp.label_distribution(v.readings(spark, sf_dir))


@register("g2_g3_sensor_reading_counts", f"""WITH readings AS ({v.READINGS_SQL})
SELECT count(DISTINCT sensor_id) AS sensors, count(*) AS readings FROM readings""")
def g2_g3_sensor_reading_counts(spark, sf_dir):
    """Distinct sensors and reading count."""
    r = v.readings(spark, sf_dir)
    return rp.sensor_count(r).crossJoin(rp.reading_count(r))


@register("g9_overall_risk", BASE + SCORED + ",\n" + LATEST + "\nSELECT coalesce(avg(risk_score), 0.0) AS overall_risk FROM latest",
          rounded=("overall_risk",))
def g9_overall_risk(spark, sf_dir):
    """Mean risk over each sensor's latest prediction."""
    return rp.overall_risk(scored(spark, sf_dir))


@register("d1_kpis", BASE + SCORED + ALERTS + ",\n" + LATEST + """
SELECT (SELECT count(DISTINCT sensor_id) FROM scored) AS sensors, (SELECT count(*) FROM scored) AS readings,
       (SELECT coalesce(avg(risk_score), 0.0) FROM latest) AS average_risk,
       (SELECT count(*) FROM alerts) AS total_alerts""", rounded=("average_risk",))
def d1_kpis(spark, sf_dir):
    """KPI row: sensors, readings, average latest risk, total alerts."""
    s = scored(spark, sf_dir)
    return rp.kpis(s, al.build_alerts(s))


@register("d2_risk_gauge", BASE + SCORED + ",\n" + LATEST + """,
o AS (SELECT coalesce(avg(risk_score), 0.0) * 100 AS gauge_value FROM latest)
SELECT gauge_value, CASE WHEN gauge_value < 50 THEN 'low' WHEN gauge_value < 70.0 THEN 'elevated' ELSE 'high' END AS band,
  CASE WHEN gauge_value < 50 THEN 'lightgray' WHEN gauge_value < 70.0 THEN 'yellow' ELSE 'red' END AS band_color,
  gauge_value - 70.0 AS delta FROM o""", rounded=("gauge_value", "delta"))
def d2_risk_gauge(spark, sf_dir):
    """Gauge value, band and delta to 70 for the overall risk."""
    return rp.gauge(rp.overall_risk(scored(spark, sf_dir)))


@register("d3_source_freshness", f"""WITH readings AS ({v.READINGS_SQL}),
per AS (SELECT sensor_id, max("timestamp") AS last_seen, count(*) AS readings FROM readings GROUP BY sensor_id),
ref AS (SELECT max("timestamp") AS as_of FROM readings)
SELECT sensor_id, last_seen, readings, (epoch_us(as_of) - epoch_us(last_seen)) // 1000000 AS lag_seconds,
       (epoch_us(as_of) - epoch_us(last_seen)) // 1000000 > 3600 AS stale
FROM per CROSS JOIN ref""")
def d3_source_freshness(spark, sf_dir):
    """Last reading, lag to the newest reading and stale flag per sensor."""
    return rp.freshness(v.readings(spark, sf_dir))


_STATUS = """CASE WHEN coalesce(is_failure, false) OR coalesce(risk_score, 0) >= 0.9 THEN 'CRITICAL'
  WHEN coalesce(risk_score, 0) >= 0.7 THEN 'WARNING' WHEN coalesce(is_anomaly, false) THEN 'ANOMALY' ELSE 'NORMAL' END"""
_SICON = _case("status", {k: f"{i} {k}" for k, i in rp.STATUS_ICONS.items()})


@register("d5_equipment_status", BASE + SCORED + ",\n" + LATEST + f""",
st AS (SELECT sensor_id, "timestamp", risk_score, failure_probability, is_failure, is_anomaly, temperature, vibration,
  pressure, {_STATUS} AS status FROM latest)
SELECT *, {_SICON} AS status_display, printf('%.3f', {R('risk_score', 3)}) AS risk_text,
  printf('%.3f', {R('failure_probability', 3)}) AS failure_text, printf('%.1f', {R('temperature', 1)}) AS temperature_text,
  printf('%.2f', {R('vibration', 2)}) AS vibration_text, printf('%.2f', {R('pressure', 2)}) AS pressure_text FROM st""",
          rounded=("risk_score", "failure_probability"))
def d5_equipment_status(spark, sf_dir):
    """Status card data per sensor at its latest prediction."""
    return rp.equipment_status(scored(spark, sf_dir))


@register("i6_latest_readings", f"""WITH readings AS ({v.READINGS_SQL})
SELECT * FROM readings ORDER BY "timestamp" DESC, reading_id DESC LIMIT 100""")
def i6_latest_readings(spark, sf_dir):
    """Newest 100 readings."""
    return rp.latest_readings(v.readings(spark, sf_dir), 100)


@register("i7_sensor_history", f"""WITH readings AS ({v.READINGS_SQL})
SELECT * FROM readings WHERE sensor_id = 'sensor_001'
  AND "timestamp" >= (SELECT max("timestamp") FROM readings) - INTERVAL 72 HOUR
  AND "timestamp" <= (SELECT max("timestamp") FROM readings)""")
def i7_sensor_history(spark, sf_dir):
    """sensor_001 history over the 72 hours before the newest reading."""
    r = v.readings(spark, sf_dir)
    as_of = r.agg(F.max("timestamp")).first()[0]  # a literal, so that both time bounds reach the scan
    return rp.sensor_history(r, "sensor_001", as_of, 72)


CLUSTERED_ROWS = 1_000  # rows per file of the clustered table: small, so that a small table has files to skip


def clustered(spark, sf_dir):
    """The readings written along the Z-curve (I1); the folder of the table."""
    path = folder(spark, "clustered")
    layout.write_clustered(v.readings(spark, sf_dir), path, CLUSTERED_ROWS)
    return path


@register("i1_clustered_history", f"""WITH readings AS ({v.READINGS_SQL})
SELECT * FROM readings WHERE sensor_id = 'sensor_001'
  AND "timestamp" >= (SELECT max("timestamp") FROM readings) - INTERVAL 72 HOUR
  AND "timestamp" <= (SELECT max("timestamp") FROM readings)""")
def i1_clustered_history(spark, sf_dir):
    """sensor_001's last 72 hours (I7) from the written Z-ordered table, opening only files that can hold them."""
    path = clustered(spark, sf_dir)
    last = layout.clustered_index(spark, path).agg(F.max("time_hi")).first()[0]
    return layout.read_clustered(spark, path, "sensor_001", str(last - datetime.timedelta(hours=72)), str(last))


@register("i1_clustered_newest", f"""WITH readings AS ({v.READINGS_SQL})
SELECT * FROM readings ORDER BY "timestamp" DESC, reading_id DESC LIMIT 100""")
def i1_clustered_newest(spark, sf_dir):
    """Newest 100 readings (I6) from the written table, without files of older rows."""
    return layout.newest(spark, clustered(spark, sf_dir), 100)


@register("i1_clustered_sensor", f"WITH readings AS ({v.READINGS_SQL}) SELECT * FROM readings WHERE sensor_id = 'sensor_007'")
def i1_clustered_sensor(spark, sf_dir):
    """All readings of one sensor (P12) from the written table."""
    return layout.read_clustered(spark, clustered(spark, sf_dir), "sensor_007")


@register("t4_sensor_trends", f"""WITH readings AS ({v.READINGS_SQL}),
last AS (SELECT reading_id, "timestamp", sensor_id, temperature, vibration, pressure FROM readings
         ORDER BY "timestamp" DESC, reading_id DESC LIMIT 100)
UNPIVOT last ON temperature, vibration, pressure INTO NAME channel VALUE value""")
def t4_sensor_trends(spark, sf_dir):
    """Last 100 readings as a long (timestamp, channel, value) series."""
    return rp.trends(v.readings(spark, sf_dir), 100)


@register("p12_filter_sensor", f"WITH readings AS ({v.READINGS_SQL}) SELECT * FROM readings WHERE sensor_id = 'sensor_007'")
def p12_filter_sensor(spark, sf_dir):
    """All readings of one sensor."""
    return rp.for_sensor(v.readings(spark, sf_dir), "sensor_007")


THR_SQL = """SELECT printf('sensor_%03d', c_custkey) AS sensor_id, 0.6 + (c_custkey % 4) * 0.05 AS failure_threshold
FROM customer WHERE c_custkey % 10 <> 3"""


def sensor_thresholds(spark, sf_dir):
    """Per-sensor failure thresholds derived from the customer table (known sensors)."""
    c = v.table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 10 != 3)
    return c.select(v.sensor_name("c_custkey").alias("sensor_id"),
                    (F.lit(0.6) + (F.col("c_custkey") % 4) * F.lit(0.05)).alias("failure_threshold"))


@register("p4_sensor_thresholds", BASE + SCORED + f""",
thr AS ({THR_SQL}),
lv AS (SELECT s.*, CASE WHEN coalesce(risk_score, 0) >= 0.9 OR coalesce(failure_probability, 0) >= 0.9
               OR coalesce(is_failure, false) THEN 'EMERGENCY'
          WHEN coalesce(risk_score, 0) >= 0.8 OR coalesce(failure_probability, 0) >= 0.8 THEN 'CRITICAL'
          WHEN coalesce(risk_score, 0) >= coalesce(t.failure_threshold, 0.7)
               OR coalesce(failure_probability, 0) >= coalesce(t.failure_threshold, 0.7)
               OR coalesce(is_anomaly, false) THEN 'WARNING'
          ELSE 'INFO' END AS alert_level
  FROM scored s LEFT JOIN thr t ON s.sensor_id = t.sensor_id)
SELECT reading_id, sensor_id, alert_level FROM lv""")
def p4_sensor_thresholds(spark, sf_dir):
    """Alert levels with per-sensor failure thresholds (default 0.7 where none)."""
    s = al.with_thresholds(scored(spark, sf_dir), sensor_thresholds(spark, sf_dir))
    return al.build_alerts(s).select("reading_id", "sensor_id", "alert_level")


_STORE_COLS = ("reading_id", "timestamp", "sensor_id", "alert_level", "risk_score", "failure_probability", "anomaly_score", "is_failure", "is_anomaly")
_STORE_SQL = BASE + SCORED + ALERTS + """
SELECT reading_id, "timestamp", sensor_id, alert_level, risk_score, failure_probability, anomaly_score, is_failure, is_anomaly FROM alerts"""
_BATCHES = 3


def _alert_store(spark, sf_dir, times=1):
    """A table of all alerts, appended in batches by reading id; every batch ``times`` times."""
    store = AlertStore(spark, folder(spark, "alerts"))
    a = stored(alerts(spark, sf_dir).select(*_STORE_COLS), "alerts")
    for b in range(_BATCHES):
        for _ in range(times):
            store.append(a.filter(F.col("reading_id") % _BATCHES == b), f"b{b}")
    return store


@register("i10_alert_table", _STORE_SQL, rounded=A_DBL)
def i10_alert_table(spark, sf_dir):
    """The stored alert table after three batches, each appended twice: every alert once."""
    return _alert_store(spark, sf_dir, times=2).read().select(*_STORE_COLS)


@register("a3_running_total", BASE + SCORED + ALERTS + f""", b AS (SELECT reading_id % {_BATCHES} AS b, count(*) AS stored FROM alerts GROUP BY 1)
SELECT 'b' || b AS batch_id, stored, CAST(sum(stored) OVER (ORDER BY b) AS BIGINT) AS total FROM b""")
def a3_running_total(spark, sf_dir):
    """Predictions to alerts to table, batch by batch: what each added and the running total, kept in the commits."""
    store = AlertStore(spark, folder(spark, "alerts"))
    s, rows, before = stored(scored(spark, sf_dir), "scored"), [], 0
    for b in range(_BATCHES):
        total = store.process(s.filter(F.col("reading_id") % _BATCHES == b), f"b{b}")
        rows.append((f"b{b}", total - before, total))
        before = total
    return spark.createDataFrame(rows, "batch_id string, stored long, total long")


@register("a8_retained_table", _STORE_SQL + " WHERE \"timestamp\" >= TIMESTAMP '2024-01-16 12:00:00'", rounded=A_DBL)
def a8_retained_table(spark, sf_dir):
    """The stored alert table after retention: dates before the cutoff dropped, the cutoff's date rewritten, later files kept."""
    store = _alert_store(spark, sf_dir)
    store.retain("2024-01-16 12:00:00")
    return store.read().select(*_STORE_COLS)


@register("s5_alert_stats_hourly", BASE + SCORED + ALERTS + """
SELECT date_trunc('hour', "timestamp") AS window_start, date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS window_end,
       alert_level, count(*) AS n
FROM alerts GROUP BY 1, 2, 3""")
def s5_alert_stats_hourly(spark, sf_dir):
    """Alerts per level per hourly event-time window (batch form of the streaming statistics)."""
    return al.alert_stats_by_window(alerts(spark, sf_dir), "1 hour")
