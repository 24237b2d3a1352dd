"""Rule-based risk without models (R1-R3) and the combined model risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.config import EPS, RiskWeights
from vigil.functions.core import iso_ts

# Fixed values of the rule risk: temperature (t - 30) / 60, vibration
# (v - 1) / 5, pressure (5 - p) / 5, each floored at 0, mean capped at 1;
# levels EMERGENCY >= 0.9, CRITICAL >= 0.8, WARNING >= 0.7, else NORMAL.
RULE_LEVEL_ICONS = {"EMERGENCY": "🚨", "CRITICAL": "⚠️", "WARNING": "⚠️", "NORMAL": "✅"}


def rule_components() -> list[Column]:
    return [
        F.greatest(F.lit(0.0), (F.col("temperature") - 30) / 60).alias("temperature_risk"),
        F.greatest(F.lit(0.0), (F.col("vibration") - 1) / 5).alias("vibration_risk"),
        F.greatest(F.lit(0.0), (F.lit(5.0) - F.col("pressure")) / 5).alias("pressure_risk"),
    ]


def rule_risk_expr() -> Column:
    t, v, p = (c for c in rule_components())
    return F.least(F.lit(1.0), (t + v + p) / 3)


def rule_level(risk: Column) -> Column:
    return (
        F.when(risk >= 0.9, "EMERGENCY").when(risk >= 0.8, "CRITICAL").when(risk >= 0.7, "WARNING").otherwise("NORMAL")
    )


def rule_risk(df: DataFrame) -> DataFrame:
    """R1 + R2: components, capped mean risk and its level."""
    risk = rule_risk_expr()
    return df.select(*df.columns, *rule_components(), risk.alias("risk_score"), rule_level(risk).alias("status"))


def status_report(df: DataFrame) -> DataFrame:
    """One status row per reading: level with icon and a formatted text block."""
    r = rule_risk(df)
    icon = F.coalesce(*[F.when(F.col("status") == k, F.lit(f"{v} {k}")) for k, v in RULE_LEVEL_ICONS.items()])
    text = F.format_string(
        "SENSOR STATUS UPDATE | Timestamp: %s | Equipment: %s | Status: %s | Risk Score: %.4f | "
        "Temperature: %s | Vibration: %s | Pressure: %s | Label: %s | "
        "Temperature Risk: %.3f | Vibration Risk: %.3f | Pressure Risk: %.3f",
        iso_ts("timestamp"), F.col("sensor_id"), icon, F.col("risk_score"),
        F.col("temperature").cast("string"), F.col("vibration").cast("string"), F.col("pressure").cast("string"),
        F.col("label"), F.col("temperature_risk"), F.col("vibration_risk"), F.col("pressure_risk"),
    )
    return r.select(*r.columns, icon.alias("status_display"), text.alias("report"))


# ------------------------------------------------------------------ M11
def anomaly_risk(score: Column, lo: Column, hi: Column, eps: float = EPS) -> Column:
    """1 - min-max normalized decision score: low (anomalous) score -> high risk."""
    return F.lit(1.0) - (score - lo) / (hi - lo + F.lit(eps))


def combine_risk(
    df: DataFrame,
    weights: RiskWeights = RiskWeights(),
    scope: str = "batch",
    fixed: tuple[float, float] | DataFrame | None = None,
) -> DataFrame:
    """risk = w_a * anomaly_risk + w_f * failure_probability + w_o * online_probability.

    scope ``batch`` normalizes the anomaly score by the min/max of this frame
    (the reference's formula, one-row aggregate + broadcast); ``fixed`` uses
    (min, max) stored at fit time, which streaming micro-batches need.
    """
    if scope == "fixed":
        if isinstance(fixed, DataFrame):
            j = df.crossJoin(F.broadcast(fixed.select(F.col("score_min").alias("_lo"), F.col("score_max").alias("_hi"))))
        else:
            lo, hi = fixed
            j = df.select("*", F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"))
    else:
        mm = df.agg(F.min("anomaly_score").alias("_lo"), F.max("anomaly_score").alias("_hi"))
        j = df.crossJoin(F.broadcast(mm))
    # clipped to [0, 1]: a no-op for batch scope, needed when fixed (fit-time) bounds
    # meet scores outside the training range
    ar = F.least(F.lit(1.0), F.greatest(F.lit(0.0), anomaly_risk(F.col("anomaly_score"), F.col("_lo"), F.col("_hi"))))
    risk = (
        F.lit(weights.anomaly) * ar
        + F.lit(weights.failure) * F.col("failure_probability")
        + F.lit(weights.online) * F.col("online_probability")
    )
    return j.select(*df.columns, ar.alias("anomaly_risk"), risk.alias("risk_score"), F.lit(scope).alias("risk_scope"))
