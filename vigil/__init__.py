"""vigil: sensor-telemetry risk analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames (or Column lists) so the same
code serves historical tables and Structured Streaming micro-batches.
"""

from vigil.config import AlertConfig, Channels, FeatureConfig, RiskWeights

__all__ = ["AlertConfig", "Channels", "FeatureConfig", "RiskWeights"]
