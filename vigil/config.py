"""Configuration as frozen dataclasses passed to operators as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the reference's behaviour:
# channels temperature, vibration, pressure; rolling windows 5, 10, 20;
# lags 1, 2, 3, 5; z-score window 10 with epsilon 1e-8 and spike cut 2;
# min-max epsilon 1e-8; IQR factor 1.5; risk weights anomaly 0.3,
# failure 0.5, online 0.2; failure threshold 0.7; anomaly threshold -0.1;
# alert cut-offs 0.9 (EMERGENCY) and 0.8 (CRITICAL).
CHANNELS = ("temperature", "vibration", "pressure")
ROLLING_WINDOWS = (5, 10, 20)
LAGS = (1, 2, 3, 5)
Z_WINDOW = 10
EPS = 1e-8
SPIKE_Z = 2.0
IQR_K = 1.5


@dataclass(frozen=True)
class Channels:
    names: tuple[str, ...] = CHANNELS


@dataclass(frozen=True)
class FeatureConfig:
    channels: tuple[str, ...] = CHANNELS
    windows: tuple[int, ...] = ROLLING_WINDOWS
    lags: tuple[int, ...] = LAGS
    z_window: int = Z_WINDOW
    spike_z: float = SPIKE_Z
    eps: float = EPS
    # Sign of temperature inside the health score: +1 follows the reference
    # (score rises with temperature), -1 inverts it.
    temperature_sign: int = 1

    @property
    def history(self) -> int:
        """Rows of history a new row needs for every feature (rolling/lag/accel)."""
        return max(max(self.windows) - 1, max(self.lags), self.z_window - 1, 2)


@dataclass(frozen=True)
class RiskWeights:
    anomaly: float = 0.3
    failure: float = 0.5
    online: float = 0.2


@dataclass(frozen=True)
class AlertConfig:
    failure_threshold: float = 0.7
    anomaly_threshold: float = -0.1
    emergency: float = 0.9
    critical: float = 0.8
    console_enabled: bool = True
    webhook_enabled: bool = False
    chat_enabled: bool = False  # attachment-style chat webhook payload (A4)
    markdown_enabled: bool = False  # markdown-text chat payload (A5)
    channels: tuple[str, ...] = field(default=())

    def enabled_channels(self) -> list[str]:
        out = ["console"] if self.console_enabled else []
        if self.webhook_enabled:
            if self.chat_enabled:
                out.append("chat")
            if self.markdown_enabled:
                out.append("markdown")
        return out + [c for c in self.channels if c not in out]
