"""Per-sensor time-series window specs and feature column builders.

All frames are row-count frames with ``min_periods=1`` semantics: aggregates
skip NULLs, a one-row std is NULL. Every builder returns a list of aliased
Columns so a caller emits all features in ONE select (one Exchange + one Sort
for the whole family, instead of one per ``withColumn``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from vigil.functions.core import bool_int, safe_div

CARRY = "_carry_"  # last non-null value of a channel before the current chunk
FIRST = "_first_"  # first non-null value of a channel in the whole sensor


@dataclass(frozen=True)
class Series:
    """How rows form one ordered series: partition keys and a unique order."""

    key: tuple[str, ...] = ("sensor_id",)
    order: tuple[str, ...] = ("timestamp", "reading_id")
    chunk: str | None = None  # extra partition column from the skew-safe plan
    carry: bool = False  # carry-in columns (CARRY/FIRST + channel) are present

    def chunked(self, chunk: str) -> "Series":
        return replace(self, chunk=chunk, carry=True)

    @property
    def parts(self) -> list[str]:
        return list(self.key) + ([self.chunk] if self.chunk else [])

    def window(self):
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def rows(self, n: int):
        return self.window().rowsBetween(-(n - 1), Window.currentRow)

    def upto(self):
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def before(self):
        return self.window().rowsBetween(Window.unboundedPreceding, -1)

    def whole(self):
        return self.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def carry_col(self, c: str) -> Column:
        return F.col(CARRY + c) if self.carry else F.lit(None).cast("double")

    def first_col(self, c: str) -> Column:
        return F.col(FIRST + c) if self.carry else F.lit(None).cast("double")


class Pool(dict):
    """Window expressions that several features share: each is computed once under its name.

    Builders hand their windows to the pool and get plain column references;
    the caller selects ``columns()`` first and the features from them.
    """

    def __call__(self, name: str, expr: Column) -> Column:
        self.setdefault(name, expr)
        return F.col(name)

    def columns(self) -> list[Column]:
        return [expr.alias(name) for name, expr in self.items()]


def _own(name: str, expr: Column) -> Column:
    """Without a pool every feature carries its own windows."""
    return expr


# ---------------------------------------------------------------- fills
def forward_fill(c: str, s: Series) -> Column:
    """Last non-null value up to this row, else the value carried into the chunk."""
    return F.coalesce(F.last(F.col(c), ignorenulls=True).over(s.upto()), s.carry_col(c))


def back_fill_leading(c: str, s: Series) -> Column:
    """After a forward fill only leading NULLs remain: first non-null of the series."""
    return F.coalesce(F.first(F.col(c), ignorenulls=True).over(s.whole()), s.first_col(c))


# ---------------------------------------------------------------- rolling
def _mean(c: str, w: int, s: Series, pool) -> Column:
    return pool(f"_w_{c}_mean_{w}", F.avg(c).over(s.rows(w)))


def _std(c: str, w: int, s: Series, pool) -> Column:
    return pool(f"_w_{c}_std_{w}", F.stddev_samp(c).over(s.rows(w)))


def _lag(c: str, k: int, s: Series, pool) -> Column:
    return pool(f"_w_{c}_lag_{k}", F.lag(F.col(c), k).over(s.window()))


def rolling(c: str, windows, s: Series, pool=_own) -> list[Column]:
    out = []
    for w in windows:
        fr = s.rows(w)
        mn, mx = pool(f"_w_{c}_min_{w}", F.min(c).over(fr)), pool(f"_w_{c}_max_{w}", F.max(c).over(fr))
        out += [
            _mean(c, w, s, pool).alias(f"{c}_rolling_mean_{w}"),
            _std(c, w, s, pool).alias(f"{c}_rolling_std_{w}"),
            mn.alias(f"{c}_rolling_min_{w}"),
            mx.alias(f"{c}_rolling_max_{w}"),
            (mx - mn).alias(f"{c}_rolling_range_{w}"),
        ]
    return out


# ---------------------------------------------------------------- change
def pct_change(c: str, s: Series, pool=_own) -> Column:
    """pandas pct_change (pad first): p/q - 1 over last non-null values, 0 divisor -> NULL."""
    p = F.coalesce(pool(f"_w_{c}_last", F.last(F.col(c), ignorenulls=True).over(s.upto())), s.carry_col(c))
    q = F.coalesce(pool(f"_w_{c}_before", F.last(F.col(c), ignorenulls=True).over(s.before())), s.carry_col(c))
    return safe_div(p - q, q)


def change(c: str, s: Series, pool=_own) -> list[Column]:
    x = F.col(c)
    l1, l2 = _lag(c, 1, s, pool), _lag(c, 2, s, pool)
    return [
        (x - l1).alias(f"{c}_rate_of_change"),
        pct_change(c, s, pool).alias(f"{c}_rate_of_change_pct"),
        ((x - l1) - (l1 - l2)).alias(f"{c}_acceleration"),
    ]


# ---------------------------------------------------------------- spikes
def z_score(c: str, s: Series, window: int = 10, eps: float = 1e-8, pool=_own) -> Column:
    return (F.col(c) - _mean(c, window, s, pool)) / (_std(c, window, s, pool) + F.lit(eps))


def spikes(c: str, s: Series, window: int = 10, eps: float = 1e-8, cut: float = 2.0, pool=_own) -> list[Column]:
    z = z_score(c, s, window, eps, pool)
    return [
        z.alias(f"{c}_z_score"),
        bool_int(F.abs(z) > F.lit(cut)).alias(f"{c}_spike"),
        F.abs(z).alias(f"{c}_spike_magnitude"),
    ]


# ---------------------------------------------------------------- lags
def lags(c: str, ks, s: Series, pool=_own) -> list[Column]:
    return [_lag(c, k, s, pool).alias(f"{c}_lag_{k}") for k in ks]


# ---------------------------------------------------------------- interactions
INTERACTIONS = (
    ("temperature", "vibration", "temp_vib_interaction"),
    ("temperature", "pressure", "temp_pressure_interaction"),
    ("vibration", "pressure", "vib_pressure_interaction"),
)


def interactions(channels) -> list[Column]:
    have = set(channels)
    return [(F.col(a) * F.col(b)).alias(n) for a, b, n in INTERACTIONS if a in have and b in have]


def min_max_norm(c: str, lo: Column, hi: Column, eps: float = 1e-8) -> Column:
    return (F.col(c) - lo) / (hi - lo + F.lit(eps))


def health_score(lo: dict, hi: dict, eps: float = 1e-8, temperature_sign: int = 1) -> Column:
    """(temp_norm + (1 - vib_norm) + pressure_norm) / 3 over global min/max columns."""
    t = min_max_norm("temperature", lo["temperature"], hi["temperature"], eps)
    if temperature_sign < 0:
        t = F.lit(1.0) - t
    v = min_max_norm("vibration", lo["vibration"], hi["vibration"], eps)
    p = min_max_norm("pressure", lo["pressure"], hi["pressure"], eps)
    return ((t + (F.lit(1.0) - v) + p) / F.lit(3.0)).alias("combined_health_score")
