"""Cleaning operators P1-P3, C1-C12.

Order (Q13): coerce first (timestamp text -> TIMESTAMP_NTZ, numbers via
try_cast, NaN -> NULL), then fill per sensor (forward, leading backward, global
median), then IQR clipping with global quartiles, then optional standard
scaling. Every statistic is a one-row aggregate joined back by broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.config import CHANNELS, IQR_K
from vigil.functions import series as fs
from vigil.functions.core import clip, nan_to_null, safe_div, to_double
from vigil.functions.series import Series
from vigil.functions.stats import exact_quantiles, moments, quantile_exprs
from vigil.plans.chunking import CHUNK, DEFAULT_CHUNK_ROWS, HALO, finish, plan_chunks
from vigil.session import stored


def channels_in(df: DataFrame, channels=CHANNELS) -> list[str]:
    return [c for c in channels if c in df.columns]


# ------------------------------------------------------------------ P1-P3
def parse_timestamp(c: str = "timestamp") -> F.Column:
    """ISO text or timestamp -> TIMESTAMP_NTZ; unparsable -> NULL."""
    return F.coalesce(
        F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz"),
        F.col(c).cast("string").try_cast("timestamp_ntz"),
    )


def coerce(df: DataFrame, channels=CHANNELS, ts: str = "timestamp") -> DataFrame:
    """P1 + P2: typed timestamp and numeric channels, bad values become NULL."""
    ch = set(channels_in(df, channels))
    cols = []
    for name, typ in df.dtypes:
        if name in ch:
            c = nan_to_null(F.col(name)) if typ == "double" else to_double(name)
            cols.append(c.alias(name))
        elif name == ts and typ != "timestamp_ntz":
            cols.append(parse_timestamp(name).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def schema_report(df: DataFrame, required=CHANNELS, raw: DataFrame | None = None) -> DataFrame:
    """Per required column, rows, NULLs and values that failed coercion.

    Raises ValueError when a required column is missing (the reference returns
    an empty frame). ``raw`` is the input before ``coerce`` for failure counts.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    src = raw if raw is not None else df
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in required:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
        bad = F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()
        aggs.append(F.count_if(bad).alias(f"bad_{c}"))
    return src.agg(*aggs)


# ------------------------------------------------------------------ C1-C4
def fill_missing(
    df: DataFrame,
    channels=CHANNELS,
    series: Series = Series(),
    chunk_rows: int | None = DEFAULT_CHUNK_ROWS,
    median: bool = True,
    fixed: DataFrame | None = None,
    materialize: bool = False,
) -> DataFrame:
    """C4: forward fill, then leading backward fill per sensor, then global median.

    The median is taken over the forward/backward-filled column (as the
    reference computes it after the first two steps); it only fills sensors
    whose channel is NULL throughout. ``fixed`` supplies medians stored at fit
    time (columns ``median_<c>``) for streaming use. ``materialize`` writes the
    filled rows once to the shared checkpoint folder, so later statistics
    passes (median here, quartiles in ``clean``) scan columns of that table
    instead of recomputing the windows.
    """
    ch = channels_in(df, channels)
    if not ch:
        return df
    x, s = plan_chunks(df, series, 1, chunk_rows, carry_channels=ch)
    plan_cols = [c for c in x.columns if c in (CHUNK, HALO) or c.startswith(fs.CARRY) or c.startswith(fs.FIRST)]
    filled = x.select(
        *[
            F.coalesce(fs.forward_fill(c, s), fs.back_fill_leading(c, s)).alias(c) if c in ch else F.col(c)
            for c in df.columns
        ],
        *plan_cols,
    )
    filled = finish(filled, s)
    if materialize:
        filled = stored(filled)
    if not median:
        return filled
    if fixed is not None:
        med = fixed
    else:
        # the median step only changes sensors whose channel is NULL throughout:
        # one cheap partial aggregate decides whether the median pass is needed at all
        key = list(series.key)
        per = df.groupBy(*key).agg(*[F.count(F.col(c)).alias(c) for c in ch])
        empty = per.agg(*[F.count_if(F.col(c) == 0).alias(c) for c in ch]).first()
        need = [c for c in ch if empty[c]]
        if not need:
            return filled
        q = exact_quantiles(filled, {c: [0.5] for c in need})
        spark = df.sparkSession
        med = spark.createDataFrame([tuple(q[(c, 0.5)] for c in need)],
                                    ", ".join(f"median_{c} double" for c in need))
        ch = need
    return filled.crossJoin(F.broadcast(med)).select(
        *[F.coalesce(F.col(c), F.col(f"median_{c}")).alias(c) if c in ch else F.col(c) for c in df.columns]
    )


# ------------------------------------------------------------------ C5-C7
def iqr_bounds(df: DataFrame, channels=CHANNELS, k: float = IQR_K, method: str = "exact", by=None) -> DataFrame:
    """Q1, Q3 and bounds Q1 - k*IQR, Q3 + k*IQR per channel (one row, or per ``by``).

    method ``exact`` (default): linear-interpolation quartiles (equal to pandas)
    found by batched bracket refinement, each pass a partial aggregation, memory
    bounded regardless of cardinality; returns a literal one-row table.
    ``percentile``: Spark's exact aggregate (merges every distinct value in one
    final task: only for low-cardinality columns). ``approx``:
    ``percentile_approx``. Per-group bounds (``by``) need one of the other two
    methods: an exact per-group search would be a driver loop over groups.
    """
    ch = channels_in(df, channels)
    if method == "exact":
        if by:
            raise ValueError("exact bounds are global; use method='approx' or 'percentile' with by=")
        q = exact_quantiles(df, {c: [0.25, 0.75] for c in ch})
        row = {}
        for c in ch:
            row.update(_bounds_row(c, q[(c, 0.25)], q[(c, 0.75)], k))
        schema = ", ".join(f"{n} double" for n in row)
        return df.sparkSession.createDataFrame([tuple(row.values())], schema)
    aggs = []
    for c in ch:
        q1, q3 = quantile_exprs(c, [0.25, 0.75], exact=method == "percentile")
        aggs += [q1.alias(f"q1_{c}"), q3.alias(f"q3_{c}")]
    st = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    out = []
    for c in ch:
        iqr = F.col(f"q3_{c}") - F.col(f"q1_{c}")
        out += [
            F.col(f"q1_{c}").cast("double").alias(f"q1_{c}"),
            F.col(f"q3_{c}").cast("double").alias(f"q3_{c}"),
            (F.col(f"q1_{c}") - F.lit(k) * iqr).cast("double").alias(f"lower_{c}"),
            (F.col(f"q3_{c}") + F.lit(k) * iqr).cast("double").alias(f"upper_{c}"),
        ]
    return st.select(*(by or []), *out)


def _bounds_row(c, q1, q3, k):
    if q1 is None:
        return {f"q1_{c}": None, f"q3_{c}": None, f"lower_{c}": None, f"upper_{c}": None}
    iqr = q3 - q1
    return {f"q1_{c}": float(q1), f"q3_{c}": float(q3), f"lower_{c}": float(q1 - k * iqr),
            f"upper_{c}": float(q3 + k * iqr)}


def _with_stats(df: DataFrame, stats: DataFrame, by=None, broadcast_rows: int = 2_000_000) -> DataFrame:
    """One-row statistics: broadcast cross join. Per-group statistics: broadcast
    only after checking the group count, else a shuffle join."""
    if by:
        n = stats.count()
        return df.join(F.broadcast(stats) if n <= broadcast_rows else stats, list(by), "left")
    return df.crossJoin(F.broadcast(stats))


def clip_outliers(df: DataFrame, bounds: DataFrame, channels=CHANNELS, by=None) -> DataFrame:
    """Clip each channel into its bounds; NULL stays NULL."""
    ch = channels_in(df, channels)
    j = _with_stats(df, bounds, by)
    return j.select(
        *[clip(c, F.col(f"lower_{c}"), F.col(f"upper_{c}")).alias(c) if c in ch else F.col(c) for c in df.columns]
    )


def count_outliers(df: DataFrame, bounds: DataFrame, channels=CHANNELS) -> DataFrame:
    """Rows outside the bounds per channel (one row)."""
    ch = channels_in(df, channels)
    j = _with_stats(df, bounds)
    return j.agg(
        *[
            F.count_if((F.col(c) < F.col(f"lower_{c}")) | (F.col(c) > F.col(f"upper_{c}"))).alias(f"outliers_{c}")
            for c in ch
        ]
    )


# ------------------------------------------------------------------ C8, C9
def fit_scaler(df: DataFrame, channels=CHANNELS) -> DataFrame:
    """Mean and population std per channel (one persistable row)."""
    return moments(df, channels_in(df, channels))


def apply_scaler(df: DataFrame, stats: DataFrame, channels=CHANNELS) -> DataFrame:
    """(x - mean) / std, constant column -> 0 (Q16), NULL stays NULL."""
    ch = channels_in(df, channels)
    j = df.crossJoin(F.broadcast(stats))

    def z(c):
        zc = F.coalesce(safe_div(F.col(c) - F.col(f"mean_{c}"), F.col(f"std_{c}")), F.lit(0.0))
        return F.when(F.col(c).isNotNull(), zc)

    return j.select(*[z(c).alias(c) if c in ch else F.col(c) for c in df.columns])


def normalize(df: DataFrame, channels=CHANNELS, stats: DataFrame | None = None) -> DataFrame:
    """Fit on own data unless statistics are given, then apply."""
    return apply_scaler(df, stats if stats is not None else fit_scaler(df, channels), channels)


# ------------------------------------------------------------------ C10-C12
def clean(
    df: DataFrame,
    channels=CHANNELS,
    series: Series = Series(),
    chunk_rows: int | None = DEFAULT_CHUNK_ROWS,
    quantiles: str = "exact",
    materialize: bool = True,
) -> DataFrame:
    """Coerce, fill (C4), clip to IQR bounds computed on the filled data.

    The filled table is written once to the shared checkpoint folder (columnar
    parquet), so the quartile passes scan three columns of it instead of
    recomputing the per-sensor windows, and a lost executor re-reads files
    rather than replaying the shuffle.
    """
    x = fill_missing(coerce(df, channels), channels, series, chunk_rows, materialize=materialize)
    return clip_outliers(x, iqr_bounds(x, channels, method=quantiles), channels)


@dataclass
class CleaningStats:
    """What cleaning and the health score learn from a table, per channel; None where a channel has no value."""

    medians: dict
    bounds: dict  # channel -> (lower, upper)
    min_max: dict  # channel -> (min, max) of the cleaned table

    def medians_frame(self, spark) -> DataFrame:
        return _one_row(spark, {f"median_{c}": m for c, m in self.medians.items()})

    def bounds_frame(self, spark) -> DataFrame:
        return _one_row(spark, {f"{k}_{c}": b[i] for c, b in self.bounds.items() for i, k in enumerate(("lower", "upper"))})

    def min_max_frame(self, spark) -> DataFrame:
        return _one_row(spark, {f"_{k}_{c}": b[i] for c, b in self.min_max.items() for i, k in enumerate(("min", "max"))})

    def to_dict(self) -> dict:
        return {"medians": self.medians, "bounds": {c: list(b) for c, b in self.bounds.items()},
                "min_max": {c: list(b) for c, b in self.min_max.items()}}

    @staticmethod
    def from_dict(d: dict) -> "CleaningStats":
        return CleaningStats(d["medians"], {c: tuple(b) for c, b in d["bounds"].items()},
                             {c: tuple(b) for c, b in d["min_max"].items()})


def _one_row(spark, values: dict) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} double" for n in values))


def fit_cleaning(df: DataFrame, channels=CHANNELS, series: Series = Series(),
                 chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> tuple[DataFrame, CleaningStats]:
    """C10 on ``df`` and the statistics it used, so that later rows are cleaned the same way (``clean_fixed``)."""
    ch = channels_in(df, channels)
    spark = df.sparkSession
    filled = fill_missing(coerce(df, ch), ch, series, chunk_rows, median=False, materialize=True)
    q = exact_quantiles(filled, {c: [0.25, 0.5, 0.75] for c in ch})
    medians = {c: None if q[(c, 0.5)] is None else float(q[(c, 0.5)]) for c in ch}
    empty = filled.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ch]).first().asDict() if ch else {}
    need = [c for c in ch if empty[c]]  # sensors without any value take the median, which moves the quartiles
    if need:
        med = _one_row(spark, {f"median_{c}": medians[c] for c in need})
        filled = filled.crossJoin(F.broadcast(med)).select(
            *[F.coalesce(F.col(c), F.col(f"median_{c}")).alias(c) if c in need else F.col(c) for c in df.columns])
        q |= exact_quantiles(filled, {c: [0.25, 0.75] for c in need})
    bounds = {}
    for c in ch:
        b = _bounds_row(c, q[(c, 0.25)], q[(c, 0.75)], IQR_K)
        bounds[c] = (b[f"lower_{c}"], b[f"upper_{c}"])
    stats = CleaningStats(medians, bounds, {})
    cleaned = clip_outliers(filled, stats.bounds_frame(spark), ch) if ch else filled
    if ch:
        mm = cleaned.agg(*[f(c).alias(f"{n}{c}") for c in ch for n, f in (("lo", F.min), ("hi", F.max))]).first()
        stats.min_max = {c: (mm[f"lo{c}"], mm[f"hi{c}"]) for c in ch}
    return cleaned, stats


def clean_fixed(df: DataFrame, stats: CleaningStats, series: Series = Series(),
                chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """C10 with statistics from fit time: coerce, fill, clip. No pass over the table for statistics."""
    ch = [c for c in stats.medians if c in df.columns]
    if not ch:
        return df
    spark = df.sparkSession
    x = fill_missing(coerce(df, ch), ch, series, chunk_rows, fixed=stats.medians_frame(spark))
    return clip_outliers(x, stats.bounds_frame(spark), ch)


def clean_normalize(df: DataFrame, channels=CHANNELS, **kw) -> DataFrame:
    """C11: clean, then standard-scale with statistics of the cleaned data."""
    return normalize(clean(df, channels, **kw), channels)


def null_report(df: DataFrame, columns=None) -> DataFrame:
    """NULL count per column plus the total, one row."""
    cols = list(columns or df.columns)
    per = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in cols]
    total = sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0).cast("long"))
    return df.agg(*per, total.alias("nulls_total"))
