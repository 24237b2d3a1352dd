"""Feature operators W1-W17, P5-P11, G4, T1.

``all_features`` emits the 79 engineered columns in one select: one Exchange by
sensor (or by (sensor, chunk) for hot sensors, see plans.chunking) and one Sort
feed every window; global min/max for the health score is a one-row aggregate
joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.config import CHANNELS, FeatureConfig
from vigil.functions import series as fs
from vigil.functions.rolling import rolled
from vigil.functions.series import Series
from vigil.plans.chunking import CHUNK, DEFAULT_CHUNK_ROWS, HALO, finish, plan_chunks
from vigil.session import stored
from vigil.sources.layout import ranks


def channels_in(df: DataFrame, channels=CHANNELS) -> list[str]:
    return [c for c in channels if c in df.columns]


def _plan_cols(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in (CHUNK, HALO) or c.startswith(fs.CARRY) or c.startswith(fs.FIRST)]


def global_min_max(df: DataFrame, channels) -> DataFrame:
    """One-row table of min/max per channel (W13); safe to broadcast."""
    aggs = []
    for c in channels:
        aggs += [F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}")]
    return df.agg(*aggs)


def feature_columns(df_cols, cfg: FeatureConfig, s: Series, with_health: bool, pool) -> list[Column]:
    """The features over the windows they leave in ``pool`` (54 instead of 105 for three channels)."""
    ch = [c for c in cfg.channels if c in df_cols]
    cols: list[Column] = []
    for w in cfg.windows:  # reference order: window outer, channel inner
        for c in ch:
            cols += fs.rolling(c, [w], s, pool)
    for c in ch:
        cols += fs.change(c, s, pool)
    for c in ch:
        cols += fs.spikes(c, s, cfg.z_window, cfg.eps, cfg.spike_z, pool)
    for c in ch:
        cols += fs.lags(c, cfg.lags, s, pool)
    if len(ch) >= 2:
        cols += fs.interactions(ch)
    if with_health:
        lo = {c: F.col(f"_min_{c}") for c in CHANNELS}
        hi = {c: F.col(f"_max_{c}") for c in CHANNELS}
        cols.append(fs.health_score(lo, hi, cfg.eps, cfg.temperature_sign))
    return cols


def feature_names(cfg: FeatureConfig = FeatureConfig(), channels=None) -> list[str]:
    """Names of the engineered features, in output order (79 for three channels)."""
    ch = [c for c in cfg.channels if channels is None or c in channels]
    names = []
    for w in cfg.windows:
        for c in ch:
            names += [f"{c}_rolling_{k}_{w}" for k in ("mean", "std", "min", "max", "range")]
    for c in ch:
        names += [f"{c}_rate_of_change", f"{c}_rate_of_change_pct", f"{c}_acceleration"]
    for c in ch:
        names += [f"{c}_z_score", f"{c}_spike", f"{c}_spike_magnitude"]
    for c in ch:
        names += [f"{c}_lag_{k}" for k in cfg.lags]
    have = set(ch)
    if len(ch) >= 2:
        names += [n for a, b, n in fs.INTERACTIONS if a in have and b in have]
    if have >= set(CHANNELS):
        names.append("combined_health_score")
    return names


def all_features(
    df: DataFrame,
    cfg: FeatureConfig = FeatureConfig(),
    series: Series = Series(),
    chunk_rows: int | None = DEFAULT_CHUNK_ROWS,
    min_max: DataFrame | None = None,
) -> DataFrame:
    """Input columns + every engineered feature, one row per input row.

    ``min_max`` optionally supplies fixed statistics (from fit time) for the
    health score; by default they are the table's own min/max (reference).
    """
    ch = channels_in(df, cfg.channels)
    if not ch:
        return df
    base = df.columns
    with_health = set(CHANNELS) <= set(ch)
    x, s = plan_chunks(df, series, cfg.history, chunk_rows, carry_channels=ch)
    if with_health:
        stats = min_max if min_max is not None else global_min_max(df, CHANNELS)
        x = x.crossJoin(F.broadcast(stats))
    pool = fs.Pool()
    cols = feature_columns(base, cfg, s, with_health, pool)
    out = x.select("*", *pool.columns()).select(*base, *cols, *_plan_cols(x))
    return finish(out, s)


def window_family(df: DataFrame, builder, series: Series = Series(), history: int = 19,
                  chunk_rows: int | None = DEFAULT_CHUNK_ROWS, carry=()) -> DataFrame:
    """Run one family builder (``builder(s) -> [Column]``) with the same skew-safe plan."""
    x, s = plan_chunks(df, series, history, chunk_rows, carry_channels=carry)
    out = x.select(*df.columns, *builder(s), *_plan_cols(x))
    return finish(out, s)


def rolling_features(df, cfg: FeatureConfig = FeatureConfig(), series: Series = Series(),
                     chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    ch = channels_in(df, cfg.channels)
    if not ch or any(df.schema[c].dataType != T.DoubleType() for c in ch):
        return window_family(
            df, lambda s: [c for w in cfg.windows for x in ch for c in fs.rolling(x, [w], s)], series, cfg.history, chunk_rows
        )
    x, s = plan_chunks(df, series, cfg.history, chunk_rows)
    return finish(rolled(x, ch, cfg.windows, s), s).select(*df.columns, *[n for n in feature_names(cfg, ch) if "_rolling_" in n])


def change_features(df, cfg: FeatureConfig = FeatureConfig(), series: Series = Series(), **kw) -> DataFrame:
    ch = channels_in(df, cfg.channels)
    return window_family(df, lambda s: [c for x in ch for c in fs.change(x, s)], series, cfg.history, carry=ch, **kw)


def spike_features(df, cfg: FeatureConfig = FeatureConfig(), series: Series = Series(), **kw) -> DataFrame:
    ch = channels_in(df, cfg.channels)
    return window_family(
        df, lambda s: [c for x in ch for c in fs.spikes(x, s, cfg.z_window, cfg.eps, cfg.spike_z)], series,
        cfg.history, **kw
    )


def lag_features(df, cfg: FeatureConfig = FeatureConfig(), series: Series = Series(), **kw) -> DataFrame:
    ch = channels_in(df, cfg.channels)
    return window_family(df, lambda s: [c for x in ch for c in fs.lags(x, cfg.lags, s)], series, cfg.history, **kw)


def interaction_features(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), min_max: DataFrame | None = None):
    """P11 + W13 + W14: products and the health score over global min/max."""
    ch = channels_in(df, cfg.channels)
    cols = fs.interactions(ch)
    if set(CHANNELS) <= set(ch):
        stats = min_max if min_max is not None else global_min_max(df, CHANNELS)
        lo = {c: F.col(f"_min_{c}") for c in CHANNELS}
        hi = {c: F.col(f"_max_{c}") for c in CHANNELS}
        return df.crossJoin(F.broadcast(stats)).select(
            *df.columns, *cols, fs.health_score(lo, hi, cfg.eps, cfg.temperature_sign)
        )
    return df.select(*df.columns, *cols)


# ------------------------------------------------------------------ W17 latest
def latest_per_key(df: DataFrame, key=("sensor_id",), order=("timestamp", "reading_id")) -> DataFrame:
    """One row per key: the greatest (order) row.

    ``max_by`` over a struct is a declarative aggregate, so each map task keeps
    one candidate per key before the shuffle: a hot key costs nothing extra.
    """
    rest = [c for c in df.columns if c not in key]
    ordk = F.struct(*[F.col(o) for o in order])
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), ordk).alias("_r")).select(*key, "_r.*")


def latest_features(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), series: Series = Series(),
                    min_max: DataFrame | None = None) -> DataFrame:
    """W16 evaluated at each sensor's latest row only (W17 of W16), exactly.

    A row's features need its ``history`` predecessors, so only each sensor's
    last history+1 rows are windowed: ``row_number() <= k`` is planned as a
    partial WindowGroupLimit (k rows per key per map task cross the shuffle, a
    hot sensor included). Global min/max still come from the whole table, and
    the one unbounded look-back (pct change over NULL gaps) gets a per-sensor
    carry: the last non-NULL value older than the tail (partial ``max_by``),
    looked up for the sensors that need it. A NULL sensor is a sensor here (I3
    rejects such rows, scoring does not).
    """
    ch = channels_in(df, cfg.channels)
    key, order = list(series.key), list(series.order)
    k = cfg.history + 1
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    tail = stored(df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk"), "tail")
    ordk = F.struct(*[F.col(o) for o in order])
    # only sensors with a full tail that lacks two values of a channel can depend on older rows
    short = tail.groupBy(*[F.col(x).alias(f"_k_{x}") for x in key]).agg(
        F.min(ordk).alias("_start"), F.count(F.lit(1)).alias("_n"), F.least(F.lit(k), *[F.count(F.col(c)) for c in ch]).alias("_least"))
    short = stored(short.filter((F.col("_n") == k) & (F.col("_least") < 2)).drop("_n", "_least"), "short")
    nulls = [F.lit(None).cast("double").alias(fs.CARRY + c) for c in ch]
    if short.isEmpty():
        t = tail.select("*", *nulls)
    else:
        same = [F.col(x).eqNullSafe(F.col(f"_k_{x}")) for x in key]
        older = df.join(short, same).filter(ordk < F.col("_start"))
        carry = older.groupBy(*[f"_k_{x}" for x in key]).agg(
            *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ordk)).alias(fs.CARRY + c) for c in ch])
        t = tail.join(stored(carry, "carry"), same, "left").drop(*[f"_k_{x}" for x in key])
    t = t.select(*t.columns, *[F.lit(None).cast("double").alias(fs.FIRST + c) for c in ch])
    s = Series(series.key, series.order, None, True)
    with_health = set(CHANNELS) <= set(ch)
    base = df.columns
    if with_health:
        stats = min_max if min_max is not None else global_min_max(df, CHANNELS)
        t = t.crossJoin(F.broadcast(stats))
    pool = fs.Pool()
    cols = feature_columns(base, cfg, s, with_health, pool)
    out = t.select("*", *pool.columns()).select(*base, *cols)
    return latest_per_key(out, tuple(key), tuple(order))


# ------------------------------------------------------------------ P5-P9
def one_hot(df: DataFrame, values, column: str = "sensor_id", prefix: str = "sensor") -> DataFrame:
    """P5: boolean dummy per known value (``sensor_<value>``); values are given, not collected."""
    return df.select(*df.columns, *[(F.col(column) == F.lit(v)).alias(f"{prefix}_{v}") for v in values])


def sensor_slots(df: DataFrame, column: str = "sensor_id") -> DataFrame:
    """(column, slot, slots) of every distinct value, in order; ranked by many tasks, nothing of it on the driver."""
    return ranks(df.filter(F.col(column).isNotNull()), column).select(column, F.col("rank").cast("int").alias("slot"), F.col("n").cast("int").alias("slots"))


def one_hot_vector(df: DataFrame, slots: DataFrame, column: str = "sensor_id", out: str = "sensor_onehot") -> DataFrame:
    """P5 for many sensors: the slot of each row's value, and a sparse vector with that slot set.

    ``slots`` (``sensor_slots`` of the training rows) is joined by its size; a
    value without a slot gets NULL and an all-zero vector.
    """
    from pyspark.ml.feature import OneHotEncoder

    s = slots.withColumnRenamed(column, "_value")
    x = df.join(s, F.col(column) == F.col("_value"), "left").drop("_value", "slots").withColumnRenamed("slot", f"{out}_slot")
    n = slots.agg(F.max("slots")).first()[0] or 0
    # slot n stands for "no slot" and is the encoder's dropped last category
    at = F.coalesce(F.col(f"{out}_slot"), F.lit(n)).cast("double")
    sizes = df.sparkSession.createDataFrame([(float(n),)], "i double")
    encoder = OneHotEncoder(inputCols=["_slot"], outputCols=[out], dropLast=True).fit(sizes.withColumnRenamed("i", "_slot"))
    return encoder.transform(x.withColumn("_slot", at)).drop("_slot")


def calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour of day and day of week with Monday = 0."""
    return df.select(*df.columns, F.hour(ts).alias("hour"), F.weekday(ts).alias("day_of_week"))


def prepare_base(df: DataFrame, sensors) -> DataFrame:
    """Required channels checked, sensor dummies and calendar columns."""
    missing = [c for c in CHANNELS if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    cols = [*df.columns]
    if "sensor_id" in df.columns:
        cols += [(F.col("sensor_id") == F.lit(v)).alias(f"sensor_{v}") for v in sensors]
    if "timestamp" in df.columns:
        cols += [F.hour("timestamp").alias("hour"), F.weekday("timestamp").alias("day_of_week")]
    return df.select(*cols)


def base_feature_names(sensors) -> list[str]:
    return list(CHANNELS) + [f"sensor_{v}" for v in sensors] + ["hour", "day_of_week"]


def align(df: DataFrame, feature_list, keep=()) -> DataFrame:
    """Features in training order, missing or NULL -> 0.0 (Q10)."""
    have = set(df.columns)
    cols = [
        (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f) for f in feature_list
    ]
    fl = set(feature_list)
    return df.select(*[k for k in keep if k in have and k not in fl], *cols)


def encode_label(c: str = "label") -> Column:
    """P10: failure -> 1.0, normal -> 0.0, anything else NULL (Q2)."""
    return F.when(F.col(c) == "failure", 1.0).when(F.col(c) == "normal", 0.0)


# ------------------------------------------------------------------ G4, T1
def label_correlations(df: DataFrame, features, target: str = "label") -> DataFrame:
    """|corr(feature, y)| per feature, pairwise-complete, NULL for constants.

    Rows turn into (feature, x, y) and one partial aggregate over as many keys
    as there are features has the three moments of each.
    """
    y = encode_label(target) if dict(df.dtypes).get(target) == "string" else F.col(target).cast("double")
    d = df.select(y.alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    long = d.unpivot(["_y"], list(features), "feature", "_x")
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    x, yy = F.when(both, F.col("_x")), F.when(both, F.col("_y"))
    m = long.groupBy("feature").agg(F.covar_pop(x, yy).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(yy).alias("sy"))
    return m.select("feature", F.abs(F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).alias("abs_corr"))


def top_features(df: DataFrame, features, target: str = "label", k: int = 20) -> DataFrame:
    """Top-k features by |corr| (NULLs last, name breaks ties); no label -> first k."""
    if target not in df.columns:
        spark = df.sparkSession
        rows = [(f, i) for i, f in enumerate(features[:k])]
        return spark.createDataFrame(rows, "feature string, rank int")
    c = label_correlations(df, features, target)
    from pyspark.sql import Window

    w = Window.orderBy(F.desc_nulls_last("abs_corr"), F.asc("feature"))
    # the correlation table has one row per feature: a global window is bounded
    return c.select("feature", "abs_corr", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)
