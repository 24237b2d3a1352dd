"""Skew-safe plan for per-sensor row-frame windows.

A plain ``Window.partitionBy('sensor_id')`` sends every row of a sensor to one
task; a sensor holding a third of the table would then be processed serially.
All our frames are bounded row frames (at most ``history`` preceding rows) plus
two unbounded carries (forward fill, last non-null for pct change), so a hot
sensor can be cut into row-balanced chunks processed in parallel:

1. ``groupBy(sensor).count/min/max`` (map-side partial aggregation) finds hot
   sensors, those with more than ``chunk_rows`` rows. There are at most
   N / chunk_rows of them.
2. Each hot sensor's time range is cut into ``subs`` equal sub-buckets per
   expected chunk; rows are counted per (sensor, sub-bucket) (partial agg).
   A sub-bucket that still holds more than ``chunk_rows`` rows (a burst) is
   cut again at 64 equi-depth points from a ``percentile_approx`` sketch, up
   to three more levels; only rows sharing one timestamp cannot be split.
3. On that small table a running count assigns sub-buckets to chunks of about
   ``chunk_rows`` rows, and each chunk receives as *halo* the whole sub-buckets
   that hold the ``history`` rows right before it (exact, never a cap).
4. The data is tagged by joins with these stored tables, which Spark broadcasts
   as long as they are small in bytes, and exploded to (chunk, halo) targets; windows then partition by (sensor, chunk), halo rows
   supply the preceding context and are dropped afterwards.
5. Unbounded carries come from a per-(hot sensor, chunk) aggregate of the last
   and first non-null value, combined over earlier chunks on the small table.

Only one full shuffle remains (the window's Exchange on (sensor, chunk)).
When no sensor is hot the input is returned untouched and the caller runs the
plain one-shuffle plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.series import CARRY, FIRST, Series
from vigil.session import stored

CHUNK = "_chunk"
HALO = "_halo"
SUB = "_sub"
SUB2 = "_sub2"  # finer equi-depth levels inside heavy sub-buckets (a struct)
LEVELS = 4
CUTS = 64
DEFAULT_CHUNK_ROWS = 4_000_000
_EPOCH = "1970-01-01 00:00:00"


def order_number(df: DataFrame, c: str) -> Column:
    """Monotone long for the leading order column (microseconds for timestamps)."""
    dt = df.schema[c].dataType
    if isinstance(dt, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col(c))
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(F.col(c))
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(c)).cast("long")
    return F.col(c).cast("long")


def plan_chunks(
    df: DataFrame,
    series: Series,
    history: int,
    chunk_rows: int | None = DEFAULT_CHUNK_ROWS,
    carry_channels=(),
    subs: int = 8,
) -> tuple[DataFrame, Series]:
    """Tag rows with (_chunk, _halo) when some sensor is hot; else return input."""
    if not chunk_rows:
        return df, series
    key = list(series.key)
    t = order_number(df, series.order[0])
    stats = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(t).alias("_t0"), F.max(t).alias("_t1")
    )
    hot = (
        stats.filter(F.col("_n") > F.lit(chunk_rows))
        .withColumn("_nb", (F.ceil(F.col("_n") / F.lit(chunk_rows)) * F.lit(subs)).cast("long"))
        .withColumn(
            "_w",
            F.greatest(F.lit(1).cast("long"), F.ceil((F.col("_t1") - F.col("_t0") + 1) / F.col("_nb"))),
        )
        .select(*key, "_t0", "_w", "_nb")
    )
    hot = stored(hot, "hot")
    if hot.isEmpty():
        return df, series

    def sub_of(frame: DataFrame) -> Column:
        # rows without a time come first in every window, so they are the first sub-bucket
        at = F.floor((order_number(frame, series.order[0]) - F.col("_t0")) / F.col("_w"))
        return F.when(F.col("_t0").isNotNull(), F.when(at.isNull(), F.lit(-1).cast("long")).otherwise(F.least(F.col("_nb") - 1, at)))

    tagged = df.join(hot, key, "left")
    tagged = tagged.withColumn(SUB, sub_of(tagged)).drop("_nb")

    tagged = tagged.drop("_t0", "_w")
    # -- small table: rows per (hot sensor, bucket). A burst can put more than
    # chunk_rows rows into one time sub-bucket: such heavy buckets are cut again
    # at equi-depth points (percentile_approx sketch, partial aggregation) for up
    # to LEVELS rounds; only rows sharing one timestamp cannot be split further.
    tnum = order_number(tagged, series.order[0])
    levels: list[str] = []
    for lvl in range(1, LEVELS + 1):
        bkey = key + [SUB] + levels
        counts = tagged.filter(F.col(SUB).isNotNull()).groupBy(*bkey).agg(F.count(F.lit(1)).alias("_ns"))
        heavy = counts.filter(F.col("_ns") > F.lit(chunk_rows)).select(*bkey)
        heavy = stored(heavy, "heavy")
        if lvl == LEVELS or heavy.isEmpty():
            break
        cuts = stored(
            tagged.join(heavy, bkey, "left_semi")
            .groupBy(*bkey)
            .agg(F.percentile_approx(tnum, [j / CUTS for j in range(1, CUTS)], 10_000).alias("_cuts")),
            "cuts",
        )
        lc = f"_l{lvl}"
        tagged = tagged.join(cuts, bkey, "left")
        tagged = tagged.withColumn(
            lc,
            F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c <= tnum)))
            .when(F.col(SUB).isNotNull(), F.lit(0)),
        ).drop("_cuts")
        levels.append(lc)
    bkey = key + [SUB] + levels
    tagged = tagged.withColumn(SUB2, F.struct(*[F.col(c) for c in levels]) if levels else F.lit(0)).drop(*levels)
    counts = counts.withColumn(SUB2, F.struct(*[F.col(c) for c in levels]) if levels else F.lit(0)).drop(*levels)
    wk = Window.partitionBy(*key).orderBy(SUB, SUB2)
    counts = counts.withColumn(
        "_cb", F.coalesce(F.sum("_ns").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_raw", F.floor(F.col("_cb") / F.lit(chunk_rows)))
    counts = counts.withColumn(CHUNK, (F.dense_rank().over(Window.partitionBy(*key).orderBy("_raw")) - 1).cast("int"))
    counts = stored(counts, "counts")
    starts = counts.groupBy(*key, CHUNK).agg(F.min("_cb").alias("_start"))
    own = counts.select(*key, SUB, SUB2, F.col(CHUNK).alias("_target"), F.lit(False).alias("_h"))
    halo = (
        counts.select(
            *key, SUB, SUB2, (F.col("_cb") + F.col("_ns")).alias("_end"),
            F.explode(F.sequence(F.col(CHUNK) + 1, F.col(CHUNK) + F.lit(history))).alias(CHUNK),
        )
        .join(starts, key + [CHUNK])
        .filter(F.col("_start") - F.col("_end") < F.lit(history))
        .select(*key, SUB, SUB2, F.col(CHUNK).alias("_target"), F.lit(True).alias("_h"))
    )
    mapping = stored(
        own.unionByName(halo)
        .groupBy(*key, SUB, SUB2)
        .agg(F.collect_list(F.struct(F.col("_target").alias("c"), F.col("_h").alias("h"))).alias("_targets")),
        "mapping",
    )

    default = F.array(F.struct(F.lit(0).alias("c"), F.lit(False).alias("h")))
    x = tagged.join(mapping, key + [SUB, SUB2], "left").withColumn(
        "_tg", F.explode(F.coalesce(F.col("_targets"), default))
    )
    x = x.withColumn(CHUNK, F.col("_tg.c")).withColumn(HALO, F.col("_tg.h")).drop("_tg", "_targets")

    s = series.chunked(CHUNK)
    carry_channels = [c for c in carry_channels if c in df.columns]
    if carry_channels:
        x = _attach_carry(x, s, key, carry_channels)
    else:
        s = Series(series.key, series.order, CHUNK, False)
    return x.drop(SUB, SUB2), s


def _attach_carry(x: DataFrame, s: Series, key, channels) -> DataFrame:
    """Per hot chunk: last non-null before it and the sensor's first non-null."""
    ordk = F.struct(*[F.col(o) for o in s.order])
    aggs = []
    for c in channels:
        ok = F.when(F.col(c).isNotNull(), ordk)
        aggs += [F.max_by(F.col(c), ok).alias(f"_last_{c}"), F.min_by(F.col(c), ok).alias(f"_fst_{c}")]
    per = x.filter(F.col(SUB).isNotNull() & ~F.col(HALO)).groupBy(*key, CHUNK).agg(*aggs)
    wc = Window.partitionBy(*key).orderBy(CHUNK)
    cols = []
    for c in channels:
        cols += [
            F.last(f"_last_{c}", ignorenulls=True).over(wc.rowsBetween(Window.unboundedPreceding, -1)).alias(CARRY + c),
            F.first(f"_fst_{c}", ignorenulls=True)
            .over(wc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            .alias(FIRST + c),
        ]
    carry = stored(per.select(*key, CHUNK, *cols), "carry")
    return x.join(carry, key + [CHUNK], "left")


def finish(df: DataFrame, s: Series) -> DataFrame:
    """Drop halo rows and plan columns after the windows ran."""
    if not s.chunk:
        return df
    extra = [c for c in df.columns if c in (CHUNK, HALO) or c.startswith(CARRY) or c.startswith(FIRST)]
    return df.filter(~F.col(HALO)).drop(*extra)
