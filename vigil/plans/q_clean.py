"""Registered cleaning queries."""

from __future__ import annotations

from vigil.config import CHANNELS
from vigil.operators import clean as cl
from vigil.plans.registry import register
from vigil.sources import views as v
from vigil.sources.views import with_views

CH = CHANNELS
W = '(PARTITION BY sensor_id ORDER BY "timestamp", reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'
WALL = '(PARTITION BY sensor_id ORDER BY "timestamp", reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)'
OTHER = ["reading_id", '"timestamp"', "sensor_id", "label"]


def _sel(mapping: dict, src: str, tail: str = "") -> str:
    order = ["reading_id", '"timestamp"', "sensor_id", "temperature", "vibration", "pressure", "label"]
    return "SELECT " + ", ".join(mapping.get(c, c) for c in order) + f" FROM {src}{tail}"


FILL_SQL = {c: f"coalesce(last_value({c} IGNORE NULLS) OVER {W}, first_value({c} IGNORE NULLS) OVER {WALL}) AS {c}" for c in CH}
MEDIAN_FILL = {c: f"coalesce({c}, (SELECT median({c}) FROM ffb)) AS {c}" for c in CH}
FILLED_CTE = f"ffb AS ({_sel(FILL_SQL, 'readings_gaps')}), filled AS ({_sel(MEDIAN_FILL, 'ffb')})"


@register(
    "p1_p2_coerce",
    with_views(_sel({"temperature": "TRY_CAST(temperature AS DOUBLE) AS temperature"}, "readings_text"), "readings_text"),
    rounded=("temperature",),
)
def p1_p2_coerce(spark, sf_dir):
    """Text channel coerced to DOUBLE, bad values to NULL."""
    return cl.coerce(v.readings_text(spark, sf_dir))


@register(
    "p3_schema_report",
    with_views(
        "SELECT count(*) AS rows, "
        + ", ".join(
            f"count_if({c} IS NULL) AS null_{c}, count_if({c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL) AS bad_{c}"
            for c in CH
        )
        + " FROM readings_text",
        "readings_text",
    ),
)
def p3_schema_report(spark, sf_dir):
    """Per required column: NULLs and values failing numeric coercion."""
    return cl.schema_report(v.readings_text(spark, sf_dir))


@register(
    "c1_c2_ffill_bfill",
    with_views(_sel(FILL_SQL, "readings_gaps"), "readings_gaps"),
)
def c1_c2_ffill_bfill(spark, sf_dir):
    """Forward fill then leading backward fill per sensor."""
    return cl.fill_missing(v.readings_gaps(spark, sf_dir), median=False)


@register("c3_c4_fill_chain", f"WITH readings_gaps AS ({v.READINGS_GAPS_SQL}), {FILLED_CTE}\nSELECT * FROM filled")
def c3_c4_fill_chain(spark, sf_dir):
    """Fill chain: forward, leading backward, then global median (all-NULL sensors)."""
    return cl.fill_missing(v.readings_gaps(spark, sf_dir))


def _iqr_sql(src):
    parts = []
    for c in CH:
        q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
        parts += [
            f"{q1} AS q1_{c}", f"{q3} AS q3_{c}",
            f"{q1} - 1.5 * ({q3} - {q1}) AS lower_{c}", f"{q3} + 1.5 * ({q3} - {q1}) AS upper_{c}",
        ]
    return f"SELECT {', '.join(parts)} FROM {src}"


IQR_COLS = tuple(f"{k}_{c}" for c in CH for k in ("q1", "q3", "lower", "upper"))


@register("c5_iqr_bounds", with_views(_iqr_sql("readings"), "readings"), rounded=IQR_COLS)
def c5_iqr_bounds(spark, sf_dir):
    """Q1, Q3 and 1.5 IQR bounds per channel (exact, linear interpolation)."""
    return cl.iqr_bounds(v.readings(spark, sf_dir))


@register("c5_iqr_bounds_lineitem", with_views(_iqr_sql("lineitem_series"), "lineitem_series"), rounded=IQR_COLS)
def c5_iqr_bounds_lineitem(spark, sf_dir):
    """IQR bounds over the larger lineitem series."""
    return cl.iqr_bounds(v.lineitem_series(spark, sf_dir))


CLIP_SQL = {c: f"CASE WHEN {c} IS NOT NULL THEN greatest(b.lower_{c}, least(b.upper_{c}, {c})) END AS {c}" for c in CH}

R_IQR = f"WITH readings AS ({v.READINGS_SQL}), b AS ({_iqr_sql('readings')})\n"
SCALE = {c: f"CASE WHEN {c} IS NOT NULL THEN coalesce(({c} - s.mean_{c}) / NULLIF(s.std_{c}, 0), 0) END AS {c}"
         for c in CH}
MOMENTS = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in CH)
CLEANED = (f"WITH readings_gaps AS ({v.READINGS_GAPS_SQL}), {FILLED_CTE}, b AS ({_iqr_sql('filled')}), "
           f"cleaned AS ({_sel(CLIP_SQL, 'filled CROSS JOIN b')})")
C6_SQL = R_IQR + _sel(CLIP_SQL, "readings CROSS JOIN b")
C7_SQL = R_IQR + "SELECT " + ", ".join(
    f"count_if({c} < b.lower_{c} OR {c} > b.upper_{c}) AS outliers_{c}" for c in CH) + " FROM readings CROSS JOIN b"
C9_SQL = (f"WITH readings AS ({v.READINGS_SQL}), s AS (SELECT {MOMENTS} FROM readings)\n"
          + _sel(SCALE, "readings CROSS JOIN s"))
C10_SQL = CLEANED + "\nSELECT * FROM cleaned"
C11_SQL = CLEANED + f", s AS (SELECT {MOMENTS} FROM cleaned)\n" + _sel(SCALE, "cleaned CROSS JOIN s")


@register("c6_clip_outliers", C6_SQL, rounded=CH)
def c6_clip_outliers(spark, sf_dir):
    """Channels clipped into their IQR bounds."""
    r = v.readings(spark, sf_dir)
    return cl.clip_outliers(r, cl.iqr_bounds(r))


@register("c7_count_outliers", C7_SQL)
def c7_count_outliers(spark, sf_dir):
    """Outliers per channel against IQR bounds."""
    r = v.readings(spark, sf_dir)
    return cl.count_outliers(r, cl.iqr_bounds(r))


SCALER_COLS = tuple(f"{k}_{c}" for c in CH for k in ("mean", "std"))


@register(
    "c8_fit_scaler",
    with_views("SELECT " + ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in CH) + " FROM readings",
               "readings"),
    rounded=SCALER_COLS,
)
def c8_fit_scaler(spark, sf_dir):
    """Mean and population std per channel."""
    return cl.fit_scaler(v.readings(spark, sf_dir))


@register("c9_apply_scaler", C9_SQL, rounded=CH)
def c9_apply_scaler(spark, sf_dir):
    """Standard scaling with fitted statistics (constant column -> 0)."""
    return cl.normalize(v.readings(spark, sf_dir))


@register("c10_clean", C10_SQL, rounded=CH)
def c10_clean(spark, sf_dir):
    """Coerce, fill chain, clip: the whole cleaning composite on gapped readings."""
    return cl.clean(v.readings_gaps(spark, sf_dir))


@register("c11_clean_normalize", C11_SQL, rounded=CH)
def c11_clean_normalize(spark, sf_dir):
    """Clean, then standard-scale."""
    return cl.clean_normalize(v.readings_gaps(spark, sf_dir))


@register(
    "c12_null_report",
    with_views(
        "SELECT "
        + ", ".join(f"count_if({c} IS NULL) AS nulls_{c}" for c in ["reading_id", "timestamp", "sensor_id", *CH, "label"])
        .replace("count_if(timestamp", 'count_if("timestamp"')
        + ", " + " + ".join(f"count_if({c} IS NULL)" for c in CH) + " AS nulls_total FROM readings_gaps",
        "readings_gaps",
    ),
)
def c12_null_report(spark, sf_dir):
    """NULL count per column and in total."""
    return cl.null_report(v.readings_gaps(spark, sf_dir))
