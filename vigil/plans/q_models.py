"""Registered model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.models import iforest as ifo
from vigil.models import metrics as mt
from vigil.models import pipeline as pl
from vigil.models.split import split
from vigil.operators import clean as cl
from vigil.operators import features as feat
from vigil.plans import sqlgen as g
from vigil.plans.q_clean import CLEANED
from vigil.plans.registry import register
from vigil.sources import views as v

_MODELS: dict = {}


def trained(spark, sf_dir):
    """Models trained on the whole readings table of ``sf_dir`` (once per session)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = pl.train_all(v.readings(spark, sf_dir))
    return _MODELS[key]


U = "CAST('0x' || substr(md5('42:' || CAST(reading_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0"


@register("m1_split_counts", f"""WITH readings AS ({v.READINGS_SQL})
SELECT label, {U} < 0.2 AS is_test, count(*) AS n FROM readings GROUP BY 1, 2""")
def m1_split_counts(spark, sf_dir):
    """Stratified 80/20 split by stable hash: rows per (label, side)."""
    return split(v.readings(spark, sf_dir)).groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("g5_anomaly_metrics", f"""WITH readings AS ({v.READINGS_SQL}), scores AS ({v.SCORES_SQL})
SELECT count_if(is_anomaly) AS n_anomalies, count_if(is_anomaly) / count(*) AS anomaly_rate,
       avg(anomaly_score) AS mean_anomaly_score, stddev_pop(anomaly_score) AS std_anomaly_score FROM scores""",
          rounded=("anomaly_rate", "mean_anomaly_score", "std_anomaly_score"))
def g5_anomaly_metrics(spark, sf_dir):
    """Anomaly count, rate, mean and std of decision scores (stand-in scores)."""
    return mt.anomaly_metrics(v.scores(spark, sf_dir))


@register("g6_accuracy", f"""WITH readings AS ({v.READINGS_SQL}), scores AS ({v.SCORES_SQL})
SELECT avg(CAST(CAST(is_failure AS DOUBLE) = CASE WHEN label = 'failure' THEN 1.0 ELSE 0.0 END AS DOUBLE)) AS accuracy
FROM scores""", rounded=("accuracy",))
def g6_accuracy(spark, sf_dir):
    """Accuracy of a stand-in failure flag against the label."""
    s = v.scores(spark, sf_dir).withColumn("y", feat.encode_label("label"))
    return mt.accuracy(s, "is_failure")


@register("g7_auc", f"""WITH readings AS ({v.READINGS_SQL}), scores AS ({v.SCORES_SQL}),
r AS (SELECT CASE WHEN label = 'failure' THEN 1.0 ELSE 0.0 END AS y,
             rank() OVER (ORDER BY failure_probability) + (count(*) OVER (PARTITION BY failure_probability) - 1) / 2.0
               AS avg_rank FROM scores)
SELECT (sum(y * avg_rank) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM r""",
          rounded=("auc",))
def g7_auc(spark, sf_dir):
    """ROC AUC of a stand-in probability against the label (ties averaged)."""
    s = v.scores(spark, sf_dir).withColumn("y", feat.encode_label("label"))
    return mt.auc_frame(s, "failure_probability")


@register("m10_train_metrics")
def m10_train_metrics(spark, sf_dir):
    """Train isolation forest, forest and logistic on all readings; metrics table."""
    return trained(spark, sf_dir)[1]


@register("m3_isolation_trees")
def m3_isolation_trees(spark, sf_dir):
    """Isolation tree node table (at most 100 x 511 rows)."""
    m = trained(spark, sf_dir)[0]
    return spark.createDataFrame(m.iforest.trees, ifo.TREE_SCHEMA)


@register("m12_score_all")
def m12_score_all(spark, sf_dir):
    """Every model on every reading plus the combined risk."""
    return pl.score_all(v.readings(spark, sf_dir), trained(spark, sf_dir)[0])


@register("m12_serving_features", CLEANED + ", f AS (" + g.all_features_sql("cleaned", base_cols=['reading_id', 'sensor_id', 'temperature', 'vibration', 'pressure']) + ") "
          "SELECT reading_id, sensor_id, " + ", ".join(f"CAST(coalesce({f}, 0) AS DOUBLE) AS {f}" for f in pl.feature_set()) + " FROM f", rounded=tuple(pl.feature_set()))
def m12_serving_features(spark, sf_dir):
    """The matrix that scoring sees for gapped readings: cleaned with fitted statistics, features, aligned."""
    r = v.readings_gaps(spark, sf_dir)
    _, stats = cl.fit_cleaning(r)
    models = pl.Models(pl.feature_set(), None, None, None, (0.0, 0.0), stats)
    return pl.aligned(pl.serving_features(r, models), models, keep=("reading_id", "sensor_id"))


@register("m13_latest_predictions")
def m13_latest_predictions(spark, sf_dir):
    """Latest prediction per sensor from features over its history."""
    return pl.latest_predictions(v.readings(spark, sf_dir), trained(spark, sf_dir)[0])


_M9_FEATS = ["temperature", "vibration", "pressure"]
_M9_SQL = f"""WITH readings AS ({v.READINGS_SQL}),
y AS (SELECT *, CASE WHEN label = 'failure' THEN 1.0 WHEN label = 'normal' THEN 0.0 END AS y FROM readings)
SELECT 'bias' AS name, 0.0 - 0.01 * avg(0.5 - y) AS weight FROM y WHERE y IS NOT NULL
""" + "".join(
    f"UNION ALL SELECT '{f}' AS name, 0.0 - 0.01 * avg((0.5 - y) * coalesce({f}, 0.0)) AS weight "
    f"FROM y WHERE y IS NOT NULL\n" for f in _M9_FEATS)


_Z = {f: f"(coalesce({f}, 0.0) - s.mean_{f}) / s.std_{f}" for f in _M9_FEATS}
_M8_SQL = f"""WITH readings AS ({v.READINGS_SQL}),
s AS (SELECT {", ".join(f"avg({f}) AS mean_{f}, stddev_pop({f}) AS std_{f}" for f in _M9_FEATS)} FROM readings),
z AS (SELECT reading_id, CASE WHEN label = 'failure' THEN 1.0 WHEN label = 'normal' THEN 0.0 END AS y,
      {", ".join(f"{e} AS z_{f}" for f, e in _Z.items())} FROM readings CROSS JOIN s),
w1 AS (SELECT 0.0 - 0.1 * avg(0.5 - y) AS b, {", ".join(f"0.0 - 0.1 * avg((0.5 - y) * z_{f}) AS w_{f}" for f in _M9_FEATS)}
       FROM z WHERE y IS NOT NULL),
e AS (SELECT z.*, w1.*, 1.0 / (1.0 + exp(-(b + {" + ".join(f"w_{f} * z_{f}" for f in _M9_FEATS)}))) - y AS err FROM z CROSS JOIN w1),
w2 AS (SELECT any_value(b) - 0.1 * avg(err) AS b2,
       {", ".join(f"any_value(w_{f}) - 0.1 * (avg(err * z_{f}) + 0.0001 * any_value(w_{f})) AS v_{f}" for f in _M9_FEATS)} FROM e WHERE y IS NOT NULL)
SELECT reading_id, 1.0 / (1.0 + exp(-(b2 + {" + ".join(f"v_{f} * z_{f}" for f in _M9_FEATS)}))) AS online_probability FROM z CROSS JOIN w2"""


@register("m8_online_probability", _M8_SQL, rounded=("online_probability",))
def m8_online_probability(spark, sf_dir):
    """Online probability of every reading after two scaled gradient steps over all readings (M9 -> M8)."""
    from vigil.models.classifiers import predict_with_weights
    from vigil.streaming.monitor import sgd_step

    r = v.readings(spark, sf_dir).withColumn("y", feat.encode_label("label"))
    m = cl.fit_scaler(r, _M9_FEATS).first()
    scaler = {f: (m[f"mean_{f}"], m[f"std_{f}"]) for f in _M9_FEATS}
    w = {"bias": 0.0, **{f: 0.0 for f in _M9_FEATS}}
    for _ in range(2):
        w = sgd_step(r, w, _M9_FEATS, lr=0.1, scaler=scaler)
    return predict_with_weights(r, w, _M9_FEATS, scaler).select("reading_id", "online_probability")


@register("m9_online_step", _M9_SQL, rounded=("weight",))
def m9_online_step(spark, sf_dir):
    """One online logistic gradient step (learning rate 0.01) from zero weights over all readings."""
    from vigil.streaming.monitor import sgd_step

    r = v.readings(spark, sf_dir).withColumn("y", feat.encode_label("label"))
    w = sgd_step(r, {"bias": 0.0, **{f: 0.0 for f in _M9_FEATS}}, _M9_FEATS, lr=0.01)
    return spark.createDataFrame(list(w.items()), "name string, weight double")  # one row per feature
