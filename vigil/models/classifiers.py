"""M5-M8: random forest and logistic classifiers on Spark ML.

Label polarity (Q2): failure = 1.0, normal = 0.0; every probability is
P(failure) = element 1 of the probability vector.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.models.forest import grow
from vigil.models.pruning import MIN_SPLIT, NODES, with_min_split

# 100 trees, depth 10, seed 42; logistic L2 strength 1e-4.
FOREST_PARAMS = dict(numTrees=100, maxDepth=10, seed=42, featureSubsetStrategy="sqrt", impurity="gini")
LOGISTIC_PARAMS = dict(regParam=1e-4, elasticNetParam=0.0, maxIter=100)


def fit_forest(train: DataFrame, features, label: str = "y", min_split: float = MIN_SPLIT, **kw) -> PipelineModel:
    """M5: VectorAssembler -> random forest (trees on unscaled features, Q8), nodes of fewer than ``min_split`` rows not split.

    The trees are grown by ``forest.grow``; the model is Spark ML's, which scores and saves them.
    """
    spark, features, p = train.sparkSession, list(features), {**FOREST_PARAMS, **kw}
    nodes = grow(train, features, label, p["numTrees"], p["maxDepth"], p["seed"], p["featureSubsetStrategy"])
    rf = RandomForestClassifier(featuresCol="rf_features", labelCol=label, probabilityCol="rf_probability",
                                rawPredictionCol="rf_raw", predictionCol="rf_prediction", **p)
    # a model of as many trees over as many features, whose nodes are then replaced
    blank = rf.fit(spark.createDataFrame([(float(k % 2), Vectors.dense([0.0] * len(features))) for k in range(64)], [label, "rf_features"]))
    assembler = VectorAssembler(inputCols=features, outputCol="rf_features", handleInvalid="keep")
    return PipelineModel(stages=[assembler, with_min_split(spark, blank, spark.createDataFrame(nodes, NODES), min_split)])


def fit_logistic(train: DataFrame, features, label: str = "y", **kw) -> PipelineModel:
    """M7: assemble -> standardize (mean and std) -> L2 logistic regression."""
    params = {**LOGISTIC_PARAMS, **kw}
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="lr_raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="lr_raw_features", outputCol="lr_features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="lr_features", labelCol=label, probabilityCol="lr_probability",
                           rawPredictionCol="lr_raw", predictionCol="lr_prediction", **params),
    ])
    return pipe.fit(train)


def logistic_weights(model: PipelineModel, features) -> tuple[dict, dict]:
    """(weights on scaled features with 'bias', {feature: (mean, std)}) of a fitted M7 pipeline: where M9 starts."""
    scaler, lr = model.stages[1], model.stages[2]
    weights = {"bias": float(lr.intercept), **{f: float(w) for f, w in zip(features, lr.coefficients.toArray())}}
    return weights, {f: (float(m), float(s)) for f, m, s in zip(features, scaler.mean.toArray(), scaler.std.toArray())}


def scaled(f: str, scaler: dict | None = None) -> Column:
    """A feature as the logistic model sees it: missing is 0, then standard scaling; a constant becomes 0."""
    x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    if scaler is None:
        return x
    mean, std = scaler[f]
    return (x - F.lit(float(mean))) / F.lit(float(std)) if std else F.lit(0.0)


def linear_score(weights: dict, features, scaler: dict | None = None) -> Column:
    z = F.lit(float(weights.get("bias", 0.0)))
    for f in features:
        z = z + F.lit(float(weights.get(f, 0.0))) * scaled(f, scaler)
    return z


def predict_with_weights(df: DataFrame, weights: dict, features, scaler: dict | None = None) -> DataFrame:
    """M8 from a table of weights: online_probability and online_prediction."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-linear_score(weights, features, scaler)))
    return df.withColumn("online_probability", p).withColumn("online_prediction", (F.col("online_probability") > 0.5).cast("double"))


def predict_failure(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M6: failure_probability and is_failure (class 1 predicted)."""
    out = model.transform(df)
    return out.withColumn("failure_probability", vector_to_array("rf_probability")[1]) \
        .withColumn("is_failure", F.col("rf_prediction") == 1.0) \
        .drop("rf_features", "rf_probability", "rf_raw", "rf_prediction")


def predict_online(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M8: online_probability and online_prediction."""
    out = model.transform(df)
    return out.withColumn("online_probability", vector_to_array("lr_probability")[1]) \
        .withColumn("online_prediction", F.col("lr_prediction")) \
        .drop("lr_raw_features", "lr_features", "lr_probability", "lr_raw", "lr_prediction")
