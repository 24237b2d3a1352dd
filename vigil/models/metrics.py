"""Model metrics as aggregates and a long (model, metric, value) table."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anomaly_metrics(scored: DataFrame) -> DataFrame:
    """Anomalies, rate, mean and population std of the decision score."""
    return scored.agg(
        F.count_if(F.col("is_anomaly")).alias("n_anomalies"),
        (F.count_if(F.col("is_anomaly")) / F.count(F.lit(1))).alias("anomaly_rate"),
        F.avg("anomaly_score").alias("mean_anomaly_score"),
        F.stddev_pop("anomaly_score").alias("std_anomaly_score"),
    )


def accuracy(df: DataFrame, pred: str, label: str = "y") -> DataFrame:
    """Share of rows whose prediction equals the label."""
    return df.agg(F.avg((F.col(pred).cast("double") == F.col(label).cast("double")).cast("double")).alias("accuracy"))


def auc(df: DataFrame, score: str, label: str = "y") -> float:
    """ROC AUC, exact (numBins=0), ties averaged; distributed sort inside the evaluator."""
    ev = BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=0)
    return float(ev.evaluate(df.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label))))


def auc_frame(df: DataFrame, score: str, label: str = "y", buckets: int = 1024) -> DataFrame:
    """G7 as aggregates: AUC = sum over scores of pos(s) * (neg_below(s) + neg(s) / 2) / (P * N).

    Exact (ties count one half) and distributed: rows are first aggregated per
    distinct score (a hot score is one row), distinct scores are cut into
    ``buckets`` ranges at approximate quantiles (``Bucketizer``, binary search
    on the JVM), negatives below each bucket come from the bounded table of
    bucket totals (broadcast, ``buckets`` rows), and only the running sum inside
    one bucket is a window, partitioned by bucket.
    """
    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import Window

    per = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.col(label).cast("double")).alias("pos"),
        F.sum(F.lit(1.0) - F.col(label).cast("double")).alias("neg"),
    ).filter(F.col("s").isNotNull())
    cuts = per.agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)], 10_000).alias("c")).first()["c"]
    splits = [float("-inf")] + sorted(set(cuts or [])) + [float("inf")]
    b = Bucketizer(splits=splits, inputCol="s", outputCol="b").transform(per)
    tot = b.groupBy("b").agg(F.sum("neg").alias("bneg"))
    wb = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # over <= buckets rows
    tot = tot.select("b", F.coalesce(F.sum("bneg").over(wb), F.lit(0.0)).alias("neg_before"))
    w = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    x = b.join(F.broadcast(tot), "b").select(
        "pos", "neg", (F.col("neg_before") + F.coalesce(F.sum("neg").over(w), F.lit(0.0))).alias("neg_below"))
    return x.agg(F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)),
                              F.sum("pos") * F.sum("neg")).alias("auc"))


def metrics_table(spark, metrics: dict) -> DataFrame:
    """{model: {metric: value}} -> rows (model, metric, value)."""
    rows = [(m, k, float(v)) for m, d in metrics.items() for k, v in d.items() if v is not None]
    return spark.createDataFrame(rows, "model string, metric string, value double")
