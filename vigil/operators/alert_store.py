"""Alert table whose appends can be rerun and whose retention frees storage.

Rows lie under ``rows/alert_date=.../batch_id=...``. A batch is written with
dynamic partition overwrite and counts only when its entry in ``commits`` is
there, so a job that failed halfway is simply run again: it overwrites its own
partitions, and a batch that is committed already is left alone. An entry has
the batch's rows per date, from which the running total is summed; the table
itself is not counted again.

Retention deletes whole dates before the cutoff and rewrites the cutoff's own
date; files of later dates stay as they are. One writer at a time is assumed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.config import AlertConfig
from vigil.operators.alerts import build_alerts
from vigil.session import stored

COMMIT = T.StructType([T.StructField("alert_date", T.DateType()), T.StructField("n", T.LongType()), T.StructField("batch_id", T.StringType())])


class AlertStore:
    """An alert table at ``path``; all batches have the columns of the first."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows_path, self.commits_path, self.schema_path = f"{self.path}/rows", f"{self.path}/commits", f"{self.path}/schema"

    # ---- files
    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _dates(self) -> list[str]:
        """Dates that have a folder."""
        fs, p = self._fs(self.rows_path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n.split("=", 1)[1] for n in names if n.startswith("alert_date="))

    def _rows(self) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.spark.read.text(self.schema_path).first()[0]))
        if not self._dates():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.rows_path)

    # ---- commits
    def commits(self) -> DataFrame:
        """alert_date, n, batch_id of every committed batch; each has at least one row."""
        if not self._exists(self.commits_path):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).parquet(self.commits_path)

    def committed(self, batch_id: str) -> bool:
        return not self.commits().filter(F.col("batch_id") == batch_id).isEmpty()

    # ---- I10
    def append(self, alerts: DataFrame, batch_id: str) -> bool:
        """Add a batch once; False if it is there already. Rows without a time go to the null date."""
        if self.committed(batch_id):
            return False
        rows = alerts.withColumn("alert_date", F.to_date("timestamp")).withColumn("batch_id", F.lit(batch_id))
        if not self._exists(f"{self.schema_path}/_SUCCESS"):
            self.spark.createDataFrame([(json.dumps(rows.schema.jsonValue()),)], "value string").coalesce(1).write.mode("overwrite").text(self.schema_path)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("alert_date", "batch_id").parquet(self.rows_path)
        counts = self._rows().filter(F.col("batch_id") == batch_id).groupBy("alert_date").agg(F.count("*").alias("n"))
        nothing = self.spark.createDataFrame([(None, 0)], "alert_date date, n long")
        counts.unionByName(nothing).coalesce(1).write.mode("overwrite").parquet(f"{self.commits_path}/batch_id={batch_id}")
        return True

    def read(self) -> DataFrame:
        """Rows of committed batches; a filter on alert_date reads only its folders."""
        return self._rows().join(self.commits().select("batch_id").distinct(), "batch_id", "left_semi").drop("batch_id")

    def total(self) -> int:
        """Rows of all committed batches, from the commits."""
        return self.commits().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    # ---- A3
    def process(self, predictions: DataFrame, batch_id: str, cfg: AlertConfig = AlertConfig()) -> int:
        """A3: level -> alert -> append once; the running total of the table."""
        self.append(build_alerts(predictions, cfg), batch_id)
        return self.total()

    # ---- A8
    def retain(self, cutoff: str) -> dict:
        """Drop rows before ``cutoff`` (a timestamp text); the dates that went and the one that was rewritten.

        Rows without a time are older than any cutoff. A run that failed is
        finished by running it again with the same cutoff.
        """
        day = self.spark.sql("SELECT CAST(CAST(:c AS TIMESTAMP_NTZ) AS DATE) AS d", args={"c": cutoff}).first()[0].isoformat()
        staged, target = f"{self.path}/staged/alert_date={day}", f"{self.rows_path}/alert_date={day}"
        if day in self._dates():
            keep = self._rows().filter((F.col("alert_date") == F.lit(day).cast("date")) & (F.col("timestamp") >= F.lit(cutoff).cast("timestamp_ntz")))
            # the date's new content is complete before the old one goes
            keep.drop("alert_date").write.mode("overwrite").partitionBy("batch_id").parquet(staged)
            self._delete(target)
        rewritten = self._exists(f"{staged}/_SUCCESS")
        if rewritten:
            fs, at = self._fs(target)
            fs.mkdirs(at.getParent())
            fs.rename(self._fs(staged)[1], at)
        old = [d for d in self._dates() if d == "__HIVE_DEFAULT_PARTITION__" or d < day]
        for d in old:
            self._delete(f"{self.rows_path}/alert_date={d}")
        self._recount(day)
        return {"dropped": old, "rewritten": day if rewritten else None}

    def _recount(self, day: str) -> None:
        """Commits without the dates that went; only the cutoff's own date is counted anew."""
        at, names = F.lit(day).cast("date"), COMMIT.fieldNames()
        commits = self.commits()
        today = self._rows().filter(F.col("alert_date") == at).groupBy("alert_date", "batch_id").agg(F.count("*").alias("n"))
        # a batch whose rows have all gone stays committed: a rerun must not bring it back
        every = commits.select(F.lit(None).cast("date").alias("alert_date"), F.lit(0).cast("long").alias("n"), "batch_id").distinct()
        left = commits.filter(F.col("alert_date") > at).select(*names).unionByName(today.select(*names)).unionByName(every.select(*names))
        left = stored(left, "commits")  # read before its own files are replaced
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.commits_path)


def append_alerts(alerts: DataFrame, path: str, batch_id: str) -> bool:
    """Add the alerts of a batch to the table at ``path``, once."""
    return AlertStore(alerts.sparkSession, path).append(alerts, batch_id)
