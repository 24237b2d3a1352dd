"""Per-sensor carry-over between micro-batches as Spark keyed state.

``transformWithStateInPandas`` keeps, per sensor, the last ``history`` rows and
the newest known value of each channel before them, in the RocksDB state store
of the query's checkpoint. A micro-batch reads and writes the state of the
sensors it touches and of no others, whatever the size of the fleet, and a
restarted query goes on from its last commit.

The operator only carries rows: for every sensor of the batch it gives back the
carried rows (kind "carry"), the new ones (kind "new") and those at or before
what the sensor has already seen (kind "late"). Cleaning and the features are the
batch operators over these rows, inside ``foreachBatch``.

Rows of one sensor need no order inside a batch and are never gathered: chunks
pass through, and only the last rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigil.config import CHANNELS, FeatureConfig

#: Fixed value: Spark's own state store over RocksDB, with commits of changed keys only.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}

KIND = "row_kind"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state needs, unless the session names another RocksDB one."""
    for k, v in STORE.items():
        if "RocksDB" not in (spark.conf.get(k, "") or "") or k.endswith("enabled"):
            spark.conf.set(k, v)


class CarryRows(StatefulProcessor):
    """State per sensor: ``tail`` (the last rows) and ``known`` (newest value of each channel older than the tail)."""

    def __init__(self, columns: list[str], channels: list[str], history: int):
        self.columns, self.channels, self.history = columns, channels, history
        self.names = ["reading_id", "at_us", *channels, "label"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [("reading_id", T.LongType()), ("at_us", T.LongType()), *[(c, T.DoubleType()) for c in self.channels], ("label", T.StringType())]
        self.tail = handle.getListState("tail", T.StructType([T.StructField(n, t) for n, t in fields]))
        known = [T.StructField(f"{c}_{part}", t) for c in self.channels for part, t in (("us", T.LongType()), ("id", T.LongType()), ("value", T.DoubleType()))]
        self.known = handle.getValueState("known", T.StructType(known))

    def close(self) -> None:
        pass

    def _frame(self, key, rows: list[tuple], kinds: list[str]) -> pd.DataFrame:
        of = dict(zip(self.names, zip(*rows)))
        of.update({c: np.array(of[c], dtype=float) for c in self.channels})
        of["timestamp"] = np.array([None if _missing(t) else int(t) for t in of["at_us"]], dtype="datetime64[us]").astype("datetime64[ns]")
        of["sensor_id"], of[KIND] = [key[0]] * len(rows), kinds
        return pd.DataFrame({c: of[c] for c in (*self.columns, KIND)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a batch has few rows of most sensors: tuples instead of frames, and no more calls to the store than needed
        tail = [tuple(r) for r in self.tail.get()]
        known = list((self.known.get() if tail else None) or [None] * (3 * len(self.channels)))
        before, edge = list(known), _at(tail[-1]) if tail else None
        out = []
        if tail:
            first = list(tail[0])
            for i in range(len(self.channels)):  # what a fill from the tail alone would not see
                if _missing(first[2 + i]) and known[3 * i + 2] is not None:
                    first[2 + i] = known[3 * i + 2]
            out = [tuple(first), *tail[1:]]
        kinds, changed = ["carry"] * len(out), False
        for chunk in rows:
            new = []
            for r in zip(*[chunk[n].tolist() for n in self.names]):
                if key[0] is None or _missing(r[1]):
                    kinds.append("late")
                else:
                    r = (int(r[0]), int(r[1]), *r[2:])
                    kinds.append("new" if edge is None or _at(r) > edge else "late")
                    if kinds[-1] == "new":
                        new.append(r)
                out.append(r)
            yield self._frame(key, out, kinds)
            out, kinds = [], []
            if not new:
                continue
            changed = True
            every = sorted(tail + new, key=_at)
            gone, tail = every[:-self.history], every[-self.history:]
            for i in range(len(self.channels)):
                at = next((r for r in reversed(gone) if not _missing(r[2 + i])), None)
                if at is not None and (known[3 * i] is None or _at(at) > (known[3 * i], known[3 * i + 1])):
                    known[3 * i:3 * i + 3] = [at[1], at[0], float(at[2 + i])]
        if changed:
            self.tail.put([(*r[:2], *[None if _missing(x) else float(x) for x in r[2:-1]], None if _missing(r[-1]) else str(r[-1])) for r in tail])
            if known != before:
                self.known.update(tuple(known))


def _missing(x) -> bool:
    return x is None or x is pd.NA or x != x


def _at(row: tuple) -> tuple[int, int]:
    return row[1], row[0]


def carried(stream: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The readings of a stream with each touched sensor's carried rows, marked by ``row_kind``.

    Readings without a time or a sensor cannot be placed in a series and are
    marked "late".
    """
    columns, channels = stream.columns, [c for c in CHANNELS if c in stream.columns]
    use_rocksdb(stream.sparkSession)
    schema = T.StructType([*stream.schema.fields, T.StructField(KIND, T.StringType())])
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("timestamp"))
    keyed = stream.withColumn("at_us", at).drop("timestamp")
    return keyed.groupBy("sensor_id").transformWithStateInPandas(
        CarryRows(columns, channels, cfg.history), schema, "Append", "None")
