"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir, ship_package

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Bytes of remembered values that one Python worker keeps, whatever it works on.
WORKER_BYTES = 32 << 20
#: Bytes of rows that Spark sends a Python worker at once; texts differ a thousandfold in length.
BATCH_BYTES = 8 << 20
#: What a dict entry of two small objects takes beside their content.
_ENTRY_BYTES = 120


class Remembered(dict):
    """A worker's table of values worked out once, up to a number of bytes.

    Frequent keys are met early; a full table serves them and works out the rest
    anew.
    """

    def __init__(self, most: int = WORKER_BYTES):
        super().__init__()
        self.left = most

    def put(self, key, value, size: int) -> None:
        if self.left > 0:
            self[key] = value
            self.left -= size + _ENTRY_BYTES


_HELD: dict = {}


def held(operator: str, kind: str, key, make):
    """What this worker keeps between batches and tasks: one thing of each kind, of one operator.

    Spark hands a worker from stage to stage; what an earlier operator kept
    goes when another asks.
    """
    if _HELD.get("operator") != operator:
        _HELD.clear()
        _HELD["operator"] = operator
    if kind not in _HELD or _HELD[kind][0] != key:
        _HELD[kind] = (key, make())
    return _HELD[kind][1]


class WordHashes(Remembered):
    """word (bytes) -> 64-bit hash."""

    def __missing__(self, word):
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        self.put(word, h, len(word))
        return h


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    This cuts lineage: what comes after reads files every executor can reach,
    so a lost executor costs a re-read and row ids given once stay as they are.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ready(spark: SparkSession) -> None:
    """Python stages of the operators import vigil on the executors, and get their rows in bounded batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, parts: int):
    """crc32 of the id's decimal text modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def carried(docs: DataFrame, **keys) -> DataFrame:
    """The whole row as one column ``row`` beside key columns, so that no name of the input can clash; ``row.*`` gives it back."""
    return docs.select(F.struct("*").alias("row"), *[expr.alias(name) for name, expr in keys.items()])
