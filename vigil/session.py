"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "vigil") -> SparkSession:
    """Session for tests and the local bench; a cluster passes its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.default.parallelism", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VIGIL_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    keep_compiled(spark)
    return spark


#: Bytes of a method beyond which the JVM interprets it for good.
_JIT_BYTES = 8_000


def keep_compiled(spark: SparkSession) -> None:
    """Rows of 79 features pass through methods that the JVM compiles.

    Spark fuses the expressions of a stage into one method of up to 64 kB, but
    HotSpot never compiles one above 8 kB. Beyond that Spark is told to project
    by split methods instead, with the same results. A session that sets a
    limit of its own keeps it.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > _JIT_BYTES and key not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set(key, _JIT_BYTES)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets this to a shared file system; only when it is unset (local
    tests) do we create a scratch folder of our own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="vigil-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def folder(spark: SparkSession, name: str) -> str:
    """A new folder on the shared checkpoint storage."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared checkpoint folder and read back.

    Cuts lineage, survives executor loss, leaves nothing in executor memory, and
    tells the optimizer the size in bytes, by which it decides on broadcasts.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A file of at most so many bytes is one partition of ``stored_by_rows``.
_FILE_BYTES = 1 << 30


def stored_by_rows(df: DataFrame, rows: int, name: str = "table") -> DataFrame:
    """``stored`` with at most ``rows`` rows in a partition, whatever their bytes.

    Spark ML keeps rows of a fit in memory many times as wide as in their files,
    so partitions cut by file bytes are too large for it. Files are written with
    at most ``rows`` rows and read one to a partition: by a session of its own,
    as the reader takes its partition size from the session.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    reader = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            reader.conf.set(key, value)
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        reader.conf.set(key, _FILE_BYTES)
    return reader.read.schema(df.schema).parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vigil`` importable in Python workers (``addPyFile`` of a zip), and wide rows compiled (``keep_compiled``).

    The driver may import the package from a path the workers do not have;
    Spark then distributes the zip to every executor, as ``--py-files`` does.
    The zip is written once per application into the checkpoint folder when
    that is a local path, else into a driver scratch folder (addPyFile uploads it).
    """
    import zipfile

    keep_compiled(spark)
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    ckpt = ensure_checkpoint_dir(spark)
    base = ckpt[len("file:"):] if ckpt.startswith("file:") else ckpt
    folder = base if "://" not in base and os.path.isdir(base) else tempfile.mkdtemp(prefix="vigil-pkg-")
    path = os.path.join(folder, f"vigil-{app}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("vigil", os.path.relpath(full, pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(app)
