"""Session helpers: local sessions for tests, and cutting lineage safely."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def local_session(app: str = "famloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Single-machine session for tests and the benchmark; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, choosing one only for local runs.

    A cluster names its shared folder in ``spark.checkpoint.dir``.  Without that
    setting a temporary folder is used, but only when the master is local.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="spark-checkpoints-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table in the checkpoint folder and read it back.

    This cuts the lineage, survives lost executors, and gives the next plan true
    sizes to choose its joins from.
    """
    folder = ensure_checkpoint_dir(df.sparkSession)
    path = f"{folder}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[stored] = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`durable` that no later plan reads."""
    for table in tables:
        path = _PLACES.pop(table, None)
        if path is not None:
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
