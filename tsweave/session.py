"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tsweave", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores) if str(cores).isdigit() else "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folder of each local application that names none.
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder of this machine is used only in local mode with the
    setting absent; on a cluster that would lose data with the machine. The
    session's settings are not touched.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = "file:" + os.path.join(tempfile.mkdtemp(prefix="tsweave-"), "shared")
    return _LOCAL_DIRS[app]


def run_dir(spark: SparkSession) -> str:
    """The folder in the shared one that holds all tables this application has written."""
    return f"{shared_dir(spark)}/tsweave-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the run's folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete the run's folder. Frames that read from it cannot be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes that travel to a Python worker at once: Spark's default, and what is set in its place. Executors hold a batch for
#: each running task beside their heap, and the worker holds it once more.
BATCH, DEFAULT_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def bound_batches(spark: SparkSession) -> None:
    """Set the session's limit on the bytes of an Arrow batch where it has Spark's default."""
    if spark.conf.get(BATCH, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH, BATCH_BYTES)


@contextmanager
def written_tables(spark: SparkSession) -> Iterator[str]:
    """A block at whose end every table that the application wrote for itself is deleted."""
    try:
        yield run_dir(spark)
    finally:
        release(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result no longer depends on the plan that made it, survives the loss of
    executors, and still prunes columns and pushes filters.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written once to the shared folder, in buckets by ``key``: grouping the result by it shuffles nothing.

    Spark knows buckets by a table's entry in the catalog; it is dropped again, and the files stay in the run's folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    entry = "tsweave_" + uuid.uuid4().hex
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return out
