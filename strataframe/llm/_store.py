"""Shared scratch tables.

Intermediate results that are read more than once, and every cut of lineage, are Parquet tables in the folder that the
session names in ``spark.checkpoint.dir``: all executors and the driver share it, so a lost executor costs no rows.
Where the setting is absent on a local master (tests), a temporary folder of the driver is set; on a cluster that is an
error. The tables of a session lie in one folder, which goes when the driver's JVM ends, or earlier by ``clear``.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows and bytes that a Python worker gets at once; a longer single row comes alone.
BATCH_ROWS = 1000
BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 16 << 20


#: Python workers keep one heap, from which Arrow's buffers come as well, so that idle ones hold less.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def small_batches(spark: SparkSession) -> None:
    """Bound the memory that batches of long texts take; a smaller setting of the session stays."""
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    for setting, most in ((BATCH_SETTING, BATCH_ROWS), (BYTES_SETTING, BATCH_BYTES)):
        now = spark.conf.get(setting)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(setting, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; set here only where the session has none and its executors are threads."""
    small_batches(spark)
    found = spark.conf.get(SETTING, None)
    if not found:
        found = spark.sparkContext.getConf().get(SETTING)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="strataframe-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> tuple[str, JavaObject, JavaObject]:
    """The folder of this session's tables, as text, Hadoop path and file system; it goes when the JVM ends."""
    folder = f"{shared_dir(spark)}/strataframe-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder, path, files


def clear(spark: SparkSession) -> None:
    """Delete all tables of this session; frames that read them can't be used any more."""
    _, path, files = _own_dir(spark)
    files.delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it.

    The scan has no lineage before the files. An empty frame keeps its schema.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)[0]}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The shuffle partitions the session asks for; the number of blocks and buckets follows it."""
    small_batches(spark)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
