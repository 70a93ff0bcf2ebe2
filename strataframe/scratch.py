"""Tables that a session needs for a while, in a folder that all machines share.

The folder is the one that the session names in ``spark.checkpoint.dir``; where it is absent on a local master (tests, a
laptop), a temporary folder is set, and on a cluster that is an error. A lost executor costs no rows, as the tables are files.
They lie in one folder of the session, which goes when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; set here only where the session has none and its executors are threads."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="strataframe-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def file_system(spark: SparkSession, folder: str) -> tuple[JavaObject, JavaObject]:
    """Hadoop's path of a folder and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def session_dir(spark: SparkSession) -> str:
    """The folder of this session's tables; it goes when the JVM ends."""
    folder = f"{shared_dir(spark)}/strataframe-{spark.sparkContext.applicationId}"
    path, files = file_system(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def clear(spark: SparkSession) -> None:
    """Delete all tables of this session; frames that read them can't be used any more."""
    path, files = file_system(spark, session_dir(spark))
    files.delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table of this session and return a scan of it.

    The scan has no lineage before the files. An empty frame keeps its schema.
    """
    path = f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(rows: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``rows`` with a broadcast hint if they are counted as ``most`` at most, else as they are."""
    from pyspark.sql import functions as F

    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def fingerprint(spark: SparkSession, folder: str, names: list[str]) -> str:
    """What tells that files below ``folder`` have changed: their names, sizes and times, as one text."""
    import hashlib

    out = []
    for name in names:
        path, files = file_system(spark, f"{folder}/{name}")
        if files.exists(path):
            found = files.listStatus(path)
            out += sorted(f"{name}/{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in found)
    return hashlib.sha256("\n".join([folder, *out]).encode()).hexdigest()[:24]
