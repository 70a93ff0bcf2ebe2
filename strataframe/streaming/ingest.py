"""Continuous import: new files of a folder are parsed and upserted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..engine import Engine
from ..functions import text as T
from ..sources import markdown as S


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files that come into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)


def named(files: DataFrame, folder: str) -> DataFrame:
    """Files as ``sources.markdown.scan`` gives them."""
    root = "file:/" + folder.removeprefix("file:").strip("/") + "/"
    bare = F.regexp_replace("path", r"^file:/+", "file:/")
    rel = F.when(F.startswith(bare, F.lit(root)), F.substr(bare, F.lit(len(root) + 1))).otherwise(F.element_at(F.split(bare, "/"), -1))
    return files.select(rel.alias("path"), F.col("modificationTime").alias("modified"), "length", "content")


def import_stream(engine: Engine, folder: str, checkpoint: str) -> StreamingQuery:
    """Import what comes into a folder until the stream is stopped; each micro-batch is one commit.

    A batch that runs again upserts the same rows, so a restart changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        files = named(batch, folder).filter(F.lower("path").rlike(r"\.(md|markdown|txt)$"))
        rows = S.concepts(files).filter("error is null").drop("error").dropDuplicates(["id"])
        if not rows.isEmpty():
            with engine.store.writing(), engine.store.pinned():
                engine._write(rows)

    return stream_files(engine.spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, event_type, n, total) of a stream or table of events (ts, event_type, value), with a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_seen(texts: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream (ts, text) without texts that came before within ``late``."""
    keyed = texts.withColumn("sha", F.sha2(T.search_text(F.col("text")), 256)).withWatermark("ts", late)
    return keyed.dropDuplicatesWithinWatermark(["sha"])
