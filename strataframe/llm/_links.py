"""Components of verified links, and look-ups by id, without gathering anything on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialise

#: Ids up to this many (about 16 MB) are broadcast to a scan; beyond it they are joined by shuffle.
BROADCAST_IDS = 1 << 20


def bounded(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` with a broadcast hint if its rows are counted as ``most`` at most, else as it is."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in ``links`` (a, b); component: the smallest id reachable.

    Each round takes the smallest label of all neighbours and then the label of that label, so chains halve. Every round
    is a table in the shared folder; what is joined is read from such tables, so skewed keys can be split.
    """
    pairs = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    edges = materialise(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = materialise(
        edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels"
    )
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).select(F.col("a").alias("id"), "label", F.lit(None).cast("long").alias("own"))
        best = (
            near.union(labels.select("id", "label", F.col("label").alias("own")))
            .groupBy("id")
            .agg(F.min("label").alias("label"), F.max("own").alias("own"))
        )
        jump = labels.select(F.col("id").alias("at"), F.col("label").alias("further"))
        step = best.join(jump, F.col("label") == F.col("at"), "left")
        fresh = materialise(step.select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "own"), "labels")
        labels = fresh.select("id", "label")
        if fresh.filter("label <> own").isEmpty():
            return labels.withColumnRenamed("label", "component")
