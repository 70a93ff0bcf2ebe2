"""Edges both ways and hub counts, kept as signed rows.

An edge is a sum of contributions: each concept gives one to the edges of its path, its chunks and its assets, and a link
gives one while both ends exist. A commit appends what has changed, +1 or -1, and the sum is what there is now. So a change
costs its own size, in whatever order commits come, and directories go with their last concept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import bounded

EDGE = ("rel", "src", "dst", "dst_label")


def owned(concepts: DataFrame, chunks: DataFrame, includes: DataFrame) -> DataFrame:
    """What concepts (id), their chunks (parent_doc_id, id) and assets (src, dst) give to edges (rel, src, dst, dst_label)."""
    parts = F.split("id", "/")
    upto = lambda k: F.array_join(F.slice("p", F.lit(1), k), "/")
    levels = F.when(F.size("p") > 1, F.sequence(F.lit(2), F.size("p"))).otherwise(F.array().cast("array<int>"))
    each = concepts.select("id", parts.alias("p")).select("id", "p", F.explode(levels).alias("k"))
    label = F.when(F.col("k") == F.size("p"), "Concept").otherwise("Directory")
    paths = each.select(F.lit("CONTAINS"), upto(F.col("k") - 1), upto(F.col("k")), label)
    held = chunks.select(F.lit("PART_OF"), "parent_doc_id", "id", F.lit("Chunk"))
    shown = includes.select(F.lit("INCLUDES_ASSET"), "src", "dst", F.lit("ImageAsset"))
    return paths.union(held).union(shown).toDF(*EDGE)


def links(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Links of raw ones (src, target) whose target is among ``known`` (id)."""
    there = raw.select("src", "target").distinct().join(known.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
    return there.select(F.lit("LINKS_TO"), "src", "target", F.lit("Concept")).toDF(*EDGE)


def link_change(raw: DataFrame, fresh_raw: DataFrame, known: DataFrame, fresh: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links that come, links that go) when the concepts of ``lost`` (id) go and ``fresh`` (id) with their raw links come.

    Only raw links from or to a concept of ``lost`` are looked at.
    """
    raw, some = raw.select("src", "target"), bounded(lost.select(F.col("id").alias("__lost")))
    to = raw.join(some, F.col("target") == F.col("__lost"), "left_semi")
    of = raw.join(some, F.col("src") == F.col("__lost"), "left_semi")
    still = to.join(some, F.col("src") == F.col("__lost"), "left_anti").union(fresh_raw.select("src", "target"))
    left = known.select("id").join(some, F.col("id") == F.col("__lost"), "left_anti").union(fresh.select("id"))
    return links(still, left), links(to.union(of), known)


def change(come: DataFrame, go: DataFrame) -> DataFrame:
    """Signed rows both ways (node, rel, way, other, label, n) of edges that come and go; what cancels out is left out."""
    both = come.select(*EDGE, F.lit(1).alias("n")).union(go.select(*EDGE, F.lit(-1).alias("n")))
    net = both.groupBy(*EDGE).agg(F.sum("n").alias("n")).filter("n <> 0")
    ways = F.array(
        F.struct(F.col("src").alias("node"), F.lit("out").alias("way"), F.col("dst").alias("other"), F.col("dst_label").alias("label")),
        F.struct(F.col("dst").alias("node"), F.lit("in").alias("way"), F.col("src").alias("other"), F.when(F.col("rel") == "CONTAINS", "Directory").otherwise("Concept").alias("label")),
    )
    return net.select("rel", "n", F.explode(ways).alias("e")).select("e.node", "rel", "e.way", "e.other", "e.label", "n")


def hub_change(changed: DataFrame) -> DataFrame:
    """(id, n): how the counts of incoming links change with rows of ``change``."""
    return changed.filter("rel = 'LINKS_TO' and way = 'in'").groupBy(F.col("node").alias("id")).agg(F.sum("n").alias("n"))


def edges(adjacency: DataFrame) -> DataFrame:
    """(rel, src, dst, dst_label) from summed rows."""
    return adjacency.filter("way = 'out' and n > 0").select("rel", F.col("node").alias("src"), F.col("other").alias("dst"), F.col("label").alias("dst_label"))


def steps(adjacency: DataFrame, rels: tuple[str, ...] | None = None, direction: str = "BOTH") -> DataFrame:
    """(src, dst, dst_label) from summed rows, by what leaves a node."""
    way = {"OUTGOING": ["out"], "INCOMING": ["in"], "BOTH": ["out", "in"]}[direction]
    chosen = adjacency.filter(F.col("way").isin(way) & (F.col("n") > 0))
    chosen = chosen if rels is None else chosen.filter(F.col("rel").isin(*rels))
    return chosen.select(F.col("node").alias("src"), F.col("other").alias("dst"), F.col("label").alias("dst_label"))
