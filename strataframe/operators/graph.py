"""Walks, paths and listings over an edge table (rel, src, dst, dst_label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import bounded, materialise

RELATIONS = ("CONTAINS", "LINKS_TO", "PART_OF", "INCLUDES_ASSET")
TARGET = {"PART_OF": "Chunk", "INCLUDES_ASSET": "ImageAsset"}


def _checked(rels: Sequence[str], depth: int, most: int) -> int:
    unknown = set(rels) - set(RELATIONS)
    if unknown:
        raise ValueError(f"no relation {sorted(unknown)}; there are {RELATIONS}")
    return max(1, min(most, depth))


def _steps(edges: DataFrame, rels: Sequence[str], direction: str) -> DataFrame:
    chosen = edges.filter(F.col("rel").isin(*rels))
    out, back = chosen.select("src", "dst", "dst_label"), chosen.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction == "OUTGOING":
        return out
    label = F.when(F.lit("CONTAINS" in rels) & ~F.col("dst").contains("doc_"), "Directory").otherwise("Concept")
    back = back.withColumn("dst_label", label)
    return back if direction == "INCOMING" else out.union(back)


def traverse(edges: DataFrame, start: str, rel: str, direction: str = "OUTGOING", depth: int = 1, any_target: bool = False, walks: bool = False) -> DataFrame:
    """(id, depth) of nodes reached; depth: of the shortest walk, or of each walk if ``walks``.

    Nodes of other labels than the relation's target are walked through but not returned, unless ``any_target``. Without
    ``walks`` each level drops what an earlier one has, so the frontier never has more rows than there are nodes.
    """
    checked([rel], direction)
    return walk(_steps(edges, [rel], direction), start, rel, depth, any_target, walks)


def checked(rels: Sequence[str], direction: str) -> None:
    """An error for relations and directions that there aren't."""
    _checked(rels, 1, 1)
    if direction not in ("OUTGOING", "INCOMING", "BOTH"):
        raise ValueError(f"no direction {direction!r}")


def walk(steps: DataFrame, start: str, rel: str, depth: int = 1, any_target: bool = False, walks: bool = False) -> DataFrame:
    """``traverse`` over ``steps`` (src, dst, dst_label)."""
    depth = _checked([rel], depth, 5)
    reached = steps.filter(F.col("src") == start).select(F.col("dst").alias("id"), "dst_label")
    found, seen = None, None
    for level in range(1, depth + 1):
        if level > 1:
            # a frontier without repeated ids only chooses, and what only chooses is pushed down to the stored rows
            reached = steps.join(frontier, F.col("src") == F.col("id"), "inner" if walks else "left_semi").select(F.col("dst").alias("id"), "dst_label")
        if not walks:
            reached = reached.distinct().filter(F.col("id") != start)
            reached = reached if seen is None else reached.join(seen, "id", "left_anti")
        if level < depth:  # the next level and the result read it: made once, the plan doesn't grow with the depth
            reached = materialise(reached, "level")  # its size is known, so joins broadcast it while it is small
        at = reached.withColumn("depth", F.lit(level))
        found = at if found is None else found.union(at)
        if level < depth:
            if reached.isEmpty():
                break
            frontier = reached.select("id")
            seen = frontier if seen is None else seen.union(frontier)
    if not any_target:
        found = found.filter(F.col("dst_label") == TARGET.get(rel, "Concept"))
    return found.select("id", "depth")


def steps_of(edges: DataFrame, rels: Sequence[str] = RELATIONS) -> DataFrame:
    """(src, dst) of these relations, either way."""
    _checked(rels, 1, 1)
    return _steps(edges, rels, "BOTH").select("src", "dst")


def distances(steps: DataFrame, start: str, most: int = 6, goal: str | None = None) -> list[DataFrame]:
    """Breadth-first levels over ``steps`` (src, dst) from ``start``, each (id, parent): level k holds what k steps reach first.

    A level is written once, and the walk stops when it is empty or has the goal; parents are the least id.
    """
    most = max(1, min(10, most))
    levels = [steps.sparkSession.createDataFrame([(start, None)], "id string, parent string")]
    seen = None
    for _ in range(most):
        near = steps.filter(F.col("src") == start) if seen is None else steps.join(levels[-1].select("id"), F.col("src") == F.col("id"))
        nexts = near.filter(F.col("dst") != start).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        nexts = nexts if seen is None else nexts.join(seen, "id", "left_anti").select("id", "parent")
        level = materialise(nexts, "level")  # its size is known, so joins broadcast it while it is small
        if level.isEmpty():
            break
        levels.append(level)
        seen = level.select("id") if seen is None else seen.union(level.select("id"))
        if goal is not None and not level.filter(F.col("id") == goal).isEmpty():
            break
    return levels


def _grown(steps: DataFrame, levels: list[DataFrame], sizes: list[int]) -> None:
    """Add the next level to ``levels``, and its rows to ``sizes``."""
    seen = levels[0].select("id")
    for level in levels[1:]:
        seen = seen.union(level.select("id"))
    near = steps.join(bounded(levels[-1].select("id")), F.col("src") == F.col("id"), "left_semi").groupBy(F.col("dst").alias("next")).agg(F.min("src").alias("parent"))
    fresh = near.join(seen, F.col("next") == F.col("id"), "left_anti").select(F.col("next").alias("id"), "parent")
    levels.append(materialise(fresh, "level"))
    sizes.append(levels[-1].count())


def two_sided(steps: DataFrame, a: str, b: str, most: int = 6) -> tuple[list[DataFrame], list[DataFrame]]:
    """Breadth-first levels (id, parent) from both ends over ``steps`` that go either way, the smaller frontier grown.

    The last levels meet if there is a path of at most ``most`` steps; as many steps as both have grown. Else one is empty
    or they have grown ``most`` steps.
    """
    spark = steps.sparkSession
    there, back = ([spark.createDataFrame([(x, None)], "id string, parent string")] for x in (a, b))
    sizes = [1], [1]
    while len(there) + len(back) - 2 < max(0, min(10, most)):
        side = 0 if (sizes[0][-1], len(there)) <= (sizes[1][-1], len(back)) else 1
        _grown(steps, (there, back)[side], sizes[side])
        if not sizes[side][-1] or not there[-1].join(back[-1].select("id"), "id", "left_semi").isEmpty():
            break
    return there, back


def find_path(steps: DataFrame, a: str, b: str, most: int = 6) -> list[str]:
    """The least shortest path over ``steps`` (src, dst; either way), both ends included; [] if there is none of ``most`` steps.

    Of several, the one whose nodes are least, compared from ``b`` backwards.
    """
    if a == b:
        return [a]
    there, back = two_sided(steps, a, b, most)
    meet = materialise(there[-1].join(back[-1].select("id"), "id", "left_semi").select("id"), "meet")
    if meet.isEmpty():
        return []
    # from where they meet on to b: only nodes that lie on shortest paths, each with its least predecessor
    onward = [meet]
    for level in back[-2::-1]:
        reached = steps.join(bounded(onward[-1].select("id")), F.col("src") == F.col("id"), "left_semi").groupBy(F.col("dst").alias("next")).agg(F.min("src").alias("parent"))
        onward.append(materialise(reached.join(level.select("id"), F.col("next") == F.col("id")).select("id", "parent"), "onward"))
    path = [b]
    for level in (*onward[:0:-1], *there[:0:-1]):
        path.append(level.filter(F.col("id") == path[-1]).select("parent").first()[0])
    return path[::-1]


def ancestry(concepts: DataFrame, nearest_only: bool = False) -> DataFrame:
    """(id, depth, ancestor): directories of each concept from the root on, or the nearest alone."""
    parts = F.split("id", "/")
    depth = F.size(parts) - 1
    levels = F.when(depth > 0, F.sequence(depth if nearest_only else F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    each = concepts.select("id", parts.alias("p"), F.explode(levels).alias("depth"))
    return each.select("id", "depth", F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("ancestor"))


def parent_of(id_col: str = "id"):
    return F.regexp_replace(F.when(F.col(id_col).contains("/"), F.col(id_col)).otherwise(F.concat(F.lit("/"), F.col(id_col))), r"/[^/]*$", "")


def siblings(concepts: DataFrame, concept: str, limit: int = 5) -> DataFrame:
    """(id, title) of concepts in the same directory; of root-level ones for a root-level concept."""
    home = concept.rsplit("/", 1)[0] if "/" in concept else ""
    near = concepts.filter((parent_of() == home) & (F.col("id") != concept))
    return near.select("id", "title").orderBy("id").limit(limit)


def list_directory(concepts: DataFrame, directories: DataFrame, at: str | None = None) -> DataFrame:
    """(ordinal, id, type): direct children, directories first; without ``at`` those of the root."""
    home = parent_of() == (at or "")
    dirs = directories.filter(home).select(F.lit(0).alias("ordinal"), "id", F.lit("Directory").alias("type"))
    return dirs.unionByName(concepts.filter(home).select(F.lit(1).alias("ordinal"), "id", "type")).orderBy("ordinal", "id")


def expand(chunk_ids: DataFrame, chunks: DataFrame, edges: DataFrame, concepts: DataFrame, hops: int = 1, most: int = 50, hubs: DataFrame | None = None) -> DataFrame:
    """(id, title, description, hub): concepts that the chunks' documents link to, within ``hops``, by incoming links.

    hubs: (id, hub) of all concepts; counted here if not given.
    """
    links = edges.filter("rel = 'LINKS_TO'").select("src", "dst")
    front = chunk_ids.join(chunks.select("chunk_id", "parent_doc_id"), "chunk_id").select(F.col("parent_doc_id").alias("id")).distinct()
    found = None
    for _ in range(max(1, hops)):
        front = links.join(front, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        found = front if found is None else found.union(front).distinct()
    hubs = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("hub")) if hubs is None else hubs
    named = concepts.select("id", "title", F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("description"))
    return found.join(named, "id").join(hubs, "id").orderBy(F.desc("hub"), "id").limit(most)


def neighbours(edges: DataFrame, ids: DataFrame, limit: int = 5) -> DataFrame:
    """(id, side, other): at most ``limit`` linked concepts on each side of each of ``ids``."""
    links = edges.filter("rel = 'LINKS_TO'")
    sides = links.select(F.col("dst").alias("id"), F.lit("incoming").alias("side"), F.col("src").alias("other")).union(
        links.select(F.col("src").alias("id"), F.lit("outgoing").alias("side"), F.col("dst").alias("other"))
    )
    near = sides.join(bounded(ids), "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("id", "side").orderBy("other"))
    return near.withColumn("place", place).filter(F.col("place") <= limit).drop("place")
