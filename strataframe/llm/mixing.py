"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Sources in code-point order, null last, get the weights in turn and share all words in proportion; no source's target is
over ``MOST`` times its size, and what is over goes to the others by weight. A source's documents all expect target / size
copies. They are laid out by size, which keeps the words taken near the target, their expected copies are summed up in
this order, one offset is added, and a document is emitted once for each whole number that its step crosses.

The prefix sums are taken in three levels, so that no task gets a source: over the distinct sizes of a source, over the
``SALTS`` salts of a size, and over the documents of a salt.

Defined cases: a null or blank text has size 0, and a text of any length is one document; null is a source of its own, told
apart from one with an empty name; a source without words has target 0 and takes nothing; rows that repeat an id, and null
ids, which come first, are rows of their own; rows of equal size and id are laid out by a hash of their text. Of input
columns that bear the name of an added one, the added one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialise

WEIGHTS = (1, 2, 3)
MOST = 3
SALTS = 1024
SEED = 20240229
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "copies", "taken")


def offset_of(seed: int) -> float:
    """The random offset, in [0, 1), of a seed."""
    return (seed * 0x9E3779B97F4A7C15 % 2**64 >> 11) / 2**53


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, nil, source_size, target) from (source, nil, source_size): one row a source in and out.

    In the order of most * size / weight, the sources at their limit come first; the level of the others, by weight, is
    the greatest that is at or below a source's own limit when those before it are at theirs.
    """
    ordered = Window.orderBy("nil", "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("w", weight).withColumn("limit", F.col("source_size") * most)
    ranked = ranked.withColumn("at", F.col("limit") / F.col("w"))
    before = Window.orderBy("at", "nil", "source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("at", "nil", "source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    levels = ranked.withColumn("level", rest / F.sum("w").over(after))
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(Window.partitionBy()), F.lit(0.0))
    target = F.least(F.col("limit").cast("double"), F.col("w") * level)
    return levels.select("source", "nil", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies * size)."""
    held = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED))
    sized = held.select(
        "*",
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"),
        F.col(source_col).isNull().alias("__nil"),
        F.xxhash64(text_col).alias("__tie"),
        F.pmod(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)), F.lit(SALTS)).alias("__salt"),
    )
    cells = materialise(sized.groupBy("__source", "__nil", "size", "__salt").agg(F.count("*").alias("n")), "cells")
    names = [F.col("__source").alias("source"), F.col("__nil").alias("nil")]
    by_size = cells.groupBy(*names, "size").agg(F.sum("n").alias("n"))
    of_source = targets(by_size.groupBy("source", "nil").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)
    in_source = Window.partitionBy("source", "nil").orderBy("size")
    starts = by_size.select("source", "nil", "size", (F.sum("n").over(in_source) - F.col("n")).alias("at")).join(of_source, ["source", "nil"])
    in_size = Window.partitionBy("__source", "__nil", "size").orderBy("__salt")
    salts = cells.withColumn("within", F.sum("n").over(in_size) - F.col("n")).drop("n")
    starts = starts.toDF("__source", "__nil", "size", "__at", "source_size", "target")
    places = salts.join(starts, ["__source", "__nil", "size"]).withColumn("__at", F.col("__at") + F.col("within")).drop("within")

    order = Window.partitionBy("__source", "__nil", "size", "__salt").orderBy(id_col, "__tie")
    rows = sized.withColumn("__k", F.row_number().over(order)).join(places, ["__source", "__nil", "size", "__salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank, u = F.col("__at") + F.col("__k"), F.lit(offset_of(seed))
    copies = F.least(F.floor(u + rate * rank) - F.floor(u + rate * (rank - 1)), F.lit(most))
    return rows.withColumn("copies", copies.cast("long")).select(
        *(F.col(f"`{c}`") for c in held.columns), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """Each row of ``mix`` as often as it is taken, without the added columns."""
    rows = mixed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.drop("__copy", *ADDED)


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS nil,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size
  FROM documents),
sources AS (SELECT source, nil, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
ranked AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY nil, source) - 1) % 3 AS w, {MOST} * source_size AS cap FROM sources),
placed AS (SELECT *, cap::DOUBLE / w AS edge FROM ranked),
levels AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY edge, nil, source
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (ORDER BY edge, nil, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level
  FROM placed),
targets AS (
  SELECT source, nil, source_size,
         least(cap::DOUBLE, w * coalesce(max(CASE WHEN level <= edge THEN level END) OVER (), 0)) AS target
  FROM levels),
laid AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY s.source, s.nil ORDER BY s.size, s.doc_id % {SALTS}, s.doc_id) AS k
  FROM sized s JOIN targets t USING (source, nil))
SELECT doc_id, size, source_size, target,
       (size * (floor('{offset_of(SEED)!r}'::DOUBLE + rate * k) - floor('{offset_of(SEED)!r}'::DOUBLE + rate * (k - 1))))::BIGINT AS taken
FROM laid
"""
