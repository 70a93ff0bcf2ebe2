"""Hashes of directories from those of their children, kept up with changes alone.

A directory has the sum, in ``LANES`` lanes of 32 bits, of the digests of its children's names and hashes, and its own hash is
the digest of these sums. So it needs no list of children, whatever their number, and a change of one child is a subtraction
and an addition. Changes go up level by level; a directory whose hash stays ends there, and so do all above it that nothing
else changes. The top directory is ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise

LANES = 8


def _lanes(name: Column, hash_: Column) -> list[Column]:
    digest = F.sha2(F.concat(name, F.lit("\n"), hash_).cast("binary"), 256)
    return [F.coalesce(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long"), F.lit(0)) for k in range(LANES)]


def parent(path: Column) -> Column:
    """The directory of a path, '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def changes(directories: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, hash, lanes, n) of each directory that changes; hash and lanes are null for one that loses its last child.

    directories: (path, hash, lanes, n) as they were. changed: files (path, was, now) by hash, null where there was or is none.
    """
    entries = changed.select("path", "was", "now", (F.size(F.split("path", "/")) - 1).alias("depth"))
    entries = materialise(entries.filter(~F.col("was").eqNullSafe(F.col("now"))), "entries")
    deepest = entries.agg(F.max("depth")).first()[0]
    if deepest is None:
        return directories.select("path", "hash", "lanes", "n").limit(0)
    above, found = None, None
    for depth in range(deepest, -1, -1):
        here = entries.filter(F.col("depth") == depth).select("path", "was", "now")
        here = here if above is None else here.union(above)
        name = F.element_at(F.split("path", "/"), -1)
        was, now = _lanes(name, F.col("was")), _lanes(name, F.col("now"))
        differs = (F.col("now").isNotNull().cast("long") - F.col("was").isNotNull().cast("long")).alias("more")
        each = here.select(parent(F.col("path")).alias("dir"), differs, *((b - a).alias(f"d{k}") for k, (a, b) in enumerate(zip(was, now))))
        moved = each.groupBy("dir").agg(F.sum("more").alias("more"), *(F.sum(f"d{k}").alias(f"d{k}") for k in range(LANES)))
        old = directories.select(F.col("path").alias("dir"), "hash", "lanes", "n")
        sums = F.array(*(F.coalesce(F.get("lanes", F.lit(k)), F.lit(0)) + F.col(f"d{k}") for k in range(LANES)))
        fresh = moved.join(old, "dir", "left").select("dir", F.col("hash").alias("was"), sums.alias("lanes"), (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"))
        left = F.col("n") > 0
        fresh = fresh.select("dir", "was", F.when(left, F.sha2(F.array_join("lanes", ","), 256)).alias("hash"), F.when(left, F.col("lanes")).alias("lanes"), "n")
        fresh = materialise(fresh.filter(~F.col("was").eqNullSafe(F.col("hash"))), "level")
        found = fresh if found is None else found.union(fresh)
        above = fresh.filter("dir <> ''").select(F.col("dir").alias("path"), "was", F.col("hash").alias("now"))
    return found.select(F.col("dir").alias("path"), "hash", "lanes", "n")


def directories(files: DataFrame) -> DataFrame:
    """(path, hash, lanes, n) of all directories above files (path, hash)."""
    none = files.sparkSession.createDataFrame([], "path string, hash string, lanes array<bigint>, n bigint")
    return changes(none, files.select("path", F.lit(None).cast("string").alias("was"), F.col("hash").alias("now")))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path): directories whose hash isn't the same in two states; none if the top ones are equal."""
    top = [r[0] for x in (a, b) for r in x.filter("path = ''").select("hash").collect()]
    both = a.select("path", F.col("hash").alias("was")).join(b.select("path", F.col("hash").alias("now")), "path", "full_outer")
    both = both.filter(~F.col("was").eqNullSafe(F.col("now"))).select("path")
    return both.limit(0) if len(top) == 2 and top[0] == top[1] else both
