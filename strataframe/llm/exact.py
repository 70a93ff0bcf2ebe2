"""Exact dedup by skew-safe combining.

Texts are equal when nothing but white space tells them apart. Rows get a digest of the text without white space, and only
texts whose digest occurs more than once are compared:

1. each task combines its own rows of one content (the map side of the first grouping);
2. rows of one digest are dealt to salts by the task that they come from, and each salt combines what its tasks have sent;
3. the winners of the salts are combined to one row a content.

With as many salts as the root of the number of tasks, nobody receives more than about that many rows of one content,
however often it is repeated. The content itself is a key of each grouping beside its digest, so texts of one digest that
differ stay apart at every stage. A row then finds its group by digest; rows of a digest with several contents by content
as well.

Of equal texts the row of most code points stays, then the one of the least id, a null id last.

Defined cases: a null text is an empty one, and so equals a text of white space alone; a text of any length counts whole;
of rows that repeat id, length and content only one stays; groups of null ids have ``keep_id`` null; an empty table gives
an empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._links import bounded
from ._store import materialise, shared_dir

#: Digests up to this many (some 10 MB) are broadcast; beyond it they are joined by shuffle.
FEW = 1 << 17
#: ``[\x20\x09-\x0D]``
SPACES = " \t\n\v\f\r"


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return functools.reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _combined(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, content, best, size) of rows (id, n, digest, content), through salts."""
    best = F.struct(F.col("n"), F.bitwise_not("id").alias("before"))
    dealt = rows.select("digest", "content", best.alias("best"), (F.spark_partition_id() % salts).alias("salt"))
    winners = dealt.groupBy("digest", "salt", "content").agg(F.max("best").alias("best"), F.count("*").alias("size"))
    return winners.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("size").alias("size"))


def _decided(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """What becomes of rows (id, n, row, and those of ``by``); one without a group is alone."""
    best = (F.col("n") == F.col("best.n")) & F.bitwise_not("id").eqNullSafe(F.col("best.before"))
    winners = materialise(rows.join(bounded(groups, FEW), by).filter(best).select(*by, "row"), "winners")
    ends = materialise(groups.join(winners.groupBy(*by).agg(F.min("row").alias("first")), by), "ends")
    alone = F.col("first").isNull()
    return rows.join(bounded(ends, FEW), by, "left").select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.bitwise_not("best.before")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first") == F.col("row"))).alias("kept"),
        "digest",
    )


def equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) of each row; ids are integers.

    digest: of a text without white space, as binary; one that takes different texts for the same costs time, not rows.
    """
    shared_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.char_length(text).alias("n"), normalised(text).alias("content"))
    texts = texts.withColumn("digest", digest(F.col("content")))
    marks = materialise(texts.select("id", "n", "digest", F.monotonically_increasing_id().alias("row")), "marks")
    tasks = 1 + (marks.agg(F.max(F.shiftright("row", 33))).first()[0] or 0)
    salts = 1 + math.isqrt(tasks)
    often = materialise(marks.groupBy("digest").count().filter("count > 1").select("digest"), "often")
    few = often.limit(FEW + 1).count() <= FEW
    # beyond that the join deals rows by digest, and the table frees them from it
    repeated = texts.join(F.broadcast(often), "digest", "left_semi") if few else materialise(texts.join(often, "digest", "left_semi"), "repeated")
    groups = materialise(_combined(repeated, salts).select("digest", "best", "size"), "groups")
    mixed = materialise(groups.groupBy("digest").count().filter("count > 1").select("digest"), "mixed")
    if mixed.isEmpty():
        return _decided(marks, groups, ["digest"])
    # digests that stand for several contents: their rows find their group by content as well
    some = bounded(mixed, FEW)
    whole = materialise(texts.join(some, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "whole")
    apart = _decided(whole, materialise(_combined(whole, salts), "contents"), ["digest", "content"])
    plain = _decided(marks.join(some, "digest", "left_anti"), groups.join(some, "digest", "left_anti"), ["digest"])
    return plain.union(apart)
