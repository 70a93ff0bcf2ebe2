"""The best text hits without reading a frequent word's entries whole: postings in levels of impact, read from the top.

An entry's impact is tf / (tf + k1 * (1 - b + b * dl / reference)), cut into ``LEVELS``. The index is sorted by term, level
and id, and a small table counts the entries of each term and level, so that a search knows from a few rows what a level can
add to a score at most, whatever the average length is by then. It reads the levels that can add most, and stops as soon as
no document that it hasn't met can be among the best; those met that may be are then looked up by term and id.

Ties go by id. Scores are rounded as those of the full ranking are, and rows are the same.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import sorted_by
from .rank import DIGITS, K1, B

LEVELS = 32
#: Entries that are read first, and by how much more each further time.
FIRST, GROWTH = 4096, 8
#: Documents that are looked up at most; while more may be among the best, more levels are read.
LOOKED = 256
#: More than what rounding and double precision can change in a score.
SLACK = 2e-6


def levelled(postings: DataFrame, reference: float) -> DataFrame:
    """(term, level, id, tf, dl) of ``postings``, each part sorted for writing; reference: about the average length of the texts."""
    impact = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(reference))))
    level = F.least(F.floor(impact * LEVELS), F.lit(LEVELS - 1)).cast("int")
    return postings.select("term", level.alias("level"), "id", "tf", "dl").sortWithinPartitions("term", "level", "id")


def counted(index: DataFrame, reference: float) -> DataFrame:
    """(term, level, n, reference): entries of each term and level, sorted for writing."""
    return sorted_by(index.groupBy("term", "level").agg(F.count("*").alias("n")), "term", "level").withColumn("reference", F.lit(float(reference)))


def _any(conditions: Sequence[Column]) -> Column:
    """Conditions joined by or, as a tree of small depth."""
    while len(conditions) > 1:
        conditions = [functools.reduce(operator.or_, conditions[k : k + 2]) for k in range(0, len(conditions), 2)]
    return conditions[0]


def _of_term(values: Mapping[str, float]) -> Column:
    """A number by term."""
    return functools.reduce(lambda sofar, t: sofar.when(F.col("term") == t, F.lit(values[t])), list(values)[1:], F.when(F.col("term") == next(iter(values)), F.lit(next(iter(values.values()))))).otherwise(F.lit(0.0))


def top(index: DataFrame, levels: DataFrame, totals: DataFrame, terms: Sequence[str], k: int, log: list[int] | None = None) -> DataFrame:
    """(id, score): the best ``k`` documents with one of ``terms`` or more, best first; what the full ranking gives.

    index: as ``levelled`` gives it; levels: as ``counted``; totals: (n, words). log: takes the entries of each reading.
    Terms that no text has add nothing, terms given twice count once, and without hits the result is empty.
    """
    sizes: dict[str, dict[int, int]] = {}
    reference = 1.0
    for r in levels.filter(F.col("term").isin(*dict.fromkeys(terms))).collect() if terms else []:  # LEVELS rows a term
        sizes.setdefault(r["term"], {})[r["level"]] = r["n"]
        reference = r["reference"]
    if not sizes or k < 1:
        return index.limit(0).select("id", F.lit(0.0).alias("score"))
    n, words = totals.first()
    average = words / n
    idf = {t: math.log((n - df + 0.5) / (df + 0.5) + 1) for t, df in ((t, sum(s.values())) for t, s in sizes.items())}
    weight = _of_term(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(average)))

    def most(term: str, level: int) -> float:
        """No entry of this level or a lower one adds more."""
        return idf[term] * (K1 + 1) / (1 + (LEVELS / (level + 1) - 1) * min(1.0, reference / average))

    steps = sorted(((-most(t, level), t, -level) for t, s in sizes.items() for level in s))
    at, want = 0, FIRST
    while True:
        read = sum(sizes[t][-level] for _, t, level in steps[:at])
        while at < len(steps) and (read < want or not at):
            read += sizes[steps[at][1]][-steps[at][2]]
            at += 1
        if log is not None:
            log.append(read)
        lowest, rest = {}, dict.fromkeys(sizes, 0.0)
        for _, t, level in steps[:at]:
            lowest[t] = -level
        for bound, t, _ in reversed(steps[at:]):
            rest[t] = -bound
        rows = index.filter(_any([(F.col("term") == t) & (F.col("level") >= level) for t, level in lowest.items()]))
        seen = rows.groupBy("id").agg(F.sum(weight).alias("part"), F.sum(_of_term(rest)).alias("met"))
        if at == len(steps):
            return _best(seen.select("id", F.col("part").alias("score")), k)
        unread = sum(rest.values())
        seen = seen.persist()  # asked twice
        try:
            best = [r["part"] for r in seen.select("part").orderBy(F.desc("part")).limit(k).collect()]
            if len(best) == k and unread < best[-1] - SLACK:
                may = seen.filter(F.col("part") + F.lit(unread) - F.col("met") >= best[-1] - SLACK).select("id").limit(LOOKED + 1).collect()
                if len(may) <= LOOKED:
                    found = index.filter(F.col("term").isin(*sizes) & _any([F.col("id") == F.lit(r["id"]) for r in may]))
                    return _best(found.groupBy("id").agg(F.sum(weight).alias("score")), k)
        finally:
            seen.unpersist()
        want *= GROWTH


def _best(scored: DataFrame, k: int) -> DataFrame:
    return scored.select("id", F.round("score", DIGITS).alias("score")).orderBy(F.desc("score"), "id").limit(k)
