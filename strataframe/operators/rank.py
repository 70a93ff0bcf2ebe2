"""Vector and text ranking, their fusion, and ranking by links.

No operator ranks all rows in one task: top-k is taken by a heap in each task, and where a fused candidate needs its place
among all text hits, the hits are counted against the few candidates in one partial aggregation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from decimal import ROUND_HALF_UP, Decimal

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T
from ..functions import vectors as V

K1, B, RRF = 1.2, 0.75, 60
#: Best hits among which those that may be returned are looked for first.
PREFIX = 1024
#: Chosen hits whose places are counted in one pass.
COUNTED = 128
DIGITS = 6


def knn(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, sim): the ``k`` nearest by inner product (of unit vectors: cosine); ties by id. Exact."""
    sim = F.round(V.dot_with(vector_col, query), DIGITS)
    return vectors.select(F.col(id_col).alias("id"), sim.alias("sim")).orderBy(F.desc("sim"), "id").limit(k)


def bm25(docs: DataFrame, terms: Sequence[str], id_col: str = "id", text: str | Column = "text") -> DataFrame:
    """(id, score) of documents with one of ``terms`` or more.

    Term counts are taken in place, so the statistics are one row and nothing is shuffled by document.
    """
    terms = list(dict.fromkeys(terms))
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lowered = docs.select(F.col(id_col).alias("id"), F.lower(body).alias("t"))
    counts = [T.n_of_token(F.col("t"), w).alias(f"tf{k}") for k, w in enumerate(terms)]
    counted = lowered.select("id", T.n_tokens(F.col("t")).alias("dl"), *counts)
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("av"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))))
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        weight = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("av")))
        score = score + F.when(tf > 0, weight).otherwise(0.0)
    hit = F.greatest(*(F.col(f"tf{k}") for k in range(len(terms))), F.lit(0)) > 0
    return counted.filter(hit).crossJoin(F.broadcast(stats)).select("id", F.round(score, DIGITS).alias("score"))


def _places(hits: DataFrame, chosen: Sequence[tuple[float, object]]) -> list[int]:
    """The places of some ``chosen`` hits (-score, id), in order, among all ``hits`` (id, score), best first, ties by id."""
    above = [f"count_if(score > {-s!r}D or (score = {-s!r}D and id <= {_literal(i)}))" for s, i in chosen]
    counts: list[int] = []
    for at in range(0, len(above), COUNTED):  # one row for so many of the chosen
        counts += hits.agg(*(F.expr(c).alias(f"c{k}") for k, c in enumerate(above[at : at + COUNTED]))).first()
    return counts


def _literal(value: object) -> str:
    """A number or text in SQL."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{int(value)}L"


def _eighth(x: float) -> float:
    """Rounded to eight digits as SQL does."""
    return float(Decimal(repr(x)).quantize(Decimal("1e-8"), ROUND_HALF_UP))


def _best(hits: DataFrame, limit: int, allowed: DataFrame | None, per: str | None, cap: int) -> dict:
    """Of hits that may be returned the best ``limit``, of each ``per`` at most ``cap``: {id: (per, score)}.

    The first ``PREFIX`` hits are enough unless filters or caps leave too few of them; then all hits are joined.
    """
    if allowed is None:
        return {r["id"]: (r["id"], r["score"]) for r in hits.orderBy(F.desc("score"), "id").limit(limit).collect()}
    may = allowed.select("id", F.col(per or "id").alias("__per"))
    top = hits.orderBy(F.desc("score"), "id").limit(PREFIX)
    out, taken = {}, Counter()
    for r in sorted(may.join(F.broadcast(top), "id").collect(), key=lambda r: (-r["score"], r["id"])):
        taken[r["__per"]] += 1
        if len(out) < limit and (not per or taken[r["__per"]] <= cap):
            out[r["id"]] = r["__per"], r["score"]
    if len(out) < limit:
        every = hits.join(may, "id")
        every = capped(every, "__per", cap, "score") if per else every
        out = {r["id"]: (r["__per"], r["score"]) for r in every.orderBy(F.desc("score"), "id").limit(limit).collect()}
    return out


def fuse(near: DataFrame, hits: DataFrame, limit: int, allowed: DataFrame | None = None, per: str | None = None, cap: int = 3) -> DataFrame:
    """(id, rrf): the best ``limit`` by reciprocal ranks of vectors (id, sim) and all text hits (id, score).

    near: the nearest few, as ``knn`` gives them. allowed: ids (distinct) that may be returned; ranks are taken before this
    filter. per: a column of ``allowed`` of which each value may be returned ``cap`` times. All hits above one outrank it,
    so of hits that aren't near only the best ``limit``, capped, can be returned, and what meets on the driver is bounded by
    ``limit`` and what is near. Jobs that don't need each other run side by side: vectors and the best hits, then the scores
    of what is near and whether it may be returned, then the places.
    """
    spark = near.sparkSession
    hits = hits.persist()  # read by each job
    columns = ["id", *([per] if per else [])]
    try:
        with ThreadPoolExecutor(2) as pool:
            ask = lambda f: pool.submit(inheritable_thread_target(spark)(f))
            best = ask(lambda: _best(hits, limit, allowed, per, cap))
            vectors = [r["id"] for r in near.orderBy(F.desc("sim"), "id").collect()]
            scores = ask(lambda: {r["id"]: r["score"] for r in hits.filter(F.col("id").isin(vectors)).collect()} if vectors else {})
            group = {i: i for i in vectors}
            if allowed is not None and vectors:
                group = {r[0]: r[-1] for r in allowed.filter(F.col("id").isin(vectors)).select(*columns).collect()}
            score_of = scores.result() | {i: s for i, (_, s) in best.result().items()}
            group |= {i: g for i, (g, _) in best.result().items()}
        found = sorted((-s, i) for i, s in score_of.items() if i in group)
        place_of = {i: k for (_, i), k in zip(found, _places(hits, found))}
    finally:
        hits.unpersist()
    rank_of = {i: k for k, i in enumerate(vectors, 1)}
    score = {i: _eighth((1 / (RRF + rank_of[i]) if i in rank_of else 0.0) + (1 / (RRF + place_of[i]) if i in place_of else 0.0)) for i in group}
    out, taken = [], Counter()
    for i in sorted(group, key=lambda i: (-score[i], i)):
        taken[group[i]] += 1
        if not per or taken[group[i]] <= cap:
            out.append((i, group[i], score[i]) if per else (i, score[i]))
    fields = [near.schema["id"], *([allowed.schema[per]] if per else [])]
    return spark.createDataFrame(out[:limit], StructType([*(StructField(f.name, f.dataType) for f in fields), StructField("rrf", DoubleType())]))


def capped(ranked: DataFrame, per: str, most: int, score: str = "rrf", id_col: str = "id") -> DataFrame:
    """At most ``most`` rows of each ``per``, the best first."""
    place = F.row_number().over(Window.partitionBy(per).orderBy(F.desc(score), id_col))
    return ranked.withColumn("__place", place).filter(F.col("__place") <= most).drop("__place")


def hub_scores(edges: DataFrame, rel: str = "LINKS_TO") -> DataFrame:
    """(id, hub): incoming links of each node that has any."""
    return edges.filter(F.col("rel") == rel).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("hub"))


def hub_blend(results: DataFrame, hubs: DataFrame, parent: str, weight: float = 0.3, score: str = "rrf") -> DataFrame:
    """``results`` with hub and final = (1 - weight) * score + weight * hub / greatest hub of the results."""
    joined = results.join(hubs.withColumnRenamed("id", parent), parent, "left").withColumn("hub", F.coalesce("hub", F.lit(0)))
    most = joined.agg(F.greatest(F.coalesce(F.max("hub"), F.lit(1)), F.lit(1)).alias("__most"))  # one row
    final = (1 - weight) * F.col(score) + weight * F.col("hub") / F.col("__most")
    return joined.crossJoin(F.broadcast(most)).withColumn("final", F.round(final, 8)).drop("__most")


def hub_multiply(results: DataFrame, hubs: DataFrame, parent: str, score: str = "rrf") -> DataFrame:
    """``results`` with hub and final = score * (1 + hub / 10)."""
    joined = results.join(hubs.withColumnRenamed("id", parent), parent, "left").withColumn("hub", F.coalesce("hub", F.lit(0)))
    return joined.withColumn("final", F.round(F.col(score) * (1 + F.lit(0.1) * F.col("hub")), 8))


def any_tag(tags: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def all_tags(tags: Column, wanted: Sequence[str]) -> Column:
    return F.forall(F.array(*map(F.lit, wanted)), lambda t: F.array_contains(tags, t))


def below(concept: Column, parent: str, depth: int) -> Column:
    """Whether a concept lies in the subtree of a directory, at most ``depth`` steps down."""
    rest = F.substr(concept, F.lit(len(parent) + 2))
    return concept.startswith(parent + "/") & (F.size(F.split(rest, "/")) <= depth)


def not_reserved(concept: Column) -> Column:
    return ~(concept.endswith("index") | concept.endswith("log"))


def concept_filter(concepts: DataFrame, type_: str | None = None, tags: Sequence[str] = (), parent: str | None = None, exclude_reserved: bool = True, depth: int = 3) -> DataFrame:
    """Concepts that a search may return."""
    out = concepts
    if type_ is not None:
        out = out.filter(F.col("type") == type_)
    if tags:
        out = out.filter(any_tag(F.col("tags"), tags))
    if parent is not None:
        out = out.filter(below(F.col("id"), parent, depth))
    return out.filter(not_reserved(F.col("id"))) if exclude_reserved else out
