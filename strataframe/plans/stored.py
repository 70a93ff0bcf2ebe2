"""What searches read, built once for a folder of tables: postings, vectors, chunks with their documents, edges.

The build is kept in the session's shared folder under a fingerprint of the files, so that later queries of the session find
it, and changed files are never answered from an old one. Queries then read the entries of their terms only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import scratch
from ..functions import text as T
from ..functions import vectors as V
from ..operators import impact as L
from ..operators import index as X
from ..operators import quantised as Q
from .views import TABLES, Inputs

DIM = 64


def _chunk(q: Inputs) -> DataFrame:
    meta = q.concept.select(F.col("id").alias("parent_doc_id"), "title", "type", "tags")
    rows = q.chunk.select(F.col("chunk_id").alias("id"), "parent_doc_id", "chunk_index", "chunk_text", "block_type")
    return rows.join(meta, "parent_doc_id", "left").sortWithinPartitions("parent_doc_id", "chunk_index")


def _chunk_vector(q: Inputs) -> DataFrame:
    return X.wide(q.chunk.select(F.col("chunk_id").alias("id"), V.hashed("chunk_text", DIM).alias("embedding")), DIM)


def _concept_text():
    return T.search_text(F.col("title"), F.col("description"), F.col("body"))


def _steps(q: Inputs) -> DataFrame:
    return X.sorted_by(stored(q, "edge").select("src", "dst").union(stored(q, "edge").select("dst", "src")), "src", "dst")


def _quantiser_rows(q: Inputs) -> DataFrame:
    cells, books = Q.fit(q.embeddings, "vec_id").rows()
    rows = [(None, *c) for c in cells] + [(p, e, v) for p, e, v in books]
    return q.spark.createDataFrame(rows, "part int, number int, centre array<double>")


def quantiser(q: Inputs) -> Q.Quantiser:
    """What is fitted on the vectors of the folder."""
    rows = stored(q, "quantiser").collect()  # bounded by the quantiser
    return Q.Quantiser.of_rows([(n, c) for p, n, c in rows if p is None], [tuple(r) for r in rows if r.part is not None])


def _average(q: Inputs, grain: str) -> float:
    n, words = stored(q, f"{grain}_stats").first()
    return max(1.0, words / n) if n else 1.0


def _impact(grain: str, texts: Callable[[Inputs], DataFrame]) -> dict[str, Callable[[Inputs], DataFrame]]:
    """texts: (id, text) of the grain."""
    return {
        f"{grain}_impact": lambda q: L.levelled(X.postings(texts(q)), _average(q, grain)),
        f"{grain}_level": lambda q: L.counted(stored(q, f"{grain}_impact"), _average(q, grain)),
    }


#: How each table is made.
BUILT: dict[str, Callable[[Inputs], DataFrame]] = {
    "document_posting": lambda q: X.segments(q.documents, "doc_id"),
    "document_stats": lambda q: X.stats(X.lengths(q.documents, "doc_id")),
    "concept_posting": lambda q: X.segments(q.concept, "doc_id", _concept_text()),
    "concept_stats": lambda q: X.stats(X.lengths(q.concept, "doc_id", _concept_text())),
    "vector": lambda q: q.embeddings.select("vec_id", "embedding"),
    "quantiser": _quantiser_rows,
    "vector_cell": lambda q: Q.coded(q.embeddings, quantiser(q), "vec_id"),
    "concept_meta": lambda q: q.concept.drop("body"),
    "chunk": _chunk,
    "chunk_posting": lambda q: X.segments(q.chunk, "chunk_id", "chunk_text"),
    "chunk_stats": lambda q: X.stats(X.lengths(q.chunk, "chunk_id", "chunk_text")),
    "chunk_vector": _chunk_vector,
    "edge": lambda q: X.sorted_by(q.edge, "rel", "src"),
    "steps": _steps,
    **_impact("document", lambda q: X.dealt(q.documents, "doc_id")),
    **_impact("chunk", lambda q: X.dealt(q.chunk, "chunk_id", "chunk_text")),
}

_FOUND: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def stored(q: Inputs, name: str) -> DataFrame:
    """The table of this name over the files as they are now."""
    spark: SparkSession = q.spark
    if q.fingerprint is None:
        q.fingerprint = scratch.fingerprint(spark, q.folder, [f"{t}.parquet" for t in TABLES])
    key = (spark.sparkContext.applicationId, q.fingerprint, name)
    if key not in _FOUND:
        made = BUILT[name](q)
        path = f"{scratch.session_dir(spark)}/index-{q.fingerprint}/{name}"
        writer = Q.laid_out(made) if name.endswith("_cell") else made.write
        writer.mode("overwrite").parquet(path)
        _FOUND[key] = path, made.schema
    path, schema = _FOUND[key]
    return spark.read.schema(schema).parquet(path)
