"""A compressed vector index: cells with product-quantised residuals, look-ups by table, exact re-ranking.

Centres of cells and codebooks are fitted on a bounded sample of the table. Each vector has the cell of its nearest centre,
and what is left of it is cut into parts of ``WIDTH`` components, each coded by the nearest of up to 256 entries: one byte a
part. An inner product with a query is that with the centre, plus one look-up a part in a table that is made once a search.
A search ranks the codes of some cells by that, reads the vectors of the best few alone, and ranks these exactly. Stored by
cell in small row groups and pages, it reads neither other cells nor other vectors.

Each row also has the length of what its codes leave out (``rest``), so an inner product is at most that of the codes plus the
query's length times it. ``exact_nearest`` ranks every row that may reach the best found by the codes, and misses none.

Null vectors and those of another length have no cell, and a search never returns them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import _literal, knn

#: Rows that centres and codebooks are fitted on (the least hashes of their ids), and rounds of fitting.
SAMPLE, ROUNDS = 8192, 8
#: Components of a part, and entries of its codebook.
WIDTH, ENTRIES = 8, 256
#: Cells for each unit of the root of the rows, up to ``MOST_CELLS``; the share of them that a search looks into, and at least.
PER_ROOT, MOST_CELLS, SHARE, PROBES = 1.0, 4096, 1 / 8, 16
#: Vectors that are ranked exactly for each one that is asked for, and at least.
RERANK, LEAST_RERANK = 4, 64
#: Vectors of a table from which on an index pays.
LEAST_ROWS = 2048
#: More than rounding changes in an inner product of unit vectors.
SLACK = 2e-6
#: How the coded table is to be written, so that a search skips what it doesn't need.
LAYOUT = {"parquet.block.size": str(1 << 20), "parquet.page.row.count.limit": "32"}


@dataclass(frozen=True)
class Quantiser:
    """centres: (cells, components); books: (parts, entries, components of a part)."""

    centres: np.ndarray
    books: np.ndarray

    def probes(self, least: int = PROBES) -> int:
        return min(len(self.centres), max(least, math.ceil(len(self.centres) * SHARE)))

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row of ``x``, and its codes."""
        cell = _nearest(x, self.centres)
        rest = _parts(x - self.centres[cell])
        return cell, np.stack([_nearest(r, b) for r, b in zip(rest, self.books)], axis=1)

    def left(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The length of what the cell and the codes of each row of ``x`` leave out."""
        own = np.stack([b[c] for b, c in zip(self.books, codes.T)])
        return np.sqrt(((_parts(x - self.centres[cell]) - own) ** 2).sum(axis=(0, 2)))

    def rows(self) -> tuple[list[tuple], list[tuple]]:
        """(cell, centre) and (part, entry, values), to be stored."""
        books = [(p, e, v) for p, part in enumerate(self.books.tolist()) for e, v in enumerate(part)]
        return list(enumerate(self.centres.tolist())), books

    @staticmethod
    def of_rows(centres: Sequence[tuple], books: Sequence[tuple]) -> Quantiser | None:
        """From what ``rows`` gave; None without any."""
        if not centres or not books:
            return None
        ordered = [v for _, _, v in sorted(books, key=lambda b: (b[0], b[1]))]
        parts = 1 + max(b[0] for b in books)
        return Quantiser(np.array([c for _, c in sorted(centres, key=lambda c: c[0])], float), np.array(ordered, float).reshape(parts, len(books) // parts, -1))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    out = [np.argmax(x[k : k + 4096] @ centres.T - half, axis=1) for k in range(0, len(x), 4096)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _parts(x: np.ndarray) -> np.ndarray:
    """(parts, rows, WIDTH), filled up with zeros."""
    parts = -(-x.shape[1] // WIDTH)
    full = np.zeros((len(x), parts * WIDTH))
    full[:, : x.shape[1]] = x
    return full.reshape(len(x), parts, WIDTH).transpose(1, 0, 2)


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from the first rows; a centre that loses all rows stays where it is."""
    centres = x[:k].copy()
    for _ in range(ROUNDS):
        cell = _nearest(x, centres)
        n = np.bincount(cell, minlength=len(centres))
        sums = np.stack([np.bincount(cell, x[:, c], len(centres)) for c in range(x.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> Quantiser | None:
    """A quantiser of the table's vectors; None if there are none. The most frequent length of the sample rules."""
    some = vectors.filter(F.size(vector_col) > 0)
    n = some.count()
    rows = some.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select(vector_col).collect()
    if not rows:
        return None
    lengths = [len(r[0]) for r in rows]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), -d))
    x = np.array([[float(v or 0.0) for v in r[0]] for r in rows if len(r[0]) == dim])
    cells = max(1, min(MOST_CELLS, round(PER_ROOT * math.sqrt(n)), len(x)))
    centres = _means(x, cells)
    rest = _parts(x - centres[_nearest(x, centres)])
    return Quantiser(centres, np.stack([_means(r, min(ENTRIES, len(r))) for r in rest]))


def coded(vectors: DataFrame, quantiser: Quantiser, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, cell, code, rest, embedding) of the vectors; write it ``laid_out``."""
    dim = quantiser.centres.shape[1]

    @F.pandas_udf("cell int, code array<smallint>, rest double")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([*batch], float).reshape(len(batch), dim)
            cell, codes = quantiser.codes(x)
            yield pd.DataFrame({"cell": cell.astype("int32"), "code": [*codes.astype("int16")], "rest": quantiser.left(x, cell, codes)})

    own = vectors.filter(F.size(vector_col) == dim).select(F.col(id_col).alias("id"), F.transform(vector_col, lambda v: F.coalesce(v, F.lit(0)).cast("float")).alias("embedding"))
    return own.withColumn("c", code("embedding")).select("id", "c.cell", "c.code", "c.rest", "embedding")


def laid_out(rows: DataFrame):
    """A writer of coded rows, in ranges of cells with small row groups and pages."""
    return rows.repartitionByRange("cell").sortWithinPartitions("cell", "id").write.options(**LAYOUT)


def _any(terms: Iterable[str]) -> Column:
    """Alternatives written out, as lists of over ten values are pushed down as one range."""
    return F.expr(" or ".join(["false", *terms]))


def _table(values: np.ndarray) -> Column:
    """Numbers as one constant."""
    return F.split(F.lit(",".join(map(repr, values.ravel().tolist()))), ",").cast("array<double>")


def about(index: DataFrame, quantiser: Quantiser, query: np.ndarray, few: int, probes: int | None = None) -> DataFrame:
    """(id, cell, about): the best ``few`` of the nearest cells by their codes; neither vectors nor other cells are read."""
    near = quantiser.centres @ query
    cells = np.argsort(-near, kind="stable")[: quantiser.probes() if probes is None else probes].tolist()
    found = index.filter(_any(f"cell = {c}" for c in cells)).select("id", "cell", "code")
    return _looked_up(found, quantiser, query).select("id", "cell", "about").orderBy(F.desc("about"), "id").limit(few)


def _looked_up(rows: DataFrame, quantiser: Quantiser, query: np.ndarray) -> DataFrame:
    """``rows`` with ``about``: the inner product of the query with what their cells and codes stand for."""
    parts, entries, _ = quantiser.books.shape
    products = np.einsum("pew,pw->pe", quantiser.books, _parts(query[None])[:, 0])
    look = F.expr(" + ".join(f"get(table, {p * entries} + get(code, {p}))" for p in range(parts)))
    found = rows.withColumn("table", _table(products))
    return found.withColumn("about", F.get(_table(quantiser.centres @ query), F.col("cell")) + look).drop("table")


def nearest(index: DataFrame, quantiser: Quantiser, query: Sequence[float], k: int, probes: int | None = None, rerank: int | None = None) -> DataFrame:
    """(id, sim): about the ``k`` nearest by inner product among ``coded`` rows, exact for those it returns; ties by id."""
    q = _fitting(quantiser, query)
    of_cell: dict[int, list] = {}
    for r in about(index, quantiser, q, max(LEAST_RERANK, RERANK * k) if rerank is None else rerank, probes).collect():
        of_cell.setdefault(r.cell, []).append(r.id)
    chosen = (f"cell = {cell} and ({' or '.join(f'id = {_literal(i)}' for i in ids)})" for cell, ids in sorted(of_cell.items()))
    return knn(index.filter(_any(chosen)), q.tolist(), k)


def _fitting(quantiser: Quantiser, query: Sequence[float]) -> np.ndarray:
    q = np.zeros(quantiser.centres.shape[1])
    q[: len(query)] = [*query][: len(q)]
    return q


def exact_nearest(index: DataFrame, quantiser: Quantiser, query: Sequence[float], k: int) -> DataFrame:
    """(id, sim): the ``k`` nearest by inner product of all ``coded`` rows, as ``knn`` gives them; ties by id.

    The best by the codes give a value that ``k`` rows reach; of the others, those are ranked too that may reach it by their
    codes and what these leave out. One more pass over the codes; vectors that can't be among the nearest aren't multiplied.
    """
    q = _fitting(quantiser, query)
    sims = [r["sim"] for r in nearest(index, quantiser, q.tolist(), k, len(quantiser.centres)).collect()]  # k rows
    if len(sims) < k or k < 1:
        return knn(index, q.tolist(), k)
    most = F.col("about") + F.lit(float(np.linalg.norm(q))) * F.col("rest")
    may = _looked_up(index, quantiser, q).filter(most >= F.lit(sims[-1] - SLACK))
    return knn(may, q.tolist(), k)


def rows_scanned(frame: DataFrame) -> int:
    """Rows that the files of a frame give up when it is collected: what row groups and pages don't let readers skip."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = (leaves.apply(k).metrics().get("numOutputRows") for k in range(leaves.size()))
    return sum(m.get().value() for m in metrics if m.isDefined())
