"""Embedding near-dedup with a pivot-permutation index.

Reference points (pivots) are vectors of the corpus, none near another. A vector is described by its ``NEAREST`` nearest
pivots in their order, nearest first. An inverted list of each pivot holds the vectors that name it, with its rank in their
orders. In a list the ``ASK`` nearest ranks ask and all answer; two vectors are candidates if they share ``SHARED`` pivots
or more, one of which either has among its ``ASK`` nearest, and each candidate is verified by its cosine in double precision.
As cosines of a list (a matrix product) are cheaper than counts, all that meet in it are verified, and nothing that is
verified is lost: one shared pivot is enough, and all ranks ask. Shared pivots of near pairs are then looked up to deal with
a pair in one list alone: that of the shared pivot whose two ranks have the least sum.

Equal vectors are one class with a representative and a count, so copies cost one entry. Lists give counts and spanning
edges back, never pairs. A list is cut into blocks of ``BLOCK`` rows, and a cell of two blocks is a unit of work, so that a
long list spreads over many tasks; a row goes to as many cells as its list has blocks.

The pivots are a sample whose bound is a parameter: ``most_pivots`` out of twice as many vectors, those of the least hash of
their id; there are ``PER_ROOT`` for each unit of the root of the rows, so lists grow as the root. All rows are indexed.
Recall is measured before: the sample's linked pairs, and pairs at a cosine of just ``COSINE`` made from it, must meet in
``RECALL`` of cases, else the index takes a quarter of the pivots, and so on; without enough of them, as in a narrow cone or
a table of near copies, one list of everything finds every link, and its work grows with the square of the classes.

Defined cases: a null vector, a zero vector, one that is empty or has null or non-finite components links with nothing and
is its own component; vectors of different lengths never link, and each length has its own lists; a null id links with
nothing and is kept; rows that repeat an id get one result, that of the least of their vectors (by its components); ties of pivots go
to the first; an empty table gives an empty result. Other input columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._links import bounded, components
from ._store import materialise, partitions, small_batches

COSINE = 0.9
NEAREST, ASK, SHARED = 8, 8, 1
MOST_PIVOTS = 16384
LEAST_PIVOTS = 128
#: Pivots for each unit of the square root of the number of vectors, within those bounds.
PER_ROOT = 8
#: Pivots have less than this cosine with each other.
APART = 0.7
RECALL = 0.96
#: Pairs that recall is measured on, of either kind.
MEASURED = 2048
BLOCK = 4096
TILE = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that very small and very large ones keep their direction."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of the sample (unit vectors) that are apart from those before."""
    kept = np.zeros((0, sample.shape[1]))
    for at in range(0, len(sample), 256):
        some = sample[at : at + 256]
        some = some[(some @ kept.T).max(1, initial=-1) < APART]
        among = some @ some.T
        chosen: list[int] = []
        for k in range(len(some)):
            if len(kept) + len(chosen) < most and (among[k, chosen] < APART).all():
                chosen.append(k)
        kept = np.vstack([kept, some[chosen]])
    return kept


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For unit vectors their ``NEAREST`` nearest pivots, nearest first."""
    far = -(x @ pivots.T)
    some = np.sort(np.argpartition(far, NEAREST - 1, axis=1)[:, :NEAREST], axis=1)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)


def meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For orders of pivots, row by row, the pivot in whose list the pair is dealt with; -1 if they aren't candidates."""
    ranks = np.arange(NEAREST)
    shared = a[:, :, None] == b[:, None, :]
    place = np.where(shared, (ranks[:, None] + ranks[None, :] << 40) + a[:, :, None], np.iinfo(np.int64).max).reshape(len(a), -1).argmin(1)
    i, j = np.divmod(place, NEAREST)
    return np.where((shared.sum((1, 2)) >= SHARED) & (np.minimum(i, j) < ASK), a[np.arange(len(a)), i], -1)


def measured(sample: np.ndarray, pivots: np.ndarray, cosine: float) -> float:
    """The least recall of pairs of the sample that are near, and of pairs at just ``cosine`` made from it."""
    if len(pivots) < 2 * NEAREST or not len(sample):
        return 0.0
    some = sample[:MEASURED]
    rng = np.random.default_rng(len(some))
    side = rng.normal(size=some.shape)
    side -= (side * some).sum(1)[:, None] * some
    length = np.linalg.norm(side, axis=1)[:, None]
    made = cosine * some + (1 - cosine * cosine) ** 0.5 * side / np.where(length > 0, length, 1)
    orders = nearest(some, pivots)
    found = [(meeting(orders, nearest(made, pivots)) >= 0).mean()] if sample.shape[1] > 1 else []
    i, j = np.nonzero(np.triu(some @ some.T >= cosine, 1))
    if len(i) >= 50:
        taken = rng.permutation(len(i))[:MEASURED]
        found.append((meeting(orders[i[taken]], orders[j[taken]]) >= 0).mean())
    return float(min(found, default=0.0))


def index_of(sample: np.ndarray, most: int, cosine: float = COSINE) -> np.ndarray:
    """The pivots of a sample of unit vectors, as many as keep recall; none if there aren't enough apart."""
    pivots = choose_pivots(sample, most)
    while len(pivots) >= 2 * NEAREST and measured(sample, pivots, cosine) < RECALL:
        pivots = pivots[: len(pivots) // 4]
    return pivots if len(pivots) >= 2 * NEAREST else pivots[:0]


def _settled(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links the least index that each row reaches."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(1)
        fresh = np.minimum(label, near)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _tile(key: int, x: np.ndarray, orders: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Verified links of two sets of rows as a matrix; only those whose list this is (all in a list of everything)."""
    linked = x[left] @ x[right].T >= cosine
    if left is right:
        linked &= np.tri(len(left), k=-1, dtype=bool)
    i, j = np.nonzero(linked) if key >= 0 else ((), ())
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        linked[a, b] = meeting(orders[left[a]], orders[right[b]]) == key
    return linked


def _cell(key: int, x: np.ndarray, orders: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(links of each row of the cell by weight, spanning edges): tile by tile, so that no matrix is larger than a tile."""
    counts, edges = np.zeros(len(x), np.int64), []
    alone = left is right
    asks = (orders[:, :ASK] == key).any(1) | (key < 0)
    left, right = (side[np.argsort(~asks[side], kind="stable")] for side in (left, right))  # rows that ask first
    cuts = [[side[at : at + TILE] for at in range(0, len(side), TILE)] for side in (left, right)]
    for p, one in enumerate(cuts[0]):
        for q, other in enumerate(cuts[1]):
            if alone and q > p:
                break
            same = alone and p == q
            other = one if same else other
            if not (asks[one].any() or asks[other].any()):
                continue
            linked = _tile(key, x, orders, one, other, cosine)
            if not linked.any():
                continue
            counts[one] += linked @ weight[other]
            counts[other] += weight[one] @ linked
            rows = one if same else np.concatenate((one, other))
            whole, shift = np.zeros((len(rows), len(rows)), bool), 0 if same else len(one)
            whole[: len(one), shift:] = linked
            label = _settled(whole | whole.T)
            moved = label < np.arange(len(rows))
            edges.append(np.stack([rows[moved], rows[label[moved]]]))
    return counts, edges


def _cells(cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        cell = np.stack([table.column(c).to_numpy() for c in ("key", "lo", "hi")], 1)
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)])
        for at, end in zip(starts, [*starts[1:], len(cell)]):
            key, lo, hi = cell[at].tolist()
            part = table.slice(at, end - at)
            ids, own, weight = (part.column(c).to_numpy() for c in ("id", "part", "n"))
            kind = np.float32 if part.column("narrow")[0].as_py() else np.float64
            x = unit(np.frombuffer(b"".join(part.column("vector").to_pylist()), kind).reshape(end - at, -1))
            orders = np.frombuffer(b"".join(part.column("order").to_pylist()), np.int32).reshape(end - at, -1).astype(np.int64)
            left = np.flatnonzero(own == lo)
            right = left if lo == hi else np.flatnonzero(own == hi)
            counts, edges = _cell(key, x, orders, weight, left, right, cosine)
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            a, b = np.concatenate(edges, axis=1)
            mark = np.r_[np.zeros(len(some), np.int32), np.ones(len(a), np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(np.r_[ids[some], ids[a]]), pa.array(np.r_[counts[some], ids[b]])], ["kind", "id", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a cell follow one another."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(c).to_numpy() for c in ("key", "lo", "hi")], 1)
            changes = np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1
            if held and tuple(held[-1].column(c)[-1].as_py() for c in ("key", "lo", "hi")) != tuple(cell[0].tolist()):
                yield from solve(pa.Table.from_batches(held))
                held = []
            if not len(changes):
                held.append(batch)
                continue
            yield from solve(pa.Table.from_batches([*held, batch.slice(0, changes[-1])]))
            held = [batch.slice(changes[-1])]
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def _vectors(good: DataFrame) -> DataFrame:
    """(id, v) with one row an id: of rows that repeat an id, the least vector."""
    repeated = materialise(good.groupBy("id").count().filter("count > 1").select("id"), "repeated")
    if repeated.isEmpty():
        return good
    ids = bounded(repeated)
    one = good.join(ids, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    return good.join(ids, "id", "left_anti").unionByName(one.withColumn("d", F.size("v")).select(*good.columns))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most_pivots: int = MOST_PIVOTS, cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``."""
    spark = vectors.sparkSession
    small_batches(spark)
    narrow = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    values = F.col(vector_col) if narrow else F.col(vector_col).cast("array<double>")
    fine = F.coalesce(
        (F.size(values) > 0)
        & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(values, lambda v: v != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), values.alias("v"), fine.alias("fine"))
    good = _vectors(rows.filter("fine and id is not null").select("id", "v", F.size("v").alias("d")))
    kind = np.float32 if narrow else np.float64

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # -0 is 0
            ends = np.cumsum(batch.column("d").to_numpy())
            raw, width = flat.tobytes(), np.dtype(kind).itemsize
            cut = [raw[width * a : width * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("d"), pa.array(cut, pa.binary())], ["id", "d", "vector"])

    stored = good.mapInArrow(coded, "id long, d int, vector binary").withColumn("print", F.sha2("vector", 256))
    stored = materialise(stored, "vectors")
    classes = materialise(stored.groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "classes")
    of_class = stored.join(bounded(classes), "print", "left")
    nodes = of_class.filter("rep is null or rep = id").select("id", "d", "vector", F.coalesce("n", F.lit(1)).alias("n"))
    count = nodes.count()
    alone = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not count:
        return alone
    want = min(most_pivots, max(LEAST_PIVOTS, int(PER_ROOT * count**0.5)))
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(2 * want).select("d", "vector").collect()  # bounded by the parameter
    of_length: dict[int, list[bytes]] = {}
    for r in sample:
        of_length.setdefault(r["d"], []).append(bytes(r["vector"]))
    pivots, base = {}, 0
    for d, found in sorted(of_length.items()):
        index = index_of(unit(np.frombuffer(b"".join(found), kind).reshape(-1, d)), want, cosine)
        if len(index):
            pivots[d] = (base, index)
            base += len(index)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, raw = batch.column("d").to_numpy(), batch.column("vector").to_pylist()
            keys: list[list[int]] = [[-int(d)] for d in lengths]  # without pivots: one list of everything of this length
            for d in np.unique(lengths).tolist():
                if d in pivots:
                    first, index = pivots[d]
                    mine = np.flatnonzero(lengths == d)
                    for at in range(0, len(mine), 512):
                        some = mine[at : at + 512]
                        found = nearest(unit(np.frombuffer(b"".join(raw[k] for k in some), kind).reshape(len(some), d)), index) + first
                        for k, row in zip(some.tolist(), found.tolist()):
                            keys[k] = row
            order = pa.array([np.array(k, np.int32).tobytes() for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n", "vector")), order, pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "vector", "order", "keys"])

    described = materialise(nodes.mapInArrow(describe, "id long, n long, vector binary, order binary, keys array<long>"), "orders")
    entries = described.select(F.explode("keys").alias("key"))
    lists = materialise(entries.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1"), "lists")
    placed = described.withColumn("key", F.explode("keys")).drop("keys").join(bounded(lists), "key")
    parts = F.ceil(F.col("rows") / BLOCK).cast("int")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = placed.select("key", F.least("part", "o").alias("lo"), F.greatest("part", "o").alias("hi"), "part", "id", "n", "vector", "order", F.lit(narrow).alias("narrow"))
    cells = cells.repartition(partitions(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")
    found = materialise(cells.mapInArrow(_cells(cosine), "kind int, id long, value long"), "links")

    counts = found.filter("kind = 0").groupBy("id").agg(F.sum("value").alias("links"))
    joined = components(found.filter("kind = 1").select(F.col("id").alias("a"), F.col("value").alias("b")))
    by_rep = counts.join(joined, "id", "left").select(F.col("id").alias("rep"), "links", F.col("component").alias("c"))
    of_id = of_class.select("id", F.coalesce("rep", "id").alias("rep"), (F.coalesce("n", F.lit(1)) - 1).alias("copies"))
    of_id = of_id.join(by_rep, "rep", "left").filter("copies > 0 or links is not null")
    of_id = of_id.select("id", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("c", "rep").alias("c"))
    linked = materialise(of_id, "linked")
    out = rows.filter("id is not null").select("id").join(linked, "id", "left")
    component = F.coalesce("c", "id")
    out = out.select("id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
    return out.union(alone.filter("id is null"))
