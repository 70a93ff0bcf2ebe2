"""Codes of vectors: k-means codebooks for parts of vectors, fitted over anchors-hierarchy metric trees.

Each component becomes floor(scale * x), and all that follows is exact on those integers. A vector is cut into equal
consecutive parts, and each part position has its own codebook. Vectors are taken in blocks, where they lie; a block has one
metric tree a part position:

* some sqrt(n) anchors are set one after another, each at the point farthest from the anchor of the largest ball; a new one
  takes the points that are nearer to it, of which only those beyond half the distance between the two anchors need a look;
* from these anchors in the middle, balls are merged upwards, the pair of the smallest common ball first, and each anchor's
  points are divided downwards in the same way, down to ``LEAF`` points;
* each ball caches the sum and the count of its points.

A round walks the trees with the entries that may own something: a ball inherits its parent's candidates and drops those
that another one beats everywhere in it. When one is left, it owns the ball, and the cached sum and count are all that is
needed; other leaves look at their points. The trees are a table that all rounds read; what tasks return of a round is a
sum for each component of an entry, whatever the number of vectors.

Defined cases: rows whose vector is null or holds a null or non-finite component (or one beyond 2^400) are dropped. The kept
row of the least id (null ids last, then the lesser vector) sets the length; vectors of another length have null for code and
error. A length that ``parts`` doesn't divide is filled up with zeros; a vector of no components has code 0 throughout.
Codebooks start from the least ids' rows, repeated ids and equal vectors counted one by one; fewer kept rows than ``entries``
give as many entries as there are. Equal distances go to the lower index, so of equal entries the first owns all. Errors
beyond a long stop at its end. An empty table gives an empty result and no entries. Other columns, if kept, pass unread; of
those that bear the name of an added one, the added one stays.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ._store import materialise, shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and points of a ball that isn't divided.
BLOCK, LEAF = 4096, 24
#: What rounding may add to a distance.
SLACK = 1 + 1e-9
LIMIT, LONG = 2.0**400, 2**63 - 1


def exact(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as floats where sums of their squared differences stay exact in doubles, else as Python's integers."""
    grown = np.floor(values.astype(np.float64) * scale)
    most = float(np.abs(grown).max()) if grown.size else 0.0
    room = (2 * most) ** 2 * max(1, values.shape[-1]) < 2**52 and most * BLOCK < 2**52
    return grown if room else np.array([int(x) for x in grown.ravel()], object).reshape(grown.shape)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    return ((a - b) ** 2).sum(axis=-1)


def _lengths(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(squares).astype(np.float64)) * SLACK


class Tree:
    """Balls over the points of one part position.

    order: points, so that each ball's stand together in start..end; left, right: its halves, or -1; centre, reach, sums: of
    a ball's points, the root first.
    """

    def __init__(self, points: np.ndarray):
        self.points, self.balls = points, []
        self.order = np.zeros(0, np.int64)
        if len(points):
            floats = points.astype(np.float64)
            root = self._divided(floats, np.arange(len(points)))
            self._laid_out(root)

    def _ball(self, at: np.ndarray, halves: tuple = ()) -> dict:
        sums = self.points[at].sum(axis=0) if not halves else halves[0]["sums"] + halves[1]["sums"]
        n = len(at) if not halves else halves[0]["n"] + halves[1]["n"]
        centre = sums // n
        if halves:
            reach = max(float(_lengths(_squares(h["centre"], centre))) + h["reach"] for h in halves) * SLACK
        else:
            reach = float(_lengths(_squares(self.points[at], centre)).max())
        return {"at": at, "n": n, "sums": sums, "centre": centre, "reach": reach, "halves": halves}

    def _anchors(self, floats: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The points of each of some sqrt(n) anchors."""
        pivots, owner = [at[0]], np.zeros(len(at), np.int64)
        far = np.sqrt(((floats[at] - floats[at[0]]) ** 2).sum(axis=1))
        while len(pivots) < math.isqrt(len(at)):
            new = int(np.argmax(far))  # the farthest point of the largest ball
            if far[new] == 0:
                break
            between = np.sqrt(((floats[pivots] - floats[at[new]]) ** 2).sum(axis=1))
            look = np.flatnonzero(far > between[owner] / 2)
            near = np.sqrt(((floats[at[look]] - floats[at[new]]) ** 2).sum(axis=1))
            taken = near < far[look]
            owner[look[taken]], far[look[taken]] = len(pivots), near[taken]
            owner[new], far[new] = len(pivots), 0.0
            pivots.append(at[new])
        return [at[owner == k] for k in range(len(pivots)) if (owner == k).any()]

    def _divided(self, floats: np.ndarray, at: np.ndarray) -> dict:
        own = self._ball(at)
        if len(at) <= LEAF or own["reach"] == 0:
            return own
        anchors = self._anchors(floats, at)
        if len(anchors) == 1:
            return own
        top = self._merged([self._divided(floats, x) for x in anchors])
        if own["reach"] < top["reach"]:
            top["reach"] = own["reach"]
        return top

    def _merged(self, balls: list[dict]) -> dict:
        """One ball of all, from the pairs of the smallest common balls upwards."""
        balls = list(balls)
        centres = np.array([b["centre"] for b in balls]).astype(np.float64).reshape(len(balls), -1)
        reach = np.array([b["reach"] for b in balls])
        gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=-1))
        common = np.maximum((gaps + reach[:, None] + reach[None]) / 2, np.maximum(reach[:, None], reach[None]))
        np.fill_diagonal(common, np.inf)
        for _ in range(len(balls) - 1):
            a, b = divmod(int(np.argmin(common)), len(balls))
            ball = self._ball(np.zeros(0, np.int64), (balls[a], balls[b]))
            balls[a], reach[a] = ball, ball["reach"]
            centres[a] = ball["centre"].astype(np.float64)
            reach[b] = np.inf
            gap = np.sqrt(((centres - centres[a]) ** 2).sum(axis=1))
            row = np.maximum((gap + reach + reach[a]) / 2, np.maximum(reach, reach[a]))
            common[a], common[:, a] = row, row
            common[a, a] = np.inf
            common[b], common[:, b] = np.inf, np.inf
            last = a
        return balls[last]

    def _laid_out(self, root: dict) -> None:
        order, waiting = [], [(root, -1, "")]
        self.left, self.right, self.start, self.end = [], [], [], []
        placed = 0
        while waiting:
            ball, parent, side = waiting.pop()
            k = len(self.balls)
            self.balls.append(ball)
            self.left.append(-1)
            self.right.append(-1)
            self.start.append(placed)
            self.end.append(placed + ball["n"])
            if parent >= 0:
                (self.left if side == "left" else self.right)[parent] = k
            if ball["halves"]:
                waiting += [(ball["halves"][1], k, "right"), (ball["halves"][0], k, "left")]
            else:
                order.append(ball["at"])
                placed += ball["n"]
        self.order = np.concatenate(order)

    def written(self) -> dict:
        width = self.points.shape[1]
        table = lambda name: np.array([b[name] for b in self.balls], self.points.dtype).reshape(len(self.balls), width)
        links = np.array([self.left, self.right, self.start, self.end], np.int32).reshape(4, -1) if self.balls else np.zeros((4, 0), np.int32)
        return {"order": self.order.astype(np.int32), "links": links, "centre": table("centre"), "sums": table("sums"), "reach": np.array([b["reach"] for b in self.balls])}


class Walk:
    """The entry of each point of a tree, and what each entry owns: counts and sums. seen: distances taken."""

    def __init__(self, tree: dict, points: np.ndarray, entries: np.ndarray):
        n, k = len(points), len(entries)
        self.codes, self.counts, self.sums, self.seen = np.zeros(n, np.int64), np.zeros(k, np.int64), np.zeros(entries.shape, points.dtype), 0
        if not n:
            return
        left, right, start, end = tree["links"].tolist()
        between = _lengths(_squares(entries[:, None], entries[None]))
        first: dict[tuple, int] = {}
        for e, values in enumerate(entries.tolist()):
            first.setdefault(tuple(values), e)
        centre, reach, order = tree["centre"], tree["reach"], tree["order"]
        waiting = [(0, np.array(list(first.values())))]
        while waiting:
            ball, some = waiting.pop()
            if len(some) > 1:
                squares = _squares(entries[some], centre[ball])
                self.seen += len(some)
                best = int(np.argmin(squares))
                if reach[ball] == 0:
                    some = some[best : best + 1]
                else:
                    beaten = (squares - squares[best]).astype(np.float64) > 2 * reach[ball] * SLACK * between[some[best], some]
                    some = some[~beaten]
            if len(some) == 1:
                self.codes[start[ball] : end[ball]] = some[0]
                self.counts[some[0]] += end[ball] - start[ball]
                self.sums[some[0]] += tree["sums"][ball]
            elif left[ball] < 0:
                at = order[start[ball] : end[ball]]
                code = some[np.argmin(_squares(points[at][:, None], entries[some][None]), axis=1)]
                self.seen += len(at) * len(some)
                self.codes[start[ball] : end[ball]] = code
                self.counts += np.bincount(code, minlength=k)
                np.add.at(self.sums, code, points[at])
            else:
                waiting += [(right[ball], some), (left[ball], some)]
        back = np.empty(n, np.int64)
        back[order] = self.codes
        self.codes = back


@dataclass(frozen=True)
class Codebooks:
    """entries: for each part position its entries, each a tuple of integers; width: components of a vector; scale: units of 1."""

    entries: tuple
    width: int
    scale: int

    def sha256(self) -> str:
        """Of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()


def _alike(values: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Exact integers as floats, or as Python's integers."""
    return values if values.dtype == kind else np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def _array(entries: tuple, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and points in one kind of numbers that is exact for both."""
    width = points.shape[1]
    found = np.array([x for e in entries for x in e], object).reshape(len(entries), width)
    most = max((abs(x) for x in found.ravel()), default=0)
    if points.dtype != object and (2 * most) ** 2 * max(1, width) < 2**52:
        return found.astype(np.float64), points
    return found, _alike(points, np.dtype(object))


def _bytes(values: np.ndarray) -> bytes:
    """Integers, in four bytes each where that holds them, or as text."""
    if values.dtype == object:
        return b"t" + ",".join(map(str, values.ravel())).encode()
    small = not values.size or np.abs(values).max() < 2**31
    return (b"i" + values.astype(np.int32).tobytes()) if small else (b"d" + values.astype(np.float64).tobytes())


def _values(data: bytes, shape: tuple[int, ...]) -> np.ndarray:
    if data[:1] == b"t":
        return np.array([int(x) for x in data[1:].decode().split(",")], object).reshape(shape)
    return np.frombuffer(data, np.int32 if data[:1] == b"i" else np.float64, offset=1).astype(np.float64).reshape(shape)


TREE = StructType([StructField("order", BinaryType()), StructField("links", BinaryType()), StructField("centre", BinaryType()), StructField("sums", BinaryType()), StructField("reach", BinaryType())])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            more = min(BLOCK - n, batch.num_rows - at)
            held.append(batch.slice(at, more))
            at, n = at + more, n + more
            if n == BLOCK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), width)


def _parts(values: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, components), filled up with zeros."""
    n, width = values.shape
    each = -(-width // parts)
    full = np.zeros((n, parts * each), values.dtype)
    full[:, :width] = values
    return full.reshape(n, parts, each).transpose(1, 0, 2)


def forest(rows: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """(rows, n, points, trees): blocks of rows (row, vec) with the trees of their parts."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            points = _parts(exact(_matrix(block.column("vec"), width), scale), parts)
            trees = []
            for p in points:
                tree = Tree(np.ascontiguousarray(p)).written()
                trees.append({"order": tree["order"].tobytes(), "links": tree["links"].tobytes(), "centre": _bytes(tree["centre"]), "sums": _bytes(tree["sums"]), "reach": tree["reach"].tobytes()})
            held = block.column("row").combine_chunks()
            held = held if isinstance(held, pa.Array) else pa.concat_arrays(held.chunks)
            listed = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
            kind = pa.struct([(f.name, pa.binary()) for f in TREE])
            yield pa.RecordBatch.from_arrays(
                [listed, pa.array([len(held)], pa.int64()), pa.array([_bytes(points.reshape(parts, -1))], pa.binary()), pa.array([trees], pa.list_(kind))],
                ["rows", "n", "points", "trees"],
            )

    schema = StructType([StructField("rows", ArrayType(rows.schema["row"].dataType)), StructField("n", LongType()), StructField("points", BinaryType()), StructField("trees", ArrayType(TREE))])
    return rows.mapInArrow(grow, schema)


def _walks(batch: pa.RecordBatch, books: Codebooks, parts: int) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, np.ndarray, Walk]]]]:
    """For each block of a batch its rows, and for each part position points, entries and the walk."""
    each = -(-books.width // parts)
    for k in range(batch.num_rows):
        n = batch.column("n")[k].as_py()
        points = _values(batch.column("points")[k].as_py(), (parts, n, each))
        out = []
        for p, tree in enumerate(batch.column("trees")[k].as_py()):
            entries, own = _array(books.entries[p], points[p])
            links = np.frombuffer(tree["links"], np.int32).reshape(4, -1)
            held = {"order": np.frombuffer(tree["order"], np.int32), "links": links, "reach": np.frombuffer(tree["reach"], np.float64)}
            held |= {name: _alike(_values(tree[name], (links.shape[1], each)), own.dtype) for name in ("centre", "sums")}
            out.append((own, entries, Walk(held, own, entries)))
        yield batch.column("rows")[k].values, out


LIMB = 32


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, signed piece) of 32 bits each, so that sums of any integers are sums of longs."""
    sign, rest, k = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if rest & 0xFFFFFFFF:
            yield k, sign * (rest & 0xFFFFFFFF)
        rest, k = rest >> LIMB, k + 1


def _round(trees: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    """Entries moved to the means of what they own."""
    each = -(-books.width // parts)

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = defaultdict(int), defaultdict(int)
        for batch in batches:
            for _, walks in _walks(batch, books, parts):
                for p, (_, _, walk) in enumerate(walks):
                    for e in np.flatnonzero(walk.counts).tolist():
                        counts[p, e] += int(walk.counts[e])
                        for c in range(each):
                            sums[p, e, c] += int(walk.sums[e, c])
        rows = [(p, e, -1, 0, n) for (p, e), n in counts.items()] + [(p, e, c, k, x) for (p, e, c), v in sums.items() for k, x in _limbs(v)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["part", "entry", "component", "limb", "value"])

    found = trees.mapInArrow(owned, "part long, entry long, component long, limb long, value long").groupBy("part", "entry", "component", "limb").agg(F.sum("value").alias("value"))
    total, count = defaultdict(int), {}
    for r in found.collect():  # as many rows as all codebooks have components, and one an entry
        if r.component < 0:
            count[r.part, r.entry] = r.value
        else:
            total[r.part, r.entry, r.component] += r.value << (LIMB * r.limb)
    moved = [
        tuple(tuple(total[p, e, c] // count[p, e] for c in range(each)) if (p, e) in count else old for e, old in enumerate(part))
        for p, part in enumerate(books.entries)
    ]
    return Codebooks(tuple(moved), books.width, books.scale)


def compressed(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """Rows that have a vector with ``code`` (two hex digits a part) and ``error`` (squared distance), and the codebooks.

    entries: of a codebook, 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    shared_dir(rows.sparkSession)
    vec = F.col(vec_col)
    fine = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LIMIT))
    held = [c for c in rows.columns if c not in ("code", "error")]
    kept = rows.filter(F.coalesce(fine, F.lit(False))).select(F.struct(*(F.col(f"`{c}`") for c in held)).alias("row"), F.col(id_col).alias("id"), vec.cast("array<double>").alias("vec"))
    least = [F.col("id").asc_nulls_last(), F.col("vec")]
    first = kept.orderBy(*least).select(F.size("vec").alias("n")).first()
    width = first.n if first else 0
    fit = kept.filter(F.size("vec") == width)
    starts = [r.vec for r in fit.orderBy(*least).limit(entries).select("vec").collect()]
    cut = _parts(exact(np.array(starts, np.float64).reshape(len(starts), width), scale), parts)
    books = Codebooks(tuple(tuple(tuple(int(x) for x in e) for e in part) for part in cut), width, scale)
    trees = materialise(forest(fit.select("row", "vec"), width, parts, scale), "forest")
    for _ in range(rounds if starts else 0):
        books = _round(trees, books, parts)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, walks in _walks(batch, books, parts):
                codes = np.stack([w.codes for _, _, w in walks], axis=1).astype(np.uint8)
                error = sum(_squares(points, entries[w.codes]) for points, entries, w in walks)
                error = [min(int(x), LONG) for x in error]
                yield pa.RecordBatch.from_arrays([own, pa.array([x.tobytes().hex() for x in codes]), pa.array(error, pa.int64())], ["row", "code", "error"])

    schema = StructType([StructField("row", kept.schema["row"].dataType), StructField("code", StringType()), StructField("error", LongType())])
    other = kept.filter(F.size("vec") != width).select("row", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return trees.mapInArrow(coded, schema).union(other).select("row.*", "code", "error"), books
