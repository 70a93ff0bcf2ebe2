"""MinHash near-dedup with min-max hashing.

A document is the set of its distinct five-word shingles. Under each of ``PERMUTATIONS`` permutations of the 64-bit
hashes both the least and the greatest value are kept, so the 128 signature values cost 64 evaluations per shingle; both
ends agree between two sets with their Jaccard similarity. A band is both ends under two permutations. Documents that
share a band are candidates, and each link is confirmed on the full sets.

Large groups stay cheap: equal sets are one class, found by a 128-bit fingerprint, and only its representative goes on;
every member of a band is compared with the band's smallest id; only members of a band that are then still in different
components meet each other, in a join whose condition bounds the similarity by the shingles that no other such
document has, and then compares four bits of each value of the signature and of a longer one that only they get. A pair of
similarity s shares no band with probability (1 - s^4)^32, 5e-6 at s = 0.75, and there falls short of ``AGREE`` or
``AGREE_FURTHER`` with about the same probability.

Defined cases: a null or blank text is an empty set and links with nothing; a text of fewer than five words is one
shingle; a text of any length counts whole, and its signature is no longer than others; a null id links with nothing and is
kept; rows that repeat an id are one document, linked by any of its texts; a component's id is its least, so there are no
ties; an empty table gives an empty result. Other input columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._links import bounded, components
from ._store import materialise, small_batches
from ._words import U64, Words, mixed, run_hashes, slices

SHINGLE = 5
PERMUTATIONS = 64
BANDS = 32
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Of the 128 signature values, those whose last four bits must agree before the full sets are compared.
AGREE = 76

#: The members of open bands meet with a second signature of so many permutations; so many of its values must agree.
FURTHER = 256
AGREE_FURTHER = 348

_MULTIPLY = mixed(np.arange(1, PERMUTATIONS + FURTHER + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_FLIP = mixed(np.arange(1, PERMUTATIONS + FURTHER + 1, dtype=U64) * U64(0xD1B54A32D192ED03))


def shingle_sets(texts: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after another, offsets)."""
    words = Words(texts, fold=True)
    counts = words.counts
    runs = np.where(counts >= length, counts - length + 1, counts > 0)
    offsets = np.concatenate(([0], np.cumsum(runs)))
    at = np.arange(offsets[-1]) + np.repeat(words.first[:-1] - offsets[:-1], runs)
    found = run_hashes(words.hashes(), at, np.repeat(np.minimum(counts, length), runs))
    for a, b in zip(offsets[:-1][runs > 1], offsets[1:][runs > 1]):
        found[a:b].sort()
    fresh = np.ones(len(found), bool)
    fresh[1:] = found[1:] != found[:-1]
    fresh[offsets[:-1][runs > 0]] = True
    return found[fresh], np.concatenate(([0], np.cumsum(fresh)))[offsets]


def _ends(sets: np.ndarray, offsets: np.ndarray, permutations: range) -> Iterator[np.ndarray]:
    """For each permutation the least, then the greatest value of each set that isn't empty."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    for k in permutations if len(starts) else ():
        dealt = (sets ^ _FLIP[k]) * _MULTIPLY[k]
        for ends in (np.minimum, np.maximum):
            yield mixed(ends.reduceat(dealt, starts))


def _planes(values: np.ndarray) -> np.ndarray:
    """Four bits of each value; for each 64 values four words, of which the k-th has bit k of each."""
    out = np.zeros((len(values) // 64 * 4, values.shape[1]), U64)
    for at, value in enumerate(values):
        for plane in range(4):
            out[at // 64 * 4 + plane] |= (value >> U64(plane) & U64(1)) << U64(at % 64)
    return out.T


def signatures(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set that isn't empty a row of ``BANDS`` keys, and its values of four bits."""
    n = int((np.diff(offsets) > 0).sum())
    values = np.array([*_ends(sets, offsets, range(PERMUTATIONS))], U64).reshape(2 * PERMUTATIONS if n else 0, n)
    keys = np.zeros((BANDS, n), U64)
    for at, value in enumerate(values):
        band = at * BANDS // len(values)
        keys[band] = mixed((keys[band] ^ value) + U64(band + 1))
    return keys.T, _planes(values)


def _lists(rows: np.ndarray, full: np.ndarray) -> pa.Array:
    """A list column; texts with an empty set have an empty list."""
    width = rows.shape[1]
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(full * width))), pa.int32()), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel())
    )


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets, offsets = shingle_sets(part.column("text"))
            n = np.diff(offsets)
            full = n > 0
            starts = offsets[:-1][full]
            prints = [np.zeros(len(n), np.int64) for _ in range(2)]
            for p, salt in zip(prints, (0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
                if len(starts):
                    p[full] = np.add.reduceat(mixed(sets ^ U64(salt)), starts).view(np.int64)
            keys, short = signatures(sets, offsets)
            columns = [part.column("id"), pa.array(n, pa.int64()), *(pa.array(p, mask=~full) for p in prints), _lists(keys, full), _lists(short, full)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "p1", "p2", "bands", "short"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for half in slices(batch, "ta"):
            for part in slices(half, "tb"):
                sides = []
                for who, text in (("a", "ta"), ("b", "tb")):
                    _, one, inverse = np.unique(part.column(who).to_numpy(), return_index=True, return_inverse=True)
                    sets, offsets = shingle_sets(part.column(text).take(pa.array(one)))
                    sides.append((sets, offsets, inverse))
                (s, so, si), (t, to, ti) = sides
                linked = np.zeros(part.num_rows, bool)
                for k, (i, j) in enumerate(zip(si, ti)):
                    x, y = s[so[i] : so[i + 1]], t[to[j] : to[j + 1]]
                    shared = len(x) + len(y) - len(np.union1d(x, y))
                    linked[k] = 100 * shared >= PERCENT * (len(x) + len(y) - shared) > 0
                yield part.select(["a", "b"]).filter(pa.array(linked))


def _further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets, offsets = shingle_sets(part.column("text"))
            full = np.diff(offsets) > 0
            values = [*_ends(sets, offsets, range(PERMUTATIONS, PERMUTATIONS + FURTHER))]
            rows = _planes(np.array(values)) if values else np.zeros((0, FURTHER // 8), U64)
            yield pa.RecordBatch.from_arrays([part.column("id"), _lists(rows, full)], ["id", "further"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets, offsets = shingle_sets(part.column("text"))
            owner = np.repeat(part.column("id").to_numpy(), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(sets.view(np.int64))], ["id", "shingle"])


def own_shingles(docs: DataFrame) -> DataFrame:
    """(id, own): how many shingles of each document no other of them has; those without any are absent."""
    rows = docs.mapInArrow(_shingles, "id long, shingle long")
    single = rows.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last")
    return single.groupBy("id").agg(F.count("*").alias("own"))


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` whose full shingle sets are similar enough; docs: (id, text)."""
    ids = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = docs.join(bounded(ids), "id", "left_semi")
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_confirmed, "a long, b long")


def _sizes_allow(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _agree(x: str, y: str, words: int, least: int) -> Column:
    """Whether ``least`` values of four bits agree: two differ if they do in one bit. As a fold if there are many."""

    def differ(at) -> Column:
        bits = [F.col(x)[at + k].bitwiseXOR(F.col(y)[at + k]) for k in range(4)]
        return F.bit_count(bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3]))

    if words > 8:
        total = F.aggregate(F.sequence(F.lit(0), F.lit(words - 4), F.lit(4)), F.lit(0), lambda sofar, at: sofar + differ(at))
    else:
        total = sum((differ(at) for at in range(0, words, 4)), F.lit(0))
    return total <= words * 16 - least


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``, by links of similarity 0.75 or more."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialise(rows.mapInArrow(_signatures, "id long, n long, p1 long, p2 long, bands array<long>, short array<long>"), "signatures")
    prints = signed.filter("n > 0 and id is not null")
    classes = materialise(prints.groupBy("p1", "p2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).filter("c > 1").drop("c"), "classes")
    of_class = signed.join(classes, ["p1", "p2"], "left")
    nodes = of_class.filter("n > 0 and id is not null and (rep is null or rep = id)").select("id", "n", "bands", "short")
    nodes = materialise(nodes, "nodes")
    short = nodes.select("id", "short")
    bands = materialise(nodes.select("id", "n", F.posexplode("bands").alias("at", "key")), "bands")

    centres = bands.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.count("*").alias("k")).filter("k > 1")
    centres = materialise(centres.select("key", F.col("c.id").alias("b"), F.col("c.n").alias("m")), "centres")
    spokes = bands.join(centres, "key").filter(F.col("id") != F.col("b")).filter(_sizes_allow(F.col("n"), F.col("m")))
    spokes = materialise(spokes.select(F.col("id").alias("a"), "b").distinct(), "spokes")
    near = spokes.join(short.toDF("a", "sa"), "a").join(short.toDF("b", "sb"), "b").filter(_agree("sa", "sb", PERMUTATIONS // 8, AGREE))
    near = materialise(near.select("a", "b"), "near")
    plain = rows.filter("id is not null")
    links = materialise(confirm(near, plain), "links")
    joined = materialise(components(links), "components")

    # Bands whose members are still in different components: their other pairs.
    labelled = bands.join(joined, "id", "left").select("key", "at", "id", "n", F.coalesce("component", "id").alias("component"))
    shared = labelled.join(centres.select("key"), "key", "left_semi")
    labelled = materialise(shared, "labelled")
    open_keys = materialise(
        labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key"), "open"
    )
    members = materialise(labelled.join(open_keys, "key", "left_semi"), "members")
    few = plain.join(bounded(materialise(members.select("id").distinct(), "ids")), "id", "left_semi")
    own, further = materialise(own_shingles(few), "own"), materialise(few.mapInArrow(_further, "id long, further array<long>"), "further")
    members = members.join(nodes.select("id", "short", "bands"), "id").join(own, "id", "left").join(further, "id").fillna(0, ["own"])
    members = materialise(members, "members")
    other = members.select("key", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "component", "short", "own", "further", "bands")))
    cross = members.join(other, "key").filter("id2 < id and component2 <> component").filter(_sizes_allow(F.col("n"), F.col("n2")))
    most, least = F.expr("least(n - own, n2 - own2)"), F.expr("greatest(n + own2, n2 + own)")  # of intersection and union
    cross = cross.filter(most * 100 >= least * PERCENT).filter(_agree("short", "short2", PERMUTATIONS // 8, AGREE))
    cross = cross.filter(~F.arrays_overlap(F.slice("bands", 1, F.col("at")), F.slice("bands2", 1, F.col("at"))))  # the first band they share
    cross = cross.filter(_agree("further", "further2", FURTHER // 8, AGREE_FURTHER))
    cross = materialise(cross.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct().join(spokes, ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        links = links.union(materialise(confirm(cross, plain), "links"))
        joined = materialise(components(links), "components")

    known = joined.select(F.col("id").alias("rep"), "component")
    of_row = of_class.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("rep", "id")).alias("rep")).join(known, "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return of_row.select(
        "id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
