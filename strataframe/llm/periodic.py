"""Periodic runs of words, by internal pattern matching.

A run is a stretch of words that repeats with a smallest period q over max(6, 4 q) words at least, and that no neighbouring
word extends with that period. Words in a run occur four times in it, so texts are first cut at words that occur less often
in their stretch, again and again; what is left loses no run. All stretches of a slice are then one string, with a separator
of its own after each:

* prefix doubling sorts its suffixes; the rank of a position at level k names the block of 2^k words there, and is the first
  place of that block's occurrences in the suffix array;
* a wavelet tree over the suffix array answers range successors: the next occurrence of a block at or after a position;
* a run of period q holds a block of b = 2^k words at a multiple of b, with b the greatest power of two up to (3 q + 1) / 2,
  and its next copy q words on. So each block asks for its occurrences in the neighbouring window of all such q. Occurrences
  nearer than b / 2 to each other stand in a progression whose difference p is the period of the block, and a window has two
  groups at most. An occurrence alone gives its distance as candidate; a progression gives the distance between the ends of
  the stretches of period p around both, as only that can be the period of something larger;
* candidates are extended to both sides by ranks, from long blocks to short ones. Stretches that are found with several
  periods keep the least.

Defined cases: a null text has no words; texts without runs keep all words; a text of any length is judged whole, alone in
its slice if it is long; rows that repeat an id, or have a null one, are rows of their own; runs come by start, then period;
an empty table gives an empty result. Of input columns that bear the name of an added one, the added one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ._store import small_batches
from ._words import U64, Words, mixed, slices
from .substrings import _kept

#: A run has TIMES periods and LEAST words at least.
TIMES, LEAST = 4, 6
#: Bytes of text that are searched together.
SLICE = 2 << 20
ADDED = ("n_words", "runs", "collapsed")


def stretches(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions that runs can hold: stretches of words each of which occurs TIMES times in its stretch.

    Equal hashes of different words only keep more.
    """
    at = np.arange(len(hashes))
    part = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, names = np.unique(hashes, return_inverse=True)
    while len(at):
        _, group, counts = np.unique(mixed(part.astype(U64) << U64(32) | names[at].astype(U64)), return_inverse=True, return_counts=True)
        often = counts[group] >= TIMES
        new = np.ones(len(at), bool)
        new[1:] = (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1) | ~often[:-1]
        part = np.cumsum(new)
        long = np.bincount(part[often], minlength=part[-1] + 1)[part] >= LEAST
        stay = often & long
        if stay.all():
            return at
        at, part = at[stay], part[stay]
    return at


def _names(words: Words, at: np.ndarray) -> np.ndarray:
    """Words by number, by their bytes."""
    size = words.end[at] - words.start[at]
    ends = np.concatenate(([0], np.cumsum(size)))
    held = words.raw[np.arange(ends[-1]) + np.repeat(words.start[at] - ends[:-1], size)]
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(held)])
    return array.dictionary_encode().indices.to_numpy().astype(np.int64)


class Ranks:
    """The suffix array of a string, sorted by the first 2^top words, and the rank of each position at each level.

    A rank is the first place in the suffix array of what starts alike; ``sizes``: how many do.
    """

    def __init__(self, text: np.ndarray, top: int):
        n = len(text)
        self.order = np.argsort(text, kind="stable")
        ordered = text[self.order]
        fresh = np.ones(n, bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n + 1, np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[n] = -1
        self.levels = [rank]
        for k in range(top):
            rank = rank.copy()
            shared = np.flatnonzero(np.bincount(rank[:n], minlength=n)[rank[:n]] > 1)
            if len(shared):
                further = self.levels[k][np.minimum(shared + (1 << k), n)].astype(np.int64)
                key = rank[shared].astype(np.int64) * (n + 2) + further + 1
                by = np.argsort(key, kind="stable")
                at, key, of = shared[by], key[by], rank[shared[by]].astype(np.int64)
                place = np.arange(len(at))
                start, fresh = np.ones(len(at), bool), np.ones(len(at), bool)
                start[1:], fresh[1:] = of[1:] != of[:-1], key[1:] != key[:-1]
                within = of - np.maximum.accumulate(np.where(start, place, 0))
                self.order[place + within] = at
                rank[at] = np.maximum.accumulate(np.where(fresh, place, 0)) + within
            self.levels.append(rank)
        self.n = n

    def sizes(self, level: int) -> np.ndarray:
        rank = self.levels[level][: self.n]
        return np.bincount(rank, minlength=self.n)[rank]

    def common(self, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many words from a and from b on (or before them) are the same; a < b."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        level = len(self.levels) - 1
        while level >= 0:
            rank, step = self.levels[level], 1 << level
            if forward:
                same = rank[np.minimum(a, self.n)] == rank[np.minimum(b, self.n)]
            else:
                same = (a >= step) & (rank[np.maximum(a - step, 0)] == rank[np.maximum(b - step, 0)])
            move = np.where(same, step, 0)
            total += move
            a, b = (a + move, b + move) if forward else (a - move, b - move)
            if level < len(self.levels) - 1 or not same.any():
                level -= 1
        return total


class Wavelets:
    """A wavelet tree over a permutation, as one matrix of prefix counts: successors in ranges of it."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.zeros = []
        for bit in range(max(1, int(self.n - 1).bit_length()))[::-1]:
            low = (values >> bit & 1) == 0
            count = np.zeros(self.n + 1, np.int32)
            np.cumsum(low, out=count[1:])
            self.zeros.append((bit, count))
            values = np.concatenate((values[low], values[~low]))

    def successor(self, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The least value >= ``least`` among places left..right, or n."""
        top = 1 << len(self.zeros)
        asked = np.minimum(least, top - 1)
        a, b, less = left.copy(), right.copy(), np.zeros(len(left), np.int64)
        for bit, count in self.zeros:
            za, zb = count[a].astype(np.int64), count[b].astype(np.int64)
            one = (asked >> bit & 1) == 1
            less += np.where(one, zb - za, 0)
            a, b = np.where(one, count[-1] + a - za, za), np.where(one, count[-1] + b - zb, zb)
        found = (less < right - left) & (least < top)
        a, b, rest, value = left.copy(), right.copy(), np.where(found, less, 0), np.zeros(len(left), np.int64)
        for bit, count in self.zeros:
            za, zb = count[a].astype(np.int64), count[b].astype(np.int64)
            one = rest >= zb - za
            rest = np.where(one, rest - (zb - za), rest)
            value |= one.astype(np.int64) << bit
            a, b = np.where(one, count[-1] + a - za, za), np.where(one, count[-1] + b - zb, zb)
        return np.where(found, value, self.n)


def candidates(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) pairs among which each run is, by a position inside it."""
    tree = Wavelets(ranks.order)
    asked = []
    for level in range(1, len(ranks.levels)):
        b, size = 1 << level, ranks.sizes(level)
        at = np.arange(0, ranks.n, b)
        at = at[size[at] > 1]
        left = ranks.levels[level][at].astype(np.int64)
        asked.append((at, left, left + size[at], np.full(len(at), b)))
    if not asked:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, left, right, b = (np.concatenate(x) for x in zip(*asked))
    end = at - (1 - 4 * b) // 3 - 1  # at + ceil((4 b - 1) / 3) - 1

    def after(some: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some blocks those that occur again from ``least`` to the end of their window, and where."""
        found = tree.successor(left[some], right[some], least)
        inside = (found < ranks.n) & (found <= end[some])
        return some[inside], found[inside]

    def stretch(start: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The ends of the stretches of period p that begin or continue at ``start``."""
        return start + p + ranks.common(start, start + p)

    one, x1 = after(np.arange(len(at)), at - (1 - 2 * b) // 3)
    pairs = [(at[one], x1 - at[one])]
    two, x2 = after(one, x1 + 1)
    before = x1[np.searchsorted(one, two)]
    near = 2 * (x2 - before) <= b[two]

    some, p, x = two[near], (x2 - before)[near], before[near]  # the window begins with a progression
    own, far = stretch(at[some], p), stretch(x, p)
    pairs.append((at[some], far - own))
    other, y = after(some, np.maximum(far - b[some], x) + 1)  # and another group may follow it
    k = np.searchsorted(some, other)
    pairs += [(at[other], y - at[other]), (at[other], stretch(y, p[k]) - own[k])]

    some, x = two[~near], x2[~near]  # one alone, then another group
    pairs.append((at[some], x - at[some]))
    three, y = after(some, x + 1)
    x = x[np.searchsorted(some, three)]
    pairs.append((at[three], stretch(x, y - x) - stretch(at[three], y - x)))
    return tuple(np.concatenate(z) for z in zip(*pairs))


def runs(text: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of all runs, by start and period; longest: words between two separators."""
    top = max(1, ((3 * (longest // TIMES) + 1) // 2).bit_length() - 1)
    ranks = Ranks(text, top)
    at, q = candidates(ranks)
    good = (q > 0) & (TIMES * q <= longest)
    at, q = at[good], q[good]
    end = at + q + ranks.common(at, at + q)
    start = at - ranks.common(at, at + q, forward=False)
    long = end - start >= np.maximum(LEAST, TIMES * q)
    found = np.unique(np.stack([start[long], end[long], q[long]], axis=1), axis=0)
    least = np.ones(len(found), bool)
    least[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[least]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """((start, end, period) of each run, in words of the slice, by text, start and period; the text of each)."""
    at = stretches(words.first, words.hashes())
    if not len(at):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    text_of = np.searchsorted(words.first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (text_of[1:] != text_of[:-1])
    begin = np.flatnonzero(new)
    names = _names(words, at)
    number = np.cumsum(new) - 1
    string = np.full(len(at) + len(begin), -1, np.int64)
    string[np.arange(len(at)) + number] = names
    gaps = np.flatnonzero(string < 0)
    string[gaps] = names.max() + 1 + np.arange(len(gaps))
    found = runs(string, int(np.diff([*begin, len(at)]).max()))
    part = np.searchsorted(gaps, found[:, 0])
    shift = at[begin[part]] - (begin[part] + part)
    found[:, :2] += shift[:, None]
    return found, text_of[begin[part]]


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; in words) and, for the text, ``collapsed``.

    collapsed: the words that no run holds beyond its first period, joined by one space.
    """
    small_batches(docs.sparkSession)
    held = [c for c in docs.columns if c not in (*ADDED, text_col)]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in held)).alias("row") if held else F.struct(F.lit(None).alias("none")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    run = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    schema = StructType([StructField("row", rows.schema["row"].dataType), StructField("n_words", LongType()), StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                words = Words(part.column("text"))
                found, of = runs_of(words)
                cover = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(cover, found[:, 0] + found[:, 2], 1)
                np.subtract.at(cover, found[:, 1], 1)
                gone = np.cumsum(cover)[:-1] > 0
                columns = [found[:, 0] - words.first[of], found[:, 1] - found[:, 0], found[:, 2]]
                listed = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], [f.name for f in run]),
                )
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(words.counts.astype(np.int64)), listed, _kept(words, gone)], ["row", *ADDED])

    return rows.mapInArrow(find, schema).select("row.*", *ADDED)
