"""Best-fit packing into sequences of several permitted lengths.

Items go, longest first, into the open bin that they fill best. An item that fits nowhere opens a bin of the least-cost
length: for each permitted length that holds it, the bin's room is filled in thought with the longest items still to come,
and the length of the least cost a word, once the bin is downsized to those contents, is opened. All lengths are so weighed
against each other at each opening. In the end each bin is downsized to the least length that holds its contents, and items
move to room elsewhere where that lets their bin be downsized further. The cost of a bin is its length and ``overhead``.
Opening one length throughout is tried as well, and the cheapest result of a shard stays.

Documents longer than the longest length are cut into full sequences and a rest. Items are dealt to shards of about
``SHARD_ITEMS`` by a hash, so no task grows with the input, and each shard wastes at most its last few bins; a shard that
rows of one id and size crowd is dealt again by their place. So the packing of a table depends on its number of rows.

Defined cases: a null or blank text is an item of length 0 that gets a place of no words; a null id packs as any other;
rows that repeat an id are items of their own; items of equal size go in the order of their ids; a text of any length is cut
as said; an empty table gives an empty result. Other input columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._links import bounded
from ._store import materialise, small_batches
from .mixing import WORD

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 8
SHARD_ITEMS = 8192
#: A shard with so many times its items is dealt again.
CROWDED = 4

PACKED = "doc_id long, piece long, first_word long, words long, bin_id long, bin_length long, bin_used long, bin_offset long"


def opening(sizes: list[int], at: int, lengths: tuple[int, ...], overhead: int) -> int:
    """The permitted length of least cost a word for a bin that item ``at`` opens; sizes: longest first."""
    best, chosen = math.inf, lengths[-1]
    for length in lengths[bisect_left(lengths, sizes[at]) :]:
        filled, nexts = sizes[at], at + 1
        while nexts < len(sizes) and filled < length:
            nexts = bisect_left(sizes, filled - length, nexts, key=neg)  # the longest that still fits
            if nexts < len(sizes):
                filled, nexts = filled + sizes[nexts], nexts + 1
            if nexts < len(sizes) and not sizes[nexts]:
                break
        fits = lengths[bisect_left(lengths, filled)]
        each = (fits + overhead) / max(filled, 1)
        if each <= best:
            best, chosen = each, fits
    return chosen


def best_fit(sizes: list[int], lengths: tuple[int, ...], preferred: int | None = None, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """(bin of each size, words in each bin); sizes: longest first, none above the longest length.

    preferred: the length to open throughout; without it, that of least cost each time.
    """
    where, used, room = [], [], []  # room: (words left, bin), in order
    for item, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            length = opening(sizes, item, lengths, overhead) if preferred is None else max(preferred, lengths[bisect_left(lengths, size)])
            left, k = length, len(used)
            used.append(0)
        used[k] += size
        where.append(k)
        if left > size:
            insort(room, (left - size, k))
    return where, used


def moved(sizes: list[int], where: list[int], used: list[int], lengths: tuple[int, ...]) -> None:
    """Move an item out of a bin where that lets the bin be downsized and the item finds room; in place."""
    items: list[list[int]] = [[] for _ in used]
    for item in range(len(sizes) - 1, -1, -1):
        items[where[item]].append(item)  # shortest first
    room = sorted((lengths[bisect_left(lengths, u)] - u, k) for k, u in enumerate(used))
    over = [(u - lengths[bisect_left(lengths, u) - 1], k) for k, u in enumerate(used) if u > lengths[0]]
    for _, k in sorted(over):
        below = bisect_left(lengths, used[k]) - 1
        if below < 0:
            continue
        excess = used[k] - lengths[below]
        item = next((i for i in items[k] if sizes[i] >= excess), None)
        if item is None:
            continue
        size = sizes[item]
        own = (lengths[below + 1] - used[k], k)
        at = bisect_left(room, (size, -1))
        if at < len(room) and room[at] == own:
            at += 1
        if at == len(room):
            continue
        left, other = room.pop(at)
        room.remove(own)
        used[k], used[other] = used[k] - size, used[other] + size
        where[item] = other
        items[k].remove(item)
        insort(items[other], item, key=neg)
        insort(room, (left - size, other))
        insort(room, (lengths[bisect_left(lengths, used[k])] - used[k], k))


def cost(used: list[int], lengths: tuple[int, ...], overhead: int = OVERHEAD) -> int:
    """Of bins downsized to their contents."""
    fit = np.asarray(lengths)[np.searchsorted(lengths, used)]
    return int(fit.sum()) + overhead * len(used)


def pack_shard(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> dict[str, np.ndarray]:
    """Pieces of a shard's items: item, piece, first_word, words, bin, bin_length, bin_used, bin_offset."""
    longest = lengths[-1]
    full = np.maximum(-(-sizes // longest), 1) - 1  # pieces before the last
    item = np.repeat(np.arange(len(sizes)), full + 1)
    piece = np.arange(len(item)) - np.repeat(np.cumsum(full + 1) - full - 1, full + 1)
    words = np.where(piece < full[item], longest, sizes[item] - piece * longest)
    order = np.argsort(-words, kind="stable")
    ordered, tried = words[order].tolist(), []
    for preferred in (None, *lengths):
        tried.append(best_fit(ordered, lengths, preferred, overhead))
        moved(ordered, *tried[-1], lengths)
    where, used = min(tried, key=lambda t: cost(t[1], lengths, overhead))
    bins, fill = np.empty(len(item), np.int64), np.array(used, np.int64)
    bins[order] = where
    by_bin = np.lexsort((item, piece, -words, bins))
    before = np.concatenate(([0], np.cumsum(words[by_bin])[:-1]))
    opens = np.searchsorted(bins[by_bin], bins[by_bin])
    offset = np.empty(len(item), np.int64)
    offset[by_bin] = before - before[opens]
    length = np.asarray(lengths)[np.searchsorted(lengths, fill)]
    return {"item": item, "piece": piece, "first_word": piece * longest, "words": words, "bin": bins, "bin_length": length[bins], "bin_used": fill[bins], "bin_offset": offset}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> DataFrame:
    """A row for each piece of each document: its words, and its bin's id, length, contents and offset."""
    small_batches(docs.sparkSession)
    lengths = tuple(sorted(lengths))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    items = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size")), "sizes")
    shards = max(1, math.ceil(items.count() / SHARD_ITEMS))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("size", "ascending")])
        found = pack_shard(part.column("size").to_numpy(), lengths, overhead)
        ids = part.column("doc_id").take(pa.array(found.pop("item")))
        shard, again, times = (part.column(c)[0].as_py() for c in ("shard", "again", "times"))
        bins = (found.pop("bin") * times + again) * shards + shard  # one for each bin of the shard's parts
        columns = {"doc_id": ids, **{k: pa.array(found[k]) for k in ("piece", "first_word", "words")}, "bin_id": pa.array(bins)}
        return pa.table(columns | {k: pa.array(found[k]) for k in ("bin_length", "bin_used", "bin_offset")})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size"), F.lit(shards)))
    crowded = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED * SHARD_ITEMS)
    crowded = materialise(crowded.select("shard", F.ceil(F.col("n") / SHARD_ITEMS).alias("times")), "crowded")
    dealt = dealt.withColumn("place", F.monotonically_increasing_id()).join(bounded(crowded), "shard", "left")
    again = F.pmod("place", F.coalesce("times", F.lit(1)))
    return dealt.select("doc_id", "size", "shard", again.alias("again"), F.coalesce("times", F.lit(1)).alias("times")).groupBy("shard", "again").applyInArrow(run, PACKED)
