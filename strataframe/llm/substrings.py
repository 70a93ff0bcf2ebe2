"""Substring dedup with difference-cover anchors.

A difference cover of a period holds, for any distance, two residues that far apart. So if a window of ``WINDOW`` words
occurs at two places, then at one offset below the period both places have a word position in the cover, and the words
from there on that still lie in the window are hashed for both alike. Only positions in the cover are hashed (5 of 21).
An anchor that occurs once proves that nothing around it repeats. Around anchors that occur more than once the match is
extended to whole windows, which are compared by 96 bits, and each word that a repeated window covers is removed.

Defined cases: a null text has no words; texts shorter than a window keep all words; a text of any length is judged whole,
alone in its slice if it is long; rows that repeat an id, or have a null one, are rows of their own; all places of a window
go alike, so there are no ties; windows are judged on the input; an empty table gives an empty result. Of input columns that
bear the name of an added one, the added one stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._blocks import ASKED, Keys, answers, block_count, packed, per_block
from ._store import materialise
from ._words import U64, Words, run_hashes, run_starts, slices

WINDOW = 35
#: Each difference modulo PERIOD is one between two of COVER.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)


class _Part:
    """The words of a slice of a block, without arrays as long as its bytes."""

    def __init__(self, rows: pa.RecordBatch, window: int):
        words = Words(rows.column("text"))
        self.rows, self.raw, self.start, self.end, self.first = rows, words.raw, words.start, words.end, words.first
        self.hashes = words.hashes()
        length = window - PERIOD + 1
        at, _ = run_starts(self.first, length)
        place = at - np.repeat(self.first[:-1], np.maximum(np.diff(self.first) - length + 1, 0))
        self.anchors = at[np.isin(place % PERIOD, COVER)]
        self.anchor_keys = run_hashes(self.hashes, self.anchors, length)

    def candidates(self, often: np.ndarray, window: int) -> np.ndarray:
        """Starts of windows that contain an anchor found more than once."""
        sums = np.zeros(len(self.hashes) + 1, np.int64)
        sums[self.anchors[often] + 1] = 1
        sums = np.cumsum(sums)
        at, _ = run_starts(self.first, window)
        return at[sums[at + PERIOD] > sums[at]]


def _parts(rows: pa.RecordBatch, window: int) -> list[_Part]:
    return [_Part(x, window) for x in slices(rows)] if rows.num_rows else []


def _joined(parts: list[np.ndarray], kind: type = U64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _divided(flags: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(flags, np.cumsum(sizes)[:-1]) if sizes else []


def _windows(parts: list[_Part], often: np.ndarray, window: int, buckets: int) -> tuple[list[np.ndarray], Keys]:
    starts = [p.candidates(o, window) for p, o in zip(parts, _divided(often, [len(p.anchors) for p in parts]))]
    first = _joined([run_hashes(p.hashes, s, window) for p, s in zip(parts, starts)])
    second = _joined([(run_hashes(p.hashes, s, window, 1) >> U64(32)).astype(np.uint32) for p, s in zip(parts, starts)], np.uint32)
    return starts, Keys(first, second, buckets)


def _kept(part: _Part, gone: np.ndarray) -> pa.Array:
    """The other words of each text, joined by one space."""
    keep = np.flatnonzero(~gone)
    first = np.searchsorted(keep, part.first)
    space = np.ones(len(keep), np.int64)
    space[first[:-1][np.diff(first) > 0]] = 0
    size = part.end[keep] - part.start[keep]
    ends = np.concatenate(([0], np.cumsum(size + space)))
    out = np.full(ends[-1], 32, np.uint8)
    to = ends[:-1] + space
    total = np.concatenate(([0], np.cumsum(size)))
    within = np.arange(total[-1])
    out[within + np.repeat(to - total[:-1], size)] = part.raw[within + np.repeat(part.start[keep] - total[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(ends[first].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space).

    window: words of the shortest repeated run that is removed, over ``PERIOD``.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    added = ("n_words", "n_removed", "kept")
    held = [c for c in docs.columns if c not in added]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in held)).alias("row"))
    blocks = block_count(rows)
    texts, at = packed(rows.drop("row"), blocks, ["text"]), held.index(text_col)

    def anchors(parts: list[_Part]) -> Keys:
        return Keys(_joined([p.anchor_keys for p in parts]), None, blocks)

    def ask_anchors(block: int, batch: pa.RecordBatch, _: None) -> pa.Table:
        return anchors(_parts(batch, window)).ask(block)

    def ask_windows(block: int, batch: pa.RecordBatch, told: pa.Table) -> pa.Table:
        parts = _parts(batch, window)
        return _windows(parts, anchors(parts).told(told), window, blocks)[1].ask(block)

    of_anchors = materialise(answers(per_block(texts, None, ask_anchors, ASKED), 8), "anchors")
    of_windows = materialise(answers(per_block(texts, of_anchors, ask_windows, ASKED), 12), "windows")

    schema = StructType(
        [StructField("row", rows.schema["row"].dataType), *(StructField(c, LongType()) for c in added[:2]), StructField(added[2], StringType())]
    )

    def remove(block: int, batch: pa.RecordBatch, told: pa.Table) -> pa.Table:
        whole = pa.RecordBatch.from_arrays([batch.column("row"), pc.struct_field(batch.column("row"), [at])], ["row", "text"])
        parts = _parts(whole, window)
        by_kind = [told.filter(pc.equal(told.column("kind"), k)) for k in (0, 1)]
        starts, keys = _windows(parts, anchors(parts).told(by_kind[0]), window, blocks)
        out = []
        for part, start, often in zip(parts, starts, _divided(keys.told(by_kind[1]), [len(s) for s in starts])):
            cover = np.zeros(len(part.hashes) + 1, np.int64)
            cover[start[often]] += 1
            np.subtract.at(cover, start[often] + window, 1)
            gone = np.cumsum(cover)[:-1] > 0
            removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[part.first])
            columns = [part.rows.column("row"), pa.array(np.diff(part.first)), pa.array(removed), _kept(part, gone)]
            out.append(pa.Table.from_arrays(columns, names=["row", *added]))
        return pa.concat_tables(out)

    both = of_anchors.withColumn("kind", F.lit(0)).union(of_windows.withColumn("kind", F.lit(1)))
    return per_block(packed(rows, blocks, ["row"]), both, remove, schema).select("row.*", *added)
