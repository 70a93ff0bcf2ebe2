"""Blocks of whole rows, and questions about which keys occur more than once.

A block is a bounded set of rows that is gathered again whenever its texts are needed, compressed on the way. Blocks ask
buckets: each sends its distinct keys, marked where it has a key twice itself, and gets one bit for each key back. So a
key that a third of all rows hold costs each bucket one entry a block, and no rows are joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._store import partitions
from ._words import U64

#: Bytes of text in a block, about.
BLOCK_BYTES = 16 << 20
ASKED = "block long, bucket long, keys binary, twice binary"
ANSWERED = "block long, bucket long, mask binary"


def block_count(rows: DataFrame, text: str = "text") -> int:
    """As many blocks as shuffle partitions, or more where texts would be over ``BLOCK_BYTES`` a block."""
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(partitions(rows.sparkSession), math.ceil(total / BLOCK_BYTES))


def gathered(batches: Iterator[pa.RecordBatch], most: int = 2 * BLOCK_BYTES) -> Iterator[pa.Table]:
    """Batches together, up to so many bytes; so a block's part of them compresses well."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > most:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def packed(rows: DataFrame, blocks: int, columns: list[str]) -> DataFrame:
    """(block, rows): ``columns`` as compressed Arrow streams, a stream for each batch and block; rows: has id and text."""
    keyed = rows.withColumn("__block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for table in gathered(batches):
            to = table.column("__block").to_numpy()
            order = np.argsort(to, kind="stable")
            names, at = np.unique(to[order], return_index=True)
            table = table.select(columns).take(pa.array(order))
            out = []
            for a, b in zip(at, [*at[1:], len(to)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=options) as w:
                    w.write_table(table.slice(a, b - a).combine_chunks())
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(out, pa.binary())], ["block", "rows"])

    return keyed.mapInArrow(pack, "block long, rows binary")


def unpacked(streams: pa.Table) -> pa.RecordBatch:
    """The rows of a block, in an order that doesn't depend on how its streams arrived."""
    parts = sorted((x.as_py() for x in streams.column("rows")), key=lambda x: (len(x), x))
    table = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in parts]).combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


class Keys:
    """Distinct keys of a block: 64 bits, or 96 with a second lane of 32; inverse: where each given key is among them."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None, buckets: int):
        bucket = first % U64(buckets)
        order = np.lexsort((first, bucket) if second is None else (second, first, bucket))
        fresh = np.ones(len(order), bool)
        fresh[1:] = first[order][1:] != first[order][:-1]
        if second is not None:
            fresh[1:] |= second[order][1:] != second[order][:-1]
        group = np.cumsum(fresh) - 1
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = group
        self.first = first[order][fresh]
        self.second = None if second is None else second[order][fresh]
        self.twice = np.bincount(group, minlength=len(self.first)) > 1
        self.buckets, self.at = np.unique(bucket[order][fresh], return_index=True)
        self.ends = [*self.at[1:], len(self.first)]

    def ask(self, block: int) -> pa.Table:
        keys, twice = [], []
        for a, b in zip(self.at, self.ends):
            keys.append(self.first[a:b].tobytes() + (b"" if self.second is None else self.second[a:b].tobytes()))
            twice.append(np.packbits(self.twice[a:b]).tobytes())
        buckets = pa.array(self.buckets.astype(np.int64))
        return pa.table({"block": pa.array([block] * len(keys), pa.int64()), "bucket": buckets, "keys": pa.array(keys, pa.binary()), "twice": pa.array(twice, pa.binary())})

    def told(self, answers: pa.Table) -> np.ndarray:
        """For each key given whether it occurs more than once anywhere."""
        masks = dict(zip(answers.column("bucket").to_pylist(), answers.column("mask").to_pylist()))
        flags = np.zeros(len(self.first), bool)
        for k, a, b in zip(self.buckets.tolist(), self.at, self.ends):
            flags[a:b] = np.unpackbits(np.frombuffer(masks[k], np.uint8), count=b - a).astype(bool)
        return flags[self.inverse]


def answers(questions: DataFrame, width: int) -> DataFrame:
    """(block, bucket, mask) for what blocks ask; width: bytes of a key, 8 or 12."""

    def answer(asked: pa.Table) -> pa.Table:
        first, second, counts, sizes = [], [], [], []
        for keys, twice in zip(asked.column("keys").to_pylist(), asked.column("twice").to_pylist()):
            n = len(keys) // width
            first.append(np.frombuffer(keys, U64, n))
            if width > 8:
                second.append(np.frombuffer(keys, np.uint32, n, 8 * n))
            counts.append(1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=n))
            sizes.append(n)
        one = np.concatenate(first)
        two = np.concatenate(second) if second else None
        order = np.argsort(one, kind="stable") if two is None else np.lexsort((two, one))
        fresh = np.ones(len(order), bool)
        fresh[1:] = one[order][1:] != one[order][:-1]
        if two is not None:
            fresh[1:] |= two[order][1:] != two[order][:-1]
        group = np.cumsum(fresh) - 1
        often = np.bincount(group, np.concatenate(counts)[order]) > 1
        flags = np.empty(len(order), bool)
        flags[order] = often[group]
        at = np.cumsum([0, *sizes])
        masks = [np.packbits(flags[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "mask": pa.array(masks, pa.binary())})

    return questions.groupBy("bucket").applyInArrow(answer, ANSWERED)


def per_block(streams: DataFrame, told: DataFrame | None, f: Callable[[int, pa.RecordBatch, pa.Table], pa.Table], schema: StructType | str) -> DataFrame:
    """``f(block, rows, answers)`` for each block; told: (block, bucket, mask) and more, or nothing yet."""

    def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        return f(left.column("block")[0].as_py(), unpacked(left), right)

    def alone(left: pa.Table) -> pa.Table:
        return run(left)

    if told is None:
        return streams.groupBy("block").applyInArrow(alone, schema)
    return streams.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)
