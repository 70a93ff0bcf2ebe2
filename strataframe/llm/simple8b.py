"""Token ids as Simple-8b words.

A word has a selector in its upper four bits and several ids of one width in the lower sixty; the selector tells how many,
and so how wide. Ids of over sixty bits are escapes: their word holds none, and they stand in a list at the end. Ids are
cut into blocks of ``BLOCK``, and a table of the blocks' first words lets blocks be decoded alone, or all at once by numpy.

A file is a Parquet table of segments in ascending order of ids: each row a run of documents, its data a segment in this
layout (little endian): ``SIM8``, u32 version, u32 ids a block, u64 ids, u32 blocks, u32 words, u32 escapes, u32 documents;
then u32 first word of each block and their end, u64 words, u64 escapes, u32 ids of each document. The documents are dealt
to ranges of ids of about ``RANGE_BYTES`` of text, or of more where ``MOST_RANGES`` don't suffice; a task sorts its range on
disk and holds a segment at a time, so its memory doesn't grow with the input.

Defined cases: a null text is empty, so it has the end id alone; null document ids come first; rows that repeat an id are
documents of their own, ordered by a hash of their texts, and equal ones may lie in several ranges; a text of any length is
one document, taken alone if it is long; an empty table gives an empty file. Other input columns aren't read, whatever their
names.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._store import materialise, partitions
from ._words import U64, column, slices, span_hashes

MAGIC, VERSION, HEADER = b"SIM8", 1, struct.Struct("<4sIIQIIII")
BLOCK = 256
#: Ids a word, by selector; each is 60 // count bits wide. Selector 0: an escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, *(60 // COUNTS[1:])])
_POWERS = U64(1) << np.arange(64, dtype=U64)
_NARROW = np.searchsorted(_POWERS, np.arange(1 << 17, dtype=U64), "right").astype(np.uint8)
SEGMENT_IDS = 1 << 20
RANGE_BYTES = 64 << 20
#: Ranges at most, as the driver samples their bounds; longer ones are sorted on disk and cut into segments alike.
MOST_RANGES = 4096
END = 0


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each block and their end, words, escapes) of unsigned ids."""
    n, blocks = len(ids), -(-len(ids) // block)
    if not n:
        return np.zeros(1, np.uint32), np.zeros(0, U64), np.zeros(0, U64)
    grid = np.zeros(blocks * block + 64, U64)
    grid[:n] = ids
    left = np.minimum(block, n - block * np.arange(blocks))
    reach = np.zeros((blocks, block + 64), np.uint8)
    reach[:, :block] = _widths(grid[:-64]).reshape(blocks, block)
    span, fits = 1, np.zeros((blocks, block), np.uint8)  # reach[k]: the greatest width of ``span`` ids from k on
    for selector in range(len(COUNTS) - 1, 0, -1):
        more = COUNTS[selector] - span
        while more:
            step = min(more, span)
            np.maximum(reach[:, : block + 64 - step], reach[:, step:], out=reach[:, : block + 64 - step])
            span, more = span + step, more - step
        fits += reach[:, :block] <= BITS[selector]
    # What fits a selector fits all with fewer ids; what is past a block's end fits any width, so a count may pass it.
    chosen = np.where(fits > 0, len(COUNTS) - fits, 0).astype(np.uint8).ravel()
    step, opens = COUNTS[chosen], np.zeros(blocks * block, bool)
    at, end = block * np.arange(blocks), block * np.arange(blocks) + left
    while len(at):
        opens[at] = True
        at = at + step[at]
        going = at < end
        at, end = at[going], end[going]
    start = np.flatnonzero(opens)
    selector = chosen[start]
    words = selector.astype(U64) << U64(60)
    for s in range(1, len(COUNTS)):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            values = grid[start[mine, None] + np.arange(COUNTS[s])]
            over = np.flatnonzero(start[mine] % block + COUNTS[s] > block)
            if len(over):
                values[over] *= start[mine[over], None] % block + np.arange(COUNTS[s]) < block
            values <<= (np.arange(COUNTS[s]) * BITS[s]).astype(U64)
            words[mine] |= np.bitwise_or.reduce(values, axis=1)
    return np.searchsorted(start, block * np.arange(blocks + 1)).astype(np.uint32), words, grid[start[selector == 0]]


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if len(ids) and int(ids.max()) < len(_NARROW):
        return _NARROW[ids.astype(np.intp)]
    return np.searchsorted(_POWERS, ids, "right").astype(np.uint8)


def decode(firsts: np.ndarray, words: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """All ids of these blocks."""
    selector = (words >> U64(60)).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts.astype(np.int64)))
    before = ends - counts
    inside = before - before[firsts[:-1].astype(np.int64)][owner] if len(words) else before
    out = np.zeros(len(firsts) * block + 64, U64)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(selector == s)
        if not len(mine):
            continue
        if s == 0:
            out[owner[mine] * block + inside[mine]] = escapes
            continue
        steps = np.arange(COUNTS[s])
        values = words[mine, None] >> (steps * BITS[s]).astype(U64) & U64((1 << int(BITS[s])) - 1)
        place = inside[mine, None] + steps
        held = place < block
        out[(owner[mine, None] * block + place)[held]] = values[held]
    return out[:n]


def segment(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> bytes:
    """A run of documents; lengths: ids of each."""
    firsts, words, escapes = encode(ids, block)
    head = HEADER.pack(MAGIC, VERSION, block, len(ids), len(firsts) - 1, len(words), len(escapes), len(lengths))
    return head + firsts.tobytes() + words.tobytes() + escapes.tobytes() + lengths.astype(np.uint32).tobytes()


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each document)."""
    magic, version, block, n, blocks, words, escapes, documents = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of Simple-8b words of this version")
    at, parts = HEADER.size, []
    for kind, count in ((np.uint32, blocks + 1), (U64, words), (U64, escapes), (np.uint32, documents)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    return decode(*parts[:3], n, block), parts[3]


class _Table:
    """Ids by 64-bit key. Of more than ``most`` keys the half that was asked for last stays."""

    def __init__(self, most: int):
        self.most, self.now = most, 0
        self.runs = [(np.zeros(0, U64), np.zeros(0, np.int64))] * 2  # (keys in order, their entries): old ones, new ones
        self.n = self.used = 0
        self.begin, self.size, self.last = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    @staticmethod
    def _grown(array: np.ndarray, n: int) -> np.ndarray:
        """With room for ``n``; sizes double."""
        if n <= len(array):
            return array
        out = np.zeros(max(n, 2 * len(array)), array.dtype)
        out[: len(array)] = array
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key; -1 without one."""
        self.now += 1
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for sorted_keys, entries in self.runs:
            if len(sorted_keys) and len(left):
                place = np.minimum(np.searchsorted(sorted_keys, keys[left]), len(sorted_keys) - 1)
                hit = sorted_keys[place] == keys[left]
                found[left[hit]] = entries[place[hit]]
                left = left[~hit]
        self.last[found[found >= 0]] = self.now
        return found

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The entries of new keys."""
        n, used = self.n + len(keys), self.used + len(ids)
        self.begin, self.size, self.last, self.ids = self._grown(self.begin, n), self._grown(self.size, n), self._grown(self.last, n), self._grown(self.ids, used)
        self.begin[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : n], self.last[self.n : n], self.ids[self.used : used] = sizes, self.now, ids
        entries = np.arange(self.n, n)
        self.n, self.used = n, used
        old, new = self.runs
        new = self._merged(new, (keys, entries))
        self.runs = [old, new] if 8 * len(new[0]) < len(old[0]) else [self._merged(old, new), (np.zeros(0, U64), np.zeros(0, np.int64))]
        return entries

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate((a[0], b[0]))
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate((a[1], b[1]))[order]

    def shrink(self) -> None:
        """To be called when no entry is held outside."""
        if self.n <= self.most:
            return
        kept = np.sort(np.argpartition(self.last[: self.n], -self.most // 2)[-self.most // 2 :])
        keys, entries = self._merged(*self.runs)
        key_of = np.empty(self.n, U64)
        key_of[entries] = keys
        sizes, last = self.size[kept], self.last[kept]
        ids = self.ids[spread(self.begin[kept], sizes)]
        self.__init__(self.most)
        self.now = int(last.max())
        entries = self.add(key_of[kept], sizes, ids)
        self.last[entries] = last


def spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each begin, as many as its size says."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)


def chunkable(path: str) -> bool:
    """Whether a tokenizer's file names the pre-tokeniser that chunks are made for, and nothing that looks beyond them."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    pieces = given.get("pre_tokenizer") or {}
    plain = pieces.get("type") == "ByteLevel" and pieces.get("use_regex", True) and not pieces.get("add_prefix_space")
    marked = all(t["content"].startswith("<|") for t in given.get("added_tokens") or ())
    return bool(plain and marked and not any(given.get(k) for k in ("normalizer", "truncation", "padding")))


class Encoder:
    """The library's ids, with those of chunks that were met before from a table.

    A chunk begins at a single space or newline between two characters that aren't white space, after such a newline, and at
    punctuation after a letter. Byte-level pre-tokenisers always begin a piece there and look no further back, so a chunk's
    ids are the same alone and in its text. Chunks are found and hashed over whole columns; the library encodes each
    distinct one once. Texts with characters for which that isn't plain, or special tokens, go to the library whole, and so
    do all texts if the tokenizer's file names another pre-tokeniser.
    """

    #: Chunks that the table holds at most.
    MOST = 1_000_000
    ODD = re.compile(rb"[\x00-\x08\x0b-\x1f\x7f]|\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe2\x80|\xe2\x81\x9f|\xe3\x80\x80|<\|")
    #: Chunks that are encoded in one string.
    JOINED = 64

    def __init__(self, path: str):
        self.library, self.chunks = Tokenizer.from_file(path), chunkable(path)
        self.table = _Table(self.MOST)
        if self.chunks:
            vocabulary = self.library.get_vocab(with_added_tokens=True)
            space, line = (self.library.encode(c, add_special_tokens=False) for c in " \n")
            self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
            self.spaced[[k for t, k in vocabulary.items() if t.startswith(space.tokens[0][0])]] = True
            (self.line,) = line.ids

    def _batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has)."""
        found = [e.ids for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _learn(self, keys: np.ndarray, data: bytes, begin: np.ndarray, end: np.ndarray, white: np.ndarray) -> np.ndarray:
        """Entries of new chunks; white: how many white bytes stand before each byte of the data."""
        raw = np.frombuffer(data, np.uint8)
        inside = white[end] - white[begin + 1]
        kind = np.where(inside > 0, 2, np.where(raw[begin] == 32, 0, np.where(white[begin + 1] > white[begin], 2, 1)))
        order = np.argsort(kind, kind="stable")  # a space in front; no white space; others
        bounds = np.searchsorted(kind[order], [0, 1, 2, 3])
        chunks = [data[a:b] for a, b in zip(begin[order].tolist(), end[order].tolist())]
        ids, sizes = [], []
        for glue, a, b in ((b"", bounds[0], bounds[1]), (b"\n", bounds[1], bounds[2])):
            found, _ = self._batch([glue + glue.join(chunks[i : min(i + self.JOINED, b)]) for i in range(a, b, self.JOINED)])
            opens = self.spaced[found] if not glue else found == self.line
            size = np.diff(np.append(np.flatnonzero(opens), len(found)))
            ids.append(found if not glue else found[~opens])
            sizes.append(size - len(glue))
        found, size = self._batch(chunks[bounds[2] :])
        sizes = np.concatenate([*sizes, size])
        if len(sizes) != len(chunks):
            raise RuntimeError("the tokenizer joins pieces across single spaces")
        entries = np.empty(len(keys), np.int64)
        entries[order] = self.table.add(keys[order], sizes, np.concatenate([*ids, found]))
        return entries

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has)."""
        raw, offsets = column(texts)
        data = raw.tobytes()
        if not self.chunks:
            return self._batch([data[a:b] for a, b in pairwise(offsets.tolist())])
        doubtful = np.unique(np.searchsorted(offsets, np.flatnonzero(_DOUBTFUL[raw]), "right") - 1).tolist()
        odd = [k for k in doubtful if self.ODD.search(data, int(offsets[k]), int(offsets[k + 1]))]
        start = np.zeros(len(raw) + 1, bool)
        kind = _CHARACTER[raw]
        if len(raw) > 2:
            solid, letter = kind > 1, kind == 3
            gap = (kind[1:-1] == 1) & (raw[1:-1] != 9) & solid[:-2] & solid[2:]
            start[1:-2] = gap
            start[2:-1] |= gap & (raw[1:-1] == 10)
            letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
            start[1:-1] |= (kind[1:] == 2) & letter[:-1]
        start[offsets] = True
        start[-1] = False
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(raw))
        first = np.searchsorted(begin, offsets)
        coded = pa.array(span_hashes(raw, begin, end)).dictionary_encode()
        back, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        where = np.flatnonzero(np.diff(np.maximum.accumulate(back), prepend=-1))  # codes are given in the order of first places
        skipped = np.zeros(len(begin), bool)
        for k in odd:
            skipped[first[k] : first[k + 1]] = True
        wanted = np.ones(len(distinct), bool)
        if odd:
            wanted[:] = False
            wanted[back[~skipped]] = True
        self.table.shrink()
        entry = self.table.find(distinct)
        fresh = np.flatnonzero(wanted & (entry < 0))
        if len(fresh):
            white = np.concatenate(([0], np.cumsum(kind == 1)))
            entry[fresh] = self._learn(distinct[fresh], data, begin[where[fresh]], end[where[fresh]], white)
        held = np.maximum(entry, 0)[back]
        sizes = np.where(skipped, 0, self.table.size[held]) if self.table.n else np.zeros(len(back), np.int64)
        ids = self.table.ids[spread(self.table.begin[held], sizes)] if self.table.n else np.zeros(0, np.uint32)
        bounds = np.concatenate(([0], np.cumsum(sizes)))[first]
        if not odd:
            return ids, np.diff(bounds)
        found, size = self._batch([data[offsets[k] : offsets[k + 1]] for k in odd])
        whole = dict(zip(odd, np.split(found, np.cumsum(size)[:-1])))
        parts = [whole[k] if k in whole else ids[bounds[k] : bounds[k + 1]] for k in range(len(offsets) - 1)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


#: 1 white space, 2 punctuation, 3 letters, 4 others.
_CHARACTER = np.full(256, 4, np.uint8)
_CHARACTER[[9, 10, 32]] = 1
_CHARACTER[[k for k in range(33, 127) if not chr(k).isalnum()]] = 2
_CHARACTER[[k for k in range(65, 123) if chr(k).isalpha()]] = 3

#: First bytes of what makes a text go to the library whole.
_DOUBTFUL = np.zeros(256, bool)
_DOUBTFUL[[*range(9), *range(11, 32), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3, ord("<")]] = True

_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_tokenizer(name: str) -> str:
    """Where the installed package has the file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def range_count(total: int, least: int) -> int:
    """Ranges of ids for so many bytes of text."""
    return max(least, min(MOST_RANGES, math.ceil(total / RANGE_BYTES)))


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """The written file: (shard, segment, doc_ids, n_ids, data); tokenizer: path of its file on every machine."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, size = [], 0

        def out() -> pa.RecordBatch:
            ids, lengths = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            row = [[shard], [number], [np.concatenate([h[0] for h in held]).tolist()], [len(ids)], [segment(ids, lengths)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, SEGMENTS.types)], SEGMENTS.names)

        for batch in batches:
            for part in slices(batch, most=1 << 20):
                ids, lengths = encoder(part.column("text"))
                ends = np.cumsum(lengths)
                ids, lengths = np.insert(ids, ends, end), lengths + 1
                names = np.array(part.column("id").to_pylist(), object)
                ends = np.cumsum(lengths)
                at = 0
                while at < len(names):  # documents until the segment is full
                    base = ends[at - 1] if at else 0
                    upto = max(at + 1, int(np.searchsorted(ends, base + SEGMENT_IDS - size, "right")))
                    held.append((names[at:upto], ids[base : ends[upto - 1]], lengths[at:upto]))
                    size += len(held[-1][1])
                    at = upto
                    if size >= SEGMENT_IDS:
                        yield out()
                        held, size, number = [], 0, number + 1
        if held:
            yield out()

    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = range_count(total, partitions(docs.sparkSession))
    order = ["id", "tie", "place"]  # a place tells equal rows apart, so that many of them can be divided
    placed = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text")
    return materialise(ordered.mapInArrow(write, "shard int, segment int, doc_ids array<long>, n_ids long, data binary"), "tokens")


SEGMENTS = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("data", pa.binary())])


def read_tokens(file: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lengths = read_segment(batch.column("data")[k].as_py())
                raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(lengths.astype(np.int64))
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                size = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, batch.column("shard")[k].as_py(), np.int32)),
                        pa.array(np.full(size, batch.column("segment")[k].as_py(), np.int32)),
                        batch.column("doc_ids")[k].values,
                        pa.array(ends // 4 - lengths),
                        pa.array(lengths, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["shard", "segment", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    shards = file.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    in_shard = Window.partitionBy("shard").orderBy("segment")
    starts = file.select("shard", "segment", (F.sum("n_ids").over(in_shard) - F.col("n_ids")).alias("at")).join(shards, "shard")
    docs = file.select("shard", "segment", "doc_ids", "data").mapInArrow(
        read, "shard int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long"
    )
    return docs.join(starts, ["shard", "segment"]).select("doc_id", F.expr("base + at + within").alias("start"), "n_tokens", "ids_crc32")
