"""Words, and hashes of words and of runs of words, over whole Arrow columns with numpy.

A text is its UTF-8 bytes. Each word pattern used here separates words by single-byte characters, so a table over the
256 byte values tells word bytes apart and no text is decoded. Hashes are polynomials modulo 2^64 from prefix sums:
the hash of any run costs two look-ups, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\v\f\r"
U64 = np.uint64
#: Bytes of text that are taken at once; a longer single text is taken alone.
SLICE_BYTES = 1 << 19


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


mixed = _mixed


def _byte_values(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=U64)
    if fold:
        codes[65:91] += U64(32)
    return _mixed((codes + U64(1)) * U64(0x9E3779B97F4A7C15))


VALUES = {False: _byte_values(False), True: _byte_values(True)}


def class_of(separators: bytes) -> np.ndarray:
    """256 flags: true for a byte of a word."""
    out = np.ones(256, bool)
    out[np.frombuffer(separators, np.uint8)] = False
    return out


#: ``[^\x20\x09-\x0D]+``
PLAIN = class_of(SPACES)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on lower-cased text: digits, letters and all beyond ASCII.
ALNUM = class_of(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


class _Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, as long as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n >> 16) << 16
            grown = []
            for base in (self.base, self.inverse):
                steps = np.full(size, base, U64)
                steps[0] = 1
                grown.append(np.cumprod(steps, dtype=U64))
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


_BYTES = _Powers(0xD6E8FEB86659FD93)
_RUNS = (_Powers(0xA0761D6478BD642F), _Powers(0xE7037ED1A0B428DB))


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_binary())
    if values.null_count:
        values = values.fill_null(b"")
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, np.int64)[values.offset : values.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes in the column ``name`` each."""
    _, off = column(batch.column(name))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


class Words:
    """The words of a column of texts.

    start, end: byte offsets; first: for each text the index of its first word (one more entry at the end).
    """

    def __init__(self, values: pa.Array, table: np.ndarray = PLAIN, fold: bool = False):
        self.raw, self.offsets = column(values)
        self.fold, size = fold, len(self.raw)
        inside = table[self.raw]
        edge = np.zeros(size + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(size, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(size, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = _BYTES.upto(len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, U64)
        np.cumsum(VALUES[self.fold][self.raw] * up[:-1], out=sums[1:])
        return _mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U64))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes."""
    up, down = _BYTES.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(VALUES[False][raw] * up[:-1], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def run_hashes(words: np.ndarray, at: np.ndarray, length: int | np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of the runs of ``length`` words that start at ``at``; words: word hashes."""
    up, down = _RUNS[lane].upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[:-1], out=sums[1:])
    n = np.asarray(length)
    return _mixed((sums[at + n] - sums[at]) * down[at] + n.astype(U64) * U64(0x9E3779B97F4A7C15))


def run_starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all runs of ``length`` words inside one text, offsets of each text's runs among them)."""
    counts = np.maximum(np.diff(first) - (length - 1), 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    return np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], counts), offsets
