"""Payloads in MPEG audio, and what its reader finds.

The stored form is an MPEG-1 Layer III stream of 48 kHz stereo: an ID3v2.3 tag with the payload's length, a frame with a
variable-bitrate table (frames, bytes, seek points), and frames whose side information claims no main data, so that their
bodies are free bytes and decoders play silence. Frames carry the standard's 16-bit checksum over header and side
information. Bodies hold the payload; the last frame has the least bitrate that holds the rest.

The reader takes any byte string. It skips tags and believes a header if another of the same version, layer and rate, or
the end, follows its frame, or if the checksum that it announces is right. Where a frame ends, one that isn't so confirmed
is believed as well, unless a confirmed one begins inside it; elsewhere it is junk, and the search goes on. The reader
verifies checksums of all layers, reads variable-bitrate tables of both kinds, and gives the exact duration from the samples
of the frames it saw, and the offset of each frame.

Defined cases: null or empty bytes have no frames, duration 0 and no payload, and a null or empty text is stored as a
payload of 64 bytes 0; what lies between frames, and a frame that the end cuts off, is counted as junk; the last 128 bytes
are a tag if they begin with TAG and no frame holds that place. A text of any length is one stream; batches are cut by
bytes, so long ones are taken alone. Rows that repeat an id are streams of their own; null ids are kept; an empty table
gives an empty result; other input columns aren't read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialise, small_batches
from ._words import slices

#: Fixed values of MPEG audio: kbit/s by version (1, else 2) and layer, Hz of MPEG-1.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = (44100, 48000, 32000)
UNIT = 64
SIDE = 32
HEAD = 4 + 2 + SIDE


#: Entries that are remembered of what depends on foreign bytes.
REMEMBERED = 4096
#: Bytes of texts or streams that are taken at once.
SLICE = 4 << 20


@lru_cache(REMEMBERED)
def crc16(data: bytes, bits: int | None = None) -> int:
    """Polynomial 0x8005, from 0xFFFF, upper bit first, over the first ``bits``, or all."""
    crc, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        for k in range(7, 7 - min(8, left), -1):
            crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ byte >> k) & 1 else 0)) & 0xFFFF
        left -= 8
        if left <= 0:
            break
    return crc


#: Fixed values of Layer II: bits of the allocation of each subband, by table.
ALLOCATION = {
    "a": [4] * 11 + [3] * 12 + [2] * 4,
    "b": [4] * 11 + [3] * 12 + [2] * 7,
    "c": [4] * 2 + [3] * 6,
    "d": [4] * 2 + [3] * 10,
    "low": [4] * 4 + [3] * 7 + [2] * 19,
}


def _checked_bits(header: bytes, rest: bytes) -> int | None:
    """Bits after header and checksum that the checksum covers; None if the frame is too short for them."""
    version, layer, hz, size, _, _, side = frame_of(header)
    mode, extension = header[3] >> 6, header[3] >> 4 & 3
    channels = 1 if mode == 3 else 2
    if layer == 3:
        return 8 * side if len(rest) >= side else None
    bound = 4 * (extension + 1) if mode == 1 else 32
    if layer == 1:
        return 4 * (bound * channels + 32 - bound)
    kbits = KBITS[1 if version == 1 else 2, 2][header[2] >> 4] // channels
    if version != 1:
        table = "low"
    elif kbits >= 56:
        table = "a" if hz == 48000 or kbits <= 80 else "b"
    else:
        table = "d" if hz == 32000 else "c"
    number, at, used = int.from_bytes(rest[:64].ljust(64, b"\0"), "big"), 0, 0
    for band, width in enumerate(ALLOCATION[table]):
        shared = channels == 2 and band >= bound
        for _ in range(1 if shared else channels):
            chosen = number >> 512 - at - width & (1 << width) - 1
            used += (channels if shared else 1) * (chosen > 0)
            at += width
    return at + 2 * used if 8 * len(rest) >= at + 2 * used else None


def checksum_right(frame: bytes) -> bool | None:
    """Whether a frame's checksum is right; None without one."""
    if not frame_of(frame[:4])[4]:
        return None
    bits = _checked_bits(frame[:4], frame[6:])
    if bits is None:
        return False
    covered = frame[2:4] + frame[6 : 6 + (bits + 7) // 8]
    return crc16(covered, 16 + bits) == int.from_bytes(frame[4:6], "big")


@lru_cache(REMEMBERED)
def frame_of(header: bytes) -> tuple[int, int, int, int, bool, int, int] | None:
    """(version, layer, Hz, bytes, checksum, samples, side bytes) of a header; None if it isn't one."""
    if len(header) < 4 or header[0] != 0xFF or header[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(header[1] >> 3 & 3)
    layer, rate, hertz = 4 - (header[1] >> 1 & 3), header[2] >> 4, header[2] >> 2 & 3
    if version is None or layer == 4 or rate in (0, 15) or hertz == 3 or header[3] & 3 == 2:
        return None
    old = 1 if version == 1 else 2
    hz = HERTZ[hertz] // (1 if version == 1 else 2 if version == 2 else 4)
    samples = 384 if layer == 1 else 576 if layer == 3 and old == 2 else 1152
    padding = header[2] >> 1 & 1
    bits = KBITS[old, layer][rate] * 1000
    size = (12 * bits // hz + padding) * 4 if layer == 1 else samples // 8 * bits // hz + padding
    mono = header[3] >> 6 == 3
    side = 0 if layer < 3 else (17 if mono else 32) if old == 1 else (9 if mono else 17)
    return version, layer, hz, size, not header[1] & 1, samples, side


def _header(rate: int) -> bytes:
    return bytes([0xFF, 0xFA, rate << 4 | 1 << 2, 0])


@cache
def _start(rate: int) -> bytes:
    """Header, checksum and empty side information."""
    head = _header(rate)
    return head + crc16(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)


@cache
def _sizes() -> tuple[int, ...]:
    return tuple(frame_of(_header(rate))[3] if rate else 0 for rate in range(15))


def _rate_for(body: int) -> int:
    return next(rate for rate in range(1, 15) if _sizes()[rate] - HEAD >= body)


def pad(text: bytes) -> bytes:
    """``text`` and bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _synchsafe(n: int) -> bytes:
    return bytes(n >> 7 * k & 0x7F for k in (3, 2, 1, 0))


def store(payload: bytes, n_bytes: int) -> bytes:
    """A stream with this payload; n_bytes: how many of it are text."""
    said = b"\x00payload\x00" + f"{len(payload)}/{n_bytes}".encode()
    tag = b"TXXX" + len(said).to_bytes(4, "big") + b"\0\0" + said
    out = [b"ID3\x03\x00\x00" + _synchsafe(len(tag)) + tag]
    body = _sizes()[14] - HEAD
    frames = []
    for at in range(0, len(payload), body):
        part = payload[at : at + body]
        rate = 14 if len(part) == body else _rate_for(len(part))
        frames.append(_start(rate) + part + bytes(_sizes()[rate] - HEAD - len(part)))
    table = _rate_for(4 + 4 + 4 + 4 + 100)
    size = _sizes()[table]
    offsets, total = [size], size
    for f in frames:
        total += len(f)
        offsets.append(total)
    points = bytes(min(255, 256 * offsets[len(frames) * k // 100] // total) for k in range(100))
    xing = _start(table) + b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + points
    out += [xing + bytes(size - len(xing)), *frames]
    return b"".join(out)


def _tags(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes of tags in front, user text fields)."""
    at, fields = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = sum((b & 0x7F) << 7 * k for b, k in zip(data[at + 6 : at + 10], (3, 2, 1, 0)))
        here, end = at + 10, min(len(data), at + 10 + size)
        while here + 10 <= end and data[here : here + 4].isalnum():
            length = int.from_bytes(data[here + 4 : here + 8], "big")
            if data[here : here + 4] == b"TXXX" and data[here + 10 : here + 11] == b"\0":
                name, _, value = data[here + 11 : here + 10 + length].partition(b"\0")
                fields[name.decode("latin1")] = value.decode("latin1")
            here += 10 + length
        at = end
    return at, fields


def _table(frame: bytes, start: int) -> dict | None:
    """The variable-bitrate table of a frame, of either kind; start: where its body begins."""
    body = frame[start:]
    if body[:4] in (b"Xing", b"Info"):
        flags, here, table = int.from_bytes(body[4:8], "big"), 8, {"frames": None, "bytes": None, "points": []}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                table[name] = int.from_bytes(body[here : here + 4], "big")
                here += 4
        table["points"] = [*body[here : here + 100]] if flags & 4 else []
        return table
    body = frame[36:]
    if body[:4] == b"VBRI" and len(body) >= 26:
        size, frames = (int.from_bytes(body[k : k + 4], "big") for k in (10, 14))
        entries, scale, width = (int.from_bytes(body[k : k + 2], "big") for k in (18, 20, 22))
        points = [body[26 + k * width : 26 + (k + 1) * width] for k in range(entries)] if width in (1, 2, 3, 4) else []
        return {"frames": frames, "bytes": size, "points": [scale * int.from_bytes(p, "big") for p in points if len(p) == width]}
    return None


class _Stream:
    """The frames of a stream, between its tags."""

    def __init__(self, data: bytes, end: int):
        self.data, self.end, self.kind = data, end, None

    def frame(self, at: int) -> int:
        """Bytes of the frame that begins here; 0 if none of the stream's kind does, or the end cuts it off."""
        found = frame_of(self.data[at : at + 4])
        if found is None or at + found[3] > self.end or self.kind not in (None, found[:3]):
            return 0
        return found[3]

    def confirmed(self, at: int) -> bool:
        size = self.frame(at)
        if not size:
            return False
        if at + size == self.end:
            return True
        following = frame_of(self.data[at + size : at + size + 4])
        if following and following[:3] == frame_of(self.data[at : at + 4])[:3]:
            return True
        return checksum_right(self.data[at : at + size]) is True

    def confirmed_between(self, at: int, end: int) -> int:
        """Where the first confirmed frame begins; ``end`` without one."""
        while (at := self.data.find(b"\xff", at, end)) >= 0:
            if self.confirmed(at):
                return at
            at += 1
        return end


def parse(data: bytes | None) -> dict:
    """What the stream holds: fields of tags, frames, offsets, samples, junk, failed checksums, the table, and bodies."""
    data = data or b""
    at, fields = _tags(data)
    out = {"fields": fields, "offsets": [], "samples": 0, "hertz": 0, "junk": 0, "bad_checksums": 0, "table": None, "bodies": []}
    first, end = True, len(data)
    if data[-128:-125] == b"TAG":
        end -= 128
    stream = _Stream(data, end)
    while at < end:
        found = frame_of(data[at : at + 4])
        if found and at < end < at + found[3] <= len(data) and stream.kind in (None, found[:3]):
            past = at + found[3]  # no tag, perhaps, but bytes of a frame
            if past == len(data) or (frame_of(data[past : past + 4]) or ())[:3] == found[:3]:
                stream.end = end = len(data)
        size = stream.frame(at)
        if not size or not (stream.confirmed(at) or (not first and stream.confirmed_between(at + 1, at + size) == at + size)):
            nearest = stream.confirmed_between(at + 1, end)
            out["junk"] += nearest - at
            at, first = nearest, first and nearest < end
            continue
        version, layer, hertz, _, checked, samples, side = found
        stream.kind = (version, layer, hertz)
        if checksum_right(data[at : at + size]) is False:
            out["bad_checksums"] += 1
        start = 4 + 2 * checked + side
        table = _table(data[at : at + size], start) if first else None
        if table:
            out["table"] = table
        else:
            out["offsets"].append(at)
            out["samples"] += samples
            out["hertz"] = hertz
            out["bodies"].append(data[at + start : at + size])
        first, at = False, at + size
    return out


MEDIA = "id long, n_bytes long, media binary"
READ = (
    "id long, n_bytes long, payload binary, media binary, frames long, samples long, hertz int, duration double, "
    "frame_offsets array<long>, table_frames long, table_bytes long, junk long, bad_checksums long, rates string"
)


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the stored form of each text; written to the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                texts = part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
                media = pa.array([store(pad(t), len(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(t) for t in texts], pa.int64()), media], ["id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(write, MEDIA), "media")


def read_media(stored: DataFrame) -> DataFrame:
    """The columns of ``READ`` from (id, media): duration in seconds, offsets of frames, the payload read back."""

    def one(data: bytes | None) -> dict:
        found = parse(data)
        size, _, text = found["fields"].get("payload", "0/0").partition("/")
        table = found["table"] or {}
        sizes = [b - a for a, b in pairwise([*found["offsets"], len(data or b"")])]
        return {
            "n_bytes": int(text),
            "payload": b"".join(found["bodies"])[: int(size)],
            "frames": len(found["offsets"]),
            "samples": found["samples"],
            "hertz": found["hertz"],
            "duration": found["samples"] / found["hertz"] if found["hertz"] else 0.0,
            "frame_offsets": found["offsets"],
            "table_frames": table.get("frames"),
            "table_bytes": table.get("bytes"),
            "junk": found["junk"],
            "bad_checksums": found["bad_checksums"],
            "rates": ",".join(map(str, dict.fromkeys(sizes))),
        }

    schema = pa.schema(
        [("n_bytes", pa.int64()), ("payload", pa.binary()), ("frames", pa.int64()), ("samples", pa.int64()), ("hertz", pa.int32())]
        + [("duration", pa.float64()), ("frame_offsets", pa.list_(pa.int64())), ("table_frames", pa.int64()), ("table_bytes", pa.int64())]
        + [("junk", pa.int64()), ("bad_checksums", pa.int64()), ("rates", pa.string())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", SLICE):
                found = pa.RecordBatch.from_pylist([one(x) for x in part.column("media").to_pylist()], schema=schema)
                named = {"id": part.column("id"), "media": part.column("media")} | {n: found.column(n) for n in schema.names}
                names = [c.split()[0] for c in READ.split(", ")]
                yield pa.RecordBatch.from_arrays([named[n] for n in names], names)

    small_batches(stored.sparkSession)
    return stored.select("id", "media").mapInArrow(read, READ)


def tail_crc32(payload: bytes) -> int:
    return zlib.crc32(payload[-UNIT:])
