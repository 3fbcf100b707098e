"""Media columns: text payloads as Ogg bitstreams of 8-bit samples.

``encode`` splits a payload's samples over two logical streams (packets go to
them in turn), multiplexes their pages and checks every page with the
container's CRC.  ``decode`` verifies page checksums, reassembles packets from
lacing values, demultiplexes the logical streams and derives each packet's
time from granule positions.  A page that fails its checksum, a gap in page
numbers or a truncated packet raises ``ValueError``.

Defined results: a null text counts as an empty one, its payload is 64 zero
bytes; equal texts give equal values, repeated rows a row each; a very long text is
stored whole, over as many pages as it needs; the table's other columns play no
part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import filled

RATE = 8000
PACKET = 4096
SERIALS = (0x53504431, 0x53504432)
_MAGIC = b"RAW8HEAD"
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, not reflected, from 0.

    zlib has the reflected form, so bytes and result are bit-reversed around it.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(size: int) -> bytes:
    """A packet's segment table: 255 as often as it fits, then a smaller value."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def _page(flags: int, granule: int, serial: int, number: int, table: bytes, body: bytes) -> bytes:
    blank = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(table)) + table + body
    return blank[:22] + checksum(blank).to_bytes(4, "little") + blank[26:]


def _stream(serial: int, packets: list[tuple[int, bytes]]) -> list[bytes]:
    """Pages of a logical stream; packets: (granule after it, bytes)."""
    pages, number = [], 0
    table, body, granule, flags = bytearray(), bytearray(), -1, 2
    for i, (position, packet) in enumerate(packets):
        values, taken = lacing(len(packet)), 0
        last = i == len(packets) - 1
        k = 0
        while k < len(values):
            room = min(255 - len(table), len(values) - k)
            size = sum(values[k : k + room])
            table += values[k : k + room]
            body += packet[taken : taken + size]
            k, taken = k + room, taken + size
            done = k == len(values)
            if done:
                granule = position
            if len(table) == 255 or (done and (i == 0 or last)):
                pages.append(_page(flags | (4 if last and done else 0), granule, serial, number, bytes(table), bytes(body)))
                number += 1
                table, body, granule, flags = bytearray(), bytearray(), -1, 0 if done else 1
    return pages


def encode(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """The payload as an Ogg file of two multiplexed logical streams."""
    parts: tuple[list, list] = ([], [])
    ends = [0, 0]
    for i, at in enumerate(range(0, len(payload), packet)):
        piece = payload[at : at + packet]
        ends[i % 2] += len(piece)
        parts[i % 2].append((ends[i % 2], piece))
    streams = []
    for k, serial in enumerate(SERIALS):
        header = _MAGIC + struct.pack("<IIQ", rate, packet, ends[k])
        streams.append(_stream(serial, [(0, header), *parts[k]]))
    longest = max(map(len, streams))
    return b"".join(s[i] for i in range(longest) for s in streams if i < len(s))


@dataclass
class Logical:
    packets: list[bytes] = field(default_factory=list)
    #: Samples after each packet where a page says so, else -1.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    number: int = 0
    open: bytearray = field(default_factory=bytearray)
    ended: bool = False


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """Flags, granule, serial, number, lacing values and body of every verified page."""
    at = 0
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise ValueError("truncated page header")
        capture, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(media, at)
        if capture != b"OggS" or version:
            raise ValueError("no page here")
        table = media[at + _HEAD.size : at + _HEAD.size + segments]
        end = at + _HEAD.size + segments + sum(table)
        page = media[at:end]
        if len(page) < end - at or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError("page checksum differs")
        yield flags, granule, serial, number, table, page[_HEAD.size + segments :]
        at = end


def demultiplex(media: bytes) -> dict[int, Logical]:
    """Logical streams by serial number, their packets reassembled."""
    found: dict[int, Logical] = {}
    for flags, granule, serial, number, table, body in pages(media):
        if flags & 2:
            found[serial] = Logical()
        s = found.get(serial)
        if s is None or s.ended or number != s.number or bool(flags & 1) != bool(s.open):
            raise ValueError("pages out of order")
        s.number, s.pages, s.ended = number + 1, s.pages + 1, bool(flags & 4)
        taken = size = 0
        for value in table:
            size += value
            if value < 255:
                s.packets.append(bytes(s.open) + body[taken : taken + size])
                s.granules.append(-1)
                s.open = bytearray()
                taken, size = taken + size, 0
        s.open += body[taken:]
        if granule >= 0 and s.granules:
            s.granules[-1] = granule
    if any(s.open or not s.ended for s in found.values()):
        raise ValueError("a logical stream has no end")
    return found


@dataclass
class Decoded:
    payload: bytes
    rate: int
    streams: int
    pages: int
    packets: int
    #: (start, end) in seconds of each data packet, by stream.
    times: list[list[tuple[float, float]]]


def decode(media: bytes) -> Decoded:
    """Read an Ogg file of ``encode`` back."""
    streams = demultiplex(media)
    data, times, rate = [], [], RATE
    for serial in sorted(streams):
        s = streams[serial]
        head = s.packets[0]
        if head[:8] != _MAGIC:
            raise ValueError("unknown codec header")
        rate, _, total = struct.unpack("<IIQ", head[8:24])
        end, own = 0, []
        for packet, granule in zip(s.packets[1:], s.granules[1:], strict=True):
            start, end = end, end + len(packet)
            if granule not in (-1, end):
                raise ValueError("granule position differs")
            own.append((start / rate, end / rate))
        if end != total:
            raise ValueError("samples are missing")
        data.append(s.packets[1:])
        times.append(own)
    order = [p for i in range(max(map(len, data), default=0)) for own in data if i < len(own) for p in [own[i]]]
    return Decoded(b"".join(order), rate, len(streams), sum(s.pages for s in streams.values()), len(order), times)


def padded(text: bytes, unit: int = 64) -> bytes:
    """The text with zero bytes up to a positive multiple of ``unit``."""
    return text + bytes(-len(text) % unit or (0 if text else unit))


def describe(decoded: Decoded) -> str:
    """A deterministic feature string of the samples and their times."""
    x = np.frombuffer(decoded.payload, np.uint8)
    n = len(x)
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    peak = int(np.bincount(x, minlength=256).argmax())
    last = max((t[-1][1] for t in decoded.times if t), default=0.0)
    container = f"streams={decoded.streams};pages={decoded.pages};packets={decoded.packets};samples={n};end_us={round(last * 1e6)}"
    return f"{container};mean={total / n:.4f};power={squares / n:.2f};crossings={crossings};peak={peak}"


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def summary(text: bytes) -> tuple:
    media = encode(padded(text))
    back = decode(media)
    p = back.payload
    return len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(back)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: digests of the stored media and of what is read back."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [summary(t.encode()) for t in filled(batch.column(1)).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = (pa.array(c, t) for c, t in zip(columns, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
