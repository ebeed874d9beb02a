"""Media columns: bytes kept as Ogg streams of 8-bit samples.

Writing cuts each logical stream into packets and packs them into pages: a
packet's length is told by lacing values of 255 and a last one below, a page
holds up to 255 of those, and its checksum (CRC-32 with polynomial 04C11DB7, not
reflected) covers header and body. Reading verifies every page's checksum and
sequence number, reassembles packets over page borders from the lacing values,
takes the logical streams apart by serial number, and derives times from the
granule positions, which count samples.

A media value here has two streams: ``samples`` (unsigned 8-bit PCM at ``RATE``,
after a header packet) and ``length``, one packet with the number of payload
bytes before padding. Serial numbers come from the payload, so equal texts give
equal bytes.

Each value is written and read in its own row; nothing is shuffled and memory is
bounded by a few copies of the longest text.

Defined cases: a null text is the empty one; the payload of an empty text is 64
zero bytes; repeated rows stay; an empty table gives no rows; other columns are
not looked at.
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

from thicket.llm.kernels import map_rows, texts_of
from thicket.storage import Scratch

PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
RATE = 8000
PACKET = 4000
NO_PACKET_ENDS = -1
HEADER = b"\x7fPCM8" + struct.pack("<BIH", 1, RATE, PACKET)
_BITS_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """The page checksum. zlib's CRC is the same polynomial with all bits mirrored, so it is taken over mirrored bytes, from 0 and without the last inversion."""
    found = zlib.crc32(data.translate(_BITS_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(found.to_bytes(4, "little").translate(_BITS_TURNED), "big")


@dataclass
class Stream:
    """A logical stream: its packets, and the granule position at the end of each (as read: None where no page tells it)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    ended: bool = False


def pages(stream: Stream) -> Iterator[bytes]:
    """The pages of a stream; its first packet has a page of its own."""
    number, table, body, granule, flags = 0, bytearray(), [], NO_PACKET_ENDS, FIRST

    def page(last: bool) -> bytes:
        nonlocal number, table, body, granule, flags
        data = b"".join(body)
        head = PAGE.pack(b"OggS", 0, flags | LAST * last, granule, stream.serial, number, 0, len(table)) + table
        out = bytearray(head + data)
        out[22:26] = checksum(bytes(out)).to_bytes(4, "little")
        number, table, body, granule, flags = number + 1, bytearray(), [], NO_PACKET_ENDS, 0
        return bytes(out)

    last = len(stream.packets) - 1
    for i, (packet, at) in enumerate(zip(stream.packets, stream.granules)):
        lacing, offset = len(packet) // 255 + 1, 0
        while lacing:
            if len(table) == 255:
                yield page(False)
                flags = CONTINUED if offset else 0
            take = min(lacing, 255 - len(table))
            lacing -= take
            if lacing:
                piece, lace = packet[offset : offset + 255 * take], b"\xff" * take
            else:
                piece, lace = packet[offset:], b"\xff" * (take - 1) + bytes([len(packet) % 255])
                granule = at
            table += lace
            body.append(piece)
            offset += len(piece)
        if i == 0 and i < last:
            yield page(False)
    yield page(True)


def written(streams: list[Stream]) -> bytes:
    """Streams interleaved page by page, the first page of each ahead of all others."""
    own = [list(pages(s)) for s in streams]
    out = [p[0] for p in own]
    rest = [p[1:] for p in own]
    while any(rest):
        for r in rest:
            if r:
                out.append(r.pop(0))
    return b"".join(out)


def read(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number; ValueError on a broken page, a missing one or an unfinished packet."""
    streams: dict[int, Stream] = {}
    parts: dict[int, list[bytes]] = {}
    numbers: dict[int, int] = {}
    at = 0
    while at < len(data):
        magic, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        body = at + PAGE.size + n
        table = np.frombuffer(data, np.uint8, n, at + PAGE.size)
        end = body + int(table.sum())
        if end > len(data) or checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise ValueError(f"the page at byte {at} doesn't match its checksum")
        if flags & FIRST:
            streams[serial], parts[serial], numbers[serial] = Stream(serial), [], 0
        stream, waiting = streams[serial], parts[serial]
        if number != numbers[serial] or bool(flags & CONTINUED) != bool(waiting):
            raise ValueError(f"a page is missing before byte {at}")
        numbers[serial] += 1
        upto = body + np.cumsum(table, dtype=np.int64)
        ends = np.flatnonzero(table < 255)
        start = body
        for e in upto[ends].tolist():
            waiting.append(data[start:e])
            stream.packets.append(b"".join(waiting))
            stream.granules.append(None)
            waiting.clear()
            start = e
        if start < end or (n and table[-1] == 255):
            waiting.append(data[start:end])
        if len(ends):
            stream.granules[-1] = granule
        stream.ended = bool(flags & LAST)
        at = end
    if any(parts.values()) or not all(s.ended for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def times(stream: Stream, rate: int = RATE, packet: int = PACKET) -> list[tuple[float, float]]:
    """Start and end in seconds of each packet after the header; packets inside a page count back from its granule position."""
    found: list[tuple[float, float]] = []
    known = None
    for body, granule in zip(reversed(stream.packets[1:]), reversed(stream.granules[1:])):
        known = granule if granule is not None else known
        found.append(((known - len(body)) / rate, known / rate))
        known -= len(body)
    return found[::-1]


def padded(text: bytes, unit: int = 64) -> bytes:
    return text + bytes(-len(text) % unit if text else unit)


def encoded(text: bytes) -> bytes:
    payload = padded(text)
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min(i + PACKET, len(payload)) for i in range(0, len(payload), PACKET)]
    serial = zlib.crc32(payload)
    samples = Stream(serial, [HEADER, *packets], [0, *ends])
    length = Stream(serial ^ 1, [struct.pack("<Q", len(text))], [0])
    return written([samples, length])


def decoded(media: bytes) -> tuple[bytes, int, Stream, int]:
    """Payload, number of bytes before padding, the stream of samples, number of streams."""
    streams = read(media)
    samples = next(s for s in streams.values() if s.packets[0] == HEADER)
    length = streams[samples.serial ^ 1]
    return b"".join(samples.packets[1:]), struct.unpack("<Q", length.packets[0])[0], samples, len(streams)


def feature(payload: bytes, samples: Stream, n_streams: int) -> str:
    """Streams, packets, seconds, and of the samples around 128: mean, root mean square and share of changes of sign."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    spans = times(samples)
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    total, squares = int(x.sum()), int((x * x).sum())
    return f"streams={n_streams};packets={len(spans)};seconds={spans[-1][1]:.6f};mean={total / len(x):.4f};rms={(squares / len(x)) ** 0.5:.4f};turns={turns / len(x):.6f}"


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media: each text as an Ogg value."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = [encoded(t.encode()) for t in texts_of(batch, text_col)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)), pa.array(values, pa.binary())], ["doc_id", "media"])

    return map_rows(docs.select(id_col, text_col), work, f"doc_id {id_type}, media binary")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media() written to the shared folder and read back."""
    return Scratch().written(media(docs, id_col, text_col), "ogg-media", compression="zstd")


def features(values: DataFrame) -> DataFrame:
    """What is read back of doc_id, media: checked bytes, their digests and features."""
    id_type = values.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [part.split()[0] for part in schema.split(", ")]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for value in batch.column(batch.schema.get_field_index("media")):
            data = value.as_py()
            payload, n, samples, streams = decoded(data)
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, samples, streams)))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *columns], names)

    return map_rows(values.select("doc_id", "media"), work, schema)
