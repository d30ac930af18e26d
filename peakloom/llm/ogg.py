"""Operator 13: media columns in Ogg containers: writing, checked reading, packets, streams and times.

A container is a run of pages. Each carries the serial number of its logical stream, its own number in that stream, a
checksum, a granule position and lacing values, which cut its body into packets; a packet goes on over pages while
its lacing values are 255. Reading looks for the capture pattern, drops pages whose checksum is wrong, deals pages to
their streams, joins packets, drops those that a missing page has torn, and derives times from granule positions: a
page's position is the end of the last packet that ends on it, so the packets before it end as much earlier as the
later ones are long.

Texts are stored as two tracks of unsigned 8-bit samples, multiplexed: bytes with an even place and bytes with an odd
one. They come back by merging the tracks' samples in the order of their times. Equal texts give equal containers.

Null texts are empty ones; an empty text is stored as 64 zeros; null ids and repeated rows are rows of their own; an
empty table gives no rows. A null, empty or foreign media column gives no packets, and what is wrong is counted. A
task holds one slice of about a megabyte, or one longer text, with its container.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

# Fixed values of the container: capture pattern, header layout, flags, segments of a page, position of pages on which no packet ends.
CAPTURE, HEAD, SEGMENTS, NONE = b"OggS", struct.Struct("<4sBBqIIIB"), 255, -1
CONTINUED, FIRST, LAST = 1, 2, 4
# Fixed values of raw samples in it: identifier, versions, format (unsigned 8 bits), rate, bits, channels, frames of a packet, further headers.
SAMPLES, SAMPLES_ID, UNSIGNED_8 = struct.Struct(">8sHHIIBBHI"), b"PCM     ", 1
RATE, FRAMES, TRACKS, BLOCK = 8000, 16384, 2, 64
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(*parts: bytes) -> int:
    """The container's checksum (polynomial 04C11DB7, highest bit first, from 0), by way of the mirrored one of zlib."""
    value = 0xFFFFFFFF
    for part in parts:
        value = zlib.crc32(part.translate(_REVERSED), value)
    return int.from_bytes((value ^ 0xFFFFFFFF).to_bytes(4, "little").translate(_REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + checksum(head, body).to_bytes(4, "little") + head[26:] + body


def pages(packets: Sequence[tuple[bytes, int]], serial: int, heads: int) -> list[tuple[int, bytes]]:
    """Pages of one stream with the last position before or on each; ``packets``: data and end position.

    The first ``heads`` packets have pages of their own. A full page is closed inside a packet if need be.
    """
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, before, flags = bytearray(), [], NONE, 0, FIRST

    def close(last: bool) -> None:
        nonlocal lacing, body, granule, before, flags
        before = max(before, granule)
        out.append((before, page(flags | (LAST if last else 0), granule, serial, len(out), bytes(lacing), b"".join(body))))
        lacing, body, granule, flags = bytearray(), [], NONE, 0

    for i, (data, end) in enumerate(packets):
        values, at = b"\xff" * (len(data) // 255) + bytes([len(data) % 255]), 0
        while True:
            room = SEGMENTS - len(lacing)
            lacing += values[:room]
            size = 255 * room if len(values) > room else len(data) - at
            body.append(data[at : at + size])
            at, values = at + size, values[room:]
            if not values:
                break
            close(False)
            flags = CONTINUED
        granule = end
        if i < heads or i + 1 == len(packets) or len(lacing) == SEGMENTS:
            close(i + 1 == len(packets))
    return out


def multiplexed(streams: Sequence[list[tuple[int, bytes]]], heads: int) -> bytes:
    """One container: the first pages of all streams, then the other header pages, then the rest by position."""
    opening = [s[k][1] for k in range(heads) for s in streams]
    return b"".join(opening + [p for _, p in heapq.merge(*[s[heads:] for s in streams], key=lambda x: x[0])])


@dataclass
class Stream:
    """A logical stream as it is read: packets as (data, end position or None, end of page)."""

    serial: int
    packets: list[tuple[bytes, int | None]] = field(default_factory=list)
    number: int = -1
    open: list[bytes] | None = None
    pages: int = 0
    torn: int = 0
    ended: bool = False
    rate: int = 0
    width: int = 0

    def add(self, flags: int, granule: int, number: int, lacing: bytes, body: memoryview) -> None:
        gap = number != self.number + 1
        self.number, self.pages, self.ended = number, self.pages + 1, bool(flags & LAST)
        goes_on = bool(flags & CONTINUED)
        if self.open is not None and (gap or not goes_on):
            self.open, self.torn = None, self.torn + 1
        skip = goes_on and self.open is None  # its beginning is lost
        own = [] if self.open is None else self.open
        at, size, ended = 0, 0, []
        for value in lacing:
            size += value
            if value < 255:
                own.append(bytes(body[at : at + size]))
                at, size = at + size, 0
                if skip:
                    skip, self.torn = False, self.torn + 1
                else:
                    ended.append(b"".join(own))
                own = []
        if size or lacing[-1:] == b"\xff":
            own.append(bytes(body[at : at + size]))
            self.open = None if skip else own
        else:
            self.open = None
        if ended:
            self._timed(ended, granule)

    def _timed(self, ended: list[bytes], granule: int) -> None:
        if not self.packets and ended[0][:8] == SAMPLES_ID and len(ended[0]) >= SAMPLES.size:
            _, _, _, form, self.rate, bits, channels, _, _ = SAMPLES.unpack_from(ended[0])
            self.width = channels if form == UNSIGNED_8 and bits == 8 else 0
        ends: list[int | None] = [granule if granule != NONE else None] * len(ended)
        for i in range(len(ended) - 2, -1, -1):
            later = ends[i + 1]
            ends[i] = later - len(ended[i + 1]) // self.width if later is not None and self.width else None
        self.packets.extend(zip(ended, ends, strict=True))


def demultiplexed(data: bytes | None) -> tuple[dict[int, Stream], int]:
    """Streams by serial number, and how many pages were dropped: cut short or with a wrong checksum."""
    streams: dict[int, Stream] = {}
    bad, at, view = 0, 0, memoryview(data or b"")
    while view and (at := data.find(CAPTURE, at)) >= 0:
        body_at = at + HEAD.size + (view[at + 26] if at + HEAD.size <= len(view) else 0)
        lacing = bytes(view[at + HEAD.size : body_at])
        end = body_at + sum(lacing)
        if at + HEAD.size > len(view) or end > len(view):
            bad, at = bad + 1, at + 4
            continue
        _, _, flags, granule, serial, number, said, _ = HEAD.unpack_from(view, at)
        if checksum(bytes(view[at : at + 22]) + bytes(4) + view[at + 26 : at + 27], lacing, bytes(view[body_at:end])) != said:
            bad, at = bad + 1, at + 4
            continue
        streams.setdefault(serial, Stream(serial)).add(flags, granule, number, lacing, view[body_at:end])
        at = end
    for s in streams.values():
        s.torn += s.open is not None
    return streams, bad


def container(payload: bytes, rate: int = RATE) -> bytes:
    """A payload of even length as two tracks of samples."""
    flat = np.frombuffer(payload, np.uint8)
    streams = []
    for track in range(TRACKS):
        samples = flat[track::TRACKS].tobytes()
        note = f"TRACKNUMBER={track + 1}".encode()
        heads = [(SAMPLES.pack(SAMPLES_ID, 0, 0, UNSIGNED_8, rate, 8, 1, FRAMES, 0), 0), (struct.pack("<I8sII", 8, b"peakloom", 1, len(note)) + note, 0)]
        parts = [(samples[a : a + FRAMES], min(a + FRAMES, len(samples))) for a in range(0, len(samples), FRAMES)]
        streams.append(pages(heads + parts, track + 1, 2))
    return multiplexed(streams, 2)


def merged(streams: dict[int, Stream]) -> bytes:
    """The samples of all tracks in the order of their times, tracks of equal times by serial number."""
    tracks = []
    for serial in sorted(streams):
        parts = [(end, data) for data, end in streams[serial].packets[2:] if end is not None]
        tracks.append(np.frombuffer(b"".join(data for _, data in sorted(parts, key=lambda p: p[0])), np.uint8))
    if len({len(t) for t in tracks}) > 1:
        raise ValueError("tracks of different lengths: pages are missing")
    return np.stack(tracks, 1).tobytes() if tracks else b""


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the container of the text) of every row."""
    two = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [t.as_buffer().to_pybytes() if len(t.as_buffer() or b"") else b"" for t in part.column("text")]
                media = pa.array([container(padded(t)) for t in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return two.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, serial, packet (from 0), start_us, end_us and data of all packets of a column of containers.

    Times are null for headers, for packets of codecs whose lengths are not known but the last of a page, and where a
    page gives no position.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for key, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for serial, s in sorted(demultiplexed(data)[0].items()):
                        for i, (body, end) in enumerate(s.packets):
                            known = s.rate and i > 1 and end is not None
                            long = len(body) // s.width if s.width else None
                            rows.append((key, serial, i, (end - long) * 1_000_000 // s.rate if known and long is not None else None, end * 1_000_000 // s.rate if known else None, body))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                types = (part.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "serial", "packet", "start_us", "end_us", "data"])

    two = media.select(media[id_col].alias("id"), media[media_col].alias("media"))
    return two.mapInArrow(run, f"id {kind}, serial long, packet int, start_us long, end_us long, data binary")


def _feature(streams: dict[int, Stream], payload: bytes) -> str:
    """Counts, end time, and level, range and changes of sign (about 128) of the samples read back."""
    x = np.frombuffer(payload, np.uint8)
    high = x >= 128
    end = max((p[1] or 0) * 1_000_000 // s.rate for s in streams.values() for p in s.packets[-1:])
    parts = {
        "streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": sum(len(s.packets) for s in streams.values()), "end_us": end,
        "sum": int(x.sum(dtype=np.int64)), "low": int(x.min()), "high": int(x.max()), "crossings": int(np.count_nonzero(high[1:] != high[:-1])),
    }
    return " ".join(f"{k}={v}" for k, v in parts.items())


def inspected(media: DataFrame) -> DataFrame:
    """What the stored bytes give when they are read back, beside doc_id and n_bytes; bad or torn parts are an error."""
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for data in part.column("media").to_pylist():
                    streams, bad = demultiplexed(data)
                    if bad or any(s.torn or not s.ended for s in streams.values()):
                        raise ValueError("a stored container is damaged")
                    payload = merged(streams)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), _feature(streams, payload)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=[n.split()[0] for n in names.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, names)


def media_query(docs: DataFrame) -> DataFrame:
    """Texts stored as containers in the shared folder, and what reading them back gives."""
    return inspected(staged(stored(docs), "media"))
