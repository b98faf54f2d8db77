"""MPEG audio columns (operator 5).

``store`` writes a byte payload as a valid MPEG-1 Layer III stream: an ID3v2.4 tag with the payload's
length, a Xing frame with frame count, byte count and seek table, then checksummed frames of silence
whose ancillary bytes are the payload. ``MpegAudio`` reads any MPEG audio stream: it skips tags,
resynchronises on frame headers (a header counts only if another of its kind or the stream's end
follows), takes an ID3v1 tag only where no frame covers its place, parses Xing, Info and VBRI tables,
verifies each frame's CRC-16, and keeps the exact duration (samples and rate), the offset of every
frame and a seek offset for each second.

A null text is an empty payload (64 zero bytes once padded). Equal texts give equal streams. Bytes
that are no stream give zero frames and an empty payload.
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
from pyspark.sql import functions as F

from stratalens.llm.shared import doc_rows

# Fixed values of the format: kbit/s by (version 1 or 2, layer) and rates in Hz by version.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    crc: bool
    kbps: int
    rate: int
    padding: int
    mono: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != 1.0 else 1152

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12_000 * self.kbps // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.kbps // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1.0 else (9 if self.mono else 17)

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None where they are none (free format included)."""
    if four in _headers:
        return _headers[four]
    found = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version = {0: 2.5, 2: 2.0, 3: 1.0}.get(four[1] >> 3 & 3)
        layer = 4 - (four[1] >> 1 & 3)
        bit, rate = four[2] >> 4, four[2] >> 2 & 3
        if version and layer < 4 and 0 < bit < 15 and rate < 3 and four[3] & 3 != 2:
            found = Header(version, layer, not four[1] & 1, BITRATES[1 if version == 1.0 else 2, layer][bit - 1], RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6 == 3)
    if len(_headers) < 100_000:
        _headers[four] = found
    return found


def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
    return crc


@dataclass
class MpegAudio:
    """What a stream holds. ``sound`` counts frames whose checksum is right, ``checked`` those that have one."""

    data: bytes
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    first: Header | None = None
    samples: int = 0
    kbps: set[int] = field(default_factory=set)
    checked: int = 0
    sound: int = 0
    skipped: int = 0
    ancillary: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._frames(self._leading(), len(self.data))

    @property
    def rate(self) -> int:
        return self.first.rate if self.first else 0

    def seek_offsets(self) -> list[int]:
        """Offset of the frame that plays at each whole second."""
        if not self.first:
            return []
        per, rate, n = self.first.samples, self.rate, len(self.offsets)
        return [self.offsets[k] for s in range(-(-self.samples // rate)) if (k := s * rate // per) < n]

    def payload(self) -> bytes:
        raw = b"".join([self.data[a:b] for a, b in self.ancillary])
        size = self.tags.get("payload_bytes", "")
        return raw[: int(size)] if size.isdigit() else raw

    def _leading(self) -> int:
        d, at = self.data, 0
        while d[at : at + 3] == b"ID3" and len(d) >= at + 10:
            size = 0
            for b in d[at + 6 : at + 10]:
                size = size << 7 | b & 127
            self._id3(at + 10, min(at + 10 + size, len(d)), d[at + 3])
            at += 10 + size + (10 if d[at + 5] & 16 else 0)
        return at

    def _id3(self, at: int, end: int, major: int) -> None:
        d = self.data
        while major >= 3 and at + 10 <= end and d[at]:
            name = d[at : at + 4].decode("latin-1")
            raw = d[at + 4 : at + 8]
            size = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if major == 4 else int.from_bytes(raw, "big")
            body = d[at + 10 : min(at + 10 + size, end)]
            if name[0] == "T" and body:
                coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                parts = body[1:].decode(coding, "replace").split("\0")
                if name == "TXXX" and len(parts) > 1:
                    self.tags[parts[0]] = parts[1]
                else:
                    self.tags[name] = parts[0]
            at += 10 + size

    def _trailing(self, at: int) -> None:
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            self.tags.setdefault(name, self.data[at + a : at + b].rstrip(b"\0 ").decode("latin-1"))

    def _frames(self, at: int, end: int) -> None:
        d, sound = self.data, {}
        before = None
        whole, tag = end, end - 128
        if tag >= at and d[tag : tag + 3] == b"TAG":
            end = tag
        while at + 4 <= end:
            h = header(d[at : at + 4])
            if h is not None and end < at + h.size <= whole and (before is None or h.kind == before.kind) and self._follows(h, at + h.size, whole):
                end = whole  # a whole frame covers the place: its bytes only look like a tag
            if h is None or at + h.size > end or before is not None and h.kind != before.kind or before is None and not self._follows(h, at + h.size, end):
                nxt = d.find(b"\xff", at + 1, end)
                nxt = end if nxt < 0 else nxt
                self.skipped += nxt - at
                before = None
                at = nxt
                continue
            body = at + 4 + 2 * h.crc
            if h.crc and h.layer == 3:
                key = d[at + 2 : body + h.side]
                if key not in sound:
                    sound[key] = crc16(key[:2] + key[4:]) == int.from_bytes(key[2:4], "big")
                self.checked += 1
                self.sound += sound[key]
            if self.first is None and not self.table and self._table(h, at, body + h.side):
                self.table["at"] = at
            else:
                if self.first is None:
                    self.first = h
                self.offsets.append(at)
                self.samples += h.samples
                self.kbps.add(h.kbps)
                if h.layer == 3:
                    self.ancillary.append((body + h.side, at + h.size))
            before = h
            at += h.size
        self.skipped += max(0, end - at)
        if end < whole:
            self._trailing(end)

    def _follows(self, h: Header, at: int, end: int) -> bool:
        if at >= end:
            return at == end
        other = header(self.data[at : at + 4])
        return other is not None and other.kind == h.kind

    def _table(self, h: Header, at: int, side_end: int) -> bool:
        d = self.data
        if d[side_end : side_end + 4] in (b"Xing", b"Info"):
            self.table["kind"] = d[side_end : side_end + 4].decode()
            flags, p = int.from_bytes(d[side_end + 4 : side_end + 8], "big"), side_end + 8
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    raw = d[p : p + size]
                    self.table[name] = list(raw) if name == "toc" else int.from_bytes(raw, "big")
                    p += size
            return True
        p = at + 36
        if d[p : p + 4] == b"VBRI":
            size, frames, entries, scale, width = *struct.unpack(">II", d[p + 10 : p + 18]), *struct.unpack(">HHH", d[p + 18 : p + 24])
            toc = [int.from_bytes(d[p + 26 + width * i : p + 26 + width * (i + 1)], "big") * scale for i in range(entries)] if width else []
            self.table |= {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
            return True
        return False

    def feature(self) -> str:
        """One line of what was measured; the seek offsets and tables as digests."""
        if not self.first:
            return f"frames=0 skipped={self.skipped}"
        h, seek, t = self.first, self.seek_offsets(), self.table
        table_ok = bool(t) and t.get("frames") == len(self.offsets) and t.get("bytes") == len(self.data) - t["at"]
        digest = hashlib.sha256(np.asarray(self.offsets, "<i8").tobytes()).hexdigest()[:16]
        return (
            f"MPEG-{h.version:g} layer {h.layer} {h.rate} Hz {'mono' if h.mono else 'stereo'}; frames={len(self.offsets)}; samples={self.samples}; ms={self.samples * 1000 / h.rate:.3f}; "
            f"kbps={min(self.kbps)}-{max(self.kbps)}; crc={self.sound}/{self.checked}; table={t.get('kind', 'none')}:{'ok' if table_ok else 'off'}; skipped={self.skipped}; seeks={len(seek)}; offsets={digest}"
        )


def _head(kbps: int, crc: bool) -> bytes:
    """Header of a 48 kHz mono MPEG-1 Layer III frame."""
    return bytes([0xFF, 0xFA if crc else 0xFB, BITRATES[1, 3].index(kbps) + 1 << 4 | 1 << 2, 0xC0])


def _silent(kbps: int) -> bytes:
    """A checksummed frame's header, CRC and side information of silence."""
    h, side = _head(kbps, True), bytes(17)
    return h + crc16(h[2:] + side).to_bytes(2, "big") + side


_PREFIX = {k: _silent(k) for k in BITRATES[1, 3]}
_ROOM = {k: 3 * k - len(_PREFIX[k]) for k in BITRATES[1, 3]}


def write_stream(payload: bytes) -> bytes:
    """The payload as an MPEG-1 Layer III stream of variable bitrate."""
    top = BITRATES[1, 3][-1]
    room = _ROOM[top]
    k = len(payload) // room
    full = np.empty((k, 3 * top), np.uint8)
    full[:, : 3 * top - room] = np.frombuffer(_PREFIX[top], np.uint8)
    full[:, 3 * top - room :] = np.frombuffer(payload, np.uint8, k * room).reshape(k, room)
    parts, rest = [full.tobytes()], payload[k * room :]
    sizes = [3 * top] * k
    if rest:
        kbps = next(b for b in BITRATES[1, 3] if _ROOM[b] >= len(rest))
        parts.append(_PREFIX[kbps] + rest + bytes(_ROOM[kbps] - len(rest)))
        sizes.append(3 * kbps)
    info = 64  # kbit/s of the table's frame: 192 bytes
    total, n = 3 * info + sum(sizes), len(sizes)
    ends = [3 * info + 3 * top * i for i in range(n)]
    toc = bytes(min(255, 256 * ends[n * i // 100] // total) if n else 0 for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, total) + toc
    first = _head(info, False) + bytes(17) + table
    body = b"\x03payload_bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _syncsafe(len(frame)) + frame + first + bytes(3 * info - len(first)) + b"".join(parts)


def _syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def store(docs: DataFrame, block: int = 64) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media: each text's UTF-8 bytes, padded with zeros to a positive multiple of ``block``, as an MPEG stream."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [(x.as_py() or "").encode() for x in part.column("text")]
                size = [max(block, -(-len(x) // block) * block) for x in raw]
                media = [write_stream(x.ljust(n, b"\0")) for x, n in zip(raw, size, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])

    return doc_rows(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, media binary")


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """The columns of ``media`` but the stream, with what reading it gives: duration, frames, checksums, seek offsets, payload digests."""
    keep = [c for c in media.columns if c != column]
    made = "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sample_rate int, frames long, crc_ok boolean, seek_offsets array<long>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in made.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for x in part.column(column):
                    data = x.as_py() or b""
                    m = MpegAudio(data)
                    p = m.payload()
                    rows.append((hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), m.feature(), m.samples, m.rate, len(m.offsets), m.checked == m.sound, m.seek_offsets()))
                cols = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *cols], [*keep, *names])

    kept = ", ".join(f"`{c}` {t}" for c, t in media.dtypes if c != column)
    return media.select(*[F.col(f"`{c}`") for c in [*keep, column]]).mapInArrow(run, f"{kept}, {made}")
