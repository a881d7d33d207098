"""Media columns: payloads carried losslessly in MPEG transport streams, and read back from them.

Writing: a program table (PAT, PMT), then one access unit for each 576 bytes of payload, as a PES
packet with a presentation timestamp in four transport packets. The first packet of a unit has an
adaptation field with the clock reference and, every RANDOM_ACCESS units, the random-access flag;
the last one is stuffed.

Reading takes any such stream: it finds the program map and the stream through the tables and
their CRC, counts breaks of the continuity counter, reassembles elementary packets from whatever
adaptation fields and lengths the packets state, and lists timestamps with random-access points.

Defined cases: a null text is the empty text; the empty payload is padded to one unit; a stream
whose tables are missing or broken gives an empty payload and `error` in the feature string.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_list, column, steps

UNIT = 576
PACKET = 188
PMT_PID, STREAM_PID, PROGRAM = 0x100, 0x101, 1
STREAM_TYPE = 0x06  # PES packets of private data
STREAM_ID = 0xBD
TICKS = 3600  # of the 90 kHz clock, a unit
RANDOM_ACCESS = 8
_STEP = 1 << 20


def crc_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def section(pid: int, body: bytes) -> bytes:
    """A packet with one table section; body lacks the CRC."""
    full = b"\0" + body + crc_mpeg(body).to_bytes(4, "big")
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10]) + full).ljust(PACKET, b"\xff")


def table_section(table: int, ident: int, rest: bytes) -> bytes:
    n = 5 + len(rest) + 4
    return bytes([table, 0xB0 | n >> 8, n & 255, ident >> 8, ident & 255, 0xC1, 0, 0]) + rest


TABLES = section(0, table_section(0, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))) + section(
    PMT_PID,
    table_section(2, PROGRAM, bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0])),
)


def _unit() -> np.ndarray:
    """The four packets of an access unit, without counter, times and payload."""
    p = np.full((4, PACKET), 255, np.uint8)
    p[:, 0], p[:, 1], p[:, 2], p[:, 3] = 0x47, STREAM_PID >> 8, STREAM_PID & 255, 0x10
    p[0, 1] |= 0x40
    p[0, 3] = p[3, 3] = 0x30
    p[0, 4], p[0, 5] = 7, 0x10  # adaptation field: clock reference
    p[0, 12:26] = [0, 0, 1, STREAM_ID, (UNIT + 8) >> 8, (UNIT + 8) & 255, 0x80, 0x80, 5, 0, 0, 0, 0, 0]
    rest = UNIT - (PACKET - 26) - 2 * (PACKET - 4)
    p[3, 4], p[3, 5] = PACKET - 5 - rest, 0
    return p


_TEMPLATE = _unit()
_FIRST, _LAST = PACKET - 26, UNIT - (PACKET - 26) - 2 * (PACKET - 4)


def pad(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b"\xff")


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload whose length is a multiple of UNIT."""
    body = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(body)
    p = np.tile(_TEMPLATE, (n, 1, 1))
    p[:, :, 3] |= (np.arange(4 * n) % 16).astype(np.uint8).reshape(n, 4)
    p[::RANDOM_ACCESS, 0, 5] |= 0x40
    t = np.arange(n, dtype=np.int64) * TICKS % (1 << 33)
    for k, shift in enumerate((25, 17, 9, 1)):  # 33 bits of clock, 6 reserved, 9 of extension
        p[:, 0, 6 + k] = t >> shift & 255
    p[:, 0, 10], p[:, 0, 11] = (t & 1) << 7 | 0x7E, 0
    p[:, 0, 21] = 0x21 | t >> 29 & 0x0E
    p[:, 0, 22], p[:, 0, 23] = t >> 22 & 255, t >> 14 & 0xFE | 1
    p[:, 0, 24], p[:, 0, 25] = t >> 7 & 255, t << 1 & 0xFE | 1
    p[:, 0, 26:] = body[:, :_FIRST]
    p[:, 1, 4:] = body[:, _FIRST : _FIRST + PACKET - 4]
    p[:, 2, 4:] = body[:, _FIRST + PACKET - 4 : UNIT - _LAST]
    p[:, 3, PACKET - _LAST :] = body[:, UNIT - _LAST :]
    return TABLES + p.tobytes()


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    breaks: int = 0  # of the continuity counter
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # their timestamps
    error: str = ""

    @property
    def feature(self) -> str:
        first, last = (self.pts[0], self.pts[-1]) if self.pts else (None, None)
        x = {"packets": self.packets, "units": len(self.pts), "breaks": self.breaks, "first_pts": first, "last_pts": last, "random_access": self.random_access}
        return json.dumps(x | ({"error": self.error} if self.error else {}), separators=(",", ":"))


_CRC_SEEN: dict[bytes, bool] = {}


def read_section(p: np.ndarray) -> bytes | None:
    """The table section that starts in a packet, if its CRC is right."""
    raw = p.tobytes()
    start = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    start += 1 + raw[start]
    body = raw[start : start + 3 + ((raw[start + 1] & 15) << 8 | raw[start + 2])]
    if body not in _CRC_SEEN:
        if len(_CRC_SEEN) > 1000:
            _CRC_SEEN.clear()
        _CRC_SEEN[body] = len(body) > 12 and crc_mpeg(body) == 0
    return body if _CRC_SEEN[body] else None


def demux(media: bytes) -> Stream:
    if not media or len(media) % PACKET:
        return Stream(error="length")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    out = Stream(packets=len(p))
    if (p[:, 0] != 0x47).any():
        out.error = "sync"
        return out
    pid = (p[:, 1].astype(np.int64) & 31) << 8 | p[:, 2]
    start = p[:, 1] & 0x40 > 0

    def table(which: int) -> bytes | None:
        for k in np.flatnonzero((pid == which) & start).tolist():
            if (s := read_section(p[k])) is not None:
                return s
        return None

    pat = table(0)
    pmt_pid = next((((pat[k + 2] & 31) << 8 | pat[k + 3]) for k in range(8, len(pat) - 4, 4) if pat[k] or pat[k + 1]), None) if pat else None
    pmt = table(pmt_pid) if pmt_pid is not None else None
    if pmt is None:
        out.error = "tables"
        return out
    k = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    if k + 5 > len(pmt) - 4:
        out.error = "no stream"
        return out
    stream = (pmt[k + 1] & 31) << 8 | pmt[k + 2]
    q, begins = p[pid == stream], start[pid == stream]
    kind, counter = q[:, 3] >> 4 & 3, q[:, 3].astype(np.int64) & 15
    carries, adapts = kind & 1 > 0, kind & 2 > 0
    at = np.flatnonzero(carries)
    if len(at) > 1:  # a packet may be sent twice, one after the other: the second is left out
        again = (counter[at[1:]] == counter[at[:-1]]) & (q[at[1:]] == q[at[:-1]]).all(1)
        again[1:] &= ~again[:-1]
        keep = np.ones(len(q), bool)
        keep[at[1:][again]] = False
        q, begins, counter, carries, adapts = (x[keep] for x in (q, begins, counter, carries, adapts))
    seen = counter[carries]
    told = (adapts & (q[:, 4] > 0) & (q[:, 5] & 0x80 > 0))[carries]  # a break that the stream itself announces
    out.breaks = int(((seen[1:] != (seen[:-1] + 1) % 16) & ~told[1:]).sum())
    skip = np.where(adapts, 5 + q[:, 4].astype(np.int64), 4)
    skip[~carries] = PACKET
    flags = np.where(adapts & (q[:, 4] > 0), q[:, 5], 0)
    whole = q[np.arange(PACKET) >= skip[:, None]]
    size = PACKET - skip
    ends = np.cumsum(size)
    head = (ends - size)[begins]  # where elementary packets start
    if not len(head) or int(head[-1]) + 14 > len(whole):
        out.error = "no units"
        return out
    h = whole[head[:, None] + np.arange(14)].astype(np.int64)
    if ((h[:, 0] != 0) | (h[:, 1] != 0) | (h[:, 2] != 1)).any():
        out.error = "start code"
        return out
    stop = np.append(head[1:], len(whole))
    stated = h[:, 4] << 8 | h[:, 5]
    if ((stated > 0) & (head + 6 + stated > stop)).any():
        out.error = "short unit"
    stop = np.where(stated > 0, np.minimum(stop, head + 6 + stated), stop)
    first = head + 9 + h[:, 8]
    timed = h[:, 7] & 0x80 > 0
    pts = (h[:, 9] >> 1 & 7) << 30 | h[:, 10] << 22 | h[:, 11] >> 1 << 15 | h[:, 12] << 7 | h[:, 13] >> 1
    out.pts = pts[timed].tolist()
    out.random_access = pts[timed & (flags[begins] & 0x40 > 0)].tolist()
    delta = np.zeros(len(whole) + 1, np.int8)
    np.add.at(delta, first, 1)
    np.add.at(delta, stop, -1)
    out.payload = whole[np.cumsum(delta[:-1], dtype=np.int8) > 0].tobytes()
    return out


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media, the transport stream of the padded text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, size=_STEP):
            texts = byte_list(column(b, "text"))
            yield pa.record_batch([column(b, "doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(pad(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """What each stored stream holds: digests of payload and stream, timestamps and random-access points."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "breaks", "pts", "random_access"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "media", _STEP):
            rows = []
            for m in byte_list(column(b, "media")):
                s = demux(m)
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), s.feature, s.breaks, s.pts, s.random_access))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.record_batch([column(b, "doc_id"), column(b, "n_bytes"), *cols], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, breaks long, pts array<long>, random_access array<long>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(apply, schema)
