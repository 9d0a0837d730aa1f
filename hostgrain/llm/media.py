"""Media columns: bytes kept as MPEG transport streams (ISO/IEC 13818-1).

The payload is cut into access units. Each becomes one elementary packet (PES) with a presentation time
stamp, spread over 188-byte transport packets with continuity counters. Every few units a random-access
point begins: the program tables (PAT, PMT) are repeated, and the unit's first packet carries the random
access flag and a clock reference. Reading parses the tables to find the elementary stream, checks the
counters, reassembles the elementary packets and returns the payload with the units' time stamps and
random-access points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
PACKET = 188
SYNC = 0x47
PES_START = b"\x00\x00\x01"
PRIVATE_STREAM_1 = 0xBD
PRIVATE_DATA = 0x06

#: Of streams written here.
PMT_PID, DATA_PID = 0x100, 0x101
UNIT_BYTES = 32_768
UNITS_BETWEEN_POINTS = 4
TICKS = 3600  # of 90 kHz: 25 units a second
BATCH_BYTES = 16 << 20

UNITS = "array<struct<pts:bigint,packet:bigint,n_bytes:bigint,random_access:boolean>>"


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of program table sections: most significant bit first, not inverted."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, id: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + id.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


_TABLES = np.stack([
    _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))),
    _table_packet(PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")),
])


def _stamp(pts: int) -> bytes:
    """33 bits in five bytes with marker bits, as a PES header has them."""
    return bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])


def _unstamp(b: bytes) -> int:
    return (b[0] & 14) << 29 | b[1] << 22 | (b[2] & 254) << 14 | b[3] << 7 | b[4] >> 1


def write_stream(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    parts, counter = [], 0
    for k, at in enumerate(range(0, max(len(payload), 1), UNIT_BYTES)):
        unit = payload[at : at + UNIT_BYTES]
        pts = (k * TICKS) % (1 << 33)
        pes = np.frombuffer(PES_START + bytes([PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + unit, np.uint8)
        point = k % UNITS_BETWEEN_POINTS == 0
        if point:
            tables = _TABLES.copy()
            tables[:, 3] |= k // UNITS_BETWEEN_POINTS & 15
            parts.append(tables)
        # Flags, then a clock reference: 33 bits of 90 kHz, 6 reserved, 9 of 27 MHz.
        field = bytes([7, 0x50]) + (pts << 15 | 0x7E00).to_bytes(6, "big") if point else b""
        first = min(len(pes), PACKET - 4 - len(field))
        n = 1 + -(-(len(pes) - first) // 184)
        packets = np.full((n, PACKET), 255, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        packets[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        packets[0, 1] |= 0x40
        counter += n
        _fill(packets[0], field, pes[:first])
        if n > 1:
            rest = pes[first:]
            packets[1 : n - 1, 4:] = rest[: (n - 2) * 184].reshape(-1, 184)
            _fill(packets[n - 1], b"", rest[(n - 2) * 184 :])
        parts.append(packets)
    return np.concatenate(parts).tobytes()


def _fill(packet: np.ndarray, field: bytes, data: np.ndarray) -> None:
    """Data at the packet's end; what room is left goes to the adaptation field as stuffing."""
    room = PACKET - 4 - len(data)
    if room:
        packet[3] |= 0x20
        if room > 1:
            field = field or b"\x00\x00"
            packet[4 : 4 + len(field)] = np.frombuffer(field, np.uint8)
        packet[4] = room - 1
    packet[4 + room :] = data


def _sections(packets: np.ndarray, pid: np.ndarray, wanted: int, table_id: int) -> bytes | None:
    """The first whole section of a table, without its CRC; None if none is sound."""
    for p in packets[(pid == wanted) & (packets[:, 1] & 0x40 > 0)]:
        at = 4 + (1 + p[4] if p[3] & 0x20 else 0)
        at += 1 + int(p[at]) if at < PACKET else 0
        if at + 3 > PACKET or p[at] != table_id:
            continue
        end = at + 3 + ((int(p[at + 1]) & 15) << 8 | int(p[at + 2]))
        if end <= PACKET and section_crc(s := p[at:end].tobytes()) == 0:
            return s[:-4]
    return None


def read_stream(media: bytes) -> tuple[bytes, list[tuple[int, int, int, bool]], int, int]:
    """Payload, units (time stamp, packet number, bytes, random access), continuity errors, damaged units.

    A stream without sound program tables or sync bytes has no units. A unit whose counters don't follow one
    another, or that is shorter than its header says, counts as damaged and is left out of the payload.
    """
    n = len(media) // PACKET
    packets = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    packets = packets[packets[:, 0] == SYNC]
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    if (pat := _sections(packets, pid, 0, 0)) is None or len(pat) < 12:
        return b"", [], 0, 0
    pmt_pid = (pat[10] & 31) << 8 | pat[11]
    if (pmt := _sections(packets, pid, pmt_pid, 2)) is None or len(pmt) < 12:
        return b"", [], 0, 0
    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    while at + 5 <= len(pmt) and pmt[at] != PRIVATE_DATA:
        at += 5 + ((pmt[at + 3] & 15) << 8 | pmt[at + 4])
    if at + 5 > len(pmt):
        return b"", [], 0, 0
    number = np.flatnonzero(pid == ((pmt[at + 1] & 31) << 8 | pmt[at + 2]))
    own = packets[number]
    if not len(own):
        return b"", [], 0, 0
    counter = own[:, 3] & 15
    breaks = np.concatenate([[False], (counter[1:] - counter[:-1]) & 15 != 1])
    has_field = own[:, 3] & 0x20 > 0
    start = np.where(has_field, 5 + own[:, 4].astype(np.int64), 4)
    access = has_field & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    data = own[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(np.maximum(PACKET - start, 0))
    begins = np.flatnonzero(own[:, 1] & 0x40)
    payload, units, damaged = [], [], 0
    for i, b in enumerate(begins.tolist()):
        last = int(begins[i + 1]) if i + 1 < len(begins) else len(own)
        pes = data[int(ends[b - 1]) if b else 0 : int(ends[last - 1])]
        length = int.from_bytes(pes[4:6], "big")
        if len(pes) < 14 or pes[:3] != PES_START or len(pes) < 6 + length or breaks[b + 1 : last].any():
            damaged += 1
            continue
        unit = pes[9 + pes[8] : 6 + length]
        payload.append(unit)
        units.append((_unstamp(pes[9:14]), int(number[b]), len(unit), bool(access[b])))
    return b"".join(payload), units, int(breaks.sum()), damaged


def _by_bytes(rows: Iterator[tuple], size, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept, n = [], 0
    for r in rows:
        kept.append(r)
        n += size(r)
        if n > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept, n = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def to_streams(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``n_bytes`` (UTF-8 of the text) and ``media``: its bytes, filled with zeros up to a positive
    multiple of 64, as a transport stream. Null counts as empty; repeated rows stay; an empty table gives an
    empty result; other columns are not looked at. Equal texts give equal streams."""
    field = docs.select(F.col(id).alias("doc_id"))

    def run(batches):
        for b in batches:
            schema = pa.schema([("doc_id", b.column(0).type), ("n_bytes", pa.int64()), ("media", pa.binary())])
            rows = ((d, len(raw := t or b""), write_stream(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"))) for d, t in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True))
            yield from _by_bytes(rows, lambda r: len(r[2]), schema)

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("binary").alias("_raw"))
    return rows.mapInArrow(run, f"doc_id {field.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def from_streams(media: DataFrame) -> DataFrame:
    """Adds to to_streams' rows ``payload``, ``units`` (time stamps and random-access points),
    ``continuity_errors`` and ``damaged``, all read from the stored bytes. Null media reads as empty."""
    kind = media.select("doc_id").schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            unit = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("n_bytes", pa.int64()), ("random_access", pa.bool_())]))
            schema = pa.schema([("doc_id", b.column(0).type), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("units", unit), ("continuity_errors", pa.int64()), ("damaged", pa.int64())])
            names = ("pts", "packet", "n_bytes", "random_access")

            def rows():
                for d, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x.as_py() for x in b.column(2)), strict=True):
                    payload, units, errors, damaged = read_stream(m or b"")
                    yield d, n, m, payload, [dict(zip(names, u, strict=True)) for u in units], errors, damaged

            yield from _by_bytes(rows(), lambda r: len(r[2] or b"") + len(r[3]), schema)

    out = f"doc_id {kind}, n_bytes long, media binary, payload binary, units {UNITS}, continuity_errors long, damaged long"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, out)


def digest(read: DataFrame) -> DataFrame:
    """Sizes, checksums and a line of features of from_streams' rows."""
    points = F.filter("units", lambda u: u["random_access"])
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("units="), F.size("units")), F.concat(F.lit("points="), F.size(points)),
        F.concat(F.lit("point_packets="), F.array_join(F.transform(points, lambda u: u["packet"].cast("string")), ",")),
        F.concat(F.lit("last_pts="), F.coalesce(F.array_max(F.transform("units", lambda u: u["pts"])), F.lit(-1))),
        F.concat(F.lit("continuity_errors="), "continuity_errors"), F.concat(F.lit("damaged="), "damaged"),
    )
    size = F.octet_length("payload")
    return read.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
