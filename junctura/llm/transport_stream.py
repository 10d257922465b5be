"""Media columns: payloads stored as MPEG transport streams and read back.

mux() lays a payload out as 188-byte packets: a program association table, a program map table and packetised
elementary packets of up to UNIT bytes with presentation timestamps, each opened by a packet with the random-access
flag. demux() trusts only the bytes: it takes the program map's id from the association table and the elementary id
from the map (checking both CRCs), checks the continuity counter of every id, reassembles the elementary packets and
returns payload, timestamps and random-access points. Both work on the packets of one text as a numpy matrix.

Cases: a null text counts as empty; the payload is padded with bytes 0 to a positive multiple of 64, so it is never
empty. Equal texts and repeated rows give equal values. A very long text is one stream of as many units as it needs; no
more than a few MB of others share its batch. An empty table gives an empty one. Damaged streams raise StreamError.
Further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces_of, small_batches

NAME = "op7_transport_stream"
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PROGRAM, PRIVATE_DATA, STREAM_ID = 1, 0x06, 0xBD
#: Bytes of payload in an elementary packet, and ticks of the 90 kHz clock between two of them.
UNIT, TICKS = 16384, 3600


class StreamError(ValueError):
    pass


@dataclass
class Stream:
    payload: bytes
    pts: list[int]
    random_access: list[int]
    packets: int
    programs: dict[int, int] = field(default_factory=dict)


@lru_cache(maxsize=64)
def _crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (5 + len(body) + 4), ident, 0xC1, 0, 0) + body
    return head + struct.pack(">I", _crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000))
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 1 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 1 | (pts << 1) & 0xFE])


def _pes(data: bytes, pts: int) -> bytes:
    return b"\x00\x00\x01" + struct.pack(">BHBBB", STREAM_ID, 8 + len(data), 0x84, 0x80, 5) + _pts_bytes(pts) + data


def mux(payload: bytes) -> bytes:
    out, counter = [_tables()], 0
    for k in range(0, len(payload), UNIT):
        pes = _pes(payload[k : k + UNIT], (k // UNIT + 1) * TICKS % (1 << 33))
        # the first packet carries 2 bytes of adaptation field, the last is stuffed by one
        n = -(-max(0, len(pes) - 182) // 184) + 1
        rows = np.full((n, PACKET), 0xFF, np.uint8)
        rows[:, 0] = SYNC
        rows[:, 1], rows[:, 2] = DATA_PID >> 8, DATA_PID & 0xFF
        rows[0, 1] |= 0x40
        rows[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        flat = np.frombuffer(pes, np.uint8)
        rows[0, 3] |= 0x20
        first = min(182, len(flat))
        rows[0, 4], rows[0, 5] = 183 - first, 0x40
        rows[0, PACKET - first :] = flat[:first]
        if n > 1:
            whole = (n - 2) * 184
            rows[1 : n - 1, 4:] = flat[first : first + whole].reshape(n - 2, 184)
            left = flat[first + whole :]
            if len(left) < 184:
                rows[n - 1, 3] |= 0x20
                rows[n - 1, 4] = 183 - len(left)
                if len(left) < 183:
                    rows[n - 1, 5] = 0
            rows[n - 1, PACKET - len(left) :] = left
        counter = (counter + n) & 15
        out.append(rows.tobytes())
    return b"".join(out)


def _read_section(row: np.ndarray, table: int) -> bytes:
    raw = row.tobytes()
    at = 5 + raw[4]
    size = struct.unpack(">H", raw[at + 1 : at + 3])[0] & 0xFFF
    section = raw[at : at + 3 + size]
    if section[0] != table or _crc32_mpeg(section[:-4]) != struct.unpack(">I", section[-4:])[0]:
        raise StreamError("bad table")
    return section[8:-4]


def demux(stream: bytes) -> Stream:
    if not stream or len(stream) % PACKET:
        raise StreamError("not whole packets")
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise StreamError("lost synchronisation")
    pid = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    starts = (rows[:, 1] & 0x40) != 0
    programs: dict[int, int] = {}
    streams: list[int] = []
    for row in rows[(pid == PAT_PID) & starts]:
        body = _read_section(row, 0x00)
        programs |= {n: p & 0x1FFF for n, p in struct.iter_unpack(">HH", body) if n}
    for map_pid in set(programs.values()):
        for row in rows[(pid == map_pid) & starts]:
            body = _read_section(row, 0x02)
            at = 4 + (struct.unpack(">H", body[2:4])[0] & 0xFFF)
            while at < len(body):
                _, es, info = struct.unpack(">BHH", body[at : at + 5])
                streams.append(es & 0x1FFF)
                at += 5 + (info & 0xFFF)
    payload, pts, access = [], [], []
    for es in dict.fromkeys(streams):
        own = np.flatnonzero(pid == es)
        part = rows[own]
        counters = part[:, 3] & 15
        if ((np.diff(counters.astype(np.int64)) & 15) != 1).any():
            raise StreamError("continuity counter")
        adapted = (part[:, 3] & 0x20) != 0
        begin = np.where(adapted, 5 + part[:, 4].astype(np.int64), 4)
        flags = np.where(adapted & (part[:, 4] > 0), part[:, 5], 0)
        access += own[(flags & 0x40) != 0].tolist()
        data = part[np.arange(PACKET) >= begin[:, None]].tobytes()
        ends = np.cumsum(PACKET - begin)
        opens = np.flatnonzero(starts[own])
        for k, i in enumerate(opens):
            a = int(ends[i] - (PACKET - begin[i]))
            b = int(ends[opens[k + 1] - 1]) if k + 1 < len(opens) else len(data)
            if data[a : a + 3] != b"\x00\x00\x01" or struct.unpack(">H", data[a + 4 : a + 6])[0] != b - a - 6:
                raise StreamError("elementary packet")
            if data[a + 7] & 0x80:
                p = data[a + 9 : a + 14]
                pts.append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1)
            payload.append(data[a + 9 + data[a + 8] : b])
    return Stream(b"".join(payload), pts, access, len(rows), programs)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def store(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of df's: the id, n_bytes, and media, the payload's transport stream (binary)."""
    schema = f"{id_column} long, n_bytes long, media binary"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in pieces_of(texts):
                made = [(n, mux(p)) for n, p in map(padded, texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], [id_column, "n_bytes", "media"])

    return df.select(F.col(id_column).cast("long").alias(id_column), text).mapInArrow(run, schema)


def features(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Reads stored streams back: payload facts, pts and random_access (packet numbers) as arrays, and feature."""
    schema = f"{id_column} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pts array<long>, random_access array<long>, feature string"

    kinds = [("payload_bytes", "int64"), ("payload_sha256", "string"), ("tail_crc32", "int64"), ("media_bytes", "int64"), ("media_sha256", "string"), ("pts", None), ("random_access", None), ("feature", "string")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for value in batch.column(2):
                raw = value.as_py()
                s = demux(raw)
                text = f"programs={len(s.programs)};packets={s.packets};units={len(s.pts)};first_pts={s.pts[0] if s.pts else -1};last_pts={s.pts[-1] if s.pts else -1};random_access={len(s.random_access)}"
                rows.append((len(s.payload), sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(raw), sha256(raw).hexdigest(), s.pts, s.random_access, text))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            made = [pa.array(c, k or pa.list_(pa.int64())) for c, (_, k) in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], [id_column, "n_bytes", *(n for n, _ in kinds)])

    return media.select(id_column, "n_bytes", "media").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return features(store(documents(spark, sf_dir))).drop("pts", "random_access")
