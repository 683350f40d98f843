"""Documents stored as MPEG transport streams, and read back.

write(): a payload is cut into access units, each carried by one private
elementary packet (PES) with a presentation time stamp. Packets of 188 bytes
follow a program association table and a program map table; the first packet
of a unit has an adaptation field with the program clock and, at random-access
units, the random-access flag; the last one is stuffed. The true length of
the payload travels in a descriptor of the program map.

read(): section checksums are verified, the stream's packets are found through
the tables, continuity counters are checked, elementary packets reassembled,
and time stamps and random-access points collected. A broken stream gives what
can be read, with its errors counted.

Nulls: a null text is an empty one, whose payload is 64 zero bytes; a null id
stays null; repeated rows and equal texts give equal streams; an empty table
gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import text_batches, text_or_empty

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, NULL_PID = 0, 0x1000, 0x100, 0x1FFF
PRIVATE_STREAM, STREAM_TYPE, LENGTH_TAG = 0xBD, 0x06, 0x80
#: Bytes of payload in an access unit; every RANDOM_ACCESS-th unit is a random-access point.
UNIT, RANDOM_ACCESS = 4096, 8
#: Ticks of the 90 kHz clock between units; the first unit's time.
TICK, FIRST_TICK = 3600, 90_000


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


@lru_cache(4096)
def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


def _stamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def _clock(t: int) -> bytes:
    return struct.pack(">IBB", t >> 1 & 0xFFFFFFFF, (t & 1) << 7 | 0x7E, 0)


_PAT = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID)))


def write(payload: bytes) -> bytes:
    """The transport stream that carries payload (not empty)."""
    info = struct.pack(">BBQ", LENGTH_TAG, 8, len(payload))
    body = struct.pack(">HH", 0xE000 | DATA_PID, 0xF000 | len(info)) + info + struct.pack(">BHH", STREAM_TYPE, 0xE000 | DATA_PID, 0xF000)
    out, counter = [_PAT, _table_packet(PMT_PID, _section(2, 1, body))], 0
    first, later = struct.pack(">H", 0x4000 | DATA_PID), struct.pack(">H", DATA_PID)
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        time = FIRST_TICK + unit * TICK
        data = payload[at : at + UNIT]
        pes = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_STREAM, len(data) + 8, 0x80, 0x80, 5) + _stamp(2, time) + data
        flags = 0x10 | (0x40 if unit % RANDOM_ACCESS == 0 else 0)
        # 12 bytes of header and adaptation field leave 176
        room = PACKET - 12
        take = pes[:room]
        stuffing = b"\xff" * (room - len(take))
        out.append(b"\x47" + first + bytes([0x30 | counter, 7 + len(stuffing), flags]) + _clock(time) + stuffing + take)
        counter = counter + 1 & 15
        for k in range(room, len(pes), PACKET - 4):
            take = pes[k : k + PACKET - 4]
            gap = PACKET - 4 - len(take)
            if not gap:
                out.append(b"\x47" + later + bytes([0x10 | counter]) + take)
            elif gap == 1:
                out.append(b"\x47" + later + bytes([0x30 | counter, 0]) + take)
            else:
                out.append(b"\x47" + later + bytes([0x30 | counter, gap - 1, 0]) + b"\xff" * (gap - 2) + take)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    programs: int = 0
    errors: int = 0
    continuity_errors: int = 0
    #: of each elementary packet: its time, the offset of its bytes in payload, the stream offset of its first packet
    times: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    #: random-access points: (time, offset in the stream)
    access: list[tuple[int, int]] = field(default_factory=list)


def _sections(raw: bytes, view: np.ndarray, pid: int, pids: np.ndarray) -> Iterator[bytes]:
    for k in np.flatnonzero(pids == pid).tolist():
        p = raw[k * PACKET : (k + 1) * PACKET]
        at = 4 + (1 + p[4] if p[3] & 0x20 else 0)
        at += 1 + p[at] if at < PACKET else 0
        if at + 3 > PACKET:
            yield b""
            continue
        length = (p[at + 1] & 15) << 8 | p[at + 2]
        yield p[at : at + 3 + length]


def read(raw: bytes) -> Stream:
    """Parses a transport stream; never raises on broken bytes."""
    s = Stream(packets=len(raw) // PACKET, errors=int(len(raw) % PACKET != 0))
    grid = np.frombuffer(raw[: s.packets * PACKET], np.uint8).reshape(-1, PACKET)
    pids = (grid[:, 1].astype(np.int64) & 31) << 8 | grid[:, 2]
    good = (grid[:, 0] == SYNC) & (grid[:, 1] & 0x80 == 0)
    s.errors += int((~good).sum())
    pids = np.where(good, pids, NULL_PID)
    pmt_pid = data_pid = declared = None
    for sec in _sections(raw, grid, PAT_PID, pids):
        if len(sec) < 16 or section_crc(sec[:-4]) != struct.unpack(">I", sec[-4:])[0]:
            s.errors += 1
            continue
        s.programs = (len(sec) - 12) // 4
        pmt_pid = struct.unpack(">H", sec[10:12])[0] & 0x1FFF
    for sec in _sections(raw, grid, pmt_pid, pids) if pmt_pid is not None else ():
        if len(sec) < 21 or section_crc(sec[:-4]) != struct.unpack(">I", sec[-4:])[0]:
            s.errors += 1
            continue
        n = struct.unpack(">H", sec[10:12])[0] & 0xFFF
        if len(sec) < 15 + n:
            s.errors += 1
            continue
        if n >= 10 and sec[12] == LENGTH_TAG:
            declared = struct.unpack(">Q", sec[14:22])[0]
        data_pid = struct.unpack(">H", sec[13 + n : 15 + n])[0] & 0x1FFF
    if data_pid is None:
        s.errors += 1
        return s
    mine = np.flatnonzero(pids == data_pid)
    rows = grid[mine]
    counters = rows[:, 3] & 15
    s.continuity_errors = int(((counters[1:] - counters[:-1]) % 16 != 1).sum()) + int(len(counters) > 0 and counters[0] != 0)
    has_field = rows[:, 3] & 0x20 != 0
    skip = np.where(has_field, rows[:, 4].astype(np.int64) + 5, 4)
    starts = np.flatnonzero(rows[:, 1] & 0x40)
    flagged = has_field & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 != 0)
    base, skips, flags = (mine * PACKET).tolist(), skip.tolist(), flagged.tolist()
    out, size = [], 0
    for a, b in zip(starts.tolist(), [*starts.tolist()[1:], len(mine)]):
        pes = b"".join([raw[base[k] + skips[k] : base[k] + PACKET] for k in range(a, b)])
        if pes[:3] != b"\0\0\1" or len(pes) < 14:
            s.errors += 1
            continue
        length, head = struct.unpack(">H", pes[4:6])[0], 9 + pes[8]
        t = pes[9:14]
        time = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
        data = pes[head : 6 + length]
        if len(pes) < 6 + length:
            s.errors += 1
        s.times.append(time)
        s.offsets.append(size)
        if flags[a]:
            s.access.append((time, base[a]))
        out.append(data)
        size += len(data)
    s.payload = b"".join(out)
    s.errors += int(declared is not None and declared != size)
    return s


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


MEDIA = "doc_id long, n_bytes long, media binary"
TRACKS = "payload binary, times array<long>, offsets array<long>, access_times array<long>, access_offsets array<long>, packets long, programs long, errors long, continuity_errors long"


def to_streams(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """MEDIA: each text's payload as a transport stream."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in text_batches(batches):
            rows = [(d, *padded(t)) for d, t in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([write(r[1]) for r in rows], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, MEDIA)


def read_streams(media: DataFrame) -> DataFrame:
    """MEDIA and TRACKS: what is read back from each stored stream."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        long, longs = pa.int64(), pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [read(m or b"") for m in part.column(part.schema.get_field_index("media")).to_pylist()]
                cols = [
                    pa.array([g.payload for g in got], pa.binary()),
                    pa.array([g.times for g in got], longs),
                    pa.array([g.offsets for g in got], longs),
                    pa.array([[t for t, _ in g.access] for g in got], longs),
                    pa.array([[o for _, o in g.access] for g in got], longs),
                    *(pa.array([getattr(g, n) for g in got], long) for n in ("packets", "programs", "errors", "continuity_errors")),
                ]
                names = [x.split()[0] for x in TRACKS.split(", ")]
                keep = ["doc_id", "n_bytes", "media"]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in keep), *cols], [*keep, *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{MEDIA}, {TRACKS}")


def digests(tracks: DataFrame) -> DataFrame:
    """One row per stored stream: checksums of payload and stream, and a feature string."""
    last = lambda c: F.element_at(c, -1)
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("ts"), F.col("packets")),
        F.concat(F.lit("programs="), F.col("programs")),
        F.concat(F.lit("units="), F.size("times")),
        F.concat(F.lit("pts="), F.element_at("times", 1), F.lit("-"), last("times")),
        F.concat(F.lit("rap="), F.size("access_times"), F.lit("@"), last("access_offsets")),
        F.concat(F.lit("errors="), F.col("errors"), F.lit("+"), F.col("continuity_errors")),
    )
    return tracks.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
