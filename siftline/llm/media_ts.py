"""MPEG transport streams as a media column: write, parse, check and index.

``mux`` stores a byte payload in one elementary stream of a single-program transport
stream (188-byte packets, program tables with CRC-32, PES packets with presentation times,
random-access indicators). ``parse`` reads any transport stream: program tables, continuity
counters, elementary packets, presentation times and random-access points. Both work on one
row at a time and never look at other rows, so the operator has no shuffle.

Defined results of ``parse``: bytes that are not in step with the sync byte are skipped and
counted; a packet repeated once with the same counter is dropped, its clock field may differ;
a gap in the counter is counted unless the discontinuity indicator announces it; packets
with the transport error flag or scrambling are counted and their payload left out; a unit
that misses bytes, by a gap or against its length, is kept and marked as damaged; tables
that are announced but not yet current are left out, a new version replaces the old; empty
input has no programs; null and repeated rows are handled like any other; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import map_rows, need_free

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, NULL_PID, CRC_POLY = 188, 0x47, 0x1FFF, 0x04C11DB7
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x100, 1
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CLOCK = 90_000

BLOCK = 576
UNIT = 16 * BLOCK
TICKS = CLOCK // 25


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ CRC_POLY if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_TABLE = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _TABLE[(c >> 24) ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, extension, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _psi_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


_PAT = _psi_packet(0, _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
_PMT = _psi_packet(PMT_PID, _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000)))


def _stamp(marker: int, t: int) -> bytes:
    return struct.pack(">BHH", marker << 4 | t >> 29 & 14 | 1, t >> 14 & 0xFFFE | 1, t << 1 & 0xFFFE | 1)


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """One transport stream: an elementary packet for every ``unit`` bytes, each a random-access point."""
    out, cc = [_PAT, _PMT], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        data = payload[at : at + unit]
        t = k * TICKS & (1 << 33) - 1
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(data) + 8, 0x84, 0x80, 5) + _stamp(2, t) + data
        clock = struct.pack(">IH", t >> 1, (t & 1) << 15 | 0x7E00)
        i, field = 0, b"\x50" + clock
        while i < len(pes):
            room = PACKET - 4 - (1 + len(field) if field else 0)
            left = len(pes) - i
            if left < room:
                field = (field or (b"\0" if room - left > 1 else b"")) + b"\xff" * (room - left - (0 if field else min(2, room - left)))
                head = bytes([len(field)]) + field
            else:
                head = bytes([len(field)]) + field if field else b""
            body = pes[i : i + PACKET - 4 - len(head)]
            out.append(struct.pack(">BHB", SYNC, (0x4000 if i == 0 else 0) | DATA_PID, (0x30 if head else 0x10) | cc) + head + body)
            cc, i, field = cc + 1 & 15, i + len(body), b""
    return b"".join(out)


def _aligned(stream: bytes) -> tuple[np.ndarray, int]:
    """Packets in step with the sync byte as rows, and the number of bytes skipped between them."""
    n = len(stream) // PACKET
    rows = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    if n and (rows[:, 0] == SYNC).all():
        return rows, len(stream) - n * PACKET
    at, found = 0, []
    while (at := stream.find(SYNC.to_bytes(1, "big"), at)) >= 0 and at + PACKET <= len(stream):
        if at + PACKET == len(stream) or stream[at + PACKET] == SYNC:
            found.append(np.frombuffer(stream, np.uint8, PACKET, at))
            at += PACKET
        else:
            at += 1
    return (np.stack(found) if found else rows[:0]), len(stream) - PACKET * len(found)


def _sections(pid_payloads: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Complete current table sections with a correct CRC, also where one ends in the packet in which the next begins."""
    buffer = b""

    def complete() -> Iterator[bytes]:
        nonlocal buffer
        while len(buffer) >= 3 and buffer[0] != 0xFF:
            size = 3 + (buffer[1] << 8 & 0xF00 | buffer[2])
            if len(buffer) < size:
                return
            if size >= 12 and crc32_mpeg(buffer[:size]) == 0 and buffer[5] & 1:
                yield buffer[:size]
            buffer = buffer[size:]

    for starts, data in pid_payloads:
        if starts and data:
            rest = data[1 : 1 + data[0]]
            buffer = buffer + rest if buffer else b""
            yield from complete()
            buffer = data[1 + data[0] :]
        elif buffer:
            buffer += data
        yield from complete()


def _without_clock(rows: np.ndarray, control: np.ndarray) -> np.ndarray:
    """Packets from their fifth byte on, the program clock reference set to zero."""
    out = rows[:, 4:].copy()
    clocked = (control & 2 != 0) & (rows[:, 4] >= 7) & (rows[:, 5] & 0x10 != 0)
    out[clocked, 2:8] = 0
    return out


def _time(b: bytes) -> int:
    return (b[0] & 14) << 29 | b[1] << 22 | (b[2] & 254) << 14 | b[3] << 7 | b[4] >> 1


def parse(stream: bytes) -> dict:
    """Programs, streams, packet counts, continuity errors and the elementary packets of a transport stream.

    units: dicts of pid, stream_id, pts, dts, random_access, offset (first packet's number), damaged and data.
    """
    rows, skipped = _aligned(stream)
    pid = (rows[:, 1].astype(int) & 0x1F) << 8 | rows[:, 2]
    control, cc = rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    broken = (rows[:, 1] & 0x80 != 0) | (rows[:, 3] & 0xC0 != 0)
    has_field = control & 2 != 0
    length = np.where(has_field, rows[:, 4].astype(int), 0)
    flags = np.where(has_field & (length > 0), rows[:, 5], 0)
    begin = np.minimum(np.where(has_field, 5 + length, 4), PACKET)
    starts = rows[:, 1] & 0x40 != 0
    usable = (control & 1 != 0) & ~broken & (pid != NULL_PID)
    errors = repeats = 0
    gap = np.zeros(len(rows), bool)
    by_pid: dict[int, np.ndarray] = {}
    for p in np.unique(pid[usable]):
        at = np.flatnonzero(usable & (pid == p))
        step = np.diff(cc[at].astype(int)) & 15
        same = np.zeros(len(at), bool)
        if len(twin := np.flatnonzero(step == 0) + 1):
            same[twin] = (_without_clock(rows[at[twin]], control[at[twin]]) == _without_clock(rows[at[twin - 1]], control[at[twin - 1]])).all(axis=1)
        same &= np.r_[True, ~same[:-1]]
        repeats += int(same.sum())
        at = at[~same]
        step = np.diff(cc[at].astype(int)) & 15
        lost = at[1:][(step != 1) & (flags[at[1:]] & 0x80 == 0)]
        gap[lost] = True
        errors += len(lost)
        by_pid[int(p)] = at
    load = lambda i: rows[i, begin[i] :].tobytes()
    programs: dict[int, int] = {}
    version = None
    for s in _sections([(bool(starts[i]), load(i)) for i in by_pid.get(0, [])]):
        if s[0] == 0:
            programs = programs if s[5] == version else {}
            version = s[5]
            programs |= {n: p & 0x1FFF for n, p in struct.iter_unpack(">HH", s[8:-4]) if n}
    tables: dict[int, dict[int, int]] = {}  # of each program, as its last version has them
    for table in sorted(set(programs.values())):
        for s in _sections([(bool(starts[i]), load(i)) for i in by_pid.get(table, [])]):
            if s[0] != 2:
                continue
            at = 12 + (s[10] << 8 & 0xF00 | s[11])
            own = tables[s[3] << 8 | s[4]] = {}
            while at + 5 <= len(s) - 4:
                own[(s[at + 1] & 0x1F) << 8 | s[at + 2]] = s[at]
                at += 5 + (s[at + 3] << 8 & 0xF00 | s[at + 4])
    streams = {pid: kind for own in tables.values() for pid, kind in own.items()}
    units = []
    for p in sorted(streams):
        at = by_pid.get(p, np.zeros(0, int))
        first = np.flatnonzero(starts[at])
        for a, b in zip(first, [*first[1:], len(at)][: len(first)], strict=True):
            own = at[a:b]
            full = own[1:-1]
            body = load(own[0]) + (rows[full, 4:].tobytes() if len(full) and (begin[full] == 4).all() else b"".join(load(i) for i in full)) + (load(own[-1]) if len(own) > 1 else b"")
            if len(body) < 9 or body[:3] != b"\0\0\1":
                continue
            size = body[4] << 8 | body[5]
            times, head = body[7] >> 6, 9 + body[8]
            data = body[head : 6 + size] if size else body[head:]
            units.append({
                "pid": p,
                "stream_id": body[3],
                "pts": _time(body[9:14]) if times & 2 else None,
                "dts": _time(body[14:19]) if times == 3 else None,
                "random_access": bool(flags[own[0]] & 0x40),
                "offset": int(own[0]),
                "damaged": bool(gap[own[1:]].any() or (b < len(at) and gap[at[b]]) or (size and len(body) < 6 + size)),
                "data": data,
            })
    return {"packets": len(rows), "skipped": skipped, "broken": int(broken.sum()), "repeats": repeats, "continuity_errors": errors, "programs": programs, "streams": streams, "units": units}


def pad(data: bytes, block: int = BLOCK) -> bytes:
    """data with bytes 255 appended up to a positive multiple of ``block``."""
    return data + b"\xff" * (-len(data) % block if data else block)


def describe(found: dict) -> str:
    """The stored index of a parsed stream as one line of text: tables, counters, times and random-access points; index digests every unit's place, times and bytes."""
    units = found["units"]
    index = hashlib.sha256(b"".join(struct.pack("<iqqqi?I", u["pid"], -1 if u["pts"] is None else u["pts"], -1 if u["dts"] is None else u["dts"], u["offset"], len(u["data"]), u["random_access"], zlib.crc32(u["data"])) for u in units)).hexdigest()[:16]
    times = [u["pts"] for u in units if u["pts"] is not None]
    return ";".join([
        "programs=" + ",".join(f"{n}:{p}" for n, p in sorted(found["programs"].items())),
        "streams=" + ",".join(f"{p}:{t}" for p, t in sorted(found["streams"].items())),
        f"packets={found['packets']}",
        f"continuity_errors={found['continuity_errors']}",
        f"units={len(units)}",
        f"random_access={sum(u['random_access'] for u in units)}",
        f"pts={min(times, default='')}-{max(times, default='')}",
        f"index={index}",
    ])


STREAM_TYPE = "packets long, skipped long, broken long, repeats long, continuity_errors long, programs map<int,int>, streams map<int,int>, units array<struct<pid:int,stream_id:int,pts:long,dts:long,random_access:boolean,offset:long,damaged:boolean,data:binary>>"


def parse_streams(media: DataFrame, column: str, unit_data: bool = True) -> DataFrame:
    """media with a struct column ``transport`` holding parse() of the binary column; null stays null."""

    @F.pandas_udf(f"struct<{', '.join(f'{a}: {b}' for a, b in (x.split(' ', 1) for x in STREAM_TYPE.split(', ')))}>")
    def parsed(values: pd.Series) -> pd.DataFrame:
        names = [x.split(" ")[0] for x in STREAM_TYPE.split(", ")]
        out = []
        for v in values:
            found = parse(bytes(v)) if v is not None else dict.fromkeys(names)
            if v is not None and not unit_data:
                found["units"] = [u | {"data": None} for u in found["units"]]
            out.append(found)
        return pd.DataFrame(out, columns=names)

    need_free(media, "transport")
    return media.withColumn("transport", parsed(F.col(column)))


def stream_units(media: DataFrame, column: str, unit_data: bool = True) -> DataFrame:
    """media, without the binary column, with one row for each elementary packet: pid, stream_id, pts, dts, random_access, offset, damaged, data; a table that has such a column is an error."""
    parsed = parse_streams(media, column, unit_data)
    units = parsed.schema["transport"].dataType["units"].dataType.elementType.names
    need_free(media.drop(column), *units)
    return parsed.select(*[c for c in media.columns if c != column], F.inline("transport.units"))


def listed(units: list[dict]) -> str:
    """pid:offset:pts:dts:random access:bytes of every elementary packet."""
    return ",".join(f"{u['pid']}:{u['offset']}:{'' if u['pts'] is None else u['pts']}:{'' if u['dts'] is None else u['dts']}:{int(u['random_access'])}:{len(u['data'])}" for u in units)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units string"


def store_texts(documents: DataFrame) -> DataFrame:
    """Digests of every text (null: empty) stored as a transport stream and read back from its bytes."""

    def digest(doc_id: int | None, text: str | None) -> list[tuple]:
        data = (text or "").encode()
        media = mux(pad(data))
        found = parse(media)
        back = b"".join(u["data"] for u in found["units"])
        return [(doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(found), listed(found["units"]))]

    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda: digest, DIGEST)


def write_streams(documents: DataFrame) -> DataFrame:
    """doc_id and the transport stream of every text, as a binary media column."""
    store = F.udf(lambda text: mux(pad((text or "").encode())), "binary", useArrow=True)
    return documents.select("doc_id", store("text").alias("media"))
