"""Texts as elementary streams in MPEG transport streams, and such streams read back.

``mux`` writes one program: association and map tables, repeated before every
random access point, and one stream of private data whose packets carry 33-bit
presentation time stamps, clock references and random access flags. ``demux``
starts from bytes alone: it finds sync, follows the tables to the stream,
checks their checksums and the continuity counters of every packet id, joins
packets to elementary packets, leaves out those with gaps, and lists time
stamps, byte offsets and random access points.

Defined results: a null or empty text is a payload of spaces; a stream with no
valid tables has an empty payload and says so in its feature; damaged or
foreign bytes never raise. Both work a document at a time in columns of their
own, so null or repeated ids, repeated rows, empty tables and extra columns need
no care. A very long text is one stream, held whole by the task of its row.
"""

from __future__ import annotations

import functools
import hashlib
import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw, table

PACKET, SYNC, BLOCK = 188, 0x47, 192
PAT_PID, PMT_PID, STREAM_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
#: Bytes of an elementary packet's data, ticks (of 90 kHz) between two, and how many stand from one random access point to the next.
UNIT, TICKS, GROUP = 12 * BLOCK, 3600, 4
WRAP = 1 << 33


@functools.cache
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


@functools.lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ t[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    data = head + body
    return data + crc32_mpeg(data).to_bytes(4, "big")


@functools.cache
def _tables() -> tuple[bytes, bytes]:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
    return tuple((b"\x00" + s).ljust(PACKET - 4, b"\xff") for s in (pat, pmt))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)])


def _clock(pcr: int) -> bytes:
    return (pcr << 15 | 0x7E00).to_bytes(6, "big")


def padded(text: bytes) -> bytes:
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK))


def mux(payload: bytes, first_pts: int = 0) -> bytes:
    """The payload's transport stream; every payload gives the same bytes each time."""
    out, cc, table_cc = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data, pts = payload[at : at + UNIT], (first_pts + k * TICKS) % WRAP
        access = k % GROUP == 0
        if access:
            for pid, body in zip((PAT_PID, PMT_PID), _tables(), strict=True):
                out.append(bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | table_cc & 15]) + body)
            table_cc += 1
        pes = b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + data
        first = bytes([7, 0x50 if access else 0x10]) + _clock(pts)
        room = PACKET - 4 - len(first)
        if len(pes) < room:
            first = bytes([7 + room - len(pes)]) + first[1:] + b"\xff" * (room - len(pes))
        out.append(bytes([SYNC, 0x40 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | cc & 15]) + first + pes[:room])
        cc += 1
        rest = pes[room:]
        whole = len(rest) // (PACKET - 4)
        if whole:
            body = np.empty((whole, PACKET), np.uint8)
            body[:, 0], body[:, 1], body[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
            body[:, 3] = 0x10 | (np.arange(cc, cc + whole) & 15)
            body[:, 4:] = np.frombuffer(rest, np.uint8, whole * (PACKET - 4)).reshape(whole, -1)
            out.append(body.tobytes())
            cc += whole
        if last := rest[whole * (PACKET - 4) :]:
            gap = PACKET - 4 - len(last)
            stuffing = b"\x00" if gap == 1 else bytes([gap - 1, 0]) + b"\xff" * (gap - 2)
            out.append(bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | cc & 15]) + stuffing + last)
            cc += 1
    return b"".join(out)


def _packets(media: bytes) -> tuple[np.ndarray, int]:
    """The packets as rows, and the bytes passed over to find sync."""
    a = np.frombuffer(media, np.uint8)
    if len(a) % PACKET == 0 and len(a) and (a[::PACKET] == SYNC).all():
        return a.reshape(-1, PACKET), 0
    at, found, lost, locked = 0, [], 0, False
    sync = np.flatnonzero(a == SYNC)
    while at + PACKET <= len(a):
        # To gain sync takes two packets in a row, to keep it one.
        locked = a[at] == SYNC and (locked or at + 2 * PACKET > len(a) or a[at + PACKET] == SYNC)
        if locked:
            found.append(at)
            at += PACKET
        else:
            i = int(np.searchsorted(sync, at, "right"))
            to = int(sync[i]) if i < len(sync) else len(a)
            lost, at = lost + to - at, to
    lost += len(a) - at if at < len(a) else 0
    return a[np.add.outer(np.array(found, np.int64), np.arange(PACKET))] if found else np.empty((0, PACKET), np.uint8), lost


def _read_section(packet: bytes, start: int, table_id: int) -> bytes | None:
    """The body of a section that begins in this packet and ends in it, if its checksum holds."""
    at = start + 1 + packet[start] if start < PACKET else PACKET
    if at + 8 > PACKET or packet[at] != table_id:
        return None
    size = 3 + ((packet[at + 1] & 0x0F) << 8 | packet[at + 2])
    data = packet[at : at + size]
    if size < 12 or len(data) < size or crc32_mpeg(data):
        return None
    return data[8:-4]


def demux(media: bytes) -> tuple[bytes, dict, list[tuple[int, int, int, bool]]]:
    """The elementary stream, what the container says, and (time stamp, offset, length, random access) of each part."""
    p, lost = _packets(media)
    info = {"packets": len(p), "bytes_lost": lost, "crc_errors": 0, "cc_errors": 0, "duplicates": 0, "stream_type": None, "pes": 0, "pes_damaged": 0}
    pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    control = p[:, 3] >> 4 & 3
    ok = (p[:, 1] & 0x80 == 0) & (control & 1 == 1)
    start = np.where(control & 2, 5 + p[:, 4].astype(np.int64), 4)
    unit = (p[:, 1] & 0x40) != 0

    def tables(of: int, table_id: int) -> list[bytes]:
        rows = np.flatnonzero((pid == of) & ok & unit)
        found = [_read_section(p[i].tobytes(), int(start[i]), table_id) for i in rows]
        info["crc_errors"] += sum(x is None for x in found)
        return [x for x in found if x is not None]

    def last_pid(b: bytes, at: int) -> int:
        return (b[at] & 0x1F) << 8 | b[at + 1]

    pmt_pid = stream = None
    for body in tables(PAT_PID, 0)[-1:]:
        pmt_pid = next((last_pid(body, i + 2) for i in range(0, len(body) - 3, 4) if body[i] << 8 | body[i + 1]), None)
    if pmt_pid is not None:
        for body in tables(pmt_pid, 2)[-1:]:
            at = 4 + ((body[2] & 0x0F) << 8 | body[3])
            if at + 5 <= len(body):
                info["stream_type"], stream = body[at], last_pid(body, at + 1)
    parts: list[bytes] = []
    points: list[tuple[int, int, int, bool]] = []
    damaged = np.zeros(len(p), bool)
    for k in np.unique(pid[ok]).tolist():
        rows = np.flatnonzero((pid == k) & ok)
        cc = p[rows, 3].astype(np.int64) & 15
        step = (cc[1:] - cc[:-1]) & 15
        told = (control[rows[1:]] & 2 != 0) & (p[rows[1:], 4] > 0) & (p[rows[1:], 5] & 0x80 != 0)
        twice = (step == 0) & ~told
        gap = (step != 1) & ~twice & ~told
        info["duplicates"] += int(twice.sum())
        info["cc_errors"] += int(gap.sum())
        ok[rows[1:][twice]] = False
        damaged[rows[1:][gap]] = True
    rows = np.flatnonzero((pid == stream) & ok & (start < PACKET)) if stream is not None else np.empty(0, np.int64)
    if len(rows):
        body = p[rows]
        data = body[np.arange(PACKET) >= start[rows, None]].tobytes()
        ends = np.cumsum(PACKET - start[rows])
        heads = np.flatnonzero(unit[rows])
        if len(heads) and heads[0] > 0:
            info["pes_damaged"] += 1
        size = 0
        for j, h in enumerate(heads.tolist()):
            to = int(heads[j + 1]) if j + 1 < len(heads) else len(rows)
            pes = data[int(ends[h] - PACKET + start[rows[h]]) : int(ends[to - 1])]
            length = int.from_bytes(pes[4:6], "big") if len(pes) >= 9 else 0
            whole = len(pes) >= 9 and pes[:3] == b"\x00\x00\x01" and (not length or len(pes) >= 6 + length)
            if not whole or damaged[rows[h + 1 : to]].any():
                info["pes_damaged"] += 1
                continue
            pts = None
            if pes[7] & 0x80 and len(pes) >= 14:
                b = pes[9:14]
                pts = (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1
            chunk = pes[9 + pes[8] : 6 + length if length else None]
            first = p[rows[h]]
            access = bool(control[rows[h]] & 2 and first[4] > 0 and first[5] & 0x40)
            parts.append(chunk)
            points.append((pts, size, len(chunk), access))
            size += len(chunk)
    info["pes"] = len(parts)
    stamps = [x[0] for x in points if x[0] is not None]
    info |= {"access_points": sum(x[3] for x in points), "first_pts": stamps[0] if stamps else None, "last_pts": stamps[-1] if stamps else None}
    return b"".join(parts), info, points


def _to_stream(text: pd.Series) -> pd.Series:
    return text.map(lambda x: mux(padded(bytes(x or b""))))


POINT = "struct<pts: long, offset: long, length: long, random_access: boolean>"
READ = f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, points array<{POINT}>"


def _read_stream(media: pd.Series) -> pd.DataFrame:
    rows = []
    for m in media:
        m = bytes(m or b"")
        payload, info, points = demux(m)
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), json.dumps(info, separators=(",", ":")), [dict(zip(("pts", "offset", "length", "random_access"), x, strict=True)) for x in points]))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "points"])


def to_stream(text: F.Column) -> F.Column:
    """A binary column as transport streams, padded to whole blocks."""
    return F.pandas_udf(_to_stream, "binary")(text)


def read_stream(media: F.Column) -> F.Column:
    """What a column of transport streams holds: a struct of the payload's digests, the container's feature and its time stamps."""
    return F.pandas_udf(_read_stream, READ)(media)


def op1_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", F.octet_length(raw("text")).cast("long").alias("n_bytes"), read_stream(to_stream(raw("text"))).alias("m"))
    return out.select("doc_id", "n_bytes", "m.*")
