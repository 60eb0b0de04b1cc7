"""Media columns as MPEG transport streams: payloads are packed into program streams and read back from them.

A stream has a program association table, a program map table and one elementary stream of private data in PES
packets with presentation timestamps. Every GROUP-th access unit is a random-access point with a clock reference.
Reading parses the tables (checking their CRC), checks continuity counters, reassembles the elementary packets and
lists timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches

PACKET, BODY = 188, 184
#: Bytes of payload in an access unit, units from one random-access point to the next, clock ticks from unit to unit.
UNIT, GROUP, TICKS = 16_384, 4, 3_600
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD


@lru_cache(64)
def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, from all ones, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) & 0xFFFFFFFF ^ (0x04C11DB7 if crc & 0x80000000 else 0)
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2) + number.to_bytes(2) + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4)


@lru_cache(1)
def _tables() -> bytes:
    """The packets of the two tables that open every stream."""
    pat = _section(0x00, 1, PROGRAM.to_bytes(2) + (0xE000 | PMT_PID).to_bytes(2))
    entry = bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2) + b"\xf0\x00"
    pmt = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2) + b"\xf0\x00" + entry)
    packet = lambda pid, s: (b"\x47" + (0x4000 | pid).to_bytes(2) + b"\x10\x00" + s).ljust(PACKET, b"\xff")
    return packet(PAT_PID, pat) + packet(PMT_PID, pmt)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    parts, counter = [_tables()], 0
    for k in range(-(-len(payload) // UNIT)):
        unit, pts = payload[k * UNIT : (k + 1) * UNIT], k * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2) + b"\x84\x80\x05" + _stamp(pts) + unit
        key = k % GROUP == 0
        field = b"\x07\x50" + (pts << 15 | 0x7E00).to_bytes(6) if key else b""
        n = -(-(len(pes) + len(field)) // BODY)
        spare = n * BODY - len(pes) - len(field)
        out = np.empty((n, PACKET), dtype=np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        if n == 1:  # stuffing goes into the adaptation field
            size = BODY - len(pes)
            if size:
                field = bytes([size - 1]) + (field[1:] or b"\x00")[: size - 1].ljust(size - 1, b"\xff")
                out[0, 3] |= 0x20
            body = field + pes
        else:
            if field:
                out[0, 3] |= 0x20
            last = b""
            if spare:
                last = (bytes([spare - 1]) + b"\x00"[: spare - 1]).ljust(spare, b"\xff")
                out[-1, 3] |= 0x20
            cut = (n - 1) * BODY - len(field)
            body = field + pes[:cut] + last + pes[cut:]
        out[:, 4:] = np.frombuffer(body, dtype=np.uint8).reshape(n, BODY)
        parts.append(out.tobytes())
    return b"".join(parts)


def _read_section(packets: np.ndarray) -> bytes:
    """The section that starts in the first of a PID's packets (long ones go on in the next)."""
    first = packets[0, 4:].tobytes()
    data = first[1 + first[0] :] + b"".join(p[4:].tobytes() for p in packets[1:8])
    section = data[: 3 + (int.from_bytes(data[1:3]) & 0x0FFF)]
    if crc_mpeg(section[:-4]) != int.from_bytes(section[-4:]):
        raise ValueError("a table's checksum is wrong")
    return section


def demux(stream: bytes) -> dict:
    """payload of a stream's first private-data stream (by program number, then as listed), with pts and random_access of
    each unit, the number of packets and of continuity errors. A packet sent twice counts once, and a jump that its
    packet announces as a discontinuity is no error. Raises ValueError for what isn't a transport stream."""
    if len(stream) % PACKET or not stream:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(stream, dtype=np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("a sync byte is missing")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pat = _read_section(packets[pid == PAT_PID])
    programs = {int.from_bytes(pat[i : i + 2]): int.from_bytes(pat[i + 2 : i + 4]) & 0x1FFF for i in range(8, len(pat) - 4, 4)}
    found = None
    for number, table in sorted(programs.items()):
        if not number or found is not None:
            continue
        pmt = _read_section(packets[pid == table])
        at = 12 + (int.from_bytes(pmt[10:12]) & 0x0FFF)
        while at < len(pmt) - 4 and found is None:
            if pmt[at] == PRIVATE_DATA:
                found = int.from_bytes(pmt[at + 1 : at + 3]) & 0x1FFF
            at += 5 + (int.from_bytes(pmt[at + 3 : at + 5]) & 0x0FFF)
    if found is None:
        raise ValueError("no private-data stream")
    own = packets[pid == found]
    control = own[:, 3] >> 4 & 3
    own, control = own[control & 1 == 1], control[control & 1 == 1]
    again = np.zeros(len(own), dtype=bool)
    again[1:] = (own[1:] == own[:-1]).all(axis=1)
    once = ~again | np.roll(again, 1)  # a packet may be sent twice, not three times
    own, control = own[once], control[once]
    counters = own[:, 3] & 15
    announced = (control == 3) & (own[:, 4] > 0) & (own[:, 5] & 0x80 > 0)
    errors = int((((counters[1:] - counters[:-1] & 15) != 1) & ~announced[1:]).sum())
    begin = np.where(control == 3, 5 + own[:, 4].astype(np.int32), 4)
    flagged = (control == 3) & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    data = own[np.arange(PACKET)[None, :] >= begin[:, None]].tobytes()
    starts = own[:, 1] & 0x40 > 0
    where = np.concatenate([[0], np.cumsum(PACKET - begin)])[:-1][starts]
    units, stamps = [], []
    for a, b in zip(where.tolist(), [*where[1:].tolist(), len(data)]):
        if data[a : a + 3] != b"\x00\x00\x01":
            raise ValueError("a PES packet doesn't start where it should")
        size = int.from_bytes(data[a + 4 : a + 6])
        end = a + 6 + size if size else b
        if data[a + 7] & 0x80:
            s = data[a + 9 : a + 14]
            stamps.append((s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1)
        else:
            stamps.append(-1)
        units.append(data[a + 9 + data[a + 8] : end])
    return {"payload": b"".join(units), "pts": stamps, "random_access": flagged[starts].tolist(), "packets": len(packets), "continuity_errors": errors}


def padded(data: bytes, unit: int = 64) -> bytes:
    """data and zeros up to a positive multiple of unit."""
    return data.ljust(max(1, -(-len(data) // unit)) * unit, b"\x00")


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text's UTF-8, media: the transport stream of it, padded to 64 bytes. A null text counts
    as empty (64 zeros). Equal texts give equal streams; other columns are ignored; an empty table an empty one."""

    def make(ids: list, data: list) -> dict:
        return {"doc_id": ids, "n_bytes": [len(d) for d in data], "media": [mux(padded(d)) for d in data]}

    raw = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    return map_batches(raw, make, "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """From doc_id, n_bytes, media: the payload read back, its units' timestamps and random-access flags, and a
    string of features. A row whose stream can't be read, or is null, has them null and the reason in error."""

    def make(ids: list, sizes: list, streams: list) -> dict:
        names = ("payload", "pts", "random_access", "packets", "continuity_errors", "error")
        rows = []
        for s in streams:
            try:
                rows.append(demux(s) | {"error": None} if s is not None else dict.fromkeys(names) | {"error": "null"})
            except (ValueError, StopIteration, IndexError) as e:
                rows.append(dict.fromkeys(names) | {"error": str(e) or type(e).__name__})
        return {"doc_id": ids, "n_bytes": sizes, "media": streams} | {k: [r[k] for r in rows] for k in names}

    schema = "doc_id long, n_bytes long, media binary, payload binary, pts array<long>, random_access array<boolean>, packets long, continuity_errors long, error string"
    return map_batches(media, make, schema)


def features(row: dict) -> str:
    """Units, packets, continuity errors, timestamps, random-access points and byte statistics of a stream read."""
    n = np.bincount(np.frombuffer(row["payload"], dtype=np.uint8), minlength=256)
    p = n[n > 0] / n.sum()
    key = [i for i, r in enumerate(row["random_access"]) if r]
    return (
        f"units={len(row['pts'])};packets={row['packets']};errors={row['continuity_errors']};pts={row['pts'][0]}-{row['pts'][-1]};"
        f"access={len(key)};bytes={int((n > 0).sum())};entropy={float(-(p * np.log2(p)).sum()):.4f}"
    )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(ids, sizes, media, payload, pts, access, packets, errors, error) -> dict:
        rows = [dict(payload=p, pts=t, random_access=a, packets=n, continuity_errors=e) for p, t, a, n, e in zip(payload, pts, access, packets, errors)]
        return {
            "doc_id": ids, "n_bytes": sizes, "payload_bytes": [len(p) for p in payload],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payload], "tail_crc32": [zlib.crc32(p[-64:]) for p in payload],
            "media_bytes": [len(m) for m in media], "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
            "feature": [features(r) for r in rows],
        }

    read = decode(encode(documents(spark, sf_dir)))
    return map_batches(
        read, digest,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
