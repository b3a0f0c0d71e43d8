"""Media columns: payloads as MPEG transport streams, muxed, read back and described.

A stream starts with a program association table and a program map table. The
payload follows in packetised elementary stream (PES) packets of one access unit
each, cut into transport packets of 188 bytes. Each packet carries a continuity
counter; each access unit a presentation timestamp; every ``RANDOM_ACCESS``-th
unit the random access indicator and a program clock reference.

Reading back parses the tables to find the elementary stream, checks the
continuity counters, reassembles the PES packets and collects the timestamps and
the random access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended

#: Fixed values of the transport stream format.
PACKET, SYNC, PAT_PID, PAT_TABLE, PMT_TABLE, PRIVATE_DATA, PRIVATE_STREAM = 188, 0x47, 0x0000, 0x00, 0x02, 0x06, 0xBD
#: Choices of this writer.
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT, RANDOM_ACCESS, TICKS = 16384, 8, 3003
BLOCK = 64


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")


def section(table: int, number: int, body: bytes) -> bytes:
    head = bytes((table,)) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, data: bytes) -> bytes:
    return (bytes((SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0)) + data).ljust(PACKET, b"\xff")


TABLES = table_packet(PAT_PID, section(PAT_TABLE, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + table_packet(
    PMT_PID, section(PMT_TABLE, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes((PRIVATE_DATA,)) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")
)


def timestamp(ticks: int) -> bytes:
    return bytes((0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, 0x01 | ticks >> 14 & 0xFE, ticks >> 7 & 0xFF, 0x01 | ticks << 1 & 0xFE))


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [TABLES], 0
    for number, at in enumerate(range(0, len(payload), UNIT)):
        unit, ticks = payload[at : at + UNIT], number * TICKS & 0x1FFFFFFFF
        pes = b"\0\0\1" + bytes((PRIVATE_STREAM,)) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + timestamp(ticks) + unit
        done, access = 0, number % RANDOM_ACCESS == 0
        while done < len(pes):
            flags = b""
            if not done and access:  # discontinuity 0, random access 1, clock reference 1
                flags = b"\x50" + (ticks << 15 | 0x7E00).to_bytes(6, "big")
            room = PACKET - 4 - (1 + len(flags) if flags else 0)
            part = pes[done : done + room]
            if len(part) < room and not flags:
                spare = room - len(part)
                field_ = bytes((spare - 1,)) + (b"\0" + b"\xff" * (spare - 2) if spare > 1 else b"")
            elif flags:
                spare = room - len(part)
                field_ = bytes((len(flags) + spare,)) + flags + b"\xff" * spare
            else:
                field_ = b""
            out.append(bytes((SYNC, (0 if done else 0x40) | DATA_PID >> 8, DATA_PID & 255, (0x30 if field_ else 0x10) | counter)) + field_ + part)
            counter = counter + 1 & 15
            done += len(part)
    return b"".join(out)


@dataclass
class Stream:
    """What reading a transport stream back gives."""

    payload: bytes = b""
    packets: int = 0
    lost: int = 0  #: packets whose continuity counter is not the next one
    timestamps: list[int] = field(default_factory=list)
    access_points: list[int] = field(default_factory=list)  #: payload offsets of the random access points


class CorruptStreamError(ValueError):
    """Bytes that are no transport stream, or one without the tables that reading it needs."""


def table_of(section_: bytes) -> bytes | None:
    """A whole section without its checksum; None as long as bytes are missing."""
    if len(section_) < 3 or len(section_) < (size := 3 + ((section_[1] & 15) << 8 | section_[2])):
        return None
    if crc32_mpeg(section_[:size]):
        raise CorruptStreamError("a table's checksum is wrong")
    return section_[: size - 4]


def program_map(pat: bytes) -> int | None:
    """The packet id of the first program's map; number 0 is the network's table."""
    for at in range(8, len(pat) - 3, 4):
        if pat[at] or pat[at + 1]:
            return (pat[at + 2] & 31) << 8 | pat[at + 3]
    return None


def first_stream(pmt: bytes) -> int | None:
    """The packet id of the first elementary stream; descriptors are skipped."""
    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    return (pmt[at + 1] & 31) << 8 | pmt[at + 2] if at + 5 <= len(pmt) else None


def demux(media: bytes) -> Stream:
    """Read a stream: tables first, then the first elementary stream of the first program.

    Tables may span packets. Packets without payload, of other streams and repeated
    ones are passed over; a jump of the counter counts as a loss unless the packet
    announces it. PES packets may lack a length or a timestamp.
    """
    if len(media) % PACKET:
        raise CorruptStreamError("not a whole number of packets")
    out, map_pid, data_pid, last = Stream(), None, None, None
    sections: dict[int, bytearray] = {}
    parts: list[bytes] = []
    length, open_ = 0, False
    for at in range(0, len(media), PACKET):
        packet = media[at : at + PACKET]
        if packet[0] != SYNC:
            raise CorruptStreamError(f"no sync byte at {at}")
        out.packets += 1
        pid, start, control, counter = (packet[1] & 31) << 8 | packet[2], packet[1] & 0x40, packet[3] >> 4 & 3, packet[3] & 15
        if not control & 1:
            continue
        flags = packet[5] if control & 2 and packet[4] else 0
        body = packet[5 + packet[4] :] if control & 2 else packet[4:]
        if pid in (PAT_PID, map_pid):
            if start:
                sections[pid] = bytearray(body[1 + body[0] :])
            elif pid in sections:
                sections[pid] += body
            table = table_of(bytes(sections.get(pid, b"")))
            if table is not None:
                del sections[pid]
                if pid == PAT_PID:
                    map_pid = program_map(table)
                else:
                    data_pid = first_stream(table)
        elif pid == data_pid:
            if last is not None:
                if (counter, body) == last:
                    continue
                out.lost += counter != last[0] + 1 & 15 and not flags & 0x80
            last = counter, body
            if start:
                if body[:3] != b"\0\0\1":
                    raise CorruptStreamError(f"no PES packet at {at}")
                if flags & 0x40:
                    out.access_points.append(length)
                if body[7] & 0x80:
                    t = body[9:14]
                    out.timestamps.append((t[0] & 14) << 29 | t[1] << 22 | (t[2] & 254) << 14 | t[3] << 7 | t[4] >> 1)
                body, open_ = body[9 + body[8] :], True
            if open_:  # what comes before the first PES packet begins in a part that is not here
                parts.append(body)
                length += len(body)
    if data_pid is None:
        raise CorruptStreamError("no program table")
    out.payload = b"".join(parts)
    return out


def to_streams(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The media column: columns ``keep``, ``n_bytes`` long (unpadded) and ``media`` binary.

    A null text counts as empty, whose payload is 64 zero bytes. Equal texts give
    equal streams; an empty table gives an empty table; other columns are not read.
    """
    schema = extended(docs.select(*keep).schema, "n_bytes long, media binary")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                data = [(x.as_py() or "").encode("utf-8") for x in rows.column(len(keep))]
                columns = [rows.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(map(len, data), pa.int64()), pa.array([mux(padded(x)) for x in data], pa.binary())], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string")).mapInArrow(batches, schema)


#: What describe() adds.
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, packets long, lost long, timestamps array<long>, access_points array<long>, feature string"


def describe(media: DataFrame, keep: tuple[str, ...] = ("doc_id",), media_col: str = "media") -> DataFrame:
    """Read each stored stream back and return the columns ``keep`` and FEATURES.

    ``timestamps`` are the units' presentation times in 1/90000 s, ``access_points``
    the payload offsets from which reading can start. A null stream gives nulls. Of
    one that cannot be read, only the stored form's size and digest are told, and
    ``feature`` is "corrupt" with the reason.
    """
    schema = extended(media.select(*keep).schema, FEATURES)

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 10
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            s = demux(data)
        except (CorruptStreamError, IndexError) as e:
            return None, None, None, *stored, None, None, None, None, f"corrupt: {e}"
        times = hashlib.sha256(",".join(map(str, s.timestamps)).encode()).hexdigest()[:16]
        feature = f"packets={s.packets};lost={s.lost};units={len(s.timestamps)};last_pts={s.timestamps[-1] if s.timestamps else ''};access={len(s.access_points)};pts={times}"
        return len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-BLOCK:]), *stored, s.packets, s.lost, s.timestamps, s.access_points, feature

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
        for batch in it:
            rows = [row(x.as_py()) for x in batch.column(len(keep))]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return media.select(*keep, media_col).mapInArrow(batches, schema)
