"""Transport streams of other writers, corrupt ones, and what is told of them."""

import hashlib

import pytest

from rowtrail.llm import media


def packet(pid, body, counter, start=False, access=False, jump=False, payload=True):
    room = media.PACKET - 4
    if access or jump or not payload or len(body) < room:
        flags = (0x80 if jump else 0) | (0x40 if access else 0)
        spare = room - 1 - len(body)
        field = bytes((spare,)) + (bytes((flags,)) + b"\xff" * (spare - 1) if spare else b"")
        control = 0x30 if payload else 0x20
    else:
        field, control = b"", 0x10
    out = bytes((media.SYNC, (0x40 if start else 0) | pid >> 8, pid & 255, control | counter & 15)) + field + body
    assert len(out) == media.PACKET
    return out


def foreign(data, drop=None):
    """A stream with a network table, a long map over two packets, a second stream, idle and repeated packets, and units without length."""
    pat = media.section(0, 7, b"\0\0\xe0\x10" + (5).to_bytes(2, "big") + (0xE000 | 0x20).to_bytes(2, "big"))
    streams = b"\x1b" + (0xE000 | 0x31).to_bytes(2, "big") + (0xF000 | 3).to_bytes(2, "big") + b"\x52\x01\x09" + b"\x0f" + (0xE000 | 0x32).to_bytes(2, "big") + b"\xf0\0"
    pmt = b"\0" + media.section(2, 5, (0xE000 | 0x31).to_bytes(2, "big") + (0xF000 | 220).to_bytes(2, "big") + b"\x05\xda" + b"d" * 218 + streams)
    out = [packet(0x1FFF, b"n" * 184, 0), packet(0, b"\0" + pat + b"\xff" * (183 - len(pat)), 0, start=True), packet(0x20, pmt[:184], 0, start=True), packet(0x20, pmt[184:].ljust(184, b"\xff"), 1)]
    counter = 3
    for number, at in enumerate(range(0, len(data), 1000)):
        ticks = 90_000 + number * 3600
        pes = b"\0\0\1\xe0\0\0\x84\xc0\x0a" + media.timestamp(ticks) + media.timestamp(ticks - 100) + data[at : at + 1000]
        for i in range(0, len(pes), 150):
            if number != drop or i:
                out.append(packet(0x31, pes[i : i + 150], counter, start=not i, access=not i and number % 2 == 0))
            if i == 150:
                out.append(out[-1])  # sent twice
            counter += 1
        out.append(packet(0x31, b"", counter - 1, payload=False))  # no payload, the counter stays
        out.append(packet(0x32, b"other".ljust(184, b"o"), number, start=True))
    return b"".join(out)


def test_a_foreign_stream():
    data = bytes(i * 7 % 251 for i in range(5500))
    found = media.demux(foreign(data))
    assert found.payload == data and found.lost == 0
    assert found.timestamps == [90_000 + i * 3600 for i in range(6)] and found.access_points == [0, 2000, 4000]


def test_losses_and_announced_jumps():
    data = b"x" * 3000
    assert media.demux(foreign(data, drop=1)).lost == 1
    head = foreign(b"")
    start = b"\0\0\1\xe0\0\0\x84\0\0"
    assert media.demux(head + packet(0x31, start + b"a", 1, start=True) + packet(0x31, b"b", 9, jump=True)).lost == 0
    untimed = media.demux(head + packet(0x31, b"before", 0) + packet(0x31, start + b"a", 1, start=True))
    assert untimed.payload == b"a" and untimed.timestamps == []


def test_corrupt_streams_are_told_and_stop_nothing(spark):
    good = media.mux(media.padded(b"some text"))
    wrong = bytearray(good)
    wrong[10] ^= 1
    rows = [(1, good), (2, b"x" * 188), (3, b"short"), (4, bytes(wrong)), (5, b""), (6, None), (7, good[2 * media.PACKET :])]
    got = {r.doc_id: r for r in media.describe(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].payload_bytes == 64 and got[1].feature.startswith("packets=")
    for i in (2, 3, 4, 5, 7):
        assert got[i].payload_sha256 is None and got[i].feature.startswith("corrupt: ")
        assert got[i].media_bytes == len(rows[i - 1][1]) and got[i].media_sha256 == hashlib.sha256(rows[i - 1][1]).hexdigest()
    assert got[6].feature is None and got[6].media_bytes is None


def test_equal_texts_have_equal_streams(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in media.describe(media.to_streams(docs)).collect()}
    assert got[1].media_sha256 == got[2].media_sha256 and got[1].feature == got[2].feature and got[3].media_sha256 == got[4].media_sha256


@pytest.mark.parametrize("cut", [1, 100, 187])
def test_streams_of_broken_length(cut):
    with pytest.raises(media.CorruptStreamError):
        media.demux(media.mux(media.padded(b"text"))[:-cut])
