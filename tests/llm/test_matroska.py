import hashlib
import struct
import zlib

import pytest

from quillspark.llm import matroska as m


def segment(*parts, unknown=False):
    head = m.element(m.EBML, m.element(m.DOC_TYPE, b"matroska"))
    body = b"".join(parts)
    return head + (m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body if unknown else m.element(m.SEGMENT, body))


def track(number=1, default_ns=0):
    more = m.number(m.DEFAULT_DURATION, default_ns) if default_ns else b""
    return m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, number) + m.number(m.TRACK_TYPE, 2) + m.element(m.CODEC_ID, b"A_X") + more))


def block(flags, data, relative=0, number=1):
    return bytes([0x80 | number]) + struct.pack(">hB", relative, flags) + data


def frames(b, media):
    return [b[p[7] : p[7] + p[8]] for p in media.packets]


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 4608, 5184, 36864, 36865, 200_000])
def test_round_trip(n):
    payload = m.padded(bytes(i * 7 % 251 for i in range(n)))
    assert len(payload) % 576 == 0 and len(payload) >= max(576, n) and len(payload) - n <= 576
    b = m.mux(payload)
    media = m.parsed(b)
    assert media.error is None and b"".join(frames(b, media)) == payload and media.doc_type == "matroska"
    assert [p[1] for p in media.packets] == [k * 72_000_000 for k in range(len(payload) // 576)]
    start = b.index(m.SEGMENT.to_bytes(4, "big"))
    at = m.vint(b, start + 4, len(b))[1]
    for time, number, cluster in media.cues:
        assert number == 1 and b[at + cluster : at + cluster + 4] == m.CLUSTER.to_bytes(4, "big") and time % 4608 == 0


@pytest.mark.parametrize(
    ("flags", "data", "want"),
    [
        (0x00, b"abc", [b"abc"]),
        (0x02, bytes([2, 255, 45, 1]) + b"a" * 300 + b"b" + b"cc", [b"a" * 300, b"b", b"cc"]),
        (0x04, bytes([2]) + b"aabbcc", [b"aa", b"bb", b"cc"]),
        (0x06, bytes([3, 0x84, 0xBE, 0xC1]) + b"aaaa" + b"bbb" + b"ccccc" + b"d", [b"aaaa", b"bbb", b"ccccc", b"d"]),
    ],
    ids=["none", "xiph", "fixed", "ebml"],
)
def test_lacing(flags, data, want):
    b = segment(track(default_ns=5), m.element(m.CLUSTER, m.number(m.TIMESTAMP, 7) + m.element(m.SIMPLE_BLOCK, block(flags | 0x81, data, 3))))
    media = m.parsed(b)
    assert frames(b, media) == want and [p[1] for p in media.packets] == [10_000_000 + 5 * k for k in range(len(want))]
    assert all(p[2] and p[3] for p in media.packets)


def test_block_groups_unknown_sizes_and_strange_elements():
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block(0x04, bytes([1]) + b"xy", -2)) + m.number(m.BLOCK_DURATION, 4) + m.element(m.REFERENCE, b"\xff"))
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.element(0xEC, b"void") + m.number(m.TIMESTAMP, 10) + group
    b = segment(track(), cluster, cluster, m.element(m.CUES, m.element(m.CUE_POINT, m.number(m.CUE_TIME, 9) + m.element(m.CUE_POSITIONS, m.number(m.CUE_TRACK, 1)))), unknown=True)
    media = m.parsed(b)
    assert media.error is None and frames(b, media) == [b"x", b"y"] * 2 and media.clusters == 2 and media.cues == [(9, 1, 0)]
    assert [p[1] for p in media.packets] == [8_000_000, 10_000_000] * 2 and not any(p[2] for p in media.packets)


def test_cut_off_and_foreign_files():
    b = m.mux(m.padded(b"a" * 6000))
    for n in range(0, len(b), 97):
        media = m.parsed(b[:n])
        assert media.error or n == 0
        assert all(p[7] + p[8] <= n for p in media.packets)
    assert m.parsed(b"RIFF1234").error and m.parsed(None).packets == [] and m.parsed(b"").error is None


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "é" * 400), (4, "x" * 120_000), (3, "é" * 400)]
    got = m.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5
    for r in got:
        data = (dict(rows)[r.doc_id] or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(m.mux(payload)).hexdigest() and r.media_bytes == len(m.mux(payload))
    by = {r.doc_id: r.feature for r in got}
    assert by[1] == by[2] != by[3] and m.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packet_table(spark):
    b = m.mux(m.padded(b"q" * 1200))
    df = spark.createDataFrame([("a", bytearray(b)), ("b", None), ("c", bytearray(b[:-5])), ("d", bytearray(b"junk"))], "name string, content binary")
    got = m.packet_table(df, "name", "content").collect()
    assert {r.key for r in got} == {"a", "c", "d"} and all(b[r.offset : r.offset + r.length] in (b"q" * 576, b"q" * 48 + b"\xff" * 528) for r in got if r.key != "d")
    assert [(r.packet_no, r.length, bool(r.error)) for r in got if r.key == "d"] == [(None, None, True)]
    assert {r.error is None for r in got if r.key == "a"} == {True} and {r.codec for r in got if r.key != "d"} == {"A_PCM/INT/LIT"}


def walked(b):
    """(id, start, stop) of each element inside b, read by the specification: ids keep their length marker, sizes lose it."""

    def inside(at, stop):
        while at < stop:
            n = 9 - b[at].bit_length()
            name, at = int.from_bytes(b[at : at + n], "big"), at + n
            n = 9 - b[at].bit_length()
            size, at = int.from_bytes(b[at : at + n], "big") & ~(1 << 7 * n), at + n
            yield name, at, at + size
            if name in (0x18538067, 0x1F43B675, 0x1654AE6B, 0xAE, 0x1C53BB6B, 0xBB, 0xB7):
                yield from inside(at, at + size)
            at += size

    return list(inside(0, len(b)))


def test_stored_form_by_another_reader(spark):
    """Frames of laced blocks, cluster times and cues of what is written, without the operator's parser."""
    for n in (1, 576 * 9 + 5, 576 * 200):
        payload = m.padded(bytes(i * 31 % 256 for i in range(n)))
        b = m.mux(payload)
        found, out, clusters, start = walked(b), b"", [], None
        for name, a, z in found:
            if name == 0x18538067:
                start = a
            elif name == 0x1F43B675:
                clusters.append(a)
            elif name == 0xA3:
                assert b[a] == 0x81
                lacing, at = b[a + 3] >> 1 & 3, a + 4
                sizes = [z - at]
                if lacing:
                    count, at = b[at] + 1, at + 1
                    sizes = []
                    if lacing == 2:
                        sizes = [(z - at) // count] * count
                    elif lacing == 1:
                        for _ in range(count - 1):
                            size = 0
                            while b[at] == 255:
                                size, at = size + 255, at + 1
                            sizes.append(size + b[at])
                            at += 1
                    else:
                        for k in range(count - 1):
                            w = 9 - b[at].bit_length()
                            raw = int.from_bytes(b[at : at + w], "big") & ~(1 << 7 * w)
                            sizes.append(raw if not k else sizes[-1] + raw - ((1 << 7 * w - 1) - 1))
                            at += w
                    if lacing != 2:
                        sizes.append(z - at - sum(sizes))
                for size in sizes:
                    assert size == 576
                    out += b[at : at + size]
                    at += size
                assert at == z
        assert out == payload
        places = [int.from_bytes(b[a:z], "big") for name, a, z in found if name == 0xF1]
        times = [int.from_bytes(b[a:z], "big") for name, a, z in found if name == 0xB3]
        assert len(places) == len(clusters) and all(start + p < c <= start + p + 12 for p, c in zip(places, clusters))
        df = spark.createDataFrame([(1, bytearray(b)), (2, None), (3, bytearray(b"junk"))], "k long, c binary")
        assert [(r.key, r.cue_no, r.track, r.timestamp_ns, r.cluster_position) for r in m.cue_table(df, "k", "c").collect()] == [(1, k, 1, t * 1_000_000, p) for k, (t, p) in enumerate(zip(times, places))]


def test_times_that_no_long_holds(spark):
    track = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 1)))
    block = m.element(m.SIMPLE_BLOCK, b"\x81\x00\x00\x80abc")
    far = m.element(m.CLUSTER, m.number(m.TIMESTAMP, (1 << 64) - 1) + block)
    cue = m.element(m.CUES, m.element(m.CUE_POINT, m.number(m.CUE_TIME, (1 << 64) - 1) + m.element(m.CUE_POSITIONS, m.number(m.CUE_TRACK, 1) + m.number(m.CUE_CLUSTER, 5))))
    head = m.element(m.EBML, m.element(m.DOC_TYPE, b"matroska"))
    files = [(1, head + m.element(m.SEGMENT, track + far)), (2, head + m.element(m.SEGMENT, track + cue)), (3, m.mux(m.padded(b"fine")))]
    table = spark.createDataFrame([(k, bytearray(b)) for k, b in files], "id int, content binary").repartition(2)
    got = {r.key: r for r in m.packet_table(table, "id", "content").collect()}
    assert "no long" in got[1].error and got[1].timestamp_ns is None and got[3].error is None
    cues = {r.key: (r.timestamp_ns, r.cluster_position) for r in m.cue_table(table, "id", "content").collect() if r.key != 3}
    assert cues == {2: (None, 5)}
