"""Matroska media columns: EBML elements to packet tables, and payloads to Matroska.

``packet_table`` turns a binary column of Matroska files into one row per packet (frame), with
track, timestamp, flags, lacing and byte range. ``muxed`` stores payloads as 8-bit PCM audio in
Matroska, ``demuxed`` reads the stored bytes back through the packet ranges. Parsing is
per file inside tasks; the plan has no shuffle, so a hot source or repeated files cost what
their bytes cost.

Defined results: null or empty content has no packets; content that isn't Matroska, or that is
cut off, yields the packets before the fault and a text in ``error``; EBML Void, CRC-32 and
unknown elements are skipped; clusters and segments of unknown size are read to their end.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import small_batches

# Element ids of the public EBML and Matroska specifications.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
MUXING_APP, WRITING_APP = 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
FLAG_LACING = 0x9C
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}
LACINGS = ("none", "xiph", "fixed", "ebml")

UNIT = 576  # bytes of a frame, and of what payloads are padded to
RATE = 8000  # samples a second; a frame lasts 72 ms
LACED, PER_CLUSTER = 8, 64  # frames in a block and in a cluster


class Fault(ValueError):
    """Bytes that no EBML reader can make sense of."""


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster's place in its segment
    clusters: int = 0
    error: str | None = None


def vint(b: bytes, at: int, stop: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length integer and where it ends; None for the reserved 'unknown'."""
    if at >= stop or not b[at]:
        raise Fault(f"no variable-length integer at {at}")
    n = 9 - b[at].bit_length()
    if at + n > stop:
        raise Fault(f"cut off at {at}")
    raw = int.from_bytes(b[at : at + n], "big")
    if keep_marker:
        return raw, at + n
    value = raw & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(b: bytes, at: int, stop: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of each child's data. An unknown size reaches to the next sibling or parent level."""
    while at < stop:
        name, start = vint(b, at, stop, keep_marker=True)
        if inside == CLUSTER and name in TOP:
            return
        size, start = vint(b, start, stop)
        if size is None:
            end = stop if name != CLUSTER else _cluster_end(b, start, stop)
        else:
            end = start + size
            if end > stop:
                if name in MASTERS:
                    yield name, start, stop
                raise Fault(f"element {name:X} at {at} is cut off")
        yield name, start, end
        at = end


def _cluster_end(b: bytes, at: int, stop: int) -> int:
    while at < stop:
        name, start = vint(b, at, stop, keep_marker=True)
        if name in TOP:
            return at
        size, start = vint(b, start, stop)
        at = start + (size or 0)
    return stop


def uint(b: bytes, start: int, end: int) -> int:
    return int.from_bytes(b[start:end], "big")


def real(b: bytes, start: int, end: int) -> float:
    return struct.unpack(">d" if end - start == 8 else ">f", b[start:end])[0] if end - start in (4, 8) else 0.0


def laced(b: bytes, at: int, stop: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, length) of each frame of a block."""
    if lacing == 0:
        return [(at, stop - at)]
    if at >= stop:
        raise Fault(f"lacing is cut off at {at}")
    n, at = b[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (stop - at) % n:
            raise Fault(f"fixed lacing at {at} doesn't divide")
        sizes = [(stop - at) // n] * n
    elif lacing == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= stop:
                    raise Fault(f"lacing is cut off at {at}")
                size, at, more = size + b[at], at + 1, b[at] == 255
                if not more:
                    break
            sizes.append(size)
    else:
        for k in range(n - 1):
            first = at
            value, at = vint(b, at, stop)
            width = 7 * (at - first) - 1
            if value is None:
                value = (1 << width + 1) - 1
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << width) - 1))
    if lacing != 2:
        sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise Fault(f"lacing at {at} has a negative size")
    ends = np.cumsum([at, *sizes]).tolist()
    return list(zip(ends, sizes))


def parsed(b: bytes | None) -> Media:
    """All of a file's packets and cues."""
    media = Media()
    if not b:
        return media
    try:
        found = list(_children(elements(b, 0, len(b)), media))
        if not found or found[0][0] != EBML:
            raise Fault("no EBML header")
        for name, start, end in found:
            if name == EBML:
                for k, s, e in elements(b, start, end):
                    if k == DOC_TYPE:
                        media.doc_type = b[s:e].rstrip(b"\0").decode("ascii", "replace")
            elif name == SEGMENT:
                _segment(b, start, end, media)
    except Fault as e:
        media.error = media.error or str(e)
    return media


def _children(found: Iterator[tuple[int, int, int]], media: Media) -> Iterator[tuple[int, int, int]]:
    """The elements up to a fault, which is noted."""
    try:
        yield from found
    except Fault as e:
        media.error = media.error or str(e)


def _segment(b: bytes, start: int, end: int, media: Media) -> None:
    for name, s, e in _children(elements(b, start, end), media):
        if name == INFO:
            for k, x, y in elements(b, s, e):
                if k == TIMESTAMP_SCALE:
                    media.scale = uint(b, x, y)
                elif k == DURATION:
                    media.duration = real(b, x, y)
        elif name == TRACKS:
            for k, x, y in elements(b, s, e):
                if k == TRACK_ENTRY:
                    _track(b, x, y, media)
        elif name == CLUSTER:
            _cluster(b, s, e, media)
        elif name == CUES:
            for k, x, y in elements(b, s, e):
                if k == CUE_POINT:
                    _cue(b, x, y, media)


def _track(b: bytes, start: int, end: int, media: Media) -> None:
    track: dict = {"codec": "", "type": 0, "default_ns": 0, "rate": 0.0, "channels": 1, "bits": 0}
    number = 0
    for name, s, e in elements(b, start, end):
        if name == TRACK_NUMBER:
            number = uint(b, s, e)
        elif name == TRACK_TYPE:
            track["type"] = uint(b, s, e)
        elif name == CODEC_ID:
            track["codec"] = b[s:e].decode("ascii", "replace")
        elif name == DEFAULT_DURATION:
            track["default_ns"] = uint(b, s, e)
        elif name == AUDIO:
            for k, x, y in elements(b, s, e):
                if k == SAMPLING:
                    track["rate"] = real(b, x, y)
                elif k == CHANNELS:
                    track["channels"] = uint(b, x, y)
                elif k == BIT_DEPTH:
                    track["bits"] = uint(b, x, y)
    media.tracks[number] = track


def _cluster(b: bytes, start: int, end: int, media: Media) -> None:
    base, no = 0, media.clusters
    media.clusters += 1
    for name, s, e in _children(elements(b, start, end, CLUSTER), media):
        if name == TIMESTAMP:
            base = uint(b, s, e)
        elif name == SIMPLE_BLOCK:
            _block(b, s, e, media, no, base, None, 0)
        elif name == BLOCK_GROUP:
            block, duration, refers = None, 0, False
            for k, x, y in _children(elements(b, s, e), media):
                if k == BLOCK:
                    block = (x, y)
                elif k == BLOCK_DURATION:
                    duration = uint(b, x, y)
                elif k == REFERENCE:
                    refers = True
            if block:
                _block(b, *block, media, no, base, not refers, duration)


def _block(b: bytes, start: int, end: int, media: Media, cluster: int, base: int, key: bool | None, duration: int) -> None:
    track, at = vint(b, start, end)
    if at + 3 > end:
        raise Fault(f"block at {start} is cut off")
    relative, flags = struct.unpack(">hB", b[at : at + 3])
    lacing = flags >> 1 & 3
    frames = laced(b, at + 3, end, lacing)
    step = media.tracks.get(track, {}).get("default_ns", 0) or duration * media.scale // len(frames)
    first = (base + relative) * media.scale
    if not -(1 << 63) <= first <= first + (len(frames) - 1) * step < 1 << 63:
        raise Fault(f"block at {start} has a time that no long holds")
    simple = key is None
    for k, (offset, length) in enumerate(frames):
        media.packets.append((track, first + k * step, bool(flags & 128) if simple else key, simple and bool(flags & 1), LACINGS[lacing], cluster, start, offset, length))


def _cue(b: bytes, start: int, end: int, media: Media) -> None:
    time = 0
    for name, s, e in elements(b, start, end):
        if name == CUE_TIME:
            time = uint(b, s, e)
        elif name == CUE_POSITIONS:
            got = {k: uint(b, x, y) for k, x, y in elements(b, s, e)}
            media.cues.append((time, got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))


# Writing


def element(name: int, data: bytes) -> bytes:
    n, size = 1, len(data)
    while size >= (1 << 7 * n) - 1:
        n += 1
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + (size | 1 << 7 * n).to_bytes(n, "big") + data


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def padded(data: bytes) -> bytes:
    """data and bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def mux(payload: bytes) -> bytes:
    """A Matroska file of one 8-bit PCM track; payload is a multiple of UNIT."""
    ms = UNIT * 1000 // RATE
    frames = len(payload) // UNIT
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(frames * ms))) + element(MUXING_APP, b"quillspark") + element(WRITING_APP, b"quillspark"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, ms * 1_000_000) + audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    for c in range(0, frames, PER_CLUSTER):
        blocks = [number(TIMESTAMP, c * ms)]
        for k in range(c, min(c + PER_CLUSTER, frames), LACED):
            n = min(LACED, frames - k, c + PER_CLUSTER - k)
            lace = b"\x84" + bytes([n - 1]) if n > 1 else b"\x80"  # key frame; equal sizes
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", (k - c) * ms) + lace + payload[k * UNIT : (k + n) * UNIT]))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, c * ms) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def feature(media: Media, payload: bytes) -> str:
    """What the packets and the samples look like, as text; a function of the stored bytes alone."""
    track = media.tracks.get(1, {"codec": "", "rate": 0.0, "bits": 0})
    x = np.frombuffer(payload, np.uint8)
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    last = max((p[1] for p in media.packets), default=0)
    kinds = sorted({p[4] for p in media.packets})
    return (
        f"codec={track['codec']};rate={track['rate']:.0f};bits={track['bits']};packets={len(media.packets)};clusters={media.clusters};cues={len(media.cues)}"
        f";lacing={'+'.join(kinds)};last_ms={last // 1_000_000};mean={x.mean() if x.size else 0:.4f};std={x.std() if x.size else 0:.4f};crossings={turns}"
    )


# DataFrame operators

PACKET = T.StructType(
    [
        T.StructField("packet_no", T.LongType()),
        T.StructField("track", T.LongType()),
        T.StructField("timestamp_ns", T.LongType()),
        T.StructField("keyframe", T.BooleanType()),
        T.StructField("discardable", T.BooleanType()),
        T.StructField("lacing", T.StringType()),
        T.StructField("cluster_no", T.LongType()),
        T.StructField("block_offset", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def packet_table(df: DataFrame, key_col: str, content_col: str) -> DataFrame:
    """One row per packet: the key, PACKET's columns, codec, and the file's error if it has one. A file without packets has no row, or one without a packet if it has an error."""
    schema = T.StructType([T.StructField("key", df.schema[key_col].dataType), *PACKET.fields, T.StructField("codec", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in enumerate(batch.column("content")):
                media = parsed(content.as_py())
                for k in range(0, len(media.packets), 50_000):
                    part = media.packets[k : k + 50_000]
                    columns = [list(range(k, k + len(part))), *map(list, zip(*part))]
                    keys = batch.column("key").take(pa.array([at] * len(part)))
                    codec = [media.tracks.get(p[0], {}).get("codec") for p in part]
                    arrays = [keys, *(pa.array(c, t) for c, t in zip(columns, _ARROW)), pa.array(codec, pa.string()), pa.array([media.error] * len(part), pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, schema.names)
                if media.error and not media.packets:
                    yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, 1), *(pa.nulls(1, t) for t in _ARROW), pa.nulls(1, pa.string()), pa.array([media.error], pa.string())], schema.names)

    small_batches(df.sparkSession)
    return df.select(F.col(key_col).alias("key"), F.col(content_col).alias("content")).mapInArrow(run, schema)


def cue_table(df: DataFrame, key_col: str, content_col: str) -> DataFrame:
    """One row per cue: the key, cue_no, track, timestamp_ns, and the place of the cluster it leads to, counted from the first byte of its segment's content; null what no long holds."""
    schema = T.StructType([T.StructField("key", df.schema[key_col].dataType), *(T.StructField(n, T.LongType()) for n in ("cue_no", "track", "timestamp_ns", "cluster_position"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in enumerate(batch.column("content")):
                media = parsed(content.as_py())
                rows = [tuple(v if v < 1 << 63 else None for v in (k, track, time * media.scale, place)) for k, (time, track, place) in enumerate(media.cues)]
                keys = batch.column("key").take(pa.array([at] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[c] for r in rows], pa.int64()) for c in range(4))], schema.names)

    small_batches(df.sparkSession)
    return df.select(F.col(key_col).alias("key"), F.col(content_col).alias("content")).mapInArrow(run, schema)


def muxed(docs: DataFrame) -> DataFrame:
    """doc_id, text to doc_id, n_bytes, media: the text's padded UTF-8 bytes in Matroska."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(x or "").encode() for x in batch.column("text").to_pylist()]
            media = pa.array([mux(padded(x)) for x in data], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, data), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def demuxed(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """stored with the payload that its packets' byte ranges hold, the number of packets, and features of both."""
    more = [T.StructField("payload", T.BinaryType()), T.StructField("n_packets", T.LongType()), T.StructField("feature", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, counts, features = [], [], []
            for b in batch.column(media_col).to_pylist():
                media = parsed(b)
                payloads.append(b"".join([b[p[7] : p[7] + p[8]] for p in media.packets]))
                counts.append(len(media.packets))
                features.append(feature(media, payloads[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(counts, pa.int64()), pa.array(features, pa.string())], [*batch.schema.names, "payload", "n_packets", "feature"])

    return stored.mapInArrow(run, T.StructType([*stored.schema.fields, *more]))


def round_trip(docs: DataFrame) -> DataFrame:
    """Per document: the digests of its stored form and of what is read back from it."""
    back = demuxed(muxed(docs))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "n_packets",
    )
