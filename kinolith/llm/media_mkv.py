"""Matroska files in a column: EBML elements, clusters, lacing and cues as packet tables.

The writer stores bytes as packets of one 8-bit PCM audio track; the reader
parses any file of this family: variable-length ids and sizes, unknown sizes,
SimpleBlocks and BlockGroups, the three kinds of lacing, and cues. Packets are
byte ranges of the file, so a payload is read back without copying headers.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import namedtuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolith.llm.shared import by_bytes, utf8_rows

# Element ids of the format (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, EBML}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES}

RATE = 8_000
PACKET = 512
LACED = 8
CLUSTER_BYTES = 32_768
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

Packet = namedtuple("Packet", "track timestamp start length keyframe lacing")
Element = namedtuple("Element", "id start body end")

#: What is written and given on at a time: bytes of texts, and packets.
BATCH_BYTES, BATCH_PACKETS = 4_000_000, 50_000


def write_id(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def write_size(value: int, width: int = 0) -> bytes:
    """A variable-length number: the first set bit of the first byte tells how many bytes."""
    width = width or max(1, -(-(value + 1).bit_length() // 7))
    if value + 1 >= 1 << (7 * width):
        width += 1
    return ((1 << (7 * width)) | value).to_bytes(width, "big")


def element(name: int, body: bytes) -> bytes:
    return write_id(name) + write_size(len(body)) + body


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def read_number(data, at: int, end: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length number and where it ends; None for the reserved value of unknown size."""
    if at >= end or data[at] == 0:
        raise ValueError(f"no EBML number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"EBML number cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        value -= 1 << (7 * width)
        if value == (1 << (7 * width)) - 1:
            return None, at + width
    return value, at + width


def laced(frames: list[bytes], kind: int) -> bytes:
    """Lace header and frames of one block."""
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        for size in sizes[:-1]:
            head += b"\xff" * (size // 255) + bytes([size % 255])
    elif kind == EBML_LACING:
        head += write_size(sizes[0])
        for before, size in zip(sizes, sizes[1:-1]):
            step = size - before
            width = next(w for w in range(1, 9) if abs(step) < (1 << (7 * w - 1)))
            head += write_size(step + (1 << (7 * width - 1)) - 1, width)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs equal frames")
    return head + b"".join(frames)


def write_file(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """A file with payload as 8-bit mono PCM: one millisecond-scaled track, laced blocks, cues."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    audio = element(AUDIO, element(SAMPLING_RATE, _float(rate)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    info = number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, _float(len(payload) * 1000 / rate))
    info += element(MUXING_APP, b"kinolith") + element(WRITING_APP, b"kinolith")
    parts = [element(INFO, info), element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, parts)), []
    for begin in range(0, len(payload), CLUSTER_BYTES):
        base = begin * 1000 // rate
        blocks = [number(TIMESTAMP, base)]
        end = min(begin + CLUSTER_BYTES, len(payload))
        for start in range(begin, end, packet * LACED):
            frames = [payload[i : min(i + packet, end)] for i in range(start, min(start + packet * LACED, end), packet)]
            kind = NO_LACING if len(frames) == 1 else FIXED if len(frames[-1]) == packet else EBML_LACING
            body = frames[0] if kind == NO_LACING else laced(frames, kind)
            offset = start * 1000 // rate - base
            blocks.append(element(SIMPLE_BLOCK, write_size(1) + offset.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + body))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, base) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def _float(value: float) -> bytes:
    import struct

    return struct.pack(">d", value)


def children(data, start: int, end: int, inside: int | None = None):
    """The elements between two bytes. An unknown size reaches to the next element that cannot be inside."""
    at = start
    while at < end:
        name, body = read_number(data, at, end, keep_marker=True)
        size, body = read_number(data, body, end)
        if size is None:
            stop = end
            if name == CLUSTER:
                stop = next((e.start for e in children(data, body, end, CLUSTER) if e.id in TOP_LEVEL), end)
        else:
            stop = body + size
            if stop > end:
                raise ValueError(f"element at byte {at} reaches beyond byte {end}")
        yield Element(name, at, body, stop)
        if inside == CLUSTER and name in TOP_LEVEL:
            return
        at = stop


def frame_ranges(data, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block, whose lace header starts at byte at."""
    if kind == NO_LACING:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == EBML_LACING:
        for i in range(count - 1):
            before = at
            value, at = read_number(data, at, end)
            width = at - before
            if value is None:
                value = (1 << (7 * width)) - 1
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << (7 * width - 1)) - 1))
    else:
        if (end - at) % count:
            raise ValueError("a block with fixed lacing is not divisible by its frames")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes reach beyond their block")
    starts = [at]
    for size in sizes[:-1]:
        starts.append(starts[-1] + size)
    return list(zip(starts, sizes, strict=True))


def read_file(data: bytes) -> dict:
    """packets, tracks (number -> codec, rate), cues [(time, cluster's byte)], scale and duration."""
    found: dict = {"packets": [], "tracks": {}, "cues": [], "scale": 1_000_000, "duration": None}
    top = list(children(data, 0, len(data)))
    if not top or top[0].id != EBML:
        raise ValueError("no EBML header")
    for segment in (e for e in top if e.id == SEGMENT):
        for part in children(data, segment.body, segment.end):
            if part.id == INFO:
                for e in children(data, part.body, part.end):
                    if e.id == TIMESTAMP_SCALE:
                        found["scale"] = int.from_bytes(data[e.body : e.end], "big")
                    elif e.id == DURATION:
                        found["duration"] = _read_float(data[e.body : e.end])
            elif part.id == TRACKS:
                for entry in children(data, part.body, part.end):
                    _read_track(data, entry, found["tracks"])
            elif part.id == CLUSTER:
                _read_cluster(data, part, found["packets"])
            elif part.id == CUES:
                for point in children(data, part.body, part.end):
                    fields = _fields(data, point)
                    found["cues"].append((fields.get(CUE_TIME, 0), segment.body + fields.get(CUE_CLUSTER, 0)))
    return found


def _read_float(raw: bytes) -> float:
    import struct

    return struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0]


def _fields(data, parent: Element) -> dict[int, int]:
    """Unsigned numbers below an element, by id."""
    found: dict[int, int] = {}
    for e in children(data, parent.body, parent.end):
        if e.id in MASTERS:
            found |= _fields(data, e)
        else:
            found[e.id] = int.from_bytes(data[e.body : e.end], "big")
    return found


def _read_track(data, entry: Element, tracks: dict) -> None:
    if entry.id != TRACK_ENTRY:
        return
    codec, rate, number_ = "", None, 0
    for e in children(data, entry.body, entry.end):
        if e.id == TRACK_NUMBER:
            number_ = int.from_bytes(data[e.body : e.end], "big")
        elif e.id == CODEC_ID:
            codec = bytes(data[e.body : e.end]).decode("ascii", "replace")
        elif e.id == AUDIO:
            for a in children(data, e.body, e.end):
                if a.id == SAMPLING_RATE:
                    rate = _read_float(data[a.body : a.end])
    tracks[number_] = (codec, rate)


def _read_cluster(data, cluster: Element, packets: list[Packet]) -> None:
    base = 0
    for e in children(data, cluster.body, cluster.end):
        blocks = [e] if e.id == SIMPLE_BLOCK else []
        if e.id == TIMESTAMP:
            base = int.from_bytes(data[e.body : e.end], "big")
        elif e.id == BLOCK_GROUP:
            blocks = [b for b in children(data, e.body, e.end) if b.id == BLOCK]
        for block in blocks:
            track, at = read_number(data, block.body, block.end)
            offset = int.from_bytes(data[at : at + 2], "big", signed=True)
            flags = data[at + 2]
            kind = flags >> 1 & 3
            key = bool(flags & 0x80) if block.id == SIMPLE_BLOCK else True
            for start, length in frame_ranges(data, at + 3, block.end, kind):
                packets.append(Packet(track, base + offset, start, length, key, kind))


def payload_of(data: bytes, packets: list[Packet], track: int = 1) -> bytes:
    return b"".join([data[p.start : p.start + p.length] for p in packets if p.track == track])


def padded(text: bytes, unit: int = 64) -> bytes:
    """text with zero bytes up to a positive multiple of unit."""
    return text + bytes(max(unit, math.ceil(len(text) / unit) * unit) - len(text))


def features(media: dict) -> str:
    """Counts of a parsed file: packets, clusters in the cues, lacing kinds, last timestamp, duration."""
    packets = media["packets"]
    kinds = [sum(p.lacing == k for p in packets) for k in range(4)]
    last = packets[-1].timestamp if packets else 0
    return (
        f"tracks={len(media['tracks'])};packets={len(packets)};cues={len(media['cues'])};"
        f"lacing={'/'.join(map(str, kinds))};last_ms={last};duration_ms={media['duration']:.3f}"
    )


def store(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media (a file with the text's bytes, padded by zeros to a multiple of 64).

    A null or empty text is stored as 64 zero bytes. Rows are taken one by one:
    repeated rows give equal files, an empty table an empty result.
    """

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            # a few megabytes of files at a time, so that a batch of long texts is not held twice
            rows = zip(keys, (t or b"" for (t,) in utf8_rows(batch, "text")), strict=True)
            for part in by_bytes(rows, BATCH_BYTES, lambda r: len(r[1]) + 256):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in part], batch.schema.field("key").type),
                        pa.array([len(t) for _, t in part], pa.int64()),
                        pa.array([write_file(padded(t)) for _, t in part], pa.binary()),
                    ],
                    names=["key", "n_bytes", "media"],
                )

    kind = docs.schema[key].dataType.simpleString()
    light = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    return light.mapInArrow(write, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


PACKETS = "array<struct<track: long, timestamp_ms: double, start: long, length: long, keyframe: boolean, lacing: int>>"


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet of each file: key, packet, track, timestamp_ms, start, length, keyframe, lacing.

    A null file has no packets; one that does not parse has a row with packet null and its error.
    """

    def parse(batches):
        import pyarrow as pa

        fields = ("packet", "track", "timestamp_ms", "start", "length", "keyframe", "lacing", "error")
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string())
        def table(keys, rows, at):
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            return pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["key", *fields],
            )

        for batch in batches:
            keys = batch.column(0)
            rows, at = [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    found = read_file(data)
                    own = [
                        (j, p.track, p.timestamp * found["scale"] / 1e6, p.start, p.length, p.keyframe, p.lacing, None)
                        for j, p in enumerate(found["packets"])
                    ]
                except (ValueError, IndexError) as e:
                    own = [(None,) * 7 + (str(e),)]
                rows += own
                at += [i] * len(own)
                if len(rows) >= BATCH_PACKETS:
                    yield table(keys, rows, at)
                    rows, at = [], []
            yield table(keys, rows, at)

    kind = media.schema[key].dataType.simpleString()
    found = media.select(F.col(key).alias("key"), F.col(column)).mapInArrow(
        parse,
        f"key {kind}, packet long, track long, timestamp_ms double, start long, length long, keyframe boolean, lacing int, error string",
    )
    return found.withColumnRenamed("key", key)


def digests(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read each file of store() back: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null file has nulls for all that would be read from it. Rows are taken one
    by one, each with memory for itself, very long ones too; repeated rows give
    equal values and an empty table gives no rows.
    """

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for data in batch.column(batch.schema.get_field_index("media")).to_pylist():
                if data is None:
                    rows.append((None,) * 6)
                    continue
                found = read_file(data)
                payload = payload_of(data, found["packets"])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(found)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            long, string = pa.int64(), pa.string()
            kinds = (long, string, long, long, string, string)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = media.schema[key].dataType.simpleString()
    found = media.select(F.col(key).alias("key"), "n_bytes", "media").mapInArrow(
        read,
        f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
    return found.withColumnRenamed("key", key)
