"""Media columns: a Matroska muxer and a parser of its variable-length elements, clusters, lacing and cues.

`parse` turns stored bytes into tracks, packets and cues; `packet_table` does so for a column; `store_as_media`
keeps each text losslessly as 8-bit samples and reads it back from the stored bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

# Fixed values of the format: element ids.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, TYPE, CODEC, LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
TOP_LEVEL = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
#: Samples a second, samples a frame (64 ms), frames a laced block, blocks a cluster (under 32 s, the reach of a block's own time).
SAMPLE_RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 32


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(name: int, body: bytes | int | float | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, str):
        body = body.encode()
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _laced(frames: list[bytes], lacing: str) -> tuple[int, bytes]:
    """The flag bits and body of a block with these frames."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == "auto":
        lacing = "fixed" if len(set(sizes)) == 1 else "ebml"
    if lacing == "fixed":
        if len(set(sizes)) != 1:
            raise ValueError("fixed lacing needs frames of one size")
        return 0x04, head + b"".join(frames)
    if lacing == "xiph":
        for n in sizes[:-1]:
            head += b"\xff" * (n // 255) + bytes([n % 255])
        return 0x02, head + b"".join(frames)
    head += _size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        head += _size(b - a + (1 << 7 * width - 1) - 1, width)
    return 0x06, head + b"".join(frames)


def mux(payload: bytes, lacing: str = "auto") -> bytes:
    """One 8-bit mono PCM track with the payload as its samples, laced into blocks, with one cue for each cluster."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = _element(INFO, _element(SCALE, 1_000_000) + _element(DURATION, len(payload) * 1000 / SAMPLE_RATE) + _element(MUXER, "graphloom") + _element(WRITER, "graphloom"))
    audio = _element(AUDIO, _element(RATE, float(SAMPLE_RATE)) + _element(CHANNELS, 1) + _element(DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK, _element(NUMBER, 1) + _element(UID, 1) + _element(TYPE, 2) + _element(LACING, 1) + _element(CODEC, "A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at, step = len(info) + len(tracks), FRAME * 1000 // SAMPLE_RATE
    for first in range(0, len(frames), LACED * BLOCKS):
        blocks, inside = [_element(TIME, first * step)], 0
        for b in range(first, min(first + LACED * BLOCKS, len(frames)), LACED):
            flags, laced = _laced(frames[b : b + LACED], lacing)
            blocks.append(_element(SIMPLE_BLOCK, _size(1) + struct.pack(">hB", (b - first) * step, 0x80 | flags) + laced))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE, _element(CUE_TIME, first * step) + _element(CUE_AT, _element(CUE_TRACK, 1) + _element(CUE_CLUSTER, at) + _element(CUE_RELATIVE, len(blocks[0])))))
        body.append(cluster)
        at += len(cluster)
    head = _element(EBML, _element(VERSION, 1) + _element(READ_VERSION, 1) + _element(MAX_ID, 4) + _element(MAX_SIZE, 8) + _element(DOC_TYPE, "matroska") + _element(DOC_VERSION, 4) + _element(DOC_READ_VERSION, 2))
    return head + _element(SEGMENT, b"".join([*body, _element(CUES, b"".join(cues))]))


def read_vint(data, at: int, end: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """The value and the position after it; None for the reserved all-ones value (an unknown size)."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - int(data[at]).bit_length()
    if at + width > end:
        raise ValueError(f"cut off at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return raw, at + width
    value = raw & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data, at: int, end: int, parent: int = 0):
    """(id, body start, body end) of each element in a span; an element of unknown size ends where a sibling of its level or a parent's level starts."""
    while at < end:
        name, body = read_vint(data, at, end, keep_marker=True)
        size, body = read_vint(data, body, end)
        if size is None:
            stop = _unknown_end(data, name, body, end)
        elif body + size > end:
            raise ValueError(f"element {name:#x} at byte {at} reaches past its parent")
        else:
            stop = body + size
        yield name, body, stop
        at = stop


def _unknown_end(data, name: int, at: int, end: int) -> int:
    if name == SEGMENT:
        return end
    while at < end:
        inner, body = read_vint(data, at, end, keep_marker=True)
        if inner in TOP_LEVEL or inner == EBML:
            return at
        size, body = read_vint(data, body, end)
        if size is None:
            raise ValueError(f"element {inner:#x} of unknown size inside {name:#x}")
        at = body + size
    return end


@dataclass
class Packet:
    track: int
    timestamp_ms: float
    start: int
    size: int
    keyframe: bool
    lacing: str
    cluster: int


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    segment: int = 0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[dict] = field(default_factory=list)


def _uint(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data, a: int, b: int) -> float:
    return 0.0 if a == b else struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]


def _text(data, a: int, b: int) -> str:
    return bytes(data[a:b]).rstrip(b"\0").decode("utf-8", "replace")


def _block(data, a: int, b: int, base: int, media: Media, cluster: int, keyframe: bool | None) -> None:
    track, at = read_vint(data, a, b)
    if at + 3 > b:
        raise ValueError(f"block cut off at byte {a}")
    offset, flags = struct.unpack(">hB", data[at : at + 3])
    at += 3
    kind = ("none", "xiph", "fixed", "ebml")[flags >> 1 & 3]
    sizes = []
    if kind == "none":
        sizes = [b - at]
    else:
        count, at = data[at] + 1, at + 1
        if kind == "fixed":
            if (b - at) % count:
                raise ValueError(f"fixed lacing does not divide the block at byte {a}")
            sizes = [(b - at) // count] * count
        elif kind == "xiph":
            for _ in range(count - 1):
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                sizes.append(n + data[at])
                at += 1
        elif count > 1:
            n, at = read_vint(data, at, b)
            sizes.append(n)
            for _ in range(count - 2):
                before = at
                n, at = read_vint(data, at, b)
                sizes.append(sizes[-1] + n - ((1 << 7 * (at - before) - 1) - 1))
        if kind != "fixed":
            sizes.append(b - at - sum(sizes))
    if any(n is None or n < 0 for n in sizes):
        raise ValueError(f"lacing sizes exceed the block at byte {a}")
    step = media.tracks.get(track, {}).get("default_ms", 0.0)
    keyframe = bool(flags & 0x80) if keyframe is None else keyframe
    for i, n in enumerate(sizes):
        media.packets.append(Packet(track, (base + offset) * media.scale / 1e6 + i * step, at, n, keyframe, kind, cluster))
        at += n


def parse(data) -> Media:
    """Tracks, packets (time, byte range, lacing) and cues of Matroska bytes; ValueError if they are malformed."""
    data, media = memoryview(data).cast("B"), Media()
    for name, a, b in elements(data, 0, len(data)):
        if name == EBML:
            for inner, c, d in elements(data, a, b):
                if inner == DOC_TYPE:
                    media.doc_type = _text(data, c, d)
        elif name == SEGMENT:
            media.segment = a
            _segment(data, a, b, media)
    if media.doc_type not in ("matroska", "webm"):
        raise ValueError(f"not Matroska: document type {media.doc_type!r}")
    return media


def _segment(data, a: int, b: int, media: Media) -> None:
    for name, c, d in elements(data, a, b):
        if name == INFO:
            for inner, e, f in elements(data, c, d):
                if inner == SCALE:
                    media.scale = _uint(data, e, f)
                elif inner == DURATION:
                    media.duration = _float(data, e, f)
        elif name == TRACKS:
            for inner, e, f in elements(data, c, d):
                if inner == TRACK:
                    _track(data, e, f, media)
        elif name == CLUSTER:
            base, start = 0, c
            for inner, e, f in elements(data, c, d):
                if inner == TIME:
                    base = _uint(data, e, f)
                elif inner == SIMPLE_BLOCK:
                    _block(data, e, f, base, media, start, None)
                elif inner == BLOCK_GROUP:
                    parts = list(elements(data, e, f))
                    key = all(x[0] != REFERENCE for x in parts)
                    for part, g, h in parts:
                        if part == BLOCK:
                            _block(data, g, h, base, media, start, key)
        elif name == CUES:
            for inner, e, f in elements(data, c, d):
                if inner == CUE:
                    _cue(data, e, f, media)


def _track(data, a: int, b: int, media: Media) -> None:
    t = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "depth": 0}
    for name, c, d in elements(data, a, b):
        if name == NUMBER:
            t["number"] = _uint(data, c, d)
        elif name == TYPE:
            t["type"] = _uint(data, c, d)
        elif name == CODEC:
            t["codec"] = _text(data, c, d)
        elif name == 0x23E383:
            t["default_ms"] = _uint(data, c, d) / 1e6
        elif name == AUDIO:
            for inner, e, f in elements(data, c, d):
                if inner == RATE:
                    t["rate"] = _float(data, e, f)
                elif inner == CHANNELS:
                    t["channels"] = _uint(data, e, f)
                elif inner == DEPTH:
                    t["depth"] = _uint(data, e, f)
    if t["codec"].startswith("A_PCM") and t["depth"]:
        t.setdefault("default_ms", FRAME * 1000 / t["rate"])
    media.tracks[t["number"]] = t


def _cue(data, a: int, b: int, media: Media) -> None:
    cue = {"time": 0, "track": 0, "cluster": 0, "relative": 0}
    for name, c, d in elements(data, a, b):
        if name == CUE_TIME:
            cue["time"] = _uint(data, c, d)
        elif name == CUE_AT:
            for inner, e, f in elements(data, c, d):
                key = {CUE_TRACK: "track", CUE_CLUSTER: "cluster", CUE_RELATIVE: "relative"}.get(inner)
                if key:
                    cue[key] = _uint(data, e, f)
    media.cues.append(cue)


def seek(data, media: Media, time_ms: float) -> Packet | None:
    """The last packet at or before a time, found through the cues (all packets where there are none)."""
    before = [c for c in media.cues if c["time"] * media.scale / 1e6 <= time_ms]
    starts = None
    if before:
        at = media.segment + max(before, key=lambda c: c["time"])["cluster"]
        _, body = read_vint(data, at, len(data), keep_marker=True)
        starts = read_vint(data, body, len(data))[1]
    found = [p for p in media.packets if p.timestamp_ms <= time_ms and (starts is None or p.cluster >= starts)]
    return max(found, key=lambda p: (p.timestamp_ms, p.start), default=None)


def samples(data, media: Media, track: int = 1) -> bytes:
    """The bytes of a track's packets in stored order."""
    view = memoryview(data)
    return b"".join(view[p.start : p.start + p.size] for p in media.packets if p.track == track)


def features(payload: bytes, media: Media) -> str:
    """Packets, blocks' lacing, duration, level and zero crossings of 8-bit samples around 128."""
    x = np.frombuffer(payload, np.uint8)
    mean, crossing = float(x.mean()) if x.size else 0.0, int(np.count_nonzero(np.diff(x >= 128)))
    rms = float(np.sqrt(np.mean((x - 128.0) ** 2))) if x.size else 0.0
    lacing = "+".join(sorted({p.lacing for p in media.packets}))
    return f"packets={len(media.packets)};lacing={lacing};cues={len(media.cues)};ms={media.duration:.1f};mean={mean:.4f};rms={rms:.4f};zc={crossing}"


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 text and that text with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))


PACKETS = pa.schema([("media_id", pa.int64()), ("packet", pa.int32()), ("track", pa.int32()), ("codec", pa.string()), ("timestamp_ms", pa.float64()), ("start", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("cluster_start", pa.int64()), ("cued", pa.bool_()), ("error", pa.string())])


def packet_table(df: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """One row for each packet of each media value. A null value gives no rows; malformed bytes give one row with
    only `error` set. Rows are independent, so repeated rows repeat their packets; other columns are ignored."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not value.is_valid:
                    continue
                try:
                    media = parse(value.as_buffer())
                    cued, seen, rows = {c["cluster"] for c in media.cues}, set(), []
                    heads = {media.segment + c: c for c in cued}
                    for i, p in enumerate(media.packets):
                        first = p.cluster not in seen and any(0 < p.cluster - h <= 12 for h in heads)
                        seen.add(p.cluster)
                        rows.append((key, i, p.track, media.tracks.get(p.track, {}).get("codec"), p.timestamp_ms, p.start, p.size, p.keyframe, p.lacing, p.cluster, first, None))
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(key, *[None] * 10, str(e))]
                for i in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 8192]), PACKETS)], schema=PACKETS)

    return df.selectExpr(f"cast(`{id_col}` as bigint) media_id", f"`{media_col}` media").mapInArrow(run, "media_id long, packet int, track int, codec string, timestamp_ms double, start long, size long, keyframe boolean, lacing string, cluster_start long, cued boolean, error string")


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets int"


def store_as_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store each text as 8-bit Matroska samples, read the payload back through the parser and describe it.

    Every row gives one row. Null and empty texts store 64 zero bytes; equal texts give equal values; rows with a
    null id keep it; extra columns are ignored. with_media adds the stored bytes."""
    bounded_batches(df.sparkSession)
    schema = STORED + (", media binary" if with_media else "")
    names = [c.split()[0] for c in schema.split(",")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()] + [pa.binary()] * with_media

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, payload = padded(text.as_py())
                stored = mux(payload)
                media = parse(stored)
                back = samples(stored, media)
                if back != payload:
                    raise ValueError(f"document {key}: the stored samples differ from the payload")
                rows.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back, media), len(media.packets), *[stored] * with_media))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return df.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, schema)
