"""Matroska files: writing payloads as one track of 8-bit PCM, and reading any file into a table of packets.

The writer makes an EBML header and a segment of seek head, info, track, clusters of simple blocks, and cues at the
end. Blocks carry several frames and take the four kinds of lacing in turn. The reader follows variable-length ids and
sizes (unknown sizes too), block groups as well as simple blocks, and every kind of lacing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.chunked import map_texts

# Fixed values of the format: element ids.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
INFO, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, RATE, CHANNELS, DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACKS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {EBML, SEGMENT, SEEK_HEAD, SEEK, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACKS}
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME, SAMPLE_RATE, FRAME_MS = 192, 8000, 24
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 128


def vint(value: int, width: int = 0) -> bytes:
    """A size: as many bytes as one leading bit tells; a number of only ones is reserved."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(name: int, value: int, width: int = 0) -> bytes:
    return element(name, value.to_bytes(width or max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], kind: int) -> bytes:
    """The part of a block behind its flags."""
    if kind == NO_LACING:
        return frames[0]
    out = [bytes([len(frames) - 1])]
    sizes = [len(f) for f in frames[:-1]]
    if kind == XIPH:
        out += [b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes]
    elif kind == EBML_LACING:
        out.append(vint(sizes[0]))
        for a, b in zip(sizes, sizes[1:]):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << 7 * w - 1)
            out.append(vint(b - a + (1 << 7 * width - 1) - 1, width))
    return b"".join(out + frames)


HEADER = element(EBML, b"".join([
    unsigned(VERSION, 1), unsigned(READ_VERSION, 1), unsigned(MAX_ID, 4), unsigned(MAX_SIZE, 8), element(DOC_TYPE, b"matroska"),
    unsigned(DOC_VERSION, 4), unsigned(DOC_READ_VERSION, 2)]))
TRACK_ENTRY = element(TRACKS, element(TRACK, b"".join([
    unsigned(TRACK_NUMBER, 1), unsigned(TRACK_UID, 1), unsigned(TRACK_TYPE, 2), unsigned(FLAG_LACING, 1),
    element(CODEC, b"A_PCM/INT/LIT"), unsigned(DEFAULT_DURATION, FRAME_MS * 1_000_000),
    element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + unsigned(CHANNELS, 1) + unsigned(DEPTH, 8))])))


def write_file(payload: bytes) -> bytes:
    """One file with the payload as 8-bit samples; its length is a positive multiple of the frame size."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, b"".join([
        unsigned(TIMESTAMP_SCALE, 1_000_000), element(DURATION, struct.pack(">d", len(frames) * FRAME_MS)),
        element(MUXER, b"strataframe"), element(WRITER, b"strataframe")]))
    seek = lambda places: element(SEEK_HEAD, b"".join(
        element(SEEK, element(SEEK_ID, n.to_bytes(4, "big")) + unsigned(SEEK_POSITION, at, 8)) for n, at in places))
    head = len(seek([(INFO, 0), (TRACKS, 0), (CUES, 0)]))
    at, clusters, cues = head + len(info) + len(TRACK_ENTRY), [], []
    per = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for first in range(0, len(frames), per):
        start, parts = first * FRAME_MS, [unsigned(TIMESTAMP, first * FRAME_MS)]
        for i in range(first, min(first + per, len(frames)), FRAMES_PER_BLOCK):
            group = frames[i : i + FRAMES_PER_BLOCK]
            kind = (XIPH, FIXED, EBML_LACING)[i // FRAMES_PER_BLOCK % 3] if len(group) > 1 else NO_LACING
            parts.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", i * FRAME_MS - start, 0x80 | kind << 1) + laced(group, kind)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, start) + element(CUE_TRACKS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        clusters.append(element(CLUSTER, b"".join(parts)))
        at += len(clusters[-1])
    body = [seek([(INFO, head), (TRACKS, head + len(info)), (CUES, at)]), info, TRACK_ENTRY, *clusters, element(CUES, b"".join(cues))]
    return HEADER + element(SEGMENT, b"".join(body))


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int | None, int]:
    """The number at `at` and where it ends; with `keep` the marker bit stays (ids). None: unknown size."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise ValueError("no length marker")
    end = at + width
    value = int.from_bytes(data[at:end], "big")
    if keep:
        return value, end
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), end


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """All elements below as (id, start of the element, start of its body, end), parents before their children."""
    while at < end:
        begin = at
        name, at = read_vint(data, at, keep=True)
        size, at = read_vint(data, at)
        stop = end if size is None else at + size
        if size is None and name == CLUSTER:  # ends where the next element of its level begins
            stop = at
            while stop < end:
                inner, x = read_vint(data, stop, keep=True)
                if inner in TOP:
                    break
                length, x = read_vint(data, x)
                stop = x + length
        if stop > end:
            raise ValueError("an element reaches beyond its parent")
        yield name, begin, at, stop
        if name in PARENTS:
            yield from elements(data, at, stop)
        at = stop


def block_frames(data: bytes, at: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """Track, relative timestamp, key flag and the byte ranges of the frames of a block."""
    track, at = read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == NO_LACING:
        return track, relative, bool(flags & 0x80), [(at, end - at)]
    n = data[at] + 1
    at += 1
    if kind == FIXED:
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for i in range(n - 1):
            if kind == XIPH:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                width = 9 - data[at].bit_length()
                value, at = read_vint(data, at)
                size = value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    if at != end or min(sizes) < 0:
        raise ValueError("a lace does not fill its block")
    return track, relative, bool(flags & 0x80), out


def packets(data: bytes) -> list[tuple[int, int, int, int, bool, bool]]:
    """Rows (track, timestamp in ns, first byte, bytes, key flag, cluster is in the cues) in file order."""
    scale, base, segment, cluster, rows, cued, step = 1_000_000, 0, 0, 0, [], set(), {}
    number = 0
    for name, begin, at, end in elements(data, 0, len(data)):
        if name == SEGMENT:
            segment = at
        elif name == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[at:end], "big")
        elif name == TRACK_NUMBER:
            number = int.from_bytes(data[at:end], "big")
        elif name == DEFAULT_DURATION:
            step[number] = int.from_bytes(data[at:end], "big")
        elif name == CLUSTER:
            cluster = begin
        elif name == TIMESTAMP:
            base = int.from_bytes(data[at:end], "big")
        elif name == CUE_CLUSTER:
            cued.add(segment + int.from_bytes(data[at:end], "big"))
        elif name in (SIMPLE_BLOCK, BLOCK):
            track, relative, key, ranges = block_frames(data, at, end)
            for i, (first, size) in enumerate(ranges):
                rows.append((track, (base + relative) * scale + i * step.get(track, 0), first, size, key, cluster))
    return [(*r[:5], r[5] in cued) for r in rows]


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b" "), len(raw)


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One file per document: `doc_id`, `n_bytes` (UTF-8 bytes of the text), `media`. A null text is an empty one."""

    def make(texts: list) -> dict:
        made = [payload_of(t) for t in texts]
        return {"n_bytes": [n for _, n in made], "media": [write_file(p) for p, _ in made]}

    return map_texts(docs, make, "n_bytes long, media binary", doc_id, text)


def packet_table(media: DataFrame, doc_id: str = "doc_id", column: str = "media") -> DataFrame:
    """The packets of every file: `doc_id, packet, track, timestamp_ns, byte_start, byte_length, key, in_cues`.

    A null or empty file has no packets; a damaged one fails the read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in zip(*(c.to_pylist() for c in b.columns)):
                if not data:
                    continue
                rows = packets(data)
                cols = [pa.array([i] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32())]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
                cols += [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=[
                    "doc_id", "packet", "track", "timestamp_ns", "byte_start", "byte_length", "key", "in_cues"])

    return media.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).alias("media")).mapInArrow(
        run, "doc_id long, packet int, track int, timestamp_ns long, byte_start long, byte_length long, key boolean, in_cues boolean")


def feature_text(samples: np.ndarray, rows: list) -> str:
    """What the samples sound like: duration, level, spread, zero crossings around the middle, energy peaks."""
    x = samples.astype(np.float64) - 128.0
    frames = np.sqrt((x.reshape(-1, FRAME) ** 2).mean(axis=1))
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    end = rows[-1][1] // 1_000_000 + FRAME_MS
    return (f"packets={len(rows)};ms={end};mean={x.mean():.4f};rms={np.sqrt((x ** 2).mean()):.4f};min={int(samples.min())};"
            f"max={int(samples.max())};crossings={crossings};loudest={int(frames.argmax())};peak={frames.max():.4f}")


def media_digests(media: DataFrame) -> DataFrame:
    """Reads every stored file back packet by packet and describes payload and file; takes what `store_media` gives."""

    def one(data: bytes) -> tuple:
        rows = packets(data)
        if not all(r[5] for r in rows):
            raise ValueError("a cluster is not in the cues")
        payload = b"".join(data[r[2] : r[2] + r[3]] for r in rows)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data),
                hashlib.sha256(data).hexdigest(), feature_text(np.frombuffer(payload, np.uint8), rows))

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = zip(*(one(x.as_py()) for x in b.column(2)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, found)], names=["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
             "media_sha256 string, feature string")
