"""Media columns in Matroska: writing, parsing to packet tables, reading back.

A payload of 8-bit samples is written as an audio track of uncompressed PCM:
frames of `FRAME` samples, several of them laced into a block, blocks in
clusters, and cues that point at the clusters.  The file has no date and no
random identifier, so equal payloads make equal files.

The parser walks variable-length EBML elements (ids, sizes, unknown sizes) with a
stack of its own, clusters with simple blocks and block groups, all four kinds of
lacing, cues, and tracks whose headers are stripped or whose packets are zlib-packed.
A packet is known by track, timestamp, byte range, cluster and place in its lace.

Defined results: a null or empty text makes one frame of padding; very long texts
and files are handled whole, each by itself; bytes that are no Matroska file, that
end early, that have numbers beyond 64 bits, or packets that can't be unpacked give
the packets before the damage and an `error`; a null file has no packets and
an error; repeated rows and texts give equal files, so there are no ties; an empty
table gives an empty one; other columns are kept, and a column named as an output is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytetext import blocks, text_bytes
from .tables import map_batches

FRAME = 576
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE
FRAMES_IN_BLOCK = 8
BLOCKS_IN_CLUSTER = 50  # a block's time is 16 bits of milliseconds after its cluster's
SCALE_NS = 1_000_000
OUT_BYTES = 8 << 20

# Element ids of the format (fixed values).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
ENCODINGS, ENCODING, ENCODING_TYPE, COMPRESSION, ALGORITHM, SETTINGS = 0x6D80, 0x6240, 0x5033, 0x5034, 0x4254, 0x4255
ZLIB, STRIPPED = 0, 3
_MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, EBML, ENCODINGS, ENCODING, COMPRESSION}
_SHARED = {AUDIO, CUE_POSITIONS, ENCODINGS, ENCODING, COMPRESSION}  # their values are kept with those of what they are in
#: What ends an element of unknown size.
_ENDS = {CLUSTER: {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML}, SEGMENT: {SEGMENT, EBML}}
_LONG = 1 << 63

LACINGS = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}


def vint(value: int, width: int = 0) -> bytes:
    """A size: `width` bytes, or as few as hold it (all ones are kept for unknown)."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(code: int, body: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(code: int, value: int) -> bytes:
    return element(code, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> bytes:
    """The frames of a block, after its flags."""
    body = b"".join(frames)
    if kind == "none":
        return body
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == "ebml" and len(frames) > 1:
        head += vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(n - before) < (1 << 7 * w - 1) - 1)
            head += vint(n - before + (1 << 7 * width - 1) - 1, width)
    return head + body


def write(payload: bytes, lacing: str = "fixed") -> bytes:
    """A Matroska file of a payload whose length is a multiple of FRAME."""
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    n = len(payload) // FRAME
    audio = element(AUDIO, element(SAMPLING, np.array([RATE], ">f8").tobytes()) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(DEFAULT_DURATION, FRAME_MS * SCALE_NS) + element(CODEC, b"A_PCM/INT/LIT") + audio
    info = number(TIMESTAMP_SCALE, SCALE_NS) + element(MUXING_APP, b"evidora") + element(WRITING_APP, b"evidora") + element(DURATION, np.array([n * FRAME_MS], ">f8").tobytes())
    parts = [element(INFO, info), element(TRACKS, element(TRACK, track))]
    at, cues = sum(map(len, parts)), []
    per_block = 1 if lacing == "none" else FRAMES_IN_BLOCK
    for first in range(0, n, per_block * BLOCKS_IN_CLUSTER):
        body = [number(CLUSTER_TIME, first * FRAME_MS)]
        for k in range(first, min(n, first + per_block * BLOCKS_IN_CLUSTER), per_block):
            frames = [payload[f * FRAME : (f + 1) * FRAME] for f in range(k, min(n, k + per_block))]
            kind = lacing if len(frames) > 1 else "none"
            flags = 0x80 | LACINGS[kind] << 1
            body.append(element(SIMPLE_BLOCK, b"\x81" + ((k - first) * FRAME_MS).to_bytes(2, "big") + bytes([flags]) + lace(frames, kind)))
        parts.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * FRAME_MS) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def read_id(raw: bytes, at: int) -> tuple[int, int]:
    if at >= len(raw) or not raw[at]:
        raise ValueError("no element id")
    width = 9 - raw[at].bit_length()
    if width > 4 or at + width > len(raw):
        raise ValueError("no element id")
    return int.from_bytes(raw[at : at + width], "big"), at + width


def read_size(raw: bytes, at: int) -> tuple[int | None, int, int]:
    """(size or None if unknown, next place, width)"""
    if at >= len(raw) or not raw[at]:
        raise ValueError("no element size")
    width = 9 - raw[at].bit_length()
    if at + width > len(raw):
        raise ValueError("no element size")
    mask = (1 << 7 * width) - 1
    value = int.from_bytes(raw[at : at + width], "big") & mask
    return (None if value == mask else value), at + width, width


def unlace(raw: bytes, at: int, end: int, kind: int) -> list[int]:
    """Sizes of the frames of a block, with the place where the first one begins before them."""
    if kind == 0:
        return [at, end - at]
    if at >= end:
        raise ValueError("lace ends early")
    n = raw[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise ValueError("lace of unequal frames")
        return [at, *[(end - at) // n] * n]
    for k in range(n - 1):
        if kind == 1:
            size = 0
            while True:
                if at >= end:
                    raise ValueError("lace ends early")
                size += raw[at]
                at += 1
                if raw[at - 1] != 255:
                    break
        else:
            value, at, width = read_size(raw, at)
            value = (1 << 7 * width) - 1 if value is None else value
            size = value if k == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("lace ends early")
    return [at, *sizes, last]


class Parsed:
    """Packets (columns of equal length), cues and tracks of a file; error is None if it was whole."""

    def __init__(self, raw: bytes | None):
        self.track: list[int] = []
        self.time: list[int] = []
        self.offset: list[int] = []
        self.size: list[int] = []
        self.cluster: list[int] = []
        self.in_lace: list[int] = []
        self.cues: list[tuple[int, int, int]] = []
        self.tracks: dict[int, dict[int, int | bytes]] = {}
        self.scale, self.error, self.clusters = SCALE_NS, None, 0
        self._cluster_time = 0
        try:
            if raw is None:
                raise ValueError("no file")
            code, _ = read_id(raw, 0)
            if code != EBML:
                raise ValueError("no EBML header")
            self._walk(raw)
        except ValueError as e:
            self.error = str(e)

    def _walk(self, raw: bytes) -> None:
        """Elements in order; the open ones are on a stack of (id, end, known size, cut, values)."""
        at, stack = 0, [(0, len(raw), True, False, {})]
        while stack:
            inside, end, known, cut, values = stack[-1]
            code, body = read_id(raw, at) if at < end else (0, at)
            if at >= end or (not known and code in _ENDS.get(inside, ())):
                stack.pop()
                self._close(inside, values)
                if cut:
                    raise ValueError("element ends early")
                at = max(at, end) if known else at
                continue
            size, body, _ = read_size(raw, body)
            stop = end if size is None else body + size
            cut, stop = stop > end, min(stop, end)
            if code in _MASTERS:
                if code == CLUSTER:
                    self.clusters += 1
                    self._cluster_time = 0
                elif code == COMPRESSION:
                    values.setdefault(ALGORITHM, ZLIB)
                stack.append((code, stop, size is not None, cut, values if code in _SHARED else {}))
                at = body
                continue
            if cut:
                raise ValueError("element ends early")
            self._value(raw, code, body, stop, values)
            at = stop

    def _close(self, code: int, values: dict[int, int | bytes]) -> None:
        if code == TRACK and TRACK_NUMBER in values:
            self.tracks[int(values[TRACK_NUMBER])] = values
        elif code == CUE_POINT:
            cue = tuple(int(values.get(k, 0)) for k in (CUE_TIME, CUE_TRACK, CUE_CLUSTER))
            if max(cue) >= _LONG:
                raise ValueError("cue out of range")
            self.cues.append(cue)

    def _value(self, raw: bytes, code: int, at: int, end: int, values: dict[int, int | bytes]) -> None:
        if code in (SIMPLE_BLOCK, BLOCK):
            self._block(raw, at, end)
        elif code in (CODEC, SETTINGS):
            values[code] = raw[at:end]
        elif end - at <= 8:
            values[code] = int.from_bytes(raw[at:end], "big")
            if code == CLUSTER_TIME:
                self._cluster_time = values[code]
            elif code == TIMESTAMP_SCALE:
                self.scale = values[code]

    def _block(self, raw: bytes, at: int, end: int) -> None:
        track, at, _ = read_size(raw, at)
        if at + 3 > end:
            raise ValueError("block ends early")
        time = int.from_bytes(raw[at : at + 2], "big", signed=True) + self._cluster_time
        place, *sizes = unlace(raw, at + 3, end, raw[at + 2] >> 1 & 3)
        step = int(self.tracks.get(track, {}).get(DEFAULT_DURATION, 0))
        times = [time * self.scale + k * step for k in range(len(sizes))]
        if min(times) < -_LONG or max(times) >= _LONG:
            raise ValueError("timestamp out of range")
        for k, size in enumerate(sizes):
            self.track.append(track or 0)
            self.time.append(times[k])
            self.offset.append(place)
            self.size.append(size)
            self.cluster.append(self.clusters - 1)
            self.in_lace.append(k)
            place += size

    def payload(self, raw: bytes, most_unpacked: int | None = None) -> bytes:
        """The packets' bytes, unpacked as their tracks say; up to the first that can't be, or is larger than `most_unpacked`, with an error."""
        out = []
        for track, at, n in zip(self.track, self.offset, self.size):
            about, packet = self.tracks.get(track, {}), raw[at : at + n]
            try:
                if about.get(ENCODING_TYPE, 0):
                    raise ValueError("encrypted track")
                if about.get(ALGORITHM) == STRIPPED:
                    packet = bytes(about.get(SETTINGS, b"")) + packet
                elif about.get(ALGORITHM) == ZLIB:
                    unpack = zlib.decompressobj()
                    packet = unpack.decompress(packet, most_unpacked or 0)
                    if not unpack.eof:
                        raise ValueError("packet ends early or is too large")
                elif ALGORITHM in about:
                    raise ValueError("unknown compression")
            except (ValueError, zlib.error) as e:
                self.error = self.error or str(e)
                break
            out.append(packet)
        return b"".join(out)


def padded(text: bytes) -> bytes:
    n = max(1, -(-len(text) // FRAME)) * FRAME
    return text.ljust(n, b"\xff")


def features(parsed: Parsed, payload: bytes) -> str:
    """What the packets and the samples are like, in integers only."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    signed = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((signed[1:] < 0) != (signed[:-1] < 0)))
    end = max((t for t in parsed.time), default=0)
    return f"packets={len(parsed.size)};clusters={parsed.clusters};cues={len(parsed.cues)};last_ns={end};sum={int(signed.sum())};energy={int((signed * signed).sum())};crossings={crossings};peak={int(np.abs(signed).max(initial=0))}"


def store_texts(df: DataFrame, *, text: str = "text", media: str = "media", lacing: str = "fixed") -> DataFrame:
    """Add each whole text's padded UTF-8 bytes as a Matroska file."""
    df = df.drop(media)
    names = df.columns
    position = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(position))
            for a, b in blocks(offsets, OUT_BYTES):
                files = [write(padded(data[offsets[i] : offsets[i + 1]].tobytes()), lacing) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(files, pa.binary())], names=[*names, media])

    return map_batches(df, run, T.StructType([*df.schema.fields, T.StructField(media, T.BinaryType())]))


_PACKET = [("track", "long"), ("timestamp_ns", "long"), ("offset", "long"), ("size", "long"), ("cluster", "long"), ("in_lace", "long")]
_CUE = [("time", "long"), ("track", "long"), ("cluster_at", "long")]


def _structs(fields: list[tuple[str, str]]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n, _ in fields]))


def _lists(fields: list[tuple[str, str]], columns: list[list[list[int]]]) -> pa.Array:
    """A list column of structs from, for each field, a list for each row."""
    offsets = np.append(0, np.cumsum([len(x) for x in columns[0]])).astype(np.int32)
    flat = [pa.array(np.array([v for row in c for v in row], dtype=np.int64)) for c in columns]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(flat, names=[n for n, _ in fields]))


def read_media(df: DataFrame, *, media: str = "media", packets: str = "packets", cues: str = "cues", payload: str = "payload", feature: str = "feature", error: str = "error", most_unpacked: int | None = None) -> DataFrame:
    """Add the packet table, the cues, the payload read back by byte ranges, features of it, and what was wrong.

    Packed packets are unpacked whole, whatever their size; for files of unknown origin `most_unpacked` bounds a packet's bytes, and a larger one is an error.
    """
    outs = [packets, cues, payload, feature, error]
    df = df.drop(*outs)
    names = df.columns
    position = names.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(position))
            for a, b in blocks(offsets, OUT_BYTES):
                part = batch.slice(a, b - a)
                files = part.column(position).to_pylist()
                read = [Parsed(f) for f in files]
                back = [p.payload(f, most_unpacked) if f is not None else b"" for p, f in zip(read, files)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        _lists(_PACKET, [[getattr(p, k) for p in read] for k in ("track", "time", "offset", "size", "cluster", "in_lace")]),
                        _lists(_CUE, [[[c[k] for c in p.cues] for p in read] for k in range(3)]),
                        pa.array(back, pa.binary()),
                        pa.array([features(p, x) for p, x in zip(read, back)], pa.string()),
                        pa.array([p.error for p in read], pa.string()),
                    ],
                    names=[*names, *outs],
                )

    types = [_structs(_PACKET), _structs(_CUE), T.BinaryType(), T.StringType(), T.StringType()]
    return map_batches(df, run, T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in zip(outs, types))]))
