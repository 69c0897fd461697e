"""Media columns as ISO base media containers.

`pack` stores a payload losslessly as 8-bit samples of a container: file type box, media data, and a movie box with the sample
tables (times, sizes, chunks, chunk offsets, sync samples). `probe` walks the nested boxes of any such container, decodes the
sample tables and gives codec, duration and the byte ranges of the keyframes of every track without touching the payload. `unpack`
reads the samples of the first track back through the tables.

Results: a null payload is stored as an empty one. `tracks` has all tracks in order; the columns beside it are the first one's. A null
container, or one that is cut, fragmented (its samples lie in movie fragments, which aren't decoded) or not made of boxes, gives null features and a text in `error`; `unpack` then gives null. Clashing column names are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import append_columns

#: Bytes of a sample, its ticks (an 8-bit tone sample each), ticks of a second, samples from one keyframe to the next, of a chunk.
SAMPLE_BYTES, TIMESCALE, KEYFRAME_EVERY, CHUNK_SAMPLES = 576, 8000, 12, 30
#: Fixed values of the container format: boxes that hold boxes, and the bytes before their children.
PARENTS = {
    b"moov": 0, b"trak": 0, b"edts": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"mvex": 0, b"moof": 0, b"traf": 0,
    b"udta": 0, b"stsd": 8, b"dref": 8, b"meta": 4,
}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class Broken(ValueError):
    """Not a container, or a cut one."""


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    """A box with version 0 and flags."""
    return box(kind, struct.pack(">I", flags), *parts)


def table(kind: bytes, rows: list[tuple[int, ...]]) -> bytes:
    return full(kind, 0, struct.pack(">I", len(rows)), np.array(rows, ">u4").tobytes())


def pack_payload(payload: bytes) -> bytes:
    """The container of a payload whose length is a positive multiple of SAMPLE_BYTES."""
    n, odd = divmod(len(payload), SAMPLE_BYTES)
    if odd or not n:
        raise ValueError(f"{len(payload)} bytes aren't a positive multiple of {SAMPLE_BYTES}")
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    first = len(head) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    ticks, step = n * SAMPLE_BYTES, CHUNK_SAMPLES * SAMPLE_BYTES
    chunks, rest = divmod(n, CHUNK_SAMPLES)
    runs = [(1, CHUNK_SAMPLES, 1)] * bool(chunks) + [(chunks + 1, rest, 1)] * bool(rest)
    offsets = first + step * np.arange(chunks + bool(rest), dtype=np.int64)
    wide = bool(offsets[-1] >> 32)
    places = full(b"co64" if wide else b"stco", 0, struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes())
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    samples = box(
        b"stbl",
        full(b"stsd", 0, struct.pack(">I", 1), entry),
        table(b"stts", [(n, SAMPLE_BYTES)]),
        table(b"stss", [(i + 1,) for i in range(0, n, KEYFRAME_EVERY)]),
        table(b"stsc", runs),
        full(b"stsz", 0, struct.pack(">II", SAMPLE_BYTES, n)),
        places,
    )
    info = box(b"minf", full(b"smhd", 0, bytes(4)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))), samples)
    media = box(
        b"mdia",
        full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)),
        full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"soun"), b"payload\0"),
        info,
    )
    track = box(b"trak", full(b"tkhd", 3, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), MATRIX, bytes(8)), media)
    movie = full(b"mvhd", 0, struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
    return head + box(b"mdat", payload) + box(b"moov", movie, track)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the content of each box in a range; sizes 0 (to the end) and 1 (64 bits follow) included."""
    at = start
    while at < end:
        if end - at < 8:
            raise Broken(f"{end - at} bytes after the last box")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise Broken("a cut box head")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Broken(f"box {kind!r} of {size} bytes where {end - at} are left")
        yield kind, at + head, at + size
        at += size


@dataclass
class Track:
    """A track's tables as they are decoded."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    ticks: int = 0
    times: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    runs: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    chunks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray | None = None

    def offsets(self) -> np.ndarray:
        """The place of every sample: chunks by their runs, then the sizes before it in its chunk."""
        n, chunks = len(self.sizes), len(self.chunks)
        if not n:
            return np.zeros(0, np.int64)
        if not len(self.runs) or self.runs[0, 0] != 1:
            raise Broken("samples without chunks")
        first = self.runs[:, 0] - 1
        spans = np.diff(np.append(first, chunks))
        if (spans < 0).any() or (self.runs[:, 1] < 0).any():
            raise Broken("chunk runs out of order")
        each = np.repeat(self.runs[:, 1], spans)
        if int(each.sum()) < n:
            raise Broken(f"{n} samples in chunks for {int(each.sum())}")
        of = np.repeat(np.arange(len(each)), each)[:n]
        before = np.cumsum(self.sizes) - self.sizes
        start = np.searchsorted(of, np.arange(len(each)))
        return self.chunks[of] + before - before[np.minimum(start, n - 1)][of]


def numbers(data: memoryview, start: int, end: int, head: int, width: int, kind: str = ">u4") -> np.ndarray:
    """The rows of a counted table whose count stands at `head`."""
    if start + head + 4 > end:
        raise Broken("a cut table")
    n = struct.unpack_from(">I", data, start + head)[0]
    size = np.dtype(kind).itemsize
    if start + head + 4 + n * width * size > end:
        raise Broken(f"a table of {n} rows is cut")
    return np.frombuffer(data, kind, n * width, start + head + 4).astype(np.int64).reshape(n, width)


def walk(data: memoryview, start: int, end: int, tracks: list[Track], path: tuple[bytes, ...] = ()) -> None:
    for kind, at, stop in boxes(data, start, end):
        if kind in (b"moof", b"mvex"):
            raise Broken("fragmented")
        if kind == b"trak":
            tracks.append(Track())
        track = tracks[-1] if tracks else Track()
        need = {b"mdhd": 24, b"hdlr": 12, b"stsz": 12, b"stz2": 12}.get(kind, 0)
        if stop - at < need or kind == b"mdhd" and data[at] and stop - at < 36:
            raise Broken(f"a cut box {kind!r}")
        if path and path[-1] == b"stsd" and not track.codec:
            track.codec = kind.decode("latin-1")
        elif kind == b"mdhd":
            track.timescale, track.ticks = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        elif kind == b"hdlr" and path[-1:] == (b"mdia",):
            track.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stts":
            track.times = numbers(data, at, stop, 4, 2)
        elif kind == b"stss":
            track.sync = numbers(data, at, stop, 4, 1)[:, 0] - 1
        elif kind == b"stsc":
            track.runs = numbers(data, at, stop, 4, 3)
        elif kind == b"stco":
            track.chunks = numbers(data, at, stop, 4, 1)[:, 0]
        elif kind == b"co64":
            track.chunks = numbers(data, at, stop, 4, 1, ">u8")[:, 0]
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, at + 4)
            if same and n > len(data):
                raise Broken(f"{n} samples in {len(data)} bytes")
            track.sizes = np.full(n, same, np.int64) if same else numbers(data, at, stop, 8, 1)[:, 0]
        elif kind == b"stz2":
            bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
            raw = np.frombuffer(data[at + 12 : stop], np.uint8)
            if bits == 4:
                raw = np.stack([raw >> 4, raw & 15], 1).ravel()
            elif bits == 16:
                raw = raw[: len(raw) // 2 * 2].view(">u2")
            if len(raw) < n:
                raise Broken("a cut table of sizes")
            track.sizes = raw[:n].astype(np.int64)
        if kind in PARENTS and at + PARENTS[kind] <= stop:
            walk(data, at + PARENTS[kind], stop, tracks, (*path, kind))


def tracks_of(container: bytes) -> list[Track]:
    found: list[Track] = []
    walk(memoryview(container), 0, len(container), found)
    if not found:
        raise Broken("no track")
    return found


def described(track: Track, size: int) -> dict:
    """A track's features, in a container of `size` bytes."""
    where = track.offsets()
    sync = np.arange(len(where)) if track.sync is None else track.sync
    if len(sync) and not 0 <= sync.min() <= sync.max() < len(where):
        raise Broken("a keyframe past the samples")
    length = track.sizes[sync]
    if len(sync) and int((where[sync] + length).max()) > size:
        raise Broken("a keyframe past the end")
    ticks = int((track.times[:, 0] * track.times[:, 1]).sum()) or track.ticks
    return {
        "codec": track.codec, "handler": track.handler, "timescale": track.timescale, "duration": ticks / track.timescale if track.timescale else None,
        "n_samples": len(where), "keyframes": [{"offset": a, "length": b} for a, b in zip(where[sync].tolist(), length.tolist(), strict=True)],
    }


def features(container: bytes | None) -> dict:
    """Codec, handler, timescale, duration in seconds, samples and keyframe ranges of the first track, and `tracks` with those of each."""
    none = dict.fromkeys(("codec", "handler", "timescale", "duration", "n_samples", "keyframes", "tracks"))
    if container is None:
        return none | {"error": "null"}
    try:
        tracks = [described(t, len(container)) for t in tracks_of(container)]
        return {**tracks[0], "tracks": tracks, "error": None}
    except (Broken, struct.error, ValueError, OverflowError, RecursionError) as e:
        return none | {"error": str(e)}


def read_payload(container: bytes | None) -> bytes | None:
    """The samples of the first track, in order, through its tables."""
    try:
        track = tracks_of(container or b"")[0]
        where, data = track.offsets(), memoryview(container or b"")
        ends = where + track.sizes
        if len(ends) and int(ends.max()) > len(data):
            return None
        cuts = np.flatnonzero(where[1:] != ends[:-1]) + 1  # neighbours are read at once
        starts, stops = where[np.append(0, cuts)[: len(where)]], ends[np.append(cuts - 1, len(ends) - 1)[: len(where)]]
        return b"".join(data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))
    except (Broken, struct.error, ValueError, OverflowError, RecursionError):
        return None


def padded(data: bytes) -> bytes:
    """`data` with bytes 255 up to a positive multiple of SAMPLE_BYTES."""
    return data + b"\xff" * (-len(data) % SAMPLE_BYTES if data else SAMPLE_BYTES)


def pack(df: DataFrame, content: str, media: str = "media", drop: bool = False) -> DataFrame:
    """`df` with the container of each `content` (string or binary, padded) in column `media`; `drop` leaves `content` out."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        values = part.column(content).cast(pa.binary()).to_pylist()
        return [pa.array([pack_payload(padded(x or b"")) for x in values], pa.binary())]

    return append_columns(df, f"`{media}` binary", compute, (content,) if drop else ())


#: What `probe` tells of a track, and its columns.
TRACK = {
    "codec": ("string", pa.string()), "handler": ("string", pa.string()), "timescale": ("long", pa.int64()), "duration": ("double", pa.float64()), "n_samples": ("long", pa.int64()),
    "keyframes": ("array<struct<offset:long,length:long>>", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))),
}
COLUMNS = TRACK | {
    "tracks": (f"array<struct<{','.join(f'{n}:{k}' for n, (k, _) in TRACK.items())}>>", pa.list_(pa.struct([(n, k) for n, (_, k) in TRACK.items()]))),
    "error": ("string", pa.string()),
}
FEATURES = ", ".join(f"{n} {k}" for n, (k, _) in COLUMNS.items())


def probe(df: DataFrame, media: str = "media") -> DataFrame:
    """`df` with the features of each container."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        found = [features(x) for x in part.column(media).to_pylist()]
        return [pa.array([f[n] for f in found], k) for n, (_, k) in COLUMNS.items()]

    return append_columns(df, FEATURES, compute)


def unpack(df: DataFrame, media: str = "media", payload: str = "payload") -> DataFrame:
    """`df` with the payload of each container, read back through its sample tables."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([read_payload(x) for x in part.column(media).to_pylist()], pa.binary())]

    return append_columns(df, f"`{payload}` binary", compute)
