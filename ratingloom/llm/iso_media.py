"""Media columns: ISO base media files (MP4, QuickTime) as binary values.

``probe`` walks the nested boxes of each value and decodes the sample tables of its tracks; it reads
no byte of the media data. ``store`` writes bytes losslessly as a track of unsigned 8-bit samples, and
``payload`` reads them back by the sample tables alone.
"""

from __future__ import annotations

import dataclasses
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import slices

#: Boxes of the ISO base media format that hold boxes and lead to sample tables.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}
#: Bytes of a stored sample, samples of a chunk, and ticks a second.
SAMPLE, CHUNK, RATE = 64, 64, 8000
_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
_TRACK = [("codec", pa.string()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframes", _RANGES)]
PROBE = pa.schema([*_TRACK, ("others", pa.list_(pa.struct(_TRACK))), ("fault", pa.string())])
_TRACK_DDL = "codec string, duration double, n_samples bigint, keyframes array<struct<first: bigint, stop: bigint>>"
PROBE_DDL = f"{_TRACK_DDL}, others array<struct<{_TRACK_DDL.replace(' string', ': string').replace(' double', ': double').replace('n_samples bigint', 'n_samples: bigint').replace('keyframes array', 'keyframes: array')}>>, fault string"


def boxes(data: memoryview, start: int = 0, stop: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, first, stop) of the content of each box between start and stop; ValueError if one leaves them."""
    stop = len(data) if stop is None else stop
    while start < stop:
        if stop - start < 8:
            raise ValueError("box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if stop - start < 16:
                raise ValueError("box header is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = stop - start
        if size < head or start + size > stop:
            raise ValueError(f"box {kind!r} has a wrong size")
        yield kind, start + head, start + size
        start += size


@dataclasses.dataclass
class Track:
    """A track's codec, timing and sample places."""

    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray | None = None
    chunk_starts: np.ndarray | None = None
    runs: np.ndarray | None = None
    times: np.ndarray | None = None
    syncs: np.ndarray | None = None

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, stop) of each sample in the file."""
        sizes, chunks = self.sizes, self.chunk_starts
        n = len(sizes)
        if not n or not len(chunks) or not len(self.runs):
            if n:
                raise ValueError("samples without chunks")
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = self.runs[:, 0].astype(np.int64) - 1
        if first[0] != 0 or (np.diff(first) <= 0).any() or first[-1] >= len(chunks):
            raise ValueError("sample-to-chunk table is out of order")
        each = np.repeat(self.runs[:, 1].astype(np.int64), np.diff(np.append(first, len(chunks))))
        if each.sum() < n:
            raise ValueError("samples without chunks")
        ends = np.cumsum(each)
        of = np.searchsorted(ends, np.arange(n), side="right")
        after = np.cumsum(sizes)
        before = after - sizes
        chunk_first = np.minimum(ends - each, n - 1)[of]
        starts = chunks[of] + before - before[chunk_first]
        return starts, starts + sizes

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges of the sync samples; every sample is one where the track has no table of them."""
        starts, stops = self.places()
        if self.syncs is not None:
            if len(self.syncs) and (self.syncs.min() < 1 or self.syncs.max() > len(starts)):
                raise ValueError("sync sample does not exist")
            starts, stops = starts[self.syncs - 1], stops[self.syncs - 1]
        return list(zip(starts.tolist(), stops.tolist()))


def _rows(data: memoryview, at: int, stop: int, kind: str, width: int, n: int) -> np.ndarray:
    dtype = np.dtype(kind)
    if n * width * dtype.itemsize > stop - at:
        raise ValueError("table is cut off")
    return np.frombuffer(data, dtype, n * width, at).astype(np.int64).reshape(n, width) if width > 1 else np.frombuffer(data, dtype, n, at).astype(np.int64)


def _table(track: Track, kind: bytes, data: memoryview, at: int, stop: int) -> None:
    count = lambda k=4: struct.unpack_from(">I", data, at + k)[0]
    if kind == b"mdhd":
        track.timescale, track.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    elif kind == b"stsd" and count():
        track.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
    elif kind == b"stts":
        track.times = _rows(data, at + 8, stop, ">u4", 2, count())
    elif kind == b"stsc":
        track.runs = _rows(data, at + 8, stop, ">u4", 3, count())
    elif kind == b"stsz":
        size, n = struct.unpack_from(">II", data, at + 4)
        if size * n > len(data):
            raise ValueError("samples do not fit the file")
        track.sizes = np.full(n, size, np.int64) if size else _rows(data, at + 12, stop, ">u4", 1, n)
    elif kind == b"stz2":
        bits, n = data[at + 7], count(8)
        if bits not in (4, 8, 16):
            raise ValueError("compact sizes of unknown width")
        if bits == 4:
            raw = _rows(data, at + 12, stop, ">u1", 1, -(-n // 2))
            track.sizes = np.stack([raw >> 4, raw & 15], axis=1).ravel()[:n]
        else:
            track.sizes = _rows(data, at + 12, stop, f">u{bits // 8}", 1, n)
    elif kind == b"stco":
        track.chunk_starts = _rows(data, at + 8, stop, ">u4", 1, count())
    elif kind == b"co64":
        track.chunk_starts = _rows(data, at + 8, stop, ">u8", 1, count())
    elif kind == b"stss":
        track.syncs = _rows(data, at + 8, stop, ">u4", 1, count())


def tracks(data: memoryview) -> list[Track]:
    """The tracks of a file, by walking its boxes depth first; media data is stepped over.

    ValueError for a file whose samples are in movie fragments: those have no sample tables.
    """
    found: list[Track] = []
    open_: list[tuple[Iterator[tuple[bytes, int, int]], Track | None]] = [(boxes(data), None)]
    while open_:
        level, track = open_[-1]
        box = next(level, None)
        if box is None:
            open_.pop()
            continue
        kind, a, b = box
        if kind in (b"moof", b"mvex"):
            raise ValueError("samples are in movie fragments")
        if kind == b"trak":
            track = Track()
            found.append(track)
        if kind in CONTAINERS:
            open_.append((boxes(data, a, b), track))
        elif track is not None:
            try:
                _table(track, kind, data, a, b)
            except (struct.error, IndexError) as e:
                raise ValueError(f"box {kind!r} is cut off") from e
    return found


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return struct.pack(">I4s", size, kind) + b"".join(parts) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def build(payload: bytes) -> bytes:
    """An ISO media file with the payload (a multiple of SAMPLE bytes) as samples of unsigned 8-bit sound.

    Chunks hold CHUNK samples; the first sample of each chunk is a sync sample.
    """
    n = len(payload) // SAMPLE
    ticks = len(payload)
    n_chunks = -(-n // CHUNK)
    rest = n - (n_chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] if rest == CHUNK else [(1, rest, 1)] if n_chunks == 1 else [(1, CHUNK, 1), (n_chunks, rest, 1)]
    wide = len(payload) > (1 << 32) - (1 << 20)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")

    def moov(first: int) -> bytes:
        sound = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        at = first + np.arange(n_chunks, dtype=np.int64) * (CHUNK * SAMPLE)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), sound),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            _full(b"stss", struct.pack(">I", n_chunks), (np.arange(n_chunks) * CHUNK + 1).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", n_chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            minf,
        )
        tkhd = _full(b"tkhd", struct.pack(">QQIIQQHHHH", 0, 0, 1, 0, ticks, 0, 0, 0, 0x100, 0), _UNITY, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, ticks, 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    mdat = _box(b"mdat", payload)
    return head + moov(len(head) + len(moov(0)) + len(mdat) - len(payload)) + mdat


def payload(data: bytes) -> bytes:
    """The bytes of the first track's samples, in order."""
    view = memoryview(data)
    starts, stops = tracks(view)[0].places()
    if not len(starts):
        return b""
    # neighbouring samples are read together
    cut = np.flatnonzero(starts[1:] != stops[:-1]) + 1
    return b"".join(view[a:b] for a, b in zip(starts[np.append(0, cut)], stops[np.append(cut - 1, len(stops) - 1)]))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, padded with zeros to a positive multiple of SAMPLE, in a media file.

    One row for each row of docs; null is empty; equal texts give equal files. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            media = [build(b + bytes(max(1, -(-len(b) // SAMPLE)) * SAMPLE - len(b))) for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def _described(track: Track, size: int) -> dict:
    """A track's part of PROBE."""
    ticks = int((track.times[:, 0] * track.times[:, 1]).sum()) if track.times is not None else track.duration
    keys = track.keyframes()
    if any(b > size for _, b in keys):
        raise ValueError("samples lie behind the end of the file")
    return {"codec": track.codec, "duration": ticks / track.timescale if track.timescale else None, "n_samples": len(track.sizes), "keyframes": [{"first": a, "stop": b} for a, b in keys]}


def describe(data: bytes | None) -> dict:
    """The columns of PROBE for one file: its first track with sample tables, and all further such ones; fault says what is wrong with it, if anything."""
    out = dict.fromkeys(PROBE.names)
    if data is None:
        return out
    try:
        found = [t for t in tracks(memoryview(data)) if t.sizes is not None and t.chunk_starts is not None and t.runs is not None]
        if not found:
            return out | {"fault": "no track with samples"}
        first, *others = (_described(t, len(data)) for t in found)
        return out | first | {"others": others}
    except ValueError as e:
        return out | {"fault": str(e)}


def probe(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with the columns of PROBE_DDL after its own: codec, duration in seconds, samples, keyframe byte ranges.

    They are of the first track with sample tables; ``others`` has those of all further ones. Null gives
    nulls; what isn't a sound ISO media file, or has its samples in fragments, gives nulls and a fault. Rows
    and other columns stay, but for columns that are named like those of PROBE_DDL (in any case): they are
    replaced, wherever they stood. The media column itself may not be named so.
    """
    names = {n.lower() for n in PROBE.names}
    if media_col.lower() in names:
        raise ValueError(f"the media column may not be called {media_col}")
    kept = [f for f in media.schema.fields if f.name.lower() not in names]
    at = [f.name for f in kept].index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.RecordBatch.from_pylist([describe(x) for x in batch.column(at).to_pylist()], PROBE)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found.columns], names=[*batch.schema.names, *PROBE.names])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return media.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, ddl + PROBE_DDL)


def digests(media: DataFrame) -> DataFrame:
    """For rows of store() and probe(): sizes and digests of the stored file and of the payload that its samples hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            files = batch.column("media").to_pylist()
            held = [payload(x) for x in files]
            sha = lambda values: pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())
            size = lambda values: pa.array(list(map(len, values)), pa.int64())
            features = [
                f"{c};{d:.6f};{n};" + ",".join(f"{k['first']}-{k['stop']}" for k in keys)
                for c, d, n, keys in zip(*(batch.column(x).to_pylist() for x in ("codec", "duration", "n_samples", "keyframes")))
            ]
            cols = [batch.column("doc_id"), batch.column("n_bytes"), size(held), sha(held), pa.array([zlib.crc32(x[-64:]) for x in held], pa.int64()), size(files), sha(files), pa.array(features, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.mapInArrow(run, ddl)
