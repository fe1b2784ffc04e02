"""ISO media containers: boxes are walked and sample tables decoded; payloads stay as they are.

``write_movie`` stores bytes as the 8-bit samples of one track, ``probe`` reads codec,
duration and keyframe byte ranges from the boxes alone, ``read_samples`` returns the
stored bytes by the sample table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bandloom.llm.textarrays import slices, tidy

UNIT = 64
SAMPLE = 4096
CHUNK_SAMPLES = 8
KEY_EVERY = 8
TIMESCALE = 8000
#: Boxes that hold boxes (ISO/IEC 14496-12); fixed values.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"])


def box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    if len(data) + 8 < 1 << 32:
        return struct.pack(">I4s", len(data) + 8, kind) + data
    return struct.pack(">I4sQ", 1, kind, len(data) + 16) + data


def full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_movie(payload: bytes, sample: int = SAMPLE) -> bytes:
    """A movie with one track of raw samples; every eighth is a keyframe."""
    sizes = [min(sample, len(payload) - k) for k in range(0, len(payload), sample)]
    n = len(sizes)
    duration = len(payload)
    deltas = [(n - 1, sizes[0]), (1, sizes[-1])] if sizes[-1] != sizes[0] else [(n, sizes[0])]
    chunks = [sum(sizes[k : k + CHUNK_SAMPLES]) for k in range(0, n, CHUNK_SAMPLES)]
    last = n - (len(chunks) - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES)] if last == CHUNK_SAMPLES else [(1, last)] if len(chunks) == 1 else [(1, CHUNK_SAMPLES), (len(chunks), last)]
    keys = list(range(1, n + 1, KEY_EVERY))
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", UNIT, UNIT), struct.pack(">II", 0x480000, 0x480000), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 8, -1))

    def moov(base: int) -> bytes:
        places, at = [], base
        for c in chunks:
            places.append(at)
            at += c
        wide = at >= 1 << 32
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">I", len(deltas)), *(struct.pack(">II", *d) for d in deltas)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", struct.pack(f">II{n}I", 0, n, *sizes)),
            full(b"co64", struct.pack(f">I{len(places)}Q", len(places), *places)) if wide else full(b"stco", struct.pack(f">I{len(places)}I", len(places), *places)),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1),
            full(b"hdlr", struct.pack(">I4s12s", 0, b"vide", bytes(12)), b"samples\0"),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(16), _MATRIX, struct.pack(">II", UNIT << 16, UNIT << 16), version=1, flags=3), media)
        return box(b"moov", full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1), track)

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    first = len(head) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return head + moov(first) + box(b"mdat", payload)


@dataclass
class Track:
    """What the boxes say of a track.  ``sizes`` holds the samples' sizes, or ``(size, n)`` if all are equal."""

    number: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray | tuple[int, int] = (0, 0)
    deltas: list[tuple[int, int]] = field(default_factory=list)
    runs: list[tuple[int, int, int]] = field(default_factory=list)
    chunks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray | None = None
    length: int = 0  # bytes of the container
    pieces: list[tuple[int, int, int, int, bool, bool]] = field(default_factory=list)  # (offset, size, n, duration, keyframe, keyframes) of n equal samples in fragments: the first, the others

    @property
    def fragments(self) -> list[tuple[int, int, int, bool]]:
        """(offset, size, duration, keyframe) of each sample in fragments."""
        return [(at + k * size, size, duration, others if k else first) for at, size, n, duration, first, others in self.pieces for k in range(n)]

    def samples(self) -> int:
        return (self.sizes[1] if isinstance(self.sizes, tuple) else len(self.sizes)) + sum(p[2] for p in self.pieces)

    def seconds(self) -> float | None:
        total = self.duration or sum(p[2] * p[3] for p in self.pieces)
        return total / self.timescale if self.timescale else None

    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        """(offset, size) of the samples in chunks that lie in the container: chunks by stsc, then sizes in turn."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if isinstance(self.sizes, tuple):
            each, n = self.sizes
            sizes = np.full(min(n, self.length // each) if each else 0, each, np.int64)
        else:
            sizes = self.sizes
        runs = [r for r in self.runs if r[0] >= 1 and r[1] >= 1]
        if not len(sizes) or not runs or not len(self.chunks):
            return none
        first = np.array([r[0] for r in runs]) - 1
        at = np.searchsorted(first, np.arange(len(self.chunks)), "right") - 1
        each_chunk = np.where(at >= 0, np.minimum(np.array([r[1] for r in runs])[at], len(sizes)), 0)
        ends = np.cumsum(each_chunk)
        chunk = np.searchsorted(ends, np.arange(len(sizes)), "right")
        inside = chunk < len(self.chunks)
        sample, chunk = np.flatnonzero(inside), chunk[inside]
        before = np.append(0, np.cumsum(sizes))
        offset = self.chunks[chunk] + before[sample] - before[(ends - each_chunk)[chunk]]
        size = sizes[sample]
        stop = int(np.argmax(np.append((offset < 0) | (offset > self.length - size), True)))
        return offset[:stop], size[:stop]

    def ranges(self) -> list[tuple[int, int]]:
        """(offset, size) of each sample; the first one outside the container ends the list."""
        offset, size = self._places()
        return [*zip(offset.tolist(), size.tolist(), strict=True), *((f[0], f[1]) for f in self.fragments)]

    def keyframe_arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, sizes) of keyframes; where all samples of a table or of a fragment's run are keyframes, of what lies without a gap."""
        offset, size = self._places()
        if self.keys is None:
            new = np.append(True, offset[1:] != (offset + size)[:-1]) if len(offset) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            offset, size = offset[start], np.add.reduceat(size, start) if len(start) else size
        else:
            keys = self.keys[(self.keys >= 1) & (self.keys <= len(offset))] - 1
            offset, size = offset[keys], size[keys]
        more = []
        for at, each, n, _, first, others in self.pieces:
            if first:
                more.append((at, each * n if others else each))
            elif others and n > 1:
                more.append((at + each, each * (n - 1)))
        extra = np.array(more, np.int64).reshape(-1, 2)
        return np.append(offset, extra[:, 0]), np.append(size, extra[:, 1])

    def keyframes(self) -> list[tuple[int, int]]:
        offset, size = self.keyframe_arrays()
        return list(zip(offset.tolist(), size.tolist(), strict=True))


def walk(data: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, start, body start, end) of each box, outer ones first, to any depth.  A broken size ends its level."""
    levels = [(0, len(data))]
    while levels:
        lo, hi = levels.pop()
        if lo + 8 > hi:
            continue
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1:
            if lo + 16 > hi:
                continue
            size, body = struct.unpack_from(">Q", data, body)[0], lo + 16
        elif size == 0:
            size = hi - lo
        if size < body - lo or lo + size > hi:
            continue
        yield kind, lo, body, lo + size
        levels.append((lo + size, hi))
        if kind in CONTAINERS:
            levels.append((body, lo + size))


def _table(data: bytes, at: int, end: int, kind: str, columns: int = 1) -> np.ndarray:
    """The entries of a full box's table as rows, as many as the box has room for."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    width = np.dtype(kind).itemsize * columns
    n = min(n, max(0, end - at - 8) // width)
    return np.frombuffer(data, kind, n * columns, at + 8).astype(np.int64).reshape(n, columns)


def _sample_sizes(data: bytes, kind: bytes, at: int, end: int) -> np.ndarray | tuple[int, int]:
    if kind == b"stsz":
        each, n = struct.unpack_from(">II", data, at + 4)
        return (each, n) if each else np.frombuffer(data, ">u4", min(n, max(0, end - at - 12) // 4), at + 12).astype(np.int64)
    bits, n = struct.unpack_from(">BI", data, at + 7)
    if bits not in (4, 8, 16):
        raise struct.error("stz2")
    raw = np.frombuffer(data, ">u2" if bits == 16 else np.uint8, min(n * bits // 8 + 1, max(0, end - at - 12)) // (2 if bits == 16 else 1), at + 12).astype(np.int64)
    return (np.stack([raw >> 4, raw & 15], 1).reshape(-1) if bits == 4 else raw)[:n]


def _fields(data: bytes, at: int, flags: int, wanted: list[tuple[int, str]]) -> tuple[list[int | None], int]:
    """The optional fields of a full box whose flag is set, in their order; and where they end."""
    out: list[int | None] = []
    for bit, kind in wanted:
        if flags & bit:
            out.append(struct.unpack_from(kind, data, at)[0])
            at += struct.calcsize(kind)
        else:
            out.append(None)
    return out, at


class _Fragment:
    """State of a moof: where its runs of samples lie."""

    def __init__(self, start: int, room: int):
        self.start, self.track, self.next, self.defaults = start, None, start, (0, 0, 0)
        self.room = room  # bytes that runs without entries may still take

    def header(self, data: bytes, at: int, tracks: dict[int, Track], extends: dict[int, tuple[int, int, int]]) -> None:
        flags = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF
        number = struct.unpack_from(">I", data, at + 4)[0]
        (base, _, duration, size, mark), _ = _fields(data, at + 8, flags, [(1, ">Q"), (2, ">I"), (8, ">I"), (0x10, ">I"), (0x20, ">I")])
        known = extends.get(number, (0, 0, 0))
        self.track, self.base = tracks.get(number), self.start if base is None else base
        self.next = self.base
        self.defaults = tuple(k if x is None else x for x, k in zip((duration, size, mark), known, strict=True))

    def run(self, data: bytes, at: int, end: int) -> None:
        flags = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF
        n = struct.unpack_from(">I", data, at + 4)[0]
        (offset, first), at = _fields(data, at + 8, flags, [(1, ">i"), (4, ">I")])
        if self.track is None:
            return
        place = self.next if offset is None else self.base + offset
        duration, size, mark = self.defaults
        each = [(0x100, ">I"), (0x200, ">I"), (0x400, ">I"), (0x800, ">I")]
        width = 4 * sum(bool(flags & bit) for bit, _ in each)
        if not width:  # equal samples, kept as one piece; those of a container's runs take no more bytes than it has
            n = min(n, self.room // size, max(0, self.track.length - place) // size) if size and place >= 0 else 0
            if n:
                key = not (mark if first is None else first) & 0x10000
                self.track.pieces.append((place, size, n, duration, key, not mark & 0x10000))
                self.room -= n * size
            self.next = place + n * size
            return
        for k in range(min(n, max(0, end - at) // width)):
            (d, s, m, _), at = _fields(data, at, flags, each)
            d, s, m = duration if d is None else d, size if s is None else s, m if m is not None else first if first is not None and not k else mark
            if place < 0 or place + s > self.track.length:
                break
            self.track.pieces.append((place, s, 1, d, not m & 0x10000, False))
            place += s
        self.next = place


def probe(data: bytes) -> list[Track]:
    """The tracks of a container; [] for anything that is not one.

    Fragments (moof) add their samples to the tracks; runs of equal samples stay one piece, and all of
    a container together take no more bytes than it has, so that the work follows its size.  Tables that
    say more than their box holds are read as far as it goes; a box too short for its fixed fields makes
    the whole unreadable.
    """
    tracks: list[Track] = []
    by_number: dict[int, Track] = {}
    extends: dict[int, tuple[int, int, int]] = {}
    fragment = None
    try:
        for kind, start, at, end in walk(data):
            if kind == b"trak":
                tracks.append(Track(length=len(data)))
            elif kind == b"trex":
                number, _, *rest = struct.unpack_from(">IIIII", data, at + 4)
                extends[number] = tuple(rest)
            elif kind == b"moof":
                fragment, by_number = _Fragment(start, fragment.room if fragment else len(data)), {t.number: t for t in tracks}
            elif kind == b"tfhd" and fragment:
                fragment.header(data, at, by_number, extends)
            elif kind == b"trun" and fragment:
                fragment.run(data, at, end)
            t = tracks[-1] if tracks else None
            if t is None or fragment:
                continue
            if kind == b"tkhd":
                t.number = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
            elif kind == b"mdhd":
                t.timescale, t.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
            elif kind == b"hdlr":
                t.handler = struct.unpack_from(">4s", data, at + 8)[0].decode("latin-1")
            elif kind == b"stsd":
                t.codec = data[at + 12 : at + 16].decode("latin-1")
            elif kind == b"stts":
                t.deltas = [tuple(r) for r in _table(data, at, end, ">u4", 2).tolist()]
            elif kind == b"stss":
                t.keys = _table(data, at, end, ">u4")[:, 0]
            elif kind == b"stsc":
                t.runs = [tuple(r) for r in _table(data, at, end, ">u4", 3).tolist()]
            elif kind in (b"stsz", b"stz2"):
                t.sizes = _sample_sizes(data, kind, at, end)
            elif kind == b"stco":
                t.chunks = _table(data, at, end, ">u4")[:, 0]
            elif kind == b"co64":
                t.chunks = _table(data, at, end, ">u8")[:, 0]
    except (struct.error, IndexError, ValueError):
        return []
    return tracks


def read_samples(data: bytes, track: Track) -> bytes:
    return b"".join(data[a : a + n] for a, n in track.ranges())


_MEDIA = "array<struct<handler:string,codec:string,seconds:double,samples:bigint,keyframes:array<struct<offset:bigint,size:bigint>>>>"


def _media_array(contents: pa.Array) -> pa.Array:
    """The tracks of each container as an Arrow column, keyframes from numpy arrays."""
    tracks, ends = [], [0]
    for data in contents:
        tracks += probe(data.as_py() or b"")
        ends.append(len(tracks))
    keys = [t.keyframe_arrays() for t in tracks]
    bounds = np.append(0, np.cumsum([len(k[0]) for k in keys], dtype=np.int64))
    offset, size = (pa.array(np.concatenate([np.zeros(0, np.int64), *(k[j] for k in keys)]), pa.int64()) for j in (0, 1))
    places = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([offset, size], ["offset", "size"]))
    columns = [pa.array([t.handler for t in tracks], pa.string()), pa.array([t.codec for t in tracks], pa.string()), pa.array([t.seconds() for t in tracks], pa.float64()), pa.array([t.samples() for t in tracks], pa.int64()), places]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["handler", "codec", "seconds", "samples", "keyframes"]))


def media_columns(df: DataFrame, content: str) -> DataFrame:
    """Adds ``media``: the tracks of a BINARY column, read from boxes without decoding payloads.

    Null, empty and foreign bytes give an empty array.  Rows and other columns stay as they
    are; a column of the name media is replaced.  A malformed container never fails: it gives
    what its boxes still say, or an empty array; memory and work are in proportion to its bytes.
    """
    from pyspark.sql import types as T

    names = [c for c in df.columns if c != "media"]
    rows = df.select(*names, df[content].cast("binary").alias("_content"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("media", T._parse_datatype_string(_MEDIA))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_content"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _media_array(part.column(part.num_columns - 1))], [*names, "media"])

    return rows.mapInArrow(tidy(run), schema)


def store_texts(df: DataFrame) -> DataFrame:
    """One row for each document: digests of its text stored in a container and read back.

    Null text: stored as 64 zero bytes, like the empty one.  Null doc_id stays null; repeated
    rows and equal texts give equal values; an empty table gives no rows; columns other than
    doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    movie = write_movie(pad(raw))
                    (track,) = probe(movie)
                    back = read_samples(movie, track)
                    keys = track.keyframes()
                    feature = f"codec={track.codec.strip()};seconds={track.seconds():.6f};samples={track.samples()};keyframes=" + ",".join(f"{a}+{n}" for a, n in keys)
                    rows.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(movie), hashlib.sha256(movie).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return df.select(df["doc_id"].cast("bigint").alias("doc_id"), df["text"].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
