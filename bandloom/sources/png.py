"""PNG images from colour columns, with the standard library only.

Tiles and other small pictures are drawn as groups.  Pictures of any size are made of strips:
a strip of rows is deflated by itself and ends on a byte (a full flush), so that strips are
chunks of one stream, whose checksum is combined from theirs.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.sources.ranged import local_path

TILE = 256


#: Rows of a strip, and the modulus of Adler-32 (a fixed value).
STRIP = 64
ADLER = 65521
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def header_chunk(height: int, width: int) -> bytes:
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0))


def combine_adler(first: int, second: int, length: int) -> int:
    """The Adler-32 of two stretches of bytes, the second ``length`` long, from theirs."""
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    a = (a1 + a2 - 1) % ADLER
    b = (b1 + b2 + (a1 - 1) * (length % ADLER)) % ADLER
    return b << 16 | a


def encode_png(rgba: np.ndarray) -> bytes:
    """An (H, W, 4) array of bytes as PNG."""
    h, w, _ = rgba.shape
    return header_chunk(h, w) + chunk(b"IDAT", zlib.compress(_lines(rgba), 6)) + chunk(b"IEND", b"")


def _lines(rgba: np.ndarray) -> bytes:
    """Unfiltered lines: a zero byte before each."""
    h, w, _ = rgba.shape
    lines = np.zeros((h, w * 4 + 1), np.uint8)
    lines[:, 1:] = np.ascontiguousarray(rgba, np.uint8).reshape(h, w * 4)
    return lines.tobytes()


def decode_png(data: bytes) -> np.ndarray:
    """The inverse of ``encode_png`` (filter 0, RGBA)."""
    at, body, shape = 8, b"", (0, 0)
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h = struct.unpack_from(">II", part)
            shape = h, w
        elif kind == b"IDAT":
            body += part
        at += size + 12
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[0], shape[1] * 4 + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:].reshape(*shape, 4)


def empty_png(side: int = TILE) -> bytes:
    return encode_png(np.zeros((side, side, 4), np.uint8))


def images(colours: DataFrame, height: int, width: int, by: list[str] = ()) -> DataFrame:
    """One PNG for each group of (row, col, r, g, b, a); missing pixels are transparent.

    An image is a picture of limited size (a tile or a preview), so a group fits in a task.
    """
    keys = list(by) or ["image"]
    rows = colours if by else colours.withColumn("image", F.lit(0))

    def draw(table: pa.Table) -> pa.Table:
        rgba = np.zeros((height, width, 4), np.uint8)
        at = table.column("row").to_numpy(), table.column("col").to_numpy()
        for k, c in enumerate("rgba"):
            rgba[at[0], at[1], k] = table.column(c).to_numpy()
        return pa.table({**{k: table.column(k)[:1] for k in keys}, "png": pa.array([encode_png(rgba)], pa.binary())})

    rows = rows.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).select(*keys, "row", "col", *"rgba")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys) + ", png binary"
    return rows.groupBy(*keys).applyInArrow(draw, schema)


def strips(colours: DataFrame, height: int, width: int, rows: int = STRIP) -> DataFrame:
    """(strip, data, adler, length): every strip of a picture as an IDAT chunk, the first with the stream's head.

    ``colours`` is (row, col, r, g, b, a); pixels that are missing are transparent, those outside are left out.
    """

    def draw(wanted: pa.Table, table: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return pa.table({"strip": pa.nulls(0, pa.int32()), "data": pa.nulls(0, pa.binary()), "adler": pa.nulls(0, pa.int64()), "length": pa.nulls(0, pa.int64())})
        strip = wanted.column("strip")[0].as_py()
        first = strip * rows
        rgba = np.zeros((min(rows, height - first), width, 4), np.uint8)
        at = table.column("row").to_numpy() - first, table.column("col").to_numpy()
        for k, c in enumerate("rgba"):
            rgba[at[0], at[1], k] = table.column(c).to_numpy()
        lines = _lines(rgba)
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = packer.compress(lines) + packer.flush(zlib.Z_FULL_FLUSH)
        data = chunk(b"IDAT", (b"" if strip else b"\x78\x9c") + data)
        return pa.table({"strip": pa.array([strip], pa.int32()), "data": pa.array([data], pa.binary()), "adler": pa.array([zlib.adler32(lines)], pa.int64()), "length": pa.array([len(lines)], pa.int64())})

    inside = colours.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    keyed = inside.select(F.expr(f"row div {rows}").cast("int").alias("strip"), F.col("row").cast("int"), F.col("col").cast("int"), *"rgba")
    every = colours.sparkSession.range(-(-height // rows)).select(F.col("id").cast("int").alias("strip"))
    return every.groupBy("strip").cogroup(keyed.groupBy("strip")).applyInArrow(draw, "strip int, data binary, adler bigint, length bigint")


def _ending(parts: list[tuple[int, int]]) -> bytes:
    """The last chunks, for (adler, length) of the strips in order: an empty final block, the checksum, the end."""
    adler = 1
    for one, length in parts:
        adler = combine_adler(adler, one, length)
    return chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", adler)) + chunk(b"IEND", b"")


def picture(colours: DataFrame, height: int, width: int, rows: int = STRIP) -> bytes:
    """A picture as bytes; its strips are drawn by tasks, and come to the driver compressed."""
    drawn = sorted(strips(colours, height, width, rows).collect(), key=lambda r: r["strip"])
    return header_chunk(height, width) + b"".join(r["data"] for r in drawn) + _ending([(r["adler"], r["length"]) for r in drawn])


def parts(colours: DataFrame, height: int, width: int, rows: int = STRIP) -> DataFrame:
    """(part, png): a picture of any size in pieces, one file when put together in order; nothing holds it whole.

    Part 0 is the header, the last one the end; the driver sees 16 bytes for each strip.
    """
    from bandloom.storage import materialise

    drawn = materialise(strips(colours, height, width, rows), "png-strips")
    sums = [(r["adler"], r["length"]) for r in drawn.select("strip", "adler", "length").orderBy("strip").toLocalIterator()]
    ends = drawn.sparkSession.createDataFrame([(0, header_chunk(height, width)), (len(sums) + 1, _ending(sums))], "part int, png binary")
    return ends.union(drawn.select(F.col("strip") + 1, "data"))


def write_picture(colours: DataFrame, height: int, width: int, path: str, rows: int = STRIP) -> None:
    """A picture of any size as a file on a mounted file system; the driver sees 16 bytes for each strip."""
    from bandloom.operators.stats import running_sum
    from bandloom.sources.tiled import write_placed
    from bandloom.storage import materialise

    head = header_chunk(height, width)
    drawn = materialise(strips(colours, height, width, rows), "png-strips")
    sums = [(r["adler"], r["length"]) for r in drawn.select("strip", "adler", "length").orderBy("strip").toLocalIterator()]
    sizes = drawn.select("strip", F.length("data").cast("bigint").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0]
    places = running_sum(sizes, "strip", "size", "before").select("strip", (F.col("before") + len(head)).cast("bigint").alias("offset"))
    rows_ = drawn.join(places, "strip").select(F.lit(0).alias("level"), F.col("strip").cast("bigint").alias("index"), "offset", "data")
    end = _ending(sums)
    write_placed(rows_, path, [(0, head), (len(head) + total, end)], [()], 4, len(head) + total + len(end))


def pixels(pictures: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """(keys, row, col, r, g, b, a) of the pictures of a BINARY column."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rgba = decode_png(batch.column(0)[k].as_py())
                row, col = np.divmod(np.arange(rgba.shape[0] * rgba.shape[1]), rgba.shape[1])
                same = pa.array(np.full(len(row), k))
                own = {name: batch.column(j + 1).take(same) for j, name in enumerate(keys)}
                yield pa.record_batch({**own, "row": pa.array(row, pa.int32()), "col": pa.array(col, pa.int32()), **{c: pa.array(rgba[..., j].reshape(-1).astype(np.int32)) for j, c in enumerate("rgba")}})

    rows = pictures.where(F.col(column).isNotNull()).select(column, *keys)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, kinds + "row int, col int, r int, g int, b int, a int")


def file_strips(spark: SparkSession, path: str) -> DataFrame:
    """(strip, data) of a file by ``write_picture``: the driver walks the heads of its chunks, tasks read them."""
    places, at = [], len(SIGNATURE)
    with open(local_path(path), "rb") as file:
        while head := file.read(8) if file.seek(at) else b"":
            size, kind = struct.unpack(">I4s", head)
            if kind == b"IDAT":
                places.append((len(places), at, size + 12))
            at += size + 12

    def run(batches):
        for batch in batches:
            for strip, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(local_path(path), "rb") as file:
                    file.seek(at)
                    yield pa.record_batch({"strip": pa.array([strip], pa.int32()), "data": pa.array([file.read(size)], pa.binary())})

    # the last chunk of data is the ending
    return spark.createDataFrame(places[:-1], "strip int, at bigint, size bigint").mapInArrow(run, "strip int, data binary")


def strip_pixels(drawn: DataFrame, width: int, rows: int = STRIP) -> DataFrame:
    """(row, col, r, g, b, a) of what ``strips`` drew, each strip inflated by itself; no task holds a picture."""

    def run(batches):
        for batch in batches:
            for strip, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = data[8 + (0 if strip else 2) : -4]
                lines = np.frombuffer(zlib.decompressobj(-15).decompress(body), np.uint8).reshape(-1, width * 4 + 1)
                if lines[:, 0].any():
                    raise ValueError("only unfiltered lines are read")
                rgba = lines[:, 1:].reshape(-1, width, 4)
                row, col = np.divmod(np.arange(len(rgba) * width), width)
                yield pa.record_batch({"row": pa.array(row + strip * rows, pa.int32()), "col": pa.array(col, pa.int32()), **{c: pa.array(rgba[..., j].reshape(-1).astype(np.int32)) for j, c in enumerate("rgba")}})

    return drawn.select("strip", "data").mapInArrow(run, "row int, col int, r int, g int, b int, a int")
