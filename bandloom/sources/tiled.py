"""A tiled GeoTIFF with overviews, written by many tasks into one file.

1. Pixels meet once, by tile.  A task compresses the planes of its tile and halves it to sums and
   counts of its valid pixels; four such quarters are the tile of the next level, and so on up.
2. Places in the file are a running sum of the tiles' sizes, smallest level first.
3. The data source ``bandloom_tiff_sink`` writes each tile at its place of a draft, and its entries
   in the tables of offsets and sizes.  A task that runs twice writes the same bytes again.  The
   commit adds the header and renames the draft, so that a file under its name is whole.

The folder must be mounted on the driver and all executors.
"""

from __future__ import annotations

import base64
import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from bandloom.model import Raster
from bandloom.operators.stats import running_sum
from bandloom.sources import tiff
from bandloom.sources.ranged import local_path
from bandloom.storage import materialise

#: Files of at least this many bytes get places of 64 bits.
BIG_BYTES = (1 << 32) - (1 << 20)
_TILES = "tile_row int, tile_col int, planes array<binary>, sums binary, counts binary"


def level_shapes(height: int, width: int, overviews: int) -> list[tuple[int, int]]:
    return [(-(-height // (1 << k)), -(-width // (1 << k))) for k in range(overviews + 1)]


def _packed(sums: np.ndarray, counts: np.ndarray, dtype: np.dtype, nodata: float, compress: str) -> tuple[list[bytes], bytes, bytes]:
    """(planes, sums, counts) of one tile: its averages compressed, and itself at half the size."""
    some = counts > 0
    value = np.where(some, sums / np.maximum(counts, 1), nodata)
    if dtype.kind in "iu":
        value = np.where(np.isnan(value), 0, np.rint(value))
    planes = [tiff.compress_block(band.astype(dtype), compress) if some[k].any() else b"" for k, band in enumerate(value)]
    n, size, _ = sums.shape
    half = lambda x: x.reshape(n, size // 2, 2, size // 2, 2).sum((2, 4))
    return planes, half(sums).tobytes(), half(counts).tobytes()


def _table(keys: tuple, packed: tuple) -> pa.Table:
    planes, sums, counts = packed
    kinds = [("tile_row", pa.int32()), ("tile_col", pa.int32()), ("planes", pa.list_(pa.binary())), ("sums", pa.binary()), ("counts", pa.binary())]
    values = [keys[0], keys[1], planes, sums, counts]
    return pa.table({name: pa.array([v], kind) for (name, kind), v in zip(kinds, values, strict=True)})


def _first_level(bands: int, tile: int, dtype: np.dtype, nodata: float, compress: str):
    def run(table: pa.Table) -> pa.Table:
        tr, tc = table.column("tile_row")[0].as_py(), table.column("tile_col")[0].as_py()
        at = table.column("row").to_numpy() - tr * tile, table.column("col").to_numpy() - tc * tile
        sums, counts = np.zeros((bands, tile, tile)), np.zeros((bands, tile, tile), np.int64)
        for k in range(bands):
            v = table.column(f"b{k}").to_numpy(zero_copy_only=False).astype(float)
            valid = ~np.isnan(v)
            sums[k][at], counts[k][at] = np.where(valid, v, 0), valid
        return _table((tr, tc), _packed(sums, counts, dtype, nodata, compress))

    return run


def _next_level(bands: int, tile: int, dtype: np.dtype, nodata: float, compress: str):
    def run(table: pa.Table) -> pa.Table:
        half = tile // 2
        sums, counts = np.zeros((bands, tile, tile)), np.zeros((bands, tile, tile), np.int64)
        for r in table.to_pylist():
            y, x = r["tile_row"] % 2 * half, r["tile_col"] % 2 * half
            sums[:, y : y + half, x : x + half] = np.frombuffer(r["sums"]).reshape(bands, half, half)
            counts[:, y : y + half, x : x + half] = np.frombuffer(r["counts"], np.int64).reshape(bands, half, half)
        return _table((table.column("up_row")[0].as_py(), table.column("up_col")[0].as_py()), _packed(sums, counts, dtype, nodata, compress))

    return run


def tile_levels(pixels: DataFrame, bands: list[str], nodata: float | None, dtype: str, overviews: int, tile: int, compress: str) -> list[DataFrame]:
    """Stored tables (tile_row, tile_col, planes, sums, counts), one for each level.

    Null pixels, and pixels that hold the nodata value, are not valid: they are nodata in the file
    and count in no average.  A tile's plane without valid pixels is empty bytes.
    """
    kind = np.dtype(dtype).newbyteorder("<")
    fill = 0.0 if nodata is None else nodata
    args = len(bands), tile, kind, fill, compress
    valid = lambda b: F.col(b).cast("double") if nodata is None else F.when(F.col(b) != F.lit(nodata), F.col(b).cast("double"))
    keyed = pixels.select(F.expr(f"row div {tile}").cast("int").alias("tile_row"), F.expr(f"col div {tile}").cast("int").alias("tile_col"), F.col("row").cast("int"), F.col("col").cast("int"), *[valid(b).alias(f"b{k}") for k, b in enumerate(bands)])
    levels = [materialise(keyed.groupBy("tile_row", "tile_col").applyInArrow(_first_level(*args), _TILES), "tiles")]
    for _ in range(overviews):
        up = levels[-1].select("tile_row", "tile_col", "sums", "counts", F.expr("tile_row div 2").cast("int").alias("up_row"), F.expr("tile_col div 2").cast("int").alias("up_col"))
        levels.append(materialise(up.groupBy("up_row", "up_col").applyInArrow(_next_level(*args), _TILES), "tiles"))
    return levels


def write_tiled(pixels: DataFrame, bands: list[str], raster: Raster, path: str, dtype: str = "float32", overviews: int = 0, tile: int = 512, compress: str = "deflate", big_bytes: int = BIG_BYTES) -> None:
    """(row, col, bands) as a tiled file at ``path``, which is replaced; ``overviews`` halve the size so many times.

    Overviews are averages of the valid pixels under each of theirs, rounded for whole-number types.
    An empty table gives a file of nodata.
    """
    target = local_path(path)
    if target is None:
        raise ValueError("a tiled file needs a mounted file system; write_pyramid goes to any store")
    if tile % 16:
        raise ValueError("tiles must be multiples of 16")
    kind = np.dtype(dtype).newbyteorder("<")
    levels = tile_levels(pixels, bands, raster.nodata, dtype, overviews, tile, compress)
    shapes = level_shapes(raster.height, raster.width, overviews)
    every = None
    for k, (level, (h, w)) in enumerate(zip(levels, shapes, strict=True)):
        high, wide = -(-h // tile), -(-w // tile)
        inside = level.where((F.col("tile_row") < high) & (F.col("tile_col") < wide))
        each = inside.select("tile_row", "tile_col", F.posexplode("planes").alias("band", "data")).where("length(data) > 0")
        index = (F.col("band").cast("bigint") * high + F.col("tile_row")) * wide + F.col("tile_col")
        # smallest level first
        part = each.select(F.lit(k).alias("level"), index.alias("index"), (F.lit(overviews - k).cast("bigint") * (1 << 50) + index).alias("place"), "data")
        every = part if every is None else every.unionByName(part)
    sizes = materialise(every.select("level", "index", "place", F.length("data").cast("bigint").alias("size")), "tile-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    entries = sum(len(bands) * -(-h // tile) * -(-w // tile) for h, w in shapes)
    layout = tiff.tiled_layout(raster, kind, shapes, len(bands), tile, compress, total + 16 * entries >= big_bytes)
    offsets = running_sum(sizes, "place", "size", "before").select("place", (F.col("before") + layout.data).cast("bigint").alias("offset"))
    rows = every.join(offsets, "place").select("level", "index", "offset", "data")
    write_placed(rows, path, layout.parts, layout.tables, layout.width, layout.data + total)


def write_placed(rows: DataFrame, path: str, parts: list[tuple[int, bytes]], tables: list[tuple[int, ...]], width: int, size: int) -> None:
    """One file of ``size`` bytes from rows (level, index, offset, data), and ``parts`` (place, bytes) of the driver.

    ``tables`` holds, for each level, where its tables of offsets and of sizes begin, if it has any; their
    entries are ``width`` bytes.
    """
    target = local_path(path)
    if target is None:
        raise ValueError("a file that tasks write together needs a mounted file system")
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    draft = f"{target}.draft-{uuid.uuid4().hex}"
    head = json.dumps({"parts": [[at, base64.b64encode(part).decode()] for at, part in parts], "tables": tables, "width": width, "size": size})
    rows.sparkSession.dataSource.register(TiledSink)
    rows.write.format(TiledSink.name()).mode("append").option("target", target).option("draft", draft).option("layout", head).save()


class TiledSink(DataSource):
    """Takes (level, index, offset, data); options: target, draft, layout (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "bandloom_tiff_sink"

    def schema(self) -> str:
        return "level int, index bigint, offset bigint, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _TiledWriter(self.options["target"], self.options["draft"], json.loads(self.options["layout"]))


@dataclass
class _Written(WriterCommitMessage):
    tiles: int
    size: int


class _TiledWriter(DataSourceArrowWriter):
    def __init__(self, target: str, draft: str, layout: dict):
        self.target, self.draft, self.layout = target, draft, layout

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        form = "<Q" if self.layout["width"] == 8 else "<I"
        tiles = size = 0
        file = os.open(self.draft, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for batch in iterator:
                level, index, offset = (batch.column(k).to_pylist() for k in range(3))
                for k, data in enumerate(batch.column(3)):
                    tile = data.as_py()
                    os.pwrite(file, tile, offset[k])
                    for table, value in zip(self.layout["tables"][level[k]], (offset[k], len(tile)), strict=False):
                        os.pwrite(file, struct.pack(form, value), table + index[k] * self.layout["width"])
                    tiles, size = tiles + 1, size + len(tile)
            os.fsync(file)
        finally:
            os.close(file)
        return _Written(tiles, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        # the same bytes may come twice from a task that ran again, but only its last message does
        file = os.open(self.draft, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            tables = [(at, at + self.layout["width"]) for pair in self.layout["tables"] for at in pair]
            for at, part in self.layout["parts"]:
                raw = base64.b64decode(part)
                # an entry that is itself a table of one tile stands in a page and is kept
                kept = [(a, os.pread(file, b - a, a)) for a, b in tables if at <= a < at + len(raw)]
                os.pwrite(file, raw, at)
                for a, value in kept:
                    os.pwrite(file, value.ljust(self.layout["width"], b"\0"), a)
            if os.fstat(file).st_size < self.layout["size"]:
                os.ftruncate(file, self.layout["size"])
            os.fsync(file)
        finally:
            os.close(file)
        os.replace(self.draft, self.target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.draft):
            os.remove(self.draft)
