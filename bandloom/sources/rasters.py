"""Rasters in files as DataFrames: headers, pixels by block, sinks, sidecar metadata.

Files are read by byte ranges (see ``ranged``): a header costs a few of them whatever the size
of the file, and a block is read when it is wanted.  The data source ``bandloom_tiff`` plans
rectangles of blocks as partitions; a window keeps all blocks outside unplanned and unread.  (The
window is an option and not a pushed filter: Spark 4.1 keeps what ``pushFilters`` notes in a state
that all uses of one DataFrame share, so that a union of two windows of it would read one of them
twice.)  Sinks are in ``tiled``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bandloom.model import BANDS, RASTER_SCHEMA, Affine, Raster
from bandloom.sources import tiff
from bandloom.sources.ranged import Ranged, local_path
from bandloom.storage import materialise, write_bytes

#: Bytes of decoded blocks in a partition, about.
PARTITION_BYTES = 32 << 20
#: Headers that are read at a time while a scan is planned.
THREADS = 16


def header_row(r: Raster) -> tuple:
    t = r.transform
    return r.raster_id, r.path, r.crs, r.bounds, r.width, r.height, len(r.descriptions), r.dtype, [t.a, t.b, t.c, t.d, t.e, t.f], r.nodata, list(r.descriptions)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a path, folder or pattern; no content is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: the header, read by a few byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                row = header_row(tiff.header(Ranged(file), file))
                bounds = dict(zip(("left", "bottom", "right", "top"), row[3], strict=True))
                names = ["raster_id", "path", "crs", "bounds", "width", "height", "count", "dtype", "transform", "nodata", "descriptions"]
                kinds = [pa.string(), pa.string(), pa.string(), pa.struct([(k, pa.float64()) for k in bounds]), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*row[:3], bounds, *row[4:]], kinds, strict=True)], names)

    return list_files(spark, path).select("path").mapInArrow(run, RASTER_SCHEMA)


def header(spark: SparkSession, path: str) -> Raster:
    """The header of one file, read by a task: the driver doesn't open it."""
    r = catalog(spark, path).first()
    if r is None:
        raise FileNotFoundError(path)
    return Raster(r["raster_id"], r["width"], r["height"], Affine(*r["transform"]), r["crs"], r["nodata"], tuple(r["descriptions"]), r["dtype"], r["path"])


def _rows(raster_id: str, block: np.ndarray, row0: int, col0: int, names: list[str]) -> pa.RecordBatch:
    n, h, w = block.shape
    rows, cols = np.divmod(np.arange(h * w), w)
    return pa.RecordBatch.from_arrays([pa.array([raster_id] * (h * w)), pa.array(rows + row0, pa.int32()), pa.array(cols + col0, pa.int32()), *(pa.array(block[k].reshape(-1).astype(float)) for k in range(n))], ["raster_id", "row", "col", *names])


def _wanted(descriptions: tuple[str, ...], count: int, bands: list[str] | None) -> list[tuple[str, int]]:
    by_name = {d.lower(): k for k, d in enumerate(descriptions) if d}
    names = bands or [d.lower() or f"band_{k + 1}" for k, d in enumerate(descriptions)] or [f"band_{k + 1}" for k in range(count)]
    out = []
    for b in names:
        if b in by_name:
            out.append((b, by_name[b]))
        elif b.startswith("band_") and b[5:].isdigit() and int(b[5:]) <= count:
            out.append((b, int(b[5:]) - 1))
        else:
            raise ValueError(f"Band not found: {b}")
    return out


def scan(spark: SparkSession, path: str, bands: list[str], window: tuple[int, int, int, int] | None = None, level: int = 0) -> DataFrame:
    """(raster_id, row, col, bands) of all files under ``path``; bands by description, or band_1, band_2...

    ``window`` (row0, col0, row1, col1; the ends excluded) reads only blocks that touch it and gives only
    its pixels.  ``level`` reads an overview (1: the first); rows and columns are then the overview's."""
    files = [r["path"] for r in list_files(spark, path).select("path").collect()]
    spark.dataSource.register(TiffDataSource)
    source = spark.read.format(TiffDataSource.name()).option("paths", json.dumps(files)).option("bands", ",".join(bands)).option("level", level)
    if window:
        source = source.option("window", ",".join(str(x) for x in window))
    return source.load()


class _Blocks(InputPartition):
    """Blocks of a file in rows [row0, row1) and columns [col0, col1) of its grid of blocks."""

    def __init__(self, path: str, row0: int, row1: int, col0: int, col1: int):
        super().__init__((path, row0, row1, col0, col1))


class TiffDataSource(DataSource):
    """Options: path or paths (a JSON list), bands (comma-separated), window (row0,col0,row1,col1), level."""

    @classmethod
    def name(cls) -> str:
        return "bandloom_tiff"

    def _bands(self) -> list[str]:
        return self.options.get("bands", ",".join(BANDS)).split(",")

    def schema(self) -> str:
        return "raster_id string, row int, col int, " + ", ".join(f"`{b}` double" for b in self._bands())

    def reader(self, schema) -> DataSourceReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        window = [int(x) for x in self.options["window"].split(",")] if "window" in self.options else [0, 0, *[1 << 31] * 2]
        return _TiffReader(paths, self._bands(), window, int(self.options.get("level", 0)))


class _TiffReader(DataSourceReader):
    def __init__(self, paths: list[str], bands: list[str], window: list[int], level: int):
        self.paths, self.bands, self.window, self.level = paths, bands, window, level

    def _page(self, data) -> tiff.TiffPage:
        pages = tiff.read_pages(data)
        if not 0 <= self.level < len(pages):
            raise ValueError(f"no level {self.level}: the file has {len(pages)}")
        return pages[self.level]

    def _plan(self, path: str) -> list[InputPartition]:
        data = Ranged(path)
        page = self._page(data)
        _wanted(tiff.header(data, path).descriptions, page.count, self.bands)
        (bh, bw), (rows, cols) = page.block_shape(), page.grid()
        row0, col0, row1, col1 = self.window
        first, last, left, right = max(0, row0) // bh, min(rows, -(-row1 // bh)), max(0, col0) // bw, min(cols, -(-col1 // bw))
        each = bh * bw * max(page.dtype.itemsize * page.count, 8 * len(self.bands))
        wide = max(1, min(right - left, PARTITION_BYTES // each))
        high = max(1, PARTITION_BYTES // (each * wide))
        data.close()
        return [_Blocks(path, r, min(last, r + high), c, min(right, c + wide)) for r in range(first, last, high) for c in range(left, right, wide)]

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(THREADS) as pool:
            found = [p for plan in pool.map(self._plan, self.paths) for p in plan]
        return found or [_Blocks(self.paths[0] if self.paths else "", 0, 0, 0, 0)]  # a scan needs a partition

    def read(self, partition: _Blocks) -> Iterator[pa.RecordBatch]:
        path, first, last, left, right = partition.value
        if first >= last:
            return
        data = Ranged(path)
        head, page = tiff.header(data, path), self._page(data)
        pick = _wanted(head.descriptions, page.count, self.bands)
        bh, bw = page.block_shape()
        row0, col0, row1, col1 = self.window
        for br in range(first, last):
            for bc in range(left, right):
                block = tiff.read_block(data, page, br, bc, [k for _, k in pick])
                r, x = br * bh, bc * bw
                a, y = max(0, row0 - r), max(0, col0 - x)
                part = block[:, a : max(a, row1 - r), y : max(y, col1 - x)]
                if part.size:
                    yield _rows(head.raster_id, part, r + a, x + y, [b for b, _ in pick])
        data.close()


def to_arrays(pixels: DataFrame, bands: list[str], height: int, width: int, fill: float = 0.0) -> np.ndarray:
    """Collect a window of limited size as (bands, H, W)."""
    if height * width > 1 << 24:
        raise ValueError("a window of over 16 M pixels isn't collected; write blocks instead")
    table = pixels.select("row", "col", *bands).toArrow()
    out = np.full((len(bands), height, width), fill)
    at = table.column("row").to_numpy(), table.column("col").to_numpy()
    for k, b in enumerate(bands):
        v = table.column(b).to_numpy(zero_copy_only=False).astype(float)
        out[k][at] = np.where(np.isnan(v), fill, v)
    return out


def write_geotiff(pixels: DataFrame, band: str, raster: Raster, path: str, mask: bool = False, compress: str = "lzw") -> None:
    """One float32 band, or a uint8 mask with nodata 0: one file, its tiles written by tasks.

    On stores without a mount only images that fit on the driver can be written."""
    from bandloom.sources import tiled

    nodata = 0.0 if mask else raster.nodata if raster.nodata is not None else float("nan")
    out = Raster(raster.raster_id, raster.width, raster.height, raster.transform, raster.crs, nodata, (band,))
    if local_path(path):
        tiled.write_tiled(pixels, [band], out, path, "uint8" if mask else "float32", compress=compress)
        return
    data = to_arrays(pixels, [band], raster.height, raster.width, nodata).astype("u1" if mask else "f4")
    write_bytes(pixels.sparkSession, path, tiff.encode_tiff(data, out, compress))


def write_pyramid(pixels: DataFrame, bands: list[str], path: str, levels: tuple[int, ...] = (1, 2, 4, 8, 16), block: int = 512) -> None:
    """Parquet by level and block row: averages of level x level pixels, so a scan of a window reads few files.

    Each level comes from the sums and counts of the finest earlier one that divides it, so that the
    pixels are read once for the first level and not again for those above it."""
    done: dict[int, DataFrame] = {}
    for level in sorted(levels):
        below = max((k for k in done if level % k == 0), default=0)
        if below:
            source, step = done[below], level // below
            sums = [F.sum(f"{kind}{k}").alias(f"{kind}{k}") for k in range(len(bands)) for kind in "sn"]
        else:
            source, step = pixels, level
            sums = [x for k, b in enumerate(bands) for x in (F.sum(F.col(b).cast("double")).alias(f"s{k}"), F.count(b).alias(f"n{k}"))]
        row, col = F.expr(f"row div {step}").cast("int"), F.expr(f"col div {step}").cast("int")
        done[level] = materialise(source.groupBy(row.alias("row"), col.alias("col")).agg(*sums), "pyramid-sums")
    small = None
    for level, sums in done.items():
        one = sums.select(F.lit(level).alias("level"), "row", "col", *[F.when(F.col(f"n{k}") > 0, F.col(f"s{k}") / F.col(f"n{k}")).alias(b) for k, b in enumerate(bands)])
        small = one if small is None else small.unionByName(one)
    keyed = small.withColumn("block_row", F.expr(f"row div {block}").cast("int")).withColumn("block_col", F.expr(f"col div {block}").cast("int"))
    keyed.repartition("level", "block_row", "block_col").sortWithinPartitions("level", "block_row", "row", "col").write.partitionBy("level", "block_row").parquet(path)


def read_pyramid(spark: SparkSession, path: str, level: int, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A level, or the part of it in (row0, col0, row1, col1) of that level; other folders aren't read."""
    df = spark.read.parquet(path).where(F.col("level") == level)
    if window:
        r0, c0, r1, c1 = window
        df = df.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    return df.drop("level", "block_row", "block_col")


def band_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, band_name, band) from a JSON report {"files": [{"path", "band_index_by_name": {...}}]}."""
    report = spark.read.schema("files array<struct<path:string,band_index_by_name:map<string,int>>>").option("multiLine", True).json(path)
    files = report.select(F.explode("files").alias("f"))
    name = F.lower(F.element_at(F.split(F.regexp_replace("f.path", r"\\", "/"), "/"), -1))
    return files.select(name.alias("file"), F.explode("f.band_index_by_name").alias("band_name", "band")).select("file", F.lower("band_name").alias("band_name"), "band")


def bands_of(spark: SparkSession, report: str, raster_path: str) -> dict[str, int]:
    """Bands of one file by its base name, whatever the case; FileNotFoundError if the report lacks it."""
    base = os.path.basename(raster_path).lower()
    found = {r["band_name"]: r["band"] for r in band_metadata(spark, report).where(F.col("file") == base).collect()}
    if not found:
        raise FileNotFoundError(f"{base} is not in {report}")
    return found


def resolve_path(name: str, folders: list[str]) -> str:
    """An absolute path, one relative to the working folder, or the base name in or below the folders."""
    if os.path.isabs(name) and os.path.exists(name):
        return name
    if os.path.exists(name):
        return os.path.abspath(name)
    base = os.path.basename(name)
    for folder in folders:
        if os.path.exists(os.path.join(folder, base)):
            return os.path.join(folder, base)
    for folder in folders:
        for top, _, files in os.walk(folder):
            if base in files:
                return os.path.join(top, base)
    raise FileNotFoundError(name)


def ingest(data: bytes, name: str, folder: str) -> str:
    """Save an upload under its bare base name; names that lead elsewhere are refused."""
    base = os.path.basename(name.replace("\\", "/"))
    if not base or base in (".", "..") or "\0" in base:
        raise ValueError(f"not a file name: {name!r}")
    target = os.path.join(folder, base)
    with open(target, "wb") as f:
        f.write(data)
    return target


def as_dict(r: Raster) -> dict:
    return asdict(r) | {"bounds": r.bounds}
