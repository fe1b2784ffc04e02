"""Files read by ranges and written by tasks."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.model import Affine, Raster
from bandloom.sources import rasters, tiff, tiled
from bandloom.sources.ranged import Ranged

RASTER = Raster("r", 83, 117, Affine(3.0, 0.0, 633825.0, 0.0, -3.0, 3004017.0), "EPSG:32645", 0.0, ("nir", "red"))


@pytest.fixture(scope="module")
def cube():
    cube = np.random.default_rng(8).integers(0, 4000, (2, 117, 83)).astype("u2")
    cube[:, :40, :40] = 0
    cube[0, 60:70, :] = 0
    return cube


def frame(spark, cube):
    n, h, w = cube.shape
    rows = [(r, c, *(int(v) if v else None for v in cube[:, r, c])) for r in range(h) for c in range(w) if cube[:, r, c].any()]
    return spark.createDataFrame(rows, "row int, col int, nir int, red int").repartition(3)


def averages(band, step):
    """Mean of the valid pixels under each pixel of a level; 0 where there is none."""
    h, w = band.shape
    out = np.zeros((-(-h // step), -(-w // step)))
    for r, c in np.ndindex(out.shape):
        part = band[r * step : (r + 1) * step, c * step : (c + 1) * step]
        out[r, c] = np.rint(part[part > 0].mean()) if (part > 0).any() else 0
    return out


@pytest.mark.parametrize("big, compress", [(False, "lzw"), (True, "deflate"), (False, "none")])
def test_every_level_comes_back(spark, tmp_path, cube, big, compress):
    path = str(tmp_path / "out.tif")
    tiled.write_tiled(frame(spark, cube), ["nir", "red"], RASTER, path, "uint16", overviews=3, tile=32, compress=compress, big_bytes=0 if big else tiled.BIG_BYTES)
    assert os.listdir(tmp_path) == ["out.tif"]
    data = Ranged(path)
    pages = tiff.read_pages(data)
    assert len(pages) == 4 and bytes(data[2:4]) == (b"\x2b\0" if big else b"\x2a\0")
    head = tiff.header(data, path)
    assert (head.width, head.height, head.crs, head.nodata, head.descriptions, head.transform) == (83, 117, "EPSG:32645", 0.0, ("nir", "red"), RASTER.transform)
    for level in range(4):
        got = rasters.to_arrays(rasters.scan(spark, path, ["nir", "red"], level=level), ["nir", "red"], *tiled.level_shapes(117, 83, 3)[level])
        assert (got == [averages(b, 1 << level) for b in cube]).all()


def test_one_tile_and_nothing(spark, tmp_path):
    small = Raster("s", 5, 4, RASTER.transform, "EPSG:4326", None, ("v",))
    df = spark.createDataFrame([(1, 2, 7.5), (3, 4, -1.0)], "row int, col int, v double")
    tiled.write_tiled(df, ["v"], small, f"file://{tmp_path}/a.tif", tile=16, overviews=1)
    want = np.zeros((4, 5))
    want[1, 2], want[3, 4] = 7.5, -1
    assert (tiff.read_window(Ranged(f"{tmp_path}/a.tif"), 0, 0, 4, 5)[0] == want).all()
    tiled.write_tiled(df.where("false"), ["v"], small, f"{tmp_path}/b.tif", tile=16)
    assert (tiff.read_window(Ranged(f"{tmp_path}/b.tif"), 0, 0, 4, 5) == 0).all()
    with pytest.raises(ValueError, match="mounted"):
        tiled.write_tiled(df, ["v"], small, "s3://bucket/a.tif")


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    small = Raster("s", 40, 40, RASTER.transform, "EPSG:4326", 0.0, ("v",))
    df = spark.range(1600).select(F.expr("cast(id div 40 as int)").alias("row"), F.expr("cast(id % 40 as int)").alias("col"), F.when(F.col("id") < 1599, F.col("id") + 1).otherwise(F.raise_error(F.lit("lost"))).cast("double").alias("v"))
    with pytest.raises(Exception, match="lost"):
        tiled.write_tiled(df, ["v"], small, str(tmp_path / "x.tif"), tile=16)
    assert os.listdir(tmp_path) == []


def test_windows_prune_blocks(spark, tmp_path, cube, monkeypatch):
    path = str(tmp_path / "f.tif")
    with open(path, "wb") as f:
        f.write(tiff.encode_tiff(cube, RASTER, "deflate", 16))
    one, two = rasters.scan(spark, path, ["nir"], (33, 20, 50, 21)), rasters.scan(spark, path, ["nir"], (0, 70, 3, 900))
    want = {(r, c, float(cube[0, r, c])) for r0, r1, c0, c1 in ((33, 50, 20, 21), (0, 3, 70, 83)) for r in range(r0, r1) for c in range(c0, c1)}
    got = [tuple(r) for r in one.union(two).select("row", "col", "nir").collect()]
    assert set(got) == want and len(got) == len(want)
    assert rasters.scan(spark, path, ["nir"], (500, 0, 600, 10)).count() == 0 and rasters.scan(spark, path, ["nir"]).where("row = 5").count() == 83
    reader = rasters._TiffReader([path], ["nir"], [33, 20, 50, 21], 0)
    assert [p.value[1:] for p in reader.partitions()] == [(2, 4, 1, 2)]
    seen = []
    plain = tiff.read_block
    monkeypatch.setattr(tiff, "read_block", lambda *a: seen.append(a[2:4]) or plain(*a))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 17 and seen == [(2, 1), (3, 1)]


def test_header_of_a_huge_file_by_few_ranges(spark, tmp_path):
    """A sparse file of 6 GB: the header and one pixel block cost a few reads."""
    raster = Raster("huge", 60_000, 50_000, RASTER.transform, "EPSG:32645", 0.0, ("nir",))
    layout = tiff.tiled_layout(raster, np.dtype("<u2"), [(50_000, 60_000)], 1, 512, "none", True)
    path = tmp_path / "huge.tif"
    index, tile = 97 * 118 + 3, np.full((512, 512), 7, "<u2")
    with open(path, "wb") as f:
        f.truncate(6 << 30)
        for at, part in layout.parts:
            f.seek(at)
            f.write(part)
        for table, value in zip(layout.tables[0], (5 << 30, tile.nbytes), strict=True):
            f.seek(table + 8 * index)
            f.write(struct.pack("<Q", value))
        f.seek(5 << 30)
        f.write(tile.tobytes())
    data = Ranged(str(path))
    head = tiff.header(data, str(path))
    assert (head.width, head.height) == (60_000, 50_000) and data.reads <= 3 and data.bytes_read < 1 << 20
    assert rasters.header(spark, f"file://{path}").width == 60_000
    got = rasters.scan(spark, f"file://{path}", ["nir"], (49_664, 1536, 49_666, 1540))
    assert [r.nir for r in got.collect()] == [7.0] * 8
