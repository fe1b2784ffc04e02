"""Strips, and tiles drawn together."""

import zlib

import numpy as np
import pytest

from bandloom.model import Affine, Raster
from bandloom.operators import tiles
from bandloom.sources import png


def test_checksums_combine():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 1), (70_000, 3), (5, 140_001)):
        a, b = (rng.integers(0, 256, k).astype("u1").tobytes() for k in (n, m))
        assert png.combine_adler(zlib.adler32(a), zlib.adler32(b), m) == zlib.adler32(a + b)


@pytest.mark.parametrize("height, width, rows", [(37, 21, 8), (8, 5, 8), (1, 1, 64), (65, 3, 64)])
def test_strips_make_one_picture(spark, tmp_path, height, width, rows):
    rgba = np.random.default_rng(2).integers(0, 256, (height, width, 4)).astype("u1")
    rgba[10:20] = 0
    cells = [(r, c, *map(int, rgba[r, c])) for r in range(height) for c in range(width) if rgba[r, c].any()] + [(height, 0, 1, 1, 1, 1), (-1, 0, 1, 1, 1, 1)]
    df = spark.createDataFrame(cells, "row int, col int, r int, g int, b int, a int").repartition(3)
    data = png.picture(df, height, width, rows)
    assert (png.decode_png(data) == rgba).all()
    png.write_picture(df, height, width, str(tmp_path / "p.png"), rows)
    assert (tmp_path / "p.png").read_bytes() == data
    assert (png.decode_png(png.picture(df.where("false"), height, width, rows)) == 0).all()


def test_tiles_cover_the_raster(spark):
    raster = Raster("r", 40, 30, Affine(100.0, 0.0, 1000000.0, 0.0, -100.0, 6000000.0), "EPSG:3857", 0.0)
    df = spark.range(1200).selectExpr("cast(id div 40 as int) row", "cast(id % 40 as int) col", "cast(1 + id % 7 as int) v")
    drawn = tiles.tile_matrix(df, raster, [8, 12], ["v"]).collect()
    assert {(r.z, r.x, r.y) for r in drawn} <= {(r.z, r.x, r.y) for r in tiles.tile_list(spark, raster, [8, 12]).collect()}
    opaque = {z: sum(int((png.decode_png(r.png)[..., 3] > 0).sum()) for r in drawn if r.z == z) for z in (8, 12)}
    side = {z: 40075016.686 / 2**z / 256 for z in (8, 12)}
    for z in (8, 12):  # the raster and half a pixel around it
        assert abs(opaque[z] - 41 * 31 * 100 * 100 / side[z] ** 2) < 0.12 * opaque[z] + 8


def test_strips_are_decoded_one_by_one(spark):
    df = spark.range(23 * 5).selectExpr("cast(id div 5 as int) row", "cast(id % 5 as int) col", "cast(id as int) r", "cast(id * 2 as int) g", "7 b", "255 a")
    drawn = png.strips(df, 23, 5, rows=4)
    assert drawn.count() == 6
    assert sorted(map(tuple, png.strip_pixels(drawn, 5, rows=4).collect())) == sorted(map(tuple, df.collect()))


def test_parts_make_one_picture(spark):
    rgba = np.random.default_rng(3).integers(0, 256, (150, 7, 4)).astype("u1")
    df = spark.createDataFrame([(r, c, *map(int, rgba[r, c])) for r in range(150) for c in range(7)], "row int, col int, r int, g int, b int, a int")
    found = sorted(map(tuple, png.parts(df, 150, 7).collect()))
    assert [k for k, _ in found] == list(range(5))
    assert b"".join(bytes(d) for _, d in found) == png.picture(df, 150, 7)


def test_png_render_is_no_single_row(spark, sf_dir):
    from bandloom.plans.catalog import QUERIES

    found = sorted(map(tuple, QUERIES["png_render"](spark, sf_dir).select("part", "png").collect()))
    rgba = png.decode_png(b"".join(bytes(d) for _, d in found))
    want = QUERIES["png_pixels"](spark, sf_dir).collect()
    assert len(found) > 2 and len(want) == rgba.shape[0] * rgba.shape[1]
    assert all(tuple(rgba[p.row, p.col]) == (p.r, p.g, p.b, p.a) for p in want)


@pytest.mark.parametrize("name", ["preview_pixels", "render_pixels", "render_band_pixels", "png_strips"])
def test_pictures_are_not_put_together(spark, sf_dir, monkeypatch, name):
    from bandloom.plans.catalog import QUERIES

    def whole(*_):
        raise AssertionError("a whole picture")

    monkeypatch.setattr(png, "picture", whole)
    monkeypatch.setattr(png, "pixels", whole)
    assert QUERIES[name](spark, sf_dir).count() >= 1500
