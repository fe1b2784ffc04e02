"""Projections against published points, scan lines against the even-odd rule, arriving files, training on cached grids."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.model import BANDS, Affine, Raster, Seed
from bandloom.operators import roi
from bandloom.operators.projection import NAMED, WGS, Conic, from_lonlat, to_lonlat
from bandloom.plans import engine as engine_module
from bandloom.plans import ingest
from bandloom.plans.engine import Engine
from bandloom.sources import tiff


def test_published_points():
    """Worked examples: EPSG guidance note 7-2 (Lambert, polar), Snyder 1987 (Albers)."""
    foot = 20925832.16
    lambert = Conic("lambert", 28 + 23 / 60, 30 + 17 / 60, 27 + 50 / 60, -99.0, 2_000_000.0, 0.0, foot, 1 / 294.97870)
    assert np.allclose(lambert.forward(-96.0, 28.5), (2963503.91, 254759.80), atol=0.01)
    polar = Conic("polar", -71.0, -71.0, -90.0, 70.0, 6_000_000.0, 6_000_000.0, f=WGS)
    assert np.allclose(polar.forward(120.0, -75.0), (7255380.79, 7053389.56), atol=0.01)
    e2 = 0.00676866
    albers = Conic("albers", 29.5, 45.5, 23.0, -96.0, 0.0, 0.0, 6378206.4, 1 - math.sqrt(1 - e2))
    assert np.allclose(albers.forward(-75.0, 35.0), (1885472.7, 1535925.0), atol=0.1)


@pytest.mark.parametrize("crs", sorted(NAMED))
def test_round_trips_below_a_millimetre(spark, crs):
    p = NAMED[crs]
    rng = np.random.default_rng(4)
    if p.kind == "polar":
        lon, lat = rng.uniform(-179.9, 179.9, 200), math.copysign(1, p.lat1) * rng.uniform(55, 89.9, 200)
    else:
        lon, lat = p.lon0 + rng.uniform(-40, 40, 200), np.clip(p.lat0 + rng.uniform(-20, 30, 200) * (1 if p.lat1 > 0 else -1), -80, 84)
    x, y = from_lonlat(crs, lon, lat)
    back = to_lonlat(crs, x, y)
    turn = (back[0] - lon + 180) % 360 - 180
    assert np.abs(turn * np.cos(np.radians(lat))).max() * 111_320 < 1e-3 and np.abs(back[1] - lat).max() * 111_320 < 1e-3
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for a, b, c, d in list(zip(lon, lat, x, y))[:20]], "lon double, lat double, x double, y double")
    fx, fy = from_lonlat(crs, F.col("lon"), F.col("lat"))
    gx, gy = to_lonlat(crs, F.col("x"), F.col("y"))
    for r in df.select(fx.alias("a"), fy.alias("b"), gx.alias("c"), gy.alias("d"), "*").collect():
        assert abs(r.a - r.x) < 1e-4 and abs(r.b - r.y) < 1e-4 and abs(r.d - r.lat) < 1e-9 and abs((r.c - r.lon + 180) % 360 - 180) < 1e-8


def test_scan_lines_against_the_even_odd_rule(spark):
    draw = random.Random(6)
    shapes = {k: [[[draw.uniform(-5, 45), draw.uniform(-5, 35)] for _ in range(draw.choice([3, 4, 7]))] for _ in range(draw.choice([1, 1, 2]))] for k in range(12)}
    shapes[20] = [[[2.0, 3.0], [2.0, 9.0], [8.0, 9.0], [8.0, 3.0], [2.0, 3.0]]]
    rows = [(k, str(v).replace("[[[", '{"type": "Polygon", "coordinates": [[[', 1) + "}") for k, v in shapes.items()] + [(90, None), (91, "junk"), (92, '{"type": "Polygon", "coordinates": []}')]
    df = spark.createDataFrame(rows, "id int, shape string")
    got = {tuple(r) for r in roi.polygon_pixels(roi.polygon_spans(df, "shape", 30, 40, Affine(1.0, 0.0, 0.0, 0.0, 1.0, 0.0), ["id"]), ["id"]).collect()}
    grid = spark.range(1200).selectExpr("cast(id div 40 as int) row", "cast(id % 40 as int) col")
    want = set()
    for k, rings in shapes.items():
        inside = roi.inside_polygon(F.col("col") + 0.5, F.col("row") + 0.5, rings)
        want |= {(k, r.row, r.col) for r in grid.where(inside).collect()}
    assert got == want and len({k for k, _, _ in got}) > 9
    north_up = Affine(2.0, 0.0, 100.0, 0.0, -2.0, 60.0)
    moved = spark.createDataFrame([(1, '{"type": "Polygon", "coordinates": [[[100, 60], [110, 60], [110, 50], [100, 50]]]}')], "id int, shape string")
    assert roi.polygon_pixels(roi.polygon_spans(moved, "shape", 30, 40, north_up, ["id"]), ["id"]).count() == 25
    values = grid.withColumn("v", F.col("row") * 40 + F.col("col"))
    zone = roi.polygon_zones(values, ["v"], moved, "shape", 30, 40, north_up, ["id"]).first()
    assert (zone.n, zone.min_v, zone.max_v) == (25, 0, 164)


def field(seed):
    rng = np.random.default_rng(seed)
    return rng.integers(100, 9000, (8, 21, 17)).astype("u2")


def test_arriving_files_once_each(spark, tmp_path, monkeypatch):
    raster = Raster("r", 17, 21, Affine(3.0, 0.0, 633825.0, 0.0, -3.0, 3004017.0), "EPSG:32645", 0.0, tuple(BANDS))
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda k: (folder / f"f{k}.tif").write_bytes(tiff.encode_tiff(field(k), raster, "deflate", 16))
    run = lambda: ingest.precompute_files(spark, f"file://{folder}", f"file://{tmp_path}/out", f"file://{tmp_path}/check", ["ndvi", "gli"], files=2).awaitTermination()
    counts = lambda: {r.path.rsplit("/", 1)[1]: r["count"] for r in ingest.read_maps(spark, f"file://{tmp_path}/out").groupBy("path").count().collect()}
    for k in range(3):
        put(k)
    run()
    assert counts() == {f"f{k}.tif": 357 for k in range(3)}
    run()
    put(3)
    # a batch that is written and then fails is written again, in the same place
    plain = ingest._maps
    monkeypatch.setattr(ingest, "_maps", lambda s, p, n: plain(s, p, n).withColumn("row", F.when(F.col("row") < 20, F.col("row")).otherwise(F.raise_error(F.lit("lost")).cast("int"))))
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(ingest, "_maps", plain)
    run()
    assert counts() == {f"f{k}.tif": 357 for k in range(4)}
    cube = field(2).astype(float) / 10000
    got = {(r.row, r.col): r.ndvi for r in ingest.read_maps(spark, f"file://{tmp_path}/out").where("path like '%f2.tif'").collect()}
    assert all(abs(got[r, c] - (cube[7, r, c] - cube[5, r, c]) / (cube[7, r, c] + cube[5, r, c])) < 1e-9 for r in range(21) for c in range(17))


def test_training_on_the_cached_grid(spark, monkeypatch):
    cube = np.full((8, 24, 24), 3000)
    cube[7, 4:14, 4:14] = 9000
    cube += np.random.default_rng(1).integers(0, 200, cube.shape)
    names = list(BANDS)
    df = spark.createDataFrame([(r, c, *map(int, cube[:, r, c])) for r in range(24) for c in range(24)], "row int, col int, " + ", ".join(f"{b} int" for b in names))
    engine = Engine(spark)
    engine.use(Raster("r", 24, 24, Affine(3.0, 0.0, 633825.0, 0.0, -3.0, 3004017.0), "EPSG:32645", 0.0, tuple(names)), df)
    monkeypatch.setattr(engine_module, "PREVIEW_SIDE", 12)
    engine.precompute()
    maps, grid = engine._training_maps(["ndvi", "savi"])  # savi takes parameters, and is not precomputed
    assert (grid.width, grid.height) == (12, 12) and maps.count() == 144 and maps.columns == ["row", "col", "ndvi", "savi"]
    r = maps.where("row = 4 and col = 4").first()
    assert r.ndvi > 0.3 and r.savi > 0.2 and maps.where("row = 0 and col = 0").first().savi < 0.1
    result = engine.train(["ndvi", "savi"], [Seed(8, 8), Seed(20, 20, "neg")], 0.5, 2)
    assert result["total_pixels"] == 144 and {s["name"] for s in result["per_index_scores"]} == {"ndvi", "savi"}


def test_tiles_meet_their_pixels_without_a_broadcast(spark):
    from bandloom.operators import tiles

    raster = Raster("r", 10, 400, Affine(100.0, 0.0, 1000000.0, 0.0, -100.0, 6000000.0), "EPSG:3857", 0.0)
    pixels = spark.range(4000).selectExpr("cast(id div 10 as int) as row", "cast(id % 10 as int) as col", "cast(1 + id % 50 as int) as b0")
    met = tiles.tile_corners(pixels, raster, tiles.tile_list(spark, raster, [9, 10, 11]), ["b0"])
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and met.count() > 0
