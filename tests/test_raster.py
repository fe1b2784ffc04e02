import json
import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import indices as ix
from bandloom.functions.arith import clip
from bandloom.model import BANDS, Affine, Raster, Seed
from bandloom.operators import projection, resample, roi, scaling, segmentation, stats, symbology, topology, training
from bandloom.plans import registry
from bandloom.plans.cache import IndexCache, TileCache, tile_key
from bandloom.plans.engine import Engine, IndexRequest, RenderRequest
from bandloom.sources import png, rasters, tiff


def frame(spark, **bands):
    any_band = next(iter(bands.values()))
    h, w = any_band.shape
    rows = [(r, c, *(None if isinstance(b[r, c], float) and math.isnan(b[r, c]) else b[r, c].item() for b in bands.values())) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "row int, col int, " + ", ".join(f"{n} double" if b.dtype.kind == "f" else f"{n} int" for n, b in bands.items()))


def grid_of(df, value, h, w):
    out = np.zeros((h, w))
    for r in df.select("row", "col", value).collect():
        out[r["row"], r["col"]] = r[value] if r[value] is not None else np.nan
    return out


def flood(may, start, connectivity):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    seen, todo = {start}, deque([start])
    while todo:
        r, c = todo.popleft()
        for dr, dc in steps:
            p = r + dr, c + dc
            if 0 <= p[0] < may.shape[0] and 0 <= p[1] < may.shape[1] and may[p] and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def test_indices_without_registry(spark):
    df = spark.createDataFrame([(0.5, 0.25), (0.0, 0.0), (None, 0.1)], "a double, b double")
    got = df.select(ix.ndmi(F.col("a"), F.col("b")).alias("n"), ix.single_band(F.col("a")).alias("s"), ix.log_ratio(F.col("a"), F.col("b"), legacy_inf=True).alias("l")).collect()
    assert [r.n for r in got] == [0.25 / 0.75, 0.0, None] and got[0].s == 0.5
    assert got[1].l == float("-inf") and got[2].l is None


def test_registry(spark):
    assert len(registry.formula_names()) == 31 and len(registry.ready_names()) == 26
    assert registry.catalog(spark).count() == 35
    with pytest.raises(ValueError, match="SWIR"):
        registry.resolve(("swir",))
    with pytest.raises(KeyError):
        registry.get_formula("NDVI")
    registry.register_formula("double_nir", ("nir",), lambda n, k=2.0: n * k, {"k": 2.0})
    df = spark.createDataFrame([(0, 0, 0.25)], "row int, col int, nir double")
    assert registry.multiple_indices(df, ["double_nir", "ndvi"]).first()["double_nir"] == 0.5
    assert registry.multiple_indices(df, ["nonsense"]).columns == ["row", "col", "nonsense"]
    del registry._formulas["double_nir"]


def test_clip_and_normalise_edges(spark):
    df = spark.createDataFrame([(None,), (2.0,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(clip(F.col("x"), 0, 1)).collect()] == [None, 1.0, 0.0]
    flat = frame(spark, v=np.full((2, 2), 3.0))
    assert {r.normalised for r in scaling.normalise(flat, "v").collect()} == {0.0}
    holes = frame(spark, v=np.array([[np.nan, np.nan]]))
    assert {r.normalised for r in scaling.normalise(holes, "v").collect()} == {0.0}
    odd = spark.createDataFrame([(0, 0, float("inf")), (0, 1, 1.0), (0, 2, 3.0), (0, 3, float("nan"))], "row int, col int, v double")
    assert [r.normalised for r in scaling.normalise(odd, "v").orderBy("col").collect()] == [0.0, 0.0, 1.0, 0.0]
    assert stats.value_stats(holes, "v").first().asDict() == {"min": 0.0, "max": 1.0, "p_low": 0.0, "p_high": 1.0}


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_do_not_depend_on_blocks(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    mask = rng.random((30, 41)) < 0.55
    pixels = frame(spark, m=mask.astype(int)).where("m = 1")
    want = {}
    for p in zip(*np.nonzero(mask), strict=True):
        p = int(p[0]), int(p[1])
        if p not in want:
            part = flood(mask, p, connectivity)
            low = min(r * 41 + c for r, c in part)
            want |= {q: low for q in part}
    for block in (7, 16, 512):
        got = {(r.row, r.col): r.component for r in topology.components(pixels, 41, connectivity, block).collect()}
        assert got == want


def test_region_mask_rules(spark):
    v = np.zeros((6, 12))
    v[1:4, 1:4], v[1:4, 6:9], v[5, 0:12] = 1.0, 0.9, 0.8
    m = frame(spark, v=v)
    seeds = [Seed(2, 2), Seed(2, 7), Seed(1, 6, "neg"), Seed(0, 0), Seed(50, 50)]
    mask = grid_of(segmentation.region_mask(m, "v", 0.5, seeds, 12, block=4), "mask", 6, 12)
    assert mask.sum() == 9 and mask[1:4, 1:4].all()
    none = segmentation.region_mask(m, "v", 0.5, [Seed(0, 0)], 12)
    assert none.where("mask > 0").count() == 0


@pytest.mark.parametrize(("connectivity", "metric", "bands"), [(4, "euclidean", 1), (8, "manhattan", 2), (4, "chebyshev", 3)])
def test_growing_both_ways(spark, connectivity, metric, bands):
    rng = np.random.default_rng(bands)
    cube = rng.integers(0, 60, (bands, 14, 17))
    names = list(BANDS)[:bands]
    pixels = frame(spark, **dict(zip(names, cube, strict=True)))
    seeds = [Seed(3, 3), Seed(3, 4), Seed(10, 12), Seed(0, 16)]
    want = np.zeros((14, 17), int)
    for k, s in enumerate(seeds, 1):
        if want[s.row, s.col]:
            continue
        gap = np.abs(cube - cube[:, s.row, s.col][:, None, None]).astype(float)
        far = gap[0] if bands == 1 else {"euclidean": np.sqrt((gap**2).sum(0)), "manhattan": gap.sum(0), "chebyshev": gap.max(0)}[metric]
        for p in flood((far <= 35) & (want == 0), (s.row, s.col), connectivity):
            want[p] = k
    for block in (512, 6):
        result = segmentation.RegionGrowing(connectivity, 35.0, metric).grow(pixels, names, seeds, 14, 17, block)
        assert (grid_of(result.labels, "label", 14, 17) == want).all()
    sizes = {r["label"]: r["count"] for r in result.region_stats.collect()}
    assert sizes == {k: int((want == k).sum()) for k in np.unique(want) if k}
    with pytest.raises(ValueError):
        segmentation.RegionGrowing().grow(pixels, names, [Seed(99, 0)], 14, 17)
    with pytest.raises(ValueError):
        segmentation.RegionGrowing(spectral_distance_metric="cosine").grow(pixels, names, seeds, 14, 17)


def test_progressive(spark):
    rng = np.random.default_rng(2)
    v = rng.random((12, 20)) * 0.3
    v[2:7, 3:9] = 0.8 + rng.random((5, 6)) * 0.2
    m = frame(spark, v=v)
    sparse, info = segmentation.progressive(m, "v", 0.5, [Seed(3, 4), Seed(5, 5), Seed(9, 9)], 20)
    assert info["iterations"] == 0 and sparse.where("state > 0").count() == 0
    seeds = [Seed(r, c) for r in range(2, 5) for c in range(3, 8)] + [Seed(11, 19, "neg")]
    state, info = segmentation.progressive(m, "v", 0.5, seeds, 20)
    start = v[2:5, 3:8]
    first = min(max(start.mean() - 0.5 * start.std(), 0.1), 0.9)
    assert info["iterations"] >= 1 and info["pixels_segmented"] >= (v >= first).sum() > 0
    marks, info = segmentation.progressive(m, "v", 0.5, [Seed(0, 0, "neg")], 20)
    assert [(r.row, r.col, r.state) for r in marks.where("state > 0").collect()] == [(0, 0, 2)]
    out, info = segmentation.progressive_with_roi(m, "v", 0.5, seeds, 20, m.where("row < 8").select("row", "col"))
    assert out.where("row >= 8 and mask > 0").count() == 0 and out.where("row >= 8").select("a").distinct().first()[0] == 76
    clear, _ = segmentation.progressive_with_roi(m, "v", 0.5, seeds, 20)
    assert {(r.mask > 0, r.a) for r in clear.collect()} == {(True, 255), (False, 0)}


def test_projection_round_trips(spark):
    lon, lat = np.array([86.0, 87.3, 89.9]), np.array([27.0, -33.1, 61.4])
    for crs in ("EPSG:4326", "EPSG:3857", "EPSG:32645", "EPSG:32745"):
        x, y = projection.from_lonlat(crs, lon, lat)
        back = projection.to_lonlat(crs, x, y)
        assert np.allclose(back[0], lon, atol=1e-10) and np.allclose(back[1], lat, atol=1e-10)
        df = spark.createDataFrame(list(zip(lon.tolist(), lat.tolist(), strict=True)), "lon double, lat double")
        cx, cy = projection.from_lonlat(crs, F.col("lon"), F.col("lat"))
        got = df.select(cx.alias("x"), cy.alias("y")).toPandas()
        assert np.allclose(got["x"], x) and np.allclose(got["y"], y)
    x, y = projection.from_lonlat("EPSG:32645", np.array([87.0]), np.array([0.0]))
    assert abs(x[0] - 500000) < 1e-6 and abs(y[0]) < 1e-6
    # a degree on the central meridian from the equator: the meridian arc times 0.9996
    assert abs(projection.from_lonlat("EPSG:32645", np.array([87.0]), np.array([1.0]))[1][0] - 0.9996 * 110574.3886) < 0.01
    with pytest.raises(ValueError):
        projection.from_lonlat("EPSG:2056", lon, lat)


def test_tiles_and_polygons(spark):
    one = spark.createDataFrame([(163, 316, 10)], "x int, y int, z int")
    got = one.select(*roi.tile_bounds(F.col("x"), F.col("y"), F.col("z"))).first()
    assert np.allclose(tuple(got), (-13658379.710365232, 7631472.904072265, -13619243.95188281, 7670608.662554687))
    box = spark.createDataFrame([(-13413000.0, 4438000.0, -13358000.0, 4508000.0)], "left double, bottom double, right double, top double")
    tiles = {(r.x, r.y) for r in roi.bounds_to_tiles(box, F.lit(12)).collect()}
    assert tiles == {(x, y) for x in range(677, 683) for y in range(1587, 1595)}
    assert roi.bounds_to_tiles(box, F.lit(12), legacy=True).count() == 0
    ring = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]]
    pts = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0), (5.0, 1.0)], "x double, y double")
    assert [r[0] for r in pts.select(roi.inside_polygon(F.col("x"), F.col("y"), ring)).collect()] == [True, False, False]
    full = roi.clip_to_polygon(frame(spark, v=np.ones((4, 4))), ["v"], {"coordinates": [[[10, 10], [20, 10], [20, 20], [10, 20], [10, 10]]]}, 4, 4)
    assert full.where("v = 1").count() == 16
    assert roi.downsampled_shape(3791, 3180, 2048) == (2048, 1718) and roi.downsampled_shape(10, 5, 2048) == (10, 5)
    assert roi.split_seeds([Seed(1, 1), Seed(2, 2, "neg")]) == ([Seed(1, 1)], [Seed(2, 2, "neg")])
    with pytest.raises(ValueError):
        roi.parse_polygon('{"type": "Point", "coordinates": [1, 2]}')


def test_seed_parsing_in_crs(spark):
    g = {"features": [{"geometry": {"type": "Point", "coordinates": [633825 + 3 * 7.5, 3004017 - 3 * 2.5]}, "properties": {"label": None, "class": "pos"}}, {"geometry": {"type": "Point", "coordinates": [633825 + 4, 3004017 - 1]}, "properties": {"value": 0}}]}
    df = spark.createDataFrame([(json.dumps(g),)], "g string")
    got = [(r.row, r.col, r.kind) for r in roi.parse_seeds(df, "g", "crs", Affine(3, 0, 633825, 0, -3, 3004017)).collect()]
    assert got == [(0, 1, "neg")]  # a label that is there but null counts, and matches nothing


def test_resampling(spark):
    v = np.arange(48).reshape(6, 8)
    small = grid_of(resample.downsample_average(frame(spark, v=v), ["v"], (6, 8), (3, 4), None, False), "v", 3, 4)
    assert np.allclose(small, v.reshape(3, 2, 4, 2).mean((1, 3)))
    near = grid_of(resample.downsample_nearest(frame(spark, v=v), (6, 8), (4, 3)), "v", 4, 3)
    rows, cols = ((np.arange(4) + 0.5) * 6 / 4).astype(int), ((np.arange(3) + 0.5) * 8 / 3).astype(int)
    assert (near == v[rows][:, cols]).all()
    raster = Raster("r", 8, 6, Affine(1, 0, 0, 0, -1, 6), "EPSG:4326")
    same = resample.warp(frame(spark, v=v), raster, roi.Bounds(0, 0, 8, 6), 6, 8)
    assert (grid_of(same, "v", 6, 8) == v).all()
    smooth = resample.warp(frame(spark, v=v), raster, roi.Bounds(0, 0, 8, 6), 6, 8, bilinear=True)
    assert np.allclose(grid_of(smooth, "v", 6, 8), v)
    beside = resample.warp(frame(spark, v=v + 1), raster, roi.Bounds(-8, 0, 0, 6), 6, 8)
    assert beside.where("v <> 0").count() == 0


def test_ramps(spark):
    v = np.array([[0.0, 0.25, 0.5, 1.0, np.nan, 2.0]])
    out = symbology.apply_stops(frame(spark, v=v), "v", symbology.RAMPS["diverging"][1], F.max(F.lit(0.0)), F.max(F.lit(1.0))).orderBy("col").collect()
    assert [tuple(r)[3:] for r in out] == [(11, 79, 108, 255), (127, 160, 170, 255), (244, 241, 233, 255), (216, 87, 42, 255), (0, 0, 0, 0), (216, 87, 42, 255)]
    hidden = symbology.apply_stops(frame(spark, v=v), "v", symbology.RAMPS["mask"][1], F.max(F.lit(0.0)), F.max(F.lit(1.0)), True).orderBy("col").first()
    assert hidden.a == 0 and symbology.Stop(1.0, "#f26522", 0.9).rgba() == (242, 101, 34, 229)
    with pytest.raises(ValueError):
        symbology.ramp_channels(F.lit(0.5), [])
    assert len(symbology.STYLES) == 28 and symbology.style_of("gli") == symbology.Style()


def newton_logistic(x, y, weights):
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        g = w + x.T @ (weights * (p - y))
        w -= np.linalg.solve(np.eye(len(w)) + (x * (weights * p * (1 - p))[:, None]).T @ x, g)
    return w


def test_logistic_with_penalised_intercept(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(160, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=160) > 0.7).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, label int")
    coef, intercept = training.fit_logistic(df, ["a", "b"])
    counts = np.bincount(y)
    want = newton_logistic(x, y, np.where(y == 1, 80 / counts[1], 80 / counts[0]))
    assert np.allclose([*coef, intercept], want, atol=1e-5)
    assert abs(sum(training.importance(coef)) - 1) < 1e-6


def test_training(spark):
    rng = np.random.default_rng(3)
    a = rng.random((20, 20))
    maps = frame(spark, good=a, bad=rng.random((20, 20)), gone=np.full((20, 20), np.nan), mask=(a > 0.6).astype(int))
    pid = (F.col("row") * 20 + F.col("col")).cast("bigint")
    result = training.learn_formula(maps, ["good", "bad", "gone"], "mask", pid, 3)
    assert result["index_names"] == ["good", "bad"] and result["best_index"] == "good"
    assert result["best_single_iou"] > 0.9 and result["mean_cv_auc"] > 0.95
    best = next(s for s in result["per_index_scores"] if s["name"] == "good")
    assert 0.45 < best["suggested_threshold"] < 0.75 and 0 < best["suggested_threshold_normalized"] < 1
    assert [r.name for r in training.ranking(spark, result).collect()][0] == "good"
    assert "warning" in training.learn_formula(maps.where("row < 3"), ["good"], "mask", pid)
    assert "warning" in training.learn_formula(maps.withColumn("mask", F.lit(0)), ["good"], "mask", pid)
    fold = training.kfold_iou(maps.withColumn("label", F.col("mask")), ["good"], pid, k=2)
    assert fold["n_splits"] == 2 and fold["mean_iou"] > 0.85
    assert training.kfold_iou(maps.withColumn("label", F.lit(1)), ["good"], pid)["n_splits"] == 0


def test_geotiff_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    cube = rng.integers(0, 9000, (8, 37, 29)).astype("u2")
    raster = Raster("r", 29, 37, Affine(3.0, 0.0, 633825.0, 0.0, -3.0, 3004017.0), "EPSG:32645", 0.0, tuple(BANDS))
    for k, (compress, predictor) in enumerate([("none", False), ("lzw", True), ("deflate", True)]):
        (tmp_path / f"r{k}.tif").write_bytes(tiff.encode_tiff(cube, raster, compress, 16, predictor, overviews=1))
    heads = rasters.catalog(spark, f"file://{tmp_path}").collect()
    assert len(heads) == 3 and {(h.width, h.height, h["count"], h.crs, h.nodata, h.dtype) for h in heads} == {(29, 37, 8, "EPSG:32645", 0.0, "uint16")}
    read = rasters.scan(spark, f"file://{tmp_path}", ["nir", "red"])
    one = read.where("raster_id = 'r1.tif'")
    assert (rasters.to_arrays(one, ["nir", "red"], 37, 29) == cube[[7, 5]]).all() and read.count() == 3 * 37 * 29
    with pytest.raises(Exception, match="Band not found"):
        rasters.scan(spark, f"file://{tmp_path}", ["swir"]).count()
    spark.dataSource.register(rasters.TiffDataSource)
    part = spark.read.format("bandloom_tiff").option("path", str(tmp_path / "r2.tif")).option("bands", "green").option("window", "5,3,20,25").load()
    assert part.count() == 15 * 22 and {(r.row, r.col, r.green) for r in part.collect()} == {(r, c, float(cube[3, r, c])) for r in range(5, 20) for c in range(3, 25)}
    rasters.write_geotiff(one, "nir", raster, str(tmp_path / "out.tif"))
    assert (tiff.read_window((tmp_path / "out.tif").read_bytes(), 0, 0, 37, 29)[0] == cube[7]).all()
    near = tiff.read_window((tmp_path / "r0.tif").read_bytes(), 0, 0, 36, 28, [1, 2], (9, 7))
    assert (near == cube[:2, 2:36:4, 2:28:4]).all()
    rasters.write_pyramid(one.drop("raster_id"), ["nir"], f"file://{tmp_path}/pyramid", (1, 2, 4))
    level = rasters.read_pyramid(spark, f"file://{tmp_path}/pyramid", 2, (0, 0, 5, 5))
    assert level.count() == 25 and abs(level.where("row = 1 and col = 2").first()["nir"] - cube[7, 2:4, 4:6].mean()) < 1e-9


def test_sidecar_and_paths(spark, tmp_path):
    report = {"files": [{"path": "C:\\data\\A.TIF", "band_index_by_name": {"Red": 6, "nir": 8}}]}
    (tmp_path / "report.json").write_text(json.dumps(report, indent=1))
    assert rasters.bands_of(spark, f"file://{tmp_path}/report.json", "/x/a.tif") == {"red": 6, "nir": 8}
    with pytest.raises(FileNotFoundError):
        rasters.bands_of(spark, f"file://{tmp_path}/report.json", "/x/b.tif")
    saved = rasters.ingest(b"x", "../../evil.tif", str(tmp_path))
    assert saved == str(tmp_path / "evil.tif") and rasters.resolve_path("evil.tif", [str(tmp_path)]) == saved
    with pytest.raises(ValueError):
        rasters.ingest(b"x", "..", str(tmp_path))


def test_caches():
    cache = TileCache(0.001)
    for k in range(5):
        cache.put(str(k), bytes(400))
    cache.put("4", bytes(500))
    assert cache.get("0") is None and cache.get("4") is not None and cache.stats()["items"] == 2
    assert abs(cache.size - 900) < 1
    assert tile_key("r", 1, 2, 3) != tile_key("r", 1, 2, 3, [Seed(1, 1)]) != tile_key("q", 1, 2, 3, [Seed(1, 1)])
    index = IndexCache()
    index.begin("r", 2)
    index.put("r", "b", None)
    index.fail("r", "a", "no")
    assert index.status("r") == {"total": 2, "done": 2, "ready": ["b"], "errors": {"a": "no"}, "finished": True}
    index.clear_for("r")
    assert index.status("r")["total"] == 0


def test_engine(spark, tmp_path):
    rng = random.Random(1)
    cube = np.array([[[rng.randrange(500, 3000) for _ in range(24)] for _ in range(18)] for _ in range(8)], "u2")
    cube[7, 3:9, 4:12] = 9000
    cube[:, 0, 0] = 0
    raster = Raster("field", 24, 18, Affine(3.0, 0.0, 633825.0, 0.0, -3.0, 3004017.0), "EPSG:32645", 0.0, tuple(BANDS))
    (tmp_path / "field.tif").write_bytes(tiff.encode_tiff(cube, raster, "deflate", 16))
    engine = Engine(spark, [str(tmp_path)])
    with pytest.raises(ValueError, match="no raster"):
        engine.metadata()
    meta = engine.load("field.tif")
    assert meta["width"] == 24 and 88 < meta["bounds_wgs84"][0] < 89 and engine.health()["raster"] == "field.tif"
    status = engine.precompute()
    assert status["finished"] and len(status["ready"]) == 26
    values, grid = engine.index_map("ndvi", 12)
    assert (grid.width, grid.height) == (12, 9)
    picture = png.decode_png(engine.render(RenderRequest("ndvi", max_size=40)))
    assert max(picture.shape[:2]) == 40 and picture[..., 3].max() == 255
    assert png.decode_png(engine.render(RenderRequest(band=8, max_size=30))).shape[2] == 4
    with pytest.raises(ValueError):
        engine.render(RenderRequest(band=9))
    assert png.decode_png(engine.preview(32))[..., 3].max() == 255
    seeds = [Seed(5, 6), Seed(15, 20, "neg")]
    mask = engine.segment(IndexRequest("ndvi", 0.6, seeds))
    assert mask.where("mask = 1").count() >= 40
    assert png.decode_png(engine.segment_picture(IndexRequest("ndvi", 0.6, seeds, 32))).max() > 0
    for bad in ([], [Seed(1, 1, "neg")]):
        with pytest.raises(ValueError):
            engine.segment(IndexRequest("ndvi", 0.5, bad))
    lon, lat = engine.pixel_to_lonlat(9, 12)
    assert engine.lonlat_to_pixel(lon + 1e-7, lat - 1e-7) == (9, 12)
    z = 17
    x = int((lon + 180) / 360 * 2**z)
    y = int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 2**z)
    tile = engine.tile(z, x, y)
    assert png.decode_png(tile).shape == (256, 256, 4) and engine.tile(z, x, y) == tile and engine.tile_cache_stats()["hits"] == 1
    assert engine.tile(z, x + 500, y) == png.empty_png()
    assert png.decode_png(engine.tile(z, x, y, [Seed(128, 128)])).shape == (256, 256, 4)
    result = engine.train(["ndvi", "gli"], seeds, 0.6, 2)
    assert result["best_index"] == "ndvi" and engine.ranking(result).count() == 2
    out, info = engine.segment_progressive(IndexRequest("ndvi", 0.5, [Seed(r, c) for r in range(3, 8) for c in range(4, 10)]))
    assert info["pixels_segmented"] > 0 and out.count() == 18 * 24
    engine.register_views()
    assert spark.sql("SELECT count(*) FROM pixels WHERE nir >= 9000").first()[0] == 48


def test_percentiles_of_large_tables_are_the_same(spark):
    import random

    from bandloom.operators.stats import percentile_row

    rng = random.Random(1)
    rows = [(rng.choice([None, float(rng.randint(0, 30)), rng.random()]), None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double")
    values = {"a": F.col("a"), "twice": F.col("a") * 2, "none": F.col("b")}
    fractions = [0.0, 0.02, 0.25, 0.5, 0.333, 0.98, 1.0]
    small, large = (percentile_row(df, values, fractions, small=s).first() for s in (1 << 62, -1))
    want = df.agg(F.percentile("a", F.array(*[F.lit(f) for f in fractions]))).first()[0]
    assert large["none"] is None and small["none"] is None
    assert large["a"] == pytest.approx(want, abs=1e-12) and large["twice"] == pytest.approx([2 * x for x in want], abs=1e-12)


def test_masks_in_one_task_and_by_blocks(spark):
    import random

    from bandloom.model import Seed
    from bandloom.operators.segmentation import region_mask
    from bandloom.operators.topology import components

    rng = random.Random(2)
    df = spark.createDataFrame([(r, c, rng.random()) for r in range(40) for c in range(30)], "row int, col int, v double")
    seeds = [Seed(r, r % 30, "neg" if r % 9 == 0 else "pos") for r in range(0, 40, 3)] + [Seed(500, 1)]
    one = {tuple(r) for r in region_mask(df, "v", 0.5, seeds, 30, height=40).collect()}
    assert one == {tuple(r) for r in region_mask(df, "v", 0.5, seeds, 30, block=16).collect()} and 0 < sum(m for _, _, m in one) < 1200
    near = df.where("v > 0.4")
    assert sorted(components(near, 30, 8, height=40).collect()) == sorted(components(near, 30, 8, block=8).collect())
