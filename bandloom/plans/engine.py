"""One object for a loaded raster: metadata, indices, pictures, segmentation, training.

Arguments are checked here (ValueError); everything else is a composition of operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.model import Raster, Seed, Segmentation
from bandloom.operators import layers, resample, roi, scaling, segmentation, stats, symbology, tiles, topology, training
from bandloom.operators.projection import from_lonlat, to_lonlat, transform_bounds
from bandloom.plans import registry
from bandloom.plans.cache import IndexCache, TileCache, tile_key
from bandloom.sources import png, rasters
from bandloom.storage import materialise

PREVIEW_SIDE = 2048
TILE_SEGMENT = segmentation.RegionGrowing(4, 20.0)


@dataclass
class IndexRequest:
    index_name: str = "ndvi"
    threshold: float = 0.5
    seeds: list[Seed] = field(default_factory=list)
    max_size: int = PREVIEW_SIDE
    max_iterations: int = 10
    roi_dimming: float = 0.3


@dataclass
class RenderRequest:
    index_name: str = "ndvi"
    band: int | None = None
    ramp: str | None = None
    range_mode: str = "auto"
    range_min: float | None = None
    range_max: float | None = None
    custom_ramp: list[symbology.Stop] | None = None
    max_size: int = PREVIEW_SIDE


class Engine:
    def __init__(self, spark: SparkSession, folders: list[str] = (), cache_mb: float = 500):
        self.spark, self.folders = spark, list(folders)
        self.tiles, self.indices = TileCache(cache_mb), IndexCache()
        self.raster: Raster | None = None
        self.pixels: DataFrame | None = None

    # loading

    def load(self, path: str) -> dict:
        """Load a file: a local one, looked for in the folders too, or any URL that Spark opens.

        Caches of the raster before are cleared.
        """
        path = path if "://" in path or path.startswith("file:") else rasters.resolve_path(path, self.folders)
        raster = rasters.header(self.spark, path)
        bands = [d.lower() or f"band_{k + 1}" for k, d in enumerate(raster.descriptions)]
        pixels = rasters.scan(self.spark, path, bands).drop("raster_id")
        return self.use(raster, materialise(pixels, "raster"))

    def use(self, raster: Raster, pixels: DataFrame) -> dict:
        """Take pixels (row, col, bands) that are a DataFrame already."""
        if self.raster is not None:
            self.indices.clear_for(self.raster.raster_id)
        self.tiles.clear()
        self.raster, self.pixels = raster, pixels
        return self.metadata()

    def upload(self, data: bytes, name: str) -> dict:
        return self.load(rasters.ingest(data, name, self.folders[0]))

    def _need(self) -> tuple[Raster, DataFrame]:
        if self.raster is None:
            raise ValueError("no raster is loaded")
        return self.raster, self.pixels

    # catalog

    def health(self) -> dict:
        return {"status": "ok", "raster": self.raster.raster_id if self.raster else None}

    def metadata(self) -> dict:
        raster, _ = self._need()
        out = rasters.as_dict(raster)
        try:
            out["bounds_wgs84"] = transform_bounds(raster.crs, "EPSG:4326", raster.bounds)
        except ValueError:
            out["bounds_wgs84"] = raster.bounds
        return out

    def formulas(self) -> DataFrame:
        return registry.catalog(self.spark)

    def ramps(self) -> DataFrame:
        return symbology.ramp_catalog(self.spark)

    def tile_cache_stats(self) -> dict:
        return self.tiles.stats()

    def clear_cache(self) -> None:
        self.tiles.clear()

    def index_status(self) -> dict:
        return self.indices.status(self._need()[0].raster_id)

    def register_views(self) -> None:
        """Pixels, formulas and ramps as views for SQL."""
        self._need()[1].createOrReplaceTempView("pixels")
        self.formulas().createOrReplaceTempView("formulas")
        self.ramps().createOrReplaceTempView("ramps")

    # maps

    def _preview(self, bands: list[str], longest: int) -> tuple[DataFrame, Raster]:
        """Bands on a grid of at most ``longest`` pixels a side, averaged, with the raster's new header."""
        raster, pixels = self._need()
        w, h = roi.downsampled_shape(raster.width, raster.height, longest)
        if (w, h) == (raster.width, raster.height):
            return pixels.select("row", "col", *bands), raster
        small = resample.downsample_average(pixels.select("row", "col", *bands), bands, (raster.height, raster.width), (h, w), raster.nodata, raster.dtype[0] in "ui")
        return small, Raster(raster.raster_id, w, h, raster.transform.scaled(raster.width / w, raster.height / h), raster.crs, raster.nodata, raster.descriptions, raster.dtype, raster.path)

    def index_map(self, name: str, longest: int | None = None) -> tuple[DataFrame, Raster]:
        """(row, col, name) and the header of its grid; a precomputed map if there is one."""
        raster, _ = self._need()
        formula = registry.get_formula(name)
        bands = sorted(set(formula.bands()))
        pixels, grid = self._preview(bands, longest) if longest else (self.pixels.select("row", "col", *bands), raster)
        ready = self.indices.get(raster.raster_id, name) if longest else None
        if ready is not None:
            return ready, grid
        return scaling.scale_reflectance(pixels, bands, raster.nodata).select("row", "col", formula.column().alias(name)), grid

    def precompute(self, longest: int | None = None) -> dict:
        """All formulas without parameters in one projection over one scan, written once, on a grid of ``longest`` (``PREVIEW_SIDE``) pixels a side."""
        raster, pixels = self._need()
        have = set(pixels.columns)
        names = [n for n in registry.ready_names() if set(registry.get_formula(n).bands()) <= have]
        self.indices.begin(raster.raster_id, len(registry.ready_names()))
        bands = sorted({b for n in names for b in registry.get_formula(n).bands()})
        small, _ = self._preview(bands, longest or PREVIEW_SIDE)
        table = materialise(registry.add_indices(scaling.scale_reflectance(small, bands, raster.nodata), names), "indices")
        for n in registry.ready_names():
            if n in names:
                self.indices.put(raster.raster_id, n, table)
            else:
                self.indices.fail(raster.raster_id, n, "a band is missing")
        return self.index_status()

    # pictures

    def _on_degrees(self, coloured: DataFrame, grid: Raster, longest: int) -> tuple[DataFrame, int, int]:
        """Colours (row, col, r, g, b, a) on a grid of degrees, its height and width."""
        box = roi.Bounds(*transform_bounds(grid.crs, "EPSG:4326", grid.bounds))
        width, height = roi.warp_shape(box, longest)
        return resample.warp(coloured.select("row", "col", *"rgba"), grid, box, height, width), height, width

    def _rendered(self, request: RenderRequest) -> tuple[DataFrame, int, int]:
        raster, pixels = self._need()
        if request.band is not None:
            if not 1 <= request.band <= len(raster.descriptions):
                raise ValueError(f"band {request.band} of {len(raster.descriptions)}")
            name = [c for c in pixels.columns if c not in ("row", "col")][request.band - 1]
            small, grid = self._preview([name], request.max_size)
            values, index = small.select("row", "col", scaling.null_band(F.col(name), raster.nodata).alias("v")), None
            mode, ramp, name = request.range_mode if request.range_mode != "auto" else "percentile", request.ramp or "sequential", "v"
        else:
            name = index = request.index_name
            values, grid = self.index_map(name, request.max_size)
            mode, ramp = request.range_mode, request.ramp
        coloured = symbology.render(values, name, index, ramp, mode, (request.range_min, request.range_max), request.custom_ramp)
        return self._on_degrees(coloured, grid, request.max_size)

    def render(self, request: RenderRequest) -> bytes:
        """An index, or a band by its number from 1, in colours."""
        return png.picture(*self._rendered(request))

    def render_strips(self, request: RenderRequest) -> tuple[DataFrame, int]:
        """What ``render`` draws, at any size: the strips of ``png.strips``, and the picture's width."""
        drawn = self._rendered(request)
        return png.strips(*drawn), drawn[2]

    def _previewed(self, max_size: int) -> tuple[DataFrame, int, int]:
        raster, pixels = self._need()
        bands = [c for c in pixels.columns if c not in ("row", "col")][:3]
        box = roi.Bounds(*transform_bounds(raster.crs, "EPSG:4326", raster.bounds))
        width, height = roi.warp_shape(box, max_size)
        warped = materialise(resample.warp(pixels.select("row", "col", *bands), raster, box, height, width, bilinear=True), "preview")
        return self._true_colour(warped, bands), height, width

    def preview(self, max_size: int = 1024) -> bytes:
        """The first three bands (or one as grey), bilinear, stretched between percentiles 2 and 98."""
        return png.picture(*self._previewed(max_size))

    def preview_strips(self, max_size: int = 1024) -> tuple[DataFrame, int]:
        """What ``preview`` draws, at any size: the strips of ``png.strips``, and the picture's width."""
        drawn = self._previewed(max_size)
        return png.strips(*drawn), drawn[2]

    def tile_matrix(self, zooms: list[int]) -> DataFrame:
        """(z, x, y, png): all tiles of the raster at these zooms, by one job."""
        raster, pixels = self._need()
        return tiles.tile_matrix(pixels, raster, zooms, [c for c in pixels.columns if c not in ("row", "col")][:3])

    def _true_colour(self, values: DataFrame, bands: list[str]) -> DataFrame:
        three = [bands[0], bands[min(1, len(bands) - 1)], bands[2] if len(bands) > 2 else bands[0]]
        named = values.select("row", "col", *[F.col(b).alias(c) for b, c in zip(three, "rgb", strict=True)], F.when(sum((F.when(F.col(b) > 0, 1).otherwise(0) for b in bands), F.lit(0)) > 0, 255).otherwise(0).alias("a"))
        return named.drop(*"rgb").join(stats.stretch(named.select("row", "col", *"rgb"), list("rgb")), ["row", "col"])

    def tile(self, z: int, x: int, y: int, seeds: list[Seed] = ()) -> bytes:
        """A tile of 256 pixels in Web Mercator; with seeds (in tile pixels) the borders of their regions in red."""
        raster, pixels = self._need()
        key = tile_key(raster.raster_id, z, x, y, list(seeds))
        found = self.tiles.get(key)
        if found is None:
            box = roi.render_bounds(x, y, z)
            mine = roi.Bounds(*transform_bounds(raster.crs, "EPSG:3857", raster.bounds))
            found = png.empty_png() if box.disjoint(mine) else self._draw_tile(box, list(seeds))
            self.tiles.put(key, found)
        return found

    def _draw_tile(self, box: roi.Bounds, seeds: list[Seed]) -> bytes:
        raster, pixels = self._need()
        side = png.TILE
        bands = [c for c in pixels.columns if c not in ("row", "col")][:3]
        left, bottom, right, top = transform_bounds("EPSG:3857", raster.crs, (box.left, box.bottom, box.right, box.top))
        r0, c0, r1, c1 = roi.Bounds(left, bottom, right, top).to_window(raster.transform)
        near = roi.window(pixels, int(r0) - 1, int(c0) - 1, int(r1) + 2, int(c1) + 2)
        warped = materialise(resample.warp(near.select("row", "col", *bands), raster, box, side, side, "EPSG:3857", bilinear=True), "tile")
        coloured = self._true_colour(warped, bands)
        if seeds:
            labels = TILE_SEGMENT.grow(warped, bands[:1], seeds, side, side).labels
            edges = topology.rising_edges(labels).where("edge").select("row", "col", F.lit(1).alias("_e"))
            red = lambda c, v: F.when(F.col("_e").isNotNull(), F.lit(v)).otherwise(F.col(c)).alias(c)
            coloured = coloured.join(edges, ["row", "col"], "left").select("row", "col", red("r", 255), red("g", 50), red("b", 50), red("a", 255))
        return bytes(png.images(coloured, side, side).first()["png"])

    # segmentation

    def _check_seeds(self, seeds: list[Seed]) -> None:
        if not seeds:
            raise ValueError("at least one seed is needed")
        if not any(s.kind == "pos" for s in seeds):
            raise ValueError("at least one positive seed is needed")

    def segment(self, request: IndexRequest) -> DataFrame:
        """(row, col, mask) at full resolution."""
        self._check_seeds(request.seeds)
        values, grid = self.index_map(request.index_name)
        return segmentation.region_mask(values, request.index_name, request.threshold, request.seeds, grid.width, height=grid.height)

    def segment_picture(self, request: IndexRequest) -> bytes:
        mask = materialise(self.segment(request), "mask")
        low, high = F.max(F.lit(0.0)), F.max(F.lit(1.0))
        return png.picture(*self._on_degrees(symbology.apply_stops(mask, "mask", symbology.RAMPS["mask"][1], low, high, True), self._need()[0], request.max_size))

    def segment_progressive(self, request: IndexRequest, region: DataFrame | None = None) -> tuple[DataFrame, dict]:
        self._check_seeds(request.seeds)
        values, grid = self.index_map(request.index_name)
        return segmentation.progressive_with_roi(values, request.index_name, request.threshold, request.seeds, grid.width, region, request.roi_dimming, request.max_iterations)

    def grow(self, bands: list[str], seeds: list[Seed], connectivity: int = 4, threshold: float = 20.0, metric: str = "euclidean") -> Segmentation:
        raster, pixels = self._need()
        return segmentation.RegionGrowing(connectivity, threshold, metric).grow(pixels, bands, seeds, raster.height, raster.width)

    # training

    def train(self, names: list[str], seeds: list[Seed], threshold: float = 0.5, k_folds: int = 5) -> dict:
        """Rank the indices by how well they tell the mask of the first one.

        With one class only, the threshold with the best balance among 19 others is taken, then
        a disc of radius 2 around positive seeds; if that has one class too, ValueError.
        """
        self._check_seeds(seeds)
        raster, pixels = self._need()
        known = [n for n in names if n in registry.formula_names()]
        if not known:
            raise ValueError("none of the indices is known")
        maps, grid = self._training_maps(known)
        seeds = [Seed(min(grid.height - 1, max(0, int(s.row * (grid.height / raster.height)))), min(grid.width - 1, max(0, int(s.col * (grid.width / raster.width)))), s.kind) for s in seeds] if grid is not raster else seeds
        raster = grid
        total = raster.width * raster.height
        mask = materialise(segmentation.region_mask(maps, known[0], threshold, seeds, raster.width, height=raster.height), "training-mask")
        if not 0 < mask.where("mask = 1").count() < total:
            tried = list(dict.fromkeys(round(t, 4) for t in [threshold, *(0.05 + 0.05 * k for k in range(19))]))
            depths, steps = layers.sweep(maps, known[0], tried, seeds, raster.width)
            depths = materialise(depths, "training-sweep")
            on = layers.balances(depths, steps)
            # of equal balances the one tried first
            choice = max(tried, key=lambda t: (min(on[t], total - on[t]), -tried.index(t)))
            k = steps.index(choice)
            mask = depths.select("row", "col", ((F.col("pos") > k) & (F.col("neg") <= k)).cast("tinyint").alias("mask")) if 0 < on[choice] < total else None
        if mask is None:
            frame = segmentation.seed_frame(self.spark, seeds)
            disc = topology.dilate(frame.where("kind = 'pos'").select("row", "col"), 2, raster.height, raster.width, frame.where("kind = 'neg'"))
            mask = maps.select("row", "col").join(disc.withColumn("_k", F.lit(1)), ["row", "col"], "left").select("row", "col", F.coalesce("_k", F.lit(0)).alias("mask"))
            if mask.select("mask").distinct().count() < 2:
                raise ValueError("the seeds give a mask of one class")
        pid = (F.col("row").cast("bigint") * raster.width + F.col("col")).cast("bigint")
        return training.learn_formula(maps.join(mask, ["row", "col"]), known, "mask", pid, k_folds)

    def _training_maps(self, names: list[str]) -> tuple[DataFrame, Raster]:
        """(row, col, names) and its grid: full resolution, or that of the precomputed maps if there are any.

        Maps that were not precomputed are then computed at full resolution and laid on that grid."""
        raster, pixels = self._need()
        ready = {n: self.indices.get(raster.raster_id, n) for n in names}
        ready = {n: m for n, m in ready.items() if m is not None}
        missing = [n for n in names if n not in ready]
        bands = sorted({b for n in missing for b in registry.get_formula(n).bands()})
        computed = registry.add_indices(scaling.scale_reflectance(pixels.select("row", "col", *bands), bands, raster.nodata), missing) if missing else None
        if not ready:
            return materialise(computed, "training-maps"), raster
        w, h = roi.downsampled_shape(raster.width, raster.height, PREVIEW_SIDE)
        out = None
        if computed is not None:
            full = computed.select("row", "col", *missing)
            out = full if (w, h) == (raster.width, raster.height) else resample.resize_bilinear(full, missing, (raster.height, raster.width), (h, w))
        for one in ready.values():
            out = one if out is None else out.join(one, ["row", "col"])
        grid = raster if (w, h) == (raster.width, raster.height) else Raster(raster.raster_id, w, h, raster.transform.scaled(raster.width / w, raster.height / h), raster.crs, raster.nodata, raster.descriptions, raster.dtype, raster.path)
        return materialise(out.select("row", "col", *names), "training-maps"), grid

    def ranking(self, result: dict) -> DataFrame:
        return training.ranking(self.spark, result)

    # places

    def lonlat_to_pixel(self, lon: float, lat: float) -> tuple[int, int]:
        raster, _ = self._need()
        x, y = from_lonlat(raster.crs, lon, lat)
        row, col = raster.transform.to_pixel(x, y)
        return int(row), int(col)

    def pixel_to_lonlat(self, row: int, col: int) -> tuple[float, float]:
        raster, _ = self._need()
        lon, lat = to_lonlat(raster.crs, *raster.transform.to_geo(row, col))
        return float(lon), float(lat)
