"""All map tiles of a raster for a range of zooms, in one job.

Tiles are listed by arithmetic, and a tile's pixels are exploded beside the data, not on the
driver.  The source pixels around each come by an equi-join of computed keys, and one shuffle by
tile brings a tile's pixels (65,536 at most, four corners each) to the task that draws it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.model import Raster
from bandloom.operators import roi
from bandloom.operators.projection import transform_bounds
from bandloom.operators.resample import corners, places_at
from bandloom.sources.png import TILE, encode_png

LOW, HIGH = 2.0, 98.0
#: Tiles whose pixels one task lists.
TILES_A_TASK = 8


def tile_list(spark: SparkSession, raster: Raster, zooms: list[int]) -> DataFrame:
    """(z, x, y) of the tiles that the raster's bounds meet."""
    box = transform_bounds(raster.crs, "EPSG:3857", raster.bounds)
    boxes = spark.createDataFrame([(z, *box) for z in sorted(set(zooms))], "zoom int, left double, bottom double, right double, top double")
    return roi.bounds_to_tiles(boxes, F.col("zoom")).select("z", "x", "y")


def tile_corners(pixels: DataFrame, raster: Raster, tiles: DataFrame, bands: list[str]) -> DataFrame:
    """(z, x, y, row, col, _w, bands): the source pixels around each tile pixel that are there, with bilinear weights."""
    places = F.sequence(F.lit(0), F.lit(TILE - 1))
    # a tile's rows and columns come after the shuffle, which deals out bare (z, x, y); a number of parts keeps them apart
    each = tiles.repartition(-(-tiles.count() // TILES_A_TASK) or 1, "z", "x", "y").withColumn("row", F.explode(places)).withColumn("col", F.explode(places))
    side = F.lit(2 * roi.RENDER_ORIGIN) / F.pow(F.lit(2.0), F.col("z"))
    gx = F.col("x") * side - roi.RENDER_ORIGIN + (F.col("col") + 0.5) * (side / TILE)
    gy = F.lit(roi.RENDER_ORIGIN) - F.col("y") * side - (F.col("row") + 0.5) * (side / TILE)
    placed = places_at(each, gx, gy, "EPSG:3857", raster)
    inside = placed.where((F.col("_r") > -1) & (F.col("_r") < raster.height + 1) & (F.col("_c") > -1) & (F.col("_c") < raster.width + 1))
    keyed = inside.withColumn("k", F.explode(corners())).select("z", "x", "y", "row", "col", "k.*")
    source = pixels.select(F.col("row").alias("_sr"), F.col("col").alias("_sc"), *bands)
    # the optimiser takes tiles for small, since it doesn't count what is exploded: neither side may be broadcast
    return keyed.hint("merge").join(source.hint("merge"), ["_sr", "_sc"]).drop("_sr", "_sc")


def _stretched(value: np.ndarray) -> np.ndarray:
    """0..255 between the percentiles of the values over 0, truncated; clipped where these coincide."""
    some = value[value > 0]
    low, high = np.percentile(some, [LOW, HIGH]) if len(some) else (0.0, 0.0)
    out = (value - low) / (high - low) * 255.0 if high > low else value
    return np.clip(out, 0, 255).astype(np.uint8)


def tile_matrix(pixels: DataFrame, raster: Raster, zooms: list[int], bands: list[str]) -> DataFrame:
    """(z, x, y, png) of every tile that the raster meets: bilinear, each tile stretched by itself.

    The first three bands are the colours, one band is grey; a pixel is opaque where a band is over 0.
    Tiles without a single source pixel have no row.
    """
    three = [0, min(1, len(bands) - 1), 2 if len(bands) > 2 else 0]

    def draw(table: pa.Table) -> pa.Table:
        at = table.column("row").to_numpy().astype(np.int64) * TILE + table.column("col").to_numpy()
        weight = table.column("_w").to_numpy()
        values = np.zeros((len(bands), TILE * TILE))
        for k in range(len(bands)):
            v = table.column(f"b{k}").to_numpy(zero_copy_only=False).astype(float)
            there = ~np.isnan(v)
            total = np.bincount(at[there], weight[there], TILE * TILE)
            sums = np.bincount(at[there], weight[there] * v[there], TILE * TILE)
            values[k] = np.where(total > 0, sums / np.where(total > 0, total, 1), 0)
        rgba = np.zeros((TILE * TILE, 4), np.uint8)
        for c, k in enumerate(three):
            rgba[:, c] = _stretched(values[k])
        rgba[:, 3] = np.where((values > 0).any(0), 255, 0)
        key = {c: table.column(c)[:1] for c in ("z", "x", "y")}
        return pa.table({**key, "png": pa.array([encode_png(rgba.reshape(TILE, TILE, 4))], pa.binary())})

    near = tile_corners(pixels.select("row", "col", *[F.col(b).alias(f"b{k}") for k, b in enumerate(bands)]), raster, tile_list(pixels.sparkSession, raster, zooms), [f"b{k}" for k in range(len(bands))])
    return near.groupBy("z", "x", "y").applyInArrow(draw, "z int, x int, y int, png binary")
