"""Queries over files: rasters written by tasks and read by ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandloom.plans.raster_queries import PIX, query
from bandloom.sources import rasters, tiled
from bandloom.sources.tables import order_pixels, order_raster
from bandloom.storage import new_path


@query(f"WITH {PIX} SELECT row, col, CAST(nir AS DOUBLE) AS nir, CAST(red AS DOUBLE) AS red FROM pixels WHERE row >= 3 AND row < 11 AND col >= 17 AND col < 70")
def tiff_window(spark, sf_dir):
    """A window of a tiled file; blocks outside aren't read."""
    path = new_path(spark, "window") + ".tif"
    tiled.write_tiled(order_pixels(spark, sf_dir, ["nir", "red"]), ["nir", "red"], _raster(spark, sf_dir, ("nir", "red")), path, "uint16", tile=16)
    return rasters.scan(spark, path, ["nir", "red"], (3, 17, 11, 70)).drop("raster_id")


@query(
    f"WITH {PIX}, l AS (SELECT unnest([0, 1, 2, 3]) AS level) SELECT CAST(level AS INTEGER) AS level, CAST(row // (1 << level) AS INTEGER) AS row, CAST(col // (1 << level) AS INTEGER) AS col, "
    "coalesce(round_even(avg(nullif(nir, 0)), 0), CAST(0 AS DOUBLE)) AS nir FROM pixels, l GROUP BY 1, 2, 3"
)
def tiff_levels(spark, sf_dir):
    """All levels of a tiled file with overviews, written and read again."""
    path = new_path(spark, "levels") + ".tif"
    tiled.write_tiled(order_pixels(spark, sf_dir, ["nir"]), ["nir"], _raster(spark, sf_dir, ("nir",)), path, "uint16", overviews=3, tile=32)
    out = None
    for level in range(4):
        one = rasters.scan(spark, path, ["nir"], level=level).select(F.lit(level).alias("level"), "row", "col", "nir")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"WITH {PIX} SELECT 'nir.tif' AS raster_id, 100 AS width, CAST(max(row) + 1 AS INTEGER) AS height, 1 AS bands, 'uint16' AS dtype, 'EPSG:32645' AS crs, CAST(0 AS DOUBLE) AS nodata, "
    'CAST(633825 AS DOUBLE) AS "left", CAST(3004017 AS DOUBLE) AS top, CAST(633825 + 3 * 100 AS DOUBLE) AS "right", CAST(3004017 - 3 * (max(row) + 1) AS DOUBLE) AS bottom FROM pixels'
)
def tiff_catalog(spark, sf_dir):
    """The header of a file, read by ranges."""
    path = new_path(spark, "catalog")
    tiled.write_tiled(order_pixels(spark, sf_dir, ["nir"]), ["nir"], _raster(spark, sf_dir, ("nir",)), f"{path}/nir.tif", "uint16", tile=64)
    return rasters.catalog(spark, path).select("raster_id", "width", "height", F.col("count").alias("bands"), "dtype", "crs", "nodata", "bounds.left", "bounds.top", "bounds.right", "bounds.bottom")


def _raster(spark, sf_dir, bands):
    from dataclasses import replace

    return replace(order_raster(spark, sf_dir), descriptions=bands)
