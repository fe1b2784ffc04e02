"""Resampling: decimation by average or nearest, warps by a join of output to source pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.model import Affine, Raster
from bandloom.operators.projection import add_coordinates, to_lonlat
from bandloom.operators.roi import Bounds


def _shares(place: str, src: int, dst: int, reach: str) -> Column:
    """ARRAY<STRUCT<at, w>>: the output places that a source place contributes to, and its weights.

    ``area``: the length that both cover, in source units.  ``triangle``: a triangle around the
    output's centre, as wide as the greater of a source and an output pixel.
    """
    scale = src / dst
    i = F.col(place).cast("double")
    if reach == "area":
        first, last = F.floor(i / F.lit(scale)), F.ceil((i + 1) / F.lit(scale)) - 1
        weight = lambda x: F.least(i + 1, (x + 1) * F.lit(scale)) - F.greatest(i, x * F.lit(scale))
    else:
        wide = max(scale, 1.0)
        first, last = F.ceil((i + 0.5 - F.lit(wide)) / F.lit(scale) - 0.5), F.floor((i + 0.5 + F.lit(wide)) / F.lit(scale) - 0.5)
        weight = lambda x: F.lit(1.0) - F.abs(i + 0.5 - (x + 0.5) * F.lit(scale)) / F.lit(wide)
    places = F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(dst - 1)).cast("int"))
    each = F.transform(places, lambda x: F.struct(x.alias("at"), weight(x).alias("w")))
    return F.filter(each, lambda e: e["w"] > 1e-12)


def _spread(pixels: DataFrame, bands: list[str], src: tuple[int, int], dst: tuple[int, int], reach: str) -> DataFrame:
    """(row, col, w, bands): each source pixel in the output pixels that it has a part in."""
    rows = pixels.select("col", F.explode(_shares("row", src[0], dst[0], reach)).alias("r"), *bands)
    return rows.select(F.col("r.at").alias("row"), F.col("r.w").alias("v"), F.explode(_shares("col", src[1], dst[1], reach)).alias("c"), *bands).select("row", F.col("c.at").alias("col"), (F.col("v") * F.col("c.w")).alias("w"), *bands)


def downsample_average(pixels: DataFrame, bands: list[str], src: tuple[int, int], dst: tuple[int, int], nodata: float | None = None, integers: bool = True) -> DataFrame:
    """Averages of the source pixels that an output pixel covers, by the area covered; nodata is left out.

    ``src`` and ``dst`` are (height, width), of which only whole ratios need no weights.  Integer
    rasters are rounded half to even.
    """
    real = lambda b: F.when(F.lit(nodata is None) | (F.col(b) != F.lit(nodata if nodata is not None else 0)), F.col(b))
    fill = (lambda c: F.coalesce(c, F.lit(float(nodata)))) if nodata is not None else (lambda c: c)
    cut = (lambda c: F.bround(c, 0)) if integers else (lambda c: c)
    if any(s % d for s, d in zip(src, dst, strict=True)):
        spread = _spread(pixels, bands, src, dst, "area")
        mean = lambda b: F.sum(real(b) * F.col("w")) / F.nullif(F.sum(F.when(real(b).isNotNull(), F.col("w"))), F.lit(0.0))
        return spread.groupBy("row", "col").agg(*[fill(cut(mean(b))).alias(b) for b in bands])
    row, col = F.expr(f"row div {src[0] // dst[0]}").cast("int"), F.expr(f"col div {src[1] // dst[1]}").cast("int")
    return pixels.groupBy(row.alias("row"), col.alias("col")).agg(*[fill(cut(F.avg(real(b)))).alias(b) for b in bands])


def resize_bilinear(pixels: DataFrame, bands: list[str], src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """Maps on a grid of another size, by triangles around the output's centres (an anti-aliased bilinear resize).

    So a map at full resolution is laid on the grid of maps that were computed on a smaller one.
    An output pixel is NULL if any source pixel that it takes from is.
    """
    whole = lambda b: F.when(F.count(b) == F.count(F.lit(1)), F.sum(F.col(b) * F.col("w")) / F.sum("w"))
    return _spread(pixels, bands, src, dst, "triangle").groupBy("row", "col").agg(*[whole(b).alias(b) for b in bands])


def downsample_nearest(pixels: DataFrame, src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """The source pixel under the centre of each output pixel: a filter, without a shuffle."""
    out = pixels
    for name, s, d in (("row", src[0], dst[0]), ("col", src[1], dst[1])):
        at = F.ceil((F.col(name) * d) / F.lit(float(s)) - 0.5).cast("int")
        exact = F.floor((at + 0.5) * s / F.lit(float(d))) == F.col(name)
        if d > s:
            raise ValueError("the output is larger than the source")
        out = out.withColumn("_at", at).where(exact & (F.col("_at") < d)).withColumn(name, F.col("_at")).drop("_at")
    return out


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    cells = spark.range(height * width)
    return cells.select(F.expr(f"id div {width}").cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def source_places(out: DataFrame, target: Affine, target_crs: str, raster: Raster) -> DataFrame:
    """Fractional source places (_r, _c) of the centres of output pixels."""
    return places_at(out, *target.to_geo(F.col("row") + 0.5, F.col("col") + 0.5), target_crs, raster)


def places_at(out: DataFrame, x: Column, y: Column, crs: str, raster: Raster) -> DataFrame:
    """``out`` with the fractional source places (_r, _c) of coordinates of ``crs``."""
    if crs == raster.crs:
        r, c = raster.transform.to_pixel(x, y)
        return out.withColumn("_r", r).withColumn("_c", c)
    lon, lat = to_lonlat(crs, x, y)
    places = add_coordinates(out.withColumn("_lon", lon).withColumn("_lat", lat), raster.crs, "_lon", "_lat", "_x", "_y")
    r, c = raster.transform.to_pixel(F.col("_x"), F.col("_y"))
    return places.withColumn("_r", r).withColumn("_c", c).drop("_lon", "_lat", "_x", "_y")


def warp(pixels: DataFrame, raster: Raster, box: Bounds, height: int, width: int, crs: str = "EPSG:4326", bilinear: bool = False) -> DataFrame:
    """Pixels of ``raster`` on a grid of ``box``: an equi-join of computed source keys.

    Output pixels without a source are 0.  Bilinear weights are renormalised over the
    source pixels that are there.
    """
    spark = pixels.sparkSession
    target = Affine((box.right - box.left) / width, 0.0, box.left, 0.0, -(box.top - box.bottom) / height, box.top)
    bands = [b for b in pixels.columns if b not in ("row", "col", "raster_id")]
    places = source_places(grid(spark, height, width), target, crs, raster)
    source = pixels.select(F.col("row").alias("_sr"), F.col("col").alias("_sc"), *bands)
    if not bilinear:
        keyed = places.withColumn("_sr", F.floor("_r").cast("int")).withColumn("_sc", F.floor("_c").cast("int"))
        joined = keyed.join(source, ["_sr", "_sc"], "left")
        return joined.select("row", "col", *[F.coalesce(b, F.lit(0)).alias(b) for b in bands])
    keyed = places.withColumn("k", F.explode(corners())).select("row", "col", "k.*")
    joined = keyed.join(source, ["_sr", "_sc"], "left")
    mean = lambda b: F.sum(F.when(F.col(b).isNotNull(), F.col(b) * F.col("_w"))) / F.nullif(F.sum(F.when(F.col(b).isNotNull(), F.col("_w"))), F.lit(0.0))
    return joined.groupBy("row", "col").agg(*[F.coalesce(mean(b), F.lit(0.0)).alias(b) for b in bands])


def corners() -> Column:
    """ARRAY<STRUCT<_sr, _sc, _w>>: the four source pixels around (_r, _c) and their bilinear weights."""
    r0, c0 = F.floor(F.col("_r") - 0.5), F.floor(F.col("_c") - 0.5)
    fr, fc = F.col("_r") - 0.5 - r0, F.col("_c") - 0.5 - c0
    return F.array(*[F.struct((r0 + i).cast("int").alias("_sr"), (c0 + j).cast("int").alias("_sc"), ((fr if i else F.lit(1.0) - fr) * (fc if j else F.lit(1.0) - fc)).alias("_w")) for i in (0, 1) for j in (0, 1)])
