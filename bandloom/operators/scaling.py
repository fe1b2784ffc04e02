"""Reflectance scaling, nodata, normalisation and thresholds.

Scalars of a whole raster (a maximum, percentiles) are one aggregate row that is joined
back as a broadcast of exactly one row; they never leave Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.functions.arith import clip, finite
from bandloom.model import REFLECTANCE_SCALE, SCALE_LIMIT


def with_scalars(pixels: DataFrame, *aggregates: Column) -> DataFrame:
    """Every row with the aggregates over all rows: a cross join with one row."""
    return pixels.crossJoin(F.broadcast(pixels.agg(*aggregates)))


def nodata_mask(bands: list[str], nodata: float) -> Column:
    """True where all of the bands hold nodata."""
    return reduce(lambda a, b: a & b, [F.col(b) == F.lit(nodata) for b in bands])


def scale_reflectance(pixels: DataFrame, bands: list[str], nodata: float | None = None) -> DataFrame:
    """Bands as reflectances: a band with a maximum over 1.5 is divided by 10000, then clipped to [0, 1].

    Where all the bands are nodata (compared before scaling) they become NULL.
    """
    probe = with_scalars(pixels, *[F.max(b).alias(f"_max_{b}") for b in bands])
    drop = nodata_mask(bands, nodata) if nodata is not None else F.lit(False)
    value = {b: clip(F.when(F.col(f"_max_{b}") > SCALE_LIMIT, F.col(b).cast("double") / REFLECTANCE_SCALE).otherwise(F.col(b).cast("double")), 0.0, 1.0) for b in bands}
    return probe.select(*[c for c in pixels.columns if c not in bands], *[F.when(~drop, value[b]).alias(b) for b in bands])


def mask_nodata(pixels: DataFrame, bands: list[str], nodata: float) -> DataFrame:
    drop = nodata_mask(bands, nodata)
    return pixels.withColumns({b: F.when(~drop, F.col(b)) for b in bands})


def null_band(band: Column, nodata: float | None) -> Column:
    """A single band with its nodata value as NULL."""
    return band if nodata is None else F.nullif(band.cast("double"), F.lit(float(nodata)))


def normalise(pixels: DataFrame, value: str, name: str = "normalised") -> DataFrame:
    """(v - min) / (max - min) over all finite values; 0 where v isn't finite or all are equal."""
    v = finite(F.col(value))
    out = with_scalars(pixels, F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return out.withColumn(name, F.coalesce(scaled, F.lit(0.0))).drop("_lo", "_hi")


def candidates(pixels: DataFrame, value: str, threshold: float) -> DataFrame:
    """Pixels whose normalised value is at least the threshold."""
    return normalise(pixels, value, "normalised").where(F.col("normalised") >= threshold)
