"""Rasters made of the benchmark tables: eight bands from orders, spectra from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.model import Affine, Raster

WIDTH = 100
#: Multipliers of key and price of each band (fixed values of the fixture).
MIX = {"coastal_blue": (11, 3), "blue": (13, 5), "green_i": (19, 11), "green": (23, 17), "yellow": (29, 19), "red": (31, 7), "rededge": (37, 23), "nir": (17, 13)}


def order_pixels(spark: SparkSession, sf_dir: str, bands: list[str] | None = None) -> DataFrame:
    """(row, col, bands): one pixel for each order, 100 to a row; 0 is nodata.  Only two columns are read."""
    k, t = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    value = {b: F.when(k % 97 == 0, F.lit(0)).otherwise(1 + (k * p + t * q) % 9999).cast("int").alias(b) for b, (p, q) in MIX.items() if bands is None or b in bands}
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.expr(f"o_orderkey div {WIDTH}").cast("int").alias("row"), (k % WIDTH).cast("int").alias("col"), *value.values())


def order_raster(spark: SparkSession, sf_dir: str) -> Raster:
    height = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.max("o_orderkey")).first()[0] // WIDTH + 1
    return Raster("orders", WIDTH, height, Affine(3.0, 0.0, 633825.0, 0.0, -3.0, 3004017.0), "EPSG:32645", 0.0)


def spectra(spark: SparkSession, sf_dir: str, width: int = 25) -> DataFrame:
    """(row, col, vec_id, spectrum): 64 bands for each vector."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.expr(f"vec_id div {width}").cast("int").alias("row"), (F.col("vec_id") % width).cast("int").alias("col"), "vec_id", F.col("embedding").cast("array<double>").alias("spectrum"))
