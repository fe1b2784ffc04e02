"""Index maps of rasters as they arrive: a file stream with exactly one result for each file.

Each run takes the files that the checkpoint hasn't seen, in batches, and ends.  A batch is written
to the folder of its number, replacing what a failed attempt left there; Spark gives a number the
same files again until its batch is committed.  So a restart neither loses nor repeats a raster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bandloom.operators import scaling
from bandloom.plans import registry
from bandloom.sources import rasters

FILES = 16
#: Columns of listed files (the source's own).
LISTED = "path string, modificationTime timestamp, length bigint, content binary"


def precompute_files(spark: SparkSession, folder: str, out: str, checkpoint: str, names: list[str] | None = None, pattern: str = "*.tif", files: int = FILES) -> StreamingQuery:
    """Start a run over the new files of ``folder``; wait for its end with ``awaitTermination``.

    ``names`` are formulas without parameters, all of them by default; a raster whose bands don't
    carry a formula has null in its column.  At most ``files`` rasters make a batch.
    """
    names = [n for n in registry.ready_names() if names is None or n in names]
    arriving = spark.readStream.format("binaryFile").schema(LISTED).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).load(folder).select("path")

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        target = f"{out}/batch={number:09d}"
        maps = [_maps(own, r["path"], names) for r in batch.distinct().orderBy("path").collect()]  # at most ``files`` rows
        if not maps:
            return
        every = maps[0]
        for one in maps[1:]:
            every = every.unionByName(one)
        every.write.mode("overwrite").parquet(target)

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _maps(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(path, row, col, names) of one raster at full resolution."""
    raster = rasters.header(spark, path)
    have = {d.lower() for d in raster.descriptions if d}
    ready = [n for n in names if set(registry.get_formula(n).bands()) <= have]
    bands = sorted({b for n in ready for b in registry.get_formula(n).bands()}) or ["band_1"]
    pixels = rasters.scan(spark, path, bands).drop("raster_id")
    maps = registry.add_indices(scaling.scale_reflectance(pixels, bands, raster.nodata), ready)
    none = F.lit(None).cast("double")
    return maps.select(F.lit(path).alias("path"), "row", "col", *[F.col(n) if n in ready else none.alias(n) for n in names])


def read_maps(spark: SparkSession, out: str) -> DataFrame:
    """(path, row, col, indices) of all rasters that were taken in."""
    return spark.read.parquet(out).drop("batch")
