"""Segmentation from seeds: threshold components, ordered region growing, progressive refinement."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bandloom.model import Seed, Segmentation
from bandloom.operators import layers
from bandloom.operators.scaling import normalise
from bandloom.operators.stats import zonal_stats
from bandloom.operators.topology import BLOCK, ONE_TASK, components, label_mask
from bandloom.storage import materialise

METRICS = ("euclidean", "manhattan", "chebyshev")


def seed_frame(spark: SparkSession, seeds: list[Seed]) -> DataFrame:
    return spark.createDataFrame([(k + 1, s.row, s.col, s.kind) for k, s in enumerate(seeds)], "seed_id int, row int, col int, kind string")


def array_distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two ARRAY<DOUBLE> columns."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}: {', '.join(METRICS)}")
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if metric == "chebyshev":
        return F.array_max(gap)
    total = F.aggregate(gap, F.lit(0.0), (lambda s, d: s + d * d) if metric == "euclidean" else (lambda s, d: s + d))
    return F.sqrt(total) if metric == "euclidean" else total


def band_distance(bands: list[str], values: list[float], metric: str) -> Column:
    """Distance of band columns from constants; one band is compared by its difference, whatever the metric."""
    gaps = [F.abs(F.col(b).cast("double") - F.lit(v).cast("double")) for b, v in zip(bands, values, strict=True)]
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}: {', '.join(METRICS)}")
    if len(gaps) == 1:
        return gaps[0]
    if metric == "chebyshev":  # greatest() passes over nulls, a distance doesn't
        return F.when(reduce(lambda a, b: a & b, [g.isNotNull() for g in gaps]), F.greatest(*gaps))
    if metric == "manhattan":
        return reduce(lambda a, b: a + b, gaps)
    return F.sqrt(reduce(lambda a, b: a + b, [g * g for g in gaps]))


def region_mask(index_map: DataFrame, value: str, threshold: float, seeds: list[Seed], width: int, block: int = BLOCK, height: int | None = None) -> DataFrame:
    """(row, col, mask): components of normalised >= threshold with a positive and without a negative seed.

    With the raster's height, one of at most ``ONE_TASK`` pixels is done by one task.
    """
    spark = index_map.sparkSession
    if height is not None and height * width <= ONE_TASK and block >= BLOCK:
        whole = index_map.select(F.lit(0).alias("raster"), "row", "col", F.col(value).cast("double").alias("v"))
        return whole.groupBy("raster").applyInArrow(_mask_in_one_task(threshold, seeds, height, width), "row int, col int, mask tinyint")
    marked = normalise(index_map.select("row", "col", value), value, "_n").select("row", "col", (F.col("_n") >= threshold).alias("_c"))
    marked = materialise(marked, "region-candidates")
    parts = components(marked.where("_c"), width, 4, block)
    at = F.broadcast(seed_frame(spark, seeds))
    hit = parts.join(at, ["row", "col"]).groupBy("component").agg(F.max(F.when(F.col("kind") == "pos", 1).otherwise(0)).alias("p"), F.max(F.when(F.col("kind") == "neg", 1).otherwise(0)).alias("n"))
    kept = parts.join(hit.where("p = 1 and n = 0").select("component"), "component", "left_semi").select("row", "col", F.lit(1).alias("_k"))
    return marked.select("row", "col").join(kept.hint("merge"), ["row", "col"], "left").select("row", "col", F.coalesce("_k", F.lit(0)).cast("tinyint").alias("mask"))


def _mask_in_one_task(threshold: float, seeds: list[Seed], height: int, width: int):
    """``normalise``, threshold and components of a raster that is one group."""

    def run(table: pa.Table) -> pa.Table:
        r, c = table.column("row").to_numpy(), table.column("col").to_numpy()
        v = table.column("v").to_numpy(zero_copy_only=False).astype(float)
        known = np.isfinite(v)
        low, high = (v[known].min(), v[known].max()) if known.any() else (0.0, 0.0)
        level = np.zeros(len(v))
        if high > low:
            level[known] = (v[known] - low) / (high - low)
        candidate = np.zeros((height, width), bool)
        candidate[r, c] = level >= threshold
        labels = label_mask(candidate, 4)
        at = {kind: {int(labels[s.row, s.col]) for s in seeds if s.kind == kind and 0 <= s.row < height and 0 <= s.col < width} - {-1} for kind in ("pos", "neg")}
        mask = np.isin(labels, sorted(at["pos"] - at["neg"]))
        return pa.table({"row": table.column("row"), "col": table.column("col"), "mask": pa.array(mask[r, c].astype(np.int8))})

    return run


def _gaps(gap: np.ndarray, metric: str) -> np.ndarray:
    """Distances from absolute differences (bands first)."""
    return gap[0] if len(gap) == 1 else gap.max(0) if metric == "chebyshev" else gap.sum(0) if metric == "manhattan" else np.sqrt((gap * gap).sum(0))


@dataclass(frozen=True)
class RegionGrowing:
    """Ordered growing from seeds.  A pixel joins a seed's region if it is connected to it by pixels
    whose value differs from the seed's by at most the threshold, and no earlier seed has it.

    connectivity: 8, or anything else for 4.  The fixed point doesn't depend on the order of visits,
    so the backends of other engines (one task, blocks, graphics cards) are this one operator;
    ``max_rounds`` only bounds the single-task flood, as a safeguard.
    """

    connectivity: int = 4
    intensity_threshold: float = 20.0
    spectral_distance_metric: str = "euclidean"
    max_rounds: int | None = None

    def grow(self, pixels: DataFrame, bands: list[str], seeds: list[Seed], height: int, width: int, block: int = 512) -> Segmentation:
        for s in seeds:
            if not (0 <= s.row < height and 0 <= s.col < width):
                raise ValueError(f"seed {s} is outside the raster")
        if self.spectral_distance_metric not in METRICS:
            raise ValueError(f"unknown metric {self.spectral_distance_metric!r}: {', '.join(METRICS)}")
        if height * width <= ONE_TASK and block >= 512:
            labels = self._in_one_task(pixels, bands, seeds, height, width)
        else:
            labels = self._by_blocks(pixels, bands, seeds, width, block)
        start = time.perf_counter()
        # the figures are counted while the labels are written
        seen = Observation("growing")
        counted = labels.observe(seen, F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("label") > 0).alias("labelled"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(F.col("label"), F.lit(62)))).alias("_bits"))
        labels = materialise(counted, "grown")
        figures = seen.get
        regions = bin((figures["_bits"] or 0) >> 1).count("1") if len(seeds) <= 61 else labels.where("label > 0").select("label").distinct().count()
        info = {"compute_seconds": time.perf_counter() - start, "pixels": figures["pixels"], "pixels_labelled": figures["labelled"], "regions": regions, "bytes": figures["pixels"] * (8 * len(bands) + 12)}
        stats = zonal_stats(labels.join(pixels.hint("merge"), ["row", "col"]), bands)
        return Segmentation(labels, seeds, stats, info)

    def _in_one_task(self, pixels: DataFrame, bands: list[str], seeds: list[Seed], height: int, width: int) -> DataFrame:
        connectivity, threshold, metric = (8 if self.connectivity == 8 else 4), self.intensity_threshold, self.spectral_distance_metric

        def run(table: pa.Table) -> pa.Table:
            r, c = table.column("row").to_numpy(), table.column("col").to_numpy()
            cube = np.full((len(bands), height, width), np.nan)
            for k, b in enumerate(bands):
                cube[k, r, c] = table.column(b).to_numpy(zero_copy_only=False).astype(float)
            labels = np.zeros((height, width), np.int32)
            for k, s in enumerate(seeds, 1):
                if labels[s.row, s.col]:
                    continue
                gap = np.abs(cube - cube[:, s.row, s.col][:, None, None])
                may = (_gaps(gap, metric) <= threshold) & (labels == 0)
                may[s.row, s.col] = True
                part = label_mask(may, connectivity)
                labels[part == part[s.row, s.col]] = k
            return pa.table({"row": table.column("row"), "col": table.column("col"), "label": pa.array(labels[r, c], pa.int32())})

        return pixels.select(F.lit(0).alias("raster"), "row", "col", *bands).groupBy("raster").applyInArrow(run, "row int, col int, label int")

    def _by_blocks(self, pixels: DataFrame, bands: list[str], seeds: list[Seed], width: int, block: int) -> DataFrame:
        """All seeds in two passes over the blocks (see ``layers``): a layer of near pixels for each."""
        connectivity, threshold, metric = (8 if self.connectivity == 8 else 4), self.intensity_threshold, self.spectral_distance_metric
        values = self._seed_values(pixels, bands, seeds)
        known = [(k, s, np.array([np.nan if x is None else float(x) for x in values[s.row, s.col]])) for k, s in enumerate(seeds, 1) if (s.row, s.col) in values]

        def masks(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
            r, c = table.column("row").to_numpy(), table.column("col").to_numpy()
            cube = np.stack([table.column(b).to_numpy(zero_copy_only=False).astype(float) for b in bands])
            for k, s, value in known:
                near = (r == s.row) & (c == s.col) | (_gaps(np.abs(cube - value[:, None]), metric) <= threshold)
                if near.any():
                    yield k, near

        blocks = materialise(layers.by_block(pixels.select("row", "col", *bands), block), "growing")
        labels = layers.in_order(layers.seed_regions(blocks, masks, seeds, width, connectivity, block), seeds, width, connectivity, block)
        return self._one_by_one(pixels, bands, seeds, width, block) if labels is None else labels

    def _seed_values(self, pixels: DataFrame, bands: list[str], seeds: list[Seed]) -> dict[tuple[int, int], list]:
        at = F.broadcast(seed_frame(pixels.sparkSession, seeds).select("row", "col").distinct())
        return {(r["row"], r["col"]): [r[b] for b in bands] for r in pixels.join(at, ["row", "col"]).select("row", "col", *bands).collect()}

    def _one_by_one(self, pixels: DataFrame, bands: list[str], seeds: list[Seed], width: int, block: int) -> DataFrame:
        values = self._seed_values(pixels, bands, seeds)
        state = materialise(pixels.select("row", "col", *bands, F.lit(0).alias("label")), "growing")
        for k, s in enumerate(seeds, 1):
            here = (F.col("row") == s.row) & (F.col("col") == s.col)
            mine = state.where(here).select("label").first()
            if mine is None or mine["label"]:
                continue
            near = F.coalesce(band_distance(bands, values[s.row, s.col], self.spectral_distance_metric) <= self.intensity_threshold, F.lit(False))
            parts = materialise(components(state.where("label = 0").where(near | here), width, self.connectivity, block), "growing-parts")
            root = parts.where(here).select("component")
            region = parts.join(F.broadcast(root), "component", "left_semi").select("row", "col", F.lit(k).alias("_k"))
            state = materialise(state.join(region, ["row", "col"], "left").withColumn("label", F.coalesce("_k", "label")).drop("_k"), "growing")
        return state.select("row", "col", F.col("label").cast("int").alias("label"))


def progressive(index_map: DataFrame, value: str, threshold: float, seeds: list[Seed], width: int, max_iterations: int = 10, convergence: float = 0.01, min_region: int = 10, block: int = 512) -> tuple[DataFrame, dict]:
    """(row, col, state) and what happened.

    Each round drops components of positive pixels smaller than ``min_region`` (which also
    clears the marks of negative seeds), takes mean and deviation of the positive values that
    are left, moves the threshold to mean - deviation / 2 within [0.1, 0.9], and adds every pixel
    at or over it, wherever it lies.  It ends when fewer than ten positive values are left,
    when the threshold moves by less than ``convergence``, or, from the second round on, when the
    number of pixels changes by less than that share.  Sparse single seeds thus give an empty mask.
    """
    spark = index_map.sparkSession
    at = seed_frame(spark, seeds).groupBy("row", "col").agg(F.max(F.when(F.col("kind") == "pos", 1).otherwise(2)).alias("_s"))
    state = index_map.select("row", "col", F.col(value).alias("v")).join(F.broadcast(at), ["row", "col"], "left").select("row", "col", "v", F.coalesce("_s", F.lit(0)).alias("state"))
    state = materialise(state, "progressive")
    info = {"iterations": 0, "final_threshold": threshold, "regions_found": 0, "pixels_segmented": 0, "converged": False}
    current, before = threshold, None
    for turn in range(max_iterations):
        if state.where("state = 1").limit(1).count():
            parts = materialise(components(state.where("state = 1"), width, 4, block), "progressive-parts")
            large = parts.groupBy("component").count().where(F.col("count") >= min_region)
            info["regions_found"] = large.count()
            kept = parts.join(large.select("component"), "component", "left_semi").select("row", "col", F.lit(1).alias("_k"))
            state = state.join(kept, ["row", "col"], "left").select("row", "col", "v", F.coalesce("_k", F.lit(0)).alias("state"))
            state = materialise(state, "progressive")
        s = state.where("state = 1 and v > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("d")).first()
        if s["n"] < 10:
            break
        fresh = min(max(s["m"] - 0.5 * (s["d"] if s["d"] > 0 else 0.1), 0.1), 0.9)
        moved = abs(fresh - current)
        current = info["final_threshold"] = fresh
        if moved < convergence:
            info["converged"] = True
            break
        state = materialise(state.withColumn("state", F.when((F.col("state") == 1) | (F.col("v") >= fresh), 1).otherwise(0)), "progressive")
        info["iterations"] = turn + 1
        now = state.where("state = 1").count()
        if turn >= 1 and before and abs(now - before) / before < convergence:
            info["converged"] = True
            break
        before = now
    info["pixels_segmented"] = state.where("state > 0").count()
    return state.select("row", "col", F.col("state").cast("int").alias("state")), info


def progressive_with_roi(index_map: DataFrame, value: str, threshold: float, seeds: list[Seed], width: int, roi: DataFrame | None = None, dimming: float = 0.3, max_iterations: int = 10) -> tuple[DataFrame, dict]:
    """(row, col, mask, r, g, b, a) and what happened: grey values, the mask in red; pixels outside the
    region of interest ((row, col) rows) are dimmed before growing and masked out after it.
    Without a region all but the mask is transparent."""
    base = normalise(index_map.select("row", "col", value), value, "v")
    inside = F.lit(True)
    if roi is not None:
        base = base.join(roi.select("row", "col", F.lit(True).alias("_in")).distinct(), ["row", "col"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
        inside = F.col("_in")
        base = base.withColumn("v", F.when(inside, F.col("v")).otherwise(F.col("v") * dimming))
    base = materialise(base, "progressive-base")
    state, info = progressive(base, "v", threshold, seeds, width, max_iterations)
    mask = F.when(inside, F.col("state")).otherwise(0)
    grey = F.least(F.greatest(F.col("v") * 255, F.lit(0.0)), F.lit(255.0)).cast("int")
    alpha = F.lit(0) if roi is None else F.when(inside, 255).otherwise(int(255 * dimming))
    out = base.join(state, ["row", "col"]).withColumn("mask", mask)
    red = lambda on, off: F.when(F.col("mask") > 0, F.lit(on)).otherwise(off)
    return out.select("row", "col", "mask", red(255, grey).alias("r"), red(0, grey).alias("g"), red(0, grey).alias("b"), red(255, alpha).alias("a")), info
