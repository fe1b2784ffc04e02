"""Sweeps and growing by blocks against one threshold, or one seed, at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.model import Seed
from bandloom.operators import layers
from bandloom.operators.segmentation import RegionGrowing, region_mask


def image(spark, h, w, seed, top=9):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, top, (h, w))
    rows = [(r, c, float(a[r, c]), float(rng.integers(0, 4))) for r in range(h) for c in range(w)]
    return spark.createDataFrame([(r, c, None if (r + c) % 23 == 0 else v, x) for r, c, v, x in rows], "row int, col int, v double, x double").repartition(3).cache()


def test_sweep_equals_single_masks(spark):
    df = image(spark, 30, 41, 1)
    seeds = [Seed(3, 4), Seed(20, 30), Seed(15, 11, "neg"), Seed(29, 40), Seed(200, 1), Seed(8, 8, "neg")]
    thresholds = [0.05 + 0.1 * k for k in range(8)] + [0.25, 2.0]
    depths, steps = layers.sweep(df, "v", thresholds, seeds, 41, block=8)
    depths = depths.cache()
    on = layers.balances(depths, steps)
    some = 0
    for k, t in enumerate(steps):
        want = {(r.row, r.col) for r in region_mask(df, "v", t, seeds, 41, height=30).where("mask = 1").collect()}
        got = {(r.row, r.col) for r in depths.where((F.col("pos") > k) & (F.col("neg") <= k)).collect()}
        assert got == want and on[t] == len(want)
        some += len(want) > 0
    assert depths.count() == 30 * 41 and some >= 3


@pytest.mark.parametrize("connectivity, metric, threshold", [(4, "euclidean", 2.0), (8, "manhattan", 2.0), (4, "chebyshev", 3.0), (8, "euclidean", 1.0)])
def test_growing_by_blocks_equals_one_task(spark, connectivity, metric, threshold):
    draw = random.Random(connectivity)
    df = image(spark, 25, 33, 2, top=6)
    seeds = [Seed(draw.randrange(25), draw.randrange(33)) for _ in range(9)]
    seeds += [seeds[0], Seed(seeds[1].row, min(32, seeds[1].col + 1))]
    grower = RegionGrowing(connectivity, threshold, metric)
    one = grower.grow(df, ["v", "x"], seeds, 25, 33)
    many = grower.grow(df, ["v", "x"], seeds, 25, 33, block=8)
    rows = lambda s: {tuple(r) for r in s.labels.collect()}
    assert rows(one) == rows(many)
    slow = grower._one_by_one(df, ["v", "x"], seeds, 33, 8)
    assert {tuple(r) for r in slow.collect()} == rows(one)


def test_growing_figures_are_counted_ones(spark):
    df = image(spark, 25, 33, 3, top=4)
    grown = RegionGrowing(4, 1.0).grow(df, ["v"], [Seed(2, 2), Seed(12, 20), Seed(24, 0)], 25, 33, block=8)
    labelled = grown.labels.where("label > 0")
    assert grown.info["pixels"] == 25 * 33 and grown.info["pixels_labelled"] == labelled.count() > 0
    assert grown.info["regions"] == labelled.select("label").distinct().count() == grown.region_stats.count()


def test_disjoint_seeds_and_none(spark):
    df = image(spark, 12, 12, 4)
    flat = df.withColumn("v", F.when(F.col("col") == 6, 100.0).otherwise(1.0))
    got = RegionGrowing(4, 1.0).grow(flat, ["v"], [Seed(0, 0), Seed(0, 11)], 12, 12, block=5).labels.groupBy("label").count().collect()
    assert {(r.label, r["count"]) for r in got} == {(0, 12), (1, 72), (2, 60)}
    depths, _ = layers.sweep(flat, "v", [0.5], [Seed(0, 0)], 12, block=5)
    assert depths.where("pos > 0 or neg > 0").count() == 0


def test_joins_of_pixels_and_regions_are_never_broadcasts(spark):
    from bandloom.model import Seed
    from bandloom.operators import layers

    reach = spark.range(400).selectExpr("cast(id div 20 as int) as row", "cast(id % 20 as int) as col", "array(cast(1 as int), cast(2 as int)) as seeds")
    labels = layers.in_order(reach, [Seed(0, 0), Seed(5, 5)], 20, 4, 8)
    plan = labels._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 3
    assert labels.where("label = 1").count() == 400
