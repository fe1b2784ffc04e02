"""Connected components, dilation, edges.

Components: pixels of a block are joined by a union-find in numpy, blocks are joined by
links across their borders, and links go through ``graph.connected_components``.  The
number of shuffled links grows with borders, not with pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandloom.graph import connected_components, join_labels

BLOCK = 512
#: Rasters of up to this many pixels are labelled by one task, without links between blocks.
ONE_TASK = 1 << 20
STEPS = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, 0), (1, 1), (1, -1)]}


def label_mask(mask: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """Index of the first pixel of each pixel's component; -1 outside the mask."""
    h, w = mask.shape
    u, v = [], []
    ids = np.arange(h * w).reshape(h, w)
    for dr, dc in STEPS[connectivity]:
        a = (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc)))
        b = (slice(dr, h), slice(max(0, dc), w - max(0, -dc)))
        both = mask[a] & mask[b]
        u.append(ids[a][both])
        v.append(ids[b][both])
    label = join_labels(h * w, np.concatenate(u), np.concatenate(v))
    return np.where(mask, label.reshape(h, w), -1)


def _label_block(connectivity: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        r, c = table.column("row").to_numpy(), table.column("col").to_numpy()
        r0, c0 = int(r.min()), int(c.min())
        mask = np.zeros((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), bool)
        mask[r - r0, c - c0] = True
        first = label_mask(mask, connectivity)[r - r0, c - c0]
        pid = (first // mask.shape[1] + r0).astype(np.int64) * width + first % mask.shape[1] + c0
        return pa.table({"row": table.column("row"), "col": table.column("col"), "local": pa.array(pid, pa.int64())})

    return run


def components(pixels: DataFrame, width: int, connectivity: int = 4, block: int = BLOCK, height: int | None = None) -> DataFrame:
    """(row, col, component) of the given pixels; component is the least row * width + col.

    With the raster's height, one of at most ``ONE_TASK`` pixels is one block.
    """
    n = 8 if connectivity == 8 else 4
    if height is not None and height * width <= ONE_TASK and block >= BLOCK:
        whole = pixels.select("row", "col").groupBy(F.lit(0).alias("raster")).applyInArrow(_label_block(n, width), "row int, col int, local bigint")
        return whole.withColumnRenamed("local", "component")
    div = lambda c: F.floor(F.col(c) / block).cast("int")
    local = pixels.select("row", "col").groupBy(div("row").alias("br"), div("col").alias("bc")).applyInArrow(_label_block(n, width), "row int, col int, local bigint")
    edge = lambda c: (F.col(c) % block == 0) | (F.col(c) % block == block - 1)
    rim = local.where(edge("row") | edge("col"))
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in STEPS[n]])
    shifted = rim.withColumn("s", F.explode(steps)).select((F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), F.col("local").alias("a"))
    links = shifted.join(rim.hint("merge"), ["row", "col"]).where("a <> local").select("a", F.col("local").alias("b")).distinct()
    merged = connected_components(links).withColumnRenamed("id", "local")
    return local.join(merged.hint("merge"), "local", "left").select("row", "col", F.coalesce("component", "local").alias("component"))


def dilate(points: DataFrame, radius: int, height: int, width: int, without: DataFrame | None = None) -> DataFrame:
    """(row, col) within Manhattan distance ``radius`` of a point, inside the grid, minus ``without``."""
    steps = [F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if abs(r) + abs(c) <= radius]
    near = points.withColumn("s", F.explode(F.array(*steps))).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col")).distinct()
    near = near.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return near if without is None else near.join(without.select("row", "col"), ["row", "col"], "left_anti")


def rising_edges(labels: DataFrame, label: str = "label") -> DataFrame:
    """(row, col, gradient, edge): the Sobel gradient to the right, edge where it is over 0.1.

    A border pixel stands in for the neighbour that isn't there.  Two windows over lines.
    """
    down, across = Window.partitionBy("col").orderBy("row"), Window.partitionBy("row").orderBy("col")
    v = F.col(label).cast("double")
    smooth = labels.withColumn("_s", F.coalesce(F.lag(v).over(down), v) + v * 2 + F.coalesce(F.lead(v).over(down), v))
    s = F.col("_s")
    out = smooth.withColumn("gradient", F.coalesce(F.lead(s).over(across), s) - F.coalesce(F.lag(s).over(across), s))
    return out.select("row", "col", "gradient", (F.col("gradient") > 0.1).alias("edge"))
