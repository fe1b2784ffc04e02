"""Components of many layers of one raster at once, and what seeds make of them.

A layer is a set of pixels: those over a threshold, or those near a seed's value.  Blocks label
every layer in one pass and send only their rims and the seeds, keyed by layer; links across
borders of all layers go through one run of ``graph.connected_components``.  A second pass over
the blocks tells each pixel which of its components a seed has reached.  So neither the number
of thresholds nor of seeds adds a pass over the raster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.graph import connected_components, join_labels
from bandloom.model import Seed
from bandloom.operators.scaling import normalise
from bandloom.operators.topology import BLOCK, STEPS, label_mask
from bandloom.storage import materialise

#: A node is a layer's component in a block: the layer above so many bits for its first pixel.
PIXEL_BITS = 50
#: Regions of equal membership that one task puts in order; more go seed by seed.
MOST_REGIONS = 2_000_000

Masks = Callable[[pa.Table], Iterator[tuple[int, np.ndarray]]]


def by_block(pixels: DataFrame, block: int) -> DataFrame:
    div = lambda c: F.floor(F.col(c) / block).cast("int")
    return pixels.withColumns({"br": div("row"), "bc": div("col")})


class _Block:
    """Pixels of a block, and the first pixel of each one's component in a layer."""

    def __init__(self, table: pa.Table, width: int, connectivity: int):
        self.row, self.col = table.column("row").to_numpy(), table.column("col").to_numpy()
        self.r0, self.c0 = int(self.row.min()), int(self.col.min())
        self.shape = int(self.row.max()) - self.r0 + 1, int(self.col.max()) - self.c0 + 1
        self.width, self.connectivity = width, connectivity

    def roots(self, member: np.ndarray) -> np.ndarray:
        """row * width + col of the first pixel of the component of each member; -1 for others."""
        grid = np.zeros(self.shape, bool)
        grid[self.row - self.r0, self.col - self.c0] = member
        first = label_mask(grid, self.connectivity)[self.row - self.r0, self.col - self.c0]
        return np.where(member, self.to_pixel(first), -1)

    def to_pixel(self, place: np.ndarray) -> np.ndarray:
        return (place // self.shape[1] + self.r0).astype(np.int64) * self.width + place % self.shape[1] + self.c0


def _rims(masks: Masks, seeds: list[tuple[int, int, int]], all_layers: bool, width: int, connectivity: int, block: int):
    """Rows (row, col, node, seed) of a block: rim pixels of every layer (seed -1), and seeds in theirs."""

    def run(table: pa.Table) -> pa.Table:
        b = _Block(table, width, connectivity)
        edge = (b.row % block == 0) | (b.row % block == block - 1) | (b.col % block == 0) | (b.col % block == block - 1)
        here = [(k, np.flatnonzero((b.row == r) & (b.col == c))) for k, r, c in seeds]
        here = [(k, at[0]) for k, at in here if len(at)]
        parts = []
        for layer, member in masks(table):
            own = [(k, at) for k, at in here if member[at] and (all_layers or k == layer)]
            rim = np.flatnonzero(edge & member)
            if not len(rim) and not own:
                continue
            node = b.roots(member) | layer << PIXEL_BITS
            at = np.concatenate([rim, np.array([at for _, at in own], np.int64)])
            parts.append((b.row[at], b.col[at], node[at], np.append(np.full(len(rim), -1), [k for k, _ in own])))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
        return pa.table({n: pa.array(c.astype(t)) for n, c, t in zip(("row", "col", "node", "seed"), columns, (np.int32, np.int32, np.int64, np.int32), strict=True)})

    return run


def border_links(rim: DataFrame, connectivity: int, keys: list[str] = ()) -> DataFrame:
    """(a, b): distinct pairs of nodes of neighbouring rim pixels with equal ``keys``; ``rim`` has row, col, node."""
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in STEPS[connectivity]])
    shifted = rim.withColumn("s", F.explode(steps)).select(*keys, (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), F.col("node").alias("a"))
    return shifted.join(rim.hint("merge"), [*keys, "row", "col"]).where("a <> node").select("a", F.col("node").alias("b")).distinct()


def reached(blocks: DataFrame, masks: Masks, seeds: list[Seed], all_layers: bool, width: int, connectivity: int, block: int) -> DataFrame:
    """(br, bc, node, pos, neg): a row for each block's component that a seed reaches.

    ``blocks`` is a stored table with br and bc.  A seed (numbered from 1) sows in every layer that
    has its pixel, or only in the layer of its number.
    """
    if len(seeds) >= 1 << 63 - PIXEL_BITS:
        raise ValueError(f"at most {(1 << 63 - PIXEL_BITS) - 1} seeds")
    places = [(k, s.row, s.col) for k, s in enumerate(seeds, 1)]
    rims = _rims(masks, places, all_layers, width, connectivity, block)
    nodes = materialise(blocks.groupBy("br", "bc").applyInArrow(rims, "row int, col int, node bigint, seed int"), "layer-rims")
    rim = nodes.where("seed < 0").select(F.shiftright("node", PIXEL_BITS).alias("layer"), "row", "col", "node")
    merged = materialise(connected_components(border_links(rim, connectivity, ["layer"])), "layer-components")
    kinds = nodes.sparkSession.createDataFrame([(k, int(s.kind != "neg"), int(s.kind == "neg")) for k, s in enumerate(seeds, 1)], "seed int, pos int, neg int")
    sown = nodes.where("seed > 0").join(F.broadcast(kinds), "seed").join(merged.hint("merge"), F.col("node") == F.col("id"), "left")
    flags = sown.groupBy(F.coalesce("component", "node").alias("c")).agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    linked = merged.join(flags.hint("merge"), F.col("component") == F.col("c")).select(F.col("id").alias("node"), "pos", "neg")
    alone = flags.join(merged.hint("merge"), F.col("c") == F.col("id"), "left_anti").select(F.col("c").alias("node"), "pos", "neg")
    pixel = F.col("node").bitwiseAND(F.lit((1 << PIXEL_BITS) - 1))
    found = linked.union(alone).withColumn("_pixel", pixel)
    return found.select(F.expr(f"(_pixel div {width}) div {block}").cast("int").alias("br"), F.expr(f"(_pixel % {width}) div {block}").cast("int").alias("bc"), "node", "pos", "neg")


def _members(table: pa.Table, flags: pa.Table, masks: Masks, width: int, connectivity: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(layer, reached by pos, reached by neg) of each layer of the block that a seed reaches."""
    node, pos, neg = (flags.column(c).to_numpy() for c in ("node", "pos", "neg"))
    layer = node >> PIXEL_BITS
    wanted = set(layer.tolist())
    b = _Block(table, width, connectivity)
    for k, member in masks(table):
        if k in wanted:
            root = b.roots(member) | k << PIXEL_BITS
            mine = layer == k
            yield k, member & np.isin(root, node[mine & (pos == 1)]), member & np.isin(root, node[mine & (neg == 1)])


def sweep(index_map: DataFrame, value: str, thresholds: list[float], seeds: list[Seed], width: int, block: int = BLOCK) -> tuple[DataFrame, list[float]]:
    """((row, col, pos, neg), thresholds in order): the masks of all thresholds at once.

    pos is how many of the ordered thresholds t[0], t[1]... still join the pixel to a positive seed
    by normalised values of at least that threshold; neg the same for negative seeds.  So the mask of
    ``region_mask`` at t[k] is pos > k and neg <= k.
    """
    steps = sorted(set(thresholds))
    n = len(steps)
    level = sum((F.when(F.col("_n") >= t, 1).otherwise(0) for t in steps), F.lit(0))
    rows = normalise(index_map.select("row", "col", value), value, "_n").select("row", "col", level.cast("int").alias("level"))
    blocks = materialise(by_block(rows, block), "sweep-levels")

    def masks(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        v = table.column("level").to_numpy()
        for k in range(n, 0, -1):
            member = v >= k
            if member.any():
                yield k, member

    flags = reached(blocks, masks, seeds, True, width, 4, block)

    def depths(table: pa.Table, flags: pa.Table) -> pa.Table:
        out = np.zeros((2, table.num_rows), np.int32)
        if table.num_rows and flags.num_rows:
            for k, pos, neg in _members(table, flags, masks, width, 4):
                for depth, hit in zip(out, (pos, neg), strict=True):
                    depth[hit] = np.maximum(depth[hit], k)
        return pa.table({"row": table.column("row"), "col": table.column("col"), "pos": pa.array(out[0]), "neg": pa.array(out[1])})

    keys = ["br", "bc"]
    return blocks.groupBy(*keys).cogroup(flags.groupBy(*keys)).applyInArrow(depths, "row int, col int, pos int, neg int"), steps


def balances(depths: DataFrame, steps: list[float]) -> dict[float, int]:
    """Threshold -> pixels of its mask; one job, a table of at most (number of thresholds + 1) squared rows."""
    rows = depths.groupBy("pos", "neg").agg(F.count(F.lit(1)).alias("n")).collect()
    return {t: sum(r["n"] for r in rows if r["pos"] > k and r["neg"] <= k) for k, t in enumerate(steps)}


def seed_regions(blocks: DataFrame, masks: Masks, seeds: list[Seed], width: int, connectivity: int, block: int) -> DataFrame:
    """(row, col, seeds ARRAY<INT>): which seeds reach each pixel in the layer of their number, all by themselves."""
    own = [Seed(s.row, s.col) for s in seeds]
    flags = reached(blocks, masks, own, False, width, connectivity, block)

    def join(table: pa.Table, flags: pa.Table) -> pa.Table:
        at, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        if table.num_rows and flags.num_rows:
            for k, hit, _ in _members(table, flags, masks, width, connectivity):
                at.append(np.flatnonzero(hit))
                seed.append(np.full(len(at[-1]), k, np.int32))
        at, seed = np.concatenate(at), np.concatenate(seed)
        order = np.lexsort((seed, at))
        ends = np.append(0, np.cumsum(np.bincount(at, minlength=table.num_rows)))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(seed[order], pa.int32()))
        return pa.table({"row": table.column("row"), "col": table.column("col"), "seeds": lists})

    keys = ["br", "bc"]
    return blocks.groupBy(*keys).cogroup(flags.groupBy(*keys)).applyInArrow(join, "row int, col int, seeds array<int>")


def _pairs(connectivity: int, shape: tuple[int, int]) -> Iterator[tuple[tuple, tuple]]:
    h, w = shape
    for dr, dc in STEPS[connectivity]:
        yield (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc))), (slice(dr, h), slice(max(0, dc), w - max(0, -dc)))


def equal_regions(pixels: DataFrame, value: str, width: int, connectivity: int, block: int) -> DataFrame:
    """(row, col, value, region): components of neighbouring pixels with one BIGINT value; the least row * width + col."""

    def run(table: pa.Table) -> pa.Table:
        b = _Block(table, width, connectivity)
        ids = np.arange(b.shape[0] * b.shape[1]).reshape(b.shape)
        grid, there = np.zeros(b.shape, np.int64), np.zeros(b.shape, bool)
        at = b.row - b.r0, b.col - b.c0
        grid[at], there[at] = table.column("value").to_numpy(), True
        u, v = [], []
        for x, y in _pairs(connectivity, b.shape):
            same = there[x] & there[y] & (grid[x] == grid[y])
            u.append(ids[x][same])
            v.append(ids[y][same])
        first = join_labels(ids.size, np.concatenate(u), np.concatenate(v)).reshape(b.shape)[at]
        return pa.table({"row": table.column("row"), "col": table.column("col"), "value": table.column("value"), "node": pa.array(b.to_pixel(first), pa.int64())})

    rows = by_block(pixels.select("row", "col", F.col(value).alias("value")), block)
    local = materialise(rows.groupBy("br", "bc").applyInArrow(run, "row int, col int, value bigint, node bigint"), "equal-blocks")
    merged = connected_components(border_links(local.where(_on_rim(block)).select("value", "row", "col", "node"), connectivity, ["value"]))
    return local.join(merged.hint("merge"), F.col("node") == F.col("id"), "left").select("row", "col", F.col("value").alias(value), F.coalesce("component", "node").alias("region"))


def _on_rim(block: int):
    edge = lambda c: (F.col(c) % block == 0) | (F.col(c) % block == block - 1)
    return edge("row") | edge("col")


def region_borders(regions: DataFrame, connectivity: int, block: int) -> DataFrame:
    """(a, b): distinct pairs of neighbouring regions, in both blocks and across their borders."""

    def run(table: pa.Table) -> pa.Table:
        b = _Block(table, 1, connectivity)
        grid = np.full(b.shape, -1, np.int64)
        grid[b.row - b.r0, b.col - b.c0] = table.column("region").to_numpy()
        found = [np.zeros((0, 2), np.int64)]
        for x, y in _pairs(connectivity, b.shape):
            p, q = grid[x].ravel(), grid[y].ravel()
            other = (p >= 0) & (q >= 0) & (p != q)
            found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1)[other])
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    inside = by_block(regions.select("row", "col", "region"), block).groupBy("br", "bc").applyInArrow(run, "a bigint, b bigint")
    across = border_links(regions.where(_on_rim(block)).select("row", "col", F.col("region").alias("node")), connectivity)
    return inside.union(across.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()


def in_order(reach: DataFrame, seeds: list[Seed], width: int, connectivity: int, block: int) -> DataFrame | None:
    """(row, col, label) of what ``seed_regions`` gave, each seed taking what earlier ones leave it; None if there are too many regions.

    A seed's final region is made of whole regions of equal membership: the earlier seeds' regions are,
    and so is what is left of its own, part by part.  So the order is settled on the graph of regions.
    """
    reach = materialise(reach, "seed-reach")
    if reach.where(F.size("seeds") > 1).isEmpty():
        return reach.select("row", "col", F.coalesce(F.get("seeds", F.lit(0)), F.lit(0)).alias("label"))
    some = reach.where(F.size("seeds") > 0).withColumn("_members", F.xxhash64("seeds"))
    regions = materialise(equal_regions(some, "_members", width, connectivity, block), "seed-regions")
    members = materialise(regions.groupBy("_members", "region").agg(F.min(F.struct("row", "col")).alias("at")).select("region", "at.*").join(some.select("row", "col", "seeds").hint("merge"), ["row", "col"]).select("region", "seeds"), "seed-members")
    if members.count() > MOST_REGIONS:
        return None
    spark = reach.sparkSession
    at = spark.createDataFrame([(k, s.row, s.col) for k, s in enumerate(seeds, 1)], "seed int, row int, col int")
    start = {r["seed"]: r["region"] for r in regions.join(F.broadcast(at), ["row", "col"]).select("seed", "region").collect()}

    def settle(links: pa.Table, members: pa.Table) -> pa.Table:
        ids = members.column("region").to_numpy()
        order = np.argsort(ids)
        ids, lists = ids[order], members.column("seeds").combine_chunks().take(pa.array(order))
        owner, seed = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy()
        a, b = (np.searchsorted(ids, links.column(c).to_numpy()) if links.num_rows else np.zeros(0, np.int64) for c in ("a", "b"))
        label = np.zeros(len(ids), np.int32)
        for k in sorted(start):
            free = np.zeros(len(ids), bool)
            free[owner[seed == k]] = True
            free &= label == 0
            own = int(np.searchsorted(ids, start[k]))
            if free[own]:
                both = free[a] & free[b]
                part = join_labels(len(ids), a[both], b[both])
                label[free & (part == part[own])] = k
        return pa.table({"region": pa.array(ids), "label": pa.array(label)})

    links = region_borders(regions, connectivity, block)
    one = F.lit(0).alias("all")
    labels = links.groupBy(one).cogroup(members.groupBy(one)).applyInArrow(settle, "region bigint, label int")
    named = regions.join(labels.hint("merge"), "region").select("row", "col", "label")
    return reach.select("row", "col").join(named.hint("merge"), ["row", "col"], "left").select("row", "col", F.coalesce("label", F.lit(0)).alias("label"))
