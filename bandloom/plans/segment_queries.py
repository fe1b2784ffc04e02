"""Queries of the distributed segmentation: small blocks, so that regions cross many borders."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandloom.operators import layers, scaling, segmentation, topology
from bandloom.plans.raster_queries import _SEED_ROWS, GROW_SEEDS, NORM, ORACLES, SEEDS, WIDTH, _grow_sql, index_map, query
from bandloom.sources.tables import order_pixels, order_raster

BLOCK = 32
SWEEP = [0.4, 0.45, 0.5, 0.6]
_WANT = ", ".join(f"({k}, CAST({t} AS DOUBLE))" for k, t in enumerate(SWEEP))


@query(
    f"WITH RECURSIVE seeds(id, row, col, kind) AS (VALUES {_SEED_ROWS}), t(k, low) AS (VALUES {_WANT}), {NORM}, cand AS MATERIALIZED (SELECT k, row, col FROM norm, t WHERE n >= low), "
    "f AS (SELECT k, s.id, c.row, c.col FROM seeds s JOIN cand c USING (row, col) UNION SELECT f.k, f.id, c.row, c.col FROM f, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(dr, dc), cand c WHERE c.k = f.k AND c.row = f.row + d.dr AND c.col = f.col + d.dc), "
    "hit AS (SELECT k, f.row, f.col, max(CASE WHEN kind = 'pos' THEN 1 ELSE 0 END) AS p, max(CASE WHEN kind = 'neg' THEN 1 ELSE 0 END) AS n FROM f JOIN seeds s USING (id) GROUP BY 1, 2, 3) "
    "SELECT t.low AS threshold, norm.row, norm.col, CAST(CASE WHEN p = 1 AND hit.n = 0 THEN 1 ELSE 0 END AS TINYINT) AS mask FROM norm CROSS JOIN t LEFT JOIN hit ON hit.k = t.k AND hit.row = norm.row AND hit.col = norm.col"
)
def threshold_sweep(spark, sf_dir):
    """The masks of several thresholds from one pass."""
    depths, steps = layers.sweep(index_map(spark, sf_dir, "ndvi"), "ndvi", SWEEP, SEEDS, WIDTH, BLOCK)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), ((F.col("pos") > k) & (F.col("neg") <= k)).cast("tinyint").alias("mask")) for k, t in enumerate(steps)]))
    return depths.select("row", "col", each.alias("e")).select("e.threshold", "row", "col", "e.mask")


@query(ORACLES["region_grow"])
def region_grow_blocks(spark, sf_dir):
    return segmentation.region_mask(index_map(spark, sf_dir, "ndvi"), "ndvi", 0.45, SEEDS, WIDTH, block=BLOCK)


@query(ORACLES["components_sizes"])
def components_sizes_blocks(spark, sf_dir):
    cand = scaling.candidates(index_map(spark, sf_dir, "ndvi"), "ndvi", 0.8)
    return topology.components(cand, WIDTH, 4, BLOCK).groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


def _grow(spark, sf_dir, bands, threshold, connectivity, metric="euclidean"):
    grower = segmentation.RegionGrowing(connectivity, threshold, metric)
    return grower.grow(order_pixels(spark, sf_dir, bands), bands, GROW_SEEDS, order_raster(spark, sf_dir).height, WIDTH, block=BLOCK).labels


_FOUR, _EIGHT = "(0, 1), (1, 0), (0, -1), (-1, 0)", "(0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)"


@query(_grow_sql(["nir"], 3000, _FOUR))
def grow_blocks_c4(spark, sf_dir):
    return _grow(spark, sf_dir, ["nir"], 3000, 4)


@query(_grow_sql(["nir"], 2500, _EIGHT))
def grow_blocks_c8(spark, sf_dir):
    return _grow(spark, sf_dir, ["nir"], 2500, 8)


@query(_grow_sql(["nir", "red", "green"], 4000, _EIGHT))
def grow_blocks_multispectral(spark, sf_dir):
    return _grow(spark, sf_dir, ["nir", "red", "green"], 4000, 8, "chebyshev")


def _progressive_sql(seeds: list[tuple[int, int, str]], threshold: float, rounds: int = 10) -> str:
    """CTEs state0, state1... of progressive refinement, round by round, from a CTE base(row, col, v)."""
    rows = ", ".join(f"({r}, {c}, {1 if kind == 'pos' else 2})" for r, c, kind in seeds)
    parts = [
        f"sown(row, col, s) AS (VALUES {rows})",
        "state0 AS MATERIALIZED (SELECT base.row, base.col, v, coalesce(s, 0) AS state FROM base LEFT JOIN (SELECT row, col, max(s) AS s FROM sown GROUP BY 1, 2) x ON x.row = base.row AND x.col = base.col)",
        f"now0 AS (SELECT CAST({threshold} AS DOUBLE) AS low, false AS done, CAST(NULL AS BIGINT) AS held)",
    ]
    for k in range(rounds):
        n = k + 1
        parts += [
            # least pixel number of each component, spread from pixel to pixel
            f"c{n}(row, col, root) USING KEY (row, col) AS (SELECT row, col, row * 100000 + col FROM state{k}, now{k} WHERE state = 1 AND NOT done UNION "
            f"SELECT o.row, o.col, min(c.root) FROM c{n} c, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(dr, dc), recurring.c{n} o WHERE o.row = c.row + dr AND o.col = c.col + dc AND c.root < o.root GROUP BY 1, 2)",
            f"big{n} AS MATERIALIZED (SELECT row, col FROM c{n} WHERE root IN (SELECT root FROM c{n} GROUP BY root HAVING count(*) >= 10))",
            f"left{n} AS MATERIALIZED (SELECT s.row, s.col, s.v, CASE WHEN (SELECT done FROM now{k}) OR NOT EXISTS (SELECT 1 FROM c{n}) THEN s.state WHEN b.row IS NOT NULL THEN 1 ELSE 0 END AS state FROM state{k} s LEFT JOIN big{n} b ON b.row = s.row AND b.col = s.col)",
            f"stat{n} AS (SELECT count(*) AS n, avg(v) AS m, stddev_pop(v) AS d FROM left{n} WHERE state = 1 AND v > 0)",
            f"try{n} AS MATERIALIZED (SELECT low, held, done OR n < 10 AS over, least(greatest(m - 0.5 * CASE WHEN d > 0 THEN d ELSE CAST(0.1 AS DOUBLE) END, CAST(0.1 AS DOUBLE)), CAST(0.9 AS DOUBLE)) AS fresh FROM now{k}, stat{n})",
            f"stop{n} AS MATERIALIZED (SELECT *, over OR abs(fresh - low) < 0.01 AS still FROM try{n})",
            f"state{n} AS MATERIALIZED (SELECT row, col, v, CASE WHEN still THEN state WHEN state = 1 OR v >= fresh THEN 1 ELSE 0 END AS state FROM left{n}, stop{n})",
            f"sum{n} AS (SELECT count(*) AS n FROM state{n} WHERE state = 1)",
            f"now{n} AS MATERIALIZED (SELECT CASE WHEN over THEN low ELSE fresh END AS low, still OR coalesce({'true' if k else 'false'} AND held > 0 AND abs(sum{n}.n - held) < 0.01 * held, false) AS done, sum{n}.n AS held FROM stop{n}, sum{n})",
        ]
    return ", ".join(parts)


_PATCH = [(r, c, "pos") for r in range(4, 8) for c in range(40, 46)]
ORACLES["progressive"] = f"WITH RECURSIVE {NORM}, base AS (SELECT row, col, n AS v FROM norm), {_progressive_sql([*_PATCH, (9, 9, 'neg')], 0.5)} SELECT row, col, CAST(state AS INTEGER) AS state FROM state10"
_GREY = "CAST(trunc(least(greatest(v * 255, 0), 255)) AS INTEGER)"
ORACLES["progressive_roi"] = (
    f"WITH RECURSIVE {NORM}, base AS MATERIALIZED (SELECT row, col, CASE WHEN row < 12 AND col > 10 THEN n ELSE n * CAST(0.3 AS DOUBLE) END AS v FROM norm), {_progressive_sql(_PATCH, 0.5)}, "
    "o AS (SELECT row, col, v, row < 12 AND col > 10 AS inside, CASE WHEN row < 12 AND col > 10 THEN state ELSE 0 END AS mask FROM state10) "
    f"SELECT row, col, CAST(mask AS INTEGER) AS mask, CASE WHEN mask > 0 THEN 255 ELSE {_GREY} END AS r, CASE WHEN mask > 0 THEN 0 ELSE {_GREY} END AS g, CASE WHEN mask > 0 THEN 0 ELSE {_GREY} END AS b, CASE WHEN mask > 0 OR inside THEN 255 ELSE 76 END AS a FROM o"
)
