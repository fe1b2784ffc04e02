"""Queries that decode what pictures hold: strips, rendered maps, previews, tiles."""

from __future__ import annotations

from bandloom.model import Affine, Raster
from bandloom.operators import symbology, tiles
from bandloom.operators.symbology import Stop
from bandloom.plans.raster_queries import _FIXED_X, _TERRAIN, NDVI, PIX, WIDTH, _ramp_sql, index_map, query
from bandloom.sources import png
from bandloom.sources.tables import order_pixels, order_raster
from bandloom.storage import new_path

#: The diverging ramp, by hand.
_TEAL = [Stop(0.0, "#0b4f6c"), Stop(0.5, "#f4f1e9"), Stop(1.0, "#d8572a")]
#: A grid of degrees whose arithmetic is exact, so that a picture of the raster's size has a pixel for each of its own.
EXACT = Affine(2.0**-7, 0.0, 10.0, 0.0, -(2.0**-7), 50.0)
MERCATOR = Affine(100.0, 0.0, 1000000.0, 0.0, -100.0, 6000000.0)
ZOOMS = [9, 10, 11]


@query(f"WITH {NDVI}, q AS (SELECT min(v) AS lo, max(v) AS hi FROM ndvi), x AS (SELECT row, col, CASE WHEN v IS NOT NULL THEN least(greatest((v - lo) / (hi - lo), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) END AS x FROM ndvi, q) SELECT row, col, {_ramp_sql(_TERRAIN, 'x')} FROM x")
def png_strips(spark, sf_dir):
    """A picture written as a file by strips of eight rows, and decoded."""
    low, high = symbology.range_aggregates("ndvi", "full", None)
    coloured = symbology.apply_stops(index_map(spark, sf_dir, "ndvi"), "ndvi", symbology.RAMPS["sequential"][1], low, high)
    path = new_path(spark, "picture") + ".png"
    png.write_picture(coloured, order_raster(spark, sf_dir).height, WIDTH, path, rows=8)
    return png.strip_pixels(png.file_strips(spark, path), WIDTH, rows=8)


def _engine(spark, sf_dir, transform, crs):
    from bandloom.plans.engine import Engine

    engine, raster = Engine(spark), order_raster(spark, sf_dir)
    engine.use(Raster("orders", WIDTH, raster.height, transform, crs, 0.0), order_pixels(spark, sf_dir))
    return engine, raster.height


@query(f"WITH {NDVI}, x AS (SELECT row, col, CASE WHEN v IS NOT NULL THEN {_FIXED_X} END AS x FROM ndvi) SELECT row, col, {_ramp_sql(_TEAL, 'x')} FROM x")
def render_pixels(spark, sf_dir):
    """What ``Engine.render`` draws of an index in its own style."""
    from bandloom.plans.engine import RenderRequest

    engine, height = _engine(spark, sf_dir, EXACT, "EPSG:4326")
    return png.strip_pixels(*engine.render_strips(RenderRequest("ndvi", max_size=max(height, WIDTH))))


_BAND_X = "CASE WHEN red <> 0 THEN least(greatest((red - lo) / (hi - lo), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) END AS x"


@query(f"WITH {PIX}, q AS (SELECT quantile_cont(CAST(nullif(red, 0) AS DOUBLE), 0.02) AS lo, quantile_cont(CAST(nullif(red, 0) AS DOUBLE), 0.98) AS hi FROM pixels), x AS (SELECT row, col, {_BAND_X} FROM pixels, q) SELECT row, col, {_ramp_sql(_TERRAIN, 'x')} FROM x")
def render_band_pixels(spark, sf_dir):
    """What ``Engine.render`` draws of a single band."""
    from bandloom.plans.engine import RenderRequest

    engine, height = _engine(spark, sf_dir, EXACT, "EPSG:4326")
    return png.strip_pixels(*engine.render_strips(RenderRequest(band=6, max_size=max(height, WIDTH))))


_FIRST = ["coastal_blue", "blue", "green_i"]


def _stretched(value: str, low: str, high: str) -> str:
    return f"CAST(trunc(least(greatest(CASE WHEN {high} > {low} THEN ({value} - {low}) / ({high} - {low}) * 255.0 ELSE {value} END, 0), 255)) AS INTEGER)"


_LIMITS = ", ".join(f"quantile_cont(CASE WHEN {b} > 0 THEN CAST({b} AS DOUBLE) END, 0.02) AS lo_{b}, quantile_cont(CASE WHEN {b} > 0 THEN CAST({b} AS DOUBLE) END, 0.98) AS hi_{b}" for b in _FIRST)
_SHOWN = ", ".join(f"{_stretched(b, f'lo_{b}', f'hi_{b}')} AS {c}" for b, c in zip(_FIRST, "rgb", strict=True))


@query(f"WITH {PIX}, q AS (SELECT {_LIMITS} FROM pixels) SELECT row, col, {_SHOWN}, CASE WHEN coastal_blue > 0 OR blue > 0 OR green_i > 0 THEN 255 ELSE 0 END AS a FROM pixels, q")
def preview_pixels(spark, sf_dir):
    """What ``Engine.preview`` draws."""
    engine, height = _engine(spark, sf_dir, EXACT, "EPSG:4326")
    return png.strip_pixels(*engine.preview_strips(max(height, WIDTH)))


_SIDE = "(CAST(40075016.685578488 AS DOUBLE) / (1 << z))"
_TILE_LIMITS = ", ".join(f"coalesce(quantile_cont(CASE WHEN {b} > 0 THEN {b} END, 0.02), CAST(0 AS DOUBLE)) AS lo_{b}, coalesce(quantile_cont(CASE WHEN {b} > 0 THEN {b} END, 0.98), CAST(0 AS DOUBLE)) AS hi_{b}" for b in _FIRST)


@query(
    f"WITH {PIX}, h AS (SELECT max(row) + 1 AS height FROM pixels), "
    "l AS (SELECT z, CAST(40075016.686 AS DOUBLE) / (1 << z) AS side FROM (VALUES (9), (10), (11)) t(z)), "
    "t AS (SELECT z, x, y FROM (SELECT z, side, unnest(range(CAST(trunc((1000000.0 + 20037508.343) / side) AS BIGINT), CAST(trunc((1010000.0 + 20037508.343) / side) AS BIGINT) + 1)) AS x, height FROM l, h) a, "
    "LATERAL (SELECT unnest(range(CAST(trunc((20037508.343 - 6000000.0) / a.side) AS BIGINT), CAST(trunc((20037508.343 - (6000000.0 - 100 * a.height)) / a.side) AS BIGINT) + 1)) AS y) b), "
    "i AS (SELECT CAST(i AS INTEGER) AS i FROM range(256) r(i)), "
    f"g AS (SELECT z, x, y, a.i AS row, b.i AS col, (x * {_SIDE} - CAST(20037508.342789244 AS DOUBLE) + (b.i + 0.5) * ({_SIDE} / 256) - 1000000.0) / 100.0 - 0.5 AS c, "
    f"(6000000.0 - (CAST(20037508.342789244 AS DOUBLE) - y * {_SIDE} - (a.i + 0.5) * ({_SIDE} / 256))) / 100.0 - 0.5 AS r FROM t, i a, i b), "
    "k AS (SELECT z, x, y, g.row, g.col, CAST(floor(r) AS INTEGER) + dr AS sr, CAST(floor(c) AS INTEGER) + dc AS sc, (CASE WHEN dr = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) * (CASE WHEN dc = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) AS w FROM g, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc)), "
    f"v AS (SELECT z, x, y, k.row, k.col, {', '.join(f'CASE WHEN sum(w) > 0 THEN sum(w * {b}) / sum(w) ELSE 0 END AS {b}' for b in _FIRST)} FROM k JOIN pixels p ON p.row = sr AND p.col = sc GROUP BY 1, 2, 3, 4, 5), "
    f"q AS (SELECT z, x, y, {_TILE_LIMITS} FROM v GROUP BY 1, 2, 3), "
    f"e AS (SELECT q.z, q.x, q.y, v.row, v.col, {', '.join(f'{_stretched(f"v.{b}", f"lo_{b}", f"hi_{b}")} AS {c}' for b, c in zip(_FIRST, 'rgb', strict=True))}, CASE WHEN coastal_blue > 0 OR blue > 0 OR green_i > 0 THEN 255 ELSE 0 END AS a FROM q JOIN v ON v.z = q.z AND v.x = q.x AND v.y = q.y) "
    "SELECT CAST(q.z AS INTEGER) AS z, CAST(q.x AS INTEGER) AS x, CAST(q.y AS INTEGER) AS y, a.i AS row, b.i AS col, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b_, 0) AS b, coalesce(a_, 0) AS a "
    "FROM q CROSS JOIN i a CROSS JOIN i b LEFT JOIN (SELECT z, x, y, row, col, r, g, b AS b_, a AS a_ FROM e) e ON e.z = q.z AND e.x = q.x AND e.y = q.y AND e.row = a.i AND e.col = b.i"
)
def tile_matrix_pixels(spark, sf_dir):
    """All tiles of three zooms, drawn by one job and decoded."""
    raster = Raster("orders", WIDTH, order_raster(spark, sf_dir).height, MERCATOR, "EPSG:3857", 0.0)
    drawn = tiles.tile_matrix(order_pixels(spark, sf_dir, _FIRST), raster, ZOOMS, _FIRST)
    return png.pixels(drawn, "png", ["z", "x", "y"])
