"""Queries of polygons, of warps in further projections, and of rasters that arrive as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandloom.model import Affine, Raster
from bandloom.operators import resample, roi
from bandloom.plans import ingest
from bandloom.plans.raster_queries import INDEX_SQL, PIX, REFL, WIDTH, query
from bandloom.sources import tiled
from bandloom.sources.tables import order_pixels, order_raster
from bandloom.storage import new_path

#: Corners of each nation's quadrilateral and of its hole, in SQL.
_POINTS = [("x", "y"), ("x + w", "y + 0.3"), ("x + w * 0.9", "y + h"), ("x + 1.25", "y + h * 0.8")]
_HOLE = [("x + w * 0.4", "y + h * 0.3"), ("x + w * 0.6", "y + h * 0.4"), ("x + w * 0.5", "y + h * 0.6")]


def _edges(points: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT k, {a[0]} AS x0, {a[1]} AS y0, {b[0]} AS x1, {b[1]} AS y1 FROM q" for a, b in zip(points, [*points[1:], points[0]], strict=True))


@query(
    f"WITH {PIX}, q AS (SELECT n_nationkey AS k, (n_nationkey * 7 % 60)::DOUBLE AS x, (n_nationkey * 3 % 11)::DOUBLE AS y, (20 + n_nationkey % 9)::DOUBLE AS w, (4 + n_nationkey % 5)::DOUBLE AS h FROM nation), "
    f"e AS ({_edges(_POINTS)} UNION ALL {_edges(_HOLE)}), "
    "c AS (SELECT k, row, col, nir, red FROM pixels p JOIN e ON (y0 > row + 0.5) <> (y1 > row + 0.5) AND col + 0.5 < x0 + (row + 0.5 - y0) * ((x1 - x0) / (y1 - y0))), "
    "i AS (SELECT k, row, col, any_value(nir) AS nir, any_value(red) AS red FROM c GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1) "
    "SELECT k AS nation, count(*) AS n, sum(nir)::BIGINT AS sum_nir, max(nir) AS max_nir, min(red) AS min_red FROM i GROUP BY 1"
)
def polygon_zones(spark, sf_dir):
    """Sums over one polygon with a hole for each nation."""
    k = F.col("n_nationkey")
    x, y, w, h = (k * 7 % 60).cast("double"), (k * 3 % 11).cast("double"), (k % 9 + 20).cast("double"), (k % 5 + 4).cast("double")
    outer = [(x, y), (x + w, y + 0.3), (x + w * 0.9, y + h), (x + 1.25, y + h * 0.8)]
    hole = [(x + w * 0.4, y + h * 0.3), (x + w * 0.6, y + h * 0.4), (x + w * 0.5, y + h * 0.6)]
    ring = lambda points: F.array(*[F.array(*p) for p in points])
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring(outer), ring(hole)).alias("coordinates")))
    polygons = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("nation"), shape.alias("shape"))
    height = order_raster(spark, sf_dir).height
    zones = roi.polygon_zones(order_pixels(spark, sf_dir, ["nir", "red"]), ["nir", "red"], polygons, "shape", height, WIDTH, Affine(1.0, 0.0, 0.0, 0.0, 1.0, 0.0), ["nation"])
    return zones.select("nation", "n", "sum_nir", "max_nir", "min_red")


_LAMBERT = Affine(2000.0, 0.0, 600000.0, 0.0, -2000.0, 6700000.0)
_BOX = roi.Bounds(2.0, 46.0, 4.5, 47.5)
_T = lambda p: f"(tan(pi() / 4 - ({p}) / 2) * exp(e * atanh(e * sin({p}))))"
_M = lambda p: f"(cos({p}) / sqrt(1 - e * e * sin({p}) * sin({p})))"


@query(
    f"WITH {PIX}, c AS (SELECT sqrt(CAST(1 AS DOUBLE) / 298.257222101 * (2 - CAST(1 AS DOUBLE) / 298.257222101)) AS e, radians(49.0) AS p1, radians(44.0) AS p2, radians(46.5) AS p0), "
    f"d AS (SELECT *, ln({_M('p1')} / {_M('p2')}) / ln({_T('p1')} / {_T('p2')}) AS n FROM c), f AS (SELECT *, 6378137.0 * {_M('p1')} / (n * pow({_T('p1')}, n)) AS s FROM d), "
    "g AS (SELECT CAST(i // 60 AS INTEGER) AS row, CAST(i % 60 AS INTEGER) AS col FROM range(60 * 48) t(i)), "
    "l AS (SELECT row, col, radians(2.0 + (col + 0.5) * (CAST(2.5 AS DOUBLE) / 60) - 3.0) AS lam, radians(47.5 - (row + 0.5) * (CAST(1.5 AS DOUBLE) / 48)) AS phi FROM g), "
    f"x AS (SELECT row, col, s * pow({_T('phi')}, n) * sin(n * lam) + 700000 AS x, s * pow({_T('p0')}, n) - s * pow({_T('phi')}, n) * cos(n * lam) + 6600000 AS y FROM l, f), "
    "k AS (SELECT row, col, CAST(floor((6700000.0 - y) / 2000) AS INTEGER) AS sr, CAST(floor((x - 600000.0) / 2000) AS INTEGER) AS sc FROM x) "
    "SELECT k.row, k.col, coalesce(pixels.nir, 0) AS nir FROM k LEFT JOIN pixels ON pixels.row = sr AND pixels.col = sc"
)
def warp_lambert(spark, sf_dir):
    """A raster in a Lambert conformal conic projection on a grid of degrees, by nearest pixels."""
    raster = Raster("orders", WIDTH, order_raster(spark, sf_dir).height, _LAMBERT, "EPSG:2154", 0.0)
    return resample.warp(order_pixels(spark, sf_dir, ["nir"]), raster, _BOX, 48, 60)


_UTM_SUM = lambda a, b: " + ".join(f"a{k} * {a}({2 * k} * xi) * {b}({2 * k} * eta)" for k in range(1, 5))


@query(
    f"WITH {PIX}, c AS (SELECT n, sqrt(f * (2 - f)) AS e, 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) * 0.9996 AS s, "
    "n / 2 - n * n * 2 / 3 + n * n * n * 5 / 16 + n * n * n * n * 41 / 180 AS a1, n * n * 13 / 48 - n * n * n * 3 / 5 + n * n * n * n * 557 / 1440 AS a2, n * n * n * 61 / 240 - n * n * n * n * 103 / 140 AS a3, n * n * n * n * 49561 / 161280 AS a4 "
    "FROM (SELECT f, f / (2 - f) AS n FROM (SELECT CAST(1 AS DOUBLE) / 298.257223563 AS f))), "
    "g AS (SELECT CAST(i // 40 AS INTEGER) AS row, CAST(i % 40 AS INTEGER) AS col FROM range(40 * 30) t(i)), "
    "l AS (SELECT row, col, radians(88.3507 + (col + 0.5) * (CAST(0.003 AS DOUBLE) / 40) - 87.0) AS lam, radians(27.1522 - (row + 0.5) * (CAST(0.0004 AS DOUBLE) / 30)) AS phi FROM g), "
    "t AS (SELECT row, col, lam, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM l, c), "
    "u AS (SELECT row, col, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM t), "
    f"x AS (SELECT row, col, s * (eta + {_UTM_SUM('cos', 'sinh')}) + 500000 AS x, s * (xi + {_UTM_SUM('sin', 'cosh')}) AS y FROM u, c), "
    "k AS (SELECT row, col, CAST(floor((3004017.0 - y) / 3) AS INTEGER) AS sr, CAST(floor((x - 633825.0) / 3) AS INTEGER) AS sc FROM x) "
    "SELECT k.row, k.col, coalesce(pixels.nir, 0) AS nir FROM k LEFT JOIN pixels ON pixels.row = sr AND pixels.col = sc"
)
def warp_utm(spark, sf_dir):
    """The raster in its UTM zone on a grid of degrees, by nearest pixels."""
    return resample.warp(order_pixels(spark, sf_dir, ["nir"]), order_raster(spark, sf_dir), roi.Bounds(88.3507, 27.1518, 88.3537, 27.1522), 30, 40)


_POLAR = Affine(1000.0, 0.0, -50_000.0, 0.0, -1000.0, -1_900_000.0)


@query(
    f"WITH {PIX}, c AS (SELECT sqrt(CAST(1 AS DOUBLE) / 298.257223563 * (2 - CAST(1 AS DOUBLE) / 298.257223563)) AS e, radians(70.0) AS p1), s AS (SELECT e, 6378137.0 * {_M('p1')} / {_T('p1')} AS s FROM c), "
    "g AS (SELECT CAST(i // 50 AS INTEGER) AS row, CAST(i % 50 AS INTEGER) AS col FROM range(50 * 30) t(i)), "
    "l AS (SELECT row, col, radians(-46.0 + (col + 0.5) * (CAST(3 AS DOUBLE) / 50) + 45.0) AS lam, radians(72.6 - (row + 0.5) * (CAST(1 AS DOUBLE) / 30)) AS phi FROM g), "
    f"x AS (SELECT row, col, s * {_T('phi')} * sin(lam) AS x, -s * {_T('phi')} * cos(lam) AS y FROM l, s), "
    "k AS (SELECT row, col, CAST(floor((-1900000.0 - y) / 1000) AS INTEGER) AS sr, CAST(floor((x + 50000.0) / 1000) AS INTEGER) AS sc FROM x) "
    "SELECT k.row, k.col, coalesce(pixels.nir, 0) AS nir FROM k LEFT JOIN pixels ON pixels.row = sr AND pixels.col = sc"
)
def warp_polar(spark, sf_dir):
    """A raster in polar stereographic coordinates on a grid of degrees."""
    raster = Raster("orders", WIDTH, order_raster(spark, sf_dir).height, _POLAR, "EPSG:3413", 0.0)
    return resample.warp(order_pixels(spark, sf_dir, ["nir"]), raster, roi.Bounds(-46.0, 71.6, -43.0, 72.6), 30, 50)


@query(f"WITH {REFL} SELECT row, col, round({INDEX_SQL['ndvi']}, 9) AS ndvi, round({INDEX_SQL['evi2']}, 9) AS evi2, CAST(NULL AS DOUBLE) AS gli FROM refl".replace("CASE WHEN nir <> 0", "CASE WHEN NOT (nir = 0 AND red = 0)"))
def precompute_stream(spark, sf_dir):
    """Maps of a raster that arrives as a file, by a stream that is run twice."""
    from dataclasses import replace

    base = new_path(spark, "arrivals")
    tiled.write_tiled(order_pixels(spark, sf_dir, ["nir", "red"]), ["nir", "red"], replace(order_raster(spark, sf_dir), descriptions=("nir", "red")), f"{base}/in/orders.tif", "uint16", tile=64)
    for _ in range(2):
        ingest.precompute_files(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", ["ndvi", "evi2", "gli"]).awaitTermination()
    return ingest.read_maps(spark, f"{base}/out").select("row", "col", *[F.round(n, 9).alias(n) for n in ("ndvi", "evi2", "gli")])



@query("WITH b AS (SELECT o_orderkey AS id, CAST(o_orderkey % 300 AS DOUBLE) AS l, CAST(o_orderkey % 170 AS DOUBLE) AS b, CAST(o_orderkey % 300 + 1 + o_orderkey % 40 AS DOUBLE) AS r, CAST(o_orderkey % 170 + 1 + o_orderkey % 25 AS DOUBLE) AS t FROM orders) SELECT id, greatest(l, 100.5) AS lft, greatest(b, 60.25) AS bottom, least(r, 180.0) AS rgt, least(t, 120.0) AS top FROM b WHERE NOT (r < 100.5 OR l > 180.0 OR t < 60.25 OR b > 120.0)")
def clipped_boxes(spark, sf_dir):
    """A box for each order, cut to an area."""
    k = F.col("o_orderkey")
    boxes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), (k % 300).cast("double").alias("left"), (k % 170).cast("double").alias("bottom"), (k % 300 + 1 + k % 40).cast("double").alias("right"), (k % 170 + 1 + k % 25).cast("double").alias("top"))
    return roi.clip_boxes(boxes, roi.Bounds(100.5, 60.25, 180.0, 120.0)).withColumnsRenamed({"left": "lft", "right": "rgt"})


@query(
    "WITH w AS (SELECT o_orderkey AS id, CAST(400 + o_orderkey % 600 AS INTEGER) AS nm FROM orders), "
    "c(i, name, centre) AS (VALUES (1, 'coastal_blue', 443), (2, 'blue', 490), (3, 'green_i', 531), (4, 'green', 565), (5, 'yellow', 610), (6, 'red', 665), (7, 'rededge', 705), (8, 'nir', 865)), "
    "f(nm, name) AS (VALUES (430, 'coastal_blue'), (445, 'coastal_blue'), (490, 'blue'), (531, 'green_i'), (550, 'green'), (565, 'green'), (610, 'yellow'), (670, 'red'), (680, 'red'), (700, 'rededge'), (705, 'rededge'), (750, 'rededge'), (800, 'nir'), (865, 'nir'), (900, 'nir'), (970, 'nir')), "
    "n AS (SELECT nm, arg_min(name, abs(centre - nm) * 10 + i) AS name FROM (SELECT DISTINCT nm FROM w), c GROUP BY nm) "
    "SELECT id, w.nm, coalesce(f.name, n.name) AS band FROM w JOIN n ON n.nm = w.nm LEFT JOIN f ON f.nm = w.nm"
)
def wavelength_bands(spark, sf_dir):
    """The band of a wavelength for each order."""
    from bandloom.plans import registry

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 600 + 400).cast("int").alias("nm"))
    return orders.withColumn("band", registry.band_column(F.col("nm")))
