"""Regions of interest, slippy tiles, polygons, seeds."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.functions.arith import half_up
from bandloom.model import Affine, Seed

#: Extents of the Web-Mercator square in metres (fixed values): for tile arithmetic, and for rendered tiles.
TILE_WORLD, TILE_ORIGIN = 40075016.686, 20037508.343
RENDER_ORIGIN = 20037508.342789244
POSITIVE, NEGATIVE = ("positive", "pos", "1", "true"), ("negative", "neg", "0", "false")


@dataclass(frozen=True)
class Bounds:
    left: float
    bottom: float
    right: float
    top: float

    def to_window(self, transform: Affine) -> tuple[float, float, float, float]:
        """Fractional (row0, col0, row1, col1)."""
        (r0, c0), (r1, c1) = transform.to_pixel(self.left, self.top), transform.to_pixel(self.right, self.bottom)
        return min(r0, r1), min(c0, c1), max(r0, r1), max(c0, c1)

    def condition(self, x: Column, y: Column) -> Column:
        return x.between(self.left, self.right) & y.between(self.bottom, self.top)

    def disjoint(self, other: Bounds) -> bool:
        return self.right < other.left or self.left > other.right or self.top < other.bottom or self.bottom > other.top

    def clip(self, other: Bounds) -> Bounds:
        return Bounds(max(self.left, other.left), max(self.bottom, other.bottom), min(self.right, other.right), min(self.top, other.top))


def window(pixels: DataFrame, row0: int, col0: int, row1: int, col1: int) -> DataFrame:
    """Pixels of a window; plain comparisons, which reach the scan."""
    r, c = F.col("row"), F.col("col")
    return pixels.where((r >= row0) & (r < row1) & (c >= col0) & (c < col1))


def tile_bounds(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column, Column]:
    """(left, bottom, right, top) in metres of tiles in columns."""
    side = F.lit(TILE_WORLD) / F.pow(F.lit(2.0), z)
    left, top = x * side - TILE_ORIGIN, F.lit(TILE_ORIGIN) - y * side
    return left, top - side, left + side, top


def render_bounds(x: int, y: int, z: int) -> Bounds:
    side = 2 * RENDER_ORIGIN / 2**z
    return Bounds(x * side - RENDER_ORIGIN, RENDER_ORIGIN - (y + 1) * side, (x + 1) * side - RENDER_ORIGIN, RENDER_ORIGIN - y * side)


def clip_boxes(boxes: DataFrame, area: Bounds) -> DataFrame:
    """The boxes (left, bottom, right, top) that meet an area, cut to it; those that only touch it stay as lines or points."""
    apart = (F.col("right") < area.left) | (F.col("left") > area.right) | (F.col("top") < area.bottom) | (F.col("bottom") > area.top)
    cut = {"left": F.greatest("left", F.lit(area.left)), "bottom": F.greatest("bottom", F.lit(area.bottom)), "right": F.least("right", F.lit(area.right)), "top": F.least("top", F.lit(area.top))}
    return boxes.where(~apart).withColumns(cut)


def bounds_to_tiles(boxes: DataFrame, zoom: Column, legacy: bool = False) -> DataFrame:
    """A row (x, y, z) for each tile that a box (left, bottom, right, top in metres) meets.

    ``legacy`` takes the rows of tiles from the top edge to the bottom edge the wrong way
    round, which is empty unless both edges lie in one row of tiles.
    """
    side = F.lit(TILE_WORLD) / F.pow(F.lit(2.0), zoom)
    across = lambda c: ((F.col(c) + TILE_ORIGIN) / side).cast("int")
    down = lambda c: ((F.lit(TILE_ORIGIN) - F.col(c)) / side).cast("int")
    first, last = (down("bottom"), down("top")) if legacy else (down("top"), down("bottom"))
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    out = boxes.withColumn("x", F.explode(upto(across("left"), across("right"))))
    return out.withColumn("y", F.explode(upto(first, last))).withColumn("z", zoom)


def polygon_bounds(geojson: Column) -> Column:
    """struct(left, bottom, right, top) around a GeoJSON polygon."""
    shape = F.from_json(geojson, "type string, coordinates array<array<array<double>>>")
    points = F.flatten(shape["coordinates"])
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("bottom"), F.array_max(xs).alias("right"), F.array_max(ys).alias("top"))


def inside_polygon(x: Column, y: Column, rings: list[list[list[float]]]) -> Column:
    """Even-odd rule over all rings, as one expression."""
    crossings = F.lit(0)
    for ring in rings:
        for (x0, y0, *_), (x1, y1, *_) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y0 == y1:
                continue
            spans = (F.lit(y0) > y) != (F.lit(y1) > y)
            cut = (y - y0) * ((x1 - x0) / (y1 - y0)) + x0
            crossings = crossings + F.when(spans & (x < cut), 1).otherwise(0)
    return crossings % 2 == 1


def polygon_spans(polygons: DataFrame, geojson: str, height: int, width: int, transform: Affine, keys: list[str]) -> DataFrame:
    """(keys, row, col0, col1): the runs of pixels whose centres lie in each polygon, ends included.

    Scan lines: an edge gives a crossing for each row of centres that it spans, a row's crossings in
    order bound its runs (even-odd over all rings, so holes are out).  The work follows the heights
    of the edges, for any number of polygons (a JSON Polygon each); null and broken ones have no runs.
    """
    shape = F.from_json(F.col(geojson), "type string, coordinates array<array<array<double>>>")
    rings = polygons.select(*keys, F.explode(shape["coordinates"]).alias("_ring"))
    n = F.size("_ring")
    edge = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("_ring", i).alias("a"), F.get("_ring", (i + 1) % n).alias("b")))
    at = lambda p: transform.to_pixel(F.get(F.col(f"_e.{p}"), F.lit(0)), F.get(F.col(f"_e.{p}"), F.lit(1)))
    (r0, c0), (r1, c1) = at("a"), at("b")
    edges = rings.where(n > 0).select(*keys, F.explode(edge).alias("_e")).select(*keys, r0.alias("_r0"), c0.alias("_c0"), r1.alias("_r1"), c1.alias("_c1"))
    low, high = F.least("_r0", "_r1"), F.greatest("_r0", "_r1")
    # rows with low <= row + 0.5 < high
    first, last = F.greatest(F.ceil(low - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(high - 0.5) - 1, F.lit(height - 1)).cast("int")
    lines = edges.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("row", F.explode(F.sequence("_first", "_last")))
    cut = F.col("_c0") + (F.col("row") + 0.5 - F.col("_r0")) * ((F.col("_c1") - F.col("_c0")) / (F.col("_r1") - F.col("_r0")))
    cuts = lines.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(cut)).alias("_cuts"))
    pairs = F.transform(F.sequence(F.lit(1), F.expr("size(_cuts) div 2")), lambda i: F.struct(F.get("_cuts", i * 2 - 2).alias("a"), F.get("_cuts", i * 2 - 1).alias("b")))
    runs = cuts.where("size(_cuts) >= 2").select(*keys, "row", F.explode(pairs).alias("_p"))
    # columns with a <= col + 0.5 < b
    left, right = F.greatest(F.ceil(F.col("_p.a") - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(F.col("_p.b") - 0.5) - 1, F.lit(width - 1)).cast("int")
    return runs.select(*keys, "row", left.alias("col0"), right.alias("col1")).where("col0 <= col1")


def polygon_pixels(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col): the pixels of runs."""
    return spans.select(*keys, "row", F.explode(F.sequence("col0", "col1")).alias("col"))


def polygon_zones(pixels: DataFrame, bands: list[str], polygons: DataFrame, geojson: str, height: int, width: int, transform: Affine, keys: list[str]) -> DataFrame:
    """(keys, n, and sum, min and max of each band) of the pixels in each polygon; polygons may overlap.

    Only pixels inside meet the raster, by their row and column.
    """
    inside = polygon_pixels(polygon_spans(polygons, geojson, height, width, transform, keys), keys)
    each = [x for b in bands for x in (F.sum(b).alias(f"sum_{b}"), F.min(b).alias(f"min_{b}"), F.max(b).alias(f"max_{b}"))]
    return inside.join(pixels.select("row", "col", *bands), ["row", "col"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *each)


def clip_to_polygon(pixels: DataFrame, bands: list[str], polygon: dict, height: int, width: int, transform: Affine | None = None) -> DataFrame:
    """Bands are 0 where a pixel's centre is outside the polygon.

    Without a transform the polygon's bounding box is laid over the whole array.
    """
    rings = polygon["coordinates"]
    if transform is None:
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        transform = Affine((max(xs) - min(xs)) / width, 0.0, min(xs), 0.0, -(max(ys) - min(ys)) / height, max(ys))
    x, y = transform.to_geo(F.col("row") + 0.5, F.col("col") + 0.5)
    inside = inside_polygon(x, y, rings)
    return pixels.withColumns({b: F.when(inside, F.col(b)).otherwise(F.lit(0)) for b in bands})


def latlng_to_pixel(lng: Column, lat: Column, box: Bounds, width: int, height: int) -> tuple[Column, Column]:
    """(row, col) by linear interpolation in a box of degrees, rounded half up."""
    col = half_up((lng - box.left) / (box.right - box.left) * (width - 1)).cast("int")
    row = half_up((F.lit(box.top) - lat) / (box.top - box.bottom) * (height - 1)).cast("int")
    return row, col


def remap_seeds(seeds: DataFrame, src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """Seeds on a grid of another (height, width), kept inside it."""
    move = lambda c, k: F.least(F.greatest((F.col(c) * dst[k] / F.lit(src[k])).cast("int"), F.lit(0)), F.lit(dst[k] - 1))
    return seeds.withColumn("row", move("row", 0)).withColumn("col", move("col", 1))


def parse_seeds(texts: DataFrame, column: str, mode: str = "pixel", transform: Affine | None = None, keys: list[str] = ()) -> DataFrame:
    """(keys, seed_id, row, col, kind) of GeoJSON points; the label is the first of label, class, value that is there.

    mode ``crs`` takes coordinates through the transform (floor), else they are (col, row).
    Other geometries, short coordinates and other labels are dropped.
    """
    shape = "features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>>"
    f = texts.select(*keys, F.posexplode(F.from_json(column, shape)["features"]).alias("seed_id", "f")).select(*keys, "seed_id", "f.*")
    f = f.where((F.col("geometry.type") == "Point") & (F.size("geometry.coordinates") >= 2))
    has = lambda k: F.map_contains_key("properties", k)
    get = lambda k: F.try_element_at("properties", F.lit(k))
    label = F.lower(F.when(has("label"), get("label")).when(has("class"), get("class")).when(has("value"), get("value")))
    kind = F.when(label.isin(*POSITIVE), "pos").when(label.isin(*NEGATIVE), "neg")
    x, y = F.get("geometry.coordinates", 0), F.get("geometry.coordinates", 1)
    if mode == "crs":
        row, col = (transform or Affine(1, 0, 0, 0, 1, 0)).to_pixel(x, y)
        row, col = F.floor(row), F.floor(col)
    else:
        row, col = y, x
    return f.select(*keys, "seed_id", row.cast("int").alias("row"), col.cast("int").alias("col"), kind.alias("kind")).where("kind is not null")


def split_seeds(seeds: list[Seed]) -> tuple[list[Seed], list[Seed]]:
    return [s for s in seeds if s.kind == "pos"], [s for s in seeds if s.kind == "neg"]


def downsampled_shape(width: int, height: int, longest: int) -> tuple[int, int]:
    """(width, height) with the longer side at most ``longest``, the aspect kept."""
    side = max(width, height)
    if side <= longest:
        return width, height
    return max(1, round(width * longest / side)), max(1, round(height * longest / side))


def warp_shape(box: Bounds, longest: int) -> tuple[int, int]:
    """(width, height) of an image of a box whose longer side is ``longest``."""
    w, h = box.right - box.left, box.top - box.bottom
    return (longest, max(1, int(round(longest * h / w)))) if w >= h else (max(1, int(round(longest * w / h))), longest)


def parse_polygon(text: str) -> dict:
    shape = json.loads(text)
    if shape.get("type") == "Feature":
        shape = shape["geometry"]
    if shape.get("type") != "Polygon" or not shape.get("coordinates") or not all(math.isfinite(v) for r in shape["coordinates"] for p in r for v in p[:2]):
        raise ValueError("a Polygon with finite coordinates is needed")
    return shape
