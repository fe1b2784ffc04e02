"""The data model: rasters, affine transforms, bands, seeds, result pairs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

#: Band numbers, names and centre wavelengths in nm (fixed values).
BANDS = {
    "coastal_blue": (1, 443),
    "blue": (2, 490),
    "green_i": (3, 531),
    "green": (4, 565),
    "yellow": (5, 610),
    "red": (6, 665),
    "rededge": (7, 705),
    "nir": (8, 865),
}
REFLECTANCE_SCALE = 10000.0
SCALE_LIMIT = 1.5

PIXEL_KEYS = ["row", "col"]
RASTER_SCHEMA = "raster_id string, path string, crs string, bounds struct<left:double,bottom:double,right:double,top:double>, width int, height int, count int, dtype string, transform array<double>, nodata double, descriptions array<string>"


@dataclass(frozen=True)
class Affine:
    """x = a*col + b*row + c, y = d*col + e*row + f.  Works on numbers and on columns."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    def to_geo(self, row, col):
        """The upper left corner of a pixel as (x, y)."""
        return col * self.a + row * self.b + self.c, col * self.d + row * self.e + self.f

    def to_pixel(self, x, y):
        """Fractional (row, col)."""
        det = self.a * self.e - self.b * self.d
        dx, dy = x - self.c, y - self.f
        return (dy * self.a - dx * self.d) / det, (dx * self.e - dy * self.b) / det

    def to_pixel_truncated(self, x: Column, y: Column) -> tuple[Column, Column]:
        row, col = self.to_pixel(x, y)
        return row.cast("int"), col.cast("int")

    def scaled(self, sx: float, sy: float) -> Affine:
        return Affine(self.a * sx, self.b * sy, self.c, self.d * sx, self.e * sy, self.f)

    def bounds(self, width: int, height: int) -> tuple[float, float, float, float]:
        (x0, y0), (x1, y1) = self.to_geo(0, 0), self.to_geo(height, width)
        return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)


@dataclass(frozen=True)
class Raster:
    """Header of one raster; its pixels are a DataFrame (row, col, a column for each band)."""

    raster_id: str
    width: int
    height: int
    transform: Affine
    crs: str = "EPSG:4326"
    nodata: float | None = None
    descriptions: tuple[str, ...] = tuple(BANDS)
    dtype: str = "uint16"
    path: str = ""

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.transform.bounds(self.width, self.height)


@dataclass(frozen=True)
class Seed:
    row: int
    col: int
    kind: str = "pos"


@dataclass
class Segmentation:
    """labels: (row, col, label); region_stats: a row for each label."""

    labels: DataFrame
    seeds: list[Seed]
    region_stats: DataFrame
    info: dict = field(default_factory=dict)
