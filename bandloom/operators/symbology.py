"""Colour ramps as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions.arith import clip, finite
from bandloom.operators.stats import percentile_row

PERCENTILES = (2.0, 98.0)


@dataclass(frozen=True)
class Stop:
    pos: float = 0.0
    color: str = "#000000"
    alpha: float = 1.0

    def rgba(self) -> tuple[int, int, int, int]:
        h = self.color.lstrip("#")
        return int(h[0:2], 16), int(h[2:4], 16), int(h[4:6], 16), int(min(max(self.alpha, 0.0), 1.0) * 255)


#: The presets' stops (fixed values).
RAMPS: dict[str, tuple[str, list[Stop]]] = {
    "diverging": ("Diverging (Teal-Orange)", [Stop(0.0, "#0b4f6c"), Stop(0.5, "#f4f1e9"), Stop(1.0, "#d8572a")]),
    "sequential": ("Sequential (Terrain)", [Stop(0.0, "#0e2f2a"), Stop(0.45, "#3b8a5a"), Stop(0.75, "#a8c686"), Stop(1.0, "#f2d492")]),
    "mask": ("Mask (Accent)", [Stop(0.0, "#000000", 0.0), Stop(1.0, "#f26522", 0.9)]),
}
@dataclass(frozen=True)
class Style:
    ramp: str = "sequential"
    range_mode: str = "percentile"
    range: tuple[float, float] | None = None


#: Defaults by index (fixed values).
STYLES: dict[str, Style] = {
    "ndvi": Style("diverging", "fixed", (-1.0, 1.0)),
    "ndwi": Style("diverging", "fixed", (-1.0, 1.0)),
    "gndvi": Style("diverging", "fixed", (-1.0, 1.0)),
    "ngrdi": Style("diverging", "fixed", (-1.0, 1.0)),
    "vari": Style("diverging", "fixed", (-1.0, 1.0)),
    "arvi": Style("diverging", "fixed", (-1.0, 1.0)),
    "arvi2": Style("diverging", "fixed", (-1.0, 1.0)),
    "wdrvi": Style("diverging", "fixed", (-1.0, 1.0)),
    "rdvi": Style("diverging", "fixed", (-1.0, 1.0)),
    "nli": Style("diverging", "fixed", (-1.0, 1.0)),
    "gemi": Style("diverging", "fixed", (-1.0, 1.0)),
    "ipvi": Style("sequential", "fixed", (0.0, 1.0)),
    "tndvi": Style("sequential", "fixed", (0.0, 1.5)),
    "evi": Style("sequential", "percentile"),
    "evi2": Style("sequential", "percentile"),
    "savi": Style("sequential", "percentile"),
    "osavi": Style("sequential", "percentile"),
    "msavi": Style("sequential", "percentile"),
    "dvi": Style("sequential", "percentile"),
    "rvi": Style("sequential", "percentile"),
    "sipi": Style("sequential", "percentile"),
    "cvi": Style("sequential", "percentile"),
    "mcari": Style("sequential", "percentile"),
    "mtvi2": Style("sequential", "percentile"),
    "tvi": Style("sequential", "percentile"),
    "wbi": Style("sequential", "percentile"),
    "pwi": Style("sequential", "percentile"),
    "logr": Style("diverging", "percentile"),
}


def style_of(index: str) -> Style:
    return STYLES.get(index, Style())


def ramp_catalog(spark: SparkSession) -> DataFrame:
    rows = [(k, name, s.pos, s.color, s.alpha) for k, (name, stops) in RAMPS.items() for s in stops]
    return spark.createDataFrame(rows, "ramp string, name string, pos double, color string, alpha double")


def range_aggregates(value: str, mode: str, default: tuple[float, float] | None, low: float = PERCENTILES[0], high: float = PERCENTILES[1], custom: tuple[float | None, float | None] = (None, None)) -> tuple[Column, Column]:
    """(min, max) as aggregates or literals: auto and fixed take the default if there is one;
    fixed takes a complete custom range first; percentile, and auto without a default, take
    percentiles; what is left takes min and max.  Without finite values: 0 and 1."""
    v = finite(F.col(value).cast("double"))
    const = lambda pair: (F.max(F.lit(float(pair[0]))), F.max(F.lit(float(pair[1]))))
    if mode == "fixed" and None not in custom:
        return const(custom)
    if mode in ("auto", "fixed") and default is not None:
        return const(default)
    if mode in ("auto", "percentile"):
        both = F.percentile(v, F.array(F.lit(low / 100.0), F.lit(high / 100.0)))  # one aggregate for the two
        a, b = F.get(both, 0), F.get(both, 1)
    else:
        a, b = F.min(v), F.max(v)
    return F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(1.0))


def range_row(pixels: DataFrame, value: str, mode: str, default: tuple[float, float] | None, low: float = PERCENTILES[0], high: float = PERCENTILES[1], custom: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """One row (_low, _high): the range of ``range_aggregates``; of large maps the percentiles are taken without one buffer."""
    fixed = mode == "fixed" and None not in custom or mode in ("auto", "fixed") and default is not None
    if fixed or mode not in ("auto", "percentile"):
        a, b = range_aggregates(value, mode, default, low, high, custom)
        return pixels.agg(a.alias("_low"), b.alias("_high"))
    row = percentile_row(pixels, {"_p": finite(F.col(value).cast("double"))}, [low / 100.0, high / 100.0])
    return row.select(F.coalesce(F.get("_p", 0), F.lit(0.0)).alias("_low"), F.coalesce(F.get("_p", 1), F.lit(1.0)).alias("_high"))


def ramp_channels(x: Column, stops: list[Stop]) -> list[Column]:
    """r, g, b, a for x in [0, 1]: linear between stops, constant outside, truncated."""
    if not stops:
        raise ValueError("a ramp needs at least one stop")
    stops = sorted(stops, key=lambda s: s.pos)
    out = []
    for c in range(4):
        level = [float(s.rgba()[c]) for s in stops]
        expr = F.lit(level[-1])
        for k in range(len(stops) - 1, 0, -1):
            p, q = stops[k - 1].pos, stops[k].pos
            part = F.lit(level[k - 1]) + (x - p) * ((level[k] - level[k - 1]) / (q - p)) if q > p else F.lit(level[k])
            expr = F.when(x <= q, part).otherwise(expr)
        out.append(F.when(x <= stops[0].pos, F.lit(level[0])).otherwise(expr).cast("int"))
    return out


def apply_stops(pixels: DataFrame, value: str, stops: list[Stop], low: Column, high: Column, transparent_zero: bool = False) -> DataFrame:
    """Adds r, g, b, a; all 0 where the value isn't finite; alpha 0 at 0 with ``transparent_zero``."""
    return apply_range(pixels, value, stops, pixels.agg(low.alias("_low"), high.alias("_high")), transparent_zero)


def apply_range(pixels: DataFrame, value: str, stops: list[Stop], limits: DataFrame, transparent_zero: bool = False) -> DataFrame:
    """``apply_stops`` with the range as a table of one row (_low, _high)."""
    out = pixels.crossJoin(F.broadcast(limits))
    v = finite(F.col(value).cast("double"))
    width = F.when(F.col("_high") == F.col("_low"), F.lit(1.0)).otherwise(F.col("_high") - F.col("_low"))
    out = out.withColumn("_x", clip((v - F.col("_low")) / width, 0.0, 1.0))
    channels = [F.when(F.col("_x").isNotNull(), c).otherwise(0) for c in ramp_channels(F.col("_x"), stops)]
    if transparent_zero:
        channels[3] = F.when(F.col(value) == 0, 0).otherwise(channels[3])
    return out.withColumns(dict(zip("rgba", channels, strict=True))).drop("_x", "_low", "_high")


def render(pixels: DataFrame, value: str, index: str | None = None, ramp: str | None = None, mode: str = "auto", custom_range: tuple[float | None, float | None] = (None, None), stops: list[Stop] | None = None, transparent_zero: bool = False) -> DataFrame:
    """Colours by the style of an index, a named ramp or own stops."""
    style = style_of(index) if index else Style()
    return apply_range(pixels, value, stops or RAMPS[ramp or style.ramp][1], range_row(pixels, value, mode, style.range, custom=custom_range), transparent_zero)
