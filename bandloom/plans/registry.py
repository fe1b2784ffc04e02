"""The formulas by name, the bands they need, and the catalog of what is and isn't supported."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions import indices as ix
from bandloom.model import BANDS

DIRECT = ("nir", "red", "green", "blue")
#: Wavelengths with a band of their own (fixed values); others go to the nearest centre.
WAVELENGTH_BANDS = {
    430: "coastal_blue", 445: "coastal_blue", 490: "blue", 531: "green_i", 550: "green", 565: "green", 610: "yellow", 670: "red", 680: "red",
    700: "rededge", 705: "rededge", 750: "rededge", 800: "nir", 865: "nir", 900: "nir", 970: "nir",
}
#: Names listed as not supported, and why.
UNSUPPORTED = {
    "gvmi": "needs a short-wave infrared band",
    "nbr": "needs a short-wave infrared band",
    "tasseled_cap": "needs coefficients for the sensor",
    "vci": "needs a time series",
}


@dataclass(frozen=True)
class Formula:
    name: str
    display: str
    required: tuple[str, ...]
    compute: Callable[..., Column]
    params: dict[str, float] = field(default_factory=dict)

    def bands(self) -> list[str]:
        return [b for b, _ in resolve(self.required)]

    @property
    def approximate(self) -> bool:
        return any(approx for _, approx in resolve(self.required))

    @property
    def status(self) -> str:
        return "requires_params" if self.params else "supported_approx" if self.approximate else "supported"

    def column(self, prefix: str = "", **params: float) -> Column:
        return self.compute(*[F.col(prefix + b) for b in self.bands()], **(self.params | params))


def band_for_wavelength(nm: int) -> str:
    """The band of the table, or the one of nearest centre (the first of equals)."""
    return WAVELENGTH_BANDS.get(nm) or min(BANDS, key=lambda b: abs(BANDS[b][1] - nm))


def band_column(nm: Column) -> Column:
    """``band_for_wavelength`` of a column of wavelengths in nm; null for null."""
    known = F.create_map(*[F.lit(x) for pair in WAVELENGTH_BANDS.items() for x in pair])
    gaps = F.array(*[F.struct(F.abs(nm - centre).alias("gap"), F.lit(k).alias("place"), F.lit(b).alias("band")) for k, (b, (_, centre)) in enumerate(BANDS.items())])
    return F.when(nm.isNotNull(), F.coalesce(F.try_element_at(known, nm.cast("int")), F.array_min(gaps)["band"]))


#: Keys that name no band, and what to say of them (fixed value).
NO_BAND = {"swir": "SWIR not available"}


def resolve(required: tuple[str, ...]) -> list[tuple[str, bool]]:
    """(band, whether it is an approximation by wavelength) for each key: a band's name or a wavelength in nm."""
    known = {key: (key, False) for key in DIRECT} | {key: (band_for_wavelength(int(key)), True) for key in required if key.isdigit()}
    missing = [key for key in required if key not in known]
    if missing:
        raise ValueError(NO_BAND.get(missing[0], f"Band not found: {missing[0]}"))
    return [known[key] for key in required]


_formulas: dict[str, Formula] = {}


def register_formula(name: str, required: tuple[str, ...], compute: Callable[..., Column], params: dict[str, float] | None = None, display: str | None = None) -> Formula:
    """Add a formula: ``compute`` maps band columns (and params) to a column."""
    f = Formula(name, display or name.upper(), tuple(required), compute, params or {})
    f.bands()
    _formulas[name] = f
    return f


for _name, _bands, _compute, _params in (
    ("ndvi", "nir red", ix.ndvi, None),
    ("evi", "nir red blue", ix.evi, None),
    ("evi2", "nir red", ix.evi2, None),
    ("savi", "nir red", ix.savi, {"l": 0.5}),
    ("osavi", "nir red", ix.osavi, None),
    ("msavi", "nir red", ix.msavi, None),
    ("rdvi", "nir red", ix.rdvi, None),
    ("ipvi", "nir red", ix.ipvi, None),
    ("dvi", "nir red", ix.dvi, None),
    ("rvi", "nir red", ix.rvi, None),
    ("ndwi", "green nir", ix.ndwi, None),
    ("wbi", "970 900", ix.water_band, None),
    ("pwi", "970 900", ix.water_band, None),
    ("nli", "nir red", ix.nli, None),
    ("gndvi", "nir green", ix.gndvi, None),
    ("sipi", "800 445 680", ix.sipi, None),
    ("cvi", "nir red green", ix.cvi, None),
    ("mcari", "700 670 550", ix.mcari, None),
    ("arvi", "nir red blue", ix.arvi, {"y": 0.08}),
    ("arvi2", "nir red", ix.arvi2, None),
    ("atsavi", "nir red", ix.atsavi, {"a": 1.0, "b": 0.0, "x": 0.08}),
    ("wdvi", "nir red", ix.wdvi, {"a": 1.0}),
    ("wdrvi", "nir red", ix.wdrvi, {"alpha": 0.1}),
    ("gli", "green red blue", ix.gli, None),
    ("ngrdi", "green red", ix.ngrdi, None),
    ("vari", "green red blue", ix.vari, None),
    ("gemi", "nir red", ix.gemi, None),
    ("mtvi2", "800 550 670", ix.mtvi2, None),
    ("tvi", "750 550 670", ix.tvi, None),
    ("tndvi", "nir red", ix.tndvi, None),
    ("logr", "nir red", ix.log_ratio, None),
):
    register_formula(_name, tuple(_bands.split()), _compute, _params, "LogR" if _name == "logr" else None)


def get_formula(name: str) -> Formula:
    """Exact name, case included; KeyError for others."""
    return _formulas[name]


def formula_names() -> list[str]:
    return list(_formulas)


def ready_names() -> list[str]:
    """The formulas that need no parameters."""
    return [n for n, f in _formulas.items() if not f.params]


def catalog(spark: SparkSession) -> DataFrame:
    """A row for each formula and each unsupported name."""
    rows = [(f.name, f.display, f.bands(), f.status, "bands chosen by wavelength" if f.approximate else None, f.params) for f in _formulas.values()]
    rows += [(n, n.upper(), [], "unsupported", why, {}) for n, why in UNSUPPORTED.items()]
    return spark.createDataFrame(rows, "name string, display_name string, required_bands array<string>, status string, note string, params map<string,double>")


def add_indices(pixels: DataFrame, names: list[str]) -> DataFrame:
    """All indices in one projection over one scan; unknown names, or those whose bands are missing, are left out."""
    have = set(pixels.columns)
    known = [n for n in names if n in _formulas and set(_formulas[n].bands()) <= have]
    return pixels.select("*", *[_formulas[n].column().alias(n) for n in known if n not in have])


def multiple_indices(pixels: DataFrame, names: list[str]) -> DataFrame:
    """(row, col, an index each); if none can be computed, the first band by itself, normalised, under the first name."""
    from bandloom.operators.scaling import normalise

    have = [b for b in pixels.columns if b not in ("row", "col", "raster_id")]
    done = [n for n in names if n in _formulas and set(_formulas[n].bands()) <= set(have)]
    if done or not have:
        return add_indices(pixels, done).select("row", "col", *done)
    name = names[0] if names else "band"
    return normalise(pixels.select("row", "col", F.col(have[0]).alias("_v")), "_v", name).select("row", "col", name)
