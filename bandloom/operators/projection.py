"""Map projections without a library: EPSG:4326, 3857, UTM (326xx, 327xx) and those of ``NAMED``.

Transverse Mercator is the Krueger n-series to the sixth order (Karney 2011); Lambert conformal
conic, Albers equal-area conic and polar stereographic are Snyder's formulas (1987), their
latitudes by a fixed number of Newton or fixed-point steps.  The same formulas run on numbers,
numpy arrays and Spark columns.  Datums within a metre or two of WGS 84 are taken as equal to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS 84 (fixed values).
A, FLATTENING = 6378137.0, 1 / 298.257223563
HALF_WORLD = math.pi * A
N = FLATTENING / (2 - FLATTENING)
ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
#: Series coefficients in powers of n (Karney 2011, eqs. 35 and 36; fixed values).
ALPHA = [
    N / 2 - 2 / 3 * N**2 + 5 / 16 * N**3 + 41 / 180 * N**4 - 127 / 288 * N**5 + 7891 / 37800 * N**6,
    13 / 48 * N**2 - 3 / 5 * N**3 + 557 / 1440 * N**4 + 281 / 630 * N**5 - 1983433 / 1935360 * N**6,
    61 / 240 * N**3 - 103 / 140 * N**4 + 15061 / 26880 * N**5 + 167603 / 181440 * N**6,
    49561 / 161280 * N**4 - 179 / 168 * N**5 + 6601661 / 7257600 * N**6,
    34729 / 80640 * N**5 - 3418889 / 1995840 * N**6,
    212378941 / 319334400 * N**6,
]
BETA = [
    N / 2 - 2 / 3 * N**2 + 37 / 96 * N**3 - 1 / 360 * N**4 - 81 / 512 * N**5 + 96199 / 604800 * N**6,
    1 / 48 * N**2 + 1 / 15 * N**3 - 437 / 1440 * N**4 + 46 / 105 * N**5 - 1118711 / 3870720 * N**6,
    17 / 480 * N**3 - 37 / 840 * N**4 - 209 / 4480 * N**5 + 5569 / 90720 * N**6,
    4397 / 161280 * N**4 - 11 / 504 * N**5 - 830251 / 7257600 * N**6,
    4583 / 161280 * N**5 - 108847 / 3991680 * N**6,
    20648693 / 638668800 * N**6,
]

_COLUMN = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, sinh=F.sinh, cosh=F.cosh, tanh=F.tanh, asinh=F.asinh, atanh=F.atanh, atan=F.atan, atan2=F.atan2, sqrt=F.sqrt, exp=F.exp, log=F.ln, floor=F.floor)
_ARRAY = SimpleNamespace(sin=np.sin, cos=np.cos, tan=np.tan, sinh=np.sinh, cosh=np.cosh, tanh=np.tanh, asinh=np.arcsinh, atanh=np.arctanh, atan=np.arctan, atan2=np.arctan2, sqrt=np.sqrt, exp=np.exp, log=np.log, floor=np.floor)


@dataclass(frozen=True)
class Conic:
    """A projection by standard parallels ``lat1`` and ``lat2`` (degrees) of an ellipsoid ``a``, ``f``.

    kind: ``lambert`` (conformal conic), ``albers`` (equal-area conic), or ``polar`` (stereographic,
    true to scale at ``lat1``, around the pole of its sign).
    """

    kind: str
    lat1: float
    lat2: float
    lat0: float
    lon0: float
    x0: float = 0.0
    y0: float = 0.0
    a: float = A
    f: float = 1 / 298.257222101

    @property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))

    def _m(self, phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (self.e * math.sin(phi)) ** 2)

    def _t(self, phi, kit):
        s = kit.sin(phi)
        return kit.tan(phi * -0.5 + math.pi / 4) * kit.exp((kit.atanh(s * self.e)) * self.e)

    def _q(self, phi, kit):
        s = kit.sin(phi)
        return (s / (s * s * -(self.e**2) + 1) + kit.atanh(s * self.e) / self.e) * (1 - self.e**2)

    def _constants(self) -> tuple[float, float, float]:
        """(n, scale, rho0) of the conics."""
        p0, p1, p2 = (math.radians(x) for x in (self.lat0, self.lat1, self.lat2))
        m1, m2 = self._m(p1), self._m(p2)
        if self.kind == "lambert":
            t0, t1, t2 = (self._t(p, _ARRAY) for p in (p0, p1, p2))
            n = math.sin(p1) if p1 == p2 else math.log(m1 / m2) / math.log(t1 / t2)
            scale = self.a * m1 / (n * t1**n)
            return n, scale, scale * t0**n
        q0, q1, q2 = (self._q(p, _ARRAY) for p in (p0, p1, p2))
        n = math.sin(p1) if p1 == p2 else (m1**2 - m2**2) / (q2 - q1)
        c = m1**2 + n * q1
        return n, c, self.a * math.sqrt(c - n * q0) / n

    def _polar(self) -> tuple[float, float]:
        """(sign of the pole, rho for a t of 1)."""
        sign, p1 = math.copysign(1.0, self.lat1), math.radians(abs(self.lat1))
        if p1 == math.pi / 2:
            return sign, 2 * self.a / math.sqrt((1 + self.e) ** (1 + self.e) * (1 - self.e) ** (1 - self.e))
        return sign, self.a * self._m(p1) / float(self._t(p1, _ARRAY))

    def forward(self, lon, lat):
        kit, rad = _kit(lon), math.pi / 180
        if self.kind == "polar":
            sign, scale = self._polar()
            lam, rho = (lon - self.lon0) * rad, self._t(lat * (rad * sign), kit) * scale
            return kit.sin(lam) * rho + self.x0, kit.cos(lam) * rho * -sign + self.y0
        n, scale, rho0 = self._constants()
        # the short way round from the central meridian
        theta = (lon - self.lon0 - kit.floor((lon - self.lon0 + 180.0) / 360.0) * 360.0) * (rad * n)
        phi = lat * rad
        rho = kit.exp(kit.log(self._t(phi, kit)) * n) * scale if self.kind == "lambert" else kit.sqrt(self._q(phi, kit) * -n + scale) * (self.a / n)
        return kit.sin(theta) * rho + self.x0, kit.cos(theta) * rho * -1.0 + (rho0 + self.y0)

    def inverse(self, x, y):
        kit, deg = _kit(x), 180 / math.pi
        if self.kind == "polar":
            sign, scale = self._polar()
            dx, dy = x - self.x0, y - self.y0
            lam = kit.atan2(dx, dy * -sign)
            return lam * deg + self.lon0, self._latitude(kit.sqrt(dx * dx + dy * dy) / scale, kit) * (deg * sign)
        n, scale, rho0 = self._constants()
        sign = math.copysign(1.0, n)
        dx, dy = (x - self.x0) * sign, (y - self.y0 - rho0) * -sign
        rho = kit.sqrt(dx * dx + dy * dy)
        lam = kit.atan2(dx, dy) / n
        if self.kind == "lambert":
            return lam * deg + self.lon0, self._latitude(kit.exp(kit.log(rho * (sign / scale)) / n), kit) * deg
        q = (rho * rho * ((n / self.a) ** 2) - scale) / -n
        return lam * deg + self.lon0, self._authalic(q, kit) * deg

    def _latitude(self, t, kit):
        """The latitude of a conformal t: eight halvings of the error by e squared."""
        phi = kit.atan(t) * -2.0 + math.pi / 2
        for _ in range(8):
            phi = kit.atan(t * kit.exp(kit.atanh(kit.sin(phi) * self.e) * -self.e)) * -2.0 + math.pi / 2
        return phi

    def _authalic(self, q, kit):
        """The latitude of an authalic q, by its series in e squared to the sixth power, and then by Newton steps."""
        pole = self._q(math.pi / 2, _ARRAY)
        s = q / pole
        beta = kit.atan(s / kit.sqrt(s * s * -1.0 + (1 + 1e-15)))
        e2 = self.e**2
        phi = beta + kit.sin(beta * 2) * (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) + kit.sin(beta * 4) * (23 * e2**2 / 360 + 251 * e2**3 / 3780) + kit.sin(beta * 6) * (761 * e2**3 / 45360)
        for _ in range(2):
            sin, cos = kit.sin(phi), kit.cos(phi)
            w = sin * sin * -e2 + 1
            phi = phi + (q - self._q(phi, kit)) * w * w / (cos * (2 * (1 - e2)))
        return phi


WGS = 1 / 298.257223563
#: Projections by their EPSG codes (fixed values).
NAMED = {
    "EPSG:2154": Conic("lambert", 49.0, 44.0, 46.5, 3.0, 700000.0, 6600000.0),
    "EPSG:3034": Conic("lambert", 35.0, 65.0, 52.0, 10.0, 4000000.0, 2800000.0),
    "EPSG:3347": Conic("lambert", 49.0, 77.0, 63.390675, -91.86666666666666, 6200000.0, 3000000.0),
    "EPSG:3005": Conic("albers", 50.0, 58.5, 45.0, -126.0, 1000000.0, 0.0),
    "EPSG:3577": Conic("albers", -18.0, -36.0, 0.0, 132.0),
    "EPSG:5070": Conic("albers", 29.5, 45.5, 23.0, -96.0),
    "EPSG:3031": Conic("polar", -71.0, -71.0, -90.0, 0.0, f=WGS),
    "EPSG:3413": Conic("polar", 70.0, 70.0, 90.0, -45.0, f=WGS),
    "EPSG:3976": Conic("polar", -70.0, -70.0, -90.0, 0.0, f=WGS),
    "EPSG:3995": Conic("polar", 71.0, 71.0, 90.0, 0.0, f=WGS),
}


def _kit(x) -> SimpleNamespace:
    return _COLUMN if isinstance(x, Column) else _ARRAY


def _utm_zone(crs: str) -> tuple[float, float]:
    """(central meridian in radians, false northing)."""
    code = int(crs.split(":")[1])
    zone, south = (code - 32600, False) if 32601 <= code <= 32660 else (code - 32700, True) if 32701 <= code <= 32760 else (0, False)
    if not zone:
        raise ValueError(f"{crs} is not supported: EPSG:4326, 3857, 326xx, 327xx and {', '.join(NAMED)} are")
    return math.radians(zone * 6 - 183), 10_000_000.0 if south else 0.0


def from_lonlat(crs: str, lon, lat):
    """Degrees to coordinates of ``crs``."""
    if crs == "EPSG:4326":
        return lon, lat
    if crs in NAMED:
        return NAMED[crs].forward(lon, lat)
    m = _kit(lon)
    rad = math.pi / 180
    if crs == "EPSG:3857":
        return lon * (HALF_WORLD / 180), m.log(m.tan(lat * (rad / 2) + math.pi / 4)) * A
    _, north = _utm_zone(crs)
    return _series(*_sphere(crs, lon, lat), north)


def _sphere(crs: str, lon, lat):
    """(xi, eta): the conformal sphere's coordinates."""
    m, rad = _kit(lon), math.pi / 180
    s, lam = m.sin(lat * rad), lon * rad - _utm_zone(crs)[0]
    t = m.sinh(m.atanh(s) - m.atanh(s * ECC) * ECC)
    return m.atan2(t, m.cos(lam)), m.asinh(m.sin(lam) / m.sqrt(t * t + m.cos(lam) * m.cos(lam)))


def _series(xi, eta, north: float):
    m, x, y = _kit(xi), eta, xi
    for k, a in enumerate(ALPHA, 1):
        x = x + m.cos(xi * (2 * k)) * m.sinh(eta * (2 * k)) * a
        y = y + m.sin(xi * (2 * k)) * m.cosh(eta * (2 * k)) * a
    return x * (0.9996 * RADIUS) + 500_000.0, y * (0.9996 * RADIUS) + north


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns whose formulas are not merged into later ones: a generator of one row stands between."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_settled")
    return df.select("*", row).select(*df.columns, "_settled.*")


def add_coordinates(df: DataFrame, crs: str, lon: str, lat: str, x: str, y: str) -> DataFrame:
    """``df`` with coordinates of ``crs`` in columns x and y; long formulas are computed in steps."""
    if crs in ("EPSG:4326", "EPSG:3857", *NAMED):
        a, b = from_lonlat(crs, F.col(lon), F.col(lat))
        return df.withColumns({x: a, y: b})
    xi, eta = _sphere(crs, F.col(lon), F.col(lat))
    df = settle(df, _xi=xi, _eta=eta)
    a, b = _series(F.col("_xi"), F.col("_eta"), _utm_zone(crs)[1])
    return settle(df, **{x: a, y: b}).drop("_xi", "_eta")


def to_lonlat(crs: str, x, y):
    """Coordinates of ``crs`` to degrees."""
    if crs == "EPSG:4326":
        return x, y
    if crs in NAMED:
        return NAMED[crs].inverse(x, y)
    m = _kit(x)
    deg = 180 / math.pi
    if crs == "EPSG:3857":
        return x * (180 / HALF_WORLD), (m.atan(m.exp(y / A)) * 2 - math.pi / 2) * deg
    centre, north = _utm_zone(crs)
    xi, eta = (y - north) / (0.9996 * RADIUS), (x - 500_000.0) / (0.9996 * RADIUS)
    p, q = xi, eta
    for k, b in enumerate(BETA, 1):
        p = p - m.sin(xi * (2 * k)) * m.cosh(eta * (2 * k)) * b
        q = q - m.cos(xi * (2 * k)) * m.sinh(eta * (2 * k)) * b
    lam = m.atan2(m.sinh(q), m.cos(p))
    want = m.sin(p) / m.sqrt(m.sinh(q) * m.sinh(q) + m.cos(p) * m.cos(p))
    tau = want
    for _ in range(4):  # Newton on the conformal latitude
        s = tau / m.sqrt(tau * tau + 1)
        sigma = m.sinh(m.atanh(s * ECC) * ECC)
        now = tau * m.sqrt(sigma * sigma + 1) - sigma * m.sqrt(tau * tau + 1)
        tau = tau + (want - now) / m.sqrt(now * now + 1) * (tau * tau * (1 - ECC**2) + 1) / (m.sqrt(tau * tau + 1) * (1 - ECC**2))
    return (lam + centre) * deg, m.atan(tau) * deg


def transform_bounds(source: str, target: str, bounds: tuple[float, float, float, float], densify: int = 21) -> tuple[float, float, float, float]:
    """The envelope of the reprojected outline, with ``densify`` points between corners on each edge."""
    left, bottom, right, top = bounds
    t = np.linspace(0, 1, densify + 2)
    xs = np.concatenate([left + (right - left) * t, left + (right - left) * t, np.full_like(t, left), np.full_like(t, right)])
    ys = np.concatenate([np.full_like(t, bottom), np.full_like(t, top), bottom + (top - bottom) * t, bottom + (top - bottom) * t])
    x, y = from_lonlat(target, *to_lonlat(source, xs, ys))
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())
