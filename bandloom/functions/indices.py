"""Spectral indices as column expressions over reflectances in [0, 1].

Names of arguments: n nir, r red, g green, b blue; rNNN is the band for that wavelength.
All quotients are safe: where the divisor is 0 the quotient is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bandloom.functions.arith import at_least
from bandloom.functions.arith import safe_divide as q


def normalised_difference(a: Column, b: Column) -> Column:
    return q(a - b, a + b)


def ndvi(n, r):
    return normalised_difference(n, r)


def ndmi(n, swir):
    return normalised_difference(n, swir)


def gndvi(n, g):
    return normalised_difference(n, g)


def ndwi(g, n):
    return normalised_difference(g, n)


def ngrdi(g, r):
    return normalised_difference(g, r)


def evi(n, r, b):
    return q(n - r, n + r * 6.0 - b * 7.5 + 1.0) * 2.5


def evi2(n, r):
    return q(n - r, n + r + 1.0) * 2.4


def savi(n, r, l=0.5):  # noqa: E741
    return q(n - r, n + r + l) * (1.0 + l)


def osavi(n, r):
    return q(n - r, n + r + 0.16) * 1.16


def msavi(n, r):
    twice = n * 2.0 + 1.0
    return (twice - F.sqrt(at_least(twice * twice - (n - r) * 8.0, 0.0))) / 2.0


def rdvi(n, r):
    return q(n - r, F.sqrt(n + r))


def ipvi(n, r):
    return q(n, n + r)


def dvi(n, r):
    return n - r


def rvi(n, r):
    return q(n, r)


def water_band(r970, r900):
    return q(r970, r900)


def nli(n, r):
    return normalised_difference(n * n, r)


def sipi(r800, r445, r680):
    return q(r800 - r445, r800 - r680)


def cvi(n, r, g):
    return q(n * r, g * g)


def mcari(r700, r670, r550):
    return ((r700 - r670) - (r700 - r550) * 0.2) * q(r700, r670)


def arvi(n, r, b, y=0.08):
    return normalised_difference(n, r - (r - b) * y)


def arvi2(n, r):
    return normalised_difference(n, r) * 1.17 - 0.18


def atsavi(n, r, a=1.0, b=0.0, x=0.08):
    return q((n - r) * a - b, n * a + r - a * b + x * (1.0 + a * a))


def wdvi(n, r, a=1.0):
    return n - r * a


def wdrvi(n, r, alpha=0.1):
    return normalised_difference(n * alpha, r)


def gli(g, r, b):
    return normalised_difference(g * 2.0, r + b)


def vari(g, r, b):
    return q(g - r, g + r - b)


def gemi(n, r):
    eta = q((n * n - r * r) * 2.0 + n * 1.5 + r * 0.5, n + r + 0.5)
    return q(eta * (F.lit(1.0) - eta * 0.25) - (r - 0.125), F.lit(1.0) - r)


def mtvi2(r800, r550, r670):
    top = ((r800 - r550) * 1.2 - (r670 - r550) * 2.5) * 1.5
    twice = r800 * 2.0 + 1.0
    inner = twice * twice - (r800 * 6.0 - F.sqrt(at_least(r670, 0.0)) * 5.0) - 0.5
    return q(top, F.sqrt(at_least(inner, 1e-6)))


def tvi(r750, r550, r670):
    return ((r750 - r550) * 120.0 - (r670 - r550) * 200.0) * 0.5


def tndvi(n, r):
    return F.sqrt(at_least(normalised_difference(n, r), 0.0)) + 0.5


def log_ratio(n, r, legacy_inf: bool = False):
    """ln(n / r).  Where the ratio is 0 the logarithm is NULL, or minus infinity with ``legacy_inf``."""
    ratio = q(n, r)
    return F.when(ratio > 0, F.ln(ratio)).when(ratio.isNotNull() & F.lit(legacy_inf), F.lit(float("-inf")))


def single_band(b):
    return b
