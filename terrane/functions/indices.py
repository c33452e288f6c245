"""Spectral indices as column expressions over raw band columns (digital numbers, scale 10 000).

Divisions by zero give null. ``literal=True`` gives the variants that older tables
were made with, where a power of one half was evaluated as a division by two and
scaled and raw bands were mixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10000.0
EPSILON = 1e-9


def raw(b: str) -> Column:
    return F.col(b)


def unit(b: str) -> Column:
    return F.col(b) / SCALE


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def normalised(a: str, b: str, extra: float = 0.0) -> Column:
    low = raw(a) + raw(b)
    return SCALE * ratio(raw(a) - raw(b), low + extra if extra else low)


def ndvi() -> Column:
    return normalised("nir", "red")


def evi2() -> Column:
    n, r = unit("nir"), unit("red")
    return 2.5 * SCALE * ratio(n - r, n + 1 + 2.4 * r)


def savi() -> Column:
    n, r = unit("nir"), unit("red")
    return SCALE * 1.5 * ratio(n - r, n + r + 0.5)


def msavi(literal: bool = False) -> Column:
    n, r = unit("nir"), unit("red")
    a = 2 * n + 1
    inner = a * a - 8 * (n - r)
    return SCALE / 2 * a - inner / 2 if literal else SCALE / 2 * (a - F.sqrt(F.when(inner >= 0, inner)))


def bare_soil(literal: bool = False) -> Column:
    n, g, r, b = (unit(x) for x in ("nir", "green", "red", "blue"))
    if literal:
        return SCALE * ratio((n + g) - (raw("red") + raw("blue")), raw("nir") + raw("green") + raw("red") + raw("blue")) * 100 + 100
    return SCALE * ratio((n + g) - (r + b), n + g + r + b) * 100 + 100


def sr() -> Column:
    return SCALE * ratio(raw("nir"), raw("red"))


def bai(series: bool = False) -> Column:
    n, r = unit("nir"), unit("red")
    scale = SCALE / 100 if series else SCALE
    x, y = 0.06 - n, 0.1 - r
    return scale * ratio(F.lit(1.0), x * x + y * y)


def ci() -> Column:
    b, g, r = unit("blue"), unit("green"), unit("red")
    widest = F.greatest(F.abs(b - g), F.abs(b - r), F.abs(r - g))
    return F.when(b.isNotNull() & g.isNotNull() & r.isNotNull(), SCALE * ((b + g + r) + 15 * widest))


def ndmi() -> Column:
    return normalised("nir", "green", EPSILON)


def nbr() -> Column:
    return normalised("nir", "SWIR2")


def nbr2() -> Column:
    return normalised("SWIR1", "SWIR2")


def mirbi() -> Column:
    return SCALE * (10 * unit("SWIR2") - 9.8 * unit("SWIR1") + 2)


def bai_s() -> Column:
    n, r, s2, e2, e3 = (unit(x) for x in ("nir", "red", "SWIR2", "redEdge2", "redEdge3"))
    under = ratio(e2 * e3 * n, r)
    return SCALE * (1 - F.sqrt(F.when(under >= 0, under))) * (ratio(s2 - n, F.sqrt(s2 + n)) + 1)


def burn_scar(series: bool = False) -> Column:
    g, r, n = (raw(x) if series else unit(x) for x in ("green", "red", "nir"))
    body = ratio(ratio(raw("SWIR2") - raw("red"), raw("SWIR2") + raw("red")), g * g + r * r + n * n)
    return body if series else SCALE * body


def ndwi() -> Column:
    return normalised("nir", "SWIR1", EPSILON)


INDICES: dict[str, Callable[[], Column]] = {
    "ndvi": ndvi, "evi2": evi2, "savi": savi, "msavi": msavi, "bareSoil": bare_soil, "sr": sr, "bai": bai, "CI": ci, "ndmi": ndmi,
    "NBR": nbr, "NBR2": nbr2, "MIRBI": mirbi, "baiS": bai_s, "BurnScar": burn_scar, "ndwi": ndwi,
}

#: Bands that each index needs, so that a scan reads no others.
INDEX_BANDS: dict[str, list[str]] = {
    "ndvi": ["nir", "red"], "evi2": ["nir", "red"], "savi": ["nir", "red"], "msavi": ["nir", "red"], "bareSoil": ["nir", "green", "red", "blue"], "sr": ["nir", "red"],
    "bai": ["nir", "red"], "CI": ["blue", "green", "red"], "ndmi": ["nir", "green"], "NBR": ["nir", "SWIR2"], "NBR2": ["SWIR1", "SWIR2"], "MIRBI": ["SWIR1", "SWIR2"],
    "baiS": ["nir", "red", "SWIR2", "redEdge2", "redEdge3"], "BurnScar": ["SWIR2", "red", "green", "nir"], "ndwi": ["nir", "SWIR1"],
}


def measure(name: str) -> Column:
    """A band or an index by name."""
    return INDICES[name]() if name in INDICES else F.col(name)
