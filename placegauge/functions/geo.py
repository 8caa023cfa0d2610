"""Geometry as column arithmetic: great circle, plane projection, geodesics, grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions.staging import with_computed

_F = 1.0 / fv.GRS80_INV_F
_N = _F / (2.0 - _F)


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_p = F.sin((p2 - p1) / 2)
    half_l = F.sin(F.radians(lng2 - lng1) / 2)
    h = half_p * half_p + F.cos(p1) * F.cos(p2) * half_l * half_l
    return F.lit(2 * fv.EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def _alphas() -> list[float]:
    """Coefficients of the forward series of Kruger, third order in n (sub-millimetre here)."""
    n = _N
    return [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    ]


def _meridian_xi0() -> float:
    """The series value of the origin latitude, so that northing is zero there."""
    lat0 = math.radians(fv.ZONE_LAT0_DEG)
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = math.sinh(math.atanh(math.sin(lat0)) - e * math.atanh(e * math.sin(lat0)))
    xi = math.atan(t)
    return xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(_alphas()))


SERIES_ALPHAS = _alphas()
SERIES_XI0 = _meridian_xi0()
SERIES_E = 2 * math.sqrt(_N) / (1 + _N)
SERIES_SCALE = fv.ZONE_K0 * fv.GRS80_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def project(df: DataFrame, lat: str, lng: str, x: str, y: str) -> DataFrame:
    """Adds easting ``x`` and northing ``y`` in metres: Transverse Mercator, mainland zone."""
    c = F.col
    north, east = c("__xi"), c("__eta")
    for j, a in enumerate(SERIES_ALPHAS, start=1):
        north = north + F.lit(a) * F.sin(c("__xi") * (2.0 * j)) * F.cosh(c("__eta") * (2.0 * j))
        east = east + F.lit(a) * F.cos(c("__xi") * (2.0 * j)) * F.sinh(c("__eta") * (2.0 * j))
    return with_computed(
        df,
        {
            "__sin": F.sin(F.radians(c(lat))),
            "__dl": F.radians(c(lng) - F.lit(fv.ZONE_LNG0_DEG)),
        },
        {
            "__t": F.sinh(
                F.atanh(c("__sin")) - F.lit(SERIES_E) * F.atanh(F.lit(SERIES_E) * c("__sin"))
            )
        },
        {
            "__xi": F.atan2(c("__t"), F.cos(c("__dl"))),
            "__eta": F.atanh(F.sin(c("__dl")) / F.sqrt(F.lit(1.0) + c("__t") * c("__t"))),
        },
        {
            x: east * F.lit(SERIES_SCALE),
            y: (north - F.lit(SERIES_XI0)) * F.lit(SERIES_SCALE),
        },
    )


def planar_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


GRS80_B = fv.GRS80_A * (1 - _F)
GRS80_FLATTENING = _F


def geodesic_direct(
    df: DataFrame, lat: str, lng: str, azimuth: str, metres: str, lat2: str, lng2: str
) -> DataFrame:
    """Adds the point reached on GRS80 (Vincenty); two corrections suffice at these distances."""
    c, lit, f = F.col, F.lit, GRS80_FLATTENING
    e2 = (fv.GRS80_A**2 - GRS80_B**2) / GRS80_B**2

    def correct(sigma: str) -> dict[str, Column]:
        cos_2m = F.cos(c("__s1") * 2 + c(sigma))
        swing = cos_2m + c("__B") / 4 * F.cos(c(sigma)) * (cos_2m * cos_2m * 2 - lit(1.0))
        return {"__sigma": c("__start") + c("__B") * F.sin(c(sigma)) * swing}

    return with_computed(
        df,
        {
            "__sin1": F.sin(F.radians(c(azimuth))),
            "__cos1": F.cos(F.radians(c(azimuth))),
            "__tan": lit(1 - f) * F.tan(F.radians(c(lat))),
        },
        {"__cu": lit(1.0) / F.sqrt(lit(1.0) + c("__tan") * c("__tan"))},
        {
            "__su": c("__tan") * c("__cu"),
            "__s1": F.atan2(c("__tan"), c("__cos1")),
            "__sa": c("__cu") * c("__sin1"),
        },
        {"__ca2": lit(1.0) - c("__sa") * c("__sa")},
        {"__u2": c("__ca2") * lit(e2)},
        {
            "__A": lit(1.0)
            + c("__u2")
            / 16384
            * (lit(4096.0) + c("__u2") * (lit(-768.0) + c("__u2") * (lit(320.0) - c("__u2") * 175))),
            "__B": c("__u2")
            / 1024
            * (lit(256.0) + c("__u2") * (lit(-128.0) + c("__u2") * (lit(74.0) - c("__u2") * 47))),
        },
        {"__start": c(metres) / (c("__A") * lit(GRS80_B))},
        correct("__start"),
        correct("__sigma"),
        {
            "__ss": F.sin(c("__sigma")),
            "__cs": F.cos(c("__sigma")),
            "__c2m": F.cos(c("__s1") * 2 + c("__sigma")),
            "__C": lit(f / 16) * c("__ca2") * (lit(4.0) + lit(f) * (lit(4.0) - c("__ca2") * 3)),
        },
        {
            "__cross": c("__su") * c("__ss") - c("__cu") * c("__cs") * c("__cos1"),
            "__lam": F.atan2(
                c("__ss") * c("__sin1"),
                c("__cu") * c("__cs") - c("__su") * c("__ss") * c("__cos1"),
            ),
            "__turn": c("__sigma")
            + c("__C")
            * c("__ss")
            * (c("__c2m") + c("__C") * c("__cs") * (c("__c2m") * c("__c2m") * 2 - lit(1.0))),
        },
        {
            lat2: F.degrees(
                F.atan2(
                    c("__su") * c("__cs") + c("__cu") * c("__ss") * c("__cos1"),
                    lit(1 - f) * F.sqrt(c("__sa") * c("__sa") + c("__cross") * c("__cross")),
                )
            ),
            lng2: c(lng)
            + F.degrees(
                c("__lam") - (lit(1.0) - c("__C")) * lit(f) * c("__sa") * c("__turn")
            ),
        },
    )


def disc_offsets(radius_m: float) -> list[tuple[float, float]]:
    """(azimuth, distance) of the 25 samples: centre, 8 at half the radius, 16 on the rim."""
    rings = [(0.0, 0.0)]
    rings += [(360.0 * i / 8, radius_m / 2) for i in range(8)]
    rings += [(360.0 * i / 16, radius_m) for i in range(16)]
    return rings


def cell_index(value: Column, size: float) -> Column:
    """Grid line number; floor, so that negative values bin right."""
    return F.floor(value / F.lit(size))


def neighbour_cells(cx: Column, cy: Column, reach_x: int = 1, reach_y: int = 1) -> Column:
    """array<struct<cx, cy>> of the cells at most ``reach`` away."""
    return F.array(
        *[
            F.struct((cx + dx).alias("cx"), (cy + dy).alias("cy"))
            for dx in range(-reach_x, reach_x + 1)
            for dy in range(-reach_y, reach_y + 1)
        ]
    )


class SphereGrid:
    """Degree grid whose cells are so small that two points of one cell are within ``metres``.

    Valid for the latitude range of the data.  ``reach`` is how many cells away a point within
    ``metres`` can lie.
    """

    def __init__(self, metres: float, lat_range: tuple[float, float] = fv.LAT_RANGE) -> None:
        side = metres / math.sqrt(2.0) * (1 - 1e-6)
        degree = math.radians(1.0) * fv.EARTH_RADIUS_M
        widest = math.cos(math.radians(min(abs(lat_range[0]), abs(lat_range[1]))))
        if lat_range[0] <= 0 <= lat_range[1]:
            widest = 1.0
        narrowest = math.cos(math.radians(max(abs(lat_range[0]), abs(lat_range[1]))))
        self.lat_size = side / degree
        self.lng_size = side / (degree * widest)
        self.reach_lat = math.ceil(metres * (1 + 1e-6) / side)
        # The great-circle chord needs a little more longitude than metres / (R cos lat).
        self.reach_lng = math.ceil(
            metres * (1 + 1e-4) / (self.lng_size * degree * narrowest)
        )

    def cell(self, lat: Column, lng: Column) -> tuple[Column, Column]:
        return cell_index(lng, self.lng_size), cell_index(lat, self.lat_size)

    def neighbours(self, cx: Column, cy: Column) -> Column:
        return neighbour_cells(cx, cy, self.reach_lng, self.reach_lat)
