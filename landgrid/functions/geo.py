"""Column expressions on coordinates: cell centres, rings, wedges, map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.config import SECTORS, Grid

# Ellipsoids as (semi-major axis, inverse flattening) and the three-parameter
# shift from the local datum to WGS84 in metres.
WGS84 = (6378137.0, 298.257223563)
CLARKE_1880_RGS = (6378249.145, 293.465)
ARC_1960_TO_WGS84 = (-160.0, -6.0, -302.0)


def cell_x(c: Column, grid: Grid) -> Column:
    return F.lit(grid.x0) + (c.cast("double") + 0.5) * grid.res


def cell_y(r: Column, grid: Grid) -> Column:
    return F.lit(grid.y0) + (r.cast("double") + 0.5) * grid.res


def col_of(x: Column, grid: Grid) -> Column:
    return F.floor((x - grid.x0) / grid.res).cast("bigint")


def row_of(y: Column, grid: Grid) -> Column:
    return F.floor((y - grid.y0) / grid.res).cast("bigint")


def dist_to_point(x: Column, y: Column, x0: float, y0: float) -> Column:
    dx, dy = x - x0, y - y0
    return F.sqrt(dx * dx + dy * dy)


def ring_of(d: Column, step: float, maximum: float) -> Column:
    """Ring number of a distance: ``((i-1)*step, i*step]``, the centre itself in ring 1,
    NULL beyond the last ring."""
    ring = F.greatest(F.ceil(d / step).cast("bigint"), F.lit(1).cast("bigint"))
    return F.when(d <= maximum, ring)


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north in [0, 360)."""
    deg = F.degrees(F.atan2(dx, dy))
    return F.when(deg < 0, deg + 360.0).otherwise(deg)


def sector_of(dx: Column, dy: Column) -> Column:
    """Wedge number 1..8 clockwise from north."""
    return F.least(F.floor(bearing(dx, dy) / 45.0).cast("int"), F.lit(7)) + 1


def sector_name(sector_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SECTORS]), sector_id)


def shift_datum(df: DataFrame, src, dst, shift) -> DataFrame:
    """Radians ``lo_, la_`` on ellipsoid ``src`` to radians on ``dst``: geocentric translation,
    then Bowring's closed form (1976), which is below a micrometre at the surface."""
    a, inv = src
    e2 = (2.0 - 1.0 / inv) / inv
    b_a, b_inv = dst
    f = 1.0 / b_inv
    b = b_a * (1.0 - f)
    d2 = f * (2.0 - f)
    dp2 = d2 / (1.0 - d2)
    lo, la, nu = F.col("lo_"), F.col("la_"), F.col("nu_")
    x, y, z = F.col("gx_"), F.col("gy_"), F.col("gz_")
    s, c = F.sin("th_"), F.cos("th_")
    return (
        df.withColumn("nu_", F.lit(a) / F.sqrt(1.0 - F.sin(la) * F.sin(la) * e2))
        .withColumns({"gx_": nu * F.cos(la) * F.cos(lo) + shift[0],
                      "gy_": nu * F.cos(la) * F.sin(lo) + shift[1],
                      "gz_": nu * (1.0 - e2) * F.sin(la) + shift[2]})
        .withColumn("p_", F.sqrt(x * x + y * y))
        .withColumn("th_", F.atan2(z * b_a, F.col("p_") * b))
        .withColumns({"lo_": F.atan2(y, x),
                      "la_": F.atan2(z + s * s * s * (dp2 * b), F.col("p_") - c * c * c * (d2 * b_a))})
        .drop("nu_", "gx_", "gy_", "gz_", "p_", "th_"))


def _third_flattening(ell: tuple[float, float]) -> float:
    f = 1.0 / ell[1]
    return f / (2.0 - f)


def _rectifying_radius(ell: tuple[float, float]) -> float:
    n = _third_flattening(ell)
    return ell[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def to_utm(df: DataFrame, lon: str, lat: str, x: str, y: str, zone: int, south: bool,
           ellipsoid=CLARKE_1880_RGS, to_wgs84=ARC_1960_TO_WGS84) -> DataFrame:
    """WGS84 degrees to UTM metres with Krueger's series to third order, built in stages so
    that shared terms are computed once."""
    out = df.withColumns({"lo_": F.radians(lon), "la_": F.radians(lat)})
    if to_wgs84 is not None:
        out = shift_datum(out, WGS84, ellipsoid, tuple(-s for s in to_wgs84))
    n = _third_flattening(ellipsoid)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * math.sqrt(n) / (1 + n)
    dlon = F.col("lo_") - math.radians(6 * zone - 183)
    s, t, xi, eta = F.col("s_"), F.col("t_"), F.col("xi_"), F.col("eta_")
    out = (out.withColumn("s_", F.sin("la_"))
           .withColumn("t_", F.sinh(F.atanh(s) - F.atanh(s * k) * k))
           .withColumns({"xi_": F.atan2(t, F.cos(dlon)),
                         "eta_": F.atanh(F.sin(dlon) / F.sqrt(t * t + 1.0))}))
    east, north = eta, xi
    for j, a_j in enumerate(alpha, start=1):
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a_j
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a_j
    scale = 0.9996 * _rectifying_radius(ellipsoid)
    return out.withColumns({x: east * scale + 500000.0,
                            y: north * scale + (10000000.0 if south else 0.0)}).drop(
        "lo_", "la_", "s_", "t_", "xi_", "eta_")


def from_utm(df: DataFrame, x: str, y: str, lon: str, lat: str, zone: int, south: bool,
             ellipsoid=CLARKE_1880_RGS, to_wgs84=ARC_1960_TO_WGS84) -> DataFrame:
    """UTM metres to WGS84 degrees."""
    n = _third_flattening(ellipsoid)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    scale = 0.9996 * _rectifying_radius(ellipsoid)
    xi, eta, chi = F.col("xi_"), F.col("eta_"), F.col("chi_")
    out = df.withColumns({"xi_": (F.col(y) - (10000000.0 if south else 0.0)) / scale,
                          "eta_": (F.col(x) - 500000.0) / scale})
    xi0, eta0, phi = xi, eta, chi
    for j, (b_j, d_j) in enumerate(zip(beta, delta), start=1):
        xi0 = xi0 - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b_j
        eta0 = eta0 - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b_j
        phi = phi + F.sin(chi * (2 * j)) * d_j
    out = out.withColumns({"xi0_": xi0, "eta0_": eta0})
    out = out.withColumns({"chi_": F.asin(F.sin("xi0_") / F.cosh("eta0_")),
                           "lo_": F.atan2(F.sinh("eta0_"), F.cos("xi0_")) + math.radians(6 * zone - 183)})
    out = out.withColumn("la_", phi)
    if to_wgs84 is not None:
        out = shift_datum(out, ellipsoid, WGS84, to_wgs84)
    return out.withColumns({lon: F.degrees("lo_"), lat: F.degrees("la_")}).drop(
        "xi_", "eta_", "xi0_", "eta0_", "chi_", "lo_", "la_")
