"""Geographic to projected coordinates, as column expressions.

Universal Transverse Mercator by Krueger's series to the sixth order (well below a
millimetre within a zone), on the WGS-84 ellipsoid. Null positions give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXIS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLATTENING / (2 - FLATTENING)
#: Radius of the rectifying sphere.
RECTIFYING = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: Krueger's alpha coefficients, powers of the third flattening from the coefficient's own order on (fixed values).
ALPHA = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
]
#: And his beta coefficients, for the way back (fixed values).
BETA = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
]


def utm_zone(longitude: Column) -> Column:
    """Zone number, 1 to 60."""
    return (F.pmod(F.floor((longitude + 180) / 6), F.lit(60)) + 1).cast("int")


def utm_code(longitude: Column, latitude: Column) -> Column:
    """The zone's EPSG code: 326zz north of the equator and on it, 327zz south."""
    return F.concat(F.when(latitude >= 0, "326").otherwise("327"), F.lpad(utm_zone(longitude).cast("string"), 2, "0"))


def utm(longitude: Column, latitude: Column, zone: int | Column, south: bool | Column = False) -> tuple[Column, Column]:
    """Easting and northing in metres within a zone."""
    zone = zone if isinstance(zone, Column) else F.lit(zone)
    south = south if isinstance(south, Column) else F.lit(south)
    e = (FLATTENING * (2 - FLATTENING)) ** 0.5
    phi, lam = F.radians(latitude), F.radians(longitude - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))  # tangent of the conformal latitude
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) ** 2))
    x, y = eta, xi
    for j, powers in enumerate(ALPHA, 1):
        a = sum(c * _N ** (j + k) for k, c in enumerate(powers))
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + SCALE * RECTIFYING * x, SCALE * RECTIFYING * y + F.when(south, 10000000.0).otherwise(0.0)


def survey_zone(df: DataFrame, coordinates: tuple[str, str] = ("longitude", "latitude")) -> tuple[int, bool]:
    """Zone and hemisphere of the median position: two exact medians, one row to the driver."""
    lon, lat = (F.median(c) for c in coordinates)
    row = df.agg(utm_zone(lon).alias("zone"), (lat < 0).alias("south")).first()
    return (row["zone"] or 1), bool(row["south"])


def with_utm(df: DataFrame, zone: int, south: bool, coordinates: tuple[str, str] = ("longitude", "latitude"), names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Add projected coordinates in a given zone."""
    x, y = utm(F.col(coordinates[0]), F.col(coordinates[1]), zone, south)
    return df.withColumns({names[0]: x, names[1]: y})
