"""Map projections as column expressions, both ways, by code.

Universal Transverse Mercator (``projection``), Lambert conformal conic, Albers
equal-area conic, Mercator on the ellipsoid and on the sphere of web maps. Forward and
inverse are closed forms but for two latitudes: that of a conformal one comes from
rounds of its fixed point, that of an authalic one from its series in the third
flattening. Null positions give nulls, as do the poles in Mercator.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.geostatistics import projection as utm

#: Axis and flattening of the ellipsoids in use (fixed values).
WGS84, GRS80 = (6378137.0, 1 / 298.257223563), (6378137.0, 1 / 298.257222101)
#: Authalic to geographic latitude: coefficients of sin 2b, 4b, 6b, 8b as powers of the third flattening (fixed values).
AUTHALIC = [
    [0, 4 / 3, 4 / 45, -16 / 35, -2582 / 14175],
    [0, 0, 46 / 45, 152 / 945, -11966 / 14175],
    [0, 0, 0, 3044 / 2835, 3802 / 14175],
    [0, 0, 0, 0, 6059 / 4725],
]
ROUNDS = 6


@dataclass(frozen=True)
class System:
    """A projected system: its kind (lcc, albers, mercator or web), ellipsoid, origin and parallels in degrees, false origin and scale."""

    kind: str
    ellipsoid: tuple[float, float] = WGS84
    longitude: float = 0.0
    latitude: float = 0.0
    parallels: tuple[float, ...] = ()
    east: float = 0.0
    north: float = 0.0
    scale: float = 1.0


#: Systems by code (fixed values of their registry).
SYSTEMS = {
    "2991": System("lcc", GRS80, -120.5, 41.75, (43.0, 45.5), 400_000.0, 0.0),
    "3005": System("albers", GRS80, -126.0, 45.0, (50.0, 58.5), 1_000_000.0, 0.0),
    "3310": System("albers", GRS80, -120.0, 0.0, (34.0, 40.5), 0.0, -4_000_000.0),
    "3338": System("albers", GRS80, -154.0, 50.0, (55.0, 65.0)),
    "3347": System("lcc", GRS80, -91.86666666666666, 63.390675, (49.0, 77.0), 6_200_000.0, 3_000_000.0),
    "3395": System("mercator"),
    "3857": System("web"),
    "3978": System("lcc", GRS80, -95.0, 49.0, (49.0, 77.0)),
    "5070": System("albers", GRS80, -96.0, 23.0, (29.5, 45.5)),
}


def eccentricity(ellipsoid: tuple[float, float]) -> float:
    f = ellipsoid[1]
    return math.sqrt(f * (2 - f))


def isometric(sine, tangent, e: float, m=math):
    """Isometric latitude from a latitude's sine and tangent; ``m`` is math or pyspark's functions."""
    return m.asinh(tangent) - e * m.atanh(e * sine)


def latitude_of(psi: Column, e: float) -> Column:
    """Latitude in radians of an isometric one; a round leaves e**2 of the error."""
    phi = F.atan(F.sinh(psi))
    for _ in range(ROUNDS if e else 0):
        phi = F.atan(F.sinh(psi + e * F.atanh(e * F.sin(phi))))
    return phi


def authalic_q(sine, e: float, m=math):
    """Twice the area between the equator and a latitude, per radian of longitude and squared axis."""
    return (1 - e * e) * (sine / (1 - e * e * sine * sine) + m.atanh(e * sine) / e)


def parallel(latitude: float, e: float) -> float:
    """Radius of a parallel, of an ellipsoid with axis 1."""
    s = math.sin(math.radians(latitude))
    return math.cos(math.radians(latitude)) / math.sqrt(1 - e * e * s * s)


def cone(system: System) -> tuple[float, float, float]:
    """(n, constant, radius at the origin) of a conic system, for an axis of 1."""
    e, (one, two) = eccentricity(system.ellipsoid), (system.parallels * 2)[:2]
    sines = [math.sin(math.radians(p)) for p in (one, two, system.latitude)]
    m1, m2 = parallel(one, e), parallel(two, e)
    if system.kind == "lcc":
        psi = [isometric(s, math.tan(math.radians(p)), e) for s, p in zip(sines, (one, two, system.latitude))]
        n = sines[0] if one == two else math.log(m1 / m2) / (psi[1] - psi[0])
        c = m1 * math.exp(n * psi[0]) / n
        return n, c, c * math.exp(-n * psi[2])
    q = [authalic_q(s, e) for s in sines]
    n = sines[0] if one == two else (m1 * m1 - m2 * m2) / (q[1] - q[0])
    c = m1 * m1 + n * q[0]
    return n, c, math.sqrt(c - n * q[2]) / n


def forward(system: System, longitude: Column, latitude: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    e, a = (0.0 if system.kind == "web" else eccentricity(system.ellipsoid)), system.ellipsoid[0] * system.scale
    lam, phi = F.radians(F.pmod(longitude - system.longitude + 180, F.lit(360.0)) - 180), F.radians(latitude)
    if system.kind in ("mercator", "web"):
        inside = F.abs(latitude) < 90
        return system.east + a * lam, F.when(inside, system.north + a * isometric(F.sin(phi), F.tan(phi), e, F))
    n, c, origin = cone(system)
    if system.kind == "lcc":
        rho = a * c * F.exp(-n * isometric(F.sin(phi), F.tan(phi), e, F))
    else:
        rho = a * F.sqrt(F.greatest(c - n * authalic_q(F.sin(phi), e, F), F.lit(0.0))) / n
    return system.east + rho * F.sin(n * lam), system.north + a * origin - rho * F.cos(n * lam)


def inverse(system: System, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    e, a = (0.0 if system.kind == "web" else eccentricity(system.ellipsoid)), system.ellipsoid[0] * system.scale
    x, y = (x - system.east) / a, (y - system.north) / a
    if system.kind in ("mercator", "web"):
        lam, phi = x, latitude_of(y, e)
    else:
        n, c, origin = cone(system)
        side = math.copysign(1.0, n)
        up = origin - y
        rho, lam = side * F.sqrt(x * x + up * up), F.atan2(side * x, side * up) / n
        if system.kind == "lcc":
            phi = latitude_of(-F.log(rho / c) / n, e)
        else:
            beta = F.asin((c - rho * rho * n * n) / n / authalic_q(1.0, e))
            third = system.ellipsoid[1] / (2 - system.ellipsoid[1])
            phi = beta
            for j, powers in enumerate(AUTHALIC, 1):
                phi = phi + sum(k * third**i for i, k in enumerate(powers)) * F.sin(2 * j * beta)
    return F.pmod(F.degrees(lam) + system.longitude + 180, F.lit(360.0)) - 180, F.degrees(phi)


def geographic(x: Column, y: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Longitude and latitude of a place in a UTM zone."""
    xi, eta = (y - (10_000_000.0 if south else 0.0)) / (utm.SCALE * utm.RECTIFYING), (x - 500_000.0) / (utm.SCALE * utm.RECTIFYING)
    p, q = xi, eta
    for j, powers in enumerate(utm.BETA, 1):
        b = sum(c * utm._N ** (j + k) for k, c in enumerate(powers))
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    sphere = F.asin(F.sin(p) / F.cosh(q))
    return F.degrees(F.atan2(F.sinh(q), F.cos(p))) + (zone * 6 - 183), F.degrees(latitude_of(F.asinh(F.tan(sphere)), eccentricity(WGS84)))


def code_of(crs: str | int) -> str:
    """A system's code; one that isn't known is refused."""
    code = str(crs).lower().removeprefix("epsg:")
    zone = len(code) == 5 and code[:3] in ("326", "327") and code.isdigit() and 1 <= int(code[3:]) <= 60
    if code not in ("4326", "4269") and code not in SYSTEMS and not zone:
        raise ValueError(f"'{crs}' is neither geographic (epsg:4326), nor a UTM zone (epsg:326zz, epsg:327zz), nor one of {', '.join(sorted(SYSTEMS))}")
    return code


def project(crs: str | int, longitude: Column, latitude: Column) -> tuple[Column, Column]:
    """Geographic coordinates in a system of that code."""
    code = code_of(crs)
    if code in ("4326", "4269"):
        return longitude, latitude
    return forward(SYSTEMS[code], longitude, latitude) if code in SYSTEMS else utm.utm(longitude, latitude, int(code[3:]), code[:3] == "327")


def unproject(crs: str | int, x: Column, y: Column) -> tuple[Column, Column]:
    """Geographic coordinates of a place in a system of that code."""
    code = code_of(crs)
    if code in ("4326", "4269"):
        return x, y
    return inverse(SYSTEMS[code], x, y) if code in SYSTEMS else geographic(x, y, int(code[3:]), code[:3] == "327")


def reproject(df: DataFrame, crs_out: str | int, coordinates: tuple[str, str] = ("longitude", "latitude"), crs_in: str | int = "epsg:4326", names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Add coordinates in an output system, from those in an input system; datums count as one."""
    longitude, latitude = unproject(crs_in, F.col(coordinates[0]), F.col(coordinates[1]))
    x, y = project(crs_out, longitude, latitude)
    return df.withColumns({names[0]: x, names[1]: y})
