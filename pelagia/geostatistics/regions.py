"""Which transects bound the mesh, by survey year and region.

A spec lists transects and the end that bounds them: ``1-119.1`` is every transect
from 1 to 119 with end .1, ``135-119/2.4`` every second one downwards, ``92.6`` one.
Ends: .1 west, .4 east, .6 south, .9 north.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: (first transect, last transect, lower bounds, upper bounds) of regions 1 to 3 (fixed values of the surveys).
REGIONS = {
    2019: [(1, 119, "1-119.1", "1-119.4"), (121, 127, "121-127.6", "121-127.9"), (129, 145, "129-145.1", "129-145.4")],
    2017: [(1, 119, "1-119.1", "1-119.4"), (120, 126, "120-126.6", "120-126.9"), (127, 144, "127-144.1", "127-144.4")],
    2015: [(1, 90, "1-90.1", "1-90.4"), (90, 102, "90.1 92.6 102.4", "90.4 92.9 102.1"), (75, 102, "75.1 102.1 104.1 108-116/2.1", "75.4 102.4 104.4 108-116/2.4")],
    2013: [
        (1, 117, "1-117.1", "1-117.4"),
        (117, 123, "114.4 114.1 115.1 118.6 119.6 120.6 122.6 124.6", "114.4 117.4 118.9 119.9 120.9 122.9 124.9"),
        (101, 125, "101.1 137-133/2.1 130.1 127-125.1", "101.1 102.1 103.1 138.4 135.4 133.4 130.4 123.6 123.9"),
    ],
    2012: [
        (1, 107, "1-107.1", "1-107.4"),
        (107, 116, "105.4 105.1 111-117/2.6", "105.4 111-117/2.9"),
        (97, 120.1, "97.1 135.1 131-121/2.1 120.1", "97.1 99.1 133.4 131.4 129.4 128.4 126.4 117.6 117.9 119.4"),
    ],
    2011: [
        (1, 117, "1-77.1 83-117.1", "1-117.4"),
        (117, 124, "114.4 114.1 117.1 120-124/2.6", "114.4 117.4 120.9 122.9 124.9"),
        (106, 128, "105.1 138.1 136.1 132-128/2.1", "105.1 144.4 138-132/2.4 124.6 122.6 128.4"),
    ],
    2009: [
        (1, 112, "1-96.1 98-110.1 113.9", "1-104.4 112.9"),
        (111, 124, "111.9 109.4 113-117.6 127.4 124.1", "111.9 112.6 112-117.9 124.4"),
        (96, 124, "124.1 127-134.1 139.1 98.1", "124.4 117.4 128-133.4 96.1"),
    ],
    2007: [
        (1, 111, "1-111.1", "1-111.4"),
        (111, 117, "111.1 111-117.6", "111.4 111-117.9"),
        (97, 119, "119-117.1 126-135.1 137-141.1 97.1", "119.4 118.4 116.9 116.6 128-135.4 137-141.4 98.1"),
    ],
    2005: [
        (1, 108, "1-106.1 108.1", "1-93.4 107.4 97-106.4 108.4"),
        (108, 111, "108.1 109.6 111.6", "108.4 109.9 111.9"),
        (97, 113, "113-123/2.1 97.1", "113.4 111.9 111.6 115-123/2.4 97.4"),
    ],
    2003: [
        (3, 105, "3-94.1 117-119.1 98-105.1", "3-96.4 117.4 98-105.4"),
        (105, 110, "105.1 106-108.6 110.4", "105.4 106-108.9 109.4"),
        (117, 109, "109-117.1", "109-116.4 98.1 117.4"),
    ],
    2001: [
        (1, 139, "1-85.1 151-147.1 144.1 141-139.1", "1-85.4 151-147.4 144.4 141-139.4"),
        (139, 134, "139.1 138-136.6 134.4", "139.4 138-136.9 135.4"),
        (83, 135, "135-128.1 147.1 126-123.1 121-119.1", "135-128.4 126-123.4 121-119.4 83.4"),
    ],
    1998: [
        (1, 222, "1-70.1 81-103.1 249.1 252.1 253.6 253.9 254.1 248.1 245.1 239.1 238.1 236.1 233.1 231.1 227.1 226.6 211.6", "1-60.4 70-80.4 99.4 265.4 262.4 260.4 271.4 274.4 255.4 246.4 238.4 236.4 233.4 231.4 229.4 226.9 223.9 222.4 211.9"),
        (224, 319, "226.6 211-207/2.6 205.6 202.6 320.4", "224.6 211.9 217-213/2.9 212.1 325.4"),
        (
            103,
            368,
            "368.6 367.4 365.6 363.6 360.6 358.6 356.6 353.6 351.1 347.1 343.6 340.1 338.1 331.1 330.6 328.6 325.1 322.1 320-316/2.1 313-303/2.1 300.1 298.1 294.1 293.6 286-282/2.1 103.1",
            "368.9 366.4 364.9 360.4 359.4 357.4 354.4 352.4 347.4 345.4 344-340/2.4 336.4 334.4 330.9 329.4 327.4 324.4 212.1 322.4 321.6 318.4 316.4 313-307/2.4 304.4 302.9 300.4 298.4 297.9 295.4 292-282/2.4",
        ),
    ],
    1995: [
        (1, 152, "1.1 2.1 4-78.1 80-6/2.1 89-99.1 101-105.1 120.1 121.1 124-127.1 129-133/2.1", "1.4 2.4 4-88.4 91-105.4 152.4 149.4 145.4 143.4 142.4 140.4 135-133.4"),
        (116, 119, "118.6 117.6 119.6 116.6", "118.9 117.9 119.9 116.9"),
        (106, 128, "116.6 119.6 115-106.1 126.1", "119.6 115-106.4 128.1"),
    ],
}


def bounds(spec: str) -> list[float]:
    """The numbers of a spec, in order."""
    out: list[float] = []
    for part in spec.split():
        first, last, step, end = re.fullmatch(r"(\d+)(?:-(\d+))?(?:/(\d+))?\.(\d)", part).groups()
        a, b, s = int(first), int(last or first), int(step or 1)
        out += [n + int(end) / 10 for n in (range(a, b + 1, s) if a <= b else range(a, b - 1, -s))]
    return out


def mesh_region(year: int, region: int) -> tuple[float, float, list[float], list[float]]:
    """(first transect, last transect, lower bounds, upper bounds)."""
    if year not in REGIONS:
        raise LookupError(f"no mesh regions for {year}; there are {', '.join(map(str, sorted(REGIONS)))}")
    first, last, low, up = REGIONS[year][region - 1]
    return first, last, bounds(low), bounds(up)


def mesh_regions(spark: SparkSession, year: int) -> DataFrame:
    """(transect_num, mesh_region, transect_lower_bound, transect_upper_bound): the transects of each region, in order, with their bounds.

    The bounds come in the sense of the mesh crop, where the lower one is the east
    or north end. Transects beyond a list's end have no bound there.
    """
    rows = []
    for region in (1, 2, 3):
        first, last, low, up = mesh_region(year, region)
        numbers = [float(n) for n in range(int(first), int(last) + 1)]
        pick = lambda x, k: x[k] if k < len(x) else None
        rows += [(n, region, pick(up, k), pick(low, k)) for k, n in enumerate(numbers)]
    return spark.createDataFrame(rows, "transect_num double, mesh_region int, transect_lower_bound double, transect_upper_bound double")
