"""Projections forward and back, over their whole extents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.geostatistics import projection_systems as systems

EXTENT = {"2991": (-125, -116, 41, 47), "3005": (-140, -113, 48, 61), "3310": (-125, -113, 32, 43), "3338": (172, 230, 51, 72), "3347": (-142, -52, 40, 85), "3395": (-180, 179.9, -80, 84), "3857": (-180, 179.9, -85, 85), "3978": (-142, -52, 40, 85), "5070": (-125, -66, 24, 50), "32610": (-126.5, -119.5, 0, 84), "32760": (173.5, 180, -80, 0)}


@pytest.mark.parametrize("code", sorted(EXTENT))
def test_there_and_back_within_a_millimetre(spark, code):
    x0, x1, y0, y1 = EXTENT[code]
    rng = np.random.default_rng(1)
    rows = [(float((a + 180) % 360 - 180), float(b)) for a, b in zip(rng.uniform(x0, x1, 400), rng.uniform(y0, y1, 400))]
    df = systems.reproject(spark.createDataFrame(rows, "longitude double, latitude double"), f"epsg:{code}")
    back = systems.reproject(df, "4326", ("x", "y"), code, ("lon", "lat"))
    again = systems.reproject(back, code, ("lon", "lat"), names=("x2", "y2"))
    s = again.agg(F.max(F.abs(F.col("x") - F.col("x2"))).alias("x"), F.max(F.abs(F.col("y") - F.col("y2"))).alias("y"), F.max(F.abs(F.col("lat") - F.col("latitude"))).alias("lat")).first()
    assert s["x"] < 1e-3 and s["y"] < 1e-3 and s["lat"] < 1e-9


def test_origins_nulls_and_poles(spark):
    rows = spark.createDataFrame([(-120.5, 41.75), (None, 40.0), (-120.0, None), (0.0, 90.0)], "longitude double, latitude double")
    got = systems.reproject(rows, 2991).collect()
    assert (got[0]["x"], got[0]["y"]) == (pytest.approx(400_000.0), pytest.approx(0.0, abs=1e-6)) and got[1]["x"] is None and got[2]["y"] is None
    assert systems.reproject(rows, "epsg:3395").collect()[3]["y"] is None
    with pytest.raises(ValueError, match="neither geographic"):
        systems.reproject(rows, "epsg:9999")


def test_areas_and_angles(spark):
    """Albers keeps areas; Lambert and Mercator keep angles: by small steps on the ellipsoid."""
    step, e2, a = 1e-5, systems.eccentricity(systems.GRS80) ** 2, systems.GRS80[0]
    points = [(-121.0, 43.0), (-118.0, 46.0), (-123.5, 41.2)]
    for code in ("3310", "5070", "2991", "3978"):
        for lon, lat in points:
            df = spark.createDataFrame([(lon, lat), (lon + step, lat), (lon, lat + step)], "longitude double, latitude double")
            p, q, r = (np.array([row["x"], row["y"]]) for row in systems.reproject(df, code).collect())
            w = 1 - e2 * np.sin(np.radians(lat)) ** 2
            east, north = a / np.sqrt(w) * np.cos(np.radians(lat)) * np.radians(step), a * (1 - e2) / w**1.5 * np.radians(step)
            u, v = (q - p) / east, (r - p) / north
            if systems.SYSTEMS[code].kind == "albers":
                assert abs(u[0] * v[1] - u[1] * v[0]) == pytest.approx(1.0, abs=1e-5)
            else:
                assert u @ v == pytest.approx(0.0, abs=1e-5) and np.hypot(*u) == pytest.approx(np.hypot(*v), rel=1e-5)
