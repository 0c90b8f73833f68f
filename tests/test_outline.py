"""Outlines of unions of polygons against brute force."""

import numpy as np
from pyspark.sql import functions as F

from pelagia.geostatistics import cropping, outline

SCHEMA = "id int, corners array<struct<x:double,y:double>>"


def ring(points):
    return [{"x": float(a), "y": float(b)} for a, b in points]


def total(spark, polygons):
    df = spark.createDataFrame([(k, None if p is None else ring(p)) for k, p in polygons], SCHEMA)
    row = outline.measures(outline.outline(df, "id")).first()
    return (None, None) if row is None or row["area"] is None else (round(row["area"], 9), round(row["length"], 9))


SQUARE = [(0, 0), (2, 0), (2, 2), (0, 2)]


def moved(dx, dy):
    return [(a + dx, b + dy) for a, b in SQUARE]


def test_shared_sides_and_copies(spark):
    assert total(spark, [(1, SQUARE)]) == (4, 8)
    assert total(spark, [(1, SQUARE), (2, SQUARE), (3, SQUARE)]) == (4, 8)
    assert total(spark, [(1, SQUARE), (2, moved(2, 0))]) == (8, 12)
    assert total(spark, [(1, SQUARE), (2, moved(1, 0))]) == (6, 10)
    assert total(spark, [(1, SQUARE), (2, moved(1, 1))]) == (7, 12)
    assert total(spark, [(1, SQUARE), (2, moved(9, 9))]) == (8, 16)
    assert total(spark, [(1, SQUARE), (2, [(0.5, 0), (1, 0), (1, 1)])]) == (4, 8)  # inside, on a side
    assert total(spark, [(2, SQUARE), (1, [(0.5, 0), (1, 0), (1, 1)])]) == (4, 8)


def test_hole_and_empty(spark):
    bars = [[(0, 0), (3, 0), (3, 1), (0, 1)], [(0, 2), (3, 2), (3, 3), (0, 3)], [(0, 0), (1, 0), (1, 3), (0, 3)], [(2, 0), (3, 0), (3, 3), (2, 3)]]
    assert total(spark, list(enumerate(bars))) == (8, 16)
    assert total(spark, [(1, None), (2, []), (3, [(0, 0), (1, 1)]), (4, SQUARE), (None, moved(9, 9))]) == (4, 8)
    assert total(spark, []) == (None, None)


def test_groups_and_a_wide_polygon(spark):
    small = [(k, "a", ring(moved(3 * (k % 20), 3 * (k // 20)))) for k in range(200)]
    rows = small + [(500, "a", ring([(-1, -1), (61, -1), (61, 31), (-1, 31)]))] + [(k, "b", c) for k, _, c in small]
    df = spark.createDataFrame(rows, "id int, g string, corners array<struct<x:double,y:double>>")
    got = {r["g"]: (round(r["area"], 6), round(r["length"], 6)) for r in outline.measures(outline.outline(df, "id", by=["g"]), ["g"]).collect()}
    assert got == {"a": (62 * 32, 2 * (62 + 32)), "b": (800, 1600)}


def test_random_polygons_by_crossings(spark):
    rng = np.random.default_rng(5)
    polygons = []
    for k in range(40):
        c = cropping.hull(rng.normal(size=(8, 2)) * rng.uniform(0.2, 2) + rng.uniform(-5, 5, 2))
        polygons.append((k, c.tolist()))
    df = spark.createDataFrame([(k, ring(p)) for k, p in polygons], SCHEMA)
    pieces = outline.outline(df, "id").select("x0", "y0", "x1", "y1").toPandas().to_numpy()
    spots = rng.uniform(-9, 9, (4000, 2))
    inside = np.zeros(len(spots), bool)
    for _, p in polygons:
        a, b = np.array(p), np.roll(np.array(p), -1, 0)
        cross = (b - a)[:, 0] * (spots[:, None, 1] - a[:, 1]) - (b - a)[:, 1] * (spots[:, None, 0] - a[:, 0])
        inside |= (cross > 0).all(1)
    x0, y0, x1, y1 = pieces.T
    up, down = (y0 <= spots[:, 1:]) & (y1 > spots[:, 1:]), (y1 <= spots[:, 1:]) & (y0 > spots[:, 1:])
    left = (x1 - x0) * (spots[:, 1:] - y0) - (spots[:, :1] - x0) * (y1 - y0)
    winding = (up & (left > 0)).sum(1) - (down & (left < 0)).sum(1)
    assert set(winding.tolist()) <= {0, 1}  # the union is on the left of all pieces, once
    assert (winding == inside).all() and 200 < inside.sum() < 3800


def test_survey_outline(spark):
    rng = np.random.default_rng(3)
    rows = [(t, float(x), t + float(e)) for t in range(12) for x, e in zip(np.linspace(0, 10, 30), rng.normal(0, 0.05, 30))]
    points = spark.createDataFrame(rows, "transect_num int, x double, y double")
    pieces = outline.survey_outline(points, 2)
    m = outline.measures(pieces).first()
    extents = cropping.transect_extent(points, 2).collect()
    whole = cropping.hull(np.array([(r[1], r[2]) for r in rows]))
    area = lambda c: 0.5 * abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(c, np.roll(c, -1, 0))))
    assert max(area(np.array([(p["x"], p["y"]) for p in r["corners"]])) for r in extents) < m["area"] <= area(whole) + 1e-9
    ends = pieces.select("x0", "y0").union(pieces.select("x1", "y1")).groupBy("x0", "y0").count()
    assert ends.where(F.col("count") % 2 == 1).count() <= ends.count() / 2  # most ends meet to the last bit


def test_polygons_are_not_broadcast(spark):
    """Arrays of sides are larger than any estimate of them, so no side of the join goes through the driver."""
    at = "array(named_struct('x', 0.0D + id, 'y', 0.0D), named_struct('x', 2.0D + id, 'y', 0.0D), named_struct('x', 1.0D + id, 'y', 2.0D))"
    plan = outline.outline(spark.range(5).selectExpr("id", f"{at} AS corners"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
