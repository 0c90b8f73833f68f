"""Standardised coordinates, survey hulls and mesh cropping.

Hulls are made in two steps: partial hulls of Arrow batches, then one small hull
per transect, so no transect has to fit into a task. A mesh point meets only the
hulls whose widened box covers its tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.geostatistics.kriging import nearest
from pelagia.geostatistics.projection import survey_zone, with_utm
from pelagia.geostatistics.variogram import near_pairs
from pelagia.session import prepare

METRES_PER_NMI = 1852.0


def interpolate(at: DataFrame, column: str, knots: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """Add ``name``: knots' piecewise linear y at ``column``; null outside their range.

    Segments are cut at whole numbers of x, so that the join is an equality with the
    exact bounds checked after it. Of knots with the same x the one with the smallest
    y counts.
    """
    spots = knots.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("_x")).agg(F.min(y).cast("double").alias("_y"))
    pieces = spots.withColumn("_x1", F.lead("_x").over(Window.orderBy("_x"))).withColumn("_y1", F.lead("_y").over(Window.orderBy("_x")))  # one row per knot of a reference line
    # a knot's segment is closed on the left; the last knot is a segment of its own
    hit = (F.col(column) >= F.col("_x")) & (F.col(column) < F.col("_x1")) | (F.col(column) == F.col("_x")) & F.col("_x1").isNull()
    cells = pieces.withColumn("_cell", F.explode(F.sequence(F.floor("_x"), F.floor(F.coalesce("_x1", "_x")))))
    rows = at.withColumn("_at", F.floor(F.col(column))).join(cells, (F.col("_at") == F.col("_cell")) & hit, "left")
    slope = F.coalesce(F.try_divide(F.col("_y1") - F.col("_y"), F.col("_x1") - F.col("_x")), F.lit(0.0))
    return rows.withColumn(name, F.col("_y") + slope * (F.col(column) - F.col("_x"))).drop("_x", "_y", "_x1", "_y1", "_cell", "_at")


def transform_coordinates(data: DataFrame, x_offset: float = 0.0, y_offset: float = 0.0, coordinates: tuple[str, str] = ("longitude", "latitude"), reference: DataFrame | None = None, delta_x: float | None = None, delta_y: float | None = None) -> tuple[DataFrame, float | None, float | None]:
    """Standardised x and y, and the extents they were divided by.

    With a reference line, x is counted from the line at the row's latitude; rows
    outside the line's latitudes get a null x.
    """
    lon, lat = coordinates
    rows = data.withColumn("_line", F.lit(0.0)) if reference is None else interpolate(data, lat, reference, lat, lon, "_line")
    shifted = F.col(lon) - F.col("_line") + x_offset
    if delta_x is None or delta_y is None:
        s = rows.agg((F.max(shifted) - F.min(shifted)).alias("x"), (F.max(lat) - F.min(lat)).alias("y")).first()
        delta_x, delta_y = s["x"] if delta_x is None else delta_x, s["y"] if delta_y is None else delta_y
    wide, high = (F.lit(float(d)) if d is not None else F.lit(None).cast("double") for d in (delta_x, delta_y))
    x = F.try_divide(F.cos(F.radians(lat)) * (shifted - x_offset), wide)
    return rows.withColumns({"x": x, "y": F.try_divide(F.col(lat) - y_offset, high)}).drop("_line"), delta_x, delta_y


def centroids(points: DataFrame, transect: str = "transect_num", x: str = "x", y: str = "y") -> DataFrame:
    """Mean of the distinct positions of each transect."""
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(transect, x, y).distinct().groupBy(transect).agg(F.avg(x).alias(x), F.avg(y).alias(y))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (x, y) rows, counter-clockwise (one or two points: those)."""
    rows = sorted(set(map(tuple, points.tolist())))
    if len(rows) < 3:
        return np.array(rows)

    def chain(order):
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(rows) + chain(reversed(rows)))


def hulls(points: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(key, corners): the convex hull of each key's points as array of (x, y)."""
    kind = points.schema[key].dataType.simpleString()

    def partial(batches):
        for b in batches:
            frame = b.to_pandas()
            for k, g in frame.groupby("key", dropna=False):
                c = hull(g[["x", "y"]].to_numpy())
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"key": [k] * len(c), "x": c[:, 0], "y": c[:, 1]}), schema=pa.schema([("key", b.schema.field("key").type), ("x", pa.float64()), ("y", pa.float64())]), preserve_index=False)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        c = hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "corners": [[{"x": a, "y": b} for a, b in c.tolist()]]})

    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    corners = rows.mapInArrow(partial, f"key {kind}, x double, y double")
    return corners.groupBy("key").applyInPandas(whole, f"key {kind}, corners array<struct<x:double,y:double>>").withColumnRenamed("key", key)


def transect_extent(points: DataFrame, nearest_transects: int = 3, transect: str = "transect_num", x: str = "x", y: str = "y") -> DataFrame:
    """(transect, corners): per transect the hull of itself and its nearest transects by centroid, ties in."""
    prepare(points.sparkSession)
    own = hulls(points, transect, x, y).checkpoint()
    mid = centroids(points, transect, x, y).withColumn("_n", F.xxhash64(transect)).withColumn("_v", F.lit(0.0)).checkpoint()
    far = nearest(mid, mid, transect, "_n", "_v", nearest_transects + 1, 1000.0, (x, y))  # itself is the nearest
    far = far.select(F.col("cell").alias(transect), F.element_at("near", -1)["distance"].alias("_far"))
    width = far.agg(F.max("_far")).first()[0] or 0.0
    a = mid.join(far, transect).select(transect, x, y, "_far")
    pairs = near_pairs(a, mid.select(transect, x, y), max(width, 1e-9), x, y).where(F.col("distance") <= F.col("a._far"))
    links = pairs.select(F.col(f"a.{transect}").alias(transect), F.col(f"b.{transect}").alias("_other"))
    corners = own.select(F.col(transect).alias("_other"), F.explode("corners").alias("p"))
    return hulls(links.join(corners, "_other").select(transect, F.col("p.x").alias("x"), F.col("p.y").alias("y")), transect)


def within(corners: Column, x: Column, y: Column, buffer: float) -> Column:
    """Is a point inside a convex polygon (counter-clockwise corners) or at most ``buffer`` from it?"""
    edges = F.transform(corners, lambda p, i: F.struct(p.alias("a"), F.coalesce(F.get(corners, i + 1), corners[0]).alias("b")))

    def left(e: Column) -> Column:
        return (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) >= (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])

    def close(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.coalesce(F.try_divide((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return (x - e["a"]["x"] - t * dx) ** 2 + (y - e["a"]["y"] - t * dy) ** 2 <= buffer * buffer

    return (F.size(corners) > 2) & F.forall(edges, left) | F.exists(edges, close)


def hull_crop(transects: DataFrame, mesh: DataFrame, num_nearest_transects: int = 3, mesh_buffer_distance: float = 2.5, coordinates: tuple[str, str] = ("longitude", "latitude"), transect: str = "transect_num") -> DataFrame:
    """Mesh rows within the buffered (nautical miles) union of the transects' extents.

    Each of mesh and transects is projected to the zone of its own median position;
    rows at the same place are projected and tested once.
    """
    prepare(mesh.sparkSession)
    buffer = mesh_buffer_distance * METRES_PER_NMI
    points = with_utm(transects.select(transect, "longitude", "latitude").distinct(), *survey_zone(transects), names=("x", "y")).checkpoint()
    polygons = transect_extent(points, num_nearest_transects, transect).checkpoint()
    side = 100_000.0  # metres
    box = lambda f, c: f(F.transform("corners", lambda p: p[c]))
    span = lambda c: F.explode(F.sequence(F.floor((box(F.array_min, c) - buffer) / side), F.floor((box(F.array_max, c) + buffer) / side)))
    boxed = polygons.withColumn("_i", span("x")).withColumn("_j", span("y")).select("corners", "_i", "_j")
    cells = with_utm(mesh.select(*coordinates).distinct(), *survey_zone(mesh, coordinates), coordinates, ("_x", "_y"))
    cells = cells.withColumn("_i", F.floor(F.col("_x") / side)).withColumn("_j", F.floor(F.col("_y") / side))
    inside = (cells["_i"] == boxed["_i"]) & (cells["_j"] == boxed["_j"]) & within(boxed["corners"], cells["_x"], cells["_y"], buffer)
    return mesh.join(cells.join(boxed, inside, "left_semi").select(*coordinates), list(coordinates), "left_semi").select(*mesh.columns)


def transect_end(rows: DataFrame, bound: str, east_west: tuple[str, str], transect: str = "transect_num") -> DataFrame:
    """(transect, longitude, latitude) of the end that a bound's first decimal names.

    .1 the westernmost row, .4 the easternmost, .6 the southernmost, .9 the northernmost.
    """
    side = F.round(F.pmod(F.col(bound), F.lit(1.0)) * 10)
    point = F.struct("longitude", "latitude")
    by = {1.0: F.min_by(point, "longitude"), 4.0: F.max_by(point, "longitude"), 6.0: F.min_by(point, "latitude"), 9.0: F.max_by(point, "latitude")}
    ends = rows.withColumn("_side", side).groupBy(transect, "_side").agg(*[v.alias(f"_{int(k)}") for k, v in by.items()])
    chosen = F.coalesce(*[F.when(F.col("_side") == k, F.col(f"_{int(k)}")) for k in by])
    return ends.select(transect, chosen["longitude"].alias(east_west[0]), chosen["latitude"].alias(east_west[1]))


def _line(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Piecewise linear y at ``at``; nan outside the range of x."""
    order = np.argsort(x, kind="stable")
    return np.interp(at, x[order], y[order], np.nan, np.nan) if len(x) else np.full(len(at), np.nan)


def transect_ends_crop(transects: DataFrame, mesh: DataFrame, latitude_resolution: float, regions: DataFrame, transect: str = "transect_num") -> tuple[DataFrame, DataFrame]:
    """Mesh rows between the ends of the transects of three regions, and the transects with their region.

    ``regions`` has transect_num, mesh_region (1, 2, 3), transect_lower_bound and
    transect_upper_bound. Regions 1 and 3 are swept in latitude between their west
    and east ends, region 2 in longitude between south and north. One row per
    transect reaches the driver, which makes one box per sweep step; the mesh meets
    the boxes by tile. Where only one side of a step is known, the other comes from
    the slope between the ends nearest to it.
    """
    rows = transects.join(regions.select(F.col("transect_num").alias(transect), "mesh_region", "transect_lower_bound", "transect_upper_bound"), transect)
    low = transect_end(rows.withColumn("_k", F.struct("mesh_region", transect)), "transect_lower_bound", ("lon", "lat"), "_k").select("_k", F.lit("low").alias("end"), "lon", "lat")
    up = transect_end(rows.withColumn("_k", F.struct("mesh_region", transect)), "transect_upper_bound", ("lon", "lat"), "_k").select("_k", F.lit("up").alias("end"), "lon", "lat")
    ends = low.unionByName(up).select("_k.mesh_region", F.col(f"_k.{transect}").alias("t"), "end", "lon", "lat").where("lon IS NOT NULL").toPandas()  # two rows per transect
    spans = {r["mesh_region"]: r for r in rows.groupBy("mesh_region").agg(F.min("latitude").alias("y0"), F.max("latitude").alias("y1"), F.min("longitude").alias("x0"), F.max("longitude").alias("x1"), F.avg("latitude").alias("ym")).collect()}  # three rows
    first_last = rows.where("mesh_region = 3").groupBy().agg(F.min(transect).alias("a"), F.max(transect).alias("b")).first()
    step, boxes = latitude_resolution, []
    for region in (1, 3):
        if region not in spans:
            continue
        e = ends[ends.mesh_region == region]
        west, east = e[e.end == "up"], e[e.end == "low"]
        if region == 1:
            at = np.arange(spans[1]["y0"], spans[1]["y1"], step)
        else:
            s = rows.where(F.col("mesh_region") == 3).where(F.col(transect).isin(first_last["a"], first_last["b"])).agg(F.min("latitude"), F.max("latitude")).first()
            at = np.arange(s[0], s[1], step)
        w, z = (_line(k["lat"].to_numpy(), k["lon"].to_numpy(), at) for k in (west, east))
        if region == 3 and len(west) and len(east):
            a, b = west.loc[west["lat"].idxmax()], east.loc[east["lat"].idxmax()]
            slope = (a["lon"] - b["lon"]) / (a["lat"] - b["lat"]) if a["lat"] != b["lat"] else 0.0
            known = ~(np.isnan(w) & np.isnan(z))
            guess = slope * (at - b["lat"]) + b["lon"]
            w, z = np.where(known & np.isnan(w), guess, w), np.where(known & np.isnan(z), guess, z)
        pad = step * np.cos(np.radians(at))
        boxes += [(x0 - p, x1 + p, y - step, y + step) for x0, x1, p, y in zip(w, z, pad, at) if x0 == x0 and x1 == x1]
    if 2 in spans:
        e = ends[ends.mesh_region == 2]
        south, north = e[e.end == "up"], e[e.end == "low"]
        wide = step * np.cos(np.radians(spans[2]["ym"]))
        at = np.arange(spans[2]["x0"], spans[2]["x1"], wide)
        s, n = (_line(k["lon"].to_numpy(), k["lat"].to_numpy(), at) for k in (south, north))
        for x, a, b in zip(at, s, n):
            if a != a and b != b:
                continue
            if a != a or b != b:
                p, q = north.iloc[np.abs(north["lon"].to_numpy() - x).argmin()], south.iloc[np.abs(south["lon"].to_numpy() - x).argmin()]
                slope = (p["lat"] - q["lat"]) / (p["lon"] - q["lon"]) if p["lon"] != q["lon"] else 0.0
                guess = slope * (x - q["lon"]) + q["lat"]
                a, b = guess if a != a else a, guess if b != b else b
            boxes.append((x - wide, x + wide, a - step, b + step))
    spark = mesh.sparkSession
    frame = spark.createDataFrame([tuple(map(float, b)) for b in boxes], "_x0 double, _x1 double, _y0 double, _y1 double")
    frame = frame.where("_x0 <= _x1 AND _y0 < _y1").withColumn("_t", F.explode(F.sequence(F.floor(F.col("_y0") / step), F.floor(F.col("_y1") / step))))
    cells = mesh.withColumn("_t", F.floor(F.col("latitude") / step))
    hit = (cells["_t"] == frame["_t"]) & (cells["longitude"] >= frame["_x0"]) & (cells["longitude"] <= frame["_x1"]) & (cells["latitude"] >= frame["_y0"]) & (cells["latitude"] < frame["_y1"])
    return cells.join(frame, hit, "left_semi").select(*mesh.columns), rows
