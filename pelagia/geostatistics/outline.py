"""Outline of overlapping convex polygons: the boundary of their union, with area and length.

Every edge is cut by the polygons near it: a convex polygon covers one stretch of
an edge, found by clipping with its sides, and what no polygon covers is outline.
Edges meet polygons in square tiles. A tile is as wide as the mean box or the root
of the mean box area, whichever is larger, so that all boxes together cover at most
nine tiles a polygon, whatever their sizes; a pair that shares several tiles is
formed in one of them. The stretches of an edge are merged by a running maximum, so
no task holds all of them.

Cases: polygons with fewer than three corners, or a null corner list, have no area
and no outline. Corners run counter-clockwise. Where sides of several polygons lie
on each other in one direction, the polygon with the smallest key keeps them; in
opposite directions both lie inside the union and go. Keys are unique in a group;
rows with a null key or group are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.geostatistics.cropping import transect_extent

#: Points nearer to a line than this share of the coordinates' size lie on it.
TOLERANCE = 1e-12


def sides(corners: Column) -> Column:
    """The sides of a polygon as array of (x0, y0, x1, y1)."""
    after = lambda i: F.coalesce(F.get(corners, i + 1), F.get(corners, F.lit(0)))
    return F.transform(corners, lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), after(i)["x"].alias("x1"), after(i)["y"].alias("y1")))


def left_of(side: Column, x: Column, y: Column) -> Column:
    """How far a point lies left of a side, times the side's length; 0 within the tolerance."""
    dx, dy = side["x1"] - side["x0"], side["y1"] - side["y0"]
    value = dx * (y - side["y0"]) - dy * (x - side["x0"])
    size = F.abs(x) + F.abs(y) + F.abs(side["x0"]) + F.abs(side["y0"])
    return F.when(F.abs(value) <= TOLERANCE * (F.abs(dx) + F.abs(dy)) * size, F.lit(0.0)).otherwise(value)


def covered(edge: Column, around: Column, first: Column) -> Column:
    """Array of no or one (lo, hi): the stretch of an edge that a polygon with these sides covers, as shares of its length.

    ``first`` tells whether the polygon keeps a side that both have.
    """

    def ends(side: Column) -> Column:
        same = (edge["x1"] - edge["x0"]) * (side["x1"] - side["x0"]) + (edge["y1"] - edge["y0"]) * (side["y1"] - side["y0"]) > 0
        return F.struct(left_of(side, edge["x0"], edge["y0"]).alias("a"), left_of(side, edge["x1"], edge["y1"]).alias("b"), same.alias("same"))

    def clip(so_far: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        on = (a == 0) & (b == 0)
        none = F.when(on, e["same"] & ~first).otherwise((a <= 0) & (b <= 0))
        lo = F.when(none, 2.0).when((a < 0) & (b > 0), F.greatest(so_far["lo"], a / (a - b))).otherwise(so_far["lo"])
        hi = F.when((a > 0) & (b < 0), F.least(so_far["hi"], a / (a - b))).otherwise(so_far["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    stretch = F.aggregate(F.transform(around, ends), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), clip)
    return F.filter(F.array(stretch), lambda s: s["lo"] < s["hi"])


def _tiles(lo: str, hi: str, tile: float) -> Column:
    return F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile)))


def _in_tiles(rows: DataFrame, tile: float) -> DataFrame:
    return rows.withColumn("tx", _tiles("x_lo", "x_hi", tile)).withColumn("ty", _tiles("y_lo", "y_hi", tile))


def outline(polygons: DataFrame, key: str, corners: str = "corners", by: Sequence[str] = ()) -> DataFrame:
    """(by..., key, x0, y0, x1, y1): pieces of the union's boundary, the union on their left; one union per ``by``."""
    groups = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    names = [f"_by{i}" for i in range(len(by))]
    ring = F.col(corners)
    over = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    boxes = polygons.where((F.size(corners) > 2) & F.col(key).isNotNull()).select(
        *groups, F.col(key).alias("key"), sides(ring).alias("sides"), over(F.array_min, "x").alias("x_lo"), over(F.array_max, "x").alias("x_hi"), over(F.array_min, "y").alias("y_lo"), over(F.array_max, "y").alias("y_hi")
    )
    for n in names:
        boxes = boxes.where(F.col(n).isNotNull())
    w, h = F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo")
    s = boxes.agg(F.avg(w).alias("w"), F.avg(h).alias("h"), F.sqrt(F.avg(w * h)).alias("a")).first()
    tile = max(s["w"] or 0.0, s["h"] or 0.0, s["a"] or 0.0) or 1.0
    edges = boxes.select(*names, "key", F.posexplode("sides").alias("no", "edge")).where("edge.x0 <> edge.x1 OR edge.y0 <> edge.y1")
    ends = edges.select("*", F.least("edge.x0", "edge.x1").alias("x_lo"), F.greatest("edge.x0", "edge.x1").alias("x_hi"), F.least("edge.y0", "edge.y1").alias("y_lo"), F.greatest("edge.y0", "edge.y1").alias("y_hi"))
    a, b = _in_tiles(ends, tile).alias("a"), _in_tiles(boxes, tile).alias("b")
    meet = (F.col("a.key") != F.col("b.key")) & (F.col("a.x_lo") <= F.col("b.x_hi")) & (F.col("a.x_hi") >= F.col("b.x_lo")) & (F.col("a.y_lo") <= F.col("b.y_hi")) & (F.col("a.y_hi") >= F.col("b.y_lo"))
    for n in ("tx", "ty", *names):
        meet &= F.col(f"a.{n}") == F.col(f"b.{n}")
    for c in "xy":  # of the tiles that both lie in, the first forms the pair
        meet &= F.col(f"a.t{c}") == F.floor(F.greatest(f"a.{c}_lo", f"b.{c}_lo") / tile)
    # the size of arrays of sides is not in an estimate, so this side must not be broadcast on one
    pairs = a.join(b.hint("merge"), meet).select(*[F.col(f"a.{n}") for n in names], F.col("a.key").alias("key"), "a.no", "a.edge", F.inline(covered(F.col("a.edge"), F.col("b.sides"), F.col("b.key") < F.col("a.key"))).alias("lo", "hi"))
    columns = [*names, "key", "no", "edge"]
    # an end that every edge has, behind which nothing is open
    whole = pairs.unionByName(edges.select(*columns, F.lit(1.0).alias("lo"), F.lit(1.0).alias("hi")))
    before = Window.partitionBy(*names, "key", "no").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    open_ = whole.withColumn("from", F.coalesce(F.max("hi").over(before), F.lit(0.0))).where(F.col("lo") - F.col("from") > TOLERANCE)

    def at(share: str, c: str) -> Column:
        start, stop = F.col(f"edge.{c}0"), F.col(f"edge.{c}1")
        return F.when(F.col(share) == 1, stop).otherwise(start + F.col(share) * (stop - start))

    return open_.select(*[F.col(n).alias(c) for n, c in zip(names, by)], F.col("key").alias(key), at("from", "x").alias("x0"), at("from", "y").alias("y0"), at("lo", "x").alias("x1"), at("lo", "y").alias("y1"))


def measures(pieces: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., area, length) of outlines; holes count as such."""
    area = F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2
    return pieces.groupBy(*by).agg(area.alias("area"), F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("length"))


def survey_outline(points: DataFrame, nearest_transects: int = 3, transect: str = "transect_num", x: str = "x", y: str = "y") -> DataFrame:
    """Outline of a survey: the union of the hulls of every transect with its nearest ones."""
    return outline(transect_extent(points, nearest_transects, transect, x, y).checkpoint(), transect)
