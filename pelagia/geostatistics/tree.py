"""Nearest neighbours by a packed tree of boxes.

Points are sorted into slabs along the longer side of their middle nine tenths and cut
into leaves of equal counts along the other, as many slabs as make leaves about as wide
as tall, so that a dense place has many small leaves and a sparse one few wide ones; leaves are packed
into nodes in the same way, up to at most FANOUT at the top. A query goes down from
there: in each node's box are at least its count of points, and each side of a tight
box has one, which bounds the distance of the kth neighbour from above; children whose
box is farther go. So a query meets the leaves that its neighbours' circle touches,
wherever it lies and however the points are spread.

Queries and nodes meet in equi-joins on the node; the children stand in the node's row
and the points in the leaf's, as arrays, so that no row is made for a pair.

Cases: of points at one position only the k with the smallest numbers can be
neighbours of anything, so the others go first. Equal distances take the smaller number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions.ranking import global_rank
from pelagia.session import prepare

#: Children of a node, and nodes at the top.
FANOUT = 32
#: Points of a leaf, at least.
LEAF = 32
BOX = ("x0", "x1", "y0", "y1")
POINT = "array<struct<distance:double,number:bigint,x:double,y:double,z:double>>"
#: A level of at most so many nodes is broadcast (about 2 kB each); a larger one is dealt with the queries.
FEW = 4096
#: A bound is loosened by this share, as distances are rounded.
SLACK = 1e-12


@dataclass
class Tree:
    """``leaves`` has id, points; ``levels`` have id, kids, from the top down, all with their number of rows; ``top`` the nodes to begin with."""

    leaves: tuple[DataFrame, int]
    levels: list[tuple[DataFrame, int]]
    top: list[dict]


def packed(rows: DataFrame, n: int, size: int, tie: str) -> DataFrame:
    """Rows with ``id``, the same for ``size`` neighbouring rows: slabs of equal counts along the longer side, cut along the other."""
    sides = rows.approxQuantile(["x", "y"], [0.05, 0.95], 0.01)
    wide, tall = (q[1] - q[0] for q in sides)
    along, across = ("y", "x") if tall > wide else ("x", "y")
    least = max(min(wide, tall), 1e-12 * max(wide, tall), 1e-300)
    slabs = max(1, min(-(-n // size), round((n / size * max(wide, tall, least) / least) ** 0.5)))
    deep = -(-n // (slabs * size)) * size  # rows of a slab, a multiple of size
    ranked = global_rank(rows, along, "_r", across, tie).withColumn("_slab", F.expr(f"_r div {deep}"))
    place = F.row_number().over(Window.partitionBy("_slab").orderBy(across, along, tie)) - 1  # about sqrt(n x size) rows or fewer
    return ranked.withColumn("id", F.col("_slab") * (1 << 32) + F.floor(place / size)).drop("_r", "_slab")


def boxes(prefix: str = "") -> list[Column]:
    return [f(F.col(prefix + c if prefix else c[0])).alias(c) for c, f in zip(BOX, (F.min, F.max, F.min, F.max))]


def build(points: DataFrame, k: int, leaf: int = LEAF, fanout: int = FANOUT) -> Tree | None:
    """The tree of points (x, y, z, number), none of them null, for searches of k; None without points."""
    prepare(points.sparkSession)
    first = points.withColumn("_k", F.row_number().over(Window.partitionBy("x", "y").orderBy("number"))).where(F.col("_k") <= k).drop("_k")
    n, size = first.count(), max(leaf, k)
    if not n:
        return None
    leaves = packed(first, n, size, "number").groupBy("id").agg(F.collect_list(F.struct("number", "x", "y", "z")).alias("points"), F.count("*").alias("n"), *boxes()).checkpoint()
    nodes, levels = leaves.select("id", "n", *BOX), []
    below = count = leaves.count()
    while count > fanout:
        middles = nodes.withColumns({"x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2}).withColumnRenamed("id", "kid")
        kids = F.collect_list(F.struct(F.col("kid").alias("id"), "n", *BOX)).alias("kids")
        upper = packed(middles, count, fanout, "kid").groupBy("id").agg(kids, F.sum("n").alias("n"), *[f(c).alias(c) for c, f in zip(BOX, (F.min, F.max, F.min, F.max))]).checkpoint()
        count = upper.count()
        levels.insert(0, (upper.select("id", "kids"), count))
        nodes = upper.select("id", "n", *BOX)
    return Tree((leaves.select("id", "points"), below), levels, [r.asDict() for r in nodes.collect()])  # at most fanout rows


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or a lambda in it uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distances(box: Column) -> tuple[Column, Column, Column]:
    """Of a cell (x, y) from a box: no point is nearer, all are as near, and at least one is."""
    x, y, (x0, x1, y0, y1) = F.col("x"), F.col("y"), (box[c] for c in BOX)
    near = lambda v, a, b: F.greatest(a - v, F.lit(0.0), v - b)
    far = lambda v, a, b: F.greatest(F.abs(v - a), F.abs(v - b))
    face = lambda v, a, b: F.least(F.abs(v - a), F.abs(v - b))
    long = lambda p, q: F.sqrt(p * p + q * q)
    fx, fy = far(x, x0, x1), far(y, y0, y1)
    return long(near(x, x0, x1), near(y, y0, y1)), long(fx, fy), F.least(long(face(x, x0, x1), fy), long(fx, face(y, y0, y1)))


def measured(box: Column) -> Column:
    least, most, one = distances(box)
    return F.struct(box["id"].alias("id"), box["n"].alias("n"), least.alias("least"), most.alias("most"), one.alias("one"))


def pruned(kids: Column, k: int) -> Column:
    """(bound, kids) of measured boxes: a bound at most the cell's, and the boxes that it leaves."""

    def tightened(boxes: Column) -> Column:
        # k nodes have a point each within their ``one``; a node of k points has k within its ``most``
        kth = F.get(F.sort_array(F.transform(boxes, lambda b: b["one"])), k - 1)
        full = F.array_min(F.transform(F.filter(boxes, lambda b: b["n"] >= k), lambda b: b["most"]))
        return F.struct(F.least("bound", kth * (1 + SLACK), full * (1 + SLACK)).alias("bound"), boxes.alias("kids"))

    def left(s: Column) -> Column:
        return F.struct(s["bound"].alias("bound"), F.filter(s["kids"], lambda b: b["least"] <= s["bound"]).alias("kids"))

    return let(let(kids, tightened), left)


def narrowed(cells: DataFrame, kids: Column, k: int) -> DataFrame:
    """(cell, x, y, bound, kids) with a tighter bound and what it leaves of the measured boxes."""
    return cells.select("cell", "x", "y", pruned(kids, k).alias("_s")).select("cell", "x", "y", "_s.bound", "_s.kids")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows by cell, in as many parts as shuffles have: they hold few bytes but much work, so parts must not be merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell", "x", "y")


def met_by(asked: DataFrame, nodes: tuple[DataFrame, int]) -> DataFrame:
    """Queries with the row of the node that each has come to, in the queries' parts where nodes are few."""
    rows, n = nodes
    return asked.join(F.broadcast(rows) if n <= FEW else rows.hint("merge"), "id")


def meetings(cells: DataFrame, tree: Tree, k: int, limit: float | None = None) -> DataFrame:
    """(cell, x, y, bound, kids): the leaves that may hold one of the k nearest points of each cell (cell, x, y)."""
    bound = F.lit(float("inf") if limit is None else float(limit))
    top = F.array(*[F.struct(*[F.lit(node[c]).alias(c) for c in ("id", "n", *BOX)]) for node in tree.top])
    rows = narrowed(dealt(cells.select("cell", "x", "y")).withColumn("bound", bound), F.transform(top, measured), k)
    for level in tree.levels:
        asked = rows.select("cell", "x", "y", "bound", F.explode_outer("kids.id").alias("id"))
        # narrowed by one node's children first, so that few of them are dealt; then by those of all nodes
        below = narrowed(met_by(asked, level), F.transform("kids", measured), k)
        met = dealt(below).groupBy("cell", "x", "y").agg(F.min("bound").alias("bound"), F.flatten(F.collect_list("kids")).alias("kids"))
        rows = narrowed(met, F.col("kids"), k)
    return rows


def nearest_points(cells: DataFrame, tree: Tree, k: int, limit: float | None = None) -> DataFrame:
    """(cell, x, y, near): the k nearest of each cell, nearest first, as array of (distance, number, x, y, z); empty where none is."""

    def seen(p: Column) -> Column:
        dx, dy = F.col("x") - p["x"], F.col("y") - p["y"]
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("distance"), p["number"].cast("long").alias("number"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))

    asked = meetings(cells, tree, k, limit).select("cell", "x", "y", "bound", F.explode_outer("kids.id").alias("id"))
    met = met_by(asked, tree.leaves).select("cell", "x", "y", "bound", F.transform("points", seen).alias("near"))
    some = met.select("cell", "x", "y", F.slice(F.sort_array(F.filter("near", lambda p: p["distance"] <= F.col("bound"))), 1, k).alias("near"))
    every = cells.select("cell", "x", "y", F.array().cast(POINT).alias("near"))
    return dealt(some.unionByName(every)).groupBy("cell", "x", "y").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
