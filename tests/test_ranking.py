"""Exact selection, global places and neighbour search on tied, dense and far rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.functions.ranking import exact_median, global_rank, select_rank
from pelagia.geostatistics import tree, variogram


def test_selection_among_ties(spark):
    tied = spark.range(400_000).select(F.when(F.col("id") % 1000 == 0, F.col("id") * 1.0).otherwise(0.5).alias("x"))
    assert exact_median(tied, "x") == 0.5
    assert exact_median(tied.select(F.lit(2.0).alias("x")), "x") == 2.0  # one value in all rows
    assert [select_rank(tied, "x", k) for k in (0, 1, 399_600, 399_601, 399_999, 400_000)] == [0.0, 0.5, 0.5, 1000.0, 399_000.0, None]


def test_selection_uses_no_window_and_no_sort(spark):
    """All that is dealt are sums of one row a task."""
    tied = spark.range(1000).select(F.lit(0.5).alias("x"))
    plan = tied.agg(F.sum((F.col("x") < 1).cast("long")))._jdf.queryExecution().toString()
    assert "Window" not in plan and "Sort" not in plan and exact_median(tied, "x") == 0.5


@pytest.mark.parametrize("n", [1, 2, 3, 10, 5001])
def test_selection_brute_force(spark, n):
    values = np.concatenate([np.random.default_rng(n).normal(size=n), [1e300, -1e300, 0.0]])[:n]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    assert exact_median(df, "x") == np.median(values)
    assert [select_rank(df, "x", k) for k in {0, n // 3, n - 1}] == [np.sort(values)[k] for k in {0, n // 3, n - 1}]


def test_places_of_tied_rows_are_spread(spark):
    df = spark.range(20_000).select(F.lit(0.5).alias("v"), F.col("id").alias("k")).repartition(6)
    got = global_rank(df, "v", "r", "k", buckets=8)
    assert [r["k"] for r in got.orderBy("r").collect()] == list(range(20_000))
    same = global_rank(df.select("v"), "v", "r", buckets=8)  # nothing tells them apart
    assert sorted(r["r"] for r in same.collect()) == list(range(20_000))
    sizes = [r["count"] for r in same.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 10_000


def scattered():
    """A dense heap, a wide scatter, one place many times, a lattice full of equal distances."""
    rng = np.random.default_rng(1)
    return np.concatenate([rng.normal(0, 0.01, (3000, 2)), rng.uniform(-50, 50, (300, 2)), np.repeat([[3.0, 4.0]], 200, 0), rng.integers(-5, 5, (300, 2)).astype(float)])


@pytest.mark.parametrize("leaf, fanout, k, limit", [(32, 32, 5, None), (4, 4, 12, None), (8, 8, 20, 2.0)])
def test_neighbours_brute_force(spark, leaf, fanout, k, limit):
    points = scattered()
    cells = np.concatenate([np.random.default_rng(2).uniform(-60, 60, (100, 2)), points[:30] + 0.001, [[3.0, 4.0], [1e4, 2e3], [-1e5, 0.0]]])
    data = spark.createDataFrame([(i, float(a), float(b), 0.0) for i, (a, b) in enumerate(points)], "number long, x double, y double, z double")
    mesh = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(cells)], "cell long, x double, y double")
    made = tree.build(data, k, leaf, fanout)
    got = {r["cell"]: [p["number"] for p in r["near"]] for r in tree.nearest_points(mesh, made, k, limit).collect()}
    for i, (a, b) in enumerate(cells):
        d = np.sqrt((a - points[:, 0]) ** 2 + (b - points[:, 1]) ** 2)
        want = [int(j) for j in np.lexsort((np.arange(len(d)), d))[:k] if limit is None or d[j] <= limit]
        assert got.get(i, []) == want, i
    # however dense or far: some times k leaves of max(leaf, k) points, where all points are 3,800
    met = tree.meetings(mesh, made, k, limit).agg(F.max(F.size("kids"))).first()[0]
    assert met <= 8 + k


def test_neighbours_of_a_heap_are_few_pairs(spark):
    """3,000 points in half a tile and 200 cells far away: pairs grow with k, not with the points."""
    cells = spark.range(200).select(F.col("id").alias("cell"), (F.col("id") + 1000.0).alias("x"), F.col("id").cast("double").alias("y"))
    pairs = []
    for n in (3000, 30_000):
        heap = spark.range(n).select(F.col("id").alias("number"), (F.rand(1) / 2).alias("x"), (F.rand(2) / 2).alias("y"), F.lit(1.0).alias("z"))
        made = tree.build(heap.checkpoint(), 10)
        leaves = tree.meetings(cells, made, 10).agg(F.sum(F.size("kids"))).first()[0]
        pairs.append(leaves * 32 / 200)
    assert max(pairs) <= 32 * 18 and pairs[1] < 2 * pairs[0] + 32


def test_dense_tiles_are_cut(spark):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.uniform(0, 0.5, (400, 2)), rng.uniform(-6, 6, (100, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    for part in (50, 1000):
        pairs = variogram.near_pairs(df, df, 1.5, "x", "y", part).where("distance <= 1.5")
        assert pairs.count() == pairs.select("a.id", F.col("b.id").alias("other")).distinct().count() == (d <= 1.5).sum()
