"""Published results of the estimators on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import apportion, cleaning, uncertainty

#: Proportions by stratum 1-3, contrast and length bin of an aged and an unaged group (fixed values of the published case).
AGED = [0.10, 0.20, 0.10, 0.10, 0.10, 0.00, 0.00, 0.00, 0.10, 0.20, 0.00, 0.00, 0.00, 0.20, 0.10, 0.10, 0.30, 0.20]
UNAGED = [0.10, 0.20, 0.20, 0.00, 0.00, 0.20, 0.10, 0.00, 0.10, 0.30, 0.00, 0.00, 0.00, 0.00, 0.00, 0.00, 0.00, 0.00]


@pytest.fixture(scope="module")
def shares(spark):
    rows = []
    for source, values in (("aged", AGED), ("unaged", UNAGED)):
        for k, p in enumerate(values):
            rows.append((source, k % 3 + 1, "A" if k < 9 else "B", [5, 10, 15][k // 3 % 3], p))
    return spark.createDataFrame(rows, "source string, stratum int, sex string, length_bin int, proportion double")


@pytest.fixture(scope="module")
def mesh(spark):
    return spark.createDataFrame([(1, 1e7), (2, 4e7), (3, 9e7)], "stratum int, biomass double")


def test_mesh_biomass_by_sex_abundance_and_nasc(spark, mesh, shares):
    weights = spark.createDataFrame([(k, s, float(k)) for k in (1, 2, 3) for s in ("all", "A", "B")], "stratum int, sex string, average_weight double")
    sigma = spark.createDataFrame([(1, 1e-3), (2, 1e-4), (3, 1e-5)], "stratum int, sigma_bs double")
    got = {(r["stratum"], r["sex"]): r for r in apportion.mesh_to_nasc(mesh, shares, weights, sigma, "stratum").collect()}
    of = lambda s, c: [got[k, s][c] for k in (1, 2, 3)]
    assert of("A", "biomass") == pytest.approx([4e6, 2e7, 6.3e7]) and of("B", "biomass") == pytest.approx([6e6, 2e7, 2.7e7])
    assert of("all", "abundance") == pytest.approx([1e7, 2e7, 3e7])
    assert of("A", "abundance") == pytest.approx([4e6, 1e7, 2.1e7]) and of("B", "abundance") == pytest.approx([6e6, 1e7, 9e6])
    assert of("all", "nasc") == pytest.approx([125663.7061, 25132.7412, 3769.9112], abs=1e-4)


def test_distributed_totals(mesh, shares):
    out = apportion.distribute(mesh.withColumnRenamed("biomass", "value"), shares, "stratum", ["sex", "length_bin"], "value", "source")
    got = {(r["source"], r["stratum"]): r["v"] for r in out.groupBy("source", "stratum").agg(F.sum("value").alias("v")).collect()}
    assert [got["aged", k] for k in (1, 2, 3)] == pytest.approx([5e6, 3.2e7, 4.5e7])
    assert [got["unaged", k] for k in (1, 2, 3)] == pytest.approx([5e6, 8e6, 4.5e7])


def interval(spark, samples, method, population=None):
    rows = spark.createDataFrame([("x", float(v)) for v in samples], "name string, x double").repartition(3)
    r = uncertainty.confidence_interval(rows, "name", "x", {"x": float(np.mean(samples)) if population is None else population}, method).first()
    return [r["low"], r["high"]]


#: Intervals of 1,000 samples about a population value of 95 (fixed values of the published cases).
PUBLISHED = {
    "percentile": [79.6233578, 120.4478217],
    "normal": [79.55786428, 120.06676714],
    "empirical": [84.43567348, 125.26013739],
    "t": [79.53329522, 120.0913362],
    "t-jackknife": [79.57453103, 120.49950457],
    "bc": [67.86816843, 109.43886671],
    "bca": [68.32433457, 109.85050844],
}


@pytest.mark.parametrize("method", PUBLISHED)
def test_published_intervals(spark, method):
    samples = np.random.RandomState(999).normal(100, 10, 1000)
    assert interval(spark, samples, method, 95.0) == pytest.approx(PUBLISHED[method], abs=1e-5)


@pytest.mark.parametrize("method", ["bc", "bca"])
def test_skewed_samples_are_refused(spark, method):
    with pytest.raises(ValueError, match="skewed"):
        interval(spark, [100.0] * 50, method, 95.0)


def test_jackknife_of_ten(spark):
    samples = np.random.RandomState(500).normal(100, 10, 10)
    assert interval(spark, samples, "t-jackknife") == pytest.approx([76.98222532, 124.62199098], abs=1e-7)


def test_percentiles_of_many(spark):
    samples = np.random.RandomState(666).normal(100, 10, 10000)
    assert interval(spark, samples, "percentile") == pytest.approx([80.20937026, 119.3864021], abs=1e-7)


def distances(spark, starts, ends):
    df = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(zip(starts, ends))], "transect_num int, interval int, distance_s double, distance_e double")
    return [r["distance_interval"] for r in cleaning.interval_distance(df).orderBy("interval").collect()]


def test_interval_distances(spark):
    assert distances(spark, [0.0, 1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0, 5.0]) == [1.0] * 5
    assert distances(spark, [0.0], [1.5]) == [1.5]
    assert distances(spark, [0.0, 1.0, 2.0, 5.0, 6.0], [1.0, 2.0, 3.0, 6.0, 7.0]) == [1.0] * 5
