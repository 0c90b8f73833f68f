"""Survey operators against known values and closed forms."""

import math

import pytest
from pyspark.sql import functions as F

from pelagia.functions.special import bessel_j, bessel_k, normal_ppf, t_ppf
from pelagia.operators import uncertainty


def test_special_functions():
    assert bessel_j(0, [1.0])[0] == pytest.approx(0.7651976865579666, abs=1e-12)
    assert bessel_j(1, [2.5])[0] == pytest.approx(0.4970941024642741, abs=1e-12)
    assert bessel_k(0.5, [2.0])[0] == pytest.approx(math.sqrt(math.pi / 4) * math.exp(-2), rel=1e-9)
    assert t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert normal_ppf(0.5) == 0


def test_geodesic_known_distances(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0), (1, 0.0, 0.0, 0.0, 1.0), (2, -125.0, 48.0, -125.0, 48.0), (3, -125.0, 48.0, -124.0, 48.0), (4, None, 0.0, 1.0, 0.0)], "k int, a double, b double, c double, d double")
    got = {r["k"]: r["m"] for r in rows.select("k", uncertainty.geodesic_nmi(*map(F.col, "abcd")).alias("m")).collect()}
    assert got[0] * 1852 == pytest.approx(111319.4908, abs=0.01)  # a degree of the equator
    assert got[1] * 1852 == pytest.approx(110574.3886, abs=0.01)  # a degree of the meridian
    assert got[2] == 0
    lat = math.radians(48)
    n = 6378137.0 / math.sqrt(1 - 0.0066943799901413165 * math.sin(lat) ** 2)
    assert got[3] * 1852 == pytest.approx(n * math.cos(lat) * math.radians(1), rel=1e-4)
    assert got[4] is None


@pytest.mark.parametrize("method", uncertainty.CI_METHODS)
def test_intervals_hold_their_mean(spark, method):
    values = [100 + 10 * normal_ppf((k + 0.5) / 40) for k in range(40)]
    rows = spark.createDataFrame([("m", float(v)) for v in values], "name string, x double")
    (r,) = uncertainty.confidence_interval(rows, "name", "x", {"m": 100.0}, method).collect()
    assert r["low"] < r["mean"] < r["high"] or method == "empirical"
    assert r["mean"] == pytest.approx(100, abs=1e-9) and r["bias"] == pytest.approx(0, abs=1e-9)


def test_interval_rejects_unknown_method(spark):
    with pytest.raises(ValueError):
        uncertainty.confidence_interval(spark.createDataFrame([("m", 1.0)], "name string, x double"), "name", "x", {"m": 1.0}, "other")


def test_bootstrap_samples_without_replacement(spark):
    t = spark.createDataFrame([(s, k, float(k), 1.0, 2.0) for s in "ab" for k in range(8)], "stratum string, transect_num int, v double, distance double, area double")
    s = uncertainty.strata_statistics(t, "stratum", "v", 0.75)
    rows = uncertainty.bootstrap(t, s, "stratum", 5, 3).collect()
    assert len(rows) == 5 * 2 * 6 and len({(r["replicate"], r["stratum"], r["transect_num"]) for r in rows}) == 60
    again = uncertainty.bootstrap(t.repartition(7), s, "stratum", 5, 3).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}


def test_curve_by_halving_and_summed_counts(spark):
    """Interpolation at, between and beyond points of short and long curves; sums after combining equal lengths are the rows' sums."""
    import numpy as np
    from pyspark.sql import functions as F

    from pelagia.operators import biology

    for n in (2, 3, 7, 64, 65):
        x = np.cumsum(np.random.default_rng(n).integers(1, 4, n)).astype(float)
        y = np.random.default_rng(n + 1).gamma(2, 3, n)
        points = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)], "sex string, length double, weight double")
        at = [float(v) for v in np.arange(x[0] - 1, x[-1] + 1.25, 0.25)]
        rows = spark.createDataFrame([("s" if k % 3 else "t", "a", v, 1 + k % 2) for k, v in enumerate(at * 2)], "stratum string, sex string, length double, length_count long")
        curves = biology.interpolators(points, ["sex"], "length", "weight")
        each = biology.interpolated_weight(rows, curves, ["sex"])
        assert [r["w"] for r in each.distinct().orderBy("length", "length_count").select("length", (F.col("weight") / F.col("length_count")).alias("w")).distinct().orderBy("length").collect()] == pytest.approx(np.interp(at, x, y).tolist())
        few = biology.combined(rows, ["stratum", "sex"])
        sums = [{r["stratum"]: r["weight"] for r in biology.stratum_weights(df, "stratum").collect()} for df in (each, biology.interpolated_weight(few, curves, ["sex"]))]
        assert few.count() < rows.count() and sums[0] == pytest.approx(sums[1])
