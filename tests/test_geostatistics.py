"""Variograms, kriging, cropping and regions against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.geostatistics import cropping, kriging, models, projection, regions, tree, variogram
from pelagia.plans.geo_queries import BASE
from pelagia.plans.registry import QUERIES

MODEL = {"model": ["bessel", "exponential"], "sill": 0.9, "nugget": 0.1, "correlation_range": 2.5, "decay_power": 1.3, "hole_effect_range": 0.2}


@pytest.fixture(scope="module")
def survey():
    rng = np.random.default_rng(5)
    data = [(k, float(x), float(y), float(z)) for k, (x, y, z) in enumerate(zip(rng.uniform(0, 30, 150), rng.uniform(0, 20, 150), rng.gamma(2, 50, 150)))]
    mesh = [(k, float(x), float(y), 2.0) for k, (x, y) in enumerate(zip(rng.uniform(-25, 45, 60), rng.uniform(-5, 25, 60)))]
    return data, mesh


@pytest.fixture(scope="module")
def frames(spark, survey):
    data, mesh = survey
    return spark.createDataFrame(data + [(999, None, 1.0, 5.0), (998, 1.0, 1.0, None)], "id long, x double, y double, z double").repartition(3), spark.createDataFrame(mesh, "cell long, x double, y double, area double")


@pytest.mark.parametrize("name", [*models.SINGLE, *models.COMPOSITE])
def test_columns_equal_arrays(spark, name):
    h = [0.0, 0.05, 0.3, 1.0, 1.7, 2.0, 9.0, 40.0]
    given = BASE | {"correlation_range": 1.7}
    want = models.gamma_array(np.array(h), given, name)
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(h)], "k int, h double")
    got = [r["g"] for r in rows.select("k", models.gamma_column(F.col("h"), given, name).alias("g")).orderBy("k").collect()]
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-7, abs=1e-9)


def test_model_lookup():
    assert models.lookup(["Exponential", "BESSEL"]) is models.bessel_exponential
    assert models.arguments("spherical") == ["sill", "nugget", "correlation_range"]
    with pytest.raises(LookupError):
        models.lookup("unknown")
    with pytest.raises(ValueError, match="correlation_range"):
        models.gamma_array(np.zeros(1), {"sill": 1.0, "nugget": 0.0}, "exponential")


@pytest.mark.parametrize("mode", ["compat", "symmetric"])
@pytest.mark.parametrize("angle", [None, 60.0])
def test_empirical_variogram(frames, survey, mode, angle):
    """Both pair rules with full matrices."""
    data = np.array([r[1:] for r in survey[0]])
    n, lags = len(data), 8
    dx, dy = (np.subtract.outer(data[:, k], data[:, k]) for k in (0, 1))
    lag = np.rint(np.hypot(dx, dy) / 1.5).astype(int) + 1
    i, j = np.indices((n, n))
    pairs = i + j <= n - 2 if mode == "compat" else i != j
    with np.errstate(divide="ignore", invalid="ignore"):
        az = np.nan_to_num(np.degrees(np.arctan(dy / dx)), nan=0.0)
    inside = np.ones((n, n), bool) if angle is None else (az >= -angle) & (az < angle)
    rows = variogram.empirical_variogram(frames[0], lags, 1.5, "z", order="id", angle=angle, mode=mode).collect()
    got = {r["lag"]: r for r in rows}
    assert set(got) == set(range(lags)) and got[0]["gamma"] == 0 and got[0]["count"] == n - 1
    z = data[:, 2]
    for k in range(1, lags):
        every, kept = pairs & (lag == k), pairs & (lag == k) & inside
        count = kept.sum()
        assert got[k]["count"] == count
        if not count:
            continue
        share = every.sum(1) / count
        mean = (z * share).sum()
        head = math.sqrt(((z - mean) ** 2 * share).sum())
        tail = math.sqrt(abs((z[j[kept]] ** 2).mean() - z[j[kept]].mean() ** 2))
        gamma = 0.5 * ((z[i[kept]] - z[j[kept]]) ** 2).sum() / (count * head * tail) if head * tail > 0 else 0.0
        assert got[k]["gamma"] == pytest.approx(gamma, rel=1e-9), k


def test_fit_recovers_parameters():
    lags = np.arange(30) * 0.1
    truth = {"nugget": 0.1, "sill": 0.95, "correlation_range": 0.8, "decay_power": 1.5, "hole_effect_range": 0.7}
    gamma = models.gamma_array(lags, truth, ["bessel", "exponential"])
    p = variogram.Parameter
    start = {"nugget": p(0.0, 0.0), "sill": p(1.3, 0.0), "correlation_range": p(0.4, 0.01), "decay_power": p(1.0, 0.1, 2.0), "hole_effect_range": p(0.4, 0.0)}
    best, before, after = variogram.fit_variogram(lags, np.full(30, 10), gamma, start)
    assert after < 1e-6 < before
    assert all(best[k] == pytest.approx(v, rel=1e-2) for k, v in truth.items())
    held = start | {"decay_power": p(1.5, 0.1, 2.0, vary=False), "sill": p(0.5, 0.0, 0.6)}
    best, *_ = variogram.fit_variogram(lags, np.full(30, 10), gamma, held)
    assert best["decay_power"] == 1.5 and best["sill"] <= 0.6


def brute(data, mesh, k_min, k_max, radius, aspect, mode, weight=None):
    """Kriging cell by cell, with whole distance rows."""
    out = {}
    for cell, x, y, _ in mesh:
        d = np.hypot(data[:, 0] - x, data[:, 1] - y)
        order = np.argsort(d, kind="stable")
        sparse = (d <= radius).sum() < k_min
        near = order[: k_min if sparse else k_max]
        r, w, ids = d[near], 1.0, near
        if sparse:
            w = (weight or kriging.uniform_search)({"x": x, "y": y}, r, k_min, radius)
        right = np.append(models.gamma_array(r, MODEL), 1.0)
        if mode == "compat":
            right = np.sort(right)
            if sparse and (r < radius).any():
                ids = np.concatenate([np.sort(near[r < radius]), np.sort(near[r >= radius])])
        p = data[ids].copy()
        p[r > radius, 2] = 0.0
        m = np.ones((len(ids) + 1,) * 2)
        m[:-1, :-1] = models.gamma_array(np.hypot(np.subtract.outer(p[:, 0], p[:, 0]), np.subtract.outer(p[:, 1], p[:, 1])), MODEL)
        np.fill_diagonal(m, 0.0)
        u, s, vt = np.linalg.svd(m)
        keep = s / s[0] > aspect
        lam = vt.T[:, keep] @ np.diag(1 / s[keep]) @ u[:, keep].T @ right
        out[cell] = ((lam[:-1] * p[:, 2]).sum() * w, lam @ right)
    return out


@pytest.mark.parametrize("mode", ["canonical", "compat"])
def test_kriging(frames, survey, mode):
    data = np.array([r[1:] for r in survey[0]])
    k = kriging.Kriging(frames[1], {"k_min": 4, "k_max": 9, "search_radius": 3.0, "aspect_ratio": 1e-3}, MODEL, mode=mode)
    got = {r["cell"]: r for r in k.krige(frames[0], "z", "id").collect()}
    want = brute(data, survey[1], 4, 9, 3.0, 1e-3, mode)
    assert set(got) == set(want)
    for c, (estimate, variance) in want.items():
        assert got[c]["z"] == pytest.approx(max(estimate, 0.0), rel=1e-7, abs=1e-9), c
        assert got[c]["kriged_variance"] == pytest.approx(variance, rel=1e-7, abs=1e-9)
    total = sum(2.0 * e for e, _ in want.values())
    cv = math.sqrt(sum(v * 4 for _, v in want.values()) * data[:, 2].var(ddof=1)) / total
    assert k.survey_cv == pytest.approx(cv, rel=1e-7)


def test_western_boundary(frames, survey):
    data = np.array([r[1:] for r in survey[0]])
    strategy = kriging.western_boundary_search(np.array([[0.0, 5.0], [2.0, 15.0]]))
    k = kriging.Kriging(frames[1], {"k_min": 4, "k_max": 9, "search_radius": 3.0, "aspect_ratio": 1e-3}, MODEL)
    with pytest.raises(ValueError):
        k.register_search_strategy("uniform", strategy)
    k.register_search_strategy("western", strategy)
    assert k.list_search_strategies() == ["uniform", "western"]
    got = {r["cell"]: r["z"] for r in k.krige(frames[0], "z", "id", adaptive_search_strategy="western").collect()}
    want = brute(data, survey[1], 4, 9, 3.0, 1e-3, "canonical", strategy)
    assert all(got[c] == pytest.approx(max(e, 0.0), rel=1e-7, abs=1e-9) for c, (e, _) in want.items())


def test_kriging_refuses(frames):
    p = {"k_min": 4, "k_max": 9, "search_radius": 3.0, "aspect_ratio": 1e-3}
    for bad in ({"k_min": 10}, {"search_radius": 0.0}, {"aspect_ratio": 2.0}):
        with pytest.raises(ValueError):
            kriging.Kriging(frames[1], p | bad, MODEL)
    k = kriging.Kriging(frames[1], p, MODEL)
    with pytest.raises(AttributeError):
        k.krige(frames[0], "z", "id", extrapolate=False)
    with pytest.raises(KeyError):
        k.krige(frames[0], "none", "id")
    with pytest.raises(ValueError):
        k.krige(frames[0], "z", "id", adaptive_search_strategy="other")


def test_no_data_gives_no_estimate(spark, frames):
    none = frames[0].where("false")
    near = kriging.nearest(frames[1], none, "cell", "id", "z", 5, 3.0)
    out = kriging.estimates(near, MODEL, 2, 5, 3.0, 1e-3)
    assert out.where("estimate IS NOT NULL").count() == 0 and out.count() == 60


def test_hull():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(200, 2))
    c = cropping.hull(p)
    cross = lambda a, b, q: (b[0] - a[0]) * (q[:, 1] - a[1]) - (b[1] - a[1]) * (q[:, 0] - a[0])
    assert all((cross(a, b, p) >= -1e-12).all() for a, b in zip(c, np.roll(c, -1, 0)))
    assert cropping.hull(np.array([[1.0, 1.0], [1.0, 1.0]])).tolist() == [[1.0, 1.0]]


def test_hull_crop_projects_each_place_once(spark, monkeypatch):
    """Rows at the same place all stay or all go, and cost no projection of their own; null places go."""
    rows, real = [], cropping.with_utm
    monkeypatch.setattr(cropping, "with_utm", lambda df, *a, **k: (rows.append(df.count()), real(df, *a, **k))[1])
    places = [(t, -125 + 0.3 * k, 40 + 0.5 * t) for t in range(3) for k in range(4)]
    tf = spark.createDataFrame(places * 20, "transect_num int, longitude double, latitude double").repartition(3)
    mesh = [(k, -124.5 if k % 2 else -121.0, 40.2) for k in range(200)] + [(200, None, 40.2)]
    mf = spark.createDataFrame(mesh, "cell int, longitude double, latitude double")
    got = sorted(r["cell"] for r in cropping.hull_crop(tf, mf, 1, 5.0).collect())
    assert got == list(range(1, 200, 2)) and sorted(rows) == [3, 12]


def test_hull_crop(spark):
    """Against distances to every hull, one point after another."""
    rng = random.Random(2)
    transects = [(t, -125 + 0.4 * k + rng.uniform(-0.05, 0.05), 40 + 0.5 * t + rng.uniform(-0.02, 0.02)) for t in range(8) for k in range(6)]
    mesh = [(k, rng.uniform(-127, -121), rng.uniform(38, 46)) for k in range(300)]
    tf, mf = spark.createDataFrame(transects, "transect_num int, longitude double, latitude double").repartition(3), spark.createDataFrame(mesh, "cell int, longitude double, latitude double")
    got = {r["cell"] for r in cropping.hull_crop(tf, mf, 2, 10.0).collect()}
    zone = projection.survey_zone(tf)
    pts = {}
    for r in projection.with_utm(tf, *zone).collect():
        pts.setdefault(r["transect_num"], []).append((r["x"], r["y"]))
    mid = {t: np.mean(sorted(set(p)), 0) for t, p in pts.items()}
    polygons = []
    for t in pts:
        others = sorted((math.dist(mid[t], mid[o]), o) for o in pts if o != t)[:2]
        polygons.append(cropping.hull(np.array([q for o in [t, *(o for _, o in others)] for q in pts[o]])))
    want = set()
    for r in projection.with_utm(mf, *projection.survey_zone(mf)).collect():
        q = np.array([r["x"], r["y"]])
        for c in polygons:
            edges = list(zip(c, np.roll(c, -1, 0)))
            inside = all((b[0] - a[0]) * (q[1] - a[1]) >= (b[1] - a[1]) * (q[0] - a[0]) for a, b in edges)
            gap = min(np.linalg.norm(q - a - np.clip((q - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1) * (b - a)) for a, b in edges)
            if inside or gap <= 18520.0:
                want.add(r["cell"])
    assert 0 < len(want) < 300 and got == want


def test_transect_ends_and_crop(spark):
    rows = [(t, 1, float(x), float(t)) for t in range(1, 6) for x in range(-128, -124)] + [(t, 2, -131.0 - t / 10, float(y)) for t in (7, 8) for y in (53, 54)] + [(t, 3, float(x), 52.0 + t / 10) for t in (10, 11) for x in (-134, -133)]
    transects = spark.createDataFrame([(float(t), x, y) for t, _, x, y in rows], "transect_num double, longitude double, latitude double")
    table = spark.createDataFrame([(float(t), r, t + (0.9 if r == 2 else 0.4), t + (0.6 if r == 2 else 0.1)) for t, r in sorted({(t, r) for t, r, _, _ in rows})], "transect_num double, mesh_region int, transect_lower_bound double, transect_upper_bound double")
    ends = {r["transect_num"]: (r["e"], r["n"]) for r in cropping.transect_end(transects.join(table, "transect_num"), "transect_lower_bound", ("e", "n")).collect()}
    assert ends[1.0] == (-125.0, 1.0) and ends[7.0][1] == 54.0 and ends[10.0] == (-133.0, 53.0)
    mesh = spark.createDataFrame([(1, -126.5, 3.0), (2, -140.0, 3.0), (3, -131.75, 53.5), (4, -133.5, 53.05), (5, -126.0, 30.0)], "cell int, longitude double, latitude double")
    kept, joined = cropping.transect_ends_crop(transects, mesh, 0.5, table)
    assert {r["cell"] for r in kept.collect()} == {1, 3, 4} and joined.count() == len(rows)


@pytest.mark.parametrize("year", sorted(regions.REGIONS))
def test_regions(spark, year):
    for region in (1, 2, 3):
        _, _, low, up = regions.mesh_region(year, region)
        assert low and up and all(round(v % 1 * 10) in (1, 4, 6, 9) for v in low + up)
    assert regions.mesh_regions(spark, year).count() > 0


def test_region_specs():
    assert regions.bounds("1-3.1 10-6/2.4 92.6") == pytest.approx([1.1, 2.1, 3.1, 10.4, 8.4, 6.4, 92.6])
    assert regions.mesh_region(1995, 1)[2][:4] == pytest.approx([1.1, 2.1, 4.1, 5.1])
    with pytest.raises(LookupError):
        regions.mesh_region(1900, 1)


def test_utm_known_point(spark):
    rows = spark.createDataFrame([(-123.0, 49.0), (3.0, -33.0)], "longitude double, latitude double")
    got = rows.select(projection.utm_code(F.col("longitude"), F.col("latitude")).alias("c"), *[c.alias(n) for c, n in zip(projection.utm(F.col("longitude"), F.col("latitude"), projection.utm_zone(F.col("longitude")), F.col("latitude") < 0), "xy")]).collect()
    assert [r["c"] for r in got] == ["32610", "32731"]
    assert got[0]["x"] == pytest.approx(500000.0, abs=1e-6)  # on the central meridian
    e2 = 0.0066943799901413165
    lat = np.radians(np.linspace(0, 49, 200_001))
    arc = np.trapezoid(6378137.0 * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5, lat)
    assert got[0]["y"] == pytest.approx(0.9996 * arc, abs=1e-3)


@pytest.mark.parametrize("part", [3, 2000])
def test_compat_pairs_of_shared_places(spark, part):
    """Many rows at few places: running sums, in one chunk a place and in several, against all pairs."""
    rng = np.random.default_rng(8)
    n = 400
    x, y, z = rng.integers(0, 6, n).astype(float), rng.integers(0, 4, n).astype(float), rng.gamma(2, 50, n)
    ranked = spark.createDataFrame([(a, b, c, k) for k, (a, b, c) in enumerate(zip(x.tolist(), y.tolist(), z.tolist()))], "x double, y double, z double, r long")
    rows = variogram.compat_pairs(ranked, n, 5, 1.0, variogram.azimuth(F.col("dx"), F.col("dy")) >= 0, part)
    got = {(r["lag"], r["ok"]): r for r in rows.groupBy("lag", "ok").agg(*[F.sum(c).alias(c) for c in variogram.SUMS]).collect()}
    dx, dy = (np.subtract.outer(v, v) for v in (x, y))
    i, j = np.indices((n, n))
    with np.errstate(divide="ignore", invalid="ignore"):
        ok = np.nan_to_num(np.degrees(np.arctan(dy / dx)), nan=0.0) >= 0
    lag = np.rint(np.hypot(dx, dy)).astype(int) + 1
    for key, r in got.items():
        m = (i + j <= n - 2) & (lag == key[0]) & (ok == key[1])
        a, b = z[i[m]], z[j[m]]
        assert [r[c] for c in variogram.SUMS] == pytest.approx([m.sum(), a.sum(), (a * a).sum(), b.sum(), (b * b).sum(), ((a - b) ** 2).sum()], rel=1e-9)
    assert sum(r["w"] for r in got.values()) == ((i + j <= n - 2) & (lag < 5)).sum()


@pytest.mark.parametrize("name", ["empirical_variogram", "empirical_variogram_compat", "empirical_variogram_azimuth"])
def test_variogram_queries_pair_the_whole_lattice(spark, name):
    """The queries' counts are those of all near pairs on the lattice of 50 by 37 places."""
    d = "/root/testdata/sf0.001"
    p = spark.read.parquet(f"{d}/part.parquet").orderBy("p_partkey").toPandas()
    x, y, n = p["p_size"].to_numpy(float), (p["p_partkey"] % 37).to_numpy(float), len(p)
    dx, dy = (np.subtract.outer(v, v) for v in (x, y))
    i, j = np.indices((n, n))
    pairs = i != j if name == "empirical_variogram" else i + j <= n - 2
    if name.endswith("azimuth"):
        with np.errstate(divide="ignore", invalid="ignore"):
            az = np.where(dx == 0, 90 * np.sign(dy), np.degrees(np.arctan(dy / dx)))
        pairs &= (az >= -40) & (az < 40)
    lag = np.rint(np.hypot(dx, dy)).astype(int) + 1
    got = {r["lag"]: r["count"] for r in QUERIES[name](spark, d).collect() if r["lag"]}
    assert got == {k: int((pairs & (lag == k)).sum()) for k in range(1, 5)}


def test_leaves_of_a_strip_are_compact(spark):
    """A strip of 50 columns, 37 points a unit of its length: leaves are about as wide as tall, either way round."""
    rng = np.random.default_rng(3)
    n = 20_000
    rows = [(float(a), k / 37, 0.0, k) for k, a in enumerate(rng.integers(1, 51, n).tolist())]
    for names in ("x double, y double, z double, number long", "y double, x double, z double, number long"):
        strip = spark.createDataFrame(rows, names).select("x", "y", "z", "number")
        boxed = tree.packed(strip, n, 32, "number").groupBy("id").agg(F.count("*").alias("n"), *tree.boxes())
        s = boxed.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.avg(F.col("x1") - F.col("x0")).alias("w"), F.avg(F.col("y1") - F.col("y0")).alias("h")).first()
        assert s["n"] == n and s["most"] == 32 and s["w"] < 15 and s["h"] < 15, names
