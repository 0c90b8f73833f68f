"""Batched scattering model and optimisers against the row-wise model and known parameters."""

import numpy as np
import pytest

from pelagia.inversion import batched, matrix, scattering
from pelagia.inversion.parameters import InvParameters

BASE = {"length_mean": 0.02, "length_sd_norm": 0.1, "length_radius_ratio": 16.0, "taper_order": 10.0, "radius_of_curvature_ratio": 3.0, "theta_mean": 10.0, "theta_sd": 20.0, "g": 1.03, "h": 1.03, "number_density": 500.0}


def test_model_of_rows_equals_model_of_a_row():
    rng, n = np.random.default_rng(1), 9
    v = {k: np.full(n, x) for k, x in BASE.items()}
    v |= {"length_mean": rng.uniform(0.008, 0.06, n), "g": rng.uniform(1.01, 1.06, n), "theta_mean": rng.uniform(0, 40, n), "radius_of_curvature_ratio": rng.uniform(2, 5, n), "taper_order": np.arange(4.0, 13.0)}
    v["length_sd_norm"][:3] = 0.2
    f, settings = np.array([38e3, 120e3, 200e3]), {"sound_speed_sw": 1500.0, "orientation": {"bins": 7}, "lengths": {"bins": 21, "family": "uniform"}}
    want = [scattering.pcdwba(f, **{k: float(x[i]) for k, x in v.items()}, **settings) for i in range(n)]
    assert np.abs(batched.pcdwba_rows(f, v, **settings) - want).max() < 1e-9


def curve(frequencies, values, **_):
    """A cheap model with two unknowns and a bend."""
    f = np.asarray(frequencies)[None] / 1e5
    return 10 * np.log10(values["number_density"])[:, None] + 30 * np.sin(values["length_mean"][:, None] * 60 * f) - 70


@pytest.mark.parametrize("method", ["least_squares", "differential_evolution"])
def test_optimisers_find_known_parameters(spark, method):
    rng = np.random.default_rng(2)
    truth = np.stack([rng.uniform(0.005, 0.03, 300), rng.uniform(50, 900, 300)], 1)
    f = {38e3: "a", 70e3: "b", 120e3: "c", 200e3: "d"}
    levels = curve(list(f), {"length_mean": truth[:, 0], "number_density": truth[:, 1]})
    rows = [(i, *map(float, x)) for i, x in enumerate(levels)]
    rows[5] = (5, *rows[5][1:4], None)  # another pattern of frequencies
    rows[6] = (6, -999.0, None, -60.0, float("nan"))  # too few of them
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, d double").repartition(4)
    p = InvParameters({"length_mean": {"value": 0.02, "min": 0.002, "max": 0.04}, "number_density": {"value": 300.0, "min": 10.0, "max": 1000.0}})
    options = {"least_squares": {}, "differential_evolution": {"generations": 120, "tolerance": 1e-6}}[method]
    progress = matrix.Progress(spark)
    got = {r["key"]: r for r in matrix.invert(df, f, p, {}, {"monte_carlo": True, "mc_realizations": 40, "mc_seed": 1}, {"method": method} | options, model=curve, keep=["key"], progress=progress).collect()}
    assert progress.rows.value == 300 and progress.failures.value == 1 and progress.evaluations.value > 300 * 10
    for i, (length, density) in enumerate(truth):
        if i == 6:
            assert got[6]["Q"] is None or np.isnan(got[6]["Q"])
            continue
        assert got[i]["length_mean"] == pytest.approx(length, rel=1e-3) and got[i]["number_density"] == pytest.approx(density, rel=1e-2), i


def test_bounds_hold_and_rows_do_not_depend_on_their_batch():
    f = np.array([38e3, 70e3, 120e3])
    target = curve(f, {"length_mean": np.array([0.05, 0.01, 0.02]), "number_density": np.array([500.0, 5000.0, 100.0])})
    low, high = np.array([0.002, 10.0]), np.array([0.04, 1000.0])

    def residuals(x, which):
        return curve(f, {"length_mean": x[:, 0], "number_density": x[:, 1]}) - target[which]

    x, _, _ = batched.differential_evolution(residuals, low, high, 3)
    alone, _, _ = batched.differential_evolution(lambda x, which: residuals(x, which + 2), low, high, 1)
    assert (x >= low).all() and (x <= high).all() and np.allclose(alone[0], x[2])
    y, _, _ = batched.damped_least_squares(residuals, np.tile((low + high) / 2, (3, 1)), low, high)
    assert (y >= low).all() and (y <= high).all()


def test_unknown_optimisers_and_open_bounds_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    p = InvParameters({"length_mean": {"value": 0.02}, "number_density": {"value": 300.0}})
    with pytest.raises(ValueError, match="unknown optimiser"):
        matrix.invert(df, {1.0: "a", 2.0: "b"}, p, {}, {}, {"method": "other"})
    with pytest.raises(ValueError, match="finite bounds"):
        matrix.optimize_rows(np.zeros((1, 2)), np.array([1.0, 2.0]), p, curve, {}, {}, {"method": "least_squares"})


def test_equal_measurements_are_fitted_once(spark):
    f = {38e3: "a", 70e3: "b", 120e3: "c", 200e3: "d"}
    levels = curve(list(f), {"length_mean": np.array([0.01, 0.02, 0.03]), "number_density": np.array([80.0, 400.0, 700.0])})
    rows = [(i, *map(float, levels[i % 3])) for i in range(300)] + [(300, None, None, None, None), (301, float("nan"), -999.0, None, None)]
    p = InvParameters({"length_mean": {"value": 0.02, "min": 0.002, "max": 0.04}, "number_density": {"value": 300.0, "min": 10.0, "max": 1000.0}})
    progress = matrix.Progress(spark)
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, d double").repartition(4)
    got = {r["key"]: r for r in matrix.invert(df, f, p, {}, {"monte_carlo": True, "mc_realizations": 40, "mc_seed": 1}, {"method": "least_squares"}, model=curve, keep=["key"], progress=progress).collect()}
    assert len(got) == progress.rows.value == 302 and progress.failures.value == 2 and 0 < progress.evaluations.value < 3 * 200
    for i in range(300):
        assert got[i]["Q"] == got[i % 3]["Q"] and got[i]["length_mean"] == got[i % 3]["length_mean"] == pytest.approx((0.01, 0.02, 0.03)[i % 3], rel=1e-3)


def test_animals_that_differ_in_density_alone_are_modelled_once(monkeypatch):
    seen = []
    real = batched.bessel_j
    monkeypatch.setattr(batched, "bessel_j", lambda n, x: (seen.append(x.size), real(n, x))[1])
    settings = {"sound_speed_sw": 1500.0, "orientation": {"bins": 7}, "lengths": {"bins": 21}}
    one = batched.pcdwba_rows(np.array([120e3]), {k: np.array([x]) for k, x in BASE.items()}, **settings)
    size = sum(seen)
    many = batched.pcdwba_rows(np.array([120e3]), {k: np.full(50, x) for k, x in BASE.items()} | {"number_density": np.arange(1.0, 51.0)}, **settings)
    assert sum(seen) == 2 * size and np.allclose(many[:, 0], one[0, 0] + 10 * np.log10(np.arange(1.0, 51.0) / 500))
