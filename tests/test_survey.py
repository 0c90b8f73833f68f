"""Estimates by hand, workbooks, reports, inversion and checks of parameters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia import validation
from pelagia.functions.ranking import exact_median, global_rank
from pelagia.inversion import matrix, scattering
from pelagia.inversion.length_ts import InversionLengthTS
from pelagia.inversion.parameters import InvParameters
from pelagia.operators import biology, uncertainty
from pelagia.operators.stratified import JollyHampton
from pelagia.reports import compare, presentation, tables
from pelagia.reports.reporter import Reporter, aggregates, headers
from pelagia.sources import surveys
from pelagia.sources.xlsx import parse_sheet, read_xlsx, sheet_names, workbook, write_xlsx

TRANSECTS = [("a", 1, 10.0, 2.0, 4.0), ("a", 2, 30.0, 3.0, 6.0), ("b", 1, 8.0, 4.0, 5.0)]


def test_jolly_hampton_by_hand(spark):
    t = spark.createDataFrame(TRANSECTS, "stratum string, transect_num int, v double, distance double, area double")
    got = {r["stratum"]: r for r in uncertainty.jolly_hampton(t, [], "stratum", "v").collect()}
    # (10 * 2 + 30 * 3) / 5 = 22; weights 0.8 and 1.2; values per distance 5 and 10
    assert got["a"]["mean"] == pytest.approx(22.0)
    assert got["a"]["variance"] == pytest.approx((0.8**2 * 17**2 + 1.2**2 * 12**2) / 2)
    assert got["b"]["mean"] == pytest.approx(8.0) and got["b"]["variance"] == pytest.approx((2 - 8) ** 2)
    cv = uncertainty.survey_cv(uncertainty.jolly_hampton(t, [], "stratum", "v")).first()["cv"]
    assert cv == pytest.approx(math.sqrt(got["a"]["variance"] * 100 + 36 * 25) / (220 + 40))


def test_replicates_are_scaled_to_the_stratum(spark):
    t = spark.createDataFrame([("a", k, 10.0, 1.0, 2.0) for k in range(4)], "stratum string, transect_num int, v double, distance double, area double")
    s = uncertainty.strata_statistics(t, "stratum", "v", 0.5)
    rows = uncertainty.replicate_estimates(uncertainty.bootstrap(t, s, "stratum", 3, 1), s, "stratum", "v").collect()
    assert len(rows) == 3 and all((r["n"], r["total"], r["density"], r["sampled_area"], r["area"], r["mean"], r["variance"]) == (2, 40.0, 5.0, 4.0, 8.0, 10.0, 0.0) for r in rows)


def test_virtual_areas_by_hand(spark):
    mesh = spark.createDataFrame([(30.1, -120.0, 1.0), (30.1, -119.0, 2.0), (31.2, -120.0, 4.0), (31.2, -118.0, 8.0), (33.3, -120.0, 16.0)], "latitude double, longitude double, v double")
    rows = uncertainty.virtual_transects(mesh, 1, "v").orderBy("transect_num").collect()
    assert [r["latitude"] for r in rows] == [31.0, 32.0, 34.0] and [r["v"] for r in rows] == [3.0, 12.0, 16.0]
    spacing = 1.5 * 60
    assert rows[0]["area"] == pytest.approx(rows[0]["distance"] * spacing / 2) and rows[1]["area"] == pytest.approx(rows[1]["distance"] * spacing) and rows[2]["area"] == 0
    one = uncertainty.virtual_transects(mesh.where("latitude < 31"), 1, "v").collect()
    assert len(one) == 1 and one[0]["area"] is None


def test_adjusted_proportions_of_one_source(spark):
    p = spark.createDataFrame([("s", "male", "aged", 1.0, 0.4), ("s", "female", "aged", 1.0, 0.6)], "stratum string, sex string, source string, aggregate double, share double")
    got = {r["sex"]: r["adjusted"] for r in biology.adjusted_proportions(p, "source", "stratum", "aged", "sex").collect()}
    assert got == {"male": 0.4, "female": 0.6}


def test_abundance_of_strata_without_shares(spark):
    rows = spark.createDataFrame([(1, "x", 2.0, 3.0), (2, "y", 2.0, 3.0)], "interval int, stratum string, area_interval double, number_density double")
    shares = spark.createDataFrame([("x", "male", 0.25)], "stratum string, sex string, proportion double")
    got = {(r["interval"], r["sex"]): r["abundance"] for r in biology.abundance(rows, shares, "stratum").collect()}
    assert got == {(1, "all"): 6.0, (2, "all"): 6.0, (1, "male"): 1.5, (2, "male"): 0.0}


@pytest.mark.parametrize("buckets", [1, 3, 7])
def test_global_rank_and_median(spark, buckets):
    values = [5.0, 1.0, 5.0, None, 2.0, 9.0, 5.0, -3.0, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").repartition(4)
    got = [(r["v"], r["k"]) for r in sorted(global_rank(df, "v", "r", "k", buckets=buckets).collect(), key=lambda r: r["r"])]
    assert got == sorted(((v, k) for k, v in enumerate(values)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert exact_median(df, "v") == 5.0 and exact_median(df.where("false"), "v") is None


def test_workbooks(spark, tmp_path):
    book = workbook({"one & two": [["a", "b", None, "d"], [1, 2.5, None, True], [], [None, "x<y>", 3, None]], "empty": []})
    assert sheet_names(book) == ["one & two", "empty"]
    assert list(parse_sheet(book, "one & two")) == [["a", "b", None, "d"], [1.0, 2.5, None, True], [], [None, "x<y>", 3.0]]
    assert list(parse_sheet(book, 1)) == []
    with pytest.raises(KeyError):
        list(parse_sheet(book, "none"))
    df = spark.createDataFrame([(1, "x", None), (2, None, 0.5)], "k int, s string, v double")
    for k in (1, 2):
        write_xlsx(spark, f"{tmp_path}/in/b{k}.xlsx", {"t": df})
    got = read_xlsx(spark, f"{tmp_path}/in", "t", seq="row").orderBy("k", "row").collect()
    assert [tuple(r) for r in got] == [(1.0, "x", None, 0), (1.0, "x", None, 0), (2.0, None, 0.5, 1), (2.0, None, 0.5, 1)]
    assert read_xlsx(spark, f"{tmp_path}/in/b1.xlsx", "t", "k string, s string").orderBy("k").collect()[0]["k"] == "1"


def test_csv_with_another_header_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x, y\n1, 2\n")
    (tmp_path / "b.csv").write_text("y, x\n3, 4\n")
    with pytest.raises(Exception):
        surveys.read_csv(spark, str(tmp_path)).collect()


def test_export_positions(spark):
    one = surveys.export_columns(spark.createDataFrame([(1.0, 2.0)], "Lat_S double, PRC_NASC double"))
    two = surveys.export_columns(spark.createDataFrame([(1.0, 2.0, 3.0)], "Lat_S double, Lat_M double, VL_end double"))
    assert one.columns == ["latitude", "nasc"] and two.columns == ["latitude_s", "latitude", "distance_e"]


def test_report_words():
    assert compare.sex_of([["Aged Length-Haul Counts (female)"]]) == "female" and compare.sex_of([["Male+Female:"]]) is None
    assert compare.quantity_of([["Kriged Acoustically Weighted Biomass (mmt)"]]) == "biomass"
    with pytest.raises(ValueError):
        compare.quantity_of([["biomass", "abundance"]])
    assert [compare.sex_of([[t]]) for t in ("Male/Female", "(Male)", "x male", "males", "female + male", "Total, all", "a-male", 3.0)] == [None, "male", "male", None, "male", "all", "male", None]
    assert [compare.translate(c) for c in ("LON", "Longitude", "a_WGT_b_wgt", "NASC", "Biomass density", "biomass densities", "ntk")] == ["longitude", "longitude", "a_biomass_b_biomass", "nasc", "biomass_density", "biomass densities", "abundance"]
    assert [compare.translate(c) for c in ("Lat", "nntk_male", "wgt_total", "Transect", "other")] == ["latitude", "number_density_male", "biomass", "transect_num", "other"]
    assert headers(4) == ["Length (cm)", "", "Age", ""][:1] + ["", "Age", ""]


def test_report_totals():
    names, rows = ["1", "2", tables.UNAGED, tables.SUBTOTAL], [[2.0, 1.0, 3.0, 4.0, 8.0], ["Subtotal", 1.0, 3.0, 4.0, None]]
    one, two = aggregates(names, rows, 20.0)
    assert one == ["Total (age1+)", 8.0, "", "Over Age:", 8.0, "", "Male+Female:", 20.0]
    assert two == ["Total (age2+)", 6.0, "", "", "", "", "Male+Female:", 15.0]


@pytest.mark.parametrize("empty", [False, True])
def test_every_report(spark, tmp_path, empty):
    r, names = Reporter(str(tmp_path)), {s: s for s in tables.SEXES}
    bio = spark.createDataFrame([("male", 10.0, 10.0, 1), ("female", 12.0, 10.0, 2), ("unsexed", 15.0, 14.0, 1)], "sex string, length double, length_bin double, haul_num int").withColumn("length_count", F.lit(2))
    cells = spark.createDataFrame([(s, 10.0, a, 1.0, "k", 2.0) for s in ("male", "female") for a in (1.0, 2.0)], "sex string, length_bin double, age_bin double, value double, ks string, weight double")
    geo = spark.createDataFrame([(1.0, 2.0, 3.0, "k", 5.0, 0.1, 7.0, 8.0, 9.0)], "transect_num double, latitude double, longitude double, ks string, biomass double, cell_cv double, biomass_density double, nasc double, number_density double")
    sigma = spark.createDataFrame([("k", 1e-4)], "ks string, sigma_bs double")
    if empty:
        bio, cells, geo = (x.where("false") for x in (bio, cells, geo))
    full = geo.withColumns({c: F.lit(1.0) for c in tables.POPULATION_COLUMNS if c not in {*geo.columns, "stratum", "sig_b", "wgt_per_fish"}})
    weights = spark.createDataFrame([("k", "all", 0.5)], "ks string, sex string, average_weight double")
    paths = [
        r.aged_length_haul_counts_report("a.xlsx", names, bio),
        r.total_length_haul_counts_report("b.xlsx", names, {"specimen": bio, "length": bio}),
        r.kriged_aged_biomass_mesh_report("c.xlsx", names, geo, cells, "ks", {"age_bin": [1.0]}),
        r.transect_aged_biomass_report("d.xlsx", names, geo, cells, "ks", {"age_bin": [1.0]}),
        r.kriged_mesh_results_report("e.xlsx", "s", geo, "ks", "biomass", sigma, "ks"),
        r.kriged_length_age_abundance_report("f.xlsx", names, {"aged": cells, "unaged": cells}, {"age_bin": [1.0]}),
        r.kriged_length_age_biomass_report("g.xlsx", names, cells),
        r.transect_length_age_abundance_report("h.xlsx", names, {"aged": cells, "unaged": cells}),
        r.transect_length_age_biomass_report("i.xlsx", names, cells),
        r.kriging_input_report("j.xlsx", "s", geo),
        r.transect_population_results_report("k.xlsx", "s", full, weights, sigma, "ks"),
    ]
    books = [open(p, "rb").read() for p in paths]
    assert [sheet_names(b) for b in books] == [["male", "female", "all"]] * 2 + [["all", "male", "female"]] * 2 + [["s"]] + [["male", "female", "all"]] * 4 + [["s"]] * 2
    if not empty:
        hauls = list(parse_sheet(books[1], "all"))
        assert hauls[1][:4] == [0.0, "1", "2", "Subtotal"] and hauls[2] == [10.0, 3.0, 3.0, 6.0] and hauls[4] == ["Subtotal", 6.0, 3.0]
        assert hauls[5] == ["Total", 9.0, "", "Male+Female", 6.0]
        assert list(parse_sheet(books[3], "male"))[2][-2:] == [0.0, 5.0]
        back = compare.read_aged_geodata(spark, paths[3]).where("sex = 'male' AND column = 'biomass'").collect()
        assert back == [] or back[0]["value"] == 5.0
        assert compare.read_geodata(spark, paths[9]).columns == ["latitude", "longitude", "biomass_density", "nasc", "number_density"]


def test_missing_report_columns(spark, tmp_path):
    r = Reporter(str(tmp_path))
    with pytest.raises(KeyError):
        r.kriging_input_report("x.xlsx", "s", spark.createDataFrame([(1.0,)], "latitude double"))
    with pytest.raises(FileNotFoundError):
        compare.resolve_file(spark, str(tmp_path), "*.xlsx")


def test_presentation(spark):
    v = spark.createDataFrame([(0.0,), (5.0,), (20.0,), (None,)], "v double")
    assert [r[0] for r in v.select(presentation.scale_sizes(F.col("v"), 0.0, 10.0)).collect()] == [25.0, 137.5, 250.0, None]
    assert v.select(presentation.scale_sizes(F.col("v"), 1.0, 1.0)).first()[0] == 25.0
    assert presentation.figure_height(10.0, 0.0, 5.0, 0.0, 2.0) == 4.0
    assert presentation.title("biomass_density_male") == ("Male biomass density", "kg nmi^-2") and presentation.title("other") == ("other", None)
    pts = spark.createDataFrame([(1, 2.0, 0.0), (1, 1.0, 5.0), (1, 2.0, 0.0), (2, 0.0, 0.0)], "transect_num int, longitude double, latitude double")
    assert [(r[0], [tuple(p) for p in r[1]]) for r in presentation.transect_lines(pts).collect()] == [(1, [(1.0, 5.0), (2.0, 0.0)])]


def test_scattering_against_sums():
    """The model with plain sums over segments, orientations and lengths."""
    p = dict(length_mean=0.02, length_sd_norm=0.1, length_radius_ratio=16.0, taper_order=10.0, radius_of_curvature_ratio=3.0, theta_mean=10.0, theta_sd=20.0, g=1.03, h=1.02, number_density=500.0)
    got = scattering.pcdwba(np.array([70e3]), **p, sound_speed_sw=1500.0, orientation={"bins": 7}, lengths={"bins": 9})[0]
    n, f, c = 50, 70e3, 1500.0
    freqs = np.arange(f * (1 - 0.31), f * 1.31 + 2000, 2000)
    z = np.linspace(-1, 1, n)
    bend = np.sin(0.5 / 3) * z
    zs, xs = 6 * bend, 6 * (1 - np.sqrt(1 - bend**2))
    theta = np.linspace(10 - 62, 10 + 62, 7)
    pdf = np.exp(-0.5 * ((theta - 10) / 20) ** 2) / (math.sqrt(2 * math.pi) * 20) * (theta[1] - theta[0])
    contrast = (1 - 1.03 * 1.02**2) / (1.03 * 1.02**2) - 0.03 / 1.03
    from pelagia.functions.special import bessel_j

    ka_last = 2 * math.pi * freqs[-1] / c * 0.02 / 16
    knots = np.linspace(-2 * ka_last, 2 * ka_last, 2 * n)
    table = bessel_j(1, knots)
    amplitude = []
    for x in freqs:
        ka = 2 * math.pi * x / c * 0.02 / 16
        power = 0.0
        for t, w in zip(np.radians(theta), pdf):
            total = 0j
            for s in range(n):
                a, b = (s, s + 1) if s + 1 < n else (n - 2, n - 1)
                slope = math.atan((zs[b] - zs[a]) / (xs[b] - xs[a] + 2.2e-16))
                tilt = slope - math.pi / 2 if slope >= 0 else slope + math.pi / 2
                k = s - 1 if s else 0
                dr = math.hypot(xs[k + 1] - xs[k], zs[k + 1] - zs[k])
                inner = ka * math.sqrt(1 - z[s] ** 10) / 1.02
                arg = 2 * inner * abs(math.cos(tilt - t)) + np.finfo(float).eps
                j = np.interp(arg, knots, table) / arg
                total += inner**2 * j * np.exp(1j * 16 * ka * math.hypot(xs[s], zs[s]) / 1.02 * math.cos(math.atan2(zs[s], xs[s]) - t)) * 1.02**2 * contrast * dr / 4
            power += abs(total) ** 2 * w
        amplitude.append(math.sqrt(power))
    sizes = np.linspace(0.7, 1.3, 9)
    lp = np.exp(-0.5 * ((sizes - 1) / 0.1) ** 2) / (math.sqrt(2 * math.pi) * 0.1) * (sizes[1] - sizes[0])
    sigma = sum(w * s * s * np.interp(s * 2 * math.pi * f / c * 0.02 / 16, 2 * math.pi * freqs / c * 0.02 / 16, amplitude) ** 2 for s, w in zip(sizes, lp)) * 0.02**2
    assert got == pytest.approx(10 * math.log10(500 * sigma), abs=1e-6)


def test_inversion(spark):
    base = {"length_mean": 0.02, "length_sd_norm": 0.1, "length_radius_ratio": 16.0, "taper_order": 10.0, "radius_of_curvature_ratio": 3.0, "theta_mean": 10.0, "theta_sd": 20.0, "g": 1.03, "h": 1.03, "number_density": 500.0}
    f = {38e3: "a", 120e3: "b", 200e3: "c"}
    rows = [(n, *scattering.pcdwba(np.array(list(f)), **(base | {"length_mean": n}), sound_speed_sw=1500.0).tolist()) for n in (0.015, 0.022)] + [(9.0, -60.0, -999.0, None)]
    df = spark.createDataFrame(rows, "key double, a double, b double, c double").repartition(3)
    for scaled in (False, True):
        p = InvParameters({k: {"value": v, "vary": False, "min": v * 0.5, "max": v * 2} for k, v in base.items()} | {"length_mean": {"value": 0.018, "min": 0.01, "max": 0.03}, "number_density": {"value": 300.0, "min": 50.0, "max": 900.0}})
        if scaled:
            p.scale()
        got = {r["key"]: r for r in matrix.invert(df, f, p, {"sound_speed_sw": 1500.0}, {"monte_carlo": True, "mc_realizations": 10, "mc_seed": 3}, {"burnin": 40, "max_evaluations": 160, "restart": {"max_attempts": 1, "Q_threshold": 0.01}}, keep=["key"]).collect()}
        for n in (0.015, 0.022):
            assert got[n]["length_mean"] == pytest.approx(n, rel=0.05) and got[n]["Q"] < 0.5
        assert math.isnan(got[9.0]["Q"] if got[9.0]["Q"] is not None else math.nan)


def test_inversion_parameters():
    p = InvParameters({"a": {"value": 2.0, "min": 1.0, "max": 5.0}, "b": {"value": 3.0, "min": 3.0, "max": 3.0, "vary": False}})
    p.scale()
    assert p.values == {"a": 0.25, "b": 0.0} and p.inverse_transform({"a": 0.5, "b": 0.0}) == {"a": 3.0, "b": 3.0}
    p.unscale()
    p.update_bounds({"a": {"max": 4.0}})
    assert p.bounds["a"] == {"min": 1.0, "max": 4.0}
    p.simulate_parameter_sets(5, np.random.default_rng(1))
    assert len(p.realizations) == 5 and all(1 <= r["a"]["value"] <= 4 and r["b"]["value"] == 3.0 for r in p.realizations.values())
    assert InvParameters.from_values({"x": 1.0}).values == {"x": 1.0} and "scaled=False" in repr(p)
    for bad in ({"a": {"value": 9.0, "max": 1.0}}, {"a": {"min": 0.0}}, {"a": {"value": 1.0, "other": 2}}):
        with pytest.raises(ValueError):
            InvParameters(bad)
    with pytest.raises(TypeError):
        InvParameters([1])


GOOD = {
    "kriging": {"search_radius": 3},
    "kriging_variogram": {"model": "exponential", "sill": 1.0, "nugget": 0.1},
    "variogram_class": {"coordinate_names": ("x", "y"), "lag_resolution": 0.1, "n_lags": 3},
    "length_ts": {"ts_length_regression": {"slope": 20, "intercept": -68}, "stratify_by": "ks"},
    "simulation": {"monte_carlo": True},
    "selectivity": {"l50": 20.0, "selection_range": 3.0},
    "single_parameter": {"value": 1.0},
    "haul_uid": {},
    "pcdwba_settings": {"type": "pcdwba", "frequency_interval": 2000},
    "hull_crop": {"num_nearest_transects": 3, "mesh_buffer_distance": 0, "projection": 4326, "coordinate_names": ("x", "y")},
}


def test_good_parameters():
    out = {k: validation.check(k, v) for k, v in GOOD.items()}
    assert out["kriging"] == {"aspect_ratio": 1e-3, "k_min": 5, "k_max": 20, "search_radius": 3.0}
    assert out["length_ts"]["stratify_by"] == ["ks"] and out["length_ts"]["haul_column"] == "haul_num"
    assert out["simulation"]["mc_realizations"] == 100 and out["hull_crop"]["projection"] == "epsg:4326"
    assert out["haul_uid"]["ship_id"] == {"US": 1, "CAN": 2} and out["pcdwba_settings"]["length_distribution"] == {"bins": 30, "family": "gaussian"}


@pytest.mark.parametrize(
    "name, change",
    [
        ("kriging", {"search_radius": 0}),
        ("kriging", {"k_min": 30}),
        ("kriging", {"k_min": 1}),
        ("kriging", {"other": 1}),
        ("kriging", {"aspect_ratio": math.inf}),
        ("kriging_variogram", {"nugget": 2.0}),
        ("kriging_variogram", {"decay_power": 2.5}),
        ("variogram_class", {"n_lags": 2.5}),
        ("variogram_class", {"lag_resolution": "x"}),
        ("length_ts", {"haul_column": "other"}),
        ("selectivity", {"slope": 1.0}),
        ("single_parameter", {"max": 0.0}),
        ("pcdwba_settings", {"length_distribution": {"family": "other"}}),
        ("hull_crop", {"projection": "wgs"}),
    ],
)
def test_bad_parameters(name, change):
    with pytest.raises(ValueError):
        validation.check(name, GOOD[name] | change)


def test_frames_are_checked(spark):
    mesh = spark.createDataFrame([(1, 2, 3.0)], "longitude int, latitude int, area double")
    assert dict(validation.check_mesh(mesh).dtypes)["longitude"] == "double"
    for bad in (mesh.drop("area"), mesh.drop("latitude"), mesh.withColumn("latitude", F.lit(99.0)), mesh.withColumn("area", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            validation.check_mesh(bad)
    points = mesh.select(F.col("longitude").alias("x"), F.col("latitude").alias("y"), F.lit(1.0).alias("z"))
    with pytest.raises(ValueError):
        validation.check_hull_crop(points, mesh, num_nearest_transects=3, mesh_buffer_distance=1.0)
    given = {"azimuth_angle_threshold": 180.0, "azimuth_filter": True, "coordinate_names": ("x", "y"), "force_lag_zero": True}
    assert validation.check_empirical(points, variable="z", **given)["variable"] == "z"
    with pytest.raises(KeyError):
        validation.check_empirical(points, variable="w", **given)
    with pytest.raises(KeyError):
        validation.check_scatter(points)


def test_scattering_parameters_are_checked():
    values = {"g": 1.0, "h": 1.0, "length_mean": 0.02, "length_radius_ratio": 16.0, "length_sd_norm": 0.1, "number_density": 5.0, "radius_of_curvature_ratio": 3.0, "theta_mean": 10.0, "theta_sd": 20.0}
    p, s = validation.check_scattering({k: {"value": v} for k, v in values.items()}, {"type": "pcdwba", "frequency_interval": 2000.0})
    assert p.bounds["theta_mean"] == {"min": -180.0, "max": 180.0} and s["environment"]["density_sw"] == 1025.0
    with pytest.raises(LookupError):
        validation.check_scattering({}, {"type": "other"})
    with pytest.raises(ValueError):
        validation.check_scattering({k: {"value": v} for k, v in values.items() if k != "g"}, {"type": "pcdwba", "frequency_interval": 2000.0})


def test_bootstrap_object(spark):
    j = JollyHampton(1, 0.5, 20, 3)
    with pytest.raises(RuntimeError):
        j.summarize()
    mesh = spark.createDataFrame([(30.1 + k, -120.0 - k % 3, 1.0 + k) for k in range(12)], "latitude double, longitude double, biomass double").unionByName(spark.createDataFrame([(30.2 + k, -118.0, 2.0) for k in range(12)], "latitude double, longitude double, biomass double"))
    limits = spark.createDataFrame([(1, 35.0), (2, 50.0)], "stratum_num int, northlimit_latitude double")
    v = j.create_virtual_transects(mesh, limits, "biomass")
    assert {r["stratum"] for r in v.collect()} == {1, 2} and v.count() == 12
    reps = j.stratified_bootstrap(v, "stratum", "biomass")
    assert reps.count() == 40
    out = {(r["scope"], r["statistic"]): r for r in j.summarize(ci_method="percentile").collect()}
    assert set(out) == {(s, n) for s in "12" for n in ("total", "density")} | {("survey", n) for n in ("total", "density", "cv")}
    assert all(r["low"] <= r["mean"] <= r["high"] for r in out.values())
    with pytest.raises(KeyError):
        j.summarize_transects(v.drop("transect_area"), "stratum", "biomass")
    with pytest.raises(ValueError):
        JollyHampton(strata_transect_proportion=0.0)


def test_length_ts_object(spark):
    fish = spark.createDataFrame([(1, 1, 20.0), (1, 2, 40.0), (3, 3, 30.0)], "ks int, haul_num int, length double")
    nasc = spark.createDataFrame([(1, 4.0, 0.5), (2, 4.0, 1.0), (3, 4.0, 1.0)], "ks int, nasc double, nasc_proportion double")
    model = InversionLengthTS({"ts_length_regression": {"slope": 20.0, "intercept": -68.0}, "stratify_by": ["ks"]})
    got = {r["ks"]: r["number_density"] for r in model.invert(nasc, fish).collect()}
    s = lambda x: 10 ** ((20 * math.log10(x) - 68) / 10)
    one, three = (s(20) + s(40)) / 2, s(30)
    assert got == pytest.approx({1: 0.5 * 4 / (4 * math.pi * one), 2: 4 / (4 * math.pi * (one + three) / 2), 3: 4 / (4 * math.pi * three)})
    with pytest.raises(RuntimeError):
        InversionLengthTS({"ts_length_regression": {"slope": 20.0, "intercept": -68.0}, "stratify_by": "ks"}).get_stratified_sigma_bs()
