"""A small invented survey from end to end, and its exports as a stream."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pelagia.geostatistics import cropping
from pelagia.geostatistics.variogram import Parameter
from pelagia.sources.xlsx import write_bytes
from pelagia.streaming import export_stream, keep_totals, read_totals, transect_totals, whole_batches
from pelagia.workflow import Survey, SurveyConfig


@pytest.fixture(scope="module")
def survey(spark):
    rng = random.Random(11)
    haul = lambda k: float(k % 6 + 1)
    fish = [(haul(k), rng.choice(["male", "female", "female", "unsexed"]), rng.randint(1, 6), round(rng.uniform(11, 59), 1)) for k in range(400)]
    specimen = spark.createDataFrame([(h, s, a, x, 5e-6 * x**3 * rng.uniform(0.9, 1.1)) for h, s, a, x in fish], "haul_num double, sex string, age long, length double, weight double")
    length = spark.createDataFrame([(haul(k), rng.choice(["male", "female"]), round(rng.uniform(11, 59), 1), rng.randint(1, 5)) for k in range(300)], "haul_num double, sex string, length double, length_count int")
    catch = spark.createDataFrame([(float(k), 5000.0 + 100 * k) for k in range(1, 7)], "haul_num double, weight double")
    haul_strata = spark.createDataFrame([(float(k), 1 + (k - 1) // 3) for k in range(1, 7)], "haul_num double, stratum_num int")
    geostrata = spark.createDataFrame([(1, 43.0), (2, 60.0)], "stratum_num int, northlimit_latitude double")
    nasc = []
    for t in range(12):
        for k in range(20):
            near = math.exp(-((t - 6) ** 2) / 8 - (k - 8) ** 2 / 30)
            nasc.append((float(t), t * 100 + k, t * 20 + 0.5 * k, t * 20 + 0.5 * k + 0.5, 40 + t / 2, -126 + k * 0.05, 10.0, 400 * near * rng.uniform(0.7, 1.3), float(1 + t // 6 * 3 + k % 3)))
    frame = spark.createDataFrame(nasc, "transect_num double, interval int, distance_s double, distance_e double, latitude double, longitude double, transect_spacing double, nasc double, haul_num double")
    mesh = spark.createDataFrame([(40 + a / 5, -126 + b * 0.1, 1.0) for a in range(28) for b in range(10)], "latitude double, longitude double, fraction double")
    line = spark.createDataFrame([(39.0 + k, -124.5 - 0.02 * k) for k in range(10)], "latitude double, longitude double")
    config = SurveyConfig(length_bins=[float(x) for x in range(10, 61, 4)], lag_resolution=0.05, n_lags=12, replicates=40, mesh_cell_area=40.0, variogram={"nugget": Parameter(0.05, 0.0, 1.0), "sill": Parameter(0.9, 0.1, 3.0), "correlation_range": Parameter(0.2, 0.02, 1.0), "hole_effect_range": Parameter(0.1, 0.0, 3.0), "decay_power": Parameter(1.5, 1.25, 1.75)})
    return Survey(specimen, length, catch, haul_strata, geostrata, frame, mesh, line, config)


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_shares_add_up(survey):
    assert {round(r["s"], 9) for r in survey.number_proportions.groupBy("stratum_num").agg(F.sum("proportion").alias("s")).collect()} == {1.0}
    aged = {r[0]: r[1] for r in survey.aged_weight_proportions.groupBy("stratum_num").agg(F.sum("proportion")).collect()}
    rest = {r[0]: r[1] for r in survey.unaged_weight_proportions.groupBy("stratum_num").agg(F.sum("proportion")).collect()}
    assert all(aged[k] + rest[k] == pytest.approx(1.0) and 0 < aged[k] < 1 for k in (1.0, 2.0))


def test_estimates_from_transects_to_mesh(survey):
    rows = survey.intervals
    assert rows.count() == 240
    swept = total(rows, "biomass") / total(rows, "area_interval")
    assert swept > 0
    kriged = survey.kriged
    assert kriged.count() == 280 and kriged.where("stratum_num IS NULL").count() == 0
    # a smooth field over the same waters has about the same mean density
    assert total(kriged, "biomass") / total(kriged, "area") == pytest.approx(swept, rel=0.25)
    assert 0 < survey.survey_cv < 1


def test_tables_keep_the_total(survey):
    whole = total(survey.kriged, "biomass")
    table = survey.biomass_table
    assert total(table, "value") == pytest.approx(whole, rel=1e-9)
    moved = survey.without_age(table)
    assert total(moved, "value") == pytest.approx(whole, rel=1e-9) and total(moved.where("age = 1"), "value") == 0
    by_sex = survey.mesh_estimates
    assert total(by_sex.where("sex = 'all'"), "biomass") == pytest.approx(whole, rel=1e-9)
    assert total(by_sex.where("sex <> 'all'"), "biomass") == pytest.approx(whole, rel=0.35)
    assert by_sex.where("nasc < 0 OR abundance < 0").count() == 0


@pytest.mark.parametrize("kriged", [False, True])
def test_uncertainty(survey, kriged):
    out = {(r["scope"], r["statistic"]): r for r in survey.uncertainty(kriged).collect()}
    assert out["survey", "total"]["mean"] == pytest.approx(total(survey.kriged if kriged else survey.intervals, "biomass"), rel=0.25)
    assert out["survey", "cv"]["mean"] > 0


def test_crop_before_kriging(spark, survey):
    other = Survey.__new__(Survey)
    other.__dict__.update({k: v for k, v in survey.__dict__.items() if k in ("config", "nasc", "specimen", "length", "catch", "geostrata", "isobath", "mesh", "intervals", "sigma_bs")})
    other.mesh = survey.mesh.unionByName(spark.createDataFrame([(40.0, -128.0, 1.0), (46.5, -125.5, 1.0)], "latitude double, longitude double, fraction double"))
    other.crop(cropping.hull_crop, num_nearest_transects=1, mesh_buffer_distance=5.0)
    assert other.mesh.count() == 280


def test_exports_as_a_stream(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    line = lambda t, k: f"{k}, {t * 10 + k}, {t * 10 + k + 1}, {t + k}.5\n"
    for t in (1, 2):
        write_bytes(spark, f"{folder}/T{t}_x.csv", ("Interval, VL_start, VL_end, PRC_NASC\n" + "".join(line(t, k) for k in range(3))).encode())
    stream = lambda: keep_totals(transect_totals(export_stream(spark, folder, "Interval int, VL_start double, VL_end double, PRC_NASC double")), out, f"{tmp_path}/state")
    stream().awaitTermination(120)
    assert {r["transect_num"]: (r["nasc"], r["intervals"], r["distance_e"]) for r in read_totals(spark, out).collect()} == {1.0: (7.5, 3, 13.0), 2.0: (10.5, 3, 23.0)}
    write_bytes(spark, f"{folder}/T2_y.csv", b"Interval, VL_start, VL_end, PRC_NASC\n9, 40, 41, 1.0\n")
    stream().awaitTermination(120)
    assert {r["transect_num"]: (r["nasc"], r["intervals"], r["distance_e"]) for r in read_totals(spark, out).collect()} == {1.0: (7.5, 3, 13.0), 2.0: (11.5, 4, 41.0)}
    # a third table takes the first one's place; one that isn't complete isn't read
    write_bytes(spark, f"{folder}/T1_y.csv", b"Interval, VL_start, VL_end, PRC_NASC\n9, 50, 51, 2.0\n")
    stream().awaitTermination(120)
    numbers = whole_batches(spark, out)
    assert len(numbers) == 2
    write_bytes(spark, f"{out}/batch={max(numbers) + 1}/part-0.parquet", b"PAR1")
    assert {r["transect_num"]: r["nasc"] for r in read_totals(spark, out).collect()} == {1.0: 9.5, 2.0: 11.5}
    with pytest.raises(FileNotFoundError):
        read_totals(spark, f"{tmp_path}/nothing")
