"""Ranges of transects from tables and workbooks, and strata of several columns."""

import pytest

from pelagia.inversion.length_ts import InversionLengthTS
from pelagia.operators import cleaning
from pelagia.sources.xlsx import workbook, write_bytes

TS = {"slope": 20.0, "intercept": -68.0}


def test_ranges_of_a_sheet(spark, tmp_path):
    df = spark.createDataFrame([(t, k, k * 1.0, k + 1.0) for t in (1, 2, 3) for k in range(6)], "transect_num int, interval int, distance_s double, distance_e double")
    rows = [["Transect", "LOG_START", "Log_End", "region_id"], [1.0, 1.5, 2.5, "A"], [1.0, 4.5, 4.9, "A"], [2.0, 0.0, 0.5, "B"]]
    path = f"{tmp_path}/r.xlsx"
    write_bytes(spark, path, workbook({"x": [["a"]], "ranges": rows}))
    found = lambda *a, **k: {(r["transect_num"], r["interval"]) for r in cleaning.filter_intervals(df, *a, **k).collect()}
    free = {(t, k) for t in (2, 3) for k in range(6)}
    assert found(path, "region_id = 'A'", "ranges") == free | {(1, 1), (1, 2), (1, 4)}
    assert found(path, sheet="ranges") == {(3, k) for k in range(6)} | {(2, 0), (1, 1), (1, 2), (1, 4)}
    with pytest.raises(KeyError, match="log_start, log_end"):
        cleaning.listed_ranges(spark.createDataFrame([(1,)], "Transect int"))
    same = spark.createDataFrame([(1, 5, 0.0, 9.0)], "transect int, transect_num int, log_start double, log_end double")
    assert cleaning.listed_ranges(same).first()["transect_num"] == 5


def test_strata_of_two_columns(spark):
    fish = spark.createDataFrame([(1, "f", 1, 20.0), (1, "m", 1, 30.0), (1, "f", 2, 40.0)], "ks int, sex string, haul_num int, length double")
    nasc = spark.createDataFrame([(1, "f", 4.0), (1, "m", 4.0), (2, "f", 4.0)], "ks int, sex string, nasc double")
    model = InversionLengthTS({"ts_length_regression": TS, "stratify_by": ["ks", "sex"], "impute_missing_strata": False})
    got = {(r["ks"], r["sex"]): r["number_density"] for r in model.invert(nasc, fish).collect()}
    s = lambda x: 10 ** -6.8 * x * x
    per = lambda v: 4 / (4 * 3.141592653589793 * v)
    assert got == pytest.approx({(1, "f"): per((s(20) + s(40)) / 2), (1, "m"): per(s(30)), (2, "f"): 0.0})
    with pytest.raises(ValueError, match="several columns"):
        InversionLengthTS({"ts_length_regression": TS, "stratify_by": ["ks", "sex"]})


def test_overlaps_by_brute_force(spark):
    """Overlapping, nested, touching and repeated ranges; no join of intervals with ranges in the plan."""
    import random

    from pelagia.operators import cleaning

    rng = random.Random(4)
    rows = [(k, k % 5, a := rng.randrange(0, 300), a + rng.randrange(0, 4)) for k in range(400)] + [(900, None, 1, 2), (901, 2, None, 2)]
    listed = [(float(t), a := rng.randrange(0, 300), a + rng.choice([-2, 0, 1, 3, 40])) for t in (0, 1, 2, 7) for _ in range(12)] + [(3.5, 0, 300), (2.0, None, 5), (1.0, 10, 12), (1.0, 10, 12)]
    df = spark.createDataFrame(rows, "interval int, transect_num int, distance_s int, distance_e int")
    out = cleaning.overlapping(df, spark.createDataFrame(listed, "transect_num double, log_start int, log_end int"))
    want = [k for k, t, s, e in rows if None not in (t, s, e) and any(u == t and a is not None and e >= a and s <= b for u, a, b in listed)]
    assert sorted(r["interval"] for r in out.collect()) == want and 20 < len(want) < 380
    assert "log_end" not in "".join(line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line) and out.columns == df.columns
