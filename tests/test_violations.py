"""Checks as columns say the same of each row as the checks of one set of parameters."""

import random

import pytest

from pelagia import validation

NUMBERS = [None, -1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 7.0, 10.0, 150.0, 1e9, float("nan"), float("inf")]


@pytest.mark.parametrize("schema", ["kriging", "variogram_model", "ts_regression", "environment", "single_parameter", "selectivity", "pcdwba_parameters", "distribution", "simulation"])
def test_rows_break_what_their_parameters_break(spark, schema):
    rules, rng = validation.SCHEMAS[schema].rules, random.Random(schema)
    names = [k for k, r in rules.items() if r.kind in (float, int, str)]
    rows = [tuple(rng.choice(["gaussian", "uniform", "other", None]) if rules[n].kind is str else rng.choice(NUMBERS[:9] if rng.random() < 0.8 else NUMBERS) for n in names) for _ in range(400)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, " + ", ".join(f"`{n}` {'string' if rules[n].kind is str else 'double'}" for n in names))
    broken = {r["row"]: r["broken"] for r in df.select("row", validation.violations(df.drop("row"), schema).alias("broken")).collect()}
    seen = set()
    for i, row in enumerate(rows):
        given = {n: v for n, v in zip(names, row) if v is not None}
        try:
            validation.check(schema, given)
            fine = True
        except ValueError:
            fine = False
        assert fine == (broken[i] == []), (given, broken[i])
        seen.add(fine)
    assert False in seen


def test_unknown_and_missing_columns(spark):
    df = spark.createDataFrame([(20.0, "x")], "slope double, other string")
    assert df.select(validation.violations(df, "ts_regression")).first()[0] == ["intercept", "other"]
    assert validation.bad_values(df).collect() == []
    places = spark.createDataFrame([(None, 91.0), (float("nan"), 0.0), (200.0, -90.0)], "longitude double, latitude double")
    assert {r["column"]: (r["nulls"], r["beyond"]) for r in validation.bad_values(places).collect()} == {"longitude": (2, 1), "latitude": (0, 1)}
