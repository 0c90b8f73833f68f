"""Geometry columns: round trips, both byte orders, boxes and pruned reads."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.geostatistics import geometry


def test_known_bytes():
    assert geometry.encode("point", [np.array([[1.0, 2.0]])]).hex() == "0101000000000000000000f03f0000000000000040"
    big = struct.pack(">BI2d", 0, 1, 1.0, 2.0)
    srid = struct.pack("<BII2d", 1, 1 | geometry.WITH_SRID, 4326, 1.0, 2.0)
    for b in (big, srid):
        kind, rings = geometry.decode(b)
        assert kind == "point" and rings[0].tolist() == [[1.0, 2.0]]
    for bad in (b"\x01\x07\x00\x00\x00\x00", big[:-1], b""):
        with pytest.raises(ValueError):
            geometry.decode(bad)


def test_round_trip(spark):
    p = "array<struct<x:double,y:double>>"
    outer, hole, path = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)], [(2.0, 1.0), (3.0, 2.0), (3.0, 1.0)], [(0.1, 0.2), (3.1, 4.2), (3.1, 5.2)]
    df = spark.createDataFrame([(1, outer, hole, path), (2, None, None, None), (3, outer, None, []), (4, outer + outer[:1], None, path[:1])], f"id int, outer {p}, hole {p}, path {p}")
    rows = df.select("id", geometry.parsed(geometry.polygon(F.col("outer"), F.col("hole"))).alias("a"), geometry.parsed(geometry.line(F.col("path"))).alias("l")).orderBy("id").collect()
    flat = lambda s: None if s is None or s["rings"] is None else [[tuple(q) for q in r] for r in s["rings"]]
    assert [flat(r["a"]) for r in rows] == [[outer, hole], None, [outer], [outer]]
    assert [flat(r["l"]) for r in rows] == [[path], None, None, [path[:1]]]
    total = df.where("id = 1 OR id = 4").select("id", geometry.length(geometry.parsed(geometry.line(F.col("path")))["rings"]).alias("n")).orderBy("id").collect()
    assert [round(r["n"], 12) for r in total] == [6.0, 0.0]


def test_pruned_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, float(x), float(y), "kept") for k, (x, y) in enumerate(rng.uniform(0, 100, (40_000, 2)))]
    rows += [(-1, None, 3.0, "kept"), (-2, 5.0, None, "kept"), (-3, 50.0, 50.0, "kept")]
    df = spark.createDataFrame(rows, "id int, longitude double, latitude double, xmin string")
    geometry.write(geometry.with_geometry(df), f"{tmp_path}/g", row_group=1 << 16)
    every = geometry.read(spark, f"{tmp_path}/g")
    assert every.count() == len(rows) and every.where("geometry IS NULL AND xmin IS NULL").count() == 2
    box = (10.0, 20.0, 12.5, 23.0)
    near = geometry.read(spark, f"{tmp_path}/g", box)
    want = {r[0] for r in rows if r[1] is not None and r[2] is not None and box[0] <= r[1] <= box[2] and box[1] <= r[2] <= box[3]}
    assert {r["id"] for r in near.collect()} == want
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(near._jdf.queryExecution(), "formatted")
    assert "LessThanOrEqual(xmin,12.5)" in plan and "GreaterThanOrEqual(ymax,20.0)" in plan
    # rows of one file lie together: their boxes take far less than the whole square
    files = every.where("xmin IS NOT NULL").groupBy(F.input_file_name()).agg(((F.max("xmax") - F.min("xmin")) * (F.max("ymax") - F.min("ymin"))).alias("a"))
    assert files.agg(F.avg("a")).first()[0] < 6_000 or files.count() == 1


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "id int, longitude double, latitude double")
    geometry.write(geometry.with_geometry(df), f"{tmp_path}/e")
    assert geometry.read(spark, f"{tmp_path}/e", (0, 0, 1, 1)).count() == 0
