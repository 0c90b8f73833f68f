"""Geometry columns: well-known binary (WKB) of points, lines and polygons, with box columns that scans prune by.

A geometry is kept as binary beside its box (xmin, ymin, xmax, ymax). ``write``
sorts rows along a Z-order curve of their box centres, so that the row groups of
the Parquet files hold near things, and ``read`` filters by the box columns, which
the scan compares with the row groups' statistics before it reads a geometry. Values
are coded by numpy in Arrow batches, whole columns of points at a time.

Cases: null coordinates or rings, or ones without a point, give a null geometry, whose
box is null; no box read finds it. Rings of polygons are closed when written and
open again when parsed. Either byte order and a leading SRID are read; little-endian
without SRID is written. Other kinds of geometry and cut-off bytes raise ValueError.
"""

from __future__ import annotations

import struct
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.session import prepare

#: Kinds and their codes in WKB (fixed values).
CODES = {"point": 1, "line": 2, "polygon": 3}
KINDS = {v: k for k, v in CODES.items()}
#: Flag of a leading SRID (a fixed value of the extended format).
WITH_SRID = 0x20000000
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
SHAPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("rings", T.ArrayType(T.ArrayType(POINT)))])
BOX = ("xmin", "ymin", "xmax", "ymax")


def encode(kind: str, rings: list[np.ndarray]) -> bytes | None:
    """WKB of (n, 2) arrays: a point and a line have one, a polygon its outer ring and its holes."""
    rings = [np.asarray(r, "<f8").reshape(-1, 2) for r in rings]
    if not rings or not len(rings[0]):
        return None
    head = struct.pack("<BI", 1, CODES[kind])
    if kind == "point":
        return head + rings[0][0].tobytes()
    if kind == "line":
        return head + struct.pack("<I", len(rings[0])) + rings[0].tobytes()
    closed = [r if len(r) > 1 and (r[0] == r[-1]).all() else np.concatenate([r, r[:1]]) for r in rings if len(r)]
    return head + struct.pack("<I", len(closed)) + b"".join(struct.pack("<I", len(r)) + r.tobytes() for r in closed)


def decode(wkb: bytes) -> tuple[str, list[np.ndarray]]:
    """Kind and rings of WKB."""
    try:
        order = "<" if wkb[0] else ">"
        code = struct.unpack_from(f"{order}I", wkb, 1)[0]
        at = 9 if code & WITH_SRID else 5
        kind = KINDS.get(code & ~WITH_SRID)
        if kind is None:
            raise ValueError(f"geometry of kind {code} isn't supported")

        def run(n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(wkb, f"{order}f8", 2 * n, at).reshape(n, 2)
            at += 16 * n
            return out

        def count() -> int:
            nonlocal at
            at += 4
            return struct.unpack_from(f"{order}I", wkb, at - 4)[0]

        if kind == "point":
            return kind, [run(1)]
        if kind == "line":
            return kind, [run(count())]
        return kind, [run(count())[:-1] for _ in range(count())]
    except (struct.error, IndexError) as e:
        raise ValueError("geometry is cut off") from e


def point(x: Column, y: Column) -> Column:
    """WKB of a point."""

    @F.pandas_udf("binary")
    def pack(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), [("order", "u1"), ("code", "<u4"), ("x", "<f8"), ("y", "<f8")])
        out["order"], out["code"], out["x"], out["y"] = 1, CODES["point"], a, b
        whole = out.tobytes()
        gone = (a.isna() | b.isna()).to_numpy()
        return pd.Series([None if g else whole[21 * k : 21 * k + 21] for k, g in enumerate(gone)], dtype=object)

    return pack(x.cast("double"), y.cast("double"))


def _coded(kind: str, rings: Column) -> Column:
    @F.pandas_udf("binary")
    def pack(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y):
            out.append(None if a is None else encode(kind, [np.column_stack([np.asarray(p, float), np.asarray(q, float)]) for p, q in zip(a, b)]))
        return pd.Series(out, dtype=object)

    of = lambda c: F.transform(rings, lambda ring: F.transform(ring, lambda p: p[c].cast("double")))
    return pack(of("x"), of("y"))


def line(points: Column) -> Column:
    """WKB of an array of (x, y)."""
    return _coded("line", F.when(points.isNotNull(), F.array(points)))


def polygon(*rings: Column) -> Column:
    """WKB of an outer ring and its holes, each an array of (x, y)."""
    return _coded("polygon", F.when(rings[0].isNotNull(), F.array_compact(F.array(*rings))))


@F.pandas_udf(SHAPE)
def parsed(wkb: pd.Series) -> pd.DataFrame:
    """(kind, rings) of WKB; kind is point, line or polygon."""
    kinds, out = [], []
    for b in wkb:
        kind, rings = (None, None) if b is None else decode(b)
        kinds.append(kind)
        out.append(None if rings is None else [[{"x": x, "y": y} for x, y in r.tolist()] for r in rings])
    return pd.DataFrame({"kind": pd.Series(kinds, dtype=object), "rings": pd.Series(out, dtype=object)})


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in BOX]))
def box_of(wkb: pd.Series) -> pd.DataFrame:
    """The smallest box around a geometry."""
    out = np.full((len(wkb), 4), np.nan)
    for k, b in enumerate(wkb):
        if b is not None:
            p = np.concatenate(decode(b)[1])
            out[k] = *p.min(0), *p.max(0)
    return pd.DataFrame(out, columns=list(BOX)).astype(object).where(~np.isnan(out), None)


def with_geometry(df: DataFrame, x: str = "longitude", y: str = "latitude", name: str = "geometry") -> DataFrame:
    """Add a point column made of two coordinate columns."""
    prepare(df.sparkSession)
    return df.withColumn(name, point(F.col(x), F.col(y)))


def length(rings: Column) -> Column:
    """Length of the first of a geometry's rings as a line."""
    p = F.get(rings, F.lit(0))
    steps = F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def z_order(x: Column, y: Column, lo: tuple[float, float], hi: tuple[float, float], bits: int = 16) -> Column:
    """Place of a position on the Z-order curve of a grid of 2^bits cells a side."""

    def spread(v: Column, a: float, b: float) -> Column:
        cell = F.floor((v - a) / ((b - a) or 1.0) * ((1 << bits) - 1)).cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask))
        return cell

    return spread(x, lo[0], hi[0]).bitwiseOR(F.shiftleft(spread(y, lo[1], hi[1]), 1))


def write(df: DataFrame, path: str, geometry: str = "geometry", row_group: int = 1 << 20) -> None:
    """Write a frame with its geometries' boxes as Parquet, near things together; ``row_group`` is in bytes.

    Boxes replace columns of their names.
    """
    prepare(df.sparkSession)
    plain = df.drop(*BOX).withColumn("_box", box_of(F.col(geometry))).select("*", "_box.*").drop("_box")
    folder = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/boxes-{uuid4().hex}"
    plain.write.mode("overwrite").parquet(folder)  # boxes are computed once, for the extent and for the order
    rows = df.sparkSession.read.parquet(folder)
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    s = rows.agg(F.min(cx).alias("x0"), F.min(cy).alias("y0"), F.max(cx).alias("x1"), F.max(cy).alias("y1")).first()
    place = z_order(cx, cy, (s["x0"] or 0.0, s["y0"] or 0.0), (s["x1"] or 0.0, s["y1"] or 0.0))
    sorted_ = rows.withColumn("_z", place).repartitionByRange("_z").sortWithinPartitions("_z").drop("_z")
    sorted_.write.mode("overwrite").option("parquet.block.size", row_group).parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Rows whose geometry's box meets ``box`` (xmin, ymin, xmax, ymax), bounds included; all rows without one."""
    prepare(spark)
    rows = spark.read.parquet(path)
    if box is None:
        return rows
    x0, y0, x1, y1 = map(float, box)
    return rows.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
