"""Loaders of survey tables: biology, strata, meshes, parameters, echo-integration and backscatter exports.

Texts are read by Spark's CSV reader and workbooks by ``read_xlsx``; everything
stays lazy. Columns come lower-cased, then renamed. A family of exports is one scan
of all its files, told apart by their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.operators import acoustics, cleaning
from pelagia.sources.xlsx import read_xlsx

#: Column names of echo-integration exports and ours (fixed values of the vendor's format).
EXPORT_NAMES = {
    "date_s": "ping_date",
    "exclude_below_line_depth_mean": "max_depth",
    "exclude_below_depth_mean": "max_depth",
    "lat_s": "latitude_s",
    "lat_m": "latitude",
    "lon_s": "longitude_s",
    "lon_m": "longitude",
    "prc_nasc": "nasc",
    "time_s": "ping_time",
    "vl_end": "distance_e",
    "vl_start": "distance_s",
}
#: Order of export rows, and the four families of a database export (fixed values).
EXPORT_ORDER = ["frequency", "transect_num", "interval", "layer"]
EXPORT_FAMILIES = ["analysis", "cells", "intervals", "layers"]


def renamed(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Lower-case columns, without outer blanks, then the given renames."""
    low = [c.strip().lower() for c in df.columns]
    return df.toDF(*[(names or {}).get(c, c) for c in low])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, **options) -> DataFrame:
    """CSV with a header and blanks after commas; files whose header differs from the first are an error, not a mix-up."""
    reader = spark.read.options(header=True, ignoreLeadingWhiteSpace=True, enforceSchema=False, **options)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path if isinstance(path, str) else list(path))


def read_table(spark: SparkSession, path: str, sheet: str | int = 0, names: Mapping[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """A CSV file or a workbook's sheet, by the path's ending, with normalised columns."""
    raw = read_csv(spark, path, schema) if path.lower().endswith(".csv") else read_xlsx(spark, path, sheet, schema)
    return renamed(raw, names)


def load_biology(spark: SparkSession, paths: Mapping[str, str] | str, sheets: Mapping[str, str] | None = None, names: Mapping[str, str] | None = None, ships: Mapping | None = None, species: Sequence | None = None, labels: Mapping | None = None, uid: Mapping | None = None) -> dict[str, DataFrame]:
    """Biology tables by name, from one workbook (``sheets`` maps names to sheets) or from a file each.

    Rows of the wanted ships, surveys and species stay; labels replace codes; haul
    numbers become doubles and every row gets its uid.
    """
    where = {k: (paths, s) for k, s in sheets.items()} if sheets else {k: (p, 0) for k, p in paths.items()}
    out = {}
    for name, (path, sheet) in where.items():
        df = read_table(spark, path, sheet, names)
        if ships:
            df = cleaning.ship_survey_filter(df, ships, species)
        elif species:
            df = df.where(F.col("species_code").isin(*species))
        present = {k: v for k, v in (labels or {}).items() if k in df.columns}
        df = cleaning.map_labels(df, present) if present else df
        out[name] = with_haul(df, uid)
    return out


def with_haul(df: DataFrame, uid: Mapping | None = None) -> DataFrame:
    """haul_num as double, and the uid."""
    if "haul_num" not in df.columns:
        raise KeyError("haul_num")
    return cleaning.haul_uid(df.withColumn("haul_num", F.col("haul_num").cast("double")), **(uid or {}))


def load_strata(spark: SparkSession, path: str, sheets: Mapping[str, str], names: Mapping[str, str] | None = None, uid: Mapping | None = None) -> dict[str, DataFrame]:
    """Haul to stratum tables by name."""
    return {k: with_haul(read_table(spark, path, s, names), uid) for k, s in sheets.items()}


def load_geostrata(spark: SparkSession, path: str, sheets: Mapping[str, str], names: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Northern limits of strata by name, with each one's latitude band."""
    from pelagia.operators.strata import band_table

    return {k: band_table(read_table(spark, path, s, names)) for k, s in sheets.items()}


def load_mesh(spark: SparkSession, path: str, sheet: str | int = 0, names: Mapping[str, str] | None = None) -> DataFrame:
    """Mesh centroids, or a reference line."""
    return read_table(spark, path, sheet, names)


load_isobath = load_mesh


def load_geostatistic_parameters(spark: SparkSession, path: str, sheet: str | int = 0, names: Mapping[str, str] | None = None) -> tuple[dict, dict]:
    """Kriging and variogram parameters of a sheet of (key, value) rows, by the keys' prefixes ``krig.`` and ``vario.``."""
    raw = read_xlsx(spark, path, sheet, header=False)
    pairs = raw.select(F.col("_c0").cast("string").alias("k"), F.col("_c1").alias("v")).where("k IS NOT NULL").collect()  # a parameter each

    def plain(v):
        try:
            return float(v)
        except (TypeError, ValueError):
            return v

    of = lambda prefix: {(names or {}).get(n, n): plain(r["v"]) for r in pairs if r["k"].startswith(prefix) for n in [r["k"].replace(prefix, "")]}
    return of("krig."), of("vario.")


def export_columns(df: DataFrame) -> DataFrame:
    """Canonical columns of an export.

    Of start, middle and end positions a single one is the position; of several the
    middle one is.
    """
    low = renamed(df)
    names = dict(EXPORT_NAMES)
    for axis, name in (("lon", "longitude"), ("lat", "latitude")):
        there = [f"{axis}_{k}" for k in "sme" if f"{axis}_{k}" in low.columns]
        if len(there) == 1:
            names[there[0]] = name
    return low.toDF(*[names.get(c, c) for c in low.columns])


def file_name(path=None):
    """The name of a row's file without its folders."""
    return F.element_at(F.split(F.col("_metadata.file_path") if path is None else path, "/"), -1)


def map_transect_num(spark: SparkSession, folder: str, families: Mapping[str, str], pattern: str = r"T(\d+)") -> DataFrame:
    """(file_type, file_path, transect_num) of the files of each family (name: glob) whose name has a transect number."""
    out = None
    for kind, glob in families.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(F.lit(kind).alias("file_type"), F.col("path").alias("file_path"))
        out = files if out is None else out.unionByName(files)
    number = F.regexp_extract("file_path", pattern, 1)
    return out.where(number != "").withColumn("transect_num", number.cast("double"))


def read_export(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, schema: str | None = None, impute: bool = True, order: str | None = "interval", **options) -> DataFrame:
    """A family of exports with canonical columns; ``pattern`` takes the transect number from the file's name.

    Bad coordinates are imputed within each file, along ``order``.
    """
    raw = read_csv(spark, path, schema, **options)
    df = export_columns(raw.withColumn("filename", file_name()))
    if pattern:
        df = df.withColumn("transect_num", F.regexp_extract("filename", pattern, 1).cast("double"))
    if impute and order in df.columns:
        for c in ("latitude", "longitude"):
            if c in df.columns:
                df = cleaning.impute_coordinates(df, c, "filename", order)
    return df


def merge_exports(spark: SparkSession, folder: str, pattern: str = r"T(\d+)", default_spacing: float = 10.0, latitude_threshold: float = 60.0, impute: bool = True, schemas: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(intervals, merged cells) of a folder of database exports.

    Only transects with exactly one file of each of the four families count.
    """
    globs = {k: f"*({k}).csv" for k in EXPORT_FAMILIES}
    files = cleaning.valid_filesets(map_transect_num(spark, folder, globs, pattern), EXPORT_FAMILIES)
    good = files.select("transect_num").distinct()
    read = lambda kind: read_export(spark, folder, pattern, (schemas or {}).get(kind), impute, "interval" if kind == "intervals" else None, pathGlobFilter=globs[kind]).drop("filename").join(good, "transect_num", "left_semi")
    intervals = cleaning.transect_spacing(read("intervals"), default_spacing, latitude_threshold)
    cells = read("cells")
    there = [c for c in ("region_name", "region_class") if c in cells.columns]
    if len(there) == 2:
        cells = cleaning.clean_cells(cells)
    merged = cleaning.merge_exports(intervals, cells, read("layers"))
    return intervals, merged


def sort_export(df: DataFrame) -> DataFrame:
    """Rows in the order of exports, for output: only where the result is shown or written."""
    return df.orderBy(*[c for c in EXPORT_ORDER if c in df.columns])


def read_nasc(spark: SparkSession, path: str, sheet: str | int = 0, names: Mapping[str, str] | None = None, uid: Mapping | None = None, impute: bool = True, group: str = "transect_num", order: str = "distance_s", hauls: bool = True) -> DataFrame:
    """A consolidated NASC table; with ``hauls`` haul numbers are doubles and rows get a uid."""
    df = read_table(spark, path, sheet, names)
    if impute and {group, order} <= set(df.columns):
        for c in ("latitude", "longitude"):
            if c in df.columns:
                df = cleaning.impute_coordinates(df, c, group, order)
    return with_haul(df, uid) if hauls else df


def read_region_key(spark: SparkSession, path: str, sheet: str | int = 0, names: Mapping[str, str] | None = None) -> DataFrame:
    """(transect_num, region_id, haul_num) of a CSV or workbook, as far as it has them."""
    df = read_table(spark, path, sheet, names)
    return df.select(*[c for c in ("transect_num", "region_id", "haul_num") if c in df.columns])


def write_region_key(key: DataFrame, path: str) -> None:
    """The key as CSV files with a header."""
    key.write.mode("overwrite").option("header", True).csv(path)


def complete_intervals(nasc: DataFrame, interval_distance: float = 0.5, spacing: float = 10.0, include: Mapping | None = None, exclude: Mapping | None = None) -> DataFrame:
    """Another survey's exports in our columns: interval ends by a fixed length, missing spacings by a default."""
    df = cleaning.apply_filters(nasc, include, exclude, strict=False).withColumnRenamed("distance", "distance_s")
    return df.withColumns({"distance_e": F.col("distance_s") + interval_distance, "transect_spacing": F.coalesce(F.col("transect_spacing").cast("double"), F.lit(float(spacing)))})


def ingest_sv(spark: SparkSession, folder: str, thresholds: Mapping[float, tuple[float, float]] | None = None, pattern: str | None = None, method: str = "cells", impute: bool = True, schema: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Volume backscatter of all CSV exports below a folder, integrated; and NASC by position.

    ``thresholds`` maps frequencies (Hz) to the range of backscatter that counts, and
    picks those frequencies; without it all count, between -999 and 999.
    """
    df = read_export(spark, folder, pattern, schema, impute, "interval", pathGlobFilter="*.csv", recursiveFileLookup=True)
    if thresholds:
        limits = {f / 1000: v for f, v in thresholds.items()}
        df = df.where(F.col("frequency").isin(list(limits)))
    else:
        limits = None
        df = df.withColumn("sv_mean", F.when(F.col("sv_mean").between(-999.0, 999.0), F.col("sv_mean")))
    return integrate(df, method, limits)


#: Keys of a cell that an integration keeps, as far as the export has them.
CELL_KEYS = {"cells": ["transect_num", "longitude", "latitude", "interval", "layer"], "interval": ["transect_num", "longitude", "latitude", "interval"], "transect": ["transect_num"]}


def integrate(df: DataFrame, method: str, thresholds: Mapping[float, tuple[float, float]] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Thresholds, linear backscatter, frequencies in Hz and NASC, then the integration of ``method``."""
    if method not in CELL_KEYS:
        raise ValueError(f"method '{method}' is not one of {', '.join(CELL_KEYS)}")
    rows = acoustics.sv_threshold(df, thresholds or {}).where("sv_mean IS NOT NULL").withColumn("frequency", F.col("frequency") * 1000.0)
    keys = [k for k in CELL_KEYS[method] if k in rows.columns]
    if method == "transect":
        out = acoustics.sv_transects(rows, F.col("distance_e") - F.col("distance_s"))
    else:
        out = (acoustics.sv_cells if method == "cells" else acoustics.sv_intervals)(rows, keys)
    positions = None
    if {"longitude", "latitude"} <= set(rows.columns):
        positions = acoustics.linear(rows).groupBy("frequency", *dict.fromkeys([*keys, "longitude", "latitude"])).agg(F.sum("nasc").alias("nasc"))
    return out, positions
