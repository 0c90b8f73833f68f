"""Queries of the readers and writers: each writes a table in a survey's format and reads it back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from pelagia.plans import roles as R
from pelagia.plans.registry import query
from pelagia.session import prepare
from pelagia.sources import surveys
from pelagia.sources.sheet_blocks import read_blocks
from pelagia.sources.sheets import replace_sheet, write_sheets
from pelagia.sources.xlsx import read_xlsx, write_bytes, write_xlsx
from pelagia.streaming import keep_totals, read_totals, transect_totals


def folder(spark) -> str:
    """A new folder among the checkpoints, which executors share."""
    prepare(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid4().hex}"


def fish(spark, d):
    s = R.table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("Haul"), (F.col("s_nationkey") % 3).alias("Ship"), (F.col("s_suppkey") % 4).alias("Survey"), (22500 + F.col("s_suppkey") % 2).alias("Species_Code"), (F.col("s_suppkey") % 5).alias("Sex"), F.round(F.abs("s_acctbal") / 100, 2).alias("Length"))


FISH = """fish AS (SELECT s_suppkey AS haul, s_nationkey % 3 AS ship, s_suppkey % 4 AS survey, s_suppkey % 5 AS sex, round(abs(s_acctbal) / 100, 2) AS length FROM supplier WHERE s_suppkey % 2 = 0)
SELECT CAST(haul + CASE ship WHEN 2 THEN 200 ELSE 0 END AS DOUBLE) AS haul_num, ship, CASE sex WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE CAST(sex AS VARCHAR) END AS sex, length FROM fish WHERE ship = 1 AND survey IN (0, 2) OR ship = 2"""
SUBSET = {"names": {"haul": "haul_num"}, "ships": {1: {"survey": [0, 2]}, 2: {"haul_offset": 200}}, "species": [22500], "labels": {"sex": {1: "male", 2: "female"}}}


def shown(df):
    return df.select("haul_num", F.col("ship").cast("int").alias("ship"), "sex", "length")


@query(f"WITH {FISH}")
def biology_views(spark, d):
    path = folder(spark)
    fish(spark, d).write.option("header", True).csv(f"{path}/fish.csv")
    return shown(surveys.load_biology(spark, {"specimen": f"{path}/fish.csv"}, **SUBSET)["specimen"])


@query(f"WITH {FISH}")
def biology_workbook(spark, d):
    path = folder(spark)
    write_xlsx(spark, f"{path}/fish.xlsx", {"notes": [["nothing"]], "biodata_specimen": fish(spark, d)})
    subset = SUBSET | {"labels": {"sex": {1.0: "male", 2.0: "female"}}}
    out = surveys.load_biology(spark, f"{path}/fish.xlsx", {"specimen": "biodata_specimen"}, **subset)["specimen"]
    return shown(out).withColumn("sex", F.regexp_replace("sex", r"\.0$", ""))


@query("SELECT CAST(n_nationkey AS DOUBLE) AS haul_num, CAST(n_regionkey AS DOUBLE) AS stratum_num, concat_ws('-', '2', '2', '99999', CAST(n_nationkey AS VARCHAR) || '.0') AS uid FROM nation")
def strata_workbook(spark, d):
    path = f"{folder(spark)}/strata.xlsx"
    n = R.table(spark, d, "nation").select(F.col("n_nationkey").alias("Haul"), F.col("n_regionkey").alias("Stratum"))
    write_xlsx(spark, path, {"Base KS": n})
    return surveys.load_strata(spark, path, {"ks": "Base KS"}, {"haul": "haul_num", "stratum": "stratum_num"})["ks"].select("haul_num", "stratum_num", "uid")


@query("SELECT CAST(r_regionkey AS DOUBLE) AS stratum_num, 35 + r_regionkey * CAST(4 AS DOUBLE) AS northlimit_latitude, CASE WHEN r_regionkey = 0 THEN -90 ELSE 31 + r_regionkey * CAST(4 AS DOUBLE) END AS lat_left, 35 + r_regionkey * CAST(4 AS DOUBLE) AS lat_right FROM region")
def geostrata_workbook(spark, d):
    path = f"{folder(spark)}/geostrata.xlsx"
    r = R.table(spark, d, "region").select(F.col("r_regionkey").alias("Stratum index"), (35 + F.col("r_regionkey") * 4.0).alias("Latitude (upper limit)"))
    write_xlsx(spark, path, {"INPFC": r})
    return surveys.load_geostrata(spark, path, {"inpfc": "INPFC"}, {"stratum index": "stratum_num", "latitude (upper limit)": "northlimit_latitude"})["inpfc"]


@query("SELECT s_suppkey * CAST(0.125 AS DOUBLE) AS latitude, -s_suppkey * CAST(0.25 AS DOUBLE) AS longitude, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS fraction, s_name AS note FROM supplier")
def mesh_workbook(spark, d):
    path = f"{folder(spark)}/mesh.xlsx"
    s = R.table(spark, d, "supplier").select((F.col("s_suppkey") * 0.125).alias("centroid_latitude"), (-F.col("s_suppkey") * 0.25).alias("centroid_longitude"), F.when(F.col("s_suppkey") % 3 > 0, 0.5).alias("fraction_cell"), F.col("s_name").alias("Note"))
    write_xlsx(spark, path, {"mesh": s})
    return surveys.load_mesh(spark, path, "mesh", {"centroid_latitude": "latitude", "centroid_longitude": "longitude", "fraction_cell": "fraction"})


@query("SELECT CASE WHEN r_regionkey < 3 THEN 'krig' ELSE 'vario' END AS kind, lower(r_name) AS name, r_regionkey * CAST(0.5 AS DOUBLE) AS value FROM region")
def geostatistic_parameters(spark, d):
    path = f"{folder(spark)}/parameters.xlsx"
    rows = [[f"{'krig' if r['r_regionkey'] < 3 else 'vario'}.{r['r_name'].lower()}", r["r_regionkey"] * 0.5] for r in R.table(spark, d, "region").collect()]  # five rows
    write_xlsx(spark, path, {"params": rows})
    krig, vario = surveys.load_geostatistic_parameters(spark, path, "params")
    return spark.createDataFrame([(k, n, v) for k, of in (("krig", krig), ("vario", vario)) for n, v in of.items()], "kind string, name string, value double")


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS row, CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name, CAST(s_nationkey AS DOUBLE) AS s_nationkey, s_acctbal FROM supplier")
def workbook_round_trip(spark, d):
    path = f"{folder(spark)}/supplier.xlsx"
    write_xlsx(spark, path, {"all": R.table(spark, d, "supplier").orderBy("s_suppkey")})
    return read_xlsx(spark, path, "all", seq="row")


@query("""WITH s AS (SELECT s_suppkey AS k, CAST('1900-01-01' AS TIMESTAMP) + to_days(CAST(s_suppkey * 370 % 100003 AS INTEGER)) + to_seconds(CAST(s_suppkey * 61 % 86400 AS INTEGER)) AS moment FROM supplier)
SELECT e AS epoch, CAST(k AS DOUBLE) AS k, strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment, strftime(moment, '%Y-%m-%d') AS day, strftime(moment, '%H:%M:%S') AS clock, CASE WHEN k % 2 = 0 THEN strftime(moment, '%Y-%m-%d %H:%M:%S') ELSE CAST(k AS VARCHAR) END AS mixed
FROM s CROSS JOIN (SELECT unnest([1900, 1904]) AS e) WHERE e = 1900 OR k * 370 % 100003 > 1460""")
def workbook_dates(spark, d):
    """Dates, times of day and mixed columns of a workbook of either epoch, told by their styles; 1904 has none before."""
    s = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.expr("TIMESTAMP_NTZ '1900-01-01 00:00:00' + make_dt_interval(CAST(s_suppkey * 370 % 100003 AS INT), 0, 0, s_suppkey * 61 % 86400)").alias("moment"))
    read = []
    for epoch in (1900, 1904):
        path = f"{folder(spark)}/dates.xlsx"
        rows = [(r["k"], r["moment"], r["moment"].date(), r["moment"].time(), r["moment"] if r["k"] % 2 == 0 else r["k"]) for r in s.where((F.col("k") * 370 % 100003 > 1460) | F.lit(epoch == 1900)).orderBy("k").collect()]
        write_xlsx(spark, path, {"dates": [["k", "moment", "day", "clock", "mixed"], *rows]}, date1904=epoch == 1904)
        sheet = read_xlsx(spark, path, "dates")
        read.append(sheet.select(F.lit(epoch).alias("epoch"), "k", F.date_format("moment", "yyyy-MM-dd HH:mm:ss").alias("moment"), F.date_format("day", "yyyy-MM-dd").alias("day"), "clock", "mixed"))
    return read[0].unionByName(read[1])


@query("SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal FROM customer UNION ALL SELECT CAST(-1 AS DOUBLE), n_name, CAST(n_nationkey AS DOUBLE), CAST(n_regionkey AS DOUBLE) FROM nation")
def workbook_sheets(spark, d):
    """All customers in as many sheets of 1,000 rows as they need, written by tasks; then one sheet more is replaced by the nations."""
    path = f"{folder(spark)}/customers.xlsx"
    c = R.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    names = write_sheets(spark, path, {"customers": c, "notes": R.table(spark, d, "region")}, most=1000, part=500)
    replace_sheet(spark, path, "notes", R.table(spark, d, "nation").select(F.lit(-1).alias("c_custkey"), F.col("n_name").alias("c_name"), F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("c_acctbal")))
    schema = "c_custkey double, c_name string, c_nationkey double, c_acctbal double"
    return read_blocks(spark, path, schema, names)


def write_exports(spark, d) -> str:
    """Four files per nation, as an export would have them; every seventh lacks one."""
    path = folder(spark)
    regions = [r["r_regionkey"] for r in R.table(spark, d, "region").collect()]  # five rows
    for row in R.table(spark, d, "nation").collect():  # 25 rows
        n = row["n_nationkey"]
        at = lambda r: (999.0 if r == 2 else 30 + n * 0.5 + r * 0.0078125, -120 - r * 0.125)
        files = {
            "intervals": ["Interval, VL_start, VL_end, Lat_M, Lon_M"] + [f"{r}, {n * 10 + r}, {n * 10 + r + 1}, {at(r)[0]}, {at(r)[1]}" for r in regions],
            "cells": ["Interval, Layer, Region_class, Region_name, PRC_NASC"] + [f'{r}, {r % 2}, " Fish", "{row["n_name"]} ", {n * 100 + r}.5' for r in regions],
            "layers": ["Layer, Layer_depth_min, Layer_depth_max"] + [f"{k}, {k * 10}, {k * 10 + 10}" for k in (0, 1)],
            "analysis": ["Interval, Lat_M"] + [f"{r}, 1" for r in regions],
        }
        for kind, lines in files.items():
            if n % 7 != 3 or kind != "layers":
                write_bytes(spark, f"{path}/T{n}_survey-x_({kind}).csv", ("\n".join(lines) + "\n").encode())
    return path


GOOD = "e AS (SELECT CAST(n_nationkey AS DOUBLE) AS transect_num, n_nationkey AS n, n_name, r_regionkey AS r FROM nation, region WHERE n_nationkey % 7 <> 3)"


@query("SELECT file_type, CAST(n_nationkey AS DOUBLE) AS transect_num, 'T' || n_nationkey || '_survey-x_(' || file_type || ').csv' AS file FROM nation, (VALUES ('analysis'), ('cells'), ('intervals'), ('layers')) f(file_type) WHERE n_nationkey % 7 <> 3 OR file_type <> 'layers'")
def transect_files(spark, d):
    files = surveys.map_transect_num(spark, write_exports(spark, d), {k: f"*({k}).csv" for k in surveys.EXPORT_FAMILIES})
    return files.select("file_type", "transect_num", surveys.file_name(F.col("file_path")).alias("file"))


@query(f"WITH {GOOD} SELECT transect_num, r AS interval, CAST(n * 10 + r AS INTEGER) AS distance_s, CAST(n * 10 + r + 1 AS INTEGER) AS distance_e, round(30 + n * CAST(0.5 AS DOUBLE) + r * CAST(0.0078125 AS DOUBLE), 9) AS latitude, -120 - r * CAST(0.125 AS DOUBLE) AS longitude FROM e")
def export_intervals(spark, d):
    intervals, _ = surveys.merge_exports(spark, write_exports(spark, d))
    return intervals.select("transect_num", "interval", "distance_s", "distance_e", F.round("latitude", 9).alias("latitude"), "longitude")


@query(f"WITH {GOOD} SELECT transect_num, r AS interval, CAST(r % 2 AS INTEGER) AS layer, 'fish' AS region_class, n_name AS region_name, n * 100 + r + CAST(0.5 AS DOUBLE) AS nasc, CAST(n * 10 + r AS INTEGER) AS distance_s, CAST(r % 2 * 10 AS INTEGER) AS layer_depth_min, CAST(r % 2 * 10 + 10 AS INTEGER) AS layer_depth_max FROM e")
def export_cells(spark, d):
    _, merged = surveys.merge_exports(spark, write_exports(spark, d))
    return merged.select("transect_num", "interval", "layer", "region_class", "region_name", "nasc", "distance_s", "layer_depth_min", "layer_depth_max")


def write_sv(spark, d) -> str:
    """A backscatter export per nation, in a folder per region."""
    path = folder(spark)
    for row in R.table(spark, d, "nation").collect():  # 25 rows
        n = row["n_nationkey"]
        lines = ["Process_ID, Interval, Layer, Sv_mean, Thickness_mean, Lat_M, Lon_M, Frequency, VL_start, VL_end"]
        for k in range(12):
            sv = -999 if k == 5 else -80 + (n * 7 + k * 5) % 30
            lines.append(f"{n}, {k // 4}, {k // 2 % 2}, {sv}, {5 + k % 3}, {30 + n * 0.25}, {-120 - k // 4 * 0.5}, {(38, 120)[k % 2]}, {k // 4}, {k // 4 + 1}")
        write_bytes(spark, f"{path}/r{row['n_regionkey']}/x{n}-T{n}_.csv", ("\n".join(lines) + "\n").encode())
    return path


SV = """raw AS (SELECT CAST(n_nationkey AS DOUBLE) AS transect_num, k // 4 AS interval, k // 2 % 2 AS layer, CAST(CASE WHEN k = 5 THEN -999 ELSE -80 + (n_nationkey * 7 + k * 5) % 30 END AS DOUBLE) AS sv_mean, 5 + k % 3 AS thick, CASE k % 2 WHEN 0 THEN 38000.0 ELSE 120000.0 END AS frequency FROM nation, range(0, 12) t(k)),
lin AS (SELECT *, 4 * pi() * 1852.0 ** 2 * pow(10, sv_mean / 10) * thick AS nasc FROM raw WHERE sv_mean BETWEEN -75 AND -55)"""


@query(f"WITH {SV} SELECT transect_num, CAST(interval AS INTEGER) AS interval, CAST(layer AS INTEGER) AS layer, CAST(frequency AS DOUBLE) AS frequency, round(avg(sv_mean), 6) AS sv_mean, round(log10(avg(nasc)), 6) AS log_nasc FROM lin GROUP BY ALL")
def sv_ingest(spark, d):
    out, _ = surveys.ingest_sv(spark, write_sv(spark, d), {38000.0: (-75.0, -55.0), 120000.0: (-75.0, -55.0)}, r"T(\d+)")
    return out.select("transect_num", "interval", "layer", "frequency", F.round("sv_mean", 6).alias("sv_mean"), F.round(F.log10("nasc"), 6).alias("log_nasc"))


@query(f"WITH {SV} SELECT transect_num, CAST(interval AS INTEGER) AS interval, CAST(frequency AS DOUBLE) AS frequency, round(10 * log10(sum(pow(10, sv_mean / 10) * thick)), 6) AS sv_mean, round(log10(sum(nasc)), 6) AS log_nasc, CAST(sum(thick) AS BIGINT) AS thickness_mean FROM lin GROUP BY ALL")
def sv_ingest_intervals(spark, d):
    out, _ = surveys.ingest_sv(spark, write_sv(spark, d), {38000.0: (-75.0, -55.0), 120000.0: (-75.0, -55.0)}, r"T(\d+)", "interval")
    return out.select("transect_num", "interval", "frequency", F.round("sv_mean", 6).alias("sv_mean"), F.round(F.log10("nasc"), 6).alias("log_nasc"), "thickness_mean")


@query(f"""WITH {SV}, w AS (SELECT *, 30 + transect_num * CAST(0.25 AS DOUBLE) AS latitude, -120 - interval * CAST(0.5 AS DOUBLE) AS longitude, sum(thick) OVER p AS ta, sum(nasc) OVER p AS tn, sum(thick) OVER (PARTITION BY frequency, transect_num, interval) AS ti FROM lin WINDOW p AS (PARTITION BY frequency, transect_num))
SELECT transect_num, CAST(frequency AS DOUBLE) AS frequency, round(sum(longitude * nasc / tn), 6) AS longitude_weighted, round(sum(latitude * nasc / tn), 6) AS latitude_weighted, round(10 * log10(sum(pow(10, sv_mean / 10) * thick / ta)), 6) AS sv_mean, round(log10(sum(nasc)), 6) AS log_nasc, round(avg(ti), 6) AS thickness_mean FROM w GROUP BY ALL""")
def sv_ingest_transects(spark, d):
    out, _ = surveys.ingest_sv(spark, write_sv(spark, d), {38000.0: (-75.0, -55.0), 120000.0: (-75.0, -55.0)}, r"T(\d+)", "transect")
    return out.select("transect_num", "frequency", *[F.round(c, 6).alias(c) for c in ("longitude_weighted", "latitude_weighted", "sv_mean", "thickness_mean")], F.round(F.log10("nasc"), 6).alias("log_nasc"))


@query("SELECT CAST(s_nationkey AS DOUBLE) AS transect_num, CAST(s_suppkey AS DOUBLE) AS haul_num, CAST(s_suppkey AS DOUBLE) AS distance_s, round(abs(s_acctbal), 2) AS nasc FROM supplier")
def nasc_workbook(spark, d):
    path = f"{folder(spark)}/nasc.xlsx"
    s = R.table(spark, d, "supplier").select(F.col("s_nationkey").alias("Transect"), F.col("s_suppkey").alias("Haul"), F.col("s_suppkey").alias("VL start"), F.round(F.abs("s_acctbal"), 2).alias("NASC"))
    write_xlsx(spark, path, {"Sheet1": s})
    return surveys.read_nasc(spark, path, "Sheet1", {"transect": "transect_num", "haul": "haul_num", "vl start": "distance_s"}).drop("uid")


@query("SELECT n_nationkey AS transect_num, n_regionkey AS region_id, n_nationkey + 1 AS haul_num FROM nation")
def region_key_file(spark, d):
    path = f"{folder(spark)}/key.csv"
    key = R.table(spark, d, "nation").select(F.col("n_nationkey").alias("transect_num"), F.col("n_regionkey").alias("region_id"), (F.col("n_nationkey") + 1).alias("haul_num"), "n_name")
    surveys.write_region_key(key, path)
    return surveys.read_region_key(spark, path)


@query("SELECT s_suppkey AS distance_s, s_suppkey + CAST(0.5 AS DOUBLE) AS distance_e, CASE WHEN s_suppkey % 3 = 0 THEN CAST(10 AS DOUBLE) ELSE CAST(s_suppkey AS DOUBLE) END AS transect_spacing FROM supplier WHERE s_nationkey <> 4")
def complete_intervals(spark, d):
    s = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("distance"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey")).alias("transect_spacing"), "s_nationkey")
    return surveys.complete_intervals(s, exclude={"s_nationkey": 4}).drop("s_nationkey")


@query("SELECT CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority")
def sheet_blocks(spark, d):
    """All orders written as sheets; two of their columns read back by many tasks, all sheets in one scan."""
    path = f"{folder(spark)}/orders.xlsx"
    names = write_sheets(spark, path, {"orders": R.table(spark, d, "orders")})
    out = read_blocks(spark, path, "o_custkey double, o_orderpriority string", names)
    return out.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))


@query(f"""WITH {R.INTERVALS} SELECT transect_num, round(sum(nasc), 4) AS nasc, count(*) AS intervals, min(distance_s) AS distance_s, max(distance_e) AS distance_e FROM intervals GROUP BY 1""")
def streamed_totals(spark, d):
    """The intervals arrive as files, one a batch; the totals of the last batch are those of all."""
    at = folder(spark)
    rows = R.intervals(spark, d).select("transect_num", "nasc", "distance_s", "distance_e")
    rows.repartition(4).write.parquet(f"{at}/in")  # several files, so several batches
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    run = keep_totals(transect_totals(stream), f"{at}/out", f"{at}/state")
    run.awaitTermination()
    return read_totals(spark, f"{at}/out").withColumn("nasc", F.round("nasc", 4))
