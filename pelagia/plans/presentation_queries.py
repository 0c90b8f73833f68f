"""Queries of the data behind maps and tables, and of the mesh regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.geostatistics import cropping, regions
from pelagia.plans import geo_queries as G
from pelagia.plans import report_queries as P
from pelagia.plans import roles as R
from pelagia.plans.registry import query
from pelagia.reports import presentation


@query(f"{P.W} SELECT length_bin, age AS age_bin, round(sum(CASE WHEN sex = 'unsexed' THEN 0 ELSE weight END), 7) AS value FROM b GROUP BY length_bin, age")
def heatmap(spark, d):
    out = presentation.heatmap(P.aged(spark, d), "value", exclude={"sex": ["unsexed"]}, replace={"value": 0.0})
    return out.withColumn("value", F.round("value", 7))


@query("SELECT p_partkey, round(25 + (greatest(1000, least(1500, p_retailprice)) - 1000) / 500 * 225, 6) AS size FROM part")
def marker_sizes(spark, d):
    return R.table(spark, d, "part").select("p_partkey", F.round(presentation.scale_sizes(F.col("p_retailprice"), 1000.0, 1500.0), 6).alias("size"))


@query(f"WITH {G.POS}, p AS (SELECT DISTINCT transect_num, longitude AS x, latitude AS y FROM pos) SELECT transect_num, CAST(count(*) AS INTEGER) AS n, arg_min(y, (x, y)) AS first_y, arg_max(y, (x, y)) AS last_y FROM p GROUP BY transect_num HAVING count(*) > 1")
def transect_lines(spark, d):
    lines = presentation.transect_lines(G.positions(spark, d))
    return lines.select("transect_num", F.size("points").alias("n"), F.element_at("points", 1)["y"].alias("first_y"), F.element_at("points", -1)["y"].alias("last_y"))


@query(f"WITH {G.POS} SELECT transect_num, round(avg(longitude), 8) AS longitude, round(avg(latitude), 8) AS latitude FROM pos GROUP BY transect_num")
def transect_labels(spark, d):
    out = presentation.transect_labels(G.positions(spark, d))
    return out.select("transect_num", F.round("longitude", 8).alias("longitude"), F.round("latitude", 8).alias("latitude"))


@query(f"""WITH {R.POINTS}, bl AS (SELECT floor(x / 4) AS i, floor(y / 4) AS j, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY 1, 2),
nd AS (SELECT DISTINCT i + a AS i, j + b AS j FROM bl, range(-2, 3) s(a), range(-2, 3) t(b)), c AS (SELECT nd.i, nd.j, bl.z, row_number() OVER (PARTITION BY nd.i, nd.j ORDER BY sqrt(((nd.i + 0.5) * 4 - x) ** 2 + ((nd.j + 0.5) * 4 - y) ** 2)) AS k FROM nd, bl WHERE sqrt(((nd.i + 0.5) * 4 - x) ** 2 + ((nd.j + 0.5) * 4 - y) ** 2) <= 4.3)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(avg(z), 6) AS z FROM c WHERE k <= 1 GROUP BY i, j""")
def interpolation_mesh(spark, d):
    out = presentation.interpolation_mesh(R.points(spark, d), "x", "y", "z", 4.0, 4.3, 1)
    return out.select("i", "j", F.round("z", 6).alias("z"))


@query(f"{P.W}, f AS (SELECT sex, length_bin, sum(weight) AS v FROM b GROUP BY ALL), g AS (SELECT sex, length_bin + 4 AS length_bin, sum(weight) AS v FROM b GROUP BY ALL) SELECT sex, length_bin, round(log10(1 + coalesce(f.v, 0)), 7) AS first, round(log10(1 + coalesce(g.v, 0)), 7) AS second, round(log10(1 + coalesce(f.v, 0)) - log10(1 + coalesce(g.v, 0)), 7) AS difference FROM f FULL JOIN g USING (sex, length_bin)")
def table_differences(spark, d):
    a = P.aged(spark, d)
    out = presentation.table_differences(a, a.withColumn("length_bin", F.col("length_bin") + 4), ["sex", "length_bin"], "value", log=True)
    return out.withColumns({c: F.round(c, 7) for c in ("first", "second", "difference")})


@query(f"{P.W} SELECT stratum, sex, round(sum(weight), 7) AS weight, sum(length) AS length FROM b GROUP BY stratum, sex")
def grouped_table(spark, d):
    return presentation.grouped_table(P.fish(spark, d), ["stratum", "sex"], ["weight", "length"]).withColumn("weight", F.round("weight", 7))


@query(f"{P.W} SELECT length_bin, round(coalesce(sum(weight) FILTER (sex = 'male'), 0), 7) AS male, round(coalesce(sum(weight) FILTER (sex = 'female'), 0), 7) AS female, CAST(0 AS DOUBLE) AS \"none\" FROM b GROUP BY length_bin")
def pivot_table(spark, d):
    out = presentation.pivot_table(P.fish(spark, d), ["length_bin"], "sex", ["male", "female", "none"], "weight")
    return out.withColumns({c: F.round(c, 7) for c in ("male", "female")})


@query("""SELECT CAST(t AS DOUBLE) AS transect_num, CASE WHEN t <= 119 THEN 1 WHEN t <= 127 THEN 2 ELSE 3 END AS mesh_region, t + CASE WHEN t BETWEEN 121 AND 127 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS transect_lower_bound, t + CASE WHEN t BETWEEN 121 AND 127 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS transect_upper_bound FROM range(1, 146) r(t) WHERE t NOT IN (120, 128)""")
def mesh_regions(spark, d):
    return regions.mesh_regions(spark, 2019)


@query(f"""WITH {G.POS}, e AS (SELECT transect_num, arg_min((longitude, latitude), longitude) AS w, arg_max((longitude, latitude), longitude) AS o, min(latitude) AS s FROM (SELECT DISTINCT transect_num, longitude, min(latitude) OVER (PARTITION BY transect_num, longitude) AS latitude FROM pos) GROUP BY transect_num) SELECT transect_num, CASE WHEN transect_num % 2 = 0 THEN w[1] ELSE o[1] END AS longitude FROM e""")
def transect_ends(spark, d):
    rows = G.positions(spark, d).withColumn("bound", F.col("transect_num") + F.when(F.col("transect_num") % 2 == 0, 0.1).otherwise(0.4))
    return cropping.transect_end(rows, "bound", ("longitude", "latitude")).drop("latitude")
