"""Queries of the cleaning and strata operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.operators import cleaning, strata
from pelagia.plans import roles as R
from pelagia.plans.registry import query
from pelagia.plans.source_queries import folder
from pelagia.sources.sheets import write_sheets


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_quantity > 10 AND l_quantity <= 30 AND NOT coalesce(l_linestatus IN ('F'), false)")
def apply_filters(spark, d):
    rows = cleaning.apply_filters(R.table(spark, d, "lineitem"), {"l_returnflag": ["A", "N"], "l_quantity": (10, 30)}, {"l_linestatus": ["F"]})
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("SELECT p_partkey, CAST(CASE WHEN x >= 0 THEN floor(x + 0.5) ELSE ceil(x - 0.5) END AS DOUBLE) AS r FROM (SELECT p_partkey, (p_size - 25) * CAST(0.5 AS DOUBLE) AS x FROM part)")
def round_half_up(spark, d):
    return R.table(spark, d, "part").select("p_partkey", cleaning.round_half_up((F.col("p_size") - 25) * 0.5).alias("r"))


@query("SELECT c_custkey, c_nationkey AS ship, CAST(c_custkey + CASE c_nationkey WHEN 2 THEN 100 ELSE 0 END AS BIGINT) AS haul_num, c_mktsegment AS species_code FROM customer WHERE ((c_nationkey = 1 AND c_custkey % 3 IN (0, 1)) OR c_nationkey = 2) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def ship_survey_filter(spark, d):
    rows = R.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("ship"), (F.col("c_custkey") % 3).alias("survey"), F.col("c_custkey").alias("haul_num"), F.col("c_mktsegment").alias("species_code"))
    return cleaning.ship_survey_filter(rows, {1: {"survey": [0, 1]}, 2: {"haul_offset": 100}}, ["BUILDING", "MACHINERY"]).drop("survey")


@query("SELECT c_custkey, coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END, c_mktsegment) AS c_mktsegment FROM customer")
def label_map(spark, d):
    return cleaning.map_labels(R.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), {"c_mktsegment": {"BUILDING": "b", "MACHINERY": "m"}})


@query("""WITH k AS (SELECT DISTINCT * FROM (SELECT s_nationkey AS ship, s_suppkey AS haul_num FROM supplier UNION ALL SELECT c_nationkey, c_custkey FROM customer)),
u AS (SELECT *, concat_ws('-', CAST(ship AS VARCHAR), CAST(CASE WHEN haul_num - 50 > 0 THEN haul_num - 50 ELSE haul_num END AS VARCHAR)) AS uid FROM k)
SELECT o_orderkey, ship, haul_num, uid FROM (SELECT o_orderkey, CAST(o_custkey % 25 AS INTEGER) AS ship, o_custkey % 100 AS haul_num FROM orders) LEFT JOIN u USING (ship, haul_num)""")
def composite_key(spark, d):
    a = R.table(spark, d, "supplier").select(F.col("s_nationkey").alias("ship"), F.col("s_suppkey").alias("haul_num"))
    b = R.table(spark, d, "customer").select(F.col("c_nationkey").alias("ship"), F.col("c_custkey").alias("haul_num"))
    key = cleaning.composite_key([a, b], ["ship", "haul_num"], {"haul_num": -50})
    rows = R.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("ship"), (F.col("o_custkey") % 100).alias("haul_num"))
    return cleaning.apply_composite_key(rows, key)


@query("SELECT s_suppkey AS haul_num, concat_ws('-', CASE WHEN s_suppkey - 20 >= 0 THEN '2' ELSE '1' END, CASE WHEN s_suppkey - 20 >= 0 THEN '2' ELSE '1' END, '99999', CAST(CASE WHEN s_suppkey - 20 >= 0 THEN s_suppkey - 20 ELSE s_suppkey END AS VARCHAR)) AS uid FROM supplier")
def uid_construct(spark, d):
    return cleaning.haul_uid(R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("haul_num")), can_haul_offset=20)


@query("SELECT p_partkey, trim(replace(p_name, '\"', '')) AS region_name, lower(trim(replace(p_type, '\"', ''))) AS region_class FROM part")
def cells_clean(spark, d):
    quoted = R.table(spark, d, "part").select("p_partkey", F.concat(F.lit(' "'), "p_name", F.lit('"')).alias("region_name"), F.concat(F.lit('"'), F.upper("p_type"), F.lit('" ')).alias("region_class"))
    return cleaning.clean_cells(quoted)


@query(r"""WITH p AS (SELECT p_partkey, p_brand AS region_name FROM part),
a AS (SELECT *, CASE WHEN regexp_matches(region_name, '(?i)brand') THEN 'B' END AS cls, CASE WHEN regexp_matches(region_name, '(?i)brand') THEN regexp_extract(region_name, '(?i)brand', 0) END AS m FROM p),
b AS (SELECT *, CASE WHEN m IS NULL THEN region_name ELSE substr(region_name, 1, instr(region_name, m) - 1) || substr(region_name, instr(region_name, m) + length(m)) END AS rest FROM a)
SELECT region_name, p_partkey, cls AS region_class, CASE WHEN regexp_matches(rest, '[0-9]+') THEN regexp_extract(rest, '[0-9]+', 0) END AS haul_num FROM b""")
def region_parse(spark, d):
    rows = R.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("region_name"))
    return cleaning.parse_regions(rows, {"region_class": {"brand": "B"}, "haul_num": {"[0-9]+": None}})


@query("SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN 'CAN' END AS country, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) + CASE WHEN p_brand LIKE '%1' THEN 200 ELSE 0 END AS haul_num FROM part")
def region_types(spark, d):
    rows = R.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("region_name"))
    parsed = cleaning.parse_regions(rows, {"haul_num": {"[0-9]+": None}})
    return cleaning.typed_regions(parsed.withColumn("country", F.when(F.col("region_name").endswith("1"), "CAN")), 200.0).drop("region_name")


FILES = "files AS (SELECT c_custkey AS path, c_nationkey * 60 + c_custkey % 60 AS transect_num, c_mktsegment AS file_type FROM customer)"


@query(f"WITH {FILES}, g AS (SELECT transect_num FROM files GROUP BY transect_num HAVING count(*) FILTER (file_type = 'BUILDING') = 1 AND count(*) FILTER (file_type = 'MACHINERY') = 1) SELECT * FROM files WHERE transect_num IN (SELECT transect_num FROM g)")
def transect_fileset_valid(spark, d):
    files = R.table(spark, d, "customer").select(F.col("c_custkey").alias("path"), (F.col("c_nationkey") * 60 + F.col("c_custkey") % 60).alias("transect_num"), F.col("c_mktsegment").alias("file_type"))
    return cleaning.valid_filesets(files, ["BUILDING", "MACHINERY"])


@query("""SELECT l_orderkey AS interval, l_linenumber AS layer, l_extendedprice AS nasc, o_custkey AS transect_num, r_name AS layer_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN region ON l_linenumber = r_regionkey WHERE l_extendedprice IS NOT NULL""")
def natural_merge(spark, d):
    cells = R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("interval"), F.col("l_linenumber").alias("layer"), F.col("l_extendedprice").alias("nasc"))
    ivals = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("interval"), F.col("o_custkey").alias("transect_num")).withColumn("interval", F.col("interval"))
    layers = R.table(spark, d, "region").select(F.col("r_regionkey").alias("layer"), F.col("r_name").alias("layer_name"))
    return cleaning.merge_exports(ivals, cells, layers).select("interval", "layer", "nasc", "transect_num", "layer_name").where("transect_num IS NOT NULL")


CELLS = """cells AS (SELECT user_id % 40 AS transect_num, event_id // 4 AS interval, CAST(event_id % 5 AS INTEGER) AS region_id, user_id % 9 AS haul_num, event_type AS region_class, value AS nasc,
 event_id % 13 * CAST(1 AS DOUBLE) AS layer_depth_min, event_id % 13 + CAST(10 AS DOUBLE) AS layer_depth_max, event_id AS seq FROM events)"""


def cells(spark, d):
    return R.table(spark, d, "events").select(
        (F.col("user_id") % 40).alias("transect_num"), F.expr("event_id div 4").alias("interval"), (F.col("event_id") % 5).cast("int").alias("region_id"), (F.col("user_id") % 9).alias("haul_num"), F.col("event_type").alias("region_class"), F.col("value").alias("nasc"),
        (F.col("event_id") % 13 * 1.0).alias("layer_depth_min"), (F.col("event_id") % 13 + 10.0).alias("layer_depth_max"), F.col("event_id").alias("seq"),
    )


@query(f"WITH {CELLS} SELECT transect_num, haul_num, region_id, arg_min(region_class, seq) AS region_class FROM cells WHERE lower(region_class) IN ('click', 'view') GROUP BY ALL")
def region_haul_key(spark, d):
    return cleaning.region_haul_key(cells(spark, d).select("transect_num", "haul_num", "region_id", "region_class", "seq"), ["click", "view"])


DEPTHS = "SELECT transect_num, interval, max(layer_depth_max) AS max_depth, (min(layer_depth_min) + max(layer_depth_max)) / 2 AS layer_mean_depth, max(layer_depth_max) - min(layer_depth_min) AS layer_height FROM {} GROUP BY transect_num, interval"


@query(f"WITH {CELLS} {DEPTHS.format('cells')}")
def layer_depths(spark, d):
    return cleaning.layer_depths(cells(spark, d))


@query(f"""WITH {CELLS}, r AS (SELECT * FROM cells WHERE lower(region_class) IN ('click', 'view')), dp AS ({DEPTHS.format('r')}),
f AS (SELECT transect_num, interval, arg_min(region_id, seq) AS region_id, sum(nasc) AS nasc FROM r GROUP BY transect_num, interval),
k AS (SELECT transect_num, region_id, min(haul_num) AS haul_num FROM cells GROUP BY transect_num, region_id), j AS (SELECT * FROM f JOIN dp USING (transect_num, interval) JOIN k USING (transect_num, region_id)),
t AS (SELECT DISTINCT transect_num, interval FROM cells)
SELECT transect_num, interval, coalesce(region_id, 999) AS region_id, round(coalesce(nasc, 0), 6) AS nasc, coalesce(max_depth, 0) AS max_depth, coalesce(layer_mean_depth, 0) AS layer_mean_depth, coalesce(layer_height, 0) AS layer_height, coalesce(haul_num, 0) AS haul_num FROM t LEFT JOIN j USING (transect_num, interval)""")
def consolidate_intervals(spark, d):
    c = cells(spark, d)
    key = c.groupBy("transect_num", "region_id").agg(F.min("haul_num").alias("haul_num"))
    out = cleaning.consolidate(c, c.select("transect_num", "interval").distinct(), key, ["click", "view"])
    return out.withColumn("nasc", F.round("nasc", 6))


@query(f"""WITH {R.INTERVALS}, b AS (SELECT transect_num, avg(latitude) AS m, max(latitude) - min(latitude) AS r FROM intervals WHERE latitude < 45 GROUP BY transect_num),
a AS (SELECT DISTINCT transect_num FROM intervals), j AS (SELECT a.transect_num, m, r FROM a LEFT JOIN b USING (transect_num)),
s AS (SELECT transect_num, abs(lead(m) OVER w - lag(m) OVER w) AS gap, lag(r) OVER w AS r2, lead(r) OVER w AS r0 FROM j WINDOW w AS (ORDER BY transect_num))
SELECT interval, transect_num, round(CASE WHEN gap <= 2.0 * 20.0 * 1.1 / 30.0 AND r2 < 1 / 6 AND r0 < 1 / 6 THEN gap * 30.0 ELSE 20.0 END, 6) AS transect_spacing FROM intervals JOIN s USING (transect_num)""")
def transect_spacing(spark, d):
    return cleaning.transect_spacing(R.intervals(spark, d), 20.0, 45.0).select("interval", "transect_num", F.round("transect_spacing", 6).alias("transect_spacing"))


@query(f"""WITH {R.INTERVALS}, n AS (SELECT *, lead(distance_s) OVER (ORDER BY transect_num, interval) AS nx FROM intervals), x AS (SELECT *, coalesce(abs(distance_s - nx), distance_e - distance_s) AS dd FROM n),
m AS (SELECT quantile_cont(dd, 0.5) AS m FROM x) SELECT interval, round(CASE WHEN abs(dd - m) > 0.05 THEN distance_e - distance_s ELSE dd END, 6) AS distance_interval FROM x, m""")
def interval_distance(spark, d):
    return cleaning.interval_distance(R.intervals(spark, d)).select("interval", F.round("distance_interval", 6).alias("distance_interval"))


@query(f"""WITH {R.INTERVALS}, b AS (SELECT transect_num, interval, CASE WHEN hash_bad THEN NULL ELSE longitude END AS x, row_number() OVER (PARTITION BY transect_num ORDER BY interval) AS i FROM (SELECT *, interval % 5 = 0 OR interval % 11 = 3 AS hash_bad FROM intervals)),
w AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY transect_num ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi, min(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY transect_num ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ni FROM b),
e AS (SELECT transect_num, min(i) AS f, max(i) AS l FROM b WHERE x IS NOT NULL GROUP BY transect_num)
SELECT w.interval, round(CASE WHEN w.x IS NOT NULL THEN w.x WHEN w.pi IS NULL THEN xf.x - (f - w.i) * (xf1.x - xf.x) WHEN w.ni IS NULL THEN xl.x + (w.i - l) * (xl.x - xl1.x) ELSE p.x + (n.x - p.x) / (w.ni - w.pi) * (w.i - w.pi) END, 6) AS longitude
FROM w LEFT JOIN e USING (transect_num) LEFT JOIN b p ON p.transect_num = w.transect_num AND p.i = w.pi LEFT JOIN b n ON n.transect_num = w.transect_num AND n.i = w.ni LEFT JOIN b xf ON xf.transect_num = w.transect_num AND xf.i = f LEFT JOIN b xf1 ON xf1.transect_num = w.transect_num AND xf1.i = f + 1 LEFT JOIN b xl ON xl.transect_num = w.transect_num AND xl.i = l LEFT JOIN b xl1 ON xl1.transect_num = w.transect_num AND xl1.i = l - 1""")
def impute_coordinates(spark, d):
    bad = F.when((F.col("interval") % 5 == 0) | (F.col("interval") % 11 == 3), 999.0).otherwise(F.col("longitude"))
    rows = R.intervals(spark, d).withColumn("longitude", bad)
    return cleaning.impute_coordinates(rows, "longitude", "transect_num", "interval").select("interval", F.round("longitude", 6).alias("longitude"))


@query(f"""WITH {R.INTERVALS}, l AS (SELECT s_suppkey % 20 AS transect_num, s_suppkey * CAST(10 AS DOUBLE) AS log_start, s_suppkey * CAST(10 AS DOUBLE) + 200 AS log_end FROM supplier)
SELECT interval, transect_num FROM intervals i WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.transect_num = i.transect_num) OR EXISTS (SELECT 1 FROM l WHERE l.transect_num = i.transect_num AND distance_e >= log_start AND distance_s <= log_end)""")
def transect_interval_filter(spark, d):
    listed = R.table(spark, d, "supplier").select((F.col("s_suppkey") % 20).alias("transect_num"), (F.col("s_suppkey") * 10.0).alias("log_start"), (F.col("s_suppkey") * 10.0 + 200).alias("log_end"))
    return cleaning.filter_intervals(R.intervals(spark, d), listed).select("interval", "transect_num")


@query(f"""WITH {R.INTERVALS}, l AS (SELECT s_suppkey % 20 AS transect_num, s_suppkey * CAST(10 AS DOUBLE) AS log_start, s_suppkey * CAST(10 AS DOUBLE) + 200 AS log_end FROM supplier WHERE s_nationkey < 20)
SELECT interval, transect_num FROM intervals i WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.transect_num = i.transect_num) OR EXISTS (SELECT 1 FROM l WHERE l.transect_num = i.transect_num AND distance_e >= log_start AND distance_s <= log_end)""")
def transect_interval_file(spark, d):
    """The same by a sheet of a workbook, in its own column names, and a condition on the survey's column."""
    path = f"{folder(spark)}/ranges.xlsx"
    ranges = R.table(spark, d, "supplier").select((F.col("s_suppkey") % 20).alias("Transect"), (F.col("s_suppkey") * 10.0).alias("Log_Start"), (F.col("s_suppkey") * 10.0 + 200).alias("LOG_END"), F.col("s_nationkey").alias("Region_ID"))
    write_sheets(spark, path, {"notes": R.table(spark, d, "region"), "ranges": ranges})
    return cleaning.filter_intervals(R.intervals(spark, d), path, "region_id < 20", "ranges").select("interval", "transect_num")


@query(f"WITH {R.INTERVALS} SELECT transect_num, min(longitude) AS longitude, min(latitude) FILTER (longitude = m) AS latitude FROM (SELECT *, min(longitude) OVER (PARTITION BY transect_num) AS m FROM intervals WHERE latitude < 45) GROUP BY transect_num")
def western_extents(spark, d):
    return cleaning.western_extents(R.intervals(spark, d), threshold=45)


@query(f"WITH {R.SPECIMEN}, {R.HAULS} SELECT fish, age, haul_num, coalesce(CAST(h.stratum_num AS DOUBLE), 0) AS stratum_num FROM specimen LEFT JOIN (SELECT haul_num + 3 AS haul_num, stratum_num FROM hauls) h USING (haul_num)")
def strata_by_haul(spark, d):
    # shifted by three, so that the first three hauls have no stratum
    return strata.join_strata(R.specimen(spark, d).select("fish", "age", "haul_num"), R.hauls(spark, d).withColumn("haul_num", F.col("haul_num") + 3))


@query(f"WITH {R.SPECIMEN}, {R.HAULS} SELECT fish, age, uid, coalesce(CAST(h.stratum_num AS DOUBLE), 0) AS stratum_num FROM (SELECT *, concat_ws('-', '2', '2', '99999', CAST(haul_num AS VARCHAR)) AS uid FROM specimen) LEFT JOIN (SELECT stratum_num, concat_ws('-', '2', '2', '99999', CAST(haul_num AS VARCHAR)) AS uid FROM hauls) h USING (uid)")
def strata_by_uid(spark, d):
    key = cleaning.haul_uid(R.hauls(spark, d))
    return strata.join_strata(cleaning.haul_uid(R.specimen(spark, d)).select("fish", "age", "uid"), key, key="uid")


LIMITS = "limits AS (SELECT n_nationkey + 2 AS stratum_num, 30 + n_nationkey * CAST(0.7 AS DOUBLE) AS northlimit_latitude FROM nation)"


def limits(spark, d):
    return R.table(spark, d, "nation").select((F.col("n_nationkey") + 2).alias("stratum_num"), (30 + F.col("n_nationkey") * 0.7).alias("northlimit_latitude"))


@query(f"""WITH {R.INTERVALS}, {LIMITS}, b AS (SELECT stratum_num, coalesce(lag(northlimit_latitude) OVER (ORDER BY northlimit_latitude), -90) AS s, northlimit_latitude AS n FROM limits UNION ALL SELECT 1, max(northlimit_latitude), 90 FROM limits)
SELECT interval, latitude, b.stratum_num FROM intervals LEFT JOIN b ON latitude >= s AND latitude < n""")
def geostrata_latitude(spark, d):
    return strata.join_by_latitude(R.intervals(spark, d).select("interval", "latitude"), limits(spark, d))


@query(f"WITH {LIMITS} SELECT *, coalesce(lag(northlimit_latitude) OVER (ORDER BY northlimit_latitude), -90) AS lat_left, northlimit_latitude AS lat_right FROM limits")
def geostrata_bins(spark, d):
    return strata.band_table(limits(spark, d))


@query("SELECT o_orderkey, o_custkey % 300 AS haul_num FROM orders WHERE o_custkey % 300 IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 20)")
def specimen_only_hauls(spark, d):
    caught = R.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 300).alias("haul_num"))
    return strata.drop_specimen_only_hauls(caught, R.specimen(spark, d).where("length > 20"))


@query(f"""WITH {R.SPECIMEN}, v AS (SELECT haul_num % 40 AS k, avg(length) AS s FROM specimen WHERE haul_num % 40 NOT IN (0, 1, 7, 8, 20, 39) GROUP BY 1), a AS (SELECT DISTINCT haul_num % 40 AS k FROM specimen)
SELECT a.k AS stratum_num, round(coalesce(v.s, (coalesce((SELECT s FROM v l WHERE l.k < a.k ORDER BY l.k DESC LIMIT 1), (SELECT s FROM v h WHERE h.k > a.k ORDER BY h.k LIMIT 1)) + coalesce((SELECT s FROM v h WHERE h.k > a.k ORDER BY h.k LIMIT 1), (SELECT s FROM v l WHERE l.k < a.k ORDER BY l.k DESC LIMIT 1))) / 2), 6) AS sigma_bs FROM a LEFT JOIN v USING (k)""")
def impute_missing_strata(spark, d):
    fish = R.specimen(spark, d).withColumn("stratum_num", F.col("haul_num") % 40)
    values = fish.where(~F.col("stratum_num").isin(0, 1, 7, 8, 20, 39)).groupBy("stratum_num").agg(F.avg("length").alias("sigma_bs"))
    return strata.impute_strata(fish, values).select("stratum_num", F.round("sigma_bs", 6).alias("sigma_bs"))
