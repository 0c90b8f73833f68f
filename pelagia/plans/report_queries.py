"""Queries of reports and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.inversion import scattering
from pelagia.inversion.matrix import backscatter, invert, misfit
from pelagia.inversion.parameters import InvParameters
from pelagia.plans import roles as R
from pelagia.plans.registry import query
from pelagia.plans.source_queries import folder
from pelagia.reports import compare, tables
from pelagia.reports.reporter import Reporter
from pelagia.sources.sheets import write_sheets
from pelagia.sources.xlsx import read_xlsx

BINS = "b AS (SELECT haul_num % 12 AS haul_num, sex, age, length, weight, stratum, 2 + (ceil(length / 4) - 1) * 4 AS length_bin FROM specimen)"
W = f"WITH {R.SPECIMEN}, {BINS}"


def fish(spark, d):
    return R.specimen(spark, d).withColumn("haul_num", F.col("haul_num") % 12).withColumn("length_bin", 2 + (F.ceil(F.col("length") / 4) - 1) * 4.0)


def aged(spark, d):
    return fish(spark, d).select("sex", "length_bin", F.col("age").alias("age_bin"), F.col("weight").alias("value"), "stratum")


def unaged(spark, d):
    return fish(spark, d).select("sex", "length_bin", (F.col("weight") * 0.5).alias("value"))


AGES = ", ".join(f"coalesce(sum(weight) FILTER (age = {a}), 0) AS a{a}" for a in range(1, 8))


@query(f"{W} SELECT length_bin, {', '.join(f'round(a{a}, 7) AS a{a}' for a in range(1, 8))}, round(u, 7) AS unaged, round(CASE WHEN g = 0 THEN u * 3 END, 7) AS subtotal FROM (SELECT length_bin, {AGES}, sum(weight) * 0.5 AS u, grouping(length_bin) AS g FROM b WHERE sex = 'male' GROUP BY ROLLUP (length_bin))")
def age_length_table(spark, d):
    out = tables.age_length_table(aged(spark, d), "male", unaged(spark, d), ages=range(1, 8))
    return out.select("length_bin", *[F.round(str(a), 7).alias(f"a{a}") for a in range(1, 8)], F.round(tables.UNAGED, 7).alias("unaged"), F.round(tables.SUBTOTAL, 7).alias("subtotal"))


@query(f"""{W}, c AS (SELECT sex, length_bin, haul_num, count(*) + sum(age) AS count FROM b WHERE sex <> 'unsexed' GROUP BY ALL UNION ALL SELECT 'all', length_bin, haul_num, count(*) + sum(age) FROM b GROUP BY ALL)
SELECT sex, length_bin, haul_num, CAST(sum(count) AS BIGINT) AS count, CAST(grouping(length_bin) AS INTEGER) AS all_lengths, CAST(grouping(haul_num) AS INTEGER) AS all_hauls FROM c GROUP BY GROUPING SETS ((sex, length_bin, haul_num), (sex, length_bin), (sex, haul_num), (sex))""")
def haul_counts(spark, d):
    f = fish(spark, d)
    return tables.haul_margins(tables.haul_counts(f, f.withColumn("length_count", F.col("age")))).withColumns({c: F.col(c).cast("int") for c in ("all_lengths", "all_hauls")})


GEO = "geo AS (SELECT o_orderkey AS transect_num, CAST(o_custkey % 60 AS DOUBLE) AS latitude, CAST(-o_custkey AS DOUBLE) AS longitude, CASE WHEN o_custkey % 3 = 0 THEN 'O' WHEN o_custkey % 3 = 1 THEN 'F' ELSE 'X' END AS stratum, o_totalprice AS biomass, o_totalprice * 0.25 AS biomass_male FROM orders)"


def geodata(spark, d):
    o = R.table(spark, d, "orders")
    s = F.when(F.col("o_custkey") % 3 == 0, "O").when(F.col("o_custkey") % 3 == 1, "F").otherwise("X")
    return o.select(F.col("o_orderkey").alias("transect_num"), (F.col("o_custkey") % 60).cast("double").alias("latitude"), (-F.col("o_custkey")).cast("double").alias("longitude"), s.alias("stratum"), F.col("o_totalprice").alias("biomass"), (F.col("o_totalprice") * 0.25).alias("biomass_male"))


def weights(spark, d):
    return fish(spark, d).groupBy("stratum", "sex", F.col("age").alias("age_bin")).agg(F.sum("weight").alias("weight"))


SHARES = "k AS (SELECT stratum, sex, age, CASE WHEN age = 1 THEN 0 ELSE w + w * coalesce(sum(w) FILTER (age = 1) OVER (PARTITION BY stratum, sex), 0) / sum(w) FILTER (age > 1) OVER (PARTITION BY stratum, sex) END AS w FROM (SELECT stratum, sex, age, sum(weight) AS w FROM b GROUP BY ALL)), sh AS (SELECT stratum, age, sum(w) / sum(sum(w)) OVER (PARTITION BY stratum) AS s FROM k WHERE sex IN ('male', 'female') GROUP BY stratum, age)"


@query(f"{W}, {GEO}, {SHARES} SELECT transect_num AS \"Transect\", latitude AS \"Lat\", geo.stratum, biomass AS wgt_total, " + ", ".join(f"round(log10(nullif(biomass * max(s) FILTER (age = {a}), 0)), 7) AS a{a}" for a in (1, 2, 7)) + " FROM geo LEFT JOIN sh ON sh.stratum = geo.stratum GROUP BY transect_num, latitude, longitude, geo.stratum, biomass")
def aged_biomass(spark, d):
    shares = tables.age_shares(weights(spark, d), "stratum", "all", {"age_bin": [1]}, True)
    out = tables.aged_biomass(geodata(spark, d), shares, "stratum", "all", ["transect_num", "latitude", "longitude"], [1, 2, 7])
    return out.select("Transect", "Lat", "stratum", "wgt_total", *[F.round(F.log10(str(a)), 7).alias(f"a{a}") for a in (1, 2, 7)])


@query(f"{W}, {GEO}, {SHARES} SELECT geo.stratum, transect_num, round(log10(biomass_male * max(m)), 7) AS age_2 FROM geo LEFT JOIN (SELECT stratum, sum(weight) FILTER (age = 2) / sum(weight) AS m FROM b WHERE sex = 'male' GROUP BY stratum) USING (stratum) GROUP BY geo.stratum, transect_num, biomass_male")
def aged_biomass_male(spark, d):
    shares = tables.age_shares(weights(spark, d), "stratum", "male")
    out = tables.aged_biomass(geodata(spark, d).withColumn("id", F.col("transect_num")), shares, "stratum", "male", ["id"], [2])
    return out.select("stratum", F.col("id").alias("transect_num"), F.round(F.log10("2"), 7).alias("age_2"))


SIGMA = "sg AS (SELECT DISTINCT stratum AS s, CASE stratum WHEN 'O' THEN CAST(2e-4 AS DOUBLE) ELSE CAST(3e-4 AS DOUBLE) END AS sigma_bs FROM b)"


def sigma(spark, d):
    return fish(spark, d).select(F.col("stratum").alias("s")).distinct().withColumn("sigma_bs", F.when(F.col("s") == "O", 2e-4).otherwise(3e-4))


@query(f"{W}, {GEO}, {SIGMA} SELECT longitude AS \"Lon\", latitude AS \"Lat\", stratum, biomass_male AS wgt_male, biomass AS wgt_total, round(4 * pi() * sigma_bs, 9) AS sig_b, CAST(0.5 AS DOUBLE) AS \"krig_CV\", biomass * 0.5 AS \"krig_SD\" FROM geo LEFT JOIN sg ON s = stratum")
def mesh_results(spark, d):
    out = tables.mesh_results(geodata(spark, d).withColumn("cell_cv", F.lit(0.5)), "stratum", "biomass", sigma(spark, d), "s")
    return out.withColumn("sig_b", F.round("sig_b", 9))


def full(spark, d):
    """Transect rows with every column of the report."""
    rows = geodata(spark, d).withColumnRenamed("stratum", "ks")
    have = set(rows.columns) | {"stratum", "sig_b", "wgt_per_fish"}
    return rows.withColumns({c: F.col("biomass") * (k + 1) for k, c in enumerate(tables.POPULATION_COLUMNS) if c not in have})


@query(f"{W}, {GEO}, {SIGMA} SELECT transect_num AS \"Transect\", stratum, biomass * 2 AS \"Region ID\", biomass * 29 / 29 AS wgt_total, round(4 * pi() * sigma_bs, 9) AS sig_b, CASE stratum WHEN 'O' THEN CAST(0.5 AS DOUBLE) END AS wgt_per_fish FROM geo LEFT JOIN sg ON s = stratum")
def population_results(spark, d):
    w = spark.createDataFrame([("O", "all", 0.5), ("O", "male", 0.4), ("F", "male", 0.3)], "ks string, sex string, average_weight double")
    out = tables.population_results(full(spark, d), w, sigma(spark, d).withColumnRenamed("s", "ks"), "ks")
    return out.select("Transect", "stratum", "Region ID", "wgt_total", F.round("sig_b", 9).alias("sig_b"), "wgt_per_fish")


@query(f"{W} SELECT sex, 'abundance' AS quantity, length_bin AS row, CAST(age AS VARCHAR) AS \"column\", round(sum(weight), 7) AS value FROM b WHERE sex = 'male' GROUP BY ALL UNION ALL SELECT 'male', 'abundance', length_bin, 'Un-aged', round(sum(weight) * 0.5, 7) FROM b WHERE sex = 'male' GROUP BY length_bin UNION ALL SELECT 'female', 'abundance', length_bin, CAST(age AS VARCHAR), round(sum(weight), 7) FROM b WHERE sex = 'female' GROUP BY length_bin, age UNION ALL SELECT 'female', 'abundance', length_bin, 'Un-aged', round(sum(weight) * 0.5, 7) FROM b WHERE sex = 'female' GROUP BY length_bin")
def abundance_workbook(spark, d):
    """A workbook of length-by-age tables, read back as a report."""
    path = Reporter(folder(spark)).transect_length_age_abundance_report("ages.xlsx", {s: s for s in tables.SEXES}, {"aged": aged(spark, d), "unaged": unaged(spark, d)})
    rows = compare.read_pivot_report(spark, path)
    return rows.where("sex <> 'all' AND value <> 0").withColumn("value", F.round("value", 7))


@query(f"{W} SELECT round(log10(sum(weight) * 1.5), 7) AS aged_total, round(log10(sum(weight) * 1.5 * (1 - sum(weight) FILTER (age = 1) / sum(weight))), 7) AS older_total, round(log10(sum(weight) * 1.5), 7) AS both_sexes FROM b WHERE sex IN ('male', 'female')")
def abundance_totals(spark, d):
    """The lines of totals below the table of all."""
    path = Reporter(folder(spark)).transect_length_age_abundance_report("ages.xlsx", {s: s for s in tables.SEXES}, {"aged": aged(spark, d), "unaged": unaged(spark, d)})
    cells = read_xlsx(spark, path, "all", header=False)
    one, two = cells.where("_c0 = 'Total (age1+)'"), cells.where("_c0 = 'Total (age2+)'")
    number = lambda c: F.round(F.log10(F.col(c).cast("double")), 7)
    return one.select(number("_c1").alias("aged_total"), number("_c7").alias("both_sexes")).crossJoin(two.select(number("_c1").alias("older_total")))


@query("""WITH r AS (SELECT 'transect' AS report_type, CAST(2000 + n_regionkey AS INTEGER) AS year, n_nationkey AS n FROM nation)
SELECT report_type, year, 'biomass' AS "column", CAST(sum(n) * 2.0 AS DOUBLE) AS first, CAST(sum(n) AS DOUBLE) AS second, CAST(sum(n) AS DOUBLE) AS difference, CAST(CASE WHEN sum(n) > 0 THEN 50 END AS DOUBLE) AS percent FROM r GROUP BY report_type, year
UNION ALL SELECT report_type, year, 'abundance', CAST(sum(n) AS DOUBLE), CAST(sum(n) AS DOUBLE), CAST(0 AS DOUBLE), CAST(CASE WHEN sum(n) > 0 THEN 0 END AS DOUBLE) FROM r GROUP BY report_type, year""")
def dataset_differences(spark, d):
    """Two datasets of a workbook a year, written, read through the parquet copies and compared."""
    from pelagia.sources.xlsx import write_xlsx

    path, files = folder(spark), {}
    nation = R.table(spark, d, "nation")
    for year in range(5):
        rows = nation.where(F.col("n_regionkey") == year)
        for name, times in (("first", 2.0), ("second", 1.0)):
            files[name, "transect", 2000 + year] = f"{path}/{name}-{year}.xlsx"
            write_xlsx(spark, files[name, "transect", 2000 + year], {"Sheet1": rows.select(F.col("n_nationkey").alias("Lat"), F.col("n_nationkey").alias("Lon"), F.col("n_nationkey").alias("ntk_total"), (F.col("n_nationkey") * times).alias("wgt_total"))})
    compare.load_reports(spark, files, f"{path}/cache")
    return compare.dataset_differences(compare.load_reports(spark, files, f"{path}/cache"), "first", "second", ["biomass", "abundance"])


@query("SELECT CAST(n_nationkey AS INTEGER) AS year, count(*) AS n, round(sum(c_acctbal), 4) AS biomass, CAST(sum(c_custkey) AS DOUBLE) AS abundance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def reports_in_one_scan(spark, d):
    """A report per nation, of all its customers, read back together."""
    path, files = folder(spark), {}
    customers = R.table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("Lat"), F.col("c_custkey").alias("Lon"), F.col("c_custkey").alias("ntk_total"), F.col("c_acctbal").alias("wgt_total"))
    for nation in sorted(r[0] for r in R.table(spark, d, "nation").select("n_nationkey").collect()):  # 25 rows
        files["first", "transect", nation] = f"{path}/{nation}.xlsx"
        write_sheets(spark, files["first", "transect", nation], {"Sheet1": customers.where(F.col("c_nationkey") == nation).drop("c_nationkey")})
    return compare.load_reports(spark, files).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("biomass"), 4).alias("biomass"), F.sum("abundance").alias("abundance"))


@query("""WITH a AS (SELECT s_nationkey AS k, sum(s_suppkey) AS x, min(s_suppkey) AS longitude FROM supplier GROUP BY 1), b AS (SELECT n_nationkey AS k, sum(n_regionkey) AS y, min(n_nationkey) AS longitude FROM nation GROUP BY 1)
SELECT 'a' AS side, k, CAST(x AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, longitude FROM a UNION ALL SELECT 'b', k, CAST(0 AS BIGINT), CAST(y AS BIGINT), longitude FROM b""")
def align_tables(spark, d):
    a = R.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("x"), F.col("s_suppkey").alias("longitude"))
    b = R.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("y"), F.col("n_nationkey").cast("long").alias("longitude"))
    x, y = compare.align(a, b, ["k"])
    cols = [F.col("k"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("longitude").cast("long").alias("longitude")]
    return x.select(F.lit("a").alias("side"), *cols).unionByName(y.select(F.lit("b").alias("side"), *cols))


@query("SELECT p_partkey, round(2 * pi() * p_retailprice * 100 / 1500, 6) AS wavenumber, round((1 - g * h * h) / (g * h * h) - (g - 1) / g, 9) AS reflection FROM (SELECT *, 1 + p_size * CAST(0.001 AS DOUBLE) AS g, 1 + p_size * CAST(0.002 AS DOUBLE) AS h FROM part)")
def scattering_terms(spark, d):
    p = R.table(spark, d, "part").select("p_partkey", "p_retailprice", (1 + F.col("p_size") * 0.001).alias("g"), (1 + F.col("p_size") * 0.002).alias("h"))
    return p.select("p_partkey", F.round(scattering.wavenumber(F.col("p_retailprice") * 100, 1500.0), 6).alias("wavenumber"), F.round(scattering.reflection_coefficient(F.col("g"), F.col("h")), 9).alias("reflection"))


SCATTERER = {"length_sd_norm": 0.1, "length_radius_ratio": 16.0, "taper_order": 10.0, "radius_of_curvature_ratio": 3.0, "theta_mean": 10.0, "theta_sd": 20.0, "g": 1.03, "h": 1.03}
FREQUENCIES = {38e3: "sv_38", 70e3: "sv_70", 120e3: "sv_120", 200e3: "sv_200"}
WATER = {"sound_speed_sw": 1500.0, "orientation": {"bins": 16}, "lengths": {"bins": 40}}
#: A swarm of each supplier: mean length and density of its animals.
SWARMS = "swarms AS (SELECT s_suppkey, CAST(0.012 AS DOUBLE) + s_suppkey % 97 * CAST(0.00015 AS DOUBLE) AS length_mean, 100 + s_suppkey % 83 * CAST(8 AS DOUBLE) AS number_density FROM supplier)"


def swarms(spark, d):
    """Their backscatter by the model, dealt widely: a row has few bytes and much work."""
    s = R.table(spark, d, "supplier").select("s_suppkey", (0.012 + F.col("s_suppkey") % 97 * 0.00015).alias("length_mean"), (100 + F.col("s_suppkey") % 83 * 8.0).alias("number_density"))
    s = s.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    return backscatter(s, FREQUENCIES, ["length_mean", "number_density"], WATER, SCATTERER, keep=["s_suppkey", "length_mean", "number_density"])


@query(f"WITH {SWARMS} SELECT s_suppkey, round(length_mean, 7) AS length_mean, round(number_density, 3) AS number_density, CAST(0 AS DOUBLE) AS q FROM swarms")
def scattering_inversion(spark, d):
    """Length and density of each swarm found again from its backscatter alone, whole batches at once."""
    p = InvParameters({k: {"value": v, "vary": False} for k, v in SCATTERER.items()} | {"length_mean": {"value": 0.018, "min": 0.008, "max": 0.03}, "number_density": {"value": 300.0, "min": 10.0, "max": 1000.0}})
    out = invert(swarms(spark, d).drop("length_mean", "number_density"), FREQUENCIES, p, WATER, {"monte_carlo": True, "mc_realizations": 24, "mc_seed": 7}, {"method": "least_squares"}, keep=["s_suppkey"])
    return out.select("s_suppkey", F.round("length_mean", 7).alias("length_mean"), F.round("number_density", 3).alias("number_density"), F.round("Q", 3).alias("q"))


@query(f"WITH {SWARMS} SELECT s_suppkey, round(4 * 10 * log10(2), 6) AS q FROM swarms")
def scattering_misfit(spark, d):
    """The deviation of the model at half of each swarm's density: 3.01 dB at each of four frequencies."""
    rows = swarms(spark, d).withColumn("number_density", F.col("number_density") / 2)
    return misfit(rows, FREQUENCIES, ["length_mean", "number_density"], WATER, SCATTERER, keep=["s_suppkey"]).select("s_suppkey", F.round("Q", 6).alias("q"))
