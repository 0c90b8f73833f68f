"""Queries of inversion, backscatter integration and selectivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.inversion.length_ts import InversionLengthTS
from pelagia.operators import acoustics
from pelagia.plans import roles as R
from pelagia.plans.registry import query

SIG = "pow(10, (20 * log10(length) - 68) / 10)"
HS = f"""al AS (SELECT stratum, haul_num, length, count(*) AS n FROM specimen GROUP BY ALL UNION ALL SELECT stratum, haul_num, length, sum(length_count) FROM lengths GROUP BY ALL),
hs AS (SELECT stratum, haul_num, sum({SIG} * n) / sum(n) AS sigma_bs, sum(n) AS n FROM al GROUP BY ALL)"""
W = f"WITH {R.SPECIMEN}, {R.LENGTHS}, {HS}"


def by_haul(spark, d):
    return acoustics.haul_sigma([R.specimen(spark, d), R.lengths(spark, d)], "stratum")


def logged(name):
    return F.round(F.log10(F.abs(name)), 7)


@query(f"{W} SELECT stratum, haul_num, round(log10(sigma_bs), 7) AS sigma_bs FROM hs")
def haul_sigma_bs(spark, d):
    return by_haul(spark, d).select("stratum", "haul_num", logged("sigma_bs").alias("sigma_bs"))


@query(f"{W} SELECT stratum, round(log10(avg(sigma_bs)), 7) AS by_haul, round(log10(sum(sigma_bs * n) / sum(n)), 7) AS by_fish FROM hs GROUP BY stratum")
def strata_sigma_bs(spark, d):
    h = by_haul(spark, d)
    a = acoustics.strata_sigma(h, "stratum").select("stratum", logged("sigma_bs").alias("by_haul"))
    return a.join(acoustics.strata_sigma(h, "stratum", False).select("stratum", logged("sigma_bs").alias("by_fish")), "stratum")


@query(f"{W}, {R.INTERVALS}, s AS (SELECT stratum, avg(sigma_bs) AS sigma_bs FROM hs GROUP BY stratum), x AS (SELECT * REPLACE (CASE WHEN interval % 3 = 0 THEN 'X' ELSE stratum END AS stratum) FROM intervals) SELECT interval, round(coalesce(nasc / (4 * pi() * sigma_bs), 0), 2) AS number_density FROM x LEFT JOIN s USING (stratum)")
def ts_invert(spark, d):
    sig = acoustics.strata_sigma(by_haul(spark, d), "stratum")
    # every third interval lies in a stratum without any fish
    rows = R.intervals(spark, d).withColumn("stratum", F.when(F.col("interval") % 3 == 0, "X").otherwise(F.col("stratum")))
    return acoustics.invert(rows, sig, "stratum").select("interval", F.round("number_density", 2).alias("number_density"))


@query("SELECT l_orderkey, l_linenumber, round(20 * log10(l_quantity) - 68, 9) AS ts FROM lineitem")
def ts_length(spark, d):
    return R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(acoustics.ts_length(F.col("l_quantity")), 9).alias("ts"))


SV = """raw AS (SELECT user_id % 10 AS transect_num, event_id // 20 AS interval, event_id % 7 AS layer, CAST(CASE event_type WHEN 'click' THEN 38 WHEN 'view' THEN 120 ELSE 200 END AS DOUBLE) AS frequency, -90 + value % 40 AS sv_mean,
 5 + (event_id % 3) * CAST(1 AS DOUBLE) AS thickness_mean, -120 + (event_id % 50) * CAST(0.1 AS DOUBLE) AS longitude, 30 + (event_id % 40) * CAST(0.1 AS DOUBLE) AS latitude, event_id FROM events),
lin AS (SELECT *, pow(10, sv_mean / 10) AS lin, 4 * pi() * 1852.0 ** 2 * pow(10, sv_mean / 10) * thickness_mean AS nasc FROM raw WHERE NOT (frequency = 38 AND (sv_mean < -85 OR sv_mean > -55)))"""


def raw_sv(spark, d):
    freq = F.when(F.col("event_type") == "click", 38.0).when(F.col("event_type") == "view", 120.0).otherwise(200.0)
    return R.table(spark, d, "events").select(
        (F.col("user_id") % 10).alias("transect_num"), F.expr("event_id div 20").alias("interval"), (F.col("event_id") % 7).alias("layer"), freq.alias("frequency"), (-90 + F.col("value") % 40).alias("sv_mean"), (5 + (F.col("event_id") % 3) * 1.0).alias("thickness_mean"),
        (-120 + (F.col("event_id") % 50) * 0.1).alias("longitude"), (30 + (F.col("event_id") % 40) * 0.1).alias("latitude"), "event_id",
    )


def sv(spark, d):
    return acoustics.sv_threshold(raw_sv(spark, d), {38.0: (-85.0, -55.0)})


@query(f"WITH {SV} SELECT event_id, CASE WHEN frequency = 38 AND (sv_mean < -85 OR sv_mean > -55) THEN NULL ELSE sv_mean END AS sv_mean FROM raw")
def sv_threshold(spark, d):
    return sv(spark, d).select("event_id", "sv_mean")


@query(f"WITH {SV} SELECT event_id, round(log10(nasc), 7) AS log_nasc FROM lin")
def sv_to_nasc(spark, d):
    return acoustics.linear(sv(spark, d)).select("event_id", logged("nasc").alias("log_nasc"))


@query(f"WITH {SV} SELECT transect_num, interval, layer, frequency, round(avg(sv_mean), 6) AS sv_mean, round(avg(nasc), 4) AS nasc, round(avg(thickness_mean), 6) AS thickness_mean FROM lin GROUP BY ALL")
def sv_cells(spark, d):
    out = acoustics.sv_cells(sv(spark, d), ["transect_num", "interval", "layer"])
    return out.withColumns({"sv_mean": F.round("sv_mean", 6), "nasc": F.round("nasc", 4), "thickness_mean": F.round("thickness_mean", 6)})


@query(f"WITH {SV}, g AS (SELECT transect_num, interval, frequency, 10 * log10(sum(lin * thickness_mean)) AS s, sum(thickness_mean) AS t FROM lin WHERE frequency IN (38, 120) GROUP BY ALL) SELECT transect_num, interval, round(coalesce(max(s) FILTER (frequency = 38), -999), 6) AS sv_38, round(coalesce(max(s) FILTER (frequency = 120), -999), 6) AS sv_120, coalesce(max(t) FILTER (frequency = 38), 0) AS t_38, coalesce(max(t) FILTER (frequency = 120), 0) AS t_120 FROM g GROUP BY transect_num, interval")
def sv_interval(spark, d):
    wide = acoustics.widen(acoustics.sv_intervals(sv(spark, d), ["transect_num", "interval"]), ["transect_num", "interval"], [38.0, 120.0])
    return wide.select("transect_num", "interval", F.round("sv_mean_38", 6).alias("sv_38"), F.round("sv_mean_120", 6).alias("sv_120"), F.col("thickness_mean_38").alias("t_38"), F.col("thickness_mean_120").alias("t_120"))


@query(f"""WITH {SV}, w AS (SELECT *, 0.5 * thickness_mean AS a, sum(0.5 * thickness_mean) OVER p AS ta, sum(nasc) OVER p AS tn, sum(thickness_mean) OVER (PARTITION BY frequency, transect_num, interval) AS ti FROM lin WINDOW p AS (PARTITION BY frequency, transect_num))
SELECT frequency, transect_num, round(sum(longitude * nasc / tn), 6) AS longitude_weighted, round(sum(latitude * nasc / tn), 6) AS latitude_weighted, round(10 * log10(sum(lin * a / ta)), 6) AS sv_mean, round(log10(sum(nasc)), 7) AS log_nasc, round(avg(ti), 6) AS thickness_mean FROM w GROUP BY frequency, transect_num""")
def sv_transect(spark, d):
    out = acoustics.sv_transects(sv(spark, d), F.lit(0.5))
    return out.select("frequency", "transect_num", *[F.round(c, 6).alias(c) for c in ("longitude_weighted", "latitude_weighted", "sv_mean", "thickness_mean")], logged("nasc").alias("log_nasc"))


@query(f"WITH {R.SPECIMEN} SELECT fish, age, length, CASE WHEN sex <> 'unsexed' THEN round(log10(1 / greatest(1 / (1 + exp(2 * ln(3) * (CASE sex WHEN 'male' THEN 20 WHEN 'female' THEN 24.0 / 1.2 END - length) / CASE sex WHEN 'male' THEN 8 WHEN 'female' THEN 2 * ln(3) / 1.2 END)), 1e-12)), 7) END AS log_expansion FROM specimen")
def selectivity(spark, d):
    nets = {"male": {"l50": 20.0, "selection_range": 8.0}, "female": {"slope": 1.2, "intercept": -24.0}}
    out = acoustics.selectivity_expansion(R.specimen(spark, d), nets, "sex")
    return out.select("fish", "age", "length", logged("selectivity_expansion").alias("log_expansion"))


@query(f"""WITH {R.SPECIMEN}, {R.LENGTHS}, {R.INTERVALS}, al AS (SELECT stratum, sex, haul_num, length, count(*) AS n FROM specimen GROUP BY ALL UNION ALL SELECT stratum, sex, haul_num, length, sum(length_count) FROM lengths GROUP BY ALL),
h AS (SELECT stratum, sex, haul_num, sum({SIG} * n) / sum(n) AS sigma_bs FROM al GROUP BY ALL), s AS (SELECT stratum, sex, avg(sigma_bs) AS sigma_bs FROM h GROUP BY ALL),
x AS (SELECT *, CASE interval % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'unsexed' ELSE 'none' END AS sex FROM intervals)
SELECT interval, stratum, sex, round(coalesce(nasc / (4 * pi() * sigma_bs), 0), 2) AS number_density FROM x LEFT JOIN s USING (stratum, sex)""")
def ts_invert_strata(spark, d):
    """The whole inversion by strata of two columns; a quarter of the intervals lies in strata without any fish."""
    k = F.col("interval") % 4
    rows = R.intervals(spark, d).withColumn("sex", F.when(k == 0, "female").when(k == 1, "male").when(k == 2, "unsexed").otherwise("none"))
    model = InversionLengthTS({"ts_length_regression": {"slope": 20.0, "intercept": -68.0}, "stratify_by": ["stratum", "sex"], "impute_missing_strata": False})
    out = model.invert(rows, [R.specimen(spark, d), R.lengths(spark, d)])
    return out.select("interval", "stratum", "sex", F.round("number_density", 2).alias("number_density"))


@query("""WITH a AS (SELECT user_id % 10 AS transect_num, event_id AS interval, value AS reference_nasc, value + 5 AS nasc, 5 + (event_id % 3) * CAST(1 AS DOUBLE) AS thickness_mean FROM events),
p AS (SELECT CAST(i AS BIGINT) AS transect_num, 0.01 + i * CAST(0.001 AS DOUBLE) AS length_mean, CAST(16 AS DOUBLE) AS length_radius_ratio, CAST(1.036 AS DOUBLE) AS g, CAST(10 * i AS DOUBLE) AS number_density FROM range(1, 9) t(i)),
n AS (SELECT transect_num, count(reference_nasc) AS n FROM a GROUP BY transect_num)
SELECT a.transect_num, interval, round(log10(nullif(coalesce(number_density * reference_nasc / nasc * thickness_mean * n, 0) * 1852.0 ** 2, 0)), 7) AS log_number, round(log10(nullif(coalesce(number_density * reference_nasc / nasc * thickness_mean * n, 0) * 1852.0 ** 2 * coalesce(pi() * (length_mean / length_radius_ratio) ** 2 * length_mean * 1025 * g, 0), 0)), 7) AS log_biomass FROM a LEFT JOIN p USING (transect_num) LEFT JOIN n USING (transect_num)""")
def krill_population(spark, d):
    e = R.table(spark, d, "events")
    rows = e.select((F.col("user_id") % 10).alias("transect_num"), F.col("event_id").alias("interval"), F.col("value").alias("reference_nasc"), (F.col("value") + 5).alias("nasc"), (5 + (F.col("event_id") % 3) * 1.0).alias("thickness_mean"))
    p = spark.range(1, 9).select(F.col("id").alias("transect_num"), (0.01 + F.col("id") * 0.001).alias("length_mean"), F.lit(16.0).alias("length_radius_ratio"), F.lit(1.036).alias("g"), (F.col("id") * 10.0).alias("number_density"))
    out = acoustics.krill_population(p, rows, ["transect_num"], 1025.0, "transect")
    return out.select("transect_num", "interval", logged("areal_number_density").alias("log_number"), logged("biomass_density").alias("log_biomass"))


@query("""WITH a AS (SELECT user_id % 10 AS transect_num, event_id AS interval, 5 + (event_id % 3) * CAST(1 AS DOUBLE) AS thickness_mean FROM events),
p AS (SELECT CAST(i AS BIGINT) AS transect_num, 0.01 + i * CAST(0.001 AS DOUBLE) AS length_mean, CAST(10 * i AS DOUBLE) AS number_density FROM range(1, 9) t(i))
SELECT transect_num, interval, round(log10(nullif(coalesce(number_density * thickness_mean, 0) * 1852.0 ** 2, 0)), 7) AS log_number, round(log10(nullif(coalesce(number_density * thickness_mean, 0) * 1852.0 ** 2 * coalesce(pi() * (length_mean / 16) ** 2 * length_mean * 1025 * 1.036, 0), 0)), 7) AS log_biomass FROM a LEFT JOIN p USING (transect_num)""")
def krill_intervals(spark, d):
    e = R.table(spark, d, "events")
    rows = e.select((F.col("user_id") % 10).alias("transect_num"), F.col("event_id").alias("interval"), (5 + (F.col("event_id") % 3) * 1.0).alias("thickness_mean"))
    p = spark.range(1, 9).select(F.col("id").alias("transect_num"), (0.01 + F.col("id") * 0.001).alias("length_mean"), F.lit(16.0).alias("length_radius_ratio"), F.lit(1.036).alias("g"), (F.col("id") * 10.0).alias("number_density"))
    out = acoustics.krill_population(p, rows, ["transect_num"], 1025.0, "interval")
    return out.select("transect_num", "interval", logged("areal_number_density").alias("log_number"), logged("biomass_density").alias("log_biomass"))


@query(f"{W}, {R.INTERVALS}, s AS (SELECT stratum, avg(sigma_bs) AS sigma_bs FROM hs GROUP BY stratum), x AS (SELECT * REPLACE (CASE WHEN interval % 3 = 0 THEN 'X' ELSE stratum END AS stratum) FROM intervals), i AS (SELECT stratum, sigma_bs FROM s UNION ALL SELECT 'X', max_by(sigma_bs, stratum) FROM s) SELECT interval, round(log10(nullif(coalesce(nasc / (4 * pi() * sigma_bs), 0), 0)), 7) AS log_density FROM x JOIN i USING (stratum)")
def length_ts_inversion(spark, d):
    """The whole inversion, with a stratum beyond the last that takes its neighbour's value."""
    rows = R.intervals(spark, d).withColumn("stratum", F.when(F.col("interval") % 3 == 0, "X").otherwise(F.col("stratum")))
    model = InversionLengthTS({"ts_length_regression": {"slope": 20.0, "intercept": -68.0}, "stratify_by": "stratum"})
    return model.invert(rows, {"specimen": R.specimen(spark, d), "length": R.lengths(spark, d)}).select("interval", logged("number_density").alias("log_density"))
