"""Queries of bins, proportions, weights, population estimates and apportionment."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.operators import acoustics, apportion, biology
from pelagia.plans import roles as R
from pelagia.plans.registry import query

MIDS = [float(m) for m in range(2, 51, 4)]  # bins (0, 4], ..., (48, 52]
BIN = "CASE WHEN length > 0 AND length <= 52 THEN 2 + (ceil(length / 4) - 1) * 4 END"
W = f"WITH {R.SPECIMEN}, {R.LENGTHS}, {R.CATCH}"
BINS = "bins AS (SELECT CAST(2 + 4 * i AS DOUBLE) AS length_bin FROM range(13) t(i))"
SPB = f"spb AS (SELECT *, {BIN} AS length_bin FROM specimen)"
LEB = f"leb AS (SELECT *, {BIN} AS length_bin FROM lengths)"
NP = f"""{SPB}, {LEB}, c AS (SELECT stratum, sex, length_bin, age, CAST(count(*) AS DOUBLE) AS count, 'aged' AS source FROM spb GROUP BY stratum, sex, length_bin, age
 UNION ALL SELECT stratum, sex, length_bin, NULL, CAST(sum(length_count) AS DOUBLE), 'unaged' FROM leb GROUP BY stratum, sex, length_bin),
np AS (SELECT c.*, count / t AS proportion FROM c JOIN (SELECT stratum, sum(count) AS t FROM c GROUP BY stratum) USING (stratum))"""
LW = """lw AS (SELECT sex, regr_slope(log10(weight), log10(length)) AS slope, regr_intercept(log10(weight), log10(length)) AS intercept FROM specimen GROUP BY sex
 UNION ALL SELECT 'all', regr_slope(log10(weight), log10(length)), regr_intercept(log10(weight), log10(length)) FROM specimen)"""
BW = f"""{BINS}, {LW}, obs AS (SELECT sex, length_bin, count(*) AS n, avg(weight) AS o FROM spb GROUP BY sex, length_bin UNION ALL SELECT 'all', length_bin, count(*), avg(weight) FROM spb GROUP BY length_bin),
bw AS (SELECT sex, length_bin, CASE WHEN coalesce(n, 0) < 5 THEN pow(10, intercept) * pow(length_bin, slope) ELSE o END AS weight_fitted FROM lw CROSS JOIN bins LEFT JOIN obs USING (sex, length_bin))"""
AW = """aw AS (SELECT stratum, 'all' AS sex, sum(proportion * weight_fitted) / sum(proportion) AS average_weight FROM np JOIN bw USING (length_bin) WHERE bw.sex = 'all' GROUP BY stratum
 UNION ALL SELECT stratum, sex, sum(proportion * weight_fitted) / sum(proportion) FROM np JOIN bw USING (length_bin, sex) GROUP BY stratum, sex)"""
WP = "w AS (SELECT stratum, sex, length_bin, age, sum(weight) AS weight FROM spb GROUP BY ALL), ct AS (SELECT stratum, sum(weight) AS t FROM catch GROUP BY stratum), wp AS (SELECT w.*, weight / t AS proportion FROM w LEFT JOIN ct USING (stratum))"


def fish(spark, d):
    return biology.binify(R.specimen(spark, d), MIDS, "length")


def unaged(spark, d):
    return biology.binify(R.lengths(spark, d), MIDS, "length")


def proportions(spark, d):
    aged = biology.binned_counts(fish(spark, d), ["stratum", "sex", "length_bin", "age"])
    other = biology.binned_counts(unaged(spark, d), ["stratum", "sex", "length_bin"], "length_count")
    return biology.number_proportions({"aged": aged, "unaged": other}, "stratum")


def both_sexes(spark, d):
    s = R.specimen(spark, d)
    return s.unionByName(s.withColumn("sex", F.lit("all")))


def fitted(spark, d):
    s = both_sexes(spark, d)
    return biology.length_binned_weights(s, MIDS, biology.length_weight_regression(s, ["sex"]), ["sex"], minimum=5)


def mean_weights(spark, d):
    return biology.average_weight(proportions(spark, d), fitted(spark, d), "stratum")


def aged_weights(spark, d):
    return biology.weight_proportions(biology.binned_weights(fish(spark, d), ["stratum", "sex", "length_bin", "age"]), R.catch(spark, d), "stratum")


def rel(name: str, digits: int = 7):
    """A value to so many significant digits, the same way in both engines' SQL."""
    return F.round(F.log10(F.abs(name)), digits)


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


@query(f"{W}, {SPB} SELECT fish, age, length, length_bin FROM spb")
def binify(spark, d):
    return fish(spark, d).select("fish", "age", "length", "length_bin")


@query("SELECT CAST(2 + 4 * i AS DOUBLE) AS bin, CAST(4 * i AS DOUBLE) AS \"left\", CAST(4 * i + 4 AS DOUBLE) AS \"right\" FROM range(13) t(i)")
def bin_distribution(spark, d):
    return biology.bin_table(spark, MIDS)


@query(f"{W}, {SPB} SELECT stratum, sex, length_bin, age, CAST(count(*) AS DOUBLE) AS count FROM spb GROUP BY ALL")
def binned_counts(spark, d):
    return biology.binned_counts(fish(spark, d), ["stratum", "sex", "length_bin", "age"])


@query(f"{W} SELECT haul_num, sex, length, CAST(sum(length_count) AS BIGINT) AS length_count FROM lengths GROUP BY ALL")
def quantize_lengths(spark, d):
    return biology.quantize_lengths(R.lengths(spark, d), ["haul_num", "sex"])


@query(f"{W}, {NP} SELECT stratum, sex, length_bin, age, source, count, round(proportion, 9) AS proportion FROM np")
def number_proportions(spark, d):
    return rounded(proportions(spark, d), "proportion", places=9)


@query(f"{W}, {LW} SELECT sex, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM lw")
def length_weight_regression(spark, d):
    return rounded(biology.length_weight_regression(both_sexes(spark, d), ["sex"]), "slope", "intercept")


@query(f"{W}, {SPB}, {BW} SELECT sex, length_bin, round(weight_fitted, 6) AS weight_fitted FROM bw")
def length_binned_weights(spark, d):
    return rounded(fitted(spark, d), "weight_fitted")


CURVE = """pts AS (SELECT sex, length AS x, avg(weight) AS y FROM specimen GROUP BY sex, length),
iw AS (SELECT l.*, CASE WHEN length <= (SELECT min(x) FROM pts p WHERE p.sex = l.sex) THEN (SELECT arg_min(y, x) FROM pts p WHERE p.sex = l.sex) WHEN length >= (SELECT max(x) FROM pts p WHERE p.sex = l.sex) THEN (SELECT arg_max(y, x) FROM pts p WHERE p.sex = l.sex)
 ELSE (SELECT arg_max(y, x) FROM pts p WHERE p.sex = l.sex AND x <= length) + (length - (SELECT max(x) FROM pts p WHERE p.sex = l.sex AND x <= length)) * ((SELECT arg_min(y, x) FROM pts p WHERE p.sex = l.sex AND x > length) - (SELECT arg_max(y, x) FROM pts p WHERE p.sex = l.sex AND x <= length))
 / ((SELECT min(x) FROM pts p WHERE p.sex = l.sex AND x > length) - (SELECT max(x) FROM pts p WHERE p.sex = l.sex AND x <= length)) END * length_count AS weight FROM lengths l)"""


def with_curve(spark, d, *keys):
    """Unaged fish with their weight, row by row or summed up by keys, sex and length."""
    curves = biology.interpolators(R.specimen(spark, d), ["sex"], "length", "weight")
    rows = R.lengths(spark, d)
    return biology.interpolated_weight(biology.combined(rows, [*keys, "sex"]) if keys else rows, curves, ["sex"])


@query(f"{W}, {CURVE} SELECT haul_num, sex, length, length_count, round(weight, 5) AS weight FROM iw")
def weight_interpolation(spark, d):
    return rounded(with_curve(spark, d).select("haul_num", "sex", "length", "length_count", "weight"), "weight", places=5)


@query(f"{W}, {CURVE} SELECT stratum, sex, {BIN} AS length_bin, round(log10(nullif(coalesce(sum(weight), 0), 0)), 7) AS weight FROM iw GROUP BY ALL")
def binned_weights(spark, d):
    out = biology.binned_weights(biology.binify(with_curve(spark, d, "stratum"), MIDS, "length"), ["stratum", "sex", "length_bin"])
    return out.withColumn("weight", rel("weight"))


@query(f"{W}, {CURVE} SELECT stratum, round(log10(sum(weight)), 7) AS weight FROM iw GROUP BY stratum")
def stratum_weights(spark, d):
    return biology.stratum_weights(with_curve(spark, d, "stratum"), "stratum").withColumn("weight", rel("weight"))


@query(f"{W}, {NP}, {BW}, {AW} SELECT stratum, sex, round(average_weight, 6) AS average_weight FROM aw")
def stratum_avg_weight(spark, d):
    return rounded(mean_weights(spark, d), "average_weight")


@query(f"{W}, {NP}, s AS (SELECT stratum, sex, source, sum(proportion) AS p FROM np GROUP BY ALL), g AS (SELECT stratum, source, sum(p) AS a FROM s GROUP BY ALL), f AS (SELECT stratum, sex, p AS first FROM s WHERE source = 'aged'), o AS (SELECT s.stratum, s.sex, s.source, g.a / (g.a + coalesce(first, 0)) AS adjusted FROM s JOIN g USING (stratum, source) LEFT JOIN f USING (stratum, sex) WHERE source <> 'aged') SELECT stratum, sex, source, round(adjusted, 9) AS adjusted FROM o UNION ALL SELECT f.stratum, f.sex, 'aged', round(first / (first + coalesce(t, 0)), 9) FROM f LEFT JOIN (SELECT stratum, sex, sum(adjusted) AS t FROM o GROUP BY ALL) USING (stratum, sex)")
def adjusted_proportions(spark, d):
    p = proportions(spark, d)
    shares = p.groupBy("stratum", "sex", "source").agg(F.sum("proportion").alias("share"))
    parts = shares.join(shares.groupBy("stratum", "source").agg(F.sum("share").alias("aggregate")), ["stratum", "source"])
    return rounded(biology.adjusted_proportions(parts, "source", "stratum", "aged", "sex"), "adjusted", places=9)


@query(f"{W}, {NP}, t AS (SELECT stratum, sex, sum(proportion) AS t FROM np GROUP BY ALL) SELECT stratum, sex, length_bin, age, source, round(proportion / t, 9) AS within FROM np JOIN t USING (stratum, sex)")
def within_proportions(spark, d):
    return rounded(biology.within_proportions(proportions(spark, d), ["stratum", "sex"]), "within", places=9).drop("count", "proportion")


@query(f"{W}, {SPB}, {WP} SELECT stratum, sex, length_bin, age, round(weight, 6) AS weight, round(proportion, 9) AS proportion FROM wp")
def weight_proportions(spark, d):
    return rounded(rounded(aged_weights(spark, d), "proportion", places=9), "weight", places=6)


@query(f"{W}, {SPB}, w AS (SELECT stratum, sex, sum(weight) AS weight FROM spb GROUP BY ALL), ct AS (SELECT stratum, sum(weight) AS t FROM catch WHERE haul_num IN (SELECT haul_num FROM lengths) GROUP BY stratum), ow AS (SELECT stratum, sum(weight) AS o FROM w GROUP BY stratum) SELECT stratum, sex, round(weight, 6) AS weight, round(weight / (coalesce(t, 0) + o), 9) AS proportion FROM w LEFT JOIN ct USING (stratum) LEFT JOIN ow USING (stratum)")
def weight_proportions_specimen(spark, d):
    w = biology.binned_weights(fish(spark, d), ["stratum", "sex"])
    return rounded(rounded(biology.weight_proportions(w, R.catch(spark, d), "stratum", R.lengths(spark, d)), "proportion", places=9), "weight", places=6)


FC = "{n} AS (SELECT stratum, length_bin, p / t * weight_fitted AS v FROM (SELECT stratum, length_bin, sum(proportion) AS p FROM np {where} GROUP BY ALL) JOIN (SELECT stratum, sum(proportion) AS t FROM np {where} GROUP BY stratum) USING (stratum) JOIN bw USING (length_bin) WHERE sex = 'all'), {n}t AS (SELECT stratum, sum(v) AS t FROM {n} GROUP BY stratum)"


@query(f"{W}, {NP}, {BW}, {FC.format(n='fc', where='')} SELECT stratum, length_bin, round(v / t, 9) AS proportion FROM fc JOIN fct USING (stratum)")
def fitted_weight_props_combined(spark, d):
    numbers = proportions(spark, d).groupBy("stratum", "length_bin").agg(F.sum("proportion").alias("proportion"))
    whole = fitted(spark, d).where("sex = 'all'").drop("sex")
    return rounded(biology.fitted_proportions_combined(numbers, whole, "stratum", ["length_bin"]), "proportion", places=9)


WHERE = "WHERE source = 'unaged'"


@query(f"{W}, {NP}, {BW}, {CURVE}, {WP}, {FC.format(n='fc', where=WHERE)}, lf AS (SELECT stratum, 1 - sum(proportion) AS l FROM wp GROUP BY stratum), sx AS (SELECT stratum, sex, sum(weight) AS w FROM iw GROUP BY ALL), st AS (SELECT stratum, sum(w) AS tw FROM sx GROUP BY stratum) SELECT stratum, sx.sex, length_bin, round(l * v / t * w / tw, 9) AS proportion FROM fc JOIN fct USING (stratum) JOIN sx USING (stratum) JOIN st USING (stratum) JOIN lf USING (stratum)")
def fitted_weight_props(spark, d):
    numbers = proportions(spark, d).where(F.col("source") == "unaged")
    return rounded(biology.fitted_proportions(with_curve(spark, d, "stratum"), aged_weights(spark, d), numbers, fitted(spark, d).where("sex = 'all'").drop("sex"), "stratum"), "proportion", places=9)


SIG = "pow(10, (20 * log10(length_bin) - 68) / 10)"


@query(f"{W}, {NP} SELECT stratum, round(coalesce(sum(proportion * {SIG}) FILTER (age = 1), 0) / sum(proportion * {SIG}), 9) AS share FROM np WHERE source = 'aged' GROUP BY stratum")
def nasc_slice(spark, d):
    return rounded(biology.nasc_share(proportions(spark, d).where("source = 'aged'"), "stratum", F.col("age") == 1), "share", places=9)


@query(f"{W}, {NP} SELECT stratum, round(coalesce(sum(proportion) FILTER (age = 1), 0) / sum(proportion), 9) AS share FROM np WHERE source = 'aged' GROUP BY stratum")
def number_slice(spark, d):
    return rounded(biology.slice_share(proportions(spark, d).where("source = 'aged'"), "stratum", F.col("proportion"), F.col("age") == 1), "share", places=9)


@query(f"{W}, {NP}, {WP}, ns AS (SELECT stratum, coalesce(sum(proportion) FILTER (age = 1), 0) / sum(proportion) AS n FROM np WHERE source = 'aged' AND length_bin >= 10 GROUP BY stratum), ws AS (SELECT stratum, coalesce(sum(proportion) FILTER (age = 1), 0) / sum(proportion) AS s FROM wp GROUP BY stratum) SELECT stratum, round(CASE WHEN n <= 1e-10 OR s <= 1e-10 THEN 0 ELSE s END, 9) AS share FROM ws LEFT JOIN ns USING (stratum)")
def weight_slice(spark, d):
    out = biology.weight_share(aged_weights(spark, d), "stratum", F.col("age") == 1, proportions(spark, d).where("source = 'aged'"), minimum_length=10.0)
    return rounded(out, "share", places=9)


def surveyed(spark, d):
    """NASC intervals with density and area."""
    rows = R.intervals(spark, d).select("interval", "transect_num", "stratum", F.col("nasc"))
    density = acoustics.invert(rows, acoustics.strata_sigma(acoustics.haul_sigma([R.specimen(spark, d), R.lengths(spark, d)], "stratum"), "stratum"), "stratum")
    return density.withColumn("area_interval", (F.col("interval") % 10 + 1) * 0.5)


INV = f"""al AS (SELECT stratum, haul_num, length, count(*) AS n FROM specimen GROUP BY ALL UNION ALL SELECT stratum, haul_num, length, sum(length_count) FROM lengths GROUP BY ALL),
hs AS (SELECT stratum, haul_num, sum(pow(10, (20 * log10(length) - 68) / 10) * n) / sum(n) AS sigma_bs FROM al GROUP BY ALL), ss AS (SELECT stratum, avg(sigma_bs) AS sigma_bs FROM hs GROUP BY stratum),
iv AS (SELECT interval, transect_num, stratum, nasc, coalesce(nasc / (4 * pi() * sigma_bs), 0) AS number_density, (interval % 10 + 1) * CAST(0.5 AS DOUBLE) AS area_interval FROM intervals LEFT JOIN ss USING (stratum))"""
AB = """sp AS (SELECT stratum, sex, sum(proportion) AS p FROM np GROUP BY ALL), ab AS (SELECT interval, stratum, 'all' AS sex, number_density * area_interval AS abundance FROM iv UNION ALL SELECT interval, stratum, sex, number_density * area_interval * p FROM iv JOIN sp USING (stratum) WHERE sex <> 'unsexed')"""
BM = """bm AS (SELECT interval, coalesce(sum(abundance * average_weight) FILTER (sex <> 'all'), 0) + (max(abundance) FILTER (sex = 'all') - coalesce(sum(abundance) FILTER (sex <> 'all'), 0)) * max(average_weight) FILTER (sex = 'all') AS biomass FROM ab LEFT JOIN aw USING (stratum, sex) GROUP BY interval)"""


def numbers_by_sex(spark, d):
    return biology.abundance(surveyed(spark, d), proportions(spark, d), "stratum", exclude=["unsexed"])


@query(f"{W}, {R.INTERVALS}, {NP}, {INV}, {AB} SELECT interval, sex, abundance = 0 AS none, round(log10(nullif(abs(abundance), 0)), 7) AS log_abundance FROM ab")
def abundance(spark, d):
    return numbers_by_sex(spark, d).select("interval", "sex", (F.col("abundance") == 0).alias("none"), rel("abundance").alias("log_abundance"))


@query(f"{W}, {R.INTERVALS}, {NP}, {BW}, {AW}, {INV}, {AB}, {BM} SELECT interval, biomass = 0 AS none, round(log10(nullif(abs(biomass), 0)), 7) AS log_biomass FROM bm")
def biomass(spark, d):
    out = biology.biomass(numbers_by_sex(spark, d), mean_weights(spark, d), ["interval"], "stratum")
    return out.select("interval", (F.col("biomass") == 0).alias("none"), rel("biomass").alias("log_biomass"))


@query(f"{W}, {R.INTERVALS}, {NP}, {BW}, {AW}, {INV}, {AB} SELECT stratum, sex, round(log10(sum(abundance)), 7) AS log_abundance, round(log10(sum(abundance * average_weight)), 7) AS log_biomass FROM ab JOIN aw USING (stratum, sex) GROUP BY stratum, sex")
def survey_biomass(spark, d):
    """The minimum slice: abundance and biomass by stratum and sex."""
    rows = numbers_by_sex(spark, d).join(mean_weights(spark, d), ["stratum", "sex"])
    out = rows.groupBy("stratum", "sex").agg(F.sum("abundance").alias("a"), F.sum(F.col("abundance") * F.col("average_weight")).alias("b"))
    return out.select("stratum", "sex", rel("a").alias("log_abundance"), rel("b").alias("log_biomass"))


@query(f"{W}, {R.INTERVALS}, {NP}, {INV}, n AS (SELECT stratum, coalesce(sum(proportion) FILTER (age = 1), 0) / sum(proportion) AS s FROM np WHERE source = 'aged' GROUP BY stratum), x AS (SELECT * REPLACE (CASE WHEN interval % 3 = 0 THEN 'X' ELSE stratum END AS stratum) FROM iv) SELECT interval, round(nasc * (1 - coalesce(s, 0)), 6) AS nasc, round(log10(nullif(abs(number_density * (1 - coalesce(s, 0))), 0)), 7) AS log_density FROM x LEFT JOIN n USING (stratum)")
def remove_group(spark, d):
    # every third interval lies in a stratum without a share
    rows = surveyed(spark, d).withColumn("stratum", F.when(F.col("interval") % 3 == 0, "X").otherwise(F.col("stratum")))
    share = biology.slice_share(proportions(spark, d).where("source = 'aged'"), "stratum", F.col("proportion"), F.col("age") == 1).withColumnRenamed("share", "s")
    out = apportion.remove_group(rows, share, "stratum", {"nasc": "s", "number_density": "s"})
    return out.select("interval", F.round("nasc", 6).alias("nasc"), rel("number_density").alias("log_density"))


@query(f"{W}, {NP}, {BW}, {AW}, al AS (SELECT stratum, haul_num, length, count(*) AS n FROM specimen GROUP BY ALL), hs AS (SELECT stratum, haul_num, sum(pow(10, (20 * log10(length) - 68) / 10) * n) / sum(n) AS sigma_bs FROM al GROUP BY ALL), ss AS (SELECT stratum, avg(sigma_bs) AS sigma_bs FROM hs GROUP BY stratum), sp AS (SELECT stratum, sex, sum(proportion) AS p FROM np GROUP BY ALL), m AS (SELECT o_orderkey AS cell, CASE WHEN o_custkey % 2 = 0 THEN 'O' ELSE 'F' END AS stratum, o_totalprice AS biomass FROM orders), e AS (SELECT cell, stratum, 'all' AS sex, biomass FROM m UNION ALL SELECT cell, stratum, sex, biomass * p FROM m JOIN sp USING (stratum)) SELECT cell, sex, round(log10(nullif(abs(biomass), 0)), 7) AS biomass, round(log10(nullif(abs(biomass / average_weight), 0)), 7) AS abundance, round(log10(nullif(abs(biomass / average_weight * sigma_bs * 4 * pi()), 0)), 7) AS nasc FROM e LEFT JOIN aw USING (stratum, sex) LEFT JOIN ss USING (stratum)")
def mesh_biomass_to_nasc(spark, d):
    mesh = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), F.when(F.col("o_custkey") % 2 == 0, "O").otherwise("F").alias("stratum"), F.col("o_totalprice").alias("biomass"))
    sig = acoustics.strata_sigma(acoustics.haul_sigma([R.specimen(spark, d)], "stratum"), "stratum")
    out = apportion.mesh_to_nasc(mesh, proportions(spark, d), mean_weights(spark, d), sig, "stratum")
    return out.select("cell", "sex", *[rel(c).alias(c) for c in ("biomass", "abundance", "nasc")])


TOT = "tot AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'O' ELSE 'F' END AS stratum, sum(o_totalprice) AS v FROM orders GROUP BY 1), dp AS (SELECT stratum, source, sex, length_bin, age, v * proportion / n AS value FROM np JOIN tot USING (stratum) JOIN (SELECT stratum, sum(proportion) AS n FROM np GROUP BY stratum) USING (stratum))"


def spread(spark, d):
    total = R.catch(spark, d).select("stratum", F.col("weight").alias("value"))
    return apportion.distribute(total, proportions(spark, d), "stratum", ["sex", "length_bin", "age"], "value", "source")


@query(f"{W}, {NP}, {TOT} SELECT stratum, source, sex, length_bin, age, round(value, 4) AS value FROM dp")
def distribute_estimates(spark, d):
    return rounded(spread(spark, d), "value", places=4)


AGED = "ag AS (SELECT sex, length_bin, age, sum(value) AS value FROM dp WHERE source = 'aged' GROUP BY ALL), un AS (SELECT sex, length_bin, sum(value) AS u FROM dp WHERE source = 'unaged' GROUP BY ALL), du AS (SELECT sex, length_bin, age, coalesce(u * value / t, 0) AS value FROM ag JOIN un USING (sex, length_bin) JOIN (SELECT sex, length_bin, sum(value) AS t FROM ag GROUP BY ALL) USING (sex, length_bin))"


@query(f"{W}, {NP}, {TOT}, {AGED} SELECT sex, length_bin, age, round(value, 3) AS value FROM du")
def distribute_unaged(spark, d):
    s = spread(spark, d)
    return rounded(apportion.distribute_unaged(s.where("source = 'unaged'"), s.where("source = 'aged'"), ["sex", "length_bin"]), "value", places=3)


@query(f"{W}, {NP}, {TOT}, {AGED.replace('GROUP BY ALL), un', 'AND length_bin NOT IN (10, 14, 30) GROUP BY ALL), un')}, k AS (SELECT sex, length_bin, sum(value) AS a FROM ag GROUP BY ALL), b AS (SELECT DISTINCT length_bin, CAST((length_bin + 2) / 4 AS INTEGER) AS r FROM dp), mi AS (SELECT un.sex, un.length_bin, u, r FROM un JOIN b USING (length_bin) LEFT JOIN k USING (sex, length_bin) WHERE a IS NULL AND u <> 0), nn AS (SELECT mi.sex, mi.length_bin, u, arg_min(k.length_bin, abs(mi.r - b.r) * 1000 + b.r) AS src FROM mi JOIN k USING (sex) JOIN b ON b.length_bin = k.length_bin GROUP BY ALL) SELECT sex, length_bin, age, round(value, 3) AS value FROM du UNION ALL SELECT nn.sex, nn.length_bin, ag.age, round(u * ag.value / k.a, 3) FROM nn JOIN ag ON ag.sex = nn.sex AND ag.length_bin = src JOIN k ON k.sex = nn.sex AND k.length_bin = src")
def impute_table(spark, d):
    s = spread(spark, d)
    aged, un = s.where("source = 'aged' AND length_bin NOT IN (10, 14, 30)"), s.where("source = 'unaged'")
    return rounded(apportion.impute_table(un, aged, apportion.distribute_unaged(un, aged, ["sex", "length_bin"]), ["sex"]), "value", places=3)


@query(f"{W}, {NP}, {TOT}, {AGED} SELECT sex, age, round(a + b, 3) AS value FROM (SELECT sex, age, sum(value) AS a FROM ag GROUP BY ALL) JOIN (SELECT sex, age, sum(value) AS b FROM du WHERE age < 6 GROUP BY ALL) USING (sex, age)")
def sum_tables(spark, d):
    s = spread(spark, d)
    aged = s.where("source = 'aged'")
    extra = apportion.distribute_unaged(s.where("source = 'unaged'"), aged, ["sex", "length_bin"]).where("age < 6")
    return rounded(apportion.sum_tables([aged, extra], ["sex", "age"]), "value", places=3)


@query(f"{W}, {NP}, {TOT}, {AGED}, t AS (SELECT sex, sum(value) FILTER (age = 1) AS lost, sum(value) FILTER (age <> 1) AS rest FROM ag GROUP BY sex) SELECT sex, length_bin, age, round(CASE WHEN age = 1 THEN 0 ELSE value + coalesce(lost * value / rest, 0) END, 3) AS value FROM ag JOIN t USING (sex)")
def reallocate_excluded(spark, d):
    aged = spread(spark, d).where("source = 'aged'").groupBy("sex", "length_bin", "age").agg(F.sum("value").alias("value"))
    return rounded(apportion.reallocate(aged, F.col("age") == 1, ["sex"]), "value", places=3)
