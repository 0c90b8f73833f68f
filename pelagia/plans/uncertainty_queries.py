"""Queries of transect statistics, the bootstrap and confidence intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.operators import uncertainty
from pelagia.plans import roles as R
from pelagia.plans.registry import query

TS = f"""WITH RECURSIVE {R.INTERVALS}, ts AS (SELECT stratum, transect_num, sum(nasc) AS nasc, max(distance_e) - min(distance_s) AS distance, sum(distance_e - distance_s) AS area FROM intervals GROUP BY ALL),
st AS (SELECT stratum, count(*) AS n_transects, sum(nasc) AS nasc, sum(distance) AS distance, sum(area) AS area, greatest(CAST(floor(count(*) * 0.75 + 0.5) AS BIGINT), 1) AS n_sampled FROM ts GROUP BY stratum)"""
#: Mean of sums weighted by distance; variance of sums per distance about it.
JH = """{n}m AS (SELECT {k} stratum, count(*) AS n, avg(distance) AS dbar, sum(nasc * distance) / sum(distance) AS mean, sum(area) AS area, sum(nasc) AS total, sum(distance) AS d FROM {t} GROUP BY ALL),
{n} AS (SELECT {k} stratum, n, d, mean, m.area, total, sum(CASE WHEN distance = 0 THEN 0 ELSE (distance / dbar) ** 2 * (nasc / distance - mean) ** 2 END) / CASE WHEN n > 1 THEN n * (n - 1) ELSE 1 END AS variance
 FROM {t} JOIN {n}m m USING ({k} stratum) GROUP BY {k} stratum, n, d, mean, m.area, total)"""
BS = f"""bs AS (SELECT * EXCLUDE (k, n_sampled) FROM (SELECT ts.*, replicate, n_sampled, row_number() OVER (PARTITION BY stratum, replicate ORDER BY md5(concat_ws('-', '7', CAST(replicate AS VARCHAR), stratum, CAST(transect_num AS VARCHAR))), transect_num) AS k
 FROM ts, range(1, 61) r(replicate), (SELECT stratum AS s2, n_sampled FROM st) WHERE s2 = stratum) WHERE k <= n_sampled), {JH.format(n='rj', k='replicate,', t='bs')},
re AS (SELECT rj.replicate, stratum, rj.n, rj.d AS distance, rj.area AS sampled_area, rj.mean, rj.variance, rj.total * n_transects / n_sampled AS total, rj.total * n_transects / n_sampled / st.area AS density, st.area FROM rj JOIN st USING (stratum)),
sv AS (SELECT replicate, sum(total) AS total, sum(density * area) / sum(area) AS density, sqrt(sum(variance * area ** 2)) / sum(mean * area) AS cv FROM re GROUP BY replicate),
b AS (SELECT stratum AS scope, 'total' AS statistic, total AS x FROM re UNION ALL SELECT stratum, 'density', density FROM re UNION ALL SELECT 'survey', 'total', total FROM sv UNION ALL SELECT 'survey', 'density', density FROM sv UNION ALL SELECT 'survey', 'cv', cv FROM sv),
{JH.format(n='oj', k='', t='ts')}, pp AS (SELECT stratum AS scope, 'total' AS statistic, total AS p FROM oj UNION ALL SELECT stratum, 'density', total / area FROM oj UNION ALL SELECT 'survey', 'total', sum(total) FROM oj UNION ALL SELECT 'survey', 'density', sum(total) / sum(area) FROM oj
 UNION ALL SELECT 'survey', 'cv', sqrt(sum(variance * area ** 2)) / sum(mean * area) FROM oj)"""


def transects(spark, d):
    rows = R.intervals(spark, d).withColumn("area", F.col("distance_e") - F.col("distance_s"))
    return uncertainty.transect_statistics(rows, "stratum", "nasc", F.max("distance_e") - F.min("distance_s"), "area")


def strata(spark, d):
    return uncertainty.strata_statistics(transects(spark, d), "stratum", "nasc", 0.75)


def r(df, *names, n=6):
    return df.withColumns({c: F.round(c, n) for c in names})


@query(f"{TS} SELECT stratum, transect_num, round(nasc, 5) AS nasc, distance, area, round(nasc / distance, 6) AS per_distance, round(nasc / area, 6) AS per_area FROM ts")
def transect_stats(spark, d):
    return r(r(transects(spark, d), "nasc", n=5), "per_distance", "per_area")


@query(f"{TS} SELECT stratum, n_transects, round(nasc, 4) AS nasc, distance, area, n_sampled, round(nasc / area, 6) AS density, round(nasc / distance, 6) AS distance_density FROM st")
def strata_stats(spark, d):
    return r(r(strata(spark, d), "nasc", n=4), "density", "distance_density")


@query(f"{TS}, {JH.format(n='j', k='', t='ts')} SELECT round(sqrt(sum(variance * area ** 2)) / sum(mean * area), 7) AS cv FROM j")
def survey_cv(spark, d):
    return r(uncertainty.survey_cv(uncertainty.jolly_hampton(transects(spark, d), [], "stratum", "nasc")), "cv", n=7)


def replicates(spark, d):
    t = transects(spark, d).drop("per_distance", "per_area")
    return uncertainty.bootstrap(t, strata(spark, d), "stratum", 60, 7)


def rel(*names):
    """Logarithms, so that rounding keeps significant digits."""
    return {c: F.round(F.log10(c), 7) for c in names}


@query(f"{TS}, {BS} SELECT replicate, stratum, n, distance, sampled_area, area, round(log10(total), 7) AS total, round(log10(density), 7) AS density, round(log10(mean), 7) AS mean, round(log10(variance), 7) AS variance FROM re")
def bootstrap_replicates(spark, d):
    out = uncertainty.replicate_estimates(replicates(spark, d), strata(spark, d), "stratum", "nasc").withColumns(rel("total", "density", "mean", "variance"))
    return out.select(F.col("replicate").cast("long").alias("replicate"), "stratum", "n", "distance", "sampled_area", "area", "total", "density", "mean", "variance")


@query(f"{TS}, {BS} SELECT replicate, round(log10(total), 7) AS total, round(log10(density), 7) AS density, round(cv, 8) AS cv FROM sv")
def bootstrap_survey(spark, d):
    each = uncertainty.replicate_estimates(replicates(spark, d), strata(spark, d), "stratum", "nasc")
    out = uncertainty.survey_estimates(each).withColumns(rel("total", "density"))
    return out.select(F.col("replicate").cast("long").alias("replicate"), "total", "density", F.round("cv", 8).alias("cv"))


def interval(spark, d, method, *statistics):
    out = uncertainty.summarize(transects(spark, d), "stratum", "nasc", 0.75, 60, 7, method, statistics=statistics or ("total", "density", "cv"))
    # in units of the mean, which has any size
    return out.select("scope", "statistic", *[F.round(F.col(c) / F.col("mean"), 6).alias(c) for c in ("low", "high", "bias")], F.round(F.log10("mean"), 7).alias("mean"))


S = "s AS (SELECT scope, statistic, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd, sum(x) AS s1, sum(x * x) AS s2, any_value(p) AS p FROM b JOIN pp USING (scope, statistic) GROUP BY ALL)"
OUT = "SELECT scope, statistic, round(({low}) / m, 6) AS low, round(({high}) / m, 6) AS high, round((m - p) / m, 6) AS bias, round(log10(m), 7) AS mean FROM s"
BY = "GROUP BY scope, statistic"


@query(f"{TS}, {BS}, {S}, q AS (SELECT scope, statistic, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM b {BY}) {OUT.format(low='lo', high='hi')} JOIN q USING (scope, statistic)")
def ci_percentile(spark, d):
    return interval(spark, d, "percentile")


@query(f"{TS}, {BS}, {S} {OUT.format(low='m - 1.959963984540054 * sd', high='m + 1.959963984540054 * sd')}")
def ci_normal(spark, d):
    return interval(spark, d, "normal")


@query(f"{TS}, {BS}, {S}, q AS (SELECT scope, statistic, quantile_cont(x - p, 0.025) AS lo, quantile_cont(x - p, 0.975) AS hi FROM b JOIN pp USING (scope, statistic) {BY}) {OUT.format(low='m + lo', high='m + hi')} JOIN q USING (scope, statistic)")
def ci_empirical(spark, d):
    return interval(spark, d, "empirical")


#: The 0.975 quantile of t with 59 degrees of freedom.
@query(f"{TS}, {BS}, {S} {OUT.format(low='m - 2.000995378088269 * sd', high='m + 2.000995378088269 * sd')}")
def ci_t(spark, d):
    return interval(spark, d, "t")


LOO = "l AS (SELECT scope, statistic, x, n, m, sd, (s1 - x) / (n - 1) AS lm, (s2 - x * x - (n - 1) * ((s1 - x) / (n - 1)) ** 2) / (n - 2) AS lv FROM b JOIN s USING (scope, statistic))"


@query(f"{TS}, {BS}, {S}, {LOO}, q AS (SELECT scope, statistic, quantile_cont((x - lm) / sqrt(greatest(lv, 1e-12)), 0.025) AS lo, quantile_cont((x - lm) / sqrt(greatest(lv, 1e-12)), 0.975) AS hi FROM l {BY}) {OUT.format(low='m + lo * sd', high='m + hi * sd')} JOIN q USING (scope, statistic)")
def ci_jackknife(spark, d):
    return interval(spark, d, "t-jackknife")


#: The normal distribution by its series, and its quantiles by bisection.
PHI = "(0.5 + exp(-0.5 * pow({z}, 2)) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60), lambda k: pow({z}, 2 * k + 1) * pow(2, k) * gamma(k + 1) / gamma(2 * k + 2))))"
# a sample's CV is above the survey's every time, which neither method allows
BIAS = f"""sh AS (SELECT scope, statistic, avg(CASE WHEN x < p THEN 1 ELSE 0 END) AS share FROM b JOIN pp USING (scope, statistic) WHERE statistic <> 'cv' {BY}),
bi AS (SELECT scope, statistic, share, CAST(-6 AS DOUBLE) AS lo, CAST(6 AS DOUBLE) AS hi, 0 AS k FROM sh UNION ALL SELECT scope, statistic, share, CASE WHEN {PHI.format(z='((lo + hi) / 2)')} < share THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {PHI.format(z='((lo + hi) / 2)')} < share THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM bi WHERE k < 50),
z0 AS (SELECT scope, statistic, (lo + hi) / 2 AS z FROM bi WHERE k = 50)"""
AT = "qs AS (SELECT scope, statistic, " + ", ".join(f"{PHI.format(z=f'(z + (z {sign} 1.959963984540054) / (1 - a * (z {sign} 1.959963984540054)))')} AS q{k}" for k, sign in enumerate("-+")) + " FROM z0 JOIN ac USING (scope, statistic))"
RANKS = "rk AS (SELECT scope, statistic, x, row_number() OVER (PARTITION BY scope, statistic ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY scope, statistic) - 1 AS m FROM b), q AS (SELECT scope, statistic, sum(x * greatest(0, 1 - abs(r - q0 * m))) AS lo, sum(x * greatest(0, 1 - abs(r - q1 * m))) AS hi FROM rk JOIN qs USING (scope, statistic) GROUP BY scope, statistic)"


@query(f"{TS}, {BS}, {S}, {BIAS}, ac AS (SELECT scope, statistic, 0 AS a FROM z0), {AT}, {RANKS} {OUT.format(low='lo', high='hi')} JOIN q USING (scope, statistic)")
def ci_bc(spark, d):
    return interval(spark, d, "bc", "total", "density")


@query(f"{TS}, {BS}, {S}, {BIAS}, {LOO}, i AS (SELECT scope, statistic, (n - 1) * (sd ** 2 / m ** 2 - 1 / m - (lv / lm ** 2 - 1 / lm)) AS i FROM l), ac AS (SELECT scope, statistic, sum(i ** 3) / (6 * pow(sum(i ** 2), 1.5)) AS a FROM i GROUP BY ALL), {AT}, {RANKS} {OUT.format(low='lo', high='hi')} JOIN q USING (scope, statistic)")
def ci_bca(spark, d):
    return interval(spark, d, "bca", "total", "density")


VT = f"""WITH RECURSIVE {R.INTERVALS}, g AS (SELECT CASE WHEN latitude * 2 + 0.5 >= 0 THEN floor(latitude * 2 + 1.0) ELSE ceil(latitude * 2) END / 2 AS latitude, min(longitude) AS x0, max(longitude) AS x1, sum(nasc) AS nasc FROM intervals GROUP BY 1)"""


@query(f"{VT} SELECT CAST(dense_rank() OVER (ORDER BY latitude) AS INTEGER) AS transect_num, latitude, round(nasc, 4) AS nasc FROM g")
def virtual_transects(spark, d):
    out = uncertainty.virtual_transects(R.intervals(spark, d), 2, "nasc")
    return out.select("transect_num", "latitude", F.round("nasc", 4).alias("nasc"))


#: Distance along a parallel on the ellipsoid, by the inverse series.
PARALLEL = """u AS (SELECT latitude, sin(atan((1 - 1 / 298.257223563) * tan(radians(latitude)))) AS s, cos(atan((1 - 1 / 298.257223563) * tan(radians(latitude)))) AS c, radians(x1 - x0) AS gap, 1 / 298.257223563 AS f FROM g),
it AS (SELECT *, gap AS lam, 0 AS k FROM u UNION ALL SELECT latitude, s, c, gap, f, gap + (1 - cc) * f * sa * (sg + cc * ss * (cm + cc * cs * (2 * cm ** 2 - 1))), k + 1 FROM (SELECT *, f / 16 * ca * (4 + f * (4 - 3 * ca)) AS cc, cs - 2 * s * s / ca AS cm FROM (SELECT *, 1 - sa ** 2 AS ca FROM
 (SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE c * c * sin(lam) / ss END AS sa FROM (SELECT *, sqrt((c * sin(lam)) ** 2 + (c * s - s * c * cos(lam)) ** 2) AS ss, s * s + c * c * cos(lam) AS cs FROM it WHERE k < 12)))))"""
LENGTH = """ln AS (SELECT latitude, CASE WHEN ss = 0 THEN 0 ELSE 6378137 * (1 - f) * a * (sg - ds) / 1852 END AS distance FROM (SELECT *, b * ss * (cm + b / 4 * (cs * (2 * cm ** 2 - 1) - b / 6 * cm * (4 * ss ** 2 - 3) * (4 * cm ** 2 - 3))) AS ds FROM
 (SELECT *, 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) AS a, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS b FROM (SELECT *, ca * (1 / (1 - f) ** 2 - 1) AS w, cs - 2 * s * s / ca AS cm FROM (SELECT *, 1 - sa ** 2 AS ca FROM
 (SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE c * c * sin(lam) / ss END AS sa FROM (SELECT *, sqrt((c * sin(lam)) ** 2 + (c * s - s * c * cos(lam)) ** 2) AS ss, s * s + c * c * cos(lam) AS cs FROM it WHERE k = 12)))))))"""


@query(f"""{VT}, {PARALLEL}, {LENGTH}, e AS (SELECT min(latitude) AS y0, max(latitude) AS y1, (max(latitude) - min(latitude)) / (count(*) - 1) * 60 AS spacing FROM g)
SELECT CAST(dense_rank() OVER (ORDER BY latitude) AS INTEGER) AS transect_num, latitude, round(distance, 6) AS distance, round(distance * spacing * CASE WHEN latitude IN (y0, y1) THEN 0.5 ELSE 1 END, 5) AS area FROM g JOIN ln USING (latitude), e""")
def virtual_transect_areas(spark, d):
    out = uncertainty.virtual_transects(R.intervals(spark, d), 2, "nasc")
    return out.select("transect_num", "latitude", F.round("distance", 6).alias("distance"), F.round("area", 5).alias("area"))
