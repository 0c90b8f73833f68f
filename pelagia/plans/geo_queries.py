"""Queries of variograms, kriging, projection and cropping."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from pelagia.geostatistics import cropping, geometry, kriging, outline, projection, variogram
from pelagia.geostatistics import projection_systems as systems
from pelagia.geostatistics.models import gamma_column
from pelagia.plans import roles as R
from pelagia.plans.registry import QUERIES, SQL, query
from pelagia.session import prepare

#: Distances 0, 0.1, ... 4.9.
LAGS = "l AS (SELECT DISTINCT (p_size - 1) / CAST(10 AS DOUBLE) AS h FROM part)"
#: J0 by its power series; K by Simpson-like sums over a finer grid than the library's.
J0 = "list_sum(list_transform(range(0, 40), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow({x} / 2, 2 * k) / pow(gamma(k + 1), 2)))"
K = "list_sum(list_transform(range(0, 1000), lambda k: (CASE WHEN k = 0 THEN 0.5 ELSE 1 END) * CAST(0.03125 AS DOUBLE) * exp(-({x}) * cosh(k * CAST(0.03125 AS DOUBLE))) * cosh({v} * k * CAST(0.03125 AS DOUBLE))))"
BASE = {"sill": 0.9, "nugget": 0.1, "correlation_range": 1.7, "hole_effect_range": 1.5, "decay_power": 1.3, "smoothness_parameter": 1.5, "smoothness": 1.5, "shape_parameter": 0.8, "power_exponent": 0.7, "alpha": 1.3, "enhance_semivariance": True}
HOLE = J0.format(x="(1.5 * h)")
EXPP, GAUSS = "(1 - exp(-pow(h / 1.7, 1.3)))", "(1 - exp(-pow(h / 1.7, 2)))"

#: Every model and its closed form at the parameters above.
MODELS = {
    "circular": "CASE WHEN h < 1.7 THEN 0.1 + 0.9 * (1 - 2 / pi() * acos(h / 1.7) + 2 * (h / 1.7) / pi() * sqrt(1 - pow(h / 1.7, 2))) ELSE 1.0 END",
    "cubic": "CASE WHEN h <= 1.7 THEN 0.1 + 0.8 * (7 * pow(h / 1.7, 2) - 35.0 / 4 * pow(h / 1.7, 3) + 7.0 / 2 * pow(h / 1.7, 5) - 3.0 / 4 * pow(h / 1.7, 7)) ELSE 0.9 END",
    "exclass": "0.9 * (1 - exp(-pow(h / 1.7, 1.3)))",
    "exponential": "0.8 * (1 - exp(-h / 1.7)) + 0.1",
    "gaussian": f"0.8 * {GAUSS} + 0.1",
    "jbessel": f"0.8 * (1 - {HOLE}) + 0.1",
    "kbessel": f"CASE WHEN h = 0 THEN 0.1 ELSE 0.8 * (1 - h / 1.5 * {K.format(x='greatest(h, 0.1) / 1.5', v=1)}) + 0.1 END",
    "linear": "0.8 * h + 0.1",
    "linear_plateau": "CASE WHEN h < 1.7 THEN 0.9 * h / 1.7 ELSE 0.9 END",
    "logarithmic": "CASE WHEN h = 0 THEN 0.1 ELSE 0.1 + 0.9 * ln(h + 1.7) END",
    # of half order the Matern model is elementary
    "matern": "0.1 + 0.8 * (1 - (1 + sqrt(3) * h / 1.7) * exp(-sqrt(3) * h / 1.7))",
    "nugget": "CASE WHEN h = 0 THEN 0 ELSE 1.0 END",
    "pentaspherical": "CASE WHEN h <= 1.7 THEN 0.1 + 0.8 * (15 * (h / 1.7) / 8 - 5 * pow(h / 1.7, 3) / 4 + 3 * pow(h / 1.7, 5) / 8) ELSE 0.9 END",
    "periodic": "0.1 + 0.9 * (1 - cos(2 * pi() * h / 1.7))",
    "power": "0.1 + 0.9 * CASE WHEN h = 0 THEN 0 ELSE pow(h, 0.7) END",
    "quadratic": "0.1 + 0.8 * (1 - pow(1 + pow(h / 1.7, 2) / 1.6, -0.8))",
    "sinc": "0.8 * (1 - CASE WHEN h = 0 THEN 1.5 ELSE sin(1.5 * h) / h END) + 0.1",
    "spherical": "CASE WHEN h < 1.7 THEN 0.8 * (3 * h / 3.4 - pow(h, 3) / (2 * pow(1.7, 3))) + 0.1 ELSE 1.0 END",
    "spline": "CASE WHEN h >= 1.7 THEN 0.9 WHEN h = 0 THEN 0 ELSE h * h * ln(h) END",
    # half order again: 2 sqrt(1.5) h / a as the argument
    "stein": "1 - (1 + 2 * sqrt(1.5) * h / 1.7) * exp(-2 * sqrt(1.5) * h / 1.7)",
    "tetraspherical": "CASE WHEN h < 1.7 THEN 0.1 + 0.9 * (asin(h / 1.7) + h / 1.7 * sqrt(1 - pow(h / 1.7, 2)) + 2.0 / 3 * (h / 1.7) * pow(1 - pow(h / 1.7, 2), 1.5)) ELSE 1.0 END",
    "wave": "CASE WHEN h = 0 THEN 0.1 ELSE 0.1 + 0.9 * (1 - 1.7 * sin(pi() * h / 1.7) / (pi() * h)) END",
    "whittle": f"0.1 + 0.9 * (1 - {K.format(x='h / 1.7', v=1)})",
    "bessel_gaussian": f"0.8 * {GAUSS} * {HOLE} + 0.1",
    "bessel_exponential": f"0.8 * {EXPP} * {HOLE} + 0.1",
    "cosine_exponential": "0.8 * (1 + exp(-h / 1.7) * cos(1.5 * h)) + 0.1",
    "cosine_gaussian": "0.8 * exp(-pow(h / 1.7, 2)) * cos(1.5 * h) + 0.1",
    "exponential_linear": f"0.8 * {EXPP} * (1 - 1.5 * pow(h, 1.3)) + 0.1",
    "gaussian_linear": f"0.8 * {GAUSS} * (1 - 1.5 * h * h) + 0.1",
}


def _register(name: str, sql: str) -> None:
    parts = name if name == "linear_plateau" else (name.split("_") if "_" in name else name)

    def run(spark, d):
        h = R.table(spark, d, "part").select(((F.col("p_size") - 1) / 10).alias("h")).distinct()
        if name == "whittle":
            h = h.where("h > 0")
        return h.select("h", F.round(gamma_column(F.col("h"), BASE, parts), 9).alias("gamma"))

    run.__name__ = f"variogram_{name}"
    run.__doc__ = f"The {name} model at distances 0 to 4.9."
    QUERIES[run.__name__] = run
    SQL[run.__name__] = f"WITH {LAGS} SELECT h, round(CAST({sql} AS DOUBLE), 9) AS gamma FROM l" + (" WHERE h > 0" if name == "whittle" else "")


for _name, _sql in MODELS.items():
    _register(_name, _sql)

PAIRS = """g AS (SELECT lag, {inside} AS ok, za, zb, w FROM ({pairs}) WHERE lag < 5),
s AS (SELECT lag, sum(w) FILTER (ok) AS n, sum(w) AS hn, sum(w * za) AS h1, sum(w * za * za) AS h2, sum(w * zb) FILTER (ok) AS t1, sum(w * zb * zb) FILTER (ok) AS t2, sum(w * (za - zb) ** 2) FILTER (ok) AS d FROM g GROUP BY lag),
v AS (SELECT lag, n, d, sqrt(greatest((h2 - 2 * (h1 / n) * h1 + (h1 / n) ** 2 * hn) / n, 0)) * sqrt(abs(t2 / n - (t1 / n) ** 2)) AS sill FROM s)"""
LAG = "CAST(round_even(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 0) AS INTEGER) + 1 AS lag, a.x - b.x AS dx, a.y - b.y AS dy, a.z AS za, b.z AS zb, 1 AS w"
NEAR = "abs(a.x - b.x) < 5 AND abs(a.y - b.y) < 5"
VOUT = "SELECT lag, CAST(lag AS DOUBLE) AS distance, CAST(n AS BIGINT) AS count, round(0.5 * d / (n * sill), 8) AS gamma FROM v"
ZERO = "SELECT 0, CAST(0 AS DOUBLE), (SELECT count(*) - 1 FROM points), CAST(0 AS DOUBLE)"


def gammas(df):
    return df.select("lag", "distance", "count", F.round("gamma", 8).alias("gamma"))


@query(f"WITH {R.LATTICE}, {PAIRS.format(inside='true', pairs=f'SELECT {LAG} FROM points a JOIN points b ON {NEAR} AND a.id <> b.id')} {VOUT} UNION ALL {ZERO}")
def empirical_variogram(spark, d):
    return gammas(variogram.empirical_variogram(R.lattice(spark, d), 5, 1.0, "z", mode="symmetric"))


RANKED = f"WITH {R.LATTICE}, r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS m FROM points)"


@query(f"{RANKED}, {PAIRS.format(inside='true', pairs=f'SELECT {LAG} FROM r a JOIN r b ON {NEAR} AND a.k + b.k <= a.m - 2')} {VOUT}")
def empirical_variogram_compat(spark, d):
    return gammas(variogram.empirical_variogram(R.lattice(spark, d), 5, 1.0, "z", order="id", force_lag_zero=False))


@query(f"{RANKED}, {PAIRS.format(inside='(CASE WHEN dx = 0 THEN 90 * sign(dy) ELSE degrees(atan(dy / dx)) END) BETWEEN -40 AND 39.999999', pairs=f'SELECT {LAG} FROM r a JOIN r b ON {NEAR} AND a.k + b.k <= a.m - 2')} {VOUT}")
def empirical_variogram_azimuth(spark, d):
    return gammas(variogram.empirical_variogram(R.lattice(spark, d), 5, 1.0, "z", order="id", angle=40.0, force_lag_zero=False))


@query()
def variogram_fit(spark, d):
    """The default model fitted to the empirical variogram; tests hold the fit against known parameters."""
    v = variogram.Variogram(1.0, 8).calculate_empirical_variogram(R.lattice(spark, d), "z", azimuth_filter=False, mode="symmetric")
    p = variogram.Parameter
    best = v.fit_variogram_model(["bessel", "exponential"], {"nugget": p(0.2, 0.0, 2.0), "sill": p(0.9, 0.0, 3.0), "correlation_range": p(1.0, 0.01, 10.0), "decay_power": p(1.5, 0.5, 2.0), "hole_effect_range": p(0.1, 0.0, 1.0)})
    return spark.createDataFrame([(k, float(x)) for k, x in sorted((best | {"mad": v.optimized["mad"]}).items())], "parameter string, value double")


#: Known data at distinct positions, and mesh cells off their lattice.
DATA = "data AS (SELECT min(id) AS id, x, y, avg(z) AS z FROM points GROUP BY x, y)"
MESH = "mesh AS (SELECT c_custkey AS cell, c_custkey % 53 + CAST(0.37 AS DOUBLE) AS x, c_custkey // 53 + CAST(0.21 AS DOUBLE) AS y, 1 + c_custkey % 3 AS area FROM customer)"


def data(spark, d):
    return R.points(spark, d).groupBy("x", "y").agg(F.min("id").alias("id"), F.avg("z").alias("z"))


def mesh(spark, d):
    c = R.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("cell"), (F.col("c_custkey") % 53 + 0.37).alias("x"), (F.expr("c_custkey div 53") + 0.21).alias("y"), (1 + F.col("c_custkey") % 3).alias("area"))


NN = "nn AS (SELECT cell, area, px, py, d, id, z, row_number() OVER (PARTITION BY cell ORDER BY d, id) AS k FROM (SELECT cell, area, b.x AS px, b.y AS py, b.id, b.z, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM mesh a JOIN data b ON abs(a.x - b.x) < 60 AND abs(a.y - b.y) < 60) QUALIFY k <= 4)"


@query(f"WITH {R.POINTS}, {DATA}, {MESH}, {NN} SELECT cell, CAST(k AS INTEGER) AS k, id AS number, round(d, 9) AS distance FROM nn")
def kriging_neighbours(spark, d):
    near = kriging.nearest(mesh(spark, d), data(spark, d), "cell", "id", "z", 4, 1.0)
    return near.select("cell", F.posexplode("near").alias("k", "p")).select("cell", (F.col("k") + 1).alias("k"), F.col("p.number").alias("number"), F.round("p.distance", 9).alias("distance"))


@query(f"WITH {R.POINTS}, {DATA}, {MESH} SELECT cell, count(id) AS n FROM mesh LEFT JOIN data ON (mesh.x - data.x) ** 2 + (mesh.y - data.y) ** 2 <= 2.25 GROUP BY cell")
def radius_counts(spark, d):
    near = kriging.nearest(mesh(spark, d), data(spark, d), "cell", "id", "z", 100, 1.5, limit=1.5)
    return near.select("cell", F.size("near").cast("long").alias("n"))


MODEL = {"model": "exponential", "sill": 0.9, "nugget": 0.1, "correlation_range": 1.7}
GAM = "(0.8 * (1 - exp(-{d} / 1.7)) + 0.1)"
#: Up to three neighbours, the bordered system solved by hand. With fewer than two data within 1 a cell is sparse: it takes two and,
#: with none within 1, tapers; data beyond 1 count as 0.
THREE = f"""h AS (SELECT a.cell, a.area, CASE WHEN a.d <= 1 THEN a.z ELSE 0 END AS z1, CASE WHEN b.d <= 1 THEN b.z ELSE 0 END AS z2, CASE WHEN c.d <= 1 THEN c.z ELSE 0 END AS z3, b.d <= 1 AS two_in, CASE WHEN a.d <= 1 THEN 1 ELSE exp(-(a.d + b.d) / 2) END AS taper,
 {GAM.format(d='a.d')} AS g1, {GAM.format(d='b.d')} AS g2, {GAM.format(d='c.d')} AS g3, {GAM.format(d='sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2)')} AS g12, {GAM.format(d='sqrt((a.px - c.px) ** 2 + (a.py - c.py) ** 2)')} AS g13, {GAM.format(d='sqrt((b.px - c.px) ** 2 + (b.py - c.py) ** 2)')} AS g23
 FROM nn a JOIN nn b ON a.cell = b.cell AND a.k = 1 AND b.k = 2 JOIN nn c ON a.cell = c.cell AND c.k = 3),
w AS (SELECT *, 4 * g13 * g23 - (g12 - g13 - g23) ** 2 AS det, g12 - g13 - g23 AS q, g1 - g3 - g13 AS u, g2 - g3 - g23 AS v FROM h),
l AS (SELECT *, CASE WHEN two_in THEN (-2 * g23 * u - q * v) / det ELSE 0.5 + (g2 - g1) / (2 * g12) END AS l1, CASE WHEN two_in THEN (-2 * g13 * v - q * u) / det ELSE 0.5 - (g2 - g1) / (2 * g12) END AS l2 FROM w),
e AS (SELECT cell, area, CASE WHEN two_in THEN l1 * z1 + l2 * z2 + (1 - l1 - l2) * z3 ELSE taper * (l1 * z1 + l2 * z2) END AS estimate,
 CASE WHEN two_in THEN l1 * g1 + l2 * g2 + (1 - l1 - l2) * g3 + g3 - g13 * l1 - g23 * l2 ELSE l1 * g1 + l2 * g2 + (g1 + g2 - g12) / 2 END AS kriged_variance,
 CASE WHEN two_in THEN ((z1 - z2) ** 2 + (z1 - z3) ** 2 + (z2 - z3) ** 2) / 6 ELSE (z1 - z2) ** 2 / 2 END AS spread FROM l)"""


def kriged(spark, d):
    near = kriging.nearest(mesh(spark, d), data(spark, d), "cell", "id", "z", 3, 1.0)
    return kriging.estimates(near, MODEL, 2, 3, 1.0, 1e-9)


@query(f"WITH {R.POINTS}, {DATA}, {MESH}, {NN}, {THREE} SELECT cell, round(estimate, 4) AS estimate, round(kriged_variance, 7) AS kriged_variance, CASE WHEN abs(estimate) > 1e-9 THEN round(sqrt(kriged_variance * spread) / abs(estimate), 6) END AS sample_variance FROM e")
def ordinary_kriging(spark, d):
    out = kriged(spark, d)
    return out.select("cell", F.round("estimate", 4).alias("estimate"), F.round("kriged_variance", 7).alias("kriged_variance"), F.round("sample_variance", 6).alias("sample_variance"))


@query(f"""WITH {R.POINTS}, {DATA}, {MESH}, {NN}, {THREE}, t AS (SELECT sum(estimate * area) AS t, avg(area) AS a, sqrt(count(*)) AS n FROM e), s AS (SELECT var_samp(z) AS s FROM data)
SELECT cell, round(greatest(estimate, 0), 4) AS estimate, round(a * sqrt(kriged_variance * s) / t * n, 8) AS cell_cv, round(cv, 8) AS survey_cv FROM e, t, s, (SELECT sqrt(sum(kriged_variance * area ** 2) * any_value(s)) / any_value(t) AS cv FROM e, s, t)""")
def kriging_projection(spark, d):
    rows = mesh(spark, d).select("cell", "area").join(kriged(spark, d), "cell").checkpoint()
    out, cv = kriging.project(rows, data(spark, d), "z")
    return out.select("cell", F.round("estimate", 4).alias("estimate"), F.round("cell_cv", 8).alias("cell_cv"), F.round(F.lit(cv), 8).alias("survey_cv"))


#: Positions along a coast, by event.
POS = "pos AS (SELECT event_id, user_id % 40 AS transect_num, -126 - (event_id % 97) * CAST(0.03 AS DOUBLE) AS longitude, 34 + (user_id % 40) * CAST(0.3 AS DOUBLE) + (event_id % 5) * CAST(0.01 AS DOUBLE) AS latitude FROM events)"


def positions(spark, d):
    e = R.table(spark, d, "events")
    return e.select("event_id", (F.col("user_id") % 40).alias("transect_num"), (-126 - (F.col("event_id") % 97) * 0.03).alias("longitude"), (34 + (F.col("user_id") % 40) * 0.3 + (F.col("event_id") % 5) * 0.01).alias("latitude"))


@query(f"WITH {POS} SELECT event_id, (CASE WHEN latitude >= 0 THEN '326' ELSE '327' END) || lpad(CAST(CAST(floor((longitude + 180) / 6) % 60 + 1 AS INTEGER) AS VARCHAR), 2, '0') AS epsg FROM pos")
def utm_code(spark, d):
    return positions(spark, d).select("event_id", projection.utm_code(F.col("longitude"), F.col("latitude")).alias("epsg"))


#: Another series than the library's: meridian arc and powers of the longitude difference.
UTM = """m AS (SELECT *, radians(latitude) AS p, cos(radians(latitude)) * radians(longitude - (-129)) AS a, 0.0066943799901413165 AS e2 FROM pos),
q AS (SELECT *, e2 / (1 - e2) * cos(p) ** 2 AS c, tan(p) ** 2 AS t, 6378137 / sqrt(1 - e2 * sin(p) ** 2) AS n,
 6378137 * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256 - 175 * e2 ** 4 / 16384) * p - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024 + 105 * e2 ** 4 / 4096) * sin(2 * p) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024 + 525 * e2 ** 4 / 16384) * sin(4 * p) - (35 * e2 ** 3 / 3072 + 175 * e2 ** 4 / 12288) * sin(6 * p) + 315 * e2 ** 4 / 131072 * sin(8 * p)) AS s FROM m)"""


@query(f"""WITH {POS}, {UTM} SELECT event_id, round(500000 + 0.9996 * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t ** 2 + 72 * c - 58 * e2 / (1 - e2)) * a ** 5 / 120 + (61 - 479 * t + 179 * t ** 2 - t ** 3) * a ** 7 / 5040), 1) AS x,
round(0.9996 * (s + n * tan(p) * (a ** 2 / 2 + (5 - t + 9 * c + 4 * c ** 2) * a ** 4 / 24 + (61 - 58 * t + t ** 2 + 600 * c - 330 * e2 / (1 - e2)) * a ** 6 / 720 + (1385 - 3111 * t + 543 * t ** 2 - t ** 3) * a ** 8 / 40320)), 1) AS y FROM q""")
def utm_coordinates(spark, d):
    rows = projection.with_utm(positions(spark, d), 9, False)
    return rows.select("event_id", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


#: The systems by their textbook forms: tangents and powers instead of inverse hyperbolic functions.
E = "CAST(0.0818191910428158 AS DOUBLE)"
CONIC = """r AS (SELECT event_id, radians(latitude) AS p, radians(longitude - ({origin})) AS l, 0 AS part FROM pos UNION ALL SELECT -k, radians(v), 0, k FROM (VALUES (1, CAST({one} AS DOUBLE)), (2, CAST({two} AS DOUBLE)), (3, CAST({zero} AS DOUBLE))) AS v(k, v)),
m AS (SELECT *, cos(p) / sqrt(1 - ({e} * sin(p)) ** 2) AS m, tan(pi() / 4 - p / 2) / ((1 - {e} * sin(p)) / (1 + {e} * sin(p))) ** ({e} / 2) AS t, (1 - {e} ** 2) * (sin(p) / (1 - ({e} * sin(p)) ** 2) - ln((1 - {e} * sin(p)) / (1 + {e} * sin(p))) / (2 * {e})) AS q FROM r),
c AS (SELECT max(m) FILTER (part = 1) AS m1, max(m) FILTER (part = 2) AS m2, max(t) FILTER (part = 1) AS t1, max(t) FILTER (part = 2) AS t2, max(t) FILTER (part = 3) AS t0, max(q) FILTER (part = 1) AS q1, max(q) FILTER (part = 2) AS q2, max(q) FILTER (part = 3) AS q0 FROM m)"""


@query(f"""WITH {POS}, {CONIC.format(origin=-120.5, one=43, two=45.5, zero=41.75, e=E)}, k AS (SELECT *, ln(m1 / m2) / ln(t1 / t2) AS n FROM c), f AS (SELECT *, m1 / (n * t1 ** n) AS f FROM k)
SELECT event_id, round(400000 + 6378137 * f * t ** n * sin(n * l), 1) AS x, round(6378137 * f * (t0 ** n - t ** n * cos(n * l)), 1) AS y FROM m, f WHERE part = 0""")
def lambert_coordinates(spark, d):
    rows = systems.reproject(positions(spark, d), "epsg:2991")
    return rows.select("event_id", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


@query(f"""WITH {POS}, {CONIC.format(origin=-126, one=50, two=58.5, zero=45, e=E)}, k AS (SELECT *, (m1 ** 2 - m2 ** 2) / (q2 - q1) AS n FROM c), f AS (SELECT *, m1 ** 2 + n * q1 AS f FROM k)
SELECT event_id, round(1000000 + 6378137 * sqrt(f - n * q) / n * sin(n * l), 1) AS x, round(6378137 * (sqrt(f - n * q0) - sqrt(f - n * q) * cos(n * l)) / n, 1) AS y FROM m, f WHERE part = 0""")
def albers_coordinates(spark, d):
    rows = systems.reproject(positions(spark, d), "epsg:3005")
    return rows.select("event_id", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


@query(f"""WITH {POS} SELECT event_id, round(6378137 * radians(longitude), 1) AS x, round(6378137 * ln(tan(pi() / 4 + radians(latitude) / 2) * ((1 - e * sin(radians(latitude))) / (1 + e * sin(radians(latitude)))) ** (e / 2)), 1) AS y,
round(6378137 * ln(tan(pi() / 4 + radians(latitude) / 2)), 1) AS web_y FROM pos, (SELECT CAST(0.08181919084262149 AS DOUBLE) AS e)""")
def mercator_coordinates(spark, d):
    rows = systems.reproject(systems.reproject(positions(spark, d), "epsg:3857", names=("_x", "web_y")), "epsg:3395")
    return rows.select("event_id", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.round("web_y", 1).alias("web_y"))


#: Into each system, on into the next, and back to degrees.
TOUR = ("2991", "32609", "3310", "3395", "3347", "32710", "3857", "3338", "5070")


@query(f"WITH {POS} SELECT event_id, round(longitude, 8) AS longitude, round(latitude, 8) AS latitude FROM pos")
def reprojection_tour(spark, d):
    """Every system's forward and inverse: what comes back is where it began."""
    rows, crs = positions(spark, d).withColumnsRenamed({"longitude": "x", "latitude": "y"}), "4326"
    for code in (*TOUR, "4326"):
        rows, crs = systems.reproject(rows, code, ("x", "y"), crs).select("event_id", "x", "y"), code
    return rows.select("event_id", F.round("x", 8).alias("longitude"), F.round("y", 8).alias("latitude"))


#: A reference line: one longitude per latitude.
LINE = "line AS (SELECT 33 + n_nationkey * CAST(0.5 AS DOUBLE) AS latitude, -124 - n_nationkey * n_nationkey * CAST(0.01 AS DOUBLE) AS longitude FROM nation)"


def line(spark, d):
    n = R.table(spark, d, "nation")
    return n.select((33 + F.col("n_nationkey") * 0.5).alias("latitude"), (-124 - F.col("n_nationkey") * F.col("n_nationkey") * 0.01).alias("longitude"))


@query(f"""WITH {POS}, {LINE}, seg AS (SELECT latitude AS y0, longitude AS x0, lead(latitude) OVER (ORDER BY latitude) AS y1, lead(longitude) OVER (ORDER BY latitude) AS x1 FROM line),
j AS (SELECT event_id, longitude, latitude, longitude - coalesce(x0 + (x1 - x0) * (latitude - y0) / (y1 - y0), x0) - 124.78338 AS t FROM pos LEFT JOIN seg ON latitude >= y0 AND (latitude < y1 OR y1 IS NULL AND latitude = y0)),
e AS (SELECT max(t) - min(t) AS dx, max(latitude) - min(latitude) AS dy FROM j)
SELECT event_id, round(cos(radians(latitude)) * (t + 124.78338) / dx, 8) AS x, round((latitude - 45) / dy, 8) AS y FROM j, e""")
def standard_coordinates(spark, d):
    out, _, _ = cropping.transform_coordinates(positions(spark, d), -124.78338, 45.0, reference=line(spark, d))
    return out.select("event_id", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


@query(f"WITH {POS} SELECT transect_num, round(avg(longitude), 8) AS longitude, round(avg(latitude), 8) AS latitude FROM (SELECT DISTINCT transect_num, longitude, latitude FROM pos) GROUP BY transect_num")
def transect_centroids(spark, d):
    return cropping.centroids(positions(spark, d), x="longitude", y="latitude").select("transect_num", F.round("longitude", 8).alias("longitude"), F.round("latitude", 8).alias("latitude"))


def grid(spark, d):
    c = R.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("cell"), (-134 + (F.col("c_custkey") % 61) * 0.17).alias("longitude"), (33 + (F.col("c_custkey") * 7 % 37) * 0.43).alias("latitude"))


@query()
def hull_crop(spark, d):
    """Mesh cells inside the buffered survey; a test holds it against brute force."""
    return cropping.hull_crop(positions(spark, d), grid(spark, d), 3, 2.5)


#: Slanted blocks of cells per part and their union by brand; a cell (i, j) is a parallelogram.
BLOCKS = "b AS (SELECT p_partkey, p_brand, p_size % 10 AS i0, p_partkey // 200 AS j0, 1 + p_partkey % 5 AS w, 1 + p_size % 3 AS h FROM part)"


@query(f"""WITH {BLOCKS}, c AS (SELECT DISTINCT p_brand, i, j FROM (SELECT p_brand, unnest(range(i0, i0 + w)) AS i, j0, h FROM b), LATERAL (SELECT unnest(range(j0, j0 + h)) AS j)),
e AS (SELECT c.p_brand, (CASE WHEN l.i IS NULL THEN 1 ELSE 0 END) + (CASE WHEN r.i IS NULL THEN 1 ELSE 0 END) AS v, (CASE WHEN d.i IS NULL THEN 1 ELSE 0 END) + (CASE WHEN u.i IS NULL THEN 1 ELSE 0 END) AS s
 FROM c LEFT JOIN c l ON l.p_brand = c.p_brand AND l.i = c.i - 1 AND l.j = c.j LEFT JOIN c r ON r.p_brand = c.p_brand AND r.i = c.i + 1 AND r.j = c.j
 LEFT JOIN c d ON d.p_brand = c.p_brand AND d.i = c.i AND d.j = c.j - 1 LEFT JOIN c u ON u.p_brand = c.p_brand AND u.i = c.i AND u.j = c.j + 1)
SELECT p_brand, round(count(*) * CAST(1.03 AS DOUBLE), 6) AS area, round(sum(v) * sqrt(CAST(0.73 AS DOUBLE)) + sum(s) * sqrt(CAST(1.46 AS DOUBLE)), 6) AS length FROM e GROUP BY p_brand""")
def extent_union(spark, d):
    """Area and length of the union of slanted blocks per brand; the SQL counts cells."""
    p = R.table(spark, d, "part")
    i, j = F.col("p_size") % 10, F.floor(F.col("p_partkey") / 200)
    w, h = 1 + F.col("p_partkey") % 5, 1 + F.col("p_size") % 3
    at = lambda a, b: F.struct((a * 1.1 - b * 0.3).alias("x"), (a * 0.5 + b * 0.8).alias("y"))
    blocks = p.select("p_brand", "p_partkey", F.array(at(i, j), at(i + w, j), at(i + w, j + h), at(i, j + h)).alias("corners"))
    out = outline.measures(outline.outline(blocks, "p_partkey", by=["p_brand"]), ["p_brand"])
    return out.select("p_brand", F.round("area", 6).alias("area"), F.round("length", 6).alias("length"))


@query(f"WITH {POS} SELECT event_id, longitude, latitude FROM pos WHERE longitude BETWEEN -128 AND -123 AND latitude BETWEEN 35 AND 45.5")
def geometry_box(spark, d):
    """All positions written as geometries; those of a box read back, coordinates from their bytes."""
    path = f"{prepare(spark).sparkContext._jsc.sc().getCheckpointDir().get()}/positions-{uuid4().hex}"
    geometry.write(geometry.with_geometry(positions(spark, d)).drop("longitude", "latitude"), path)
    shape = F.get(F.get(F.col("s.rings"), F.lit(0)), F.lit(0))
    rows = geometry.read(spark, path, (-128, 35, -123, 45.5)).select("event_id", geometry.parsed("geometry").alias("s"))
    return rows.select("event_id", shape["x"].alias("longitude"), shape["y"].alias("latitude"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity, lead(l_linenumber) OVER w AS n1, lead(l_quantity) OVER w AS q1 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity))
SELECT l_orderkey, count(*) AS n, 9 + 16 * count(*) AS n_bytes, round(coalesce(sum(sqrt((n1 - l_linenumber) * (n1 - l_linenumber) + (q1 - l_quantity) * (q1 - l_quantity))), 0), 6) AS length FROM p GROUP BY l_orderkey""")
def geometry_lines(spark, d):
    """Per order the line through its items as a geometry: points, bytes and length read back."""
    prepare(spark)
    at = F.struct(F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    lines = R.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(at)).alias("p"))
    rows = lines.select("l_orderkey", geometry.line(F.col("p")).alias("g"))
    rows = rows.select("l_orderkey", F.octet_length("g").alias("n_bytes"), geometry.parsed("g").alias("s"))
    return rows.select("l_orderkey", F.size(F.get(F.col("s.rings"), F.lit(0))).cast("long").alias("n"), F.col("n_bytes").cast("long").alias("n_bytes"), F.round(geometry.length(F.col("s.rings")), 6).alias("length"))
