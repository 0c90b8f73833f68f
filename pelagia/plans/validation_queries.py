"""Queries of the checks: parameter tables and surveys' tables made from the given ones, with what they break."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia import validation
from pelagia.plans import roles as R
from pelagia.plans.registry import QUERIES, SQL, query

TENTHS = "CAST(10 AS DOUBLE)"
#: By schema: its parameters as expressions of a part, that both dialects read; and what each rule forbids, in SQL.
CASES = {
    "kriging": (
        {"aspect_ratio": f"(p_size % 13 - 1) / {TENTHS}", "k_min": "p_size % 7", "k_max": "p_partkey % 11", "search_radius": "p_partkey % 5 - 1"},
        {"aspect_ratio": "aspect_ratio <= 0 OR aspect_ratio > 1", "k_min": "k_min < 2", "search_radius": "search_radius <= 0", "k_min <= k_max": "k_min > k_max"},
    ),
    "variogram_model": (
        {"correlation_range": "p_size % 3", "decay_power": f"p_partkey % 25 / {TENTHS}", "hole_effect_range": "p_size % 4 - 1", "sill": f"p_size % 9 / {TENTHS}", "nugget": f"(p_partkey % 10 - 1) / {TENTHS}", "smoothness_parameter": "p_partkey % 12", "shape_parameter": "p_partkey % 103", "power_exponent": f"p_size % 22 / {TENTHS}"},
        {"correlation_range": "correlation_range <= 0", "decay_power": "decay_power <= 0 OR decay_power > 2", "hole_effect_range": "hole_effect_range < 0", "sill": "sill <= 0", "nugget": "nugget < 0", "smoothness_parameter": "smoothness_parameter <= 0 OR smoothness_parameter > 10", "shape_parameter": "shape_parameter <= 0 OR shape_parameter > 100", "power_exponent": "power_exponent <= 0 OR power_exponent >= 2", "nugget < sill": "sill <= nugget"},
    ),
    "ts_regression": ({"slope": "CASE WHEN p_size % 4 > 0 THEN p_size END", "intercept": "CASE WHEN p_partkey % 3 > 0 THEN -p_size END"}, {"slope": "slope IS NULL", "intercept": "intercept IS NULL"}),
    "environment": ({"sound_speed_sw": "p_size % 4 * 500", "density_sw": "CASE WHEN p_partkey % 2 = 0 THEN p_size - 3 END"}, {"sound_speed_sw": "sound_speed_sw <= 0", "density_sw": "density_sw <= 0"}),
    "single_parameter": ({"min": "p_size % 10", "value": "p_partkey % 12", "max": "p_size % 10 + p_partkey % 5"}, {"min <= value <= max": "value < min OR value > max"}),
    "selectivity": (
        {"slope": "CASE WHEN p_size % 2 = 0 THEN 1 END", "intercept": "CASE WHEN p_size % 3 > 0 THEN -4 END", "l50": "CASE WHEN p_size % 2 = 1 THEN p_partkey % 20 END", "selection_range": "CASE WHEN p_size % 3 = 0 THEN p_partkey % 4 END"},
        {"l50": "l50 <= 0", "selection_range": "selection_range <= 0", "slope and intercept or l50 and selection_range": "NOT (slope IS NOT NULL AND intercept IS NOT NULL AND l50 IS NULL AND selection_range IS NULL OR slope IS NULL AND intercept IS NULL AND l50 IS NOT NULL AND selection_range IS NOT NULL)"},
    ),
    "pcdwba_parameters": (
        {"g": f"p_size % 12 / {TENTHS}", "h": f"p_partkey % 12 / {TENTHS}", "length_mean": "p_size % 5", "length_radius_ratio": "p_size % 17", "length_sd_norm": f"(p_size % 6 - 1) / {TENTHS}", "number_density": "p_partkey % 6", "radius_of_curvature_ratio": "p_partkey % 4", "theta_mean": "p_partkey % 400 - 200", "theta_sd": "p_size % 40 - 1"},
        {"g": "g <= 0", "h": "h <= 0", "length_mean": "length_mean <= 0", "length_radius_ratio": "length_radius_ratio <= 0", "length_sd_norm": "length_sd_norm < 0", "number_density": "number_density <= 0", "radius_of_curvature_ratio": "radius_of_curvature_ratio <= 0", "theta_mean": "theta_mean < -180 OR theta_mean > 180", "theta_sd": "theta_sd < 0"},
    ),
    "distribution": ({"bins": f"p_size / {TENTHS}", "family": "CASE p_partkey % 3 WHEN 0 THEN 'gaussian' WHEN 1 THEN 'uniform' ELSE 'other' END"}, {"bins": "bins <> floor(bins)", "family": "family NOT IN ('gaussian', 'uniform')"}),
    "variogram_class": ({"lag_resolution": f"(p_size % 8 - 1) / {TENTHS}", "n_lags": "p_partkey % 9"}, {"lag_resolution": "lag_resolution <= 0", "n_lags": "n_lags <= 0"}),
    "hull_crop": ({"num_nearest_transects": "p_size % 6", "mesh_buffer_distance": "p_partkey % 9 - 1"}, {"num_nearest_transects": "num_nearest_transects <= 0", "mesh_buffer_distance": "mesh_buffer_distance < 0"}),
    "simulation": ({"mc_realizations": f"p_partkey % 30 / {TENTHS}", "mc_seed": "p_size", "minimum_frequency_count": f"p_size / {TENTHS}"}, {"mc_realizations": "mc_realizations <> floor(mc_realizations)", "minimum_frequency_count": "minimum_frequency_count <> floor(minimum_frequency_count)"}),
}


def _register(schema: str, given: dict[str, str], forbidden: dict[str, str]) -> None:
    def run(spark, d):
        p = R.table(spark, d, "part").selectExpr("p_partkey", *[f"{e} AS `{k}`" for k, e in given.items()])
        return p.select("p_partkey", F.array_join(validation.violations(p.drop("p_partkey"), schema), "; ").alias("broken"))

    run.__name__, run.__doc__ = f"violations_{schema}", f"What each of a table of {schema} parameters breaks."
    QUERIES[run.__name__] = run
    cases = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in forbidden.items())
    SQL[run.__name__] = f"SELECT p_partkey, concat_ws('; ', {cases}) AS broken FROM (SELECT p_partkey, " + ", ".join(f'{e} AS "{k}"' for k, e in given.items()) + " FROM part)"


for _name, (_given, _forbidden) in CASES.items():
    _register(_name, _given, _forbidden)

#: Positions of which some are missing or off the globe.
PLACES = "places AS (SELECT CASE WHEN event_id % 7 > 0 THEN event_id % 400 - 200.0 END AS longitude, event_id % 190 - 95.0 AS latitude, CASE WHEN event_id % 5 > 0 THEN 1 END AS area FROM events)"


@query(f"""WITH {PLACES} SELECT 'longitude' AS "column", count(*) FILTER (longitude IS NULL) AS nulls, count(*) FILTER (longitude < -180 OR longitude > 180) AS beyond FROM places
UNION ALL SELECT 'latitude', count(*) FILTER (latitude IS NULL), count(*) FILTER (latitude < -90 OR latitude > 90) FROM places UNION ALL SELECT 'area', count(*) FILTER (area IS NULL), 0 FROM places""")
def violations_tables(spark, d):
    """Missing and impossible values of a mesh's columns, counted in one pass."""
    e = R.table(spark, d, "events")
    places = e.select(F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 400 - 200.0).alias("longitude"), (F.col("event_id") % 190 - 95.0).alias("latitude"), F.when(F.col("event_id") % 5 > 0, 1).alias("area"))
    return validation.bad_values(places)
