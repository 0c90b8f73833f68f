"""Checks of parameters and tables before work begins.

A schema names the parameters of one operator, each with a rule; ``check`` gives
them back complete or raises. ``check_frame`` holds a table's columns and ranges
against a rule in one aggregate.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.geostatistics.models import lookup
from pelagia.inversion.parameters import InvParameters, checked
from pelagia.inversion.scattering import MODELS

REQUIRED = object()


@dataclass(frozen=True)
class Rule:
    """A parameter's type and range; ``above`` and ``below`` exclude their bound, ``least`` and ``most`` include it."""

    kind: type | tuple = float
    default: Any = REQUIRED
    above: float | None = None
    least: float | None = None
    below: float | None = None
    most: float | None = None
    choices: Sequence | None = None
    finite: bool = True
    nested: str | None = None

    def judge(self, name: str, v: Any) -> Any:
        if self.nested:
            return check(self.nested, v or {})
        if self.kind is float and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        if self.kind is int and isinstance(v, float) and v.is_integer():
            v = int(v)
        if self.kind is not object and (not isinstance(v, self.kind) or isinstance(v, bool) and self.kind is not bool):
            raise ValueError(f"'{name}' has the wrong type: {v!r}")
        if isinstance(v, float) and (math.isnan(v) or self.finite and math.isinf(v)):
            raise ValueError(f"'{name}' must be a finite number")
        if self.choices is not None and v not in self.choices:
            raise ValueError(f"'{name}' must be one of {', '.join(map(str, self.choices))}, not {v!r}")
        for bad, text in ((self.above is not None and not v > self.above, f"above {self.above}"), (self.least is not None and not v >= self.least, f"at least {self.least}"), (self.below is not None and not v < self.below, f"below {self.below}"), (self.most is not None and not v <= self.most, f"at most {self.most}")):
            if bad:
                raise ValueError(f"'{name}' must be {text}, not {v!r}")
        return v


@dataclass(frozen=True)
class Schema:
    rules: Mapping[str, Rule]
    extra: bool = False
    also: Callable[[dict], dict] = field(default=lambda given: given)


def _sill_above_nugget(p: dict) -> dict:
    if "sill" in p and "nugget" in p and p["sill"] <= p["nugget"]:
        raise ValueError(f"sill ({p['sill']}) must be greater than nugget ({p['nugget']})")
    return p


def _known_model(p: dict) -> dict:
    lookup(p["model"])
    return _sill_above_nugget(p)


def _neighbours(p: dict) -> dict:
    if p["k_min"] > p["k_max"]:
        raise ValueError(f"k_max ({p['k_max']}) must be at least k_min ({p['k_min']})")
    return p


def _draws(p: dict) -> dict:
    p = p | {"monte_carlo": bool(p.get("monte_carlo"))}
    return p | {"mc_realizations": 100} if p["monte_carlo"] and "mc_realizations" not in p else p


def _one_net(p: dict) -> dict:
    given = set(p)
    if given not in ({"slope", "intercept"}, {"l50", "selection_range"}):
        raise ValueError("give either slope and intercept or l50 and selection_range, both and nothing else")
    return p


def _ordered(p: dict) -> dict:
    if not p["min"] <= p["value"] <= p["max"]:
        raise ValueError(f"value ({p['value']}) must lie between min ({p['min']}) and max ({p['max']})")
    return p


def _crs(p: dict) -> dict:
    code = str(p["projection"]).lower().removeprefix("epsg").lstrip(":")
    if not re.fullmatch(r"\d+", code):
        raise ValueError(f"'{p['projection']}' is no EPSG code such as 'epsg:4326'")
    return p | {"projection": f"epsg:{code}"}


NAMES = Rule((tuple, list))
VARIOGRAM = {
    "correlation_range": Rule(default=None, above=0.0), "decay_power": Rule(default=None, above=0.0, most=2.0), "enhance_semivariance": Rule(bool, None), "hole_effect_range": Rule(default=None, least=0.0),
    "sill": Rule(default=None, above=0.0), "nugget": Rule(default=None, least=0.0), "smoothness_parameter": Rule(default=None, above=0.0, most=10.0), "shape_parameter": Rule(default=None, above=0.0, most=100.0), "power_exponent": Rule(default=None, above=0.0, below=2.0),
}
MODEL = Rule((str, list, tuple))
POSITIVE = Rule(above=0.0, finite=False)

SCHEMAS: dict[str, Schema] = {
    "hull_crop": Schema({"num_nearest_transects": Rule(int, above=0), "mesh_buffer_distance": Rule(least=0.0), "projection": Rule((str, int, float), "epsg:4326"), "coordinate_names": NAMES}, also=_crs),
    "variogram_model": Schema(VARIOGRAM, also=_sill_above_nugget),
    "variogram_class": Schema({"coordinate_names": NAMES, "lag_resolution": Rule(above=0.0), "n_lags": Rule(int, above=0)}),
    "empirical_variogram": Schema({"azimuth_angle_threshold": Rule(least=0.0, most=180.0), "azimuth_filter": Rule(bool), "coordinate_names": NAMES, "force_lag_zero": Rule(bool), "variable": Rule(str)}),
    "variogram_fit": Schema({"model": MODEL, "model_parameters": Rule(dict), "optimizer_kwargs": Rule(dict, {})}, also=_known_model),
    "kriging": Schema({"aspect_ratio": Rule(default=1e-3, above=0.0, most=1.0), "k_min": Rule(int, 5, least=2), "k_max": Rule(int, 20), "search_radius": Rule(above=0.0)}, also=_neighbours),
    "kriging_variogram": Schema(VARIOGRAM | {"model": MODEL}, also=_known_model),
    "kriging_class": Schema({"kriging_params": Rule(nested="kriging"), "variogram_params": Rule(nested="kriging_variogram"), "coordinate_names": NAMES}),
    "mesh_crop": Schema({"crop_function": Rule(object), "coordinate_names": NAMES, "kwargs": Rule(dict, {})}),
    "ts_regression": Schema({"slope": Rule(), "intercept": Rule()}),
    "length_ts": Schema({"ts_length_regression": Rule(nested="ts_regression"), "stratify_by": Rule((list, str)), "expected_strata": Rule((list, tuple), None), "impute_missing_strata": Rule(bool, True), "haul_replicates": Rule(bool, True), "haul_column": Rule(str, "haul_num", choices=("haul_num", "uid"))}, also=lambda p: p | {"stratify_by": [p["stratify_by"]] if isinstance(p["stratify_by"], str) else p["stratify_by"]}),
    "environment": Schema({"sound_speed_sw": Rule(default=1500.0, above=0.0), "density_sw": Rule(default=1025.0, above=0.0)}),
    "simulation": Schema({"iter_cb": Rule(object, None), "monte_carlo": Rule(bool, None), "mc_realizations": Rule(int, None), "mc_seed": Rule(int, None), "scale_parameters": Rule(bool, True), "minimum_frequency_count": Rule(int, 2)}, also=_draws),
    "model_settings": Schema({"type": Rule(str), "environment": Rule(default={}, nested="environment")}, extra=True),
    "single_parameter": Schema({"min": Rule(default=-math.inf, finite=False), "value": Rule(), "max": Rule(default=math.inf, finite=False), "vary": Rule(bool, False)}, also=_ordered),
    "pcdwba_parameters": Schema({"g": POSITIVE, "h": POSITIVE, "length_mean": POSITIVE, "length_radius_ratio": POSITIVE, "length_sd_norm": Rule(least=0.0, finite=False), "number_density": POSITIVE, "radius_of_curvature_ratio": POSITIVE, "theta_mean": Rule(least=-180.0, most=180.0), "theta_sd": Rule(least=0.0, finite=False)}),
    "distribution": Schema({"bins": Rule(int, 30), "family": Rule(str, "gaussian", choices=("gaussian", "uniform"))}),
    "pcdwba_settings": Schema({"type": Rule(str), "frequency_interval": Rule(above=0.0), "length_distribution": Rule(default={}, nested="distribution"), "n_integration": Rule(int, 50, above=0), "n_wavelength": Rule(int, 10, above=0), "orientation_distribution": Rule(default={}, nested="distribution"), "taper_order": Rule(default=10.0, above=0.0)}, extra=True),
    "selectivity": Schema({"intercept": Rule(default=None), "slope": Rule(default=None), "l50": Rule(default=None, above=0.0), "selection_range": Rule(default=None, above=0.0)}, also=_one_net),
    "country": Schema({"US": Rule(object, 1), "CAN": Rule(object, 2)}),
    "haul_uid": Schema({"ship_id": Rule(default={}, nested="country"), "survey_id": Rule(default={}, nested="country"), "species_id": Rule(object, 99999), "haul_offset": Rule((int, float), 0), "single_country": Rule(bool, False)}),
}


def check(name: str, given: Mapping[str, Any]) -> dict[str, Any]:
    """Parameters completed by their defaults; those that are None are left out. Unknown, missing or bad ones raise."""
    schema, out = SCHEMAS[name], {}
    unknown = set(given) - set(schema.rules)
    if unknown and not schema.extra:
        raise ValueError(f"{name}: unknown parameters {', '.join(sorted(unknown))}")
    for key, rule in schema.rules.items():
        v = given.get(key, rule.default)
        if v is REQUIRED:
            raise ValueError(f"{name}: '{key}' is required")
        if v is not None:
            out[key] = rule.judge(key, v)
    return schema.also(out | {k: given[k] for k in unknown})


#: Ranges of known columns; null and beyond it are errors.
RANGES = {"longitude": (-180.0, 180.0), "latitude": (-90.0, 90.0), "x": (None, None), "y": (None, None), "area": (None, None), "fraction": (None, None)}
#: Relations between the parameters of a schema: a name, and what breaks it, of columns with defaults filled in.
RELATIONS: dict[str, list[tuple[str, Callable[[Callable], Column]]]] = {
    "kriging": [("k_min <= k_max", lambda c: c("k_min") > c("k_max"))],
    "variogram_model": [("nugget < sill", lambda c: c("sill") <= c("nugget"))],
    "single_parameter": [("min <= value <= max", lambda c: (c("value") < c("min")) | (c("value") > c("max")))],
    "selectivity": [("slope and intercept or l50 and selection_range", lambda c: ~_pair(c, "slope", "intercept", "l50", "selection_range") & ~_pair(c, "l50", "selection_range", "slope", "intercept"))],
}


def _pair(c: Callable, a: str, b: str, other_a: str, other_b: str) -> Column:
    return c(a).isNotNull() & c(b).isNotNull() & c(other_a).isNull() & c(other_b).isNull()


def violations(df: DataFrame, name: str) -> Column:
    """What each row of a table of parameters, a column each, breaks in a schema: an array of names, empty where all is well.

    Numbers, texts and truth values are checked, as ``check`` does one set of parameters; nested
    schemas are tables of their own. Columns that the schema doesn't know break it in every row.
    """
    schema, have = SCHEMAS[name], set(df.columns)

    def value(key: str) -> Column:
        default = schema.rules[key].default
        if default is REQUIRED or default is None:
            return F.col(f"`{key}`") if key in have else F.lit(None).cast("double")
        return F.coalesce(F.col(f"`{key}`"), F.lit(default)) if key in have else F.lit(default)

    def broken(key: str, rule: Rule) -> Column:
        v, bad = value(key), F.lit(False)
        if rule.kind in (float, int):
            x = v.cast("double")
            bad = x.isNull() | F.isnan(x)  # a text that is no number, too
            if rule.kind is int:
                bad = bad | (x != F.floor(x))
            if rule.finite:
                bad = bad | (F.abs(x) == float("inf"))
            for bound, test in ((rule.above, lambda b: x <= b), (rule.least, lambda b: x < b), (rule.below, lambda b: x >= b), (rule.most, lambda b: x > b)):
                bad = bad | test(bound) if bound is not None else bad
        if rule.choices is not None:
            bad = bad | ~v.isin(list(rule.choices))
        return F.when(F.coalesce(bad, F.lit(True)) & v.isNotNull() | (v.isNull() if rule.default is REQUIRED else F.lit(False)), F.lit(key))

    rules = {k: r for k, r in schema.rules.items() if r.kind in (float, int, str, bool) and not r.nested}
    found = [broken(k, r) for k, r in rules.items()]
    found += [F.when(F.coalesce(test(value), F.lit(False)), F.lit(text)) for text, test in RELATIONS.get(name, [])]
    found += [F.lit(c) for c in df.columns if c not in schema.rules and not schema.extra]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def bad_values(df: DataFrame, ranges: Mapping[str, tuple] = RANGES) -> DataFrame:
    """(column, nulls, beyond): how many values of each known column are null or not a number, and how many out of its range."""
    known = [c for c in ranges if c in df.columns]
    if not known:
        return df.sparkSession.createDataFrame([], "column string, nulls long, beyond long")

    def counts(c: str) -> Column:
        x, (low, high) = F.col(c).cast("double"), ranges[c]
        out = (x < low if low is not None else F.lit(False)) | (x > high if high is not None else F.lit(False))
        return F.struct(F.lit(c).alias("column"), F.count_if(x.isNull() | F.isnan(x)).alias("nulls"), F.count_if(out & ~F.isnan(x)).alias("beyond"))

    return df.agg(F.array(*[counts(c) for c in known]).alias("a")).select(F.inline("a"))


def check_scattering(parameters: InvParameters | Mapping, settings: Mapping) -> tuple[InvParameters, dict]:
    """Inversion parameters held against their model, and the model's settings completed.

    Bounds that aren't given are the model's own; an unknown model raises LookupError.
    """
    settings = check("model_settings", settings)
    if settings["type"] not in MODELS:
        raise LookupError(f"scattering model '{settings['type']}' could not be found")
    rules = SCHEMAS[f"{settings['type']}_parameters"].rules
    own = parameters._own if isinstance(parameters, InvParameters) else checked(parameters)
    out = {}
    for name, p in own.items():
        if name not in rules:
            raise ValueError(f"'{name}' is no parameter of '{settings['type']}'")
        rule = rules[name]
        low = rule.least if rule.least is not None else (rule.above + 2.3e-16 if rule.above is not None else -math.inf)
        high = rule.most if rule.most is not None else math.inf
        rule.judge(name, p["value"])
        out[name] = p | {"min": p["min"] if p["min"] > -math.inf else low, "max": p["max"] if p["max"] < math.inf else high}
    missing = set(rules) - set(out)
    if missing:
        raise ValueError(f"parameters of '{settings['type']}' are missing: {', '.join(sorted(missing))}")
    made = InvParameters(out)
    if isinstance(parameters, InvParameters) and parameters.is_scaled:
        made.scale()
    return made, check(f"{settings['type']}_settings", settings)


def check_frame(df: DataFrame, title: str, one_of: Sequence[Sequence[Sequence[str]]], ranges: Mapping[str, tuple] = RANGES) -> DataFrame:
    """The table itself, if it has one column set of each group and no value out of range.

    Known columns are cast to double; counts of bad values come from one aggregate.
    """
    for sets in one_of:
        if not any(set(s) <= set(df.columns) for s in sets):
            raise ValueError(f"{title} needs " + " or ".join(f"({', '.join(s)})" for s in sets))
    known = [c for c in ranges if c in df.columns]
    out = df.withColumns({c: F.col(c).cast("double") for c in known})

    def bad(c: str):
        low, high = ranges[c]
        test = F.col(c).isNull() | F.isnan(c)
        test = test | (F.col(c) < low) if low is not None else test
        return test | (F.col(c) > high) if high is not None else test

    counts = out.agg(*[F.count_if(bad(c)).alias(c) for c in known]).first() if known else {}
    wrong = [f"{c}: {counts[c]}" for c in known if counts[c]]
    if wrong:
        raise ValueError(f"{title} has nulls or values out of range ({'; '.join(wrong)})")
    return out


COORDINATES = [("longitude", "latitude"), ("x", "y")]


def check_mesh(df: DataFrame) -> DataFrame:
    return check_frame(df, "a kriging mesh", [COORDINATES, [("area",), ("fraction",)]])


def check_transects(df: DataFrame) -> DataFrame:
    return check_frame(df, "a table of transects", [COORDINATES], {k: v for k, v in RANGES.items() if k not in ("area", "fraction")})


def check_scatter(df: DataFrame) -> DataFrame:
    """Backscatter in long form: frequency, sv_mean, nasc and thickness_mean."""
    missing = {"frequency", "sv_mean", "nasc", "thickness_mean"} - set(df.columns)
    if missing:
        raise KeyError(f"columns missing from the backscatter: {', '.join(sorted(missing))}")
    return df


def check_hull_crop(transects: DataFrame, mesh: DataFrame, **given) -> dict:
    """Parameters of a hull crop; both tables must share a pair of coordinates."""
    out = check("hull_crop", {"coordinate_names": ("longitude", "latitude")} | given)
    a, b = check_transects(transects), check_mesh(mesh)
    if not any({*pair} <= set(a.columns) & set(b.columns) for pair in COORDINATES):
        raise ValueError("transects and mesh must share (longitude, latitude) or (x, y)")
    return out | {"transects": a, "mesh": b}


def check_empirical(data: DataFrame, **given) -> dict:
    out = check("empirical_variogram", given)
    missing = [c for c in (*out["coordinate_names"], out["variable"]) if c not in data.columns]
    if missing:
        raise KeyError(f"columns missing from the data: {', '.join(missing)}")
    return out | {"data": check_transects(data)}
