"""Acoustic inversion by target strength, volume-backscatter integration and net selectivity."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.operators.biology import sigma

FOUR_PI = 4 * math.pi
NMI = 1852.0


def ts_length(length: Column, slope: float = 20.0, intercept: float = -68.0) -> Column:
    """Target strength of a length."""
    return slope * F.log10(length) + intercept


def _names(stratum: str | Sequence[str]) -> list[str]:
    """The columns that hold the strata."""
    return [stratum] if isinstance(stratum, str) else list(stratum)


def haul_sigma(frames: Sequence[DataFrame], stratum: str | Sequence[str], slope: float = 20.0, intercept: float = -68.0) -> DataFrame:
    """Mean cross-section per stratum and haul over all fish of all frames, with their number."""
    strata, counts = _names(stratum), None
    for df in frames:
        n = F.sum("length_count") if "length_count" in df.columns else F.count("*")
        part = df.where("length IS NOT NULL").groupBy(*strata, "haul_num", "length").agg(n.cast("double").alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    s = sigma(F.col("length"), slope, intercept)
    return counts.groupBy(*strata, "haul_num").agg(F.try_divide(F.sum(s * F.col("n")), F.sum("n")).alias("sigma_bs"), F.sum("n").alias("n"))


def strata_sigma(by_haul: DataFrame, stratum: str | Sequence[str], haul_replicates: bool = True) -> DataFrame:
    """Mean cross-section per stratum: of hauls as replicates, or of all fish."""
    mean = F.avg("sigma_bs") if haul_replicates else F.try_divide(F.sum(F.col("sigma_bs") * F.col("n")), F.sum("n"))
    return by_haul.groupBy(*_names(stratum)).agg(mean.alias("sigma_bs"))


def invert(nasc: DataFrame, sigma_bs: DataFrame, stratum: str | Sequence[str]) -> DataFrame:
    """Number density of every interval: NASC (times nasc_proportion, if there) / (4 pi sigma); 0 without one."""
    share = F.col("nasc_proportion") if "nasc_proportion" in nasc.columns else F.lit(1.0)
    out = nasc.join(sigma_bs, _names(stratum), "left")
    return out.withColumn("number_density", F.coalesce(share * F.try_divide(F.col("nasc"), FOUR_PI * F.col("sigma_bs")), F.lit(0.0))).drop("sigma_bs")


def sv_threshold(df: DataFrame, limits: Mapping[float, tuple[float, float]]) -> DataFrame:
    """Volume backscatter outside its frequency's range becomes null."""
    value = F.col("sv_mean")
    for frequency, (low, high) in limits.items():
        value = F.when((F.col("frequency") == frequency) & ~F.col("sv_mean").between(low, high), None).otherwise(value)
    return df.withColumn("sv_mean", value)


def sv_to_nasc(sv_linear: Column, thickness: Column) -> Column:
    """Nautical area scattering coefficient of linear volume backscatter over a thickness."""
    return FOUR_PI * NMI**2 * sv_linear * thickness


def linear(df: DataFrame) -> DataFrame:
    """Rows with backscatter, its linear form, and NASC where that is missing."""
    out = df.where("sv_mean IS NOT NULL").withColumn("sv_mean_linear", F.pow(F.lit(10.0), F.col("sv_mean") / 10))
    own = sv_to_nasc(F.col("sv_mean_linear"), F.col("thickness_mean"))
    return out.withColumn("nasc", F.coalesce("nasc", own) if "nasc" in df.columns else own)


def sv_cells(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means per cell and frequency."""
    return linear(df).groupBy(*keys, "frequency").agg(F.avg("sv_mean").alias("sv_mean"), F.avg("nasc").alias("nasc"), F.avg("thickness_mean").alias("thickness_mean"))


def sv_intervals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums over the water column per interval and frequency."""
    sv = 10 * F.log10(F.sum(F.col("sv_mean_linear") * F.col("thickness_mean")))
    return linear(df).groupBy(*keys, "frequency").agg(sv.alias("sv_mean"), F.sum("nasc").alias("nasc"), F.sum("thickness_mean").alias("thickness_mean"))


def sv_transects(df: DataFrame, distance: Column, transect: str = "transect_num", interval: str = "interval") -> DataFrame:
    """Area-weighted backscatter, NASC-weighted position and mean water column per transect and frequency.

    Two aggregates, by interval and then by transect, stand in for the windows
    over whole transects.
    """
    rows = linear(df).withColumn("_area", distance * F.col("thickness_mean"))
    by = rows.groupBy("frequency", transect, interval).agg(
        F.sum("_area").alias("a"), F.sum(F.col("_area") * F.col("sv_mean_linear")).alias("as"), F.sum("nasc").alias("s"), F.sum(F.col("nasc") * F.col("longitude")).alias("sx"), F.sum(F.col("nasc") * F.col("latitude")).alias("sy"),
        F.sum("thickness_mean").alias("t"), F.count("*").alias("n"),
    )
    return by.groupBy("frequency", transect).agg(
        F.try_divide(F.sum("sx"), F.sum("s")).alias("longitude_weighted"), F.try_divide(F.sum("sy"), F.sum("s")).alias("latitude_weighted"), (10 * F.log10(F.sum("as") / F.sum("a"))).alias("sv_mean"),
        F.sum("s").alias("nasc"), (F.sum(F.col("t") * F.col("n")) / F.sum("n")).alias("thickness_mean"),
    )


def widen(df: DataFrame, keys: Sequence[str], frequencies: Sequence[float]) -> DataFrame:
    """One row per key with a column ``<value>_<frequency>`` each; empty cells 0, and -999 for backscatter."""
    cells = []
    for f in frequencies:
        for name, empty in (("sv_mean", -999.0), ("nasc", 0.0), ("thickness_mean", 0.0)):
            cells.append(F.coalesce(F.max(F.when(F.col("frequency") == f, F.col(name))), F.lit(empty)).alias(f"{name}_{f:g}"))
    return df.where(F.col("frequency").isin(list(frequencies))).groupBy(*keys).agg(*cells)


def l50_and_range(params: Mapping[str, float]) -> tuple[float, float]:
    """Length at half retention and selection range, given or from a logistic slope and intercept."""
    if {"l50", "selection_range"} <= set(params):
        return params["l50"], params["selection_range"]
    return -params["intercept"] / params["slope"], 2 * math.log(3) / params["slope"]


def selectivity_expansion(df: DataFrame, nets: Mapping[str, Mapping[str, float]], net: str, minimum: float = 1e-12, compat: bool = False) -> DataFrame:
    """Add ``selectivity_expansion`` = 1 / retention at the row's length; null for an unknown net.

    ``compat`` takes the difference K * L50 - L over the range, as older results did.
    """
    k, l50, sr = 2 * math.log(3), F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, params in nets.items():
        a, b = l50_and_range(params)
        l50, sr = F.when(F.col(net) == name, a).otherwise(l50), F.when(F.col(net) == name, b).otherwise(sr)
    power = (k * l50 - F.col("length")) / sr if compat else k * (l50 - F.col("length")) / sr
    return df.withColumn("selectivity_expansion", F.when(l50.isNotNull(), 1 / F.greatest(1 / (1 + F.exp(power)), F.lit(minimum))))


def krill_population(parameters: DataFrame, acoustic: DataFrame, keys: Sequence[str], density_sw: float, method: str = "interval", transect: str = "transect_num") -> DataFrame:
    """Areal number and biomass density from inverted parameters (one row per key) at the reference frequency.

    ``acoustic`` has nasc and thickness_mean per key and, for ``transect``, reference_nasc of each interval.
    """
    radius = F.col("length_mean") / F.col("length_radius_ratio")
    p = parameters.withColumn("body_weight", math.pi * radius * radius * F.col("length_mean") * density_sw * F.col("g"))
    rows = acoustic.join(p, list(keys), "left")
    if method == "transect":
        n = acoustic.groupBy(transect).agg(F.count("reference_nasc").alias("_n"))
        rows = rows.join(n, transect).withColumn("_d", F.col("number_density") * F.try_divide("reference_nasc", "nasc") * F.col("thickness_mean") * F.col("_n")).drop("_n")
    else:
        rows = rows.withColumn("_d", F.col("number_density") * F.col("thickness_mean"))
    rows = rows.withColumn("areal_number_density", F.coalesce(F.col("_d"), F.lit(0.0)) * NMI**2).drop("_d")
    return rows.withColumn("biomass_density", F.coalesce(F.col("areal_number_density") * F.col("body_weight"), F.lit(0.0)))
