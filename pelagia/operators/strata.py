"""Strata: by haul, by identifier, by latitude, and values for strata that have none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_strata(df: DataFrame, strata: DataFrame, key: str = "haul_num", default: float = 0.0, name: str = "stratum_num") -> DataFrame:
    """The stratum of each row's key; ``default`` where the key has none."""
    taken = strata.select(F.col(key), F.col("stratum_num").alias(name))
    return df.drop(name).join(taken, key, "left").withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(default)))


def latitude_bands(limits: DataFrame, stratum: str = "stratum_num", north: str = "northlimit_latitude") -> DataFrame:
    """(stratum, south, north) of each band [south, north); the band above the last limit is stratum 1."""
    w = Window.orderBy(north)  # one row per stratum
    bands = limits.select(F.col(stratum), F.coalesce(F.lag(north).over(w), F.lit(-90.0)).alias("south"), F.col(north).alias("north"))
    top = limits.agg(F.lit(1).cast("int").alias(stratum), F.max(north).alias("south"), F.lit(90.0).alias("north"))
    return bands.unionByName(top.select(F.col(stratum).cast(bands.schema[stratum].dataType), "south", "north"))


def join_by_latitude(df: DataFrame, limits: DataFrame, latitude: str = "latitude", name: str = "stratum_num") -> DataFrame:
    """Range join: the band that holds each latitude.

    Bands are cut into whole degrees, so that the join is an equality of degrees
    with the exact bounds checked after it; latitudes outside all bands get null.
    """
    bands = latitude_bands(limits).withColumnRenamed("stratum_num", name)
    cells = bands.withColumn("_deg", F.explode(F.sequence(F.floor("south"), F.floor("north"))))
    rows = df.drop(name).withColumn("_deg", F.floor(latitude))
    hit = (rows["_deg"] == cells["_deg"]) & (F.col(latitude) >= F.col("south")) & (F.col(latitude) < F.col("north"))
    return rows.join(cells, hit, "left").drop("_deg", "south", "north")


def band_table(limits: DataFrame) -> DataFrame:
    """Each limit's right-closed latitude interval."""
    w = Window.orderBy("northlimit_latitude")
    return limits.withColumns({"lat_left": F.coalesce(F.lag("northlimit_latitude").over(w), F.lit(-90.0)), "lat_right": F.col("northlimit_latitude")})


def drop_specimen_only_hauls(catch: DataFrame, length: DataFrame) -> DataFrame:
    """Catches of hauls that have length samples."""
    return catch.join(length.select("haul_num").distinct(), "haul_num", "left_semi")


def impute_strata(spine: DataFrame, values: DataFrame, stratum: str = "stratum_num", value: str = "sigma_bs") -> DataFrame:
    """Strata without a value get the mean of the nearest lower and upper ones that have it; at an edge, the nearest."""
    rows = spine.select(stratum).distinct().join(values.select(stratum, value), stratum, "left")
    w = Window.orderBy(stratum)  # one row per stratum
    low = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.select(stratum, F.coalesce(F.col(value), (F.coalesce(low, high) + F.coalesce(high, low)) / 2).alias(value))


def shared(frames: dict[str, DataFrame], strata: DataFrame, **how) -> dict[str, DataFrame]:
    """``join_strata`` over a named collection; frames without the key stay as they are."""
    key = how.get("key", "haul_num")
    return {n: join_strata(df, strata, **how) if key in df.columns else df for n, df in frames.items()}


def number(limits: Sequence[float]) -> list[int]:
    """Stratum numbers of north limits in order."""
    return list(range(1, len(limits) + 1))
