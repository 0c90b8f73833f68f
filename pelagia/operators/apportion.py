"""Apportionment of population estimates over age, length and sex."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUR_PI = 12.566370614359172


def remove_group(df: DataFrame, shares: DataFrame, stratum: str, families: Mapping[str, str]) -> DataFrame:
    """Take a group's share out of estimates: column times (1 - its family's share of the stratum).

    ``families`` maps columns of ``df`` to columns of ``shares``; other columns
    stay. A stratum without a share loses nothing.
    """
    rows = df.join(shares.select(stratum, *{c: F.col(c).alias(f"_{c}") for c in families.values()}.values()), stratum, "left")
    out = rows.withColumns({c: F.col(c) * (1 - F.coalesce(f"_{s}", F.lit(0.0))) for c, s in families.items()})
    return out.drop(*{f"_{s}" for s in families.values()})


def mesh_to_nasc(mesh: DataFrame, shares: DataFrame, weights: DataFrame, sigma: DataFrame, stratum: str, category: str = "sex") -> DataFrame:
    """Mesh biomass as biomass per category, abundance and NASC (long, one row per cell and category)."""
    p = shares.groupBy(stratum, category).agg(F.sum("proportion").alias("_p"))
    each = mesh.join(p, stratum).withColumn("biomass", F.col("biomass") * F.col("_p")).drop("_p")
    rows = mesh.withColumn(category, F.lit("all")).unionByName(each.select(*mesh.columns, category))
    rows = rows.join(weights, [stratum, category], "left").withColumn("abundance", F.try_divide("biomass", "average_weight"))
    return rows.join(sigma, stratum, "left").withColumn("nasc", F.col("abundance") * F.col("sigma_bs") * FOUR_PI).drop("average_weight", "sigma_bs")


def distribute(df: DataFrame, proportions: DataFrame, stratum: str, keys: Sequence[str], value: str, group: str | None = None) -> DataFrame:
    """A stratum's total spread over its proportions, normalised over all their rows (all sources together)."""
    total = df.groupBy(stratum).agg(F.sum(value).alias("_total"))
    norm = proportions.groupBy(stratum).agg(F.sum("proportion").alias("_norm"))
    rows = proportions.join(norm, stratum).join(total, stratum)
    return rows.select(stratum, *([group] if group else []), *keys, (F.col("_total") * F.try_divide("proportion", "_norm")).alias(value))


def distribute_unaged(unaged: DataFrame, aged: DataFrame, keys: Sequence[str], age: str = "age", value: str = "value") -> DataFrame:
    """Unaged totals of (length, sex, ...) spread over ages as the aged fish are; 0 where none were aged."""
    total = aged.groupBy(*keys).agg(F.sum(value).alias("_t"))
    shares = aged.groupBy(*keys, age).agg(F.sum(value).alias("_a")).join(total, list(keys))
    rows = unaged.groupBy(*keys).agg(F.sum(value).alias("_u")).join(shares, list(keys))
    return rows.select(*keys, age, F.coalesce(F.col("_u") * F.try_divide("_a", "_t"), F.lit(0.0)).alias(value))


def impute_table(unaged: DataFrame, aged: DataFrame, standard: DataFrame, group: Sequence[str], length: str = "length_bin", age: str = "age", value: str = "value") -> DataFrame:
    """Complete ``standard`` for lengths of unaged fish that no aged fish has.

    Each such length takes the ages of the nearest length (by rank, the shorter
    on ties) of its group that has aged fish.
    """
    u = unaged.groupBy(*group, length).agg(F.sum(value).alias("_u")).where("_u <> 0")
    a = aged.groupBy(*group, length).agg(F.sum(value).alias("_a"))
    spine = aged.select(length).union(unaged.select(length)).distinct().withColumn("_rank", F.row_number().over(Window.orderBy(length)))  # one row per bin
    missing = u.join(a.where("_a <> 0"), [*group, length], "left_anti").join(spine, length)
    known = a.where("_a <> 0").join(spine, length).select(*group, F.col(length).alias("_from"), F.col("_rank").alias("_at"), "_a")
    nearest = missing.join(known, list(group)).groupBy(*group, length, "_u").agg(F.min_by(F.struct("_from", "_a"), F.struct(F.abs(F.col("_rank") - F.col("_at")), "_at")).alias("n"))
    ages = aged.groupBy(*group, F.col(length).alias("_from"), age).agg(F.sum(value).alias("_v"))
    filled = nearest.select(*group, length, "_u", "n._from", "n._a").join(ages, [*group, "_from"]).select(*group, length, age, (F.col("_u") * F.try_divide("_v", "_a")).alias(value))
    kept = standard.join(filled.select(*group, length).distinct(), [*group, length], "left_anti")
    return kept.select(*group, length, age, value).unionByName(filled)


def sum_tables(tables: Sequence[DataFrame], keys: Sequence[str], value: str = "value") -> DataFrame:
    """Tables reduced to shared keys and added; cells that any of them lacks are dropped."""
    out = None
    for k, df in enumerate(tables):
        part = df.groupBy(*keys).agg(F.sum(value).alias(f"_{k}"))
        out = part if out is None else out.join(part, list(keys))
    return out.select(*keys, sum((F.col(f"_{k}") for k in range(1, len(tables))), F.col("_0")).alias(value))


def reallocate(df: DataFrame, excluded: Column, group: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Zero the excluded cells and spread their group total over its other cells, in proportion."""
    out = df.withColumn("_x", F.coalesce(excluded, F.lit(False)))
    total = out.groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col("_x"), F.col(value))), F.lit(0.0)).alias("_lost"), F.sum(F.when(~F.col("_x"), F.col(value))).alias("_rest"))
    out = out.join(total, list(group)) if group else out.join(total, F.lit(True))
    moved = F.col(value) + F.coalesce(F.col("_lost") * F.try_divide(F.col(value), F.col("_rest")), F.lit(0.0))
    return out.withColumn(value, F.when(F.col("_x"), 0.0).otherwise(moved)).drop("_x", "_lost", "_rest")
