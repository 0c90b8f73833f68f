"""Report tables from long estimates: margins by rollup, wide only at the edge.

A table's width is that of the bin grid or of the list of hauls, which a single
small query gives; its rows are bins. ``all`` is male and female together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEXES = ("male", "female", "all")
SUBTOTAL, UNAGED = "Subtotal", "Un-aged"


def of_sex(sex: str, everyone: Sequence[str] = ("male", "female")) -> Column:
    """Rows of a sex; of ``all``, those of everyone."""
    if sex not in SEXES:
        raise ValueError(f"sex '{sex}' is not one of {', '.join(SEXES)}")
    return F.col("sex").isin(*everyone) if sex == "all" else F.col("sex") == sex


def labels(df: DataFrame, column: str) -> list:
    """The values of a column in order: bins or hauls of a survey."""
    return sorted(r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().collect())


def _name(value) -> str:
    return f"{value:g}" if isinstance(value, float) else str(value)


def _wide(rows: DataFrame, row: str, column: str, values: Sequence, cell: Column, last: Mapping[str, Column] | None = None) -> DataFrame:
    """(row, a column per value, Subtotal) with a last row of subtotals, whose own subtotal is null."""
    whole = F.grouping(row) == 1
    cells = [F.coalesce(F.sum(F.when(F.col(column) == v, cell)), F.lit(0)).alias(_name(v)) for v in values]
    extra = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (last or {}).items()]
    out = rows.rollup(row).agg(*cells, *extra, F.when(~whole, F.coalesce(F.sum(cell), F.lit(0))).alias(SUBTOTAL), whole.alias("_whole"))
    # an empty table has no row at all but the rollup's
    return out.where("_whole OR " + f"`{row}` IS NOT NULL")


def age_length_table(aged: DataFrame, sex: str, unaged: DataFrame | None = None, value: str = "value", ages: Sequence | None = None) -> DataFrame:
    """Length by age sums of one sex, with the unaged in a column of their own, and subtotals.

    ``aged`` has sex, length_bin, age_bin and the value, ``unaged`` the same without
    age. Columns: length_bin (null in the last row), ages, Un-aged, Subtotal, _whole.
    """
    ages = labels(aged, "age_bin") if ages is None else ages
    rows = aged.where(of_sex(sex)).select("length_bin", F.col("age_bin").cast("double").alias("age"), F.col(value).alias("v"), F.lit(False).alias("un"))
    last = None
    if unaged is not None:
        rows = rows.unionByName(unaged.where(of_sex(sex)).select("length_bin", F.lit(None).cast("double").alias("age"), F.col(value).alias("v"), F.lit(True).alias("un")))
        last = {UNAGED: F.when(F.col("un"), F.col("v"))}
    return _wide(rows, "length_bin", "age", [float(a) for a in ages], F.col("v"), last)


def haul_counts(specimen: DataFrame, length: DataFrame | None = None) -> DataFrame:
    """(sex, length_bin, haul_num, count) of fish: aged ones by head, with ``length`` unaged ones by their counts.

    ``all`` has the unsexed as well.
    """
    rows = specimen.select("sex", "length_bin", "haul_num", F.lit(1).cast("long").alias("n"))
    if length is not None:
        rows = rows.unionByName(length.select("sex", "length_bin", "haul_num", F.col("length_count").cast("long").alias("n")))
    both = F.explode(F.array_compact(F.array(F.when(F.col("sex").isin("male", "female"), F.col("sex")), F.when(F.col("sex").isin("male", "female", "unsexed"), "all"))))
    return rows.withColumn("sex", both).groupBy("sex", "length_bin", "haul_num").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))


def haul_table(counts: DataFrame, sex: str, hauls: Sequence | None = None) -> DataFrame:
    """Length by haul counts of one sex with subtotals; columns as in ``age_length_table``."""
    hauls = labels(counts, "haul_num") if hauls is None else hauls
    return _wide(counts.where(F.col("sex") == sex), "length_bin", "haul_num", hauls, F.col("count"))


def haul_margins(counts: DataFrame) -> DataFrame:
    """The same in long form for any number of hauls: every cell, every length's and haul's sum, and the whole."""
    sums = counts.groupingSets([["sex", "length_bin", "haul_num"], ["sex", "length_bin"], ["sex", "haul_num"], ["sex"]], "sex", "length_bin", "haul_num")
    return sums.agg(F.sum("count").alias("count"), F.grouping("length_bin").alias("all_lengths"), F.grouping("haul_num").alias("all_hauls"))


def excluded(cells: Mapping[str, Sequence] | None) -> Column:
    """Is a row in any of the listed cells (column to values)?"""
    out = F.lit(False)
    for name, values in (cells or {}).items():
        out = out | F.coalesce(F.col(name).isin(list(values)), F.lit(False))
    return out


def age_shares(weights: DataFrame, stratum: str, sex: str, exclude: Mapping[str, Sequence] | None = None, reallocate: bool = False) -> DataFrame:
    """(stratum, age_bin, share) of a sex's weight by age.

    Excluded cells (column to values) count as 0; with ``reallocate`` their weight
    goes to the rest of their sex and stratum in proportion.
    """
    out = excluded(exclude)
    cells = weights.withColumn("_kept", F.when(out, 0.0).otherwise(F.col("weight"))).withColumn("_gone", F.when(out, F.col("weight")).otherwise(0.0))
    if reallocate:
        sums = cells.groupBy(stratum, "sex").agg(F.sum("_kept").alias("_k"), F.sum("_gone").alias("_g"))
        cells = cells.join(sums, [stratum, "sex"]).withColumn("_kept", F.col("_kept") + F.coalesce(F.try_divide(F.col("_kept") * F.col("_g"), F.col("_k")), F.lit(0.0)))
    rows = cells.where(of_sex(sex)).groupBy(stratum, "age_bin").agg(F.sum("_kept").alias("_w"))
    total = rows.groupBy(stratum).agg(F.sum("_w").alias("_t"))
    return rows.join(total, stratum).select(stratum, "age_bin", F.coalesce(F.try_divide("_w", "_t"), F.lit(0.0)).alias("share"))


def aged_biomass(geodata: DataFrame, shares: DataFrame, stratum: str, sex: str, keep: Sequence[str], ages: Sequence, variable: str = "biomass") -> DataFrame:
    """Rows of ``keep``, stratum, the sex's biomass, and a column per age with its part; null without shares."""
    name = f"{variable}_{sex}" if sex != "all" and f"{variable}_{sex}" in geodata.columns else variable
    if name not in geodata.columns:
        raise KeyError(name)
    wide = shares.groupBy(stratum).agg(F.count("*").alias("_n"), *[F.sum(F.when(F.col("age_bin") == a, F.col("share"))).alias(f"_a{k}") for k, a in enumerate(ages)])
    rows = geodata.join(wide, stratum, "left")
    given = {"transect_num": "Transect", "latitude": "Lat", "longitude": "Lon"}
    total = "wgt_total" if sex == "all" else f"wgt_{sex}"
    return rows.select(*[F.col(c).alias(given.get(c, c)) for c in keep], F.col(stratum).alias("stratum"), F.col(name).alias(total), *[(F.col(name) * F.col(f"_a{k}")).alias(_name(float(a))) for k, a in enumerate(ages)])


#: Report columns of a kriged mesh, in order (fixed values of the report's format).
MESH_COLUMNS = {
    "longitude": "Lon", "latitude": "Lat", "stratum": "stratum", "nasc": "NASC", "abundance_male": "ntk_male", "abundance_female": "ntk_female", "abundance": "ntk_total",
    "biomass_male": "wgt_male", "biomass_female": "wgt_female", "biomass": "wgt_total", "sig_b": "sig_b", "cell_cv": "krig_CV", "krig_SD": "krig_SD",
}


def with_sigma(df: DataFrame, stratum: str, sigma: DataFrame, sigma_stratum: str) -> DataFrame:
    """Add ``stratum`` and ``sig_b``, 4 pi times the stratum's mean cross-section (null where unknown)."""
    for name, frame in ((stratum, df), (sigma_stratum, sigma)):
        if name not in frame.columns:
            raise KeyError(name)
    known = sigma.select(F.col(sigma_stratum).alias("stratum"), (F.col("sigma_bs") * (4 * F.pi())).alias("sig_b"))
    rows = df.withColumnRenamed(stratum, "stratum")
    return rows.join(known, "stratum", "left")


def mesh_results(kriged: DataFrame, stratum: str, variable: str, sigma: DataFrame, sigma_stratum: str) -> DataFrame:
    """The kriged mesh in report columns, as far as it has them, with sig_b and the estimate's deviation."""
    if variable not in kriged.columns:
        raise KeyError(variable)
    rows = with_sigma(kriged, stratum, sigma, sigma_stratum).withColumn("krig_SD", F.col(variable) * F.col("cell_cv"))
    return rows.select(*[F.col(c).alias(n) for c, n in MESH_COLUMNS.items() if c in rows.columns])


def kriging_input(transects: DataFrame) -> DataFrame:
    names = {"latitude": "Lat", "longitude": "Lon", "biomass_density": "Biomass density", "nasc": "NASC", "number_density": "Number density"}
    return transects.select(*[F.col(c).alias(n) for c, n in names.items()])


#: Report columns of transect results (fixed values of the report's format).
POPULATION_COLUMNS = {
    "transect_num": "Transect", "region_id": "Region ID", "distance_s": "VL_start", "distance_e": "VL_end", "latitude": "Lat", "longitude": "Lon", "stratum": "stratum", "bottom_depth": "Depth", "nasc": "NASC",
    "abundance_male": "ntk_male", "abundance_female": "ntk_female", "abundance": "ntk_total", "biomass_male": "wgt_male", "biomass_female": "wgt_female", "biomass": "wgt_total",
    "number_density_male": "nntk_male", "number_density_female": "nntk_female", "number_density": "nntk_total", "biomass_density_male": "nwgt_male", "biomass_density_female": "nwgt_female", "biomass_density": "nwgt_total",
    "layer_mean_depth": "Layer Depth", "layer_height": "Layer height", "transect_spacing": "Transect spacing", "distance_interval": "interval", "nasc_proportion": "mix_coef", "sig_b": "sig_b", "wgt_per_fish": "wgt_per_fish",
}


def population_results(transects: DataFrame, weights: DataFrame, sigma: DataFrame, stratum: str) -> DataFrame:
    """Transect results in report columns; ``weights`` has stratum, sex (with all) and average_weight."""
    own = transects.drop(*[c for c in transects.columns if c in POPULATION_COLUMNS.values() and c not in POPULATION_COLUMNS])
    rows = with_sigma(own, stratum, sigma, stratum)
    rows = rows.join(weights.where("sex = 'all'").select(F.col(stratum).alias("stratum"), F.col("average_weight").alias("wgt_per_fish")), "stratum", "left")
    missing = [c for c in POPULATION_COLUMNS if c not in rows.columns]
    if missing:
        raise KeyError(f"columns missing from the transects: {', '.join(missing)}")
    return rows.select(*[F.col(c).alias(n) for c, n in POPULATION_COLUMNS.items()])
