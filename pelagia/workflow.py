"""A whole survey in one object: from biology, strata, NASC and mesh to estimates with their uncertainty.

Every step is a method that gives a DataFrame and can be used by itself. Steps
that later ones read several times are checkpointed once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.geostatistics import cropping, kriging
from pelagia.geostatistics.variogram import Parameter, Variogram
from pelagia.inversion.length_ts import InversionLengthTS
from pelagia.operators import apportion, biology, cleaning, strata
from pelagia.operators.stratified import JollyHampton
from pelagia.session import prepare

STRATUM = "stratum_num"


@dataclass
class SurveyConfig:
    """Bins, regressions, kriging and bootstrap of a survey; the defaults are those of Pacific hake."""

    length_bins: Sequence[float] = tuple(np.linspace(2.0, 80.0, 40).tolist())
    ts: Mapping[str, float] = field(default_factory=lambda: {"slope": 20.0, "intercept": -68.0})
    minimum_count: int = 5
    interval_threshold: float = 0.05
    lag_resolution: float = 0.002
    n_lags: int = 30
    variogram: Mapping[str, Parameter] = field(default_factory=lambda: {"nugget": Parameter(0.0, 0.0), "sill": Parameter(0.91, 0.0), "correlation_range": Parameter(0.007, 1e-6), "hole_effect_range": Parameter(0.0, 0.0), "decay_power": Parameter(1.5, 1.25, 1.75)})
    model: Sequence[str] = ("exponential", "bessel")
    variogram_mode: str = "compat"
    kriging: Mapping[str, float] = field(default_factory=lambda: {"k_min": 3, "k_max": 10, "aspect_ratio": 0.001})
    radius_per_range: float = 3.0
    mesh_cell_area: float = 6.25
    x_offset: float = -124.78338
    y_offset: float = 45.0
    transects_per_latitude: int = 5
    sampled_share: float = 0.75
    replicates: int = 1000
    seed: int = 0
    ci_method: str = "t-jackknife"


class Survey:
    """``specimen`` (haul_num, sex, age, length, weight), ``length`` (haul_num, sex, length, length_count), ``catch``
    (haul_num, weight), ``haul_strata`` (haul_num, stratum_num), ``geostrata`` (stratum_num, northlimit_latitude),
    ``nasc`` (transect_num, interval, distance_s, distance_e, latitude, longitude, transect_spacing, nasc, haul_num),
    ``mesh`` (latitude, longitude, fraction or area) and an optional reference line ``isobath``.
    """

    def __init__(self, specimen: DataFrame, length: DataFrame, catch: DataFrame, haul_strata: DataFrame, geostrata: DataFrame, nasc: DataFrame, mesh: DataFrame, isobath: DataFrame | None = None, config: SurveyConfig | None = None):
        prepare(nasc.sparkSession)
        self.config = config or SurveyConfig()
        place = lambda df: strata.join_strata(df, haul_strata)
        bins = list(self.config.length_bins)
        self.specimen, self.length = (biology.binify(place(df), bins, "length") for df in (specimen, length))
        self.catch, self.nasc = place(catch), place(nasc)
        self.geostrata, self.mesh, self.isobath = geostrata, mesh, isobath

    @cached_property
    def number_proportions(self) -> DataFrame:
        """Shares of number by stratum, source, sex, length and age; the unsexed of the aged left out."""
        aged = self.specimen.where("age IS NOT NULL AND length IS NOT NULL AND weight IS NOT NULL AND sex <> 'unsexed'")
        counts = {"aged": biology.binned_counts(aged, [STRATUM, "sex", "length_bin", "age"]), "unaged": biology.binned_counts(self.length.where("length IS NOT NULL"), [STRATUM, "sex", "length_bin"], "length_count")}
        return biology.number_proportions(counts, STRATUM).checkpoint()

    @cached_property
    def binned_weights(self) -> DataFrame:
        """Mean weight by length bin, for each sex and for all."""
        both = self.specimen.unionByName(self.specimen.withColumn("sex", F.lit("all")))
        return biology.length_binned_weights(both.drop("length_bin"), list(self.config.length_bins), biology.length_weight_regression(both, ["sex"]), ["sex"], self.config.minimum_count).checkpoint()

    @cached_property
    def average_weights(self) -> DataFrame:
        return biology.average_weight(self.number_proportions, self.binned_weights, STRATUM).checkpoint()

    @cached_property
    def aged_weight_proportions(self) -> DataFrame:
        known = self.specimen.where("sex IN ('male', 'female')")
        return biology.weight_proportions(biology.binned_weights(known, [STRATUM, "sex", "length_bin", "age"]), self.catch, STRATUM).checkpoint()

    @cached_property
    def unaged_weight_proportions(self) -> DataFrame:
        """Shares of the unaged weight by stratum, sex and length: what the aged leave."""
        known = self.length.where("sex IN ('male', 'female')")
        means = self.binned_weights.where("sex <> 'all'")
        weights = known.join(means, ["sex", "length_bin"], "left").withColumn("weight", F.col("weight_fitted") * F.col("length_count"))
        numbers = self.number_proportions.where("source = 'unaged'")
        return biology.fitted_proportions(weights, self.aged_weight_proportions, numbers, self.binned_weights.where("sex = 'all'").drop("sex"), STRATUM).checkpoint()

    @cached_property
    def intervals(self) -> DataFrame:
        """NASC intervals with number density, area, abundance and biomass, and their densities."""
        model = InversionLengthTS({"ts_length_regression": dict(self.config.ts), "stratify_by": STRATUM})
        dense = model.invert(self.nasc, [self.length, self.specimen])
        self.sigma_bs = model.sigma_bs_strata
        rows = cleaning.interval_distance(dense, self.config.interval_threshold).withColumn("area_interval", F.col("transect_spacing") * F.col("distance_interval")).checkpoint()
        sexed = biology.abundance(rows, self.number_proportions, STRATUM, exclude=["unsexed"])
        weight = biology.biomass(sexed, self.average_weights, ["transect_num", "interval"], STRATUM)
        out = rows.withColumn("abundance", F.col("number_density") * F.col("area_interval")).join(weight, ["transect_num", "interval"])
        return out.withColumn("biomass_density", F.coalesce(F.try_divide("biomass", "area_interval"), F.lit(0.0))).checkpoint()

    @cached_property
    def projected(self) -> tuple[DataFrame, DataFrame]:
        """Intervals and mesh in standard coordinates."""
        c = self.config
        points, dx, dy = cropping.transform_coordinates(self.intervals, c.x_offset, c.y_offset, reference=self.isobath)
        cells, _, _ = cropping.transform_coordinates(self.mesh.withColumn("cell", F.xxhash64("latitude", "longitude")), c.x_offset, c.y_offset, reference=self.isobath, delta_x=dx, delta_y=dy)
        return points.withColumn("number", F.xxhash64("transect_num", "interval")).checkpoint(), cells.checkpoint()

    @cached_property
    def variogram(self) -> Variogram:
        v = Variogram(self.config.lag_resolution, self.config.n_lags)
        v.calculate_empirical_variogram(self.projected[0], "biomass_density", order="distance_s", mode=self.config.variogram_mode)
        v.fit_variogram_model(list(self.config.model), self.config.variogram)
        return v

    def crop(self, function, **kwargs) -> None:
        """Keep only the mesh that a crop leaves, before kriging."""
        out = function(mesh=self.mesh, transects=self.intervals, **kwargs)
        self.mesh = out[0] if isinstance(out, tuple) else out

    @cached_property
    def kriged(self) -> DataFrame:
        """The mesh with biomass density, biomass and its stratum by latitude; ``survey_cv`` is set."""
        c = self.config
        points, cells = self.projected
        best = {k: v for k, v in self.variogram.optimized.items() if k != "mad"}
        k = kriging.Kriging(cells, dict(c.kriging) | {"search_radius": best["correlation_range"] * c.radius_per_range}, best | {"model": list(c.model)})
        extents = np.array([(r["x"], r["y"]) for r in cleaning.western_extents(points.where("x IS NOT NULL"), "x", "y", float("inf")).collect()])  # a row per transect
        k.register_search_strategy("western", kriging.western_boundary_search(extents))
        out = k.krige(points, "biomass_density", "number", default_mesh_cell_area=c.mesh_cell_area, adaptive_search_strategy="western")
        self.survey_cv = k.survey_cv
        return strata.join_by_latitude(out.withColumn("biomass", F.col("biomass_density") * F.col("area")), self.geostrata, name=STRATUM).checkpoint()

    @cached_property
    def mesh_estimates(self) -> DataFrame:
        """Biomass, abundance and NASC of the mesh by sex."""
        shares = self.aged_weight_proportions.select(STRATUM, "sex", "proportion").unionByName(self.unaged_weight_proportions.select(STRATUM, "sex", "proportion"))
        self.intervals  # sets sigma_bs
        return apportion.mesh_to_nasc(self.kriged.select("cell", STRATUM, "biomass"), shares, self.average_weights.where("sex = 'all'").drop("sex").crossJoin(self.kriged.sparkSession.createDataFrame([("all",), ("male",), ("female",)], "sex string")), self.sigma_bs, STRATUM)

    @cached_property
    def biomass_table(self) -> DataFrame:
        """Kriged biomass by sex, length and age: aged and unaged together, the unaged aged as the aged are."""
        total = self.kriged.select(STRATUM, F.col("biomass").alias("value"))
        shares = self.aged_weight_proportions.select(STRATUM, F.lit("aged").alias("source"), "sex", "length_bin", "age", "proportion").unionByName(self.unaged_weight_proportions.select(STRATUM, F.lit("unaged").alias("source"), "sex", "length_bin", F.lit(None).cast("long").alias("age"), "proportion"))
        spread = apportion.distribute(total, shares, STRATUM, ["sex", "length_bin", "age"], "value", "source").checkpoint()
        aged, unaged = (spread.where(F.col("source") == s) for s in ("aged", "unaged"))
        keyed = apportion.distribute_unaged(unaged, aged, ["sex", "length_bin"])
        whole = apportion.impute_table(unaged, aged, keyed, ["sex"])
        return aged.select("sex", "length_bin", "age", "value").unionByName(whole.select("sex", "length_bin", "age", "value")).groupBy("sex", "length_bin", "age").agg(F.sum("value").alias("value"))

    def without_age(self, table: DataFrame, age: int = 1) -> DataFrame:
        """A table with one age's estimates moved to the others of their sex."""
        return apportion.reallocate(table, F.col("age") == age, ["sex"])

    def uncertainty(self, kriged: bool = False) -> DataFrame:
        """Intervals of biomass by geographic stratum and of the survey, from transects or from the kriged mesh."""
        c = self.config
        j = JollyHampton(c.transects_per_latitude, c.sampled_share, c.replicates, c.seed)
        if kriged:
            data = j.create_virtual_transects(self.kriged, self.geostrata, "biomass")
        else:
            # a transect lies in one stratum, that of its mean latitude
            mean = self.intervals.groupBy("transect_num").agg(F.avg("latitude").alias("_lat"))
            of = strata.join_by_latitude(mean, self.geostrata, "_lat", "stratum").select("transect_num", "stratum")
            data = self.intervals.join(of, "transect_num").withColumnsRenamed({"distance_interval": "transect_distance", "area_interval": "transect_area"})
        j.stratified_bootstrap(data.where("stratum IS NOT NULL"), "stratum", "biomass")
        return j.summarize(ci_method=c.ci_method)
