"""The stratified bootstrap as one object: transects in, replicates and intervals out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.operators import uncertainty
from pelagia.operators.strata import join_by_latitude


class JollyHampton:
    """Stratified statistics and bootstrap of transects (Jolly and Hampton 1990)."""

    def __init__(self, transects_per_latitude: int = 5, strata_transect_proportion: float = 0.75, num_replicates: int = 1000, seed: int = 0):
        if not 0 < strata_transect_proportion <= 1 or num_replicates < 1 or transects_per_latitude < 1:
            raise ValueError("the proportion must lie in (0, 1], replicates and transects per degree be at least 1")
        self.per_latitude, self.share, self.replicates, self.seed = transects_per_latitude, strata_transect_proportion, num_replicates, seed
        self.transects: DataFrame | None = None

    def create_virtual_transects(self, mesh: DataFrame, limits: DataFrame, variable: str, stratum: str = "stratum") -> DataFrame:
        """Transects of a mesh by latitude, each in the stratum whose band holds its latitude."""
        missing = [c for c in ("latitude", "longitude", variable) if c not in mesh.columns]
        if missing:
            raise KeyError(f"columns missing from the mesh: {', '.join(missing)}")
        out = uncertainty.virtual_transects(mesh, self.per_latitude, variable)
        return join_by_latitude(out, limits, name=stratum).withColumnsRenamed({"distance": "transect_distance", "area": "transect_area"})

    def summarize_transects(self, data: DataFrame, stratum: str, variable: str) -> DataFrame:
        """Sums per transect; distance and area as given, or from positions and spacing."""
        if "transect_distance" in data.columns:
            distance = F.sum("transect_distance")
        elif {"longitude", "latitude"} <= set(data.columns):
            distance = uncertainty.geodesic_nmi(F.min("longitude"), F.min("latitude"), F.max("longitude"), F.max("latitude"))
        else:
            raise KeyError("the data need 'transect_distance', or 'longitude' and 'latitude'")
        if "transect_area" in data.columns:
            rows, area = data, "transect_area"
            out = uncertainty.transect_statistics(rows, stratum, variable, distance, area)
        elif "transect_spacing" in data.columns:
            means = data.groupBy(stratum, "transect_num").agg(F.sum(variable).alias(variable), distance.alias("distance"), F.avg("transect_spacing").alias("_s"))
            out = means.withColumn("area", F.col("_s") * F.col("distance")).drop("_s")
            out = out.withColumn("per_distance", F.try_divide(variable, "distance")).withColumn("per_area", F.try_divide(variable, "area"))
        else:
            raise KeyError("the data need 'transect_area' or 'transect_spacing'")
        return out

    def stratified_bootstrap(self, data: DataFrame, stratum: str, variable: str) -> DataFrame:
        """Replicates by stratum; the statistics of all transects are kept for ``summarize``."""
        self.stratum, self.variable = stratum, variable
        self.transects = self.summarize_transects(data, stratum, variable)
        strata = uncertainty.strata_statistics(self.transects, stratum, variable, self.share)
        drawn = uncertainty.bootstrap(self.transects.select(stratum, "transect_num", variable, "distance", "area"), strata, stratum, self.replicates, self.seed)
        return uncertainty.replicate_estimates(drawn, strata, stratum, variable)

    def summarize(self, ci_percentile: float = 0.95, ci_method: str = "t-jackknife") -> DataFrame:
        """Intervals of strata and survey."""
        if self.transects is None:
            raise RuntimeError("stratified_bootstrap has to run before summarize")
        return uncertainty.summarize(self.transects, self.stratum, self.variable, self.share, self.replicates, self.seed, ci_method, ci_percentile)
