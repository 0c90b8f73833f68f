"""Inversion of NASC by a regression of target strength on length."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.operators import acoustics
from pelagia.operators.strata import impute_strata
from pelagia.validation import check


class InversionLengthTS:
    """Mean cross-sections by haul and stratum, and the number densities they give."""

    method = "length_TS_regression"

    def __init__(self, model_parameters: Mapping):
        self.params = check("length_ts", model_parameters)
        self.strata = list(self.params["stratify_by"])
        if len(self.strata) > 1 and self.params["impute_missing_strata"]:
            raise ValueError("only strata of one column have neighbours to impute from; with several columns set impute_missing_strata to False")
        self.stratum = self.strata[0]
        self.sigma_bs_haul: DataFrame | None = None
        self.sigma_bs_strata: DataFrame | None = None

    def set_haul_sigma_bs(self, lengths: DataFrame | Sequence[DataFrame] | Mapping[str, DataFrame]) -> DataFrame:
        """Mean cross-section of each haul over the fish of all tables."""
        frames = [lengths] if isinstance(lengths, DataFrame) else list(lengths.values()) if isinstance(lengths, Mapping) else list(lengths)
        haul, ts = self.params["haul_column"], self.params["ts_length_regression"]
        frames = [f.withColumn("haul_num", F.col(haul)) if haul != "haul_num" else f for f in frames]
        self.sigma_bs_haul = acoustics.haul_sigma(frames, self.strata, ts["slope"], ts["intercept"])
        return self.sigma_bs_haul

    def get_stratified_sigma_bs(self, lengths=None) -> DataFrame:
        """Mean cross-section of each stratum, of hauls or of fish."""
        if lengths is not None:
            self.set_haul_sigma_bs(lengths)
        if self.sigma_bs_haul is None:
            raise RuntimeError("there are no cross-sections of hauls yet; give the lengths")
        self.sigma_bs_strata = acoustics.strata_sigma(self.sigma_bs_haul, self.strata, self.params["haul_replicates"])
        return self.sigma_bs_strata

    def invert(self, nasc: DataFrame, lengths=None) -> DataFrame:
        """``nasc`` with its number density; strata without fish take the mean of their neighbours."""
        sigma = self.get_stratified_sigma_bs(lengths)
        if self.params["impute_missing_strata"]:
            expected = self.params.get("expected_strata")
            spine = nasc.select(self.stratum) if expected is None else nasc.sparkSession.createDataFrame([(s,) for s in expected], f"{self.stratum} {nasc.schema[self.stratum].dataType.simpleString()}")
            sigma = impute_strata(spine.unionByName(sigma.select(self.stratum)), sigma, self.stratum)
            self.sigma_bs_strata = sigma
        return acoustics.invert(nasc, sigma, self.strata)
