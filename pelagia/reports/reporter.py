"""Workbooks of report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.operators.apportion import reallocate
from pelagia.reports import tables
from pelagia.sources.xlsx import write_xlsx

MILLION_TONNES = 1e-9  # of a kilogram


def headers(width: int, column: str = "Age", row: str = "Length (cm)") -> list[str]:
    """The row's name first, the column's name over the middle."""
    middle = -(-(width - 1) // 2)
    out = [row] + [""] * (middle - 1) + [column]
    return out + [""] * (width - len(out))


def body(table: DataFrame) -> tuple[list[str], list[list]]:
    """Column names and rows of a table in the order of its bins, the subtotals last."""
    names = [c for c in table.columns if c not in ("length_bin", "_whole")]
    rows = table.orderBy("_whole", "length_bin").collect()  # a row per bin
    return names, [["Subtotal" if r["_whole"] else r["length_bin"], *[r[c] for c in names]] for r in rows]


def data_rows(names: Sequence[str], rows: Sequence[Sequence]) -> list[list]:
    """A line of names after a 0, the bins, and the subtotals without their own; the names alone of an empty table."""
    return [[0, *names], *map(list, rows[:-1]), *[list(r[:-1]) for r in rows[-1:]]]


def inner_sum(rows: Sequence[Sequence]) -> float:
    return sum(sum(v or 0 for v in r[1:-1]) for r in rows[:-1])


def aggregates(names: Sequence[str], rows: Sequence[Sequence], both: float | None) -> list[list]:
    """Totals from age 1 and from age 2 on; ``both`` is the sum of male and female, for the table of all."""
    last = dict(zip(names, rows[-1][1:])) if rows else {}
    unaged = last.get(tables.UNAGED, 0.0) or 0.0
    aged = sum(v or 0 for n, v in last.items() if n not in (tables.UNAGED, tables.SUBTOTAL))
    first = (last.get("1", 0.0) or 0.0) / aged if aged else 0.0
    one = ["Total (age1+)", aged + unaged, "", "Over Age:", aged + unaged, ""]
    two = ["Total (age2+)", (aged + unaged) * (1 - first)]
    if both is not None:
        one, two = one + ["Male+Female:", both], two + [""] * 4 + ["Male+Female:", both * (1 - first)]
    return [one, two]


def label(title: str) -> list[list]:
    return [[""], [""] * 9 + [title]]


class Reporter:
    """Writes each report as one workbook in a folder that Spark can reach."""

    def __init__(self, save_directory: str):
        self.save_directory = str(save_directory).rstrip("/")

    def _save(self, filename: str, df: DataFrame, sheets: Mapping) -> str:
        path = f"{self.save_directory}/{filename}"
        write_xlsx(df.sparkSession, path, sheets)
        return path

    def _hauls(self, filename: str, sheetnames: Mapping[str, str], counts: DataFrame, title: str) -> str:
        hauls = tables.labels(counts, "haul_num")
        made = {s: body(tables.haul_table(counts, s, hauls)) for s in tables.SEXES}
        sheets = {}
        for sex, (names, rows) in made.items():
            total = ["Total", inner_sum(rows)]
            if sex == "all":
                total += ["", "Male+Female", sum(inner_sum(made[s][1]) for s in ("female", "male"))]
            sheets[sheetnames[sex]] = [headers(len(names), f"Haul Number ({sex.capitalize()})"), *data_rows(names, rows), total, [""], *label(f"{title} ({sex})")]
        return self._save(filename, counts, sheets)

    def _ages(self, filename: str, sheetnames: Mapping[str, str], aged: DataFrame, unaged: DataFrame | None, title: str) -> str:
        ages = tables.labels(aged, "age_bin")
        made = {s: body(tables.age_length_table(aged, s, unaged, ages=ages)) for s in tables.SEXES}
        both = sum(inner_sum(made[s][1]) for s in ("female", "male"))
        sheets = {sheetnames[s]: [headers(len(n)), *data_rows(n, r), *aggregates(n, r, both if s == "all" else None), *label(f"{title} ({s})")] for s, (n, r) in made.items()}
        return self._save(filename, aged, sheets)

    def _biomass(self, filename: str, sheetnames: Mapping[str, str], geodata: DataFrame, weights: DataFrame, stratum: str, keep: Sequence[str], exclude: Mapping | None, moved: bool) -> str:
        ages = tables.labels(weights, "age_bin")
        sheets = {}
        for sex in ("all", "male", "female"):
            wide = tables.aged_biomass(geodata, tables.age_shares(weights, stratum, sex, exclude, moved), stratum, sex, keep, ages)
            sheets[sheetnames[sex]] = [["All (Male + Female)" if sex == "all" else sex.capitalize()], wide.columns, *map(list, wide.collect())]  # a row per reported position
        return self._save(filename, geodata, sheets)

    def aged_length_haul_counts_report(self, filename: str, sheetnames: Mapping[str, str], bio_data: DataFrame) -> str:
        missing = {"sex", "length", "length_bin", "haul_num"} - set(bio_data.columns)
        if missing:
            raise KeyError(f"columns missing from the biology: {', '.join(sorted(missing))}")
        return self._hauls(filename, sheetnames, tables.haul_counts(bio_data.where("length IS NOT NULL")), "Aged Length-Haul Counts")

    def total_length_haul_counts_report(self, filename: str, sheetnames: Mapping[str, str], bio_data: Mapping[str, DataFrame]) -> str:
        return self._hauls(filename, sheetnames, tables.haul_counts(bio_data["specimen"].where("length IS NOT NULL"), bio_data["length"]), "Aged Length-Haul Counts")

    def kriged_aged_biomass_mesh_report(self, filename: str, sheetnames: Mapping[str, str], kriged_data: DataFrame, weight_data: DataFrame, stratum: str, exclude: Mapping | None = None) -> str:
        return self._biomass(filename, sheetnames, kriged_data, weight_data, stratum, ["latitude", "longitude"], exclude, False)

    def transect_aged_biomass_report(self, filename: str, sheetnames: Mapping[str, str], transect_data: DataFrame, weight_data: DataFrame, stratum: str, exclude: Mapping | None = None) -> str:
        return self._biomass(filename, sheetnames, transect_data, weight_data, stratum, ["transect_num", "latitude", "longitude"], exclude, True)

    def kriged_mesh_results_report(self, filename: str, sheetname: str, kriged_data: DataFrame, kriged_stratum: str, kriged_variable: str, sigma_bs_data: DataFrame, sigma_bs_stratum: str) -> str:
        return self._save(filename, kriged_data, {sheetname: tables.mesh_results(kriged_data, kriged_stratum, kriged_variable, sigma_bs_data, sigma_bs_stratum)})

    def kriged_length_age_abundance_report(self, filename: str, sheetnames: Mapping[str, str], datatables: Mapping[str, DataFrame], exclude: Mapping | None = None) -> str:
        aged = datatables["aged"].groupBy("sex", "length_bin", "age_bin").agg(F.sum("value").alias("value"))
        return self._ages(filename, sheetnames, reallocate(aged, tables.excluded(exclude), ["sex"]) if exclude else aged, datatables["unaged"], "Kriged Acoustically Weighted Abundance")

    def kriged_length_age_biomass_report(self, filename: str, sheetnames: Mapping[str, str], datatable: DataFrame) -> str:
        return self._ages(filename, sheetnames, datatable.withColumn("value", F.col("value") * MILLION_TONNES), None, "Kriged Acoustically Weighted Biomass (mmt)")

    def transect_length_age_abundance_report(self, filename: str, sheetnames: Mapping[str, str], datatables: Mapping[str, DataFrame]) -> str:
        return self._ages(filename, sheetnames, datatables["aged"], datatables["unaged"], "Un-kriged Acoustically Weighted Abundance")

    def transect_length_age_biomass_report(self, filename: str, sheetnames: Mapping[str, str], datatable: DataFrame) -> str:
        return self._ages(filename, sheetnames, datatable.withColumn("value", F.col("value") * MILLION_TONNES), None, "Un-kriged Acoustically Weighted Biomass (mmt)")

    def kriging_input_report(self, filename: str, sheetname: str, transect_data: DataFrame) -> str:
        missing = {"latitude", "longitude", "biomass_density", "nasc", "number_density"} - set(transect_data.columns)
        if missing:
            raise KeyError(f"columns missing from the transects: {', '.join(sorted(missing))}")
        return self._save(filename, transect_data, {sheetname: tables.kriging_input(transect_data)})

    def transect_population_results_report(self, filename: str, sheetname: str, transect_data: DataFrame, weight_strata_data: DataFrame, sigma_bs_stratum: DataFrame, stratum_name: str) -> str:
        return self._save(filename, transect_data, {sheetname: tables.population_results(transect_data, weight_strata_data, sigma_bs_stratum, stratum_name)})
