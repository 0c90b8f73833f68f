"""Data behind maps, heat maps and comparisons; drawing is left to the reader's own tools."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.geostatistics.kriging import nearest
from pelagia.operators.cleaning import apply_filters


def heatmap(df: DataFrame, value: str, include: Mapping | None = None, exclude: Mapping | None = None, replace: Mapping | None = None) -> DataFrame:
    """(length_bin, age_bin, value) summed over everything else, after the filters."""
    rows = apply_filters(df, include, exclude, replace)
    return rows.groupBy("length_bin", "age_bin").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def scale_sizes(value: Column, low: float, high: float, small: float = 25.0, large: float = 250.0) -> Column:
    """A marker's size: values clamped to [low, high] and spread over [small, large]; small where both bounds are equal."""
    if high == low:
        return F.when(value.isNotNull(), F.lit(float(small)))
    held = F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))
    return (held - low) / (high - low) * (large - small) + small


def figure_height(width: float, x0: float, x1: float, y0: float, y1: float) -> float:
    """Height of a figure whose map keeps its aspect."""
    return width * (y1 - y0) / (x1 - x0)


def transect_lines(df: DataFrame, x: str = "longitude", y: str = "latitude", transect: str = "transect_num") -> DataFrame:
    """(transect, points): the distinct points of each transect in order of x and y; transects of one point have no line.

    A line is made of a transect's points, so its size is that of the transect.
    """
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(transect, F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("p")).distinct()
    lines = points.groupBy(transect).agg(F.sort_array(F.collect_list("p")).alias("points"))
    return lines.where(F.size("points") > 1)


def transect_labels(df: DataFrame, x: str = "longitude", y: str = "latitude", transect: str = "transect_num") -> DataFrame:
    """(transect, x, y): where each transect's label stands, the mean of its points."""
    return df.groupBy(transect).agg(F.avg(x).alias(x), F.avg(y).alias(y))


def interpolation_mesh(df: DataFrame, x: str, y: str, z: str, spacing: float, reach: float, k: int = 5) -> DataFrame:
    """(i, j, x, y, z): a regular grid over the points, each node the mean of its ``k`` nearest block means.

    Points are averaged by block of ``spacing`` first. Nodes with no block mean
    within ``reach`` are left out.
    """
    i, j = F.floor(F.col(x) / spacing), F.floor(F.col(y) / spacing)
    blocks = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).groupBy(i.alias("i"), j.alias("j")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z"))
    steps = int(reach // spacing) + 1
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-steps, steps + 1) for b in range(-steps, steps + 1)]))
    # only nodes near a block can have one within reach
    nodes = blocks.select("i", "j", around.alias("s")).select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j")).distinct()
    nodes = nodes.select(F.struct("i", "j").alias("cell"), ((F.col("i") + 0.5) * spacing).alias("x"), ((F.col("j") + 0.5) * spacing).alias("y"))
    near = nearest(nodes, blocks.withColumn("n", F.xxhash64("i", "j")), "cell", "n", "z", k, reach, limit=reach)
    mean = F.aggregate("near", F.lit(0.0), lambda s, p: s + p["z"]) / F.size("near")
    return near.where(F.size("near") > 0).select("cell.i", "cell.j", "x", "y", mean.alias("z"))


def table_differences(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str, log: bool = False) -> DataFrame:
    """(keys, first, second, difference) of two long tables, cells that one lacks as 0; optionally of log10(1 + value)."""
    shown = (lambda c: F.log10(c + 1)) if log else (lambda c: c)
    a = first.groupBy(*keys).agg(F.sum(value).alias("_a"))
    b = second.groupBy(*keys).agg(F.sum(value).alias("_b"))
    out = a.join(b, list(keys), "full")
    one, two = (shown(F.coalesce(c, F.lit(0.0))) for c in ("_a", "_b"))
    return out.select(*keys, one.alias("first"), two.alias("second"), (one - two).alias("difference"))


#: Titles of known variables and their units (fixed values).
TITLES = {
    "abundance": ("Abundance", "animals"),
    "biomass_density": ("Biomass density", "kg nmi^-2"),
    "biomass": ("Biomass", "kg"),
    "nasc": ("NASC", "m^2 nmi^-2"),
    "number_density": ("Number density", "animals nmi^-2"),
}


def title(variable: str) -> tuple[str, str | None]:
    """A variable's title, with its suffix before it, and its units; an unknown one is its own title."""
    for name, (text, units) in TITLES.items():
        if variable == name or variable.startswith(f"{name}_"):
            suffix = variable[len(name) :].strip("_")
            return f"{suffix} {text}".capitalize() if suffix else text, units
    return variable, None


def grouped_table(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums by key, 0 where there is nothing to add."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values])


def pivot_table(df: DataFrame, index: Sequence[str], column: str, labels: Sequence, value: str) -> DataFrame:
    """One row per index with a column per given label: sums, 0 for empty cells."""
    cells = [F.coalesce(F.sum(F.when(F.col(column) == v, F.col(value))), F.lit(0.0)).alias(str(v)) for v in labels]
    return df.groupBy(*index).agg(*cells)


def is_wide(df: DataFrame, keys: Sequence[str]) -> bool:
    """Has a table one column per category besides its keys, all of them numbers?"""
    rest = [f.dataType.typeName() for f in df.schema if f.name not in keys]
    return len(rest) > 1 and all(t in ("double", "float", "integer", "long", "short", "decimal") for t in rest)
