"""Ordinary kriging on a mesh.

Neighbours come from a packed tree of the data (``tree``): a mesh cell meets the
leaves that the circle of its neighbours touches, far from the data too and
however dense they are. So no distance matrix is built and no table is broadcast.
The small systems of a batch of cells are then solved together in numpy.

``mode="canonical"`` keeps the Lagrange 1 last on the right-hand side and a cell's
neighbours in the order of their distance. ``mode="compat"`` sorts the whole
right-hand side, the 1 included, and orders a sparse cell's neighbours by their
number, as established surveys do.

Cases: cells or data with a null position, and data with a null value, have no
estimate and take part in nothing; with fewer data than ``k_min`` all there are
count. Ties in distance take the smaller data number.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.geostatistics.models import gamma_array
from pelagia.geostatistics.tree import POINT, build, nearest_points


def nearest(mesh: DataFrame, data: DataFrame, cell: str, number: str, value: str, k: int, radius: float, coordinates: tuple[str, str] = ("x", "y"), limit: float | None = None) -> DataFrame:
    """(cell, x, y, near): the ``k`` nearest data of each cell as array of (distance, number, x, y, z), nearest first.

    ``limit`` bounds the distance; without it, every cell has ``k`` or all data.
    ``radius`` isn't needed to find them and stays for callers that give it.
    """
    x, y = coordinates
    points = data.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("z"), F.col(number).alias("number"))
    cells = mesh.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(cell).alias("cell"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    tree = build(points, k)
    if tree is None:
        return cells.withColumn("near", F.lit(None).cast(POINT))
    return nearest_points(cells, tree, k, limit)


def kriging_matrix(distances: np.ndarray, parameters: Mapping) -> np.ndarray:
    """Semivariances of a stack of distance matrices, bordered by ones, with a zero diagonal."""
    *stack, k, _ = distances.shape
    out = np.ones((*stack, k + 1, k + 1))
    out[..., :k, :k] = gamma_array(distances, parameters)
    out[..., np.arange(k + 1), np.arange(k + 1)] = 0.0
    return out


def kriging_weights(matrix: np.ndarray, right: np.ndarray, aspect_ratio: float) -> np.ndarray:
    """Solutions by a pseudo-inverse that drops singular values at or below ``aspect_ratio`` of the largest."""
    u, s, vt = np.linalg.svd(matrix)
    keep = s / s[..., :1] > aspect_ratio
    inverse = np.where(keep, 1 / np.where(keep, s, 1.0), 0.0)
    return np.einsum("...ji,...j->...i", vt, inverse * np.einsum("...ij,...i->...j", u, right))


def uniform_search(cell: dict, distance: np.ndarray, k_min: int, radius: float) -> float:
    """Weight of a sparse cell's estimate: 1 with data within the radius, else a taper by the mean distance."""
    return 1.0 if (distance <= radius).any() else float(np.exp(-distance[:k_min].mean() / radius))


def western_boundary_search(extents: np.ndarray) -> Callable:
    """A strategy that tapers only cells west of the survey's western extent less the radius.

    ``extents`` has a row (x, y) per transect; a cell is held against the one whose y is nearest.
    """

    def weight(cell: dict, distance: np.ndarray, k_min: int, radius: float) -> float:
        limit = extents[np.abs(extents[:, 1] - cell["y"]).argmin(), 0] - radius
        return float(np.exp(-distance[:k_min].mean() / radius)) if cell["x"] < limit else 1.0

    return weight


def estimates(neighbours: DataFrame, parameters: Mapping, k_min: int, k_max: int, radius: float, aspect_ratio: float, strategy: Callable = uniform_search, mode: str = "canonical") -> DataFrame:
    """(cell, estimate, kriged_variance, sample_variance) of cells with their nearest data.

    A cell with fewer than ``k_min`` data within the radius is sparse: it takes its
    ``k_min`` nearest, and ``strategy`` gives its weight. Data beyond the radius
    count as 0.
    """

    def solve(near: np.ndarray, weight: np.ndarray, sparse: np.ndarray) -> np.ndarray:
        """Rows of (cell, neighbour, (distance, number, x, y, z))."""
        right = np.concatenate([gamma_array(near[..., 0], parameters), np.ones((len(near), 1))], 1)
        z = np.where(near[..., 0] > radius, 0.0, near[..., 4])
        place = near
        if mode == "compat":
            right = np.sort(right, 1)
            far = near[..., 0] >= radius
            order = np.lexsort((np.where(sparse[:, None], near[..., 1], 0), np.where(sparse[:, None], far, 0)), axis=-1)
            order = np.where((sparse & ~far.all(1))[:, None], order, np.arange(near.shape[1]))
            place = np.take_along_axis(near, order[..., None], 1)
            z = np.where(near[..., 0] > radius, 0.0, place[..., 4])
        gaps = np.hypot(*(place[:, :, None, c] - place[:, None, :, c] for c in (2, 3)))
        lam = kriging_weights(kriging_matrix(gaps, parameters), right, aspect_ratio)
        value = (lam[:, :-1] * z).sum(1) * weight
        variance = (lam * right).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.sqrt(variance * (z.var(1, ddof=1) if z.shape[1] > 1 else np.nan)) / np.abs(value)
        spread[np.abs(value) < np.finfo(float).eps] = np.nan
        return np.stack([value, variance, spread], 1)

    def run(batches):
        for b in batches:
            cells = b.column("cell")
            lists, xs, ys = b.column("near").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist()
            out = np.full((len(lists), 3), np.nan)
            groups: dict[int, list] = {}
            for r, found in enumerate(lists):
                if not found:
                    continue
                inside = sum(p["distance"] <= radius for p in found)
                used = found[: k_min if inside < k_min else k_max]
                near = np.array([[p["distance"], p["number"], p["x"], p["y"], p["z"]] for p in used])
                weight = strategy({"x": xs[r], "y": ys[r]}, near[:, 0], k_min, radius) if inside < k_min else 1.0
                groups.setdefault(len(used), []).append((r, near, weight, inside < k_min))
            for rows in groups.values():
                out[[g[0] for g in rows]] = solve(np.stack([g[1] for g in rows]), np.array([g[2] for g in rows]), np.array([g[3] for g in rows]))
            cols = [pa.array(c, pa.float64(), mask=np.isnan(c)) for c in out.T]
            yield pa.RecordBatch.from_arrays([cells, *cols], ["cell", "estimate", "kriged_variance", "sample_variance"])

    kind = neighbours.schema["cell"].dataType.simpleString()
    return neighbours.select("cell", "x", "y", "near").mapInArrow(run, f"cell {kind}, estimate double, kriged_variance double, sample_variance double")


def project(estimated: DataFrame, data: DataFrame, variable: str, default_area: float | None = None) -> tuple[DataFrame, float]:
    """Areas, clipped estimates and cell CVs of a mesh with estimates; and the survey CV.

    The survey's total is taken before negative estimates are set to 0.
    """
    if "fraction" in estimated.columns and default_area is not None:
        area = F.col("fraction") * default_area
    elif "area" in estimated.columns:
        area = F.col("area")
    elif default_area is not None:
        area = F.lit(float(default_area))
    else:
        raise KeyError("the mesh needs a column 'area', or a default cell area is required")
    rows = estimated.withColumn("area", area)
    spread = data.agg(F.var_samp(variable)).first()[0]
    s = rows.agg(F.sum(F.col("estimate") * F.col("area")).alias("t"), F.avg("area").alias("a"), F.count("*").alias("n"), F.sum(F.col("kriged_variance") * F.col("area") ** 2).alias("v")).first()
    if not s["t"] or spread is None:
        return rows.withColumn("cell_cv", F.lit(None).cast("double")), float("nan")
    cv = F.sqrt(F.col("kriged_variance") * spread) * (s["a"] / s["t"] * s["n"] ** 0.5)
    out = rows.withColumn("estimate", F.greatest(F.col("estimate"), F.lit(0.0))).withColumn("cell_cv", cv)
    return out, float(np.sqrt((s["v"] or 0.0) * spread) / s["t"])


@dataclass
class Kriging:
    """A mesh, a variogram and search strategies by name."""

    mesh: DataFrame
    kriging_params: Mapping
    variogram_params: Mapping
    coordinate_names: tuple[str, str] = ("x", "y")
    cell: str = "cell"
    mode: str = "canonical"
    mesh_cropped: DataFrame | None = None
    survey_cv: float | None = None
    strategies: dict[str, Callable] = field(default_factory=lambda: {"uniform": uniform_search})

    def __post_init__(self):
        missing = {"k_min", "k_max", "search_radius", "aspect_ratio"} - set(self.kriging_params)
        if missing:
            raise ValueError(f"kriging parameters are missing: {', '.join(sorted(missing))}")
        p = self.kriging_params
        if not 0 < p["k_min"] <= p["k_max"] or not p["search_radius"] > 0 or not 0 < p["aspect_ratio"] <= 1:
            raise ValueError("kriging parameters need 0 < k_min <= k_max, a positive search_radius and an aspect_ratio in (0, 1]")
        gamma_array(np.zeros(1), self.variogram_params)

    def register_search_strategy(self, name: str, strategy: Callable) -> None:
        if name == "uniform":
            raise ValueError("cannot overwrite the built-in strategy 'uniform'")
        self.strategies[name] = strategy

    def list_search_strategies(self) -> list[str]:
        return list(self.strategies)

    def crop_mesh(self, crop_function: Callable, **kwargs) -> None:
        """Keep what ``crop_function(mesh=..., **kwargs)`` leaves, for kriging without extrapolation."""
        out = crop_function(mesh=self.mesh, **kwargs)
        self.mesh_cropped = out[0] if isinstance(out, tuple) else out

    def krige(self, transects: DataFrame, variable: str, number: str, extrapolate: bool = True, default_mesh_cell_area: float | None = None, adaptive_search_strategy: str = "uniform") -> DataFrame:
        """The mesh with the variable's estimate, variances and cell CV; ``survey_cv`` is set."""
        missing = [c for c in (*self.coordinate_names, variable) if c not in transects.columns]
        if missing:
            raise KeyError(f"columns missing from the transects: {', '.join(missing)}")
        if adaptive_search_strategy not in self.strategies:
            raise ValueError(f"unknown search strategy '{adaptive_search_strategy}'; there are: {', '.join(self.strategies)}")
        if not extrapolate and self.mesh_cropped is None:
            raise AttributeError("crop_mesh has to run before kriging without extrapolation")
        mesh, p = self.mesh if extrapolate else self.mesh_cropped, self.kriging_params
        transects = transects.dropna(subset=[*self.coordinate_names, variable])
        near = nearest(mesh, transects, self.cell, number, variable, p["k_max"], p["search_radius"], self.coordinate_names)
        solved = estimates(near, self.variogram_params, p["k_min"], p["k_max"], p["search_radius"], p["aspect_ratio"], self.strategies[adaptive_search_strategy], self.mode)
        rows = mesh.join(solved.withColumnRenamed("cell", self.cell), self.cell, "left").checkpoint()
        out, self.survey_cv = project(rows, transects, variable, default_mesh_cell_area)
        return out.withColumnRenamed("estimate", variable)
