"""Inversion of volume backscatter, row by row, by fitting a scattering model.

A row has one measurement per frequency; its fit is independent of every other. The
simplex takes rows as they come. Optimisers of batches give the same result for the
same measurements, so these are brought together and fitted once. Draws are seeded
per row alike, so a row's result doesn't depend on where it runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from pelagia.inversion.batched import ROWS, damped_least_squares, differential_evolution
from pelagia.inversion.parameters import InvParameters
from pelagia.inversion.scattering import MODELS

#: Backscatter that stands for none.
EMPTY = -999.0


def deviation(values: Mapping[str, float], measured: np.ndarray, frequencies: np.ndarray, model: Callable, settings: Mapping) -> float:
    """Sum of absolute differences between the model and the measurements, in dB."""
    return float(np.abs(model(frequencies, **values, **settings) - measured).sum())


def simplex(cost: Callable[[np.ndarray], float], start: np.ndarray, low: np.ndarray, high: np.ndarray, evaluations: int = 2000, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Smallest cost found by a bounded downhill simplex (reflection, expansion, contraction, shrinking)."""
    n = len(start)
    span = np.where(np.isfinite(high - low), high - low, np.maximum(np.abs(start), 1.0))
    points = [np.clip(start, low, high)]
    for k in range(n):
        p = points[0].copy()
        p[k] = p[k] + 0.1 * span[k] if p[k] + 0.1 * span[k] <= high[k] else p[k] - 0.1 * span[k]
        points.append(np.clip(p, low, high))
    x, f = np.array(points), np.array([cost(p) for p in points])
    used = n + 1
    while used < evaluations:
        order = np.argsort(f, kind="stable")
        x, f = x[order], f[order]
        if f[-1] - f[0] <= tolerance and np.abs(x - x[0]).max() <= tolerance * span.max():
            break
        middle = x[:-1].mean(0)

        def at(step: float) -> tuple[np.ndarray, float]:
            p = np.clip(middle + step * (x[-1] - middle), low, high)
            return p, cost(p)

        p, v = at(-1.0)
        used += 1
        if v < f[0]:
            q, w = at(-2.0)
            used += 1
            p, v = (q, w) if w < v else (p, v)
        elif v >= f[-2]:
            q, w = at(-0.5 if v < f[-1] else 0.5)
            used += 1
            if w < min(v, f[-1]):
                p, v = q, w
            else:
                x[1:] = x[0] + 0.5 * (x[1:] - x[0])
                f[1:] = [cost(p) for p in x[1:]]
                used += n
                continue
        x[-1], f[-1] = p, v
    best = int(f.argmin())
    return x[best], float(f[best])


def optimize(measured: np.ndarray, frequencies: np.ndarray, parameters: InvParameters, model: Callable, settings: Mapping, simulation: Mapping, optimization: Mapping) -> dict[str, float]:
    """Best parameters of one row and their deviation ``Q``; nulls with too few frequencies.

    Monte Carlo draws (``mc_realizations``, ``mc_seed``) give the start, ``burnin``
    evaluations a coarse fit, ``max_evaluations`` the fit; ``restarts`` perturb the
    result by ``scale`` until ``Q_threshold`` is met.
    """
    ok = np.isfinite(measured) & (measured > EMPTY)
    if ok.sum() < simulation.get("minimum_frequency_count", 2):
        return {k: np.nan for k in parameters.values} | {"Q": np.nan}
    measured, frequencies = measured[ok], frequencies[ok]
    whole = parameters.parameters
    names = [k for k, p in whole.items() if p["vary"]]
    low, high = (np.array([whole[k][b] for k in names], float) for b in ("min", "max"))

    def values(x: np.ndarray) -> dict[str, float]:
        now = parameters.values | dict(zip(names, x.tolist()))
        return parameters.inverse_transform(now) if parameters.is_scaled else now

    def cost(x: np.ndarray) -> float:
        with np.errstate(all="ignore"):
            q = deviation(values(x), measured, frequencies, model, settings)
        return q if np.isfinite(q) else 1e12

    rng = np.random.default_rng(simulation.get("mc_seed"))
    parameters.simulate_parameter_sets(simulation.get("mc_realizations") if simulation.get("monte_carlo") else None, rng)
    starts = [np.array([r[k]["value"] for k in names], float) for r in parameters.realizations.values()]
    x = min(starts, key=cost)
    if optimization.get("burnin"):
        x, _ = simplex(cost, x, low, high, optimization["burnin"])
    x, q = simplex(cost, x, low, high, optimization.get("max_evaluations", 2000))
    restart = optimization.get("restart", {})
    for _ in range(restart.get("max_attempts", 0)):
        if q < restart.get("Q_threshold", 0.0):
            break
        scale = restart.get("scale", 0.05)
        moved = np.clip(x + rng.uniform(-scale, scale, len(x)) * np.where(x == 0, 1.0, np.abs(x)), low, high)
        y, w = simplex(cost, moved, low, high, optimization.get("max_evaluations", 2000))
        x, q = (y, w) if w < q else (x, q)
    return values(x) | {"Q": q}


#: Optimisers of whole batches, by name.
BATCHED = ("differential_evolution", "least_squares")


def optimize_rows(measured: np.ndarray, frequencies: np.ndarray, parameters: InvParameters, model: Callable, settings: Mapping, simulation: Mapping, optimization: Mapping) -> pd.DataFrame:
    """Best parameters of all rows and their deviation ``Q``, and the evaluations of the model that a row took on average.

    Rows with the same frequencies go together. ``optimization["method"]`` names the
    optimiser; its other entries are the optimiser's options. ``mc_realizations`` draws,
    the same for all rows, give each row its start.
    """
    whole, scaled = parameters._own, parameters.parameters
    names = [k for k, p in whole.items() if p["vary"]]
    low, high = (np.array([whole[k][b] for k in names], float) for b in ("min", "max"))
    if not np.isfinite(low).all() or not np.isfinite(high).all():
        raise ValueError("optimisers of batches need finite bounds of all parameters that vary")
    if parameters.is_scaled:
        start = np.array([parameters.inverse_transform({k: p["value"] for k, p in scaled.items()})[k] for k in names])
    else:
        start = np.array([whole[k]["value"] for k in names], float)
    options = {k: v for k, v in optimization.items() if k != "method"}
    seed, draws = simulation.get("mc_seed") or 0, simulation.get("mc_realizations") if simulation.get("monte_carlo") else None
    ok = np.isfinite(measured) & (measured > EMPTY)
    out = {k: np.full(len(measured), np.nan) for k in [*whole, "Q", "evaluations"]}
    for pattern in np.unique(ok, axis=0) if len(ok) else ():
        if pattern.sum() < simulation.get("minimum_frequency_count", 2):
            continue
        rows = np.flatnonzero((ok == pattern).all(1))
        target, at = measured[np.ix_(rows, pattern)], frequencies[pattern]

        def residuals(x: np.ndarray, which: np.ndarray) -> np.ndarray:
            values = {k: np.full(len(x), float(p["value"])) for k, p in whole.items()} | dict(zip(names, x.T))
            with np.errstate(all="ignore"):
                return model(at, values, **settings) - target[which]

        first, used = np.tile(start, (len(rows), 1)), 0
        if draws:
            points = np.vstack([start, low + np.random.default_rng(seed).random((draws, len(names))) * (high - low)])
            level = residuals(points, np.zeros(len(points), int)) + target[0]  # the draws' backscatter serves all rows
            first, used = points[np.abs(level[None] - target[:, None]).sum(2).argmin(1)], len(points)
        if optimization["method"] == "differential_evolution":
            x, q, more = differential_evolution(residuals, low, high, len(rows), seed, start=first, **options)
        else:
            x, q, more = damped_least_squares(residuals, first, low, high, **options)
        fitted = {k: np.full(len(rows), float(p["value"])) for k, p in whole.items()} | dict(zip(names, x.T))
        for k, v in (fitted | {"Q": q, "evaluations": np.full(len(rows), (more + used) / len(rows))}).items():
            out[k][rows] = v
    return pd.DataFrame(out)


class Progress:
    """Counts of rows, failures and evaluations of the model, added up by tasks and read on the driver after an action.

    A task that is run again counts again, as accumulators in transformations do.
    """

    def __init__(self, spark: SparkSession):
        self.rows, self.failures, self.evaluations = (spark.sparkContext.accumulator(0) for _ in range(3))

    def add(self, q: np.ndarray, evaluations: np.ndarray) -> None:
        self.rows.add(len(q))
        self.failures.add(int(np.isnan(q).sum()))
        self.evaluations.add(int(round(np.nansum(evaluations))))


def invert(measurements: DataFrame, columns: Mapping[float, str], parameters: InvParameters, settings: Mapping, simulation: Mapping | None = None, optimization: Mapping | None = None, model: str | Callable = "pcdwba", keep: Sequence[str] = (), progress: Progress | None = None) -> DataFrame:
    """``keep`` columns of each row with its inverted parameters and ``Q``.

    ``columns`` maps frequencies (Hz) to columns of volume backscatter (dB); nulls
    and -999 don't count. ``settings`` are the model's other arguments.
    ``optimization["method"]``: ``simplex`` (the default) fits row by row;
    ``differential_evolution`` and ``least_squares`` move all rows of a batch together
    and take a model by name or a function of (frequencies, values by name, settings).
    """
    simulation, optimization = dict(simulation or {}), dict(optimization or {})
    method = optimization.get("method", "simplex")
    if method not in ("simplex", *BATCHED):
        raise ValueError(f"unknown optimiser '{method}'; there are: simplex, {', '.join(BATCHED)}")
    f = (ROWS if method in BATCHED else MODELS)[model] if isinstance(model, str) else model
    frequencies, names = np.array(list(columns), float), list(parameters.values)

    def run(frames):
        for frame in frames:
            values = frame[list(columns.values())].to_numpy(float, na_value=np.nan)
            if method in BATCHED:
                distinct, place = np.unique(np.where(np.isfinite(values) & (values > EMPTY), values, EMPTY), axis=0, return_inverse=True)
                rows = optimize_rows(distinct, frequencies, parameters, f, settings, simulation, optimization).iloc[place.reshape(-1)].reset_index(drop=True)
                once = np.unique(place.reshape(-1), return_index=True)[1]  # a fit's evaluations count once
                rows["evaluations"] = rows["evaluations"].where(rows.index.isin(once), 0.0)
            else:
                rows = pd.DataFrame([optimize(r.astype(float), frequencies, parameters, f, settings, simulation, optimization) for r in values], columns=[*names, "Q"])
                rows["evaluations"] = np.nan
            if progress is not None:
                progress.add(rows["Q"].to_numpy(), rows["evaluations"].to_numpy())
            yield pd.concat([frame[list(keep)].reset_index(drop=True), rows[[*names, "Q"]]], axis=1)

    kept = ", ".join(f"`{c}` {measurements.schema[c].dataType.simpleString()}" for c in keep)
    out = ", ".join(f"`{n}` double" for n in [*names, "Q"])
    rows = measurements.select(*dict.fromkeys([*keep, *columns.values()]))
    if method in BATCHED:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns.values()).sortWithinPartitions(*columns.values())
    return rows.mapInPandas(run, f"{kept}, {out}" if kept else out)


def backscatter(rows: DataFrame, columns: Mapping[float, str], fitted: Sequence[str], settings: Mapping, fixed: Mapping[str, float] | None = None, model: str | Callable = "pcdwba", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns of each row and the model's backscatter (dB) at each frequency, at the parameters in its columns ``fitted`` and in ``fixed``."""
    f, frequencies, fixed = ROWS[model] if isinstance(model, str) else model, np.array(list(columns), float), dict(fixed or {})

    def run(frames):
        for frame in frames:
            values = {k: np.full(len(frame), float(v)) for k, v in fixed.items()} | {k: frame[k].to_numpy(float) for k in fitted}
            yield pd.concat([frame[list(keep)].reset_index(drop=True), pd.DataFrame(f(frequencies, values, **settings), columns=list(columns.values()))], axis=1)

    kept = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), *(f"`{c}` double" for c in columns.values())])
    return rows.select(*dict.fromkeys([*keep, *fitted])).mapInPandas(run, kept)


def misfit(measurements: DataFrame, columns: Mapping[float, str], fitted: Sequence[str], settings: Mapping, fixed: Mapping[str, float] | None = None, model: str | Callable = "pcdwba", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns of each row and its deviation ``Q`` (dB) at the parameters in its columns ``fitted`` and in ``fixed``."""
    f, frequencies, fixed = ROWS[model] if isinstance(model, str) else model, np.array(list(columns), float), dict(fixed or {})

    def run(frames):
        for frame in frames:
            measured = frame[list(columns.values())].to_numpy(float, na_value=np.nan)
            values = {k: np.full(len(frame), float(v)) for k, v in fixed.items()} | {k: frame[k].to_numpy(float) for k in fitted}
            gap = np.abs(f(frequencies, values, **settings) - np.where(measured > EMPTY, measured, np.nan))
            yield pd.concat([frame[list(keep)].reset_index(drop=True), pd.DataFrame({"Q": np.nansum(gap, 1)})], axis=1)

    kept = ", ".join(f"`{c}` {measurements.schema[c].dataType.simpleString()}" for c in keep)
    wanted = dict.fromkeys([*keep, *columns.values(), *fitted])
    return measurements.select(*wanted).mapInPandas(run, f"{kept}, `Q` double" if kept else "`Q` double")
