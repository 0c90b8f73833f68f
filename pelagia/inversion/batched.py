"""Fits of many rows at once: the scattering model over rows, and optimisers that move all rows of a batch together.

A batch has a row of unknowns for each measurement; one call of the model gives the
backscatter of all rows, so that a generation of trial points or a column of a Jacobian
costs one pass of numpy over the batch instead of a Python call a row. Rows that have
met the tolerance leave the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np

from pelagia.functions.special import bessel_j
from pelagia.inversion.scattering import EPS, frequency_interval, reflection_coefficient, wavenumber, weights_of

#: Rows x orientations x segments that one pass of the model holds, about.
HELD = 60_000
#: Least argument of the Bessel function in units of ka; below, J1(x) / x is constant.
NIL = 1e-6


def bent_cylinders(n: int, curvature: np.ndarray, taper_order: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``bent_cylinder``, with a row for each curvature and taper."""
    z = np.linspace(-1.0, 1.0, n)
    rho = curvature[:, None]
    bend = np.sin(0.5 / rho) * z
    zs, xs = 2 * rho * bend, 2 * rho * (1 - np.sqrt(1 - bend * bend))
    dz, dx = np.diff(zs), np.diff(xs) + EPS
    slope = np.arctan(dz / dx)
    slope = np.concatenate([slope, slope[:, -1:]], 1)
    step = np.hypot(dx, dz)
    return np.sqrt(1 - np.abs(z) ** taper_order[:, None] * np.where((z < 0) & (taper_order[:, None] % 2 == 1), -1, 1)), np.arctan2(zs, xs), np.where(slope >= 0, slope - np.pi / 2, slope + np.pi / 2), np.hypot(xs, zs), np.concatenate([step[:, :1], step], 1)


def pcdwba_rows(center_frequencies: np.ndarray, values: Mapping[str, np.ndarray], *, sound_speed_sw: float, frequency_interval_hz: float = 2000.0, n_integration: int = 50, n_wavelength: int = 10, orientation: Mapping | None = None, lengths: Mapping | None = None) -> np.ndarray:
    """Backscatter in dB, a row for each row of ``values`` and a column for each frequency; as ``pcdwba`` row by row.

    Rows that differ in density alone are computed once, those of one shape that need the
    same number of segments together, in blocks of bounded memory. A length that is no
    number gives none.
    """
    v = {k: np.atleast_1d(np.asarray(x, float)) for k, x in values.items()}
    n = max(map(len, v.values()))
    v = {k: np.broadcast_to(x, n) for k, x in v.items()}
    angles, sizes = {"family": "gaussian", "bins": 60} | dict(orientation or {}), {"family": "gaussian", "bins": 100} | dict(lengths or {})
    names = [k for k in v if k not in ("length_mean", "number_density")]
    animals, place = np.unique(np.column_stack([v[k] for k in [*names, "length_mean"]]), axis=0, return_inverse=True)
    length = animals[:, -1]
    shapes, shape = np.unique(animals[:, :-1], axis=0, return_inverse=True)
    order = np.argsort(shape.reshape(-1), kind="stable")
    found = np.full((len(animals), len(center_frequencies)), np.nan)
    for p, rows in zip(shapes, np.split(order, np.cumsum(np.bincount(shape.reshape(-1)))[:-1])):
        p, rows = dict(zip(names, p.tolist())), rows[np.isfinite(length[rows])]
        for c, f in enumerate(np.asarray(center_frequencies, float)):
            k = wavenumber(frequency_interval(float(f), p["length_sd_norm"], float(frequency_interval_hz)), sound_speed_sw)
            reach = k[-1] * length[rows] * (1 + 3.1 * p["length_sd_norm"])
            segments = np.where(reach < n_integration, n_integration, np.ceil(reach * n_wavelength / (2 * np.pi))).astype(int)
            for m in np.unique(segments).tolist():
                block = max(1, HELD // (angles["bins"] * m))
                alike = rows[segments == m]
                for at in range(0, len(alike), block):
                    r = alike[at : at + block]
                    found[r, c] = _sections(p, length[r], k, wavenumber(f, sound_speed_sw), m, angles, sizes)
    return 10 * np.log10(v["number_density"][:, None] * found[place.reshape(-1)])


def _sections(p: Mapping[str, float], length: np.ndarray, k: np.ndarray, center: float, segments: int, angles: Mapping, sizes: Mapping) -> np.ndarray:
    """Mean cross-section at one frequency of animals of one shape: axes are orientation x segment, row.

    The knots of a row's Bessel table scale with its length, so all rows read theirs at the same places.
    """
    taper, place, tilt, r, dr = (x[0] for x in bent_cylinders(segments, np.array([p["radius_of_curvature_ratio"]]), np.array([p["taper_order"]])))
    to_ka = length / p["length_radius_ratio"]
    table = bessel_j(1, np.linspace(-1.0, 1.0, 2 * segments)[:, None] * (2 * k[-1] * to_ka))
    theta = np.linspace(p["theta_mean"] - 3.1 * p["theta_sd"], p["theta_mean"] + 3.1 * p["theta_sd"], angles["bins"])
    radians = np.radians(theta)[:, None]
    thin = taper / p["h"]
    facing = np.maximum(2 * thin * np.abs(np.cos(tilt - radians)), NIL).ravel()
    turn = (p["length_radius_ratio"] * (r / p["h"]) * np.cos(place - radians)).ravel()[:, None]
    weight = np.tile(p["h"] ** 2 * reflection_coefficient(p["g"], p["h"]) / 4 * dr * thin**2, len(theta)) / facing
    # frequencies are evenly spaced: the phase of the next is that of the last, turned on
    phase = np.exp(1j * (turn * (k[0] * to_ka)))
    onward = np.exp(1j * (turn * ((k[1] - k[0]) * to_ka))) if len(k) > 1 else 1.0
    power = np.empty((len(theta), len(k), len(length)))
    part, more, whole = np.empty(phase.shape), np.empty(phase.shape), np.empty(phase.shape, complex)
    for j in range(len(k)):
        spot = np.minimum(k[j] / k[-1] * facing * (2 * segments - 1) / 4 + (segments - 0.5), 2 * segments - 1)  # places in the table, whose middle is 0
        low = np.clip(np.nan_to_num(spot).astype(np.int64), 0, 2 * segments - 2)
        share = spot - low
        np.take(table, low, 0, part, "clip")
        np.take(table, low + 1, 0, more, "clip")
        part *= ((1 - share) * weight)[:, None]
        more *= (share * weight)[:, None]
        part += more
        np.multiply(part, phase, out=whole)
        form = whole.reshape(len(theta), segments, -1).sum(1) * (k[j] * to_ka) + EPS
        power[:, j] = form.real**2 + form.imag**2
        phase *= onward
    average = np.sqrt(np.tensordot(weights_of(theta, p["theta_mean"], p["theta_sd"], angles["family"]), power, 1))
    share = np.linspace(1 - 3 * p["length_sd_norm"], 1 + 3 * p["length_sd_norm"], sizes["bins"])
    w = share * share * weights_of(share, 1.0, p["length_sd_norm"], sizes["family"])
    f = np.stack([np.interp(np.where((a >= x[0]) & (a <= x[-1]), a, np.nan), x, y) for a, x, y in zip(np.outer(center * to_ka, share), np.outer(to_ka, k), average.T)])
    return (w * f**2).sum(1) * length**2


#: Scattering models of whole batches, by name.
ROWS: dict[str, Callable] = {"pcdwba": pcdwba_rows}


def reflected(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Points beyond a bound mirrored back inside."""
    x = np.where(x < low, 2 * low - x, x)
    return np.clip(np.where(x > high, 2 * high - x, x), low, high)


def differential_evolution(residuals: Callable[[np.ndarray, np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, rows: int, seed: int = 0, population: int = 16, generations: int = 60, weight: float = 0.7, crossover: float = 0.9, tolerance: float = 1e-3, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Differential evolution of a population a row (rand/1/bin); (best points, costs, evaluations of rows).

    ``residuals(x, which)`` gives the residuals of points x of the rows ``which``; the cost is the sum of
    their absolute values. All rows draw the same numbers, so a row's result doesn't depend on its batch.
    """
    rng, m = np.random.default_rng(seed), len(low)
    cost = lambda x, which: np.nan_to_num(np.abs(residuals(x.reshape(-1, m), np.repeat(which, x.shape[1]))).sum(1), nan=1e12, posinf=1e12).reshape(len(which), -1)
    x = np.broadcast_to(low + rng.random((population, m)) * (high - low), (rows, population, m)).copy()
    if start is not None:
        x[:, 0] = np.clip(start, low, high)
    which = np.arange(rows)
    q, used = cost(x, which), rows * population
    for _ in range(generations):
        # three others for each member, the same for all rows; at least one unknown is always taken
        others = np.array([rng.choice(np.delete(np.arange(population), i), 3, False) for i in range(population)])
        take = rng.random((population, m)) < crossover
        take[np.arange(population), rng.integers(0, m, population)] = True
        a, b, c = (x[which][:, others[:, j]] for j in range(3))
        trial = np.where(take, reflected(a + weight * (b - c), low, high), x[which])
        new = cost(trial, which)
        used += len(which) * population
        better = new < q[which]
        x[which], q[which] = np.where(better[..., None], trial, x[which]), np.where(better, new, q[which])
        which = which[(q[which].max(1) - q[which].min(1) > tolerance) & (q[which].min(1) > tolerance)]
        if not len(which):
            break
    best = q.argmin(1)
    return x[np.arange(rows), best], q[np.arange(rows), best], used


def damped_least_squares(residuals: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 40, tolerance: float = 1e-9, step: float = 1e-5) -> tuple[np.ndarray, np.ndarray, int]:
    """Levenberg-Marquardt within bounds, a damping a row; (points, sums of absolute residuals, evaluations of rows)."""
    rows, m = start.shape
    span = high - low
    x = np.clip(start, low, high)
    clean = lambda r: np.nan_to_num(r, nan=1e6, posinf=1e6, neginf=-1e6)
    def near(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals of points and their derivatives by each unknown, in shares of the span, from one call of the model."""
        moved = np.repeat(at[None], m + 1, 0)
        for k in range(m):
            moved[k + 1, :, k] += np.where(at[:, k] + step * span[k] > high[k], -1, 1) * step * span[k]
        level = clean(residuals(moved.reshape(-1, m), np.tile(which, m + 1))).reshape(m + 1, len(which), -1)
        return level[0], np.stack([(level[k + 1] - level[0]) / (moved[k + 1, :, k] - at[:, k])[:, None] * span[k] for k in range(m)], 2)

    which = np.arange(rows)
    (r, slopes), used, damping = near(x, which), rows * (m + 1), np.full(rows, 1e-2)
    for _ in range(rounds):
        now, base, jacobian = x[which], r[which], slopes[which]
        gradient = np.einsum("nfk,nf->nk", jacobian, base)
        square = np.einsum("nfk,nfl->nkl", jacobian, jacobian)
        held = (now <= low) & (gradient > 0) | (now >= high) & (gradient < 0)  # pushed against a bound
        square = np.where(held[:, :, None] | held[:, None, :], 0.0, square)
        ridge = damping[which, None] * (np.einsum("nkk->nk", square) + 1e-12) + held
        move = -np.linalg.solve(square + ridge[:, :, None] * np.eye(m), np.where(held, 0.0, gradient)[..., None])[..., 0]
        trial = np.clip(now + move * span, low, high)
        new, fresh = near(trial, which)
        used += len(which) * (m + 1)
        before, after = (base**2).sum(1), (new**2).sum(1)
        better = after < before
        x[which], r[which], slopes[which] = np.where(better[:, None], trial, now), np.where(better[:, None], new, base), np.where(better[:, None, None], fresh, jacobian)
        damping[which] = np.where(better, damping[which] / 5, damping[which] * 5)
        small = np.abs(trial - now).max(1) <= tolerance * span.max()
        which = which[~((better & (before - after <= tolerance * (1 + before))) | (small & ~better) | (damping[which] > 1e12))]
        if not len(which):
            break
    return x, np.abs(r).sum(1), used
