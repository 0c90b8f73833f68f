"""Empirical variograms and their fit.

Pairs come from an equi-join on square tiles as wide as the longest lag, so no
pair farther apart than the neighbouring tile is ever formed; dense tiles are cut
into parts. Co-located points
are summed up first: the symmetric pairs of two places follow from their counts and
sums, and the compat ones from running sums by row number, so that no pair of rows
at two places is formed, however many rows they have.

``mode="compat"`` pairs rows i and j (numbered in the order of a key) with
i + j <= n - 2, both ways round and with themselves, as established surveys do;
its result depends on the order. ``mode="symmetric"`` pairs every two different
rows, both ways round. Null positions or values take part in nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions.ranking import global_rank
from pelagia.geostatistics.models import arguments, gamma_array
from pelagia.session import small_batches

#: Rows of a dense tile that one task pairs, and the most tiles that are cut.
PART, TILES = 2000, 4096


def azimuth(dx: Column, dy: Column) -> Column:
    """Angle of a pair in degrees, in [-90, 90]; 0 for a point with itself."""
    up = F.when(dy > 0, 90.0).when(dy < 0, -90.0).otherwise(0.0)
    return F.when(dx == 0, up).otherwise(F.degrees(F.atan(F.try_divide(dy, dx))))


def tiles(x: str, y: str, width: float) -> tuple[Column, Column]:
    return F.floor(F.col(x) / width), F.floor(F.col(y) / width)


def near_pairs(left: DataFrame, right: DataFrame, width: float, x: str, y: str, part: int = PART) -> DataFrame:
    """All pairs of rows whose tiles touch: columns of ``left`` as struct a, of ``right`` as struct b, and dx, dy, distance.

    A tile with more than ``part`` rows of ``left``, or more than one in TILES of them, is
    cut into parts of about so many; each meets the rows of ``right`` in a task of its own.
    """
    i, j = tiles(x, y, width)
    around = F.explode(F.array(*[F.struct((i + p).alias("i"), (j + q).alias("j")) for p in (-1, 0, 1) for q in (-1, 0, 1)]))
    a = left.select(F.struct(*left.columns).alias("a"), i.alias("_i"), j.alias("_j"))
    b = right.select(F.struct(*right.columns).alias("b"), around.alias("_t")).select("b", F.col("_t.i").alias("_i"), F.col("_t.j").alias("_j"))
    most = max(part, a.count() // TILES)
    dense = a.groupBy("_i", "_j").count().where(F.col("count") > most).select("_i", "_j", F.ceil(F.col("count") / most).cast("int").alias("_n"))
    dense = F.broadcast(dense)  # at most TILES tiles
    n = F.coalesce("_n", F.lit(1))
    a = a.join(dense, ["_i", "_j"], "left").withColumn("_p", F.pmod(F.xxhash64("a"), n).cast("int"))
    b = b.join(dense, ["_i", "_j"], "left").withColumn("_p", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = a.drop("_n").join(b.drop("_n"), ["_i", "_j", "_p"]).select("a", "b", (F.col(f"a.{x}") - F.col(f"b.{x}")).alias("dx"), (F.col(f"a.{y}") - F.col(f"b.{y}")).alias("dy"))
    return rows.withColumn("distance", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))


def lag_pairs(left: DataFrame, right: DataFrame, x: str, y: str, n_lags: int, resolution: float) -> DataFrame:
    """Near pairs with their lag number 1 .. n_lags - 1: the rounded (half to even) distance in lags, plus 1."""
    rows = near_pairs(left, right, n_lags * resolution, x, y)
    return rows.withColumn("lag", (F.rint(F.col("distance") / resolution) + 1).cast("int")).where(F.col("lag") < n_lags)


SUMS = ("w", "h1", "h2", "t1", "t2", "d")


def chunks(ranked: DataFrame, n: int, part: int) -> DataFrame:
    """(x, y, m, s, q, lo, hi, rows): rows (r, z) at one place in the order of r, with their count, sums and least and largest r.

    A place with more than ``part`` rows, or more than one in TILES of them, has
    several chunks, cut by r.
    """
    most = max(part, n // TILES)
    dense = ranked.groupBy("x", "y").count().where(F.col("count") > most).select("x", "y", F.ceil(F.lit(float(n)) * most / F.col("count")).alias("_w"))
    rows = ranked.join(F.broadcast(dense), ["x", "y"], "left").withColumn("_c", F.coalesce(F.expr("r div _w"), F.lit(0)))  # at most TILES places
    sums = [F.count("*").cast("double").alias("m"), F.sum("z").alias("s"), F.sum(F.col("z") ** 2).alias("q"), F.min("r").alias("lo"), F.max("r").alias("hi")]
    return rows.groupBy("x", "y", "_c").agg(*sums, F.array_sort(F.collect_list(F.struct("r", F.col("z").cast("double").alias("z")))).alias("rows")).drop("_c")


def pair_sums(ra: np.ndarray, za: np.ndarray, rb: np.ndarray, zb: np.ndarray, most: int) -> list[float]:
    """SUMS over the pairs with ra + rb <= most; rb ascends."""
    k = np.searchsorted(rb, most - ra, "right")
    s, q = (np.concatenate([[0.0], np.cumsum(v)])[k] for v in (zb, zb * zb))
    return [float(v.sum()) for v in (k, k * za, k * za * za, s, q, k * za * za - 2 * za * s + q)]


def compat_pairs(ranked: DataFrame, n: int, n_lags: int, resolution: float, inside: Column, part: int = PART) -> DataFrame:
    """(lag, ok, *SUMS) of the pairs of rows (x, y, z, r) with a.r + b.r <= n - 2, summed up by pairs of chunks."""
    small_batches(ranked.sparkSession)
    cut = chunks(ranked, n, part).checkpoint()
    sums = cut.drop("rows")
    pairs = lag_pairs(sums, sums, "x", "y", n_lags, resolution).where(F.col("a.hi") + F.col("b.hi") <= n - 2)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    d = b("m") * a("q") + a("m") * b("q") - 2 * a("s") * b("s")
    whole = pairs.select("lag", inside.alias("ok"), *[v.alias(c) for c, v in zip(SUMS, (a("m") * b("m"), a("s") * b("m"), a("q") * b("m"), a("m") * b("s"), a("m") * b("q"), d))])
    if (cut.agg(F.max("m")).first()[0] or 0) <= 1:  # a pair of single rows counts or not
        return whole

    def run(batches):
        for batch in batches:
            lag, ok = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            flat = [(c.offsets.to_numpy(), *(c.values.field(k).to_numpy() for k in (0, 1))) for c in (batch.column(2), batch.column(3))]
            found: dict[tuple, np.ndarray] = {}
            for k, key in enumerate(zip(lag, ok)):
                (ra, za), (rb, zb) = ((r[at[k] : at[k + 1]], z[at[k] : at[k + 1]]) for at, r, z in flat)
                found[key] = found.get(key, 0.0) + np.array(pair_sums(ra, za, rb, zb, n - 2))
            cols = zip(*((*key, *v.tolist()) for key, v in found.items())) if found else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.int32(), pa.bool_(), *[pa.float64()] * 6])], ["lag", "ok", *SUMS])

    rows = cut.select("x", "y", "lo", "hi", "rows")
    split = lag_pairs(rows, rows, "x", "y", n_lags, resolution).where((a("hi") + b("hi") > n - 2) & (a("lo") + b("lo") <= n - 2))
    split = split.select("lag", inside.alias("ok"), a("rows").alias("a"), b("rows").alias("b"))
    return whole.unionByName(split.mapInArrow(run, "lag int, ok boolean, " + ", ".join(f"{c} double" for c in SUMS)))


def empirical_variogram(points: DataFrame, n_lags: int, resolution: float, variable: str = "biomass_density", coordinates: tuple[str, str] = ("x", "y"), order: str | None = None, angle: float | None = None, force_lag_zero: bool = True, mode: str = "compat") -> DataFrame:
    """(lag, distance, count, gamma, covariance) by lag: the standardised semivariance.

    gamma is half the sum of squared differences over count times the population
    deviations of heads and tails; 0 where either is 0. ``angle`` keeps pairs whose
    azimuth lies in [-angle, angle) - not among heads, whose moments take all pairs.
    ``covariance`` is the product of both deviations, null where one is 0.
    """
    if mode not in ("compat", "symmetric"):
        raise ValueError(f"mode '{mode}' is neither compat nor symmetric")
    x, y = coordinates
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(variable).isNotNull())
    inside = F.lit(True) if angle is None else (azimuth(F.col("dx"), F.col("dy")) >= -angle) & (azimuth(F.col("dx"), F.col("dy")) < angle)
    if mode == "compat":
        if order is None:
            raise ValueError("mode compat needs the column that orders the rows")
        n = rows.count()
        ranked = global_rank(rows.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(variable).alias("z"), F.col(order).alias("_order")), "_order", "r").drop("_order")
        one = compat_pairs(ranked, n, n_lags, resolution, inside)
    else:
        n = rows.count()
        places = rows.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").cast("double").alias("m"), F.sum(variable).alias("s"), F.sum(F.col(variable) ** 2).alias("q"))
        p = lag_pairs(places, places, "x", "y", n_lags, resolution)
        # a place with itself: the pairs of its different rows
        itself = (F.col("dx") == 0) & (F.col("dy") == 0)
        times = F.col("b.m") - itself.cast("double")
        d = F.col("b.m") * F.col("a.q") + F.col("a.m") * F.col("b.q") - 2 * F.col("a.s") * F.col("b.s")
        one = p.select("lag", inside.alias("ok"), (F.col("a.m") * times).alias("w"), (F.col("a.s") * times).alias("h1"), (F.col("a.q") * times).alias("h2"), *[F.when(itself, F.col(f"b.{c}") * times).otherwise(F.col("a.m") * F.col(f"b.{c}")).alias(k) for c, k in (("s", "t1"), ("q", "t2"))], d.alias("d"))
    kept = lambda c: F.sum(F.when(F.col("ok"), F.col(c)).otherwise(0.0))
    sums = one.groupBy("lag").agg(kept("w").alias("n"), F.sum("w").alias("hn"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"), kept("t1").alias("t1"), kept("t2").alias("t2"), kept("d").alias("d"))
    # heads are weighed by counts of all pairs over the counts of the kept ones
    share = F.try_divide(F.col("h1"), F.col("n"))
    head = F.sqrt(F.greatest(F.try_divide(F.col("h2") - 2 * share * F.col("h1") + share**2 * F.col("hn"), F.col("n")), F.lit(0.0)))
    tail = F.sqrt(F.abs(F.try_divide(F.col("t2"), F.col("n")) - F.try_divide(F.col("t1"), F.col("n")) ** 2))
    sums = sums.withColumn("sill", F.coalesce(head * tail, F.lit(0.0)))
    spine = points.sparkSession.range(1, n_lags).select(F.col("id").cast("int").alias("lag"))
    out = spine.join(F.broadcast(sums), "lag", "left")  # one row per lag
    gamma = F.when(F.col("sill") > 0, F.try_divide(F.col("d") * 0.5, F.col("n") * F.col("sill")))
    out = out.select("lag", (F.col("lag") * F.lit(float(resolution))).alias("distance"), F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("count"), F.coalesce(gamma, F.lit(0.0)).alias("gamma"), F.when(F.col("sill") > 0, F.col("sill")).alias("covariance"))
    if force_lag_zero:
        zero = points.sparkSession.createDataFrame([(0, 0.0, max(0, n - 1), 0.0, None)], "lag int, distance double, count long, gamma double, covariance double")
        out = zero.unionByName(out)
    return out


@dataclass
class Parameter:
    """A model parameter: its value, bounds, and whether the fit moves it."""

    value: float
    low: float = -np.inf
    high: float = np.inf
    vary: bool = True

    def __post_init__(self):
        if not self.low <= self.value <= self.high:
            raise ValueError(f"value {self.value} is outside [{self.low}, {self.high}]")


def bounded_least_squares(residual: Callable[[np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 500, tolerance: float = 1e-12) -> np.ndarray:
    """Least squares within bounds by a damped Gauss-Newton method with projection.

    Variables at a bound that the gradient pushes against are held for the step.
    """
    x = np.clip(start, low, high)
    scale = np.maximum(np.abs(x), 1e-3)
    r = residual(x)
    cost, damping = float(r @ r), 1e-3
    for _ in range(rounds):
        step = 1e-7 * np.maximum(np.abs(x), 1e-4)
        step = np.where(x + step > high, -step, step)
        jac = np.stack([(residual(x + np.eye(len(x))[k] * step[k]) - r) / step[k] for k in range(len(x))], 1)
        slope = jac.T @ r
        free = ~((x <= low) & (slope > 0) | (x >= high) & (slope < 0))
        if not free.any() or np.abs(slope[free] * scale[free]).max() <= tolerance * max(cost, 1e-300):
            break
        better = False
        while damping < 1e12:
            a = jac[:, free].T @ jac[:, free]
            try:
                move = np.linalg.solve(a + damping * np.diag(np.maximum(np.diag(a), 1e-30)), -slope[free])
            except np.linalg.LinAlgError:
                damping *= 10
                continue
            new = x.copy()
            new[free] = np.clip(x[free] + move, low[free], high[free])
            rn = residual(new)
            cn = float(rn @ rn)
            if np.isfinite(cn) and cn < cost:
                better = True
                small = cost - cn <= tolerance * cost and np.abs(new - x).max() <= tolerance * np.abs(x).max()
                x, r, cost, damping = new, rn, cn, max(damping / 5, 1e-12)
                break
            damping *= 4
        if not better or small:
            break
    return x


def fit_variogram(lags: np.ndarray, counts: np.ndarray, gamma: np.ndarray, parameters: Mapping[str, Parameter], model: str | Sequence[str] = ("bessel", "exponential"), **options) -> tuple[dict[str, float], float, float]:
    """Best parameters, and the mean absolute weighted deviation before and after.

    Residuals are (model - gamma) times a lag's share of all pairs. The inputs have
    one entry per lag.
    """
    lags, gamma, share = np.asarray(lags, float), np.asarray(gamma, float), np.asarray(counts, float) / np.sum(counts)
    names = [n for n, p in parameters.items() if p.vary and n in arguments(model)]
    fixed = {n: p.value for n, p in parameters.items()}

    def residual(x: np.ndarray) -> np.ndarray:
        return (gamma_array(lags, fixed | dict(zip(names, x.tolist())), model) - gamma) * share

    start = np.array([parameters[n].value for n in names], float)
    best = bounded_least_squares(residual, start, *(np.array([getattr(parameters[n], k) for n in names], float) for k in ("low", "high")), **options) if names else start
    return fixed | dict(zip(names, best.tolist())), float(np.abs(residual(start)).mean()), float(np.abs(residual(best)).mean())


@dataclass
class Variogram:
    """Lags, empirical semivariance and a fitted model."""

    lag_resolution: float
    n_lags: int
    coordinate_names: tuple[str, str] = ("x", "y")
    lags: np.ndarray | None = None
    gamma: np.ndarray | None = None
    lag_counts: np.ndarray | None = None
    lag_covariance: float | None = None
    initial: dict = field(default_factory=dict)
    optimized: dict = field(default_factory=dict)
    model: str | Sequence[str] | None = None

    def __post_init__(self):
        if not self.lag_resolution > 0 or not np.isfinite(self.lag_resolution):
            raise ValueError("lag_resolution must be a positive finite number")
        if int(self.n_lags) != self.n_lags or self.n_lags < 1:
            raise ValueError("n_lags must be a positive whole number")

    def calculate_empirical_variogram(self, data: DataFrame, variable: str, order: str | None = None, azimuth_filter: bool = True, azimuth_angle_threshold: float = 180.0, force_lag_zero: bool = True, mode: str = "compat") -> "Variogram":
        rows = empirical_variogram(data, self.n_lags, self.lag_resolution, variable, self.coordinate_names, order, azimuth_angle_threshold if azimuth_filter else None, force_lag_zero, mode).orderBy("lag").collect()  # one row per lag
        self.lags, self.lag_counts, self.gamma = (np.array([r[c] for r in rows], float) for c in ("distance", "count", "gamma"))
        known = [r["covariance"] for r in rows if r["covariance"] is not None]
        self.lag_covariance = float(np.mean(known)) if known else float("nan")
        return self

    def fit_variogram_model(self, model: str | Sequence[str], parameters: Mapping[str, Parameter], **options) -> dict[str, float]:
        if self.gamma is None:
            raise RuntimeError("calculate_empirical_variogram has to run first")
        best, before, after = fit_variogram(self.lags, self.lag_counts, self.gamma, parameters, model, **options)
        self.model = model
        self.initial = {n: p.value for n, p in parameters.items()} | {"mad": before}
        self.optimized = best | {"mad": after}
        return best
