"""Theoretical variogram models, each written once for columns and for numpy arrays.

A model is a function of a backend ``m`` (``NUMPY`` or ``COLUMNS``), the lag
distance and its parameters. ``gamma_column`` gives a Spark column, which stays in
the JVM; ``gamma_array`` a numpy array, for kernels and fits. Composite models are
named by their parts in any order, in any case.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pelagia.functions.special import bessel_j, bessel_k

#: Distances below this count as zero where a model has no value at zero.
TINY = 1e-10


class _Numpy:
    """Array arithmetic."""

    exp, cos, sin, sqrt, log, arcsin, arccos = np.exp, np.cos, np.sin, np.sqrt, np.log, np.arcsin, np.arccos

    @staticmethod
    def where(test, yes, no):
        return np.where(test, yes, no)

    @staticmethod
    def power(x, p):
        return np.power(x, p)

    @staticmethod
    def least(x, limit):
        return np.minimum(x, limit)

    @staticmethod
    def most(x, limit):
        return np.maximum(x, limit)

    @staticmethod
    def j0(x):
        return bessel_j(0, x)

    @staticmethod
    def k(order, x):
        return bessel_k(order, x)


class _Columns:
    """The same in column expressions."""

    exp, cos, sin, sqrt, log, arcsin, arccos = map(staticmethod, (F.exp, F.cos, F.sin, F.sqrt, F.ln, F.asin, F.acos))

    @staticmethod
    def where(test, yes, no):
        lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
        return F.when(test, lit(yes)).otherwise(lit(no))

    @staticmethod
    def power(x, p):
        return F.pow(x, F.lit(float(p)))

    @staticmethod
    def least(x, limit):
        return F.least(x, F.lit(float(limit)))

    @staticmethod
    def most(x, limit):
        return F.greatest(x, F.lit(float(limit)))

    @staticmethod
    def j0(x, nodes: int = 64):
        """Midpoint rule on the integral of cos(x sin t); Hankel's series beyond 25, where it is exact to the last digits."""
        near = F.aggregate(F.array(*[F.lit(math.sin((k + 0.5) * math.pi / nodes)) for k in range(nodes)]), F.lit(0.0), lambda s, t: s + F.cos(x * t)) / nodes
        p, q, term = F.lit(1.0), F.lit(0.0), 1.0
        for k in range(1, 17):
            term *= -((2 * k - 1) ** 2) / (8.0 * k)
            part = term / F.pow(F.abs(x), F.lit(float(k)))
            if k % 2:
                q = q + (part if k % 4 == 1 else -part)
            else:
                p = p + (part if k % 4 == 0 else -part)
        turn = F.abs(x) - math.pi / 4
        far = F.sqrt(F.lit(2 / math.pi) / F.abs(x)) * (p * F.cos(turn) - q * F.sin(turn))
        return F.when(F.abs(x) > 25, far).otherwise(near)

    @staticmethod
    def k(order, x, step: float = 0.125, reach: float = 31.0):
        """Trapezoid rule on the integral of exp(-x cosh t) cosh(order t)."""
        nodes = [k * step for k in range(int(reach / step) + 1)]
        pairs = F.array(*[F.struct(F.lit(math.cosh(t)).alias("c"), F.lit(math.log(math.cosh(order * t) * step * (0.5 if t == 0 else 1.0))).alias("w")) for t in nodes])
        return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + F.exp(v["w"] - x * v["c"]))


NUMPY, COLUMNS = _Numpy(), _Columns()

SINGLE: dict[str, Callable] = {}
COMPOSITE: dict[tuple[str, ...], Callable] = {}


def model(*names: str):
    """Register a model under its name, or under the sorted names of its parts."""

    def keep(f):
        if len(names) > 1:
            COMPOSITE[tuple(sorted(names))] = f
        else:
            SINGLE[names[0]] = f
        return f

    return keep


def _rising(correlation, sill, nugget):
    """From the nugget at full correlation up to the sill at none."""
    return nugget + (sill - nugget) * (1 - correlation)


@model("circular")
def circular(m, h, sill, nugget, correlation_range):
    r = m.least(h / correlation_range, 1.0)
    return m.where(h < correlation_range, nugget + sill * (1 - (m.arccos(r) - r * m.sqrt(1 - r * r)) * (2 / math.pi)), nugget + sill)


@model("cubic")
def cubic(m, h, sill, nugget, correlation_range):
    r = h / correlation_range
    shape = r * r * (7 + r * (-8.75 + r * r * (3.5 - 0.75 * r * r)))
    return m.where(r <= 1, nugget + (sill - nugget) * shape, sill)


@model("exclass")
def exclass(m, h, sill, correlation_range, alpha):
    return sill * (1 - m.exp(-m.power(h / correlation_range, alpha)))


@model("exponential")
def exponential(m, h, sill, nugget, correlation_range):
    return _rising(m.exp(-(h / correlation_range)), sill, nugget)


@model("gaussian")
def gaussian(m, h, sill, nugget, correlation_range):
    return _rising(m.exp(-(h * h / correlation_range**2)), sill, nugget)


@model("jbessel")
def jbessel(m, h, sill, nugget, hole_effect_range):
    return _rising(m.j0(h * hole_effect_range), sill, nugget)


@model("kbessel")
def kbessel(m, h, sill, nugget, hole_effect_range):
    if hole_effect_range == 0:
        return m.where(h == 0, 0.0, nugget)
    r = h / hole_effect_range
    return m.where(r < 1e-4, nugget, _rising(r * m.k(1.0, m.most(r, 1e-4)), sill, nugget))


@model("linear")
def linear(m, h, sill, nugget):
    return h * (sill - nugget) + nugget


@model("linear_plateau")
def linear_plateau(m, h, sill, correlation_range):
    return m.where(h < correlation_range, h * sill / correlation_range, sill)


@model("logarithmic")
def logarithmic(m, h, sill, nugget, correlation_range):
    return m.where(h == 0, nugget, nugget + sill * m.log(h + correlation_range))


@model("matern")
def matern(m, h, sill, nugget, correlation_range, smoothness_parameter):
    v = smoothness_parameter
    z = m.where(h == 0, TINY, h / correlation_range) * math.sqrt(2 * v)
    correlation = m.power(z, v) * m.k(v, z) * (2 ** (1 - v) / math.gamma(v))
    return m.where(h == 0, nugget, _rising(correlation, sill, nugget))


@model("nugget")
def nugget(m, h, sill, nugget):
    return m.where(h == 0, 0.0, sill + nugget)


@model("pentaspherical")
def pentaspherical(m, h, sill, nugget, correlation_range):
    r = h / correlation_range
    return m.where(r <= 1, nugget + (sill - nugget) * r * (15 - 10 * r * r + 3 * r * r * r * r) / 8, sill)


@model("periodic")
def periodic(m, h, sill, nugget, correlation_range):
    return nugget + sill * (1 - m.cos(h * (2 * math.pi) / correlation_range))


@model("power")
def power(m, h, sill, nugget, power_exponent):
    return nugget + sill * m.where(h == 0, 0.0, m.power(h, power_exponent))


@model("quadratic")
def quadratic(m, h, sill, nugget, correlation_range, shape_parameter):
    r = h / correlation_range
    return _rising(m.power(1 + r * r / (2 * shape_parameter), -shape_parameter), sill, nugget)


@model("sinc")
def sinc(m, h, sill, nugget, hole_effect_range):
    away = h + np.finfo(float).eps
    return _rising(m.sin(away * hole_effect_range) / away, sill, nugget)


@model("spherical")
def spherical(m, h, sill, nugget, correlation_range):
    r = h / correlation_range
    return m.where(h < correlation_range, nugget + (sill - nugget) * r * (3 - r * r) / 2, sill + nugget)


@model("spline")
def spline(m, h, sill, correlation_range):
    near = m.most(h, TINY)
    return m.where(h >= correlation_range, sill, near * near * m.log(near))


@model("stein")
def stein(m, h, correlation_range, smoothness):
    z = m.most(h, TINY) * (2 * math.sqrt(smoothness)) / correlation_range
    return 1 - m.power(z, smoothness) * m.k(smoothness, z) * (2 ** (1 - smoothness) / math.gamma(smoothness))


@model("tetraspherical")
def tetraspherical(m, h, sill, nugget, correlation_range):
    r = m.least(h / correlation_range, 1.0)
    c = m.sqrt(1 - r * r)
    return m.where(h < correlation_range, nugget + sill * (m.arcsin(r) + r * c + r * c * c * c * 2 / 3), nugget + sill)


@model("wave")
def wave(m, h, sill, nugget, correlation_range):
    turn = m.where(h == 0, 1.0, h) * math.pi / correlation_range
    return m.where(h == 0, nugget, nugget + sill * (1 - m.sin(turn) / turn))


@model("whittle")
def whittle(m, h, sill, nugget, correlation_range):
    return nugget + sill * (1 - m.k(1.0, m.most(h, TINY) / correlation_range))


def _decay(m, h, correlation_range, exponent):
    return 1 - m.exp(-m.power(h / correlation_range, exponent))


@model("bessel", "gaussian")
def bessel_gaussian(m, h, sill, nugget, correlation_range, hole_effect_range):
    return nugget + (sill - nugget) * _decay(m, h, correlation_range, 2) * m.j0(h * hole_effect_range)


@model("bessel", "exponential")
def bessel_exponential(m, h, sill, nugget, correlation_range, decay_power, hole_effect_range):
    return nugget + (sill - nugget) * _decay(m, h, correlation_range, decay_power) * m.j0(h * hole_effect_range)


@model("cosine", "exponential")
def cosine_exponential(m, h, sill, nugget, correlation_range, hole_effect_range, enhance_semivariance):
    sign = 1.0 if enhance_semivariance is True else -1.0
    return nugget + (sill - nugget) * (1 + m.exp(-(h / correlation_range)) * m.cos(h * hole_effect_range) * sign)


@model("cosine", "gaussian")
def cosine_gaussian(m, h, sill, nugget, correlation_range, hole_effect_range):
    r = h / correlation_range
    return nugget + (sill - nugget) * m.exp(-(r * r)) * m.cos(h * hole_effect_range)


@model("exponential", "linear")
def exponential_linear(m, h, sill, nugget, correlation_range, hole_effect_range, decay_power):
    return nugget + (sill - nugget) * _decay(m, h, correlation_range, decay_power) * (1 - m.power(h, decay_power) * hole_effect_range)


@model("gaussian", "linear")
def gaussian_linear(m, h, sill, nugget, correlation_range, hole_effect_range):
    return nugget + (sill - nugget) * _decay(m, h, correlation_range, 2) * (1 - h * h * hole_effect_range)


def lookup(name: str | Sequence[str]) -> Callable:
    """The model of a name or of the names of its parts; LookupError if there is none."""
    parts = [name.lower()] if isinstance(name, str) else sorted(n.lower() for n in name)
    found = SINGLE.get(parts[0]) if len(parts) == 1 else COMPOSITE.get(tuple(parts))
    if found is None:
        raise LookupError(f"the model input ({name}) is not a known variogram model")
    return found


def arguments(name: str | Sequence[str]) -> list[str]:
    """Names of the parameters that a model takes, besides the lag distance."""
    return list(inspect.signature(lookup(name)).parameters)[2:]


def _bound(name, parameters: Mapping) -> tuple[Callable, dict]:
    if name is None:
        name = parameters.get("model")
        if name is None:
            raise ValueError("the argument `model` is missing")
    missing = [a for a in arguments(name) if a not in parameters]
    if missing:
        raise ValueError(f"the following variogram parameters are missing: {', '.join(missing)}")
    return lookup(name), {a: parameters[a] for a in arguments(name)}


def gamma_column(h: Column, parameters: Mapping, name: str | Sequence[str] | None = None) -> Column:
    """Semivariance at a distance column; parameters that the model doesn't take are ignored."""
    f, given = _bound(name, parameters)
    return f(COLUMNS, h, **given)


def gamma_array(h: np.ndarray, parameters: Mapping, name: str | Sequence[str] | None = None) -> np.ndarray:
    """The same for an array of distances."""
    f, given = _bound(name, parameters)
    return np.asarray(f(NUMPY, np.asarray(h, float), **given), float)
