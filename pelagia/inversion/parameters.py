"""Model parameters with bounds, on their own scale or on [0, 1]."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np

BOUNDS = {"min": -math.inf, "max": math.inf, "vary": True}


def checked(parameters: Mapping) -> dict[str, dict]:
    """Every parameter as value, min, max and vary; bad ones raise."""
    if not isinstance(parameters, Mapping):
        raise TypeError("parameters must be a dictionary")
    out = {}
    for name, given in parameters.items():
        if not isinstance(name, (str, int, float)):
            raise TypeError(f"parameter key '{name}' must be a number or a string")
        extra = set(given) - {"value", *BOUNDS}
        if extra or "value" not in given:
            raise ValueError(f"parameter '{name}' needs a value and takes min, max and vary, not {sorted(extra)}")
        p = BOUNDS | dict(given)
        if not p["min"] <= p["value"] <= p["max"]:
            raise ValueError(f"value {p['value']} of '{name}' is outside [{p['min']}, {p['max']}]")
        out[name] = p
    return out


class InvParameters:
    """Named parameters, their bounds, and random realisations within them."""

    def __init__(self, parameters: Mapping):
        self._own = checked(parameters)
        self.is_scaled = False
        self.realizations: dict[int, dict] = {}

    def __repr__(self) -> str:
        return f"InvParameters(scaled={self.is_scaled}, parameters={list(self._own)})"

    @classmethod
    def from_values(cls, values: Mapping[str, float]) -> "InvParameters":
        return cls({k: {"value": v} for k, v in values.items()})

    @property
    def parameters(self) -> dict[str, dict]:
        if not self.is_scaled:
            return self._own
        share = lambda p: (p["value"] - p["min"]) / (p["max"] - p["min"]) if p["max"] != p["min"] else 0.0
        return {k: p | {"value": share(p), "min": 0.0, "max": 1.0} for k, p in self._own.items()}

    @property
    def values(self) -> dict[str, float]:
        return {k: p["value"] for k, p in self.parameters.items()}

    @property
    def bounds(self) -> dict[str, dict]:
        return {k: {"min": p["min"], "max": p["max"]} for k, p in self._own.items()}

    def scale(self) -> None:
        """From now on values lie in [0, 1] between their bounds."""
        self.is_scaled = True

    def unscale(self) -> None:
        self.is_scaled = False

    def inverse_transform(self, scaled: Mapping[str, float]) -> dict[str, float]:
        """Values on their own scale from those on [0, 1]."""
        return {k: v * (self._own[k]["max"] - self._own[k]["min"]) + self._own[k]["min"] for k, v in scaled.items()}

    def update_bounds(self, bounds: Mapping[str, Mapping]) -> None:
        self._own = checked({k: p | {b: v for b, v in bounds.get(k, {}).items() if b in ("min", "max")} for k, p in self._own.items()})

    def simulate_parameter_sets(self, count: int | None = None, rng: np.random.Generator | None = None) -> None:
        """Uniform draws of the varying parameters; without a count the parameters themselves."""
        p = self.parameters
        if not count:
            self.realizations = {0: p}
            return
        rng = rng or np.random.default_rng()
        self.realizations = {i: {k: v | {"value": float(rng.uniform(v["min"], v["max"])) if v["vary"] else v["value"]} for k, v in p.items()} for i in range(count)}
