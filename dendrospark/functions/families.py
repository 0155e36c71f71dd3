"""Expression families: one value that chooses the response and the likelihood of a gene."""

from __future__ import annotations

import math
from dataclasses import dataclass

# The family names by what they are asked for with, and the parameters each has with its default.
KINDS = {
    "negbinomial.size": ("negbinomial.size", {"size": math.inf}),
    "negbinomial": ("negbinomial", {}),
    "tobit": ("Tobit", {"lower": 0.0, "upper": math.inf}),
    "uninormal": ("uninormal", {}),
    "binomialff": ("binomialff", {}),
}


@dataclass(frozen=True)
class Family:
    """lower and upper bound a censored response; size is a fixed negative binomial size. What a kind doesn't have stays at its neutral value."""

    vfamily: str = "negbinomial.size"
    size: float = math.inf
    lower: float = 0.0
    upper: float = math.inf

    def params(self) -> dict:
        return {k: getattr(self, k) for k in KINDS[self.vfamily.lower()][1]}


def family_from_name(name: str, **params) -> Family:
    if name == "gaussianff":
        raise ValueError("'gaussianff' is no family name here; use 'uninormal'")
    if name.lower() not in KINDS:
        raise ValueError(f"unknown expression family {name!r}")
    kind, known = KINDS[name.lower()]
    if extra := set(params) - set(known):
        raise TypeError(f"{kind} has no parameters {sorted(extra)}")
    return Family(kind, **params)
