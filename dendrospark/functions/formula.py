"""Model formulas: terms 1, 0, x, C(x), ns(x, df=k), a + b, a:b, a * b; and natural cubic splines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd


def normalize_formula(text: str) -> str:
    text = text.strip()
    text = text if text.startswith("~") else "~" + text
    return re.sub(r"(?:sm\.|splines::|VGAM::sm\.)ns\(", "ns(", text)


def formula_terms(text: str) -> list[str]:
    """Variable names in the order in which they are first seen."""
    out: list[str] = []
    for m in re.finditer(r"([A-Za-z_][\w.]*)\s*(\(|=(?!=))?", normalize_formula(text)[1:]):
        if not m[2] and m[1] not in out:
            out.append(m[1])
    return out


def bspline(knots: np.ndarray, x: np.ndarray, order: int = 4, deriv: int = 0) -> np.ndarray:
    """B-spline basis of the given order by the Cox-de Boor recursion, or a derivative of it."""
    n = len(knots) - order
    if deriv:
        low = bspline(knots, x, order - 1, deriv - 1)
        out = np.zeros((len(x), n))
        for i in range(n):
            a, b = knots[i + order - 1] - knots[i], knots[i + order] - knots[i + 1]
            out[:, i] = (order - 1) * ((low[:, i] / a if a > 0 else 0) - (low[:, i + 1] / b if b > 0 else 0))
        return out
    if order == 1:
        out = ((x[:, None] >= knots[:-1]) & (x[:, None] < knots[1:])).astype(float)
        last = np.flatnonzero(np.diff(knots) > 0)[-1]
        out[x == knots[-1], last] = 1
        return out
    low = bspline(knots, x, order - 1)
    out = np.zeros((len(x), n))
    for i in range(n):
        a, b = knots[i + order - 1] - knots[i], knots[i + order] - knots[i + 1]
        if a > 0:
            out[:, i] += (x - knots[i]) / a * low[:, i]
        if b > 0:
            out[:, i] += (knots[i + order] - x) / b * low[:, i + 1]
    return out


def ns_basis(x: np.ndarray, knots: np.ndarray, boundary: tuple[float, float], intercept: bool = False) -> np.ndarray:
    """Natural cubic basis: second derivatives vanish at the boundary, linear beyond it; NaN stays NaN."""
    full = np.concatenate([[boundary[0]] * 4, np.sort(knots), [boundary[1]] * 4])
    inside = np.clip(x, *boundary)
    base = bspline(full, inside)
    ends = np.array(boundary, dtype=float)
    value, slope = bspline(full, ends), bspline(full, ends, deriv=1)
    for side, at in ((0, x < boundary[0]), (1, x > boundary[1])):
        base[at] = value[side] + (x[at] - boundary[side])[:, None] * slope[side]
    second = bspline(full, ends, deriv=2)
    if not intercept:
        base, second = base[:, 1:], second[:, 1:]
    q = np.linalg.qr(second.T, mode="complete")[0]
    out = (base @ q)[:, 2:]
    out[np.isnan(x)] = np.nan
    return out


@dataclass
class Design:
    """A formula with what it learnt from training data: spline knots and factor levels."""

    formula: str
    knots: dict = field(default_factory=dict)
    levels: dict = field(default_factory=dict)

    def matrix(self, data: pd.DataFrame) -> np.ndarray:
        right = normalize_formula(self.formula)[1:]
        blocks: dict[str, list[np.ndarray]] = {}
        intercept = True
        for raw in self._split(right, "+"):
            t = raw.strip()
            if t in ("1", "0", "-1", ""):
                intercept = intercept and t in ("1", "")
                continue
            parts = [p.strip() for p in self._split(t, "*")]
            combos = [[p] for p in parts] + ([parts] if len(parts) > 1 else []) if len(parts) > 1 else [[p.strip() for p in self._split(t, ":")]]
            for combo in combos:
                cols = [np.ones(len(data))]
                for p in combo:
                    cols = [a * b for b in self._term(p, data) for a in cols]
                blocks.setdefault(":".join(combo), cols)
        out = [np.ones(len(data))] if intercept else []
        return np.stack(out + [c for cols in blocks.values() for c in cols], axis=1)

    @staticmethod
    def _split(text: str, sep: str) -> list[str]:
        out, depth = [""], 0
        for ch in text:
            depth += (ch == "(") - (ch == ")")
            if ch == sep and not depth:
                out.append("")
            else:
                out[-1] += ch
        return out

    def _term(self, t: str, data: pd.DataFrame) -> list[np.ndarray]:
        m = re.fullmatch(r"ns\(\s*([\w.]+)\s*(?:,\s*(?:df\s*=\s*)?(\d+))?\s*\)", t)
        if m:
            x, df = data[m[1]].to_numpy(dtype=float), int(m[2] or 3)
            if t not in self.knots:
                good = x[~np.isnan(x)]
                self.knots[t] = (np.quantile(good, np.linspace(0, 1, df + 1)[1:-1]), (good.min(), good.max()))
            return list(ns_basis(x, *self.knots[t]).T)
        name = m[1] if (m := re.fullmatch(r"C\(\s*([\w.]+)\s*\)", t)) else t
        if name not in data.columns:
            raise ValueError(f"{name!r} in {self.formula!r} is not a column")
        col = data[name]
        if t != name or not pd.api.types.is_numeric_dtype(col) or isinstance(col.dtype, pd.CategoricalDtype):
            if name not in self.levels:
                self.levels[name] = list(col.cat.categories) if isinstance(col.dtype, pd.CategoricalDtype) else sorted(col.unique())
            return [(col == v).to_numpy(dtype=float) for v in self.levels[name][1:]]
        return [col.to_numpy(dtype=float)]
