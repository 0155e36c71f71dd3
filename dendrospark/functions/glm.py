"""Maximum-likelihood kernels in numpy: GLMs by IRLS, joint negative binomial, censored Gaussian, likelihood ratios."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


@dataclass
class Fit:
    params: np.ndarray
    llf: float
    kind: str  # how a linear predictor becomes a mean: log, identity, logit, log10
    extra: float = math.nan

    def predict(self, x: np.ndarray) -> np.ndarray:
        eta = x @ self.params
        if self.kind == "log":
            return np.exp(eta)
        if self.kind == "logit":
            return 1 / (1 + np.exp(-eta))
        return 10**eta if self.kind == "log10" else eta


def chi2_sf(stat: float, df: int) -> float:
    """P(X > stat) for integer df: erfc or exp, plus a finite sum."""
    if not stat > 0:
        return 1.0
    if df % 2 == 0:
        term = total = math.exp(-stat / 2)
        for i in range(1, df // 2):
            term *= stat / 2 / i
            total += term
        return total
    total = math.erfc(math.sqrt(stat / 2))
    term = math.sqrt(2 * stat / math.pi) * math.exp(-stat / 2)
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= stat / (2 * i + 1)
    return total


def nb_constant(y: np.ndarray, alpha: float) -> np.ndarray:
    """The terms of ``nb_loglik`` that no mean changes."""
    return _lgamma(y + 1) if alpha <= 0 else _lgamma(y + 1 / alpha) - math.lgamma(1 / alpha) - _lgamma(y + 1)


def nb_loglik(y: np.ndarray, mu: np.ndarray, alpha: float, constant: np.ndarray | None = None) -> float:
    constant = nb_constant(y, alpha) if constant is None else constant
    if alpha <= 0:
        return float(np.sum(np.where(y > 0, y * np.log(np.maximum(mu, 1e-300)), 0) - mu - constant))
    r = 1 / alpha
    return float(np.sum(constant - r * np.log1p(alpha * mu) + np.where(y > 0, y * (np.log(np.maximum(alpha * mu, 1e-300)) - np.log1p(alpha * mu)), 0)))


def fit_glm(y: np.ndarray, x: np.ndarray, family: str, alpha: float = 0.0, maxit: int = 100) -> Fit:
    """family: nb (alpha 0 or infinite: Poisson), gaussian with the ML scale, binomial."""
    if family == "gaussian":
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        n, rss = len(y), max(float(np.sum((y - x @ beta) ** 2)), 1e-300)
        return Fit(beta, -n / 2 * (math.log(2 * math.pi * rss / n) + 1), "identity")
    alpha = 0.0 if not math.isfinite(alpha) else alpha
    mu = (y + 0.5) / 2 if family == "binomial" else (y + max(y.mean(), 1e-8)) / 2
    eta = np.log(mu / (1 - mu)) if family == "binomial" else np.log(mu)
    beta, old = np.zeros(x.shape[1]), math.inf
    constant = None if family == "binomial" else nb_constant(y, alpha)
    for _ in range(maxit):
        slope = mu * (1 - mu) if family == "binomial" else mu
        w = slope if family == "binomial" else mu / (1 + alpha * mu)
        z = eta + (y - mu) / np.maximum(slope, 1e-12)
        sw = np.sqrt(np.maximum(w, 1e-12))
        beta = np.linalg.lstsq(x * sw[:, None], z * sw, rcond=None)[0]
        eta = np.clip(x @ beta, -30, 30)
        mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else np.exp(eta)
        llf = float(np.sum(y * np.log(np.maximum(mu, 1e-300)) + (1 - y) * np.log(np.maximum(1 - mu, 1e-300)))) if family == "binomial" else nb_loglik(y, mu, alpha, constant)
        if abs(llf - old) < 1e-10 * (abs(llf) + 0.1):
            break
        old = llf
    if not math.isfinite(llf):
        raise FloatingPointError("the likelihood is not finite")
    return Fit(beta, llf, "logit" if family == "binomial" else "log", alpha)


def fit_joint_nb(y: np.ndarray, x: np.ndarray) -> Fit:
    """Mean and dispersion together: golden-section search in ln(alpha) over IRLS fits."""
    lo, hi, g = math.log(1e-6), math.log(1e3), (math.sqrt(5) - 1) / 2
    f = lambda a: fit_glm(y, x, "nb", math.exp(a)).llf
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > 1e-7:
        if fa > fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return fit_glm(y, x, "nb", math.exp((lo + hi) / 2))


def _log_cdf(z: np.ndarray) -> np.ndarray:
    body = np.log(np.maximum(0.5 * _erfc(-z / math.sqrt(2)), 1e-300))
    tail = -z * z / 2 - np.log(np.maximum(-z, 1e-12)) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / np.maximum(z * z, 1.0001))
    return np.where(z < -25, tail, body)


def fit_tobit(y: np.ndarray, x: np.ndarray, lower: float = 0.0, upper: float = math.inf, maxit: int = 200) -> Fit:
    """Gaussian censored at lower and upper, in (beta, ln sigma), by Newton steps on a numeric Hessian of the score."""
    left, right = y <= lower, y >= upper
    mid = ~left & ~right

    def loglik(t: np.ndarray) -> float:
        s, eta = math.exp(t[-1]), x @ t[:-1]
        out = np.sum(-0.5 * ((y[mid] - eta[mid]) / s) ** 2) - mid.sum() * (t[-1] + 0.5 * math.log(2 * math.pi))
        return float(out + np.sum(_log_cdf((lower - eta[left]) / s)) + np.sum(_log_cdf((eta[right] - upper) / s)))

    def score(t: np.ndarray) -> np.ndarray:
        s, eta = math.exp(t[-1]), x @ t[:-1]
        z = (y - eta) / s
        de, ds = np.zeros(len(y)), np.zeros(len(y))
        de[mid], ds[mid] = z[mid] / s, z[mid] ** 2 - 1
        for part, bound, sign in ((left, lower, 1.0), (right, upper, -1.0)):
            if part.any():
                u = sign * (bound - eta[part]) / s
                ratio = np.exp(-u * u / 2 - 0.5 * math.log(2 * math.pi) - _log_cdf(u))
                de[part], ds[part] = -sign * ratio / s, -ratio * u
        return np.append(x.T @ de, ds.sum())

    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    t = np.append(beta, math.log(max(np.std(y - x @ beta), 1e-3)))
    now = loglik(t)
    for _ in range(maxit):
        g = score(t)
        h = np.stack([(score(t + d) - score(t - d)) / 2e-5 for d in np.eye(len(t)) * 1e-5])
        h = (h + h.T) / 2
        vals, vecs = np.linalg.eigh(-h)
        step = vecs @ ((vecs.T @ g) / np.maximum(np.abs(vals), 1e-6))
        size = 1.0
        while size > 1e-8 and not loglik(t + size * step) >= now:
            size /= 2
        t, old, now = t + size * step, now, loglik(t + size * step)
        if abs(now - old) < 1e-11 * (1 + abs(now)):
            break
    return Fit(t[:-1], now, "log10", float(t[-1]))


def fit_with_fallback(y: np.ndarray, x: np.ndarray, family: str, alpha: float = 0.0) -> Fit | None:
    for attempt in (lambda: fit_glm(y, x, family, alpha), lambda: fit_joint_nb(y, x) if family == "nb" else None):
        try:
            return attempt()
        except (FloatingPointError, np.linalg.LinAlgError, OverflowError, ValueError):
            continue
    return None


def lrt(full: Fit, reduced: Fit) -> tuple[float, int, float]:
    stat, df = max(0.0, 2 * (full.llf - reduced.llf)), len(full.params) - len(reduced.params)
    return stat, df, chi2_sf(stat, df) if df > 0 else math.nan
