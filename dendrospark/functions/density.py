"""Gaussian kernel density by binning and FFT, and its mode; LOWESS."""

from __future__ import annotations

import numpy as np


def bw_nrd0(x: np.ndarray) -> float:
    if len(x) < 2:
        raise ValueError("a bandwidth needs two values or more")
    hi = np.std(x, ddof=1)
    q75, q25 = np.percentile(x, [75, 25])
    return 0.9 * (min(hi, (q75 - q25) / 1.34) or hi or abs(x[0]) or 1.0) * len(x) ** -0.2


def density(x: np.ndarray, n: int = 512, cut: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    bw = bw_nrd0(x)
    lo, hi = x.min() - cut * bw, x.max() + cut * bw
    wide_lo, wide_hi = lo - 4 * bw, hi + 4 * bw
    step = (wide_hi - wide_lo) / (n - 1)
    at = (x - wide_lo) / step
    i = np.clip(np.floor(at).astype(int), 0, n - 2)
    part = at - i
    mass = np.bincount(i, 1 - part, 2 * n) + np.bincount(i + 1, part, 2 * n)
    # the kernel's 2n ordinates are spread over twice the range, its first and last included, as R's density has them
    d = np.linspace(0, 2 * (wide_hi - wide_lo), 2 * n)
    d[n + 1 :] = d[n - 1 : 0 : -1]
    kernel = np.exp(-0.5 * (d / bw) ** 2) / (bw * np.sqrt(2 * np.pi))
    y = np.fft.irfft(np.fft.rfft(mass / len(x)) * np.fft.rfft(kernel), 2 * n)[:n]
    grid = np.linspace(lo, hi, n)
    return grid, np.interp(grid, np.linspace(wide_lo, wide_hi, n), np.maximum(y, 0))


def dmode(x: np.ndarray) -> float:
    if len(x) < 2:
        return 0.0
    grid, y = density(x)
    return float(grid[y == y.max()].mean())


#: Points from which lowess sums by a tree of intervals; nodes of an interval.
MANY, NODES = 2000, 12


def lowess(x: np.ndarray, y: np.ndarray, frac: float = 2 / 3, iterations: int = 3) -> np.ndarray:
    """Locally linear fits with tricube weights and bisquare robustness, at every x (sorted)."""
    n = len(x)
    k = max(2, min(n, int(np.ceil(frac * n))))
    robust, fit = np.ones(n), np.zeros(n)
    many = _Local(x, k) if n > MANY else None
    for it in range(iterations + 1):
        if many is not None:
            fit = many.fit(robust, robust * y)
        for i in range(n if many is None else 0):
            d = np.abs(x - x[i])
            h = np.partition(d, k - 1)[k - 1] or 1e-12
            w = np.clip(1 - (d / h) ** 3, 0, None) ** 3 * robust
            sw = w.sum() or 1e-12
            mx, my = (w * x).sum() / sw, (w * y).sum() / sw
            vx = (w * (x - mx) ** 2).sum()
            fit[i] = my + (x[i] - mx) * ((w * (x - mx) * (y - my)).sum() / vx if vx > 1e-12 else 0)
        if it == iterations:
            break
        r = np.abs(y - fit)
        s = 6 * np.median(r) or 1e-12
        robust = np.clip(1 - (r / s) ** 2, 0, None) ** 2
    return fit


class _Local:
    """Local fits at all x in n log n steps, the sums being the same: on either side of a point the weight is a polynomial of degree 9, and with the squared distance
    of degree 11, so twelve nodes with weights of their own stand for any interval of points there without loss. Equal x share a fit.
    """

    def __init__(self, x: np.ndarray, k: int):
        own, self.which = np.unique(x, return_inverse=True)
        self.x, n = own, len(own)
        # the k nearest of a point are a run of the sorted points: the first run whose far end is at least as far as its near end, or the run before
        lo, hi = np.zeros(n, int), np.full(n, len(x) - k)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            right = x[mid + k - 1] - own >= own - x[mid]
            lo, hi = np.where(right | (lo >= hi), lo, mid + 1), np.where(right & (lo < hi), mid, hi)
        reach = lambda at: np.maximum(own - x[at], x[at + k - 1] - own)
        self.h = np.minimum(reach(lo), reach(np.maximum(lo - 1, 0)))
        self.h[self.h == 0] = 1e-12
        self.lo, self.hi = np.searchsorted(own, own - self.h, "left"), np.searchsorted(own, own + self.h, "right")
        self.size = 1 << max(4, (n - 1).bit_length())
        grid = np.concatenate([own, np.full(self.size - n, own[-1])])
        self.nodes, self.moves = [grid[:, None]], []
        xi = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
        poly = np.cos(np.arange(NODES)[:, None] * np.arccos(xi)) * np.append(1, np.full(NODES - 1, 2))[:, None] / NODES
        width = 1
        while width < self.size:
            width *= 2
            if width < 16:
                self.nodes.append(grid.reshape(-1, width))
                self.moves.append(None)
                continue
            ends = grid.reshape(-1, width)
            mid, half = (ends[:, 0] + ends[:, -1]) / 2, (ends[:, -1] - ends[:, 0]) / 2
            half[half == 0] = 1.0
            at = self.nodes[-1].reshape(len(mid), -1)
            inside = np.arccos(np.clip((at - mid[:, None]) / half[:, None], -1, 1))
            self.moves.append(np.cos(inside[:, :, None] * np.arange(NODES)) @ poly)
            self.nodes.append(mid[:, None] + half[:, None] * xi)

    def fit(self, robust: np.ndarray, pull: np.ndarray) -> np.ndarray:
        """The fit at every point by its robust weights and their products with y."""
        n = len(self.x)
        weights = []
        for v in (robust, pull):
            level = [np.append(np.bincount(self.which, v, n), np.zeros(self.size - n))[:, None]]
            for k, move in enumerate(self.moves):
                below = level[-1].reshape(len(self.nodes[k + 1]), -1)
                level.append(below if move is None else np.einsum("bs,bsq->bq", below, move))
            weights.append(level)
        total = np.zeros((5, n))
        for first, last in ((self.lo, np.arange(n)), (np.arange(n), self.hi)):
            lo, hi = first.copy(), last.copy()
            for k in range(len(self.nodes)):
                for at, block in ((np.flatnonzero((lo < hi) & (lo % 2 == 1)), lo), (np.flatnonzero((lo < hi) & (hi % 2 == 1)), hi - 1)):
                    for some in np.array_split(at, max(1, len(at) // 16_384)):
                        b = block[some]
                        t = (self.nodes[k][b] - self.x[some, None]) / self.h[some, None]
                        w = (1 - np.abs(t) ** 3) ** 3
                        one, two = weights[0][k][b] * w, weights[1][k][b] * w
                        total[:, some] += one.sum(axis=1), (one * t).sum(axis=1), (one * t * t).sum(axis=1), two.sum(axis=1), (two * t).sum(axis=1)
                # what is left is whole parents
                lo, hi = (lo + 1) // 2, hi // 2
        s0, s1, s2, t0, t1 = total
        s0 = np.where(s0 == 0, 1e-12, s0)
        spread = s2 - s1 * s1 / s0
        slope = np.where(spread * self.h**2 > 1e-12, (t1 - s1 * t0 / s0) / np.where(spread == 0, 1, spread), 0)
        return (t0 / s0 - s1 / s0 * slope)[self.which]
