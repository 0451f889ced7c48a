"""Small numeric helpers used on arrays inside tasks."""

from __future__ import annotations

import numpy as np


def log_gamma(x):
    """Log-gamma for x > 0, by recurrence to 8 and the asymptotic series."""
    x = np.asarray(x, dtype=float)
    y = x + 8.0
    product = np.ones_like(x)
    for i in range(8):
        product = product * (x + i)
    t = 1 / (y * y)
    series = (1 / 12 - t * (1 / 360 - t * (1 / 1260 - t * (1 / 1680 - t / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_beta(a, b):
    return log_gamma(a) + log_gamma(b) - log_gamma(np.add(a, b))


def log_sum_exp(x, axis):
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis=axis) + np.log(np.sum(np.exp(x - top), axis=axis))


def log_beta_mass(edges, a, b):
    """Log mass of Beta(a, b) in each cell of a grid; shape (cells, len(a)).

    Inner cells use the density at the midpoint. A cell that touches 0 or 1, where the
    density may be unbounded, integrates the power of that end exactly.
    """
    edges = np.asarray(edges, dtype=float)
    a, b = np.atleast_1d(a).astype(float), np.atleast_1d(b).astype(float)
    mid, width = (edges[1:] + edges[:-1]) / 2, np.diff(edges)
    left = np.outer(np.log(mid), a - 1) + np.log(width)[:, None]
    right = np.outer(np.log1p(-mid), b - 1)
    if edges[0] <= 0.0:
        left[0] = a * np.log(width[0]) - np.log(a)
    if edges[-1] >= 1.0:
        left[-1] = np.log(mid[-1]) * (a - 1)
        right[-1] = b * np.log(width[-1]) - np.log(b)
    return left + right - log_beta(a, b)[None, :]


def beta_share(a, b, x):
    """Regularised incomplete beta function (share of Beta(a, b) below x), by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    turned = x > (a + 1) / (a + b + 2)  # the fraction converges fast below the mean
    p, q, z = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    tiny = 1e-300
    keep_off = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    d = 1 / keep_off(1 - (p + q) * z / (p + 1))
    c, f = np.ones_like(d), d.copy()
    for m in range(1, 400):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / keep_off(1 + step * d)
            c = keep_off(1 + step / c)
            f = f * d * c
    with np.errstate(divide="ignore"):
        share = np.exp(p * np.log(z) + q * np.log1p(-z) - log_beta(p, q)) * f / p
    return np.clip(np.where(turned, 1 - share, share), 0.0, 1.0)


def f_quantile(p, d1, d2):
    """Quantile of the F distribution with d1 and d2 degrees of freedom, by bisection on its share."""
    d1, d2 = np.broadcast_arrays(np.asarray(d1, dtype=float), np.asarray(d2, dtype=float))
    low, high = np.zeros(d1.shape), np.ones(d1.shape)
    for _ in range(80):
        mid = (low + high) / 2
        below = beta_share(d1 / 2, d2 / 2, mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    x = (low + high) / 2
    return d2 * x / (d1 * (1 - x))


def grid_interval(edges, mass, share, steps=600):
    """Shortest interval holding ``share`` of a density that is flat inside each cell."""
    cdf = np.concatenate([[0.0], np.cumsum(mass)])
    cdf /= cdf[-1]
    start = np.linspace(0.0, 1.0 - share, steps)
    low, high = np.interp(start, cdf, edges), np.interp(start + share, cdf, edges)
    best = int(np.argmin(high - low))
    return float(low[best]), float(high[best])


def weighted_interval(points, weights, share):
    """Shortest interval of weighted points that holds at least ``share`` of the weight."""
    order = np.argsort(points)
    x, cdf = points[order], np.cumsum(weights[order])
    cdf /= cdf[-1]
    before = cdf - weights[order] / weights.sum()
    last = np.searchsorted(cdf, before + share - 1e-12)
    ok = last < len(x)
    width = x[last[ok]] - x[ok]
    best = int(np.argmin(width))
    return float(x[ok][best]), float(x[last[ok]][best])


# The published splitmix64 constants.
_STEP, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def uniforms(ids, stream):
    """Uniform numbers in (0, 1) that depend on the row id and a stream number only."""
    with np.errstate(over="ignore"):
        x = np.asarray(ids).astype(np.uint64) + np.uint64((stream + 1) * _STEP % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def gamma_draws(ids, shape, stream):
    """One gamma(shape, 1) number per row id: the squeeze method on numbered uniforms.

    A row's number does not depend on the rows it is computed with, so a repeated task
    gives the same draws.
    """
    shape = np.asarray(shape, dtype=float)
    lifted = np.where(shape < 1, shape + 1, shape)
    d = lifted - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, open_rows, attempt = np.zeros_like(d), np.arange(len(d)), 0
    while len(open_rows):
        base = stream + 3 * attempt + 1
        i = ids[open_rows]
        u1, u2, u3 = uniforms(i, base), uniforms(i, base + 1), uniforms(i, base + 2)
        x = np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)
        v = (1 + c[open_rows] * x) ** 3
        dd = d[open_rows]
        ok = (v > 0) & (np.log(u3) < 0.5 * x**2 + dd - dd * v + dd * np.log(np.where(v > 0, v, 1.0)))
        out[open_rows[ok]] = (dd * v)[ok]
        open_rows, attempt = open_rows[~ok], attempt + 1
    return np.where(shape < 1, out * uniforms(ids, stream) ** (1 / np.where(shape < 1, shape, 1.0)), out)


def beta_draws(ids, a, b):
    x, y = gamma_draws(ids, a, 0), gamma_draws(ids, b, 1_000_003)
    return x / (x + y)


def pick(log_weights, u):
    """Index by inverse cumulative weight, one per row of ``log_weights``."""
    w = np.exp(log_weights - log_weights.max(axis=1, keepdims=True))
    cdf = np.cumsum(w, axis=1)
    return np.minimum((cdf < (u * cdf[:, -1])[:, None]).sum(axis=1), log_weights.shape[1] - 1)
