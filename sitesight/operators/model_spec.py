"""What a hierarchical model says: priors, grids and links, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np


@dataclass(frozen=True)
class Axis:
    """Grid points of one parameter and the log prior mass of each.

    ``density`` names the prior and its parameters where the points are equal steps of the log, so
    that other points can be given their prior mass.
    """

    points: tuple[float, ...]
    log_prior: tuple[float, ...]
    density: tuple = ()

    def __len__(self) -> int:
        return len(self.points)


def _axis(points: np.ndarray, log_density: np.ndarray, density: tuple = ()) -> Axis:
    top = log_density.max()
    log_prior = log_density - top - np.log(np.exp(log_density - top).sum())
    return Axis(tuple(float(p) for p in points), tuple(float(v) for v in log_prior), density)


def _log_density(density: tuple, x: np.ndarray) -> np.ndarray:
    """Log prior of a cell of a log grid around x; the log of x is the cell's width."""
    kind, *values = density
    if kind == "half_normal":
        return -(x**2) / (2 * values[0] ** 2) + np.log(x)
    shape, rate = values
    return shape * np.log(x) - rate * x


def _log_points(low: float, high: float, n: int) -> np.ndarray:
    """Midpoints of n cells that are equal on the log scale."""
    return low * (high / low) ** ((np.arange(n) + 0.5) / n)


def fixed(value: float) -> Axis:
    return Axis((float(value),), (0.0,))


def _on_log_grid(density: tuple, low: float, high: float, n: int) -> Axis:
    x = _log_points(low, high, n)
    return _axis(x, _log_density(density, x), density)


def half_normal(sigma: float, low: float, high: float, n: int) -> Axis:
    return _on_log_grid(("half_normal", sigma), low, high, n)


def gamma(shape: float, rate: float, low: float, high: float, n: int) -> Axis:
    return _on_log_grid(("gamma", shape, rate), low, high, n)


def beta(a: float, b: float, n: int) -> Axis:
    x = (np.arange(n) + 0.5) / n
    return _axis(x, (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))


def narrowed(axis: Axis, weight: np.ndarray, n: int) -> Axis:
    """``n`` log points where ``weight``, the posterior on the axis, has its mass."""
    if len(axis) < 2:
        return axis
    used = np.flatnonzero(weight > weight.max() * 1e-6)
    x = np.log(axis.points)
    half = (x[1] - x[0]) / 2
    low, high = np.exp(x[max(used[0] - 1, 0)] - half), np.exp(x[min(used[-1] + 1, len(x) - 1)] + half)
    if axis.density:
        return _on_log_grid(axis.density, float(low), float(high), n)
    points = _log_points(float(low), float(high), n)
    return _axis(points, np.interp(np.log(points), x, axis.log_prior))


#: Factor by which an axis reaches farther on a side that holds mass.
WIDEN = 30.0


def widened(axis: Axis, below: bool, above: bool) -> Axis:
    """``axis`` with points of the same spacing added beyond its ends, and their prior mass."""
    if len(axis) < 2 or not axis.density:
        return axis
    x = np.log(axis.points)
    step = x[1] - x[0]
    more = max(1, int(np.ceil(np.log(WIDEN) / step)))
    low, high = x[0] - step / 2 - more * step * below, x[-1] + step / 2 + more * step * above
    return _on_log_grid(axis.density, float(np.exp(low)), float(np.exp(high)), len(axis) + more * (below + above))


def rescaled(axis: Axis, old: tuple[float, float], new: tuple[float, float], n: int) -> Axis:
    """``axis``, whose cells lie over ``old``, with ``n`` cells over ``new``; the prior is interpolated."""
    points = new[0] + (new[1] - new[0]) * (np.arange(n) + 0.5) / n
    return _axis(points, np.interp(points, axis.points, axis.log_prior))


@dataclass(frozen=True)
class Model:
    """A three-level model of success counts.

    ``region_mean`` is the prior of a region's mean, unless ``top`` is given: then regions
    follow Beta(g*c, (1-g)*c) with ``top = (axis of g, axis of c)``. Municipality means
    follow Beta(a*p, (1-a)*p) and sites Beta(m*s, (1-m)*s), or, with ``link='logit'``, the
    logit of the municipality's mean plus normal noise of *variance* s. ``offset`` is
    added to both Beta parameters above the site level. ``region_range`` is the part of
    0..1 over which the cells of ``region_mean`` lie.
    """

    site_precision: Axis
    municipality_precision: Axis
    region_mean: Axis = field(default_factory=lambda: beta(2, 2, 100))
    mean_cells: int = 100
    shared_municipality_precision: bool = True
    by_region: bool = True
    top: tuple[Axis, Axis] | None = None
    link: str = "beta"
    offset: float = 0.0
    noise_nodes: int = 41
    region_range: tuple[float, float] = (0.0, 1.0)

    def with_grid(self, **changes) -> "Model":
        return replace(self, **changes)


def fixed_precision(**grid) -> Model:
    """Known precisions: 100 between municipalities, 20 between sites."""
    return Model(fixed(20.0), fixed(100.0), **grid)


def three_level(n: int = 10, site_high: float = 200.0, municipality_high: float = 200.0, **grid) -> Model:
    """Both precisions unknown and shared by all groups, half-normal with scale 10."""
    return Model(
        half_normal(10.0, 0.5, site_high, n), half_normal(10.0, 0.5, municipality_high, n), **grid
    )


def own_precision(n: int = 10, **grid) -> Model:
    """A municipality precision of its own for every municipality."""
    return three_level(n, **grid).with_grid(shared_municipality_precision=False)


def two_level(n: int = 10, **grid) -> Model:
    """No region: all municipalities share one mean."""
    return three_level(n, **grid).with_grid(by_region=False)


def hyper_prior(n: int = 10, top_cells: int = 10, **grid) -> Model:
    """Regions follow a global mean with a half-normal(0.1) concentration.

    So small a concentration makes the prior of a region's mean U-shaped: it favours
    rates near 0 and 1.
    """
    return three_level(n, **grid).with_grid(
        top=(beta(2, 2, top_cells), half_normal(0.1, 0.005, 0.5, max(2, top_cells // 2)))
    )


def logit_normal(n: int = 8, **grid) -> Model:
    """Logit-normal sites; gamma(1, 0.1) precision and variance priors, offset 0.01."""
    return Model(
        gamma(1.0, 0.1, 0.002, 10.0, n), gamma(1.0, 0.1, 0.5, 100.0, n), link="logit", offset=0.01, **grid
    )


def logit_normal_revised(n: int = 8, top_cells: int = 8, **grid) -> Model:
    """Logit-normal sites with tighter priors and a global mean above the regions."""
    return Model(
        gamma(2.0, 2.0, 0.002, 6.0, n),
        gamma(2.0, 0.9, 0.2, 20.0, n),
        top=(beta(3, 3, top_cells), gamma(2.0, 0.5, 0.2, 30.0, max(2, top_cells // 2))),
        link="logit",
        offset=0.1,
        **grid,
    )
