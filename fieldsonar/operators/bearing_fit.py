"""Robust position fits from bearings, many at once: bounded least squares in two unknowns, on arrays of problems.

The method is the reflective trust region of Branch, Coleman and Li (1999) with Huber's loss. All problems of a call
take their steps together; those that have ended drop out. The singular values that each step needs come from one call
for all, so nothing is solved problem by problem in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = float(np.finfo(float).eps)
TOLERANCE = 1e-8
RADIUS_TOLERANCE, RADIUS_ROUNDS = 0.01, 10
#: Evaluations of one problem, after which it has not converged.
MOST_CALLS = 200


@dataclass
class Bearings:
    """Problems as rows: places of sites, weights (0 for no site), bearings in degrees and what a degree counts."""

    sx: np.ndarray
    sy: np.ndarray
    weight: np.ndarray
    bearing: np.ndarray
    sigma: float

    def some(self, which: np.ndarray) -> Bearings:
        return Bearings(self.sx[which], self.sy[which], self.weight[which], self.bearing[which], self.sigma)

    def off(self, p: np.ndarray) -> np.ndarray:
        """Degrees, in [-180, 180), from the bearing of each point to that which was measured."""
        there = (np.degrees(np.arctan2(p[:, :1] - self.sx, p[:, 1:] - self.sy)) + 360.0) % 360.0
        return (self.bearing - there + 180.0) % 360.0 - 180.0

    def residuals(self, p: np.ndarray) -> np.ndarray:
        return np.sqrt(self.weight) * self.off(p) / self.sigma

    def slopes(self, p: np.ndarray, f: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Derivatives of the residuals f by both unknowns (problem, site, unknown), by differences inside the box.

        The closed form is no better here: beside a site, where a bearing has no slope, recorded results stop where
        differences of this length tell them to.
        """
        out = np.empty((*f.shape, 2))
        for i in (0, 1):
            step = EPS**0.5 * np.where(p[:, i] >= 0, 1.0, -1.0) * np.maximum(1.0, np.abs(p[:, i]))
            to = p[:, i] + step
            to = np.where((to >= lo[:, i]) & (to <= hi[:, i]), to, p[:, i] - step)
            moved = p.copy()
            moved[:, i] = to
            out[:, :, i] = (self.residuals(moved) - f) / (to - p[:, i])[:, None]
        return out


def huber(f: np.ndarray) -> np.ndarray:
    """Half the loss of each row of residuals."""
    z = f * f
    return 0.5 * np.where(z <= 1, z, 2 * np.abs(f) - 1).sum(axis=-1)


def _weighed(f: np.ndarray, jac: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals and slopes of the least squares that Huber's loss is near the point."""
    far = np.abs(f) > 1
    size = np.where(far, np.abs(f), 1.0)
    scale = np.sqrt(np.where(far, EPS, 1.0))
    return f / (size * scale), jac * scale[..., None]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1)


def _to_edge(x: np.ndarray, way: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many times a way fits into the box, and which unknowns stop it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        times = np.where(way > 0, (hi - x) / way, np.where(way < 0, (lo - x) / way, np.inf))
    least = times.min(axis=1)
    return least, times == least[:, None]


class _Model:
    """Quadratic models g p + |M p|^2 / 2 of problems, with M's singular values; f has the residuals, M's rows beyond them have none."""

    def __init__(self, m: np.ndarray, g: np.ndarray, f: np.ndarray) -> None:
        self.m, self.g = m, g
        u, self.s, vt = np.linalg.svd(m, full_matrices=False)
        self.v, n = np.swapaxes(vt, 1, 2), f.shape[1]
        self.uf = np.einsum("nij,ni->nj", u[:, :n], f)
        self.along = self.s * self.uf
        self.eig = self.s * self.s
        self.full = self.s[:, 1] > EPS * n * self.s[:, 0]

    def _turned(self, p: np.ndarray) -> np.ndarray:
        return np.einsum("nsi,ni->ns", self.m, p)

    def value(self, p: np.ndarray) -> np.ndarray:
        q = self._turned(p)
        return 0.5 * _dot(q, q) + _dot(self.g, p)

    def step(self, radius: np.ndarray, damping: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least point within the radius, by Newton's method on its damping."""
        back = lambda q: np.einsum("nij,nj->ni", self.v, q)
        with np.errstate(divide="ignore", invalid="ignore"):
            free = np.where(self.full[:, None], -self.uf / self.s, np.nan)
        inner = self.full & (np.sqrt(_dot(free, free)) <= radius)
        size = np.sqrt(_dot(self.along, self.along))
        high = size / radius

        def excess(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            d = self.eig + t[:, None]
            n = np.sqrt(((self.along / d) ** 2).sum(axis=1))
            return n - radius, -(self.along**2 / d**3).sum(axis=1) / n

        with np.errstate(divide="ignore", invalid="ignore"):
            e, slope = excess(np.zeros(len(radius)))
            low = np.where(self.full, -e / slope, 0.0)
        start = lambda: np.maximum(0.001 * high, np.sqrt(np.maximum(low * high, 0.0)))
        t = np.where(~self.full & (damping == 0), start(), damping)
        going = ~inner
        for _ in range(RADIUS_ROUNDS):
            t = np.where(going & ((t < low) | (t > high)), start(), t)
            with np.errstate(divide="ignore", invalid="ignore"):
                e, slope = excess(t)
                ratio = e / slope
            high = np.where(going & (e < 0), t, high)
            low = np.where(going, np.maximum(low, t - ratio), low)
            t = np.where(going, t - (e + radius) * ratio / radius, t)
            going &= np.abs(e) >= RADIUS_TOLERANCE * radius
            if not going.any():
                break
        with np.errstate(divide="ignore", invalid="ignore"):
            edge = -self.along / (self.eig + t[:, None])
            edge *= (radius / np.sqrt(_dot(edge, edge)))[:, None]
        return back(np.where(inner[:, None], free, edge)), np.where(inner, 0.0, t)

    def best_on(self, way: np.ndarray, low: np.ndarray, high: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The point of base + t way, t between low and high, where the model is least, and its value."""
        along = self._turned(way)
        curve, slope = 0.5 * _dot(along, along), _dot(self.g, way) + _dot(self._turned(base), along)
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = -0.5 * slope / curve
        ends = np.stack([low, high, np.where((turn > low) & (turn < high), turn, low)], axis=1)
        values = ends * (curve[:, None] * ends + slope[:, None])
        t = np.take_along_axis(ends, values.argmin(axis=1)[:, None], axis=1)
        point = base + t * way
        return point, self.value(point)


def _within(model: _Model, x: np.ndarray, d: np.ndarray, p: np.ndarray, radius: np.ndarray, lo: np.ndarray, hi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scaled step, kept in the box, and by how much the model falls: cut, reflected, or steepest descent, the best."""
    outside = ((x + d * p < lo) | (x + d * p > hi)).any(axis=1)
    step, value = p.copy(), model.value(p)
    if not outside.any():
        return step, -value
    stride, hit = _to_edge(x, d * p, lo, hi)
    cut = p * np.where(np.isfinite(stride), stride, 1.0)[:, None]
    mirrored = np.where(hit, -p, p)
    # how far the mirrored way goes from the edge, within the radius and the box
    a, b, c = _dot(mirrored, mirrored), _dot(cut, mirrored), _dot(cut, cut) - radius**2
    with np.errstate(divide="ignore", invalid="ignore"):
        root = (-b + np.sqrt(np.maximum(b * b - a * c, 0.0))) / a
        edge, _ = _to_edge(x + d * cut, d * mirrored, lo, hi)
        reach = np.minimum(edge, root)
        low, high = (1 - theta) * stride / reach, np.where(reach == edge, theta * edge, root)
    usable = (reach > 0) & (low <= high)
    other, found = model.best_on(mirrored, np.where(usable, low, 0.0), np.where(usable, high, 0.0), cut)
    short = cut * theta[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        to_radius = radius / np.sqrt(_dot(model.g, model.g))
        edge, _ = _to_edge(x, -d * model.g, lo, hi)
    down, fall = model.best_on(-model.g, np.zeros(len(x)), np.where(edge < to_radius, theta * edge, to_radius), np.zeros_like(x))
    options = np.stack([short, other, down], axis=1)
    values = np.stack([model.value(short), np.where(usable, found, np.inf), fall], axis=1)
    best = values.argmin(axis=1)
    rows = np.arange(len(x))
    step[outside], value[outside] = options[rows, best][outside], values[rows, best][outside]
    return step, -value


def fit(problem: Bearings, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each problem: its point of least Huber loss within its box, the loss there, and whether the search converged."""
    n = len(start)
    inner = np.nextafter(lo, hi), np.nextafter(hi, lo)
    x = np.clip(start, *inner)
    f = problem.residuals(x)
    cost, calls, done = huber(f), np.ones(n, int), np.zeros(n, bool)
    radius, damping = np.ones(n), np.zeros(n)
    state: dict[str, np.ndarray] = {"m": np.zeros((n, problem.sx.shape[1] + 2, 2)), "f": np.zeros_like(f), "g": np.zeros((n, 2)), "d": np.ones((n, 2)), "theta": np.ones(n)}
    fresh, first = np.arange(n), True
    going = np.ones(n, bool)
    while True:
        if len(fresh):  # points just reached: slopes, the scaling by the distance to the edge, and the model
            r, jac = _weighed(f[fresh], problem.some(fresh).slopes(x[fresh], f[fresh], lo[fresh], hi[fresh]))
            g = np.einsum("nsi,ns->ni", jac, r)
            v = np.where(g < 0, hi[fresh] - x[fresh], np.where(g > 0, x[fresh] - lo[fresh], 1.0))
            if first:
                size = np.sqrt(_dot(x / np.sqrt(v), x / np.sqrt(v)))
                radius, first = np.where(size > 0, size, 1.0), False
            slope = np.abs(g * v).max(axis=1)
            d = np.sqrt(v)
            m = np.concatenate([jac * d[:, None, :], np.sqrt(np.abs(g))[:, :, None] * np.eye(2)], axis=1)
            for k, value in (("m", m), ("f", r), ("g", d * g), ("d", d), ("theta", np.maximum(0.995, 1 - slope))):
                state[k][fresh] = value
            done[fresh] = slope < TOLERANCE
            going[fresh] &= ~done[fresh] & (calls[fresh] < MOST_CALLS)
        now = np.flatnonzero(going)
        if not len(now):
            return x, cost, done
        model = _Model(state["m"][now], state["g"][now], state["f"][now])
        p, damping[now] = model.step(radius[now], damping[now])
        step, expected = _within(model, x[now], state["d"][now], p, radius[now], lo[now], hi[now], state["theta"][now])
        move = state["d"][now] * step
        to = np.clip(x[now] + move, inner[0][now], inner[1][now])
        there = problem.some(now).residuals(to)
        calls[now] += 1
        cost_there = huber(there)
        gain = cost[now] - cost_there
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(expected > 0, gain / expected, np.where((expected == 0) & (gain == 0), 1.0, 0.0))
        length = np.sqrt(_dot(step, step))
        new = np.where(ratio < 0.25, 0.25 * length, np.where((ratio > 0.75) & (length > 0.95 * radius[now]), 2 * radius[now], radius[now]))
        ended = ((gain < TOLERANCE * cost[now]) & (ratio > 0.25)) | (np.sqrt(_dot(move, move)) < TOLERANCE * (TOLERANCE + np.sqrt(_dot(x[now], x[now]))))
        damping[now] = np.where(ended, damping[now], damping[now] * radius[now] / new)
        radius[now] = np.where(ended, radius[now], new)
        better = gain > 0
        at = now[better]
        x[at], f[at], cost[at] = to[better], there[better], cost_there[better]
        done[now[ended]] = True
        going[now[ended | (calls[now] >= MOST_CALLS) & ~better]] = False
        fresh = now[better & ~ended]
