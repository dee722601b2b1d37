"""The best and the second best choice of bearings of an event of many sites, without a fit of every choice.

Where a fit may end is known: within MAX_DISTANCE_M of all sites. That region is cut into cells. In a cell the bearing to
a site lies between two angles, so each of a site's two bearings has a least loss there, and a choice of bearings costs at
least the sum of its sites' least losses in the best cell for it. A partial choice is bounded likewise, with the lesser loss for every site
still open. Partial choices are taken up in the order of their bounds; whole ones are fitted, and the search ends when
no bound is below the second best fit. Bounds only decide what need not be fitted, so the result is that of fitting all.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable

import numpy as np

from .. import settings as S

#: Cells on a side at first; cells that may matter are quartered until they are this small or there are so many.
SIDE, LEAST_CELL_M, MOST_CELLS = 24, 2.0, 6_000
#: Choices that are fitted at once.
TOGETHER = 64
#: Rounding that a bound may have.
SLACK = 1e-9

Fits = tuple[np.ndarray, np.ndarray, np.ndarray]


def _least_losses(cells: np.ndarray, half: float, sx: np.ndarray, sy: np.ndarray, bearings: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Lower bounds (cell, site, bearing) of the loss in square cells about given middles; infinite where too far from a site."""
    dx, dy = cells[:, :1] - sx, cells[:, 1:] - sy
    away, radius = np.hypot(dx, dy), half * np.sqrt(2.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = np.where(away > radius, np.degrees(np.arcsin(np.minimum(radius / away, 1.0))), 180.0)
    off = np.abs((bearings[None] - np.degrees(np.arctan2(dx, dy))[:, :, None] + 180.0) % 360.0 - 180.0)
    f = np.sqrt(weight)[None, :, None] * np.maximum(off - spread[:, :, None], 0.0) / S.ORIENTATION_SIGMA_DEG
    loss = 0.5 * np.where(f <= 1, f * f, 2 * f - 1)
    loss[(away > S.MAX_DISTANCE_M + radius).any(axis=1)] = np.inf
    return loss


def _cells(sx: np.ndarray, sy: np.ndarray, losses: Callable[[np.ndarray, float], np.ndarray], most: float) -> np.ndarray:
    """Least losses in cells that together hold every point within reach where some choice may cost at most `most`."""
    low = np.array([sx.max(), sy.max()]) - S.MAX_DISTANCE_M
    high = np.array([sx.min(), sy.min()]) + S.MAX_DISTANCE_M
    if (low > high).any():
        return np.zeros((0, len(sx), 2))
    half = float((high - low).max()) / (2 * SIDE)
    if half == 0:
        half = LEAST_CELL_M / 2
    steps = [np.arange(a + half, b + half, 2 * half) if b > a else np.array([a]) for a, b in zip(low, high)]
    cells = np.stack(np.meshgrid(*steps, indexing="ij"), axis=-1).reshape(-1, 2)
    while True:
        loss = losses(cells, half)
        best = loss.min(axis=2).sum(axis=1)
        near = np.isfinite(best) & (best <= most)
        cells, loss = cells[near], loss[near]
        if 2 * half <= LEAST_CELL_M or 4 * len(cells) > MOST_CELLS:
            return loss
        half /= 2
        cells = (cells[:, None] + half * np.array(list(itertools.product((-1, 1), repeat=2)))).reshape(-1, 2)


def best_two(sx: np.ndarray, sy: np.ndarray, one: np.ndarray, two: np.ndarray, weight: np.ndarray, fitted: Callable[[np.ndarray], Fits]) -> tuple[np.ndarray, np.ndarray, float, float] | None:
    """The choice (a bit a site) of least cost, the first of equal ones, its point, its cost and the next cost; None if no fit holds.

    fitted(choices) gives for each choice its point, its cost and whether the fit holds (converged, and near all sites).
    """
    n = len(sx)
    bearings = np.stack([one, two], axis=1)
    losses = lambda cells, half: _least_losses(cells, half, sx, sy, bearings, weight)
    tried: dict[bytes, tuple[float, np.ndarray]] = {}

    def fit_all(choices: np.ndarray) -> None:
        new = {c.tobytes(): c for c in choices.astype(np.int8)}
        new = [c for k, c in new.items() if k not in tried]
        if new:
            at, cost, ok = fitted(np.stack(new))
            tried.update((c.tobytes(), (x if good else np.inf, p)) for c, p, x, good in zip(new, at, cost.tolist(), ok))

    def limit() -> float:
        """The second best cost so far: what costs more than that can be left."""
        costs = heapq.nsmallest(2, (cost for cost, _ in tried.values()))
        return costs[1] if len(costs) > 1 else np.inf

    # first fits: the best choices in the best cells, and those with one bearing changed
    rough = _cells(sx, sy, losses, np.inf)
    if not len(rough):
        return None
    first = np.unique(rough[np.argsort(rough.min(axis=2).sum(axis=1), kind="stable")[:16]].argmin(axis=2), axis=0)
    fit_all(first)
    if np.isfinite(limit()) or any(np.isfinite(cost) for cost, _ in tried.values()):
        seed = np.frombuffer(min(tried, key=lambda k: tried[k][0]), np.int8)
        fit_all(seed ^ np.eye(n, dtype=np.int8))
    loss = _cells(sx, sy, losses, limit() + SLACK)

    # sites whose bearings differ most come first
    order = np.argsort(-np.abs(loss[:, :, 0] - loss[:, :, 1]).mean(axis=0), kind="stable") if len(loss) else np.arange(n)
    count = itertools.count()
    base = loss.min(axis=2).sum(axis=1)
    heap = [(float(base.min()), next(count), np.zeros(n, np.int8), 0, np.arange(len(loss)), base)] if len(loss) else []
    whole: list[np.ndarray] = []
    while heap:
        bound, _, bits, depth, cells, value = heapq.heappop(heap)
        most = limit() + SLACK
        if bound > most:
            break
        if depth == n:
            whole.append(bits)
            if len(whole) == TOGETHER or not heap:
                fit_all(np.stack(whole))
                whole = []
            continue
        site = order[depth]
        least = loss[cells, site].min(axis=1)
        for bit in (0, 1):
            own = value - least + loss[cells, site, bit]
            keep = own <= most
            if keep.any():
                changed = bits.copy()
                changed[site] = bit
                heapq.heappush(heap, (float(own[keep].min()), next(count), changed, depth + 1, cells[keep], own[keep]))
    if whole:
        fit_all(np.stack(whole))
    held = sorted((cost, key) for key, (cost, _) in tried.items() if np.isfinite(cost))
    if not held:
        return None
    cost, key = held[0]
    return np.frombuffer(key, np.int8), tried[key][1], cost, held[1][0] if len(held) > 1 else np.inf
