"""Dense optical flow between two maps by polynomial expansion on a pyramid, warping along a flow, and the two temporal scores that need them.

Around every pixel a map is fitted by a quadratic f(x) = x'Ax + b'x + c, weighted by a Gaussian. If the second map is the first one moved by d, then
b2 = b1 - 2Ad, so the shift follows from the change of b; it is solved over a window around each pixel, from the coarsest level of the pyramid down.

Functions in the plural take many maps of one size at once (maps first), so that small maps cost no calls of their own.
"""

from __future__ import annotations

import math

import numpy as np

from cellmill.functions.images import structures

LEVELS, WINDOW, ROUNDS, REACH, SIGMA = 3, 15, 3, 5, 1.2
SMALLEST = 16


def _along(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with an odd kernel along an axis; the edge goes on beyond the border."""
    reach = len(kernel) // 2
    pad = [(reach, reach) if a == axis else (0, 0) for a in range(image.ndim)]
    padded = np.pad(image, pad, mode="edge")
    return sum(k * np.take(padded, range(i, i + image.shape[axis]), axis=axis) for i, k in enumerate(kernel))


def expansion(image: np.ndarray, reach: int = REACH, sigma: float = SIGMA) -> tuple[np.ndarray, np.ndarray]:
    """A (..., H, W, 2, 2) and b (..., H, W, 2), x before y, of the quadratic around each pixel of maps (..., H, W)."""
    at = np.arange(-reach, reach + 1, dtype=float)
    weight = np.exp(-at * at / (2 * sigma * sigma))
    powers = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]
    moment = lambda p: float((weight * at**p).sum())
    gram = np.array([[moment(p + r) * moment(q + s) for r, s in powers] for p, q in powers])
    y, x = image.ndim - 2, image.ndim - 1
    seen = np.stack([_along(_along(image, weight * at**p, x), weight * at**q, y) for p, q in powers], axis=-1)
    c = seen @ np.linalg.inv(gram)
    a = np.stack([c[..., 3], c[..., 5] / 2, c[..., 5] / 2, c[..., 4]], axis=-1).reshape(*image.shape, 2, 2)
    return a, c[..., 1:3]


def samples(fields: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values of fields (N, H, W, ...) at positions (N, h, w) of each; those outside count as on the border."""
    n, h, w = fields.shape[:3]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    more = (...,) + (None,) * (fields.ndim - 3)
    fx, fy = (x - x0)[more], (y - y0)[more]
    at = np.arange(n).reshape(-1, *[1] * (x.ndim - 1))
    return (fields[at, y0, x0] * (1 - fx) + fields[at, y0, x1] * fx) * (1 - fy) + (fields[at, y1, x0] * (1 - fx) + fields[at, y1, x1] * fx) * fy


def _grid(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[:h, :w].astype(float)
    return x, y


def _level(first: np.ndarray, second: np.ndarray, flow: np.ndarray, window: int, rounds: int) -> np.ndarray:
    (a1, b1), (a2, b2) = expansion(first), expansion(second)
    x, y = _grid(*first.shape[1:])
    box = np.ones(window) / window
    gap = np.minimum(np.minimum(x, x.max() - x), np.minimum(y, y.max() - y))
    edge = np.minimum(1.0, (gap + 1) / (REACH + 1)) ** 4  # near the border the fit leans on what was made up beyond it
    edges = np.broadcast_to(edge, first.shape)
    for _ in range(rounds):
        u, v = x + flow[..., 0], y + flow[..., 1]
        a = (a1 + samples(a2, u, v)) / 2
        change = (b1 - samples(b2, u, v)) / 2 + np.einsum("nhwij,nhwj->nhwi", a, flow)
        trust = (edge * samples(edges, u, v) * ((u >= 0) & (v >= 0) & (u <= x.max()) & (v <= y.max())) + 1e-6)[..., None]
        left, right = trust[..., None] * np.einsum("nhwji,nhwjk->nhwik", a, a), trust * np.einsum("nhwji,nhwj->nhwi", a, change)
        left, right = (_along(_along(m, box, 1), box, 2) for m in (left, right))
        ridge = 1e-9 * np.trace(left, axis1=3, axis2=4)[..., None, None] + 1e-300
        flow = np.linalg.solve(left + ridge * np.eye(2), right[..., None])[..., 0]
    return flow


def dense_flows(first: np.ndarray, second: np.ndarray, levels: int = LEVELS, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """(N, H, W, 2) with first[n](x) = second[n](x + flow[n]), x before y. Pairs of maps that are not finite everywhere have no flow (nan)."""
    out = np.full((*first.shape, 2), np.nan)
    finite = np.isfinite(first).all(axis=(1, 2)) & np.isfinite(second).all(axis=(1, 2))
    if not finite.any():
        return out
    pyramid = [(first[finite].astype(float), second[finite].astype(float))]
    smooth = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    smooth /= smooth.sum()
    while len(pyramid) < levels and min(pyramid[-1][0].shape[1:]) >= 2 * SMALLEST:
        pyramid.append(tuple(_along(_along(m, smooth, 1), smooth, 2)[:, ::2, ::2] for m in pyramid[-1]))
    flow = np.zeros((*pyramid[-1][0].shape, 2))
    for a, b in reversed(pyramid):
        if flow.shape[:3] != a.shape:
            x, y = (np.broadcast_to(g, a.shape) for g in _grid(*a.shape[1:]))
            flow = 2 * samples(flow, x / 2, y / 2)
        flow = _level(a, b, flow, min(window, 2 * (min(a.shape[1:]) // 2) - 1), rounds)
    out[finite] = flow
    return out


def dense_flow(first: np.ndarray, second: np.ndarray, levels: int = LEVELS, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """dense_flows of one pair."""
    return dense_flows(first[None], second[None], levels, window, rounds)[0]


def warped(depths: np.ndarray, flows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps (N, H, W) sampled at x + flow, and where that lies inside them."""
    x, y = _grid(*depths.shape[1:])
    u, v = x + flows[..., 0], y + flows[..., 1]
    inside = (u >= 0) & (v >= 0) & (u <= depths.shape[2] - 1) & (v <= depths.shape[1] - 1)
    return samples(depths, np.where(inside, u, 0), np.where(inside, v, 0)), inside


def pair_errors(before: np.ndarray, after: np.ndarray, flows: np.ndarray) -> np.ndarray:
    """Mean relative difference between each map and its forerunner, warped along a backward flow; nan where no pixel counts."""
    moved, inside = warped(before, flows)
    ok = inside & np.isfinite(moved) & (moved > 0) & np.isfinite(after) & (after > 0)
    gap = np.abs(np.where(ok, moved, 1) - np.where(ok, after, 1)) / np.where(ok, after, 1)
    counted = ok.sum(axis=(1, 2))
    return np.where(counted > 0, gap.sum(axis=(1, 2)) / np.maximum(counted, 1), np.nan)


def warping_error(depths: np.ndarray, flows: np.ndarray) -> float:
    """Mean of pair_errors over the neighbours of a clip (flows[t] leads from t + 1 to t)."""
    n = min(len(depths) - 1, len(flows))
    errors = pair_errors(depths[:n], depths[1 : n + 1], flows[:n]) if n > 0 else np.zeros(0)
    errors = errors[np.isfinite(errors)]
    return float(np.mean(errors)) if len(errors) else math.nan


def _scaled(depths: np.ndarray) -> np.ndarray:
    """Each map in whole steps from 0 to 255; one that is not finite stays so and has no flow."""
    low, high = (f(axis=(1, 2), keepdims=True) for f in (depths.min, depths.max))
    span = high - low
    with np.errstate(invalid="ignore", divide="ignore"):
        steps = np.floor((depths - low) / span * 255)
        return np.where(np.isfinite(span), np.where(span < 1e-8, 0.0, steps), np.nan)


def motion_similarities(pred: tuple[np.ndarray, np.ndarray], truth: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Structural similarity of the sizes of the flows from first to second maps, predicted against true; nan where none can be made."""
    size = lambda maps: np.linalg.norm(dense_flows(*map(_scaled, maps)), axis=-1)
    return structures(size(pred), size(truth))


def motion_consistency(pred: np.ndarray, truth: np.ndarray) -> float:
    """Mean of motion_similarities over the neighbours of a clip."""
    scores = motion_similarities((pred[:-1], pred[1:]), (truth[:-1], truth[1:])) if len(pred) > 1 else np.zeros(0)
    scores = scores[np.isfinite(scores)]
    return float(np.mean(scores)) if len(scores) else math.nan
