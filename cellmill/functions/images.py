"""Kernels on whole frames (small arrays): geometry, structure and boundaries of depth maps. Used per clip in Arrow batches."""

from __future__ import annotations

import math

import numpy as np


def valid_pixels(pred: np.ndarray, truth: np.ndarray, low: float = 0.1, high: float = 10.0) -> np.ndarray:
    return np.isfinite(truth) & (truth > low) & (truth < high) & np.isfinite(pred) & (pred > 0)


def back_project(depth: np.ndarray, fx: float, fy: float, cx: float, cy: float) -> np.ndarray:
    """Points (H, W, 3) of a depth map."""
    v, u = np.mgrid[: depth.shape[0], : depth.shape[1]]
    return np.stack([(u - cx) * depth / fx, (v - cy) * depth / fy, depth], axis=-1)


def quaternion_matrices(q: np.ndarray) -> np.ndarray:
    x, y, z, w = (q / np.linalg.norm(q, axis=-1, keepdims=True)).T
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    return np.moveaxis(np.array(rows), -1, 0)


def reproject(depth: np.ndarray, source: np.ndarray, target: np.ndarray, fx: float, fy: float, cx: float, cy: float) -> tuple[np.ndarray, np.ndarray]:
    """Depth map moved from one camera to another (4 x 4 world-from-camera poses), and where it landed; the last write to a pixel wins."""
    points = back_project(depth, fx, fy, cx, cy).reshape(-1, 3)
    good = (points[:, 2] > 0) & np.isfinite(points[:, 2])
    move = np.linalg.inv(target) @ source
    moved = points[good] @ move[:3, :3].T + move[:3, 3]
    moved = moved[moved[:, 2] > 1e-6]
    u, v = np.rint(moved[:, 0] * fx / moved[:, 2] + cx).astype(int), np.rint(moved[:, 1] * fy / moved[:, 2] + cy).astype(int)
    inside = (u >= 0) & (v >= 0) & (u < depth.shape[1]) & (v < depth.shape[0])
    out, hit = np.zeros_like(depth, float), np.zeros(depth.shape, bool)
    out[v[inside], u[inside]], hit[v[inside], u[inside]] = moved[inside, 2], True
    return out, hit


def temporal_alignment_error(depths: np.ndarray, poses: np.ndarray, fx: float, fy: float, cx: float, cy: float, both_ways: bool = True) -> float:
    """Mean relative difference between a frame's depth and its neighbour's moved to it; nan if none overlaps."""
    errors = []
    for t in range(len(depths) - 1):
        for a, b in ((t, t + 1), (t + 1, t))[: 1 + both_ways]:
            moved, hit = reproject(depths[a], poses[a], poses[b], fx, fy, cx, cy)
            ok = hit & (moved > 0) & (depths[b] > 0) & np.isfinite(depths[b])
            if ok.any():
                errors.append(np.mean(np.abs(moved[ok] - depths[b][ok]) / depths[b][ok]))
    return float(np.mean(errors)) if errors else math.nan


def structures(a: np.ndarray, b: np.ndarray, window: int = 7) -> np.ndarray:
    """Mean structural similarity over sliding windows of maps (N, H, W), the range of each pair taken from both maps."""
    n = min(window, *a.shape[1:])
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x, (n, n), axis=(1, 2)).reshape(len(x), -1, n * n)
    x, y = view(a.astype(float)), view(b.astype(float))
    span = np.maximum(a.max(axis=(1, 2)), b.max(axis=(1, 2))) - np.minimum(a.min(axis=(1, 2)), b.min(axis=(1, 2)))
    span = np.where(span == 0, 1.0, span)[:, None]
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    mx, my, vx, vy = x.mean(2), y.mean(2), x.var(2), y.var(2)
    cov = ((x - mx[..., None]) * (y - my[..., None])).mean(2)
    return np.mean((2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2)), axis=1)


def structure(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """structures of one pair."""
    return float(structures(a[None], b[None], window)[0])


def temporal_gradients(pred: np.ndarray, truth: np.ndarray, static: float = 0.05) -> dict[str, float]:
    """Change between frames, predicted against true: absolute (where the truth is static), squared, and structural."""
    tgm, tgse, tcc = [], [], []
    for t in range(len(pred) - 1):
        ok = valid_pixels(pred[t], truth[t]) & valid_pixels(pred[t + 1], truth[t + 1])
        if not ok.any():
            continue
        dp, dt = pred[t + 1] - pred[t], truth[t + 1] - truth[t]
        still = ok & (np.abs(dt) < static)
        if still.any():
            tgm.append(np.mean(np.abs(np.abs(dp[still]) - np.abs(dt[still]))))
        tgse.append(np.mean((dp[ok] - dt[ok]) ** 2))
        tcc.append(structure(dp * ok, dt * ok))
    mean = lambda x: float(np.mean(x)) if x else math.nan
    return {"tgm": mean(tgm), "tgse": mean(tgse), "tcc": mean(tcc)}


#: Pairs of points up to which all are compared.
FEW_PAIRS = 4_000_000


def _all_pairs(a: np.ndarray, b: np.ndarray, p: int, block: int = 1024) -> np.ndarray:
    out = []
    for at in range(0, len(a), block):
        d = np.abs(a[at : at + block, None] - b[None])
        out.append((d.sum(-1) if p == 1 else np.sqrt((d * d).sum(-1))).min(axis=1))
    return np.concatenate(out) if out else np.zeros(0)


def nearest_distance(a: np.ndarray, b: np.ndarray, p: int = 2) -> np.ndarray:
    """Distance (p = 1 or 2) of each point of a to the nearest of b. Points of b lie in grid cells; a distance of one cell or less is
    final once the neighbouring cells are searched, and what is left goes on in a grid twice as wide."""
    if not len(a) or not len(b):
        return np.full(len(a), np.inf)
    low = np.minimum(a.min(axis=0), b.min(axis=0))
    extent = float(max((np.maximum(a.max(axis=0), b.max(axis=0)) - low).max(), 1e-12))
    side = extent / max(1.0, len(b) ** (1 / 3))
    best, left = np.full(len(a), np.inf), np.arange(len(a))
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * 3, indexing="ij"), -1).reshape(-1, 3)
    while left.size * len(b) > FEW_PAIRS and side < extent:
        span = int(extent / side) + 3
        number = lambda points: (np.floor((points - low) / side).astype(np.int64) + 1) @ np.array([span * span, span, 1])
        cells = number(b)
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        own = number(a[left])
        for step in steps @ np.array([span * span, span, 1]):
            begin, end = (np.searchsorted(cells, own + step, side) for side in ("left", "right"))
            for j in range(int((end - begin).max())):
                has = np.flatnonzero(end - begin > j)
                d = np.abs(a[left[has]] - b[order[begin[has] + j]])
                d = d.sum(-1) if p == 1 else np.sqrt((d * d).sum(-1))
                best[left[has]] = np.minimum(best[left[has]], d)
        left = left[best[left] > side]
        side *= 2
    best[left] = _all_pairs(a[left], b, p)
    return best


def cloud_scores(pred: np.ndarray, truth: np.ndarray, limits: tuple[float, ...] = (0.01, 0.02, 0.05, 0.1)) -> dict[str, float]:
    """Chamfer distance and F-scores of two point clouds; nan and zeros under ten points."""
    if min(len(pred), len(truth)) < 10:
        return {"chamfer_l1": math.nan} | {f"fscore_{round(t * 100)}cm": 0.0 for t in limits}
    there, back = nearest_distance(pred, truth), nearest_distance(truth, pred)
    out = {"chamfer_l1": float(nearest_distance(pred, truth, 1).mean() + nearest_distance(truth, pred, 1).mean())}
    for t in limits:
        p, r = float(np.mean(there < t)), float(np.mean(back < t))
        out[f"fscore_{round(t * 100)}cm"] = 0.0 if p + r < 1e-12 else 2 * p * r / (p + r)
    return out


def normals(depth: np.ndarray, fx: float, fy: float, cx: float, cy: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit surface normals by central differences, and where all neighbours are known (the border isn't)."""
    points = back_project(depth, fx, fy, cx, cy)
    known = np.isfinite(depth) & (depth > 0)
    dx, dy = np.zeros_like(points), np.zeros_like(points)
    dx[:, 1:-1], dy[1:-1] = points[:, 2:] - points[:, :-2], points[2:] - points[:-2]
    cross = np.cross(dx, dy)
    size = np.linalg.norm(cross, axis=-1)
    ok = np.zeros_like(known)
    ok[1:-1, 1:-1] = known[1:-1, 1:-1] & known[1:-1, 2:] & known[1:-1, :-2] & known[2:, 1:-1] & known[:-2, 1:-1]
    ok &= size > 0
    return np.divide(cross, size[..., None], out=np.zeros_like(cross), where=size[..., None] > 0), ok


def normal_errors(pred: np.ndarray, truth: np.ndarray, fx: float, fy: float, cx: float, cy: float) -> dict[str, float]:
    (a, oka), (b, okb) = normals(pred, fx, fy, cx, cy), normals(truth, fx, fy, cx, cy)
    ok = oka & okb
    if ok.sum() < 10:
        return {"normal_mae": math.nan, "normal_acc1125": 0.0}
    angle = np.degrees(np.arccos(np.clip(np.abs((a[ok] * b[ok]).sum(-1)), 0, 1)))
    return {"normal_mae": float(angle.mean()), "normal_acc1125": float(np.mean(angle < 11.25))}


def contours(depth: np.ndarray, percent: float) -> np.ndarray:
    """Pixels with a 4-neighbour that is more than so many percent further away."""
    out = np.zeros(depth.shape, bool)
    for axis in (0, 1):
        for step in (1, -1):
            other = np.roll(depth, -step, axis)
            edge = np.ones(depth.shape, bool)
            edge[(-1 if step > 0 else 0, slice(None)) if axis == 0 else (slice(None), -1 if step > 0 else 0)] = False
            ok = edge & (depth > 1e-6) & (other > 1e-6)
            out |= ok & (other > depth * (1 + percent / 100))
    return out


def boundary_f1(pred: np.ndarray, truth: np.ndarray, percents: tuple[float, ...] = (5, 10, 15, 20, 25)) -> float:
    scores = []
    for p in percents:
        a, b = contours(pred, p), contours(truth, p)
        hit = (a & b).sum()
        scores.append(1.0 if not a.any() and not b.any() else 2 * hit / (a.sum() + b.sum()))
    return float(np.mean(scores))


def sharpness(grey: np.ndarray) -> dict[str, float]:
    """Variance of the Laplacian, mean gradient and mean luma of a grey image."""
    g = grey.astype(float)
    inner = g[1:-1, 1:-1]
    laplace = g[2:, 1:-1] + g[:-2, 1:-1] + g[1:-1, 2:] + g[1:-1, :-2] - 4 * inner
    gy, gx = (g[2:, 1:-1] - g[:-2, 1:-1]) / 2, (g[1:-1, 2:] - g[1:-1, :-2]) / 2
    return {"laplacian_var": float(laplace.var()), "gradient_mean": float(np.hypot(gx, gy).mean()), "luma_mean": float(g.mean())}


def dilate(mask: np.ndarray, rounds: int = 1) -> np.ndarray:
    for _ in range(rounds):
        padded = np.pad(mask, 1)
        mask = padded[1:-1, 1:-1] | padded[2:, 1:-1] | padded[:-2, 1:-1] | padded[1:-1, 2:] | padded[1:-1, :-2]
    return mask


def boundary(mask: np.ndarray) -> np.ndarray:
    """Pixels of a mask with a 4-neighbour outside of it."""
    padded = np.pad(mask, 1, constant_values=False)
    return mask & ~(padded[2:, 1:-1] & padded[:-2, 1:-1] & padded[1:-1, 2:] & padded[1:-1, :-2])


def _envelope(heights: np.ndarray) -> np.ndarray:
    """For each place the smallest height + squared distance, over all places of finite height: the lower envelope of parabolas."""
    places = np.flatnonzero(np.isfinite(heights))
    if not len(places):
        return np.full(len(heights), np.inf)
    kept, begins = [int(places[0])], [-np.inf]
    for q in places[1:].tolist():
        while True:
            p = kept[-1]
            meet = ((heights[q] + q * q) - (heights[p] + p * p)) / (2 * (q - p))
            if meet > begins[-1]:
                break
            kept.pop()
            begins.pop()
        kept.append(q)
        begins.append(meet)
    at = np.arange(len(heights))
    nearest = np.array(kept)[np.searchsorted(begins, at, side="right") - 1]
    return heights[nearest] + (at - nearest) ** 2.0


def distances(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of every pixel to the nearest one of the mask (inf if it is empty): envelopes along columns, then along rows."""
    columns = np.stack([_envelope(c) for c in np.where(mask, 0.0, np.inf).T], axis=1)
    return np.sqrt(np.stack([_envelope(r) for r in columns]))


def boundary_scores(pred: np.ndarray, truth: np.ndarray, tolerance: float = 2) -> dict[str, float]:
    """Shares of the predicted boundary that lie within the tolerance of the true one (accuracy) and the other way round (completeness), and their F
    score; two empty boundaries agree, an empty one and another don't."""
    a, b = boundary(pred), boundary(truth)
    if not a.any() or not b.any():
        same = float(a.any() == b.any())
        return {"accuracy": same, "completeness": same, "f": same}
    p, r = float((distances(b)[a] <= tolerance).mean()), float((distances(a)[b] <= tolerance).mean())
    return {"accuracy": p, "completeness": r, "f": 2 * p * r / (p + r) if p + r else 0.0}


def mask_boundary_f(pred: np.ndarray, truth: np.ndarray, tolerance: float = 2) -> float:
    """F-score of two masks' boundaries within a tolerance in pixels."""
    return boundary_scores(pred, truth, tolerance)["f"]


def label_edges(mask: np.ndarray) -> np.ndarray:
    """Pixels with a neighbour of another label, and those beside them (up, down, left, right)."""
    edge = np.zeros(mask.shape, bool)
    for axis in (0, 1):
        change = np.diff(mask, axis=axis) != 0
        ahead, behind = [slice(None)] * 2, [slice(None)] * 2
        ahead[axis], behind[axis] = slice(1, None), slice(None, -1)
        edge[tuple(ahead)] |= change
        edge[tuple(behind)] |= change
    return dilate(edge)


def largest_jump(depth: np.ndarray) -> np.ndarray:
    """The largest difference of each pixel from one of its four neighbours."""
    out = np.zeros(depth.shape)
    for axis in (0, 1):
        step = np.abs(np.diff(depth, axis=axis))
        none = [(0, 0), (0, 0)]
        for side in ((1, 0), (0, 1)):
            none[axis] = side
            out = np.fmax(out, np.pad(step, none))
    return out


def edge_depth_scores(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray, mask: np.ndarray, jump: float = 0.05, least: int = 50) -> dict[str, float]:
    """On the edges of a labelled mask: the share where the prediction jumps (accuracy), the share of the true jumps where it does too (completeness), and
    their F score; nan with fewer than `least` edge pixels or true jumps."""
    edges = label_edges(mask) & valid
    real, found = edges & (largest_jump(truth) > jump), edges & (largest_jump(pred) > jump)
    if edges.sum() < least or real.sum() < least:
        return dict.fromkeys(("edge_accuracy", "edge_completeness", "edge_f"), math.nan)
    a, c = float(found[edges].mean()), float(found[real].mean())
    return {"edge_accuracy": a, "edge_completeness": c, "edge_f": 2 * a * c / max(a + c, 1e-9)}
