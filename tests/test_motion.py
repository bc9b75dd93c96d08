"""Flow, warping, reprojection, running products, pose tracks and neighbour-preserving axes against plain loops."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellmill.functions import flow as L
from cellmill.functions import images as I
from cellmill.operators import manifold as N
from cellmill.operators import motions as M
from cellmill.operators import reprojection as P
from cellmill.plans import motion as Q


def scene(x, y):
    return 3 + np.sin(0.31 * x + 0.11 * y) + np.cos(0.23 * y - 0.17 * x) + 0.5 * np.sin(0.07 * x * 1.3 + 0.19 * y)


def grid(h, w):
    y, x = np.mgrid[:h, :w].astype(float)
    return x, y


@pytest.mark.parametrize("shift", [(1.5, -0.75), (4.0, 3.0), (0.0, 0.0)])
def test_a_shift_is_recovered(shift):
    x, y = grid(64, 80)
    got = L.dense_flow(scene(x, y), scene(x - shift[0], y - shift[1]))
    assert np.abs(got[8:-8, 8:-8] - shift).max() < 0.5


def test_a_turn_is_recovered():
    x, y = grid(64, 64)
    a, cx, cy = math.radians(3), 31.5, 31.5
    back = lambda u, v: (math.cos(a) * (u - cx) + math.sin(a) * (v - cy) + cx, -math.sin(a) * (u - cx) + math.cos(a) * (v - cy) + cy)
    got = L.dense_flow(scene(x, y), scene(*back(x, y)))
    want = np.stack([math.cos(a) * (x - cx) - math.sin(a) * (y - cy) + cx - x, math.sin(a) * (x - cx) + math.cos(a) * (y - cy) + cy - y], axis=-1)
    assert np.abs(got - want)[8:-8, 8:-8].max() < 0.5


def test_expansion_of_a_quadratic():
    x, y = grid(20, 20)
    a, b = L.expansion(2 * x * x - 3 * x * y + 0.5 * y * y + x - 4 * y + 7)
    mid = a[10, 10], b[10, 10]
    assert np.allclose(mid[0], [[2, -1.5], [-1.5, 0.5]]) and np.allclose(mid[1], [4 * 10 - 3 * 10 + 1, -3 * 10 + 10 - 4])


def slow_warp(before, after, flow):
    h, w = before.shape
    errors = []
    for y in range(h):
        for x in range(w):
            u, v = x + flow[y, x, 0], y + flow[y, x, 1]
            if not (0 <= u <= w - 1 and 0 <= v <= h - 1):
                continue
            x0, y0 = int(u), int(v)
            x1, y1 = min(x0 + 1, w - 1), min(y0 + 1, h - 1)
            value = (before[y0, x0] * (1 - u + x0) + before[y0, x1] * (u - x0)) * (1 - v + y0) + (before[y1, x0] * (1 - u + x0) + before[y1, x1] * (u - x0)) * (v - y0)
            if value > 0 and after[y, x] > 0:
                errors.append(abs(value - after[y, x]) / after[y, x])
    return np.mean(errors) if errors else None


def test_warping_errors(spark):
    rng = np.random.default_rng(1)
    maps, flows = rng.uniform(-0.3, 4, (5, 6, 7)), rng.uniform(-4, 4, (5, 6, 7, 2))
    flows[2] = 100.0
    want = [slow_warp(maps[t - 1], maps[t], flows[t]) for t in range(1, 5)]
    assert want[1] is None
    mean = np.mean([e for e in want if e is not None])
    assert L.warping_error(maps, flows[1:]) == pytest.approx(mean)
    rows = [("a", t, maps[t].ravel().tolist(), flows[t, ..., 0].ravel().tolist(), flows[t, ..., 1].ravel().tolist()) for t in range(5)]
    rows += [("one", 0, *rows[0][2:]), ("bad", 0, [float("nan")] * 42, *rows[0][3:]), ("bad", 1, [float("inf")] * 42, *rows[0][3:]), ("null", 0, None, None, None), ("null", 1, *rows[0][2:])]
    df = spark.createDataFrame(rows, "clip string, frame int, d array<double>, u array<double>, v array<double>")
    got = {r.clip: r for r in P.warping_errors(df, ["clip"], "frame", "d", "u", "v", 7, 6).collect()}
    assert got["a"].opw == pytest.approx(mean) and got["a"].pairs == 3
    assert all(got[c].opw is None and got[c].pairs == 0 for c in ("one", "bad", "null"))
    assert P.warping_errors(df.limit(0), ["clip"], "frame", "d", "u", "v", 7, 6).count() == 0


def test_motion_consistency():
    x, y = grid(32, 32)
    maps = np.array([scene(x - t, y) for t in range(3)])
    other = np.array([scene(x + 2 * t, y - t) for t in range(3)])
    assert L.motion_consistency(maps, maps) == pytest.approx(1.0)
    assert L.motion_consistency(other, maps) < 0.9
    assert math.isnan(L.motion_consistency(np.full((2, 32, 32), np.nan), maps[:2]))


def pose_matrix(q, t):
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = I.quaternion_matrices(np.array([q]))[0], t
    return out


def test_banded_alignment(spark):
    rng = np.random.default_rng(2)
    camera, w, h, frames = (8.0, 8.0, 3.5, 3.5), 8, 8, 7
    pred, truth = rng.uniform(-0.2, 5.5, (frames, h, w)), rng.uniform(0.1, 5.5, (frames, h, w))
    pred[3, 2, 2] = np.nan
    q = rng.normal(0, 0.05, (frames, 4)) + [0, 0, 0, 1]
    q, t = q / np.linalg.norm(q, axis=1, keepdims=True), rng.normal(0, 0.1, (frames, 3))
    t[5] = np.nan  # neither its pair nor the next counts
    want = {}
    for a in range(frames - 1):
        if not np.isfinite(t[[a, a + 1]]).all():
            continue
        moved, hit = I.reproject(pred[a], pose_matrix(q[a], t[a]), pose_matrix(q[a + 1], t[a + 1]), *camera)
        for name, (low, high) in P.BANDS.items():
            ok = hit & (moved > 0) & np.isfinite(pred[a + 1]) & (pred[a + 1] > 0) & (truth[a] >= low) & (truth[a] < high)
            if ok.sum() >= 4:
                want.setdefault(name, []).append(np.mean(np.abs(moved[ok] - pred[a + 1][ok]) / pred[a + 1][ok]))
    rows = [(1, a, [*q[a].tolist(), *t[a].tolist()], pred[a].ravel().tolist(), truth[a].ravel().tolist()) for a in range(frames)] + [(2, 0, None, [1.0] * 64, [1.0] * 64), (2, 1, None, [1.0] * 64, [1.0] * 64)]
    df = spark.createDataFrame(rows, "clip int, frame int, pose array<double>, pred array<double>, truth array<double>")
    got = {r.band: (r.pairs, r.tae) for r in P.banded_alignment(df, ["clip"], "frame", "pose", "pred", "truth", camera, w, h, 4).collect()}
    assert set(got) == set(want) == {"near", "mid", "far"}
    assert all(got[b][0] == len(want[b]) and got[b][1] == pytest.approx(np.mean(want[b])) for b in want)
    plan = P.banded_alignment(df, ["clip"], "frame", "pose", "pred", "truth", camera, w, h)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def turns(rng, n, size):
    q = np.concatenate([rng.normal(0, size, (n, 3)), np.ones((n, 1))], axis=1)
    return np.concatenate([I.quaternion_matrices(q).reshape(n, 9), rng.normal(0, 0.1, (n, 3))], axis=1)


def test_many_small_clips_are_scored_together(monkeypatch):
    rng = np.random.default_rng(15)
    maps, preds = rng.uniform(2, 6, (400, 8, 8)), rng.uniform(2, 6, (400, 8, 8))
    sizes = [12, 1, 7, 12, 2, *[12] * 30, 6]
    maps[15], preds[40, 2, 3] = np.nan, np.inf
    group = np.repeat(np.arange(len(sizes)), sizes)
    assert len(group) == 400
    lists = lambda m: pa.array(m.reshape(400, 64).tolist(), pa.list_(pa.float64()))
    solve, calls = np.linalg.solve, []
    monkeypatch.setattr(np.linalg, "solve", lambda *args: calls.append(1) or solve(*args))
    got = Q._flow_scores(pa.table({"clip": group + 100, "frame": np.arange(400), "truth": lists(maps), "pred": lists(preds)}), group)
    assert len(calls) <= 18  # three rounds of three flows for each of two blocks of pairs, not for each pair
    assert got.column("clip").to_pylist() == list(range(100, 100 + len(sizes)))
    for clip, (opw, tmc) in enumerate(zip(got.column("opw").to_pylist(), got.column("tmc").to_pylist())):
        truth, pred = maps[group == clip], preds[group == clip]
        flows = np.array([L.dense_flow(b, a, window=5) for a, b in zip(truth, truth[1:])]).reshape(-1, 8, 8, 2)
        errors = [slow_warp(pred[t], pred[t + 1], flows[t]) for t in range(len(truth) - 1) if np.isfinite(flows[t]).all() and np.isfinite(pred[t : t + 2]).all()]
        if np.isfinite(pred).all():
            assert opw == (pytest.approx(np.mean(errors)) if errors else None)
        size = lambda m, t: np.linalg.norm(L.dense_flow(*L._scaled(m[t : t + 2])), axis=-1)
        alike = [I.structure(size(pred, t), size(truth, t)) for t in range(len(truth) - 1)]
        alike = [x for x in alike if np.isfinite(x)]
        assert tmc == (pytest.approx(np.mean(alike)) if alike else None)
    nothing = pa.table({"clip": [1, 1], "frame": [0, 1], "truth": pa.array([None, None], pa.list_(pa.float64())), "pred": lists(preds)[:2]})
    assert Q._flow_scores(nothing, np.zeros(2, int)).to_pylist() == [{"clip": 1, "opw": None, "tmc": None}]


def slow_products(motions):
    out, now = [], np.eye(4)
    for m in motions:
        step = np.eye(4)
        step[:3, :3], step[:3, 3] = m[:9].reshape(3, 3), m[9:]
        now = now @ step
        out.append(np.concatenate([now[:3, :3].ravel(), now[:3, 3]]))
    return np.array(out)


def test_one_long_track_over_many_partitions(spark):
    rng = np.random.default_rng(3)
    motions = turns(rng, 100_000, 0.01)
    rows = spark.createDataFrame([(7, i, m) for i, m in enumerate(motions.tolist())] + [(None, i, m) for i, m in enumerate(motions[:3].tolist())] + [(8, 0, None)], "track int, at int, m array<double>").repartition(13)
    got = M.products(rows, "track", "at", "m").select("track", "at", "pose").toPandas()
    assert len(got) == 100_004
    long = got[got.track == 7].sort_values("at")
    assert np.abs(np.array(long.pose.tolist()) - slow_products(motions)).max() < 1e-7
    short = got[got.track.isna()].sort_values("at")
    assert np.allclose(np.array(short.pose.tolist()), slow_products(motions[:3]))
    assert got[got.track == 8].pose.iloc[0].tolist() == [1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0]
    assert M.products(rows.limit(0), "track", "at", "m").count() == 0


def angle(m):
    return math.degrees(math.acos(np.clip((np.trace(m[:3, :3]) - 1) / 2, -1, 1)))


def slow_tracks(frames, cams, boards):
    inv, corr = np.linalg.inv, lambda a, b: np.corrcoef(np.ravel(a), np.ravel(b))[0, 1]
    ars = [inv(b) for b in boards]
    c, a = [inv(cams[0]) @ m for m in cams], [inv(ars[0]) @ m for m in ars]
    ct, at = np.array([m[:3, 3] for m in c]), np.array([m[:3, 3] for m in a])

    def vector(m):
        t = math.radians(angle(m))
        return np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]]) * (0.5 if t < 1e-9 else t / (2 * math.sin(t)))

    cr, ar = np.array([vector(m) for m in c]), np.array([vector(m) for m in a])
    rmse = lambda x: math.sqrt(np.mean(np.square(x)))
    et, er = np.linalg.norm(ct - at, axis=1), [angle(inv(x) @ y) for x, y in zip(c, a)]
    steps = [(inv(cams[i - 1]) @ cams[i], inv(ars[i - 1]) @ ars[i], frames[i] - frames[i - 1]) for i in range(1, len(cams))]
    st, sr, gap = [np.linalg.norm(x[:3, 3] - y[:3, 3]) for x, y, _ in steps], [angle(inv(x) @ y) for x, y, _ in steps], np.array([g for *_, g in steps])
    world = [x @ y for x, y in zip(cams, boards)]
    place = np.array([m[:3, 3] for m in world])
    jitter = np.linalg.norm(place - np.median(place, axis=0), axis=1)
    mad = np.median(np.abs(jitter - np.median(jitter)))
    f = np.array(frames, float) - np.mean(frames)
    return {
        "frames": len(frames), "first_frame": frames[0], "last_frame": frames[-1],
        **{f"translation_{n}_corr": corr(ct[:, i], at[:, i]) for i, n in enumerate("xyz")}, **{f"rotation_{n}_corr": corr(cr[:, i], ar[:, i]) for i, n in enumerate("xyz")},
        "translation_all_corr": corr(ct, at), "rotation_all_corr": corr(cr, ar), "translation_size_corr": corr(np.linalg.norm(ct, axis=1), np.linalg.norm(at, axis=1)), "rotation_size_corr": corr(np.linalg.norm(cr, axis=1), np.linalg.norm(ar, axis=1)),
        "anchor_translation_rmse": rmse(et), "anchor_translation_mean": np.mean(et), "anchor_rotation_mean": np.mean(er), "anchor_rotation_rmse": rmse(er), "step_translation_rmse": rmse(st), "step_rotation_rmse": rmse(sr),
        "step_translation_rmse_by_frame": rmse(st / gap), "step_rotation_rmse_by_frame": rmse(sr / gap), "mean_gap": np.mean(gap),
        "board_translation_drift_rmse": rmse(np.linalg.norm(place - place[0], axis=1)), "board_rotation_drift_rmse": rmse([angle(inv(world[0]) @ m) for m in world]),
        "jitter_mean": np.mean(jitter), "jitter_median": np.median(jitter), "jitter_p95": np.percentile(jitter, 95), "jitter_max": jitter.max(),
        "board_slope_by_frame": np.linalg.norm((f[:, None] * (place - place.mean(axis=0))).sum(axis=0) / (f @ f)), "outlier_rate": np.mean((jitter - np.median(jitter)) / (1.4826 * mad) > 3.5),
    }


def test_pose_tracks(spark):
    rng = np.random.default_rng(4)
    square = lambda m: np.vstack([np.hstack([m[:9].reshape(3, 3), m[9:, None]]), [0, 0, 0, 1]])
    flat = lambda m: [*m[:3, :3].ravel().tolist(), *m[:3, 3].tolist()]
    rows, want = [], {}
    for track in (1, 2):
        cams = [square(m) for m in slow_products(turns(rng, 60, 0.02))]
        still, noise = square(turns(rng, 1, 0.3)[0]), [square(m) for m in turns(rng, 60, 0.005)]
        boards = [np.linalg.inv(c) @ still @ n for c, n in zip(cams, noise)]
        boards[7] = boards[7] @ square(turns(rng, 1, 0.01)[0] + np.array([0] * 9 + [3.0, 0, 0]))
        frames = np.cumsum(rng.integers(1, 4, 60)).tolist()
        rows += [(track, f, flat(c), flat(b)) for f, c, b in zip(frames, cams, boards)]
        want[track] = slow_tracks(frames, cams, boards)
    rows += [(3, 5, rows[0][2], rows[0][3]), (4, 1, None, rows[0][3])]
    got = {r.track: r.asDict() for r in M.compare_tracks(spark.createDataFrame(rows, "k int, f int, cam array<double>, board array<double>").repartition(5), "k", "f", "cam", "board").collect()}
    assert set(got) == {1, 2, 3} and set(got[1]) == {"track", *want[1]} and got[3]["step_translation_rmse"] is None and got[3]["translation_x_corr"] is None and got[3]["outlier_rate"] == 0
    for track in want:
        for name, value in want[track].items():
            assert got[track][name] == pytest.approx(value, abs=1e-5), name


def test_axes_equal_dense_algebra(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 4)) @ rng.normal(size=(4, 4))
    names = ["a", "b", "c", "d"]
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0, 1.0, 1.0), (998, float("nan"), 1.0, 1.0, 1.0)], "i int, a double, b double, c double, d double")
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    near = np.argsort(d2, axis=1)[:, :10]
    t = np.median(np.take_along_axis(d2, near, axis=1))
    w = np.zeros((150, 150))
    for i in range(150):
        w[i, near[i]] = np.exp(-d2[i, near[i]] / t)
    w = np.maximum(w, w.T)
    degree = np.diag(w.sum(axis=1))
    left, right = x.T @ (degree - w) @ x, x.T @ degree @ x + 1e-9 * np.eye(4)
    values, vectors = np.linalg.eig(np.linalg.inv(right) @ left)
    want = vectors[:, np.argsort(values.real)].real.T[:2]
    for block in (4096, 40):
        got = N.preserving_axes(rows, names, 2, block=block)
        for a, b in zip(got, want):
            assert abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b) == pytest.approx(1, abs=1e-8) and a.sum() >= 0
            assert a @ right @ a == pytest.approx(1)
    assert not N.preserving_axes(rows.limit(0), names).any()
    out = N.preserved(rows, ["i"], names).collect()
    assert len(out) == 152 and [r for r in out if r.i == 999][0].lpp1 is None


def test_distances_against_brute_force():
    rng = np.random.default_rng(8)
    for share in (0.0, 0.02, 0.3, 1.0):
        mask = rng.random((13, 17)) < share
        y, x = np.mgrid[:13, :17]
        there = np.argwhere(mask)
        want = np.full(mask.shape, np.inf) if not len(there) else np.sqrt(((np.stack([y, x], -1)[:, :, None] - there) ** 2).sum(-1)).min(axis=2)
        assert np.allclose(I.distances(mask), want)


def test_boundary_scores():
    a, b = np.zeros((20, 20), bool), np.zeros((20, 20), bool)
    a[4:12, 4:12], b[5:13, 6:14] = True, True
    near = lambda p, q, t: np.mean([min(math.hypot(y - v, x - u) for v, u in np.argwhere(I.boundary(q))) <= t for y, x in np.argwhere(I.boundary(p))])
    for t in (0, 1, 1.5, 2, 3):
        got = I.boundary_scores(a, b, t)
        assert got["accuracy"] == pytest.approx(near(a, b, t)) and got["completeness"] == pytest.approx(near(b, a, t))
    assert I.boundary_scores(a & False, b & False)["f"] == 1 and I.boundary_scores(a, b & False)["f"] == 0 == I.mask_boundary_f(a & False, b)


def test_edge_depth_scores():
    rng = np.random.default_rng(9)
    labels, pred, truth = rng.integers(0, 2, (9, 8)), rng.random((9, 8)), rng.random((9, 8))
    around = lambda y, x: [(y + a, x + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= y + a < 9 and 0 <= x + b < 8]
    places = [(y, x) for y in range(9) for x in range(8)]
    sharp = {p for p in places if any(labels[q] != labels[p] for q in around(*p))}
    wide = sharp | {q for p in sharp for q in around(*p)}
    jumps = lambda d: {p for p in wide if max(abs(d[p] - d[q]) for q in around(*p)) > 0.7}
    got = I.edge_depth_scores(pred, truth, np.ones((9, 8), bool), labels, 0.7, 1)
    assert got["edge_accuracy"] == pytest.approx(len(jumps(pred)) / len(wide)) and got["edge_completeness"] == pytest.approx(len(jumps(pred) & jumps(truth)) / len(jumps(truth)))
    assert math.isnan(I.edge_depth_scores(pred, truth, np.zeros((9, 8), bool), labels)["edge_f"])


def test_planted_correspondences(spark):
    from cellmill.operators import patches as H

    rng = np.random.default_rng(10)
    f = rng.normal(size=(12, 6))
    moved = rng.permutation(12)
    rows = [("p", 0, i, v.tolist()) for i, v in enumerate(f)] + [("p", 1, int(moved[i]), (3 * v + rng.normal(0, 0.01, 6)).tolist()) for i, v in enumerate(f)]
    rows += [("p", 1, 99, [0.0] * 6), ("p", 0, 98, None), ("q", 0, 0, [1.0] * 6)]
    df = spark.createDataFrame(rows, "pair string, side int, patch int, feature array<double>")
    got = H.mutual_matches(df, ["pair"]).collect()
    assert {(r.pair, r.patch_a, r.patch_b) for r in got} == {("p", i, int(moved[i])) for i in range(12)}
    shares = spark.createDataFrame([("p", s, k, m, w) for s in (0, 1) for k in range(12) for m, w in (((k if s == 0 else int(np.argsort(moved)[k])) % 3, 0.75), (9, 0.25))], "pair string, side int, patch int, mask int, share double")
    votes = {(r.mask_a, r.mask_b): r.votes for r in H.mask_votes(H.mutual_matches(df, ["pair"]), shares, ["pair"]).collect()}
    assert votes == pytest.approx({**{(m, m): 4 * 0.5625 for m in range(3)}, (9, 9): 12 * 0.0625, **{(m, 9): 0.75 for m in range(3)}, **{(9, m): 0.75 for m in range(3)}})


def test_equalised(spark):
    from cellmill.operators import patches as H

    rows = [("a", i, v) for i, v in enumerate([0, 5, 5, 7, -1, 9])] + [("few", 0, 20), ("few", 1, 0), ("none", 0, 0), ("none", 1, None)]
    got = {(r.f, r.p): r.level for r in H.equalised(spark.createDataFrame(rows, "f string, p int, v int"), ["f"], "v", 10.0, 30.0, 2).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0.5, ("a", 2): 0.5, ("a", 3): 0.75, ("a", 4): 0, ("a", 5): 1, ("few", 0): 0.5, ("few", 1): 0, ("none", 0): 0, ("none", 1): 0}
