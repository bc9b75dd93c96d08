"""Rules held against values worked out by hand."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill.functions import images
from cellmill.functions import kernels as K
from cellmill.functions import names as N
from cellmill.operators import curves, difficulty, grouped, identity, lookups, planning, questions, ranks, sequences, stats, vectors


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_mad_clip_uses_the_scaled_deviation(spark):
    # median 3, deviations 2 1 0 1 97 -> MAD 1; limit 3 + 5 * 1.4826 = 10.413
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)] + [("b", 1.0), ("b", 50.0)] + [("c", 2.0)] * 4 + [("c", 9.0)] + [("d", v) for v in (1.0, 2.0, 3.0, 4.0, 10.0)]
    got = sequences.mad_clip(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()
    by = {k: sorted(r.clipped for r in got if r.k == k) for k in "abcd"}
    assert by["a"] == [1, 2, 3, 3, 4] and by["d"] == [1, 2, 3, 4, 10]
    assert by["b"] == [1, 50] and by["c"] == [2, 2, 2, 2, 9]  # too few; no spread


def test_mad_outliers_are_high_values(spark):
    rows = [("a", v) for v in (-100.0, 1.0, 2.0, 3.0, 4.0, 100.0)] + [("b", 1.0)] * 3 + [("b", 0.5), ("b", 1.5)] + [("c", 7.0)] * 3
    got = sequences.mad_outliers(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").filter("outlier").collect()
    assert sorted((r.k, r.v) for r in got) == [("a", 100.0), ("b", 1.5)]


def test_stability_over_seen_frames_and_items(spark):
    areas = {"x": [10.0, 0.0, 10.0, 4.0], "y": [5.0, 5.0, 5.0, 5.0], "z": [0.0, 0.0, 0.0, 0.0]}
    df = spark.createDataFrame([("s", i, t, a) for i, col in areas.items() for t, a in enumerate(col)], "s string, item string, t int, a double")
    got = sequences.stability(df, ["s"], "item", ["t"], "a").first()
    # x: sizes 10 10 4 -> mean 8, deviation sqrt(8); falls to 0 and to 4: 2 of 4 frames; two flips of 4 frames. z was never seen.
    assert (got.area_cv, got.area_drop, got.vis_instability) == pytest.approx((math.sqrt(8) / 8 / 2, 0.25, 0.25))


@pytest.mark.parametrize("mode, truth", [("affine", lambda p: 2 * p + 1), ("disparity", lambda p: 1 / (0.5 * p + 0.2)), ("log", lambda p: math.exp(0.3 * p - 1)), ("median", lambda p: 3 * p)])
def test_alignment_recovers_its_own_model(spark, mode, truth):
    rows = [("a", p / 4, truth(p / 4), True) for p in range(1, 12)] + [("a", 2.0, 99.0, False), ("b", 1.0, 5.0, False)] + [("c", 2.0, t, True) for t in (1.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, p double, g double, fine boolean")
    got = sequences.aligned(df, ["k"], "p", "g", mode, F.col("fine")).collect()
    for r in got:
        if r.k == "a" and r.fine:
            assert r.aligned == pytest.approx(r.g, rel=1e-6)
    assert [r.aligned for r in got if r.k == "b"] == [1.0]
    if mode == "affine":
        assert [r.aligned for r in got if r.k == "c"] == [2.0, 2.0]  # a constant prediction gets the mean


def test_alignment_bounds(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 0.5), ("a", -40.0, 1.0)], "k string, p double, g double")
    fit = F.col("p") > 0
    assert min(r.aligned for r in sequences.aligned(df, ["k"], "p", "g", "disparity", fit).collect() if r.p < 0) == pytest.approx(1000.0)  # 1 / 1e-3
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, math.e), ("a", 50.0, 1.0)], "k string, p double, g double")
    assert max(r.aligned for r in sequences.aligned(df, ["k"], "p", "g", "log", F.col("p") < 3).collect()) == pytest.approx(math.exp(5.0))


def test_labels_of_any_script(spark):
    texts = {"T-shirt Café a\tb": "t-shirt café a b", "  Fire_Hydrant!! ": "fire hydrant", "ﬁne  ＡＢＣ": "fine abc", "Straße №5": "straße no5", "…": "", None: None}
    assert one(spark, [(t,) for t in texts], "t string", K.normal_label(F.col("t"))) == list(texts.values())


def test_canonical_values_by_kind(spark):
    assert one(spark, [(" GRAY ",), ("To  drink",), (None,)], "t string", K.canonical(F.col("t"), K.COLOUR_ALIASES)) == ["grey", "to drink", None]
    assert one(spark, [("gray",), ("To  drink",), ("to  Snack ",)], "t string", K.canonical(F.col("t"), K.FUNCTION_ALIASES)) == ["gray", "drink", "snack"]


def test_direction_error_at_tiny_lengths(spark):
    a = [F.col(c) for c in "abc"]
    rows = [(5e-9, 0.0, 0.0), (5e-10, 0.0, 0.0)]
    assert one(spark, rows, "a double, b double, c double", K.direction_error(a, [F.lit(1.0), F.lit(0.0), F.lit(0.0)])) == [0.0, 180.0]


def test_mean_iou_leaves_out_negative_classes(spark):
    # class 0: 1 hit of 2 rows of either; class 1: 0 of 1; class -1 does not count; group "n" has no class
    rows = [("a", 0, 0), ("a", 1, 0), ("a", 0, 1), ("a", 0, -1), ("n", 2, -1)]
    got = {r.k: (r.miou, r.classes) for r in curves.mean_iou(spark.createDataFrame(rows, "k string, p int, t int"), "p", "t", ("k",)).collect()}
    assert got["a"] == (pytest.approx((1 / 4 + 0) / 2), 2) and got["n"] == (1.0, 0)


def test_effort_has_a_share_of_the_weight():
    names = ["iter_mean", "iter_max", *[f"f{i}" for i in range(29)]]
    w = difficulty.effort_stratified(names, ("iter_mean", "iter_max"))
    assert w["iter_mean"] == w["iter_max"] == 0.125 and w["f0"] == pytest.approx(0.75 / 29) and sum(w.values()) == pytest.approx(1.0)
    assert difficulty.effort_stratified(["iter_max"], ("iter_max",)) == {"iter_max": 1.0}
    with pytest.raises(ValueError):
        difficulty.effort_stratified(["f"], ("iter_max",))
    with pytest.raises(ValueError):
        difficulty.effort_stratified(names, ("iter_max",), 1.5)


def test_boxes_on_the_grid(spark):
    b = tuple(F.col(c) for c in "abcd")
    rows = [(0.0, 0.0, 1000.0, 1000.0), (0.5, 0.0, 1.0, 0.5), (10.0, 0.0, 1001.0, 5.0), (-1.0, 0.0, 5.0, 5.0), (9.0, 0.0, 5.0, 5.0), (2.0, 3.0, 5.0, 7.0)]
    px = K.scaled_box(b, F.lit(640), F.lit(480))
    got = [tuple(r) for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select(*px).collect()]
    assert got[0] == (0, 0, 639, 479) and got[1] == (319.5, 0, 639, 239.5) and got[2:5] == [(None,) * 4] * 3
    assert got[5] == pytest.approx((2 * 639 / 1000, 3 * 479 / 1000, 5 * 639 / 1000, 7 * 479 / 1000))


def test_roofline_names_the_slower_part(spark):
    got = spark.createDataFrame([(19.5e12, 2039e9 / 2), (1.0, 2039e9)], "f double, t double").select(*K.roofline(F.col("f"), F.col("t"), 19.5, 2039.0)).collect()
    assert [r[3] for r in got] == ["compute", "memory"] and got[0][0] == pytest.approx(1000.0) and got[0][2] == pytest.approx(1000.0) and got[1][2] == pytest.approx(1000.0)


def test_ranks_cut_a_shared_value_by_its_ties(spark):
    rows = [(i, 1.0) for i in range(4000)] + [(9000 + i, float(i)) for i in range(50)] + [(9900, None), (9901, float("nan"))]
    got = {r.i: (r["rank"], r.total) for r in ranks.global_rank(spark.createDataFrame(rows, "i long, v double").repartition(7), "v", "i").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None or math.isnan(r[1]), r[1] if r[1] is not None and not math.isnan(r[1]) else 0.0, r[0]))
    assert got == {i: (k + 1, len(rows)) for k, (i, _) in enumerate(order)}


@pytest.mark.parametrize("p", [1, 2])
def test_nearest_distance_in_grid_cells(monkeypatch, p):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(900, 3)), np.concatenate([rng.normal(size=(700, 3)), rng.normal(size=(5, 3)) * 50])
    want = images._all_pairs(a, b, p)
    monkeypatch.setattr(images, "FEW_PAIRS", 1000)
    assert images.nearest_distance(a, b, p) == pytest.approx(want)
    assert images.nearest_distance(a[:0], b, p).size == 0 and np.isinf(images.nearest_distance(a, b[:0], p)).all()


def test_selections_from_the_rule():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(80, 3))
    chosen, gap = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < 9:
        gap[chosen] = -1
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    assert grouped.farthest_points(points, 9).tolist() == sorted(chosen)
    poses = np.concatenate([np.cumsum(rng.normal(size=(80, 3)) * 0.1, axis=0), rng.normal(size=(80, 4))], axis=1)
    poses[:, 3:] /= np.linalg.norm(poses[:, 3:], axis=1, keepdims=True)
    for radius in (0.0, 0.3, 0.9, 2.0):
        kept = []
        for i in range(79):
            if all(grouped.pose_distance(poses[i], poses[[k]], 0.5)[0] >= radius for k in kept):
                kept.append(i)
        assert grouped.ordered_poses(poses, radius, 0.5) == [*kept, 79]
    for k in (2, 5, 20, 79, 80, 200):
        got = grouped.ordered_poses_for(poses, k, 0.5, 0.0)
        assert len(got) == min(k, 80) and got[0] == 0 and got[-1] == 79 and got == sorted(set(got))


def test_the_pose_search_by_halving_holds_no_distances_of_pairs():
    rng = np.random.default_rng(14)

    def drawn(n):
        poses = np.concatenate([rng.normal(size=(n, 3)), rng.normal(size=(n, 4))], axis=1)
        poses[:, 3:] /= np.linalg.norm(poses[:, 3:], axis=1, keepdims=True)
        return poses

    for n, k in ((40, 10), (90, 12), (5, 3), (30, 200)):
        poses, low, high, want = drawn(n), 0.01, 3.0, None
        for _ in range(25):
            kept = grouped.ordered_poses(poses, (low + high) / 2, 0.5)
            if len(kept) >= min(k, n):
                low, want = (low + high) / 2, kept
            else:
                high = (low + high) / 2
        want = want or grouped.ordered_poses(poses, 0.01, 0.5)
        want = [want[0], *want[1:-1][: k - 2], want[-1]]
        assert grouped.ordered_poses_for(poses, k, 0.5) == want
    poses = drawn(3000)
    tracemalloc.start()
    assert len(grouped.ordered_poses_for(poses, 10, 0.5)) == 10
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000  # 4.5 million distances between pairs would take 36 MB


def test_bootstrap_of_the_phase_effect(spark):
    rng = np.random.default_rng(5)
    rows = [(s, p, float(k + rng.normal()), float(rng.normal())) for s in range(40) for k, p in enumerate(("clutter", "interaction", "clean"))]
    z = spark.createDataFrame(rows, "scene int, phase string, a double, b double")
    got = stats.bootstrap_phi(z, ["a", "b"], 80).first()
    point = stats.phi_oneway(stats.Cube.of(z, ["a", "b"]))
    assert got.n_boot == 80 and got.n_success + got.n_failed == 80 and got.phi_wilks_low < point.phi_wilks < got.phi_wilks_high and got.phi_wilks_se > 0
    with pytest.raises(stats.StatsError):
        stats.bootstrap_phi(z, ["a", "b"], 10)
    with pytest.raises(stats.StatsError):  # a constant metric fails every draw
        stats.bootstrap_phi(z.withColumn("b", F.lit(0.0)), ["a", "b"], 60)


def test_names(spark):
    q = [("What is made of  wood that is used for eating?", "wood", "eating", None), ("Which is NOT made of steel", None, None, "steel"), ("Where?", None, None, None)]
    material, function = N.composition_parts(F.col("q"))
    got = spark.createDataFrame([(x[0],) for x in q], "q string").select(material, function, N.odd_one_out_part(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [x[1:] for x in q]
    paths = {"a/0.0/1.0/x.tar": "a/0/1/x.tar", "a/v1.0": "a/v1.0", "/12.0/": "/12/", "a/1.05/b": "a/1.05/b"}
    assert one(spark, [(p,) for p in paths], "p string", N.repaired_path(F.col("p"))) == list(paths.values())
    assert one(spark, [("a/rgb/rgb/1.png",), ("rgb/1",)], "p string", N.swapped_segment(F.col("p"), "rgb", "depth")) == ["a/depth/rgb/1.png", "rgb/1"]
    assert one(spark, [("a/b.c.png",), (".hidden",), ("plain",)], "p string", N.stem(F.col("p"))) == ["b.c", ".hidden", "plain"]
    assert one(spark, [("x12", "y3"), ("x", "y3"), ("x", "y")], "a string, b string", N.trailing_number(F.col("a"), F.col("b"))) == [12, 3, 0]
    assert one(spark, [("Plastic / metal&Plastic",), ("/",)], "v string", N.material_atoms(F.col("v"))) == [["metal", "plastic"], []]
    assert one(spark, [(0.125,), (0.375,), (2.5,)], "v double", N.half_even(F.col("v"), 2)) == [0.12, 0.38, 2.5]
    assert one(spark, [("clean",), ("zoo",), ("clutter",), (None,)], "p string", N.phase_rank(F.col("p"))) == [2, 3, 0, 3]


def test_lookups(spark):
    cells = spark.createDataFrame([("s1", "clean", "easy", 1.0, 2, True, "x")], "scene_id string, phase string, difficulty string, `metric:a` double, `metric:b` int, c boolean, d string")
    rows = lookups.analysis_rows(cells)
    assert rows.columns == ["scene", "phase", "difficulty", "id", "a", "b"] and rows.first().id == "s1_clean"
    assert lookups.metric_columns(cells.toDF("scene", "phase", "difficulty", "a", "b", "c", "d"), {"a", "b", "c", "d", "scene"}) == ["a", "b"]
    with pytest.raises(ValueError):
        lookups.metric_columns(rows, {"a"}, ["a", "nope"])
    frames = spark.createDataFrame([("multi", True), ("multi", None), ("ego", True)], "scene_type string, has_rgb boolean")
    assert lookups.scoped(frames, ["multi"], ["has_rgb"]).count() == 1 and lookups.scoped(frames, ["multi"], ["has_mask"]).count() == 0


def test_identity_without_reassignment(spark):
    rows = [(0, 1, 1), (0, 1, 2), (0, 2, 2), (0, 9, 3), (0, 1, 0)]  # track, truth
    px = spark.createDataFrame(rows, "frame int, track long, truth long")
    tracks = spark.createDataFrame([(1, 1), (2, 2)], "track long, source long")
    got = {r.object: (r.hit, r.union, r.located) for r in identity.identity_iou(px, tracks, ["frame"]).collect()}
    assert got == {1: (1, 3, True), 2: (1, 2, True), 3: (0, 1, False)}


def test_border_coherence(spark):
    mask = np.zeros((8, 8), int)
    mask[:, 4:] = 1
    rows = [(1, mask.ravel().tolist(), (mask * 2.0).ravel().tolist()), (2, mask.ravel().tolist(), [1.0] * 64), (3, [0] * 64, [1.0] * 64)]
    got = {r.k: r for r in identity.border_coherence(spark.createDataFrame(rows, "k int, mask array<int>, depth array<double>"), ["k"], (8, 8)).collect()}
    # the mask's border is column 3, the depth's columns 3 and 4; both widened by two
    assert got[1].precision == 1.0 and got[1].recall == pytest.approx(5 / 6) and got[1].coherence == pytest.approx(2 * (5 / 6) / (1 + 5 / 6))
    assert (got[2].precision, got[2].recall, got[2].coherence) == (0.0, 1.0, 0.0) and got[3].coherence == 1.0


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 40)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(150, 5)).astype(np.float32)
    v[7] = v[3] * 2  # a tie
    odd = [(900, None, 0), (901, [0.0] * 5, 0), (902, [1.0], 0), (903, [float("nan")] * 5, 0), (None, [1.0] * 5, 0)]
    rows = [(i, [float(x) for x in v[i]], i % 3) for i in range(150)] + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in vectors.nearest(df, F.col("vec_id") % 10 == 0, 4).collect():
        got.setdefault(r.query, {})[r.place] = r.neighbour
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    for q in range(0, 150, 10):
        cos = np.round(u @ u[q], 9)
        want = sorted((i for i in range(150) if i != q), key=lambda i: (-cos[i], i))[:4]
        assert [got[q][k] for k in range(1, 5)] == want
    assert set(got) == set(range(0, 150, 10))


def test_quota_sample_prefers_other_scenes(spark):
    rows = [("t", s, i) for s in range(2) for i in range(5)] + [("u", 7, i) for i in range(3)]
    df = spark.createDataFrame(rows, "type string, scene int, i int")
    got = planning.quota_sample(df, ["type"], "scene", ["i"], 2, "s").collect()
    assert {r.scene for r in got if r.type == "t"} == {0, 1} and len([r for r in got if r.type == "u"]) == 2
    cells = spark.createDataFrame([("t",), ("u",), ("v",)], "type string")
    assert [r.type for r in planning.short_cells(planning.quota_sample(df, ["type"], "scene", ["i"], 2, "s"), cells, ["type"], 2).collect()] == ["v"]


def test_rings_reach_every_member(spark):
    pool = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 1)], "k string, m long")
    got = questions.ring(pool, ["k"], "m", "seed").collect()
    assert sorted(r.place for r in got if r.k == "a") == list(range(300)) and {r["size"] for r in got if r.k == "a"} == {300}
    targets = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 3, "a"), (2, 4, "a")], "frame int, item long, v string")
    found = questions.references(targets, pool.withColumnRenamed("k", "v").withColumnRenamed("m", "item"), "v", ["frame"], "item", "s").collect()
    assert len(found) == 1 and found[0].reference != 5  # b has no other member; two objects of frame 2 share a value
