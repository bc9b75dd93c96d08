"""Operators against plain implementations and known values."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill.functions import fdist
from cellmill.functions import images as I
from cellmill.functions import kernels as K
from cellmill.operators import cells as C
from cellmill.operators import difficulty as D
from cellmill.operators import grouped as R
from cellmill.operators import quality as U
from cellmill.operators import scores as S
from cellmill.operators import stats as X
from cellmill.operators.ranks import global_rank, percentile_norm
from cellmill.sources import sinks, tables

PHASES = ("clutter", "interaction", "clean")


def cube(spark, values, tiers=None):
    """values: (scene, phase, metric) array."""
    n, _, k = values.shape
    rows = [(s, PHASES[p], (tiers or ["easy"] * n)[s], *[float(x) for x in values[s, p]]) for s in range(n) for p in range(3)]
    names = [f"m{i}" for i in range(k)]
    return spark.createDataFrame(rows, "scene long, phase string, tier string, " + ", ".join(f"{m} double" for m in names)), names


def test_f_distribution():
    assert fdist.f_sf(4.0, 1, 10) == pytest.approx(0.0734, abs=1e-4)
    assert fdist.f_sf(3.0, 5, 2) == pytest.approx(0.2688, abs=1e-3)
    assert fdist.f_sf(1.0, 7, 7) == pytest.approx(0.5)
    assert 0 < fdist.f_sf(900.0, 4, 300) < 1e-100
    assert fdist.f_sf(0, 3, 3) == 1.0 and fdist.f_sf(math.inf, 3, 3) == 0.0


def test_random_cube_is_invariant_and_shifts_show(spark):
    v = np.random.default_rng(42).normal(size=(100, 3, 5))
    z, names = cube(spark, v)
    phi = X.phi_oneway(X.Cube.of(X.standardise(z, names), names))
    assert phi.phi_wilks > 0.9 and phi.p_value > 0.05
    v = np.random.default_rng(123).normal(size=(100, 3, 5))
    v[:, 1, 0] += 5
    v[:, 2, 0] += 2
    z, names = cube(spark, v)
    phi = X.phi_oneway(X.Cube.of(X.standardise(z, names), names))
    assert phi.phi_wilks < 0.5 and phi.p_value < 1e-6


def test_phi_against_dense_algebra(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 3, 3)) + rng.normal(size=(40, 1, 3)) * 2 + np.array([0, 0.5, 0.2])[None, :, None]
    z, names = cube(spark, v)
    got = X.Cube.of(z, names)
    pm, sm, g = v.mean(0), v.mean(1), v.mean((0, 1))
    e = (v - pm).reshape(-1, 3)
    h = 40 * (pm - g).T @ (pm - g)
    assert np.allclose(got.within, e.T @ e) and np.allclose(got.between, h)
    r = (v - pm - sm[:, None] + g).reshape(-1, 3)
    subjects, dummies = np.repeat(np.eye(40), 3, axis=0), np.tile(np.eye(3), (40, 1))
    flat = v.reshape(-1, 3)
    design = np.column_stack([subjects, dummies])
    left = flat - design @ np.linalg.lstsq(design, flat, rcond=None)[0]
    assert np.allclose(left.T @ left, r.T @ r)
    repeated = X.phi_repeated(got)
    assert repeated.wilks == pytest.approx(np.linalg.det(r.T @ r) / np.linalg.det(r.T @ r + h))
    assert repeated.phi_wilks < X.phi_oneway(got).phi_wilks  # scenes' variance is out of the error


def test_constant_phase_profile_is_one(spark):
    v = np.repeat(np.random.default_rng(7).normal(size=(20, 1, 2)), 3, axis=1)
    z, names = cube(spark, v)
    got = X.phi_repeated(X.Cube.of(z, names))
    assert got.phi_wilks == 1.0 and got.p_value == 1.0
    assert X.hotelling_of(X.differences(z, names, "clutter", "clean"), names)["phi"] == 1.0


def test_collinear_and_unbalanced_cubes_are_refused(spark):
    v = np.random.default_rng(8).normal(size=(30, 3, 1))
    z, names = cube(spark, np.concatenate([v, v * 2 + 1e-9], axis=2))
    with pytest.raises(X.StatsError):
        X.phi_oneway(X.Cube.of(z, names))
    with pytest.raises(X.StatsError):
        X.Cube.of(z.filter("NOT (scene = 3 AND phase = 'clean')"), names)


def test_transitions_and_holm(spark):
    v = np.random.default_rng(9).normal(size=(50, 3, 2))
    v[:, 1] += 0.8
    z, names = cube(spark, v)
    rows = {r.transition: r for r in X.transitions(z, names, PHASES).collect()}
    d = v[:, 1] - v[:, 0]
    t2 = 50 * d.mean(0) @ np.linalg.inv(np.cov(d.T)) @ d.mean(0)
    assert rows["clutter->interaction"].t2 == pytest.approx(t2) and rows["clutter->interaction"].phi == pytest.approx(1 - t2 / (t2 + 49))
    p = sorted((r.p_value, r.p_holm) for r in rows.values())
    assert [h for _, h in p] == sorted(h for _, h in p) and all(h >= q for q, h in p) and p[0][1] == pytest.approx(min(1, 3 * p[0][0]))


def test_mixed_design_sees_the_interaction(spark):
    rng = np.random.default_rng(10)
    tiers = ["easy"] * 33 + ["medium"] * 33 + ["hard"] * 34
    v = rng.normal(size=(100, 3, 2))
    z, names = cube(spark, v, tiers)
    flat = {r.effect: r for r in X.mixed_design(z, names, PHASES).collect()}
    v[66:, 1] += 2.0
    z, names = cube(spark, v, tiers)
    bent = {r.effect: r for r in X.mixed_design(z, names, PHASES).collect()}
    assert flat["interaction"].p_value > 0.01 and bent["interaction"].p_value < 1e-6
    assert bent["interaction"].phi_wilks < flat["interaction"].phi_wilks


def test_budget_curve(spark):
    rows = [(b, s, v) for b, v in ((50, 0.10), (100, 0.052), (250, 0.05)) for s in range(10)]
    got = X.degradation(spark.createDataFrame(rows, "frame_budget long, scene long, absrel double"), "absrel").first()
    assert got.critical_budget == 100 and got.tcv == pytest.approx(0.05)
    flat = X.degradation(spark.createDataFrame([(b, 0.3) for b in (50, 100, 250)], "frame_budget long, absrel double"), "absrel").first()
    assert flat.audc == pytest.approx(1.0)


def test_global_rank_is_exact(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, float("nan"), rng.randint(0, 20) / 2, rng.random()])) for i in range(500)]
    got = {r.i: r.rank for r in global_rank(spark.createDataFrame(rows, "i long, v double"), "v", "i").collect()}
    last = lambda v: v is None or math.isnan(v)
    want = sorted(rows, key=lambda r: (last(r[1]), 0 if last(r[1]) else r[1], r[0]))
    assert [got[i] for i, _ in want] == list(range(1, 501))
    assert global_rank(spark.createDataFrame([], "i long, v double"), "v", "i").count() == 0


def test_percentile_norm(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", float("nan")), ("b", 3.0), ("b", 3.0), ("c", None)]
    got = [r.p for r in percentile_norm(spark.createDataFrame(rows, "f string, v double"), ("f",), "v", "p").orderBy("f", F.isnan("v"), "v").collect()]
    assert got == pytest.approx([1 / 3, 2.5 / 3, 2.5 / 3, 0.5, 0.5, 0.5, 0.5])


def test_components_and_clusters(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.02, size=(20, 4)) for c in (0.1, 0.5, 0.9)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double, d double")
    got = np.array([r.pc1 for r in D.component_scores(df, ["i"], list("abcd")).orderBy("i").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, 0] * s[0])) and got[0] < got[-1]
    tiers = [r.tier for r in D.cluster_tiers(df, ["i"], list("abcd")).orderBy("i").collect()]
    assert tiers == ["easy"] * 20 + ["medium"] * 20 + ["hard"] * 20


def test_cells(spark):
    rows = [(i, f"s{i % 3}", p, "easy" if i > 3 else None, 0.1 + 0.05 * (p == "int"), 42.0, 50) for i in range(12) for p in ("clu", "int", "cln")]
    s = spark.createDataFrame(rows + [(99, None, "clu", "easy", 9.0, 1.0, 1)], "sample long, scene string, phase string, difficulty string, absrel double, latency_ms double, frame_budget long")
    got = C.cells_from_samples(s, ["absrel"]).collect()
    assert len(got) == 9 and {r.n_samples for r in got} == {4} and {r.difficulty for r in got} == {"easy"}
    assert {round(r.absrel, 9) for r in got} == {0.1, 0.15}


def test_composite_zero_and_bounds(spark):
    specs = [S.Spec("a", 0.0, 1.0), S.Spec("b", 1.0, 0.0)]
    df = spark.createDataFrame([(0.2, 0.5), (1.5, 0.9), (0.0, 1.0)], "a double, b double")
    got = df.select(S.composite(specs).alias("j"), S.composite(specs, 0.01).alias("e"), S.out_of_bounds(specs).alias("o")).collect()
    assert [r.j for r in got] == pytest.approx([math.sqrt(0.4), 0.0, 1.0]) and got[1].e == pytest.approx(math.sqrt(0.009)) and got[1].o == ["a"]


def test_depth_of_nothing(spark):
    df = spark.createDataFrame([], "p double, t double")
    r = df.agg(*[c.alias(n) for n, c in K.depth_aggregates(F.col("p"), F.col("t")).items()]).first()
    assert (r.absrel, r.rmse, r.delta1, r.delta3) == (0.0, 0.0, 1.0, 1.0)


def test_chain_is_a_product(spark):
    q = [0.1, 0.2, 0.3, math.sqrt(1 - 0.14)]
    turn = [x for row in K.quaternion_matrix([F.lit(v) for v in q]) for x in row]
    step = F.array(*turn, F.lit(1.0), F.lit(0.0), F.lit(0.5))
    got = spark.range(1).select(K.chain(F.array(step, step, step)).alias("c")).first().c
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = I.quaternion_matrices(np.array([q]))[0], (1.0, 0.0, 0.5)
    want = m @ m @ m
    assert np.allclose(got, [*want[:3, :3].ravel(), *want[:3, 3]])
    assert not np.allclose(got[9:], [3.0, 0.0, 1.5])  # turning first is not adding up


def test_relative_poses(spark):
    rng = np.random.default_rng(4)
    q = rng.normal(size=(2, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    t = rng.normal(size=(2, 3))
    m = np.tile(np.eye(4), (2, 1, 1))
    m[:, :3, :3], m[:, :3, 3] = I.quaternion_matrices(q), t
    a, b = (K.motion([F.lit(float(x)) for x in q[i]], [F.lit(float(x)) for x in t[i]]) for i in (0, 1))
    r = spark.range(1).select(K.relative(a, b).alias("r"), K.flip_axes(K.flip_axes(a)).alias("same"), a.alias("a"), K.motion_angle(K.relative(a, b)).alias("angle")).first()
    want = np.linalg.inv(m[0]) @ m[1]
    assert np.allclose(r.r, [*want[:3, :3].ravel(), *want[:3, 3]]) and np.allclose(r.same, r.a)
    assert r.angle == pytest.approx(math.degrees(math.acos((np.trace(want[:3, :3]) - 1) / 2)))


def brute_assign(cost):
    n, m = cost.shape
    if n > m:
        return brute_assign(cost.T)
    return min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))


def test_hungarian_against_all_assignments():
    rng = np.random.default_rng(11)
    for _ in range(150):
        cost = rng.integers(-9, 9, size=(rng.integers(1, 6), rng.integers(1, 6))).astype(float)
        pairs = R.hungarian(cost)
        assert len(pairs) == min(cost.shape) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        assert sum(cost[i, j] for i, j in pairs) == brute_assign(cost)


def test_selections():
    rng = np.random.default_rng(12)
    p = rng.normal(size=(60, 3))
    chosen = R.farthest_points(p, 10)
    assert chosen[0] == 0 and len(set(chosen)) == 10 and len(R.farthest_points(p[:3], 10)) == 3
    kept = R.poisson_disk(p[:, :2], range(60), 0.5)
    gaps = [np.linalg.norm(p[a, :2] - p[b, :2]) for a, b in itertools.combinations(kept, 2)]
    assert min(gaps) >= 0.5
    assert all(min(np.linalg.norm(p[i, :2] - p[k, :2]) for k in kept) < 0.5 for i in set(range(60)) - set(kept))  # nothing more fits
    q = np.column_stack([p, np.tile([0, 0, 0, 1.0], (60, 1))])
    assert len(R.ordered_poses_for(q, 12, 0.5)) <= 12 and R.ordered_poses(q, 0.0, 1.0) == list(range(60)) and R.ordered_poses(q[:1], 1, 1) == [0]
    boxes = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [20, 20, 30, 30]], float)
    assert R.suppress(boxes, np.array([0.5, 0.9, 0.1]), 0.5) == [1, 2]


def test_fair_distribution(spark):
    rng = random.Random(13)
    rows = [(1, f"f{rng.randrange(8)}", f"fact{i % 25}") for i in range(160)]
    got = R.distribute(spark.createDataFrame(rows, "g long, frame string, fact string"), ["g"], "frame", "fact", 4).orderBy("place").collect()
    placed = [(r.frame, r.fact) for r in got]
    assert len(set(placed)) == len(placed) and set(placed) <= {(f, x) for _, f, x in rows}
    per_frame = [sum(f == x for x, _ in placed) for f in {f for f, _ in placed}]
    assert max(per_frame) <= 4
    facts = [x for _, x in placed]
    firsts = len(set(facts))
    assert len(set(facts[:firsts])) == firsts  # every fact once before any repeats
    free = R.distribute(spark.createDataFrame(rows, "g long, frame string, fact string"), ["g"], "frame", "fact", None).count()
    assert free == len({(f, x) for _, f, x in rows})


def test_balanced_and_quota(spark):
    rng = random.Random(14)
    rows = [(1, f, rng.choice("abc"), i, f"s{i % 11}") for i, f in enumerate(sorted(rng.randrange(30) for _ in range(200)))]
    df = spark.createDataFrame(rows, "g long, frame long, kind string, id long, meaning string")
    got = R.balanced_assign(df, ["g"], "frame", "kind", "id").collect()
    assert len(got) == len({r[1] for r in rows})
    counts = [sum(r.kind == k for r in got) for k in "abc"]
    assert max(counts) - min(counts) <= 3
    picked = R.quota_select(df, ["g"], "kind", "frame", "meaning", "id", 3).collect()
    meanings = {r[3]: r[4] for r in rows}
    assert len({meanings[r.id] for r in picked}) == len(picked) and max(sum(r.kind == k for r in picked) for k in "abc") <= 3


def test_tracking(spark):
    rng = random.Random(15)
    box = lambda t, f: (t * 30.0 + f, 0.0, t * 30.0 + f + 10, 10.0)
    truth = [("c", f, False, str(t), *box(t, f)) for f in range(10) for t in range(3)]
    schema = "clip string, frame long, is_pred boolean, track string, x1 double, y1 double, x2 double, y2 double"
    score = lambda pred: R.track_scores(spark.createDataFrame(truth + pred, schema), ["clip"], "frame").first()
    same = score([("c", f, True, "p" + t, *b) for _, f, _, t, *b in truth])
    assert all(getattr(same, k) == pytest.approx(1.0) for k in ("mota", "f1", "hota", "deta", "assa", "idf1")) and same.idsw == 0
    swapped = score([("c", f, True, ("p" if f < 5 else "q") + t, *b) for _, f, _, t, *b in truth])
    assert swapped.deta == pytest.approx(1.0) and swapped.assa == pytest.approx(0.5) and swapped.idf1 == pytest.approx(0.5) and swapped.idsw == 0
    crossed = score([("c", f, True, t if f < 5 else str((int(t) + 1) % 3), *b) for _, f, _, t, *b in truth])
    assert crossed.idsw == 3 and crossed.mota == pytest.approx(0.9)
    half = score([("c", f, True, t, *b) for _, f, _, t, *b in truth if f % 2])
    assert half.fn == 15 and half.mota == pytest.approx(0.5) and half.deta == pytest.approx(0.5)
    assert rng


def test_frame_kernels():
    rng = np.random.default_rng(16)
    depth = 1 + rng.random((12, 14))
    cam = (10.0, 10.0, 6.5, 5.5)
    still = np.tile(np.eye(4), (2, 1, 1))
    assert I.temporal_alignment_error(np.stack([depth, depth]), still, *cam) == pytest.approx(0.0, abs=1e-12)
    assert I.temporal_alignment_error(np.stack([depth, depth * 1.1]), still, *cam) == pytest.approx((0.1 + 0.1 / 1.1) / 2, rel=1e-6)
    assert I.structure(depth, depth) == pytest.approx(1.0) and I.structure(depth, depth[::-1]) < 0.9
    cloud = I.back_project(depth, *cam).reshape(-1, 3)
    assert I.cloud_scores(cloud, cloud)["fscore_1cm"] == 1.0 and I.cloud_scores(cloud[:5], cloud)["fscore_5cm"] == 0.0
    moved = I.cloud_scores(cloud + np.array([0, 0, 0.03]), cloud)
    assert moved["fscore_5cm"] == 1.0 and moved["chamfer_l1"] <= 0.06 + 1e-9
    assert I.normal_errors(depth, depth, *cam) == {"normal_mae": pytest.approx(0.0, abs=1e-4), "normal_acc1125": 1.0}
    assert I.boundary_f1(depth, depth) == 1.0
    step = np.ones((8, 8))
    step[:, 4:] = 2
    assert I.contours(step, 20).sum() == 8 and I.contours(step, 150).sum() == 0
    mask = np.zeros((9, 9), bool)
    mask[2:6, 2:6] = True
    assert I.mask_boundary_f(mask, mask) == 1.0 and I.mask_boundary_f(mask, ~mask & False) == 0.0
    assert I.boundary(mask).sum() == 12 and I.sharpness(np.ones((5, 5)))["laplacian_var"] == 0.0
    g = I.temporal_gradients(np.stack([depth, depth + 0.01]), np.stack([depth, depth]), 0.05)
    assert g["tgm"] == pytest.approx(0.01) and g["tgse"] == pytest.approx(1e-4)


def test_readers_and_writers(spark, tmp_path):
    a = spark.createDataFrame([("m", "s", 1.0)], "model string, scene string, absrel double")
    b = spark.createDataFrame([("n", "t", 2.0)], "model string, scene string, delta1 double")
    sinks.write_cells(a, str(tmp_path / "a.parquet"))
    sinks.write_cells(b, str(tmp_path / "b.jsonl"))
    got = tables.read_cells(spark, str(tmp_path / "a.parquet"), str(tmp_path / "b.jsonl")).orderBy("model").collect()
    assert [(r.absrel, r.delta1) for r in got] == [(1.0, None), (None, 2.0)]
    sinks.write_cells(spark.createDataFrame([], tables.CELL_SCHEMA), str(tmp_path / "e.parquet"))
    assert spark.read.parquet(str(tmp_path / "e.parquet")).columns == tables.CELL_SCHEMA.names
    (tmp_path / "m.json").write_text(json.dumps({"task": "t", "samples": [{"id": "x", "rgb": "1.png"}, {"id": "y", "rgb": "2.png"}]}))
    assert [r.id for r in tables.read_manifest(spark, str(tmp_path / "m.json"), 1).collect()] == ["x"]
    (tmp_path / "r.json").write_text(json.dumps({"model": "M", "task": "T", "records": [{"v": 1, "model": None}, {"v": 2, "model": "N"}]}))
    assert {(r.v, r.model, r.task) for r in tables.read_records(spark, str(tmp_path / "r.json")).collect()} == {(1, "M", "T"), (2, "N", "T")}
    (tmp_path / "j.jsonl").write_text('{"k": 1}\nbroken\n')
    bad = tables.read_jsonl_checked(spark, str(tmp_path / "j.jsonl"), "k int").collect()
    assert [r._corrupt_record for r in bad if r.k is None] == ["broken"]
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in tables.file_checksums(spark, str(tmp_path), "*.json").collect()}
    assert {"m.json", "r.json"} <= set(sums) and all(len(v) == 64 for v in sums.values())
    m = spark.createDataFrame([("s", '{"1": {"name": "cup"}, "2": {"name": "pan"}}')], "scene string, j string")
    assert {(r.scene, r.id, r.name) for r in tables.map_entries(m, "j", "id", "name string").collect()} == {("s", "1", "cup"), ("s", "2", "pan")}
    sinks.write_splits(spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "task string, split string, v int"), str(tmp_path / "splits"), "task", "split")
    assert spark.read.json(str(tmp_path / "splits" / "task=a" / "split=x")).first().v == 1
    assert sinks.markdown(a) == "| model | scene | absrel |\n| --- | --- | --- |\n| m | s | 1.0000 |" and json.loads(sinks.report_json(a)) == [{"model": "m", "scene": "s", "absrel": 1.0}]
    assert U.tables_differ(a, a).count() == 0


def test_token_f1_is_a_multiset(spark):
    df = spark.createDataFrame([("a a b", "a b b"), ("", ""), ("x", "y"), ("The_Cup!", "the cup")], "p string, t string")
    assert [r.f for r in df.select(K.words(F.col("p")).alias("p"), K.words(F.col("t")).alias("t")).select(K.token_f1(F.col("p"), F.col("t")).alias("f")).collect()] == pytest.approx([2 / 3, 0.0, 0.0, 1.0])
