"""Manifests, samples, audits, depth runs and checked readers: the rules on small tables, with nulls and odd files."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill.operators import depth_runs as D
from cellmill.operators import manifests as M
from cellmill.roles import PHASES, TIERS
from cellmill.sources import tables as S


def test_unified_frames(spark):
    frames = spark.createDataFrame([("s1", "multi_object", "0", 1), ("s1", "multi_object", "7", 2), ("s2", "single_object", "x", 3), ("s3", "multi_object", None, 4)], "scene_id string, scene_type string, phase string, frame int")
    ego = spark.createDataFrame([("s1", "ego", 9, "head", "c1", "lost")], "scene_id string, scene_type string, frame int, view string, capture_id string, phase string")
    splits = spark.createDataFrame([("s1", 0, "easy", "0.5", 1), ("s1", 0, "hard", "", 2), ("s2", 0, "easy", "1", 1)], "scene_id string, phase_index int, difficulty string, rpx_ds string, place int")
    got = {r.frame: r.asDict() for r in M.unified_frames(frames, ego, splits).collect()}
    assert len(got) == 5 and got[1]["difficulty"] == "hard" and got[1]["rpx_ds"] is None and got[1]["phase_name"] == "clutter"  # the later split counts
    assert (got[2]["phase_index"], got[2]["phase_name"], got[2]["difficulty"]) == (7, None, None)
    assert (got[3]["view"], got[3]["capture_id"], got[3]["phase_index"]) == ("object", "x", None)
    assert (got[4]["view"], got[4]["capture_id"]) == ("phase", None)
    assert (got[9]["view"], got[9]["capture_id"], got[9]["phase"]) == ("head", "c1", None)
    assert M.unified_frames(frames.limit(0), ego.limit(0), splits.limit(0)).count() == 0


def test_pair_manifest_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(s, p, 2 * i, float(x)) for s in range(4) for p in (0, 1) for i, x in enumerate(rng.uniform(0, 1, 60 if (s, p) != (3, 1) else 45))]
    frames = spark.createDataFrame(rows, "scene int, phase int, frame int, x double").repartition(5)
    tiers = spark.createDataFrame([(0, 0, "easy"), (0, 1, "odd"), (1, 0, "hard"), (1, 1, None), (2, 0, "medium"), (3, 1, "easy")], "scene int, phase int, tier string")
    far = F.abs(F.col("x_b") - F.col("x_a"))
    pairs = M.pair_manifest(frames, ["scene", "phase"], "frame", far, F.lit(5.0), tiers, "tier", (0.05, 0.2), (2.0, 35.0), "x")
    want = set()
    for s, p, t in ((0, 0, "easy"), (1, 0, "hard"), (2, 0, "medium")):
        clip = sorted(r[2:] for r in rows if r[:2] == (s, p))
        for i in range(0, len(clip), 10):
            for j in (i + o for o in M.OFFSETS):
                if j < len(clip) and 0.05 <= abs(clip[j][1] - clip[i][1]) <= 0.2:
                    want.add((s, p, t, clip[i][0], clip[j][0]))
                    break
    assert {tuple(r) for r in pairs.collect()} == want and len(want) > 8
    one = M.pair_entries(pairs, "scene", "phase", F.lit("clutter")).filter("scene = 0").orderBy("id").first()
    assert one.rgb.startswith("scenes/0/0/rgb/") and one.pose_b.endswith(".npz") and one.id.startswith("0_clutter_")
    heads = M.manifest_heads(M.pair_entries(pairs, "scene", "phase", F.lit("clutter")))
    assert heads.agg(F.sum("samples")).first()[0] == len(want)


def test_canonical_order(spark):
    rows = [("b", "mos", 0, 1, "x"), ("a", "mos", None, 0, "x"), ("a", "mos", 2, 3, "x"), ("a", "mos", 2, 3, "a"), ("a", "ego", None, 9, "x"), ("a", "mos", 10, 0, "x")]
    got = M.canonical_order(spark.createDataFrame(rows, "scene string, kind string, phase int, at int, cat string"), "scene", "kind", "phase", "at", "cat").orderBy("rank").collect()
    assert [tuple(r)[:5] for r in got] == sorted(rows, key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3], r[4]))


def test_audit(spark):
    rows = [("a", 1, 3, 0.5), ("a", 2, 1, 0.5), ("a", 3, 4, 2.5), ("a", 4, None, None), ("a", 5, 2, 2.0), ("b", 1, None, None), (None, 1, 5, 1.0)]
    gated = M.gated(spark.createDataFrame(rows, "seq string, frame int, markers int, error double"), "markers", "error")
    assert {(r.seq, r.frame): (r.raw_detected, r.detected, r.reject_reason) for r in gated.collect()} == {
        ("a", 1): (True, True, ""), ("a", 2): (True, False, "insufficient_inlier_markers"), ("a", 3): (True, False, "high_reprojection_error"),
        ("a", 4): (False, False, ""), ("a", 5): (True, True, ""), ("b", 1): (False, False, ""), (None, 1): (True, True, ""),
    }
    drift = spark.createDataFrame([("a", 0.25), (None, float("nan")), ("b", 8.0)], "seq string, drift double")
    each = M.audited(gated, "seq", "markers", "error", drift)
    by = {r.seq: r for r in each.collect()}
    assert len(by) == 3 and by["a"].drift == 0.25 and math.isnan(by[None].drift) and by["b"].mean_marker_count is None and by["a"].detection_coverage == 0.4
    one = M.audit_summary(each, ["mean_marker_count", "drift"]).first()
    assert (one.sequences, one.sequences_with_detections, one.total_frames, one.matched_frames, one.raw_detected_frames) == (3, 2, 7, 3, 5)
    assert one.mean_marker_count == pytest.approx((2.5 * 2 + 5) / 3) and one.drift == 0.25  # what is no number, or has no matched frame, has no weight
    none = M.audit_summary(each.limit(0), ["drift"]).first()
    assert (none.sequences, none.total_frames, none.detection_coverage, none.drift) == (0, 0, 0.0, None)


def slow_basket(p, g):
    e = np.log(np.maximum(p, 1e-6)) - np.log(np.maximum(g, 1e-6))
    ratio = np.maximum(p / g, g / p)
    return [np.mean(abs(p - g) / g), np.mean((p - g) ** 2 / g), np.sqrt(np.mean((p - g) ** 2)), np.sqrt(np.mean(e**2)), 100 * e.std(), np.mean(abs(np.log10(p) - np.log10(g))), np.mean(abs(p - g)),
            np.sqrt(np.mean((1 / p - 1 / g) ** 2)), np.mean(abs(1 / p - 1 / g)), *[np.mean(ratio < 1.25**k) for k in (1, 2, 3)]]


def test_depth_run_against_arrays(spark):
    rng = np.random.default_rng(5)
    truth = rng.uniform(0.2, 5.5, (6, 200))
    pred = truth * rng.uniform(0.6, 1.5, truth.shape)
    truth[0, :5], truth[1, 0], pred[0, 5:9] = np.nan, np.inf, [np.nan, -1.0, 0.0, np.inf]
    mask = rng.integers(0, 4, truth.shape)
    rows = [(f // 3, f, i, float(pred[f, i]), float(truth[f, i]), None if f == 5 else int(mask[f, i])) for f in range(6) for i in range(200)]
    pixels = spark.createDataFrame(rows, "cell int, frame int, i int, pred double, truth double, mask int")
    ready = D.prepared(pixels, ["cell"], "none")
    valid = np.isfinite(truth) & (truth > 0.3) & (truth < 5) & np.isfinite(pred) & (pred > 0)
    got = {(r.frame, r.stratum): r for r in D.frame_scores(ready, ["frame"], 20).collect()}
    strata = {"all": truth > 0, "near": truth < 1, "mid": (truth >= 1) & (truth < 3), "far": truth >= 3, "in_mask": mask > 0, "out_mask": mask == 0}
    want = {}
    for f in range(6):
        for name, where in strata.items():
            m = valid[f] & where[f] & (f != 5 or "mask" not in name)
            if m.sum() >= 20:
                want[f, name] = [m.sum(), *slow_basket(pred[f][m], truth[f][m])]
    assert set(got) == set(want)
    for k, v in want.items():
        assert [got[k].n_valid, *[got[k][c] for c in D.SCORES]] == pytest.approx(v)
    objects = {(r.frame, r.instance): r for r in D.object_scores(ready, ["frame"], 40, 45).collect()}
    for f in range(5):
        for k in (1, 2, 3):
            mine = mask[f] == k
            assert ((f, k) in objects) == (mine.sum() >= 45)
            if mine.sum() >= 45:
                o, m = objects[f, k], mine & valid[f]
                assert (o.n_pixels, o.n_valid) == (mine.sum(), m.sum()) and o.coverage == pytest.approx(m.sum() / mine.sum())
                assert o.abs_rel is None if m.sum() < 40 else [o[c] for c in D.SCORES] == pytest.approx(slow_basket(pred[f][m], truth[f][m]))
    holes = {r.frame: r for r in D.hole_scores(ready, ["frame"]).collect()}
    gone = ~np.isfinite(truth) | (truth <= 0.3)
    assert all(holes[f].overall == pytest.approx(gone[f].mean()) for f in range(6)) and holes[5].in_mask is None and holes[0].in_mask == pytest.approx(gone[0][mask[0] > 0].mean())
    fitted = D.prepared(pixels, ["cell"], "affine").filter("cell = 0 AND valid").collect()
    m = valid[:3]
    s, t = np.polyfit(pred[:3][m], truth[:3][m], 1)
    again = (truth[:3] > 0.3) & (truth[:3] < 5) & np.isfinite(pred[:3]) & (s * pred[:3] + t > 0)  # a prediction of zero may count once it is aligned
    assert {(r.frame, r.i): r.pred for r in fitted} == pytest.approx({(f, i): s * pred[f, i] + t for f in range(3) for i in range(200) if again[f, i]})
    overall = {(r.stratum, r.score): r for r in D.over_all(D.frame_scores(ready, ["frame"], 20), ["stratum"], ["rmse"]).collect()}
    assert overall["all", "rmse"].n == 6 and overall["all", "rmse"].mean == pytest.approx(np.mean([want[f, "all"][3] for f in range(6)]))
    assert D.frame_scores(ready.limit(0), ["frame"]).count() == 0


def test_scene_splits(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"splits": {"easy": ["s1", "s2"], "hard": [], "medium": ["s3"]}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"s1": "easy", "s4": "hard"}))
    assert {tuple(r) for r in S.read_scene_splits(spark, str(tmp_path / "a.json")).collect()} == {("s1", "easy"), ("s2", "easy"), ("s3", "medium")}
    assert {tuple(r) for r in S.read_scene_splits(spark, str(tmp_path / "b.json")).collect()} == {("s1", "easy"), ("s4", "hard")}


def test_broken_lines_are_numbered(spark, tmp_path):
    lines = [json.dumps({"id": i, "name": "n" * (i % 50)}) for i in range(3000)]
    lines[0], lines[7], lines[1500], lines[2999] = "{", "", '{"id": "no number"}', "[torn"
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "y.jsonl").write_text('{"id": 1}\n  \nnot json')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16000")  # a file in many blocks
    try:
        good, errors = S.read_jsonl_numbered(spark, str(tmp_path), "id long, name string")
        assert good.select(F.spark_partition_id()).distinct().count() > 5
        assert {(r.file[-7:], r.line, r.text) for r in errors.collect()} == {("x.jsonl", 1, "{"), ("x.jsonl", 1501, '{"id": "no number"}'), ("x.jsonl", 3000, "[torn"), ("y.jsonl", 3, "not json")}
        assert good.count() == 3000 - 4 + 1 and good.columns == ["id", "name"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_manifest_rows(spark):
    tasks = {"monocular_depth"}
    manifest = {"task": "monocular_depth", "root": "/data", "samples": [{"id": "a", "rgb": "1.png"}, {"id": "b", "phase": "clean", "rgb": None}]}
    got = S.manifest_rows(spark, manifest, tasks).orderBy("position").collect()
    assert [(r.id, r.rgb, r.phase, r.position, r.task, r.root) for r in got] == [("a", "1.png", None, 0, "monocular_depth", "/data"), ("b", None, "clean", 1, "monocular_depth", "/data")]
    assert S.manifest_rows(spark, manifest | {"samples": []}, tasks).count() == 0
    for wrong in ({"samples": []}, {"task": "x", "samples": []}, {"task": "monocular_depth"}, {"task": "monocular_depth", "samples": {}}):
        with pytest.raises(S.ManifestError):
            S.manifest_rows(spark, wrong, tasks)


def test_rows_to_samples(spark):
    turn = [0.0, -1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0]
    still = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
    still = [float(x) for x in still]
    rows = [(1, "a.png", turn, still, "clean", "", turn), (2, "b.png", turn, turn[:9], None, "easy", None), (3, None, turn, still, None, None, None), (4, "c.png", still, turn, "other", None, None)]
    df = spark.createDataFrame(rows, "id int, rgb string, pose_a array<double>, pose_b array<double>, phase string, difficulty string, camera_pose array<double>")
    got = {r.id: r for r in S.to_samples(df, "relative_camera_pose", PHASES, TIERS).collect()}
    assert {k: r.error for k, r in got.items()} == {"1": None, "2": "pose_b must have 16 numbers", "3": "no rgb", "4": "unknown phase"}
    back = np.linalg.inv(np.array(turn).reshape(4, 4))
    assert got["1"].ground_truth.motion == pytest.approx([*back[:3, :3].ravel(), *back[:3, 3]]) and got["1"].difficulty is None
    assert got["1"].camera_pose == [turn[:4], turn[4:8], turn[8:12], turn[12:]] and got["2"].ground_truth.motion is None
    boxes = S.to_samples(spark.createDataFrame([(1, "a", [1.0])], "id int, rgb string, boxes array<double>"), "object_detection", PHASES, TIERS).first()
    assert boxes.ground_truth.boxes == [1.0] and boxes.error is None and boxes.camera_pose is None
    for task in ("visual_grounding", "nothing"):
        with pytest.raises(S.ManifestError):
            S.to_samples(df, task, PHASES, TIERS)


def test_boxes_outside_the_image(spark):
    kinds = "type string, question string, answer string, scene_id string, kind string, phase int, frame int, img_w int, img_h int, box array<int>, target string, reference string, reference_shard string, reference_member string, crop_box array<int>, fact_key string"
    row = lambda box, phase, kind: ("t", "q", "a", "s", kind, phase, 5, 64, 48, box, "x", "y", None, None, [0, 0, 1, 1], "k")
    facts = spark.createDataFrame([row([0, 0, 63, 47], 2, "mos"), row([0, 0, 64, 47], 2, "mos"), row([5, 0, 4, 47], 2, "mos"), row(None, 2, "mos"), row([16, 12, 16, 12], None, "ego")], kinds)
    got = {r.kind: r for r in M.incontext_rows(facts, "r", "repo").collect()}
    import hashlib

    assert got["mos"].target_image.shard == "scenes/s/2/rgb.tar" and got["ego"].target_image.shard == "scenes/s/ego/rgb.tar" and got["ego"].reference_image.shard == ""
    assert got["ego"].sample_id == hashlib.sha256(b"t|s|ego|None|5|x|y|k").hexdigest()[:24] and got["ego"].answer_is_centered and got["mos"].answer_is_centered
    assert [tuple(r) for r in M.box_drops(facts).collect()] == [("t", "target_bbox_invalid", 3)]
