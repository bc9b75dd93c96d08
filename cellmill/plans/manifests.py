"""Queries of manifests, audits, in-context rows, whole depth runs and files that are checked as they are read, with equal SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cellmill import roles
from cellmill.functions import kernels as K
from cellmill.operators import depth_runs as D
from cellmill.operators import manifests as M
from cellmill.plans import questions as Q
from cellmill.plans.cells import rounded
from cellmill.session import settle, shared_dir
from cellmill.sources.publish import Files
from cellmill.sources.tables import read_jsonl_numbered, read_scene_splits, table


def unified_frames(spark, sf):
    """Lines as frames of recordings, events as captures, parts as the splits of their phases."""
    phased = F.col("l_linestatus") == "O"
    frames = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("scene_id"), F.when(phased, "multi_object").otherwise("single_object").alias("scene_type"),
        F.when(phased, F.pmod("l_linenumber", F.lit(3)).cast("string")).otherwise(F.col("l_returnflag")).alias("phase"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame"),
    )
    captures = table(spark, sf, "events").select(F.col("user_id").alias("scene_id"), F.lit("ego").alias("scene_type"), F.col("event_id").alias("frame"), F.col("event_type").alias("view"), F.col("event_id").cast("string").alias("capture_id"))
    splits = table(spark, sf, "part").select(
        F.pmod("p_partkey", F.lit(97)).alias("scene_id"), F.pmod("p_size", F.lit(3)).alias("phase_index"), F.get(F.array(*map(F.lit, roles.TIERS)), F.pmod("p_partkey", F.lit(3)).cast("int")).alias("difficulty"),
        F.when(F.pmod("p_size", F.lit(5)) == 0, "").otherwise(F.col("p_size").cast("string")).alias("rpx_ds"), F.col("p_partkey").alias("place"),
    )
    return M.unified_frames(frames, captures, splits)


def _pairs(spark, sf):
    e = table(spark, sf, "embeddings").filter("label IS NOT NULL").select(F.col("label").alias("scene"), F.lit("0").alias("phase"), "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    size = F.sqrt(sum((F.pow(F.col("e")[i], F.lit(2)) for i in range(4)), F.lit(0.0)))
    frames = e.select("scene", "phase", "vec_id", *[(F.col("e")[i] / size).alias(f"q{i}") for i in range(4)], *[F.col("e")[8 + i].alias(f"t{i}") for i in range(3)])
    side = lambda kind, n, end: [F.col(f"{kind}{i}_{end}") for i in range(n)]
    moved, turned = K.translation_error(side("t", 3, "a"), side("t", 3, "b")), K.quaternion_angle(side("q", 4, "a"), side("q", 4, "b"))
    tiers = roles.scenes(spark, sf).select((F.col("scene") - 1).alias("scene"), F.lit("0").alias("phase"), "tier")
    names = [f"{k}{i}" for k, n in (("q", 4), ("t", 3)) for i in range(n)]
    return M.pair_manifest(frames, ["scene", "phase"], "vec_id", moved, turned, tiers, "tier", (0.05, 0.3), (2.0, 110.0), *names, stride=3, offsets=(1, 2, 3, 5, 8, 13))


def pair_manifest(spark, sf):
    """Entries of pairs of a label's vectors whose poses are not too near and not too far apart."""
    return M.pair_entries(_pairs(spark, sf), "scene", "phase", F.lit(roles.PHASES[0]))


def pair_manifest_heads(spark, sf):
    return M.manifest_heads(_pairs(spark, sf))


def canonical_order(spark, sf):
    """Place of every line in the order of listings; lines of open orders have no phase."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", F.when(F.col("l_linestatus") == "F", F.pmod("l_orderkey", F.lit(3))).alias("phase"), "l_linenumber", "l_partkey", "l_orderkey")
    return M.canonical_order(li, "l_suppkey", "l_returnflag", "phase", "l_linenumber", "l_partkey", "l_orderkey").select("l_orderkey", "l_linenumber", "rank")


def _gated(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("value") >= 20, F.pmod(F.floor("value"), F.lit(5))).alias("markers"), (F.col("value") / 60).alias("error"))
    return M.gated(e, "markers", "error")


def sequence_gate(spark, sf):
    """Frames that a detector saw, and why it was not believed."""
    return _gated(spark, sf).select("event_id", "raw_detected", "detected", "reject_reason")


AUDITED = ["mean_marker_count", "mean_reprojection_rmse_px"]


def sequence_audit(spark, sf):
    return rounded(M.audited(_gated(spark, sf), "user_id", "markers", "error"))


def audit_summary(spark, sf):
    """All sequences in one row, weighted by their matched frames."""
    return rounded(M.audit_summary(M.audited(_gated(spark, sf), "user_id", "markers", "error"), AUDITED))


def _facts(spark, sf):
    r = Q.incontext_reference(spark, sf)
    n = lambda c, m: F.pmod(c, F.lit(m)).cast("int")
    mos = n("frame", 2) == 0
    x, y = n("item", 64), n(F.col("item") * 7, 48)
    other = F.col("reference").cast("string")
    return r.select(
        F.lit("inctx_attribute").alias("type"), F.lit("Which object shares this brand?").alias("question"), F.col("item").cast("string").alias("answer"), n("frame", 100).alias("scene_id"),
        F.when(mos, "mos").otherwise("ego").alias("kind"), F.when(mos, n("frame", 3)).alias("phase"), "frame", F.lit(64).alias("img_w"), F.lit(48).alias("img_h"),
        F.array(x, y, x + n("frame", 9), y + n("reference", 7)).alias("box"), F.col("item").alias("target"), "reference",
        F.when(n("reference", 5) > 0, F.concat(F.lit("objects/"), other, F.lit("/rgb.tar"))).alias("reference_shard"), F.concat(F.lit("rgb/"), other, F.lit(".webp")).alias("reference_member"),
        F.array(F.lit(0), F.lit(0), n("reference", 9), n("reference", 7)).alias("crop_box"), F.concat(F.lit("brand:"), "value").alias("fact_key"),
    )


def incontext_rows(spark, sf):
    """Rows of the questions that refer to a brand by another object's picture."""
    rows = M.incontext_rows(_facts(spark, sf), "r1", "own/frames")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rounded(rows.select(
        "sample_id", "target", "reference", "kind", "phase", joined("answer_bbox").alias("answer_bbox"), F.col("target_image.shard").alias("target_shard"), F.col("target_image.member").alias("target_member"),
        F.col("reference_image.shard").alias("reference_shard"), joined("reference_image.crop_bbox").alias("crop_bbox"), "answer_center_x_norm", "answer_center_y_norm", "answer_is_centered", "dedup_key",
    ))


def incontext_drops(spark, sf):
    """Facts whose box leaves the image."""
    return M.box_drops(_facts(spark, sf))


LEAST, LEAST_OBJECT = 4, 16


def _depth_rows(spark, sf):
    e = table(spark, sf, "embeddings").filter("label IS NOT NULL").select("label", "vec_id", F.posexplode("embedding").alias("i", "v"))
    truth = F.abs(F.col("v").cast("double")) * 14
    pixels = e.select("label", "vec_id", "i", F.floor(F.col("i") / 16).cast("int").alias("mask"), truth.alias("truth"), (truth * 0.9 + F.pmod("i", F.lit(3)) * 0.1 + 0.05).alias("pred"))
    return settle(D.prepared(pixels, ["label"], "affine"))


def depth_run_frames(spark, sf):
    """Scores of each frame, by band and mask, after one fit a cell."""
    return rounded(D.frame_scores(_depth_rows(spark, sf), ["label", "vec_id"], LEAST), 5)


def depth_run_objects(spark, sf):
    """Scores of the objects in a frame, each of which weighs the same."""
    return rounded(D.object_means(D.object_scores(_depth_rows(spark, sf), ["label", "vec_id"], LEAST, LEAST_OBJECT), ["label", "vec_id"]), 5)


def depth_run_holes(spark, sf):
    return rounded(D.hole_scores(_depth_rows(spark, sf), ["vec_id"]), 5)


def depth_run_summary(spark, sf):
    """Every score over all frames that have it, by stratum, with intervals."""
    return rounded(D.over_all(D.frame_scores(_depth_rows(spark, sf), ["label", "vec_id"], LEAST), ["stratum"], list(D.SCORES)), 5)


def _written(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scene_splits_file(spark, sf):
    """Scenes by tier, written as one document and read again."""
    place = _written(spark, "splits")
    by_tier = roles.scenes(spark, sf).groupBy("tier").agg(F.collect_list(F.col("scene").cast("string")).alias("scenes"))
    whole = by_tier.agg(F.map_from_entries(F.collect_list(F.struct("tier", "scenes"))).alias("splits"))
    whole.select(F.to_json(F.struct("splits")).alias("value")).write.text(place)
    rows = settle(read_scene_splits(spark, place))
    Files(spark, place).delete(place)
    return rows.select(F.col("scene").cast("long").alias("scene"), "tier")


def broken_lines(spark, sf):
    """Customers as JSON lines, a file a nation, some of them torn and some blank: where the torn ones are."""
    place = _written(spark, "lines")
    line = F.to_json(F.struct("c_custkey", "c_name"))
    torn = F.when(F.pmod("c_custkey", F.lit(11)) == 0, F.substring(line, 1, 9)).when(F.pmod("c_custkey", F.lit(7)) == 0, "").otherwise(line)
    lines = table(spark, sf, "customer").select("c_nationkey", "c_custkey", torn.alias("value"))
    ordered = lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "value")
    ordered.write.partitionBy("c_nationkey").text(place)
    _, errors = read_jsonl_numbered(spark, place, "c_custkey long, c_name string")
    rows = settle(errors.select(F.regexp_extract("file", r"c_nationkey=(\d+)", 1).cast("long").alias("nation"), F.col("line").cast("long").alias("line"), "text"))
    Files(spark, place).delete(place)
    return rows


QUERIES = {f.__name__: f for f in (
    unified_frames, pair_manifest, pair_manifest_heads, canonical_order, sequence_gate, sequence_audit, audit_summary, incontext_rows, incontext_drops,
    depth_run_frames, depth_run_objects, depth_run_holes, depth_run_summary, scene_splits_file, broken_lines,
)}

_PAIRS = f"""{roles.SCENES_SQL},
    f AS (
        SELECT label, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n
        FROM embeddings WHERE label IS NOT NULL),
    g AS (SELECT f.*, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3] + e[4] * e[4]) AS size, tier FROM f JOIN scenes ON scene = label + 1 WHERE n > 13),
    tried AS (SELECT *, unnest([1, 2, 3, 5, 8, 13]) AS step FROM g WHERE k % 3 = 0),
    met AS (
        SELECT a.label, a.tier, a.vec_id AS frame_a, b.vec_id AS frame_b, step,
            sqrt((a.e[9] - b.e[9]) * (a.e[9] - b.e[9]) + (a.e[10] - b.e[10]) * (a.e[10] - b.e[10]) + (a.e[11] - b.e[11]) * (a.e[11] - b.e[11])) AS moved,
            degrees(2 * acos(least(abs((a.e[1] * b.e[1] + a.e[2] * b.e[2] + a.e[3] * b.e[3] + a.e[4] * b.e[4]) / (a.size * b.size)), 1))) AS turned
        FROM tried a JOIN g b ON b.label = a.label AND b.k = a.k + a.step),
    pairs AS (
        SELECT label, tier AS difficulty, frame_a, arg_min(frame_b, step) AS frame_b FROM met
        WHERE moved BETWEEN CAST(0.05 AS DOUBLE) AND CAST(0.3 AS DOUBLE) AND turned BETWEEN 2 AND 110 GROUP BY label, tier, frame_a)"""
_GATE = """gate AS (
        SELECT *, CASE WHEN markers < 2 THEN 'insufficient_inlier_markers' WHEN markers IS NOT NULL AND error > 2 THEN 'high_reprojection_error' ELSE '' END AS reject_reason
        FROM (SELECT user_id, event_id, CASE WHEN value >= 20 THEN CAST(floor(value) AS BIGINT) % 5 END AS markers, value / 60 AS error FROM events)),
    gated AS (SELECT *, markers IS NOT NULL AS raw_detected, markers IS NOT NULL AND reject_reason = '' AS detected FROM gate),
    audited AS (
        SELECT user_id, count(*) AS total_frames, count(*) FILTER (WHERE raw_detected) AS raw_detected_frames, count(*) FILTER (WHERE detected) AS matched_frames,
            avg(markers) FILTER (WHERE detected) AS mean_marker_count, avg(error) FILTER (WHERE detected) AS mean_reprojection_rmse_px
        FROM gated GROUP BY user_id)"""
_FACTS = f"""facts AS (
        SELECT *, item % 64 AS x1, item * 7 % 48 AS y1, item % 64 + frame % 9 AS x2, item * 7 % 48 + reference % 7 AS y2, frame % 2 = 0 AS mos FROM ({Q.ORACLE_SQL["incontext_reference"]}))"""
_BASKET = """avg(abs(p - g) / g) AS abs_rel, avg((p - g) * (p - g) / g) AS sq_rel, sqrt(avg((p - g) * (p - g))) AS rmse, sqrt(avg((ln(p) - ln(g)) * (ln(p) - ln(g)))) AS rmse_log,
    100 * stddev_pop(ln(p) - ln(g)) AS silog, avg(abs(log10(p) - log10(g))) AS log10, avg(abs(p - g)) AS mae, sqrt(avg((1 / p - 1 / g) * (1 / p - 1 / g))) AS irmse, avg(abs(1 / p - 1 / g)) AS imae,
    avg(CASE WHEN greatest(p / g, g / p) < CAST(1.25 AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS delta1, avg(CASE WHEN greatest(p / g, g / p) < CAST(1.5625 AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS delta2,
    avg(CASE WHEN greatest(p / g, g / p) < CAST(1.953125 AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS delta3"""
_ROUND = ", ".join(f"round({s}, 5) AS {s}" for s in D.SCORES)
_DEPTH = f"""raw AS (
        SELECT label, vec_id, i, i // 16 AS mask, abs(CAST(embedding[i + 1] AS DOUBLE)) * 14 AS g, abs(CAST(embedding[i + 1] AS DOUBLE)) * 14 * CAST(0.9 AS DOUBLE) + (i % 3) * CAST(0.1 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS q
        FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE label IS NOT NULL),
    fit AS (SELECT label, regr_slope(g, q) AS s, regr_intercept(g, q) AS t FROM raw WHERE g > CAST(0.3 AS DOUBLE) AND g < 5 AND q > 0 GROUP BY label),
    px AS (SELECT label, vec_id, i, mask, g, q * s + t AS p, g > CAST(0.3 AS DOUBLE) AND g < 5 AND q * s + t > 0 AS valid FROM raw JOIN fit USING (label))"""
_STRATA = f"""strata AS (
        SELECT label, vec_id, p, g, unnest(list_filter([
            'all', CASE WHEN g < 1 THEN 'near' WHEN g < 3 THEN 'mid' ELSE 'far' END, CASE WHEN mask > 0 THEN 'in_mask' ELSE 'out_mask' END], lambda s: s IS NOT NULL)) AS stratum
        FROM px WHERE valid),
    scored AS (SELECT label, vec_id, stratum, count(*) AS n_valid, {_BASKET} FROM strata GROUP BY label, vec_id, stratum HAVING count(*) >= {LEAST})"""
ORACLE_SQL: dict[str, str] = {
    "unified_frames": """WITH s AS (
            SELECT p_partkey % 97 AS scene_id, p_size % 3 AS phase_index, arg_max(list_extract(['easy', 'medium', 'hard'], p_partkey % 3 + 1), p_partkey) AS difficulty,
                arg_max(CASE WHEN p_size % 5 = 0 THEN -1 ELSE p_size END, p_partkey) AS ds FROM part GROUP BY ALL),
        f AS (
            SELECT l_suppkey AS scene_id, CASE WHEN l_linestatus = 'O' THEN 'multi_object' ELSE 'single_object' END AS scene_type, CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber % 3 AS VARCHAR) ELSE l_returnflag END AS phase,
                l_orderkey * 10 + l_linenumber AS frame, CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber % 3 AS INT) END AS phase_index FROM lineitem)
        SELECT f.scene_id, scene_type, phase, frame, CASE WHEN f.phase_index IS NULL THEN 'object' ELSE 'phase' END AS view, CASE WHEN f.phase_index IS NULL THEN phase ELSE 'phase' || f.phase_index END AS capture_id,
            f.phase_index, list_extract(['clutter', 'interaction', 'clean'], f.phase_index + 1) AS phase_name, difficulty, CASE WHEN ds >= 0 THEN CAST(ds AS DOUBLE) END AS rpx_ds
        FROM f LEFT JOIN s ON s.scene_id = f.scene_id AND s.phase_index = f.phase_index
        UNION ALL SELECT user_id, 'ego', NULL, event_id, event_type, CAST(event_id AS VARCHAR), NULL, NULL, NULL, NULL FROM events""",
    "pair_manifest": f"""WITH {_PAIRS} SELECT label || '_clutter_' || frame_a || '_' || frame_b AS id, label AS scene, 'clutter' AS phase, difficulty, 'scenes/' || label || '/0/rgb/' || frame_a || '.png' AS rgb,
        'scenes/' || label || '/0/rgb/' || frame_b || '.png' AS rgb_b, 'scenes/' || label || '/0/pose/' || frame_a || '.npz' AS pose_a, 'scenes/' || label || '/0/pose/' || frame_b || '.npz' AS pose_b FROM pairs""",
    "pair_manifest_heads": f"WITH {_PAIRS} SELECT difficulty, label AS scene, '0' AS phase, count(*) AS samples FROM pairs GROUP BY ALL",
    "canonical_order": """SELECT l_orderkey, l_linenumber, row_number() OVER (
            ORDER BY l_suppkey, l_returnflag, CASE WHEN l_linestatus = 'F' THEN l_orderkey % 3 END NULLS LAST, l_linenumber, l_partkey, l_orderkey) AS rank FROM lineitem""",
    "sequence_gate": f"WITH {_GATE} SELECT event_id, raw_detected, detected, reject_reason FROM gated",
    "sequence_audit": f"""WITH {_GATE} SELECT user_id, total_frames, raw_detected_frames, matched_frames, round(matched_frames / total_frames, 6) AS detection_coverage,
        round(raw_detected_frames / total_frames, 6) AS raw_detection_coverage, round(mean_marker_count, 6) AS mean_marker_count, round(mean_reprojection_rmse_px, 6) AS mean_reprojection_rmse_px FROM audited""",
    "audit_summary": f"""WITH {_GATE}, s AS (
            SELECT count(*) AS sequences, count(*) FILTER (WHERE matched_frames > 0) AS sequences_with_detections, CAST(sum(total_frames) AS BIGINT) AS total_frames, CAST(sum(matched_frames) AS BIGINT) AS matched_frames,
                CAST(sum(raw_detected_frames) AS BIGINT) AS raw_detected_frames, sum(mean_marker_count * matched_frames) / sum(matched_frames) AS m, sum(mean_reprojection_rmse_px * matched_frames) / sum(matched_frames) AS r FROM audited)
        SELECT sequences, sequences_with_detections, total_frames, matched_frames, raw_detected_frames, round(matched_frames / total_frames, 6) AS detection_coverage,
            round(raw_detected_frames / total_frames, 6) AS raw_detection_coverage, round(m, 6) AS mean_marker_count, round(r, 6) AS mean_reprojection_rmse_px FROM s""",
    "incontext_rows": f"""WITH {_FACTS}, c AS (SELECT *, (x1 + x2) / CAST(2 AS DOUBLE) / 64 AS cx, (y1 + y2) / CAST(2 AS DOUBLE) / 48 AS cy, CASE WHEN mos THEN frame % 3 END AS phase FROM facts WHERE x2 < 64 AND y2 < 48)
        SELECT substr(sha256(concat_ws('|', 'inctx_attribute', frame % 100, CASE WHEN mos THEN 'mos' ELSE 'ego' END, coalesce(CAST(phase AS VARCHAR), 'None'), frame, item, reference, 'brand:' || value)), 1, 24) AS sample_id,
            item AS target, reference, CASE WHEN mos THEN 'mos' ELSE 'ego' END AS kind, CAST(phase AS INT) AS phase, concat_ws(',', x1, y1, x2, y2) AS answer_bbox,
            'scenes/' || frame % 100 || '/' || CASE WHEN mos THEN CAST(phase AS VARCHAR) ELSE 'ego' END || '/rgb.tar' AS target_shard, 'rgb/' || frame || '.webp' AS target_member,
            CASE WHEN reference % 5 > 0 THEN 'objects/' || reference || '/rgb.tar' ELSE '' END AS reference_shard, concat_ws(',', 0, 0, reference % 9, reference % 7) AS crop_bbox,
            round(cx, 6) AS answer_center_x_norm, round(cy, 6) AS answer_center_y_norm, cx BETWEEN CAST(0.25 AS DOUBLE) AND CAST(0.75 AS DOUBLE) AND cy BETWEEN CAST(0.25 AS DOUBLE) AND CAST(0.75 AS DOUBLE) AS answer_is_centered,
            concat_ws('|', 'inctx_attribute', 'brand:' || value, item, reference) AS dedup_key FROM c""",
    "incontext_drops": f"WITH {_FACTS} SELECT 'inctx_attribute' AS type, 'target_bbox_invalid' AS reason, count(*) AS n FROM facts WHERE NOT (x2 < 64 AND y2 < 48) HAVING count(*) > 0",
    "depth_run_frames": f"WITH {_DEPTH}, {_STRATA} SELECT label, vec_id, stratum, n_valid, {_ROUND} FROM scored",
    "depth_run_objects": f"""WITH {_DEPTH},
        o AS (SELECT label, vec_id, mask, count(*) AS n_pixels, count(*) FILTER (WHERE valid) AS n_valid FROM px WHERE mask > 0 GROUP BY ALL HAVING count(*) >= {LEAST_OBJECT}),
        b AS (SELECT label, vec_id, mask, {_BASKET} FROM px WHERE mask > 0 AND valid GROUP BY ALL HAVING count(*) >= {LEAST})
        SELECT label, vec_id, count(*) AS n_objects, round(avg(n_valid / n_pixels), 5) AS mean_coverage, round(avg(n_pixels), 5) AS mean_n_pixels, {", ".join(f"round(avg({s}), 5) AS {s}" for s in D.SCORES)}
        FROM o LEFT JOIN b USING (label, vec_id, mask) GROUP BY label, vec_id""",
    "depth_run_holes": f"""WITH {_DEPTH}, h AS (SELECT vec_id, mask, CASE WHEN g <= CAST(0.3 AS DOUBLE) THEN 1.0 ELSE 0.0 END AS hole FROM px)
        SELECT vec_id, round(avg(hole), 5) AS overall, round(avg(hole) FILTER (WHERE mask > 0), 5) AS in_mask, round(avg(hole) FILTER (WHERE mask = 0), 5) AS out_mask FROM h GROUP BY vec_id""",
    "depth_run_summary": f"""WITH {_DEPTH}, {_STRATA}, long AS (UNPIVOT (SELECT stratum, {", ".join(f"CAST({s} AS DOUBLE) AS {s}" for s in D.SCORES)} FROM scored) ON {", ".join(D.SCORES)} INTO NAME score VALUE v),
        s AS (SELECT stratum, score, count(*) AS n, avg(v) AS m, median(v) AS md, coalesce(stddev_samp(v), 0) AS sd, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95 FROM long GROUP BY ALL)
        SELECT stratum, score, n, round(m, 5) AS mean, round(md, 5) AS median, round(sd, 5) AS std, round(p5, 5) AS p5, round(p95, 5) AS p95, round(m - CAST(1.96 AS DOUBLE) * sd / sqrt(n), 5) AS ci95_low,
            round(m + CAST(1.96 AS DOUBLE) * sd / sqrt(n), 5) AS ci95_high FROM s""",
    "scene_splits_file": f"WITH {roles.SCENES_SQL} SELECT scene, tier FROM scenes",
    "broken_lines": """WITH l AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line FROM customer)
        SELECT CAST(nation AS BIGINT) AS nation, line, substr('{"c_custkey":' || c_custkey, 1, 9) AS text FROM l WHERE c_custkey % 11 = 0""",
}
