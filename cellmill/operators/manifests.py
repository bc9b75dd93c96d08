"""Manifests: frames of two releases as one table, pairs by difficulty, audits of sequences, question rows, and the order they are listed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmill.operators.pairs import first_offsets
from cellmill.operators.ranks import global_rank
from cellmill.roles import PHASES, TIERS

#: How far ahead a pair's second frame is looked for, and how many frames lie between first ones.
OFFSETS, STRIDE = (5, 10, 15, 20, 30, 45), 10


def unified_frames(frames: DataFrame, captures: DataFrame, splits: DataFrame, phased: str = "multi_object", names: tuple[str, ...] = PHASES) -> DataFrame:
    """Frames of recordings in phases or of single objects (scene_id, scene_type, phase, ...) and those of other captures (the same without phase, with
    view and capture_id) as one table, with view, capture_id, phase_index, phase_name, difficulty and rpx_ds. splits: scene_id, phase_index, difficulty,
    rpx_ds, place; of several rows of a phase that of the largest place counts. Only frames of `phased` recordings have a phase index, which is a
    number; a phase without a split, and every capture, has no difficulty. A column that one side lacks is null there."""
    last = splits.groupBy("scene_id", "phase_index").agg(F.max_by(F.struct("difficulty", F.expr("try_cast(rpx_ds AS double)").alias("rpx_ds")), "place").alias("__s"))
    known = last.select(F.col("scene_id").alias("__scene"), F.col("phase_index").cast("int").alias("__index"), "__s")
    inside = F.col("scene_type") == phased
    index = F.when(inside, F.expr("try_cast(phase AS int)"))
    own = frames.withColumn("phase_index", index).withColumn("view", F.when(inside, "phase").otherwise("object"))
    own = own.withColumn("capture_id", F.when(inside, F.concat(F.lit("phase"), F.col("phase_index").cast("string"))).otherwise(F.col("phase").cast("string")))
    name = F.when(F.col("phase_index") >= 0, F.get(F.array(*[F.lit(n) for n in names]), F.col("phase_index")))
    found = own.withColumn("phase_name", name).join(known, (F.col("scene_id") == F.col("__scene")) & (F.col("phase_index") == F.col("__index")), "left")
    placed = found.select(*frames.columns, "view", "capture_id", "phase_index", "phase_name", F.col("__s.difficulty").alias("difficulty"), F.col("__s.rpx_ds").alias("rpx_ds"))
    return placed.unionByName(captures.drop("phase"), allowMissingColumns=True)


def pair_manifest(frames: DataFrame, clip: list[str], frame: str, moved: Column, turned: Column, tiers: DataFrame, tier: str, move: tuple[float, float], turn: tuple[float, float], *carry: str, stride: int = STRIDE, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """Samples of the pair tasks: clip, tier, frame_a, frame_b. Every stride-th frame of a clip meets the first of the frames `offsets` places ahead
    that is within the limits (inclusive) of moved and turned, which are columns of the carried ones with _a and _b. Clips that are shorter than the
    largest offset, have no tier or one of another name are left out; tiers has one row a clip."""
    within = (moved.between(*move)) & turned.between(*turn)
    sizes = frames.groupBy(*clip).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max(offsets))
    wanted = tiers.filter(F.col(tier).isin(*TIERS)).select(*clip, F.col(tier).alias("difficulty")).join(sizes, clip).drop("__n")
    pairs = first_offsets(frames.join(wanted.select(*clip), clip, "left_semi"), clip, frame, offsets, stride, within, *carry)
    return pairs.join(wanted, clip).select(*clip, "difficulty", F.col("order_a").alias("frame_a"), F.col("order_b").alias("frame_b"))


def pair_entries(pairs: DataFrame, scene: str, phase: str, phase_name: Column) -> DataFrame:
    """Manifest entries of pairs: an id and the files of both frames."""
    file = lambda sub, frame, kind: F.concat(F.lit("scenes/"), F.col(scene).cast("string"), F.lit("/"), F.col(phase).cast("string"), F.lit(f"/{sub}/"), F.col(frame).cast("string"), F.lit(f".{kind}"))
    own = F.concat_ws("_", F.col(scene).cast("string"), phase_name, F.col("frame_a").cast("string"), F.col("frame_b").cast("string"))
    return pairs.select(
        own.alias("id"), F.col(scene).alias("scene"), phase_name.alias("phase"), "difficulty", file("rgb", "frame_a", "png").alias("rgb"), file("rgb", "frame_b", "png").alias("rgb_b"),
        file("pose", "frame_a", "npz").alias("pose_a"), file("pose", "frame_b", "npz").alias("pose_b"),
    )


def manifest_heads(entries: DataFrame) -> DataFrame:
    """The scenes of each difficulty's manifest with their number of samples; a difficulty without samples has no rows, and no manifest."""
    return entries.groupBy("difficulty", "scene", "phase").agg(F.count(F.lit(1)).alias("samples"))


def canonical_order(df: DataFrame, scene: str, kind: str, phase: str, index: str, catalog: str, *more: str) -> DataFrame:
    """df with rank and total in the order that listings have: by scene, kind, phase (null last), index, catalogue id, and what else tells rows apart."""
    return global_rank(df, scene, kind, F.col(phase).asc_nulls_last(), index, catalog, *more)


# -- audits of sequences ---------------------------------------------------------------------------------------------------

#: Markers that a board's pose needs, and the largest error of its reprojection in pixels.
MIN_MARKERS, MAX_REPROJECTION = 2, 2.0


def gated(frames: DataFrame, markers: str, error: str, least: int = MIN_MARKERS, most: float = MAX_REPROJECTION) -> DataFrame:
    """Frames with raw_detected (markers is not null), detected and the reason why a detection was refused (empty if it wasn't)."""
    seen = F.col(markers).isNotNull()
    reason = F.when(seen & (F.col(markers) < least), "insufficient_inlier_markers").when(seen & (F.col(error) > most), "high_reprojection_error").otherwise("")
    return frames.withColumn("raw_detected", seen).withColumn("reject_reason", reason).withColumn("detected", seen & (F.col("reject_reason") == ""))


def audited(frames: DataFrame, sequence: str, markers: str, error: str, scores: DataFrame | None = None) -> DataFrame:
    """One row a sequence of gated frames: total_frames, raw_detected_frames, matched_frames, both coverages, means of markers and error over matched
    frames (null without any), and the scores of its matched frames, such as those of motions.compare_tracks (sequence and a column each)."""
    n = F.count(F.lit(1))
    raw, matched = F.count_if("raw_detected"), F.count_if("detected")
    mine = lambda c: F.avg(F.when(F.col("detected"), F.col(c)))
    out = frames.groupBy(sequence).agg(
        n.alias("total_frames"), raw.alias("raw_detected_frames"), matched.alias("matched_frames"), (matched / n).alias("detection_coverage"), (raw / n).alias("raw_detection_coverage"),
        mine(markers).alias("mean_marker_count"), mine(error).alias("mean_reprojection_rmse_px"),
    )
    if scores is None:
        return out
    renamed = scores.withColumnRenamed(sequence, "__of")
    return out.join(renamed, F.col(sequence).eqNullSafe(F.col("__of")), "left").drop("__of")


def audit_summary(sequences: DataFrame, scores: list[str]) -> DataFrame:
    """One row over audited sequences: counts, coverages of all frames, and the scores' means weighted by matched frames; a score that no sequence with matched
    frames has is null."""
    total, matched, raw = (F.coalesce(F.sum(c), F.lit(0)) for c in ("total_frames", "matched_frames", "raw_detected_frames"))
    weight = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col("matched_frames"))
    mean = lambda c: F.try_divide(F.sum(F.nanvl(F.col(c).cast("double"), F.lit(0.0)) * weight(c)), F.sum(weight(c)))
    share = lambda part: part / F.greatest(total, F.lit(1))
    return sequences.agg(
        F.count(F.lit(1)).alias("sequences"), F.count_if(F.col("matched_frames") > 0).alias("sequences_with_detections"), total.alias("total_frames"), matched.alias("matched_frames"),
        raw.alias("raw_detected_frames"), share(matched).alias("detection_coverage"), share(raw).alias("raw_detection_coverage"), *[mean(c).alias(c) for c in scores],
    )


# -- rows of in-context questions ------------------------------------------------------------------------------------------

#: Fixed value: digits of a sample's id.
ID_DIGITS = 24


def sample_id(*parts: Column) -> Column:
    """The first digits of the SHA-256 of the parts, which a bar joins; a missing part reads None."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, ID_DIGITS)


def incontext_rows(facts: DataFrame, revision: str, repository: str) -> DataFrame:
    """Question rows of facts: type, question, answer, scene_id, kind, phase, frame, img_w, img_h, box (x1, y1, x2, y2), target, reference, reference_shard,
    reference_member, crop_box, fact_key. Adds an id, both images by shard and member, the middle of the answer in shares of the image, whether that is
    in the middle half of both axes, and a key by which repeats are found. A box that is no box inside the image gives no row; see box_drops."""
    x, y = ((F.col("box")[a] + F.col("box")[a + 2]) / 2 / F.col(size) for a, size in ((0, "img_w"), (1, "img_h")))
    part = F.when(F.col("kind") == "mos", F.col("phase").cast("string")).otherwise("ego")
    image = lambda shard, member, *more: F.struct(F.lit(repository).alias("repo_id"), F.lit(revision).alias("revision"), shard.alias("shard"), member.alias("member"), *more)
    fine = facts.filter(box_inside()).withColumn("answer_center_x_norm", x).withColumn("answer_center_y_norm", y)
    middle = F.col("answer_center_x_norm").between(0.25, 0.75) & F.col("answer_center_y_norm").between(0.25, 0.75)
    return fine.select(
        sample_id(*[F.col(c) for c in ("type", "scene_id", "kind", "phase", "frame", "target", "reference", "fact_key")]).alias("sample_id"),
        "type", "question", "answer", "scene_id", "kind", "phase", "frame", "img_w", "img_h", F.col("box").alias("answer_bbox"), "target", "reference",
        image(F.concat(F.lit("scenes/"), F.col("scene_id").cast("string"), F.lit("/"), part, F.lit("/rgb.tar")), F.concat(F.lit("rgb/"), F.col("frame").cast("string"), F.lit(".webp"))).alias("target_image"),
        image(F.coalesce("reference_shard", F.lit("")), F.coalesce("reference_member", F.lit("")), F.col("crop_box").alias("crop_bbox")).alias("reference_image"),
        "answer_center_x_norm", "answer_center_y_norm", middle.alias("answer_is_centered"), F.concat_ws("|", "type", "fact_key", F.col("target").cast("string"), F.col("reference").cast("string")).alias("dedup_key"),
    )


def box_inside() -> Column:
    """Whether box is ordered and inside the image; false if anything is missing."""
    b = F.col("box")
    return F.coalesce((b[0] >= 0) & (b[0] <= b[2]) & (b[2] < F.col("img_w")) & (b[1] >= 0) & (b[1] <= b[3]) & (b[3] < F.col("img_h")), F.lit(False))


def box_drops(facts: DataFrame) -> DataFrame:
    """type and reason of the facts that give no row, with their number."""
    return facts.filter(~box_inside()).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select("type", F.lit("target_bbox_invalid").alias("reason"), "n")
