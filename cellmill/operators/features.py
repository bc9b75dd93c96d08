"""Features of a recording (scene, phase) from its pixels, poses and annotation rounds: the input of difficulty scoring.

Pixels are rows: keys, frame, x, y, object (0 for the background), depth (metres; 0 or less is no measurement) and luma (0 to 255). A
frame's pixels are shuffled once, by keys and frame; all that follows is aggregated from rows a frame or a frame and object. Rules are
those of the published feature set: shares and deviations a frame, then means over frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmill.functions.kernels import dot, norm
from cellmill.operators.sequences import mad_clip, stability

#: Luma above which a pixel is a highlight, and below which it is dark; share of overlap that is heavy.
BRIGHT, DARK, HEAVY = 230, 30, 0.3


def _share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def neighbours(pixels: DataFrame, frame: list[str], width: int, height: int, value: str = "luma") -> DataFrame:
    """pixels with the wrapped Laplacian `lap` and the gradient magnitude `grad` of whole frames of that size, in one window a frame."""
    w = W.partitionBy(*frame).orderBy("y", "x")
    at = lambda k: F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)
    left = F.when(F.col("x") == 0, at(width - 1)).otherwise(at(-1))
    right = F.when(F.col("x") == width - 1, at(1 - width)).otherwise(at(1))
    up = F.when(F.col("y") == 0, at(width * (height - 1))).otherwise(at(-width))
    down = F.when(F.col("y") == height - 1, at(-width * (height - 1))).otherwise(at(width))
    own = F.col(value)
    slope = lambda low, high, c, last: F.when(F.col(c) == 0, high - own).when(F.col(c) == last, own - low).otherwise((high - low) / 2)
    gx, gy = slope(left, right, "x", width - 1), slope(up, down, "y", height - 1)
    return pixels.withColumn("lap", left + right + up + down - 4.0 * own).withColumn("grad", F.sqrt(gx * gx + gy * gy))


def image_features(pixels: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Depth holes and noise (all pixels, and those of objects), highlights and darkness at holes, sharpness and texture."""
    hole, inside = F.col("depth") <= 0, F.col("object") > 0
    frames = neighbours(pixels, [*keys, "frame"], width, height).groupBy(*keys, "frame").agg(
        _share(hole).alias("depth_invalid"), F.avg(F.when(inside, hole.cast("double"))).alias("depth_invalid_mask"),
        F.stddev_pop(F.when(~hole, F.col("depth"))).alias("depth_std"), F.stddev_pop(F.when(~hole & inside, F.col("depth"))).alias("depth_std_mask"),
        _share((F.col("luma") > BRIGHT) & hole).alias("specular"), _share((F.col("luma") < DARK) & hole).alias("dark"),
        F.var_pop("lap").alias("rgb_blur"), F.avg("grad").alias("rgb_texture"),
    )
    names = ("depth_invalid", "depth_invalid_mask", "depth_std", "depth_std_mask", "specular", "dark", "rgb_blur", "rgb_texture")
    return frames.groupBy(*keys).agg(*[_zero(F.avg(n)).alias(n) for n in names])


def object_boxes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame, object, area and the inclusive box of every visible object."""
    seen = pixels.filter("object > 0").groupBy(*keys, "frame", "object")
    return seen.agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"))


def occlusion_features(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Share of an object's box that boxes of other objects cover (summed), a frame; mean over its frames; then over objects."""
    other = boxes.select(*keys, "frame", *[F.col(c).alias(f"{c}_o") for c in ("object", "x1", "y1", "x2", "y2")])
    side = lambda c: F.greatest(F.least(f"{c}2", f"{c}2_o") - F.greatest(f"{c}1", f"{c}1_o"), F.lit(0))
    covered = F.when(F.col("object") != F.col("object_o"), side("x") * side("y")).otherwise(0)  # an object meets itself, so lone ones stay
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    each = boxes.join(other, [*keys, "frame"]).groupBy(*keys, "frame", "object").agg((F.sum(covered) / F.max(size)).alias("cover"))
    mean = each.groupBy(*keys, "object").agg(F.avg("cover").alias("cover"))
    return mean.groupBy(*keys).agg(F.avg("cover").alias("occ_mean"), F.percentile("cover", 0.9).alias("occ_p90"), _share(F.col("cover") > HEAVY).alias("occ_heavy"))


def object_features(frames: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of objects a frame, sizes of objects, and how these change. frames: keys, frame, pixels (their number)."""
    counted = frames.join(boxes.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("n")), [*keys, "frame"], "left").fillna(0, ["n"])
    total = boxes.groupBy(*keys).agg(F.countDistinct("object").alias("objects"))
    complete = _share(F.col("n") == F.col("objects"))
    numbers = counted.join(total, keys, "left").groupBy(*keys).agg(F.avg("n").alias("obj_mean"), F.stddev_pop("n").alias("obj_std"), complete.alias("obj_consist"), F.max("pixels").alias("pixels"))
    sizes = boxes.groupBy(*keys, "object").agg(F.avg("area").alias("area")).groupBy(*keys).agg(F.avg("area").alias("area"), F.stddev_pop("area").alias("spread"))
    grid = frames.select(*keys, "frame").join(boxes.select(*keys, "object").distinct(), keys).join(boxes.select(*keys, "frame", "object", "area"), [*keys, "frame", "object"], "left")
    steady = stability(grid.withColumn("area", F.coalesce(F.col("area").cast("double"), F.lit(0.0))), keys, "object", ["frame"], "area")
    joined = numbers.join(sizes, keys, "left").join(steady, keys, "left")
    share = lambda c: _zero(F.col(c) / F.col("pixels"))
    return joined.select(
        *keys, "obj_mean", "obj_std", "obj_consist", share("area").alias("mask_area_mean"), share("spread").alias("mask_area_std"),
        *[_zero(F.col(c)).alias(c) for c in ("area_cv", "area_drop", "vis_instability")],
    )


def motion_features(poses: DataFrame, keys: list[str], position: list[str], quaternion: list[str]) -> DataFrame:
    """Step lengths and turns between frames, with jumps replaced by the median, and the mean change of the step length."""
    w = W.partitionBy(*keys).orderBy("frame")
    before = lambda c: F.lag(c).over(w)
    q = [F.col(c) for c in quaternion]
    named = poses.select(*keys, "frame", norm([F.col(c) - before(c) for c in position]).alias("step"), *q, *[before(c).alias(f"{c}_b") for c in quaternion])
    b = [F.col(f"{c}_b") for c in quaternion]
    sizes = norm(q) * norm(b)
    turn = F.when(sizes > 0, 2 * F.acos(F.least(F.abs(dot(q, b)) / F.nullif(sizes, F.lit(0.0)), F.lit(1.0)))).otherwise(0.0)
    steps = named.withColumn("turn", turn).filter("step IS NOT NULL").select(*keys, "frame", "step", "turn")
    clipped = mad_clip(steps, keys, "step").select(*keys, "frame", F.col("clipped").alias("step")).join(mad_clip(steps, keys, "turn").select(*keys, "frame", F.col("clipped").alias("turn")), [*keys, "frame"])
    jerk = clipped.withColumn("jerk", F.abs(F.col("step") - F.lag("step").over(w)))
    found = jerk.groupBy(*keys).agg(
        F.avg("step").alias("trans_mean"), F.percentile("step", 0.9).alias("trans_p90"), F.avg("turn").alias("rot_mean"), F.percentile("turn", 0.9).alias("rot_p90"), _zero(F.avg("jerk")).alias("jerk")
    )
    return poses.select(*keys).distinct().join(found, keys, "left").fillna(0.0, ["trans_mean", "trans_p90", "rot_mean", "rot_p90", "jerk"])


def effort_features(frames: DataFrame, faulty: DataFrame, keys: list[str]) -> DataFrame:
    """Rounds that a frame took: one, and one more for every round that lists it. faulty: keys, round, frame."""
    listed = faulty.select(*keys, "round", "frame").distinct().groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("n"))
    rounds = 1 + F.coalesce("n", F.lit(0))
    return frames.join(listed, [*keys, "frame"], "left").groupBy(*keys).agg(F.avg(rounds).alias("iter_mean"), F.max(rounds).cast("double").alias("iter_max"))


FISHEYE = ("fisheye_dark", "fisheye_bright", "fisheye_sharpness", "fisheye_corr", "fisheye_texture")


def fisheye_features(pairs: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Exposure, sharpness, left-right correlation and texture. pairs: keys, frame, x, y, left, right (null without a right image)."""
    frames = neighbours(pairs, [*keys, "frame"], width, height, "left").groupBy(*keys, "frame").agg(
        _share(F.col("left") < DARK).alias("fisheye_dark"), _share(F.col("left") > BRIGHT).alias("fisheye_bright"), F.var_pop("lap").alias("fisheye_sharpness"),
        F.corr("left", "right").alias("fisheye_corr"), F.avg("grad").alias("fisheye_texture"),
    )
    fine = F.when(~F.isnan("fisheye_corr"), F.col("fisheye_corr"))  # a constant image has none
    return frames.withColumn("fisheye_corr", fine).groupBy(*keys).agg(*[_zero(F.avg(n)).alias(n) for n in FISHEYE])


def phase_features(pixels: DataFrame, poses: DataFrame, faulty: DataFrame, fisheye: DataFrame, keys: list[str], size: tuple[int, int], fisheye_size: tuple[int, int], position: list[str], quaternion: list[str]) -> DataFrame:
    """All features of every recording that has pixels, a column each; those of the fisheye cameras are NaN where it has no such images."""
    frames = pixels.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("pixels"))
    boxes = object_boxes(pixels, keys)
    out = image_features(pixels, keys, *size)
    for part in (object_features(frames, boxes, keys), occlusion_features(boxes, keys), motion_features(poses, keys, position, quaternion), effort_features(frames, faulty, keys)):
        out = out.join(part, keys, "left")
    out = out.join(fisheye_features(fisheye, keys, *fisheye_size), keys, "left")
    rest = [c for c in out.columns if c not in keys and c not in FISHEYE]
    return out.select(*keys, *[_zero(F.col(c)).alias(c) for c in rest], *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in FISHEYE])
