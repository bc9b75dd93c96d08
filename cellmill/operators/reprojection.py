"""Temporal scores of depth clips with DataFrame functions: warping along a given flow, and reprojection as a scatter and a join.

A frame is a row with arrays of pixels, row by row. No frame is handed to Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmill.functions import kernels as K

#: Bands of true depth in metres, lower end included.
BANDS = {"near": (0.3, 1.0), "mid": (1.0, 2.5), "far": (2.5, 5.0)}


def _good(depth: Column) -> Column:
    return F.coalesce((depth > 0) & (depth < float("inf")) & ~F.isnan(depth), F.lit(False))


def _bilinear(depth: Column, x: Column, y: Column, width: int, height: int) -> Column:
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(width - 1)), F.least(y0 + 1, F.lit(height - 1))
    at = lambda v, u: F.get(depth, v * width + u)
    fx, fy = x - x0, y - y0
    return (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy


def warping_errors(frames: DataFrame, clip: list[str], frame: str, depth: str, flow_x: str, flow_y: str, width: int, height: int) -> DataFrame:
    """clip columns, pairs and opw: the mean relative difference between each frame of a clip and the one before it, sampled along the flow that
    leads back from the frame's pixels. Pixels that the flow leads outside, and depths that aren't positive and finite, don't count; nor do
    pairs without any pixel. A clip without pairs has null."""
    before = F.lag(depth).over(W.partitionBy(*clip).orderBy(frame))

    def error(i: Column) -> Column:
        x, y = i % width + F.get(flow_x, i), F.floor(i / width) + F.get(flow_y, i)
        inside = (x >= 0) & (y >= 0) & (x <= width - 1) & (y <= height - 1)
        moved, now = _bilinear(F.col("__before"), x, y, width, height), F.get(depth, i)
        return F.when(inside & _good(moved) & _good(now), F.abs(moved - now) / now)

    errors = F.filter(F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), error), lambda e: e.isNotNull())
    pairs = frames.withColumn("__before", before).withColumn("__errors", F.when(F.col("__before").isNotNull(), errors))
    mean = F.when(F.size("__errors") > 0, F.aggregate("__errors", F.lit(0.0), lambda a, e: a + e) / F.size("__errors"))
    return pairs.withColumn("__mean", mean).groupBy(*clip).agg(F.count("__mean").alias("pairs"), F.avg("__mean").alias("opw"))


def scattered(frames: DataFrame, clip: list[str], frame: str, pose: str, depth: str, camera: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """clip columns, frame (the one before), pixel (in the next frame) and moved: its depth as seen from the frame before. Of several
    pixels that land on one, the last in the order of rows wins. pose: array (qx, qy, qz, qw, tx, ty, tz) from camera to world; rows whose
    pose is not finite move nothing."""
    fx, fy, cx, cy = camera
    following = F.lead(pose).over(W.partitionBy(*clip).orderBy(frame))
    finite = lambda p: F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    pairs = frames.withColumn("__next", following).filter(F.coalesce(finite(pose) & finite("__next"), F.lit(False)))
    part = lambda p, i: F.get(p, F.lit(i))
    posed = lambda p: K.motion([part(p, i) for i in range(4)], [part(p, 4 + i) for i in range(3)])
    both = pairs.select(*clip, frame, depth, posed(pose).alias("__here"), posed("__next").alias("__there"))
    moves = both.select(*clip, frame, depth, K.relative(F.col("__there"), F.col("__here")).alias("__move"))
    pixels = moves.select(*clip, frame, "__move", F.posexplode(depth).alias("__source", "__depth")).filter(_good(F.col("__depth")))
    seen = [(F.col("__source") % width - cx) * F.col("__depth") / fx, (F.floor(F.col("__source") / width) - cy) * F.col("__depth") / fy, F.col("__depth")]
    there = [sum((part("__move", 3 * i + k) * c for k, c in enumerate(seen)), part("__move", 9 + i)) for i in range(3)]
    moved = pixels.select(*clip, frame, "__source", *[c.alias(f"__{n}") for c, n in zip(there, "xyz")]).filter("__z > 1e-6")
    u, v = F.rint(F.col("__x") * fx / F.col("__z") + cx), F.rint(F.col("__y") * fy / F.col("__z") + cy)
    landed = moved.withColumn("__u", u).withColumn("__v", v).filter((F.col("__u") >= 0) & (F.col("__v") >= 0) & (F.col("__u") < width) & (F.col("__v") < height))
    pixel = (F.col("__v") * width + F.col("__u")).cast("int").alias("pixel")
    return landed.groupBy(*clip, frame, pixel).agg(F.max_by("__z", "__source").alias("moved"))


def banded_alignment(frames: DataFrame, clip: list[str], frame: str, pose: str, depth: str, truth: str, camera: tuple[float, float, float, float], width: int, height: int, least: int = 100) -> DataFrame:
    """clip columns, band, pairs and tae: the mean relative difference between a frame's depth and that of the frame before moved to it, over
    pixels whose true depth in the frame before lies in the band. A pair counts in a band where it has `least` such pixels."""
    moved = scattered(frames, clip, frame, pose, depth, camera, width, height)
    ordered = W.partitionBy(*clip).orderBy(frame)
    pairs = frames.select(*clip, frame, F.lead(depth).over(ordered).alias("__after"), truth)
    target = pairs.filter("__after IS NOT NULL").select(*clip, frame, F.posexplode(F.arrays_zip("__after", truth)).alias("pixel", "__both"))
    band = F.lit(None).cast("string")
    for name, (low, high) in BANDS.items():
        band = F.when((F.col(f"__both.{truth}") >= low) & (F.col(f"__both.{truth}") < high), name).otherwise(band)
    met = target.join(moved, [*clip, frame, "pixel"]).withColumn("band", band).filter(F.col("band").isNotNull() & _good(F.col("__both.__after")) & _good(F.col("moved")))
    error = F.abs(F.col("moved") - F.col("__both.__after")) / F.col("__both.__after")
    each = met.groupBy(*clip, frame, "band").agg(F.avg(error).alias("__tae"), F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    return each.groupBy(*clip, "band").agg(F.count(F.lit(1)).alias("pairs"), F.avg("__tae").alias("tae"))
