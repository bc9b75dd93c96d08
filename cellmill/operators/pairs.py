"""Pairs and points for matching tasks: frame pairs by motion, chains, depth points and keypoints. Draws are hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmill.functions.kernels import ROTATION_BINS, ROTATION_EDGES, band
from cellmill.operators.joins import chains, offset_pairs
from cellmill.operators.questions import ring, spin
from cellmill.operators.sampling import top_by_hash

Motion = tuple[Column, Column]


def first_offsets(frames: DataFrame, keys: list[str], order: str, offsets: tuple[int, ...], stride: int, fits: Column, *carry: str) -> DataFrame:
    """For every stride-th frame (by place) the first of some offsets at which the pair fits: keys, order_a, order_b. Candidates are an
    equi-join by place, so each frame meets as many others as there are offsets."""
    placed = frames.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1)
    steps = F.posexplode(F.array(*[F.lit(o) for o in offsets])).alias("try", "offset")
    a = placed.filter(F.col("place") % stride == 0).select(*keys, F.col(order).alias("order_a"), F.col("place").alias("place_a"), *[F.col(c).alias(f"{c}_a") for c in carry], steps)
    b = placed.select(*keys, F.col(order).alias("order_b"), F.col("place").alias("place_b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    pairs = a.withColumn("place_b", F.col("place_a") + F.col("offset")).join(b, [*keys, "place_b"]).filter(fits)
    return pairs.groupBy(*keys, "order_a").agg(F.min_by("order_b", "try").alias("order_b"))


def binned(pairs: DataFrame, keys: list[str], motion: Motion, quota: int, seed: str, least: Motion | tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Pairs that turn and move enough, with their rotation bin, `quota` of each bin in hash order. motion: degrees and metres."""
    turn, move = motion
    found = pairs.filter((turn >= least[0]) & (move >= least[1])).withColumn("bin", band(turn, ROTATION_EDGES, ROTATION_BINS)).filter("bin IS NOT NULL")
    return top_by_hash(found, [*keys, "bin"], quota, seed, *keys, "order_a", "order_b")


def gap_pairs(frames: DataFrame, keys: list[str], order: str, gap: int, *carry: str) -> DataFrame:
    return offset_pairs(frames, keys, order, gap, *carry)


def cross_pairs(first: DataFrame, second: DataFrame, keys: list[str], order: str, cap: int, seed: str, *carry: str) -> DataFrame:
    """Pairs of frames of two recordings of a scene, at most about `cap` a scene: the sampling rule. Each frame of the first takes the frames of
    the second next to it on a ring of hashes, so candidates are never multiplied out."""
    a = first.select(*keys, F.col(order).alias("order_a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    numbered = ring(second, keys, order, seed).withColumnRenamed(order, "order_b")
    sizes = numbered.groupBy(*keys).agg(F.first("size").alias("size"))
    counts = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.col("size"), F.greatest(F.floor(F.lit(cap) / F.col("n")), F.lit(1)))
    tried = a.join(sizes, keys).join(counts, keys).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), share - 1)))
    placed = tried.withColumn("place", F.pmod(spin(seed, *keys, "order_a") + F.col("step"), F.col("size"))).drop("size", "n", "step")
    b = second.select(*keys, F.col(order).alias("order_b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return placed.join(numbered.drop("size"), [*keys, "place"]).drop("place").join(b, [*keys, "order_b"])


def chain_starts(frames: DataFrame, keys: list[str], order: str, length: int, stride: int, count: int, seed: str) -> DataFrame:
    """`count` starts a key, in hash order, from which `length` steps of `stride` exist."""
    return top_by_hash(chains(frames, keys, order, length, stride), keys, count, seed, *keys, "start")


def depth_points(pixels: DataFrame, frame: list[str], n: int, seed: str) -> DataFrame:
    """n pixels with a measured depth of each frame, in hash order of their place. pixels: frame, x, y, depth."""
    return top_by_hash(pixels.filter("depth > 0"), frame, n, seed, *frame, "x", "y")


def keypoints(points: DataFrame, targets: DataFrame, pair: list[str], move: tuple[Column, Column, Column], size: tuple[int, int], camera: tuple[float, float, float, float], occlusion: float) -> DataFrame:
    """Points of a first frame seen from a second: x2, y2 and visible. points: pair, x, y, depth; targets: pair, x, y, depth of the second
    frame's pixels; move: the point (cam_x, cam_y, cam_z in the first camera) in the second camera."""
    fx, fy, cx, cy = camera
    width, height = size
    z = F.col("depth")
    lifted = points.withColumn("cam_x", (F.col("x") - cx) * z / fx).withColumn("cam_y", (F.col("y") - cy) * z / fy).withColumn("cam_z", z)
    seen = lifted.select(*pair, "x", "y", move[0].alias("u"), move[1].alias("v"), move[2].alias("w"))
    flat = seen.withColumn("x2", F.when(F.col("w") > 0, F.col("u") * fx / F.col("w") + cx)).withColumn("y2", F.when(F.col("w") > 0, F.col("v") * fy / F.col("w") + cy))
    inside = (F.col("x2") >= 0) & (F.col("x2") < width) & (F.col("y2") >= 0) & (F.col("y2") < height)
    at = lambda c, most: F.when(inside, F.least(F.floor(c), F.lit(most - 1)))
    placed = flat.withColumn("px", at("x2", width)).withColumn("py", at("y2", height))
    observed = targets.select(*pair, F.col("x").alias("px"), F.col("y").alias("py"), F.col("depth").alias("observed"))
    joined = placed.join(observed, [*pair, "px", "py"], "left")
    visible = inside & (F.col("observed") > 0) & (F.abs(F.col("observed") - F.col("w")) <= occlusion)
    return joined.select(*pair, "x", "y", "x2", "y2", F.coalesce(visible, F.lit(False)).alias("visible"))
