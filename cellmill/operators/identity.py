"""Scores of predictions that name what they show: identities of masks, first boxes, depth order of objects, mask and depth borders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmill.functions.images import dilate
from cellmill.operators.sampling import hash_rank


def identity_iou(pixels: DataFrame, tracks: DataFrame, frame: list[str]) -> DataFrame:
    """Overlap of each truth object with the tracks that were started for it, without reassignment. pixels: frame, track, truth (0: none);
    tracks: track, source. One row for each frame and truth object: hit pixels, union, iou, located (any pixel of its tracks)."""
    named = pixels.join(tracks.select("track", "source").distinct(), "track", "left")
    truth = named.filter("truth > 0").select(*frame, F.col("truth").alias("object"), "source")
    own = truth.groupBy(*frame, "object").agg(F.count(F.lit(1)).alias("nt"), F.count_if(F.col("source") == F.col("object")).alias("hit"))
    shown = named.filter("source IS NOT NULL").groupBy(*frame, F.col("source").alias("object")).agg(F.count(F.lit(1)).alias("np"))
    both = own.join(shown, [*frame, "object"], "left").withColumn("np", F.coalesce("np", F.lit(0)))
    return both.select(*frame, "object", "hit", (F.col("nt") + F.col("np") - F.col("hit")).alias("union"), (F.col("hit") / (F.col("nt") + F.col("np") - F.col("hit"))).alias("iou"), (F.col("np") > 0).alias("located"))


def identity_summary(scores: DataFrame, *by: str) -> DataFrame:
    """Object frames, located ones, mean IoU and share of hits at 0.5."""
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("object_frames"), F.count_if("located").alias("located_frames"), F.avg("iou").alias("iou_mean"), F.avg((F.col("iou") >= 0.5).cast("double")).alias("accuracy_50")
    )


def grounding(predictions: DataFrame, truths: DataFrame, key: list[str], order: str, iou: Column, threshold: float = 0.5) -> DataFrame:
    """IoU of the first predicted box with the best truth box, and whether it reaches the threshold. iou: an expression over p1..p4, t1..t4.
    Without a prediction the score is 0; without a truth box it is 1."""
    names = [f"p{i}" for i in range(1, 5)]
    first = predictions.groupBy(*key).agg(F.min_by(F.struct(*names), order).alias("b")).select(*key, "b.*")
    every = first.select(*key).union(truths.select(*key)).distinct().join(first, key, "left").join(truths, key, "left")
    best = every.withColumn("iou", F.when(F.col("p1").isNull(), 0.0).when(F.col("t1").isNull(), 1.0).otherwise(iou)).groupBy(*key).agg(F.max("iou").alias("iou"))
    return best.withColumn("hit", F.col("iou") >= threshold)


def depth_order(pixels: DataFrame, frame: list[str], draws: int, seed: str, gap: float = 0.05, least: int = 50) -> DataFrame:
    """Share of object pairs whose depth order the prediction keeps. Each draw takes one pixel of every object (that with the smallest hash
    of draw and place), and pairs its objects in hash order; pairs nearer than `gap` don't count, frames with fewer than `least` pairs drop out.
    pixels: frame, object, at (place), pred, truth, valid ones only."""
    shown = pixels.filter("object > 0")
    drawn = shown.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    rank = hash_rank(seed, "draw", "object", "at")
    one = drawn.groupBy(*frame, "draw", "object").agg(F.min_by(F.struct("pred", "truth"), rank).alias("p"))
    row = F.struct(hash_rank(seed, "draw", "object").alias("h"), F.col("p.pred").alias("pred"), F.col("p.truth").alias("truth"))
    pair = F.slice(F.array_sort(F.collect_list(row)), 1, 2)
    pairs = one.groupBy(*frame, "draw").agg(pair.alias("s")).filter(F.size("s") == 2)
    a, b = F.col("s")[0], F.col("s")[1]
    kept = ((a["truth"] < b["truth"]) == (a["pred"] < b["pred"])).cast("double")
    clear = pairs.filter(F.abs(a["truth"] - b["truth"]) >= gap)
    return clear.groupBy(*frame).agg(F.avg(kept).alias("accuracy"), F.count(F.lit(1)).alias("pairs")).filter(F.col("pairs") >= least)


def mask_border(mask: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Pixels whose label differs from that of the next pixel down or to the right, widened."""
    edge = np.zeros(mask.shape, bool)
    edge[:-1] |= mask[:-1] != mask[1:]
    edge[:, :-1] |= mask[:, :-1] != mask[:, 1:]
    return dilate(edge, rounds)


def depth_border(depth: np.ndarray, threshold: float = 0.1, rounds: int = 2) -> np.ndarray:
    """Pixels with a central difference above the threshold, widened; the outermost rows and columns have none of their own axis."""
    gy, gx = np.zeros_like(depth), np.zeros_like(depth)
    gy[1:-1] = (depth[2:] - depth[:-2]) / 2
    gx[:, 1:-1] = (depth[:, 2:] - depth[:, :-2]) / 2
    return dilate(np.hypot(gx, gy) > threshold, rounds)


def border_coherence(frames: DataFrame, keys: list[str], shape: tuple[int, int], threshold: float = 0.1, rounds: int = 2) -> DataFrame:
    """Agreement of mask borders with depth borders: precision and recall a frame, their means by keys, and the F score of these. frames: keys,
    mask (array of int), depth (array of double), row by row."""
    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            out = []
            for mask, depth in zip(batch.column("mask").to_pylist(), batch.column("depth").to_pylist()):
                m, d = mask_border(np.array(mask).reshape(shape), rounds), depth_border(np.array(depth, np.float64).reshape(shape), threshold, rounds)
                hit = float((m & d).sum())
                out.append((hit / m.sum() if m.any() else 1.0, hit / d.sum() if d.any() else 1.0))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array([p for p, _ in out], pa.float64()), pa.array([r for _, r in out], pa.float64())], names=[*keys, "precision", "recall"])

    each = frames.select(*keys, "mask", "depth").mapInArrow(run, f"{kinds}, precision double, recall double")
    means = each.groupBy(*keys).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("frames"))
    total = F.col("precision") + F.col("recall")
    return means.withColumn("coherence", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))
