"""Correspondence of patch grids, and equalised depth, with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mutual_matches(patches: DataFrame, pair: list[str], side: str = "side", patch: str = "patch", feature: str = "feature") -> DataFrame:
    """pair columns, patch_a, patch_b, cosine: patches of the two sides (0 and 1) of a pair, each the other's nearest by cosine (rounded to nine
    places, ties to the smaller number). A pair has two frames' patches, so a join within it is bounded by the grid. Patches without a feature or of
    length zero match nothing."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    usable = patches.select(*pair, side, F.col(patch).alias("p"), F.col(feature).cast("array<double>").alias("f")).withColumn("size", F.sqrt(dot(F.col("f"), F.col("f")))).filter("size > 0")
    one, other = (usable.filter(F.col(side) == n).select(*pair, F.col("p").alias(f"patch_{s}"), F.col("f").alias(f"f_{s}"), F.col("size").alias(f"size_{s}")) for n, s in ((0, "a"), (1, "b")))
    both = one.join(other, pair).select(*pair, "patch_a", "patch_b", F.round(dot(F.col("f_a"), F.col("f_b")) / (F.col("size_a") * F.col("size_b")), 9).alias("cosine"))
    first = lambda of, by: F.row_number().over(W.partitionBy(*pair, of).orderBy(F.desc("cosine"), by))
    return both.withColumn("to_b", first("patch_a", "patch_b")).withColumn("to_a", first("patch_b", "patch_a")).filter("to_a = 1 AND to_b = 1").select(*pair, "patch_a", "patch_b", "cosine")


def mask_votes(matches: DataFrame, shares: DataFrame, pair: list[str], side: str = "side", patch: str = "patch", mask: str = "mask", share: str = "share") -> DataFrame:
    """pair columns, mask_a, mask_b, votes: for every match, the product of the shares of the two patches' areas that the masks have. shares: pair
    columns, side, patch, mask, share."""
    of = lambda n, s: shares.filter(F.col(side) == n).select(*pair, F.col(patch).alias(f"patch_{s}"), F.col(mask).alias(f"mask_{s}"), F.col(share).alias(f"share_{s}"))
    met = matches.join(of(0, "a"), [*pair, "patch_a"]).join(of(1, "b"), [*pair, "patch_b"])
    return met.groupBy(*pair, "mask_a", "mask_b").agg(F.sum(F.col("share_a") * F.col("share_b")).alias("votes"))


def equalised(pixels: DataFrame, frame: list[str], value: str, low: float, high: float, least: int = 100, out: str = "level") -> DataFrame:
    """pixels with `out` in [0, 1]: the share of the frame's valid (positive) values that are not above this one; 0 where invalid. A frame with `least`
    valid pixels or fewer is stretched from low to high instead.

    Values are counted a frame, and the counts added up in their order: a histogram of a frame's different values, of which depth in millimetres has
    65,536 at most. Pixels look their value up, so ties stay together."""
    valid = F.col(value) > 0
    counts = pixels.filter(valid).groupBy(*frame, value).agg(F.count(F.lit(1)).alias("__n"))
    rows = W.partitionBy(*frame)
    up_to = counts.withColumn("__to", F.sum("__n").over(rows.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("__all", F.sum("__n").over(rows)).drop("__n")
    linear = F.greatest(F.least((F.col(value) - low) / max(high - low, 1.0), F.lit(1.0)), F.lit(0.0))
    level = F.when(F.col("__all") > least, F.col("__to") / F.col("__all")).when(F.col("__all").isNotNull(), linear).otherwise(0.0)
    return pixels.join(up_to, [*frame, value], "left").withColumn(out, level).drop("__to", "__all")
