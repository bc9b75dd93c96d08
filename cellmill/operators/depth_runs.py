"""A whole evaluation of depth maps kept as pixels: alignment pooled over cells, then scores of frames by band and mask, of objects, and over all.

Pixels are rows (cell, frame, pred, truth, mask: the instance's number, 0 for none, null for no mask), so no frame is ever in one Python call, and
every score is a sum with partial aggregates. A pixel is in up to three strata: the whole frame, its band of true depth, and in or out of the mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmill.functions.kernels import valid_depth
from cellmill.operators.sequences import aligned
from cellmill.operators.stats import mean_ci

#: The sensor's range in metres, the bands within it, and the fewest pixels of a stratum and of an object.
LOW, HIGH = 0.3, 5.0
BANDS = {"near": (0.3, 1.0), "mid": (1.0, 3.0), "far": (3.0, 5.0)}
LEAST_PIXELS, LEAST_OBJECT = 100, 200
_TINY = 1e-6


def basket(pred: Column, truth: Column, when: Column) -> dict[str, Column]:
    """Nine errors and three accuracies over the rows where `when` holds; null where it never does."""
    p, g = (F.when(when, c) for c in (pred, truth))
    log = lambda c: F.when(when, F.ln(F.greatest(c, F.lit(_TINY))))  # noqa: E731  the greatest of a null and a number is the number
    e, off, turned, worst = log(p) - log(g), p - g, 1 / p - 1 / g, F.greatest(p / g, g / p)
    root = lambda c: F.sqrt(F.avg(c * c))
    return {
        "abs_rel": F.avg(F.abs(off) / g), "sq_rel": F.avg(off * off / g), "rmse": root(off), "rmse_log": root(e), "silog": 100 * F.stddev_pop(e), "log10": F.avg(F.abs(e)) / F.ln(F.lit(10.0)),
        "mae": F.avg(F.abs(off)), "irmse": root(turned), "imae": F.avg(F.abs(turned)), **{f"delta{k}": F.avg((worst < 1.25**k).cast("double")) for k in (1, 2, 3)},
    }


SCORES = ("abs_rel", "sq_rel", "rmse", "rmse_log", "silog", "log10", "mae", "irmse", "imae", "delta1", "delta2", "delta3")


def prepared(pixels: DataFrame, cell: list[str], mode: str = "none") -> DataFrame:
    """pixels with pred aligned by cell, and valid: the truth in the sensor's range, the (aligned) prediction finite and positive. The fit takes
    the pixels that are valid before."""
    fine = lambda c: F.coalesce(valid_depth(F.col(c), F.col("truth"), LOW, HIGH), F.lit(False))
    fitted = aligned(pixels, cell, "pred", "truth", mode, fine("pred"))
    return fitted.withColumn("valid", fine("aligned")).drop("pred").withColumnRenamed("aligned", "pred")


def _scored(rows: DataFrame, by: list[str], least: int, *more: Column) -> DataFrame:
    """The basket of each group, null where fewer than `least` pixels are valid, and n_valid."""
    out = rows.groupBy(*by).agg(*more, F.count_if("valid").alias("n_valid"), *[c.alias(n) for n, c in basket(F.col("pred"), F.col("truth"), F.col("valid")).items()])
    return out.select(*[c for c in out.columns if c not in SCORES], *[F.when(F.col("n_valid") >= least, F.col(c)).alias(c) for c in SCORES])


def frame_scores(rows: DataFrame, frame: list[str], least: int = LEAST_PIXELS) -> DataFrame:
    """frame, stratum (all, near, mid, far, in_mask, out_mask), n_valid and the basket, from prepared pixels; strata with fewer than `least` valid pixels are
    not there."""
    g = F.col("truth")
    band = F.coalesce(*[F.when((g >= low) & (g < high), name) for name, (low, high) in BANDS.items()])
    side = F.when(F.col("mask") > 0, "in_mask").when(F.col("mask") == 0, "out_mask")
    each = rows.filter("valid").withColumn("stratum", F.explode(F.array_compact(F.array(F.lit("all"), band, side))))
    return _scored(each, [*frame, "stratum"], least).filter(F.col("n_valid") >= least)


def hole_scores(rows: DataFrame, frame: list[str]) -> DataFrame:
    """Shares of pixels without a true depth: of the frame, in the mask and out of it (null where there is none)."""
    g = F.col("truth")
    hole = (g.isNull() | F.isnan(g) | (F.abs(g) == float("inf")) | (g <= LOW)).cast("double")
    return rows.groupBy(*frame).agg(F.avg(hole).alias("overall"), F.avg(F.when(F.col("mask") > 0, hole)).alias("in_mask"), F.avg(F.when(F.col("mask") == 0, hole)).alias("out_mask"))


def object_scores(rows: DataFrame, frame: list[str], least: int = LEAST_PIXELS, least_object: int = LEAST_OBJECT) -> DataFrame:
    """One row an instance of a frame with `least_object` pixels or more: n_pixels, n_valid, coverage and the basket (null below `least` valid ones)."""
    own = _scored(rows.filter("mask > 0").withColumnRenamed("mask", "instance"), [*frame, "instance"], least, F.count(F.lit(1)).alias("n_pixels"))
    kept = own.filter(F.col("n_pixels") >= least_object)
    return kept.select(*frame, "instance", "n_pixels", "n_valid", (F.col("n_valid") / F.col("n_pixels")).alias("coverage"), *SCORES)


def object_means(objects: DataFrame, frame: list[str]) -> DataFrame:
    """Means over a frame's objects, each of which weighs the same."""
    return objects.groupBy(*frame).agg(F.count(F.lit(1)).alias("n_objects"), F.avg("coverage").alias("mean_coverage"), F.avg("n_pixels").alias("mean_n_pixels"), *[F.avg(c).alias(c) for c in SCORES])


def over_all(scores: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """score, mean, median, deviation, percentiles and interval of every column over the rows that have it, within `by`."""
    long = scores.unpivot(by, [F.col(c).cast("double").alias(c) for c in columns], "score", "value").filter("value IS NOT NULL")
    return mean_ci(long, "value", (*by, "score"))
