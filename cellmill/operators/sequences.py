"""Ordered-sequence operators over frames of a clip. Windows are partitioned by clip; clips are bounded by their recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def deltas(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """First difference, and the change of the difference (jerk)."""
    w = W.partitionBy(*keys).orderBy(*order)
    one = df.withColumn("delta", F.col(value) - F.lag(value).over(w))
    return one.withColumn("jerk", F.col("delta") - F.lag("delta").over(w))


def gap_rates(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Change of value per unit of the order column since the row before."""
    w = W.partitionBy(*keys).orderBy(order)
    gap = F.col(order) - F.lag(order).over(w)
    return df.withColumn("rate", (F.col(value) - F.lag(value).over(w)) / F.nullif(gap, F.lit(0)))


#: Fixed value: makes the median absolute deviation of normal values their standard deviation.
MAD_SCALE = 1.4826


def _spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with med, mad, range and n of its key."""
    center = df.groupBy(*keys).agg(F.median(value).alias("med"), F.count(value).alias("n"), (F.max(value) - F.min(value)).alias("range"))
    far = df.join(center, keys)
    return far.join(far.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad")), keys)


def mad_clip(df: DataFrame, keys: list[str], value: str, k: float = 5.0) -> DataFrame:
    """Values more than k scaled median absolute deviations above the median are replaced by the median. Keys with fewer than three
    values or without spread pass unchanged."""
    over = (F.col("n") >= 3) & (F.col("mad") > 0) & (F.col(value) > F.col("med") + k * F.col("mad") * MAD_SCALE)
    return _spread(df, keys, value).withColumn("clipped", F.when(over, F.col("med")).otherwise(F.col(value)))


def mad_outliers(df: DataFrame, keys: list[str], value: str, z: float = 3.5) -> DataFrame:
    """Values whose robust z-score is above z; low values never are. Where most values are equal, any above the median; where
    all are (to 1e-9), none."""
    above = F.col(value) - F.col("med")
    outlier = F.when(F.col("range") < 1e-9, False).when(F.col("mad") < 1e-12, above > 1e-9).otherwise(above / (MAD_SCALE * F.col("mad")) > z)
    return _spread(df, keys, value).withColumn("outlier", outlier)


def stability(df: DataFrame, keys: list[str], item: str, order: list[str], value: str, drop: float = 0.5) -> DataFrame:
    """Means over the items of a key that were seen (size > 0): coefficient of variation over the frames that show the item, share of
    frames at which it loses more than `drop` of its size, share of frames at which it comes or goes. df: a row per item and frame."""
    before = F.lag(value).over(W.partitionBy(*keys, item).orderBy(*order))
    seen, was = F.col(value) > 0, before > 0
    marked = df.withColumn("fell", F.when(was, ((before - F.col(value)) / before > drop).cast("int"))).withColumn("flipped", (seen != was).cast("int"))
    shown = F.when(seen, F.col(value))
    frames = F.count(F.lit(1))
    each = marked.groupBy(*keys, item).agg(
        (F.stddev_pop(shown) / F.avg(shown)).alias("cv"), F.max(seen).alias("ever"),
        (F.sum("fell") / frames).alias("drops"), F.when(frames > 1, F.coalesce(F.sum("flipped"), F.lit(0)) / frames).alias("flips"),
    )
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("ever"), F.col(c))), F.lit(0.0))
    return each.groupBy(*keys).agg(mean("cv").alias("area_cv"), mean("drops").alias("area_drop"), mean("flips").alias("vis_instability"))


def dense_grid(df: DataFrame, keys: list[str], frame: str, item: str, value: str) -> DataFrame:
    """Every item of a key in every frame of the key, 0 where it is not seen."""
    frames, items = df.select(*keys, frame).distinct(), df.select(*keys, item).distinct()
    return frames.join(items, keys).join(df.groupBy(*keys, frame, item).agg(F.sum(value).alias(value)), [*keys, frame, item], "left").fillna(0.0, [value])


def switches(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Times that a known value differs from the last known one."""
    w = W.partitionBy(*keys).orderBy(*order)
    changed = df.filter(F.col(value).isNotNull()).withColumn("c", (F.col(value) != F.lag(value).over(w)).cast("long"))
    return changed.groupBy(*keys).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("switches"), F.count(F.lit(1)).alias("n"))


def contiguity(df: DataFrame, keys: list[str], frame: str, start: int = 0) -> DataFrame:
    """Whether frames are start, start + 1, ... without a gap or repeat; from counts alone."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(frame).alias("d"), F.min(frame).alias("first"), F.max(frame).alias("last"))
    return out.withColumn("contiguous", (F.col("n") == F.col("d")) & (F.col("first") == start) & (F.col("last") - F.col("first") + 1 == F.col("n")))


def islands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive numbers."""
    w = W.partitionBy(*keys).orderBy(value)
    group = df.select(*keys, value).distinct().withColumn("g", F.col(value) - F.row_number().over(w))
    return group.groupBy(*keys, "g").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n")).drop("g")


def reopened(df: DataFrame, order: list[str], key: str, within: list[str]) -> DataFrame:
    """Keys that appear in more than one run of an ordered stream."""
    w = W.partitionBy(*within).orderBy(*order)
    opens = df.withColumn("opens", F.coalesce((F.col(key) != F.lag(key).over(w)).cast("int"), F.lit(1)))
    return opens.groupBy(*within, key).agg(F.sum("opens").alias("runs")).filter("runs > 1")


def anchored(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Values relative to the first row of the key."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.select(*keys, *order, *[(F.col(v) - F.first(v).over(w)).alias(v) for v in values])


def cumulative(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("drift", F.sum(value).over(w))


def slopes(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of y over x, and its fit."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


#: Smallest disparity or depth that is inverted, largest logarithm of a depth.
INVERSE_FLOOR, LOG_CAP = 1e-3, 5.0


def aligned(df: DataFrame, keys: list[str], pred: str, truth: str, mode: str = "affine", valid: Column | None = None) -> DataFrame:
    """Prediction brought to the truth per key from running sums: none, median (ratio of medians), affine (truth over prediction),
    disparity (1 / truth over prediction, which is a disparity itself) or log (ln truth over prediction). Only `valid` rows are
    fitted; a key without any keeps its predictions, one with a constant prediction gets the mean."""
    if mode == "none":
        return df.withColumn("aligned", F.col(pred))
    x, y = F.col(pred), F.col(truth)
    fine = F.lit(True) if valid is None else valid
    if mode == "median":
        scale = F.median(F.when(fine, y)) / F.greatest(F.median(F.when(fine, x)), F.lit(1e-9))
        return df.join(df.groupBy(*keys).agg(scale.alias("__s")), keys).withColumn("aligned", x * F.coalesce("__s", F.lit(1.0))).drop("__s")
    goal = {"affine": y, "disparity": 1 / F.greatest(y, F.lit(INVERSE_FLOOR)), "log": F.when(y > 0, F.ln(y))}[mode]
    pairs = df.withColumn("__x", F.when(fine & goal.isNotNull(), x)).withColumn("__y", F.when(fine & x.isNotNull(), goal))
    fit = pairs.groupBy(*keys).agg(
        F.coalesce(F.regr_slope("__y", "__x"), F.lit(0.0)).alias("__s"), F.coalesce(F.regr_intercept("__y", "__x"), F.avg("__y")).alias("__t"), F.count("__y").alias("__n")
    )
    line = x * F.col("__s") + F.col("__t")
    back = {"affine": line, "disparity": 1 / F.greatest(line, F.lit(INVERSE_FLOOR)), "log": F.exp(F.least(line, F.lit(LOG_CAP)))}[mode]
    return df.join(fit, keys).withColumn("aligned", F.when(F.col("__n") > 0, back).otherwise(x)).drop("__s", "__t", "__n")


def consecutive_mean(df: DataFrame, keys: list[str], order: list[str], distance: Column | str, value: str) -> DataFrame:
    """Mean absolute change between neighbouring frames, per key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__d", F.abs(F.col(value) - F.lag(value).over(w))).groupBy(*keys).agg(F.avg("__d").alias("mean_change"), F.count("__d").alias("steps"))


#: Depth bands in metres.
BANDS = {"near": (0.3, 1.0), "mid": (1.0, 2.5), "far": (2.5, 5.0)}


def range_gradients(pixels: DataFrame, clip: list[str], frame: str, pixel: str, pred: str, truth: str, static: float = 0.05, least: int = 100) -> DataFrame:
    """Errors of change between successive frames by the band of the first frame's true depth: mean difference of absolute changes where the truth is static
    (tgm), mean squared difference of changes (tgse). A pair of frames counts for a band with `least` pixels or more; clips average their pairs.
    pixels: clip, frame, pixel, pred, truth. Pairs are a shift within the pixel, so no frame is joined with itself."""
    frames = pixels.select(*clip, frame).distinct().withColumn("__t", F.row_number().over(W.partitionBy(*clip).orderBy(frame)))
    w = W.partitionBy(*clip, pixel).orderBy("__t")
    lead = lambda c: F.lead(c).over(w)
    shifted = pixels.join(frames, [*clip, frame]).select(*clip, "__t", pred, truth, lead(pred).alias("__p"), lead(truth).alias("__g"), lead("__t").alias("__u"))
    low, high = min(a for a, _ in BANDS.values()), max(b for _, b in BANDS.values())
    fine = lambda p, g: (F.col(g) > low) & (F.col(g) < high) & (F.col(p) > 0) & (F.abs(F.col(p)) < float("inf"))
    valid = shifted.filter((F.col("__u") == F.col("__t") + 1) & fine(pred, truth) & fine("__p", "__g"))
    dp, dt = F.col("__p") - F.col(pred), F.col("__g") - F.col(truth)
    band = F.lit(None).cast("string")
    for name, (a, b) in BANDS.items():
        band = F.when((F.col(truth) >= a) & (F.col(truth) < b), F.lit(name)).otherwise(band)
    still = F.abs(dt) < static
    each = valid.withColumn("__band", band).filter("__band IS NOT NULL").groupBy(*clip, "__t", "__band").agg(
        F.when(F.count_if(still) >= least, F.avg(F.when(still, F.abs(F.abs(dp) - F.abs(dt))))).alias("tgm"),
        F.when(F.count(F.lit(1)) >= least, F.avg((dp - dt) * (dp - dt))).alias("tgse"),
    )
    return each.groupBy(*clip).agg(*[F.avg(F.when(F.col("__band") == b, F.col(m))).alias(f"{m}_{b}") for m in ("tgm", "tgse") for b in BANDS])
