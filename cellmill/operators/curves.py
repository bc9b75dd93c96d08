"""Error curves, success tables and detection scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def error_auc(df: DataFrame, error: str, threshold: float, by: tuple[str, ...] = (), points: int = 100) -> DataFrame:
    """Normalised area under the share of errors <= t for an even grid of t in [0, threshold]. Every row adds one to a grid
    place, so the grid isn't multiplied with the rows."""
    step = threshold / (points - 1)
    place = F.when(F.col(error).isNull() | F.isnan(error) | (F.col(error) > threshold), points).otherwise(F.greatest(F.ceil(F.col(error) / step - 1e-12), F.lit(0)))
    counted = df.groupBy(*by, place.cast("int").alias("place")).agg(F.count(F.lit(1)).alias("c"))
    # a row at grid place g is within all t >= g: it adds (points - 1 - g) intervals, and half of the one before it
    covers = F.when(F.col("place") >= points, 0.0).when(F.col("place") == 0, float(points - 1)).otherwise(points - 1 - F.col("place") + 0.5)
    return counted.groupBy(*by).agg((F.sum(F.col("c") * covers) / F.sum("c") / (points - 1)).alias("auc"), F.sum("c").alias("n"))


def success_table(df: DataFrame, a: str, b: str, limits: list[tuple[float, float]], by: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows within both limits, a column for each pair of limits."""
    share = lambda x, y: F.avg(((F.col(a) <= x) & (F.col(b) <= y)).cast("double"))
    return df.groupBy(*by).agg(*[share(x, y).alias(f"s{i}") for i, (x, y) in enumerate(limits)], F.count(F.lit(1)).alias("n"))


def thresholded(df: DataFrame, score: str, valid: str, thresholds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows whose valid score reaches each threshold, and their mean; invalid rows stay in the denominator."""
    hit = lambda t: F.avg((F.col(valid) & (F.col(score) >= t)).cast("double"))
    out = df.groupBy(*by).agg(*[hit(t).alias(f"acc_{round(t * 100)}") for t in thresholds], F.avg(F.when(F.col(valid), F.col(score)).otherwise(0.0)).alias("mean_score"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("mean_acc", sum((F.col(f"acc_{round(t * 100)}") for t in thresholds), F.lit(0.0)) / len(thresholds))


def confusion(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))


def mean_iou(df: DataFrame, pred: str, truth: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over the truth's classes (those of 0 and more) of intersection over union of rows with that class; 1 where the truth
    has no class."""
    c = confusion(df, pred, truth, by)
    t = c.groupBy(*by, truth).agg(F.sum("n").alias("nt"), F.sum(F.when(F.col(pred) == F.col(truth), F.col("n")).otherwise(0)).alias("hit"))
    p = c.groupBy(*by, pred).agg(F.sum("n").alias("np")).withColumnRenamed(pred, truth)
    iou = t.join(p, [*by, truth], "left").withColumn("iou", F.when(F.col(truth) >= 0, F.col("hit") / (F.col("nt") + F.coalesce("np", F.lit(0)) - F.col("hit"))))
    return iou.groupBy(*by).agg(F.coalesce(F.avg("iou"), F.lit(1.0)).alias("miou"), F.count("iou").alias("classes"))


def log_curve(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Trapezoidal area of y over x per key."""
    w = W.partitionBy(*keys).orderBy(x)
    return df.withColumn("__a", (F.lead(x).over(w) - F.col(x)) * (F.lead(y).over(w) + F.col(y)) / 2).groupBy(*keys).agg(F.sum("__a").alias("area"))
