"""Cells: per-(scene, phase) means of sample metrics, and logs of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cells_from_samples(samples: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("scene", "phase"), order: str = "sample") -> DataFrame:
    """One row per cell: means of metrics, number of samples, mean latency, first known difficulty and budget in the given order. Rows
    without a scene or phase are dropped."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return (
        samples.dropna(subset=list(keys)).groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_samples"), *[F.avg(m).alias(m) for m in metrics], F.avg("latency_ms").alias("latency_ms_mean"),
            first("difficulty").alias("difficulty"), first("frame_budget").alias("frame_budget"),
        )
    )


def merge_logs(*logs: DataFrame) -> DataFrame:
    """All rows of all logs with the union of their columns; missing values are null."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def to_long(cells: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value: one row per metric of a cell; missing metrics have no row."""
    return cells.unpivot(keys, metrics, "metric", "value").filter("value IS NOT NULL")


def to_wide(long: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("metric", metrics).agg(F.first("value"))


def complete_scenes(cells: DataFrame, phases: int, scene: str | tuple[str, ...] = "scene", phase: str = "phase", metrics: tuple[str, ...] = ()) -> DataFrame:
    """Cells of scenes that have every phase, after dropping cells that miss a metric."""
    whole = cells.dropna("any", subset=list(metrics)) if metrics else cells
    seen = F.size(F.collect_set(phase).over(W.partitionBy(*([scene] if isinstance(scene, str) else scene))))  # a scene's cells are as few as its phases
    return whole.withColumn("__p", seen).filter(F.col("__p") == phases).drop("__p")


def mean_by(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Group means with the number of rows."""
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))


def weighted_means(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """sum(v * w) / sum(w) over rows that have both; null where there is none."""
    known = F.col(value).isNotNull() & F.col(weight).isNotNull()
    total = F.sum(F.when(known, F.col(weight)))
    return df.groupBy(*keys).agg((F.sum(F.when(known, F.col(value) * F.col(weight))) / F.nullif(total, F.lit(0.0))).alias("weighted_mean"), F.count_if(known).alias("n"))
