"""Data-quality checks: every check is a table of violations or statuses, empty where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """table, rows, expected, ok. One count per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(expected.get(n)).cast("long").alias("expected")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ok", F.col("rows").eqNullSafe(F.col("expected")))


def unit_status(df: DataFrame, keys: list[str], errors: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    """Per unit the checks that failed, and its status: error, warning or ok."""
    names = lambda cs: F.array_compact(F.array(*[F.when(F.coalesce(F.max(c.cast("int")), F.lit(0)) > 0, F.lit(n)) for n, c in cs.items()]))
    out = df.groupBy(*keys).agg(names(errors).alias("errors"), names(warnings).alias("warnings"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("status", F.when(F.size("errors") > 0, "error").when(F.size("warnings") > 0, "warning").otherwise("ok"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def completeness(df: DataFrame, key: str, *required: str) -> DataFrame:
    """Rows that lack a required field (null or blank), with the names."""
    gap = lambda c: F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c))
    return df.select(key, F.array_compact(F.array(*[gap(c) for c in required])).alias("gaps")).filter(F.size("gaps") > 0)


def checksums(found: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """key and status of every expected item: ok, missing or mismatch."""
    f = found.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    status = F.when(F.col("__k").isNull(), "missing").when(F.col("__v").eqNullSafe(F.col(value)), "ok").otherwise("mismatch")
    return expected.join(f, expected[key] == F.col("__k"), "left").select(key, status.alias("status"))


def split_integrity(cells: DataFrame, scene: str, tier: str, phases: int) -> DataFrame:
    """Scenes with more than one tier or without exactly `phases` cells."""
    out = cells.groupBy(scene).agg(F.countDistinct(tier).alias("tiers"), F.count(F.lit(1)).alias("cells"))
    return out.filter((F.col("tiers") != 1) | (F.col("cells") != phases))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child keys without a parent, and how many rows have them."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti").groupBy(child_key).agg(F.count(F.lit(1)).alias("n"))


def not_finite(df: DataFrame, key: list[str], *columns: str) -> DataFrame:
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    names = F.array_compact(F.array(*[F.when(bad(c), F.lit(c)) for c in columns]))
    return df.select(*key, names.alias("columns")).filter(F.size("columns") > 0)


def sequence_summary(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Count, first, last, missing and repeated numbers of sequences that should run without a gap."""
    out = df.groupBy(*keys).agg(F.count(number).alias("n"), F.countDistinct(number).alias("d"), F.min(number).alias("first"), F.max(number).alias("last"))
    return out.select(*keys, "n", "first", "last", (F.col("last") - F.col("first") + 1 - F.col("d")).alias("missing"), (F.col("n") - F.col("d")).alias("duplicate"))


def tables_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by which two tables differ as multisets, with their side."""
    columns = sorted(a.columns)
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def inventory(files: DataFrame, root_depth: int = -2) -> DataFrame:
    """Files and bytes by folder name (`modality`) of a file listing (path, bytes)."""
    return files.withColumn("modality", F.element_at(F.split("path", "/"), root_depth)).groupBy("modality").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def empty_like(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([], df.schema)
