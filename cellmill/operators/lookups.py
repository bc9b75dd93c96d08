"""Recipes, schemas, layouts and catalogues: small tables that rows are looked up in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

#: Fixed value: prefix of metric columns in cell logs.
METRIC_PREFIX = "metric:"
METADATA = frozenset({"id", "phase", "difficulty", "scene", "latency_ms"})


def metric_columns(df: DataFrame, known: set[str], explicit: list[str] | None = None) -> list[str]:
    """Numeric columns with a registered metric, in the table's order; explicit ones must all be registered."""
    if explicit:
        unknown = sorted(set(explicit) - known)
        if unknown:
            raise ValueError(f"metrics without a specification: {unknown}")
        return list(explicit)
    number = lambda f: isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)
    return [f.name for f in df.schema if f.name in known and f.name not in METADATA and number(f)]


def analysis_rows(cells: DataFrame) -> DataFrame:
    """Cell-log rows (scene_id, phase, difficulty, metric:...) as rows of an analysis: scene, phase, difficulty, id and bare metric names."""
    metrics = [c for c in cells.columns if c.startswith(METRIC_PREFIX)]
    return cells.select(
        F.col("scene_id").alias("scene"), "phase", "difficulty", F.concat_ws("_", F.col("scene_id").cast("string"), F.col("phase").cast("string")).alias("id"),
        *[F.col(f"`{m}`").alias(m.removeprefix(METRIC_PREFIX)) for m in metrics],
    )


def resolve_recipes(tasks: DataFrame, recipes: DataFrame, families: tuple[str, ...], limit: int = 10_000) -> DataFrame:
    """Tasks (task, family or null) with their recipe (task, family, ...): that of the family, else the first family that has one. Unknown
    tasks have nulls. Recipes are a dimension table: broadcast up to `limit` rows, which is counted."""
    order = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("recipe_family"))
    named = recipes.withColumnRenamed("task", "recipe_task").withColumnRenamed("family", "recipe_family")
    small = named.limit(limit + 1).count() <= limit
    fits = (F.col("task") == F.col("recipe_task")) & (F.col("family").isNull() | (F.col("family") == F.col("recipe_family")))
    joined = tasks.join(F.broadcast(named) if small else named, fits, "left")
    best = F.row_number().over(W.partitionBy("task", "family").orderBy(order.asc_nulls_last()))
    return joined.withColumn("__k", best).filter("__k = 1").drop("__k", "recipe_task")


def scoped(frames: DataFrame, families: list[str], flags: list[str], family: str = "scene_type") -> DataFrame:
    """Frames of a recipe: first those of its scene families, then those with every modality; a modality without a column leaves none."""
    inside = frames.filter(F.col(family).isin(families))
    if set(flags) - set(frames.columns):
        return inside.filter(F.lit(False))
    for flag in flags:
        inside = inside.filter(F.coalesce(F.col(flag), F.lit(False)))
    return inside


def matched_scenes(ego: DataFrame, other: DataFrame, name: str = "name") -> DataFrame:
    """Names of one layout whose scene number exactly one name of the other has: name, number, ok."""
    number = lambda c: F.when(F.regexp_like(c, F.lit(r"^scene\d+")), F.regexp_extract(c, r"^scene(\d+)", 1).cast("int"))
    counted = other.select(number(F.col(name)).alias("number")).filter("number IS NOT NULL").groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    numbered = ego.select(name, F.when(F.regexp_like(name, F.lit(r"^scene\d+$")), number(F.col(name))).alias("number"))
    return numbered.join(counted, "number", "left").select(name, "number", F.coalesce(F.col("n") == 1, F.lit(False)).alias("ok"))


#: Rows of a palette that may be broadcast.
PALETTE = 65_536


def palette_labels(pixels: DataFrame, palette: DataFrame, image: list[str]) -> DataFrame:
    """pixels (image, red, green, blue, ...) with label: the colour's place in the palette (label, red, green, blue; broadcast up to PALETTE rows, which are counted), 0 if
    it has none. An image whose largest label leaves a gap gets its number of other labels there instead."""
    rgb = ["red", "green", "blue"]
    colours = palette.select(*rgb, "label")
    small = colours.limit(PALETTE + 1).count() <= PALETTE
    placed = pixels.join(F.broadcast(colours) if small else colours, rgb, "left").withColumn("label", F.coalesce("label", F.lit(0)))
    spans = placed.groupBy(*image).agg(F.max("label").alias("__most"), (F.countDistinct("label") - 1).alias("__dense"))
    return placed.join(spans, image).withColumn("label", F.when(F.col("label") == F.col("__most"), F.col("__dense")).otherwise(F.col("label")).cast("long")).drop("__most", "__dense")


def objects_meta(objects: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """One row for each object: that of its first appearance."""
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return objects.filter(F.col(key).isNotNull()).groupBy(key).agg(first.alias("r")).select(key, "r.*")
