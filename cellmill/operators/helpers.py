"""Smaller operators: complete runs, primary takes, remaps, boxes of masks, contrast, robust rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmill.functions import kernels as K


def complete_runs(shards: DataFrame, group: list[str], run: str, shard: str, total: str, time: str) -> DataFrame:
    """The newest run of each group that has all of its shards 0 .. total - 1."""
    runs = shards.groupBy(*group, run).agg(F.countDistinct(shard).alias("have"), F.max(total).alias("need"), F.min(shard).alias("lo"), F.max(shard).alias("hi"), F.max(time).alias("at"))
    whole = runs.filter("have = need AND lo = 0 AND hi = need - 1")
    return whole.groupBy(*group).agg(F.max_by(run, F.struct("at", run)).alias(run), F.max("at").alias("at"))


def aligned(modalities: dict[str, DataFrame], *keys: str) -> tuple[DataFrame, DataFrame]:
    """Keys that every modality has, and how many each one lacks of all keys."""
    tagged = None
    for name, df in modalities.items():
        one = df.select(*keys).distinct().withColumn("modality", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    seen = tagged.groupBy(*keys).agg(F.collect_set("modality").alias("has"))
    names = F.array(*[F.lit(n) for n in modalities])
    lacking = seen.select(F.explode(F.array_except(names, "has")).alias("modality")).groupBy("modality").agg(F.count(F.lit(1)).alias("missing"))
    return seen.filter(F.size("has") == len(modalities)).select(*keys), lacking


def primary_take(takes: DataFrame, by: list[str], take: str, length: str, policy: str = "longest") -> DataFrame:
    order = [F.col(take)] if policy == "first" else [F.col(length).desc(), F.col(take)]
    w = W.partitionBy(*by).orderBy(*order)
    return takes.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def remap_problems(mapping: DataFrame, old: str, new: str, known: DataFrame, key: str) -> DataFrame:
    """Why a remap may not be applied: ids mapped twice, targets taken twice, known ids left out, unknown ids."""
    twice = mapping.groupBy(old).agg(F.countDistinct(new).alias("n")).filter("n > 1").select(F.col(old).alias("id"), F.lit("ambiguous").alias("problem"))
    taken = mapping.groupBy(new).agg(F.countDistinct(old).alias("n")).filter("n > 1").select(F.col(new).alias("id"), F.lit("not injective").alias("problem"))
    ids = known.select(F.col(key).alias(old)).distinct()
    left = ids.join(mapping, old, "left_anti").select(F.col(old).alias("id"), F.lit("left out").alias("problem"))
    alien = mapping.select(old).distinct().join(ids, old, "left_anti").select(F.col(old).alias("id"), F.lit("unknown").alias("problem"))
    return twice.unionByName(taken).unionByName(left).unionByName(alien)


def by_id_or_name(left: DataFrame, catalog: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """left with the catalogue's object: by id, else by a name that only one object has; `how` is id, name or none."""
    ids = catalog.select(F.col(id_col).alias("__i"), F.col(id_col).alias("__by_id"))
    names = catalog.groupBy(F.col(name_col).alias("__n")).agg(F.min(id_col).alias("__by_name"), F.count(F.lit(1)).alias("__c")).filter("__c = 1").drop("__c")
    j = left.join(ids, left[id_col] == F.col("__i"), "left").join(names, left[name_col] == F.col("__n"), "left")
    how = F.when(F.col("__by_id").isNotNull(), "id").when(F.col("__by_name").isNotNull(), "name").otherwise("none")
    return j.withColumn("object", F.coalesce("__by_id", "__by_name")).withColumn("how", how).drop("__i", "__n", "__by_id", "__by_name")


def mask_boxes(pixels: DataFrame, keys: list[str], x: str, y: str, least: int = 1) -> DataFrame:
    """Inclusive box and area of each mask of pixel rows; masks under `least` pixels are dropped."""
    out = pixels.groupBy(*keys).agg(F.min(x).alias("x1"), F.min(y).alias("y1"), F.max(x).alias("x2"), F.max(y).alias("y2"), F.count(F.lit(1)).alias("area"))
    return out.filter(F.col("area") >= least)


def drop_large(boxes: DataFrame, width: float, height: float, share: float) -> DataFrame:
    return boxes.filter((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) <= share * width * height)


def repinned(rows: DataFrame, old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose shard is equal at both revisions move; others are excluded with reasons."""
    a, b = old.select(F.col(key).alias("__a"), F.col(digest).alias("__da")), new.select(F.col(key).alias("__b"), F.col(digest).alias("__db"))
    j = rows.join(a, rows[key] == F.col("__a"), "left").join(b, rows[key] == F.col("__b"), "left")
    reasons = F.array_compact(F.array(F.when(F.col("__a").isNull(), F.lit("missing at old")), F.when(F.col("__b").isNull(), F.lit("missing at new")), F.when(F.col("__da") != F.col("__db"), F.lit("changed"))))
    return j.withColumn("reasons", reasons).withColumn("moves", F.size("reasons") == 0).drop("__a", "__da", "__b", "__db")


def path_cells(df: DataFrame, path: str) -> DataFrame:
    """(scene, phase) pairs named by paths scene/phase/...; a phase in the path goes before the logical one."""
    parts = F.split(path, "/")
    return df.select(F.get(parts, F.lit(0)).alias("scene"), F.coalesce(F.regexp_extract(F.get(parts, F.lit(1)), r"^(\d+)$", 1), F.lit("")).alias("phase")).distinct()


def stretched(df: DataFrame, by: list[str], value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values scaled to [0, 1] between two percentiles of their group."""
    edges = df.groupBy(*by).agg(F.percentile(value, low).alias("__l"), F.percentile(value, high).alias("__h"))
    unit = (F.col(value) - F.col("__l")) / F.nullif(F.col("__h") - F.col("__l"), F.lit(0.0))
    return df.join(edges, by).withColumn("stretched", F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0))).drop("__l", "__h")


def rotation_medoid(df: DataFrame, by: list[str], item: str, quaternion: list[str], block: str) -> DataFrame:
    """The rotation with the smallest median angle to the others of its group. Groups are further cut by `block`, so pairs stay few."""
    a = df.select(*by, block, F.col(item).alias("item"), *[F.col(c).alias(f"a{i}") for i, c in enumerate(quaternion)])
    b = df.select(*by, block, F.col(item).alias("other"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(quaternion)])
    angle = K.quaternion_angle([F.col(f"a{i}") for i in range(4)], [F.col(f"b{i}") for i in range(4)])
    medians = a.join(b, [*by, block]).filter("item <> other").groupBy(*by, block, "item").agg(F.median(angle).alias("median"))
    return medians.groupBy(*by, block).agg(F.min_by("item", F.struct(F.round("median", 9), "item")).alias("medoid"), F.min("median").alias("median"))


def best_format(pred: K.Box, truth: K.Box, width: Column, height: Column) -> tuple[Column, Column]:
    """Best IoU of a predicted box over what its numbers may mean (pixels, thousandths, corner and size), and that meaning."""
    x, y, a, b = pred
    pixels, thousand, corner = pred, K.scaled_box(pred, width, height), (x, y, x + a, y + b)
    scores = [F.struct(F.round(K.box_iou(p, truth, True), 9).alias("iou"), F.lit(-i).alias("rank"), F.lit(n).alias("meaning")) for i, (n, p) in enumerate((("pixels", pixels), ("thousandths", thousand), ("corner_size", corner)))]
    best = F.greatest(*scores)
    return best["iou"], best["meaning"]


def split_answer(text: Column) -> tuple[Column, Column]:
    """The phrase after the last "answer:" of a diagnostic text (else the whole), and the names of its defects."""
    marked = F.regexp_extract(text, r"(?is).*answer\s*[:=]\s*(.*)$", 1)
    phrase = F.trim(F.when(marked != "", marked).otherwise(text))
    flags = {"empty": phrase == "", "no_marker": marked == "", "long": F.length(phrase) > 60, "lines": phrase.contains("\n"), "question": phrase.endswith("?")}
    return phrase, F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
