"""Joins: prioritised lookups, guarded keys, offset, range and nearest joins. Range joins are equi-joins on buckets, so no join
compares all pairs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmill.operators.nearby import nearest_rows


def lookup_first(left: DataFrame, right: DataFrame, key_pairs: list[tuple[str, str]], value: str) -> DataFrame:
    """left with the value found by the first key pair (left column, right column) that finds one, and its number (from 1)."""
    out = left
    for i, (a, b) in enumerate(key_pairs):
        found = right.filter(F.col(b).isNotNull()).groupBy(F.col(b).alias(f"__k{i}")).agg(F.min(value).alias(f"__v{i}"))
        out = out.join(found, out[a] == F.col(f"__k{i}"), "left")
    values = [F.col(f"__v{i}") for i in range(len(key_pairs))]
    tier = F.coalesce(*[F.when(v.isNotNull(), i + 1) for i, v in enumerate(values)])
    return out.withColumn(value, F.coalesce(*values)).withColumn("matched_by", tier).drop(*[f"__{x}{i}" for i in range(len(key_pairs)) for x in "kv"])


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that are not unique; empty if a join on them can't multiply rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def verified(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """left with agrees: null if the key is unknown on the right, else whether the two values are equal."""
    other = right.select(F.col(key).alias("__k"), F.col(b).alias("__b"), F.lit(True).alias("__known"))
    return left.join(other, left[key] == F.col("__k"), "left").withColumn("agrees", F.when(F.col("__known"), F.col(a).eqNullSafe(F.col("__b")))).drop("__k", "__b", "__known")


def in_all(df: DataFrame, others: list[DataFrame], *keys: str) -> DataFrame:
    for other in others:
        df = df.join(other.select(*keys).distinct(), list(keys), "left_semi")
    return df


def in_none(df: DataFrame, others: list[DataFrame], *keys: str) -> DataFrame:
    for other in others:
        df = df.join(other.select(*keys).distinct(), list(keys), "left_anti")
    return df


def coverage(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Keys on one side only: status missing or extra."""
    e, f = expected.select(*keys).distinct(), found.select(*keys).distinct()
    return e.join(f, list(keys), "left_anti").withColumn("status", F.lit("missing")).unionByName(f.join(e, list(keys), "left_anti").withColumn("status", F.lit("extra")))


def changes(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Keys with status removed, added or remained."""
    b = before.select(*keys).distinct().withColumn("__b", F.lit(True))
    a = after.select(*keys).distinct().withColumn("__a", F.lit(True))
    status = F.when(F.col("__a").isNull(), "removed").when(F.col("__b").isNull(), "added").otherwise("remained")
    return b.join(a, list(keys), "full").withColumn("status", status).drop("__a", "__b")


def latest_wins(parts: list[DataFrame], *keys: str) -> DataFrame:
    """Union of maps; of several values of a key the one from the last part stays."""
    tagged = None
    for i, part in enumerate(parts):
        one = part.select(*keys, F.struct(F.lit(i).alias("i"), *[c for c in part.columns if c not in keys]).alias("r"))
        tagged = one if tagged is None else tagged.unionByName(one)
    rest = [c for c in parts[0].columns if c not in keys]
    return tagged.groupBy(*keys).agg(F.max("r").alias("r")).select(*keys, *[F.col(f"r.{c}") for c in rest])


def offset_pairs(df: DataFrame, keys: list[str], order: str, gap: int, *carry: str) -> DataFrame:
    """Rows whose order differs by exactly gap: order_a, order_b and both sides' carried columns."""
    a = df.select(*keys, F.col(order).alias("order_a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    b = df.select(*keys, F.col(order).alias("order_b"), (F.col(order) - gap).alias("order_a"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return a.join(b, [*keys, "order_a"])


def lead_pairs(df: DataFrame, keys: list[str], order: list[str], stride: int, *carry: str) -> DataFrame:
    """A row and the one `stride` places after it."""
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.select(*keys, *order, *carry, *[F.lead(c, stride).over(w).alias(f"{c}_next") for c in (*order, *carry)])
    return out.filter(F.col(f"{order[-1]}_next").isNotNull())


def within_gap(df: DataFrame, keys: list[str], order: str, gap: int, *carry: str) -> DataFrame:
    """Pairs with 0 < order_b - order_a <= gap. Buckets of width gap: a partner is in the same bucket or the next."""
    a = df.select(*keys, F.col(order).alias("order_a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    a = a.withColumn("__bucket", F.explode(F.array(F.floor(F.col("order_a") / gap), F.floor(F.col("order_a") / gap) + 1)))
    b = df.select(*keys, F.col(order).alias("order_b"), F.floor(F.col(order) / gap).alias("__bucket"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return a.join(b, [*keys, "__bucket"]).filter((F.col("order_b") > F.col("order_a")) & (F.col("order_b") <= F.col("order_a") + gap)).drop("__bucket")


def first_match(pairs: DataFrame, keys: list[str], offset: Column, condition: Column) -> DataFrame:
    """For each key the pair with the smallest offset that meets a condition."""
    w = W.partitionBy(*keys).orderBy(offset)
    return pairs.filter(condition).withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """left with the latest right value at or before its time, by one union and a running last value."""
    rows = left.select(*left.columns, F.lit(1).alias("__side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"))
    extra = right.select(*keys, time, F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = W.partitionBy(*keys).orderBy(time, "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = rows.unionByName(extra, allowMissingColumns=True)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).filter("__side = 1").drop("__side", "__v")


def near_in_time(left: DataFrame, right: DataFrame, keys: list[str], time: str, limit: float) -> DataFrame:
    """Pairs whose times (numbers) differ by less than limit: time_a, time_b."""
    bucket = F.floor(F.col(time) / limit)
    a = left.select(*keys, F.col(time).alias("time_a"), *[F.col(c).alias(f"{c}_a") for c in left.columns if c not in (*keys, time)], bucket.alias("__b"))
    a = a.withColumn("__b", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)))
    b = right.select(*keys, F.col(time).alias("time_b"), *[F.col(c).alias(f"{c}_b") for c in right.columns if c not in (*keys, time)], bucket.alias("__b"))
    return a.join(b, [*keys, "__b"]).filter(F.abs(F.col("time_a") - F.col("time_b")) < limit).drop("__b")


def chains(df: DataFrame, keys: list[str], order: str, hops: int, stride: int) -> DataFrame:
    """Rows from which order + stride, ..., order + hops * stride all exist."""
    steps = df.select(*keys, F.col(order).alias("start"), F.explode(F.sequence(F.lit(1), F.lit(hops))).alias("hop")).withColumn("at", F.col("start") + F.col("hop") * stride)
    there = df.select(*keys, F.col(order).alias("at")).distinct()
    return steps.join(there, [*keys, "at"], "left_semi").groupBy(*keys, "start").agg(F.countDistinct("hop").alias("n")).filter(F.col("n") == hops).drop("n")


def item_pairs(df: DataFrame, frame: list[str], item: str, *carry: str) -> DataFrame:
    """Pairs of items of a frame, each once: item_a < item_b. Frames hold few items."""
    a = df.select(*frame, F.col(item).alias(f"{item}_a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    b = df.select(*frame, F.col(item).alias(f"{item}_b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return a.join(b, frame).filter(F.col(f"{item}_a") < F.col(f"{item}_b"))


def nearest_in_direction(df: DataFrame, frame: list[str], item: str, x: str, y: str) -> DataFrame:
    """For each item and direction the nearest other item that way, by Manhattan distance, ties by item."""
    a = df.select(*frame, F.col(item).alias("item"), F.col(x).alias("xa"), F.col(y).alias("ya"))
    b = df.select(*frame, F.col(item).alias("other"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    ways = F.array_compact(F.array(F.when(dx < 0, "left"), F.when(dx > 0, "right"), F.when(dy < 0, "above"), F.when(dy > 0, "below")))
    pairs = a.join(b, frame).filter("item <> other").withColumn("direction", F.explode(ways)).withColumn("distance", F.abs(dx) + F.abs(dy))
    return pairs.groupBy(*frame, "item", "direction").agg(F.min_by("other", F.struct("distance", "other")).alias("nearest"), F.min("distance").alias("distance"))


def nearest_within(left: DataFrame, right: DataFrame, point: tuple[str, str, str], radius: float, left_id: str, right_id: str) -> DataFrame:
    """For each left point the nearest right point not further than radius (ties to the smaller id), in leaves of a k-d tree: grid cells as wide as the radius may hold
    all points. Ids are whole numbers; points with a null or non-finite coordinate take no part."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    points = lambda df, i: df.filter(F.col(i).isNotNull() & reduce(and_, map(fine, point))).select(F.col(i).cast("long").alias("row"), F.array(*[F.col(c).cast("double") for c in point]).alias("x"))
    found = nearest_rows(points(left, left_id), points(right, right_id), 1, radius)
    return found.select(F.col("row").alias("id_a"), F.col("other").alias("id_b"), F.sqrt("d2").alias("distance"))
