"""Deterministic selection. Ranks are SHA-256 of a seed and an identity, so a draw needs no state and any engine repeats it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmill.operators.ranks import global_rank

SEP = chr(31)


def hash_rank(seed: str, *identity: str | Column) -> Column:
    parts = [F.col(c).cast("string") if isinstance(c, str) else c for c in identity]
    return F.sha2(F.concat_ws(":", F.lit(seed), F.concat_ws(SEP, *parts) if len(parts) > 1 else parts[0]), 256)


def row_identity(*columns: str) -> Column:
    return F.concat_ws(SEP, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def stable_id(*columns: str) -> Column:
    return F.substring(F.sha2(row_identity(*columns), 256), 1, 20)


def top_by_hash(df: DataFrame, by: list[str], n: int, seed: str, *identity: str) -> DataFrame:
    """n rows of each group in hash order. Spark keeps n rows per group and task before the shuffle."""
    h = hash_rank(seed, *identity)
    w = W.partitionBy(*by).orderBy(h)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def quota_per_bin(df: DataFrame, by: list[str], bin: Column, n: int, seed: str, *identity: str) -> DataFrame:
    return top_by_hash(df.withColumn("bin", bin), [*by, "bin"], n, seed, *identity)


def shard(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Round-robin shard of the sorted identities (which must be distinct)."""
    return global_rank(df, order).withColumn("shard", F.pmod(F.col("rank") - 1, F.lit(shards))).drop("rank", "total")


def stratified_cap(df: DataFrame, by: list[str], bucket: str, cap: int, order: list[str], priority: Column | None = None) -> DataFrame:
    """At most cap rows of a group: by priority, then round-robin over its buckets."""
    first = priority if priority is not None else F.lit(0)
    inside = F.row_number().over(W.partitionBy(*by, bucket).orderBy(first, *order))
    dealt = df.withColumn("__p", first).withColumn("__i", inside)
    w = W.partitionBy(*by).orderBy("__p", "__i", bucket)
    return dealt.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= cap).drop("__p", "__i", "__k")


def halves(df: DataFrame, by: list[str], seed: str, *identity: str) -> DataFrame:
    """The first half of each group in hash order, rounded down, and the rest."""
    w = W.partitionBy(*by)
    k = F.row_number().over(w.orderBy(hash_rank(seed, *identity)))
    return df.withColumn("half", F.when(k <= F.floor(F.count(F.lit(1)).over(w) / 2), "first").otherwise("second"))


def even_spaced(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each group at even steps from its start; groups of n or fewer whole."""
    w = W.partitionBy(*by)
    placed = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__c", F.count(F.lit(1)).over(w))
    slot = F.ceil(F.col("__i") * n / F.col("__c"))  # the first slot that starts at or after this row
    take = (F.col("__c") <= n) | ((slot < n) & (F.floor(slot * F.col("__c") / n) == F.col("__i")))
    return placed.filter(take).drop("__i", "__c")


def stride_sample(df: DataFrame, by: list[str], order: list[str], budget: int) -> DataFrame:
    """budget rows of each group at rounded even places, both ends included."""
    w = W.partitionBy(*by)
    placed = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__c", F.count(F.lit(1)).over(w))
    spots = F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), lambda j: F.bround(j * (F.col("__c") - 1) / (budget - 1)).cast("int"))
    return placed.filter((F.col("__c") <= budget) | F.array_contains(spots, F.col("__i").cast("int"))).drop("__i", "__c")


def first_per_stratum(df: DataFrame, stratum: Column, n: int, order: list[str]) -> DataFrame:
    w = W.partitionBy("stratum").orderBy(*order)
    return df.withColumn("stratum", stratum).withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def balanced_negatives(df: DataFrame, by: list[str], positive: str, seed: str, *identity: str) -> DataFrame:
    """All positive rows of a group and as many negative ones in hash order."""
    w = W.partitionBy(*by)
    yes = F.sum(F.col(positive).cast("int")).over(w)
    k = F.row_number().over(W.partitionBy(*by, positive).orderBy(hash_rank(seed, *identity)))
    return df.withColumn("__y", yes).withColumn("__k", k).filter(F.col(positive) | (F.col("__k") <= F.col("__y"))).drop("__y", "__k")


def best_row(df: DataFrame, by: list[str], gate: Column, order: list[Column]) -> DataFrame:
    """The best row of each group among those that pass a gate."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.filter(gate).withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
