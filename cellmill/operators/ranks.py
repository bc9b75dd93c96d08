"""Global ranks without a single-partition window, percentile norms and thirds.

A global row number needs one order over the whole table. Rows are sorted into ranges by value and ties, as many as the session has
shuffle partitions; numbers are counted within ranges, and the sizes of earlier ranges are added. A value that many rows share is cut by its
ties, so no range holds it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmill.session import settle

BUCKETS = 64


def global_rank(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """df with rank (1-based, ascending by value, then ties; nulls and NaN last) and total (rows)."""
    number = dict(df.dtypes)[value] in ("double", "float")
    key = F.when(~F.isnan(value), F.col(value)) if number else F.col(value)
    order = [key.asc_nulls_last(), *ties]
    # ranges are sampled anew whenever the plan runs, so they are settled before two readers use them
    dealt = settle(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    up_to = W.orderBy("__range").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row for each range
    offsets = sizes.select("__range", (F.sum("__n").over(up_to) - F.col("__n")).alias("__before"), F.sum("__n").over(W.partitionBy()).alias("total"))
    within = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    ranked = dealt.withColumn("__within", within).join(F.broadcast(offsets), "__range")
    return ranked.withColumn("rank", F.col("__within") + F.col("__before")).drop("__range", "__within", "__before")


def tertile(rank: Column, total: Column, distinct: Column | None = None) -> Column:
    """Third by ordinal rank; fewer than three distinct scores are all medium."""
    third = F.when(rank * 3 <= total, "easy").when(rank * 3 <= total * 2, "medium").otherwise("hard")
    few = (distinct if distinct is not None else total) < 3
    return F.when(few, "medium").otherwise(third)


def percentile_norm(df: DataFrame, by: tuple[str, ...], value: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Average rank over the number of valid values within groups `by`; ties share their mean, missing values and
    constant groups get 0.5. Ranks are counted over distinct values, so ties never meet in one task as rows, and within buckets
    between approximate quantiles, so a group is not one task either. Sums of doubles and approximate quantiles may differ whenever a plan runs, so
    the values and the quantiles are settled before more than one reader uses them."""
    valid = F.when(~F.isnan(value), F.col(value))
    df = settle(df)
    seen = df.select(*by, valid.alias("__v")).filter("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    groups = seen.groupBy(*by).agg(F.percentile_approx("__v", shares, F.lit(1000)).alias("__cuts"), F.sum("__n").alias("__total"), F.count(F.lit(1)).alias("__distinct"))
    placed = seen.join(F.broadcast(settle(groups)), list(by)).withColumn("__bucket", F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))).drop("__cuts")
    sizes = placed.groupBy(*by, "__bucket").agg(F.sum("__n").alias("__s"))
    before = F.sum("__s").over(W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__s")
    running = F.sum("__n").over(W.partitionBy(*by, "__bucket").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = placed.withColumn("__running", running).join(sizes.withColumn("__before", before).drop("__s"), [*by, "__bucket"])
    average = (F.col("__before") + F.col("__running") - F.col("__n") + (F.col("__n") + 1) / 2) / F.col("__total")
    norms = ranked.select(*by, "__v", F.when(F.col("__distinct") < 2, F.lit(0.5)).otherwise(average).alias("__p"))
    return df.withColumn("__v", valid).join(norms, [*by, "__v"], "left").withColumn(out, F.coalesce("__p", F.lit(0.5))).drop("__v", "__p")


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and, by name, exact percentiles of the known values of each group, linear between neighbours. Different values are counted and sorted into
    ranges; sizes of earlier ranges are added, so no task holds a group's values."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    dealt = settle(counted.repartitionByRange(*by, "__v").withColumn("__range", F.spark_partition_id()))  # ranges are sampled anew by every run
    of = [f"__of_{c}" for c in by]
    sizes = dealt.groupBy(*[F.col(c).alias(o) for c, o in zip(by, of)], F.col("__range").alias("__in")).agg(F.sum("__n").alias("__s"))  # a row for each range
    up_to = W.partitionBy(*of).orderBy("__in").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sizes.withColumn("__before", F.sum("__s").over(up_to) - F.col("__s")).withColumn("__total", F.sum("__s").over(W.partitionBy(*of))).drop("__s")
    running = F.sum("__n").over(W.partitionBy("__range", *by).orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow))
    same = F.col("__range") == F.col("__in")
    for c, o in zip(by, of):
        same &= F.col(c).eqNullSafe(F.col(o))
    ranked = dealt.withColumn("__running", running).join(F.broadcast(offsets), same).withColumn("__last", F.col("__before") + F.col("__running"))
    at = lambda place: F.max(F.when((place < F.col("__last")) & (place >= F.col("__last") - F.col("__n")), F.col("__v")))
    spots = {name: q * (F.col("__total") - 1) for name, q in shares.items()}
    ends = [c for name, spot in spots.items() for c in (at(F.floor(spot)).alias(f"__low_{name}"), at(F.ceil(spot)).alias(f"__high_{name}"))]
    found = ranked.groupBy(*by).agg(F.max("__total").alias("__total"), *ends)

    def between(name: str) -> Column:
        low, high, spot = F.col(f"__low_{name}"), F.col(f"__high_{name}"), spots[name]
        return F.when(low == high, low).otherwise((F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high)

    return found.select(*by, *[between(name).alias(name) for name in shares])
