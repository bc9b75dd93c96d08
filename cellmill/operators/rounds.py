"""Greedy choices over groups of any size, as rounds of joins and aggregates.

`operators.grouped` runs the same rules group by group in Python, which suits clips and frames. Here a group may hold a third of all rows: a round
aggregates every group at once with partial sums or minima, keeps one row (or the mutual best rows) of each, and what it decides is written out, so lineage
stays short and a lost executor costs a round. Identities are unique in their group (farthest_points) or need not be (the others).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmill.session import settle

#: Groups up to which their picks (a row each) are broadcast; with more, the join is shuffled and skew is left to adaptive execution.
BROADCAST_GROUPS = 100_000


def _hash(seed: str, column: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), column.cast("string")), 256)


def farthest_points(df: DataFrame, keys: list[str], order: str, point: Sequence[str], budget: int) -> DataFrame:
    """Identities of up to `budget` points of each group: the first by order, then always the one furthest from those picked (ties: first by order). A round reads
    the points once and compares each with its group's picks; no point is moved while the picks are broadcast. Rows with a null key, order or coordinate take no part."""
    points = df.select(*keys, F.col(order).alias("__o"), F.array(*[F.col(c).cast("double") for c in point]).alias("__p")).dropna(subset=[*keys, "__o"])
    points = settle(points.filter(~F.exists("__p", lambda x: x.isNull())))
    first = F.min(F.struct(F.col("__o").alias("o"), F.col("__p").alias("p")))
    picks = settle(points.groupBy(*keys).agg(F.array(first).alias("__picks")))
    few = picks.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    for _ in range(budget - 1):
        met = points.join(F.broadcast(picks) if few else picks, keys).filter(~F.exists("__picks", lambda k: k["o"] == F.col("__o")))
        gap = F.array_min(F.transform("__picks", lambda k: square(F.col("__p"), k["p"])))
        best = met.groupBy(*keys).agg(F.min(F.struct((-gap).alias("g"), F.col("__o").alias("o"), F.col("__p").alias("p"))).alias("__b"))
        grown = F.when(F.col("__b").isNull(), F.col("__picks")).otherwise(F.concat("__picks", F.array(F.struct(F.col("__b.o").alias("o"), F.col("__b.p").alias("p")))))
        before, picks = picks, settle(picks.join(best, keys, "left").select(*keys, grown.alias("__picks")))
        if before.agg(F.sum(F.size("__picks"))).first()[0] == picks.agg(F.sum(F.size("__picks"))).first()[0]:
            break
    return picks.select(*keys, F.explode("__picks.o").alias(order))


def set_cover(df: DataFrame, keys: list[str], identity: str, element: str, most: int, seed: str = "cover") -> DataFrame:
    """Up to `most` identities of each group chosen greedily: the one that adds most elements, ties by hash; with what it adds and its place. A round counts what is
    uncovered by identity and sends on the elements that the chosen one doesn't have, so its rows only grow fewer. Rows with a null identity or element count for nothing."""
    left = settle(df.select(*keys, identity, element).dropna(subset=[*keys, identity, element]).distinct())
    chosen = []
    for place in range(most):
        gains = left.groupBy(*keys, identity).agg(F.count(F.lit(1)).cast("int").alias("gain"))
        order = F.struct(-F.col("gain"), _hash(seed, F.col(identity)))
        best = settle(gains.groupBy(*keys).agg(F.min_by(F.struct(identity, "gain"), order).alias("b")).select(*keys, f"b.{identity}", "b.gain"))
        if best.isEmpty():
            break
        chosen.append(best.withColumn("place", F.lit(place)))
        if place + 1 < most:
            covered = left.join(best.select(*keys, identity), [*keys, identity], "left_semi").select(*keys, element)
            left = settle(left.join(covered, [*keys, element], "left_anti"))
    empty = left.select(*keys, identity, F.lit(0).alias("gain"), F.lit(0).alias("place")).limit(0)
    for c in chosen:
        empty = empty.unionByName(c)
    return empty


def conflict_free(df: DataFrame, keys: list[str], left: str, right: str, weight: str) -> DataFrame:
    """One-to-one pairs, heaviest vote first (ties by left, then right). A pair that is the best of both its ends is what the sequential rule would take whatever
    else happens; a round takes all of these and drops every pair that shares an end with one. Rounds go on until no pair is left: few for votes in no particular order,
    as many as pairs in the worst case (votes that fall along a chain). Rows with a null key, end or weight take no part."""
    votes = settle(df.select(*keys, left, right, weight).dropna())
    taken = []
    while not votes.isEmpty():
        rank = F.struct((-F.col(weight)).alias("w"), F.col(left).alias("l"), F.col(right).alias("r"))
        ends = lambda end: votes.groupBy(*keys, end).agg(F.min(rank).alias("__best"))
        by_left, by_right = ends(left), ends(right)
        mutual = by_left.join(by_right.select(*keys, "__best"), [*keys, "__best"]).select(*keys, F.col("__best.l").alias(left), F.col("__best.r").alias(right), (-F.col("__best.w")).alias(weight))
        picked = settle(mutual)
        taken.append(picked)
        rest = votes.join(picked.select(*keys, left), [*keys, left], "left_anti").join(picked.select(*keys, right), [*keys, right], "left_anti")
        votes = settle(rest)
    out = votes
    for t in taken:
        out = out.unionByName(t)
    return out.select(*keys, left, right, F.col(weight).cast(dict(df.dtypes)[weight]).alias(weight))
