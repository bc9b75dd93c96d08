"""Difficulty scoring: percentile norms, weighted scores, thirds, votes, confidence under random weights, splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmill.operators.ranks import global_rank, percentile_norm, tertile
from cellmill.session import settle

TIER_ORDER = ("easy", "medium", "hard")


def long_features(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, value, p: the percentile norm of each feature's values."""
    long = df.unpivot(keys, features, "feature", "value")
    return percentile_norm(long, ("feature",), "value", "p")


def scores(normed: DataFrame, keys: list[str], weights: DataFrame | None = None) -> DataFrame:
    """Weighted mean (weights: feature, weight; renormalised over those given), median and maximum of the norms."""
    weighted = normed.join(F.broadcast(weights), "feature") if weights is not None else normed.withColumn("weight", F.lit(1.0))  # one row a feature
    return weighted.groupBy(*keys).agg(
        (F.sum(F.col("weight") * F.col("p")) / F.sum("weight")).alias("weighted"), F.median("p").alias("median"), F.max("p").alias("max")
    )


def effort_stratified(features: list[str], effort: tuple[str, ...], alpha: float = 0.25) -> dict[str, float]:
    """Weights that give the effort features a share of alpha, equally, and all others the rest; equal weights if all are effort."""
    marked = [f for f in features if f in effort]
    others = [f for f in features if f not in effort]
    if not marked or not 0 <= alpha <= 1:
        raise ValueError(f"no effort feature among {features}" if not marked else f"alpha must lie in [0, 1], not {alpha}")
    if not others:
        return {f: 1 / len(features) for f in features}
    return {f: alpha / len(marked) if f in effort else (1 - alpha) / len(others) for f in features}


def category_scores(normed: DataFrame, categories: DataFrame, keys: list[str]) -> DataFrame:
    """Mean norm of each category of features (categories: feature, category)."""
    return normed.join(F.broadcast(categories), "feature").groupBy(*keys, "category").agg(F.avg("p").alias("score"))


def tiers(df: DataFrame, value: str, *ties: str, out: str = "tier") -> DataFrame:
    """Thirds by ordinal rank of a score; fewer than three distinct scores are all medium."""
    distinct = F.broadcast(df.agg(F.countDistinct(value).alias("__d")))
    ranked = global_rank(df, value, *ties).crossJoin(distinct)  # one row
    return ranked.withColumn(out, tertile(F.col("rank"), F.col("total"), F.col("__d"))).drop("__d", "rank", "total")


def consensus(votes: DataFrame, keys: list[str], tier: str = "tier") -> DataFrame:
    """The tier with the most votes; ties go to the easier one."""
    place = F.array_position(F.array(*[F.lit(t) for t in TIER_ORDER]), F.col(tier))
    counted = votes.groupBy(*keys, tier).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.max_by(tier, F.struct(F.col("n"), -place)).alias("consensus"), F.max("n").alias("votes"))


def scene_splits(phase_scores: DataFrame, value: str, scene: str = "scene") -> DataFrame:
    """Scenes by mean score: the first floor(N/3) easy, as many medium, the rest hard."""
    means = phase_scores.groupBy(scene).agg(F.avg(value).alias("score"))
    third = F.floor(F.col("total") / 3)
    split = F.when(F.col("rank") <= third, "easy").when(F.col("rank") <= 2 * third, "medium").otherwise("hard")
    return global_rank(means, "score", scene).withColumn("split", split).drop("rank", "total")


def mode_split(frames: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent known value; ties go to the smaller one."""
    counted = frames.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    top = W.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counted.withColumn("k", F.row_number().over(top)).filter("k = 1").drop("k")


#: Flip rates below which a tier is of high or medium confidence.
HIGH_BELOW, MEDIUM_BELOW = 0.10, 0.50
#: Accuracy of approximate quantiles that bracket a border (their error is one in that many rows).
BRACKET = 10_000


def tier_borders(scored: DataFrame, by: str, value: str, ties: list[str], total: int) -> DataFrame:
    """by, easy and medium: the (value, ties) of the last row of the first and of the second third in each group; null where a third
    is empty. Each group has `total` rows. Two approximate quantiles bracket a border, the rows below are counted and only the few
    rows between are ordered, so the groups' rows are never shuffled."""
    ranks = [total // 3, 2 * total // 3]
    slack = 2.0 / BRACKET
    shares = [min(max(r / total + d, 0.0), 1.0) for r in ranks for d in (-slack, slack)]
    # approximate quantiles may differ whenever a plan runs, so they are settled before several readers use them; a row for each group
    brackets = F.broadcast(settle(scored.groupBy(by).agg(F.percentile_approx(value, shares, BRACKET).alias("__b"))))
    lows, highs = [F.col("__b")[0], F.col("__b")[2]], [F.col("__b")[1], F.col("__b")[3]]
    near = scored.join(brackets, by)
    below = near.groupBy(by).agg(*[F.count_if(F.col(value) < low).alias(f"__less{i}") for i, low in enumerate(lows)])
    between = lambda i: near.filter((F.col(value) >= lows[i]) & (F.col(value) <= highs[i])).select(by, F.struct(value, *ties).alias("__row"))
    out = below
    for i, name in enumerate(("easy", "medium")):
        number = F.row_number().over(W.partitionBy(by).orderBy("__row"))
        at = between(i).join(F.broadcast(below.select(by, f"__less{i}")), by).withColumn("__k", number + F.col(f"__less{i}")).filter(F.col("__k") == ranks[i])
        out = out.join(at.select(by, F.col("__row").alias(name)), by, "left")
    return out.select(by, "easy", "medium")


def confidence(normed: DataFrame, keys: list[str], base: DataFrame, replicates: int = 1000, seed: str = "weights", high: float = HIGH_BELOW, medium: float = MEDIUM_BELOW) -> DataFrame:
    """Share of replicates in which a key leaves its tier when features are weighted by normalised exponential draws, which are
    flat Dirichlet weights, and the label of that share. base: keys and tier. Draws are hashes, so a replicate is the same everywhere.
    Replicates are made where the keys' norms are; borders and flips are aggregated there, so the shuffles carry a row a replicate
    and a row a key, not their product."""
    features = sorted(r.feature for r in normed.select("feature").distinct().collect())  # names of columns, a few dozen
    if not features:
        return base.select(*keys, "tier", F.lit(0.0).alias("flip_rate"), F.lit("high").alias("confidence")).limit(0)
    wide = settle(normed.groupBy(*keys).pivot("feature", features).agg(F.first("p")))
    total = wide.count()
    spark = normed.sparkSession
    u = lambda f: (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("replicate").cast("string"), F.lit(f)), 256), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    draws = spark.range(replicates).withColumnRenamed("id", "replicate")
    draws = draws.select("replicate", *[(-F.ln(u(f))).alias(f"__w{i}") for i, f in enumerate(features)])
    each = wide.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")))).join(F.broadcast(draws), "replicate")
    known = [(F.col(f"`{f}`"), F.col(f"__w{i}")) for i, f in enumerate(features)]
    weight = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in known), F.lit(0.0))
    score = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in known), F.lit(0.0)) / weight
    scored = each.select(*keys, "replicate", F.round(score, 9).alias("score"))
    borders = settle(tier_borders(scored, "replicate", "score", keys, total))
    row = F.struct("score", *keys)
    drawn = F.when(row <= F.col("easy"), "easy").when(row <= F.col("medium"), "medium").otherwise("hard")
    joined = scored.join(F.broadcast(borders), "replicate").select(*keys, (F.lit("medium") if total < 3 else drawn).alias("drawn"))
    tallies = joined.groupBy(*keys).agg(*[F.count_if(F.col("drawn") == t).alias(f"__{t}") for t in TIER_ORDER])
    kept = sum((F.when(F.col("tier") == t, F.col(f"__{t}")).otherwise(0) for t in TIER_ORDER), F.lit(0))
    rate = (replicates - kept) / replicates
    label = F.when(F.col("flip_rate") < high, "high").when(F.col("flip_rate") < medium, "medium").otherwise("low")
    return base.join(tallies, keys).select(*keys, "tier", rate.alias("flip_rate")).withColumn("confidence", label)


def principal_axes(df: DataFrame, features: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and the n leading axes of the features' covariance, from sums; every axis points where features grow together."""
    row = df.agg(*[F.avg(f).alias(f"a_{f}") for f in features], *[F.covar_pop(f, g).alias(f"c_{i}_{j}") for i, f in enumerate(features) for j, g in enumerate(features) if i <= j]).first()
    k = len(features)
    cov = np.array([[row[f"c_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :n].T
    signs = np.where(axes.sum(axis=1) < 0, -1.0, 1.0)
    return np.array([row[f"a_{f}"] or 0.0 for f in features]), axes * signs[:, None]


def component_scores(df: DataFrame, keys: list[str], features: list[str], n: int = 1) -> DataFrame:
    """keys and pc1 .. pcn: projections of centred features (a column a feature) on the leading axes."""
    means, axes = principal_axes(df, features, n)
    on = lambda axis: sum(((F.col(f) - float(m)) * float(w) for f, m, w in zip(features, means, axis)), F.lit(0.0))
    return df.select(*keys, *[on(a).alias(f"pc{i + 1}") for i, a in enumerate(axes)])


def cluster_tiers(df: DataFrame, keys: list[str], features: list[str], n: int = 5, seed: int = 7) -> DataFrame:
    """Three k-means clusters on leading components, named by their mean feature: easy, medium, hard."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    scored = component_scores(df, keys, features, min(n, len(features))).join(df, keys)
    points = VectorAssembler(inputCols=[c for c in scored.columns if c.startswith("pc")], outputCol="__x").transform(scored)
    found = KMeans(k=3, seed=seed, featuresCol="__x", predictionCol="__c").fit(points).transform(points)
    mean = sum((F.col(f) for f in features), F.lit(0.0)) / len(features)
    order = sorted(found.groupBy("__c").agg(F.avg(mean).alias("m")).collect(), key=lambda r: r.m)
    name = F.create_map(*[x for r, t in zip(order, TIER_ORDER) for x in (F.lit(r["__c"]), F.lit(t))])
    return found.select(*keys, name[F.col("__c")].alias("tier"))
