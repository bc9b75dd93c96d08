"""Scores of cells: tier means, weighted phase scores, transitions, desirability composites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIER_WEIGHTS = {"easy": 0.25, "medium": 0.35, "hard": 0.40}


@dataclass(frozen=True)
class Spec:
    """Direction and bounds of a metric: desirability 1 at best, 0 at worst."""

    name: str
    best: float
    worst: float

    @property
    def direction(self) -> str:
        return "lower" if self.best < self.worst else "higher"


def tier_means(samples: DataFrame, metric: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of a metric by tier as columns; samples without a tier or a value don't count."""
    mean = lambda t: F.avg(F.when(F.col("difficulty") == t, F.col(metric))).alias(t)
    return samples.groupBy(*keys).agg(*[mean(t) for t in TIER_WEIGHTS])


def weighted_tiers(weights: dict[str, float] = TIER_WEIGHTS) -> Column:
    """Weighted mean of the tier columns that exist, weights renormalised; 0 if none does."""
    top = sum((F.coalesce(F.col(t) * w, F.lit(0.0)) for t, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(t).isNotNull(), w).otherwise(0.0) for t, w in weights.items()), F.lit(0.0))
    return F.when(weight > 0, top / weight).otherwise(0.0)


def phase_scores(samples: DataFrame, metric: str, phases: tuple[str, ...] = ("clutter", "interaction", "clean")) -> DataFrame:
    """One row: weighted score of each phase, their mean, and the two transitions."""
    by_phase = tier_means(samples.filter(F.col("phase").isNotNull()), metric, ("phase",)).select("phase", weighted_tiers().alias("s"))
    one = by_phase.agg(*[F.coalesce(F.max(F.when(F.col("phase") == p, F.col("s"))), F.lit(0.0)).alias(f"s_{p}") for p in phases])
    a, b, c = (F.col(f"s_{p}") for p in phases)
    return one.select(*[f"s_{p}" for p in phases], ((a + b + c) / 3).alias("s_overall"), (b - a).alias("delta_int"), (c - b).alias("delta_rec"))


def transitions(by_phase: DataFrame, keys: list[str], value: str, phases: tuple[str, ...] = ("clutter", "interaction", "clean")) -> DataFrame:
    """Differences between consecutive phases; a missing phase counts as 0."""
    at = [F.coalesce(F.max(F.when(F.col("phase") == p, F.col(value))), F.lit(0.0)).alias(f"m_{p}") for p in phases]
    a, b, c = (F.col(f"m_{p}") for p in phases)
    return by_phase.groupBy(*keys).agg(*at).withColumn("str_c_to_i", b - a).withColumn("str_i_to_l", c - b)


def ratio(spec: Spec) -> Column:
    return (F.col(spec.name) - spec.worst) / (spec.best - spec.worst)


def desirability(spec: Spec, floor: float = 0.0) -> Column:
    return F.least(F.greatest(ratio(spec), F.lit(floor)), F.lit(1.0))


def composite(specs: list[Spec], epsilon: float = 0.0) -> Column:
    """Geometric mean of desirabilities, 0 if any is 0. With epsilon > 0 that is their floor."""
    each = [desirability(s, epsilon) for s in specs]
    logs = sum((F.when(d > 0, F.ln(d)).otherwise(0.0) for d in each), F.lit(0.0))
    return F.when(F.least(*each, F.lit(1.0)) <= 0, 0.0).otherwise(F.exp(logs / len(specs)))


def out_of_bounds(specs: list[Spec]) -> Column:
    """Names of metrics outside their bounds before clipping."""
    return F.array_compact(F.array(*[F.when((ratio(s) < 0) | (ratio(s) > 1), F.lit(s.name)) for s in specs]))


def composite_by_model(cells: DataFrame, specs: list[Spec], keys: list[str], epsilon: float = 0.0) -> DataFrame:
    """Means of the composite by keys and phase, and over all phases (phase null), with the number of cells out of bounds."""
    scored = cells.withColumn("j", composite(specs, epsilon)).withColumn("oob", (F.size(out_of_bounds(specs)) > 0).cast("long"))
    sets = [[*map(F.col, keys), F.col("phase")], [*map(F.col, keys)]]
    return scored.groupingSets(sets, *keys, "phase").agg(F.avg("j").alias("jedi"), F.sum("oob").alias("n_oob"), F.count(F.lit(1)).alias("n_cells"))


def worst_phase(cells: DataFrame, specs: list[Spec], keys: list[str]) -> DataFrame:
    """Smallest phase mean of the composite, and its phase (ties: first by name)."""
    means = cells.withColumn("j", composite(specs)).groupBy(*keys, "phase").agg(F.avg("j").alias("m"))
    return means.groupBy(*keys).agg(F.min("m").alias("j_min"), F.min_by("phase", F.struct("m", "phase")).alias("worst_phase"))
