"""Whole analyses: integrity rules first, then every test of a model's cells, as one long table."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill import roles
from cellmill.operators import cells as C
from cellmill.operators import quality as U
from cellmill.operators import scores as S
from cellmill.operators import stats as X
from cellmill.plans.cells import METRICS, SPECS, cells, rounded
from cellmill.session import settle


class IntegrityError(ValueError):
    """Cells that may not be analysed."""


def check_bounds(specs: list[S.Spec], metrics: list[str], epsilon: float) -> None:
    """Bounds must cover exactly the metrics, be finite and distinct, and the floor lie in (0, 1]."""
    if sorted(s.name for s in specs) != sorted(metrics):
        raise IntegrityError(f"bounds must define exactly {metrics}")
    if not 0 < epsilon <= 1:
        raise IntegrityError("epsilon must be in (0, 1]")
    for s in specs:
        if not all(abs(x) < float("inf") for x in (s.best, s.worst)) or s.best == s.worst:
            raise IntegrityError(f"bounds of {s.name} must be finite and differ")


def check_cells(cells: DataFrame, metrics: list[str], phases: tuple[str, ...], scene: str = "scene", tier: str = "tier") -> None:
    """One tier a scene, every phase once, finite metrics, no unknown phase."""
    for problem, table in {
        "scenes without exactly one tier and all phases": U.split_integrity(cells, scene, tier, len(phases)),
        "repeated cells": U.duplicates(cells, scene, "phase"),
        "missing or infinite metrics": U.not_finite(cells, [scene, "phase"], *metrics),
        "unknown phases": cells.filter(~F.col("phase").isin(*phases)),
    }.items():
        found = table.limit(3).collect()
        if found:
            raise IntegrityError(f"{problem}: {[r.asDict() for r in found]}")


def analyse(cells: DataFrame, metrics: list[str], specs: list[S.Spec], phases: tuple[str, ...] = roles.PHASES, lower: tuple[str, ...] = (), epsilon: float = 0.01) -> DataFrame:
    """test, name, value: phase effects of both designs, interaction with tiers, transitions, composites by phase and phase means.
    Raises IntegrityError for cells that break a rule."""
    check_bounds(specs, metrics, epsilon)
    check_cells(cells, metrics, phases)
    spark = cells.sparkSession
    z = X.standardise(cells.select("scene", "phase", "tier", *metrics), metrics, lower)
    cube = X.Cube.of(z, metrics)
    tests = {"oneway": X.phi_oneway(cube), "repeated": X.phi_repeated(cube), "interaction": X.phi_interaction(z, metrics, phases)}
    rows = [(test, name, float(value)) for test, phi in tests.items() for name, value in asdict(phi).items()]
    algebra = spark.createDataFrame(rows, "test string, name string, value double")
    moves = X.transitions(z, metrics, phases).unpivot(["transition"], ["t2", "f", "p_value", "p_holm", "phi"], "name", "value").withColumnRenamed("transition", "test")
    scored = cells.withColumn("jedi", S.composite(specs, epsilon))
    means = scored.groupBy("phase").agg(*[F.avg(m).alias(m) for m in (*metrics, "jedi")]).unpivot(["phase"], [*metrics, "jedi"], "name", "value").withColumnRenamed("phase", "test")
    return algebra.unionByName(moves).unionByName(means)


def full_analysis(spark, sf):
    c = cells(spark, sf).withColumnRenamed("difficulty", "tier")
    return rounded(analyse(settle(C.complete_scenes(c, 3).select("scene", "phase", "tier", *METRICS)), METRICS, SPECS, lower=("absrel", "rmse")))


def track_analysis(cells: DataFrame, metrics: list[str], specs: list[S.Spec], phases: tuple[str, ...] = roles.PHASES, lower: tuple[str, ...] = (), epsilon: float = 0.01) -> DataFrame:
    """Everything that is asked of one model's cells (scene, phase, tier, metrics): the whole analysis, the phase effect within every tier, and means
    with their composites overall, by phase and by tier, as one long table of section, name and value."""
    cells = settle(cells)
    out = analyse(cells, metrics, specs, phases, lower, epsilon).withColumnRenamed("test", "section")
    z = X.standardise(cells, metrics, lower)
    rows = [(f"tier {tier}", name, float(v)) for tier, cube in X.Cube.of_each(z, metrics, "tier").items() for name, v in asdict(X.phi_oneway(cube)).items()]
    out = out.unionByName(cells.sparkSession.createDataFrame(rows, "section string, name string, value double"))
    return out.unionByName(metric_means(cells, metrics, specs, epsilon).unpivot(["section"], [*metrics, "composite"], "name", "value"))


def metric_means(cells: DataFrame, metrics: list[str], specs: list[S.Spec], epsilon: float = 0.01) -> DataFrame:
    """Means over all cells, by phase and by tier, with the composite of the means: section, metrics, composite."""
    sets = cells.groupingSets([[], ["phase"], ["tier"]], "phase", "tier").agg(*[F.avg(m).alias(m) for m in metrics])
    section = F.when(F.col("phase").isNotNull(), F.concat(F.lit("phase "), "phase")).when(F.col("tier").isNotNull(), F.concat(F.lit("tier "), "tier")).otherwise("all")
    return sets.withColumn("section", section).withColumn("composite", S.composite(specs, epsilon)).select("section", *metrics, "composite")


def ego_analysis(cells: DataFrame, metrics: list[str], hardware: list[str], expected: dict[str, int] | None = None) -> DataFrame:
    """Means of metrics over all cells and by tier, and of hardware columns whose values are all finite (null else); the numbers of cells of each tier
    must be as expected, where that is given."""
    if expected is not None:
        found = {r.tier: r.n for r in cells.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}  # a few tiers
        if found != expected:
            raise IntegrityError(f"cells by tier: {found}, expected {expected}")
    fine = lambda c: F.count_if(F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))) == F.count(F.lit(1))
    return cells.groupingSets([[], ["tier"]], "tier").agg(*[F.avg(m).alias(m) for m in metrics], *[F.when(fine(h), F.avg(h)).alias(h) for h in hardware], F.countDistinct("scene").alias("scenes"), F.count(F.lit(1)).alias("cells"))


def tracking_analysis(spark, sf):
    c = C.complete_scenes(cells(spark, sf).withColumnRenamed("difficulty", "tier"), 3).filter("tier IS NOT NULL")
    return rounded(track_analysis(c.select("scene", "phase", "tier", *METRICS), METRICS, SPECS, lower=("absrel", "rmse")))


def tracking_means(spark, sf):
    """Means and composites by phase and tier."""
    return rounded(metric_means(cells(spark, sf).withColumnRenamed("difficulty", "tier"), METRICS, SPECS))


def ego_means(spark, sf):
    c = cells(spark, sf).withColumnRenamed("difficulty", "tier").withColumn("memory", F.when(F.col("scene") % 7 > 0, F.col("n_samples") * 1.5))
    return rounded(ego_analysis(c, METRICS, ["latency_ms_mean", "memory"]))


def phase_summary(spark, sf):
    """Cells, scenes and metric means by phase and tier, with subtotals."""
    c = cells(spark, sf).withColumnRenamed("difficulty", "tier")
    out = c.groupingSets([["phase", "tier"], ["phase"], []], "phase", "tier").agg(*[F.avg(m).alias(m) for m in METRICS], F.countDistinct("scene").alias("scenes"), F.count(F.lit(1)).alias("cells"), F.sum("n_samples").alias("samples"))
    return rounded(out)


def matched_bin_delta(spark, sf):
    """Mean errors of two kinds of pairs within equal bins, and their difference."""
    s = roles.samples(spark, sf).withColumn("bin", F.floor(F.col("latency_ms") / 20)).withColumn("kind", F.when(F.col("model") == "A", "intra").when(F.col("model") == "N", "cross"))
    by = s.filter("kind IS NOT NULL").groupBy("bin").agg(*[F.avg(F.when(F.col("kind") == k, F.col("rmse"))).alias(k) for k in ("intra", "cross")])
    return rounded(by.dropna().withColumn("delta", F.col("cross") - F.col("intra")))


QUERIES = {f.__name__: f for f in (full_analysis, tracking_analysis, tracking_means, ego_means, phase_summary, matched_bin_delta)}

from cellmill.plans.cells import CELLS_SQL  # noqa: E402

_MEANS = ", ".join(f"avg({m}) AS {m}" for m in METRICS)
_RATIO = ", ".join(f"least(greatest(({s.name} - CAST({s.worst} AS DOUBLE)) / CAST({s.best - s.worst!r} AS DOUBLE), CAST(0.01 AS DOUBLE)), 1.0) AS d_{s.name}" for s in SPECS)
ORACLE_SQL = {
    "tracking_means": f"""WITH {CELLS_SQL}, m AS (SELECT 'all' AS section, {_MEANS} FROM cells UNION ALL SELECT 'phase ' || phase, {_MEANS} FROM cells GROUP BY phase UNION ALL SELECT 'tier ' || difficulty, {_MEANS} FROM cells GROUP BY difficulty),
        d AS (SELECT *, {_RATIO} FROM m) SELECT section, round(absrel, 6) AS absrel, round(rmse, 6) AS rmse, round(delta1, 6) AS delta1, round(exp((ln(d_absrel) + ln(d_rmse) + ln(d_delta1)) / 3), 6) AS composite FROM d""",
    "ego_means": f"""WITH {CELLS_SQL}, c AS (SELECT *, difficulty AS tier, CASE WHEN scene % 7 > 0 THEN n_samples * 1.5 END AS memory FROM cells)
        SELECT tier, round(avg(absrel), 6) AS absrel, round(avg(rmse), 6) AS rmse, round(avg(delta1), 6) AS delta1, round(avg(latency_ms_mean), 6) AS latency_ms_mean,
            round(CASE WHEN count(memory) = count(*) THEN avg(memory) END, 6) AS memory, count(DISTINCT scene) AS scenes, count(*) AS cells FROM c GROUP BY GROUPING SETS ((), (tier))""",
    "phase_summary": f"""WITH {CELLS_SQL} SELECT phase, difficulty AS tier, round(avg(absrel), 6) AS absrel, round(avg(rmse), 6) AS rmse, round(avg(delta1), 6) AS delta1, count(DISTINCT scene) AS scenes, count(*) AS cells,
        CAST(sum(n_samples) AS BIGINT) AS samples FROM cells GROUP BY GROUPING SETS ((phase, difficulty), (phase), ())""",
    "matched_bin_delta": f"""WITH {roles.SAMPLES_SQL}, b AS (SELECT CAST(floor(latency_ms / 20) AS BIGINT) AS bin, avg(rmse) FILTER (WHERE model = 'A') AS intra, avg(rmse) FILTER (WHERE model = 'N') AS "cross" FROM samples GROUP BY 1)
        SELECT bin, round(intra, 6) AS intra, round("cross", 6) AS "cross", round("cross" - intra, 6) AS delta FROM b WHERE intra IS NOT NULL AND "cross" IS NOT NULL""",
}
