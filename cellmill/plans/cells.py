"""Queries over cells and their scores, with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill import roles
from cellmill.operators import cells as C
from cellmill.operators import scores as S
from cellmill.operators.ranks import percentiles
from cellmill.session import settle
from cellmill.sources.tables import table

METRICS = list(roles.METRICS)
#: Bounds chosen so that some cells fall outside.
SPECS = [S.Spec("absrel", 0.047, 0.055), S.Spec("rmse", 2.3, 2.7), S.Spec("delta1", 0.966, 0.955)]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as the SQL does it: the product with a power of ten is rounded, so a tie may be lost by the product's last bit."""
    scale = 10.0**digits
    nearest = lambda c: F.when(F.abs(F.col(c)) < 1e300, F.round(F.col(c) * scale) / scale).otherwise(F.col(c))
    return df.select(*[nearest(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return C.cells_from_samples(roles.tiered_samples(spark, sf), METRICS)


CELLS_SQL = f"""{roles.TIERED_SQL}, cells AS (
    SELECT scene, phase, count(*) AS n_samples, avg(absrel) AS absrel, avg(rmse) AS rmse, avg(delta1) AS delta1, avg(latency_ms) AS latency_ms_mean,
        arg_min(difficulty, sample) AS difficulty, arg_min(frame_budget, sample) AS frame_budget
    FROM tiered WHERE scene IS NOT NULL AND phase IS NOT NULL GROUP BY scene, phase)"""
_D = ", ".join(f"least(greatest(({s.name} - CAST({s.worst} AS DOUBLE)) / CAST({s.best - s.worst!r} AS DOUBLE), 0.0), 1.0) AS d_{s.name}" for s in SPECS)
_OUT = " + ".join(f"CASE WHEN ({s.name} - CAST({s.worst} AS DOUBLE)) / CAST({s.best - s.worst!r} AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 1 ELSE 0 END" for s in SPECS)
_MIN = f"least({', '.join('d_' + s.name for s in SPECS)})"


def _jedi_sql(eps: float = 0.0) -> str:
    ds = ", ".join(f"greatest(d_{s.name}, CAST({eps} AS DOUBLE)) AS e_{s.name}" for s in SPECS)
    least = f"least({', '.join('e_' + s.name for s in SPECS)})"
    logs = " + ".join(f"ln(e_{s.name})" for s in SPECS)
    return f"""d AS (SELECT *, {_D}, {_OUT} AS n_out FROM cells), e AS (SELECT *, {ds} FROM d),
        j AS (SELECT *, CASE WHEN {least} <= 0 THEN 0.0 ELSE exp(CASE WHEN {least} <= 0 THEN 0 ELSE ({logs}) / 3 END) END AS jedi FROM (
            SELECT * REPLACE ({", ".join(f"CASE WHEN e_{s.name} <= 0 THEN 0 ELSE e_{s.name} END AS e_{s.name}" for s in SPECS)}) FROM e))"""


def cells_from_samples(spark, sf):
    return rounded(cells(spark, sf))


def cells_union_schema(spark, sf):
    """Two logs with different metrics merged by name."""
    s = roles.tiered_samples(spark, sf)
    a = C.cells_from_samples(s.filter("model = 'A'"), ["absrel", "rmse"]).withColumn("model", F.lit("A"))
    b = C.cells_from_samples(s.filter("model = 'R'"), ["delta1"]).withColumn("model", F.lit("R"))
    return rounded(C.merge_logs(a, b).select("model", "scene", "phase", "n_samples", "absrel", "rmse", "delta1"))


def cells_long(spark, sf):
    return rounded(C.to_long(cells(spark, sf), ["scene", "phase"], METRICS))


def cells_wide(spark, sf):
    long = C.to_long(cells(spark, sf), ["scene", "phase"], METRICS)
    return rounded(C.to_wide(long, ["scene", "phase"], METRICS))


def metric_means_by_phase(spark, sf):
    return rounded(C.mean_by(C.complete_scenes(cells(spark, sf), 3), ["phase"], METRICS))


def weighted_mean_nulls(spark, sf):
    s = roles.samples(spark, sf).withColumn("v", F.when(F.col("frame") % 3 != 0, F.col("rmse"))).withColumn("w", F.when(F.col("frame") != 4, F.col("frame").cast("double")))
    return rounded(C.weighted_means(s, ["model", "task"], "v", "w"))


def latency_percentiles(spark, sf):
    """Percentiles of latency per model after the first frames of each scene are trimmed as warm-up; a scene with no more than those keeps all."""
    from pyspark.sql import Window as W

    s = roles.samples(spark, sf)
    w = W.partitionBy("model", "scene")
    trimmed = s.withColumn("k", F.row_number().over(w.orderBy("sample", "latency_ms"))).withColumn("frames", F.count(F.lit(1)).over(w)).filter("k > 2 OR frames <= 2")
    trimmed = settle(trimmed.select("model", "latency_ms"))  # read twice
    p = percentiles(trimmed, ["model"], "latency_ms", {f"p{round(q * 100)}": q for q in (0.05, 0.5, 0.95, 0.99)}).withColumnRenamed("model", "of")
    rest = trimmed.groupBy("model").agg(F.avg("latency_ms").alias("mean"), F.max("latency_ms").alias("max"), F.count(F.lit(1)).alias("n"))
    joined = rest.join(p, F.col("model").eqNullSafe(F.col("of")), "left")
    return rounded(joined.select("model", "p5", "p50", "p95", "p99", "mean", "max", "n"))


def esd_by_tier(spark, sf):
    return rounded(S.tier_means(roles.tiered_samples(spark, sf), "absrel", ("model",)))


def phase_weighted_score(spark, sf):
    return rounded(S.phase_scores(roles.tiered_samples(spark, sf), "rmse"))


def str_deltas(spark, sf):
    s = C.mean_by(roles.samples(spark, sf), ["model", "phase"], ["rmse"])
    return rounded(S.transitions(s, ["model"], "rmse"))


def jedi_cell(spark, sf):
    return rounded(cells(spark, sf).select("scene", "phase", S.composite(SPECS).alias("jedi"), *[S.desirability(s).alias(f"d_{s.name}") for s in SPECS]))


def jedi_epsilon(spark, sf):
    """With a floor under each desirability."""
    return rounded(cells(spark, sf).select("scene", "phase", S.composite(SPECS, 0.01).alias("jedi")))


def jedi_model(spark, sf):
    """Mean composite by tier, by tier and phase."""
    c = cells(spark, sf).withColumnRenamed("difficulty", "tier")
    return rounded(S.composite_by_model(c, SPECS, ["tier"]))


def jedi_worst_phase(spark, sf):
    return rounded(S.worst_phase(cells(spark, sf).withColumnRenamed("difficulty", "tier"), SPECS, ["tier"]))


def jedi_out_of_bounds(spark, sf):
    names = S.out_of_bounds(SPECS)
    return cells(spark, sf).filter(F.size(names) > 0).select("scene", "phase", F.concat_ws(",", names).alias("out_of_bounds"))


def accurate_and_robust(spark, sf):
    """Tiers whose worst phase still reaches a composite of 0.3."""
    return rounded(S.worst_phase(cells(spark, sf).withColumnRenamed("difficulty", "tier"), SPECS, ["tier"]).withColumn("passes", F.col("j_min") >= 0.3))


def grouping_sets_accuracy(spark, sf):
    """Share of samples under an error bound: overall, by model, by task, by phase."""
    s = roles.samples(spark, sf).withColumn("ok", (F.col("absrel") <= 0.05).cast("double"))
    sets = [[], [F.col("model")], [F.col("task")], [F.col("phase")]]
    return rounded(s.groupingSets(sets, "model", "task", "phase").agg(F.avg("ok").alias("accuracy"), F.count(F.lit(1)).alias("n")))


def summary_by_model(spark, sf):
    """Counts, median, spread and extremes for each model, as a performance summary."""
    s = roles.samples(spark, sf)
    p = percentiles(s.select("model", "latency_ms"), ["model"], "latency_ms", {"median": 0.5, "p95": 0.95}).withColumnRenamed("model", "of")
    rest = s.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("scene").alias("scenes"), F.max("latency_ms").alias("max"), F.min("latency_ms").alias("min"),
        F.stddev_samp("latency_ms").alias("std"), F.sqrt(F.avg(F.col("rmse") * F.col("rmse"))).alias("rms"),
    )
    joined = rest.join(F.broadcast(p), F.col("model").eqNullSafe(F.col("of")), "left")
    return rounded(joined.select("model", "n", "scenes", "median", "p95", "max", "min", "std", "rms"))


def records_schema(spark, sf):
    """Orders as metric records whose group columns are spelled out."""
    o = table(spark, sf, "orders")
    return rounded(o.groupBy(F.col("o_orderpriority").alias("task"), roles.phase_of(F.col("o_orderstatus")).alias("phase")).agg(F.avg("o_totalprice").alias("score"), F.count(F.lit(1)).alias("n")))


QUERIES = {f.__name__: f for f in (
    cells_from_samples, cells_union_schema, cells_long, cells_wide, metric_means_by_phase, weighted_mean_nulls, latency_percentiles, esd_by_tier, phase_weighted_score, str_deltas,
    jedi_cell, jedi_epsilon, jedi_model, jedi_worst_phase, jedi_out_of_bounds, accurate_and_robust, grouping_sets_accuracy, summary_by_model, records_schema,
)}

_WORST = f"""WITH {CELLS_SQL}, {_jedi_sql()}, m AS (SELECT difficulty AS tier, phase, avg(jedi) AS m FROM j GROUP BY ALL)
    SELECT tier, round(min(m), 6) AS j_min, arg_min(phase, struct_pack(a := m, b := phase)) AS worst_phase"""
ORACLE_SQL = {
    "cells_from_samples": f"""WITH {CELLS_SQL} SELECT scene, phase, n_samples, round(absrel, 6) AS absrel, round(rmse, 6) AS rmse, round(delta1, 6) AS delta1,
        round(latency_ms_mean, 6) AS latency_ms_mean, difficulty, frame_budget FROM cells""",
    "cells_union_schema": f"""WITH {roles.SAMPLES_SQL}
        SELECT model, scene, phase, count(*) AS n_samples, CASE WHEN model = 'A' THEN round(avg(absrel), 6) END AS absrel, CASE WHEN model = 'A' THEN round(avg(rmse), 6) END AS rmse,
            CASE WHEN model = 'R' THEN round(avg(delta1), 6) END AS delta1 FROM samples WHERE model IN ('A', 'R') AND phase IS NOT NULL GROUP BY model, scene, phase""",
    "cells_long": f"""WITH {CELLS_SQL} SELECT scene, phase, metric, round(value, 6) AS value FROM (
        SELECT scene, phase, 'absrel' AS metric, absrel AS value FROM cells UNION ALL SELECT scene, phase, 'rmse', rmse FROM cells UNION ALL SELECT scene, phase, 'delta1', delta1 FROM cells)""",
    "cells_wide": f"WITH {CELLS_SQL} SELECT scene, phase, round(absrel, 6) AS absrel, round(rmse, 6) AS rmse, round(delta1, 6) AS delta1 FROM cells",
    "metric_means_by_phase": f"""WITH {CELLS_SQL} SELECT phase, round(avg(absrel), 6) AS absrel, round(avg(rmse), 6) AS rmse, round(avg(delta1), 6) AS delta1, count(*) AS n
        FROM cells WHERE scene IN (SELECT scene FROM cells GROUP BY scene HAVING count(DISTINCT phase) = 3) GROUP BY phase""",
    "weighted_mean_nulls": f"""WITH {roles.SAMPLES_SQL} SELECT model, task, round(sum(rmse * frame) / sum(CAST(frame AS DOUBLE)), 6) AS weighted_mean, count(*) AS n
        FROM samples WHERE frame % 3 <> 0 AND frame <> 4 GROUP BY model, task""",
    "latency_percentiles": f"""WITH {roles.SAMPLES_SQL} SELECT model, round(quantile_cont(latency_ms, 0.05), 6) AS p5, round(quantile_cont(latency_ms, 0.5), 6) AS p50,
        round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99, round(avg(latency_ms), 6) AS mean, round(max(latency_ms), 6) AS max, count(*) AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY model, scene ORDER BY sample, latency_ms) AS k, count(*) OVER (PARTITION BY model, scene) AS frames FROM samples)
        WHERE k > 2 OR frames <= 2 GROUP BY model""",
    "esd_by_tier": f"""WITH {roles.TIERED_SQL} SELECT model, round(avg(absrel) FILTER (WHERE difficulty = 'easy'), 6) AS easy, round(avg(absrel) FILTER (WHERE difficulty = 'medium'), 6) AS medium,
        round(avg(absrel) FILTER (WHERE difficulty = 'hard'), 6) AS hard FROM tiered GROUP BY model""",
    "phase_weighted_score": f"""WITH {roles.TIERED_SQL}, m AS (SELECT phase, difficulty, avg(rmse) AS v FROM tiered WHERE phase IS NOT NULL AND difficulty IS NOT NULL GROUP BY ALL),
        s AS (SELECT phase, sum(v * w) / sum(w) AS s FROM m JOIN (VALUES ('easy', CAST(0.25 AS DOUBLE)), ('medium', 0.35), ('hard', 0.4)) AS t(difficulty, w) USING (difficulty) GROUP BY phase),
        p AS (SELECT coalesce(max(s) FILTER (WHERE phase = 'clutter'), 0) AS a, coalesce(max(s) FILTER (WHERE phase = 'interaction'), 0) AS b, coalesce(max(s) FILTER (WHERE phase = 'clean'), 0) AS c FROM s)
        SELECT round(a, 6) AS s_clutter, round(b, 6) AS s_interaction, round(c, 6) AS s_clean, round((a + b + c) / 3, 6) AS s_overall, round(b - a, 6) AS delta_int, round(c - b, 6) AS delta_rec FROM p""",
    "str_deltas": f"""WITH {roles.SAMPLES_SQL}, p AS (SELECT model, coalesce(avg(rmse) FILTER (WHERE phase = 'clutter'), 0) AS a, coalesce(avg(rmse) FILTER (WHERE phase = 'interaction'), 0) AS b,
        coalesce(avg(rmse) FILTER (WHERE phase = 'clean'), 0) AS c FROM samples GROUP BY model)
        SELECT model, round(a, 6) AS m_clutter, round(b, 6) AS m_interaction, round(c, 6) AS m_clean, round(b - a, 6) AS str_c_to_i, round(c - b, 6) AS str_i_to_l FROM p""",
    "jedi_cell": f"WITH {CELLS_SQL}, {_jedi_sql()} SELECT scene, phase, round(jedi, 6) AS jedi, {', '.join(f'round(d_{s.name}, 6) AS d_{s.name}' for s in SPECS)} FROM j",
    "jedi_epsilon": f"WITH {CELLS_SQL}, {_jedi_sql(0.01)} SELECT scene, phase, round(jedi, 6) AS jedi FROM j",
    "jedi_model": f"""WITH {CELLS_SQL}, {_jedi_sql()} SELECT difficulty AS tier, phase, round(avg(jedi), 6) AS jedi, CAST(sum(CASE WHEN n_out > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_oob, count(*) AS n_cells
        FROM j GROUP BY GROUPING SETS ((difficulty, phase), (difficulty))""",
    "jedi_worst_phase": f"{_WORST} FROM m GROUP BY tier",
    "accurate_and_robust": f"{_WORST}, min(m) >= 0.3 AS passes FROM m GROUP BY tier",
    "jedi_out_of_bounds": f"""WITH {CELLS_SQL}, o AS (SELECT scene, phase, concat_ws(',', {", ".join(
        f"CASE WHEN ({s.name} - CAST({s.worst} AS DOUBLE)) / CAST({s.best - s.worst!r} AS DOUBLE) NOT BETWEEN 0 AND 1 THEN '{s.name}' END" for s in SPECS)}) AS out_of_bounds FROM cells)
        SELECT * FROM o WHERE out_of_bounds <> ''""",
    "grouping_sets_accuracy": f"""WITH {roles.SAMPLES_SQL} SELECT model, task, phase, round(avg(CASE WHEN absrel <= CAST(0.05 AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
        FROM samples GROUP BY GROUPING SETS ((), (model), (task), (phase))""",
    "summary_by_model": f"""WITH {roles.SAMPLES_SQL} SELECT model, count(*) AS n, count(DISTINCT scene) AS scenes, round(median(latency_ms), 6) AS median, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
        round(max(latency_ms), 6) AS max, round(min(latency_ms), 6) AS min, round(stddev_samp(latency_ms), 6) AS std, round(sqrt(avg(rmse * rmse)), 6) AS rms FROM samples GROUP BY model""",
    "records_schema": """SELECT o_orderpriority AS task, CASE o_orderstatus WHEN 'F' THEN 'clutter' WHEN 'P' THEN 'interaction' WHEN 'O' THEN 'clean' END AS phase,
        round(avg(o_totalprice), 6) AS score, count(*) AS n FROM orders GROUP BY 1, 2""",
}
