"""Queries over a (scene, phase, metric) cube, with equal SQL for two metrics where algebra is needed."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmill import roles
from cellmill.operators import cells as C
from cellmill.operators import stats as X
from cellmill.plans.cells import CELLS_SQL, METRICS, cells, rounded
from cellmill.session import settle

TWO = ["absrel", "rmse"]


def _z(spark, sf, metrics=None):
    metrics = metrics or METRICS
    whole = C.complete_scenes(cells(spark, sf).withColumnRenamed("difficulty", "tier"), 3, metrics=tuple(metrics))
    kept = settle(whole.select("scene", "phase", "tier", *metrics))  # the tests below read it several times
    return X.standardise(kept, metrics, ("absrel", "rmse"))


def standardise_z(spark, sf):
    return rounded(_z(spark, sf).drop("tier"))


def sscp_by_phase(spark, sf):
    """Sums and cross products by phase: all that the tests below need."""
    return rounded(X.sscp(_z(spark, sf, TWO), TWO, ("phase",)), 4)


def phi_designs(spark, sf):
    """Both phase effects on all metrics: scenes' variance in the error, and taken out."""
    cube = X.Cube.of(_z(spark, sf), METRICS)
    return rounded(X.phi_table(spark, {"oneway": X.phi_oneway(cube), "repeated": X.phi_repeated(cube)}))


def phi_designs_k2(spark, sf):
    cube = X.Cube.of(_z(spark, sf, TWO), TWO)
    t = X.phi_table(spark, {"oneway": X.phi_oneway(cube), "repeated": X.phi_repeated(cube)})
    return rounded(t.select("design", "wilks", "phi_wilks", "pillai", "phi_pillai"))


def phi_by_model(spark, sf):
    """One-way phase effect of every model, each on its complete scenes: all models in one pass."""
    c = C.complete_scenes(C.cells_from_samples(roles.tiered_samples(spark, sf), METRICS, ("model", "scene", "phase")), 3, ("model", "scene"))
    cubes = X.Cube.of_each(X.standardise(c.select("model", "scene", "phase", *METRICS), METRICS, by=("model",)), METRICS, "model")
    return rounded(X.phi_table(spark, {m: X.phi_oneway(cube) for m, cube in cubes.items()}).withColumnRenamed("design", "model"))


def phi_mixed_design(spark, sf):
    return rounded(X.mixed_design(_z(spark, sf), METRICS, roles.PHASES))


def phi_transitions(spark, sf):
    return rounded(X.transitions(_z(spark, sf), METRICS, roles.PHASES))


def hotelling_k2(spark, sf):
    return rounded(X.transitions(_z(spark, sf, TWO), TWO, roles.PHASES).select("transition", "n", "t2", "f", "phi"))


def phase_differences(spark, sf):
    return rounded(X.differences(cells(spark, sf), METRICS, "clutter", "clean"))


def holm_adjust(spark, sf):
    """Adjusted p-values in families of five: the priorities of each status, with stand-in p-values."""
    p = roles.table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg((F.pmod(F.sum("o_orderkey"), F.lit(997)) / 20000).alias("p_value"))
    return rounded(X.holm(p, "p_value", "p_holm", ("o_orderstatus",), "o_orderpriority"))


def metric_corr(spark, sf):
    """Correlation of every pair of metrics over cells, strongest first by rank."""
    c = cells(spark, sf)
    pairs = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]]
    one = c.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return rounded(one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r"))


def worst_correlated_pair(spark, sf):
    m = metric_corr(spark, sf)
    return m.agg(F.max_by("pair", F.struct(F.abs("r"), "pair")).alias("pair"), F.max(F.abs("r")).alias("abs_r"))


def mean_ci(spark, sf):
    return rounded(X.mean_ci(cells(spark, sf), "rmse", ("phase",)))


def hash_bootstrap(spark, sf):
    """Spread of 2,000 bootstrap means of a metric per phase, scenes drawn by hash."""
    means = X.bootstrap_means(cells(spark, sf), "rmse", "scene", 2000, ("phase",))
    return rounded(means.groupBy("phase").agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("se"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high")))


def _by_budget(spark, sf):
    return roles.samples(spark, sf).groupBy("model", "scene", "frame_budget").agg(F.avg("rmse").alias("rmse"))


def phi_bootstrap(spark, sf):
    """Spread of the phase effect on two metrics over 1,000 draws of scenes."""
    return rounded(X.bootstrap_phi(_z(spark, sf, TWO), TWO))


def degradation_curve(spark, sf):
    return rounded(C.mean_by(_by_budget(spark, sf), ["model", "frame_budget"], ["rmse"]))


def critical_budget(spark, sf):
    return rounded(X.degradation(_by_budget(spark, sf), "rmse", by=("model",)))


def wilcoxon_budgets(spark, sf):
    """Signed ranks of scenes between the smallest and the largest budget, paired by scene."""
    b = _by_budget(spark, sf).groupBy("model", "scene").agg(F.max(F.when(F.col("frame_budget") == 50, F.col("rmse"))).alias("a"), F.max(F.when(F.col("frame_budget") == 350, F.col("rmse"))).alias("b"))
    return rounded(X.wilcoxon(b.dropna().withColumn("a", F.round("a", 6)).withColumn("b", F.round("b", 6)), "a", "b", ("model",)))


QUERIES = {f.__name__: f for f in (
    standardise_z, sscp_by_phase, phi_designs, phi_designs_k2, phi_by_model, phi_mixed_design, phi_transitions, hotelling_k2, phase_differences, holm_adjust, metric_corr, worst_correlated_pair,
    mean_ci, hash_bootstrap, phi_bootstrap, degradation_curve, critical_budget, wilcoxon_budgets,
)}

_Z = f"""{CELLS_SQL}, whole AS (SELECT * FROM cells WHERE scene IN (SELECT scene FROM cells GROUP BY scene HAVING count(DISTINCT phase) = 3)),
    z AS (SELECT scene, phase, -(absrel - avg(absrel) OVER ()) / stddev_pop(absrel) OVER () AS absrel, -(rmse - avg(rmse) OVER ()) / stddev_pop(rmse) OVER () AS rmse,
        (delta1 - avg(delta1) OVER ()) / stddev_pop(delta1) OVER () AS delta1 FROM whole)"""
_T = f"""WITH {_Z}, p AS (SELECT 1 AS one, 'clutter' AS a, 'interaction' AS b UNION ALL SELECT 2, 'interaction', 'clean' UNION ALL SELECT 3, 'clutter', 'clean'),
    d AS (SELECT a || '->' || b AS transition, y.absrel - x.absrel AS u, y.rmse - x.rmse AS v FROM p JOIN z x ON x.phase = a JOIN z y ON y.phase = b AND y.scene = x.scene),
    m AS (SELECT transition, count(*) AS n, avg(u) AS mu, avg(v) AS mv, var_samp(u) AS su, var_samp(v) AS sv, covar_samp(u, v) AS suv FROM d GROUP BY transition),
    t AS (SELECT transition, n, n * (mu * mu * sv - 2 * mu * mv * suv + mv * mv * su) / (su * sv - suv * suv) AS t2 FROM m)
    SELECT transition, n, round(t2, 6) AS t2, round((n - 2) / ((n - 1) * CAST(2 AS DOUBLE)) * t2, 6) AS f, round(1 - t2 / (t2 + n - 1), 6) AS phi FROM t"""
_K2 = f"""WITH {_Z}, pm AS (SELECT phase, avg(absrel) AS a, avg(rmse) AS b FROM z GROUP BY phase), sm AS (SELECT scene, avg(absrel) AS a, avg(rmse) AS b FROM z GROUP BY scene),
    n AS (SELECT count(*) AS n FROM sm), g AS (SELECT avg(absrel) AS a, avg(rmse) AS b FROM z),
    h AS (SELECT sum(n.n * (pm.a - g.a) * (pm.a - g.a)) AS aa, sum(n.n * (pm.a - g.a) * (pm.b - g.b)) AS ab, sum(n.n * (pm.b - g.b) * (pm.b - g.b)) AS bb FROM pm, g, n),
    r AS (SELECT 'oneway' AS design, absrel - pm.a AS u, rmse - pm.b AS v FROM z JOIN pm USING (phase)
        UNION ALL SELECT 'repeated', absrel - pm.a - sm.a + g.a, rmse - pm.b - sm.b + g.b FROM z JOIN pm USING (phase) JOIN sm USING (scene), g),
    e AS (SELECT design, sum(u * u) AS aa, sum(u * v) AS ab, sum(v * v) AS bb FROM r GROUP BY design),
    w AS (SELECT design, (e.aa * e.bb - e.ab * e.ab) / ((e.aa + h.aa) * (e.bb + h.bb) - (e.ab + h.ab) * (e.ab + h.ab)) AS wilks,
        ((e.bb + h.bb) * h.aa - 2 * (e.ab + h.ab) * h.ab + (e.aa + h.aa) * h.bb) / ((e.aa + h.aa) * (e.bb + h.bb) - (e.ab + h.ab) * (e.ab + h.ab)) AS pillai FROM e, h)
    SELECT design, round(wilks, 6) AS wilks, round(sqrt(wilks), 6) AS phi_wilks, round(pillai, 6) AS pillai, round(1 - pillai / 2, 6) AS phi_pillai FROM w"""
_BUDGET = f"{roles.SAMPLES_SQL}, bb AS (SELECT model, scene, frame_budget, avg(rmse) AS rmse FROM samples GROUP BY ALL)"
_POISSON = " + ".join(f"CASE WHEN h >= CAST({step!r} AS DOUBLE) THEN 1 ELSE 0 END" for step in X.poisson_steps())
_DRAW = "CAST(('0x' || substr(sha256('{seed}:' || replicate || ':' || scene), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS h"
ORACLE_SQL = {
    "phi_bootstrap": f"""WITH {_Z}, d AS (SELECT z.*, replicate, {_DRAW.format(seed='phi')} FROM z, (SELECT unnest(range(1000)) AS replicate)), t AS (SELECT *, {_POISSON} AS t FROM d),
        p AS (SELECT replicate, phase, sum(t) AS n, sum(t * absrel) AS sa, sum(t * rmse) AS sb, sum(t * absrel * absrel) AS aa, sum(t * absrel * rmse) AS ab, sum(t * rmse * rmse) AS bb FROM t WHERE t > 0 GROUP BY ALL),
        m AS (SELECT *, sa / n AS ma, sb / n AS mb, avg(sa / n) OVER r AS ga, avg(sb / n) OVER r AS gb FROM p WINDOW r AS (PARTITION BY replicate)),
        e AS (SELECT replicate, sum(aa - sa * sa / n) AS eaa, sum(ab - sa * sb / n) AS eab, sum(bb - sb * sb / n) AS ebb,
            sum(n * (ma - ga) * (ma - ga)) AS haa, sum(n * (ma - ga) * (mb - gb)) AS hab, sum(n * (mb - gb) * (mb - gb)) AS hbb FROM m GROUP BY replicate HAVING count(*) >= 2 AND min(n) >= 2),
        l AS (SELECT *, (eaa + ebb) / 2 AS mid, sqrt((eaa - ebb) * (eaa - ebb) / 4 + eab * eab) AS off FROM e),
        f AS (SELECT *, (eaa + haa) * (ebb + hbb) - (eab + hab) * (eab + hab) AS td FROM l WHERE (mid + off) / (mid - off) BETWEEN 0 AND 1000),
        w AS (SELECT sqrt((eaa * ebb - eab * eab) / td) AS x, 1 - ((ebb + hbb) * haa - 2 * (eab + hab) * hab + (eaa + haa) * hbb) / td / 2 AS y FROM f)
        SELECT round(avg(x), 6) AS phi_wilks_mean, round(quantile_cont(x, 0.025), 6) AS phi_wilks_low, round(quantile_cont(x, 0.975), 6) AS phi_wilks_high, round(stddev_samp(x), 6) AS phi_wilks_se,
            round(avg(y), 6) AS phi_pillai_mean, round(quantile_cont(y, 0.025), 6) AS phi_pillai_low, round(quantile_cont(y, 0.975), 6) AS phi_pillai_high, round(stddev_samp(y), 6) AS phi_pillai_se,
            1000 AS n_boot, count(*) AS n_success, 1000 - count(*) AS n_failed FROM w""",
    "standardise_z": f"WITH {_Z} SELECT scene, phase, round(absrel, 6) AS absrel, round(rmse, 6) AS rmse, round(delta1, 6) AS delta1 FROM z",
    "sscp_by_phase": f"""WITH {_Z} SELECT phase, count(*) AS n, round(sum(absrel), 4) AS s_absrel, round(sum(rmse), 4) AS s_rmse, round(sum(absrel * absrel), 4) AS p_absrel_absrel,
        round(sum(absrel * rmse), 4) AS p_absrel_rmse, round(sum(rmse * rmse), 4) AS p_rmse_rmse FROM z GROUP BY phase""",
    "phi_designs_k2": _K2,
    "hotelling_k2": _T,
    "phase_differences": f"""WITH {CELLS_SQL} SELECT a.scene, round(b.absrel - a.absrel, 6) AS absrel, round(b.rmse - a.rmse, 6) AS rmse, round(b.delta1 - a.delta1, 6) AS delta1
        FROM cells a JOIN cells b ON a.scene = b.scene AND a.phase = 'clutter' AND b.phase = 'clean'""",
    "holm_adjust": """WITH p AS (SELECT o_orderstatus, o_orderpriority, (CAST(sum(o_orderkey) AS BIGINT) % 997) / CAST(20000 AS DOUBLE) AS p_value FROM orders GROUP BY ALL),
        a AS (SELECT *, (count(*) OVER (PARTITION BY o_orderstatus) - row_number() OVER w + 1) * p_value AS a FROM p WINDOW w AS (PARTITION BY o_orderstatus ORDER BY p_value, o_orderpriority))
        SELECT o_orderstatus, o_orderpriority, round(p_value, 6) AS p_value, round(least(max(a) OVER (PARTITION BY o_orderstatus ORDER BY p_value, o_orderpriority ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_holm FROM a""",
    "metric_corr": f"""WITH {CELLS_SQL} SELECT 'absrel|rmse' AS pair, round(corr(absrel, rmse), 6) AS r FROM cells UNION ALL SELECT 'absrel|delta1', round(corr(absrel, delta1), 6) FROM cells
        UNION ALL SELECT 'rmse|delta1', round(corr(rmse, delta1), 6) FROM cells""",
    "worst_correlated_pair": f"""WITH {CELLS_SQL}, c AS (SELECT 'absrel|rmse' AS pair, abs(round(corr(absrel, rmse), 6)) AS r FROM cells UNION ALL SELECT 'absrel|delta1', abs(round(corr(absrel, delta1), 6)) FROM cells
        UNION ALL SELECT 'rmse|delta1', abs(round(corr(rmse, delta1), 6)) FROM cells) SELECT arg_max(pair, struct_pack(a := r, b := pair)) AS pair, max(r) AS abs_r FROM c""",
    "mean_ci": f"""WITH {CELLS_SQL}, s AS (SELECT phase, count(*) AS n, avg(rmse) AS m, median(rmse) AS md, stddev_samp(rmse) AS sd, quantile_cont(rmse, 0.05) AS p5, quantile_cont(rmse, 0.95) AS p95 FROM cells GROUP BY phase)
        SELECT phase, n, round(m, 6) AS mean, round(md, 6) AS median, round(sd, 6) AS std, round(p5, 6) AS p5, round(p95, 6) AS p95,
            round(m - CAST(1.96 AS DOUBLE) * sd / sqrt(n), 6) AS ci95_low, round(m + CAST(1.96 AS DOUBLE) * sd / sqrt(n), 6) AS ci95_high FROM s""",
    "hash_bootstrap": f"""WITH {CELLS_SQL}, r AS (SELECT phase, scene, rmse, replicate, CAST(('0x' || substr(sha256('boot:' || replicate || ':' || scene), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS h
            FROM cells, (SELECT unnest(range(2000)) AS replicate)),
        t AS (SELECT *, {_POISSON} AS times FROM r), m AS (SELECT phase, replicate, sum(rmse * times) / nullif(sum(times), 0) AS mean FROM t GROUP BY ALL)
        SELECT phase, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS se, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY phase""",
    "degradation_curve": f"WITH {_BUDGET} SELECT model, frame_budget, round(avg(rmse), 6) AS rmse, count(*) AS n FROM bb GROUP BY ALL",
    "critical_budget": f"""WITH {_BUDGET}, c AS (SELECT model, frame_budget AS b, avg(rmse) AS v FROM bb GROUP BY ALL),
        s AS (SELECT *, (lead(b) OVER w - b) * (lead(v) OVER w + v) / 2 AS area FROM c WINDOW w AS (PARTITION BY model ORDER BY b)),
        e AS (SELECT model, arg_min(v, b) AS lo, arg_max(v, b) AS hi, sum(area) AS area, max(b) - min(b) AS range FROM s GROUP BY model)
        SELECT model, round(lo - hi, 6) AS tcv, round(area / (range * abs(hi)), 6) AS audc, (SELECT min(b) FROM c WHERE c.model = e.model AND abs(c.v - hi) <= CAST(0.05 AS DOUBLE) * abs(hi)) AS critical_budget FROM e""",
    "wilcoxon_budgets": f"""WITH {_BUDGET}, p AS (SELECT model, scene, round(max(rmse) FILTER (WHERE frame_budget = 50), 6) AS a, round(max(rmse) FILTER (WHERE frame_budget = 350), 6) AS b FROM bb GROUP BY model, scene),
        d AS (SELECT model, b - a AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND b - a <> 0),
        r AS (SELECT model, d, rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY model, abs(d)) AS c FROM d),
        s AS (SELECT model, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, CAST(sum(c * c - 1) AS DOUBLE) AS ties FROM r GROUP BY model)
        SELECT model, CAST(n AS BIGINT) AS n, round(w, 6) AS w_plus, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s""",
}
