"""Queries of difficulty scoring and of ordered sequences, with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmill import roles
from cellmill.operators import difficulty as D
from cellmill.operators import sequences as Q
from cellmill.plans.cells import CELLS_SQL, METRICS, cells, rounded
from cellmill.session import settle
from cellmill.sources.tables import table

WEIGHTS = {"absrel": 0.5, "rmse": 0.3, "delta1": 0.2}
CATEGORIES = {"absrel": "error", "rmse": "error", "delta1": "accuracy"}
KEYS = ["scene", "phase"]


def _normed(spark, sf):
    c = cells(spark, sf)
    return D.long_features(c.select(*KEYS, *[F.round(m, 9).alias(m) for m in METRICS]), KEYS, METRICS)


def _dim(spark, values, name, kind):
    return spark.createDataFrame(list(values.items()), f"feature string, {name} {kind}")


def percentile_norms(spark, sf):
    return rounded(_normed(spark, sf).select(*KEYS, "feature", "p"))


def difficulty_score(spark, sf):
    return rounded(D.scores(_normed(spark, sf), KEYS, _dim(spark, WEIGHTS, "weight", "double")))


def category_scores(spark, sf):
    return rounded(D.category_scores(_normed(spark, sf), _dim(spark, CATEGORIES, "category", "string"), KEYS))


def tertile_cut(spark, sf):
    s = D.scores(_normed(spark, sf), KEYS, _dim(spark, WEIGHTS, "weight", "double")).withColumn("weighted", F.round("weighted", 9))
    return rounded(D.tiers(s.select(*KEYS, "weighted"), "weighted", *KEYS))


def scene_splits(spark, sf):
    s = D.scores(_normed(spark, sf), KEYS, _dim(spark, WEIGHTS, "weight", "double"))
    means = s.groupBy("scene").agg(F.round(F.avg("weighted"), 9).alias("weighted"))
    return rounded(D.scene_splits(means, "weighted"))


def consensus_tier(spark, sf):
    """Three scores vote on every cell's tier."""
    s = D.scores(_normed(spark, sf), KEYS, _dim(spark, WEIGHTS, "weight", "double"))
    votes = [D.tiers(s.select(*KEYS, F.round(v, 9).alias("v")), "v", *KEYS).select(*KEYS, "tier") for v in ("weighted", "median", "max")]
    return D.consensus(votes[0].unionByName(votes[1]).unionByName(votes[2]), KEYS)


def _wide_norms(spark, sf):
    n = _normed(spark, sf)
    return settle(n.groupBy(*KEYS).pivot("feature", METRICS).agg(F.first("p")))


def component_scores(spark, sf):
    """First principal component of the percentile norms."""
    return rounded(D.component_scores(_wide_norms(spark, sf), KEYS, METRICS), 4)


def cluster_tiers(spark, sf):
    """Cells in three clusters of the norms' components, by mean norm."""
    return D.cluster_tiers(_wide_norms(spark, sf), KEYS, METRICS)


EFFORT_FEATURES = ("iter_mean",)


def effort_weights(spark, sf):
    """Scores in which the work that a scene was has a quarter of the weight: one plus the number of its orders' priorities."""
    effort = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_suppkey").alias("scene")).agg((1.0 + F.countDistinct("o_orderpriority")).alias("iter_mean"))
    features = [*METRICS, *EFFORT_FEATURES]
    c = cells(spark, sf).join(effort, "scene")
    normed = D.long_features(c.select(*KEYS, *[F.round(m, 9).alias(m) for m in features]), KEYS, features)
    weights = D.effort_stratified(features, EFFORT_FEATURES)
    return rounded(D.scores(normed, KEYS, _dim(spark, weights, "weight", "double")).select(*KEYS, F.col("weighted").alias("score")))


def confidence_flips(spark, sf):
    """How often cells leave their tier under 1,000 random weightings."""
    n = _normed(spark, sf)
    base = D.tiers(D.scores(n, KEYS).select(*KEYS, F.round("weighted", 9).alias("v")), "v", *KEYS).select(*KEYS, "tier")
    return rounded(D.confidence(n, KEYS, base))


def mode_split(spark, sf):
    """Most common market segment of each nation's customers."""
    return D.mode_split(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment")


def _clips(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", F.round("value", 6).alias("value"))


CLIP = ["user_id", "event_type"]


def frame_deltas(spark, sf):
    return rounded(Q.deltas(_clips(spark, sf), CLIP, ["ts", "event_id"], "value").select("event_id", "delta", "jerk"))


def gap_rates(spark, sf):
    """Change of a user's value per event number since the event before."""
    return rounded(Q.gap_rates(_clips(spark, sf), ["user_id"], "event_id", "value").select("event_id", "rate"))


def mad_filter(spark, sf):
    return rounded(Q.mad_clip(_clips(spark, sf), ["event_type"], "value", 2.0).select("event_id", "clipped"))


def mad_outliers(spark, sf):
    return rounded(Q.mad_outliers(_clips(spark, sf), ["event_type"], "value", 2.0).filter("outlier").select("event_id", "value"))


def area_stability(spark, sf):
    """Order values of a nation's customers over days, as sizes of a scene's objects over frames; urgent orders are unseen."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    size = F.when(F.col("o_orderpriority") == "1-URGENT", 0.0).otherwise(F.col("o_totalprice") / 1000)
    frames = o.join(c, o.o_custkey == c.c_custkey).select("c_nationkey", "o_custkey", "o_orderdate", "o_orderkey", size.alias("size"))
    return rounded(Q.stability(frames, ["c_nationkey"], "o_custkey", ["o_orderdate", "o_orderkey"], "size"))


def dense_grid(spark, sf):
    """Seen quantity of every part brand in every frame of an order status."""
    li, o, p = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "part")
    df = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return rounded(Q.dense_grid(df.select("o_orderstatus", "l_linenumber", "p_brand", F.col("l_quantity").alias("q")), ["o_orderstatus"], "l_linenumber", "p_brand", "q"))


def id_switches(spark, sf):
    """Times that the supplier of a part changes along its orders."""
    return Q.switches(table(spark, sf, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber"], "l_suppkey")


def contiguity(spark, sf):
    return Q.contiguity(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", 1)


def islands(spark, sf):
    """Runs of consecutive order numbers per customer."""
    return Q.islands(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey")


def reopened_keys(spark, sf):
    """Event types that a user leaves and comes back to."""
    return Q.reopened(_clips(spark, sf), ["ts", "event_id"], "event_type", ["user_id"])


def anchor_relative(spark, sf):
    return rounded(Q.anchored(_clips(spark, sf), CLIP, ["ts", "event_id"], ["value"]).select("event_id", "value"))


def cumulative_drift(spark, sf):
    return rounded(Q.cumulative(_clips(spark, sf), CLIP, ["ts", "event_id"], "value").select("event_id", "drift"), 4)


def motion_slope(spark, sf):
    return rounded(Q.slopes(roles.samples(spark, sf).withColumn("x", F.col("frame").cast("double")), KEYS, "x", "latency_ms"))


def align_affine(spark, sf):
    return _aligned(spark, sf, "affine")


def align_median(spark, sf):
    return _aligned(spark, sf, "median")


def align_disparity(spark, sf):
    return _aligned(spark, sf, "disparity")


def align_log(spark, sf):
    return _aligned(spark, sf, "log")


def _aligned(spark, sf, mode):
    """Price predicted from quantity, brought to scale per cell; mean error of each cell."""
    s = Q.aligned(roles.samples(spark, sf), KEYS, "rmse", "latency_ms", mode)
    return rounded(s.groupBy(*KEYS).agg(F.avg(F.abs(F.col("aligned") - F.col("latency_ms"))).alias("mae"), F.count("aligned").alias("n")), 5)


def temporal_stability(spark, sf):
    return rounded(Q.consecutive_mean(_clips(spark, sf), CLIP, ["ts", "event_id"], None, "value"))


QUERIES = {f.__name__: f for f in (
    percentile_norms, difficulty_score, category_scores, tertile_cut, scene_splits, consensus_tier, component_scores, cluster_tiers, effort_weights, confidence_flips, mode_split, frame_deltas, gap_rates, mad_filter, mad_outliers, area_stability,
    dense_grid, id_switches, contiguity, islands, reopened_keys, anchor_relative, cumulative_drift, motion_slope, align_affine, align_median, align_disparity, align_log, temporal_stability,
)}

_N = f"""{CELLS_SQL}, l AS (SELECT scene, phase, 'absrel' AS feature, round(absrel, 9) AS v FROM cells UNION ALL SELECT scene, phase, 'rmse', round(rmse, 9) FROM cells UNION ALL SELECT scene, phase, 'delta1', round(delta1, 9) FROM cells),
    normed AS (SELECT scene, phase, feature, CASE WHEN min(v) OVER f = max(v) OVER f THEN 0.5 ELSE
        (rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0) / count(*) OVER f END AS p FROM l WINDOW f AS (PARTITION BY feature))"""
_S = f"""{_N}, w(feature, weight, category) AS (VALUES ('absrel', CAST(0.5 AS DOUBLE), 'error'), ('rmse', 0.3, 'error'), ('delta1', 0.2, 'accuracy')),
    scored AS (SELECT scene, phase, sum(weight * p) / sum(weight) AS weighted, median(p) AS median, max(p) AS max FROM normed JOIN w USING (feature) GROUP BY scene, phase)"""


def _tier(value, source="scored", extra=""):
    return f"""SELECT scene, phase, {value} AS v{extra}, CASE WHEN (SELECT count(DISTINCT {value}) FROM {source}) < 3 THEN 'medium' WHEN rk * 3 <= n THEN 'easy' WHEN rk * 3 <= 2 * n THEN 'medium' ELSE 'hard' END AS tier
        FROM (SELECT *, row_number() OVER (ORDER BY {value}, scene, phase) AS rk, count(*) OVER () AS n FROM {source})"""


_EV = "ev AS (SELECT user_id, event_type, event_id, ts, round(value, 6) AS value FROM events)"
_MAD = f"""WITH {_EV}, m AS (SELECT event_type, median(value) AS med, count(value) AS n, max(value) - min(value) AS spread FROM ev GROUP BY 1),
    d AS (SELECT ev.*, med, n, spread FROM ev JOIN m USING (event_type)), s AS (SELECT event_type, median(abs(value - med)) AS mad FROM d GROUP BY 1)"""


def _align(fit, back):
    return f"""WITH {roles.SAMPLES_SQL}, f AS (SELECT scene, phase, {fit} FROM samples GROUP BY scene, phase), a AS (SELECT scene, phase, latency_ms, {back} AS aligned FROM samples JOIN f USING (scene, phase))
        SELECT scene, phase, round(avg(abs(aligned - latency_ms)), 5) AS mae, count(aligned) AS n FROM a GROUP BY scene, phase"""


_fit = lambda y: f"coalesce(regr_slope({y}, rmse), 0) AS s, coalesce(regr_intercept({y}, rmse), avg({y})) AS t"
_U = "(CAST(('0x' || substr(sha256('weights:' || replicate || ':' || feature), 1, 8)) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)"
ORACLE_SQL = {
    "percentile_norms": f"WITH {_N} SELECT scene, phase, feature, round(p, 6) AS p FROM normed",
    "difficulty_score": f"WITH {_S} SELECT scene, phase, round(weighted, 6) AS weighted, round(median, 6) AS median, round(max, 6) AS max FROM scored",
    "category_scores": f"WITH {_S} SELECT scene, phase, category, round(avg(p), 6) AS score FROM normed JOIN w USING (feature) GROUP BY ALL",
    "tertile_cut": f"WITH {_S} SELECT scene, phase, round(v, 6) AS weighted, tier FROM ({_tier('round(weighted, 9)')})",
    "scene_splits": f"""WITH {_S}, m AS (SELECT scene, round(avg(weighted), 9) AS score FROM scored GROUP BY scene), r AS (SELECT *, row_number() OVER (ORDER BY score, scene) AS rk, count(*) OVER () // 3 AS t FROM m)
        SELECT scene, round(score, 6) AS score, CASE WHEN rk <= t THEN 'easy' WHEN rk <= 2 * t THEN 'medium' ELSE 'hard' END AS split FROM r""",
    "consensus_tier": f"""WITH {_S}, v AS ({_tier('round(weighted, 9)')} UNION ALL {_tier('round(median, 9)')} UNION ALL {_tier('round(max, 9)')}),
        c AS (SELECT scene, phase, tier, count(*) AS n FROM v GROUP BY ALL)
        SELECT scene, phase, tier AS consensus, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY scene, phase ORDER BY n DESC, CASE tier WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS k FROM c) WHERE k = 1""",
    "confidence_flips": f"""WITH {_N}, even AS (SELECT scene, phase, round(avg(p), 9) AS e FROM normed GROUP BY ALL), base AS ({_tier('e', 'even')}),
        dr AS (SELECT feature, replicate, -ln({_U}) AS weight FROM (SELECT DISTINCT feature FROM normed), (SELECT unnest(range(1000)) AS replicate)),
        s AS (SELECT scene, phase, replicate, round(sum(weight * p) / sum(weight), 9) AS s FROM normed JOIN dr USING (feature) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY s, scene, phase) AS rk, count(*) OVER (PARTITION BY replicate) AS n FROM s),
        f AS (SELECT scene, phase, tier, avg(CASE WHEN tier <> CASE WHEN rk * 3 <= n THEN 'easy' WHEN rk * 3 <= 2 * n THEN 'medium' ELSE 'hard' END THEN 1.0 ELSE 0.0 END) AS rate FROM r JOIN base USING (scene, phase) GROUP BY ALL)
        SELECT scene, phase, tier, round(rate, 6) AS flip_rate, CASE WHEN rate < CAST(0.1 AS DOUBLE) THEN 'high' WHEN rate < 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM f""",
    "effort_weights": f"""WITH {CELLS_SQL},
        e AS (SELECT l_suppkey AS scene, 1.0 + count(DISTINCT o_orderpriority) AS iter_mean FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
        c AS (SELECT * FROM cells JOIN e USING (scene)),
        l AS (SELECT scene, phase, 'absrel' AS feature, round(absrel, 9) AS v FROM c UNION ALL SELECT scene, phase, 'rmse', round(rmse, 9) FROM c
            UNION ALL SELECT scene, phase, 'delta1', round(delta1, 9) FROM c UNION ALL SELECT scene, phase, 'iter_mean', iter_mean FROM c),
        n AS (SELECT scene, phase, feature, CASE WHEN min(v) OVER f = max(v) OVER f THEN 0.5 ELSE
            (rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0) / count(*) OVER f END AS p FROM l WINDOW f AS (PARTITION BY feature))
        SELECT scene, phase, round(sum(p * CAST(0.25 AS DOUBLE)), 6) AS score FROM n GROUP BY scene, phase""",
    "mode_split": """SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM (
        SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY ALL)) WHERE k = 1""",
    "frame_deltas": f"""WITH {_EV}, d AS (SELECT *, value - lag(value) OVER w AS delta FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
        SELECT event_id, round(delta, 6) + 0 AS delta, round(delta - lag(delta) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), 6) + 0 AS jerk FROM d""",
    "gap_rates": f"WITH {_EV} SELECT event_id, round((value - lag(value) OVER w) / nullif(event_id - lag(event_id) OVER w, 0), 6) AS rate FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "mad_filter": f"{_MAD} SELECT event_id, round(CASE WHEN n >= 3 AND mad > 0 AND value > med + 2.0 * mad * CAST(1.4826 AS DOUBLE) THEN med ELSE value END, 6) AS clipped FROM d JOIN s USING (event_type)",
    "mad_outliers": f"""{_MAD} SELECT event_id, round(value, 6) AS value FROM d JOIN s USING (event_type)
        WHERE CASE WHEN spread < 1e-9 THEN false WHEN mad < 1e-12 THEN value > med + 1e-9 ELSE (value - med) / (CAST(1.4826 AS DOUBLE) * mad) > 2.0 END""",
    "area_stability": """WITH s AS (SELECT c_nationkey, o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0.0 ELSE CAST(o_totalprice / 1000 AS DOUBLE) END AS size FROM orders JOIN customer ON o_custkey = c_custkey),
        o AS (SELECT *, lag(size) OVER (PARTITION BY c_nationkey, o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM s),
        e AS (SELECT c_nationkey, o_custkey, count(*) AS t, max(size) > 0 AS ever, stddev_pop(size) FILTER (WHERE size > 0) / avg(size) FILTER (WHERE size > 0) AS cv,
            count(*) FILTER (WHERE was > 0) AS shown, count(*) FILTER (WHERE was > 0 AND (was - size) / was > 0.5) AS fell, count(*) FILTER (WHERE (size > 0) <> (was > 0)) AS flipped FROM o GROUP BY ALL)
        SELECT c_nationkey, round(coalesce(avg(cv) FILTER (WHERE ever), 0.0), 6) AS area_cv, round(coalesce(avg(fell / CAST(t AS DOUBLE)) FILTER (WHERE ever AND shown > 0), 0.0), 6) AS area_drop,
            round(coalesce(avg(flipped / CAST(t AS DOUBLE)) FILTER (WHERE ever AND t > 1), 0.0), 6) AS vis_instability FROM e GROUP BY c_nationkey""",
    "dense_grid": """WITH d AS (SELECT o_orderstatus, l_linenumber, p_brand, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
        s AS (SELECT o_orderstatus, l_linenumber, p_brand, sum(q) AS q FROM d GROUP BY ALL)
        SELECT o_orderstatus, l_linenumber, p_brand, round(coalesce(q, 0), 6) AS q FROM (SELECT DISTINCT o_orderstatus, l_linenumber FROM d) JOIN (SELECT DISTINCT o_orderstatus, p_brand FROM d) USING (o_orderstatus)
        LEFT JOIN s USING (o_orderstatus, l_linenumber, p_brand)""",
    "id_switches": """WITH c AS (SELECT l_partkey, l_suppkey <> lag(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS c FROM lineitem)
        SELECT l_partkey, CAST(coalesce(sum(CAST(c AS BIGINT)), 0) AS BIGINT) AS switches, count(*) AS n FROM c GROUP BY l_partkey""",
    "contiguity": """SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS first, max(l_linenumber) AS last,
        count(*) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1 AND max(l_linenumber) - min(l_linenumber) + 1 = count(*) AS contiguous FROM lineitem GROUP BY l_orderkey""",
    "islands": """WITH g AS (SELECT o_custkey, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders))
        SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM g GROUP BY o_custkey, g""",
    "reopened_keys": """WITH o AS (SELECT user_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS opens FROM events)
        SELECT user_id, event_type, CAST(sum(opens) AS BIGINT) AS runs FROM o GROUP BY ALL HAVING sum(opens) > 1""",
    "anchor_relative": f"WITH {_EV} SELECT event_id, round(value - first_value(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), 6) AS value FROM ev",
    "cumulative_drift": f"WITH {_EV} SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS drift FROM ev",
    "motion_slope": f"""WITH {roles.SAMPLES_SQL} SELECT scene, phase, round(regr_slope(latency_ms, CAST(frame AS DOUBLE)), 6) AS slope, round(regr_intercept(latency_ms, CAST(frame AS DOUBLE)), 6) AS intercept,
        round(regr_r2(latency_ms, CAST(frame AS DOUBLE)), 6) AS r2, count(*) AS n FROM samples GROUP BY scene, phase""",
    "align_affine": _align(_fit("latency_ms"), "rmse * s + t"),
    "align_median": _align("median(latency_ms) / greatest(median(rmse), 1e-9) AS s", "rmse * s"),
    "align_disparity": _align(_fit("1 / greatest(latency_ms, 1e-3)"), "1 / greatest(s * rmse + t, 1e-3)"),
    "align_log": _align(_fit("ln(latency_ms)"), "exp(least(s * rmse + t, 5.0))"),
    "temporal_stability": f"""WITH {_EV}, d AS (SELECT user_id, event_type, abs(value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS d FROM ev)
        SELECT user_id, event_type, round(avg(d), 6) AS mean_change, count(d) AS steps FROM d GROUP BY ALL""",
}
