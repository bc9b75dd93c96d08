"""Queries of the smaller operators, with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmill import roles
from cellmill.functions import kernels as K
from cellmill.functions.registry import Registry, Task
from cellmill.operators import helpers as H
from cellmill.operators import scores as S
from cellmill.plans.cells import rounded
from cellmill.sources.tables import table


def complete_run(spark, sf):
    """Orders as runs of a customer's shards: line numbers are shards of as many as the order has."""
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("shard"))
    need = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("need"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    s = li.join(need, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return H.complete_runs(s, ["o_custkey"], "l_orderkey", "shard", "need", "o_orderdate").select("o_custkey", "l_orderkey")


def _modalities(spark, sf):
    li = table(spark, sf, "lineitem")
    return {m: li.filter(F.col("l_returnflag") == f).select("l_suppkey", "l_linenumber", F.pmod("l_partkey", F.lit(30)).alias("stem")) for m, f in (("rgb", "A"), ("depth", "N"), ("pose", "R"))}


def aligned_frames(spark, sf):
    return H.aligned(_modalities(spark, sf), "l_suppkey", "l_linenumber", "stem")[0]


def missing_by_modality(spark, sf):
    return H.aligned(_modalities(spark, sf), "l_suppkey", "l_linenumber", "stem")[1]


def primary_take(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return H.primary_take(o, ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey")


def remap_problems(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("old"), F.when(F.col("n_nationkey") == 3, 4).otherwise(F.col("n_nationkey")).cast("long").alias("new"))
    m = n.filter("old <> 7").unionByName(n.filter("old = 9").withColumn("new", F.lit(100).cast("long"))).unionByName(n.filter("old = 2").withColumn("old", F.lit(77).cast("long")).withColumn("new", F.lit(78).cast("long")))
    return H.remap_problems(m, "old", "new", n, "old")


def map_by_id_or_name(spark, sf):
    p = table(spark, sf, "part")
    left = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")).otherwise(F.lit(-1)).alias("id"), "p_name")
    catalog = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, F.lit("same")).otherwise(F.col("p_name")).alias("p_name"))
    return H.by_id_or_name(left, catalog, "id", "p_name").select("p_partkey", "object", "how")


def mask_boxes(spark, sf):
    """Pixels from lines: position by part and supplier, mask by return flag and line number."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", F.pmod("l_partkey", F.lit(64)).alias("x"), F.pmod("l_suppkey", F.lit(48)).alias("y"))
    return H.mask_boxes(li, ["l_returnflag", "l_linenumber"], "x", "y", 100)


def large_boxes_dropped(spark, sf):
    return H.drop_large(mask_boxes(spark, sf), 64.0, 48.0, 0.97)


def repinned(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.pmod("p_partkey", F.lit(40)).alias("shard"))
    side = lambda low, high, odd: spark.range(low, high).select(F.col("id").alias("shard"), F.when(F.col("id") % odd == 0, "x").otherwise(F.col("id").cast("string")).alias("digest"))
    return H.repinned(p, side(0, 38, 100), side(2, 40, 7), "shard", "digest").select("p_partkey", "moves", F.concat_ws(",", "reasons").alias("reasons"))


def path_cells(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.format_string("scene_%03d/x.png", F.col("o_custkey"))).otherwise(F.format_string("scene_%03d/%d/x.png", F.col("o_custkey"), F.pmod("o_orderkey", F.lit(3)))).alias("p"))
    return H.path_cells(o, "p")


def percentile_stretch(spark, sf):
    return rounded(H.stretched(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", "stretched"))


def rotation_medoid(spark, sf):
    e = table(spark, sf, "embeddings").filter("label IS NOT NULL").select("vec_id", "label", F.floor(F.col("vec_id") / 50).alias("block"), *[F.element_at("embedding", i + 1).cast("double").alias(f"c{i}") for i in range(4)])
    size = F.sqrt(sum((F.col(f"c{i}") * F.col(f"c{i}") for i in range(4)), F.lit(0.0)))
    q = e.select("vec_id", "label", "block", *[(F.col(f"c{i}") / size).alias(f"q{i}") for i in range(4)])
    return rounded(H.rotation_medoid(q, ["label"], "vec_id", [f"q{i}" for i in range(4)], "block"), 5)


def best_box_format(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"))
    truth = (F.col("s"), F.col("s"), F.col("s") + 40, F.col("s") + 30)
    given = [truth, tuple(t * k for t, k in zip(truth, (1000 / 99.0,) * 4)), (F.col("s"), F.col("s"), F.lit(40.0), F.lit(30.0))]
    pick = lambda i: F.when(F.col("p_partkey") % 3 == 0, given[0][i]).when(F.col("p_partkey") % 3 == 1, given[1][i]).otherwise(given[2][i])
    iou, meaning = H.best_format(tuple(pick(i) for i in range(4)), truth, F.lit(100), F.lit(100))
    return p.select("p_partkey", (iou > 0.9).alias("good"), meaning.alias("meaning"))


def answer_phrases(spark, sf):
    d = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("I think. Answer: "), F.col("text"))).otherwise(F.col("text")).alias("t"))
    phrase, flags = H.split_answer(F.col("t"))
    return d.select("item_id", F.length(phrase).cast("long").alias("chars"), F.concat_ws(",", flags).alias("flags"))


def registered_metrics(spark, sf):
    """A task's registered calculators in one aggregation, with a hook that adds their composite."""
    r = Registry()
    r.spec(S.Spec("absrel", 0.0, 0.1), S.Spec("delta1", 1.0, 0.9))
    r.metric("depth")(lambda: {"absrel": F.avg("absrel"), "n": F.count(F.lit(1))})
    r.metric("depth", "accuracy")(lambda: {"delta1": F.avg("delta1")})
    r.task(Task("depth", ("absrel", "delta1"), (lambda df: df.withColumn("score", S.composite(list(r.specs.values()))),)))
    return rounded(r.evaluate(roles.samples(spark, sf), "depth", "phase"))


def per_object_mean(spark, sf):
    """Error per object, then per image, then over images: every image weighs the same."""
    s = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.avg("l_discount").alias("e")).groupBy("l_orderkey").agg(F.avg("e").alias("e"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return rounded(s.join(o, s.l_orderkey == o.o_orderkey).groupBy("o_orderstatus").agg(F.avg("e").alias("error"), F.count(F.lit(1)).alias("images")))


def hole_fractions(spark, sf):
    """Share of missing values: overall, inside and outside of a mask."""
    li = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_discount") == 0).cast("double").alias("hole"), (F.col("l_quantity") > 25).alias("mask"))
    return rounded(li.groupBy("l_linestatus").agg(F.avg("hole").alias("overall"), F.avg(F.when(F.col("mask"), F.col("hole"))).alias("inside"), F.avg(F.when(~F.col("mask"), F.col("hole"))).alias("outside")))


def expected_roster(spark, sf):
    """Expected units, each with the errors of its results: missing, too few, or repeated."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer").filter("c_acctbal > 4000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    errors = F.array_compact(F.array(F.when(F.col("n").isNull(), F.lit("missing")), F.when(F.col("n") < 30, F.lit("too few"))))
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"), F.concat_ws(",", errors).alias("errors"))


def pose_bins_by_stride(spark, sf):
    """Pairs of a user's events by stride: means overall, by stride and by type."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    from cellmill.operators.joins import lead_pairs

    pairs = None
    for stride in (1, 5, 10):
        p = lead_pairs(e, ["user_id"], ["event_id"], stride, "event_type", "value").select("event_type", F.lit(stride).alias("stride"), F.abs(F.col("value_next") - F.col("value")).alias("d"))
        pairs = p if pairs is None else pairs.unionByName(p)
    return rounded(pairs.groupingSets([["stride"], ["event_type"], []], "stride", "event_type").agg(F.avg("d").alias("mean"), F.count(F.lit(1)).alias("n")), 5)


QUERIES = {f.__name__: f for f in (
    complete_run, aligned_frames, missing_by_modality, primary_take, remap_problems, map_by_id_or_name, mask_boxes, large_boxes_dropped, repinned, path_cells, percentile_stretch, rotation_medoid,
    best_box_format, answer_phrases, registered_metrics, per_object_mean, hole_fractions, expected_roster, pose_bins_by_stride,
)}

_MOD = """m AS (SELECT DISTINCT l_suppkey, l_linenumber, l_partkey % 30 AS stem, CASE l_returnflag WHEN 'A' THEN 'rgb' WHEN 'N' THEN 'depth' WHEN 'R' THEN 'pose' END AS modality FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')),
    k AS (SELECT l_suppkey, l_linenumber, stem, list(DISTINCT modality) AS has FROM m GROUP BY ALL)"""
_MASK = "b AS (SELECT l_returnflag, l_linenumber, min(l_partkey % 64) AS x1, min(l_suppkey % 48) AS y1, max(l_partkey % 64) AS x2, max(l_suppkey % 48) AS y2, count(*) AS area FROM lineitem GROUP BY ALL HAVING count(*) >= 100)"
_PAIR = "SELECT event_type, {0} AS stride, abs(lead(value, {0}) OVER (PARTITION BY user_id ORDER BY event_id) - value) AS d FROM events"
ORACLE_SQL = {
    "complete_run": """WITH r AS (SELECT o_custkey, l_orderkey, count(DISTINCT l_linenumber) AS have, count(*) AS need, min(l_linenumber) AS lo, max(l_linenumber) AS hi, max(o_orderdate) AS tm FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
        SELECT o_custkey, arg_max(l_orderkey, struct_pack(a := tm, b := l_orderkey)) AS l_orderkey FROM r WHERE have = need AND lo = 1 AND hi = need GROUP BY o_custkey""",
    "aligned_frames": f"WITH {_MOD} SELECT l_suppkey, l_linenumber, stem FROM k WHERE len(has) = 3",
    "missing_by_modality": f"WITH {_MOD} SELECT x AS modality, count(*) AS missing FROM k, (VALUES ('rgb'), ('depth'), ('pose')) AS t(x) WHERE NOT list_contains(has, x) GROUP BY x",
    "primary_take": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1",
    "remap_problems": """SELECT CAST(id AS BIGINT) AS id, problem FROM (VALUES (9, 'ambiguous'), (4, 'not injective'), (7, 'left out'), (77, 'unknown')) AS t(id, problem)""",
    "map_by_id_or_name": """WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'same' ELSE p_name END AS name FROM part WHERE p_partkey % 2 = 0), u AS (SELECT name, min(id) AS id FROM c GROUP BY name HAVING count(*) = 1)
        SELECT p_partkey, coalesce(c.id, u.id) AS object, CASE WHEN c.id IS NOT NULL THEN 'id' WHEN u.id IS NOT NULL THEN 'name' ELSE 'none' END AS how FROM part LEFT JOIN c ON p_partkey % 3 = 0 AND c.id = p_partkey LEFT JOIN u ON u.name = p_name""",
    "mask_boxes": f"WITH {_MASK} SELECT * FROM b",
    "large_boxes_dropped": f"WITH {_MASK} SELECT * FROM b WHERE (x2 - x1) * (y2 - y1) <= CAST(0.97 AS DOUBLE) * 64 * 48",
    "repinned": """WITH p AS (SELECT p_partkey, p_partkey % 40 AS s FROM part) SELECT p_partkey, s BETWEEN 2 AND 37 AND s % 7 <> 0 AS moves,
        concat_ws(',', CASE WHEN s > 37 THEN 'missing at old' END, CASE WHEN s < 2 THEN 'missing at new' END, CASE WHEN s BETWEEN 2 AND 37 AND s % 7 = 0 THEN 'changed' END) AS reasons FROM p""",
    "path_cells": "SELECT DISTINCT format('scene_{:03d}', o_custkey) AS scene, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS phase FROM orders",
    "percentile_stretch": """WITH e AS (SELECT event_type, quantile_cont(value, 0.02) AS l, quantile_cont(value, 0.98) AS h FROM events GROUP BY event_type)
        SELECT event_id, round(least(greatest((value - l) / nullif(h - l, 0), 0.0), 1.0), 6) AS stretched FROM events JOIN e USING (event_type)""",
    "rotation_medoid": """WITH e AS (SELECT vec_id, label, vec_id // 50 AS block, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE label IS NOT NULL),
        p AS (SELECT a.label, a.block, a.vec_id AS item, degrees(2 * acos(least(abs(list_dot_product(a.q, b.q)) / (sqrt(list_dot_product(a.q, a.q)) * sqrt(list_dot_product(b.q, b.q))), 1.0))) AS angle FROM e a JOIN e b ON a.label = b.label AND a.block = b.block AND a.vec_id <> b.vec_id),
        m AS (SELECT label, block, item, median(angle) AS med FROM p GROUP BY ALL) SELECT label, block, arg_min(item, struct_pack(a := round(med, 9), b := item)) AS medoid, round(min(med), 5) AS median FROM m GROUP BY ALL""",
    "best_box_format": "SELECT p_partkey, true AS good, CASE p_partkey % 3 WHEN 0 THEN 'pixels' WHEN 1 THEN 'thousandths' ELSE 'corner_size' END AS meaning FROM part",
    "answer_phrases": r"""WITH d AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'I think. Answer: ' || text ELSE text END AS t FROM benchmark), m AS (SELECT item_id, t, regexp_extract(t, '(?is).*answer\s*[:=]\s*(.*)$', 1) AS m FROM d),
        p AS (SELECT item_id, m, trim(CASE WHEN m <> '' THEN m ELSE t END) AS p FROM m)
        SELECT item_id, length(p) AS chars, concat_ws(',', CASE WHEN p = '' THEN 'empty' END, CASE WHEN m = '' THEN 'no_marker' END, CASE WHEN length(p) > 60 THEN 'long' END, CASE WHEN contains(p, chr(10)) THEN 'lines' END, CASE WHEN ends_with(p, '?') THEN 'question' END) AS flags FROM p""",
    "registered_metrics": f"""WITH {roles.SAMPLES_SQL}, p AS (SELECT phase, avg(absrel) AS a, avg(delta1) AS d, count(*) AS n FROM samples GROUP BY phase),
        s AS (SELECT *, least(greatest((a - CAST(0.1 AS DOUBLE)) / CAST(-0.1 AS DOUBLE), 0.0), 1.0) AS u, least(greatest((d - CAST(0.9 AS DOUBLE)) / CAST({1.0 - 0.9!r} AS DOUBLE), 0.0), 1.0) AS v FROM p)
        SELECT phase, round(a, 6) AS absrel, n, round(d, 6) AS delta1, round(CASE WHEN u <= 0 OR v <= 0 THEN 0.0 ELSE sqrt(u * v) END, 6) AS score FROM s""",
    "per_object_mean": """WITH o AS (SELECT l_orderkey, l_partkey, avg(l_discount) AS e FROM lineitem GROUP BY ALL), i AS (SELECT l_orderkey, avg(e) AS e FROM o GROUP BY 1)
        SELECT o_orderstatus, round(avg(e), 6) AS error, count(*) AS images FROM i JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus""",
    "hole_fractions": """SELECT l_linestatus, round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END), 6) AS overall, round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE l_quantity > 25), 6) AS inside,
        round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE l_quantity <= 25), 6) AS outside FROM lineitem GROUP BY l_linestatus""",
    "expected_roster": """SELECT n_name, coalesce(n, 0) AS n, concat_ws(',', CASE WHEN n IS NULL THEN 'missing' END, CASE WHEN n < 30 THEN 'too few' END) AS errors FROM nation
        LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 4000 GROUP BY 1) ON n_nationkey = c_nationkey""",
    "pose_bins_by_stride": f"""WITH p AS ({' UNION ALL '.join(_PAIR.format(s) for s in (1, 5, 10))}) SELECT stride, event_type, round(avg(d), 5) AS mean, count(*) AS n FROM p WHERE d IS NOT NULL GROUP BY GROUPING SETS ((stride), (event_type), ())""",
}
