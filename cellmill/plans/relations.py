"""Queries of joins, set operations and sampling, with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmill import roles
from cellmill.operators import joins as J
from cellmill.operators import sampling as P
from cellmill.plans.cells import rounded
from cellmill.sources.tables import table


def lookup_priority(spark, sf):
    """Each customer's partner: by key, else by name, else by nation."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    left = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Supplier#"), F.substr("c_name", F.lit(10)))).alias("name"), F.col("c_nationkey").cast("long").alias("nation"))
    right = s.select(F.col("s_suppkey").alias("rk"), F.col("s_name").alias("rname"), F.col("s_nationkey").cast("long").alias("rnation"), F.col("s_suppkey").alias("partner"))
    return J.lookup_first(left, right, [("k", "rk"), ("name", "rname"), ("nation", "rnation")], "partner").select("c_custkey", "partner", "matched_by")


def left_default(spark, sf):
    """Documents with their quality; unlabelled ones stay, as invalid."""
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("valid"), F.col("quality").isNotNull().alias("known"))


def repeated_keys(spark, sf):
    return J.repeated_keys(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


def verified_join(spark, sf):
    """Whether the customer of a nation's number lives in that nation: unknown, yes or no."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation").filter("n_nationkey < 15").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("b"))
    left = c.select("c_custkey", F.col("c_nationkey").alias("key"), F.pmod(F.col("c_custkey"), F.lit(5)).cast("int").alias("a"))
    return J.verified(left, n, "key", "a", "b").select("c_custkey", F.coalesce(F.col("agrees").cast("string"), F.lit("unknown")).alias("agrees"))


def routed_join(spark, sf):
    """Rows of a vocabulary by where they go: resolved, sentinel or unresolved."""
    p, n = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand"), table(spark, sf, "nation").select(F.col("n_nationkey").alias("p_size"), "n_name")
    j = p.join(n, "p_size", "left")
    return j.select("p_partkey", F.when(F.col("p_brand") == "Brand#1", "sentinel").when(F.col("n_name").isNotNull(), "resolved").otherwise("unresolved").alias("route"), "n_name")


def semi_joint(spark, sf):
    """Suppliers seen in all three order states and among returned lines."""
    s = roles.samples(spark, sf)
    streams = [s.filter(F.col("phase") == p).select("scene") for p in roles.PHASES] + [s.filter("model = 'R'").select("scene")]
    return J.in_all(s.select("scene").distinct(), streams, "scene")


def anti_excluded(spark, sf):
    """Cells that are on no exclusion list: scenes, and (scene, phase) pairs."""
    s = roles.samples(spark, sf).select("scene", "phase").distinct()
    return J.in_none(J.in_none(s, [s.filter("scene % 7 = 0").select("scene")], "scene"), [s.filter("scene % 5 = 0 AND phase = 'clean'")], "scene", "phase")


def missing_extra_ids(spark, sf):
    return J.coverage(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("doc_id")), "doc_id")


def set_intersect(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")).intersect(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


def set_except(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


def multiset_equal(spark, sf):
    """Rows by which two copies of a table differ as multisets (one copy lacks some)."""
    a = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    b = a.filter("o_orderkey % 97 <> 0").union(a.filter("o_orderkey = 1"))
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def state_change(spark, sf):
    """Parts of a supplier before and after: removed, added or remained."""
    s = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    return J.changes(s.filter("l_returnflag = 'A'"), s.filter("l_returnflag = 'N'"), "l_suppkey", "l_partkey").groupBy("l_suppkey", "status").agg(F.count(F.lit(1)).alias("n"))


def latest_wins(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return J.latest_wins([table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (-F.col("c_custkey")).alias("v")), o], "k")


def pairs_fixed_gap(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "user_id")
    return J.offset_pairs(e, ["event_type"], "event_id", 5, "user_id")


def pairs_lead(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return J.lead_pairs(e, ["user_id"], ["event_id"], 5, "event_type")


def pairs_max_gap(spark, sf):
    """Pairs of a user's events at most 200 numbers apart whose values differ enough."""
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    return J.within_gap(e, ["user_id"], "event_id", 200, "value").filter(F.abs(F.col("value_a") - F.col("value_b")) > 10).select("user_id", "order_a", "order_b")


def first_offset_match(spark, sf):
    """For each event the nearest later one of the user, at most 300 numbers on, whose value is higher."""
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    pairs = J.within_gap(e, ["user_id"], "event_id", 300, "value")
    return J.first_match(pairs, ["user_id", "order_a"], F.col("order_b") - F.col("order_a"), F.col("value_b") > F.col("value_a")).select("order_a", "order_b")


def as_of_join(spark, sf):
    """Each purchase with the value of the user's latest click."""
    e = table(spark, sf, "events")
    types = ("event_id", "user_id", "ts")
    return rounded(J.as_of(e.filter("event_type = 'purchase'").select(*types), e.filter("event_type = 'click'").select("user_id", "ts", F.col("value").alias("last_click")), ["user_id"], "ts", "last_click").select("event_id", "last_click"))


def sync_gate(spark, sf):
    """Pairs of a user's clicks and views less than an hour apart."""
    e = table(spark, sf, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
    a, b = (e.filter(F.col("event_type") == k).select("user_id", "t", "event_id") for k in ("click", "view"))
    return J.near_in_time(a, b, ["user_id"], "t", 3600.0).select("event_id_a", "event_id_b")


def temporal_chains(spark, sf):
    """Order numbers of a customer from which three steps of 1 exist in the order table's key space."""
    return J.chains(table(spark, sf, "events").select(F.pmod(F.col("user_id"), F.lit(7)).alias("g"), F.floor(F.col("event_id") / 7).alias("slot")), ["g"], "slot", 3, 2)


def _objects(spark, sf):
    """Lines of an order as objects of a frame: the first line of a number stands for it."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("x"), F.min("l_suppkey").alias("y"), F.min("l_quantity").alias("size"))
    return li.withColumnRenamed("l_orderkey", "frame").withColumnRenamed("l_linenumber", "item")


def nearest_in_direction(spark, sf):
    return J.nearest_in_direction(_objects(spark, sf), ["frame"], "item", "x", "y")


def overlap_fraction(spark, sf):
    """Share of each object's box that others of its frame cover (sums, so it may pass 1)."""
    o = _objects(spark, sf).select("frame", "item", F.pmod("x", F.lit(40)).alias("x"), F.pmod("y", F.lit(40)).alias("y"), F.col("size").cast("long").alias("size"))
    a = o.select("frame", "item", "x", "y", "size")
    b = o.select("frame", *[F.col(c).alias(f"{c}_b") for c in ("item", "x", "y", "size")])
    w = F.least(F.col("x") + F.col("size"), F.col("x_b") + F.col("size_b")) - F.greatest("x", "x_b")
    h = F.least(F.col("y") + F.col("size"), F.col("y_b") + F.col("size_b")) - F.greatest("y", "y_b")
    cover = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    return rounded(a.join(b, "frame").filter("item <> item_b").groupBy("frame", "item").agg((F.sum(cover) / F.max(F.col("size") * F.col("size"))).alias("overlap")))


def occluder_best(spark, sf):
    """For each object the smaller-numbered one that covers most of it."""
    o = _objects(spark, sf).select("frame", "item", F.pmod("x", F.lit(40)).alias("x"), F.col("size").cast("long").alias("size"))
    b = o.select("frame", *[F.col(c).alias(f"{c}_b") for c in ("item", "x", "size")])
    cover = F.greatest(F.least(F.col("x") + F.col("size"), F.col("x_b") + F.col("size_b")) - F.greatest("x", "x_b"), F.lit(0))
    pairs = o.join(b, "frame").filter("item_b < item").withColumn("cover", cover / F.col("size")).filter("cover > 0")
    return rounded(pairs.groupBy("frame", "item").agg(F.max_by("item_b", F.struct("cover", -F.col("item_b"))).alias("occluder"), F.max("cover").alias("cover")))


def nearest_points(spark, sf):
    """Nearest other-labelled point within a radius, in three dimensions."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")])
    return rounded(J.nearest_within(e.filter("label < 5"), e.filter("label >= 5"), ("x", "y", "z"), 0.25, "vec_id", "vec_id"))


def null_safe_lookup(spark, sf):
    """Prompts by a key that may be null."""
    a = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.pmod("o_custkey", F.lit(9))).alias("k"))
    b = spark.range(9).select(F.when(F.col("id") > 0, F.col("id")).alias("kb"), F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"))
    return a.join(F.broadcast(b), F.col("k").eqNullSafe(F.col("kb")), "left").select("o_orderkey", "prompt")


def hash_topk_per_group(spark, sf):
    o = table(spark, sf, "orders")
    return P.top_by_hash(o.select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"], 3, "seed", "o_orderkey")


def stable_ids(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", P.stable_id("n_name", "n_regionkey").alias("id"), P.hash_rank("7", "n_name").alias("rank"))


def quota_per_bin(spark, sf):
    from cellmill.functions.kernels import band

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return P.quota_per_bin(o, ["o_orderstatus"], band(F.col("o_totalprice"), [0.0, 100000.0, 300000.0, 1e12], ["low", "mid", "high"]), 5, "bins", "o_orderkey").select("o_orderkey", "bin")


def shard_modulo(spark, sf):
    return P.shard(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 8)


def stratified_cap(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return P.stratified_cap(c, ["c_nationkey"], "c_mktsegment", 12, ["c_custkey"], F.when(F.col("c_acctbal") > 5000, 0).otherwise(1)).select("c_custkey", "c_nationkey")


def half_split(spark, sf):
    return P.halves(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], "half", "c_custkey")


def even_spaced(spark, sf):
    return P.even_spaced(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 8)


def stride_sample(spark, sf):
    return P.stride_sample(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 10)


def first_n_per_stratum(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return P.first_per_stratum(o, F.concat_ws("/", "o_orderstatus", "o_orderpriority"), 4, ["o_orderkey"]).select("o_orderkey", "stratum")


def balanced_negatives(spark, sf):
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", (F.col("toxic") == 1).alias("yes"))
    return P.balanced_negatives(lab, ["lang"], "yes", "neg", "doc_id")


def best_frame(spark, sf):
    """The best line of each order among unreturned ones: low discount, then high quantity."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_returnflag", "l_partkey")
    return P.best_row(li, ["l_orderkey"], F.col("l_returnflag") != "R", [F.col("l_discount").asc(), F.col("l_quantity").desc(), F.col("l_linenumber").asc(), F.col("l_partkey").asc()]).select("l_orderkey", "l_linenumber", "l_partkey")


QUERIES = {f.__name__: f for f in (
    lookup_priority, left_default, repeated_keys, verified_join, routed_join, semi_joint, anti_excluded, missing_extra_ids, set_intersect, set_except, multiset_equal, state_change, latest_wins,
    pairs_fixed_gap, pairs_lead, pairs_max_gap, first_offset_match, as_of_join, sync_gate, temporal_chains, nearest_in_direction, overlap_fraction, occluder_best, nearest_points, null_safe_lookup,
    hash_topk_per_group, stable_ids, quota_per_bin, shard_modulo, stratified_cap, half_split, even_spaced, stride_sample, first_n_per_stratum, balanced_negatives, best_frame,
)}

_OBJ = "obj AS (SELECT l_orderkey AS frame, l_linenumber AS item, min(l_partkey) AS x, min(l_suppkey) AS y, min(l_quantity) AS size FROM lineitem GROUP BY ALL)"
_E5 = "e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
_h = lambda seed, c: f"sha256('{seed}:' || {c})"
ORACLE_SQL = {
    "lookup_priority": """SELECT c_custkey, coalesce(a.v, b.v, n.v) AS partner, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN n.v IS NOT NULL THEN 3 END AS matched_by FROM customer
        LEFT JOIN (SELECT s_suppkey AS k, min(s_suppkey) AS v FROM supplier GROUP BY 1) a ON c_custkey % 2 = 0 AND a.k = c_custkey
        LEFT JOIN (SELECT s_name AS k, min(s_suppkey) AS v FROM supplier GROUP BY 1) b ON c_custkey % 3 = 0 AND b.k = 'Supplier#' || substr(c_name, 10)
        LEFT JOIN (SELECT s_nationkey AS k, min(s_suppkey) AS v FROM supplier GROUP BY 1) n ON n.k = c_nationkey""",
    "left_default": "SELECT doc_id, coalesce(quality = 1, false) AS valid, quality IS NOT NULL AS known FROM documents LEFT JOIN labels USING (doc_id)",
    "repeated_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "verified_join": "SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN 'unknown' WHEN c_custkey % 5 IS NOT DISTINCT FROM n_regionkey THEN 'true' ELSE 'false' END AS agrees FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 15) ON c_nationkey = n_nationkey",
    "routed_join": "SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'sentinel' WHEN n_name IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS route, n_name FROM part LEFT JOIN nation ON p_size = n_nationkey",
    "semi_joint": f"""WITH {roles.SAMPLES_SQL} SELECT DISTINCT scene FROM samples WHERE scene IN (SELECT scene FROM samples WHERE phase = 'clutter') AND scene IN (SELECT scene FROM samples WHERE phase = 'interaction')
        AND scene IN (SELECT scene FROM samples WHERE phase = 'clean') AND scene IN (SELECT scene FROM samples WHERE model = 'R')""",
    "anti_excluded": f"WITH {roles.SAMPLES_SQL} SELECT DISTINCT scene, phase FROM samples WHERE scene % 7 <> 0 AND NOT (scene % 5 = 0 AND phase = 'clean')",
    "missing_extra_ids": """SELECT doc_id, 'missing' AS status FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id * 2 FROM labels) UNION ALL
        SELECT doc_id, 'extra' FROM (SELECT doc_id * 2 AS doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""",
    "set_intersect": "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT o_custkey FROM orders",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "multiset_equal": """WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS (SELECT * FROM a WHERE o_orderkey % 97 <> 0 UNION ALL SELECT * FROM a WHERE o_orderkey = 1)
        SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "state_change": """WITH b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N')
        SELECT l_suppkey, status, count(*) AS n FROM (SELECT coalesce(b.l_suppkey, a.l_suppkey) AS l_suppkey, CASE WHEN a.l_suppkey IS NULL THEN 'removed' WHEN b.l_suppkey IS NULL THEN 'added' ELSE 'remained' END AS status
        FROM b FULL JOIN a ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey) GROUP BY ALL""",
    "latest_wins": "SELECT coalesce(c_custkey, k) AS k, coalesce(v, -c_custkey) AS v FROM customer FULL JOIN (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 1) ON k = c_custkey",
    "pairs_fixed_gap": "SELECT a.event_type, a.event_id AS order_a, b.event_id AS order_b, a.user_id AS user_id_a, b.user_id AS user_id_b FROM events a JOIN events b ON a.event_type = b.event_type AND a.event_id + 5 = b.event_id",
    "pairs_lead": """SELECT * FROM (SELECT user_id, event_id, event_type, lead(event_id, 5) OVER w AS event_id_next, lead(event_type, 5) OVER w AS event_type_next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        WHERE event_id_next IS NOT NULL""",
    "pairs_max_gap": "SELECT a.user_id, a.event_id AS order_a, b.event_id AS order_b FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.event_id <= a.event_id + 200 WHERE abs(a.value - b.value) > 10",
    "first_offset_match": """SELECT a.event_id AS order_a, min(b.event_id) AS order_b FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.event_id <= a.event_id + 300 AND b.value > a.value GROUP BY 1""",
    "as_of_join": """SELECT p.event_id, round((SELECT arg_max(c.value, c.ts) FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts), 6) AS last_click FROM events p WHERE p.event_type = 'purchase'""",
    "sync_gate": """SELECT a.event_id AS event_id_a, b.event_id AS event_id_b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'
        AND abs(floor(epoch(a.ts)) - floor(epoch(b.ts))) < 3600""",
    "temporal_chains": """WITH s AS (SELECT DISTINCT user_id % 7 AS g, event_id // 7 AS slot FROM events) SELECT g, slot AS start FROM s WHERE (g, slot + 2) IN (SELECT (g, slot) FROM s) AND (g, slot + 4) IN (SELECT (g, slot) FROM s)
        AND (g, slot + 6) IN (SELECT (g, slot) FROM s)""",
    "nearest_in_direction": f"""WITH {_OBJ}, p AS (SELECT a.frame, a.item, b.item AS other, b.x - a.x AS dx, b.y - a.y AS dy, abs(b.x - a.x) + abs(b.y - a.y) AS distance FROM obj a JOIN obj b ON a.frame = b.frame AND a.item <> b.item),
        d AS (SELECT *, unnest(list_filter([CASE WHEN dx < 0 THEN 'left' END, CASE WHEN dx > 0 THEN 'right' END, CASE WHEN dy < 0 THEN 'above' END, CASE WHEN dy > 0 THEN 'below' END], lambda v: v IS NOT NULL)) AS direction FROM p)
        SELECT frame, item, direction, arg_min(other, struct_pack(a := distance, b := other)) AS nearest, min(distance) AS distance FROM d GROUP BY ALL""",
    "overlap_fraction": f"""WITH {_OBJ}, o AS (SELECT frame, item, x % 40 AS x, y % 40 AS y, CAST(size AS BIGINT) AS size FROM obj)
        SELECT a.frame, a.item, round(sum(greatest(least(a.x + a.size, b.x + b.size) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.size, b.y + b.size) - greatest(a.y, b.y), 0)) / CAST(max(a.size * a.size) AS DOUBLE), 6) AS overlap
        FROM o a JOIN o b ON a.frame = b.frame AND a.item <> b.item GROUP BY ALL""",
    "occluder_best": f"""WITH {_OBJ}, o AS (SELECT frame, item, x % 40 AS x, CAST(size AS BIGINT) AS size FROM obj),
        p AS (SELECT a.frame, a.item, b.item AS other, greatest(least(a.x + a.size, b.x + b.size) - greatest(a.x, b.x), 0) / CAST(a.size AS DOUBLE) AS cover FROM o a JOIN o b ON a.frame = b.frame AND b.item < a.item)
        SELECT frame, item, arg_max(other, struct_pack(a := cover, b := -other)) AS occluder, round(max(cover), 6) AS cover FROM p WHERE cover > 0 GROUP BY ALL""",
    "nearest_points": f"""WITH {_E5}, p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM e a JOIN e b ON a.label < 5 AND b.label >= 5)
        SELECT id_a, arg_min(id_b, struct_pack(a := d2, b := id_b)) AS id_b, round(sqrt(min(d2)), 6) AS distance FROM p WHERE d2 <= CAST(0.0625 AS DOUBLE) GROUP BY id_a""",
    "null_safe_lookup": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'prompt 0' WHEN o_custkey % 9 = 0 THEN NULL ELSE 'prompt ' || o_custkey % 9 END AS prompt FROM orders",
    "hash_topk_per_group": f"SELECT o_orderkey, o_orderpriority, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY {_h('seed', 'o_orderkey')}) AS k FROM orders) WHERE k <= 3",
    "stable_ids": f"SELECT n_nationkey, substr(sha256(n_name || chr(31) || n_regionkey), 1, 20) AS id, {_h('7', 'n_name')} AS rank FROM nation",
    "quota_per_bin": f"""WITH b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS bin FROM orders)
        SELECT o_orderkey, bin FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, bin ORDER BY {_h('bins', 'o_orderkey')}) AS k FROM b) WHERE k <= 5""",
    "shard_modulo": "SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) % 8 AS shard FROM customer",
    "stratified_cap": """WITH i AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_acctbal > 5000 THEN 0 ELSE 1 END AS p, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY CASE WHEN c_acctbal > 5000 THEN 0 ELSE 1 END, c_custkey) AS i FROM customer)
        SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY p, i, c_mktsegment) AS k FROM i) WHERE k <= 12""",
    "half_split": f"""SELECT c_custkey, c_nationkey, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY {_h('half', 'c_custkey')}) <= count(*) OVER (PARTITION BY c_nationkey) // 2 THEN 'first' ELSE 'second' END AS half FROM customer""",
    "even_spaced": """WITH i AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events)
        SELECT user_id, event_id FROM i WHERE c <= 8 OR list_contains(list_transform(range(8), lambda j: j * c // 8), i)""",
    "stride_sample": """WITH i AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events)
        SELECT user_id, event_id FROM i WHERE c <= 10 OR list_contains(list_transform(range(10), lambda j: CAST(round_even(j * (c - 1) / 9.0, 0) AS BIGINT)), i)""",
    "first_n_per_stratum": """SELECT o_orderkey, o_orderstatus || '/' || o_orderpriority AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 4""",
    "balanced_negatives": f"""WITH l AS (SELECT doc_id, lang, toxic = 1 AS yes FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY lang, yes ORDER BY {_h('neg', 'doc_id')}) AS k, sum(CASE WHEN yes THEN 1 ELSE 0 END) OVER (PARTITION BY lang) AS y FROM l)
        SELECT doc_id, lang, yes FROM r WHERE yes OR k <= y""",
    "best_frame": """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_quantity DESC, l_linenumber, l_partkey) AS k FROM lineitem WHERE l_returnflag <> 'R') WHERE k = 1""",
}
