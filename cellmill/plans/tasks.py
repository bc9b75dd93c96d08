"""Queries of task building and per-pixel change: nearest vectors, in-context and robot questions, benchmark plans, with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmill.functions import names as N
from cellmill.operators import planning as B
from cellmill.operators import questions as G
from cellmill.operators import sequences as Q
from cellmill.operators import vectors as V
from cellmill.plans.cells import rounded
from cellmill.plans.questions import _objects, _placed
from cellmill.sources.tables import table


def knn_embeddings(spark, sf):
    """The five nearest vectors of every vector whose id is divisible by 100."""
    return rounded(V.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 5))


def knn_votes(spark, sf):
    """Labels that the nearest vectors vote for."""
    e = table(spark, sf, "embeddings")
    return rounded(V.votes(V.nearest(e, F.col("vec_id") % 100 == 0, 5), e), 5)


def range_gradients(spark, sf):
    """Errors of change between a label's successive frames, by depth."""
    e = table(spark, sf, "embeddings").select(F.col("label").alias("clip"), "vec_id", F.posexplode("embedding").alias("pixel", "v"))
    truth = F.abs(F.col("v").cast("double")) * 6 + 0.25
    p = e.select("clip", "vec_id", "pixel", truth.alias("truth"), (truth * 1.05 + F.pmod("pixel", F.lit(3)) * 0.02).alias("pred"))
    return rounded(Q.range_gradients(p, ["clip"], "vec_id", "pixel", "pred", "truth", static=0.5, least=3), 9)


def incontext_farthest(spark, sf):
    """The object furthest from each published object of an order, where that is clear."""
    return G.farthest_from(_placed(spark, sf), ["frame"], "item", "x", "y", table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("item")))


def incontext_identify(spark, sf):
    """Objects to be found again in an order by their brand as identity, and why others are left out."""
    o = _objects(spark, sf, "p_brand", "size_class").select("frame", "item", F.concat_ws("/", "p_brand", "size_class").alias("identity"))
    catalog = table(spark, sf, "part").filter("p_size > 5").select(F.concat_ws("/", "p_brand", F.pmod("p_size", F.lit(5)).cast("string")).alias("identity")).distinct()
    return G.identify(o, ["frame"], "item", "identity", catalog)


def robot_presence(spark, sf):
    """Whether a referenced brand is in an order: up to three that are, and no more that aren't."""
    o = _objects(spark, sf, "p_brand").select("frame", F.col("p_brand").alias("category")).distinct()
    return G.presence_questions(o, ["frame"], "category", table(spark, sf, "part").select(F.col("p_brand").alias("category")), 3, "t1")


def robot_direction(spark, sf):
    """The nearest object on the first side of an object that has any, with options."""
    return G.direction_questions(_placed(spark, sf), ["frame"], "item", "x", "y", 3, "t3")


def robot_count(spark, sf):
    """How many objects of an order share a brand, with numbers to choose from."""
    o = _objects(spark, sf, "p_brand").select("frame", "item", F.col("p_brand").alias("category"))
    return G.count_questions(o, ["frame"], "item", "category", "t5")


def robot_attribute(spark, sf):
    """Which of several objects of a brand in an order has a size, with options."""
    return G.attribute_questions(_objects(spark, sf, "p_brand", "size_class"), ["frame"], "item", "p_brand", "size_class", "t2")


def robot_state(spark, sf):
    """What went, came and changed in number between the first and the last lines of an order, which overlap."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("frame"), "l_linenumber", "p_brand")
    return G.state_questions(li.filter("l_linenumber <= 4"), li.filter("l_linenumber >= 3"), ["frame"], "p_brand", "t4")


def mos_plan(spark, sf):
    """Six orders of each supplier that several kinds of lines share, dealt to kinds and halves."""
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("cell"), F.col("l_orderkey").alias("frame"), F.when(F.col("l_quantity") > 25, "spatial").otherwise("general").alias("stream"))
    return B.joint_frames(li.select(F.col("l_suppkey").alias("cell"), F.col("l_orderkey").alias("frame"), F.when(F.col("l_discount") < 0.06, "spatial").otherwise("general").alias("stream")).union(rows), ["cell"], "frame", "stream", ["general", "spatial"], 6, "plan")


def acceptance_sample(spark, sf):
    """Two centred answers of each type and condition, from different scenes where possible; and the cells that have fewer."""
    li = table(spark, sf, "lineitem")
    x, y = F.col("l_partkey") % 60, F.col("l_suppkey") % 40
    fine = N.centred(F.lit(None).cast("boolean"), x, y, x + F.col("l_quantity"), y + 9, F.lit(64), F.lit(48))
    rows = li.filter(fine).select(F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("condition"), F.col("l_suppkey").alias("scene"), "l_orderkey")
    return B.quota_sample(rows, ["type", "condition"], "scene", ["l_orderkey"], 2, "accept")


QUERIES = {f.__name__: f for f in (knn_embeddings, knn_votes, range_gradients, incontext_farthest, incontext_identify, robot_presence, robot_direction, robot_count, robot_attribute, robot_state, mos_plan, acceptance_sample)}

_h = lambda seed, *parts: f"sha256('{seed}:' || {' || chr(31) || '.join(parts)})"
_O = """o AS (SELECT DISTINCT l_orderkey AS frame, l_partkey AS item, p_brand, p_type, CAST(p_size % 5 AS VARCHAR) AS size_class, p_size, p_retailprice, CAST(l_partkey % 64 AS DOUBLE) AS x, CAST(l_partkey * 7 % 48 AS DOUBLE) AS y
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_KNN = """q AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum([x * x FOR x IN v])) AS norm FROM q),
    c AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 9) AS cosine FROM n a JOIN n b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id WHERE a.norm > 0 AND b.norm > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS place FROM c), nn AS (SELECT * FROM k WHERE place <= 5)"""
_BAND = "CASE WHEN truth >= CAST(0.3 AS DOUBLE) AND truth < 1 THEN 'near' WHEN truth >= 1 AND truth < 2.5 THEN 'mid' WHEN truth >= 2.5 AND truth < 5 THEN 'far' END"
_MIX = lambda seed, key: f"list(o ORDER BY sha256('{seed}:' || {key} || ':' || o))"
ORACLE_SQL = {
    "knn_embeddings": f"WITH {_KNN} SELECT query, neighbour, round(cosine, 6) AS cosine, place FROM nn",
    "knn_votes": f"""WITH {_KNN}, w AS (SELECT query, e.label, sum(greatest(cosine, 0)) AS w FROM nn JOIN embeddings e ON e.vec_id = neighbour GROUP BY ALL), s AS (SELECT *, CASE WHEN sum(w) OVER p > 0 THEN w / sum(w) OVER p ELSE 0.0 END AS share FROM w WINDOW p AS (PARTITION BY query)),
        t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(share, 9) DESC, label) AS k FROM s) SELECT query, t.label, round(share, 5) AS share, t.label IS NOT DISTINCT FROM e.label AS agreed FROM t JOIN embeddings e ON e.vec_id = query WHERE k = 1""",
    "range_gradients": f"""WITH e AS (SELECT label AS clip, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t, embedding FROM embeddings), p AS (SELECT clip, vec_id, t, pixel, abs(CAST(embedding[pixel + 1] AS DOUBLE)) * 6 + CAST(0.25 AS DOUBLE) AS truth
            FROM (SELECT *, unnest(range(64)) AS pixel FROM e)), v AS (SELECT *, truth * CAST(1.05 AS DOUBLE) + pixel % 3 * CAST(0.02 AS DOUBLE) AS pred, {_BAND} AS band FROM p),
        d AS (SELECT a.clip, a.t, a.band, b.pred - a.pred AS dp, b.truth - a.truth AS dt FROM v a JOIN v b ON a.clip = b.clip AND b.t = a.t + 1 AND a.pixel = b.pixel
            WHERE a.truth > CAST(0.3 AS DOUBLE) AND a.truth < 5 AND b.truth > CAST(0.3 AS DOUBLE) AND b.truth < 5 AND a.pred > 0 AND b.pred > 0),
        s AS (SELECT clip, t, band, CASE WHEN count(*) FILTER (WHERE abs(dt) < 0.5) >= 3 THEN avg(abs(abs(dp) - abs(dt))) FILTER (WHERE abs(dt) < 0.5) END AS tgm, CASE WHEN count(*) >= 3 THEN avg((dp - dt) * (dp - dt)) END AS tgse FROM d WHERE band IS NOT NULL GROUP BY ALL)
        SELECT clip, {", ".join(f"round(avg({m}) FILTER (WHERE band = '{b}'), 9) AS {m}_{b}" for m in ("tgm", "tgse") for b in ("near", "mid", "far"))} FROM s GROUP BY clip""",
    "incontext_farthest": f"""WITH {_O}, d AS (SELECT a.frame, a.item, b.item AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM o a JOIN o b ON a.frame = b.frame AND a.item <> b.item WHERE a.p_size > 10),
        m AS (SELECT frame, item, max(d2) AS d2 FROM d GROUP BY ALL) SELECT d.frame, d.item, min(other) AS farthest FROM d JOIN m USING (frame, item, d2) GROUP BY d.frame, d.item HAVING count(*) = 1""",
    "incontext_identify": f"""WITH {_O}, i AS (SELECT frame, item, p_brand || '/' || size_class AS identity FROM o), c AS (SELECT DISTINCT p_brand || '/' || p_size % 5 AS identity FROM part WHERE p_size > 5),
        r AS (SELECT i.*, c.identity IS NULL AS unknown, count(*) OVER (PARTITION BY frame, i.identity) AS n FROM i LEFT JOIN c USING (identity))
        SELECT frame, item, identity, CASE WHEN unknown THEN 'not_in_catalog' WHEN n > 1 THEN 'duplicate_identity' END AS dropped FROM r""",
    "robot_presence": f"""WITH {_O}, v AS (SELECT DISTINCT frame, p_brand AS category FROM o), y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {_h('t1', 'frame', 'category')}) AS k FROM v) WHERE k <= 3),
        r AS (SELECT category, row_number() OVER (ORDER BY {_h('t1', 'category')}, category) - 1 AS place, count(*) OVER () AS size FROM (SELECT DISTINCT p_brand AS category FROM part)),
        n AS (SELECT frame, count(*) AS wanted FROM y GROUP BY frame), c AS (SELECT frame, count(*) AS have FROM v GROUP BY frame),
        a AS (SELECT n.frame, wanted, have, size, CAST(('0x' || substr({_h('t1', 'n.frame')}, 1, 12)) AS BIGINT) AS start FROM n JOIN c USING (frame), (SELECT DISTINCT size FROM r)),
        s AS (SELECT *, unnest(range(least(wanted + have, size))) AS step FROM a), f AS (SELECT s.frame, r.category, step, wanted FROM s JOIN r ON r.place = (start + step) % s.size),
        z AS (SELECT f.frame, f.category, wanted, row_number() OVER (PARTITION BY f.frame ORDER BY step) AS k FROM f LEFT JOIN v USING (frame, category) WHERE v.frame IS NULL)
        SELECT frame, category, 'yes' AS answer FROM y UNION ALL SELECT frame, category, 'no' FROM z WHERE k <= wanted""",
    "robot_direction": f"""WITH {_O}, refs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {_h('t3', 'frame', 'item')}) AS k FROM o) WHERE k <= 3),
        d AS (SELECT r.frame, r.item, b.item AS other, unnest(list_filter([CASE WHEN b.x < r.x THEN 1 END, CASE WHEN b.x > r.x THEN 2 END, CASE WHEN b.y < r.y THEN 3 END, CASE WHEN b.y > r.y THEN 4 END], lambda w: w IS NOT NULL)) AS way, abs(r.x - b.x) + abs(r.y - b.y) AS dist
            FROM refs r JOIN o b ON r.frame = b.frame AND r.item <> b.item), f AS (SELECT *, min(way) OVER (PARTITION BY frame, item) AS first FROM d),
        a AS (SELECT frame, item, way, arg_min(other, struct_pack(a := dist, b := other)) AS answer FROM f WHERE way = first GROUP BY ALL),
        w AS (SELECT a.frame, a.item, CAST(o.item AS VARCHAR) AS o, row_number() OVER (PARTITION BY a.frame, a.item ORDER BY {_h('t3', 'a.frame', 'a.item', 'o.item')}) AS k FROM a JOIN o ON a.frame = o.frame AND o.item <> a.item AND o.item <> a.answer),
        e AS (SELECT frame, item, CAST(answer AS VARCHAR) AS o FROM a UNION ALL SELECT frame, item, 'nothing' FROM a UNION ALL SELECT frame, item, o FROM w WHERE k <= 2),
        m AS (SELECT frame, item, {_MIX('t3', "frame || '/' || item")} AS os FROM e GROUP BY ALL)
        SELECT frame, item, ['left', 'right', 'above', 'below'][way] AS direction, answer, array_to_string(os, '|') AS options, CAST(list_position(os, CAST(answer AS VARCHAR)) AS INT) AS place FROM a JOIN m USING (frame, item)""",
    "robot_count": f"""WITH {_O}, c AS (SELECT frame, p_brand AS category, count(DISTINCT item) AS answer FROM o GROUP BY ALL), e AS (SELECT frame, category, answer, CAST(unnest(CASE WHEN answer = 1 THEN [1, 2, 3, 4] ELSE [answer - 1, answer, answer + 1, answer + 2] END) AS VARCHAR) AS o FROM c),
        m AS (SELECT frame, category, answer, {_MIX('t5', "frame || '/' || category")} AS os FROM e GROUP BY ALL)
        SELECT frame, category, answer, array_to_string(os, '|') AS options, CAST(list_position(os, CAST(answer AS VARCHAR)) AS INT) AS place FROM m""",
    "robot_attribute": f"""WITH {_O}, i AS (SELECT frame, p_brand, list(struct_pack(item := item, v := size_class) ORDER BY item) AS every FROM o GROUP BY ALL HAVING count(*) > 1),
        a AS (SELECT frame, p_brand, every, unnest(every[1:2]) AS one FROM i),
        w AS (SELECT frame, p_brand, one.item AS item, 'the ' || one.v || ' ' || p_brand AS answer, list_filter(every, lambda e: e.v <> one.v)[1:2] AS others FROM a),
        e AS (SELECT frame, p_brand, item, answer, unnest(([answer] || [('the ' || x.v || ' ' || p_brand) FOR x IN others] || ['any ' || p_brand, 'none of the visible objects', 'none of the visible objects'])[1:4]) AS o FROM w)
        SELECT frame, p_brand, item, answer, array_to_string(os, '|') AS options, CAST(list_position(os, answer) AS INT) AS place
        FROM (SELECT frame, p_brand, item, answer, {_MIX('t2', "frame || '/' || item")} AS os FROM e GROUP BY ALL)""",
    "robot_state": f"""WITH l AS (SELECT l_orderkey AS frame, l_linenumber AS n, p_brand AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
        s AS (SELECT frame, c, bool_or(n <= 4) AS was, bool_or(n >= 3) AS is_, sha256('t4:' || frame || ':' || c) AS h FROM l GROUP BY frame, c),
        k AS (SELECT frame, coalesce(list(c ORDER BY h) FILTER (WHERE was AND is_), []) AS stayed, coalesce(list(c ORDER BY h) FILTER (WHERE NOT is_), []) AS removed,
            coalesce(list(c ORDER BY h) FILTER (WHERE NOT was), []) AS added, count(*) FILTER (WHERE is_) - count(*) FILTER (WHERE was) AS d FROM s GROUP BY frame),
        q AS (SELECT frame, 'removed' AS change, unnest(removed[1:2]) AS answer, (stayed || ['nothing was removed', 'nothing was removed', 'nothing was removed'])[1:3] AS wrong FROM k
            UNION ALL SELECT frame, 'added', unnest(added[1:1]), (stayed || ['nothing was added', 'nothing was added', 'nothing was added'])[1:3] FROM k
            UNION ALL SELECT frame, 'count', CASE WHEN d < 0 THEN 'decreased by ' || -d ELSE 'increased by ' || d END,
                ['stayed the same', CASE WHEN d < 0 THEN 'increased by ' || (1 - d) ELSE 'decreased by ' || (d + 1) END, 'cannot determine'] FROM k WHERE d <> 0),
        e AS (SELECT frame, change, answer, unnest([answer] || wrong) AS o FROM q)
        SELECT frame, change, answer, array_to_string(os, '|') AS options, CAST(list_position(os, answer) AS INT) AS place
        FROM (SELECT frame, change, answer, {_MIX('t4', "frame || '/' || change || '/' || answer")} AS os FROM e GROUP BY ALL)""",
    "mos_plan": f"""WITH s AS (SELECT l_suppkey AS cell, l_orderkey AS frame, CASE WHEN l_discount < CAST(0.06 AS DOUBLE) THEN 'spatial' ELSE 'general' END AS stream FROM lineitem UNION SELECT l_suppkey, l_orderkey, CASE WHEN l_quantity > 25 THEN 'spatial' ELSE 'general' END FROM lineitem),
        j AS (SELECT cell, frame FROM s GROUP BY ALL HAVING count(DISTINCT stream) = 2), c AS (SELECT cell, count(*) AS eligible FROM j GROUP BY cell),
        f AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {_h('plan', 'cell', 'frame')}) AS k FROM j), p AS (SELECT cell, frame, k, row_number() OVER (PARTITION BY cell ORDER BY {_h('plan-split', 'cell', 'frame')}) AS half, count(*) OVER (PARTITION BY cell) AS n FROM f WHERE k <= 6)
        SELECT cell, frame, CASE WHEN half <= n // 2 THEN 'general' ELSE 'spatial' END AS slot, eligible, eligible >= 6 AS enough FROM p JOIN c USING (cell)""",
    "acceptance_sample": f"""WITH b AS (SELECT l_returnflag AS type, l_linenumber AS condition, l_suppkey AS scene, l_orderkey, (2 * (l_partkey % 60) + l_quantity) / 128 AS x, (2 * (l_suppkey % 40) + 9) / CAST(96 AS DOUBLE) AS y FROM lineitem),
        r AS (SELECT type, condition, scene, l_orderkey, row_number() OVER (PARTITION BY type, condition, scene ORDER BY {_h('accept', 'type', 'condition', 'scene', 'l_orderkey')}) AS turn FROM b WHERE x BETWEEN 0.25 AND 0.75 AND y BETWEEN 0.25 AND 0.75),
        k AS (SELECT *, row_number() OVER (PARTITION BY type, condition ORDER BY turn, {_h('accept', 'type', 'condition', 'scene', 'l_orderkey')}) AS k FROM r) SELECT type, condition, scene, l_orderkey FROM k WHERE k <= 2""",
}
