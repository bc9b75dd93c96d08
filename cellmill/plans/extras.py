"""Queries of naming rules, lookups, identity scores and pair sampling, with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmill.functions import kernels as K
from cellmill.functions import names as N
from cellmill.operators import identity as I
from cellmill.operators import lookups as L
from cellmill.operators import pairs as P
from cellmill.plans.cells import rounded
from cellmill.sources.tables import table


def _part(spark, sf):
    return table(spark, sf, "part")


def question_parts(spark, sf):
    """Materials and functions that generated questions ask for."""
    k = F.col("p_partkey") % 3
    q = F.when(k == 0, F.concat(F.lit("What is made of "), "p_type", F.lit(" that is used for "), "p_brand", F.lit("?"))).when(k == 1, F.concat(F.lit("Which object is not MADE of "), "p_type", F.lit(" ?"))).otherwise("p_name")
    p = _part(spark, sf).withColumn("q", q)
    material, function = N.composition_parts(F.col("q"))
    return p.select("p_partkey", material.alias("material"), function.alias("function"), N.odd_one_out_part(F.col("q")).alias("odd"))


def path_repairs(spark, sf):
    """Paths with defects and without: repaired, with another modality, stem and frame number."""
    p = _part(spark, sf)
    path = F.concat(F.lit("scenes/s"), "p_partkey", F.when(F.col("p_partkey") % 2 == 0, "/1.0/rgb/rgb/").otherwise("/1/depth/rgb/"), "p_size", F.lit(".v2.png"))
    d = p.select("p_partkey", path.alias("path"), F.concat(F.lit("id-"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_partkey").cast("string"))).alias("id"))
    return d.select("p_partkey", N.repaired_path(F.col("path")).alias("repaired"), N.swapped_segment(F.col("path"), "rgb", "mask").alias("swapped"), N.stem(F.col("path")).alias("stem"), N.trailing_number(F.col("id"), F.lit("f07")).alias("frame"))


def material_atoms(spark, sf):
    """Parts of compound materials, joined again."""
    v = F.concat_ws("/", "p_type", F.concat(F.lit("  "), F.upper("p_brand"), F.lit("& "), "p_type"), F.lit(" "))
    return _part(spark, sf).select("p_partkey", F.concat_ws("|", N.material_atoms(v)).alias("atoms"))


def object_prompts(spark, sf):
    """Display names, detector prompts, referring expressions, and a template filled with them."""
    p = _part(spark, sf)
    name = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("_")))
    starts = F.element_at(F.array(*[F.lit(x) for x in ("Which object is ", "What is the object ", "Which object ", "Find ")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    question = F.concat(starts, "p_type", F.lit("_one?"))
    phrase = N.referring_expression(question)
    return p.select("p_partkey", N.display_name(name).alias("display"), N.prompt_text(F.lower("p_brand"), name).alias("prompt"), phrase.alias("phrase"), N.filled(F.lit("detect {x} in {y}"), x=phrase, y=F.col("p_brand")).alias("filled"))


def latex_rows(spark, sf):
    """Rows of a report; a negative balance counts as missing."""
    c = table(spark, sf, "customer")
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 7)
    return c.select("c_custkey", N.latex_row(F.col("c_name"), N.report_cell(balance, 3), N.report_cell(F.col("c_nationkey") / 3, 1, "n/a")).alias("line"))


def half_even_rounding(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", N.half_even((F.col("c_custkey") % 40) / 8, 2).alias("two"), N.half_even((F.col("c_custkey") % 40) / 4, 1).alias("one"), N.half_even((F.col("c_custkey") % 40) / 2, 0).alias("none"))


def phase_order(spark, sf):
    """Places of phases; other words come last by name."""
    o = table(spark, sf, "orders").select(F.coalesce(F.create_map(*[F.lit(x) for x in ("F", "clutter", "P", "interaction", "O", "clean")])[F.col("o_orderstatus")], F.lit("x")).alias("phase"), "o_orderpriority")
    both = o.select(F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderpriority")).otherwise(F.col("phase")).alias("phase"))
    return both.groupBy("phase").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", N.phase_rank(F.col("phase")))


def answer_centred(spark, sf):
    li = table(spark, sf, "lineitem")
    x, y = F.col("l_partkey") % 60, F.col("l_suppkey") % 40
    flag = F.when(F.col("l_linenumber") == 1, F.col("l_returnflag") == "A")
    return li.groupBy("l_linenumber").agg(F.count_if(N.centred(flag, x, y, x + F.col("l_quantity"), y + 9, F.lit(64), F.lit(48))).alias("centred"), F.count(F.lit(1)).alias("n"))


#: Families in the order in which they are searched.
FAMILIES = ("multi", "single", "ego")
RECIPES = [("click", "multi", "rgb,depth"), ("click", "single", "rgb"), ("view", "single", "rgb,mask"), ("view", "ego", "rgb"), ("purchase", "ego", "rgb,pose")]


def recipe_lookup(spark, sf):
    """Modalities of tasks by family, or by the first family that knows the task."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("task"), F.when(F.col("user_id") % 3 == 0, "ego").when(F.col("user_id") % 3 == 1, "single").alias("family"))
    recipes = spark.createDataFrame(RECIPES, "task string, family string, modalities string")
    return L.resolve_recipes(e.distinct(), recipes, FAMILIES).select("task", "family", "recipe_family", "modalities")


def ego_layout(spark, sf):
    """Scenes of one layout that exactly one folder of another has."""
    s = table(spark, sf, "supplier").filter("s_suppkey IS NOT NULL")
    ego = s.select(F.format_string("scene%03d", F.col("s_suppkey")).alias("name"))
    other = s.select(F.explode(F.when(F.col("s_suppkey") % 5 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))).alias("part"), "s_suppkey")
    return L.matched_scenes(ego, other.select(F.concat(F.lit("scene"), "s_suppkey", F.lit("."), "part").alias("name")))


def _colours(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("image"), *[(F.pmod(F.col("l_partkey"), F.lit(n)) * 50).alias(c) for c, n in (("red", 3), ("green", 2), ("blue", 2))], "l_partkey").filter("l_partkey % 11 < image % 11 + 1")


PALETTE = [(0, 0, 0, 0), (1, 50, 0, 0), (2, 100, 50, 50), (3, 0, 50, 50), (4, 50, 50, 50)]


def palette_labels(spark, sf):
    """Labels of colours in each image."""
    palette = spark.createDataFrame(PALETTE, "label int, red long, green long, blue long")
    return L.palette_labels(_colours(spark, sf), palette, ["image"]).groupBy("image", "label").agg(F.count(F.lit(1)).alias("n"))


def objects_meta(spark, sf):
    li = table(spark, sf, "lineitem")
    return L.objects_meta(li, "l_partkey", ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"], "l_returnflag", "l_quantity")


def identity_iou(spark, sf):
    """Line numbers as tracks against parts as identities, two tracks of each."""
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("frame"), F.col("l_linenumber").cast("long").alias("track"), (F.col("l_partkey") % 6).alias("truth"))
    tracks = spark.createDataFrame([(t, (t * 2) % 5) for t in range(1, 7)], "track long, source long")
    return rounded(I.identity_summary(I.identity_iou(li, tracks, ["frame"]), "frame"))


def grounding_first_box(spark, sf):
    """The box of an order's first odd line against those of its even lines."""
    li = table(spark, sf, "lineitem")
    box = lambda p, d: [(F.col("l_partkey") % 30 + d).alias(f"{p}1"), (F.col("l_suppkey") % 30).alias(f"{p}2"), (F.col("l_partkey") % 30 + F.col("l_quantity") + d).alias(f"{p}3"), (F.col("l_suppkey") % 30 + 12).alias(f"{p}4")]
    pred = li.filter("l_linenumber % 2 = 1").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("k"), *box("p", 0))
    truth = li.filter("l_linenumber % 2 = 0").select("l_orderkey", *box("t", 3))
    iou = K.box_iou(tuple(F.col(f"p{i}") for i in range(1, 5)), tuple(F.col(f"t{i}") for i in range(1, 5)))
    return rounded(I.grounding(pred, truth, ["l_orderkey"], "k", iou))


def depth_order(spark, sf):
    """Order of pixels of two objects a draw, by vectors as frames."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("at", "v"))
    px = e.select("vec_id", (F.floor(F.col("at") / 16) + 1).alias("object"), "at", F.round(F.col("v").cast("double") * 4, 4).alias("truth"), F.round(F.col("v").cast("double") * 3 + (F.col("at") % 5) / 5, 4).alias("pred"))
    return rounded(I.depth_order(px, ["vec_id"], 12, "ord", 0.05, 5))


def _lines(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))



def pose_gap_pairs(spark, sf):
    """Pairs two lines apart that turn and move enough, two of each bin and order."""
    pairs = P.gap_pairs(_lines(spark, sf), ["l_orderkey"], "l_linenumber", 2, "p", "q").withColumn("turn", F.pmod(F.abs(F.col("p_a") - F.col("p_b")), F.lit(180)).cast("double")).withColumn("move", F.abs(F.col("q_a") - F.col("q_b")) / 10)
    return P.binned(pairs, ["l_orderkey"], (F.col("turn"), F.col("move")), 2, "gap", (5.0, 0.5)).select("l_orderkey", "order_a", "order_b", "bin")


def pose_cross_pairs(spark, sf):
    """Pairs of a supplier's lines of two kinds, at most 40 candidates, three of each bin."""
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at")).agg(F.min("l_partkey").alias("p"))
    a, b = (li.filter(F.col("l_returnflag") == k).select("l_suppkey", "at", "p") for k in "AN")
    pairs = P.cross_pairs(a, b, ["l_suppkey"], "at", 40, "cross", "p").withColumn("turn", F.pmod(F.abs(F.col("p_a") - F.col("p_b")), F.lit(180)).cast("double"))
    return P.binned(pairs, ["l_suppkey"], (F.col("turn"), F.lit(0.0)), 3, "cross", (2.0, 0.0)).select("l_suppkey", "order_a", "order_b", "bin")


OFFSETS = (5, 3, 8, 12)


def pose_source_pairs(spark, sf):
    """For every fourth event of a user the first offset at which the value differs moderately."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.round("value", 6).alias("value"))
    return P.first_offsets(e, ["user_id"], "event_id", OFFSETS, 4, F.abs(F.col("value_a") - F.col("value_b")).between(5.0, 40.0), "value")


def chain_starts(spark, sf):
    e = table(spark, sf, "events").select(F.pmod(F.col("user_id"), F.lit(7)).alias("g"), F.floor(F.col("event_id") / 7).alias("slot"))
    return P.chain_starts(e, ["g"], "slot", 3, 2, 5, "chain")


def _depths(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("at", "v"))
    return e.select("frame", F.pmod("at", F.lit(8)).alias("x"), F.floor(F.col("at") / 8).alias("y"), F.round(F.col("v").cast("double") * 4 + 1, 4).alias("depth"))


def sparse_depth(spark, sf):
    """Ten measured points of every frame."""
    return rounded(P.depth_points(_depths(spark, sf), ["frame"], 10, "sparse"))


def keypoint_pairs(spark, sf):
    """Points of a frame seen from the next one, which stands a little aside."""
    d = _depths(spark, sf)
    points = P.depth_points(d, ["frame"], 10, "keys")
    nxt = d.withColumn("frame", F.col("frame") - 1)
    move = (F.col("cam_x") + 0.1, F.col("cam_y") - 0.05, F.col("cam_z") + 0.02)
    return rounded(P.keypoints(points, nxt, ["frame"], move, (8, 8), (4.0, 4.0, 3.5, 3.5), 0.5))


QUERIES = {f.__name__: f for f in (
    question_parts, path_repairs, material_atoms, object_prompts, latex_rows, half_even_rounding, phase_order, answer_centred, recipe_lookup, ego_layout, palette_labels, objects_meta, identity_iou,
    grounding_first_box, depth_order, pose_gap_pairs, pose_cross_pairs, pose_source_pairs, chain_starts, sparse_depth, keypoint_pairs,
)}

_h = lambda seed, *parts: f"sha256('{seed}:' || {' || chr(31) || '.join(parts)})"
_spin = lambda seed, *parts: f"CAST(('0x' || substr({_h(seed, *parts)}, 1, 12)) AS BIGINT)"
_bin = "CASE WHEN turn < 15 THEN '0-15' WHEN turn < 45 THEN '15-45' WHEN turn < 90 THEN '45-90' ELSE '90-180' END"
_squeeze = lambda c: rf"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"
_DEPTH = """d AS (SELECT vec_id AS frame, pos % 8 AS x, pos // 8 AS y, round(CAST(embedding[pos + 1] AS DOUBLE) * 4 + 1, 4) AS depth FROM (SELECT vec_id, embedding, unnest(range(64)) AS pos FROM embeddings))"""
_POINTS = lambda seed: f"pt AS (SELECT frame, x, y, depth FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {_h(seed, 'frame', 'x', 'y')}) AS k FROM d WHERE depth > 0) WHERE k <= 10)"
ORACLE_SQL = {
    "question_parts": r"""WITH q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'What is made of ' || p_type || ' that is used for ' || p_brand || '?' WHEN 1 THEN 'Which object is not MADE of ' || p_type || ' ?' ELSE p_name END AS q FROM part)
        SELECT p_partkey, nullif(trim(regexp_extract(q, '(?i)made of (.+?) that is used for (.+?)\??$', 1)), '') AS material, nullif(trim(regexp_extract(q, '(?i)made of (.+?) that is used for (.+?)\??$', 2)), '') AS function,
            nullif(trim(regexp_extract(q, '(?i)NOT made of (.+?)\??$', 1)), '') AS odd FROM q""",
    "path_repairs": r"""WITH d AS (SELECT p_partkey, 'scenes/s' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '/1.0/rgb/rgb/' ELSE '/1/depth/rgb/' END || p_size || '.v2.png' AS p, p_size || '.v2' AS stem FROM part)
        SELECT p_partkey, regexp_replace(p, '/(\d+)\.0/', '/\1/') AS repaired, regexp_replace(p, '/rgb/', '/mask/') AS swapped, stem, CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE p_partkey END AS frame FROM d""",
    "material_atoms": f"""WITH v AS (SELECT p_partkey, {_squeeze('p_type')} AS a, {_squeeze('p_brand')} AS b FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct([a, b])), '|') AS atoms FROM v""",
    "object_prompts": """WITH q AS (SELECT *, lower(p_name) AS n, CASE p_partkey % 4 WHEN 0 THEN 'the object ' WHEN 1 THEN 'the object ' WHEN 2 THEN 'the object ' ELSE 'Find ' END || replace(p_type, '_', ' ') || ' one' AS phrase FROM part)
        SELECT p_partkey, n AS display, lower(p_brand) || ' ' || n AS prompt, phrase, 'detect ' || phrase || ' in ' || p_brand AS filled FROM q""",
    "latex_rows": r"""SELECT c_custkey, c_name || ' & ' || CASE WHEN c_acctbal >= 0 THEN printf('%.3f', c_acctbal / 7) ELSE '--' END || ' & ' || printf('%.1f', c_nationkey / CAST(3 AS DOUBLE)) || ' \\' AS line FROM customer""",
    "half_even_rounding": "SELECT c_custkey, round_even((c_custkey % 40) / CAST(8 AS DOUBLE), 2) AS two, round_even((c_custkey % 40) / CAST(4 AS DOUBLE), 1) AS one, round_even((c_custkey % 40) / CAST(2 AS DOUBLE), 0) AS none FROM customer",
    "phase_order": """WITH p AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN o_orderpriority ELSE CASE o_orderstatus WHEN 'F' THEN 'clutter' WHEN 'P' THEN 'interaction' WHEN 'O' THEN 'clean' ELSE 'x' END END AS phase FROM orders)
        SELECT phase, count(*) AS n, CAST(CASE phase WHEN 'clutter' THEN 0 WHEN 'interaction' THEN 1 WHEN 'clean' THEN 2 ELSE 3 END AS INT) AS rank FROM p GROUP BY phase""",
    "answer_centred": """WITH b AS (SELECT l_linenumber, l_returnflag, (2 * (l_partkey % 60) + l_quantity) / 128 AS x, (2 * (l_suppkey % 40) + 9) / CAST(96 AS DOUBLE) AS y FROM lineitem)
        SELECT l_linenumber, count(*) FILTER (WHERE CASE WHEN l_linenumber = 1 THEN l_returnflag = 'A' ELSE x BETWEEN 0.25 AND 0.75 AND y BETWEEN 0.25 AND 0.75 END) AS centred, count(*) AS n FROM b GROUP BY l_linenumber""",
    "recipe_lookup": f"""WITH t AS (SELECT DISTINCT event_type AS task, CASE user_id % 3 WHEN 0 THEN 'ego' WHEN 1 THEN 'single' END AS family FROM events), r(task, recipe_family, modalities) AS (VALUES {", ".join(map(str, RECIPES))}),
        j AS (SELECT t.*, recipe_family, modalities, row_number() OVER (PARTITION BY t.task, t.family ORDER BY CASE recipe_family WHEN 'multi' THEN 1 WHEN 'single' THEN 2 WHEN 'ego' THEN 3 END) AS k
            FROM t LEFT JOIN r ON t.task = r.task AND (t.family IS NULL OR t.family = r.recipe_family)) SELECT task, family, recipe_family, modalities FROM j WHERE k = 1""",
    "ego_layout": "SELECT format('scene{:03d}', s_suppkey) AS name, CAST(s_suppkey AS INT) AS number, s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 AS ok FROM supplier",
    "palette_labels": f"""WITH c AS (SELECT l_suppkey AS image, l_partkey % 3 * 50 AS red, l_partkey % 2 * 50 AS green, l_partkey % 2 * 50 AS blue FROM lineitem WHERE l_partkey % 11 < l_suppkey % 11 + 1), p(label, red, green, blue) AS (VALUES {", ".join(map(str, PALETTE))}),
        j AS (SELECT image, coalesce(label, 0) AS label FROM c LEFT JOIN p USING (red, green, blue)), s AS (SELECT image, max(label) AS most, count(DISTINCT label) - 1 AS dense FROM j GROUP BY image)
        SELECT image, CAST(CASE WHEN label = most THEN dense ELSE label END AS BIGINT) AS label, count(*) AS n FROM j JOIN s USING (image) GROUP BY ALL""",
    "objects_meta": """SELECT l_partkey, l_returnflag, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag) AS k FROM lineitem WHERE l_partkey IS NOT NULL) WHERE k = 1""",
    "identity_iou": f"""WITH t(track, source) AS (VALUES {", ".join(str((t, (t * 2) % 5)) for t in range(1, 7))}), p AS (SELECT l_suppkey % 50 AS frame, l_partkey % 6 AS truth, source FROM lineitem LEFT JOIN t ON track = l_linenumber),
        a AS (SELECT frame, truth AS object, count(*) AS nt, count(*) FILTER (WHERE source = truth) AS hit FROM p WHERE truth > 0 GROUP BY ALL), b AS (SELECT frame, source AS object, count(*) AS np FROM p WHERE source IS NOT NULL GROUP BY ALL),
        s AS (SELECT frame, hit / CAST(nt + coalesce(np, 0) - hit AS DOUBLE) AS iou, coalesce(np, 0) > 0 AS located FROM a LEFT JOIN b USING (frame, object))
        SELECT frame, count(*) AS object_frames, count(*) FILTER (WHERE located) AS located_frames, round(avg(iou), 6) AS iou_mean, round(avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS accuracy_50 FROM s GROUP BY frame""",
    "grounding_first_box": """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_partkey % 30 AS x, l_suppkey % 30 AS y FROM lineitem),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM b WHERE l_linenumber % 2 = 1) WHERE k = 1), t AS (SELECT * FROM b WHERE l_linenumber % 2 = 0),
        j AS (SELECT coalesce(p.l_orderkey, t.l_orderkey) AS l_orderkey, p.x IS NULL AS none, t.x IS NULL AS no_truth, greatest(least(p.x + p.l_quantity, t.x + 3 + t.l_quantity) - greatest(p.x, t.x + 3), 0) * greatest(least(p.y, t.y) + 12 - greatest(p.y, t.y), 0) AS i,
            p.l_quantity * 12 + t.l_quantity * 12 AS a FROM p FULL JOIN t USING (l_orderkey)), m AS (SELECT l_orderkey, max(CASE WHEN none THEN 0.0 WHEN no_truth THEN 1.0 ELSE i / (a - i) END) AS iou FROM j GROUP BY l_orderkey)
        SELECT l_orderkey, round(iou, 6) AS iou, iou >= 0.5 AS hit FROM m""",
    "depth_order": f"""WITH e AS (SELECT vec_id, pos, CAST(embedding[pos + 1] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(64)) AS pos FROM embeddings)),
        px AS (SELECT vec_id, pos // 16 + 1 AS object, pos, round(v * 4, 4) AS truth, round(v * 3 + (pos % 5) / CAST(5 AS DOUBLE), 4) AS pred FROM e), dr AS (SELECT px.*, draw FROM px, (SELECT unnest(range(12)) AS draw)),
        o AS (SELECT vec_id, draw, object, arg_min(pred, {_h('ord', 'draw', 'object', 'pos')}) AS pred, arg_min(truth, {_h('ord', 'draw', 'object', 'pos')}) AS truth FROM dr GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, draw ORDER BY {_h('ord', 'draw', 'object')}, pred, truth) AS k FROM o),
        j AS (SELECT a.vec_id, CASE WHEN (a.truth < b.truth) = (a.pred < b.pred) THEN 1.0 ELSE 0.0 END AS kept FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.draw = b.draw AND a.k = 1 AND b.k = 2 WHERE abs(a.truth - b.truth) >= CAST(0.05 AS DOUBLE))
        SELECT vec_id, round(avg(kept), 6) AS accuracy, count(*) AS pairs FROM j GROUP BY vec_id HAVING count(*) >= 5""",
    "pose_gap_pairs": f"""WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
        c AS (SELECT a.l_orderkey, a.l_linenumber AS order_a, b.l_linenumber AS order_b, abs(a.p - b.p) % 180 AS turn, abs(a.q - b.q) / 10 AS move FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 2),
        f AS (SELECT *, {_bin} AS bin FROM c WHERE turn >= 5 AND move >= 0.5)
        SELECT l_orderkey, order_a, order_b, bin FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, bin ORDER BY {_h('gap', 'l_orderkey', 'order_a', 'order_b')}) AS k FROM f) WHERE k <= 2""",
    "pose_cross_pairs": f"""WITH l AS (SELECT l_suppkey, l_returnflag, l_orderkey * 10 + l_linenumber AS ln, min(l_partkey) AS p FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL),
        b AS (SELECT l_suppkey, ln, p, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_h('cross', 'l_suppkey', 'ln')}, ln) - 1 AS place, count(*) OVER (PARTITION BY l_suppkey) AS size FROM l WHERE l_returnflag = 'N'),
        a AS (SELECT l_suppkey, ln, p, count(*) OVER (PARTITION BY l_suppkey) AS n, {_spin('cross', 'l_suppkey', 'ln')} AS start FROM l WHERE l_returnflag = 'A'),
        t AS (SELECT a.*, size, unnest(range(least(size, greatest(40 // n, 1)))) AS step FROM a JOIN (SELECT DISTINCT l_suppkey, size FROM b) USING (l_suppkey)),
        c AS (SELECT t.l_suppkey, t.ln AS order_a, b.ln AS order_b, abs(t.p - b.p) % 180 AS turn FROM t JOIN b ON b.l_suppkey = t.l_suppkey AND b.place = (t.start + t.step) % t.size), f AS (SELECT *, {_bin} AS bin FROM c WHERE turn >= 2)
        SELECT l_suppkey, order_a, order_b, bin FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, bin ORDER BY {_h('cross', 'l_suppkey', 'order_a', 'order_b')}) AS k FROM f) WHERE k <= 3""",
    "pose_source_pairs": f"""WITH e AS (SELECT user_id, event_id, round(value, 6) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events), o(try, step) AS (VALUES {", ".join(str((i, o)) for i, o in enumerate(OFFSETS))}),
        p AS (SELECT a.user_id, a.event_id AS order_a, b.event_id AS order_b, try FROM e a, o JOIN e b ON b.user_id = a.user_id AND b.place = a.place + step WHERE a.place % 4 = 0 AND abs(a.value - b.value) BETWEEN 5.0 AND 40.0)
        SELECT user_id, order_a, arg_min(order_b, try) AS order_b FROM p GROUP BY ALL""",
    "chain_starts": f"""WITH e AS (SELECT DISTINCT user_id % 7 AS g, event_id // 7 AS slot FROM events), c AS (SELECT g, slot AS start FROM e WHERE (g, slot + 2) IN (SELECT (g, slot) FROM e) AND (g, slot + 4) IN (SELECT (g, slot) FROM e) AND (g, slot + 6) IN (SELECT (g, slot) FROM e))
        SELECT g, start FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {_h('chain', 'g', 'start')}) AS k FROM c) WHERE k <= 5""",
    "sparse_depth": f"WITH {_DEPTH}, {_POINTS('sparse')} SELECT frame, x, y, round(depth, 6) AS depth FROM pt",
    "keypoint_pairs": f"""WITH {_DEPTH}, {_POINTS('keys')}, m AS (SELECT frame, x, y, (x - 3.5) * depth / 4.0 + CAST(0.1 AS DOUBLE) AS u, (y - 3.5) * depth / 4.0 - CAST(0.05 AS DOUBLE) AS v, depth + CAST(0.02 AS DOUBLE) AS w FROM pt),
        f AS (SELECT *, CASE WHEN w > 0 THEN u * 4.0 / w + 3.5 END AS x2, CASE WHEN w > 0 THEN v * 4.0 / w + 3.5 END AS y2 FROM m), i AS (SELECT *, x2 >= 0 AND x2 < 8 AND y2 >= 0 AND y2 < 8 AS inside FROM f)
        SELECT i.frame, i.x, i.y, round(x2, 6) AS x2, round(y2, 6) AS y2, coalesce(inside AND d.depth > 0 AND abs(d.depth - w) <= 0.5, false) AS visible
        FROM i LEFT JOIN d ON inside AND d.frame = i.frame + 1 AND d.x = CAST(floor(x2) AS BIGINT) AND d.y = CAST(floor(y2) AS BIGINT)""",
}
