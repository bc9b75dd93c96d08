"""Queries of the scalar kernels and curves, with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmill import roles
from cellmill.functions import kernels as K
from cellmill.operators import curves as V
from cellmill.plans.cells import rounded
from cellmill.sources.tables import table


def _depth(spark, sf):
    """Pixels: a line's price predicts its quantity's range."""
    s = roles.samples(spark, sf).select("scene", "phase", (F.col("rmse")).alias("truth"), (F.col("latency_ms") / 15 + 0.05).alias("pred"))
    return s.filter(K.valid_depth(F.col("pred"), F.col("truth"), 0.3, 5.0))


def depth_errors(spark, sf):
    return rounded(_depth(spark, sf).groupBy("phase").agg(*[c.alias(n) for n, c in K.depth_aggregates(F.col("pred"), F.col("truth")).items()], F.count(F.lit(1)).alias("n")))


def depth_bands(spark, sf):
    """Errors by range band; bands with under 100 pixels are left out."""
    d = _depth(spark, sf).withColumn("band", K.band(F.col("truth"), [0.3, 1.0, 2.5, 5.0], ["near", "mid", "far"]))
    a = K.depth_aggregates(F.col("pred"), F.col("truth"))
    return rounded(d.groupBy("phase", "band").agg(a["absrel"].alias("absrel"), a["delta1"].alias("delta1"), F.count(F.lit(1)).alias("n")).filter("n >= 100 AND band IS NOT NULL"))


def depth_clip_mean(spark, sf):
    """Frame errors first, then their mean over clips (scenes), so that every frame weighs the same."""
    a = K.depth_aggregates(F.col("pred"), F.col("truth"))
    frames = _depth(spark, sf).groupBy("phase", "scene").agg(a["absrel"].alias("absrel"), a["rmse"].alias("rmse"))
    return rounded(frames.groupBy("phase").agg(F.avg("absrel").alias("absrel"), F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("frames")))


def depth_quality(spark, sf):
    """Shares of missing and saturated values and percentiles."""
    li = table(spark, sf, "lineitem")
    share = lambda c: F.avg(c.cast("double"))
    return rounded(li.groupBy("l_returnflag").agg(
        share(F.col("l_discount") == 0).alias("zero"), share(F.col("l_discount") >= 0.1).alias("saturated"), F.percentile("l_quantity", 0.01).alias("p01"),
        F.percentile("l_quantity", 0.5).alias("p50"), F.percentile("l_quantity", 0.99).alias("p99"), F.count(F.lit(1)).alias("n"),
    ))


def _boxes(spark, sf):
    """Two inclusive boxes for each line from its numbers."""
    li = table(spark, sf, "lineitem")
    k, p, s, q = (F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"))
    x, y = F.pmod(k, F.lit(50)), F.pmod(p, F.lit(50))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", x.alias("ax"), y.alias("ay"), (x + q).alias("bx"), (y + q).alias("by"),
        (x + F.pmod(s, F.lit(9)) - 4).alias("cx"), (y + F.pmod(k, F.lit(7)) - 3).alias("cy"), (x + q + F.pmod(p, F.lit(5))).alias("dx"), (y + q - F.pmod(s, F.lit(3))).alias("dy"),
    )


_A, _B = ("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy")
_cols = lambda names: tuple(F.col(n) for n in names)


def box_iou(spark, sf):
    b = _boxes(spark, sf)
    return rounded(b.groupBy("l_returnflag").agg(F.avg(K.box_iou(_cols(_A), _cols(_B))).alias("iou"), F.avg(K.box_iou(_cols(_A), _cols(_B), True)).alias("iou_inclusive"), F.count(F.lit(1)).alias("n")))


def box_giou(spark, sf):
    b = _boxes(spark, sf)
    return rounded(b.groupBy("l_returnflag").agg(
        F.avg(K.box_giou(_cols(_A), _cols(_B))).alias("giou"), F.avg(K.center_inside(_cols(_B), _cols(_A)).cast("double")).alias("center_inside"),
        F.avg(K.box_valid(_cols(_B), F.lit(100), F.lit(100)).cast("double")).alias("valid"),
    ))


def iou_accuracy(spark, sf):
    """Share of boxes that reach each IoU threshold; boxes outside the image stay in the denominator."""
    b = _boxes(spark, sf).withColumn("iou", K.box_iou(_cols(_A), _cols(_B), True)).withColumn("valid", K.box_valid(_cols(_B), F.lit(100), F.lit(100)))
    return rounded(V.thresholded(b, "iou", "valid", [0.5 + 0.05 * i for i in range(10)], ("l_returnflag",)))


def box_scaling(spark, sf):
    """Boxes given in thousandths of the image, or as shares, as pixels; some are off the grid."""
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("double")
    given = tuple(F.when(F.col("p_partkey") % 2 == 0, (size + o) / 60).otherwise((size + o) * 17) for o in (0, 1, 4, 9))
    px = K.scaled_box(given, F.lit(640), F.lit(480))
    return rounded(p.select("p_partkey", *[c.alias(n) for c, n in zip(px, ("x1", "y1", "x2", "y2"))]))


def _quats(spark, sf):
    """Unit quaternions and translations from neighbouring parts of a vector."""
    e = table(spark, sf, "embeddings")
    q, r = ([F.element_at("embedding", i).cast("double") for i in range(a, a + 4)] for a in (1, 5))
    t, u = ([F.element_at("embedding", i).cast("double") for i in range(a, a + 3)] for a in (9, 12))
    unit = lambda v: [x / K.norm(v) for x in v]
    return e, unit(q), unit(r), t, u


def rotation_error(spark, sf):
    e, q, r, t, u = _quats(spark, sf)
    return rounded(e.select(
        "vec_id", K.quaternion_angle(q, r).alias("angle"), K.rotation_error(K.quaternion_matrix(q), K.quaternion_matrix(r)).alias("matrix_angle"), K.translation_error(t, u).alias("translation"),
        K.direction_error(t, u).alias("direction"), K.band(K.quaternion_angle(q, r), K.ROTATION_EDGES, K.ROTATION_BINS).alias("rotation_bin"),
    ), 4)


def pose_vector(spark, sf):
    """Mean pose errors by label and rotation bin."""
    e, q, r, t, u = _quats(spark, sf)
    d = e.select("label", K.quaternion_angle(q, r).alias("angle"), K.translation_error(t, u).alias("translation"))
    d = d.withColumn("rotation_bin", K.band(F.col("angle"), K.ROTATION_EDGES, K.ROTATION_BINS))
    return rounded(d.groupBy("label", "rotation_bin").agg(F.avg("angle").alias("angle"), F.avg("translation").alias("translation"), F.count(F.lit(1)).alias("n")), 4)


def error_auc(spark, sf):
    return rounded(V.error_auc(roles.samples(spark, sf), "rmse", 5.0, ("phase",)))


def joint_success(spark, sf):
    return rounded(V.success_table(roles.samples(spark, sf), "rmse", "absrel", [(1.0, 0.02), (2.0, 0.05), (4.0, 0.08)], ("phase",)))


def joint_auc(spark, sf):
    """Mean of the joint success over a 5 x 4 grid of limits."""
    limits = [(float(a), b / 100) for a in (1, 2, 3, 4, 5) for b in (2, 4, 6, 8)]
    s = V.success_table(roles.samples(spark, sf), "rmse", "absrel", limits, ("phase",))
    return rounded(s.select("phase", (sum((F.col(f"s{i}") for i in range(len(limits))), F.lit(0.0)) / len(limits)).alias("auc")))


def mean_iou(spark, sf):
    """Line numbers as predicted classes against quantities' eighths; one of these is no class."""
    li = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("long").alias("pred"), (F.pmod(F.col("l_quantity").cast("long"), F.lit(8)) - 1).alias("truth"))
    return rounded(V.mean_iou(li, "pred", "truth", ("l_returnflag",)))


def confusion_matrix(spark, sf):
    return V.confusion(table(spark, sf, "labels"), "quality", "toxic")


def token_f1(spark, sf):
    """Words of a user's turn against those of the answer."""
    c = table(spark, sf, "conversations")
    u, a = c.filter("role = 'user'").select("conv_id", "turn", K.words(F.col("text")).alias("u")), c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), K.words(F.col("text")).alias("a"))
    return rounded(u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", K.token_f1(F.col("u"), F.col("a")).alias("f1")))


def label_normalise(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", K.normal_label(F.concat_ws("_", F.lit(" To "), "p_name", F.lit("x-y\t(x)!"))).alias("label"))


def canonical_values(spark, sf):
    """Colours, functions and materials in odd spellings."""
    p = table(spark, sf, "part")
    colour = F.concat(F.lit(" "), F.when(F.col("p_partkey") % 3 == 0, "GRAY").otherwise(F.upper(F.substring_index("p_name", " ", 1))), F.lit("  "))
    function = F.element_at(F.array(*[F.lit(x) for x in ("To  Drink", "to eat ", "To Snack", "cut")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", K.canonical(colour, K.COLOUR_ALIASES).alias("colour"), K.canonical(function, K.FUNCTION_ALIASES).alias("function"), K.canonical("p_type").alias("material"))


def box_parsing(spark, sf):
    """The one box in generated answers; none if there are two."""
    p = table(spark, sf, "part")
    one = F.format_string("box: [%d, %d,%d , %d]", F.col("p_size"), F.lit(1), F.col("p_size") + 5, F.lit(9))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(one, F.lit(" or [1,2,3,4]"))).otherwise(one)
    return p.select("p_partkey", K.only_box(text).alias("b")).filter("b IS NOT NULL").select("p_partkey", *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def metadata_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", K.metadata_field(F.col("props"), "k").cast("long").alias("k"))


def roofline(spark, sf):
    """Parts as kernels: size is work, price is traffic."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 1e9).alias("flops"), (F.col("p_retailprice") * 1e4).alias("traffic"))
    compute, memory, least, bound = K.roofline(F.col("flops"), F.col("traffic"), 19.5, 2039.0)
    return rounded(p.select("p_partkey", compute.alias("compute_ms"), memory.alias("memory_ms"), least.alias("bound_ms"), bound.alias("bound"), (F.col("flops") / F.col("traffic")).alias("intensity")), 9)


def vqa_score(spark, sf):
    """Answers as boxes, overall and by type, in one pass: invalid ones count with IoU 0 and GIoU -1."""
    b = _boxes(spark, sf).withColumn("valid", K.box_valid(_cols(_B), F.lit(100), F.lit(100)))
    b = b.withColumn("iou", F.when(F.col("valid"), K.box_iou(_cols(_A), _cols(_B), True)).otherwise(0.0)).withColumn("giou", F.when(F.col("valid"), K.box_giou(_cols(_A), _cols(_B))).otherwise(-1.0))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return rounded(b.groupingSets([["l_returnflag"], []], "l_returnflag").agg(
        share(F.col("valid")).alias("valid_share"), F.avg("iou").alias("mean_iou"), F.avg("giou").alias("mean_giou"), share(F.col("iou") >= 0.5).alias("acc_50"), share(F.col("iou") >= 0.75).alias("acc_75"),
        share(F.col("valid") & K.center_inside(_cols(_B), _cols(_A))).alias("center"), F.count(F.lit(1)).alias("n"),
    ))


def chain_drift(spark, sf):
    """Drift of chains of ten relative poses: the product of the predicted steps against the product of the true ones, and the
    mere sum of step errors beside it."""
    e, q, r, t, u = _quats(spark, sf)
    small = lambda v, w: [x * 0.02 for x in v[:3]] + [F.sqrt(1 - sum((x * x * 0.0004 for x in v[:3]), F.lit(0.0)))]  # noqa: E731  a slight turn
    steps = e.select("vec_id", F.floor(F.col("vec_id") / 10).alias("chain"), K.motion(small(q, None), t).alias("truth"), K.motion(small(q, None), [a + b * 0.01 for a, b in zip(t, u)]).alias("pred"))
    ordered = steps.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("vec_id", "truth", "pred"))).alias("s"))
    ends = ordered.select("chain", K.chain(F.transform("s", lambda x: x["truth"])).alias("a"), K.chain(F.transform("s", lambda x: x["pred"])).alias("b"), F.aggregate("s", F.lit(0.0), lambda acc, x: acc + K.norm([x["pred"][9 + i] - x["truth"][9 + i] for i in range(3)])).alias("summed"))
    off = K.relative(F.col("a"), F.col("b"))
    return rounded(ends.select("chain", K.motion_angle(off).alias("angle"), K.norm([off[9 + i] for i in range(3)]).alias("drift"), "summed"), 4)


QUERIES = {f.__name__: f for f in (
    depth_errors, depth_bands, depth_clip_mean, depth_quality, box_iou, box_giou, iou_accuracy, box_scaling, rotation_error, pose_vector, error_auc, joint_success, joint_auc, mean_iou, confusion_matrix,
    token_f1, label_normalise, canonical_values, box_parsing, metadata_fields, roofline, vqa_score, chain_drift,
)}

_DEPTH = f"{roles.SAMPLES_SQL}, d AS (SELECT scene, phase, rmse AS truth, latency_ms / 15 + CAST(0.05 AS DOUBLE) AS pred FROM samples WHERE rmse > CAST(0.3 AS DOUBLE) AND rmse < 5 AND latency_ms / 15 + CAST(0.05 AS DOUBLE) > 0)"
_W = "greatest(pred / truth, truth / pred)"
_BOXES = """b AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_orderkey % 50 AS ax, l_partkey % 50 AS ay, l_orderkey % 50 + CAST(l_quantity AS BIGINT) AS bx, l_partkey % 50 + CAST(l_quantity AS BIGINT) AS bz,
    l_orderkey % 50 + l_suppkey % 9 - 4 AS cx, l_partkey % 50 + l_orderkey % 7 - 3 AS cy, l_orderkey % 50 + CAST(l_quantity AS BIGINT) + l_partkey % 5 AS dx, l_partkey % 50 + CAST(l_quantity AS BIGINT) - l_suppkey % 3 AS dy FROM lineitem)"""


def _iou(plus):
    inter = f"(greatest(least(bx, dx) - greatest(ax, cx) + {plus}, 0) * greatest(least(bz, dy) - greatest(ay, cy) + {plus}, 0))"
    union = f"(greatest(bx - ax + {plus}, 0) * greatest(bz - ay + {plus}, 0) + greatest(dx - cx + {plus}, 0) * greatest(dy - cy + {plus}, 0) - {inter})"
    return f"CASE WHEN {union} > 0 THEN {inter} / CAST(nullif({union}, 0) AS DOUBLE) ELSE 0.0 END", union


_VALID = "(cx >= 0 AND cy >= 0 AND dx >= cx AND dy >= cy AND dx < 100 AND dy < 100)"
_HULL = "((greatest(bx, dx) - least(ax, cx) + 1) * (greatest(bz, dy) - least(ay, cy) + 1))"
_ACC = [0.5 + 0.05 * i for i in range(10)]
_q = lambda a: [f"CAST(embedding[{i}] AS DOUBLE)" for i in range(a, a + 4)]
_POSE = f"""p AS (SELECT vec_id, label, {", ".join(f"{x} AS q{i}" for i, x in enumerate(_q(1)))}, {", ".join(f"{x} AS r{i}" for i, x in enumerate(_q(5)))},
        {", ".join(f"CAST(embedding[{9 + i}] AS DOUBLE) AS t{i}, CAST(embedding[{12 + i}] AS DOUBLE) AS u{i}" for i in range(3))} FROM embeddings),
    a AS (SELECT *, degrees(2 * acos(least(abs(q0 * r0 + q1 * r1 + q2 * r2 + q3 * r3) / (sqrt(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3) * sqrt(r0 * r0 + r1 * r1 + r2 * r2 + r3 * r3)), 1.0))) AS angle,
        sqrt((t0 - u0) * (t0 - u0) + (t1 - u1) * (t1 - u1) + (t2 - u2) * (t2 - u2)) AS translation,
        degrees(acos(greatest(least((t0 * u0 + t1 * u1 + t2 * u2) / (sqrt(t0 * t0 + t1 * t1 + t2 * t2) * sqrt(u0 * u0 + u1 * u1 + u2 * u2)), 1.0), -1.0))) AS direction FROM p),
    c AS (SELECT *, CASE WHEN angle < 15 THEN '0-15' WHEN angle < 45 THEN '15-45' WHEN angle < 90 THEN '45-90' ELSE '90-180' END AS rotation_bin FROM a)"""
_LIMITS = [(1.0, 0.02), (2.0, 0.05), (4.0, 0.08)]
_share = lambda a, b: f"avg(CASE WHEN rmse <= {a} AND absrel <= CAST({b} AS DOUBLE) THEN 1.0 ELSE 0.0 END)"
_norm = lambda c: rf"trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize({c})), '_', ' '), '[^\p{{L}}\p{{N}}\s-]', '', 'g'), '\s+', ' ', 'g'))"
_words = lambda c: f"list_filter(string_split({_norm(c)}, ' '), lambda w: w <> '')"
_canonical = lambda c: rf"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"
_SCALE = """s AS (SELECT p_partkey, p_size + o.o AS v, o.o, p_partkey % 2 = 0 AS share, CASE WHEN o.o IN (0, 4) THEN 639 ELSE 479 END AS last FROM part, (VALUES (0), (1), (4), (9)) o(o)),
    g AS (SELECT p_partkey, o, last, CASE WHEN share THEN v / CAST(60 AS DOUBLE) ELSE v * CAST(17 AS DOUBLE) END AS given FROM s),
    w AS (SELECT *, max(given) OVER (PARTITION BY p_partkey) AS most FROM g),
    b AS (SELECT p_partkey, o, CASE WHEN most <= 1000 THEN given * last / CASE WHEN most <= 1 THEN 1.0 ELSE 1000.0 END END AS px FROM w)"""
ORACLE_SQL = {
    "depth_errors": f"""WITH {_DEPTH} SELECT phase, round(avg(abs(pred - truth) / truth), 6) AS absrel, round(avg((pred - truth) * (pred - truth) / truth), 6) AS sqrel, round(sqrt(avg((pred - truth) * (pred - truth))), 6) AS rmse,
        round(avg(abs(pred - truth)), 6) AS mae, round(sqrt(avg((ln(pred) - ln(truth)) * (ln(pred) - ln(truth)))), 6) AS log_rmse, round(stddev_pop(ln(pred) - ln(truth)), 6) AS silog,
        round(sqrt(avg((1 / pred - 1 / truth) * (1 / pred - 1 / truth))), 6) AS irmse, {", ".join(f"round(avg(CASE WHEN {_W} < CAST({1.25**k!r} AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS delta{k}" for k in (1, 2, 3))}, count(*) AS n FROM d GROUP BY phase""",
    "depth_bands": f"""WITH {_DEPTH}, b AS (SELECT *, CASE WHEN truth < 1 THEN 'near' WHEN truth < CAST(2.5 AS DOUBLE) THEN 'mid' ELSE 'far' END AS band FROM d)
        SELECT phase, band, round(avg(abs(pred - truth) / truth), 6) AS absrel, round(avg(CASE WHEN {_W} < CAST(1.25 AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS delta1, count(*) AS n FROM b GROUP BY ALL HAVING count(*) >= 100""",
    "depth_clip_mean": f"""WITH {_DEPTH}, f AS (SELECT phase, scene, avg(abs(pred - truth) / truth) AS absrel, sqrt(avg((pred - truth) * (pred - truth))) AS rmse FROM d GROUP BY ALL)
        SELECT phase, round(avg(absrel), 6) AS absrel, round(avg(rmse), 6) AS rmse, count(*) AS frames FROM f GROUP BY phase""",
    "depth_quality": """SELECT l_returnflag, round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero, round(avg(CASE WHEN l_discount >= CAST(0.1 AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS saturated,
        round(quantile_cont(l_quantity, 0.01), 6) AS p01, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.99), 6) AS p99, count(*) AS n FROM lineitem GROUP BY l_returnflag""",
    "box_iou": f"WITH {_BOXES} SELECT l_returnflag, round(avg({_iou(0)[0]}), 6) AS iou, round(avg({_iou(1)[0]}), 6) AS iou_inclusive, count(*) AS n FROM b GROUP BY l_returnflag",
    "box_giou": f"""WITH {_BOXES} SELECT l_returnflag, round(avg({_iou(1)[0]} - ({_HULL} - {_iou(1)[1]}) / CAST({_HULL} AS DOUBLE)), 6) AS giou,
        round(avg(CASE WHEN (cx + dx) / 2.0 BETWEEN ax AND bx AND (cy + dy) / 2.0 BETWEEN ay AND bz THEN 1.0 ELSE 0.0 END), 6) AS center_inside, round(avg(CASE WHEN {_VALID} THEN 1.0 ELSE 0.0 END), 6) AS valid FROM b GROUP BY l_returnflag""",
    "iou_accuracy": f"""WITH {_BOXES}, i AS (SELECT l_returnflag, {_VALID} AS valid, {_iou(1)[0]} AS iou FROM b)
        SELECT l_returnflag, {", ".join(f"round(avg(CASE WHEN valid AND iou >= CAST({t!r} AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS acc_{round(t * 100)}" for t in _ACC)},
        round(avg(CASE WHEN valid THEN iou ELSE 0.0 END), 6) AS mean_score, count(*) AS n, round(({" + ".join(f"avg(CASE WHEN valid AND iou >= CAST({t!r} AS DOUBLE) THEN 1.0 ELSE 0.0 END)" for t in _ACC)}) / 10, 6) AS mean_acc FROM i GROUP BY l_returnflag""",
    "vqa_score": f"""WITH {_BOXES}, i AS (SELECT l_returnflag, {_VALID} AS valid, CASE WHEN {_VALID} THEN {_iou(1)[0]} ELSE 0.0 END AS iou, CASE WHEN {_VALID} THEN {_iou(1)[0]} - ({_HULL} - {_iou(1)[1]}) / CAST({_HULL} AS DOUBLE) ELSE -1.0 END AS giou,
        (cx + dx) / 2.0 BETWEEN ax AND bx AND (cy + dy) / 2.0 BETWEEN ay AND bz AS inside FROM b)
        SELECT l_returnflag, round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6) AS valid_share, round(avg(iou), 6) AS mean_iou, round(avg(giou), 6) AS mean_giou, round(avg(CASE WHEN iou >= CAST(0.5 AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS acc_50,
            round(avg(CASE WHEN iou >= CAST(0.75 AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS acc_75, round(avg(CASE WHEN valid AND inside THEN 1.0 ELSE 0.0 END), 6) AS center, count(*) AS n FROM i GROUP BY GROUPING SETS ((l_returnflag), ())""",
    "box_scaling": f"""WITH {_SCALE} SELECT p_partkey, round(max(px) FILTER (WHERE o = 0), 6) AS x1, round(max(px) FILTER (WHERE o = 1), 6) AS y1, round(max(px) FILTER (WHERE o = 4), 6) AS x2,
        round(max(px) FILTER (WHERE o = 9), 6) AS y2 FROM b GROUP BY p_partkey""",
    "rotation_error": f"WITH {_POSE} SELECT vec_id, round(angle, 4) AS angle, round(angle, 4) AS matrix_angle, round(translation, 4) AS translation, round(direction, 4) AS direction, rotation_bin FROM c",
    "pose_vector": f"WITH {_POSE} SELECT label, rotation_bin, round(avg(angle), 4) AS angle, round(avg(translation), 4) AS translation, count(*) AS n FROM c GROUP BY ALL",
    "error_auc": f"""WITH {roles.SAMPLES_SQL}, t AS (SELECT i, CAST(5 AS DOUBLE) / 99 * i AS t FROM (SELECT unnest(range(100)) AS i)), c AS (SELECT phase, i, avg(CASE WHEN rmse <= t + 1e-12 THEN 1.0 ELSE 0.0 END) AS s FROM samples, t GROUP BY ALL),
        a AS (SELECT phase, (s + lead(s) OVER (PARTITION BY phase ORDER BY i)) / 2 AS area FROM c) SELECT phase, round(sum(area) / 99, 6) AS auc, (SELECT count(*) FROM samples s WHERE s.phase = a.phase) AS n FROM a GROUP BY phase""",
    "joint_success": f"WITH {roles.SAMPLES_SQL} SELECT phase, {', '.join(f'round({_share(a, b)}, 6) AS s{i}' for i, (a, b) in enumerate(_LIMITS))}, count(*) AS n FROM samples GROUP BY phase",
    "joint_auc": f"WITH {roles.SAMPLES_SQL} SELECT phase, round(({' + '.join(_share(a, b / 100) for a in (1, 2, 3, 4, 5) for b in (2, 4, 6, 8))}) / 20, 6) AS auc FROM samples GROUP BY phase",
    "mean_iou": """WITH d AS (SELECT l_returnflag, CAST(l_linenumber AS BIGINT) AS pred, CAST(l_quantity AS BIGINT) % 8 - 1 AS truth FROM lineitem), t AS (SELECT l_returnflag, truth AS c, count(*) AS nt, count(*) FILTER (WHERE pred = truth) AS hit FROM d GROUP BY ALL),
        p AS (SELECT l_returnflag, pred AS c, count(*) AS np FROM d GROUP BY ALL) SELECT l_returnflag, round(coalesce(avg(hit / CAST(nt + coalesce(np, 0) - hit AS DOUBLE)) FILTER (WHERE c >= 0), 1.0), 6) AS miou,
            count(*) FILTER (WHERE c >= 0) AS classes FROM t LEFT JOIN p USING (l_returnflag, c) GROUP BY l_returnflag""",
    "confusion_matrix": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "token_f1": f"""WITH j AS (SELECT u.conv_id, u.turn, {_words("coalesce(u.text, '')")} AS p, {_words("coalesce(a.text, '')")} AS t FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn - 1 = u.turn AND u.role = 'user' AND a.role = 'assistant'),
        n AS (SELECT *, row_number() OVER () AS pair FROM j),
        a AS (SELECT pair, w, count(*) AS n FROM (SELECT pair, unnest(p) AS w FROM n) GROUP BY ALL), b AS (SELECT pair, w, count(*) AS n FROM (SELECT pair, unnest(t) AS w FROM n) GROUP BY ALL),
        c AS (SELECT pair, sum(least(a.n, b.n)) AS common FROM a JOIN b USING (pair, w) GROUP BY pair)
        SELECT conv_id, turn, round(coalesce(2.0 * common / CAST(len(p) + len(t) AS DOUBLE), 0.0), 6) AS f1 FROM n LEFT JOIN c USING (pair)""",
    "label_normalise": f"""SELECT p_partkey, {_norm("concat_ws('_', ' To ', p_name, 'x-y' || chr(9) || '(x)!')")} AS label FROM part""",
    "canonical_values": f"""WITH v AS (SELECT p_partkey, {_canonical("CASE WHEN p_partkey % 3 = 0 THEN 'GRAY' ELSE upper(split_part(p_name, ' ', 1)) END")} AS c,
            {_canonical("list_extract(['To  Drink', 'to eat ', 'To Snack', 'cut'], p_partkey % 4 + 1)")} AS f, {_canonical("p_type")} AS material FROM part)
        SELECT p_partkey, CASE c WHEN 'gray' THEN 'grey' ELSE c END AS colour, CASE f WHEN 'to drink' THEN 'drink' WHEN 'to eat' THEN 'eat' WHEN 'to snack' THEN 'snack' ELSE f END AS function, material FROM v""",
    "box_parsing": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS x1, CAST(1 AS DOUBLE) AS y1, CAST(p_size + 5 AS DOUBLE) AS x2, CAST(9 AS DOUBLE) AS y2 FROM part WHERE p_partkey % 3 <> 0",
    "metadata_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "roofline": """WITH p AS (SELECT p_partkey, p_size * CAST(1e9 AS DOUBLE) AS f, p_retailprice * CAST(1e4 AS DOUBLE) AS t FROM part), m AS (SELECT *, f / (CAST(19.5 AS DOUBLE) * 1e12) * 1e3 AS c, t / (CAST(2039 AS DOUBLE) * 1e9) * 1e3 AS m FROM p)
        SELECT p_partkey, round(c, 9) AS compute_ms, round(m, 9) AS memory_ms, round(greatest(c, m), 9) AS bound_ms, CASE WHEN c >= m THEN 'compute' ELSE 'memory' END AS bound, round(f / t, 9) AS intensity FROM m""",
}
