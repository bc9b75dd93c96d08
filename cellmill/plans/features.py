"""Queries of feature extraction, with equal SQL. Vectors are frames of 8 x 8 pixels; their labels are scenes, ids modulo three phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmill.operators import features as X
from cellmill.plans.cells import rounded
from cellmill.sources.tables import table

KEYS = ["scene", "phase"]
#: Features in the ten thousands: their last digits differ between engines.
LARGE = ("rgb_blur", "fisheye_sharpness")


def _frames(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("label").alias("scene"), F.pmod("vec_id", F.lit(3)).alias("phase"), F.col("vec_id").alias("frame"), F.col("embedding"))


def _pixels(spark, sf):
    p = _frames(spark, sf).select("scene", "phase", "frame", F.posexplode("embedding").alias("at", "v")).withColumn("v", F.col("v").cast("double"))
    luma = F.pmod(F.floor(F.abs("v") * 2000), F.lit(256))
    return p.select(
        "scene", "phase", "frame", F.pmod("at", F.lit(8)).alias("x"), F.floor(F.col("at") / 8).alias("y"), luma.alias("luma"),
        F.round(F.col("v") * 8 + 0.5, 4).alias("depth"), F.when(F.col("v") > 0.1, F.floor(F.col("at") / 16) + 1).otherwise(0).alias("object"),
    )


def _poses(spark, sf):
    return _frames(spark, sf).select("scene", "phase", "frame", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("px", "py", "pz", "qx", "qy", "qz", "qw"))])


def _faulty(spark, sf):
    """Rounds one to four list fewer and fewer frames."""
    f = _frames(spark, sf).select("scene", "phase", "frame", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("round"))
    return f.filter("frame % (round * 2) = 0")


def _fisheye(spark, sf):
    """The first and second half of a vector as images of 8 x 4; scene 3 has none."""
    at = F.col("at")
    luma = lambda i: F.pmod(F.floor(F.abs(F.get("embedding", i).cast("double")) * 2000), F.lit(256))
    p = _frames(spark, sf).filter("scene <> 3").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return p.select("scene", "phase", "frame", F.pmod(at, F.lit(8)).alias("x"), F.floor(at / 8).alias("y"), luma(at).alias("left"), luma(at + 32).alias("right"))


def phase_features(spark, sf):
    """All features of every scene and phase."""
    out = X.phase_features(_pixels(spark, sf), _poses(spark, sf), _faulty(spark, sf), _fisheye(spark, sf), KEYS, (8, 8), (8, 4), ["px", "py", "pz"], ["qx", "qy", "qz", "qw"])
    known = lambda c: F.nanvl(F.col(c), F.lit(None)) if c in X.FISHEYE else F.col(c)
    return out.select(*KEYS, *[F.round(known(c), 5 if c in LARGE else 9).alias(c) for c in out.columns if c not in KEYS])


def image_sharpness(spark, sf):
    """Sharpness and texture of every frame."""
    p = X.neighbours(_pixels(spark, sf), [*KEYS, "frame"], 8, 8)
    return rounded(p.groupBy("frame").agg(F.var_pop("lap").alias("blur"), F.avg("grad").alias("texture")), 5)


QUERIES = {f.__name__: f for f in (phase_features, image_sharpness)}


def _neighbours(value: str, source: str, height: int) -> str:
    last = 8 * (height - 1)
    return f"""SELECT *, l + r + u + d - 4.0 * own AS lap, sqrt(gx * gx + gy * gy) AS grad FROM (
        SELECT *, CASE x WHEN 0 THEN r - own WHEN 7 THEN own - l ELSE (r - l) / 2.0 END AS gx, CASE y WHEN 0 THEN d - own WHEN {height - 1} THEN own - u ELSE (d - u) / 2.0 END AS gy FROM (
        SELECT *, CAST({value} AS DOUBLE) AS own, CASE WHEN x = 0 THEN lead({value}, 7) OVER f ELSE lag({value}) OVER f END AS l, CASE WHEN x = 7 THEN lag({value}, 7) OVER f ELSE lead({value}) OVER f END AS r,
            CASE WHEN y = 0 THEN lead({value}, {last}) OVER f ELSE lag({value}, 8) OVER f END AS u, CASE WHEN y = {height - 1} THEN lag({value}, {last}) OVER f ELSE lead({value}, 8) OVER f END AS d
        FROM {source} WINDOW f AS (PARTITION BY frame ORDER BY y, x)))"""


_PIXELS = """fr AS (SELECT label AS scene, vec_id % 3 AS phase, vec_id AS frame, embedding FROM embeddings),
    e AS (SELECT scene, phase, frame, unnest(range(64)) AS pos, embedding FROM fr),
    v AS (SELECT scene, phase, frame, pos, CAST(embedding[pos + 1] AS DOUBLE) AS v FROM e),
    px AS (SELECT scene, phase, frame, pos % 8 AS x, pos // 8 AS y, CAST(floor(abs(v) * 2000) AS BIGINT) % 256 AS luma, round(v * 8 + CAST(0.5 AS DOUBLE), 4) AS depth,
        CASE WHEN v > CAST(0.1 AS DOUBLE) THEN pos // 16 + 1 ELSE 0 END AS object FROM v)"""
_CLIP = "CASE WHEN n >= 3 AND mad_{0} > 0 AND {0} > med_{0} + 5 * mad_{0} * CAST(1.4826 AS DOUBLE) THEN med_{0} ELSE {0} END"
ORACLE_SQL = {
    "image_sharpness": f"WITH {_PIXELS}, nb AS ({_neighbours('luma', 'px', 8)}) SELECT frame, round(var_pop(lap), 5) AS blur, round(avg(grad), 5) AS texture FROM nb GROUP BY frame",
    "phase_features": f"""WITH {_PIXELS}, nb AS ({_neighbours('luma', 'px', 8)}),
        fi AS (SELECT scene, phase, frame, count(*) AS pixels, avg(CASE WHEN depth <= 0 THEN 1.0 ELSE 0.0 END) AS depth_invalid, avg(CASE WHEN depth <= 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE object > 0) AS depth_invalid_mask,
            stddev_pop(depth) FILTER (WHERE depth > 0) AS depth_std, stddev_pop(depth) FILTER (WHERE depth > 0 AND object > 0) AS depth_std_mask,
            avg(CASE WHEN luma > 230 AND depth <= 0 THEN 1.0 ELSE 0.0 END) AS specular, avg(CASE WHEN luma < 30 AND depth <= 0 THEN 1.0 ELSE 0.0 END) AS dark, var_pop(lap) AS rgb_blur, avg(grad) AS rgb_texture
            FROM nb GROUP BY ALL),
        im AS (SELECT scene, phase, {", ".join(f"coalesce(avg({c}), 0) AS {c}" for c in ("depth_invalid", "depth_invalid_mask", "depth_std", "depth_std_mask", "specular", "dark", "rgb_blur", "rgb_texture"))} FROM fi GROUP BY ALL),
        bx AS (SELECT scene, phase, frame, object, count(*) AS area, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM px WHERE object > 0 GROUP BY ALL),
        cn AS (SELECT fi.scene, fi.phase, fi.frame, coalesce(n, 0) AS n FROM fi LEFT JOIN (SELECT frame, count(*) AS n FROM bx GROUP BY frame) USING (frame)),
        tt AS (SELECT scene, phase, count(DISTINCT object) AS objects FROM bx GROUP BY ALL),
        nu AS (SELECT scene, phase, avg(n) AS obj_mean, stddev_pop(n) AS obj_std, avg(CASE WHEN n = objects THEN 1.0 ELSE 0.0 END) AS obj_consist FROM cn LEFT JOIN tt USING (scene, phase) GROUP BY ALL),
        sz AS (SELECT scene, phase, avg(a) / 64 AS mask_area_mean, stddev_pop(a) / 64 AS mask_area_std FROM (SELECT scene, phase, object, avg(area) AS a FROM bx GROUP BY ALL) GROUP BY ALL),
        gr AS (SELECT f.scene, f.phase, f.frame, o.object, coalesce(bx.area, 0) AS area FROM fi f JOIN (SELECT DISTINCT scene, phase, object FROM bx) o USING (scene, phase) LEFT JOIN bx ON bx.frame = f.frame AND bx.object = o.object),
        lg AS (SELECT *, lag(area) OVER (PARTITION BY scene, phase, object ORDER BY frame) AS was FROM gr),
        ob AS (SELECT scene, phase, object, count(*) AS t, stddev_pop(area) FILTER (WHERE area > 0) / avg(area) FILTER (WHERE area > 0) AS cv, count(*) FILTER (WHERE was > 0) AS shown,
            count(*) FILTER (WHERE was > 0 AND (was - area) / CAST(was AS DOUBLE) > 0.5) AS fell, count(*) FILTER (WHERE (area > 0) <> (was > 0)) AS flips FROM lg GROUP BY ALL),
        st AS (SELECT scene, phase, avg(cv) AS area_cv, avg(fell / CAST(t AS DOUBLE)) FILTER (WHERE shown > 0) AS area_drop, avg(flips / CAST(t AS DOUBLE)) FILTER (WHERE t > 1) AS vis_instability FROM ob GROUP BY ALL),
        cv AS (SELECT a.scene, a.phase, a.frame, a.object, sum(CASE WHEN a.object <> b.object THEN greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) ELSE 0 END)
            / CAST(max((a.x2 - a.x1) * (a.y2 - a.y1)) AS DOUBLE) AS c FROM bx a JOIN bx b ON a.frame = b.frame GROUP BY ALL),
        oc AS (SELECT scene, phase, avg(c) AS occ_mean, quantile_cont(c, 0.9) AS occ_p90, avg(CASE WHEN c > CAST(0.3 AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS occ_heavy
            FROM (SELECT scene, phase, object, avg(c) AS c FROM cv GROUP BY ALL) GROUP BY ALL),
        ps AS (SELECT scene, phase, frame, {", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS p{i}" for i in range(7))} FROM fr),
        sp AS (SELECT scene, phase, frame, sqrt({" + ".join(f"pow(p{i} - lag(p{i}) OVER w, 2)" for i in range(3))}) AS step,
            2 * acos(least(abs({" + ".join(f"p{i} * lag(p{i}) OVER w" for i in range(3, 7))}) / (sqrt({" + ".join(f"p{i} * p{i}" for i in range(3, 7))}) * sqrt({" + ".join(f"pow(lag(p{i}) OVER w, 2)" for i in range(3, 7))})), 1.0)) AS turn
            FROM ps WINDOW w AS (PARTITION BY scene, phase ORDER BY frame)),
        s1 AS (SELECT * FROM sp WHERE step IS NOT NULL),
        md AS (SELECT scene, phase, count(*) AS n, median(step) AS med_step, median(turn) AS med_turn FROM s1 GROUP BY ALL),
        ma AS (SELECT scene, phase, median(abs(step - med_step)) AS mad_step, median(abs(turn - med_turn)) AS mad_turn FROM s1 JOIN md USING (scene, phase) GROUP BY ALL),
        cl AS (SELECT scene, phase, frame, {_CLIP.format("step")} AS step, {_CLIP.format("turn")} AS turn FROM s1 JOIN md USING (scene, phase) JOIN ma USING (scene, phase)),
        jk AS (SELECT *, abs(step - lag(step) OVER (PARTITION BY scene, phase ORDER BY frame)) AS j FROM cl),
        mo AS (SELECT scene, phase, avg(step) AS trans_mean, quantile_cont(step, 0.9) AS trans_p90, avg(turn) AS rot_mean, quantile_cont(turn, 0.9) AS rot_p90, coalesce(avg(j), 0) AS jerk FROM jk GROUP BY ALL),
        ef AS (SELECT scene, phase, avg(k) AS iter_mean, CAST(max(k) AS DOUBLE) AS iter_max FROM (SELECT scene, phase, 1 + (frame % 2 = 0)::INT + (frame % 4 = 0)::INT + (frame % 6 = 0)::INT + (frame % 8 = 0)::INT AS k FROM fr) GROUP BY ALL),
        fs AS (SELECT scene, phase, frame, pos % 8 AS x, pos // 8 AS y, CAST(floor(abs(CAST(embedding[pos + 1] AS DOUBLE)) * 2000) AS BIGINT) % 256 AS lft,
            CAST(floor(abs(CAST(embedding[pos + 33] AS DOUBLE)) * 2000) AS BIGINT) % 256 AS rgt FROM e WHERE pos < 32 AND scene <> 3),
        fn AS ({_neighbours('lft', 'fs', 4)}),
        ff AS (SELECT scene, phase, frame, avg(CASE WHEN lft < 30 THEN 1.0 ELSE 0.0 END) AS fisheye_dark, avg(CASE WHEN lft > 230 THEN 1.0 ELSE 0.0 END) AS fisheye_bright, var_pop(lap) AS fisheye_sharpness,
            corr(lft, rgt) AS fisheye_corr, avg(grad) AS fisheye_texture FROM fn GROUP BY ALL),
        fe AS (SELECT scene, phase, {", ".join(f"avg({c}) AS {c}" for c in X.FISHEYE)} FROM ff GROUP BY ALL)
        SELECT scene, phase, {", ".join(f"round(coalesce({c}, 0), {5 if c in LARGE else 9}) AS {c}" for c in ("depth_invalid", "depth_invalid_mask", "depth_std", "depth_std_mask", "specular", "dark", "rgb_blur", "rgb_texture", "obj_mean", "obj_std", "obj_consist",
            "mask_area_mean", "mask_area_std", "area_cv", "area_drop", "vis_instability", "occ_mean", "occ_p90", "occ_heavy", "trans_mean", "trans_p90", "rot_mean", "rot_p90", "jerk", "iter_mean", "iter_max"))},
            {", ".join(f"round({c}, {5 if c in LARGE else 9}) AS {c}" for c in X.FISHEYE)}
        FROM im LEFT JOIN nu USING (scene, phase) LEFT JOIN sz USING (scene, phase) LEFT JOIN st USING (scene, phase) LEFT JOIN oc USING (scene, phase) LEFT JOIN mo USING (scene, phase)
        LEFT JOIN ef USING (scene, phase) LEFT JOIN fe USING (scene, phase)""",
}
