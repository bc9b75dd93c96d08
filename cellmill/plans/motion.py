"""Queries of flow, reprojection, pose tracks and neighbour-preserving axes, with equal SQL where SQL can express them.

Frames are vectors of 64 numbers as 8 x 8 depth maps, twelve to a clip by number; poses turn and move with the frame's place in its clip.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from cellmill.functions import flow as L
from cellmill.functions import images as I
from cellmill.functions import kernels as K
from cellmill.operators import difficulty as D
from cellmill.operators import grouped as R
from cellmill.operators import manifold as N
from cellmill.operators import motions as M
from cellmill.operators import patches as H
from cellmill.operators import reprojection as P
from cellmill.plans.cells import METRICS, rounded
from cellmill.plans.grouped import CAMERA
from cellmill.plans.kernels import _quats
from cellmill.plans.sequences import KEYS, WEIGHTS, _dim, _normed, _wide_norms
from cellmill.sources.tables import table

SIDE, CLIP = 8, 12
TURN, MOVE = 0.05, (0.05, 0.01, 0.02)
LEAST = 3
#: Pairs of frames whose flows are found together.
FLOW_PAIRS = 256


def _frames(spark, sf):
    """clip, frame, truth, pred, flow_x, flow_y, pose"""
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / CLIP).alias("clip"), (F.col("vec_id") % CLIP).alias("frame"), F.col("embedding").cast("array<double>").alias("e"))
    at = lambda shift: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("e", (i + shift) % 64) * 6)
    half = F.col("frame") * (TURN / 2)
    pose = F.array(F.lit(0.0), F.sin(half), F.lit(0.0), F.cos(half), *[F.col("frame") * m for m in MOVE])
    truth = F.transform("e", lambda x: 2 + 4 * x)
    return e.select("clip", "frame", truth.alias("truth"), F.transform("e", lambda x, i: (2 + 4 * x) * 1.05 + (i % 3) * 0.02).alias("pred"), at(7).alias("flow_x"), at(29).alias("flow_y"), pose.alias("pose"))


def warping_errors(spark, sf):
    """Temporal consistency of clips along a given flow."""
    return rounded(P.warping_errors(_frames(spark, sf), ["clip"], "frame", "pred", "flow_x", "flow_y", SIDE, SIDE), 5)


def banded_alignment(spark, sf):
    """Temporal alignment of clips by band of true depth, pixels moved by the poses."""
    return rounded(P.banded_alignment(_frames(spark, sf), ["clip"], "frame", "pose", "pred", "truth", CAMERA, SIDE, SIDE, LEAST), 5)


def _maps(column: pa.ChunkedArray) -> np.ndarray:
    """(rows, SIDE, SIDE); what is null is not finite, so it has no flow."""
    flat = pc.fill_null(column, pa.scalar([None] * SIDE * SIDE, column.type)).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, SIDE, SIDE)


def _flow_scores(rows: pa.Table, group: np.ndarray) -> pa.Table:
    """A row a clip of many whole clips; neighbours of all clips are compared together, FLOW_PAIRS at a time."""
    truth, pred = _maps(rows.column("truth")), _maps(rows.column("pred"))
    first = np.flatnonzero(group[1:] == group[:-1])
    found = [np.zeros((2, 0))]
    for at in range(0, len(first), FLOW_PAIRS):
        a = first[at : at + FLOW_PAIRS]
        b = a + 1
        errors = L.pair_errors(pred[a], pred[b], L.dense_flows(truth[b], truth[a], window=5))
        found.append(np.stack([errors, L.motion_similarities((pred[a], pred[b]), (truth[a], truth[b]))]))
    scores, clips = np.concatenate(found, axis=1), int(group[-1]) + 1

    def mean(values: np.ndarray) -> pa.Array:
        ok = np.isfinite(values)
        n, total = (np.bincount(group[first[ok]], w, clips) for w in (None, values[ok]))
        return pa.array(np.where(n > 0, total / np.maximum(n, 1), np.nan), from_pandas=True)

    begins = np.flatnonzero(np.diff(group, prepend=-1))
    return pa.table({"clip": rows.column("clip").take(pa.array(begins)), "opw": mean(scores[0]), "tmc": mean(scores[1])})


def flow_scores(spark, sf):
    """Warping error along the flow of the true maps, and consistency of predicted with true motion, of each clip of twelve frames."""
    f = _frames(spark, sf).select("clip", "frame", "truth", "pred").filter("clip IS NOT NULL")
    return rounded(R.whole_groups(f, ["clip"], "frame", _flow_scores, "clip long, opw double, tmc double"), 4)


def _steps(spark, sf):
    """vec_id, label and slight motions: a true one and one that is a little off."""
    e, q, _, t, u = _quats(spark, sf)
    slight = [x * 0.02 for x in q[:3]] + [F.sqrt(1 - sum((x * x * 0.0004 for x in q[:3]), F.lit(0.0)))]
    return e.select("vec_id", "label", K.motion(slight, t).alias("truth"), K.motion(slight, [a + b * 0.01 for a, b in zip(t, u)]).alias("pred"))


def track_products(spark, sf):
    """Where each step of a label's track leads: the product of all steps so far."""
    p = M.products(_steps(spark, sf).filter("label IS NOT NULL"), "label", "vec_id", "truth")
    return rounded(p.select("vec_id", "label", K.motion_angle(F.col("pose")).alias("angle"), *[F.get("pose", F.lit(9 + i)).alias(f"t{i}") for i in range(3)]), 4)


def pose_tracks(spark, sf):
    """A camera's track against that of a board it sees, for each label: the board's pose is the camera's undone, and a little off."""
    p = M.products(M.products(_steps(spark, sf).filter("label IS NOT NULL"), "label", "vec_id", "truth", "cam"), "label", "vec_id", "pred", "other")
    return rounded(M.compare_tracks(p.withColumn("board", K.inverse(F.col("other"))), "label", "vec_id", "cam", "board"), 4)


def lpp_scores(spark, sf):
    """Percentile norms on the axis that keeps neighbours near."""
    return rounded(N.preserved(_wide_norms(spark, sf), KEYS, METRICS, 1), 4)


def lpp_consensus(spark, sf):
    """Tiers by the weighted mean, the first component and the neighbour-preserving axis vote."""
    wide = _wide_norms(spark, sf)
    mean = D.scores(_normed(spark, sf), KEYS, _dim(spark, WEIGHTS, "weight", "double")).select(*KEYS, F.round("weighted", 9).alias("v"))
    component = D.component_scores(wide, KEYS, METRICS).select(*KEYS, F.round("pc1", 9).alias("v"))
    preserved = N.preserved(wide, KEYS, METRICS, 1).select(*KEYS, F.round("lpp1", 9).alias("v"))
    votes = [D.tiers(s, "v", *KEYS).select(*KEYS, "tier") for s in (mean, component, preserved)]
    return D.consensus(votes[0].unionByName(votes[1]).unionByName(votes[2]), KEYS)


def patch_matches(spark, sf):
    """Patches of four numbers of two neighbouring vectors, matched both ways; masks are bands of a number's size."""
    e = table(spark, sf, "embeddings").filter("embedding IS NOT NULL").select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "x"))
    cut = e.withColumn("patch", F.floor(F.col("at") / 4)).withColumn("mask", F.floor(F.abs("x") * 20) % 3)
    patches = cut.groupBy("pair", "side", "patch").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("feature"))
    shares = cut.groupBy("pair", "side", "patch", "mask").agg((F.count(F.lit(1)) / 4).alias("share"))
    votes = H.mask_votes(H.mutual_matches(patches, ["pair"]), shares, ["pair"])
    return rounded(R.conflict_free(votes, ["pair"], "mask_a", "mask_b", "votes").select("pair", "mask_a", "mask_b", "votes"), 6)


def rank_equalised(spark, sf):
    """Vectors as depth in millimetres, equalised by rank."""
    e = table(spark, sf, "embeddings").filter("embedding IS NOT NULL").select("vec_id", F.posexplode("embedding").alias("pixel", "x"))
    pixels = e.select("vec_id", "pixel", F.rint(10 * (2 + 6 * F.col("x").cast("double"))).cast("int").alias("depth"))
    return rounded(H.equalised(pixels, ["vec_id"], "depth", 5.0, 40.0, 62), 6)


def boundary_distances(spark, sf):
    """Boundaries of predicted and true masks within one and a half pixels, and depth jumps on their edges, of each vector as a frame."""
    def run(batches):
        for b in batches:
            rows = []
            for e in b.embedding:
                x = np.array(e, float).reshape(SIDE, SIDE)
                pred, labels = x + 0.02 * np.sin(np.arange(SIDE)), (x > 0).astype(int) + (x > 0.15)
                rows.append({**I.boundary_scores(pred > 0.01, x > 0, 1.5), **I.edge_depth_scores(4 * pred, 4 * x, np.isfinite(x), labels, 0.3, 5)})
            yield pd.DataFrame({"vec_id": b.vec_id, **{n: [r[n] for r in rows] for n in ("accuracy", "completeness", "f", "edge_accuracy", "edge_completeness", "edge_f")}})

    names = "accuracy, completeness, f, edge_accuracy, edge_completeness, edge_f".split(", ")
    e = table(spark, sf, "embeddings").filter("embedding IS NOT NULL").select("vec_id", "embedding")
    return rounded(e.mapInPandas(run, "vec_id long, " + ", ".join(f"{n} double" for n in names)))


QUERIES = {f.__name__: f for f in (patch_matches, rank_equalised, boundary_distances, warping_errors, banded_alignment, flow_scores, track_products, pose_tracks, lpp_scores, lpp_consensus)}


def _sql_motion(q: list[str], t: list[str]) -> list[str]:
    x, y, z, w = q
    turn = [f"1 - 2 * ({y} * {y} + {z} * {z})", f"2 * ({x} * {y} - {z} * {w})", f"2 * ({x} * {z} + {y} * {w})", f"2 * ({x} * {y} + {z} * {w})", f"1 - 2 * ({x} * {x} + {z} * {z})", f"2 * ({y} * {z} - {x} * {w})",
            f"2 * ({x} * {z} - {y} * {w})", f"2 * ({y} * {z} + {x} * {w})", f"1 - 2 * ({x} * {x} + {y} * {y})"]
    return turn + t


def _sql_product(a: str, b: str) -> list[str]:
    turn = [" + ".join(f"{a}m{3 * i + k} * {b}m{3 * k + j}" for k in range(3)) for i in range(3) for j in range(3)]
    return turn + [" + ".join([*(f"{a}m{3 * i + k} * {b}m{9 + k}" for k in range(3)), f"{a}m{9 + i}"]) for i in range(3)]


def _named(values: list[str]) -> str:
    return ", ".join(f"{v} AS m{i}" for i, v in enumerate(values))


_UNIT = "sqrt(" + " + ".join(f"pow(CAST(embedding[{i}] AS DOUBLE), 2)" for i in range(1, 5)) + ")"
SLIGHT_SQL = f"""raw AS (SELECT vec_id, label, {", ".join(f"CAST(embedding[{i}] AS DOUBLE) / {_UNIT} * 0.02 AS q{i}" for i in (1, 2, 3))},
        {", ".join(f"CAST(embedding[{9 + i}] AS DOUBLE) AS t{i}" for i in range(3))}, {", ".join(f"CAST(embedding[{12 + i}] AS DOUBLE) AS u{i}" for i in range(3))} FROM embeddings),
    slight AS (SELECT *, sqrt(1 - q1 * q1 - q2 * q2 - q3 * q3) AS q4 FROM raw)"""
_FRAMES_SQL = f"""frames AS (
        SELECT vec_id // {CLIP} AS clip, vec_id % {CLIP} AS frame, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    pixels AS (
        SELECT clip, frame, i, 2 + 4 * e[i + 1] AS truth, (2 + 4 * e[i + 1]) * 1.05 + (i % 3) * 0.02 AS pred, 6 * e[(i + 7) % 64 + 1] AS fx, 6 * e[(i + 29) % 64 + 1] AS fy
        FROM frames, (SELECT unnest(range(64)) AS i))"""

_FX, _FY, _CX, _CY = CAMERA
ORACLE_SQL: dict[str, str] = {
    "warping_errors": f"""WITH {_FRAMES_SQL},
        maps AS (SELECT clip, frame, e, list_transform(e, lambda x, k: (2 + 4 * x) * 1.05 + ((k - 1) % 3) * 0.02) AS p FROM frames),
        aimed AS (
            SELECT n.clip, n.frame, n.p[i + 1] AS pred, b.p AS before, i % 8 + 6 * n.e[(i + 7) % 64 + 1] AS x, i // 8 + 6 * n.e[(i + 29) % 64 + 1] AS y
            FROM maps n JOIN maps b ON b.clip = n.clip AND b.frame = n.frame - 1, (SELECT unnest(range(64)) AS i)),
        cornered AS (
            SELECT *, CAST(floor(x) AS INT) AS x0, CAST(floor(y) AS INT) AS y0, least(CAST(floor(x) AS INT) + 1, 7) AS x1, least(CAST(floor(y) AS INT) + 1, 7) AS y1
            FROM aimed WHERE x >= 0 AND y >= 0 AND x <= 7 AND y <= 7),
        moved AS (
            SELECT clip, frame, pred, (before[y0 * 8 + x0 + 1] * (1 - (x - x0)) + before[y0 * 8 + x1 + 1] * (x - x0)) * (1 - (y - y0))
                + (before[y1 * 8 + x0 + 1] * (1 - (x - x0)) + before[y1 * 8 + x1 + 1] * (x - x0)) * (y - y0) AS was FROM cornered),
        means AS (SELECT clip, frame, avg(abs(was - pred) / pred) AS e FROM moved WHERE was > 0 AND pred > 0 GROUP BY clip, frame)
        SELECT clip, count(e) AS pairs, round(avg(e), 5) AS opw FROM (SELECT DISTINCT clip FROM frames) LEFT JOIN means USING (clip) GROUP BY clip""",
    "banded_alignment": f"""WITH {_FRAMES_SQL},
        turned AS (  -- a turn about the vertical axis
            SELECT clip, frame, i, pred AS z0, (i % 8 - {_CX}) * pred / {_FX} AS x0, (i // 8 - {_CY}) * pred / {_FY} AS y0, frame * {TURN} AS a, (frame + 1) * {TURN} AS b FROM pixels WHERE pred > 0),
        away AS (
            SELECT *, x0 * cos(a) + z0 * sin(a) - {MOVE[0]} AS wx, y0 - {MOVE[1]} AS wy, z0 * cos(a) - x0 * sin(a) - {MOVE[2]} AS wz FROM turned
            WHERE (clip, frame + 1) IN (SELECT (clip, frame) FROM frames)),
        seen AS (SELECT clip, frame, i, wx * cos(b) - wz * sin(b) AS x, wy AS y, wz * cos(b) + wx * sin(b) AS z FROM away),
        landed AS (SELECT clip, frame, i, z, round_even(x * {_FX} / z + {_CX}, 0) AS u, round_even(y * {_FY} / z + {_CY}, 0) AS v FROM seen WHERE z > 1e-6),
        won AS (SELECT clip, frame, CAST(v * 8 + u AS INT) AS i, arg_max(z, i) AS moved FROM landed WHERE u >= 0 AND v >= 0 AND u < 8 AND v < 8 GROUP BY clip, frame, CAST(v * 8 + u AS INT)),
        met AS (
            SELECT w.clip, w.frame, abs(moved - n.pred) / n.pred AS e,
                CASE WHEN t.truth >= 0.3 AND t.truth < 1 THEN 'near' WHEN t.truth >= 1 AND t.truth < 2.5 THEN 'mid' WHEN t.truth >= 2.5 AND t.truth < 5 THEN 'far' END AS band
            FROM won w JOIN pixels n ON n.clip = w.clip AND n.frame = w.frame + 1 AND n.i = w.i JOIN pixels t ON t.clip = w.clip AND t.frame = w.frame AND t.i = w.i WHERE n.pred > 0),
        each AS (SELECT clip, frame, band, avg(e) AS e FROM met WHERE band IS NOT NULL GROUP BY clip, frame, band HAVING count(*) >= {LEAST})
        SELECT clip, band, count(*) AS pairs, round(avg(e), 5) AS tae FROM each GROUP BY clip, band""",
    "track_products": f"""WITH RECURSIVE {SLIGHT_SQL},
        steps AS (
            SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, {_named(_sql_motion(["q1", "q2", "q3", "q4"], ["t0", "t1", "t2"]))}
            FROM slight WHERE label IS NOT NULL),
        so_far AS (
            SELECT * FROM steps WHERE k = 1
            UNION ALL SELECT s.vec_id, s.label, s.k, {", ".join(_sql_product("p.", "s."))} FROM so_far p JOIN steps s ON s.label = p.label AND s.k = p.k + 1)
        SELECT vec_id, label, round(degrees(acos(greatest(least((m0 + m4 + m8 - 1) / 2, 1), -1))), 4) AS angle, round(m9, 4) AS t0, round(m10, 4) AS t1, round(m11, 4) AS t2 FROM so_far""",
    "chain_drift": f"""WITH RECURSIVE {SLIGHT_SQL},
        truth AS (
            SELECT vec_id // 10 AS chain, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS k, {_named(_sql_motion(["q1", "q2", "q3", "q4"], ["t0", "t1", "t2"]))} FROM slight),
        pred AS (
            SELECT vec_id // 10 AS chain, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS k,
                {_named(_sql_motion(["q1", "q2", "q3", "q4"], ["t0 + u0 * 0.01", "t1 + u1 * 0.01", "t2 + u2 * 0.01"]))} FROM slight),
        a AS (SELECT * FROM truth WHERE k = 1 UNION ALL SELECT s.chain, s.k, {", ".join(_sql_product("p.", "s."))} FROM a p JOIN truth s ON s.chain = p.chain AND s.k = p.k + 1),
        b AS (SELECT * FROM pred WHERE k = 1 UNION ALL SELECT s.chain, s.k, {", ".join(_sql_product("p.", "s."))} FROM b p JOIN pred s ON s.chain = p.chain AND s.k = p.k + 1),
        summed AS (SELECT vec_id // 10 AS chain, count(*) AS k, sum(0.01 * sqrt(u0 * u0 + u1 * u1 + u2 * u2)) AS summed FROM raw GROUP BY vec_id // 10)
        SELECT chain, round(degrees(acos(greatest(least(({" + ".join(f"a.m{i} * b.m{i}" for i in range(9))} - 1) / 2, 1), -1))), 4) AS angle,
            round(sqrt(pow(a.m9 - b.m9, 2) + pow(a.m10 - b.m10, 2) + pow(a.m11 - b.m11, 2)), 4) AS drift, round(summed, 4) AS summed
        FROM summed JOIN a USING (chain, k) JOIN b USING (chain, k)""",
    "patch_matches": """WITH RECURSIVE e AS (
            SELECT vec_id // 2 AS pair, vec_id % 2 AS side, i // 4 AS patch, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE embedding IS NOT NULL),
        patches AS (SELECT pair, side, patch, list(x ORDER BY pos) AS f FROM e GROUP BY pair, side, patch),
        met AS (
            SELECT a.pair, a.patch AS pa, b.patch AS pb, round(list_inner_product(a.f, b.f) / (sqrt(list_inner_product(a.f, a.f)) * sqrt(list_inner_product(b.f, b.f))), 9) AS c
            FROM patches a JOIN patches b ON a.pair = b.pair AND a.side = 0 AND b.side = 1),
        mutual AS (
            SELECT pair, pa, pb FROM (SELECT *, row_number() OVER (PARTITION BY pair, pa ORDER BY c DESC, pb) AS x, row_number() OVER (PARTITION BY pair, pb ORDER BY c DESC, pa) AS y FROM met) WHERE x = 1 AND y = 1),
        shares AS (SELECT pair, side, patch, CAST(floor(abs(x) * 20) AS INT) % 3 AS mask, count(*) / 4 AS share FROM e GROUP BY ALL),
        votes AS (
            SELECT m.pair, a.mask AS mask_a, b.mask AS mask_b, sum(a.share * b.share) AS votes FROM mutual m
            JOIN shares a ON a.pair = m.pair AND a.side = 0 AND a.patch = pa JOIN shares b ON b.pair = m.pair AND b.side = 1 AND b.patch = pb GROUP BY ALL),
        g AS (
            SELECT *, false AS picked FROM votes
            UNION ALL SELECT pair, mask_a, mask_b, votes, p FROM (
                SELECT *, max(p) OVER (PARTITION BY pair, mask_a) OR max(p) OVER (PARTITION BY pair, mask_b) AS touched FROM (
                    SELECT *, row_number() OVER (PARTITION BY pair, mask_a ORDER BY votes DESC, mask_a, mask_b) = 1
                        AND row_number() OVER (PARTITION BY pair, mask_b ORDER BY votes DESC, mask_a, mask_b) = 1 AS p FROM g WHERE NOT picked)) WHERE p OR NOT touched)
        SELECT pair, mask_a, mask_b, round(votes, 6) AS votes FROM g WHERE picked""",
    "rank_equalised": """WITH p AS (
            SELECT vec_id, i AS pixel, CAST(round_even(10 * (2 + 6 * CAST(embedding[i + 1] AS DOUBLE)), 0) AS INT) AS depth FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE embedding IS NOT NULL),
        r AS (SELECT vec_id, pixel, cume_dist() OVER (PARTITION BY vec_id ORDER BY depth) AS share, count(*) OVER (PARTITION BY vec_id) AS n FROM p WHERE depth > 0)
        SELECT vec_id, pixel, depth, round(CASE WHEN n > 62 THEN share WHEN n IS NOT NULL THEN greatest(least((depth - 5) / 35, 1), 0) ELSE 0 END, 6) AS level FROM p LEFT JOIN r USING (vec_id, pixel)""",
}
