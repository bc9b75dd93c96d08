"""Products of rigid motions along tracks of any length, and the comparison of two pose tracks.

Motions are arrays of twelve doubles (functions.kernels.motion). Products are associative, so a track is cut into sorted ranges: each range
multiplies its own motions in order, the products of whole ranges are multiplied along a track, and every row gets the product of the
ranges before it in front. A track may fill many partitions; what is gathered for a track is one motion a range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmill.functions import kernels as K
from cellmill.operators.ranks import global_rank
from cellmill.session import settle


def composed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of motions (n, 12), a first."""
    left, right = a[:, :9].reshape(-1, 3, 3), b[:, :9].reshape(-1, 3, 3)
    return np.concatenate([(left @ right).reshape(-1, 9), np.einsum("nij,nj->ni", left, b[:, 9:]) + a[:, 9:]], axis=1)


def running(motions: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Product of each row's motion and all before it in its run; new: where a run begins. In about log2 n steps of whole arrays."""
    out, at = motions.copy(), np.arange(len(motions))
    begin = np.maximum.accumulate(np.where(new, at, 0))
    step = 1
    while step < len(out):
        rows = np.flatnonzero(at - step >= begin)
        if not len(rows):
            break
        out[rows] = composed(out[rows - step], out[rows])
        step *= 2
    return out


def products(steps: DataFrame, track: str, order: str, motion: str, out: str = "pose") -> DataFrame:
    """steps with `out`: the product of the track's motions up to and including this row, by `order` (equal ones in any order). Null
    motions count as no motion; a null track is a track."""
    kind = steps.schema[track].dataType.simpleString()
    filled = steps.withColumn("__motion", F.coalesce(F.col(motion), F.array(*map(F.lit, K.IDENTITY)))).withColumn("__tie", F.monotonically_increasing_id())
    sorted_ranges = filled.repartitionByRange(track, order, "__tie").sortWithinPartitions(track, order, "__tie")

    def within(batches):
        part, track_now, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("__track").to_pylist()
            rows = batch.column("__motion").flatten().to_numpy().reshape(-1, 12).copy()
            if last is not None and ids[0] == track_now:
                rows[0] = composed(last, rows[:1])[0]
            new = np.array([True, *(a != b for a, b in zip(ids[1:], ids))])
            done = running(rows, new)
            track_now, last = ids[-1], done[-1:]
            local = pa.FixedSizeListArray.from_arrays(pa.array(done.ravel()), 12).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("__track"), batch.column("__at"), local, pa.array([part] * batch.num_rows, pa.int32())], names=["__row", "__track", "__at", "__local", "__part"])

    packed = sorted_ranges.select(F.struct(*steps.columns).alias("__row"), F.col(track).alias("__track"), F.struct(order, "__tie").alias("__at"), "__motion")
    row, at = (packed.schema[c].dataType.simpleString() for c in ("__row", "__at"))
    local = settle(packed.mapInArrow(within, f"__row {row}, __track {kind}, __at {at}, __local array<double>, __part int"))
    whole = local.groupBy("__track", "__part").agg(F.max_by("__local", "__at").alias("whole"))
    begin = F.struct(F.array(*map(F.lit, K.IDENTITY)).alias("now"), F.array().cast("array<struct<part:int,before:array<double>>>").alias("seen"))
    grow = lambda acc, p: F.struct(K.compose(acc["now"], p["whole"]).alias("now"), F.concat(acc["seen"], F.array(F.struct(p["__part"].alias("part"), acc["now"].alias("before")))).alias("seen"))
    listed = whole.groupBy("__track").agg(F.array_sort(F.collect_list(F.struct("__part", "whole"))).alias("parts"))
    before = listed.select(F.col("__track").alias("__of"), F.explode(F.aggregate("parts", begin, grow)["seen"]).alias("p")).select("__of", F.col("p.part").alias("__in"), F.col("p.before").alias("__before"))
    joined = local.join(settle(before), (F.col("__part") == F.col("__in")) & F.col("__track").eqNullSafe(F.col("__of")))
    return joined.select("__row.*", K.compose(F.col("__before"), F.col("__local")).alias(out))


def rotation_vector(m: Column) -> list[Column]:
    """Axis times angle in radians of a motion's rotation (not at half a turn, where the axis has two signs)."""
    at = lambda i: F.get(m, F.lit(i))
    angle = F.radians(K.motion_angle(m))
    scale = F.when(F.abs(F.sin(angle)) < 1e-12, F.lit(0.5)).otherwise(F.try_divide(angle, 2 * F.sin(angle)))
    return [(at(a) - at(b)) * scale for a, b in ((7, 5), (2, 6), (3, 1))]


def compare_tracks(rows: DataFrame, track: str, frame: str, camera: str, board: str) -> DataFrame:
    """One row per track that two sources saw: a camera's poses (world from camera) and a board's (camera from board), both motions. Both
    tracks are taken relative to their first frames; steps are between neighbouring frames; the board, which stands still, must stay in one place in the
    world. No transform between the sources is fitted.

    Columns: frames, first_frame, last_frame; correlations of translations and rotation vectors by axis, of all together and of their sizes; errors
    relative to the anchor, of steps, and of steps by frame; mean_gap; drift of the board from its first place and jitter around its median
    place, with the share of outliers (median and MAD, 3.5) and the slope of its place by frame. Correlations are null where a side doesn't vary, step
    numbers where a track has one frame."""
    plain = rows.select(F.col(track).alias("track"), F.col(frame).cast("long").alias("frame"), F.col(camera).alias("cam"), F.col(board).alias("board")).filter("cam IS NOT NULL AND board IS NOT NULL AND frame IS NOT NULL")
    posed = plain.withColumn("ar", K.inverse(F.col("board"))).withColumn("world", K.compose(F.col("cam"), F.col("board")))
    ranked = settle(global_rank(posed, "track", "frame").drop("total"))
    first = F.min_by(F.struct("cam", "ar", "world"), "rank")
    anchors = ranked.groupBy(F.col("track").alias("of")).agg(first.alias("anchor"), *[F.median(F.get("world", F.lit(9 + i))).alias(f"mid{i}") for i in range(3)])
    same = F.col("track").eqNullSafe(F.col("of"))
    before = ranked.select(F.col("track").alias("prior"), (F.col("rank") + 1).alias("rank"), F.col("frame").alias("frame0"), F.col("cam").alias("cam0"), F.col("ar").alias("ar0"))
    both = ranked.join(anchors, same).join(before, "rank", "left")
    stepped = F.col("track").eqNullSafe(F.col("prior")) & F.col("frame0").isNotNull()
    shift = lambda m: [F.get(m, F.lit(9 + i)) for i in range(3)]
    apart = lambda a, b: K.norm([x - y for x, y in zip(a, b)])
    between = lambda a, b: K.motion_angle(K.relative(a, b))
    made = both.select(
        "track", "frame", K.relative(F.col("anchor.cam"), F.col("cam")).alias("c"), K.relative(F.col("anchor.ar"), F.col("ar")).alias("a"), "world", "anchor",
        F.when(stepped, K.relative(F.col("cam0"), F.col("cam"))).alias("cs"), F.when(stepped, K.relative(F.col("ar0"), F.col("ar"))).alias("as"),
        F.when(stepped, F.col("frame") - F.col("frame0")).alias("gap"), *[F.col(f"mid{i}") for i in range(3)],
    )
    place = shift(F.col("world"))
    each = made.select(
        "track", "frame", "gap", F.array(*shift(F.col("c"))).alias("ct"), F.array(*shift(F.col("a"))).alias("at"), F.array(*rotation_vector(F.col("c"))).alias("cr"), F.array(*rotation_vector(F.col("a"))).alias("ar"),
        apart(shift(F.col("c")), shift(F.col("a"))).alias("et"), between(F.col("c"), F.col("a")).alias("er"),
        apart(shift(F.col("cs")), shift(F.col("as"))).alias("st"), F.when(F.col("gap").isNotNull(), between(F.col("cs"), F.col("as"))).alias("sr"),
        apart(place, shift(F.col("anchor.world"))).alias("dt"), between(F.col("anchor.world"), F.col("world")).alias("dr"),
        apart(place, [F.col(f"mid{i}") for i in range(3)]).alias("jitter"), *[p.alias(f"p{i}") for i, p in enumerate(place)],
    )
    each = settle(each)
    rmse = lambda c: F.sqrt(F.avg(c * c))
    by_frame = lambda c: F.col(c) / F.greatest(F.col("gap"), F.lit(1))
    corr = lambda x, y: F.when((F.stddev_pop(x) >= 1e-12) & (F.stddev_pop(y) >= 1e-12), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    size = lambda c: K.norm([F.get(c, F.lit(i)) for i in range(3)])
    axes = [corr(F.get(a, F.lit(i)), F.get(b, F.lit(i))).alias(f"{n}_{'xyz'[i]}_corr") for n, a, b in (("translation", "ct", "at"), ("rotation", "cr", "ar")) for i in range(3)]
    slope = F.try_divide(F.sqrt(sum((F.pow(F.covar_pop("frame", f"p{i}"), F.lit(2)) for i in range(3)), F.lit(0.0))), F.var_pop("frame"))
    summary = each.groupBy("track").agg(
        F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), *axes,
        corr(size("ct"), size("at")).alias("translation_size_corr"), corr(size("cr"), size("ar")).alias("rotation_size_corr"),
        rmse(F.col("et")).alias("anchor_translation_rmse"), F.avg("et").alias("anchor_translation_mean"), F.avg("er").alias("anchor_rotation_mean"), rmse(F.col("er")).alias("anchor_rotation_rmse"),
        rmse(F.col("st")).alias("step_translation_rmse"), rmse(F.col("sr")).alias("step_rotation_rmse"), rmse(by_frame("st")).alias("step_translation_rmse_by_frame"), rmse(by_frame("sr")).alias("step_rotation_rmse_by_frame"),
        F.avg("gap").alias("mean_gap"), rmse(F.col("dt")).alias("board_translation_drift_rmse"), rmse(F.col("dr")).alias("board_rotation_drift_rmse"),
        F.avg("jitter").alias("jitter_mean"), F.median("jitter").alias("jitter_median"), F.percentile("jitter", 0.95).alias("jitter_p95"), F.max("jitter").alias("jitter_max"), F.min("jitter").alias("jitter_min"),
        slope.alias("board_slope_by_frame"),
    )
    stacked = each.select("track", F.explode(F.arrays_zip("ct", "at", "cr", "ar")).alias("z")).groupBy("track").agg(corr(F.col("z.ct"), F.col("z.at")).alias("translation_all_corr"), corr(F.col("z.cr"), F.col("z.ar")).alias("rotation_all_corr"))
    mids = summary.select(F.col("track").alias("of"), F.col("jitter_median").alias("mid"), (F.col("jitter_max") - F.col("jitter_min")).alias("span"))
    spread = settle(each.select("track", "jitter").join(mids, same))
    mads = spread.groupBy(F.col("track").alias("of")).agg(F.median(F.abs(F.col("jitter") - F.col("mid"))).alias("mad"))
    out = F.when(F.col("span") < 1e-9, False).when(F.col("mad") < 1e-12, F.col("jitter") > F.col("mid") + 1e-9).otherwise(F.col("jitter") - F.col("mid") > 3.5 * 1.4826 * F.col("mad"))
    rates = spread.drop("of").join(mads, same).groupBy("track").agg(F.avg(out.cast("double")).alias("outlier_rate"))
    null_safe = lambda df: df.withColumnRenamed("track", "of")
    return summary.drop("jitter_min").join(null_safe(stacked), same).drop("of").join(null_safe(rates), same).drop("of")
