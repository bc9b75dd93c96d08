"""Benchmark plans: frames that several question streams share, dealt to slots; samples with a quota a cell. Draws are hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmill.operators import grouped as R
from cellmill.operators.sampling import hash_rank, top_by_hash
from cellmill.session import settle


def joint_frames(rows: DataFrame, cell: list[str], frame: str, stream: str, streams: list[str], n: int, seed: str) -> DataFrame:
    """n frames of each cell that every stream has, in hash order; half of them go to the first stream's slot, the others to the second's. Returns cell, frame,
    slot, eligible (frames to choose from), enough."""
    both = rows.filter(F.col(stream).isin(*streams)).groupBy(*cell, frame).agg(F.countDistinct(stream).alias("__s")).filter(F.col("__s") == len(streams)).drop("__s")
    counts = both.groupBy(*cell).agg(F.count(F.lit(1)).alias("eligible"))
    chosen = top_by_hash(both, cell, n, seed, *cell, frame)
    half = F.row_number().over(W.partitionBy(*cell).orderBy(hash_rank(f"{seed}-split", *cell, frame)))  # n rows a cell
    size = F.count(F.lit(1)).over(W.partitionBy(*cell))
    dealt = chosen.withColumn("slot", F.when(half <= F.floor(size / 2), streams[0]).otherwise(streams[1]))
    return dealt.join(counts, cell).select(*cell, frame, "slot", "eligible", (F.col("eligible") >= n).alias("enough"))


def full_plan(rows: DataFrame, cell: list[str], frame: str, stream: str, kind: str, identity: str, slots: list[tuple[str, str | None, str, str | None]], n: int, seed: str) -> DataFrame:
    """A plan of slots over n frames of each cell that have rows in every stream that a slot draws on (frames in hash order). A slot (name, stream, share, reason) takes all of the frames, the `first` half
    or the `second`, and one row of its stream for each, with the kinds kept even within cell and slot. A slot without a stream is pending: its frames are reserved, with the
    reason and no row. Returns cell, frame, slot, kind, identity, reason, eligible (frames to choose from) and enough. Only the rows of chosen frames are moved to the
    slots, so a group is as large as n frames."""
    needed = sorted({s for _, s, _, _ in slots if s})
    joint = rows.filter(F.col(stream).isin(needed)).groupBy(*cell, frame).agg(F.countDistinct(stream).alias("__s")).filter(F.col("__s") == len(needed)).drop("__s")
    counts = joint.groupBy(*cell).agg(F.count(F.lit(1)).alias("eligible"))
    chosen = top_by_hash(joint, cell, n, seed, *cell, frame)
    half = F.row_number().over(W.partitionBy(*cell).orderBy(hash_rank(f"{seed}-split", *cell, frame)))  # n rows a cell
    share = F.when(half <= F.floor(F.count(F.lit(1)).over(W.partitionBy(*cell)) / 2), "first").otherwise("second")
    text = lambda v: F.lit(v).cast("string")
    offered = F.explode(F.array(*[F.struct(text(a).alias("slot"), text(b).alias(stream), text(c).alias("share"), text(d).alias("reason")) for a, b, c, d in slots]))
    dealt = settle(chosen.withColumn("__share", share).select(*cell, frame, "__share", offered.alias("s")).select(*cell, frame, "__share", "s.*").filter("share IN ('all', __share)").drop("share", "__share"))
    candidates = dealt.join(rows.select(*cell, frame, stream, kind, identity), [*cell, frame, stream])
    taken = R.balanced_assign(candidates, [*cell, "slot"], frame, kind, identity, seed).withColumn("reason", text(None))
    nothing = [F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in (kind, identity)]
    pending = dealt.filter(F.col(stream).isNull()).select(*cell, "slot", frame, *nothing, "reason")
    return taken.unionByName(pending).join(counts, cell).select(*cell, frame, "slot", kind, identity, "reason", "eligible", (F.col("eligible") >= n).alias("enough"))


def require_enough(plan: DataFrame, cell: list[str], report: int = 20) -> DataFrame:
    """The plan, unless cells had too few frames to choose from: then an error that names some of them."""
    short = plan.filter(~F.col("enough")).select(*cell, "eligible").distinct().orderBy(*cell).limit(report).collect()
    if short:
        raise ValueError("too few eligible frames: " + ", ".join(f"{'/'.join(str(r[c]) for c in cell)} has {r.eligible}" for r in short))
    return plan


def quota_sample(rows: DataFrame, cell: list[str], scene: str, identity: list[str], n: int, seed: str) -> DataFrame:
    """n rows of each cell in hash order, a second row of a scene only after every other scene has had its turn. A scene sends n rows at most, so
    no cell is ranked as a whole."""
    rank = hash_rank(seed, *cell, scene, *identity)
    few = rows.distinct().withColumn("__turn", F.row_number().over(W.partitionBy(*cell, scene).orderBy(rank))).filter(F.col("__turn") <= n)
    return few.withColumn("__k", F.row_number().over(W.partitionBy(*cell).orderBy("__turn", rank))).filter(F.col("__k") <= n).drop("__turn", "__k")


def short_cells(sample: DataFrame, cells: DataFrame, cell: list[str], n: int) -> DataFrame:
    """Cells (of a list of all) with fewer than n rows in a sample."""
    have = sample.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(have, cell, "left").fillna(0, ["n"]).filter(F.col("n") < n)
