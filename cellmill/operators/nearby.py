"""Exact nearest rows in few dimensions, in leaves of a k-d tree.

Space is cut at medians of a bounded sample into leaves of about LEAF rows (at most MAX_LEAVES of them, so leaves grow beyond LEAF x MAX_LEAVES rows). Every row
first asks the leaf it lies in; the distance of its k-th find bounds what is left, and it visits only the leaves whose box lies within that
distance. The sample decides how the work is dealt, never the result. Where rows are spread over more dimensions than a few, a row visits more
leaves, up to all of them; rows at one place can't be cut and share a leaf, which is compared in chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmill.session import settle

LEAF, MAX_LEAVES = 1024, 4096
#: Sampled rows for each leaf, and numbers held at once in a comparison.
SAMPLED, CHUNK = 16, 4_000_000
#: Boxes are met a little beyond the bound, so that rounding hides none.
SLACK = 1 + 1e-9


def tree(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of boxes that fill the space: lower <= x < upper."""
    size = points.shape[1]
    open_ = [(points, np.full(size, -np.inf), np.full(size, np.inf), leaves)]
    done = []
    while open_:
        inside, low, high, n = open_.pop()
        axis = int(np.ptp(inside, axis=0).argmax()) if n > 1 and len(inside) > 1 else 0
        at = np.median(inside[:, axis]) if len(inside) else 0.0
        left = inside[:, axis] < at
        if n > 1 and len(inside) > 1 and not left.any():  # many rows at the smallest place
            above = inside[inside[:, axis] > at, axis]
            at = above.min() if len(above) else at
            left = inside[:, axis] < at
        if n < 2 or not left.any() or left.all():
            done.append((low, high))
            continue
        middle_high, middle_low = high.copy(), low.copy()
        middle_high[axis] = middle_low[axis] = at
        open_ += [(inside[left], low, middle_high, n // 2), (inside[~left], middle_low, high, n - n // 2)]
    return np.array([d[0] for d in done]), np.array([d[1] for d in done])


def _points(table: pa.Table | pa.RecordBatch, size: int) -> np.ndarray:
    return np.array(table.column("x").to_pylist(), np.float64).reshape(-1, size)


def _home(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    step = max(1, CHUNK // (low.size + 1))
    return np.concatenate([((x[at : at + step, None] >= low) & (x[at : at + step, None] < high)).all(axis=2).argmax(axis=1) for at in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _best(asks: np.ndarray, number: np.ndarray, x: np.ndarray, k: int, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of rows that ask, of their k nearest asked rows (ties to the smaller number; others: not rows of their own number), and squared distances."""
    there, here = np.flatnonzero(~asks), np.flatnonzero(asks)
    there = there[np.argsort(number[there], kind="stable")]
    none = np.zeros(0, np.int64)
    found = [(none, none, np.zeros(0))]
    step = max(1, CHUNK // (len(there) * x.shape[1] + 1))
    for at in range(0, len(here) if len(there) else 0, step):
        mine = here[at : at + step]
        gap = ((x[there][None] - x[mine][:, None]) ** 2).sum(axis=2)
        if others:
            gap[number[there][None] == number[mine][:, None]] = np.inf
        last = np.partition(gap, k - 1, axis=1)[:, k - 1 : k] if k < len(there) else np.inf
        r, c = np.nonzero((gap <= last) & (gap < np.inf))
        order = np.lexsort((c, gap[r, c], r))
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, c = r[place < k], c[place < k]
        found.append((mine[r], there[c], gap[r, c]))
    return tuple(np.concatenate(f) for f in zip(*found))


def nearest_rows(asking: DataFrame, asked: DataFrame, k: int, radius: float | None = None, others: bool = False, leaf: int = LEAF) -> DataFrame:
    """row, other, d2: the k asked rows nearest to each asking row (Euclidean, ties to the smaller number), not further than radius if that is given; others: rows
    of the same number don't count. asking, asked: row (a whole number), x (array of finite doubles, equally long)."""
    both = settle(asking.select("row", "x", F.lit(True).alias("asks")).unionByName(asked.select("row", "x", F.lit(False).alias("asks"))))
    total = both.count()
    leaves = min(MAX_LEAVES, max(1, -(-total // leaf)))
    share = min(1.0, SAMPLED * leaves / max(total, 1))
    drawn = both.filter(F.pmod(F.xxhash64("row", "asks"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * SAMPLED * leaves)
    sample = np.array([r.x for r in drawn.select("x").collect()], np.float64)  # 2 x SAMPLED x MAX_LEAVES at most
    if not len(sample):
        return both.limit(0).select("row", F.col("row").alias("other"), F.lit(0.0).alias("d2"))
    size = sample.shape[1]
    low, high = tree(sample, leaves)
    limit = np.inf if radius is None else radius * radius
    boxes = both.sparkSession.sparkContext.broadcast((low, high))

    def place(batches):
        for batch in batches:
            home = _home(_points(batch, size), *boxes.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], names=["row", "x", "asks", "leaf"])

    def ask(table: pa.Table, first: bool) -> pa.Table:
        """Finds (row, other, d2), and when a leaf is asked first the rows' (row, x, leaves to visit)."""
        asks, number, x = table.column("asks").to_numpy(zero_copy_only=False), table.column("row").to_numpy(), _points(table, size)
        a, b, d2 = _best(asks, number, x, k, others)
        fits = d2 <= limit
        rows, finds = number[a[fits]], number[b[fits]]
        out = {"row": rows, "other": finds, "d2": d2[fits], "x": [None] * len(rows), "leaves": [None] * len(rows)}
        if first:
            lows, highs = boxes.value
            here, bound = np.flatnonzero(asks), np.full(len(asks), np.inf)
            count = np.bincount(a, minlength=len(asks))
            np.maximum.at(reach := np.zeros(len(asks)), a, d2)
            bound[count >= k] = reach[count >= k]
            bound = np.minimum(bound, limit)
            own, step = table.column("leaf")[0].as_py(), max(1, CHUNK // (lows.size + 1))
            for at in range(0, len(here), step):
                mine = here[at : at + step]
                away = np.maximum(np.maximum(lows - x[mine][:, None], x[mine][:, None] - highs), 0.0)
                near = (away**2).sum(axis=2) <= bound[mine][:, None] * SLACK
                near[:, own] = False
                visits = [(i, np.flatnonzero(n).tolist()) for i, n in zip(mine, near) if n.any()]
                for name, values in (("row", [number[i] for i, _ in visits]), ("other", [None] * len(visits)), ("d2", [None] * len(visits)), ("x", [x[i].tolist() for i, _ in visits]), ("leaves", [v for _, v in visits])):
                    out[name] = list(out[name]) + values
        kinds = {"row": pa.int64(), "other": pa.int64(), "d2": pa.float64(), "x": pa.list_(pa.float64()), "leaves": pa.list_(pa.int32())}
        return pa.table({n: pa.array(v, kinds[n]) for n, v in out.items()})

    schema = "row bigint, other bigint, d2 double, x array<double>, leaves array<int>"
    placed = settle(both.select(F.col("row").cast("long").alias("row"), "x", "asks").mapInArrow(place, "row bigint, x array<double>, asks boolean, leaf int"))
    begun = settle(placed.groupBy("leaf").applyInArrow(lambda t: ask(t, True), schema))
    visits = begun.filter("leaves IS NOT NULL").select("row", "x", F.lit(True).alias("asks"), F.explode("leaves").alias("leaf"))
    ended = visits.unionByName(placed.filter("NOT asks")).groupBy("leaf").applyInArrow(lambda t: ask(t, False), schema)
    found = begun.filter("leaves IS NULL").unionByName(ended).select("row", "other", "d2")
    order = F.row_number().over(W.partitionBy("row").orderBy("d2", "other"))
    return found.withColumn("__k", order).filter(F.col("__k") <= k).drop("__k")
