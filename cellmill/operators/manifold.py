"""Locality-preserving projection: linear axes along which neighbours stay near.

Every row is tied to its nearest rows (Euclidean) by an edge of weight exp(-d^2 / t). With L the Laplacian of that graph and D its degrees, the
axes are the generalised eigenvectors of X'LX v = l X'DX v with the smallest eigenvalues. Both matrices are sums over edges:
X'LX of w (a - b)(a - b)' and X'DX of w (aa' + bb'), so only K x K numbers reach the driver, where the small problem is solved.

Nearest rows are found in leaves of a k-d tree (nearby).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.operators.nearby import LEAF, nearest_rows
from cellmill.operators.ranks import global_rank
from cellmill.session import settle

NEIGHBOURS = 10
BLOCK = 4096
RIDGE = 1e-9


def neighbour_edges(rows: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """row, other, d2: the k nearest other rows of each row (ties to the smaller number). rows: row (a unique number), x (array of doubles)."""
    return nearest_rows(rows, rows, k, others=True, leaf=min(block, LEAF))


def median(df: DataFrame, value: str) -> float | None:
    """The exact median, by ranks in sorted ranges."""
    ranked = global_rank(df.select(value), value)
    return ranked.filter((F.col("rank") * 2 >= F.col("total")) & (F.col("rank") * 2 <= F.col("total") + 2)).agg(F.avg(value)).first()[0]


def preserving_axes(df: DataFrame, features: list[str], n: int = 2, k: int = NEIGHBOURS, heat: float | None = None, block: int = BLOCK) -> np.ndarray:
    """(n, K) axes for columns of features, smallest eigenvalue first, each pointing where features grow together. heat: t of the weights, or the median
    squared distance of neighbours (1 where that is 0). Rows with a null or non-finite feature take no part; without two rows the axes are zero."""
    size = len(features)
    fine = sum(((F.isnan(f) | F.col(f).isNull() | (F.abs(f) == float("inf"))).cast("int") for f in features), F.lit(0)) == 0
    usable = df.filter(fine).select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    rows = settle(usable.withColumn("row", F.monotonically_increasing_id()))
    near = settle(neighbour_edges(rows, k, block))
    t = heat or median(near, "d2") or 1.0
    edges = near.select(F.least("row", "other").alias("row"), F.greatest("row", "other").alias("to"), F.exp(-F.col("d2") / t).alias("w")).distinct()
    ends = edges.join(rows, "row").withColumnRenamed("x", "a").join(rows.select(F.col("row").alias("to"), F.col("x").alias("b")), "to").select("w", "a", "b")

    def sums(batches):
        left, right = np.zeros((size, size)), np.zeros((size, size))
        for batch in batches:
            w, a, b = batch.column("w").to_numpy(), *(batch.column(c).flatten().to_numpy().reshape(-1, size) for c in "ab")
            left += (a - b).T @ (w[:, None] * (a - b))
            right += a.T @ (w[:, None] * a) + b.T @ (w[:, None] * b)
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * size * size), pa.int32()), pa.array(np.concatenate([left.ravel(), right.ravel()]))], names=["at", "s"])

    total = ends.mapInArrow(sums, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()  # 2 K x K numbers
    both = np.zeros(2 * size * size)
    for r in total:
        both[r["at"]] = r["s"]
    if not both.any():
        return np.zeros((n, size))
    left, right = both.reshape(2, size, size)
    inverse = np.linalg.inv(np.linalg.cholesky(right + RIDGE * np.eye(size)))
    axes = (inverse.T @ np.linalg.eigh(inverse @ left @ inverse.T)[1]).T[:n]
    return axes * np.where(axes.sum(axis=1) < 0, -1.0, 1.0)[:, None]


def preserved(df: DataFrame, keys: list[str], features: list[str], n: int = 2, k: int = NEIGHBOURS, heat: float | None = None) -> DataFrame:
    """keys and lpp1 .. lppn: the features' projections on the axes."""
    axes = preserving_axes(df, features, n, k, heat)
    on = lambda axis: sum((F.col(f) * float(w) for f, w in zip(features, axis)), F.lit(0.0))
    return df.select(*keys, *[on(a).alias(f"lpp{i + 1}") for i, a in enumerate(axes)])
