"""Nearest vectors and the votes of their labels, in blocks of queries against blocks of rows.

Every query block meets every row block in one task, which keeps the best k rows of each query; a second step keeps the best k over all row
blocks. So no task holds more than two blocks, and what is sent back grows with queries times k times row blocks. The work is queries times
rows, by the rule of an exact search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmill.session import settle

QUERY_BLOCK, ROW_BLOCK = 1024, 8192


def _units(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of equal length, and which rows are usable (finite, not zero)."""
    size = max((len(v) for v in vectors if v is not None), default=0)
    rows = np.array([v if v is not None and len(v) == size and None not in v else [np.nan] * size for v in vectors], np.float64).reshape(len(vectors), size)
    norms = np.linalg.norm(rows, axis=1)
    fine = np.isfinite(norms) & (norms > 0)
    return np.where(fine[:, None], rows / np.where(fine, norms, 1.0)[:, None], 0.0), fine


def nearest(rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query, neighbour, cosine (rounded to nine places), place (from 1): the k rows nearest to each query other than itself, ties to the smaller
    id. Rows without an id or a usable vector take no part; ids must be unique."""
    plain = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("q"))
    sizes = plain.agg(F.count(F.lit(1)).alias("rows"), F.count_if("q").alias("queries")).first()
    row_blocks, query_blocks = -(-sizes.rows // ROW_BLOCK) or 1, -(-sizes.queries // QUERY_BLOCK) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = plain.select("id", "vector")
    left = plain.filter("q").select("id", "vector").withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("rb", every(row_blocks)).withColumn("asks", F.lit(True))
    right = base.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int")).withColumn("qb", every(query_blocks)).withColumn("asks", F.lit(False))
    dealt = left.select("qb", "rb", "asks", "id", "vector").unionByName(right.select("qb", "rb", "asks", "id", "vector"))

    def best(table: pa.Table) -> pa.Table:
        asks, ids = table.column("asks").to_numpy(zero_copy_only=False), table.column("id").to_numpy()
        unit, fine = _units(table.column("vector").to_pylist())
        out = []
        own = np.flatnonzero(~asks & fine)
        own = own[np.argsort(ids[own], kind="stable")]
        for at in np.flatnonzero(asks & fine):
            cosine = np.round(unit[own] @ unit[at], 9)
            cosine[ids[own] == ids[at]] = -np.inf
            order = np.argsort(-cosine, kind="stable")[:k]
            out += [(ids[at], ids[own[j]], cosine[j]) for j in order if np.isfinite(cosine[j])]
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate((("query", pa.int64()), ("neighbour", pa.int64()), ("cosine", pa.float64())))})

    found = settle(dealt.groupBy("qb", "rb").applyInArrow(best, "query bigint, neighbour bigint, cosine double"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def votes(neighbours: DataFrame, labels: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """query, label, share (of the similarity of its neighbours that the label has), agreed (whether it is the query's own label): the label with the largest
    share, ties to the smaller one."""
    known = labels.select(F.col(id_col).cast("long").alias("neighbour"), F.col(label_col).alias("label"))
    weight = F.greatest("cosine", F.lit(0.0))
    counted = neighbours.join(known, "neighbour").groupBy("query", "label").agg(F.sum(weight).alias("w"))
    total = F.sum("w").over(W.partitionBy("query"))
    shares = counted.withColumn("share", F.when(total > 0, F.col("w") / total).otherwise(0.0))
    top = shares.withColumn("k", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("share", 9)), "label"))).filter("k = 1")
    own = known.select(F.col("neighbour").alias("query"), F.col("label").alias("own"))
    return top.join(own, "query", "left").select("query", "label", "share", F.col("label").eqNullSafe(F.col("own")).alias("agreed"))
