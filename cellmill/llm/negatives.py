"""Hard-negative mining by full score sorts.

Every anchor is scored against all rows: an integer inner product. Its rows stand in the order of falling score, then rising id. Its
positives are the first of its own label; for each, hard negatives are the first rows of other labels whose score is between two
shares of the positive's score, found by a binary search for the upper limit in the sorted scores and read from there down to the lower.

Rows and anchors are dealt in blocks of at most BLOCK each. A task holds one block of rows and one of anchors, sorts the block's scores for each
anchor, and sends the few best of each; the best of all blocks are the best of all rows, so both steps are exact. Anchors are sent to every block of
rows, rows to every block of anchors (one up to BLOCK anchors), so a row is sent once for every BLOCK anchors and not for each.

Sums of products that a double can't hold exactly are made with whole numbers of any size; a score beyond 64 bits counts as the largest (smallest)
64-bit number.

Edge cases: rows with a null label or vector, or a null or non-finite component, take no part; a null id takes part, is no anchor and comes
last among ties; repeated rows are rows each, and an anchor's copy is another row; vectors of different lengths don't compare; empty vectors score
zero; a positive with a negative score has no negatives, as its limits cross; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmill.llm.common import cut

BLOCK = 65_536
#: Scores in memory at once.
SCORES = 1 << 22
POSITIVES = 5
NEGATIVES = 10
#: Per cent of the positive's score that a negative may have.
LOW, HIGH = 30, 90
_EXACT = 2.0**52
_LONG = 2**63 - 1


def usable(label: Column, vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return label.isNotNull() & F.coalesce(fine, F.lit(False))


def quantised(vector: Column, scale: int = 256) -> Column:
    """Whole numbers: the floor of each component times scale."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, anchors by rows."""
    largest = np.linalg.norm(anchors.astype(np.float64), axis=1).max(initial=0) * np.linalg.norm(rows.astype(np.float64), axis=1).max(initial=0)
    if largest < _EXACT:
        return np.rint(anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = anchors.astype(object) @ rows.astype(object).T
    return np.clip(exact, -_LONG, _LONG).astype(np.int64)


def limits(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Lowest and highest score with low * positive <= 100 * score <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _matrix(column: pa.Array, at: np.ndarray, width: int) -> np.ndarray:
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), width)


def _blocks(table: pa.Table) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray]]:
    """Of the rows and anchors of a cell, by vector length: anchors, rows by id, scores; a slice of anchors at a time."""
    table = table.combine_chunks()
    is_anchor = table.column("as_anchor").to_numpy()
    column = table.column("vector").chunk(0) if table.num_rows else None
    widths = np.diff(column.offsets.to_numpy())
    ids = table.column("id")
    order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()))
    for width in np.unique(widths[is_anchor]).tolist():
        own = order[(widths[order] == width) & ~is_anchor[order]]
        asking = np.flatnonzero((widths == width) & is_anchor)
        if not len(own):
            continue
        rows = _matrix(column, own, width)
        for at in range(0, len(asking), step := max(1, SCORES // len(own))):
            these = asking[at : at + step]
            yield table.take(pa.array(these)), table.take(pa.array(own)), scores(_matrix(column, these, width), rows)


def _cells(rows: DataFrame, anchors: DataFrame, each: Callable, schema: str, extra: list[str], block: int) -> DataFrame:
    """Deals rows and anchors in blocks and applies `each` to every cell of both."""
    spark = rows.sparkSession
    n_rows = max(-(-rows.count() // block), int(spark.conf.get("spark.sql.shuffle.partitions")))  # tasks enough for a small table
    n_anchors = max(-(-anchors.count() // block), 1)
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    nothing = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra]
    of_rows = rows.select(F.pmod(F.xxhash64("row"), F.lit(n_rows)).alias("rb"), F.explode(numbers(n_anchors)).alias("ab"), F.lit(False).alias("as_anchor"), "row", "id", "label", "vector", *nothing)
    of_anchors = anchors.select(F.explode(numbers(n_rows)).alias("rb"), F.pmod(F.xxhash64("row"), F.lit(n_anchors)).alias("ab"), F.lit(True).alias("as_anchor"), "row", "id", "label", "vector", *extra)
    return of_rows.unionByName(of_anchors).groupBy("ab", "rb").applyInArrow(each, schema)


def _best(found: DataFrame, by: list[str], score: str, ident: str, tie: str, k: int) -> DataFrame:
    """The first k of each group by falling score, then rising id; `rank` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.col(ident).asc_nulls_last(), tie)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def positives_of(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES, block: int = BLOCK) -> DataFrame:
    """anchor_row, positive_row, positive_id, positive_score, rank."""

    def each(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for asking, own, score in _blocks(table):
            label, number, ids = own.column("label").to_numpy(), own.column("row").to_numpy(), own.column("id").to_pylist()
            for line, its_label, its_row in zip(score, asking.column("label").to_pylist(), asking.column("row").to_pylist()):
                order = np.argsort(-line, kind="stable")  # rows are by id, so ties are too
                same = order[(label[order] == its_label) & (number[order] != its_row)][:k]
                out += [(its_row, int(number[i]), ids[i], int(line[i])) for i in same]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["anchor_row", "positive_row", "positive_id", "positive_score"])

    schema = "anchor_row bigint, positive_row bigint, positive_id bigint, positive_score bigint"
    return _best(_cells(rows, anchors, each, schema, [], block), ["anchor_row"], "positive_score", "positive_id", "positive_row", k)


def negatives_of(rows: DataFrame, anchors: DataFrame, k: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """anchor_row, positive_rank, negative_id, negative_score, rank. anchors have `positives`: the positives' scores by rank."""

    def each(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for asking, own, score in _blocks(table):
            label, number, ids = own.column("label").to_numpy(), own.column("row").to_numpy(), own.column("id").to_pylist()
            for line, its_label, its_row, wanted in zip(score, asking.column("label").to_pylist(), asking.column("row").to_pylist(), asking.column("positives").to_pylist()):
                order = np.argsort(-line, kind="stable")
                order = order[label[order] != its_label]
                falling = -line[order]
                for rank, positive in enumerate(wanted, 1):
                    least, most = limits(positive, low, high)
                    begin = int(np.searchsorted(falling, -most, side="left"))
                    chosen = order[begin : begin + k]
                    out += [(its_row, rank, ids[i], int(line[i]), int(number[i])) for i in chosen if line[i] >= least]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=["anchor_row", "positive_rank", "negative_id", "negative_score", "negative_row"])

    schema = "anchor_row bigint, positive_rank bigint, negative_id bigint, negative_score bigint, negative_row bigint"
    return _best(_cells(rows, anchors, each, schema, ["positives"], block), ["anchor_row", "positive_rank"], "negative_score", "negative_id", "negative_row", k)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """One row per anchor, positive and hard negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: a condition on
    the columns `id` and `label`."""
    fine = rows.filter(usable(rows[label_col], rows[vector_col]))
    plain = fine.select(rows[id_col].cast("long").alias("id"), rows[label_col].cast("long").alias("label"), quantised(rows[vector_col]).alias("vector"))
    settled = cut(plain.withColumn("row", F.monotonically_increasing_id()))
    anchors = cut(settled.filter(anchor & F.col("id").isNotNull()))
    found = cut(positives_of(settled, anchors, positives, block))
    listed = found.groupBy(F.col("anchor_row").alias("of")).agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("ranked"))  # at most `positives` each
    asking = cut(anchors.join(listed, F.col("row") == F.col("of")).withColumn("positives", F.transform("ranked", lambda x: x["positive_score"])).drop("of", "ranked"))
    each = negatives_of(settled, asking, negatives, low, high, block)
    pairs = found.select(F.col("anchor_row").alias("a"), F.col("rank").cast("long").alias("p"), "positive_id", "positive_score").join(anchors.select(F.col("row").alias("r"), F.col("id").alias("anchor_id")), F.col("a") == F.col("r"))
    joined = each.join(pairs, (F.col("anchor_row") == F.col("a")) & (F.col("positive_rank") == F.col("p")))
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
